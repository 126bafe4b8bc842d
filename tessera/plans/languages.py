"""Registered queries of the language operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import language as lg
from tessera.plans.registry import query, read

_COLLAPSED = f"trim(regexp_replace(coalesce(text, ''), '{tx.SPACE}+', ' ', 'g'))"
_RANGES = [f"[\\x{{{a:X}}}-\\x{{{b:X}}}]" for a, b in tx.SCRIPTS.values()]
_NAMES = list(tx.SCRIPTS)


def _grams(t: str) -> str:
    return f"list_transform(range(1, greatest(length({t}) - 2, 1) + 1), lambda i: substr({t}, i, 3))"


def _script(t: str) -> str:
    """{n, k} of the block with most letters; letters outside all blocks count under one name."""
    plain = f"regexp_replace({t}, '[^\\p{{L}}]', '', 'g')"
    each = [f"{{'n': length(regexp_replace({plain}, '{r.replace('[', '[^')}', '', 'g')), 'at': {-i}, 'k': '{k}'}}" for i, (k, r) in enumerate(zip(_NAMES, _RANGES))]
    return f"list_sort([{', '.join(each)}], 'DESC')"


_PROFILES = f"""p AS (SELECT lang, ' ' || {_COLLAPSED} || ' ' AS t FROM documents WHERE lang IS NOT NULL),
    g AS (SELECT lang, unnest({_grams('t')}) AS gram FROM p), c AS (SELECT lang, gram, count(*) AS n FROM g WHERE length(gram) = 3 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r FROM c),
    f AS (SELECT lang, gram, n, ln((n + 1) / (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))) AS weight FROM r WHERE r <= 2000),
    fs AS (SELECT lang, ({_script('string_agg(repeat(gram, CAST(n AS INTEGER)), chr(32))')})[1].k AS script FROM f GROUP BY lang)"""
#: d(id, lang, t, chars) -> j(id, lang, script, script_share, code_switched, detected, best, second)
_JUDGED = f"""x AS (SELECT id, {_script('t')} AS s, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS letters FROM d),
    y AS (SELECT id, CASE WHEN letters = 0 THEN 'Unknown' ELSE s[1].k END AS script, CASE WHEN letters = 0 THEN 0.0 ELSE s[1].n / letters END AS script_share, letters > 0 AND s[2].n / letters >= 0.2 AS code_switched, letters FROM x),
    h AS (SELECT id, gram, count(*) AS k FROM (SELECT id, unnest({_grams("(' ' || t || ' ')")}) AS gram FROM d) WHERE length(gram) = 3 GROUP BY ALL),
    z AS (SELECT h.id, fs.lang, sum(k * coalesce(weight, -20.0)) / sum(k) AS score FROM h JOIN y ON y.id = h.id JOIN fs ON fs.script = y.script LEFT JOIN f ON f.lang = fs.lang AND f.gram = h.gram GROUP BY ALL),
    b AS (SELECT id, list(lang ORDER BY score DESC, lang) AS langs, list(score ORDER BY score DESC, lang) AS scores FROM z GROUP BY id),
    j AS (SELECT d.id, d.lang, script, script_share, code_switched, CASE WHEN chars >= 40 AND letters > 0 THEN langs[1] END AS detected,
      CASE WHEN chars >= 40 AND letters > 0 THEN scores[1] END AS best, CASE WHEN chars >= 40 AND letters > 0 THEN scores[2] END AS second FROM d JOIN y ON y.id = d.id LEFT JOIN b ON b.id = d.id)"""
_DOCUMENTS = f"d AS (SELECT doc_id AS id, lang, {_COLLAPSED} AS t, length(coalesce(text, '')) AS chars FROM documents)"


def _profiles(spark, sf_dir):
    return lg.language_profiles(read(spark, sf_dir, "documents"))


def _detected(spark, sf_dir):
    return lg.detect_language(read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), _profiles(spark, sf_dir))


@query(f"WITH {_PROFILES} SELECT lang, gram, n, round(weight, 9) AS weight FROM f")
def language_profiles(spark, sf_dir):
    return _profiles(spark, sf_dir).withColumn("weight", F.round("weight", 9))


@query(
    f"""WITH {_PROFILES}, {_DOCUMENTS}, {_JUDGED} SELECT id AS doc_id, script, round(script_share, 9) AS script_share, code_switched, detected, round(best, 6) AS score, round(second, 6) AS runner_up,
    CASE WHEN detected IS NULL THEN 0.0 WHEN second IS NULL THEN 1.0 ELSE round(least(1.0, 10 * abs(best - second) / greatest(abs(best), 1e-9)), 6) END AS confidence FROM j"""
)
def language_detection(spark, sf_dir):
    d = _detected(spark, sf_dir)
    return d.select("doc_id", "script", F.round("script_share", 9).alias("script_share"), "code_switched", "detected", *[F.round(c, 6).alias(c) for c in ("score", "runner_up", "confidence")])


@query(
    f"""WITH {_PROFILES}, {_DOCUMENTS}, {_JUDGED}, n AS (SELECT 'detected' AS kind, coalesce(detected, 'undecided') AS key FROM j UNION ALL SELECT 'script', script FROM j UNION ALL SELECT 'code_switched', '' FROM j WHERE code_switched
      UNION ALL SELECT CASE WHEN lang IN (SELECT lang FROM fs) THEN 'mismatch' ELSE 'unadjudicable' END, CASE WHEN lang IN (SELECT lang FROM fs) THEN lang || '->' || detected ELSE lang END FROM j WHERE detected IS NOT NULL AND lang <> '' AND lang <> detected),
    m AS (SELECT kind, key, count(*) AS n FROM n GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, key) AS r FROM m)
    SELECT kind, key, n FROM o WHERE kind <> 'mismatch' OR r <= 20"""
)
def language_report(spark, sf_dir):
    return lg.language_report(_detected(spark, sf_dir), _profiles(spark, sf_dir))


_CUT = f"""u AS (SELECT doc_id, lang, list_filter(string_split_regex(regexp_replace({_COLLAPSED}, '([.!?।॥]) ', '\\1' || chr(1), 'g'), ' *' || chr(1) || ' *'), lambda x: x <> '') AS s FROM documents WHERE lang IS NOT NULL),
    v AS (SELECT lang, n AS sentences, doc_id * 100000 + i AS id0, array_to_string(s[i:i + n - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(s) + 1, n)) AS i FROM u, (VALUES (1), (2), (5)) AS k(n))),
    d AS (SELECT id0 * 10 + sentences AS id, lang, sentences, t, length(t) AS chars FROM v)"""


@query(
    f"""WITH {_PROFILES}, {_CUT}, {_JUDGED}, q AS (SELECT lang, 1.0 / count(*) OVER (PARTITION BY script) AS chance FROM fs),
    a AS (SELECT CAST(j.id % 10 AS INTEGER) AS sentences, j.lang, CASE WHEN j.detected = j.lang THEN 1.0 ELSE 0.0 END AS hit, chance FROM j JOIN q ON q.lang = j.lang)
    SELECT sentences, lang, count(*) AS documents, round(avg(hit), 4) AS accuracy, round(avg(chance), 4) AS by_script FROM a GROUP BY GROUPING SETS ((sentences), (sentences, lang))"""
)
def language_grading(spark, sf_dir):
    return lg.graded_languages(read(spark, sf_dir, "documents"), _profiles(spark, sf_dir))
