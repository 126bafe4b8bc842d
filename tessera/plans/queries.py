"""Registered queries of the corpus, conversation and mixture operators, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.markup import to_markdown
from tessera.operators import attribution as at
from tessera.operators import catalogue as ct
from tessera.operators import conversations as cv
from tessera.operators import corpus as cp
from tessera.operators import manifest as mf
from tessera.operators import mixture as mx
from tessera.operators import personal as pn
from tessera.operators import quality as ql
from tessera.operators import similarity as sm
from tessera.operators import tokens as tk
from tessera.plans.registry import ORACLE_SQL, QUERIES, query
from tessera.plans.registry import read as _read
from tessera.sources import records as rc
from tessera.sources import tables as tb

_TEXT = "coalesce(text, '')"
_COLLAPSED = f"trim(regexp_replace({_TEXT}, '{tx.SPACE}+', ' ', 'g'))"


@query(f"SELECT doc_id, trim(regexp_replace(regexp_replace({_TEXT}, '{tx.NOISE}', '', 'g'), '{tx.SPACE}+', ' ', 'g')) AS cleaned FROM documents")
def noise_and_space(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.collapse_space(tx.strip_noise(F.coalesce("text", F.lit("")))).alias("cleaned"))


#: The given tables hold no HTML entity, so there unescaping changes nothing; a fixture tests it.
_CLEANED = f"trim(regexp_replace(regexp_replace(nfc_normalize({_TEXT}), '{tx.NOISE}', '', 'g'), '{tx.SPACE}+', ' ', 'g'))"


@query(f"SELECT doc_id, {_CLEANED} AS cleaned FROM documents WHERE {_CLEANED} <> ''")
def clean_documents(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.clean_text(F.coalesce("text", F.lit(""))).alias("cleaned")).where("cleaned != ''")


@query("SELECT doc_id, " + ", ".join(f"len(regexp_extract_all({_TEXT}, '{p}')) AS n_{k}" for k, p in tx.NOISE_CLASSES.items()) + " FROM documents")
def noise_findings(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", *[tx.noise_count(F.coalesce("text", F.lit("")), k).alias(f"n_{k}") for k in tx.NOISE_CLASSES])


@query("SELECT conv_id, turn, " + ", ".join(f"CAST((length(text) - length(replace(text, '{m}', ''))) / {len(m)} AS BIGINT) AS marker_{i}" for i, m in enumerate(tx.ROLE_MARKERS)) + " FROM conversations")
def role_markers(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", *[tx.literal_count(F.col("text"), m).alias(f"marker_{i}") for i, m in enumerate(tx.ROLE_MARKERS)])


@query(f"SELECT doc_id, 'sha256:' || sha256({_TEXT}) AS hash FROM documents")
def content_hashes(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.coalesce("text", F.lit(""))).alias("hash"))


@query(f"SELECT 'sha256:' || sha256({_TEXT}) AS hash, min(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY 1")
def exact_first(spark, sf_dir):
    return cp.exact_first(_read(spark, sf_dir, "documents"))


@query(
    f"""SELECT doc_id, len(list_filter(string_split_regex({_TEXT}, '{tx.SPACE}+'), lambda x: x <> '')) AS n_words,
    len(regexp_extract_all({_TEXT}, '{tx.UNIT_RUN}')) AS n_units, len(regexp_extract_all(lower(nfc_normalize({_TEXT})), '{tx.WORD_RUN}')) AS n_runs,
    length(regexp_replace({_TEXT}, '{tx.SPACE}', '', 'g')) AS n_visible FROM documents"""
)
def word_units(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _read(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(tx.words(t)).cast("long").alias("n_words"),
        F.regexp_count(t, F.lit(tx.UNIT_RUN)).cast("long").alias("n_units"),
        F.size(tx.lower_words(t)).cast("long").alias("n_runs"),
        F.length(F.regexp_replace(t, tx.SPACE, "")).cast("long").alias("n_visible"),
    )


@query(
    "WITH p AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g') AS t FROM documents) SELECT doc_id, "
    + ", ".join(f"length(regexp_replace(t, '[^\\x{{{a:X}}}-\\x{{{b:X}}}]', '', 'g')) AS n_{k.lower()}" for k, (a, b) in tx.SCRIPTS.items())
    + " FROM p"
)
def script_counts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", *[tx.script_count(F.coalesce("text", F.lit("")), k).alias(f"n_{k.lower()}") for k in tx.SCRIPTS])


_STOPS = {k: "[" + ", ".join(f"'{w}'" for w in some) + "]" for k, some in ql.STOP_WORD_LISTS.items()}
_LISTED = " ".join(f"WHEN '{k}' THEN {some}" for k, some in _STOPS.items())
_LETTERS = "regexp_replace(t, '[^\\p{L}]', '', 'g')"
_IN_SCRIPT = ", ".join(f"{{'n': length(regexp_replace({_LETTERS}, '[^\\x{{{a:X}}}-\\x{{{b:X}}}]', '', 'g')), 'at': {-i}, 'k': '{k}'}}" for i, (k, (a, b)) in enumerate(tx.SCRIPTS.items()))
_SCRIPT = f"list_max([{_IN_SCRIPT}]).k"

_MEASURES = f"""
WITH t AS (SELECT doc_id, source, {_TEXT} AS t FROM documents),
s AS (SELECT doc_id, source, t, list_filter(string_split_regex(t, '{tx.SPACE}+'), lambda x: x <> '') AS w,
      list_filter(list_transform(string_split(regexp_replace(t, '([.!?।॥]){tx.SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: trim(regexp_replace(x, '{tx.SPACE}+', ' ', 'g'))), lambda x: x <> '') AS s FROM t),
b AS (SELECT *, greatest(len(w), 1) AS nw, greatest(len(s), 1) AS ns, list_transform(w, lambda x: lower(x)) AS l FROM s),
g AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, g, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS g FROM b) GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT b.doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[^\\p{{L}}\\p{{M}}]', '', 'g')) / nw AS mean_word_length,
  (length(t) - length(replace(t, '#', '')) + length(t) - length(replace(t, '…', '')) + (length(t) - length(replace(t, '...', ''))) // 3) / nw AS symbols,
  len(list_filter(s, lambda x: contains('.!?', right(x, 1)))) / ns AS terminal_english,
  len(list_filter(s, lambda x: contains('.!?।॥…', right(x, 1)))) / ns AS terminal_aware,
  1 - len(list_distinct(s)) / ns AS duplicates, coalesce(g.top, 0) / greatest(len(w) - 1, 1) AS top_bigram,
  len(list_intersect(list_distinct(l), {_STOPS['Latin']})) AS stops_english, len(list_intersect(list_distinct(l), CASE {_SCRIPT} {_LISTED} ELSE {_STOPS['Latin']} END)) AS stops_aware,
  len(list_filter(s, lambda x: regexp_matches(x, '^{tx.SPACE}*[-*•·‣▪]|^{tx.SPACE}*[0-9]+[.)]{tx.SPACE}'))) / ns AS bullets,
  len(list_filter(s, lambda x: regexp_matches(x, '(\\.\\.\\.|…){tx.SPACE}*$'))) / ns AS ellipses
  FROM b LEFT JOIN g ON g.doc_id = b.doc_id)
"""


@query(
    _MEASURES
    + """SELECT doc_id, n_words, round(mean_word_length, 9) AS mean_word_length, round(symbols, 9) AS symbols, round(terminal_english, 9) AS terminal_english,
    round(terminal_aware, 9) AS terminal_aware, round(duplicates, 9) AS duplicates, round(top_bigram, 9) AS top_bigram, stops_english, stops_aware,
    round(bullets, 9) AS bullets, round(ellipses, 9) AS ellipses FROM m"""
)
def quality_measures(spark, sf_dir):
    m = ql.measures(_read(spark, sf_dir, "documents"), script=tx.dominant_script(F.coalesce("text", F.lit(""))))
    return m.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in m.dtypes])


@query(
    _MEASURES
    + """, f AS (SELECT source, unnest(list_filter([
      CASE WHEN NOT mean_word_length BETWEEN 3.0 AND 10.0 THEN 'mean_word_length' END, CASE WHEN symbols >= 0.10 THEN 'symbol_to_word_ratio' END,
      CASE WHEN terminal_aware < 0.30 THEN 'terminal_punctuation' END, CASE WHEN duplicates >= 0.30 THEN 'duplicate_lines' END,
      CASE WHEN top_bigram >= 0.20 THEN 'top_bigram' END, CASE WHEN stops_aware < 2 THEN 'stop_words' END,
      CASE WHEN bullets >= 0.90 THEN 'bullet_lines' END, CASE WHEN ellipses >= 0.30 THEN 'ellipsis_lines' END,
      CASE WHEN NOT n_words BETWEEN 50 AND 100000 THEN 'word_count' END], lambda x: x IS NOT NULL)) AS rule FROM m)
    SELECT source, rule, count(*) AS n FROM f GROUP BY GROUPING SETS ((rule), (source, rule))"""
)
def quality_failures(spark, sf_dir):
    return ql.failures(ql.judged(ql.measures(_read(spark, sf_dir, "documents"), ("doc_id", "source"), script=tx.dominant_script(F.coalesce("text", F.lit("")))))).select("source", "rule", "n")


@query(
    f"""WITH n AS (SELECT doc_id, source, CAST(n_chars AS BIGINT) AS k, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS c FROM documents),
    s AS (SELECT source, c, sum(k) AS k FROM n GROUP BY ALL),
    o AS (SELECT source, c, coalesce(sum(k) OVER (PARTITION BY source ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
    SELECT n.doc_id, n.source FROM n JOIN o ON n.source = o.source AND n.c = o.c WHERE before < 20000"""
)
def budgeted_read(spark, sf_dir):
    return cp.budgeted(_read(spark, sf_dir, "documents"), F.col("n_chars"), 20_000, chunk=5).select("doc_id", "source")


@query()
def pii_masked(spark, sf_dir):
    return pn.mask(_read(spark, sf_dir, "documents"), dial=0.5).select("doc_id", F.sha2("masked", 256).alias("masked_sha256"), F.size("spans").alias("n_spans"))


@query()
def pii_by_kind(spark, sf_dir):
    return pn.masked_by_kind(pn.mask(_read(spark, sf_dir, "documents")))


_ITEMS = f"SELECT item_id, 'b' || (item_id % 4) AS benchmark, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '{tx.WORD_RUN}') AS w FROM benchmark"


@query(
    f"""WITH i AS ({_ITEMS}), s AS (SELECT *, least(len(w), 13) AS width FROM i WHERE len(w) >= 6),
    x AS (SELECT item_id, benchmark, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS g FROM s),
    ix AS (SELECT width, g, arg_min(benchmark, item_id) AS benchmark FROM x GROUP BY width, g),
    d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize({_TEXT})), '{tx.WORD_RUN}') AS w FROM documents),
    e AS (SELECT DISTINCT doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS g
      FROM d, (SELECT DISTINCT width FROM ix) WHERE len(w) >= width)
    SELECT doc_id, benchmark, count(*) AS n_hits FROM e JOIN ix USING (width, g) GROUP BY doc_id, benchmark"""
)
def benchmark_collisions(spark, sf_dir):
    index = at.item_index(_read(spark, sf_dir, "benchmark"), F.concat(F.lit("b"), F.col("item_id") % 4))
    return at.collisions(_read(spark, sf_dir, "documents"), index)


@query(f"SELECT count(*) FILTER (len(w) >= 13) AS \"full\", count(*) FILTER (len(w) BETWEEN 6 AND 12) AS narrow, count(*) FILTER (len(w) < 6) AS refused FROM ({_ITEMS})")
def benchmark_widths(spark, sf_dir):
    return at.refused(_read(spark, sf_dir, "benchmark"))


@query(
    f"""WITH r AS (SELECT doc_id, {_TEXT} AS t, len(list_filter(string_split_regex({_TEXT}, '{tx.SPACE}+'), lambda x: x <> '')) AS n FROM documents),
    e AS (SELECT * FROM r WHERE doc_id IN (SELECT min(doc_id) FROM r GROUP BY t)), l AS (SELECT * FROM e WHERE n BETWEEN 50 AND 100000),
    c AS (SELECT 0 AS ord, 'read' AS stage, count(*) AS documents, sum(n) AS units FROM r UNION ALL SELECT 1, 'exact', count(*), sum(n) FROM e UNION ALL SELECT 2, 'length', count(*), sum(n) FROM l)
    SELECT CAST(ord AS INTEGER) AS ord, stage, documents, CAST(units AS BIGINT) AS units, round(units / first(units) OVER (ORDER BY ord), 4) AS share FROM c"""
)
def yield_descent(spark, sf_dir):
    kept = lambda d: d.join(cp.exact_first(d).select(F.col("keep_id").alias("doc_id")), "doc_id", "left_semi")
    long = lambda d: d.where(F.size(tx.words(F.coalesce("text", F.lit("")))).between(50, 100_000))
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return mf.yield_descent(mf.folded(docs, [("exact", kept), ("length", long)], lambda df, _: tb.cut(df))[1])


@query()
def pii_counts(spark, sf_dir):
    return cp.pii_counts(_read(spark, sf_dir, "documents"))


@query(
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '{tx.WORD_RUN}') AS w FROM documents),
    i AS (SELECT regexp_extract_all(lower(nfc_normalize(text)), '{tx.WORD_RUN}') AS w FROM benchmark),
    x AS (SELECT DISTINCT unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM i WHERE len(w) >= 13),
    d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM w WHERE len(w) >= 13)
    SELECT doc_id, count(*) AS n_hits FROM d SEMI JOIN x USING (g) GROUP BY doc_id"""
)
def decontamination(spark, sf_dir):
    return cp.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query(
    f"""WITH h AS (SELECT sha256({_TEXT}) AS h FROM documents), b AS (SELECT left(h, 3) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, '' ORDER BY b)) AS corpus_hash FROM b"""
)
def corpus_hash(spark, sf_dir):
    return cp.corpus_hash(_read(spark, sf_dir, "documents"))


@query("SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def language_breakdown(spark, sf_dir):
    return _read(spark, sf_dir, "documents").groupBy(F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("lang")).agg(F.count("*").alias("n"))


_TURNS = f"(SELECT conv_id, turn, lower(coalesce(role, 'user')) AS r, regexp_replace({_TEXT}, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g') AS t FROM conversations)"
_RENDERED = f"""SELECT conv_id, count(*) AS turns,
    coalesce(string_agg(t, chr(10) || chr(10) ORDER BY turn) FILTER (t <> ''), '') AS content,
    coalesce(string_agg(CASE WHEN r IN ('user', 'human') THEN '[USER]' WHEN r IN ('assistant', 'gpt') THEN '[ASSISTANT]' ELSE '[SYSTEM]' END || ' ' || t, ' ' ORDER BY turn) FILTER (t <> ''), '') AS samvaad,
    coalesce(string_agg('<|im_start|>' || r || chr(10) || t || '<|im_end|>' || chr(10), '' ORDER BY turn) FILTER (t <> ''), '') AS chatml,
    coalesce(string_agg(CASE WHEN r IN ('user', 'human') THEN '### Instruction:' ELSE '### Response:' END || chr(10) || t || chr(10), chr(10) ORDER BY turn) FILTER (t <> ''), '') AS alpaca,
    coalesce(string_agg(CASE WHEN r IN ('user', 'human') THEN 'Q:' WHEN r IN ('assistant', 'gpt') THEN 'A:' ELSE 'Note:' END || ' ' || t, chr(10) ORDER BY turn) FILTER (t <> ''), '') AS header
    FROM {_TURNS} GROUP BY conv_id"""


@query(_RENDERED)
def conversation_formats(spark, sf_dir):
    return cv.rendered(_read(spark, sf_dir, "conversations"))


@query(
    f"""WITH r AS ({_RENDERED}), s AS (SELECT sum(length(content)) AS content, sum(length(samvaad)) AS samvaad, sum(length(chatml)) AS chatml, sum(length(alpaca)) AS alpaca, sum(length(header)) AS header FROM r),
    l AS (SELECT content AS c, unnest(['content', 'samvaad', 'chatml', 'alpaca', 'header']) AS format, unnest([content, samvaad, chatml, alpaca, header]) AS u FROM s)
    SELECT format, CAST(u AS BIGINT) AS units, CAST(u - c AS BIGINT) AS overhead, round((u - c) / c, 4) AS share FROM l"""
)
def format_costs(spark, sf_dir):
    return cv.format_costs(cv.rendered(_read(spark, sf_dir, "conversations")))


@query("SELECT source, CAST(sum(n_chars) AS BIGINT) AS n_chars, round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 9) AS share FROM documents GROUP BY 1")
def source_shares(spark, sf_dir):
    return mx.shares(_read(spark, sf_dir, "documents"), "source", "n_chars").withColumn("share", F.round("share", 9))


@query(
    """WITH p AS (SELECT lang AS k, count(*) / (SELECT count(*) FROM documents) AS s FROM documents GROUP BY 1),
    r AS (SELECT lang AS k, sum(n_chars) / (SELECT sum(n_chars) FROM documents) AS s FROM documents GROUP BY 1)
    SELECT coalesce(p.k, r.k) AS lang, round(coalesce(p.s, 0), 9) AS planned, round(coalesce(r.s, 0), 9) AS realised, round(coalesce(r.s, 0) - coalesce(p.s, 0), 9) AS gap FROM p FULL JOIN r ON p.k = r.k"""
)
def mixture_deviation(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    plan = mx.shares(docs.withColumn("one", F.lit(1)), "lang", "one")
    return mx.deviation(plan, mx.shares(docs, "lang", "n_chars"), "lang").select("lang", *[F.round(c, 9).alias(c) for c in ("planned", "realised", "gap")])


@query(
    """SELECT CAST(e AS INTEGER) AS epochs, round(1e9 * (1 + 15.4 * (1 - exp(-(e - 1) / 15.4))), 3) AS worth,
    CASE WHEN e > 16.4 THEN 'beyond ceiling' WHEN e > 16 THEN 'exhausted' WHEN e > 4 THEN 'diminishing' WHEN e > 1 THEN 'repeated' WHEN e > 0.5 THEN 'sufficient' ELSE 'ample' END AS verdict FROM range(1, 65) AS t(e)"""
)
def repetition_worth(spark, sf_dir):
    e = F.col("epochs").cast("double")
    return spark.range(1, 65).select(F.col("id").cast("int").alias("epochs")).select("epochs", F.round(mx.worth_tokens(F.lit(1e9), e), 3).alias("worth"), mx.supply_verdict(e * 1e9, F.lit(1e9)).alias("verdict"))


@query(
    """SELECT doc_id, lang FROM documents WHERE CAST('0x' || left(md5('0:' || doc_id), 13) AS BIGINT) / 4503599627370496.0 < CASE lang WHEN 'en' THEN 0.25 WHEN 'fr' THEN 0.5 WHEN 'de' THEN 0.5 WHEN 'es' THEN 1.0 ELSE 0.0 END"""
)
def sampled_mixture(spark, sf_dir):
    return mx.stratified_sample(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", {"en": 0.25, "fr": 0.5, "de": 0.5, "es": 1.0})


_COUNTS = f"""SELECT coalesce(lang, '') AS lang, CAST(length(regexp_replace({_TEXT}, '{tx.SPACE}', '', 'g')) AS BIGINT) AS tokens,
    CAST(len(list_filter(string_split_regex({_TEXT}, '{tx.SPACE}+'), lambda x: x <> '')) AS BIGINT) AS units FROM documents"""
_FERTILITY = f"SELECT lang, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(units) AS BIGINT) AS units, CASE WHEN sum(units) > 0 THEN sum(tokens) / sum(units) ELSE 0.0 END AS fertility FROM ({_COUNTS}) GROUP BY lang"


def _fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    visible, words = F.length(F.regexp_replace(t, tx.SPACE, "")).cast("long"), F.size(tx.words(t)).cast("long")
    return tk.fertility(_read(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), visible.alias("tokens"), words.alias("units")))


@query(f"SELECT lang, tokens, units, round(fertility, 9) AS fertility FROM ({_FERTILITY})")
def character_fertility(spark, sf_dir):
    return _fertility(spark, sf_dir).withColumn("fertility", F.round("fertility", 9))


@query(
    f"""WITH f AS ({_FERTILITY}), o AS (SELECT max(fertility) - min(fertility) AS spread, sum(tokens) / sum(units) AS mean, max(fertility) FILTER (lang = 'hi') AS x FROM f),
    s AS (SELECT spread, mean, 1000 / spread AS score, coalesce(exp(greatest(0.0, x / 1.2 - 1)), 1.0) AS penalty FROM o)
    SELECT round(spread, 9) AS spread, round(mean, 9) AS mean, round(score, 6) AS score, round(penalty, 9) AS penalty, round(score / penalty, 6) AS adjusted FROM s"""
)
def fertility_scores(spark, sf_dir):
    s = tk.scores(_fertility(spark, sf_dir))
    return s.select(*[F.round(c, 6 if c in ("score", "adjusted") else 9).alias(c) for c in s.columns])


@query(
    f"""WITH s AS (SELECT lang, sum(tokens) AS size FROM ({_COUNTS}) GROUP BY lang), w AS (SELECT lang, max(size) OVER () / size AS w FROM s)
    SELECT lang, round(w / min(w) OVER (), 9) AS weight FROM w"""
)
def corpus_weights(spark, sf_dir):
    sizes = _fertility(spark, sf_dir).select("lang", F.col("tokens").alias("size"))
    return tk.corpus_weights(sizes).select("lang", F.round("weight", 9).alias("weight"))


@query(
    f"""WITH l AS (SELECT doc_id, string_split({_TEXT}, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM l)
    SELECT doc_id, CAST(pos AS INTEGER) AS pos, md5(line) AS line, pos % 5 = 2 AS held_out FROM e"""
)
def holdout_split(spark, sf_dir):
    return tk.held_out_lines(_read(spark, sf_dir, "documents"), offset=2).withColumn("line", F.md5("line"))


@query(
    f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize({_TEXT})), '{tx.WORD_RUN}') AS w FROM documents)
    SELECT doc_id, CAST(len(list_distinct(list_transform(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS BIGINT) AS n_shingles FROM w"""
)
def shingle_counts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.size(sm.shingles(F.coalesce("text", F.lit("")))).cast("long").alias("n_shingles"))


@query(
    """WITH s AS (SELECT * FROM (VALUES (14, 8), (28, 4), (7, 16), (6, 4)) AS t(bands, rows)), p AS (SELECT i / 20 AS similarity FROM range(21) AS t(i))
    SELECT bands, rows, round(pow(1 / bands, 1 / rows), 6) AS threshold, similarity, round(1 - pow(1 - pow(similarity, rows), bands), 6) AS captured FROM s, p"""
)
def capture_curve(spark, sf_dir):
    return sm.capture_curve(spark, [(14, 8), (28, 4), (7, 16), (6, 4)]).withColumn("threshold", F.round("threshold", 6)).withColumn("captured", F.round("captured", 6))


@query()
def near_survivors_greedy(spark, sf_dir):
    sets = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), sm.shingles(F.coalesce("text", F.lit(""))).alias("set"))
    return sm.greedy_dropped(sets, sm.threshold()).select(F.col("ord").alias("doc_id"), F.col("by").alias("dropped_by"))


@query()
def page_markdown(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", to_markdown(F.col("html"), F.col("url")).alias("markdown"))


@query("SELECT 'docs-' || lpad(CAST(row_number() OVER (ORDER BY doc_id) - 1 AS VARCHAR), 7, '0') AS id, doc_id FROM documents")
def document_ids(spark, sf_dir):
    return rc.numbered(_read(spark, sf_dir, "documents").select("doc_id"), "docs", "doc_id").select("id", "doc_id")


@query(
    """WITH v AS (SELECT CAST(v AS DOUBLE) AS v FROM range(64000, 320001, 8000) AS t(v)), r AS (SELECT v, 1 + 1.11 * pow(0.92, log2(v / 131072)) AS f, v / (v + 6.0 * 4096 * 32) AS c,
      1 + 1.11 * pow(0.92, log2(64000 / 131072)) AS f0, 64000 / (64000 + 6.0 * 4096 * 32) AS c0 FROM v)
    SELECT CAST(v AS BIGINT) AS vocab_size, round(f, 4) AS fertility, round(c, 6) AS softmax_cost, round((f0 - f) / f0, 6) AS token_saving, round((f0 - f) / f0 - (c - c0), 6) AS net_benefit FROM r"""
)
def vocabulary_sweep(spark, sf_dir):
    return ct.vocabulary_sweep(spark, 131_072, 2.11, 4096, 32)


@query(
    f"""WITH s AS (SELECT source, CAST(substr(source, 4) AS INTEGER) AS ord, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL), t AS (SELECT source, sum(n) AS d FROM s GROUP BY 1)
    SELECT lang, round(sum(n / d * d) / (SELECT sum(d) FROM t), 9) AS share FROM s JOIN t USING (source) GROUP BY lang"""
)
def realised_mixture(spark, sf_dir):
    n = _read(spark, sf_dir, "documents").where("source is not null and lang is not null").groupBy("source", "lang").agg(F.count("*").alias("n"))
    of = n.join(n.groupBy("source").agg(F.sum("n").alias("duration")), "source")
    stages = of.select(F.col("source").alias("ord"), F.col("duration").cast("double").alias("duration"), F.col("lang").alias("lane"), (F.col("n") / F.col("duration")).alias("share"))
    return mx.realised_mixture(stages).select(F.col("lane").alias("lang"), F.round("share", 9).alias("share"))


# Registered by import.
from tessera.plans import languages, near, small, stages  # noqa: E402, F401
