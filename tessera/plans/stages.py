"""Registered queries of stage reports, budgets, formats and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import attribution as at
from tessera.operators import conversations as cv
from tessera.operators import corpus as cp
from tessera.operators import personal as pn
from tessera.operators import quality as ql
from tessera.operators import reports as rp
from tessera.operators import tokens as tk
from tessera.plans.queries import _CLEANED, _MEASURES, _RENDERED, _TEXT
from tessera.plans.registry import Literal, query, read
from tessera.sources import files as fl

_FAILS = {
    mode: f"NOT (mean_word_length BETWEEN 3.0 AND 10.0 AND symbols < 0.10 AND terminal_{mode} >= 0.30 AND duplicates < 0.30 AND top_bigram < 0.20 AND stops_{mode} >= 2 AND bullets < 0.90 AND ellipses < 0.30 AND n_words BETWEEN 50 AND 100000)"
    for mode in ("english", "aware")
}


def _measured(spark, sf_dir, keep=("doc_id", "source")):
    return ql.measures(read(spark, sf_dir, "documents"), keep, script=tx.dominant_script(F.coalesce("text", F.lit(""))))


_NFC = f"nfc_normalize({_TEXT})"
_FOUND = f"""SELECT doc_id, {_CLEANED} AS c, 0::BIGINT AS entities, 0::BIGINT AS double_escaped, {", ".join(f"len(regexp_extract_all({_NFC}, '{p}')) AS {k}" for k, p in tx.NOISE_CLASSES.items())}, len(regexp_extract_all({_NFC}, '{tx.SPACE}{{2,}}')) AS space_runs,
    {", ".join(f"CAST(length({_CLEANED}) - length(replace({_CLEANED}, '{j}', '')) AS BIGINT) AS joiner_{k}" for k, j in rp.JOINERS.items())}, length({_TEXT}) AS chars_before, length({_CLEANED}) AS chars_after, 'sha256:' || sha256({_TEXT}) AS raw_hash FROM documents"""


@query(f"SELECT * EXCLUDE (c), md5(c) AS cleaned FROM ({_FOUND})")
def normalise_findings(spark, sf_dir):
    found = rp.findings(read(spark, sf_dir, "documents"))
    return found.withColumn("cleaned", F.md5("cleaned"))


_SUMMED = ("entities", "double_escaped", *tx.NOISE_CLASSES, "space_runs", *(f"joiner_{k}" for k in rp.JOINERS), "chars_before", "chars_after")


@query(
    f"""SELECT count(*) AS docs_in, count(*) FILTER (c <> '') AS docs_out, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMMED)},
    (count(*) FILTER (c <> '') - count(DISTINCT c) FILTER (c <> '')) - (count(*) - count(DISTINCT raw_hash)) AS collisions_gained FROM ({_FOUND})"""
)
def normalise_report(spark, sf_dir):
    return rp.normalise_report(rp.findings(read(spark, sf_dir, "documents")))


@query(_MEASURES + f"SELECT source AS corpus, count(*) AS docs, count(*) FILTER ({_FAILS['english']}) AS english, count(*) FILTER ({_FAILS['aware']}) AS aware, round(1 - count(*) FILTER ({_FAILS['aware']}) / count(*), 4) AS survives FROM m GROUP BY source")
def quality_survival(spark, sf_dir):
    return rp.survival(_measured(spark, sf_dir))


_GROUPS = {"low": ("src0", "src1", "src2", "src3"), "high": ("src4", "src5")}


@query(
    _MEASURES
    + f""", y AS (SELECT source, round(1 - count(*) FILTER ({_FAILS['aware']}) / count(*), 4) AS v FROM m GROUP BY source), z AS (SELECT CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'low' WHEN source IN ('src4', 'src5') THEN 'high' END AS "group", v FROM y)
    SELECT "group", round(avg(v), 4) AS mean FROM z WHERE "group" IS NOT NULL GROUP BY "group" """
)
def quality_bias(spark, sf_dir):
    return rp.bias(rp.survival(_measured(spark, sf_dir)), _GROUPS)


@query(_MEASURES + f"SELECT doc_id FROM m WHERE NOT ({_FAILS['aware']})")
def quality_survivors(spark, sf_dir):
    return rp.quality_survivors(read(spark, sf_dir, "documents"), _measured(spark, sf_dir, ("doc_id",)), gate=3.0).select("doc_id")




def _grams(tag: str, keep: str, table: str) -> str:
    words = f"SELECT {keep}regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '{tx.WORD_RUN}') AS w FROM {table}"
    return f"x{tag} AS (SELECT DISTINCT {keep}unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k + 12], ' '))) AS g FROM ({words}) WHERE len(w) >= 13)"


_DECONTAMINATED = f"WITH {_grams('i', '', 'benchmark')}, {_grams('d', 'doc_id, ', 'documents')}, f AS (SELECT DISTINCT doc_id FROM xd SEMI JOIN xi USING (g))"


@query(_DECONTAMINATED + " SELECT (SELECT count(*) FROM documents) AS docs_in, (SELECT count(*) FROM f) AS flagged, 0::BIGINT AS canary_only, (SELECT count(*) FROM documents) - (SELECT count(*) FROM f) AS docs_out, 'held-out' AS coverage")
def decontamination_report(spark, sf_dir):
    return at.decontaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), at.canaries(spark, 24))[1]


@query(_DECONTAMINATED + " SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f)")
def decontamination_survivors(spark, sf_dir):
    return at.decontaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), at.canaries(spark, 24))[0].select("doc_id")


@query()
def pii_by_corpus(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return rp.masked_by_corpus(pn.mask(docs), docs)


@query(
    f"""WITH h AS (SELECT sha256({_TEXT}) AS h FROM documents), b AS (SELECT left(h, 3) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS d FROM h GROUP BY 1),
    l AS (SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS documents, sha256(string_agg(d, '' ORDER BY b)) AS content_hash, (SELECT string_agg(lang || '=' || n, ',' ORDER BY n DESC, lang) FROM l) AS languages, 'normalize,dedup' AS stages, 'c' AS code, 'x' AS config FROM b"""
)
def run_manifest(spark, sf_dir):
    m = rp.manifest(read(spark, sf_dir, "documents"), ("normalize", "dedup"), {"config": "x", "code": "c"})
    said = F.array_join(F.transform("languages", lambda x: F.concat(x["lang"], F.lit("="), x["n"].cast("string"))), ",")
    return m.withColumn("languages", said).withColumn("stages", F.array_join("stages", ","))


@query(
    """WITH RECURSIVE n AS (SELECT doc_id, source, CAST(n_chars AS BIGINT) AS k, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 5 AS c FROM documents),
    s AS (SELECT source, c, sum(k) AS k FROM n GROUP BY ALL), o AS (SELECT source, c, sum(k) OVER w - k AS before, sum(k) OVER w AS upto FROM s WINDOW w AS (PARTITION BY source ORDER BY c ROWS UNBOUNDED PRECEDING)),
    sh AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS m FROM (SELECT DISTINCT source FROM documents)),
    walk AS (SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS HUGEINT) AS counted, CAST(0 AS HUGEINT) AS share UNION ALL
      SELECT w.i + 1, w.counted + CASE WHEN w.counted >= 300000 THEN 0 ELSE (SELECT coalesce(max(upto), 0) FROM o WHERE o.source = sh.source AND before < greatest((300000 - w.counted) // (sh.m - w.i), 1)) END,
        CASE WHEN w.counted >= 300000 THEN 0 ELSE greatest((300000 - w.counted) // (sh.m - w.i), 1) END FROM walk w JOIN sh ON sh.i = w.i)
    SELECT n.doc_id FROM n JOIN o ON o.source = n.source AND o.c = n.c JOIN sh ON sh.source = n.source JOIN walk w ON w.i = sh.i + 1 WHERE o.before < w.share"""
)
def budgeted_corpus(spark, sf_dir):
    return cp.budgeted_corpus(read(spark, sf_dir, "documents"), F.col("n_chars"), 300_000, chunk=5).select("doc_id")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) WHERE r <= 400")
def probed_read(spark, sf_dir):
    return cp.probed(read(spark, sf_dir, "documents"), 400).select("doc_id")


@query(f"SELECT round((sum(length(samvaad)) - sum(length(content))) / sum(turns), 2) AS samvaad, round((sum(length(chatml)) - sum(length(content))) / sum(turns), 2) AS chatml, round((sum(length(alpaca)) - sum(length(content))) / sum(turns), 2) AS alpaca, round((sum(length(header)) - sum(length(content))) / sum(turns), 2) AS header FROM ({_RENDERED})")
def format_cost_per_turn(spark, sf_dir):
    each = cv.cost_per_turn(cv.rendered(read(spark, sf_dir, "conversations")))
    return each.agg(*[F.max(F.when(F.col("format") == f, F.col("per_turn"))).alias(f) for f in cv.FORMATS[1:]])


_PER_TURN = Literal("format string, per_turn double", ("content", 0.0), ("chatml", 11.5), ("samvaad", 7.0))


@query(f"SELECT CAST(n AS INTEGER) AS length, format, round(per_turn / (n + per_turn), 4) AS share FROM {_PER_TURN.sql}, (VALUES (15), (50), (200), (2000)) AS l(n)")
def format_projection(spark, sf_dir):
    return cv.projected(_PER_TURN.df(spark))


@query(f"WITH r AS ({_RENDERED}), s AS (SELECT unnest(['content', 'samvaad', 'chatml', 'alpaca', 'header']) AS format, unnest([sum(length(content)), sum(length(samvaad)), sum(length(chatml)), sum(length(alpaca)), sum(length(header))]) AS u, sum(length(content)) AS c FROM r), t AS (SELECT format, round((u - c) / u, 4) AS share FROM s) SELECT max(format) AS format, share FROM t WHERE share = (SELECT max(share) FROM t) GROUP BY share")
def worst_format(spark, sf_dir):
    return cv.worst_format(cv.format_costs(cv.rendered(read(spark, sf_dir, "conversations"))))


@query(" UNION ALL ".join(f"SELECT '{m}' AS marker, CAST(sum((length({_TEXT}) - length(replace({_TEXT}, '{m}', ''))) // {len(m)}) AS BIGINT) AS n, count(*) FILTER (contains({_TEXT}, '{m}')) AS documents FROM documents" for m in tx.ROLE_MARKERS))
def marker_report(spark, sf_dir):
    return cv.format_report(read(spark, sf_dir, "documents"), tx.ROLE_MARKERS)


@query(f"SELECT doc_id, len(regexp_extract_all(nfc_normalize({_TEXT}), '{tx.SPACE}{{2,}}')) AS space_runs, length({_TEXT}) - length(replace({_TEXT}, chr(8204), '')) AS zwnj, length({_TEXT}) - length(replace({_TEXT}, chr(8205), '')) AS zwj, CAST(length({_TEXT}) - length(replace({_TEXT}, '▁', '')) AS BIGINT) AS metaspace FROM documents")
def space_and_joiners(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    runs = F.regexp_count(tx.nfc(t), F.lit(tx.SPACE + "{2,}")).cast("long")
    return read(spark, sf_dir, "documents").select("doc_id", runs.alias("space_runs"), tx.literal_count(t, "‌").alias("zwnj"), tx.literal_count(t, "‍").alias("zwj"), tx.literal_count(t, tk.WORD_START).alias("metaspace"))


_NAMES = Literal("name string", ("FineWeb-Edu v1.2",), ("  --  ",), ("Ünïcode text",), ("a__b",), (None,))


@query(f"SELECT name, coalesce(nullif(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unnamed') AS slug FROM {_NAMES.sql}")
def slugs(spark, sf_dir):
    return _NAMES.df(spark).select("name", tx.slug(F.col("name")).alias("slug"))


@query("SELECT 'documents.parquet' AS file, (SELECT count(*) FROM documents) AS n_rows, CAST(5 AS INTEGER) AS n_columns, true AS reachable UNION ALL SELECT 'nothing.parquet', NULL, NULL, false")
def shard_survey(spark, sf_dir):
    planned = spark.createDataFrame([("docs", f"{sf_dir}/documents.parquet", 1), ("docs", f"{sf_dir}/nothing.parquet", 1)], "corpus string, path string, size long")
    found = fl.survey(planned)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), "n_rows", F.when(F.col("reachable"), F.size("columns")).alias("n_columns"), "reachable")


@query("SELECT page_id, url, CAST(row_number() OVER () - 1 AS BIGINT) AS row FROM pages")
def pages_in_file_order(spark, sf_dir):
    return fl.in_order(spark, f"{sf_dir}/pages.parquet", ("page_id", "url", "absent")).select("page_id", "url", F.col("place").alias("row"))


_ITEM_ROWS = Literal("Question string, option_a string, option_b string", (" What is the capital of France today ", "Paris", " "), ("Too short", "a", "b"), (None, "x", "y"), ("Which river runs through the old town", "Seine", "Rhine"), ("Which river runs through the old town", "Seine", "Rhine"))


@query(f"SELECT DISTINCT text FROM (SELECT array_to_string(list_filter([trim(Question), trim(option_a), trim(option_b)], lambda x: x <> ''), ' ') AS text FROM {_ITEM_ROWS.sql} WHERE trim(Question) <> '') WHERE len(string_split(text, ' ')) >= 6")
def question_items(spark, sf_dir):
    return fl.question_items(_ITEM_ROWS.df(spark), ("option_a", "option_b"))


_PARALLEL = Literal("i int, eng string, hin string, mai string", (0, "one", "ek", None), (2, "three", "tin", "tin"), (1, "two", "", "du"))


@query(f"SELECT 'en' AS lang, string_agg(eng, chr(10) ORDER BY i) AS text FROM {_PARALLEL.sql} WHERE eng <> '' UNION ALL SELECT 'hi', string_agg(hin, chr(10) ORDER BY i) FROM {_PARALLEL.sql} WHERE hin <> '' UNION ALL SELECT 'mai', string_agg(mai, chr(10) ORDER BY i) FROM {_PARALLEL.sql} WHERE mai <> ''")
def parallel_texts(spark, sf_dir):
    return fl.parallel_texts(_PARALLEL.df(spark), {"eng": "en", "hin": "hi", "mai": "mai", "tel": "te"}, "i")


_FILES = Literal("lane string, path string, hex string", ("code", "b.py", "78203D2031"), ("code", "a.py", "79"), ("code", "c.bin", "FFFE80"), ("web", "z", "C3A9"))


@query(f"SELECT lane, count(*) FILTER (hex NOT LIKE 'FF%') AS n_files, count(*) FILTER (hex LIKE 'FF%') AS skipped, string_agg(decode(CASE WHEN hex NOT LIKE 'FF%' THEN unhex(hex) END), chr(10) || chr(10) ORDER BY path) FILTER (hex NOT LIKE 'FF%') AS text FROM {_FILES.sql} GROUP BY lane")
def lane_texts(spark, sf_dir):
    return fl.lane_texts(_FILES.df(spark).select("lane", "path", F.unhex("hex").alias("content")))


_JSON = Literal("name string, body string", ("a", '["one item", {"question": " two? "}, {"text": "three"}, " "]'), ("b", '{"items": [{"question": "four", "text": "no"}]}'))


@query("SELECT * FROM (VALUES ('a', 'one item'), ('a', 'two?'), ('a', 'three'), ('b', 'four')) AS t(name, item)")
def benchmark_item_texts(spark, sf_dir):
    return _JSON.df(spark).select("name", F.explode(fl.item_texts(F.col("body"))).alias("item"))
