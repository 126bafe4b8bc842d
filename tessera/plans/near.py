"""Registered queries of the near-duplicate pass."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import neardup as nd
from tessera.operators import similarity as sm
from tessera.plans.registry import query, read

SETTINGS = ((14, 8), (28, 4), (7, 16))


def _coefficients(n: int) -> str:
    rng = np.random.default_rng(1)
    a, b = rng.integers(1, sm.PRIME, n), rng.integers(0, sm.PRIME, n)
    return "[" + ", ".join(f"{{'a': {x}::BIGINT, 'b': {y}::BIGINT}}" for x, y in zip(a.tolist(), b.tolist())) + "]"


def _pass_sql(docs: str = "documents", bands: int = sm.BANDS, rows: int = sm.ROWS, tag: str = "") -> str:
    """Common tables s{tag} (sets), r{tag} (classes), c{tag} (candidates), v{tag} (verified), l{tag} (clusters)."""
    return f"""w{tag} AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(coalesce(text, ''))), '{tx.WORD_RUN}') AS w FROM {docs}),
    s{tag} AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1),
      lambda i: CAST('0x' || left(md5(array_to_string(w[i:i + 4], ' ')), 15) AS BIGINT)))) AS s FROM w{tag}),
    r{tag} AS (SELECT s, min(doc_id) AS rep, count(*) AS k FROM s{tag} GROUP BY s),
    g{tag} AS (SELECT rep, list_transform({_coefficients(bands * rows)}, lambda c: list_min(list_transform(s, lambda x: (c.a * (x % {sm.PRIME}) + c.b) % {sm.PRIME}))) AS sig FROM r{tag} WHERE len(s) > 0),
    k{tag} AS (SELECT rep, i, sig[i * {rows} + 1:i * {rows} + {rows}] AS key FROM g{tag}, range({bands}) AS t(i)),
    p{tag} AS (SELECT DISTINCT x.rep AS a, y.rep AS b FROM k{tag} x JOIN k{tag} y ON x.i = y.i AND x.key = y.key AND x.rep < y.rep),
    c{tag} AS (SELECT a, b, len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))) AS jaccard FROM p{tag} JOIN r{tag} x ON x.rep = a JOIN r{tag} y ON y.rep = b),
    v{tag} AS (SELECT * FROM c{tag} WHERE jaccard >= {sm.threshold(bands, rows)!r}),
    e{tag} AS (SELECT a, b FROM v{tag} UNION SELECT b, a FROM v{tag}),
    q{tag} AS (SELECT a AS n, a AS m FROM e{tag} UNION SELECT e{tag}.b, q{tag}.m FROM q{tag} JOIN e{tag} ON e{tag}.a = q{tag}.n),
    l{tag} AS (SELECT n AS rep, min(m) AS cluster FROM q{tag} GROUP BY n),
    m{tag} AS (SELECT coalesce(cluster, r{tag}.rep) AS c, sum(k) AS k FROM r{tag} LEFT JOIN l{tag} ON l{tag}.rep = r{tag}.rep GROUP BY 1)"""


def _report_sql(tag: str) -> str:
    return f"""(SELECT (SELECT count(*) FROM c{tag}) AS candidate_pairs, (SELECT count(*) FROM v{tag}) AS verified_pairs, count(*) AS clusters,
      CAST(coalesce(sum(k - 1), 0) AS BIGINT) AS removed, CAST(coalesce(max(k), 0) AS BIGINT) AS largest FROM m{tag} WHERE k > 1)"""


def _documents(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query("WITH RECURSIVE " + _pass_sql() + " SELECT rep, array_to_string(sig, ',') AS signature FROM g")
def near_signatures(spark, sf_dir):
    sets = _documents(spark, sf_dir).select("doc_id", nd.stable_shingles(F.coalesce("text", F.lit(""))).alias("set"))
    classes = sets.groupBy("set").agg(F.min("doc_id").alias("rep")).where("size(set) > 0")
    return classes.select("rep", F.array_join(sm.signature(F.col("set")).cast("array<string>"), ",").alias("signature"))


@query("WITH RECURSIVE " + _pass_sql() + f" SELECT a, b, round(jaccard, 9) AS jaccard, jaccard >= {sm.threshold()!r} AS verified FROM c")
def near_candidates(spark, sf_dir):
    found = nd.near_pass(_documents(spark, sf_dir)).candidates
    return found.select("a", "b", F.round("jaccard", 9).alias("jaccard"), (F.col("jaccard") >= sm.threshold()).alias("verified"))


@query("WITH RECURSIVE " + _pass_sql() + " SELECT doc_id, coalesce(cluster, r.rep) AS keep_id FROM s JOIN r ON r.s = s.s LEFT JOIN l ON l.rep = r.rep WHERE doc_id <> coalesce(cluster, r.rep)")
def near_dropped(spark, sf_dir):
    return nd.near_pass(_documents(spark, sf_dir)).dropped()


@query("WITH RECURSIVE " + _pass_sql() + " SELECT * FROM " + _report_sql(""))
def near_report(spark, sf_dir):
    return nd.near_pass(_documents(spark, sf_dir)).report()


@query("WITH RECURSIVE " + _pass_sql() + " SELECT CAST(k AS BIGINT) AS size, count(*) AS n FROM m WHERE k > 1 GROUP BY k")
def near_cluster_sizes(spark, sf_dir):
    return nd.near_pass(_documents(spark, sf_dir)).cluster_sizes()


@query(
    "WITH RECURSIVE "
    + ", ".join(_pass_sql("documents", b, r, str(i)) for i, (b, r) in enumerate(SETTINGS))
    + " "
    + " UNION ALL ".join(f"SELECT {b} AS bands, {r} AS rows, {round(sm.threshold(b, r), 4)}::DOUBLE AS threshold, removed, candidate_pairs, verified_pairs FROM {_report_sql(str(i))}" for i, (b, r) in enumerate(SETTINGS))
)
def near_sweep(spark, sf_dir):
    return nd.swept(_documents(spark, sf_dir), SETTINGS)


_FIRST = "f AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY coalesce(text, '')), d AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM f)), "
_GONE = ", o AS (SELECT doc_id FROM s JOIN r ON r.s = s.s LEFT JOIN l ON l.rep = r.rep WHERE doc_id <> coalesce(cluster, r.rep))"


@query(
    "WITH RECURSIVE " + _FIRST + _pass_sql("d") + _GONE + """ SELECT source AS corpus, count(*) AS docs_in, count(*) FILTER (f.doc_id IS NULL) AS exact_duplicate,
    count(*) FILTER (o.doc_id IS NOT NULL) AS near_duplicate, count(*) FILTER (f.doc_id IS NOT NULL AND o.doc_id IS NULL) AS docs_out
    FROM documents x LEFT JOIN f ON f.doc_id = x.doc_id LEFT JOIN o ON o.doc_id = x.doc_id GROUP BY source"""
)
def dedup_stage_report(spark, sf_dir):
    return nd.dedup_stage(_documents(spark, sf_dir))[1]


@query("WITH RECURSIVE " + _FIRST + _pass_sql("d") + _GONE + " SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM o)")
def dedup_stage_survivors(spark, sf_dir):
    return nd.dedup_stage(_documents(spark, sf_dir))[0].select("doc_id")
