"""Secret scans with multipart credential linking, in DataFrame functions only.

Base patterns find strong spans. Weak candidates (a bare 40-character key, a login name, an endpoint) are reported only
when a complementary part lies within their scope: an interval join of parts by document and position bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_or_empty

_KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
_VALUE = "[A-Za-z0-9+/_.=-]"
#: kind, role, strong, cheap test of the whole text, pattern, group whose length counts, least length. Kinds sort in this order.
KINDS: tuple[tuple[str, str, bool, str, str, int, int], ...] = (
    ("assign", "secret", True, _KEYWORD, rf"""{_KEYWORD}["']?\x20*[:=]\x20*["']?({_VALUE}+)""", 1, 6),
    ("access", "id", True, "AKIA", "(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", "secret", True, "[0-9a-f]{24}", "([0-9a-f]{24,})", 1, 24),
    ("bare", "secret", False, "[A-Za-z0-9/+]{40}", "(?<![A-Za-z0-9/+=])([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+=])", 1, 40),
    ("login", "id", False, "(?i:user|login)", r"""(?i:\b(?:user(?:_?name|_?id)?|login))["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]+)""", 1, 3),
    # Bounded scheme and labels, each tried from the start of its run only: linear in runs of letters, digits and dots.
    ("endpoint", "endpoint", False, "://|amazonaws", r"""((?:(?<![a-z+])[a-z][a-z0-9+]{0,31}://[A-Za-z0-9.-]++[^\x20\x09-\x0D"'<>]*+|(?<![a-z0-9.-])(?:[a-z0-9-]{1,63}+\.){1,16}?amazonaws\.com))""", 1, 8),
)
#: role -> the roles that complement it
COMPLEMENTS = {"secret": ("id", "endpoint"), "id": ("secret",), "endpoint": ("secret",)}
#: Code points on either side of a candidate that are its scope.
SCOPE = 200


def _hits(text: Column, number: int) -> Column:
    """Array of struct(kind, pos, pre, len, vlen): for each match its length, the length of the text since the match
    before it, and that of the group which counts."""
    _, _, _, test, pattern, group, _ = KINDS[number]
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("m"), F.regexp_extract_all(text, F.lit(pattern), group).alias("v"))
    every = F.transform(
        F.filter(zipped, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("pos"), F.length(x["p"]).alias("pre"), F.length(x["m"]).alias("len"), F.length(x["v"]).alias("vlen")),
    )
    return F.when(text.rlike(test), every).otherwise(F.lit(None))


def _literal(values: list, of: str) -> Column:
    return F.array(*[F.lit(v).cast(of) for v in values])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has doc_id and th, a hash of the text, for every row of docs; spans has doc_id, th, kind
    (index into KINDS), start and end (code points, end exclusive), once for rows that repeat."""
    text = text_or_empty(text_col)
    hits = F.flatten(F.array_compact(F.array(*[_hits(F.col("text"), i) for i in range(len(KINDS))])))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", F.xxhash64("text").alias("th"), hits.alias("hits"))
    rows = materialize(rows, "scanned")
    each = rows.where(F.size("hits") > 0).dropDuplicates(["doc_id", "th"]).select("doc_id", "th", F.inline("hits"))
    in_order = Window.partitionBy("doc_id", "th", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("pre") + F.col("len")).over(in_order)
    placed = each.select("doc_id", "th", "kind", "vlen", (end - F.col("len")).alias("start"), end.alias("end"))
    least = F.element_at(_literal([k[6] for k in KINDS], "int"), F.col("kind") + 1)
    placed = materialize(placed.where(F.col("vlen") >= least).drop("vlen"), "parts")
    return rows.select("doc_id", "th"), link_parts(placed)


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """parts(doc_id, th, kind, start, end) -> the strong ones, and the weak ones that have a complement within scope and
    no strong span over them."""
    strong = F.element_at(_literal([k[2] for k in KINDS], "boolean"), F.col("kind") + 1)
    role = F.element_at(_literal([k[1] for k in KINDS], "string"), F.col("kind") + 1)
    parts = parts.withColumn("strong", strong).withColumn("role", role)
    bucket = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("bucket")
    weak = parts.where("not strong").select("*", bucket(F.col("start") - scope, F.col("end") + scope))
    other = parts.select(
        F.col("doc_id").alias("d2"), F.col("th").alias("t2"), F.col("role").alias("r2"), F.col("strong").alias("s2"), F.col("start").alias("b2"), F.col("end").alias("e2"), bucket(F.col("start"), F.col("end")).alias("k2")
    )
    same = F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")) & (F.col("bucket") == F.col("k2"))
    complementary = F.lit(False)
    for r, others in COMPLEMENTS.items():
        complementary |= (F.col("role") == r) & F.col("r2").isin(*others)
    near = (F.col("b2") <= F.col("end") + scope) & (F.col("start") <= F.col("e2") + scope)
    over = (F.col("b2") < F.col("end")) & (F.col("start") < F.col("e2"))
    linked = weak.join(other, same & near & complementary & ~over, "left_semi").join(other.where("s2"), same & over, "left_anti")
    covered = weak.join(other.where("s2"), same & over, "left_semi").select("doc_id", "th", "kind", "start", "end").distinct()
    c = covered.select(*[F.col(x).alias(f"c_{x}") for x in covered.columns])
    kept = linked.select("doc_id", "th", "kind", "start", "end").distinct()
    kept = kept.join(c, F.col("doc_id").eqNullSafe(F.col("c_doc_id")) & (F.col("th") == F.col("c_th")) & (F.col("kind") == F.col("c_kind")) & (F.col("start") == F.col("c_start")), "left_anti")
    return parts.where("strong").select("doc_id", "th", "kind", "start", "end").unionByName(kept)


def _joined(spans: Column) -> Column:
    names = _literal([k[0] for k in KINDS], "string")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, th, found (sorted array of struct(start, kind, end)), n_assign, n_access, n_hex,
    base (strong spans joined), spans (all joined). Null text counts as empty; an empty table gives an empty table."""
    rows, spans = secret_spans(docs, id_col, text_col)
    found = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    found = found.select(F.col("doc_id").alias("d2"), F.col("th").alias("t2"), "found")
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left")
    every = F.coalesce("found", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    n_strong = sum(k[2] for k in KINDS)
    out = joined.select("doc_id", "th", every.alias("found"))
    return out.select("doc_id", "th", "found", *[count(i).alias(f"n_{KINDS[i][0]}") for i in range(n_strong)], _joined(F.filter("found", lambda s: s["kind"] < n_strong)).alias("base"), _joined(F.col("found")).alias("spans"))


def redacted(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """text with every span of found (sorted by start, perhaps overlapping) replaced by the mask."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        upto = F.when(s["start"] > acc["at"], s["start"]).otherwise(acc["at"])
        kept = F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (upto - acc["at"]).cast("int")), F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise(""))
        return F.struct(kept.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    return F.aggregate(found, start, step, lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every reported span masked and n_chars counted anew; documents without secrets are unchanged."""
    _, spans = secret_spans(docs)
    found = materialize(spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found")), "found")
    found = found.select(F.col("doc_id").alias("__d"), F.col("th").alias("__t"), F.col("found").alias("__found"))
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found["__d"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["__t"]), "left")
    joined = joined.withColumn("text", F.when(F.col("__found").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("__found"))))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(F.col("__found").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return joined.select(*docs.columns)
