"""Registered queries over plans and catalogues, which are tables of a few rows given here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import attribution as at
from tessera.operators import catalogue as ct
from tessera.operators import conversations as cv
from tessera.operators import invariants as iv
from tessera.operators import language as lg
from tessera.operators import manifest as mf
from tessera.operators import mixture as mx
from tessera.operators import similarity as sm
from tessera.operators import tokens as tk
from tessera.plans.registry import Literal, query, read
from tessera.sources import records as rc


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def sorted_text(c: str):
    return F.array_join(F.array_sort(c), ",")


# ---------------------------------------------------------------- catalogue

_SIZES = Literal(
    "id string, size string", ("a", "1.5T tokens"), ("b", "300 M rows"), ("c", "about 20B Tokens, 3 files"), ("d", None), ("e", "verified 64B, unverified 10.5B, synthetic 162B"),
    ("f", "12 k tokens"), ("g", "tokens unknown"), ("h", "Verified 2M then verified 3M"),
)
_TIMES = "CASE upper({0}) WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6 WHEN 'B' THEN 1e9 WHEN 'T' THEN 1e12 END"


@query(
    f"""SELECT id, CASE WHEN regexp_matches(size, '{ct.SIZE}') AND contains(lower(size), 'token') THEN TRY_CAST(regexp_extract(size, '{ct.SIZE}', 1) AS DOUBLE) * {_TIMES.format(f"regexp_extract(size, '{ct.SIZE}', 2)")} END AS tokens FROM {_SIZES.sql}"""
)
def catalogue_sizes(spark, sf_dir):
    return _SIZES.df(spark).select("id", ct.stated_tokens(F.col("size")).alias("tokens"))


@query(
    f"""WITH e AS (SELECT id, unnest(regexp_extract_all(size, '{ct.SPLIT_SIZE}', 1)) AS k, unnest(regexp_extract_all(size, '{ct.SPLIT_SIZE}', 2)) AS n, unnest(regexp_extract_all(size, '{ct.SPLIT_SIZE}', 3)) AS s,
      unnest(range(len(regexp_extract_all(size, '{ct.SPLIT_SIZE}')))) AS i FROM {_SIZES.sql}) SELECT id, lower(k) AS part, arg_max(CAST(n AS DOUBLE) * {_TIMES.format('s')}, i) AS tokens FROM e GROUP BY ALL"""
)
def catalogue_parts(spark, sf_dir):
    return _SIZES.df(spark).select("id", F.explode(ct.stated_parts(F.col("size"))).alias("part", "tokens"))


_LICENCES = Literal("id string, licence string", ("a", "CC-BY-4.0"), ("b", "CC BY-NC 4.0"), ("c", "Apache-2.0"), ("d", "CC-BY-SA-4.0, commercial use"), ("e", None), ("f", "custom"), ("g", "MIT with attribution"))


@query(
    f"""WITH l AS (SELECT id, lower(coalesce(licence, '')) AS t FROM {_LICENCES.sql}), has AS (SELECT id, t, regexp_matches(t, '-nc| nc|noncommercial|non-commercial') AS nc,
      regexp_matches(t, 'permits commercial|commercial use|cc-by-4|cc by 4|cc-0|cc0|mit|apache') AS ok FROM l)
    SELECT id, CASE WHEN nc THEN false WHEN ok THEN true END AS commercial, CASE WHEN (contains(t, 'by') AND contains(t, 'cc')) OR contains(t, 'attribution') THEN true END AS attribution,
      CASE WHEN regexp_matches(t, '-sa|share-alike|sharealike') THEN true END AS share_alike FROM has"""
)
def catalogue_licences(spark, sf_dir):
    return _LICENCES.df(spark).select("id", ct.licence_flags(F.col("licence")).alias("f")).select("id", "f.*")


_CARDS = Literal(
    "id string, tier string, licence string, used_by string, types array<string>, blocking boolean", ("a", "green", "CC0", "x", [], False), ("b", "GREEN", " ", None, ["DEDUP"], False), ("c", "amber", None, "", ["COMPOSITION", "PROVENANCE"], False),
    ("d", "RED", "gpl", "y", None, None), ("e", "GREEN", "CC0", None, ["PROVENANCE"], True), ("f", None, None, None, [], False),
)


@query(
    f"""WITH c AS (SELECT id, upper(trim(coalesce(tier, ''))) AS t, trim(coalesce(licence, '')) AS l, trim(coalesce(used_by, '')) AS u, coalesce(types, []) AS y, coalesce(blocking, false) AS b FROM {_CARDS.sql})
    SELECT id, CASE WHEN b THEN 'FAIL' WHEN t = 'GREEN' AND l <> '' THEN 'PASS' WHEN t = 'AMBER' THEN 'CONDITIONAL' WHEN t = 'RED' THEN 'FAIL' ELSE 'UNKNOWN' END AS provenance,
      CASE WHEN list_contains(y, 'COMPOSITION') THEN 'CONDITIONAL' ELSE 'UNKNOWN' END AS composition, CASE WHEN list_contains(y, 'PROVENANCE') AND b THEN 'FAIL' ELSE 'UNKNOWN' END AS contamination,
      CASE WHEN list_contains(y, 'DEDUP') THEN 'CONDITIONAL' ELSE 'UNKNOWN' END AS "yield", CASE WHEN u <> '' THEN 'PASS' ELSE 'UNKNOWN' END AS evidence FROM c"""
)
def catalogue_gates(spark, sf_dir):
    return ct.derived_gates(_CARDS.df(spark)).select("id", *[F.col("gates")[g].alias(g) for g in ct.GATES])


_NOTES = Literal(
    "id string, note string", ("a", "Large overlap with crawls. Strong coverage of law; toxic pages remain!"), ("b", "Deduplicate first. Duplicates again. Nothing else - Good for speech"), ("c", None), ("d", "Do not use: pirated books. Terms unclear? Fine prose."), ("e", "plain remark"),
)
_NOTE_RULES = (("SAFETY", "toxic"), ("PROVENANCE", "pirated"), ("DEDUP", "overlap|duplicat"), ("LICENCE", r"terms (are )?unclear"))
_BARRING, _UPSIDES = ("do not use",), ("good for", "strong", "fine")


def _any(t: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


@query(
    f"""WITH n AS (SELECT id, coalesce(note, '') AS note, {_any("lower(coalesce(note, ''))", _BARRING)} AS barred FROM {_NOTES.sql}),
    s AS (SELECT id, barred, unnest(list_filter(list_transform(string_split(regexp_replace(regexp_replace(note, '([.;!?])\\s+', '\\1' || chr(1), 'g'), '\\s+-\\s+([A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS t FROM n),
    o AS (SELECT *, row_number() OVER (PARTITION BY id) AS i, CASE {' '.join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{k}'" for k, p in _NOTE_RULES)} END AS k FROM s),
    f AS (SELECT id, k, arg_min(t, i) AS t, min(i) AS i, bool_or(barred) AS b FROM o WHERE k IS NOT NULL GROUP BY id, k),
    g AS (SELECT id, string_agg(k || '|' || CASE WHEN b OR {_any('lower(t)', _BARRING)} THEN 'blocking' ELSE 'advisory' END || '|' || t, '~' ORDER BY i) AS findings FROM f GROUP BY id),
    p AS (SELECT id, min(i) AS i FROM o WHERE k IS NULL AND {_any('lower(t)', _UPSIDES)} GROUP BY id),
    r AS (SELECT o.id, string_agg(t, ' ' ORDER BY o.i) AS rest FROM o LEFT JOIN p ON p.id = o.id WHERE k IS NULL AND (p.i IS NULL OR p.i <> o.i) GROUP BY o.id)
    SELECT n.id, coalesce(findings, '') AS findings, o.t AS opportunity, rest FROM n LEFT JOIN g ON g.id = n.id LEFT JOIN p ON p.id = n.id LEFT JOIN o ON o.id = p.id AND o.i = p.i LEFT JOIN r ON r.id = n.id"""
)
def catalogue_notes(spark, sf_dir):
    found = ct.risk_notes(_NOTES.df(spark), _NOTE_RULES, _BARRING, _UPSIDES)
    return found.select("id", F.array_join(F.transform("findings", lambda f: F.concat_ws("|", f["type"], f["severity"], f["text"])), "~").alias("findings"), "opportunity", "rest")


_GRADED = Literal(
    "id string, provenance string, composition string, contamination string, yield string, evidence string, blocking boolean", ("a", "PASS", "PASS", "PASS", "PASS", "PASS", False), ("b", "PASS", "PASS", "UNKNOWN", "CONDITIONAL", None, None),
    ("c", "FAIL", "PASS", "PASS", "PASS", "PASS", False), ("d", "PASS", None, None, None, "PASS", False), ("e", "PASS", "PASS", "PASS", "PASS", "PASS", True), ("f", "PASS", "CONDITIONAL", "PASS", "CONDITIONAL", "PASS", False),
)


@query(
    f"""WITH g AS (SELECT id, blocking, list_transform([provenance, composition, contamination, "yield", evidence], lambda v: coalesce(v, 'UNKNOWN')) AS v, provenance, contamination FROM {_GRADED.sql}),
    p AS (SELECT *, list_sum(list_transform(v, lambda x: CASE x WHEN 'PASS' THEN 2 WHEN 'CONDITIONAL' THEN 1 ELSE 0 END)) AS score, len(list_filter(v, lambda x: x <> 'UNKNOWN')) AS scored FROM g)
    SELECT id, CAST(score AS INTEGER) AS score, CAST(scored AS INTEGER) AS scored, CASE WHEN coalesce(blocking, false) OR coalesce(provenance, '') = 'FAIL' OR coalesce(contamination, '') = 'FAIL' THEN 'X'
      WHEN score >= 8 AND scored = 5 THEN 'A' WHEN score >= 5 AND scored >= 3 THEN 'B' ELSE 'C' END AS grade FROM p"""
)
def catalogue_grades(spark, sf_dir):
    rows = _GRADED.df(spark)
    gates = F.map_filter(F.create_map(*[x for g in ct.GATES for x in (F.lit(g), F.col(g))]), lambda k, v: v.isNotNull())
    return ct.graded(rows.select("id", gates.alias("gates"), "blocking"))


_MAPPING = Literal("ord int, tier string, category string", (0, "web", "English Web"), (1, "code", "Code"), (2, "stem", "Math"), (3, "rest", "Math"), (4, "rest", "Speech"))
_DATASETS = Literal(
    "id string, category string, stage array<string>, gated string, is_gap boolean, grade string, commercial boolean, tokens double", ("a", "English Web", ["PT"], None, False, "A", True, 5e12), ("b", "Code", ["PT", "SFT"], "manual", False, "B", True, 1e11),
    ("c", "Math", ["SFT"], "auto", False, "B", None, 2e10), ("d", "Speech", [], None, True, "C", False, None), ("e", "Maps", ["EVAL", "RL"], None, None, "X", True, 1e9), ("f", "Code", ["PT"], None, False, "A", False, 9e11), ("g", "Math", None, None, False, None, True, None),
    ("h", "English Web", ["PT"], None, False, "A", None, None),
)
_STEPS = Literal("step string, tag string", ("pre-training", "PT"), ("pre-training", "MT"), ("post-training", "SFT"), ("post-training", "RL"), ("evaluation", "EVAL"))
_BLOCKED = f"""SELECT *, list_filter([CASE WHEN gated = 'manual' THEN 'access' END, CASE WHEN coalesce(is_gap, false) THEN 'does not exist' END, CASE WHEN grade = 'X' THEN 'excluded' WHEN coalesce(grade NOT IN ('A', 'B'), true) THEN 'evidence' END,
    CASE WHEN NOT coalesce(commercial, false) THEN 'licence' END, CASE WHEN tokens IS NULL THEN 'size' END], lambda x: x IS NOT NULL) AS blockers FROM {_DATASETS.sql}"""
_TIERED = f"SELECT d.id, arg_min(tier, ord) AS tier FROM {_DATASETS.sql} d LEFT JOIN {_MAPPING.sql} m ON m.category = d.category GROUP BY d.id"
_SERVED = f"SELECT DISTINCT t.id, step FROM (SELECT id, unnest(stage) AS tag FROM {_DATASETS.sql}) t JOIN {_STEPS.sql} s ON s.tag = t.tag"


@query(_TIERED)
def catalogue_tiers(spark, sf_dir):
    return ct.tier_of(_DATASETS.df(spark), _MAPPING.df(spark))


@query(f"SELECT id, array_to_string(blockers, ',') AS blockers FROM ({_BLOCKED})")
def catalogue_blockers(spark, sf_dir):
    return ct.blockers(_DATASETS.df(spark)).withColumn("blockers", F.array_join("blockers", ","))


@query(f"WITH s AS ({_SERVED}) SELECT id, step FROM s UNION ALL SELECT id, NULL FROM {_DATASETS.sql} WHERE id NOT IN (SELECT id FROM s)")
def catalogue_lifecycle(spark, sf_dir):
    return ct.lifecycle(_DATASETS.df(spark), _STEPS.df(spark))


@query(
    f"""SELECT step, count(*) AS datasets, count(*) FILTER (len(blockers) = 0) AS committable, count(tokens) AS sized, coalesce(sum(tokens), 0.0) AS tokens, count(*) FILTER (blockers = ['licence']) AS licence_only
    FROM ({_SERVED}) s JOIN ({_BLOCKED}) b ON b.id = s.id GROUP BY step"""
)
def catalogue_rollup(spark, sf_dir):
    return ct.lifecycle_rollup(_DATASETS.df(spark), _STEPS.df(spark))


@query(f"SELECT CAST(row_number() OVER (ORDER BY tokens DESC NULLS LAST, b.id) AS INTEGER) AS place, b.id, tier, tokens FROM ({_BLOCKED}) b JOIN ({_TIERED}) t ON t.id = b.id WHERE blockers = ['licence'] AND tier IS NOT NULL")
def catalogue_licence_queue(spark, sf_dir):
    return ct.licence_queue(_DATASETS.df(spark), ct.tier_of(_DATASETS.df(spark), _MAPPING.df(spark)))


_PLAN = Literal("tier string, required double, is_synthetic boolean", ("web", 6e12, False), ("synthetic", 1e11, True), ("none", 5e10, False))
_COMMITTED = Literal(
    "tier string, id string, tokens double, verified double, parents array<string>", ("web", "p", 4e12, None, []), ("web", "q", 3e12, 1e12, None), ("web", "p-edu", 1e12, None, ["p"]), ("synthetic", "s", 9e10, 1e10, ["q"]), ("web", "u", None, None, ["other"]),
)


@query(
    f"""WITH c AS (SELECT * FROM {_COMMITTED.sql}), x AS (SELECT DISTINCT c.tier, c.id FROM (SELECT tier, id, unnest(parents) AS parent FROM c) c JOIN c p ON p.tier = c.tier AND p.id = c.parent),
    u AS (SELECT c.tier, CASE WHEN is_synthetic THEN tokens ELSE coalesce(verified, tokens) END AS n FROM c JOIN {_PLAN.sql} t ON t.tier = c.tier WHERE (c.tier, c.id) NOT IN (SELECT tier, id FROM x)),
    s AS (SELECT t.tier, required, coalesce(sum(n), 0.0) AS supply, count(u.tier) AS datasets, count(u.tier) - count(n) AS unmeasured FROM {_PLAN.sql} t LEFT JOIN u ON u.tier = t.tier GROUP BY t.tier, required)
    SELECT *, greatest(required - supply, 0.0) AS shortfall, round(supply / nullif(required, 0), 6) AS coverage, supply * 0.8 AS deduplicated_high, supply * 0.6 AS deduplicated_low FROM s"""
)
def catalogue_supply(spark, sf_dir):
    return rounded(ct.supply_plan(_PLAN.df(spark), _COMMITTED.df(spark)))


_CAPABILITIES = Literal(
    "capability string, include array<string>, exclude array<string>, traps array<string>", ("code", ["code", "swe-bench"], [], ["code-mix"]), ("context", ["india-context"], ["translated"], []), ("speech", ["speech", "asr"], None, None), ("none", ["smell"], [], []),
)
_ABOUT = Literal("benchmark string, about string", ("b1", "Code generation"), ("b2", "code-mix sentiment"), ("b3", "India-context QA, translated from English"), ("b4", "India-Context culture; speech and code"))


@query(
    f"""WITH c AS (SELECT * FROM {_CAPABILITIES.sql}), b AS (SELECT benchmark, lower(about) AS t FROM {_ABOUT.sql}),
    m AS (SELECT capability, benchmark FROM c, b WHERE len(list_filter(include, lambda i: contains(CASE WHEN len(coalesce(traps, [])) > 0 THEN replace(t, traps[1], ' ') ELSE t END, i))) > 0 AND len(list_filter(coalesce(exclude, []), lambda e: contains(t, e))) = 0)
    SELECT c.capability, count(benchmark) AS n, coalesce(string_agg(benchmark, ',' ORDER BY benchmark), '') AS benchmarks, CASE count(benchmark) WHEN 0 THEN 'hole' WHEN 1 THEN 'thin' ELSE 'covered' END AS status FROM c LEFT JOIN m ON m.capability = c.capability GROUP BY c.capability"""
)
def catalogue_coverage(spark, sf_dir):
    return ct.coverage_status(ct.capability_matrix(_CAPABILITIES.df(spark), _ABOUT.df(spark))).withColumn("benchmarks", sorted_text("benchmarks"))


_TIER_CAPS = Literal("tier string, capabilities array<string>, seen double, share double", ("web", ["knowledge"], 1e12, 0.5), ("craft", ["weaving"], 1e10, 0.1), ("bare", [], 5e9, 0.05), ("null", None, 1e9, 0.01))
_BENCH_CAPS = Literal("benchmark string, capabilities array<string>", ("x", ["knowledge", "code"]), ("y", ["speech"]))


@query(
    f"""SELECT tier, seen, share, round(6.0 * 4e10 * seen / 4e14 / 3600 * 2.0, 2) AS usd FROM {_TIER_CAPS.sql}
    WHERE tier NOT IN (SELECT tier FROM (SELECT tier, unnest(capabilities) AS c FROM {_TIER_CAPS.sql}) WHERE c IN (SELECT unnest(capabilities) FROM {_BENCH_CAPS.sql}))"""
)
def catalogue_orphans(spark, sf_dir):
    return ct.orphan_cost(_TIER_CAPS.df(spark), _BENCH_CAPS.df(spark), 40e9)


_DOMAINS = Literal("domain string, modality string, pattern string, in_crawls boolean", ("law", "text", "legal|court", False), ("news", "text", "newspaper", True), ("songs", "audio", "song|music", False), ("dance", "video", "dance", False))
_ITEMS = Literal("id string, about string, committable boolean", ("a", "Court rulings and legal acts", True), ("b", "Legal forms", False), ("c", "Music scores", True), ("d", "Plain web", True))
_COVERED = f"""SELECT o.domain, modality, count(id) AS datasets, count(id) FILTER (committable) AS committable, CASE WHEN count(id) > 0 THEN 'isolated' WHEN in_crawls THEN 'inside crawls' ELSE 'absent' END AS status
    FROM {_DOMAINS.sql} o LEFT JOIN {_ITEMS.sql} i ON regexp_matches(lower(about), lower(pattern)) GROUP BY o.domain, modality, in_crawls"""


@query(_COVERED)
def catalogue_domains(spark, sf_dir):
    return ct.domain_coverage(_DOMAINS.df(spark), _ITEMS.df(spark))


@query(f"SELECT modality, CAST(sum(datasets) AS BIGINT) AS datasets, CAST(sum(committable) AS BIGINT) AS committable, coalesce(string_agg(domain, ',' ORDER BY domain) FILTER (status <> 'isolated'), '') AS unsupplied FROM ({_COVERED}) GROUP BY modality")
def catalogue_modalities(spark, sf_dir):
    return ct.modality_rollup(ct.domain_coverage(_DOMAINS.df(spark), _ITEMS.df(spark))).withColumn("unsupplied", sorted_text("unsupplied"))


_TIER_SHARES = Literal("tier string, share double", ("web", 0.6), ("code", 0.3), ("speech", 0.1))
_WEIGHTS = Literal("tier string, modality string, weight double", ("web", "text", 1.0), ("code", "text", 0.2), ("code", "code", 0.8), ("speech", "audio", 1.0))
_EMPHASIS = Literal("stage string, modality string, factor double", ("base", "text", 1.0), ("late", "code", 3.0), ("late", "audio", 0.5))


@query(
    f"""WITH b AS (SELECT modality, sum(share * weight) AS b FROM {_TIER_SHARES.sql} t JOIN {_WEIGHTS.sql} w ON w.tier = t.tier GROUP BY modality),
    e AS (SELECT s.stage, b.modality, b * coalesce(factor, 1.0) AS w FROM b CROSS JOIN (SELECT DISTINCT stage FROM {_EMPHASIS.sql}) s LEFT JOIN {_EMPHASIS.sql} x ON x.stage = s.stage AND x.modality = b.modality)
    SELECT stage, modality, round(w / sum(w) OVER (PARTITION BY stage), 4) AS share FROM e"""
)
def curriculum_by_modality(spark, sf_dir):
    return ct.curriculum_shares(_TIER_SHARES.df(spark), _WEIGHTS.df(spark), _EMPHASIS.df(spark))


_SPINE = Literal("id string, kind string", ("a", "text"), ("b", "image"), ("b", "text"), ("c", "smell"))


@query(f"SELECT 'repeated' AS kind, id, CAST(count(*) AS VARCHAR) AS detail FROM {_SPINE.sql} GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'value', id, 'kind=' || kind FROM {_SPINE.sql} WHERE kind NOT IN ('text', 'image') UNION ALL SELECT 'count', NULL, CAST(count(*) AS VARCHAR) FROM {_SPINE.sql} HAVING count(*) <> 5")
def catalogue_violations(spark, sf_dir):
    return ct.violations(_SPINE.df(spark), {"kind": ("text", "image")}, 5)


@query(f"SELECT DISTINCT id FROM {_SPINE.sql} WHERE id NOT IN (SELECT id FROM {_SPINE.sql} WHERE kind = 'text')")
def catalogue_lost(spark, sf_dir):
    rows = _SPINE.df(spark)
    return ct.lost(rows, rows.where("kind = 'text'")).distinct()


_COSTS = Literal("tokens double, params double", (2e12, 40e9), (1e9, 1e9), (5e13, 7e10))


@query(
    """SELECT tokens, params, 6.0 * params * tokens AS flops, round(6.0 * params * tokens / 4e14 / 3600, 3) AS gpu_hours, round(6.0 * params * tokens / 4e14 / 3600 * 2, 3) AS usd, round(6.0 * params * tokens / 4e14 / 3600 * 2 * 88, 3) AS inr,
    CASE WHEN u < 1e4 THEN '$' WHEN u < 1e5 THEN '$$' WHEN u < 1e6 THEN '$$$' WHEN u < 1e7 THEN '$$$$' WHEN u < 1e8 THEN '$$$$$' ELSE '$$$$$$' END AS band FROM (SELECT *, 6.0 * params * tokens / 4e14 / 3600 * 2 AS u FROM """
    + _COSTS.sql
    + ")"
)
def run_costs(spark, sf_dir):
    rows = _COSTS.df(spark).withColumn("c", ct.training_cost(F.col("tokens"), F.col("params")))
    return rows.select("tokens", "params", F.col("c.flops").alias("flops"), *[F.round(f"c.{k}", 3).alias(k) for k in ("gpu_hours", "usd", "inr")], ct.cost_band(F.col("c.usd")).alias("band"))


_TRADES = Literal("seen double, share double, gain double, cost double", (2e12, 0.18, 0.229, 0.011), (1e12, 0.4, 0.1, 0.0))


@query(f"SELECT seen, round(share * gain, 4) AS saving, round(seen * share * gain, 3) AS tokens, round(6.0 * 4e10 * (seen * share * gain) / 4e14 / 3600 * 2, 3) AS usd, round(share * gain / nullif(cost, 0), 2) AS multiple FROM {_TRADES.sql}")
def vocabulary_trade(spark, sf_dir):
    t = _TRADES.df(spark)
    return t.select("seen", ct.vocabulary_trade(F.col("seen"), F.col("share"), F.col("gain"), F.col("cost"), 40e9).alias("v")).select("seen", F.col("v.saving").alias("saving"), F.round("v.tokens", 3).alias("tokens"), F.round("v.usd", 3).alias("usd"), F.col("v.multiple").alias("multiple"))


_FERT = Literal("lang string, words double, before double, after double", ("hi", 1e9, 2.4, 1.85), ("en", 2e9, 1.3, 1.35))


@query(f"SELECT lang, round(6.0 * 1e9 * (words * before) / 4e14 / 3600 * 2 - 6.0 * 1e9 * (words * after) / 4e14 / 3600 * 2, 6) AS usd FROM {_FERT.sql}")
def tokenizer_savings(spark, sf_dir):
    return _FERT.df(spark).select("lang", F.round(ct.cost_saved(F.col("words"), F.col("before"), F.col("after"), 1e9)["usd"], 6).alias("usd"))


_TIERS = Literal(
    "tier string, needed double, epochs double, is_indic boolean, is_synthetic boolean, always_on boolean", ("web", 1e12, 1.0, False, False, False), ("indic", 6e10, 6.0, True, False, True), ("indic-made", 4e11, None, True, True, False),
    ("rare", 1e8, 50.0, False, False, True), ("sliver", 1e8, 3.0, False, False, False), ("empty", None, 2.0, False, False, False), ("half", 1e9, 17.0, False, False, False), ("back", 1e9, -1.0, False, False, False),
)
_COMPOSED = f"""m AS (SELECT tier, needed, e AS epochs, is_indic, is_synthetic, always_on, u * e AS seen, CASE WHEN e <= 1 THEN u * greatest(e, 0.0) ELSE u * (1 + 15.4 * (1 - exp(-(e - 1) / 15.4))) END AS worth, u
    FROM (SELECT *, coalesce(epochs, 1.0) AS e, coalesce(needed, 0.0) AS u FROM {_TIERS.sql})), c AS (SELECT *, seen / (SELECT sum(seen) FROM m) AS share FROM m)"""
_MIX_TOTALS = """t AS (SELECT sum(seen) AS seen, sum(needed) AS needed, sum(worth) AS worth, sum(seen) FILTER (is_indic) / sum(seen) AS indic_share, sum(seen) FILTER (is_indic AND NOT is_synthetic) / sum(seen) AS natural_share,
    sum(worth) FILTER (is_indic AND NOT is_synthetic) / sum(seen) AS natural_worth_share, 1 - sum(seen) FILTER (is_indic AND NOT is_synthetic) / sum(seen) FILTER (is_indic) AS synthetic_of_indic, sum(share) FILTER (always_on) AS always_on_share FROM c)"""


@query(f"WITH {_COMPOSED} SELECT tier, seen, round(worth, 2) AS worth, round(share, 9) AS share FROM c")
def mixture_composition(spark, sf_dir):
    return ct.composed(_TIERS.df(spark)).select("tier", "seen", F.round("worth", 2).alias("worth"), F.round("share", 9).alias("share"))


@query(f"WITH {_COMPOSED}, {_MIX_TOTALS} SELECT seen, needed, round(worth, 2) AS worth, round(indic_share, 9) AS indic_share, round(natural_share, 9) AS natural_share, round(natural_worth_share, 9) AS natural_worth_share, round(synthetic_of_indic, 9) AS synthetic_of_indic, round(always_on_share, 9) AS always_on_share FROM t")
def mixture_totals(spark, sf_dir):
    t = ct.mixture_totals(ct.composed(_TIERS.df(spark)))
    return t.select("seen", "needed", F.round("worth", 2).alias("worth"), *[F.round(c, 9).alias(c) for c in t.columns[3:]])


@query(
    f"""WITH {_COMPOSED}, {_MIX_TOTALS} SELECT CASE WHEN epochs > 40 THEN 'error' ELSE 'warning' END AS level, tier, CASE WHEN epochs > 40 THEN 'worthless' WHEN epochs > 16 THEN 'past half-life' ELSE 'past near-free' END AS finding FROM c WHERE epochs > 4
    UNION ALL SELECT 'warning', tier, 'no pool stated' FROM c WHERE u = 0 UNION ALL SELECT 'error', tier, 'negative epochs' FROM c WHERE epochs < 0 UNION ALL SELECT 'error', tier, 'above ceiling' FROM c WHERE u <> 0 AND seen > u * 16.4
    UNION ALL SELECT 'warning', tier, 'sliver repeated' FROM c WHERE share < 0.01 AND epochs > 1 UNION ALL SELECT 'warning', 'indic', 'mostly synthetic' FROM t WHERE synthetic_of_indic > 0.5
    UNION ALL SELECT 'warning', 'always-on', CASE WHEN always_on_share > 0.2 THEN 'lane too large' ELSE 'lane too small' END FROM t WHERE always_on_share > 0.2 OR always_on_share < 0.08"""
)
def mixture_guardrails(spark, sf_dir):
    return ct.guardrails(ct.composed(_TIERS.df(spark)))


_MILESTONES = Literal("id string, tokens double, ladder boolean", ("m1", 2e12, True), ("m2", 5e12, False), ("m3", 1e13, True), ("m4", None, True))
_SHAPE = Literal("tier string, share double, epochs double", ("web", 0.7, 1.0), ("indic", 0.3, 4.0))


@query(f"SELECT id, tier, tokens * share AS seen, tokens * share / epochs AS needed FROM {_MILESTONES.sql}, {_SHAPE.sql} s WHERE ladder AND tokens > 0")
def milestone_presets(spark, sf_dir):
    return ct.milestone_presets(_MILESTONES.df(spark), _SHAPE.df(spark))


@query(
    """WITH v AS (SELECT CAST(v AS DOUBLE) AS v FROM range(64000, 320001, 8000) AS t(v)), r AS (SELECT v, 1 + 1.11 * pow(0.92, log2(v / 131072)) AS f, v / (v + 6.0 * 4096 * 32) AS c, 1 + 1.11 * pow(0.92, log2(64000 / 131072)) AS f0, 64000 / (64000 + 6.0 * 4096 * 32) AS c0 FROM v),
    n AS (SELECT CAST(v AS BIGINT) AS v, round((f0 - f) / f0 - (c - c0), 6) AS b FROM r), p AS (SELECT max(b) AS net_benefit FROM n) SELECT min(v) AS peak, net_benefit, CAST(ceil(min(v) / 128) * 128 AS BIGINT) AS recommended FROM n JOIN p ON n.b = p.net_benefit GROUP BY net_benefit"""
)
def vocabulary_best(spark, sf_dir):
    return ct.best_vocabulary(ct.vocabulary_sweep(spark, 131_072, 2.11, 4096, 32))


# ---------------------------------------------------------------- mixture and curriculum

_INVENTORY = Literal("lane string, tokens double, samples double, packed boolean", ("web", 1e12, None, False), ("web", None, None, False), ("long", 6e10, None, True), ("long", 4e10, None, False), ("agentic", 1.5e8, 2400.0, False), ("agentic", 9e7, 1e4, False), ("agentic", 1e7, None, False))
_HEADLINES = Literal("lane string, headline double", ("web", 1.2e12), ("long", 1e11), ("agentic", None))


@query(f"SELECT i.lane, sum(tokens) AS tokens, count(*) AS n, count(*) - count(tokens) AS n_unknown, headline, headline - sum(tokens) AS residual, coalesce(abs(headline - sum(tokens)) > 0.02 * headline, false) AS disagrees FROM {_INVENTORY.sql} i LEFT JOIN {_HEADLINES.sql} h ON h.lane = i.lane GROUP BY i.lane, headline")
def lane_supply(spark, sf_dir):
    return mx.lane_supply(_INVENTORY.df(spark), _HEADLINES.df(spark))


@query(f"SELECT lane, round(1 - coalesce(sum(tokens) FILTER (packed), 0) / sum(tokens), 9) AS factor FROM {_INVENTORY.sql} GROUP BY lane")
def double_counted(spark, sf_dir):
    return rounded(mx.double_counted(_INVENTORY.df(spark)), 9)


@query(f"SELECT lane, round(min(s / (tokens / samples)), 9) AS low, round(max(s / (tokens / samples)), 9) AS high FROM {_INVENTORY.sql}, (VALUES (200.0), (500.0)) AS k(s) WHERE tokens > 0 AND samples > 0 GROUP BY lane")
def supervised_ratio(spark, sf_dir):
    return rounded(mx.supervised_ratio(_INVENTORY.df(spark)), 9)


_INDIC = Literal("tier string, share double", ("A", 0.45), ("B", 0.20), ("C", 0.20), ("D", 0.15))
_INDIC_ROWS = Literal("tier string, tokens double", ("A", 6.4e10), ("B", 3e10), ("C", 1.62e11), ("C", None))


@query(
    f"""WITH s AS (SELECT t.tier, share * 3.6e11 AS demand, coalesce(sum(tokens), 0) + CASE WHEN bool_or(r.tier IS NOT NULL AND tokens IS NULL) THEN 5.1e9 ELSE 0 END AS supply FROM {_INDIC.sql} t LEFT JOIN {_INDIC_ROWS.sql} r ON r.tier = t.tier GROUP BY t.tier, share)
    SELECT tier, demand, supply, round(demand / nullif(supply, 0), 6) AS epochs, greatest(0.0, demand - supply * 16.4) AS must_generate FROM s"""
)
def tier_sizing(spark, sf_dir):
    return rounded(mx.tier_sizing(_INDIC.df(spark), _INDIC_ROWS.df(spark), 3.6e11, 5.1e9))


_SHARES = Literal("lane string, share double", ("web", 0.5), ("code", 0.2), ("indic", 0.18), ("agentic", 0.02), ("stem", 0.1))
_FLOORS = Literal("lane string, floor double", ("indic", 0.12), ("agentic", 0.02), ("speech", 0.01))


@query(f"SELECT f.lane, floor, round(coalesce(share, 0) - floor, 9) AS headroom FROM {_FLOORS.sql} f LEFT JOIN {_SHARES.sql} s ON s.lane = f.lane")
def floor_headroom(spark, sf_dir):
    return rounded(mx.floor_headroom(_SHARES.df(spark), _FLOORS.df(spark)), 9)


_POOLS = Literal("lane string, tokens double, fraction double", ("agentic", 6.27e8, 1.0), ("indic", 6.4e10, 0.3), ("stem", 3.2e11, 0.05))


@query(f"SELECT sum(tokens * fraction) AS held, sum(tokens * fraction) / 2e12 AS share, sum(tokens * fraction) / 2e12 >= 0.02 * 0.9 AS covers FROM {_POOLS.sql}")
def anneal_reserve(spark, sf_dir):
    return mx.anneal_reserve(_POOLS.df(spark), 2e12, 0.02)


_DEMANDS = Literal("lane string, demand double, supply double", ("agentic", 4e10, 6.27e8), ("web", 1e12, 2e12), ("made", 5e10, None))


@query(f"SELECT lane, demand - coalesce(supply, 0) * 16.4 AS tokens FROM {_DEMANDS.sql} WHERE demand > coalesce(supply, 0) * 16.4")
def generation_bill(spark, sf_dir):
    return mx.generation_bill(_DEMANDS.df(spark))


_BENCHES = Literal("benchmark string, lanes array<string>, stage string", ("milu", ["indic", "web"], "general"), ("swe", ["agentic", "code"], "anneal"), ("long-eval", ["long"], "long"), ("dance", ["video"], "general"))
_STAGES = Literal("stage string, duration double", ("foundation", 0.3), ("general", 0.5), ("anneal", 0.2))


@query(f"SELECT lane, count(*) AS n, string_agg(benchmark, ',' ORDER BY benchmark) AS benchmarks FROM (SELECT benchmark, unnest(lanes) AS lane FROM {_BENCHES.sql}) GROUP BY lane")
def benchmarks_by_lane(spark, sf_dir):
    return mx.by_lane(_BENCHES.df(spark))


@query(f"SELECT s.stage, count(benchmark) AS n, coalesce(string_agg(benchmark, ',' ORDER BY benchmark), '') AS benchmarks FROM {_STAGES.sql} s LEFT JOIN {_BENCHES.sql} b ON b.stage = s.stage GROUP BY s.stage")
def benchmarks_by_stage(spark, sf_dir):
    return mx.by_stage(_BENCHES.df(spark), _STAGES.df(spark))


_LANES = Literal("lane string, share double, schedule_only boolean", ("web", 0.5, False), ("indic", 0.3, False), ("code", 0.2, False), ("agentic", 0.0, False), ("long", 0.0, True))


@query(f"SELECT benchmark FROM {_BENCHES.sql} WHERE NOT list_has_any(lanes, (SELECT list(lane) FROM {_LANES.sql} WHERE share > 0 OR schedule_only))")
def unfunded_benchmarks(spark, sf_dir):
    return mx.unfunded(_BENCHES.df(spark), _LANES.df(spark))


_MIXES = Literal(
    "ord int, stage string, duration double, lane string, share double", (0, "foundation", 0.3, "web", 0.8), (0, "foundation", 0.3, "code", 0.2), (1, "general", 0.5, "web", 0.5), (1, "general", 0.5, "code", 0.3), (1, "general", 0.5, "indic", 0.2), (2, "anneal", 0.2, "indic", 0.6), (2, "anneal", 0.2, "web", 0.4),
)


@query(f"WITH l AS (SELECT *, share - lag(share) OVER (PARTITION BY lane ORDER BY ord) AS shift FROM {_MIXES.sql}) SELECT ord, arg_max(lane, abs(shift)) AS lane, round(arg_max(shift, abs(shift)), 9) AS shift FROM l WHERE shift IS NOT NULL GROUP BY ord")
def stage_seams(spark, sf_dir):
    return rounded(mx.seams(_MIXES.df(spark)), 9)


@query(f"WITH a AS (SELECT lane, share FROM {_MIXES.sql} WHERE ord = 0), b AS (SELECT lane, share FROM {_MIXES.sql} WHERE ord = 1) SELECT coalesce(a.lane, b.lane) AS lane, round(coalesce(a.share, 0) * 0.75 + coalesce(b.share, 0) * 0.25, 9) AS share FROM a FULL JOIN b ON a.lane = b.lane")
def seam_blend(spark, sf_dir):
    rows = _MIXES.df(spark)
    return rounded(mx.seam_blend(rows.where("ord = 0").select("lane", "share"), rows.where("ord = 1").select("lane", "share"), 0.25), 9)


_RUNGS = Literal("ord int, tokens double, sequence_length double", (0, 1e12, 4096.0), (1, 5e11, 8192.0), (2, 2e11, 32768.0), (3, 1e11, 32768.0))
_SCHEDULE = f"""SELECT ord, tokens, sequence_length, sum(tokens) OVER w - tokens AS start, sum(tokens) OVER w AS "end", sequence_length / lag(sequence_length) OVER (ORDER BY ord) AS multiple FROM {_RUNGS.sql} WINDOW w AS (ORDER BY ord ROWS UNBOUNDED PRECEDING)"""


@query(f"SELECT *, coalesce(multiple IN (1, 2), true) AS ok FROM ({_SCHEDULE})")
def sequence_schedule(spark, sf_dir):
    return mx.sequence_schedule(_RUNGS.df(spark))


_ARM = Literal("lane string, share double", ("web", 0.5), ("indic", 0.2), ("code", 0.2), ("speech", 0.1))


@query(f"SELECT lane, round(CASE WHEN lane = 'indic' THEN share ELSE share * 0.8 / (SELECT sum(share) FROM {_ARM.sql} WHERE lane <> 'indic') END, 9) AS share FROM {_ARM.sql}")
def frozen_arm(spark, sf_dir):
    return rounded(mx.with_frozen(_ARM.df(spark), ("indic",)), 9)


@query(f"SELECT lane, round(CASE WHEN lane IN ('web', 'indic') THEN share ELSE 0.0 END / 0.7, 9) AS share, lane NOT IN ('web', 'indic') AS dropped FROM {_ARM.sql}")
def effective_shares(spark, sf_dir):
    return rounded(mx.effective_shares(_ARM.df(spark), spark.createDataFrame([("web",), ("indic",), ("maps",)], "lane string")), 9)


_DRAWN = Literal("lane string, share double, tokens long", ("code", 0.2, 50_000), ("indic", 0.3, 20_000), ("web", 0.5, 900_000))
_U = "CAST('0x' || left(md5(concat_ws(':', '7', CAST(d AS VARCHAR), '{0}')), 13) AS BIGINT) / 4503599627370496.0"


@query(
    f"""WITH l AS (SELECT lane, greatest(257, floor(tokens * 0.5)) AS size, sum(share) OVER (ORDER BY lane ROWS UNBOUNDED PRECEDING) / sum(share) OVER () AS high FROM {_DRAWN.sql}), b AS (SELECT *, coalesce(lag(high) OVER (ORDER BY lane), 0) AS low FROM l),
    u AS (SELECT d, {_U.format('lane')} AS u, {_U.format('place')} AS v FROM range(100, 2100) AS t(d)) SELECT d AS draw, lane, CAST(floor(v * greatest(size - 257, 1)) AS BIGINT) AS start FROM u JOIN b ON u >= low AND u < high"""
)
def mixture_draws(spark, sf_dir):
    return mx.mixture_draws(_DRAWN.df(spark), 2000, 256, seed=7, unique_fraction=0.5, first=100)


@query("SELECT doc_id, md5(left(coalesce(text, ''), CAST(floor(length(coalesce(text, '')) * 0.9) AS BIGINT))) AS train, md5(substr(coalesce(text, ''), CAST(floor(length(coalesce(text, '')) * 0.9) AS BIGINT) + 1)) AS held_out FROM documents")
def tail_split(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return mx.tail_split(docs).select("doc_id", F.md5("train").alias("train"), F.md5("held_out").alias("held_out"))


_BANDS = Literal("ord int, band string, share double, tokens double", (0, "short", 0.4, 120.0), (1, "medium", 0.3, 800.0), (2, "long", 0.2, 800.0), (3, "ultra", 0.2, 9000.0))


@query(f"SELECT band, share, share * 0.15 * 2e12 AS tokens FROM {_BANDS.sql}")
def band_tokens(spark, sf_dir):
    return mx.band_tokens(_BANDS.df(spark).drop("tokens"), 0.15, 2e12)


_LEVELS = Literal("stage string, band string, share double", ("foundation", "easy", 0.9), ("foundation", "hard", 0.1), ("general", "easy", 0.5), ("general", "hard", 0.4), ("anneal", "hard", 1.0))


@query(f"SELECT band, round(sum(share * duration), 9) AS share FROM {_LEVELS.sql} l JOIN {_STAGES.sql} s ON s.stage = l.stage GROUP BY band")
def band_shares(spark, sf_dir):
    return rounded(mx.band_shares(_STAGES.df(spark), _LEVELS.df(spark)), 9)


_RUNS = Literal("rung string, params double, tokens double, arms int", ("step-0", 5.785e6, 2.05e6, 20), ("1B", 1e9, 2e9, 4), ("3B", 3e9, 2e9, 2))
_MACHINES = Literal("machine string, tflops double, usd_per_hour double", ("local", 5.281, None), ("rented", 312.0, 2.9), ("unknown", None, 1.0))


@query(f"SELECT rung, machine, 6.0 * params * tokens * arms AS flops, round(6.0 * params * tokens * arms / (tflops * 1e12) / 3600, 9) AS hours, round(6.0 * params * tokens * arms / (tflops * 1e12) / 3600 * usd_per_hour, 9) AS usd FROM {_RUNS.sql}, {_MACHINES.sql} m")
def cost_ladder(spark, sf_dir):
    return rounded(mx.cost_ladder(_RUNS.df(spark), _MACHINES.df(spark)), 9)


@query(f"SELECT machine, tflops * 1e12 * 168.0 * 3600 / (6.0 * 1e9) AS tokens, round(1000.0 / ln(2) / 420, 9) AS bpb FROM {_MACHINES.sql}")
def budget_reach(spark, sf_dir):
    return _MACHINES.df(spark).select("machine", mx.tokens_for_hours(F.col("tflops"), F.lit(168.0), F.lit(1e9)).alias("tokens"), F.round(mx.bits_per_byte(F.lit(1000.0), F.lit(420)), 9).alias("bpb"))


_SCORES = Literal(
    "arm string, lane string, seed int, score double", *[(a, k, s, round(m + d, 4)) for a, k, m in (("A", "indic", 2.50), ("A", "web", 2.20), ("B", "indic", 2.62), ("B", "web", 2.21), ("C", "indic", 2.51), ("C", "web", 2.20), ("D", "indic", 2.70), ("D", "web", 2.10)) for s, d in ((1, -0.01), (2, 0.0), (3, 0.015))]
)
_HYPOTHESES = Literal("hypothesis string, arm string, lane string, threshold double, other_gain double", ("H1", "B", "indic", 0.03, None), ("H2", "C", "indic", 0.03, None), ("H3", "D", "indic", 0.03, 0.01), ("H4", "B", "indic", 0.09, 0.01))
_STATS = f"SELECT arm, lane, avg(score) AS m, max(score) - min(score) AS s FROM {_SCORES.sql} GROUP BY arm, lane"


@query(
    f"""WITH s AS ({_STATS}), p AS (SELECT s.arm, s.lane, s.m / b.m - 1 AS effect, greatest(s.s, b.s) / b.m AS noise FROM s JOIN s b ON b.arm = 'A' AND b.lane = s.lane WHERE s.arm <> 'A'),
    o AS (SELECT h.*, p.effect, p.noise FROM {_HYPOTHESES.sql} h JOIN p ON p.arm = h.arm AND p.lane = h.lane),
    g AS (SELECT h.hypothesis, max(-p.effect) AS gain, arg_max(p.lane, -p.effect) AS best_lane, arg_max(p.noise, -p.effect) AS gn FROM {_HYPOTHESES.sql} h JOIN p ON p.arm = h.arm AND p.lane <> h.lane WHERE other_gain IS NOT NULL GROUP BY h.hypothesis)
    SELECT o.hypothesis, round(effect, 9) AS effect, round(noise, 9) AS noise, CASE WHEN abs(effect) <= noise THEN 'inconclusive' WHEN effect >= threshold THEN CASE WHEN gain > other_gain AND gain > gn THEN 'refuted' WHEN gain > other_gain THEN 'qualified' ELSE 'supported' END ELSE 'refuted' END AS verdict,
      best_lane, round(gain, 9) AS gain FROM o LEFT JOIN g ON g.hypothesis = o.hypothesis"""
)
def hypothesis_verdicts(spark, sf_dir):
    return rounded(mx.hypothesis_verdicts(_SCORES.df(spark), _HYPOTHESES.df(spark)), 9)


@query(f"WITH s AS (SELECT arm, count(*) AS n, avg(score) AS m, max(score) - min(score) AS spread FROM {_SCORES.sql} GROUP BY arm) SELECT arm, n, round(m, 9) AS mean, round(spread, 9) AS spread, round(m / (SELECT m FROM s WHERE arm = 'A') - 1, 9) AS effect FROM s")
def seed_statistics(spark, sf_dir):
    return rounded(mx.seed_statistics(_SCORES.df(spark), "A"), 9)


@query(f"SELECT arm AS run, round(sum(score * share) / sum(share), 9) AS score FROM {_SCORES.sql} s JOIN {_ARM.sql} w ON w.lane = s.lane GROUP BY arm")
def run_scores(spark, sf_dir):
    return rounded(mx.weighted_score(_SCORES.df(spark).withColumnRenamed("arm", "run"), _ARM.df(spark).withColumnRenamed("share", "weight")), 9)


_REPEATS = Literal("epochs double, score double", (1.15, 2.5023), (2.30, 2.5884), (4.59, 2.5738), (9.18, 2.6286), (18.37, 2.6722))


@query(f"WITH b AS (SELECT *, first(score) OVER (ORDER BY epochs) AS b, lead(score) OVER (ORDER BY epochs) AS n FROM {_REPEATS.sql}) SELECT epochs, score, round(100 * (score / b - 1), 9) AS excess, score - b > 0.08 AS beyond_noise, coalesce(n < score, false) AS inverted FROM b")
def repetition_reading(spark, sf_dir):
    return rounded(mx.repetition_reading(_REPEATS.df(spark), 0.08), 9)


@query("SELECT round(max(loss) FILTER (step BETWEEN 200 AND 240) / median(loss) FILTER (step BETWEEN 160 AND 199), 9) AS ratio FROM (SELECT CAST(i AS INTEGER) AS step, 2.0 + 0.5 / (1 + i) + CASE WHEN i = 203 THEN 0.4 ELSE 0 END AS loss FROM range(400) AS t(i))")
def seam_peak(spark, sf_dir):
    losses = spark.range(400).select(F.col("id").cast("int").alias("step"), (2.0 + 0.5 / (1 + F.col("id")) + F.when(F.col("id") == 203, 0.4).otherwise(0.0)).alias("loss"))
    return rounded(mx.seam_peak(losses, 200), 9)


_SCALES = Literal("scale long, arm string, score double", *[(s, a, v) for s, row in ((1, (2.5, 2.6, 2.4, 2.45)), (4, (2.3, 2.2, 2.25, 2.21)), (16, (2.1, 2.12, 2.0, 2.02))) for a, v in zip("ABCD", row)])


@query(f"WITH s AS (SELECT * FROM {_SCALES.sql}), b AS (SELECT arm, score AS s0 FROM s WHERE scale = 1), j AS (SELECT s.scale, s.arm, score, s0 FROM s JOIN b ON b.arm = s.arm WHERE scale > 1) SELECT 1::BIGINT AS small, a.scale AS large, a.arm AS better, b.arm AS worse FROM j a JOIN j b ON a.scale = b.scale AND a.s0 < b.s0 AND a.score > b.score")
def rank_inversions(spark, sf_dir):
    return mx.rank_inversions(_SCALES.df(spark))


_VERDICTS = Literal("lane string, verdict string", ("web", "sufficient"), ("agentic", "beyond ceiling"), ("made", "beyond ceiling"), ("stem", "exhausted"))
_DECLARED = Literal("lane string", ("agentic",))
_SUPPLY = Literal("lane string, n long, tokens double", ("web", 2, 1e12), ("code", 0, None), ("indic", 3, 0.0), ("agentic", 1, 1e8), ("stem", 1, 5e9))
_LANG_PLAN = Literal("lang string, share double, unknown double, blocked boolean", ("hi", 0.5, 0.001, False), ("te", 0.3, 0.002, False), ("bn", 0.1, 0.83, True), ("ta", 0.0, 0.9, True))
_CLAIMS = Literal("hypothesis string, threshold double, refuted_if string, lane string", ("H1", 0.03, "less than 3 %", "indic"), ("H2", 0.0, " ", "web"), ("H3", 0.01, "x", None))
_GAPS = Literal("lane string, gap double", ("web", 0.001), ("code", -0.02))


def _sum_off(rows: str, amount: str, by: str | None = None) -> str:
    return f"SELECT {by or '1 AS one'} FROM {rows} {f'GROUP BY {by}' if by else ''} HAVING abs(coalesce(sum({amount}), 0) - 1) > 1e-9"


@query(
    " UNION ALL ".join(
        (
            f"SELECT 'INV-1' AS rule, 'error' AS level, 'sum' AS subject FROM ({_sum_off(_SHARES.sql, 'share')})",
            f"SELECT 'INV-2', 'error', lane FROM {_VERDICTS.sql} WHERE verdict = 'beyond ceiling' AND lane NOT IN (SELECT lane FROM {_DECLARED.sql})",
            f"SELECT 'INV-2', 'warning', lane FROM {_VERDICTS.sql} WHERE verdict IN ('exhausted', 'diminishing')",
            f"SELECT 'INV-3', 'error', f.lane FROM {_FLOORS.sql} f LEFT JOIN {_SHARES.sql} s ON s.lane = f.lane WHERE coalesce(share, 0) < floor",
            f"SELECT 'INV-4', 'error', lane FROM {_SHARES.sql} WHERE share > 0 AND lane NOT IN (SELECT unnest(lanes) FROM {_BENCHES.sql})",
            f"SELECT 'INV-4b', 'error', benchmark FROM {_BENCHES.sql} WHERE NOT list_has_any(lanes, (SELECT list(lane) FROM {_LANES.sql} WHERE share > 0 OR schedule_only))",
            f"SELECT 'INV-5', 'warning', 'synthetic' FROM (SELECT sum(share) AS s FROM {_INDIC.sql} WHERE tier IN ('C', 'D')) WHERE s > 0.3",
            f"SELECT 'INV-6a', 'error', 'durations' FROM ({_sum_off(_STAGES.sql, 'duration')})",
            f"SELECT 'INV-6a', 'error', stage FROM ({_sum_off(_LEVELS.sql, 'share', 'stage')})",
            f"SELECT 'INV-6b', 'error', lane FROM {_GAPS.sql} WHERE abs(gap) > 0.01",
            f"SELECT 'INV-7', 'error', 'reserve' FROM {_POOLS.sql} HAVING NOT sum(tokens * fraction) / 2e12 >= 0.03 * 0.9",
            f"SELECT 'INV-8', 'error', s.lane FROM {_SHARES.sql} s LEFT JOIN {_SUPPLY.sql} u ON u.lane = s.lane WHERE share > 0 AND (coalesce(n, 0) = 0 OR coalesce(tokens, 0) <= 0)",
            f"SELECT 'INV-9', 'error', 'tiers' FROM ({_sum_off(_INDIC.sql, 'share')})",
            f"SELECT 'INV-10', 'error', 'shares' FROM ({_sum_off(_BANDS.sql, 'share')})",
            "SELECT 'INV-10', 'error', 'lengths'",
            f"SELECT 'INV-11', 'error', hypothesis FROM {_CLAIMS.sql} WHERE threshold <= 0",
            f"SELECT 'INV-11', 'error', hypothesis FROM {_CLAIMS.sql} WHERE trim(coalesce(refuted_if, '')) = ''",
            f"SELECT 'INV-11', 'error', hypothesis FROM {_CLAIMS.sql} WHERE coalesce(lane, '') = ''",
            f"SELECT 'INV-12', 'error', stage FROM ({_sum_off(_LEVELS.sql, 'share', 'stage')})",
            f"SELECT 'INV-12', 'error', 'bands' FROM ({_sum_off(f'(SELECT share * duration AS x FROM {_LEVELS.sql} l JOIN {_STAGES.sql} s ON s.stage = l.stage)', 'x')})",
            f"SELECT 'INV-13', 'error', lang FROM {_LANG_PLAN.sql} WHERE share > 0 AND unknown > 0.05",
            f"SELECT 'INV-13', 'error', lang FROM {_LANG_PLAN.sql} WHERE share > 0 AND blocked",
            f"SELECT 'INV-13', 'error', 'languages' FROM ({_sum_off(_LANG_PLAN.sql, 'share')})",
            f"SELECT 'INV-14', 'error', CAST(ord AS VARCHAR) FROM ({_SCHEDULE}) WHERE multiple NOT IN (1, 2)",
        )
    )
)
def invariant_findings(spark, sf_dir):
    d = lambda t: t.df(spark)
    benches, shares = d(_BENCHES), d(_SHARES)
    return iv.all_findings(
        iv.shares_sum(shares), iv.within_supply(d(_VERDICTS), d(_DECLARED)), iv.floors_hold(shares, d(_FLOORS), 0.20), iv.lanes_measured(shares, mx.by_lane(benches)), iv.benchmarks_funded(mx.unfunded(benches, d(_LANES))),
        iv.synthetic_capped(d(_INDIC), cap=0.3), iv.schedule_formed(d(_STAGES), d(_LEVELS)), iv.stages_integrate(d(_GAPS), 0.01), iv.reserve_covers(mx.anneal_reserve(d(_POOLS), 2e12, 0.03)), iv.supply_traceable(shares, d(_SUPPLY)),
        iv.tiers_sum(d(_INDIC)), iv.bands_differ(d(_BANDS)), iv.falsifiable(d(_CLAIMS)), iv.ladder_partitions(mx.band_shares(d(_STAGES), d(_LEVELS)), d(_LEVELS)), iv.languages_spendable(d(_LANG_PLAN)), iv.lengths_double(mx.sequence_schedule(d(_RUNGS))),
    )


# ---------------------------------------------------------------- tokens, languages, records

_COUNTS = Literal("tokenizer string, lang string, tokens long, words long, unknown long", ("own", "en", 1300, 1000, 2), ("own", "hi", 2110, 1000, 9), ("own", "bn", 900, 300, 750), ("wide", "en", 1200, 1000, 0), ("wide", "hi", 5360, 1000, 0), ("wide", "bn", 3000, 300, 0))
_USABLE = f"(SELECT *, CASE WHEN tokens > 0 AND unknown / tokens <= 0.05 THEN tokens END AS usable FROM {_COUNTS.sql})"


@query(f"SELECT tokenizer, lang, usable FROM {_USABLE}")
def usable_counts(spark, sf_dir):
    return _COUNTS.df(spark).select("tokenizer", "lang", tk.usable_count(F.col("tokens"), F.col("unknown")).alias("usable"))


@query(f"SELECT lang, min(usable) AS least, max(usable) AS most, round(max(usable) / min(usable), 9) AS ratio FROM {_USABLE} WHERE usable IS NOT NULL GROUP BY lang")
def tokenizer_spread(spark, sf_dir):
    counts = _COUNTS.df(spark).withColumn("tokens", tk.usable_count(F.col("tokens"), F.col("unknown")))
    return rounded(tk.tokenizer_spread(counts), 9)


@query(f"WITH f AS (SELECT tokenizer, lang, tokens / words AS f FROM {_COUNTS.sql}) SELECT f.tokenizer, f.lang, round(f.f, 9) AS fertility, round(f.f / e.f, 9) AS expansion FROM f LEFT JOIN f e ON e.tokenizer = f.tokenizer AND e.lang = 'en'")
def tokenizer_expansion(spark, sf_dir):
    return rounded(tk.expansion(_COUNTS.df(spark).select("tokenizer", "lang", (F.col("tokens") / F.col("words")).alias("fertility"))), 9)


@query(f"WITH f AS (SELECT tokenizer, lang, tokens / words AS f FROM {_COUNTS.sql}) SELECT tokenizer, round(max(f) FILTER (lang <> 'en') / max(f) FILTER (lang = 'en'), 9) AS parity, max(f) FILTER (lang <> 'en') / max(f) FILTER (lang = 'en') <= 1.5 AS met FROM f GROUP BY tokenizer")
def parity_ratios(spark, sf_dir):
    return rounded(tk.parity(_COUNTS.df(spark).select("tokenizer", "lang", (F.col("tokens") / F.col("words")).alias("fertility"))), 9)


@query(
    f"""WITH s AS (SELECT lang, sum(unknown) / sum(tokens) AS u, sum(tokens) / sum(words) AS f FROM {_COUNTS.sql} WHERE tokenizer = 'own' GROUP BY lang)
    SELECT lang, round(u, 9) AS unknown_share, round(f, 9) AS tokens_per_word, u <= 0.05 AS admitted, CAST(row_number() OVER (ORDER BY u <= 0.05 DESC, f NULLS LAST, lang) AS INTEGER) AS wave FROM s"""
)
def language_readability(spark, sf_dir):
    return rounded(lg.readability(_COUNTS.df(spark).where("tokenizer = 'own'")), 9)


_SPLITS = Literal("recipe string, score double", ("a", 3.0), ("a", 5.0), ("a", 4.0), ("b", 2.0), ("b", 2.5))


@query(f"SELECT recipe, count(*) AS n, avg(score) AS mean, round(stddev_samp(score), 9) AS stdev, min(score) AS low, max(score) AS high FROM {_SPLITS.sql} GROUP BY recipe")
def recipe_stability(spark, sf_dir):
    return rounded(tk.stability(_SPLITS.df(spark)), 9)


_SPECS = Literal("spec string, adjusted double, error string", ("a", 5.0, None), ("b", None, "failed"), ("c", 7.5, None), ("d", 5.0, None), ("e", None, "no memory"))


@query(f"SELECT spec, adjusted, error, CAST(row_number() OVER (ORDER BY error IS NOT NULL, adjusted DESC NULLS LAST, spec) AS INTEGER) AS place FROM {_SPECS.sql}")
def recipe_ranking(spark, sf_dir):
    return tk.ranked(_SPECS.df(spark))


@query(f"SELECT lang, fertility > before AS degraded FROM (SELECT arg_min(lang, before) AS lang, min(before) AS before, arg_min(after, before) AS fertility FROM {_FERT.sql})")
def best_degraded(spark, sf_dir):
    rows = _FERT.df(spark)
    return tk.degrades_best(rows.select("lang", F.col("after").alias("fertility")), rows.select("lang", F.col("before").alias("fertility")))


_LINES = Literal("a string, b string, question string, answer string, second string", (" ", " x ", "q?", "yes", None), ("one", "two", " ", " no ", "maybe"), (None, None, None, None, ""))


@query(
    f"""WITH l AS (SELECT * FROM {_LINES.sql}) SELECT coalesce(nullif(trim(a), ''), nullif(trim(b), ''), '') AS text, array_to_string(list_filter([nullif(trim(question), ''), nullif(trim(answer), ''), nullif(trim(second), '')], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS qa FROM l"""
)
def record_texts(spark, sf_dir):
    answers = F.array(F.struct(F.col("answer").alias("text")), F.struct(F.col("second").alias("text")))
    return _LINES.df(spark).select(rc.first_text("a", "b").alias("text"), rc.question_text(F.col("question"), answers).alias("qa"))


@query(
    "SELECT conv_id, coalesce(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10) || chr(10) ORDER BY turn) FILTER (regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g') <> ''), '') AS text, CAST(count(*) AS INTEGER) AS turns FROM conversations GROUP BY conv_id"
)
def conversation_texts(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("content")))).alias("t"))
    return turns.select("conv_id", rc.conversation_text(F.col("t")).alias("text"), rc.turn_count(F.col("t")).alias("turns"))


_SETS = Literal("i int, a array<string>, b array<string>", (1, ["x", "y", "z"], ["y", "z", "w"]), (2, [], []), (3, ["x"], []), (4, ["q", "r"], ["r", "q"]))


@query(f"SELECT i, CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) END AS jaccard FROM {_SETS.sql}")
def set_similarity(spark, sf_dir):
    return _SETS.df(spark).select("i", sm.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query(
    """WITH c AS (SELECT CAST(i AS INTEGER) AS canary, string_agg('zq' || left(sha256('3:' || i || ':' || j), 8), ' ' ORDER BY j) AS text FROM range(24) AS t(i), range(15) AS u(j) GROUP BY i) SELECT canary, text, true AS recovered FROM c"""
)
def canaries_recovered(spark, sf_dir):
    planted = at.canaries(spark, 24, seed=3)
    docs = planted.select(F.col("canary").alias("doc_id"), F.concat(F.lit("before it "), F.col("text"), F.lit(" after it")).alias("text"))
    found = at.recovered(docs, planted)
    return planted.join(found, "canary", "left").select("canary", "text", F.coalesce("recovered", F.lit(False)).alias("recovered"))


@query("SELECT sha256('{\"a\": 1, \"b\": [\"x\", null]}') AS config, 'run-lite-' || left(sha256('c|d|e'), 12) AS run, 'sha256:' || sha256('') AS empty")
def run_identity(spark, sf_dir):
    return spark.createDataFrame([(mf.config_fingerprint({"b": ["x", None], "a": 1}), mf.run_id("lite", "c", "d", "e"))], "config string, run string").withColumn("empty", F.concat(F.lit("sha256:"), F.sha2(F.lit(""), 256)))


@query("SELECT " + ", ".join(f"CAST({v} AS DOUBLE) AS {k}" for k, v in (("e112", 112**-0.5), ("threshold", sm.threshold()))))
def estimate_error(spark, sf_dir):
    return spark.createDataFrame([(sm.PERMUTATIONS**-0.5, sm.threshold())], "e112 double, threshold double")


_TURNS = Literal("i int, text string, turns int", (1, "a b c d e f g", 3), (2, "one two", 5), (3, "", 2), (4, "x y z", 0))


@query(
    f"""WITH w AS (SELECT i, list_filter(string_split(text, ' '), lambda x: x <> '') AS w, greatest(turns, 1) AS n FROM {_TURNS.sql}), s AS (SELECT *, greatest(len(w) // n, 1) AS k FROM w)
    SELECT i, array_to_string(list_transform(range(0, least(CAST(n AS BIGINT), CAST(ceil(len(w) / k) AS BIGINT))), lambda j: array_to_string(w[j * k + 1:j * k + k], ' ')), '|') AS turns FROM s"""
)
def rebuilt_turns(spark, sf_dir):
    return _TURNS.df(spark).select("i", F.array_join(cv.rebuilt(F.col("text"), F.col("turns")), "|").alias("turns"))


@query("SELECT * FROM (VALUES ('held-out', 2, 0), ('canary-only', 0, 3), ('unchecked', 0, 0)) AS t(coverage, items, canaries)")
def coverage_words(spark, sf_dir):
    rows = [(at.coverage(i, c), i, c) for i, c in ((2, 0), (0, 3), (0, 0))]
    return reduce(DataFrame.unionAll, [spark.createDataFrame([r], "coverage string, items int, canaries int") for r in rows])
