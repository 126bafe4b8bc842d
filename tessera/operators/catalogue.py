"""Catalogues of datasets: sizes and licences read from free text, grades, supply plans, coverage and vocabulary sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import let
from tessera.operators.mixture import CEILING, worth_tokens

# Multipliers of size suffixes, gates, points of verdicts, limits of grades, overlap range of a plan.
MULTIPLIERS = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}
GATES = ("provenance", "composition", "contamination", "yield", "evidence")
BLOCKING = ("provenance", "contamination")
POINTS = {"PASS": 2, "CONDITIONAL": 1, "UNKNOWN": 0, "FAIL": 0}
A_LEAST, B_LEAST, B_SCORED = 8, 5, 3
OVERLAP = (0.20, 0.40)
SIZE = r"([0-9.]+)\s*([BMTKbmtk])"
SPLIT_SIZE = r"(?i)(verified|unverified|synthetic)\s+([0-9.]+)\s*([BMTK])"


def _times(suffix: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, m in MULTIPLIERS.items() for x in (F.lit(k), F.lit(m))]), F.upper(suffix))


def stated_tokens(size: Column) -> Column:
    """The first size in a text that speaks of tokens; else null."""
    amount = F.regexp_extract(size, SIZE, 1).try_cast("double") * _times(F.regexp_extract(size, SIZE, 2))
    return F.when(size.rlike(SIZE) & F.contains(F.lower(size), F.lit("token")), amount)


def stated_parts(size: Column) -> Column:
    """Map of verified, unverified and synthetic sizes, the last of each where it is named twice; empty without any."""
    found = F.arrays_zip(*[F.regexp_extract_all(size, F.lit(SPLIT_SIZE), i).alias(n) for i, n in ((1, "part"), (2, "amount"), (3, "suffix"))])
    parts = F.transform(found, lambda x: F.struct(F.lower(x["part"]).alias("k"), (x["amount"].try_cast("double") * _times(x["suffix"])).alias("v")))
    last = lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"]))
    none = F.map_from_entries(F.array().cast("array<struct<k:string,v:double>>"))
    return F.coalesce(F.map_from_entries(let(parts, last)), none)


def licence_flags(licence: Column) -> Column:
    """struct(commercial, attribution, share_alike): true, false, or null where the text doesn't say."""
    t = F.lower(F.coalesce(licence, F.lit("")))
    has = lambda *some: F.array_contains(F.array(*[F.contains(t, F.lit(s)) for s in some]), True)
    # What marks each permission.
    barred = has("-nc", " nc", "noncommercial", "non-commercial")
    allowed = has("permits commercial", "commercial use", "cc-by-4", "cc by 4", "cc-0", "cc0", "mit", "apache")
    named = (has("by") & has("cc")) | has("attribution")
    alike = has("-sa", "share-alike", "sharealike")
    return F.struct(F.when(barred, False).when(allowed, True).alias("commercial"), F.when(named, True).alias("attribution"), F.when(alike, True).alias("share_alike"))


def graded(rows: DataFrame) -> DataFrame:
    """rows(id, gates map<string,string>, blocking boolean) -> (id, score, scored, grade). A failed blocking gate or a
    blocking finding is X; A and B ask for points and for gates that were looked at; else C. A missing gate is UNKNOWN."""
    verdict = lambda g: F.coalesce(F.try_element_at("gates", F.lit(g)), F.lit("UNKNOWN"))
    points = F.create_map(*[x for k, p in POINTS.items() for x in (F.lit(k), F.lit(p))])
    score = sum((F.coalesce(F.try_element_at(points, verdict(g)), F.lit(0)) for g in GATES), F.lit(0))
    scored = sum(((verdict(g) != "UNKNOWN").cast("int") for g in GATES), F.lit(0))
    out = rows.select("id", score.alias("score"), scored.alias("scored"), (F.coalesce("blocking", F.lit(False)) | F.array_contains(F.array(*[verdict(g) == "FAIL" for g in BLOCKING]), True)).alias("__x"))
    grade = F.when(F.col("__x"), "X").when((F.col("score") >= A_LEAST) & (F.col("scored") == len(GATES)), "A").when((F.col("score") >= B_LEAST) & (F.col("scored") >= B_SCORED), "B").otherwise("C")
    return out.select("id", "score", "scored", grade.alias("grade"))


def supply_plan(tiers: DataFrame, committed: DataFrame) -> DataFrame:
    """tiers(tier, required double, is_synthetic), committed(tier, id, tokens, verified, parents array<string>) -> a row
    per tier. A dataset whose parent is committed in the same tier adds nothing: it is contained in it. Natural tiers take
    verified tokens where known. Datasets without a figure are counted, not read as zero."""
    parents = committed.select("tier", "id", F.explode("parents").alias("parent"))
    inside = parents.join(committed.select(F.col("tier").alias("t2"), F.col("id").alias("p2")), (F.col("tier") == F.col("t2")) & (F.col("parent") == F.col("p2")), "left_semi")
    counted = committed.join(inside.select("tier", "id"), ["tier", "id"], "left_anti").join(tiers.select("tier", "is_synthetic"), "tier")
    used = F.when(F.col("is_synthetic"), F.col("tokens")).otherwise(F.coalesce("verified", "tokens"))
    sums = counted.groupBy("tier").agg(F.sum(used).alias("supply"), F.count("*").alias("datasets"), F.count_if(used.isNull()).alias("unmeasured"))
    of = tiers.join(sums, "tier", "left").select("tier", "required", F.coalesce("supply", F.lit(0.0)).alias("supply"), F.coalesce("datasets", F.lit(0)).alias("datasets"), F.coalesce("unmeasured", F.lit(0)).alias("unmeasured"))
    after = [(F.col("supply") * (1 - o)).alias(n) for o, n in zip(OVERLAP, ("deduplicated_high", "deduplicated_low"))]
    return of.select("*", F.greatest(F.col("required") - F.col("supply"), F.lit(0.0)).alias("shortfall"), (F.col("supply") / F.nullif("required", F.lit(0.0))).alias("coverage"), *after)


def capability_matrix(capabilities: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """capabilities(capability, include, exclude, and perhaps traps, arrays), benchmarks(benchmark, about) -> (capability, n,
    benchmarks): those whose description holds a term to include outside of any trap, and none to exclude. Terms are exploded and met with the benchmarks
    in a nested loop over two catalogues; a capability without any has n = 0."""
    about = F.lower("about")
    meets = lambda terms: F.exists(terms, lambda t: F.contains(about, F.lower(t)))
    trapped = F.col("traps") if "traps" in capabilities.columns else F.array().cast("array<string>")
    outside = F.aggregate(F.coalesce(trapped, F.array().cast("array<string>")), about, lambda t, trap: F.replace(t, F.lower(trap), F.lit(" ")))
    named = F.exists("include", lambda t: F.contains(outside, F.lower(t)))
    found = capabilities.join(benchmarks, named & ~F.coalesce(meets(F.col("exclude")), F.lit(False)))
    listed = found.groupBy("capability").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("benchmark")).alias("benchmarks"))
    return capabilities.select("capability").join(listed, "capability", "left").select("capability", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("benchmarks", F.array().cast("array<string>")).alias("benchmarks"))


def orphans(tiers: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """tiers(tier, capabilities) that share no capability with benchmarks(benchmark, capabilities)."""
    measured = benchmarks.select(F.explode("capabilities").alias("c"))
    covered = tiers.select("tier", F.explode("capabilities").alias("c")).join(measured, "c", "left_semi")
    return tiers.join(covered, "tier", "left_anti")


def violations(rows: DataFrame, enums: dict[str, tuple[str, ...]], expected: int | None = None) -> DataFrame:
    """(kind, id, detail): values outside their lists, ids that repeat, and a count that isn't the expected one."""
    out = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated").alias("kind"), "id", F.col("n").cast("string").alias("detail"))
    for c, allowed in enums.items():
        bad = rows.where(F.col(c).isNotNull() & ~F.col(c).isin(*allowed))
        out = out.unionByName(bad.select(F.lit("value").alias("kind"), "id", F.concat_ws("=", F.lit(c), F.col(c)).alias("detail")))
    if expected is not None:
        n = rows.agg(F.count("*").alias("n")).where(F.col("n") != expected)
        out = out.unionByName(n.select(F.lit("count").alias("kind"), F.lit(None).cast("string").alias("id"), F.col("n").cast("string").alias("detail")))
    return out


def vocabulary_sweep(spark: SparkSession, measured_at: int, measured: float, width: int, layers: int, low: int = 64_000, high: int = 320_000, step: int = 8_000) -> DataFrame:
    """(vocab_size, fertility, softmax_cost, token_saving, net_benefit): each doubling of the vocabulary takes 8 % off what
    a measured fertility has above one; the output projection's share of the compute rises. Both against the least size."""
    v = F.col("vocab_size")
    fert = lambda x: 1 + max(measured - 1, 0.0) * F.pow(F.lit(0.92), F.log2(x / measured_at))
    cost = lambda x: x / (x + 6.0 * width * layers)
    first = F.lit(float(low))
    rows = spark.range(low, high + 1, step).select(F.col("id").alias("vocab_size")).select("*", fert(v).alias("f"), cost(v).alias("c"), fert(first).alias("f0"), cost(first).alias("c0"))
    saving = (F.col("f0") - F.col("f")) / F.col("f0")
    return rows.select("vocab_size", F.round("f", 4).alias("fertility"), F.round("c", 6).alias("softmax_cost"), F.round(saving, 6).alias("token_saving"), F.round(saving - (F.col("c") - F.col("c0")), 6).alias("net_benefit"))


def best_vocabulary(sweep: DataFrame, multiple: int = 128) -> DataFrame:
    """One row: the size of greatest net benefit (the smallest of equals), and it rounded up to a multiple."""
    best = sweep.agg(F.min_by("vocab_size", F.struct(-F.col("net_benefit"), "vocab_size")).alias("peak"), F.max("net_benefit").alias("net_benefit"))
    return best.withColumn("recommended", (F.ceil(F.col("peak") / multiple) * multiple).cast("long"))


# Which findings speak of which gate.
FINDING_OF = {"composition": "COMPOSITION", "contamination": "PROVENANCE", "yield": "DEDUP"}


def derived_gates(rows: DataFrame) -> DataFrame:
    """rows(id, tier, licence, used_by, types array<string>, blocking) -> (id, gates map). A row that says nothing of a
    gate is UNKNOWN there, never a pass."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    tier, licence, used = F.upper(said(F.col("tier"))), said(F.col("licence")), said(F.col("used_by"))
    blocking = F.coalesce("blocking", F.lit(False))
    found = lambda gate: F.coalesce(F.array_contains("types", FINDING_OF[gate]), F.lit(False))
    verdicts = {
        "provenance": F.when(blocking, "FAIL").when((tier == "GREEN") & (licence != ""), "PASS").when(tier == "AMBER", "CONDITIONAL").when(tier == "RED", "FAIL"),
        "composition": F.when(found("composition"), "CONDITIONAL"),
        "contamination": F.when(found("contamination") & blocking, "FAIL"),
        "yield": F.when(found("yield"), "CONDITIONAL"),
        "evidence": F.when(used != "", "PASS"),
    }
    return rows.select("id", F.create_map(*[x for g in GATES for x in (F.lit(g), F.coalesce(verdicts[g], F.lit("UNKNOWN")))]).alias("gates"))


def risk_notes(rows: DataFrame, rules: Sequence[tuple[str, str]], barring: Sequence[str], upsides: Sequence[str]) -> DataFrame:
    """rows(id, note) -> (id, findings array<struct<type,text,severity>>, opportunity, rest).

    A note is cut into sentences. rules (type, pattern), in order, give a sentence its type; of each type the first sentence
    counts. A word of `barring` makes a finding blocking, and one anywhere in the note all of them. The first sentence
    without a type that holds a word of `upsides` is the opportunity; the others of those are the rest."""
    holds = lambda t, words: F.coalesce(F.array_contains(F.array(*[F.contains(t, F.lit(w)) for w in words]), True), F.lit(False))
    note = F.coalesce("note", F.lit(""))
    parts = F.array_remove(F.transform(F.split(note, r"(?<=[.;!?])\s+|\s+-\s+(?=[A-Z])"), lambda s: F.trim(s)), "")

    def judged(s: Column) -> Column:
        kind = F.lit(None).cast("string")
        for name, pattern in reversed(rules):
            kind = F.when(F.lower(s).rlike(pattern), name).otherwise(kind)
        severity = F.when(holds(F.lower(s), barring), "blocking").otherwise("advisory")
        return F.struct(kind.alias("type"), s.alias("text"), severity.alias("severity"))

    cut = rows.select("id", holds(F.lower(note), barring).alias("barred"), F.transform(parts, judged).alias("s"))
    first = F.filter("s", lambda x, i: x["type"].isNotNull() & ~F.exists(F.slice("s", 1, i), lambda y: y["type"].eqNullSafe(x["type"])))
    findings = F.transform(first, lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), F.when(F.col("barred"), "blocking").otherwise(x["severity"]).alias("severity")))
    plain = F.transform(F.filter("s", lambda x: x["type"].isNull()), lambda x: x["text"])
    cut = cut.select("id", findings.alias("findings"), plain.alias("plain"))
    at = F.array_position(F.transform("plain", lambda t: holds(F.lower(t), upsides)), True)
    rest = F.array_join(F.filter("plain", lambda t, i: i + 1 != F.col("at")), " ")
    return cut.withColumn("at", at).select("id", "findings", F.try_element_at("plain", F.nullif("at", F.lit(0)).cast("int")).alias("opportunity"), F.nullif(rest, F.lit("")).alias("rest"))


def lost(given: DataFrame, kept: DataFrame) -> DataFrame:
    """Ids of given that are nowhere in kept: a step over a catalogue drops nothing silently."""
    return given.select("id").join(kept.select("id"), "id", "left_anti")


def tier_of(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """rows(id, category), mapping(ord, tier, category) -> (id, tier) of the first tier that lists the category; else null."""
    found = rows.select("id", "category").join(F.broadcast(mapping), "category", "left")  # the mapping is a short list
    return found.groupBy("id").agg(F.min_by("tier", "ord").alias("tier"))


def lifecycle(rows: DataFrame, stages: DataFrame) -> DataFrame:
    """rows(id, stage array<string>), stages(step, tag) -> (id, step), a row for each step that a dataset serves; a null
    step for one that serves none, which is reported and not dropped."""
    tagged = rows.select("id", F.explode_outer("stage").alias("tag")).join(F.broadcast(stages), "tag", "left")
    known = tagged.where("step is not null").select("id", "step").distinct()
    none = rows.select("id").distinct().join(known.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("step"))
    return known.unionByName(none)


# Reasons in the order in which they are listed, and the grades that may be used.
USABLE = ("A", "B")


def blockers(rows: DataFrame) -> DataFrame:
    """rows(id, gated, is_gap, grade, commercial, tokens) -> (id, blockers): everything that keeps a dataset from being
    committed. A failed check (excluded) differs from one that nobody made (evidence), reading terms from asking a person
    (access). None: it can be."""
    no = F.coalesce(F.col("commercial"), F.lit(False))
    reasons = (
        F.when(F.col("gated") == "manual", "access"),
        F.when(F.coalesce("is_gap", F.lit(False)), "does not exist"),
        F.when(F.col("grade") == "X", "excluded").when(~F.coalesce(F.col("grade").isin(*USABLE), F.lit(False)), "evidence"),
        F.when(~no, "licence"),
        F.when(F.col("tokens").isNull(), "size"),
    )
    return rows.select("id", F.array_compact(F.array(*reasons)).alias("blockers"))


def lifecycle_rollup(rows: DataFrame, stages: DataFrame) -> DataFrame:
    """Datasets of each step, those that can be committed, those with a size, known tokens, and those that only a licence
    blocks. rows as for blockers(), with stage."""
    blocked = blockers(rows)
    each = lifecycle(rows, stages).where("step is not null").join(blocked, "id").join(rows.select("id", "tokens"), "id")
    only = F.col("blockers") == F.array(F.lit("licence"))
    return each.groupBy("step").agg(F.count("*").alias("datasets"), F.count_if(F.size("blockers") == 0).alias("committable"), F.count("tokens").alias("sized"), F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("tokens"), F.count_if(only).alias("licence_only"))


def licence_queue(rows: DataFrame, tiers: DataFrame) -> DataFrame:
    """rows as for blockers(), tiers(id, tier) -> (place, id, tier, tokens): datasets that only a licence keeps from a tier,
    the greatest first and those of unknown size last. One row a dataset of a catalogue."""
    waiting = rows.join(blockers(rows), "id").where(F.col("blockers") == F.array(F.lit("licence"))).join(tiers.where("tier is not null"), "id")
    place = F.row_number().over(Window.orderBy(F.col("tokens").desc_nulls_last(), "id"))
    return waiting.select(place.alias("place"), "id", "tier", "tokens")


def coverage_status(matrix: DataFrame) -> DataFrame:
    """capability_matrix() with a status: hole without a benchmark, thin with one, else covered."""
    return matrix.withColumn("status", F.when(F.col("n") == 0, "hole").when(F.col("n") == 1, "thin").otherwise("covered"))


def domain_coverage(domains: DataFrame, datasets: DataFrame) -> DataFrame:
    """domains(domain, modality, pattern, in_crawls), datasets(id, about, committable) -> (domain, modality, datasets,
    committable, status). Patterns meet descriptions in a nested loop over two short lists; case is ignored. Without a
    match a domain is inside the crawls or absent."""
    hit = datasets.join(F.broadcast(domains), F.regexp(F.lower("about"), F.lower("pattern")))
    n = hit.groupBy("domain").agg(F.count("*").alias("datasets"), F.count_if("committable").alias("committable"))
    out = domains.join(n, "domain", "left").fillna(0, ["datasets", "committable"])
    status = F.when(F.col("datasets") > 0, "isolated").when(F.col("in_crawls"), "inside crawls").otherwise("absent")
    return out.select("domain", "modality", "datasets", "committable", status.alias("status"))


def modality_rollup(domain_rows: DataFrame) -> DataFrame:
    """(modality, datasets, committable, unsupplied): sums over its domains, and those that no dataset isolates."""
    unsupplied = F.array_sort(F.collect_list(F.when(F.col("status") != "isolated", F.col("domain"))))
    return domain_rows.groupBy("modality").agg(F.sum("datasets").alias("datasets"), F.sum("committable").alias("committable"), unsupplied.alias("unsupplied"))


def curriculum_shares(tiers: DataFrame, weights: DataFrame, emphasis: DataFrame) -> DataFrame:
    """tiers(tier, share), weights(tier, modality, weight), emphasis(stage, modality, factor) -> (stage, modality, share):
    the mixture by modality at each stage, renormalised; a factor that isn't given is 1."""
    base = tiers.join(weights, "tier").groupBy("modality").agg(F.sum(F.col("share") * F.col("weight")).alias("base"))
    each = base.crossJoin(emphasis.select("stage").distinct()).join(emphasis, ["stage", "modality"], "left")  # lists of a few rows
    each = each.select("stage", "modality", (F.col("base") * F.coalesce("factor", F.lit(1.0))).alias("w"))
    return each.select("stage", "modality", F.round(F.col("w") / F.sum("w").over(Window.partitionBy("stage")), 4).alias("share"))


# Of training cost.
FLOPS, GPU_FLOPS, USD_HOUR, INR, BANDS = 6, 4.0e14, 2.0, 88.0, ((1e4, "$"), (1e5, "$$"), (1e6, "$$$"), (1e7, "$$$$"), (1e8, "$$$$$"))


def training_cost(tokens: Column, params: Column | float, inr: float = INR) -> Column:
    """struct(flops, gpu_hours, usd, inr) of training on tokens: six operations a parameter and token."""
    flops = F.lit(float(FLOPS)) * params * tokens
    hours = flops / GPU_FLOPS / 3600
    return F.struct(flops.alias("flops"), hours.alias("gpu_hours"), (hours * USD_HOUR).alias("usd"), (hours * USD_HOUR * inr).alias("inr"))


def cost_band(usd: Column) -> Column:
    out = F.lit(BANDS[-1][1] + "$")
    for ceiling, band in reversed(BANDS):
        out = F.when(usd < ceiling, band).otherwise(out)
    return out


def cost_saved(words: Column, before: Column, after: Column, params: float) -> Column:
    """What the same words cost less when a tokenizer takes `after` tokens a word and not `before`."""
    old, new = training_cost(words * before, params), training_cost(words * after, params)
    return F.struct(*[(old[k] - new[k]).alias(k) for k in ("flops", "gpu_hours", "usd", "inr")])


def vocabulary_trade(seen: Column, share: Column, gain: Column, cost_share: Column, params: float) -> Column:
    """struct(saving, tokens, usd, multiple): what a larger vocabulary saves of a mixture in which `share` of the tokens
    become fewer by `gain`, and how often that pays the compute share which it costs."""
    saving = share * gain
    cost = training_cost(seen * saving, params)
    return F.struct(F.round(saving, 4).alias("saving"), (seen * saving).alias("tokens"), cost["usd"].alias("usd"), F.round(saving / F.nullif(cost_share, F.lit(0.0)), 2).alias("multiple"))


def orphan_cost(tiers: DataFrame, benchmarks: DataFrame, params: float) -> DataFrame:
    """orphans() of tiers(tier, capabilities, seen, share), priced."""
    return orphans(tiers, benchmarks).select("tier", "seen", "share", F.round(training_cost(F.col("seen"), params)["usd"], 2).alias("usd"))


# Limits of a mixture.
NEAR_FREE, HALF_LIFE, WORTHLESS, LEAST_SHARE, ALWAYS_ON, MOST_SYNTHETIC = 4, 16, 40, 0.01, (0.08, 0.20), 0.50


def composed(tiers: DataFrame) -> DataFrame:
    """tiers(tier, needed, epochs, is_indic, is_synthetic, always_on) -> with seen, worth and share. No epochs means one."""
    epochs = F.coalesce(F.col("epochs"), F.lit(1.0))
    unique = F.coalesce(F.col("needed"), F.lit(0.0))
    worth = F.when(epochs <= 1, unique * F.greatest(epochs, F.lit(0.0))).otherwise(worth_tokens(unique, epochs))
    rows = tiers.withColumn("epochs", epochs).withColumn("seen", unique * epochs).withColumn("worth", worth)
    total = rows.agg(F.sum("seen").alias("__total"))
    return rows.crossJoin(total).withColumn("share", F.col("seen") / F.coalesce(F.nullif("__total", F.lit(0.0)), F.lit(1.0))).drop("__total")


def mixture_totals(mix: DataFrame) -> DataFrame:
    """One row of a composed mixture: totals, and what is Indic, natural, synthetic and always on."""
    indic, natural = F.col("is_indic"), F.col("is_indic") & ~F.col("is_synthetic")
    of = lambda c, amount="seen": F.coalesce(F.sum(F.when(c, F.col(amount))), F.lit(0.0))
    total = F.coalesce(F.nullif(F.sum("seen"), F.lit(0.0)), F.lit(1.0))
    synthetic = F.coalesce((of(indic) - of(natural)) / F.nullif(of(indic), F.lit(0.0)), F.lit(0.0))
    return mix.agg(
        total.alias("seen"), F.sum("needed").alias("needed"), F.sum("worth").alias("worth"), (of(indic) / total).alias("indic_share"), (of(natural) / total).alias("natural_share"),
        (of(natural, "worth") / total).alias("natural_worth_share"), synthetic.alias("synthetic_of_indic"), of(F.col("always_on"), "share").alias("always_on_share"),
    )


def guardrails(mix: DataFrame) -> DataFrame:
    """(level, tier, finding) of a composed mixture; with an error it can't be built."""
    e, unasked = F.col("epochs"), F.coalesce(F.col("needed"), F.lit(0.0)) == 0
    found = lambda level, name: F.struct(F.lit(level).alias("level"), F.lit(name).alias("finding"))
    of_tier = F.array_compact(
        F.array(
            F.when(e > WORTHLESS, found("error", "worthless")).when(e > HALF_LIFE, found("warning", "past half-life")).when(e > NEAR_FREE, found("warning", "past near-free")),
            F.when(unasked, found("warning", "no pool stated")),
            F.when(e < 0, found("error", "negative epochs")),
            F.when(~unasked & (F.col("seen") > F.col("needed") * CEILING), found("error", "above ceiling")),
            F.when((F.col("share") < LEAST_SHARE) & (e > 1), found("warning", "sliver repeated")),
        )
    )
    on = F.col("always_on_share")
    of_mix = F.array_compact(
        F.array(
            F.when(F.col("synthetic_of_indic") > MOST_SYNTHETIC, F.struct(F.lit("warning").alias("level"), F.lit("mostly synthetic").alias("finding"), F.lit("indic").alias("tier"))),
            F.when(on > ALWAYS_ON[1], F.struct(F.lit("warning").alias("level"), F.lit("lane too large").alias("finding"), F.lit("always-on").alias("tier"))),
            F.when(on < ALWAYS_ON[0], F.struct(F.lit("warning").alias("level"), F.lit("lane too small").alias("finding"), F.lit("always-on").alias("tier"))),
        )
    )
    return mix.select("tier", F.inline(of_tier)).select("level", "tier", "finding").unionByName(mixture_totals(mix).select(F.inline(of_mix)).select("level", "tier", "finding"))


def milestone_presets(milestones: DataFrame, shape: DataFrame) -> DataFrame:
    """milestones(id, tokens, ladder), shape(tier, share, epochs) -> (id, tier, seen, needed) of the rungs with a size."""
    rungs = milestones.where(F.col("ladder") & F.col("tokens").isNotNull() & (F.col("tokens") > 0)).select("id", "tokens")
    seen = F.col("tokens") * F.col("share")
    return rungs.crossJoin(F.broadcast(shape)).select("id", "tier", seen.alias("seen"), (seen / F.col("epochs")).alias("needed"))  # a few rungs and tiers
