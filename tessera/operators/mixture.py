"""Mixture, supply and experiment arithmetic over small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Repetition constants and the epochs at which a verdict changes.
R_STAR, CEILING = 15.4, 16.4


def worth_tokens(unique: Column, epochs: Column) -> Column:
    """What unique tokens repeated for some epochs are worth: U (1 + R (1 - exp(-(e - 1) / R)))."""
    return unique * (1 + R_STAR * (1 - F.exp(-(F.greatest(epochs, F.lit(1.0)) - 1) / R_STAR)))


def supply_verdict(demand: Column, supply: Column) -> Column:
    epochs = demand / supply
    return F.when(supply.isNull() | (supply <= 0), "unmeasured").when(demand > supply * CEILING, "beyond ceiling").when(epochs > 16, "exhausted").when(epochs > 4, "diminishing").when(epochs > 1, "repeated").when(epochs > 0.5, "sufficient").otherwise("ample")


def shares(rows: DataFrame, key: str, amount: str) -> DataFrame:
    """(key, amount, share): sums and their part of the whole."""
    sums = rows.groupBy(key).agg(F.sum(amount).alias(amount))
    total = sums.agg(F.sum(amount).alias("__total"))
    return sums.crossJoin(F.broadcast(total)).select(key, amount, (F.col(amount) / F.col("__total")).alias("share"))


def renormalised(shares_rows: DataFrame, available: DataFrame, key: str) -> DataFrame:
    """The shares of available keys, summing to one again."""
    kept = shares_rows.join(available.select(key).distinct(), key, "left_semi")
    total = kept.agg(F.sum("share").alias("__total"))
    return kept.crossJoin(F.broadcast(total)).select(key, (F.col("share") / F.col("__total")).alias("share"))


def deviation(plan: DataFrame, real: DataFrame, key: str) -> DataFrame:
    """(key, planned, realised, gap) of either table's keys."""
    joined = plan.select(key, F.col("share").alias("planned")).join(real.select(key, F.col("share").alias("realised")), key, "full_outer").fillna(0.0, ["planned", "realised"])
    return joined.withColumn("gap", F.col("realised") - F.col("planned"))


def seams(stages: DataFrame) -> DataFrame:
    """stages(ord, lane, share) -> (ord, lane, shift): the largest change of a share against the stage before."""
    lanes = Window.partitionBy("lane").orderBy("ord")
    shifted = stages.withColumn("shift", F.col("share") - F.lag("share").over(lanes)).where("shift is not null")
    return shifted.groupBy("ord").agg(F.max_by("lane", F.struct(F.abs("shift"), "lane")).alias("lane"), F.max_by("shift", F.struct(F.abs("shift"), "lane")).alias("shift"))


def seed_statistics(scores: DataFrame, base: str) -> DataFrame:
    """scores(arm, seed, score) -> (arm, n, mean, spread, effect): effect against the base arm's mean."""
    stats = scores.groupBy("arm").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("spread"))
    of_base = stats.where(F.col("arm") == base).select(F.col("mean").alias("__base"))
    return stats.crossJoin(F.broadcast(of_base)).withColumn("effect", F.col("mean") / F.col("__base") - 1).drop("__base")


def stratified_sample(rows: DataFrame, key: str, fractions: dict[str, float], order: str = "doc_id", seed: int = 0) -> DataFrame:
    """Rows whose hash falls below their stratum's fraction: the same rows in any partitioning, without a shuffle."""
    u = uniform(F.lit(seed), F.col(order))
    limit = F.lit(0.0)
    for k, f in fractions.items():
        limit = F.when(F.col(key) == k, F.lit(f)).otherwise(limit)
    return rows.where(u < limit)


def lane_supply(inventory: DataFrame, headlines: DataFrame, least: float = 0.02) -> DataFrame:
    """inventory(lane, tokens), headlines(lane, headline) -> (lane, tokens, n, n_unknown, headline, residual, disagrees):
    null tokens are counted, not read as zero."""
    sums = inventory.groupBy("lane").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"), F.count_if(F.col("tokens").isNull()).alias("n_unknown"))
    joined = sums.join(headlines, "lane", "left").withColumn("residual", F.col("headline") - F.col("tokens"))
    return joined.withColumn("disagrees", F.coalesce(F.abs("residual") > least * F.col("headline"), F.lit(False)))


def realised_mixture(stages: DataFrame) -> DataFrame:
    """stages(ord, duration, lane, share) -> (lane, share): shares weighted by the stages' durations."""
    total = stages.select("ord", "duration").distinct().agg(F.sum("duration").alias("__total"))
    return stages.crossJoin(F.broadcast(total)).groupBy("lane").agg(F.sum(F.col("share") * F.col("duration") / F.col("__total")).alias("share"))


def sequence_schedule(stages: DataFrame) -> DataFrame:
    """stages(ord, tokens, sequence_length) -> with start and end of each one's interval of tokens, its length as a
    multiple of the rung before, and whether that is one or two. One row a stage."""
    w = Window.orderBy("ord")
    end = F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = stages.select("*", (end - F.col("tokens")).alias("start"), end.alias("end"), (F.col("sequence_length") / F.lag("sequence_length").over(w)).alias("multiple"))
    return out.withColumn("ok", F.coalesce(F.col("multiple").isin(1.0, 2.0), F.lit(True)))


def seam_blend(before: DataFrame, after: DataFrame, at: float) -> DataFrame:
    """(lane, share): linear blend of two mixtures, at = 0 the first and 1 the second; a missing lane has no share."""
    joined = before.select("lane", F.col("share").alias("a")).join(after.select("lane", F.col("share").alias("b")), "lane", "full_outer")
    return joined.fillna(0.0, ["a", "b"]).select("lane", (F.col("a") * (1 - at) + F.col("b") * at).alias("share"))


def with_frozen(arm: DataFrame, frozen: tuple[str, ...]) -> DataFrame:
    """(lane, share): frozen lanes keep their shares, the others are scaled to fill what is left."""
    held = F.col("lane").isin(*frozen)
    sums = arm.agg(F.sum(F.when(held, F.col("share")).otherwise(0.0)).alias("__held"), F.sum(F.when(held, 0.0).otherwise(F.col("share"))).alias("__free"))
    scaled = F.col("share") * (1 - F.col("__held")) / F.nullif("__free", F.lit(0.0))
    return arm.crossJoin(F.broadcast(sums)).select("lane", F.when(held, F.col("share")).otherwise(scaled).alias("share"))


def weighted_score(values: DataFrame, weights: DataFrame) -> DataFrame:
    """values(run, lane, score), weights(lane, weight) -> (run, score): the mean over a run's lanes, weights renormalised."""
    joined = values.join(weights, "lane").where("score is not null")
    return joined.groupBy("run").agg((F.sum(F.col("score") * F.col("weight")) / F.nullif(F.sum("weight"), F.lit(0.0))).alias("score"))


def repetition_reading(points: DataFrame, noise: float) -> DataFrame:
    """points(epochs, score), lower scores better -> (epochs, score, excess, beyond_noise, inverted): loss over the least
    repeated point in percent, and whether the next point, repeated more, scores better. One row a point."""
    w = Window.orderBy("epochs")
    base = F.first("score").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = points.select("epochs", "score", (100 * (F.col("score") / base - 1)).alias("excess"), (F.col("score") - base > noise).alias("beyond_noise"), (F.lead("score").over(w) < F.col("score")).alias("inverted"))
    return out.fillna(False, ["inverted"])


def seam_peak(losses: DataFrame, seam: int, reach: int = 40) -> DataFrame:
    """losses(step, loss) -> one row: the greatest loss within reach after a seam over the median within reach before."""
    before = F.when(F.col("step").between(seam - reach, seam - 1), F.col("loss"))
    after = F.when(F.col("step").between(seam, seam + reach), F.col("loss"))
    near = losses.where(F.col("step").between(seam - reach, seam + reach))
    return near.agg((F.max(after) / F.nullif(F.median(before), F.lit(0.0))).alias("ratio"))


def rank_inversions(scores: DataFrame) -> DataFrame:
    """scores(scale, arm, score), lower better -> pairs of arms whose order at the smallest scale is reversed at a larger
    one: (small, large, better, worse). Arms and scales are a handful."""
    least = scores.agg(F.min("scale").alias("small"))
    base = scores.join(F.broadcast(least), scores["scale"] == least["small"]).select("small", F.col("arm"), F.col("score").alias("s0"))
    joined = scores.join(base, "arm").where("scale > small").select(F.col("scale").alias("large"), "small", "arm", "score", "s0")
    a, b = joined.alias("a"), joined.alias("b")
    worse = a.join(b, (F.col("a.large") == F.col("b.large")) & (F.col("a.s0") < F.col("b.s0")) & (F.col("a.score") > F.col("b.score")))
    return worse.select(F.col("a.small").alias("small"), F.col("a.large").alias("large"), F.col("a.arm").alias("better"), F.col("b.arm").alias("worse"))


def effective_shares(arm: DataFrame, available: DataFrame) -> DataFrame:
    """(lane, share, dropped): an arm's shares over the lanes that there is a corpus for; a lane without one keeps no share
    and is named. With no lane left, all shares are null."""
    has = available.select(F.col("lane")).distinct().withColumn("__has", F.lit(True))
    rows = arm.where("share > 0").join(has, "lane", "left").withColumn("__kept", F.when(F.col("__has"), F.col("share")).otherwise(0.0))
    total = rows.agg(F.nullif(F.sum("__kept"), F.lit(0.0)).alias("__total"))
    return rows.crossJoin(F.broadcast(total)).select("lane", (F.col("__kept") / F.col("__total")).alias("share"), F.col("__has").isNull().alias("dropped"))


def uniform(*parts: Column | str) -> Column:
    """A number of [0, 1) from the MD5 of parts joined by colons: the same on every engine and in any partitioning."""
    digits = F.left(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])), F.lit(13))
    return F.conv(digits, 16, 10).cast("double") / float(1 << 52)


def mixture_draws(lanes: DataFrame, n: int, context: int, seed: int = 0, unique_fraction: float = 1.0, first: int = 0) -> DataFrame:
    """lanes(lane, share, tokens) -> (draw, lane, start): draws first to first + n - 1 of a mixture, each a window of
    context + 1 tokens at a random place of a lane drawn by share. unique_fraction keeps the beginning of each lane. A draw
    depends on its number and the seed alone, so a run resumes at any draw, and lanes may be reweighed between draws
    without disturbing places. A lane too short for one window raises. Lanes are a handful, ordered by name."""
    size = F.greatest(F.lit(context + 1), F.floor(F.col("tokens") * unique_fraction)) if unique_fraction < 1 else F.col("tokens")
    w = Window.orderBy("lane")
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = F.sum("share").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("share").over(every)
    placed = lanes.select("lane", "tokens", size.alias("size"), upto.alias("upto"), F.row_number().over(w).alias("i"), F.count("*").over(every).alias("k"))
    placed = placed.withColumn("size", F.when(F.col("tokens") < context + 1, F.raise_error(F.concat(F.lit("lane too short for a window: "), F.col("lane")))).otherwise(F.col("size")))
    before = F.coalesce(F.lag("upto").over(w), F.lit(0.0))
    placed = placed.select("lane", "size", before.alias("low"), F.when(F.col("i") == F.col("k"), F.lit(1.0)).otherwise(F.col("upto")).alias("high"))
    draws = lanes.sparkSession.range(first, first + n).select(F.col("id").alias("draw"), uniform(F.lit(seed), F.col("id"), F.lit("lane")).alias("u"), uniform(F.lit(seed), F.col("id"), F.lit("place")).alias("v"))
    hit = draws.join(F.broadcast(placed), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return hit.select("draw", "lane", F.floor(F.col("v") * F.greatest(F.col("size") - context - 1, F.lit(1))).cast("long").alias("start"))


def tail_split(docs: DataFrame, share: float = 0.10, text_col: str = "text") -> DataFrame:
    """docs with train and held_out: the last part of each text, cut at a character, is held out."""
    at = F.floor(F.length(text_col) * (1 - share)).cast("int")
    return docs.select("*", F.left(F.col(text_col), at).alias("train"), F.substr(F.col(text_col), at + 1, F.length(text_col)).alias("held_out"))


def double_counted(rows: DataFrame) -> DataFrame:
    """rows(lane, tokens, packed) -> (lane, factor): the part of a lane that isn't another lane's text packed anew."""
    total = F.sum(F.coalesce("tokens", F.lit(0.0)))
    packed = F.sum(F.when(F.col("packed"), F.coalesce("tokens", F.lit(0.0))).otherwise(0.0))
    return rows.groupBy("lane").agg(F.coalesce((total - packed) / F.nullif(total, F.lit(0.0)), F.lit(1.0)).alias("factor"))


def supervised_ratio(rows: DataFrame, supervised: tuple[float, ...] = (200.0, 500.0)) -> DataFrame:
    """rows(lane, tokens, samples) -> (lane, low, high): what part of a trajectory's tokens carries loss when a few hundred
    do; rows without both figures say nothing."""
    each = rows.where("tokens > 0 and samples > 0").select("lane", F.explode(F.array(*map(F.lit, supervised))).alias("s"), (F.col("tokens") / F.col("samples")).alias("per"))
    return each.groupBy("lane").agg(F.min(F.col("s") / F.col("per")).alias("low"), F.max(F.col("s") / F.col("per")).alias("high"))


def tier_sizing(tiers: DataFrame, rows: DataFrame, demand: float, residual: float) -> DataFrame:
    """tiers(tier, share), rows(tier, tokens) -> (tier, demand, supply, epochs, must_generate). The residual, a total that
    isn't split further, belongs to tiers with a row of unknown size. Generated must be what repetition can't reach."""
    sums = rows.groupBy("tier").agg(F.sum(F.coalesce("tokens", F.lit(0.0))).alias("s"), F.max(F.when(F.col("tokens").isNull(), F.lit(residual)).otherwise(0.0)).alias("r"))
    out = tiers.join(sums, "tier", "left").select("tier", (F.col("share") * demand).alias("demand"), (F.coalesce("s", F.lit(0.0)) + F.coalesce("r", F.lit(0.0))).alias("supply"))
    return out.select("*", (F.col("demand") / F.nullif("supply", F.lit(0.0))).alias("epochs"), F.greatest(F.lit(0.0), F.col("demand") - F.col("supply") * CEILING).alias("must_generate"))


def floor_headroom(shares_rows: DataFrame, floors: DataFrame) -> DataFrame:
    """(lane, floor, headroom): what of a protected lane's share a selector may still move."""
    return floors.join(shares_rows, "lane", "left").select("lane", "floor", (F.coalesce("share", F.lit(0.0)) - F.col("floor")).alias("headroom"))


def anneal_reserve(pools: DataFrame, run_tokens: float, target: float, tolerance: float = 0.10) -> DataFrame:
    """pools(lane, tokens, fraction) -> one row: tokens held back, their share of the run, and whether that covers the last
    stage within a tolerance."""
    held = pools.agg(F.sum(F.col("tokens") * F.col("fraction")).alias("held"))
    return held.select("held", (F.col("held") / run_tokens).alias("share"), (F.col("held") / run_tokens >= target * (1 - tolerance)).alias("covers"))


def generation_bill(lanes: DataFrame) -> DataFrame:
    """lanes(lane, demand, supply) -> (lane, tokens) that no repetition of the supply reaches."""
    missing = F.col("demand") - F.coalesce("supply", F.lit(0.0)) * CEILING
    return lanes.where(missing > 0).select("lane", missing.alias("tokens"))


def by_lane(benchmarks: DataFrame) -> DataFrame:
    """benchmarks(benchmark, lanes array, stage) -> (lane, n, benchmarks) that each lane pays for."""
    each = benchmarks.select("benchmark", F.explode("lanes").alias("lane"))
    return each.groupBy("lane").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("benchmark")), ",").alias("benchmarks"))


def by_stage(benchmarks: DataFrame, stages: DataFrame) -> DataFrame:
    """stages(stage) with the benchmarks taught there; a stage without any stays."""
    n = benchmarks.groupBy("stage").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("benchmark")), ",").alias("benchmarks"))
    return stages.join(n, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("benchmarks", F.lit("")).alias("benchmarks"))


def unfunded(benchmarks: DataFrame, lanes: DataFrame) -> DataFrame:
    """benchmarks none of whose lanes(lane, share, schedule_only) is paid for or a mere schedule."""
    funded = lanes.where("share > 0 or schedule_only").select("lane")
    paid = benchmarks.select("benchmark", F.explode("lanes").alias("lane")).join(funded, "lane", "left_semi")
    return benchmarks.join(paid, "benchmark", "left_anti").select("benchmark")


def band_tokens(bands: DataFrame, lane_share: float, run_tokens: float) -> DataFrame:
    """bands(band, share) -> with the tokens of the run that fall to each."""
    return bands.select("band", "share", (F.col("share") * lane_share * run_tokens).alias("tokens"))


def band_shares(stages: DataFrame, mixes: DataFrame) -> DataFrame:
    """stages(stage, duration), mixes(stage, band, share) -> (band, share) of the whole run."""
    return mixes.join(stages, "stage").groupBy("band").agg(F.sum(F.col("share") * F.col("duration")).alias("share"))


def cost_ladder(rungs: DataFrame, hardware: DataFrame) -> DataFrame:
    """rungs(rung, params, tokens, arms), hardware(machine, tflops, usd_per_hour) -> a row for each pair: flops, and hours
    and usd where they are known; an unknown rate prices nothing."""
    flops = 6.0 * F.col("params") * F.col("tokens") * F.col("arms")
    hours = flops / (F.nullif("tflops", F.lit(0.0)) * 1e12) / 3600
    return rungs.crossJoin(F.broadcast(hardware)).select("rung", "machine", flops.alias("flops"), hours.alias("hours"), (hours * F.col("usd_per_hour")).alias("usd"))  # short lists


def tokens_for_hours(tflops: Column, hours: Column, params: Column) -> Column:
    """Tokens that so many hours of a machine train; null where its rate isn't known."""
    return F.nullif(tflops, F.lit(0.0)) * 1e12 * hours * 3600 / (6.0 * params)


def bits_per_byte(nll_nats: Column, n_bytes: Column) -> Column:
    """Loss over the bytes of a text, which doesn't depend on how it was cut into tokens."""
    return nll_nats / F.log(F.lit(2.0)) / F.nullif(n_bytes, F.lit(0))


def hypothesis_verdicts(scores: DataFrame, plan: DataFrame, base: str = "A") -> DataFrame:
    """scores(arm, lane, seed, score), lower better; plan(hypothesis, arm, lane, threshold, other_gain) -> (hypothesis,
    effect, noise, verdict, best_lane, gain).

    An effect inside the seeds' own spread is inconclusive, whatever its size; past the threshold it supports, else it
    refutes. A second clause (other_gain) is met when another lane gains more: that refutes, or only qualifies when the gain
    is inside its own spread. Tables of a few rows."""
    stats = scores.groupBy("arm", "lane").agg(F.avg("score").alias("mean"), (F.max("score") - F.min("score")).alias("spread"))
    of = stats.where(F.col("arm") == base).select("lane", F.col("mean").alias("m0"), F.col("spread").alias("s0"))
    pairs = stats.where(F.col("arm") != base).join(of, "lane").select("arm", "lane", (F.col("mean") / F.col("m0") - 1).alias("effect"), (F.greatest("spread", "s0") / F.col("m0")).alias("noise"))
    own = plan.join(pairs, ["arm", "lane"])
    others = plan.where("other_gain is not null").select("hypothesis", "arm", F.col("lane").alias("own")).join(pairs, "arm").where("lane != own")
    best = others.groupBy("hypothesis").agg(F.max(F.struct((-F.col("effect")).alias("gain"), F.col("lane").alias("best_lane"), F.col("noise").alias("gain_noise"))).alias("b"))
    rows = own.join(best, "hypothesis", "left").select("*", "b.gain", "b.best_lane", "b.gain_noise")
    first = F.when(F.abs("effect") <= F.col("noise"), "inconclusive").when(F.col("effect") >= F.col("threshold"), "supported").otherwise("refuted")
    met = (first == "supported") & F.coalesce(F.col("gain") > F.col("other_gain"), F.lit(False))
    verdict = F.when(met & (F.col("gain") > F.col("gain_noise")), "refuted").when(met, "qualified").otherwise(first)
    return rows.select("hypothesis", "effect", "noise", verdict.alias("verdict"), "best_lane", "gain")
