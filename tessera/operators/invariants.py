"""Invariants of a mixture and its schedule: each check returns findings (rule, level, subject), none when it holds.

All inputs are plans of a few rows; sums are taken by Spark so that a plan may also come from tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOLERANCE = 1e-9
ERROR, WARNING = "error", "warning"


def _found(rows: DataFrame, rule: str, level: str, subject: Column | str) -> DataFrame:
    name = F.lit(subject) if isinstance(subject, str) else subject.cast("string")
    return rows.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), name.alias("subject"))


def _off(rows: DataFrame, amount: str, by: str | None = None) -> DataFrame:
    """Sums, of each group or of all, that aren't one."""
    sums = rows.groupBy(by).agg(F.sum(amount).alias("__s")) if by else rows.agg(F.sum(amount).alias("__s"))
    return sums.where(F.abs(F.coalesce("__s", F.lit(0.0)) - 1) > TOLERANCE)


def shares_sum(shares: DataFrame) -> DataFrame:
    """shares(lane, share): a partition of one budget, without negative parts."""
    return _found(_off(shares, "share"), "INV-1", ERROR, "sum").unionAll(_found(shares.where("share < 0"), "INV-1", ERROR, F.col("lane")))


def within_supply(verdicts: DataFrame, declared: DataFrame) -> DataFrame:
    """verdicts(lane, verdict), declared(lane): no lane asks for more than repetition can be worth, unless a generation bill
    says so; one that repeats beyond the near-free band is a warning."""
    beyond = verdicts.where("verdict = 'beyond ceiling'").join(declared.select("lane"), "lane", "left_anti")
    strained = verdicts.where(F.col("verdict").isin("exhausted", "diminishing"))
    return _found(beyond, "INV-2", ERROR, F.col("lane")).unionAll(_found(strained, "INV-2", WARNING, F.col("lane")))


def floors_hold(shares: DataFrame, floors: DataFrame, ceiling: float) -> DataFrame:
    """floors(lane, floor): each holds, and together they stay a minority."""
    under = floors.join(shares, "lane", "left").where(F.coalesce("share", F.lit(0.0)) < F.col("floor"))
    return _found(under, "INV-3", ERROR, F.col("lane")).unionAll(_found(floors.agg(F.sum("floor").alias("s")).where(F.col("s") > ceiling), "INV-3", ERROR, "ceiling"))


def lanes_measured(shares: DataFrame, lane_benchmarks: DataFrame) -> DataFrame:
    """Every lane with a share names a benchmark that it buys."""
    return _found(shares.where("share > 0").join(lane_benchmarks.select("lane"), "lane", "left_anti"), "INV-4", ERROR, F.col("lane"))


def benchmarks_funded(orphans: DataFrame) -> DataFrame:
    return _found(orphans, "INV-4b", ERROR, F.col("benchmark"))


def synthetic_capped(tiers: DataFrame, made: tuple[str, ...] = ("C", "D"), cap: float = 0.50) -> DataFrame:
    """tiers(tier, share): translated and synthetic text together stay under the cap."""
    return _found(tiers.where(F.col("tier").isin(*made)).agg(F.sum("share").alias("s")).where(F.col("s") > cap), "INV-5", WARNING, "synthetic")


def schedule_formed(stages: DataFrame, stage_shares: DataFrame) -> DataFrame:
    """stages(stage, duration), stage_shares(stage, lane, share): durations sum to one, and so do each stage's shares."""
    return _found(_off(stages, "duration"), "INV-6a", ERROR, "durations").unionAll(_found(_off(stage_shares, "share", "stage"), "INV-6a", ERROR, F.col("stage")))


def stages_integrate(deviations: DataFrame, tolerance: float) -> DataFrame:
    """deviations(lane, gap): the stages together are the headline mixture."""
    return _found(deviations.where(F.abs("gap") > tolerance), "INV-6b", ERROR, F.col("lane"))


def reserve_covers(reserve: DataFrame) -> DataFrame:
    return _found(reserve.where("not covers"), "INV-7", ERROR, "reserve")


def supply_traceable(shares: DataFrame, supply: DataFrame) -> DataFrame:
    """supply(lane, n, tokens): a lane with a share has datasets behind it, and tokens in them."""
    joined = shares.where("share > 0").join(supply, "lane", "left")
    return _found(joined.where("coalesce(n, 0) = 0 or coalesce(tokens, 0) <= 0"), "INV-8", ERROR, F.col("lane"))


def tiers_sum(tiers: DataFrame) -> DataFrame:
    return _found(_off(tiers, "share"), "INV-9", ERROR, "tiers")


def bands_differ(bands: DataFrame) -> DataFrame:
    """bands(ord, share, tokens): shares sum to one, lengths strictly grow."""
    shorter = bands.withColumn("__before", F.lag("tokens").over(Window.orderBy("ord"))).where("tokens <= __before")
    return _found(_off(bands, "share"), "INV-10", ERROR, "shares").unionAll(_found(shorter.limit(1), "INV-10", ERROR, "lengths"))


def falsifiable(hypotheses: DataFrame) -> DataFrame:
    """hypotheses(hypothesis, threshold, refuted_if, lane): each could fail, and says how and where."""
    bad = [F.col("threshold") <= 0, F.trim(F.coalesce("refuted_if", F.lit(""))) == "", F.coalesce("lane", F.lit("")) == ""]
    return reduce(DataFrame.unionAll, [_found(hypotheses.where(b), "INV-11", ERROR, F.col("hypothesis")) for b in bad])


def ladder_partitions(band_shares: DataFrame, mixes: DataFrame) -> DataFrame:
    """mixes(stage, band, share) of each stage sum to one, and the bands' shares of the run do."""
    return _found(_off(mixes, "share", "stage"), "INV-12", ERROR, F.col("stage")).unionAll(_found(_off(band_shares, "share"), "INV-12", ERROR, "bands"))


def languages_spendable(plan: DataFrame, gate: float = 0.05) -> DataFrame:
    """plan(lang, share, unknown, blocked): no share for a language that the tokenizer can't read, and a sum of one."""
    held = plan.where("share > 0")
    out = _found(held.where(F.col("unknown") > gate), "INV-13", ERROR, F.col("lang")).unionAll(_found(held.where("blocked"), "INV-13", ERROR, F.col("lang")))
    return out.unionAll(_found(_off(plan, "share"), "INV-13", ERROR, "languages"))


def lengths_double(schedule: DataFrame) -> DataFrame:
    """sequence_schedule(): a context length holds or doubles, and never shrinks or skips a rung."""
    return _found(schedule.where("multiple is not null and multiple not in (1.0, 2.0)"), "INV-14", ERROR, F.col("ord"))


def all_findings(*checks: DataFrame) -> DataFrame:
    """Findings of all checks, errors first."""
    return reduce(DataFrame.unionAll, checks).orderBy(F.col("level") != ERROR, "rule", "subject")
