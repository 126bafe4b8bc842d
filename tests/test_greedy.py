"""Greedy survivors over batches and rounds, against the definition; many rows that share a value take no round each."""

import random

import numpy as np
import pytest

from tessera.operators import greedy as gr
from tessera.operators import similarity as sm


def direct(sets: dict[int, set], least: float) -> dict[int, int]:
    stay, out = [], {}
    for i in sorted(sets):
        a = sets[i]
        by = next((j for j in stay if (a == sets[j]) or (a & sets[j] and len(a & sets[j]) / len(a | sets[j]) >= least)), None)
        if by is None:
            stay.append(i)
        else:
            out[i] = by
    return out


def grouped(rng: random.Random, n: int) -> dict[int, set]:
    """A third near copies of one set, the others of several, unlike ones that share a value, copies and empty sets."""
    bases = [set(rng.sample(range(-5000, 5000), rng.choice([7, 40, 90]))) for _ in range(12)]
    sets = {}
    for i in range(n):
        base = bases[0 if i % 3 == 0 else rng.randrange(12)]
        s = set(rng.sample(sorted(base), len(base) - rng.randrange(len(base) // 3)))
        s |= {rng.randrange(1 << 40, 1 << 41) for _ in range(rng.randrange(len(base) // 6 + 1))}
        sets[i * 7 - 50] = s if i % 5 else {77, -(1 << 62) + i} if i % 10 else set() if i % 20 else bases[3]
    return sets


@pytest.mark.parametrize("local", [gr.LOCAL, 0])
def test_greedy_in_batches_is_the_definition(spark, monkeypatch, local):
    monkeypatch.setattr(gr, "LOCAL", local)
    monkeypatch.setattr(gr, "FIRST", 40)
    sets = grouped(random.Random(5), 400 if local else 150)
    rows = spark.createDataFrame([(i, list(s)) for i, s in sets.items()], "ord long, set array<long>").repartition(3)
    got = {r["ord"]: r["by"] for r in gr.greedy_dropped(rows, 0.719).collect()}
    assert got == direct(sets, 0.719)


def test_many_unlike_rows_that_share_a_value_take_few_jobs(spark):
    rows, status = spark.createDataFrame([(i, [0, 10 + i]) for i in range(20)], "ord long, set array<long>"), spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("greedy", "greedy")
    try:
        assert sm.greedy_dropped(rows, 0.4).count() == 0
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(status.getJobIdsForGroup("greedy")) < 60


def test_blocks_keep_their_numbers():
    rng = np.random.default_rng(3)
    for x in (np.zeros(5, np.uint64), np.array([7], np.uint64), rng.integers(0, (1 << 64) - 1, 999, np.uint64), np.array([0, (1 << 64) - 1], np.uint64)):
        assert (gr._numbers(gr._planes(x), len(x)) == x).all()
        assert (gr._sorted_numbers(gr._sorted_planes(np.sort(x))) == np.sort(x)).all()
