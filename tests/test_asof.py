"""As-of join next to a walk over all measurements, across slices, with ties, holes and NULL keys."""

import random
from datetime import datetime, timedelta

import pytest

from pulsegrid.operators.asof import asof_join

START = datetime(2024, 3, 1)


def brute(left, right, tolerance):
    out = []
    for row, key, ts in left:
        seen = [(at, tie, v) for k, at, tie, v in right if k == key and ts is not None and at is not None and at <= ts]
        at, _, v = max(seen, key=lambda m: (m[0], m[1]), default=(None, None, None))
        if at is not None and tolerance is not None and ts - at > timedelta(seconds=tolerance):
            at, v = None, None
        out.append((row, key, ts, at, v))
    return sorted(out)


@pytest.mark.parametrize(("tolerance", "seconds"), [(None, 3600), (90, 60), (5, 7), (4000, 600)])
def test_asof_join_against_a_walk(spark, tolerance, seconds):
    rng = random.Random(tolerance or 1)
    key = lambda: rng.choice(["a", "a", "a", "b", None, "never"])
    left = [(k, key(), None if rng.random() < 0.05 else START + timedelta(seconds=rng.randrange(9000))) for k in range(400)]
    right = [(rng.choice(["a", "a", "b", None]), None if rng.random() < 0.05 else START + timedelta(seconds=rng.choice([rng.randrange(9000), 300, 301])),
              k, None if rng.random() < 0.1 else float(k)) for k in range(300)]
    got = asof_join(spark.createDataFrame(left, "row long, key string, ts timestamp"),
                    spark.createDataFrame(right, "key string, at timestamp, tie long, v double"), ["key"], right_ts="at", values=["v"],
                    tie=["tie"], tolerance=tolerance, seconds=seconds, matched="seen_at")
    assert got.columns == ["row", "key", "ts", "seen_at", "v"]
    assert sorted(map(tuple, got.collect())) == brute(left, right, tolerance)


def test_no_measurements(spark):
    left = spark.createDataFrame([(1, START)], "key long, ts timestamp")
    right = left.where("1 = 0").selectExpr("key", "ts", "key AS v")
    assert [tuple(r) for r in asof_join(left, right, ["key"], values=["v"]).collect()] == [(1, START, None)]
    assert asof_join(left.where("1 = 0"), left.selectExpr("key", "ts", "key AS v"), ["key"], values=["v"]).count() == 0
