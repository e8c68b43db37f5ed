"""Blocks against the max-min mean formula."""

import random

import pytest

from formline.operators.isotonic import isotonic_blocks
from formline.plans import models as M


def plain(rows):
    """Fit at every score: max over starts at or below it of the min over ends at or above it of the mean between."""
    sums = {}
    for x, y in rows:
        s, w = sums.get(x, (0, 0))
        sums[x] = (s + y, w + 1)
    xs = sorted(sums)

    def mean(a, b):
        return sum(sums[x][0] for x in xs[a:b + 1]) / sum(sums[x][1] for x in xs[a:b + 1])

    return {x: max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("pieces,n,steps", [(1, 60, 20), (3, 80, 40), (20, 80, 60), (40, 50, 10**9)])
def test_blocks_equal_the_formula(spark, pieces, n, steps):
    rng = random.Random(n + pieces)
    rows = []
    for _ in range(n):
        x = rng.randrange(steps) / steps
        rows.append((x, int(rng.random() < 0.3 + x / 2)))
    got = isotonic_blocks(spark.createDataFrame(rows, "x double, y int"), "x", "y", pieces).orderBy("low").collect()
    want = plain(rows)
    assert [b["mean"] for b in got] == sorted({b["mean"] for b in got}) and sum(b["weight"] for b in got) == n
    for x, g in want.items():
        mine = [b["mean"] for b in got if b["low"] <= x <= b["high"]]
        assert mine == [pytest.approx(g)]


def test_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([(None, 1), (0.5, None), (float("nan"), 1), (0.25, 1), (0.75, 0)], "x double, y int")
    assert [tuple(r) for r in isotonic_blocks(df, "x", "y").collect()] == [(0.25, 0.75, 0.5, 2)]
    assert isotonic_blocks(df.limit(0), "x", "y").count() == 0


def test_close_scores_stay_apart(spark):
    """Scores nearer than any grid step keep their own fit."""
    df = spark.createDataFrame([(0.5, 0), (0.5 + 1e-9, 1), (0.5 + 2e-9, 1)], "x double, y int")
    out = {r["x"]: r["c"] for r in M.isotonic_calibrate(df, "x", "y").apply(df, "x", "c").collect()}
    assert out == {0.5: 0.01, 0.5 + 1e-9: 0.99, 0.5 + 2e-9: 0.99}
