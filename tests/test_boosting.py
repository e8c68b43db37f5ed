"""Models side by side against MLlib's trees, and what the queries ask of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from bindings.base import QUERIES, STATS
from bindings import plans
from formline.plans import boosting as B
from formline.plans import models as M

SF = "/root/testdata/sf0.001"
FEATURES = ["a", "b", "c", "d"]


def table(spark, n=1200):
    """Few distinct values, so bins are exact; c is missing at times, d always."""
    df = spark.range(n).selectExpr(
        "id", "double(hash(id, 1) % 11) a", "double(hash(id, 2) % 7) b", "if(hash(id, 3) % 5 = 0, null, double(hash(id, 4) % 9)) c",
        "cast(null as double) d", "abs(hash(id, 5) % 4) block", "abs(hash(id, 6) % 30) who", "hash(id, 9) % 9 e")
    return df.withColumn("y", F.expr("int(a + b + coalesce(c, 0) + e > 0)")).drop("e")


def held_bins(x):
    found = [B.cut(*np.unique(c, return_counts=True), 0) for c in x.T]
    return B.Bins([m for m, _ in found], [c for _, c in found])


def held(bins, x, y, most=1 << 40, size=B.PIECE):
    out, b = B.Pieces(most), bins.bins(x)
    for i in range(0, len(b), size):
        part = np.ascontiguousarray(b[i:i + size].T)
        out.add([part, bins.codes(part), y[i:i + size]])
    return out


def numbers(n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[:, 3] = x[:, 3] > 1.9
    return x, (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=n) > 0).astype(np.uint8)


def same(a, b):
    return len(a) == len(b) and all((s.feature == u.feature).all() and (s.limit == u.limit).all() and (s.value == u.value).all() for s, u in zip(a, b))


@pytest.mark.parametrize("depth, leaf", [(4, 25), (1, 3)])
def test_models_equal_those_of_mllib(spark, depth, leaf):
    """Leaves are large, so that no two splits are as good as each other."""
    df, p = table(spark), M.TreeParams(max_iter=10, max_depth=depth, step=0.1, subsample=1.0, columns=1.0, leaf=leaf)
    flags = {"__type": F.lit("t"), "__train": F.expr("if(block < 3, 4L, 0L)"), "__out": F.expr("if(block = 3, 4L, 0L)")}
    got = B.out_of_fold(M.with_doubles(df.withColumns(flags), FEATURES), FEATURES, "y", [("t", 3)], 3, p).collect()
    want = M.fit_trees(df.filter("block < 3"), FEATURES, "y", p).score(df.filter("block = 3"), "p").collect()
    assert {(r["__type"], r["fold"]) for r in got} == {("t", 3)} and len({r["p"] for r in want}) > 1
    mine, theirs = (np.array(sorted((r[y], r["p"]) for r in rows)) for y, rows in (("label", got), ("y", want)))
    assert mine == pytest.approx(theirs, abs=1e-5)


def test_types_side_by_side_equal_types_alone(spark):
    p = M.TreeParams(max_iter=4, max_depth=3, step=0.3, subsample=1.0)
    df = table(spark).withColumn("prop", F.expr("if(id % 3 = 0, 'A', 'B')"))
    who = df.select("prop", "who").distinct().withColumn("fold", F.expr("who % 2 + 1"))
    for got, one in (
        (M.time_cv(df, FEATURES, "y", 3, p, prop="prop", types=["A", "B"]), lambda t: M.time_cv(t, FEATURES, "y", 3, p, prop="prop")),
        (M.player_holdout_cv(df, who, "who", FEATURES, "y", 2, p, prop="prop"),
         lambda t: M.player_holdout_cv(t, who, "who", FEATURES, "y", 2, p, prop="prop")),
    ):
        got = {r["prop"]: r for r in got.collect()}
        assert set(got) == {"A", "B"}
        for t, r in got.items():
            assert tuple(one(df.filter(F.col("prop") == t)).first()) == pytest.approx(tuple(r), abs=1e-9)
    with pytest.raises(ValueError, match="C"):
        M.time_cv(df, FEATURES, "y", 3, p, prop="prop", types=["A", "C"])


def test_folds_by_mllib_one_at_a_time(spark):
    """Means over folds whose models and rows are picked one by one."""
    from formline.operators import evaluate as E

    df, p = table(spark), M.TreeParams(max_iter=4, max_depth=3, step=0.3, subsample=1.0, columns=1.0, leaf=25)
    who = df.select("who").distinct().withColumn("fold", F.expr("who % 2 + 1"))
    parts = {"time": [(df.filter(F.col("block") < f), df.filter(F.col("block") == f)) for f in (1, 2, 3)],
             "players": [(df.filter(F.expr(f"who % 2 + 1 <> {f}")), df.filter(F.expr(f"who % 2 + 1 = {f}"))) for f in (1, 2)]}
    got = {"time": M.time_cv(df, FEATURES, "y", 3, p).first(), "players": M.player_holdout_cv(df, who, "who", FEATURES, "y", 2, p).first()}
    for how, folds in parts.items():
        rows = [E.binary_metrics(M.fit_trees(seen, FEATURES, "y", p).score(new, "p"), "y", "p").first() for seen, new in folds]
        assert got[how]["folds"] == len(rows)
        for m in M.CV_METRICS:
            assert got[how][m] == pytest.approx(np.mean([r[m] for r in rows]), abs=1e-5)
            assert got[how][f"{m}_std"] == pytest.approx(np.std([r[m] for r in rows]), abs=1e-5)


def test_labels_that_are_not_known_raise(spark):
    df = table(spark, 200).withColumn("y", F.when(F.col("id") != 5, F.col("y")))
    with pytest.raises(Exception, match="labels must be 0 or 1"):
        M.time_cv(df.withColumn("block", F.expr("if(id = 5, 0, block)")), FEATURES, "y", 3, M.TreeParams(max_iter=1, max_depth=1))


def test_rows_of_one_piece_or_many_in_memory_or_in_a_file_give_the_same_trees():
    x, y = numbers()
    bins, p = held_bins(x), M.TreeParams(max_iter=6, max_depth=4, subsample=1.0)
    want = B.boost(held(bins, x, y), bins, [1], p)
    for size in (100, 7):  # small pieces have no rows in some nodes
        assert same(want, B.boost(held(bins, x, y, size=size), bins, [1], p))
    half = M.TreeParams(max_iter=6, max_depth=4)
    memory, file = held(bins, x, y, size=500), held(bins, x, y, most=20_000, size=500)
    assert memory.file is None and file.file is not None
    trees = B.boost(memory, bins, [1], half)
    assert same(trees, B.boost(file, bins, [1], half)) and not same(trees, want)


def one_tree(bins, target, depth, leaf):
    """Mean target of each row's leaf, node by node."""
    best, out = (0.0, None), np.full(len(target), target.mean())
    for f in range(bins.shape[1]) if depth else ():
        for limit in range(B.BINS):
            low = bins[:, f] <= limit
            if min(low.sum(), (~low).sum()) >= leaf:
                gain = sum(target[s].sum() ** 2 / s.sum() for s in (low, ~low)) - target.sum() ** 2 / len(target)
                if gain > best[0] + 1e-9:
                    best = gain, low
    if best[1] is not None:
        for side in (best[1], ~best[1]):
            out[side] = one_tree(bins[side], target[side], depth - 1, leaf)
    return out


@pytest.mark.parametrize("depth, leaf, size", [(9, 3, 300), (4, 20, 1 << 16), (0, 1, 500)])
def test_trees_equal_plain_python(depth, leaf, size):
    x, y = numbers(1500)
    bins = held_bins(x)
    b = bins.bins(x)
    trees = B.boost(held(bins, x, y, size=size), bins, [1], M.TreeParams(max_iter=2, max_depth=depth, step=0.1, subsample=1.0, columns=1.0, leaf=leaf))
    margin = one_tree(b, np.where(y, 1.0, -1.0), depth, leaf)
    line = np.ascontiguousarray(b.T)
    assert trees[0].values(line) == pytest.approx(margin, abs=1e-9)
    target = np.rint((y - 1 / (1 + np.exp(-2 * margin))) * B.UNIT) / B.UNIT
    assert trees[1].values(line) == pytest.approx(0.4 * one_tree(b, target, depth, leaf), abs=1e-4)


def test_draws_of_rows_and_features():
    x, y = numbers()
    label, none = np.zeros(50_000, np.uint8), np.zeros(50_000, np.float32)
    p = M.TreeParams(subsample=0.8)
    drawn = [B._weights(t, i, label, none, [1], p) > 0 for t, i in ((0, 0), (1, 0), (0, 1))]
    assert all(abs(d.mean() - 0.8) < 0.01 for d in drawn) and (drawn[0] != drawn[1]).any() and (drawn[0] != drawn[2]).any()
    bins = held_bins(x)
    roots = {int(t.feature[0]) for t in B.boost(held(bins, x, y), bins, [1], M.TreeParams(max_iter=30, max_depth=2, columns=0.25))}
    assert len(roots) > 2


def test_bins_of_many_rows_stay_near_their_ranks():
    rng = np.random.default_rng(3)
    s, x = B.Summary(), rng.normal(size=400_000)
    folds = np.stack([np.ones(len(x), np.int64), (np.arange(len(x)) < 70_000).astype(np.int64)], 1)
    for i in range(0, len(x), 10_000):
        s.add(x[i:i + 10_000], folds[i:i + 10_000])
    values, weights = s.all()
    assert len(values) <= B.KEPT and (weights.sum(0) == folds.sum(0)).all()
    for k in (0, 1):
        mine = np.sort(x[folds[:, k] == 1])
        middle, cuts = B.cut(values, weights[:, k], 0)
        assert len(cuts) == B.BINS - 1
        assert np.abs(np.searchsorted(mine, cuts) / len(mine) - np.arange(1, B.BINS) / B.BINS).max() < 0.006
        assert abs(np.searchsorted(mine, middle) / len(mine) - 0.5) < 0.006
    few = B.Summary()
    for _ in range(5):
        few.add(np.array([3.0, 1.0, 1.0]), np.array([[1], [1], [0]]))
    values, weights = few.all()
    assert values.tolist() == [1.0, 3.0] and weights.tolist() == [[5], [5]]
    assert B.cut(values, weights[:, 0], 4)[1].tolist() == [2.0]


@pytest.mark.parametrize("name", ["player_holdout_cv", "time_cv"])
def test_queries_fit_all_rounds_of_all_models(spark, monkeypatch, name):
    asked, fit = [], M.out_of_fold

    def spy(rows, features, label, models, folds, p):
        asked.append((features, sorted(models), p))
        return fit(rows, features, label, models, folds, M.TreeParams(max_iter=2, max_depth=2))

    monkeypatch.setattr(M, "out_of_fold", spy)
    got = QUERIES[name](spark, SF).collect()
    (features, models, p), = asked
    assert models == sorted((t, f) for t in STATS for f in range(1, plans.FOLDS + 1)) and features == plans.FEATURES
    assert p == M.TreeParams() and (p.max_iter, p.max_depth, p.step) == (300, 5, 0.05)
    assert {r["prop"]: r["folds"] for r in got} == dict.fromkeys(STATS, plans.FOLDS)
