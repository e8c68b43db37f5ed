"""The search against one model at a time in plain Python."""

import math

import numpy as np
import pandas as pd
import pytest

from bindings import plans
from bindings.base import QUERIES, STATS
from formline.plans import search as Q

FEATURES = ["f", "g", "h"]


def table(n=90, seed=1, types=("A", "B")):
    rng = np.random.default_rng(seed)
    parts = []
    for t in types:
        x = np.round(rng.normal(size=(n, 3)), 1)
        x[rng.random((n, 3)) < 0.1] = np.nan
        y = (np.nan_to_num(x[:, 0]) + rng.normal(size=n) > 0).astype(float)
        parts.append(pd.DataFrame(x, columns=FEATURES).assign(y=y, prop=t, block=np.arange(n) * 4 // n, id=np.arange(n)))
    return pd.concat(parts)


def tree(x, g, h, features, c, depth):
    """A nested split or a leaf value, on the rows given."""
    sg, sh = sum(g), sum(h)

    def score(a, b):
        return max(abs(a) - c.alpha, 0) ** 2 / (b + c.lam)

    best = None
    if depth < c.max_depth:
        for f in features:
            for b in range(Q.BINS):
                left = [i for i in range(len(x)) if x[i][f] <= b]
                gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                if hl < c.leaf or sh - hl < c.leaf:
                    continue
                gain = score(gl, hl) + score(sg - gl, sh - hl)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, f, b)
    if best is None or best[0] <= score(sg, sh) + 1e-9:
        return -math.copysign(max(abs(sg) - c.alpha, 0), sg) / (sh + c.lam) * c.step
    _, f, b = best
    side = [[i for i in range(len(x)) if (x[i][f] <= b) == low] for low in (True, False)]
    return (f, b, *[tree([x[i] for i in s], [g[i] for i in s], [h[i] for i in s], features, c, depth + 1) for s in side])


def value(node, x):
    while isinstance(node, tuple):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def one_model(p, c, m, seed):
    mine = np.flatnonzero(p.model == m)
    x, y, train = p.bins[mine].tolist(), p.label[mine].tolist(), p.train[mine].tolist()
    t, f = p.names[m]
    dice = np.random.default_rng([seed, f, *t.encode()])
    logit = [0.0] * len(y)
    for _ in range(c.max_iter):
        prob = [1 / (1 + math.exp(-v)) for v in logit]
        drawn = dice.random(len(y)) < c.subsample
        features = sorted(dice.permutation(len(FEATURES))[:max(1, round(c.columns * len(FEATURES)))].tolist())
        use = [i for i in range(len(y)) if train[i] and drawn[i]]
        grown = tree([x[i] for i in use], [prob[i] - y[i] for i in use], [prob[i] * (1 - prob[i]) for i in use], features, c, 0)
        logit = [v + value(grown, xi) for v, xi in zip(logit, x)]
    loss = [-math.log(1 / (1 + math.exp(-v if yi else v))) for v, yi, tr in zip(logit, y, train) if not tr]
    return sum(loss) / len(loss)


CONFIGS = [Q.Config(3, 0.3, 6, 0.8, 0.7, 1, 0.0, 0.5), Q.Config(2, 0.1, 4, 1.0, 1.0, 3, 0.5, 2.0), Q.Config(5, 0.2, 5, 0.6, 0.7, 0.5, 0.1, 1.0)]


@pytest.mark.parametrize("c", CONFIGS)
def test_models_side_by_side_equal_models_alone(c):
    p = Q.problems(table(), "prop", FEATURES, "y", 3, 5)
    assert p.names == [(t, f) for t in "AB" for f in (1, 2, 3)]
    got = Q.losses(p, c, [2, c.max_iter], 42)[c.max_iter]
    assert got == pytest.approx([one_model(p, c, m, 42) for m in range(len(p.names))], abs=1e-6)


def test_rounds_are_prefixes():
    p = Q.problems(table(), "prop", FEATURES, "y", 3, 5)
    both = Q.losses(p, CONFIGS[0], [3, 6], 42)
    assert (both[3] == Q.losses(p, CONFIGS[0], [3], 42)[3]).all() and (both[6] != both[3]).any()


def test_search_ranks_as_separate_fits(spark):
    rows = table()
    rows.loc[rows["id"] == 7, "y"] = np.nan
    grid = {"max_depth": [2, 3], "max_iter": [3, 5], "step": [0.1, 0.5], "leaf": [1.0]}
    frame = spark.createDataFrame(rows)
    got = Q.random_search(frame, "prop", ["id"], FEATURES, "y", 3, n=8, top=3, grid=grid, rows=60).collect()
    known = Q.bounded(frame.filter("not isnan(y)"), "prop", ["id"], 60, 42).toPandas().replace({None: np.nan})
    p = Q.problems(known, "prop", FEATURES, "y", 3, 5)
    configs = Q.draw(8, 42, grid)
    assert len(set(configs)) == 8 and {(c.max_iter, c.step) for c in configs} == {(a, b) for a in (3, 5) for b in (0.1, 0.5)}
    for t in "AB":
        models = [m for m, (name, _) in enumerate(p.names) if name == t]
        loss = {i: sum(one_model(p, c, m, 42) for m in models) / len(models) for i, c in enumerate(configs)}
        mine = sorted((r for r in got if r["prop"] == t), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3]
        assert [r["log_loss"] for r in mine] == pytest.approx(sorted(loss.values())[:3], abs=1e-6)
        for r in mine:
            assert loss[r["config"]] == pytest.approx(r["log_loss"], abs=1e-6)
            assert r["max_iter"] == configs[r["config"]].max_iter and r["step"] == configs[r["config"]].step


def test_folds_without_both_classes_do_not_count():
    rows = table(types=("A",))
    rows.loc[rows["block"] == 0, "y"] = 1.0
    assert Q.problems(rows, "prop", FEATURES, "y", 3, 5).names == [("A", 2), ("A", 3)]
    with pytest.raises(ValueError):
        Q.problems(rows.assign(y=1.0), "prop", FEATURES, "y", 3, 5)


def test_query_draws_from_the_whole_grid(spark, monkeypatch):
    sizes = [len(v) for v in Q.GRID.values()]
    assert plans.SEARCHES == 500 and math.prod(sizes) == 720_000 and len(set(Q.draw(500))) == 500
    monkeypatch.setattr(plans, "SEARCHES", 6)
    monkeypatch.setitem(Q.GRID, "max_iter", [2, 3])
    got = QUERIES["random_search"](spark, "/root/testdata/sf0.001").collect()
    assert {(r["prop"], r["rank"]) for r in got} == {(p, i) for p in STATS for i in range(1, 6)}
    assert {r["folds"] for r in got} == {plans.FOLDS}
