"""Random search over configurations of boosted trees.

Cross-validating one configuration means a model for every type and fold, five hundred configurations ten thousand models.
They are fitted side by side: one table of labelled rows of bounded size (``ROWS`` of each type, those of the smallest hash
of their key) is binned once to bytes and sent to every task, Spark deals the configurations to tasks, and a task grows the
trees of all types and folds of a configuration level by level in the same arrays, a histogram per open node. Configurations
that differ in their number of rounds alone share one ensemble, read at each of these numbers.

Trees follow the second-order rules: leaves are -G / (H + lambda) with G shrunk by alpha, a split must leave the hessian sum
``leaf`` on both sides and gain more than nothing. Each model draws its rows and features from its own seed, so its trees are
the same alone and among others.

The folds are cut over all rows; only what the models learn from and are ranked by is the bounded table. Rows without a label
are left out, missing values take the median of their type. A fold with fewer than ``at_least`` validation rows, or without
training rows of both classes, counts for no configuration.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.operators.ordered import top_n

ROWS = 400  # of a type
BINS = 16

# The tuning grid, 720,000 configurations.
GRID = {
    "max_depth": [3, 4, 5, 6, 7, 8, 9, 10],
    "step": [0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2],
    "max_iter": [100, 200, 300, 500],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
    "columns": [0.6, 0.7, 0.8, 0.9, 1.0],
    "leaf": [1, 3, 5, 7, 10],
    "alpha": [0.0, 0.01, 0.1, 0.5, 1.0],
    "lam": [0.5, 1.0, 2.0, 5.0],
}


@dataclass(frozen=True)
class Config:
    max_depth: int = 5
    step: float = 0.05
    max_iter: int = 300
    subsample: float = 0.8
    columns: float = 0.8
    leaf: float = 3
    alpha: float = 0.1
    lam: float = 1.0


def draw(n: int, seed: int = 42, grid: dict | None = None) -> list[Config]:
    """n distinct configurations of the grid, the same for the same seed."""
    rng, axes = random.Random(seed), grid or GRID
    size = 1
    for values in axes.values():
        size *= len(values)
    out = []
    for i in rng.sample(range(size), min(n, size)):
        picked = {}
        for name, values in axes.items():
            i, j = divmod(i, len(values))
            picked[name] = values[j]
        out.append(Config(**picked))
    return out


@dataclass
class Problems:
    """Rows of all models side by side: those a model trains on and those it is judged by."""

    names: list[tuple[str, int]]  # type and fold of each model
    model: np.ndarray
    bins: np.ndarray  # bytes, (row, feature)
    label: np.ndarray
    train: np.ndarray  # true where the model learns from the row


def problems(table: pd.DataFrame, prop: str, features: list[str], label: str, k: int, at_least: int) -> Problems:
    """Expanding folds over ``block`` for each type: blocks below f train, block f validates."""
    names, parts = [], []
    for t, mine in table.groupby(prop, sort=True):
        x = mine[features].to_numpy(np.float64, na_value=np.nan)
        keep = ~np.isnan(x).all(0)
        middle = np.zeros(len(features))
        middle[keep] = np.nanmedian(x[:, keep], axis=0)
        x = np.where(np.isnan(x), middle, x)
        cuts = [np.unique(np.quantile(c, np.arange(1, BINS) / BINS, method="inverted_cdf")) for c in x.T]
        bins = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T, strict=True)], 1).astype(np.uint8)
        y, block = mine[label].to_numpy(np.float64), mine["block"].to_numpy()
        for f in range(1, k + 1):
            train, judged = block < f, block == f
            if judged.sum() < at_least or len(np.unique(y[train])) < 2:
                continue
            rows = np.flatnonzero(train | judged)
            parts.append((np.full(len(rows), len(names)), bins[rows], y[rows], train[rows]))
            names.append((str(t), f))
    if not names:
        raise ValueError(f"no fold holds {at_least} rows and both classes")
    return Problems(names, *[np.concatenate(c) for c in zip(*parts, strict=True)])


def grow(p: Problems, c: Config, used: np.ndarray, chosen: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of every row in one more tree of each model. ``used`` rows are learnt from; ``chosen`` are the features of
    each model."""
    def score(gs, hs):
        top = np.abs(gs)
        if c.alpha:
            top -= c.alpha
            np.maximum(top, 0, out=top)
        top *= top
        top /= hs + c.lam
        return top

    out, (count, wide) = np.zeros(len(g)), chosen.shape
    rows, node = np.arange(len(g)), p.model
    picked = np.take_along_axis(p.bins, chosen[p.model], 1).astype(np.int64) + np.arange(wide) * BINS
    learn, at = np.flatnonzero(used), p.model[used]  # the rows learnt from, with their cells and weights
    cells, gs, hs = picked[learn], g[learn], h[learn]
    for depth in range(c.max_depth + 1):
        sum_g, sum_h = np.bincount(at, gs, count), np.bincount(at, hs, count)
        value = -np.sign(sum_g) * np.maximum(np.abs(sum_g) - c.alpha, 0) / (sum_h + c.lam) * c.step
        if depth == c.max_depth:
            out[rows] = value[node]
            break
        cell, size = (cells + at[:, None] * (wide * BINS)).ravel(), count * wide * BINS
        left_g = np.bincount(cell, np.repeat(gs, wide), size).reshape(count, wide, BINS).cumsum(2)
        left_h = np.bincount(cell, np.repeat(hs, wide), size).reshape(count, wide, BINS).cumsum(2)
        right_h = sum_h[:, None, None] - left_h
        gain = score(left_g, left_h)
        gain += score(sum_g[:, None, None] - left_g, right_h)
        gain[np.minimum(left_h, right_h) < c.leaf] = -1
        flat = gain.reshape(count, -1)
        best = flat.argmax(1)
        split = flat[np.arange(count), best] > score(sum_g, sum_h) + 1e-9
        feature, limit, number = best // BINS, best % BINS, 2 * np.cumsum(split) - 2
        goes = split[node]
        out[rows[~goes]] = value[node[~goes]]
        rows, node = rows[goes], node[goes]
        if not len(rows):
            break
        node = number[node] + (picked[rows, feature[node]] - feature[node] * BINS > limit[node])
        goes = split[at]
        if not goes.all():
            at, cells, gs, hs = at[goes], cells[goes], gs[goes], hs[goes]
        at = number[at] + (cells[np.arange(len(at)), feature[at]] - feature[at] * BINS > limit[at])
        count = 2 * int(split.sum())
    return out


def losses(p: Problems, c: Config, rounds: list[int], seed: int) -> dict[int, np.ndarray]:
    """Log-loss of each model on its validation rows after each of these numbers of rounds."""
    models, wide = len(p.names), p.bins.shape[1]
    take = max(1, round(c.columns * wide))
    sizes = np.bincount(p.model, minlength=models)
    dice = [np.random.default_rng([seed, f, *t.encode()]) for t, f in p.names]
    judged = ~p.train
    n = np.bincount(p.model[judged], minlength=models)
    logit, out = np.zeros(len(p.label)), {}
    for done in range(1, max(rounds) + 1):
        prob = 1 / (1 + np.exp(-logit))
        drawn = np.concatenate([d.random(s) for d, s in zip(dice, sizes, strict=True)]) < c.subsample
        chosen = np.stack([np.sort(d.permutation(wide)[:take]) for d in dice])
        logit += grow(p, c, p.train & drawn, chosen, prob - p.label, prob * (1 - prob))
        if done in rounds:
            prob = np.clip(1 / (1 + np.exp(-logit[judged])), 1e-15, 1 - 1e-15)
            loss = -np.where(p.label[judged] > 0.5, np.log(prob), np.log(1 - prob))
            out[done] = np.bincount(p.model[judged], loss, models) / n
    return out


def bounded(rows: DataFrame, prop: str, key: list[str], n: int, seed: int) -> DataFrame:
    """At most n rows of every type, those of the smallest hash of their key."""
    hashed = rows.withColumn("__draw", S.stable_order(str(seed), *[F.col(c) for c in key]))
    return top_n(hashed, [prop], ["__draw", *key], n).drop("__draw")


def random_search(blocks: DataFrame, prop: str, key: list[str], features: list[str], label: str, k: int, n: int = 500,
                  top: int = 5, seed: int = 42, grid: dict | None = None, rows: int = ROWS, at_least: int = 5,
                  tasks: int | None = None) -> DataFrame:
    """The ``top`` configurations of each type by mean log-loss over expanding folds. ``blocks`` holds the type, a block per
    row (see ``timeseries_folds``), the features and the label; ``key`` names its rows."""
    spark = blocks.sparkSession
    y = F.col(label).cast("double")
    known = blocks.filter(y.isNotNull() & ~F.isnan(y)).select(
        prop, "block", y.alias(label), *[F.col(f).cast("double").alias(f) for f in features],
        *[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)])
    table = bounded(known, prop, [f"__k{i}" for i in range(len(key))], rows, seed)
    side_by_side = problems(table.toPandas(), prop, features, label, k, at_least)
    configs = draw(n, seed, grid)
    shared: dict[tuple, list[int]] = {}
    for i, c in enumerate(configs):
        shared.setdefault(tuple(v for a, v in asdict(c).items() if a != "max_iter"), []).append(i)
    # dealt by cost: depth times rounds, the dearest first and round about
    groups = sorted(shared.values(), key=lambda g: -max(configs[i].max_iter for i in g) * configs[g[0]].max_depth)
    tasks = min(len(groups), tasks or 2 * spark.sparkContext.defaultParallelism)
    dealt = spark.createDataFrame([(j % tasks, g) for j, g in enumerate(groups)], "task int, configs array<int>")

    def run(pdfs: Iterable[pd.DataFrame]):
        for pdf in pdfs:
            out = []
            for group in pdf["configs"]:
                at = {int(i): configs[i].max_iter for i in group}
                found = losses(side_by_side, configs[int(group[0])], sorted(set(at.values())), seed)
                out += [(i, t, f, float(x)) for i, m in at.items()
                        for (t, f), x in zip(side_by_side.names, found[m], strict=True)]
            yield pd.DataFrame(out, columns=["config", "prop", "fold", "loss"])

    fitted = dealt.repartitionByRange(tasks, "task").mapInPandas(run, "config int, prop string, fold int, loss double")
    mean = fitted.groupBy("prop", "config").agg(F.avg(F.round("loss", 12)).alias("log_loss"), F.count("*").cast("int").alias("folds"))
    best = mean.withColumn("rank", F.row_number().over(Window.partitionBy("prop").orderBy("log_loss", "config")))
    axes = spark.createDataFrame(
        [(i, *map(float, asdict(c).values())) for i, c in enumerate(configs)],
        "config int, " + ", ".join(f"{a} double" for a in GRID))
    chosen = best.filter(F.col("rank") <= top).join(F.broadcast(axes), "config")
    return chosen.select(F.col("prop").alias(prop), "rank", "config", "folds", "log_loss", *GRID)
