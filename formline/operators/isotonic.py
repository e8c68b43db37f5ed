"""Isotonic regression by pooling adjacent violators, range by range.

Scores are counted once each, cut into ranges and pooled range by range; the block lists of ``FAN`` neighbouring ranges are
then pooled again, until one list is left. Pooling the blocks of a sequence gives the same blocks as pooling its points, so
the result is exact and no score is rounded. A range of n rows usually leaves about the cube root of n blocks; with outcomes
0 and 1 it cannot leave more than about n to the power of 2/3, as there are only so many growing means of small counts.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 16
BLOCK = "piece long, low double, high double, total double, weight long"


class Pool:
    """Blocks of growing mean; a new one absorbs those before it that are not below it."""

    def __init__(self):
        self.blocks: list[list] = []

    def add(self, low: float, high: float, total: float, weight: int) -> None:
        while self.blocks and self.blocks[-1][2] * weight >= total * self.blocks[-1][3]:
            low, _, t, w = self.blocks.pop()
            total, weight = total + t, weight + w
        self.blocks.append([low, high, total, weight])

    def add_all(self, rows: pd.DataFrame) -> None:
        for low, high, total, weight in zip(rows["low"], rows["high"], rows["total"], rows["weight"], strict=True):
            self.add(low, high, total, int(weight))

    def frame(self, piece: int) -> pd.DataFrame:
        out = pd.DataFrame(self.blocks, columns=["low", "high", "total", "weight"])
        return out.assign(piece=piece)[["piece", "low", "high", "total", "weight"]]


def isotonic_blocks(df: DataFrame, score: str, label: str, pieces: int | None = None) -> DataFrame:
    """low, high, mean and weight of the blocks of the isotonic fit of ``label`` on ``score``; rows without either are left
    out."""
    x, y = F.col(score).cast("double"), F.col(label).cast("double")
    rows = df.select(x.alias("low"), y.alias("y")).filter("low is not null and not isnan(low) and y is not null")
    points = rows.groupBy("low").agg(F.sum("y").alias("total"), F.count("*").alias("weight"))
    pieces = pieces or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def first(pdfs: Iterable[pd.DataFrame]):
        pool = Pool()
        for pdf in pdfs:
            pool.add_all(pdf)
        yield pool.frame(TaskContext.get().partitionId())

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pool = Pool()
        pool.add_all(pdf.sort_values("low"))
        return pool.frame(int(key[0]))

    ranges = points.select("low", F.col("low").alias("high"), "total", "weight").repartitionByRange(pieces, "low")
    blocks = ranges.sortWithinPartitions("low").mapInPandas(first, BLOCK)
    while pieces > 1:
        pieces = -(-pieces // FAN)
        blocks = blocks.withColumn("piece", F.floor(F.col("piece") / FAN)).groupBy("piece").applyInPandas(again, BLOCK)
    return blocks.select("low", "high", (F.col("total") / F.col("weight")).alias("mean"), "weight")
