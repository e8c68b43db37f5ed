"""Writers. Each writes from the executors; nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_parquet(df: DataFrame, path: str, by: list[str]) -> None:
    """Partitioned parquet. Rows meet their partition's files through a rebalance that splits large ones."""
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).parquet(path)


def sink_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def sink_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# Names of the pick columns as readers see them.
PICK_NAMES = {
    "player": "Player", "prop": "Prop", "line": "Line", "side": "Pick", "confidence": "Confidence",
    "edge": "Edge", "game_date": "Date",
}


def clean_picks(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(n) for c, n in PICK_NAMES.items() if c in df.columns])


def sink_picks(df: DataFrame, path: str, high: int = 7) -> dict[str, str]:
    """All picks and the confident ones as CSV, and one JSON line per pick."""
    picks = clean_picks(df)
    out = {"all": f"{path}/picks", "high": f"{path}/high_confidence", "json": f"{path}/json"}
    sink_csv(picks, out["all"])
    sink_csv(picks.filter(F.col("Confidence") >= high), out["high"])
    sink_json(picks, out["json"])
    return out
