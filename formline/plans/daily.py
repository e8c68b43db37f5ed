"""Today's picks and the predict-then-reveal evaluation, each as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.operators import classify, joins, select
from formline.operators.ordered import top_n


def todays_edges(props: DataFrame, history: DataFrame, on: list[str], time: list[str], take: list[str], stat: str,
                 line: str, odds: str) -> DataFrame:
    """Latest known features, recent hit rate and edge for each of today's props, weak edges dropped."""
    rows = joins.asof_latest(props, history, on, time, take)
    rows = joins.recent_hit_rate(rows, history, on, [f"-{t}" for t in time], stat, line, odds)
    return classify.edge_filter(rows)


def reveal_by_day(predictions: DataFrame, actual: str, line: str, day: str, prop: str, odds: str,
                  tiebreak: list[str], per_type: int = 2, high: int = 7) -> DataFrame:
    """Every day at once: pick the slate without outcomes, reveal, then hits, accuracy and miss sizes."""
    slate = top_n(select.with_asc_nulls_last(predictions, odds)[0], [day, prop], [f"__null_{odds}", odds, *tiebreak], per_type)
    rows = slate.withColumn("hit", F.col("side") == F.when(F.col(actual) > F.col(line), "OVER").otherwise("UNDER"))
    rows = classify.add_severity(rows, actual, line, "side")
    return rows.groupBy(F.col(day).alias("day")).agg(
        F.count(F.lit(1)).alias("picks"), F.count_if("hit").alias("hits"),
        (F.count_if("hit") / F.count(F.lit(1)) * 100.0).alias("accuracy"),
        F.count_if(~F.col("hit") & (F.col("severity") == "MAJOR")).alias("major_misses"),
        F.count_if(~F.col("hit") & (F.col("confidence") >= high)).alias("confident_misses"),
    )
