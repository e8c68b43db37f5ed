"""Daily increments over stored data: calendars, registries, date-wise replacement."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.sources import manifest


def calendar(spark: SparkSession, low: Column, high: Column, day: str = "day") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(low, high)).alias(day))


def pending_dates(wanted: DataFrame, done: DataFrame, day: str = "day") -> DataFrame:
    """Days of the wanted range that have no data yet."""
    return wanted.join(done.select(day).distinct(), day, "left_anti")


def next_window(pending: DataFrame, day: str = "day", length: int = 7) -> DataFrame:
    """First pending day and the end of the window that starts there."""
    return pending.agg(F.min(day).alias("first_day")).withColumn(
        "last_day", F.date_add("first_day", length - 1)
    )


def mark_dates(done: DataFrame, new: DataFrame, day: str = "day") -> DataFrame:
    """Registry plus newly processed days, each once."""
    return done.select(day).unionByName(new.select(day)).distinct()


def dates_by_month(done: DataFrame, day: str = "day") -> DataFrame:
    return done.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def upsert_by_date(stored: DataFrame, new: DataFrame, day: str) -> DataFrame:
    """Stored rows of other dates plus the new rows."""
    replaced = stored.join(new.select(day).distinct(), day, "left_anti")
    return replaced.select(*stored.columns).unionByName(new.select(*stored.columns))


def write_dates(new: DataFrame, path: str, day: str) -> None:
    """The stored form of the same replacement: only the partitions of the new dates are rewritten."""
    (
        new.hint("rebalance", day).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)
    )


def season_cache(spark: SparkSession, path: str, wanted: list[str], build, season: str = "season",
                 force: bool = False, day: str | None = None, must_have: dict[str, str] | None = None,
                 between: tuple[str, str] | None = None) -> DataFrame:
    """Stored seasons of ``path``; those that the manifest does not name are built, written and then committed.

    A season of ``must_have`` is stale, and built again, while it has no row of the day given for it. ``between`` keeps the
    days from one to another, both included. Each build goes to a folder of its own, so readers of the list before keep theirs.
    """
    number, stored = manifest.newest(spark, path)

    def stale(s: str) -> bool:
        if force or s not in stored:
            return True
        wants = (must_have or {}).get(s)
        return wants is not None and _of(spark, path, stored, [s], season).filter(F.col(day) == F.lit(wants).cast("date")).isEmpty()

    missing = [s for s in wanted if stale(s)]
    if missing:
        rows, folder = build(missing), f"part-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").partitionBy(season).parquet(f"{path}/{folder}")
        stored = stored | {s: {"folder": folder, "schema": rows.schema.json()} for s in missing}
        manifest.commit(spark, path, number, stored)
    out = _of(spark, path, stored, wanted, season)
    return out.filter(F.col(day).between(*[F.lit(d).cast("date") for d in between])) if between else out


def _of(spark: SparkSession, path: str, stored: dict, wanted: list[str], season: str) -> DataFrame:
    """Rows of the wanted seasons, each from the folder that the manifest names."""
    folders: dict[str, list[str]] = {}
    for s in wanted:
        folders.setdefault(stored[s]["folder"], []).append(s)
    parts = []
    for folder, names in folders.items():
        schema = T.StructType.fromJson(json.loads(stored[names[0]]["schema"]))
        some = spark.read.schema(schema).parquet(f"{path}/{folder}").filter(F.col(season).cast("string").isin(*names))
        parts.append(some.select(*schema.names))
    return reduce(lambda a, b: a.unionByName(b), parts)


def mark_session(new: DataFrame, path: str, day: str, session: str, info: dict[str, str]) -> None:
    """Store the days of a session that no earlier one has, then its record. The record commits them: days of a session
    without one do not count."""
    spark = new.sparkSession
    number, stored = manifest.newest(spark, path)
    if session in stored:
        raise ValueError(f"session {session} is recorded already")
    days = new.select(F.col(day).cast("date").alias("day")).filter("day is not null").distinct()
    if stored:
        days = days.join(marked_dates(spark, path), "day", "left_anti")
    folder = f"days-{uuid.uuid4().hex}"
    days.write.mode("errorifexists").parquet(f"{path}/{folder}")
    record = {**info, "folder": folder, "order": str(len(stored)), "dates": str(spark.read.schema("day date").parquet(f"{path}/{folder}").count())}
    manifest.commit(spark, path, number, stored | {session: record})


def marked_dates(spark: SparkSession, path: str) -> DataFrame:
    """Days of all recorded sessions, each once."""
    _, stored = manifest.newest(spark, path)
    if not stored:
        return spark.createDataFrame([], "day date")
    return spark.read.schema("day date").parquet(*[f"{path}/{r['folder']}" for r in stored.values()])


def sessions(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Session records in order, the ``last`` ones if given: position, session, dates and what else was recorded."""
    _, stored = manifest.newest(spark, path)
    rows = sorted((int(r["order"]), name, int(r["dates"]), {k: v for k, v in r.items() if k not in ("folder", "order", "dates")})
                  for name, r in stored.items())
    return spark.createDataFrame(rows[-last:] if last else rows, "position int, session string, dates long, info map<string,string>")
