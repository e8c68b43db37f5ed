"""Box-score scans from CSV with declared schemas."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable
from urllib.parse import unquote

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline import config
from formline.functions import scalars as S

PLAYER_SCHEMA = (
    "personId long, gameId long, firstName string, lastName string, gameDateTimeEst string, "
    "playerteamCity string, playerteamName string, opponentteamCity string, opponentteamName string, "
    "home int, win int, numMinutes double, points int, assists int, blocks int, steals int, "
    "reboundsTotal int, reboundsDefensive int, reboundsOffensive int, foulsPersonal int, turnovers int, "
    "fieldGoalsAttempted int, fieldGoalsMade int, fieldGoalsPercentage double, "
    "threePointersAttempted int, threePointersMade int, threePointersPercentage double, "
    "freeThrowsAttempted int, freeThrowsMade int, freeThrowsPercentage double, plusMinusPoints double"
)
TEAM_SCHEMA = (
    "gameId long, teamId long, opponentTeamId long, teamCity string, teamName string, "
    "opponentTeamCity string, opponentTeamName string, gameDateTimeEst string, home int, "
    "teamScore int, opponentScore int, assists int, reboundsTotal int, reboundsOffensive int, "
    "fieldGoalsAttempted int, freeThrowsAttempted int, threePointersAttempted int, turnovers int, "
    "numMinutes double"
)


HEADER_BYTES = 1 << 20


def first_names(uri: str) -> list[str]:
    """Column names of the first line with text of a CSV file; none of an empty file."""
    system, place = pafs.FileSystem.from_uri(uri)
    with system.open_input_stream(place) as stream:
        text = stream.read(HEADER_BYTES).decode("utf-8-sig", "replace")
    line = next((x for x in io.StringIO(text) if x.strip()), "")
    return next(csv.reader([line]), [])


def by_header(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """The files below ``path`` by their header, in one job: tasks share the files and read their beginnings alone."""
    files = sorted(spark.read.text(path).inputFiles())
    if not files:
        return {}

    def read(pdfs: Iterable[pd.DataFrame]):
        for pdf in pdfs:
            yield pdf.assign(names=[first_names(f) for f in pdf["file"]])

    tasks = min(len(files), max(1, spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(tasks)
    out: dict[tuple[str, ...], list[str]] = {}
    for file, names in sorted(listed.mapInPandas(read, "file string, names array<string>").collect()):
        if names:
            out.setdefault(tuple(names), []).append(unquote(file))  # readers take plain paths
    return out


def once(header: tuple[str, ...]) -> set[str]:
    """Names that one column alone has; Spark renames columns of one name, in any case."""
    lower = [n.lower() for n in header]
    return {n for n in header if lower.count(n.lower()) == 1}


def read_named(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """CSV columns picked by header name and cast to the declared types.

    Files may carry more columns or another order, also within one folder: files of one header are read together. A
    declared column that a file lacks is null there, and one that all files lack raises; a value that does not fit its
    type reads as null.
    """
    declared = T.StructType.fromDDL(schema)
    found = by_header(spark, path)
    if absent := [f.name for f in declared if found and not any(f.name in once(header) for header in found)]:
        raise ValueError(f"no file has the columns {absent}")
    out = spark.createDataFrame([], declared)
    for k, (header, files) in enumerate(sorted(found.items())):
        raw = spark.read.csv(files, header=True)
        one = raw.select(*[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in once(header) else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in declared])
        out = out.unionByName(one) if k else one
    return out


def scan_csv(spark: SparkSession, path: str | list[str], schema: str, time: str = "gameDateTimeEst") -> DataFrame:
    """Typed CSV scan with ``game_date`` from a time column that mixes forms."""
    rows = read_named(spark, path, schema)
    return rows.withColumn("game_time", S.parse_time(F.col(time))).withColumn("game_date", F.to_date("game_time"))


def scan_players(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, PLAYER_SCHEMA)


def scan_teams(spark: SparkSession, path: str) -> DataFrame:
    return scan_csv(spark, path, TEAM_SCHEMA)


def scan_many(spark: SparkSession, paths: list[str], schemas: list[str]) -> DataFrame:
    """Union of folders whose columns differ; absent columns are null."""
    out = None
    for path, schema in zip(paths, schemas):
        one = read_named(spark, path, schema)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def actuals(box: DataFrame) -> DataFrame:
    """Ids and outcomes only: kept apart from features until after prediction."""
    ids = [c for c in ("gameId", "game_date", "personId", "firstName", "lastName", "FullName") if c in box.columns]
    return box.select(*ids, *[c for c in config.OUTCOME_COLUMNS if c in box.columns])


def settling_stats(box: DataFrame, keys: list[str]) -> DataFrame:
    """The four columns that settle props, by key."""
    return box.select(*keys, *config.PROP_TO_ACTUAL.values())


def filter_season(df: DataFrame, day: str, season: str, ranges: dict | None = None) -> DataFrame:
    """Rows inside a named season, bounds included."""
    table = ranges or config.SEASON_RANGES
    if season not in table:
        raise ValueError(f"unknown season {season}; known: {sorted(table)}")
    low, high = table[season]
    upper = F.lit(high).cast("date") if high else F.date_sub(F.current_date(), 1)
    return df.filter(F.col(day).between(F.lit(low).cast("date"), upper))


def filter_date(df: DataFrame, day: str, value: str) -> DataFrame:
    """Rows of one date, compared as DATE so partitions and row groups can be skipped."""
    return df.filter(F.col(day) == F.lit(value).cast("date"))


def union_seasons(df: DataFrame, day: str, seasons: list[str], ranges: dict | None = None) -> DataFrame:
    """Several seasons as one filter over one scan."""
    table = ranges or config.SEASON_RANGES
    keep = F.lit(False)
    for s in seasons:
        if s not in table:
            raise ValueError(f"unknown season {s}; known: {sorted(table)}")
        low, high = table[s]
        upper = F.lit(high).cast("date") if high else F.date_sub(F.current_date(), 1)
        keep = keep | F.col(day).between(F.lit(low).cast("date"), upper)
    return df.filter(keep)


def list_dates(df: DataFrame, day: str) -> DataFrame:
    return df.select(F.col(day).alias("day")).distinct().orderBy("day")
