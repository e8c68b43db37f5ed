"""Lines and odds: stored parquet and landed JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.operators.joins import map_code

PAYLOAD_SCHEMA = (
    "struct<id:string,home_team:string,away_team:string,commence_time:string,"
    "bookmakers:array<struct<key:string,title:string,markets:array<struct<key:string,"
    "outcomes:array<struct<name:string,description:string,point:double,price:int>>>>>>>"
)


def parse_payload(raw: DataFrame, text: str) -> DataFrame:
    return raw.withColumn("event", F.from_json(text, PAYLOAD_SCHEMA)).drop(text)


def market_prop(key: Column) -> Column:
    """``player_points`` to ``PTS``."""
    bare = F.upper(F.regexp_replace(key, "^player_", ""))
    return S.normalize_prop(bare)


def flatten_odds_payload(events: DataFrame, event: str = "event", book: str | None = None) -> DataFrame:
    """Nested event to one row per Over outcome that names a player and a point."""
    e = F.col(event)
    books = e["bookmakers"]
    if book:
        books = F.filter(books, lambda b: b["key"] == book)
    kept = [c for c in events.columns if c != event]
    ids = [*kept, "home_team", "away_team", "commence_time"]
    # explode_outer plus a filter behind it: an inner explode would add a size test that parses again.
    rows = events.select(*kept, *[e[c].alias(c) for c in ids[len(kept):]], F.explode_outer(books).alias("b"))
    rows = rows.filter(F.col("b").isNotNull()).select(*ids, F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    rows = rows.select(*ids, "book", market_prop(F.col("m.key")).alias("prop"), F.explode(
        F.filter("m.outcomes", lambda o: (o["name"] == "Over") & o["description"].isNotNull() & o["point"].isNotNull())
    ).alias("o"))
    return rows.select(
        *ids, "book", "prop", F.col("o.description").alias("player"), F.col("o.point").alias("line"),
        F.col("o.price").alias("odds"),
    )


def flatten_game_lines(events: DataFrame, event: str = "event") -> DataFrame:
    """Spread and total of a game from its first book."""
    e = F.col(event)
    kept = [c for c in events.columns if c != event]
    markets = F.try_element_at(e["bookmakers"], F.lit(1))["markets"]

    def points(key: str, outcome: Column) -> Column:
        chosen = F.flatten(F.transform(F.filter(markets, lambda m: m["key"] == key), lambda m: m["outcomes"]))
        return F.array_max(F.transform(F.filter(chosen, lambda o: o["name"] == outcome), lambda o: o["point"]))

    return events.select(
        *kept, e["home_team"].alias("home_team"), e["away_team"].alias("away_team"),
        F.abs(points("spreads", e["home_team"])).alias("spread"),
        points("totals", F.lit("Over")).alias("total"),
    )


def consolidate_lines(lines: DataFrame, keys: list[str], line: str, odds: str, pick: list[str]) -> DataFrame:
    """One line per key: the first by ``pick``, and the mean odds of all as an integer."""
    return lines.groupBy(*keys).agg(
        F.min_by(line, F.struct(*pick)).alias(line), F.avg(odds).cast("int").alias(odds)
    )


def stored_odds(raw: DataFrame, codes: DataFrame, line: str = "line", odds: str = "odds") -> DataFrame:
    """Season odds as stored: Over side, team codes, key, upper-case type, consolidated."""
    rows = raw.filter(F.col("side") == "Over")
    rows = map_code(rows, F.col("home_team"), codes, "home_code", F.col("home_team"))
    rows = map_code(rows, F.col("away_team"), codes, "away_code", F.col("away_team"))
    rows = rows.select(
        F.concat_ws("_", F.date_format("game_date", "yyyy-MM-dd"), "home_code", "away_code").alias("join_key"),
        F.col("player_name").alias("player"), F.upper("prop_type").alias("prop"), line, odds,
        F.col("home_code").alias("home_team"), F.col("away_code").alias("away_team"), "game_date", "book",
    )
    keys = ["join_key", "player", "prop", "home_team", "away_team", "game_date"]
    return consolidate_lines(rows, keys, line, odds, ["book", line])


def fallback_code(name: Column) -> Column:
    """First three letters, upper case, for a name outside the map."""
    return F.upper(F.substring(name, 1, 3))
