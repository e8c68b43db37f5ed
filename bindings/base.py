"""The test tables in the roles the operators expect, as DataFrames and as SQL fragments.

Every fragment name starts with ``q_``; ``with_fragments`` puts those a query mentions in front of it.
Money and ratios are carried as integers (cents, percent), so sums are exact in any order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.operators import classify, features
from formline.operators.ordered import Frame, rolling
from formline.session import run_dir, staged

STATS = {"PTS": "points", "REB": "rebounds", "AST": "assists", "3PM": "threes"}
ENTITY, ORDER = ["entity_id"], ["game_date", "game_id"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf) -> DataFrame:
    """Entity x time rows: user, moment, kind, value in cents and the JSON number."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("entity_id"), "ts", F.to_date("ts").alias("game_date"),
        F.col("event_type").alias("team"), F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.from_json("props", "struct<k:long>")["k"].alias("k"),
    )


RING = {"click": "error", "error": "purchase", "purchase": "signup", "signup": "view", "view": "click"}


def team_days(spark, sf) -> DataFrame:
    """Team x game rows: one per kind and day, opponents in a fixed ring."""
    k = F.col("k")

    def n(cond):
        return F.count_if(cond)

    return events(spark, sf).groupBy("game_date", "team").agg(
        F.count(F.lit(1)).alias("fga"), n(k % 4 == 1).alias("fta"), n(k % 7 == 0).alias("oreb"),
        n(k % 5 == 0).alias("tov"), n(k % 3 == 0).alias("reb"), n(k % 4 == 0).alias("ast"),
        n(k % 6 == 0).alias("fg3a"), F.sum(k % 11).alias("score"), F.sum(k % 13).alias("allowed"),
        n(k > 50).alias("minutes"),
    ).withColumn("opponent", S.case_of(F.col("team"), RING, F.lit(None).cast("string")))


def box(spark, sf) -> DataFrame:
    """Player x game rows: customer, order, and sums over its lines; null where it has no line."""
    flag = F.col("l_returnflag")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("long")).alias("points"),
        F.count(F.lit(1)).alias("rebounds"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("assists"),
        F.count_if(flag == "R").alias("threes"),
        F.sum(F.round(F.col("l_tax") * 100).cast("long")).alias("minutes"),
        F.sum(F.col("l_linenumber").cast("long")).alias("fga"),
        F.count_if(F.col("l_linestatus") == "F").alias("fgm"),
        F.count_if(flag.isin("R", "A")).alias("fg3a"),
        F.count_if(flag == "A").alias("fta"),
        F.count_if(flag == "N").alias("tov"),
    )
    people = table(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("team"))
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.col("o_orderkey").alias("game_id"),
        F.to_date("o_orderdate").alias("game_date"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int").alias("home"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    rows = orders.join(lines, F.col("game_id") == F.col("l_orderkey"), "left").drop("l_orderkey")
    rows = rows.join(people, F.col("entity_id") == F.col("c_custkey"), "left").drop("c_custkey")
    team = F.col("team")
    return rows.withColumn("opponent", team + 1 - 2 * (team % 2)).withColumn("season", S.season_of(F.col("game_date")))


def featured(spark, sf, players: DataFrame | None = None) -> DataFrame:
    """Box rows (``players`` if given) with rolling means and spreads, rest days and season means, one shuffle by entity."""
    stats = {**STATS, "MIN": "minutes"}
    frames = [*features.mean_frames(stats, "season"), *features.std_frames(STATS), Frame("__prev", "lag", "game_date", 1)]
    rows = rolling(box(spark, sf) if players is None else players, ENTITY, ORDER, frames)
    rest = F.coalesce(F.datediff("game_date", "__prev"), F.lit(7))
    return rows.withColumn("rest_days", rest).withColumn("is_b2b", (F.col("rest_days") == 1).cast("int")).drop("__prev")


LONG = ["entity_id", "game_id", "game_date", "season", "home", "team", "opponent", "c_name", "rest_days", "is_b2b",
        "L5_Avg_MIN", "Season_Avg_MIN", "Season_Avg_PTS"]


def prop_rows(spark, sf, players: DataFrame | None = None) -> DataFrame:
    """One row per player, game and prop type with a line from the last ten games and its odds."""
    items = F.array(*[
        F.struct(
            F.lit(p).alias("prop"), F.col(c).alias("actual"), F.col(f"L5_Avg_{p}").alias("l5"),
            F.col(f"L10_Avg_{p}").alias("l10"), F.col(f"Season_Avg_{p}").alias("sm"),
            F.col(f"L5_StdDev_{p}").alias("sd5"), F.col(f"L10_StdDev_{p}").alias("sd10"),
        )
        for p, c in STATS.items()
    ])
    rows = featured(spark, sf, players).select(*LONG, F.explode(items).alias("i")).select(*LONG, "i.*")
    odds = S.case_of(F.col("game_id") % 7, {0: -110, 1: -125, 2: 105, 3: 120, 4: -140, 6: 0}, F.lit(None).cast("int"))
    return rows.withColumn("line", F.floor(F.col("l10") * 2) / 2.0).withColumn("odds", odds).filter("line IS NOT NULL")


def labelled(spark, sf) -> DataFrame:
    rows = prop_rows(spark, sf).withColumn("outcome", S.outcome(F.col("actual"), F.col("line")))
    return rows.filter("outcome IS NOT NULL")


def predicted(spark, sf) -> DataFrame:
    """Labelled rows scored by recent form over form plus line, and a second opinion from the season mean."""
    both = F.col("l5") + F.col("line")
    p = F.coalesce(F.when(both > 0, F.floor(F.col("l5") / both * 1000) / 1000.0), F.lit(0.5))
    rows = labelled(spark, sf).withColumn("p", p)
    return rows.select(
        "*",
        F.when(F.col("p") > 0.5, "OVER").otherwise("UNDER").alias("side"),
        S.ten_point_confidence(F.col("p")).alias("confidence"),
        F.when(F.col("sm") > F.col("line"), "OVER").otherwise("UNDER").alias("side2"),
        (F.col("game_id") % 10 + 1).cast("int").alias("confidence2"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where a source has fewer splits than cores (small files only)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tagged(spark, sf) -> DataFrame:
    """Prediction log: predictions with tier, reliability, tags and whether they came in.

    The log is a stored table; tier limits and the reports on it read the files, not the plan again.
    """
    log = staged(predicted(spark, sf), run_dir(spark, "predictions"))
    rows = classify.player_tier(log, "Season_Avg_PTS", "Season_Avg_MIN", "tier")
    rows = rows.withColumn("Reliability_Tag", S.reliability(row_cv()))
    return rows.withColumn("context_tags", row_tags()).withColumn(
        "is_correct", (F.col("side") == "OVER") == (F.col("outcome") == 1)
    )


def row_cv():
    from formline import config

    default = S.case_of(F.col("prop"), config.SPREAD_DEFAULTS, F.lit(1.0))
    return F.when(F.col("sm") > 0, F.coalesce("sd5", "sd10", default) / F.col("sm")).otherwise(1.0)


def row_tags():
    g = F.col("game_id")
    return S.context_tags(
        F.col("is_b2b"), g % 30, (g % 12) + 94, g % 17, (g % 45) + 200, F.col("l5") - F.col("line")
    )


SEASON_SQL = """CASE WHEN month({d}) >= 10 THEN year({d}) ELSE year({d}) - 1 END"""


def season_sql(d: str) -> str:
    y = SEASON_SQL.format(d=d)
    return f"CAST({y} AS VARCHAR) || '-' || lpad(CAST((({y}) + 1) % 100 AS VARCHAR), 2, '0')"


def windows_sql() -> str:
    def w(keys, n):
        start = "UNBOUNDED" if n is None else str(n)
        return (f"(PARTITION BY {keys} ORDER BY game_date, game_id "
                f"ROWS BETWEEN {start} PRECEDING AND 1 PRECEDING)")

    return f"WINDOW w5 AS {w('entity_id', 5)}, w10 AS {w('entity_id', 10)}, ws AS {w('entity_id, season', None)}"


def _feature_sql() -> str:
    cols = []
    for s, c in {**STATS, "MIN": "minutes"}.items():
        cols += [f'avg({c}) OVER w5 AS "L5_Avg_{s}"', f'avg({c}) OVER w10 AS "L10_Avg_{s}"',
                 f'avg({c}) OVER ws AS "Season_Avg_{s}"']
    for s, c in STATS.items():
        cols += [f'stddev_samp({c}) OVER w5 AS "L5_StdDev_{s}"', f'stddev_samp({c}) OVER w10 AS "L10_StdDev_{s}"']
    return ", ".join(cols)


def _long_sql() -> str:
    parts = []
    for s, c in STATS.items():
        parts.append(
            f"SELECT {', '.join(LONG)}, '{s}' AS prop, {c} AS actual, \"L5_Avg_{s}\" AS l5, \"L10_Avg_{s}\" AS l10, "
            f"\"Season_Avg_{s}\" AS sm, \"L5_StdDev_{s}\" AS sd5, \"L10_StdDev_{s}\" AS sd10 FROM q_feat"
        )
    return " UNION ALL ".join(parts)


def tags_sql(alias: str = "") -> str:
    """Comma list of tags, in the fixed order."""
    a = alias
    r = f"(CASE WHEN {a}game_id % 30 = 0 THEN 15 ELSE {a}game_id % 30 END)"
    pace = f"({a}game_id % 12 + 94)"
    gap = f"({a}game_id % 17)"
    total = f"({a}game_id % 45 + 200)"
    edge = f"abs(coalesce({a}l5 - {a}line, 0))"
    return (
        "concat_ws(',', "
        f"CASE WHEN {a}is_b2b = 1 THEN 'b2b' END, "
        f"CASE WHEN {r} <= 5 THEN 'elite_defense' WHEN {r} <= 10 THEN 'good_defense' WHEN {r} >= 25 THEN 'weak_defense' END, "
        f"CASE WHEN {pace} > 102 THEN 'fast_pace' WHEN {pace} < 97 THEN 'slow_pace' END, "
        f"CASE WHEN {gap} > 14 THEN 'blowout_risk' WHEN {gap} > 10 THEN 'moderate_spread' END, "
        f"CASE WHEN {total} > 235 THEN 'high_total' WHEN {total} < 215 THEN 'low_total' END, "
        f"CASE WHEN {edge} > 5 THEN 'large_edge' WHEN {edge} < 2 THEN 'small_edge' END)"
    )


CV_SQL = ("round(CASE WHEN sm > 0 THEN coalesce(sd5, sd10, CASE prop WHEN 'PTS' THEN 5.0 WHEN 'REB' THEN 2.5 "
          "WHEN 'AST' THEN 2.0 ELSE 1.0 END) / sm ELSE 1.0 END, 9)")
RELIABILITY_SQL = (f"CASE WHEN {CV_SQL} < 0.25 THEN 'SNIPER' WHEN {CV_SQL} < 0.45 THEN 'STANDARD' "
                   "ELSE 'VOLATILE' END")


def tier_sql(source: str, points: str = '"Season_Avg_PTS"', minutes: str = '"Season_Avg_MIN"') -> str:
    """SELECT of every column of ``source`` plus its tier; thresholds are exact discrete quantiles."""
    def cut(c, q, default):
        return f"CASE WHEN coalesce({q}, 0) = 0 THEN {default} ELSE {q} END AS {c}"

    return (
        f"SELECT s.*, CASE WHEN {points} > p80_pts AND {minutes} > p80_min THEN 'STAR' "
        f"WHEN {minutes} > p60_min THEN 'STARTER' WHEN {minutes} > p40_min THEN 'ROTATION' ELSE 'BENCH' END AS tier "
        f"FROM {source} s, (SELECT "
        + ", ".join([
            cut("p80_pts", f"quantile_disc({points}, 0.8)", "15.0"), cut("p80_min", f"quantile_disc({minutes}, 0.8)", "30.0"),
            cut("p60_min", f"quantile_disc({minutes}, 0.6)", "25.0"), cut("p40_min", f"quantile_disc({minutes}, 0.4)", "20.0"),
        ])
        + f" FROM {source}) c"
    )


RING_SQL = "CASE team " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RING.items()) + " END"

FRAGMENTS = {
    "q_ev": """SELECT event_id, user_id AS entity_id, ts, CAST(ts AS DATE) AS game_date, event_type AS team,
        CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "q_team": f"""SELECT *, {RING_SQL} AS opponent FROM (SELECT game_date, team, count(*) AS fga,
        count(*) FILTER (WHERE k % 4 = 1) AS fta, count(*) FILTER (WHERE k % 7 = 0) AS oreb,
        count(*) FILTER (WHERE k % 5 = 0) AS tov, count(*) FILTER (WHERE k % 3 = 0) AS reb,
        count(*) FILTER (WHERE k % 4 = 0) AS ast, count(*) FILTER (WHERE k % 6 = 0) AS fg3a,
        CAST(sum(k % 11) AS BIGINT) AS score, CAST(sum(k % 13) AS BIGINT) AS allowed,
        count(*) FILTER (WHERE k > 50) AS minutes FROM q_ev GROUP BY game_date, team)""",
    "q_li": """SELECT l_orderkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS points, count(*) AS rebounds,
        CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS assists,
        count(*) FILTER (WHERE l_returnflag = 'R') AS threes,
        CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS minutes,
        CAST(sum(l_linenumber) AS BIGINT) AS fga, count(*) FILTER (WHERE l_linestatus = 'F') AS fgm,
        count(*) FILTER (WHERE l_returnflag IN ('R', 'A')) AS fg3a, count(*) FILTER (WHERE l_returnflag = 'A') AS fta,
        count(*) FILTER (WHERE l_returnflag = 'N') AS tov FROM lineitem GROUP BY l_orderkey""",
    "q_box": f"""SELECT o.*, {season_sql('game_date')} AS season, team + 1 - 2 * (team % 2) AS opponent,
        points, rebounds, assists, threes, minutes, fga, fgm, fg3a, fta, tov FROM (
        SELECT o_custkey AS entity_id, o_orderkey AS game_id, CAST(o_orderdate AS DATE) AS game_date,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END AS home,
        CAST(round(o_totalprice * 100) AS BIGINT) AS cents, c_name, c_nationkey AS team
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey) o LEFT JOIN q_li ON o.game_id = l_orderkey""",
    "q_feat": f"""SELECT *, CASE WHEN rest_days = 1 THEN 1 ELSE 0 END AS is_b2b FROM (SELECT *, {_feature_sql()},
        coalesce(game_date - lag(game_date) OVER (PARTITION BY entity_id ORDER BY game_date, game_id), 7) AS rest_days
        FROM q_box {windows_sql()})""",
    "q_long": _long_sql(),
    "q_prop": """SELECT *, floor(l10 * 2) / 2 AS line, CASE game_id % 7 WHEN 0 THEN -110 WHEN 1 THEN -125
        WHEN 2 THEN 105 WHEN 3 THEN 120 WHEN 4 THEN -140 WHEN 6 THEN 0 END AS odds FROM q_long WHERE l10 IS NOT NULL""",
    "q_lab": """SELECT *, CASE WHEN actual > line THEN 1 ELSE 0 END AS outcome FROM q_prop WHERE actual IS NOT NULL""",
    "q_pred": """SELECT *, CASE WHEN p > 0.5 THEN 'OVER' ELSE 'UNDER' END AS side,
        CAST(trunc(least(greatest(abs(p - 0.5) * 20, 1), 10)) AS INTEGER) AS confidence,
        CASE WHEN sm > line THEN 'OVER' ELSE 'UNDER' END AS side2, CAST(game_id % 10 + 1 AS INTEGER) AS confidence2
        FROM (SELECT *, coalesce(CASE WHEN l5 + line > 0 THEN floor(l5 / (l5 + line) * 1000) / 1000 END, 0.5) AS p
        FROM q_lab)""",
    "q_tier": tier_sql("q_pred"),
    "q_log": f"""SELECT *, {RELIABILITY_SQL} AS "Reliability_Tag", {tags_sql()} AS tags,
        (side = 'OVER') = (outcome = 1) AS is_correct FROM q_tier""",
}


def _accuracy_sql(dim: str, value: str) -> str:
    return (f"SELECT '{dim}' AS dimension, CAST({value} AS VARCHAR) AS value, count(*) AS total, "
            "count(*) FILTER (WHERE is_correct) * 100.0::DOUBLE / count(*) AS accuracy FROM q_log GROUP BY 2")


FRAGMENTS["q_conf"] = " UNION ALL ".join(
    _accuracy_sql(d, v) for d, v in (("confidence", "confidence2"), ("tier", "tier"), ("prop", "prop")))


def with_fragments(body: str) -> str:
    """Prefix the fragments a query mentions, dependencies first."""
    done: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in re.findall(r"\bq_[a-z0-9]+\b", text):
            if name in FRAGMENTS and name not in done:
                visit(FRAGMENTS[name])
                done[name] = FRAGMENTS[name]

    visit(body)
    if not done:
        return body
    shared = ", ".join(f"{n} AS ({s})" for n, s in done.items())
    own = body.lstrip()
    if own.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {shared}, {own[15:]}"
    return f"WITH {shared}, {own[5:]}" if own.startswith("WITH ") else f"WITH {shared} {own}"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and its SQL."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_fragments(sql)
        return fn

    return add


def r6(*names: str):
    """Round doubles for comparison across engines."""
    return [F.round(F.col(n), 6).alias(n) for n in names]


def r6_sql(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)
