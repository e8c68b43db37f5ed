"""Projections, filters, labels, classes and gates."""

import re

from pyspark.sql import functions as F

from bindings.base import (RELIABILITY_SQL, STATS, box, events, featured, labelled, predicted, prop_rows, query, r6,
                           r6_sql, season_sql, table, tagged, tags_sql, tier_sql)
from formline import config
from formline.functions import scalars as S
from formline.operators import classify as C
from formline.operators import joins as J
from formline.sources import box as B

RANGES = {"1996-97": ("1996-10-22", "1997-06-22"), "1998-99": ("1998-10-28", "1999-06-21"), "open": ("2001-01-01", None)}


@query("filter_season", """SELECT game_id, game_date FROM q_box WHERE game_date BETWEEN DATE '1996-10-22' AND DATE '1997-06-22'""")
def filter_season(spark, sf):
    return B.filter_season(box(spark, sf), "game_date", "1996-97", RANGES).select("game_id", "game_date")


@query("union_seasons", """SELECT game_id FROM q_box WHERE game_date BETWEEN DATE '1996-10-22' AND DATE '1997-06-22'
    UNION ALL SELECT game_id FROM q_box WHERE game_date BETWEEN DATE '1998-10-28' AND DATE '1999-06-21'""")
def union_seasons(spark, sf):
    return B.union_seasons(box(spark, sf), "game_date", ["1996-97", "1998-99"], RANGES).select("game_id")


@query("filter_date", "SELECT event_id, cents FROM q_ev WHERE game_date = DATE '2024-01-15'")
def filter_date(spark, sf):
    return B.filter_date(events(spark, sf), "game_date", "2024-01-15").select("event_id", "cents")


@query("season_of_date", f"SELECT o_orderkey, {season_sql('o_orderdate')} AS season FROM orders")
def season_of_date(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.season_of(F.col("o_orderdate")).alias("season"))


def _codes(spark, sf):
    return table(spark, sf, "nation").filter("n_nationkey < 20").select(
        F.col("n_name").alias("name"), F.concat(F.lit("N"), "n_nationkey").alias("code"))


@query("map_code", """SELECT c_custkey, coalesce(k.code, 'UNK') AS team_code, upper(substr(n.n_name, 1, 3)) AS short_code
    FROM customer JOIN nation n ON c_nationkey = n.n_nationkey
    LEFT JOIN (SELECT n_name AS name, 'N' || CAST(n_nationkey AS VARCHAR) AS code FROM nation WHERE n_nationkey < 20) k ON k.name = n.n_name""")
def map_code(spark, sf):
    from formline.sources.odds import fallback_code

    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = J.map_code(people, F.col("n_name"), _codes(spark, sf), "team_code", F.lit("UNK"))
    return rows.select("c_custkey", "team_code", fallback_code(F.col("n_name")).alias("short_code"))


@query("unknown_codes", """SELECT count(*) FILTER (WHERE c_nationkey >= 20) AS unknown, count(*) AS n FROM customer""")
def unknown_codes(spark, sf):
    return map_code(spark, sf).agg(F.count_if(F.col("team_code") == "UNK").alias("unknown"), F.count(F.lit(1)).alias("n"))


@query("join_key", """SELECT game_id, strftime(game_date, '%Y-%m-%d') || '_' ||
    CASE WHEN home = 1 THEN 'N' || team ELSE 'N' || opponent END || '_' ||
    CASE WHEN home = 1 THEN 'N' || opponent ELSE 'N' || team END AS join_key FROM q_box""")
def join_key(spark, sf):
    def n(c):
        return F.concat(F.lit("N"), F.col(c).cast("string"))

    return box(spark, sf).select("game_id", S.join_key(F.col("game_date"), n("team"), n("opponent"), F.col("home")).alias("join_key"))


RAW_TYPE = {"PTS": "POINTS", "REB": "REBOUNDS", "AST": "ASSISTS", "3PM": "THREES"}


@query("normalize_type", """SELECT event_id, CASE event_type WHEN 'click' THEN 'PTS' WHEN 'view' THEN 'REB'
    WHEN 'purchase' THEN 'AST' WHEN 'signup' THEN '3PM' ELSE 'ERROR' END AS prop FROM events""")
def normalize_type(spark, sf):
    raw = S.case_of(F.col("event_type"), {"click": "POINTS", "view": "REBOUNDS", "purchase": "ASSISTS", "signup": "THREES"},
                    F.upper("event_type"))
    return table(spark, sf, "events").select("event_id", S.normalize_prop(raw).alias("prop"))


ODDS_SQL = """CASE WHEN odds IS NULL OR odds = 0 THEN 0.5 WHEN odds > 0 THEN 100.0::DOUBLE / (odds + 100)
    ELSE abs(odds)::DOUBLE / (abs(odds) + 100) END"""


@query("implied_prob", f"""SELECT game_id, prop, round(CAST({ODDS_SQL} AS DOUBLE), 6) AS implied,
    round(100::DOUBLE / (1 + game_id % 7), 6) AS decimal_pct FROM q_prop""")
def implied_prob(spark, sf):
    return prop_rows(spark, sf).select(
        "game_id", "prop", F.round(S.implied_probability(F.col("odds")), 6).alias("implied"),
        F.round(S.decimal_probability(1 + F.col("game_id") % 7), 6).alias("decimal_pct"))


@query("roi_from_odds", """SELECT prop, odds, round((acc * pay - (1 - acc)) * 100, 6) AS roi,
    round(acc * 1.91 - 1, 6) AS flat_ev, round(acc * 0.91 - (1 - acc), 6) AS slate_ev FROM
    (SELECT prop, odds, avg(outcome) AS acc, CASE WHEN odds < 0 THEN 100::DOUBLE / abs(odds) ELSE odds::DOUBLE / 100 END AS pay
     FROM q_lab WHERE odds IS NOT NULL GROUP BY prop, odds)""")
def roi_from_odds(spark, sf):
    acc = labelled(spark, sf).filter("odds IS NOT NULL").groupBy("prop", "odds").agg(F.avg("outcome").alias("acc"))
    a = F.col("acc")
    return acc.select("prop", "odds", F.round(S.roi_percent(a, F.col("odds")), 6).alias("roi"),
                      F.round(a * 1.91 - 1.0, 6).alias("flat_ev"), F.round(a * 0.91 - (1.0 - a), 6).alias("slate_ev"))


@query("label_outcome", """SELECT game_id, prop, line, actual, CASE WHEN actual IS NULL THEN NULL
    WHEN actual > line THEN 1 ELSE 0 END AS outcome FROM q_prop""")
def label_outcome(spark, sf):
    return prop_rows(spark, sf).select("game_id", "prop", "line", "actual",
                                       S.outcome(F.col("actual"), F.col("line")).alias("outcome"))


@query("drop_unlabelled", "SELECT game_id, prop, outcome FROM q_lab")
def drop_unlabelled(spark, sf):
    return label_outcome(spark, sf).dropna(subset=["outcome", "actual"]).select("game_id", "prop", "outcome")


@query("player_tier", f"""SELECT game_id, tier FROM ({tier_sql('q_feat')})""")
def player_tier(spark, sf):
    return C.player_tier(featured(spark, sf), "Season_Avg_PTS", "Season_Avg_MIN", "tier").select("game_id", "tier")


@query("tier_limits", """SELECT CAST(coalesce(nullif(quantile_disc("Season_Avg_PTS", 0.8), 0), 15) AS DOUBLE) AS p80_pts,
    CAST(coalesce(nullif(quantile_disc("Season_Avg_MIN", 0.8), 0), 30) AS DOUBLE) AS p80_min,
    CAST(coalesce(nullif(quantile_disc("Season_Avg_MIN", 0.6), 0), 25) AS DOUBLE) AS p60_min,
    CAST(coalesce(nullif(quantile_disc("Season_Avg_MIN", 0.4), 0), 20) AS DOUBLE) AS p40_min FROM q_feat""")
def tier_limits(spark, sf):
    return C.tier_limits(featured(spark, sf), "Season_Avg_PTS", "Season_Avg_MIN")


def _wide_props(spark, sf):
    rows = featured(spark, sf)
    return rows.withColumn("prop", F.explode(F.array(*[F.lit(p) for p in STATS])))


@query("reliability_tag", f"""SELECT game_id, prop, {RELIABILITY_SQL} AS "Reliability_Tag" FROM q_long""")
def reliability_tag(spark, sf):
    return C.reliability_tag(_wide_props(spark, sf), "prop").select("game_id", "prop", "Reliability_Tag")


TIER_NUM = "CASE tier WHEN 'STAR' THEN 3 WHEN 'STARTER' THEN 2 WHEN 'ROTATION' THEN 1 WHEN 'BENCH' THEN 0 ELSE 1 END"
REL_NUM = """CASE "Reliability_Tag" WHEN 'SNIPER' THEN 2 WHEN 'STANDARD' THEN 1 WHEN 'VOLATILE' THEN 0 ELSE 1 END"""


@query("encode_ordinal", f"""SELECT game_id, prop, {TIER_NUM} AS "Player_Tier_encoded", {REL_NUM} AS "Reliability_Tag_encoded" FROM q_log""")
def encode_ordinal(spark, sf):
    rows = C.encode_ordinal(tagged(spark, sf).withColumnRenamed("tier", "Player_Tier"))
    return rows.select("game_id", "prop", "Player_Tier_encoded", "Reliability_Tag_encoded")


@query("usage_tier", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount * 3 > 0.25 OR l_tax * 2 > 0.15 THEN 'STAR'
    WHEN l_discount * 3 > 0.22 OR l_tax * 2 > 0.12 THEN 'SECONDARY'
    WHEN l_discount * 3 > 0.18 OR l_tax * 2 > 0.08 THEN 'ROTATION' ELSE 'ROLE' END AS usage_tier FROM lineitem""")
def usage_tier(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.usage_tier(
        F.col("l_discount") * 3, F.col("l_tax") * 2).alias("usage_tier"))


def _gated(spark, sf):
    return tagged(spark, sf).withColumnRenamed("tier", "Player_Tier")


@query("quality_gate", """SELECT game_id, prop FROM q_log WHERE tier <> 'BENCH' AND "Reliability_Tag" <> 'VOLATILE'""")
def quality_gate(spark, sf):
    return C.quality_gate(_gated(spark, sf)).select("game_id", "prop")


@query("quality_gate_counts", """SELECT count(*) AS before, count(*) FILTER (WHERE tier <> 'BENCH') AS after_tier,
    count(*) FILTER (WHERE tier <> 'BENCH' AND "Reliability_Tag" <> 'VOLATILE') AS after_reliability FROM q_log""")
def quality_gate_counts(spark, sf):
    return C.gate_counts(_gated(spark, sf))


@query("edge_filter", f"""SELECT * FROM (SELECT game_id, prop, round(p - {ODDS_SQL}, 6) AS edge,
    CASE WHEN p - {ODDS_SQL} > 0 THEN 'OVER' WHEN p - {ODDS_SQL} < -0.05 THEN 'UNDER' ELSE 'NEUTRAL' END AS direction
    FROM q_pred) WHERE direction <> 'NEUTRAL'""")
def edge_filter(spark, sf):
    rows = predicted(spark, sf).withColumn("edge", F.col("p") - S.implied_probability(F.col("odds")))
    return C.edge_filter(rows).select("game_id", "prop", F.round("edge", 6).alias("edge"), "direction")


@query("confidence_scale", """SELECT game_id, prop, confidence,
    CAST(least(greatest(trunc(5 + 10 * abs(p - 0.5)), 5), 10) AS INTEGER) AS slate_confidence FROM q_pred""")
def confidence_scale(spark, sf):
    return predicted(spark, sf).select("game_id", "prop", S.ten_point_confidence(F.col("p")).alias("confidence"),
                                       S.five_to_ten_confidence(F.col("p")).alias("slate_confidence"))


ROUTE = """SELECT game_id, prop, (weak OR unsure OR tired OR wild) AND NOT (prop IN ('AST', '3PM') AND confidence2 >= 7 AND NOT tired) AS needs_review,
    CASE WHEN r = '' THEN 'edge case' ELSE r END AS reason FROM (SELECT *, concat_ws('; ', CASE WHEN weak THEN prop || ' model is weak' END,
    CASE WHEN unsure THEN 'low ML confidence (' || CAST(confidence2 AS VARCHAR) || ')' END, CASE WHEN tired THEN 'B2B game' END,
    CASE WHEN wild THEN 'volatile player' END) AS r FROM (SELECT *, prop IN ('PTS', 'REB') AS weak, confidence2 < 5 AS unsure,
    is_b2b = 1 AS tired, "Reliability_Tag" = 'VOLATILE' AS wild FROM q_log))"""


@query("route_review", ROUTE)
def route_review(spark, sf):
    return C.route_review(tagged(spark, sf), confidence="confidence2").select("game_id", "prop", "needs_review", "reason")


@query("route_shares", f"""SELECT needs_review, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS pct
    FROM ({ROUTE}) GROUP BY needs_review""")
def route_shares(spark, sf):
    return C.route_shares(route_review(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("matchup_context", """SELECT game_id, prop, round(coalesce("L5_Avg_MIN", 0) - coalesce("Season_Avg_MIN", 0), 6) AS minutes_trend,
    (a + b) / 2.0::DOUBLE AS projected_pace, (a + b) / 2.0::DOUBLE - 100 AS pace_vs_average,
    CASE WHEN d < 108 THEN 'Elite Defense' WHEN d < 112 THEN 'Good Defense' WHEN d < 115 THEN 'Average Defense' ELSE 'Weak Defense' END AS defence,
    CASE WHEN coalesce(l5, 0) - line > 2 THEN 'LOW' WHEN coalesce(l5, 0) - line < -2 THEN 'HIGH' ELSE 'FAIR' END AS line_band
    FROM (SELECT *, CASE WHEN game_id % 12 = 0 THEN 100 ELSE game_id % 12 + 94 END AS a, game_id % 9 + 95 AS b,
          CASE WHEN game_id % 15 = 0 THEN 110 ELSE game_id % 15 + 103 END AS d FROM q_prop)""")
def matchup_context(spark, sf):
    g = F.col("game_id")
    rows = prop_rows(spark, sf).withColumn("a", F.when(g % 12 == 0, 0).otherwise(g % 12 + 94)).withColumn(
        "b", g % 9 + 95).withColumn("d", F.when(g % 15 != 0, g % 15 + 103))
    out = C.matchup_context(rows, "L5_Avg_MIN", "Season_Avg_MIN", "a", "b", "d", "l5", "line")
    return out.select("game_id", "prop", F.round("minutes_trend", 6).alias("minutes_trend"), "projected_pace",
                      "pace_vs_average", "defence", "line_band")


@query("context_tags", f"SELECT game_id, prop, {tags_sql()} AS tags FROM q_prop")
def context_tags(spark, sf):
    from bindings.base import row_tags

    return prop_rows(spark, sf).select("game_id", "prop", F.array_join(row_tags(), ",").alias("tags"))


SEVERITY = """SELECT *, CASE WHEN abs(miss_margin) < 1 OR miss_pct < 10 THEN 'MINOR' WHEN abs(miss_margin) < 2 OR miss_pct < 25
    THEN 'MODERATE' ELSE 'MAJOR' END AS severity FROM (SELECT *, CASE WHEN line > 0 THEN abs(miss_margin) / line * 100 ELSE 0 END AS miss_pct
    FROM (SELECT *, CASE WHEN side = 'OVER' THEN actual - line ELSE line - actual END AS miss_margin FROM q_pred))"""


@query("miss_severity", f"SELECT game_id, prop, miss_margin, round(miss_pct, 6) AS miss_pct, severity FROM ({SEVERITY})")
def miss_severity(spark, sf):
    rows = C.add_severity(predicted(spark, sf), "actual", "line", "side")
    return rows.select("game_id", "prop", "miss_margin", F.round("miss_pct", 6).alias("miss_pct"), "severity")


def _group_sql() -> str:
    out = "CASE "
    for g, frags in config.FEATURE_GROUPS:
        out += f"WHEN {' OR '.join(f'contains(low, {chr(39)}{f}{chr(39)})' for f in frags)} THEN '{g}' "
    return out + "ELSE 'Other' END"


@query("feature_category", f"""SELECT name, {_group_sql()} AS category FROM (SELECT name, lower(name) AS low FROM
    (SELECT DISTINCT p_name || '_' || p_type || CASE p_size % 9 WHEN 0 THEN '_L5_Avg' WHEN 1 THEN '_Opp_Rank' WHEN 2 THEN '_Pace'
     WHEN 3 THEN '_is_b2b' WHEN 4 THEN '_Home' WHEN 5 THEN '_Line' WHEN 6 THEN '_Tier' WHEN 7 THEN '_TS_Pct' ELSE '' END AS name FROM part))""")
def feature_category(spark, sf):
    tail = S.case_of(F.col("p_size") % 9, {0: "_L5_Avg", 1: "_Opp_Rank", 2: "_Pace", 3: "_is_b2b", 4: "_Home", 5: "_Line",
                                          6: "_Tier", 7: "_TS_Pct"}, F.lit(""))
    names = table(spark, sf, "part").select(F.concat("p_name", F.lit("_"), "p_type", tail).alias("name")).distinct()
    return names.withColumn("category", S.feature_group(F.col("name")))


@query("impute_median", """SELECT game_id, round(coalesce("Season_Avg_PTS", (SELECT quantile_disc("Season_Avg_PTS", 0.5) FROM q_feat
    WHERE game_date < DATE '1999-01-01')), 6) AS "Season_Avg_PTS", round(coalesce("L5_Avg_MIN", (SELECT quantile_disc("L5_Avg_MIN", 0.5)
    FROM q_feat WHERE game_date < DATE '1999-01-01')), 6) AS "L5_Avg_MIN" FROM q_feat""")
def impute_median(spark, sf):
    rows = featured(spark, sf).select("game_id", "game_date", "Season_Avg_PTS", "L5_Avg_MIN")
    train = rows.filter(F.col("game_date") < F.lit("1999-01-01").cast("date"))
    return C.impute_median(train, rows, ["Season_Avg_PTS", "L5_Avg_MIN"]).select("game_id", *r6("Season_Avg_PTS", "L5_Avg_MIN"))


@query("fill_numeric_zero", """SELECT game_id, coalesce(points, 0) AS points, round(coalesce("L5_Avg_PTS", 0), 6) AS "L5_Avg_PTS", c_name FROM q_feat""")
def fill_numeric_zero(spark, sf):
    rows = featured(spark, sf).select("game_id", "points", "L5_Avg_PTS", "c_name")
    return C.fill_numeric_zero(rows, ("game_id",)).withColumn("L5_Avg_PTS", F.round("L5_Avg_PTS", 6))


@query("shape_schema", f"""SELECT game_id, entity_id, {r6_sql("L5_Avg_PTS", "L5_Avg_REB")}, home FROM q_feat""")
def shape_schema(spark, sf):
    rows = featured(spark, sf).select("home", F.col("game_date").alias("gameLabel"), *r6("L5_Avg_PTS", "L5_Avg_REB"),
                                      "entity_id", "game_id", F.col("home") + 1)
    rows = rows.toDF(*rows.columns[:-1], "home")
    return C.shape_schema(rows, ["game_id", "entity_id"], prefixes=["L5_Avg"])


@query("actuals_projection", """SELECT entity_id AS "personId", game_id AS "gameId", game_date, points, assists, tov AS turnovers FROM q_box""")
def actuals_projection(spark, sf):
    rows = box(spark, sf).withColumnsRenamed({"entity_id": "personId", "game_id": "gameId", "tov": "turnovers"})
    return B.actuals(rows)


# of the model's list, the features of the player's own games; the others come from team, line and tier
OWN = [c for c in config.model_features("PTS") if not re.match("Opp_|Player_|Reliability_|Form_|Line|.*_SameVenue", c)]


@query("feature_select", f"""SELECT game_id, home, is_b2b, CAST(rest_days AS BIGINT) AS rest_days, {r6_sql(*[c for c in OWN if "_Avg_" in c or "_StdDev_" in c])}
    FROM q_feat""")
def feature_select(spark, sf):
    rows = featured(spark, sf)
    names = C.feature_select(rows, OWN)
    return rows.select("game_id", *[F.round(c, 6).alias(c) if "_" in c and c[0] in "LS" else F.col(c).cast("long" if c == "rest_days" else "int").alias(c)
                                    for c in names])


@query("parse_times", """SELECT event_id, CAST(timezone('America/New_York', ts AT TIME ZONE 'UTC') AS DATE) AS local_day,
    CAST(ts AS DATE) AS utc_day, CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-11' AS in_window FROM events""")
def parse_times(spark, sf):
    rows = table(spark, sf, "events")
    ts = F.col("ts").cast("timestamp")
    text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    parsed = F.to_date(S.parse_time(text))
    day = F.lit("2024-01-10").cast("date")
    return rows.select("event_id", S.game_day_eastern(ts).alias("local_day"), parsed.alias("utc_day"),
                       parsed.between(day, F.date_add(day, 1)).alias("in_window"))
