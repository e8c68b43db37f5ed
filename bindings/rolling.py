"""Window features over events (user x time) and orders (customer x order)."""

from pyspark.sql import functions as F

from bindings.base import (ENTITY, ORDER, STATS, box, events, featured, query, r6, r6_sql, season_sql, team_days,
                           windows_sql)
from formline.functions import scalars as S
from formline.operators import features as X
from formline.operators.ordered import Frame, rolling, top_n

EV_ORDER = ["ts", "event_id"]


def ev_window(keys: str, n) -> str:
    start = "UNBOUNDED" if n is None else str(n)
    return f"(PARTITION BY {keys} ORDER BY ts, event_id ROWS BETWEEN {start} PRECEDING AND 1 PRECEDING)"


def _events(spark, sf):
    return events(spark, sf).withColumn("season", S.season_of(F.col("game_date")))


@query("rolling_mean", f"""
    SELECT event_id, round(avg(cents) OVER {ev_window('entity_id', 5)}, 6) AS "L5_Avg_V",
           round(avg(k) OVER {ev_window('entity_id', 5)}, 6) AS "L5_Avg_K",
           round(avg(cents) OVER {ev_window('entity_id', 10)}, 6) AS "L10_Avg_V",
           round(avg(k) OVER {ev_window('entity_id', 10)}, 6) AS "L10_Avg_K",
           round(avg(cents) OVER {ev_window('entity_id, season', None)}, 6) AS "Season_Avg_V",
           round(avg(k) OVER {ev_window('entity_id, season', None)}, 6) AS "Season_Avg_K"
    FROM (SELECT *, {season_sql('game_date')} AS season FROM q_ev)""")
def rolling_mean(spark, sf):
    rows = X.rolling_mean(_events(spark, sf), ENTITY, EV_ORDER, {"V": "cents", "K": "k"}, "season")
    return rows.select("event_id", *r6(*[f"{w}_Avg_{s}" for w in ("L5", "L10", "Season") for s in "VK"]))


@query("rolling_mean_orders", f"""
    SELECT game_id, {r6_sql(*[f"{w}_Avg_{s}" for w in ("L5", "L10", "Season") for s in (*STATS, "MIN")])} FROM q_feat""")
def rolling_mean_orders(spark, sf):
    rows = X.rolling_mean(box(spark, sf), ENTITY, ORDER, {**STATS, "MIN": "minutes"}, "season")
    return rows.select("game_id", *r6(*[f"{w}_Avg_{s}" for w in ("L5", "L10", "Season") for s in (*STATS, "MIN")]))


@query("rolling_mean_split", f"""
    SELECT event_id, round(avg(cents) OVER {ev_window('entity_id, team', 5)}, 6) AS "L5_Avg_V_SameVenue",
           round(avg(cents) OVER {ev_window('entity_id, team, season', None)}, 6) AS "Season_Avg_V_SameVenue"
    FROM (SELECT *, {season_sql('game_date')} AS season FROM q_ev)""")
def rolling_mean_split(spark, sf):
    rows = X.rolling_mean_split(_events(spark, sf), ENTITY, "team", EV_ORDER, {"V": "cents"}, "season")
    return rows.select("event_id", *r6("L5_Avg_V_SameVenue", "Season_Avg_V_SameVenue"))


@query("rolling_std", f"""
    SELECT event_id, round(stddev_samp(cents) OVER {ev_window('entity_id', 5)}, 6) AS "L5_StdDev_V",
           round(stddev_samp(cents) OVER {ev_window('entity_id', 10)}, 6) AS "L10_StdDev_V" FROM q_ev""")
def rolling_std(spark, sf):
    rows = X.rolling_std(events(spark, sf), ENTITY, EV_ORDER, {"V": "cents"})
    return rows.select("event_id", *r6("L5_StdDev_V", "L10_StdDev_V"))


@query("form_delta", """
    SELECT game_id, """ + ", ".join(
    f'round("L5_Avg_{s}" - "Season_Avg_{s}", 6) AS "Form_{s}"' for s in STATS) + " FROM q_feat")
def form_delta(spark, sf):
    rows = X.form_delta(X.rolling_mean(box(spark, sf), ENTITY, ORDER, STATS, "season"), list(STATS))
    return rows.select("game_id", *r6(*[f"Form_{s}" for s in STATS]))


def _rates():
    c = F.col
    return X.game_rates(c("fga"), c("fta"), c("fg3a"), c("fgm"), c("threes"), c("tov"),
                        {s: c(v) for s, v in STATS.items()})


RATE_SQL = {
    "Poss": "poss", "TS_Pct": "CASE WHEN shots > 0 THEN points / (2.0 * shots) END",
    "eFG_Pct": "CASE WHEN fga > 0 THEN (fgm + 0.5 * threes)::DOUBLE / fga END",
    "3PA_Rate": "CASE WHEN fga > 0 THEN fg3a::DOUBLE / fga END",
    "FT_Rate": "CASE WHEN fga > 0 THEN fta::DOUBLE / fga END",
    **{f"{s}_per100": f"CASE WHEN poss > 0 THEN {c} / poss * 100 END" for s, c in STATS.items()},
}
SHOTS_SQL = "SELECT *, shots + tov AS poss FROM (SELECT *, fga + CAST(0.44 AS DOUBLE) * fta AS shots FROM q_box)"


@query("game_rates", "SELECT game_id, " + ", ".join(
    f'round({e}, 6) AS "{n}"' for n, e in RATE_SQL.items()) + f" FROM ({SHOTS_SQL})")
def game_rates(spark, sf):
    return box(spark, sf).select("game_id", *[F.round(c, 6).alias(n) for n, c in _rates().items()])


@query("rolling_rates", "SELECT game_id, " + ", ".join(
    f'round(avg({e}) OVER w, 6) AS "Player_{n}"' for n, e in RATE_SQL.items()) + f""" FROM ({SHOTS_SQL})
    WINDOW w AS (PARTITION BY entity_id ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def rolling_rates(spark, sf):
    rows = X.rolling_rates(box(spark, sf), ENTITY, ORDER, _rates())
    return rows.select("game_id", *r6(*[f"Player_{n}" for n in RATE_SQL]))


@query("rest_days", """SELECT game_id, CAST(rest_days AS INTEGER) AS rest_days, CAST(is_b2b AS INTEGER) AS is_b2b
    FROM q_feat""")
def rest_days(spark, sf):
    return X.rest_days(box(spark, sf), ENTITY, ORDER, "game_date").select("game_id", "rest_days", "is_b2b")


TAKE = ["fga", "fta", "oreb", "tov", "reb", "ast", "fg3a"]


def _joined(spark, sf):
    return X.opponent_rows(team_days(spark, sf), "game_date", "team", "opponent", TAKE)


JOINED_SQL = ("SELECT t.*, " + ", ".join(f"o.{c} AS o_{c}" for c in TAKE)
              + " FROM q_team t LEFT JOIN q_team o ON t.game_date = o.game_date AND t.team = o.opponent")


@query("opponent_self_join", f"SELECT game_date, team, fga, {', '.join('o_' + c for c in TAKE)} FROM ({JOINED_SQL})")
def opponent_self_join(spark, sf):
    return _joined(spark, sf).select("game_date", "team", "fga", *[f"o_{c}" for c in TAKE])


METRIC_SQL = {
    "Team_Pace": "CASE WHEN minutes <> 0 THEN CAST(48.0 AS DOUBLE) * ((mine + theirs) / 2) / (minutes / 5) END",
    "Team_Def_Rating": "CASE WHEN mine <> 0 THEN allowed * 100 / mine END",
    "Allowed_PTS": "allowed", "Allowed_REB": "o_reb", "Allowed_AST": "o_ast", "Allowed_3PA": "o_fg3a",
    "Opp_Def_Rating": "CASE WHEN theirs <> 0 THEN score * 100 / theirs END",
}
POSS_SQL = f"""SELECT *, fga + CAST(0.44 AS DOUBLE) * fta - oreb + tov AS mine,
    o_fga + CAST(0.44 AS DOUBLE) * o_fta - o_oreb + o_tov AS theirs FROM ({JOINED_SQL})"""
GAME_SQL = "SELECT *, " + ", ".join(f'{e} AS "{m}_Game"' for m, e in METRIC_SQL.items()) + f" FROM ({POSS_SQL})"


@query("team_rates", "SELECT game_date, team, " + ", ".join(
    f'CAST(round("{m}_Game", 6) AS DOUBLE) AS "{m}_Game"' for m in X.TEAM_METRICS) + f" FROM ({GAME_SQL})")
def team_rates(spark, sf):
    rows = X.team_rates(_joined(spark, sf))
    return rows.select("game_date", "team", *[
        F.round(F.col(f"{m}_Game").cast("double"), 6).alias(f"{m}_Game") for m in X.TEAM_METRICS])


def _team_window(n) -> str:
    start = "UNBOUNDED" if n is None else str(n)
    return f"(PARTITION BY team ORDER BY game_date ROWS BETWEEN {start} PRECEDING AND 1 PRECEDING)"


ROLLED_SQL = "SELECT *, " + ", ".join(
    f'avg("{m}_Game") OVER {_team_window(n)} AS "{lab}_{m}"' for lab, n in X.SPANS for m in X.TEAM_METRICS
) + f" FROM ({GAME_SQL})"
TEAM_COLS = [f"{lab}_{m}" for lab, _ in X.SPANS for m in X.TEAM_METRICS]


def team_context(spark, sf):
    rows = X.rolling_team(X.team_rates(_joined(spark, sf)), ["team"], ["game_date"])
    return rows


@query("rolling_team", f"SELECT game_date, team, {r6_sql(*TEAM_COLS)} FROM ({ROLLED_SQL})")
def rolling_team(spark, sf):
    return team_context(spark, sf).select("game_date", "team", *r6(*TEAM_COLS))


RANKS = {**{f"Rank_Allows_{s}": (f'round("Season_Allowed_{s}", 9)', "DESC NULLS LAST") for s in ("PTS", "REB", "AST", "3PA")},
         "Team_Def_Rank": ('round("Season_Team_Def_Rating", 9)', "ASC NULLS FIRST")}


@query("daily_rank", "SELECT game_date, team, " + ", ".join(
    f'CAST(rank() OVER (PARTITION BY game_date ORDER BY {c} {d}) AS INTEGER) AS "{n}"' for n, (c, d) in RANKS.items())
    + f" FROM ({ROLLED_SQL})")
def daily_rank(spark, sf):
    rows = team_context(spark, sf)
    for s in ("Allowed_PTS", "Allowed_REB", "Allowed_AST", "Allowed_3PA", "Team_Def_Rating"):
        rows = rows.withColumn(f"Season_{s}", F.round(f"Season_{s}", 9))
    return X.daily_rank(rows, "game_date").select("game_date", "team", *RANKS)


@query("latest_features", f"""SELECT entity_id, game_id, {r6_sql("L5_Avg_PTS", "L10_StdDev_PTS")} FROM q_feat
    QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY game_date DESC, game_id DESC) = 1""")
def latest_features(spark, sf):
    rows = top_n(featured(spark, sf), ENTITY, ["-game_date", "-game_id"], 1)
    return rows.select("entity_id", "game_id", *r6("L5_Avg_PTS", "L10_StdDev_PTS"))


@query("season_first_rows", f"""SELECT game_id, CAST(count(points) OVER ws AS BIGINT) AS earlier,
    round(avg(points) OVER ws, 6) AS prior_mean FROM q_box {windows_sql()}""")
def season_first_rows(spark, sf):
    """A season's first row has no prior mean and its second has the first row's value."""
    rows = rolling(box(spark, sf), ["entity_id", "season"], ORDER,
                   [Frame("earlier", "count", "points"), Frame("prior_mean", "mean", "points")])
    return rows.select("game_id", "earlier", *r6("prior_mean"))
