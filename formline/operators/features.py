"""Features of an entity as of before each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.operators.ordered import Frame, ranked, rolling

SPANS = (("L5", 5), ("L10", 10), ("Season", None))


def mean_frames(stats: dict[str, str], season: str | None = None, spans=SPANS, suffix: str = "",
                infix: str = "_Avg_", by: tuple[str, ...] = ()) -> list[Frame]:
    """Frames for every (span, stat): ``{"PTS": "points"}`` gives ``L5_Avg_PTS`` and so on. The
    unbounded span restarts with the ``season`` column where one is given."""
    frames = []
    for label, rows in spans:
        keys = (*by, season) if season and rows is None else by
        frames += [Frame(f"{label}{infix}{stat}{suffix}", "mean", col, rows, keys) for stat, col in stats.items()]
    return frames


def std_frames(stats: dict[str, str], spans=SPANS[:2]) -> list[Frame]:
    return [
        Frame(f"{label}_StdDev_{stat}", "std", col, rows)
        for label, rows in spans
        for stat, col in stats.items()
    ]


def rolling_mean(df: DataFrame, entity: list[str], order: list[str], stats: dict[str, str],
                 season: str | None = None) -> DataFrame:
    """Last-5, last-10 and season-to-date means."""
    return rolling(df, entity, order, mean_frames(stats, season))


def venue_frames(stats: dict[str, str], split: str, season: str | None = None) -> list[Frame]:
    return mean_frames(stats, season, (SPANS[0], SPANS[2]), "_SameVenue", by=(split,))


def rolling_mean_split(df: DataFrame, entity: list[str], split: str, order: list[str],
                       stats: dict[str, str], season: str | None = None) -> DataFrame:
    """The same inside one context (home or away): last 5 and season to date."""
    return rolling(df, entity, order, venue_frames(stats, split, season))


def rolling_std(df: DataFrame, entity: list[str], order: list[str], stats: dict[str, str]) -> DataFrame:
    return rolling(df, entity, order, std_frames(stats))


def form_delta(df: DataFrame, stats: list[str]) -> DataFrame:
    """Recent mean minus season mean."""
    return df.select(
        "*", *[(F.col(f"L5_Avg_{s}") - F.col(f"Season_Avg_{s}")).alias(f"Form_{s}") for s in stats]
    )


def game_rates(fga: Column, fta: Column, fg3a: Column, fgm: Column, fg3m: Column, tov: Column,
               stats: dict[str, Column]) -> dict[str, Column]:
    """Efficiency of a single row; null where the denominator is not positive."""
    shots = fga + 0.44 * fta
    poss = shots + tov
    rates = {
        "Poss": poss,
        "TS_Pct": F.when(shots > 0, stats["PTS"] / (2.0 * shots)),
        "eFG_Pct": F.when(fga > 0, (fgm + 0.5 * fg3m) / fga),
        "3PA_Rate": F.when(fga > 0, fg3a / fga),
        "FT_Rate": F.when(fga > 0, fta / fga),
    }
    for name, c in stats.items():
        rates[f"{name}_per100"] = F.when(poss > 0, c / poss * 100.0)
    return rates


def rolling_rates(df: DataFrame, entity: list[str], order: list[str], rates: dict[str, Column]) -> DataFrame:
    """Prior mean of each single-row rate as ``Player_*``; the raw rates do not leave."""
    raw = df.select("*", *[c.alias(f"__r_{n}") for n, c in rates.items()])
    frames = [Frame(f"Player_{n}", "mean", f"__r_{n}") for n in rates]
    return rolling(raw, entity, order, frames).drop(*[f"__r_{n}" for n in rates])


def rest_days(df: DataFrame, entity: list[str], order: list[str], day: str, first: int = 7) -> DataFrame:
    """Days since the entity's previous row (``first`` where there is none) and the b2b flag."""
    rows = rolling(df, entity, order, [Frame("__prev", "lag", day, 1)])
    rest = F.coalesce(F.datediff(F.col(day), F.col("__prev")), F.lit(first))
    return rows.withColumn("rest_days", rest).withColumn(
        "is_b2b", (F.col("rest_days") == 1).cast("int")
    ).drop("__prev")


def possessions(fga: Column, fta: Column, oreb: Column, tov: Column) -> Column:
    return fga + 0.44 * fta - oreb + tov


def opponent_rows(team: DataFrame, game: str, me: str, opponent: str, take: list[str],
                  prefix: str = "o_") -> DataFrame:
    """Left self-join: the row of the same game whose opponent I am."""
    other = team.select(
        F.col(game).alias("__game"), F.col(opponent).alias("__their_opponent"),
        *[F.col(c).alias(prefix + c) for c in take],
    )
    cond = (team[game] == other["__game"]) & (team[me] == other["__their_opponent"])
    return team.join(other, cond, "left").drop("__game", "__their_opponent")


TEAM_METRICS = ["Team_Pace", "Team_Def_Rating", "Allowed_PTS", "Allowed_REB", "Allowed_AST",
                "Allowed_3PA", "Opp_Def_Rating"]


def team_rates(joined: DataFrame) -> DataFrame:
    """Pace, ratings and what was allowed in the game itself (intermediate, never a feature)."""
    c = F.col
    mine = possessions(c("fga"), c("fta"), c("oreb"), c("tov"))
    theirs = possessions(c("o_fga"), c("o_fta"), c("o_oreb"), c("o_tov"))
    minutes = c("minutes") / 5.0
    return joined.select(
        "*",
        F.when(minutes != 0, 48.0 * ((mine + theirs) / 2.0) / minutes).alias("Team_Pace_Game"),
        F.when(mine != 0, c("allowed") * 100.0 / mine).alias("Team_Def_Rating_Game"),
        c("allowed").alias("Allowed_PTS_Game"),
        c("o_reb").alias("Allowed_REB_Game"),
        c("o_ast").alias("Allowed_AST_Game"),
        c("o_fg3a").alias("Allowed_3PA_Game"),
        F.when(theirs != 0, c("score") * 100.0 / theirs).alias("Opp_Def_Rating_Game"),
    )


def rolling_team(df: DataFrame, entity: list[str], order: list[str], season: str | None = None) -> DataFrame:
    """Last-5, last-10 and season-to-date means of the seven team metrics."""
    stats = {m: f"{m}_Game" for m in TEAM_METRICS}
    return rolling(df, entity, order, mean_frames(stats, season, infix="_"))


def daily_rank(df: DataFrame, day: str) -> DataFrame:
    """Rank within the day by season-prior figures: 1 allows most; 1 has the lowest rating."""
    ranks = {f"Rank_Allows_{s}": [f"-Season_Allowed_{s}"] for s in ("PTS", "REB", "AST", "3PA")}
    return ranked(df, [day], {**ranks, "Team_Def_Rank": ["Season_Team_Def_Rating"]})
