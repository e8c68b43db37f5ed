"""Pair relations and slips."""

from __future__ import annotations

import functools
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUBSETS = ("all", "narrow", "top", "top_narrow")


def pair_correlation(picks: DataFrame, slate: str) -> DataFrame:
    """Number of pick pairs per slate and relation, by inclusion and exclusion: no pair is formed and nothing is joined.

    Pairs of one team are counted from group sizes, opposing pairs from how often a team is a team and an opponent, and pairs
    where either pick has a wide spread as all pairs less those of narrow picks. Pairs of two scoring overs are the same
    counts within those picks alone.
    """
    wide = F.abs(F.coalesce(F.col("spread"), F.lit(0))) > 12
    over = F.coalesce(F.col("side") == "OVER", F.lit(False))
    top = over & (F.coalesce(F.col("total"), F.lit(0)) > 235)
    member = dict(zip(SUBSETS, (F.lit(True), ~wide, top, top & ~wide), strict=True))
    sizes = picks.groupBy(slate, "team", "opponent", "prop", over.alias("over")).agg(
        *[F.count_if(m).alias(f"n_{s}") for s, m in member.items()])
    parts = [_team_pairs(sizes, slate), _one_way(sizes, slate), _both_ways(sizes, slate)]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    names = [c for c in every.columns if c != slate]
    sums = every.groupBy(slate).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])

    def at(name: str, subset: str) -> Column:
        return F.col(f"{name}_{subset}")

    def wide_opponents(subset: str, narrow: str) -> Column:
        """Opposing pairs with a wide spread that no rule for one team takes first."""
        def opposing(s: str) -> Column:
            return at("one_way", s) - at("both_ways", s) - at("own", s)
        return opposing(subset) - opposing(narrow)

    crowd = at("crowd", "all") + wide_opponents("all", "narrow")
    scoring = at("pairs", "top") - at("crowd", "top") - at("mates", "top") - wide_opponents("top", "top_narrow")
    positive = at("mates", "all") + scoring
    counts = {"negative": crowd, "positive": positive, "neutral": at("pairs", "all") - crowd - positive}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("relation"), v.cast("long").alias("pairs")) for k, v in counts.items()]))
    return sums.select(slate, rows.alias("r")).select(slate, "r.*").filter("pairs > 0")


def _pairs(n: Column) -> Column:
    return F.floor(n * (n - 1) / F.lit(2))


def _team_pairs(sizes: DataFrame, slate: str) -> DataFrame:
    """Per slate: pairs of all; of one team, pairs on one prop over (``crowd``) and points with assists (``mates``); and those
    of the two with an own team as opponent (``own``)."""
    self_ = F.coalesce(F.col("team") == F.col("opponent"), F.lit(False))
    props = sizes.groupBy(slate, "team", "prop").agg(*[
        F.sum(F.when(cond, F.col(f"n_{s}")).otherwise(0)).alias(f"{k}_{s}") for s in SUBSETS
        for k, cond in (("n", F.lit(True)), ("over", F.col("over")), ("over_own", F.col("over") & self_), ("own", self_))])
    real = F.col("team").isNotNull() & F.col("prop").isNotNull()
    teams = props.groupBy(slate, "team").agg(*[c for s in SUBSETS for c in (
        F.sum(f"n_{s}").alias(f"n_{s}"),
        F.sum(F.when(real, _pairs(F.col(f"over_{s}"))).otherwise(0)).alias(f"crowd_{s}"),
        F.sum(F.when(real, _pairs(F.col(f"over_{s}")) - _pairs(F.col(f"over_{s}") - F.col(f"over_own_{s}"))).otherwise(0)).alias(f"crowd_own_{s}"),
        *[F.sum(F.when(real & (F.col("prop") == prop), F.col(f"{k}_{s}")).otherwise(0)).alias(f"{k}_{prop}_{s}")
          for prop in ("POINTS", "ASSISTS") for k in ("n", "own")])])
    columns = []
    for s in SUBSETS:
        p, a, po, ao = (F.col(f"{k}_{prop}_{s}") for k in ("n", "own") for prop in ("POINTS", "ASSISTS"))
        n = F.sum(f"n_{s}")
        columns += [_pairs(n).alias(f"pairs_{s}"), F.sum(f"crowd_{s}").alias(f"crowd_{s}"), F.sum(p * a).alias(f"mates_{s}"),
                    F.sum(F.col(f"crowd_own_{s}") + p * a - (p - po) * (a - ao)).alias(f"own_{s}")]
    return teams.groupBy(slate).agg(*columns)


def _one_way(sizes: DataFrame, slate: str) -> DataFrame:
    """Per slate: ordered pairs in which the opponent of the first is the team of the second."""
    def roles(column: str, role: str) -> DataFrame:
        other = {"team": "opponent", "opponent": "team"}[column]
        same = F.col(column) == F.col(other)
        return sizes.filter(F.col(column).isNotNull()).select(slate, F.col(column).alias("club"), *[
            (F.col(f"n_{s}") if k == role else F.when(same, F.col(f"n_{s}")).otherwise(0) if (k, role) == ("self", "team") else F.lit(0))
            .cast("long").alias(f"{k}_{s}") for s in SUBSETS for k in ("team", "opponent", "self")])
    clubs = roles("team", "team").unionByName(roles("opponent", "opponent"))
    summed = clubs.groupBy(slate, "club").agg(*[F.sum(c).alias(c) for c in clubs.columns if c not in (slate, "club")])
    return summed.groupBy(slate).agg(*[
        F.sum(F.col(f"team_{s}") * F.col(f"opponent_{s}") - F.col(f"self_{s}")).alias(f"one_way_{s}") for s in SUBSETS])


def _both_ways(sizes: DataFrame, slate: str) -> DataFrame:
    """Per slate: pairs in which each is the other's opponent."""
    known = sizes.filter("team is not null and opponent is not null")
    low, high = F.least("team", "opponent"), F.greatest("team", "opponent")
    games = known.groupBy(slate, low.alias("low"), high.alias("high")).agg(*[
        F.sum(F.when(cond, F.col(f"n_{s}")).otherwise(0)).alias(f"{k}_{s}") for s in SUBSETS
        for k, cond in (("first", F.col("team") <= F.col("opponent")), ("second", F.col("team") > F.col("opponent")))])
    return games.groupBy(slate).agg(*[
        F.sum(F.when(F.col("low") == F.col("high"), _pairs(F.col(f"first_{s}"))).otherwise(F.col(f"first_{s}") * F.col(f"second_{s}")))
        .alias(f"both_ways_{s}") for s in SUBSETS])


def _same(a, b) -> bool:
    """Equality as in SQL: a missing value equals nothing."""
    return a is not None and b is not None and a == b


def negative(p: dict, q: dict) -> bool:
    """The two rules that forbid a pair, for the scan of one small slate; a missing spread counts as 0."""
    together = _same(p["team"], q["team"])
    if together and _same(p["prop"], q["prop"]) and p["side"] == "OVER" == q["side"]:
        return True
    mates = together and {p["prop"], q["prop"]} == {"POINTS", "ASSISTS"}
    opposing = _same(p["opponent"], q["team"]) or _same(p["team"], q["opponent"])
    wide = max(abs(p["spread"]), abs(q["spread"])) > 12
    return bool(not mates and opposing and wide)


def _records(pdf: pd.DataFrame, order: list[str]) -> list[dict]:
    keys = [c.lstrip("-") for c in order]
    pdf = pdf.sort_values(keys, ascending=[not c.startswith("-") for c in order])
    names = {c: pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("team", "opponent", "prop", "side")}
    return pdf.assign(spread=pdf["spread"].astype(float).fillna(0.0), **names).to_dict("records")


def _frame(slips: list[list[dict]], slate_value, slate: str, key: str) -> pd.DataFrame:
    rows = [
        {slate: slate_value, "slip": i + 1, "leg": j + 1, key: leg[key]}
        for i, s in enumerate(slips)
        for j, leg in enumerate(s)
    ]
    return pd.DataFrame(rows, columns=[slate, "slip", "leg", key])


def _queues(legs: list[dict]) -> tuple[list[int], dict[int, deque], list[dict]]:
    """Class of each leg, places of each class in order, and a leg of each class. Legs of a class relate alike to all others,
    so a slate is matched class by class."""
    number: dict[tuple, int] = {}
    kinds, queues, sample = [], {}, []
    for i, leg in enumerate(legs):
        key = (leg["team"], leg["opponent"], leg["prop"], leg["side"], abs(leg["spread"]) > 12)
        if key not in number:
            number[key] = len(number)
            sample.append(leg)
        kinds.append(number[key])
        queues.setdefault(number[key], deque()).append(i)
    return kinds, queues, sample


def power_slips(picks: DataFrame, slate: str, key: str, order: list[str], size: int = 2) -> DataFrame:
    """Short slips, each pick used once: the first free pick leads, the next free ones that suit it follow. ``picks`` is a
    selected slate; its time is the number of picks times that of classes."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        legs = _records(pdf, order)
        kinds, queues, sample = _queues(legs)
        suits = functools.cache(lambda a: [b for b in queues if not negative(sample[a], sample[b])])
        slips = []
        for i, lead in enumerate(legs):
            mine = queues[kinds[i]]
            if not mine or mine[0] != i:
                continue  # used before: places of a class are used in order
            mine.popleft()
            slip = [lead]
            while len(slip) < size:
                heads = [(queues[b][0], b) for b in suits(kinds[i]) if queues[b]]
                if not heads:
                    break
                at, kind = min(heads)
                queues[kind].popleft()
                slip.append(legs[at])
            if len(slip) == size:
                slips.append(slip)
        return _frame(slips, pdf[slate].iloc[0], slate, key)

    return _apply(picks, slate, key, build)


def flex_slips(picks: DataFrame, slate: str, key: str, order: list[str], size: int = 5) -> DataFrame:
    """Long slips filled in order, no negative pair inside."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        slips, open_slip = [], []
        if len(pdf) >= size:
            for pick in _records(pdf, order):
                if all(not negative(leg, pick) for leg in open_slip):
                    open_slip.append(pick)
                if len(open_slip) == size:
                    slips.append(open_slip)
                    open_slip = []
        return _frame(slips, pdf[slate].iloc[0], slate, key)

    return _apply(picks, slate, key, build)


def _apply(picks: DataFrame, slate: str, key: str, build) -> DataFrame:
    kinds = dict(picks.dtypes)
    return picks.groupBy(slate).applyInPandas(
        build, f"{slate} {kinds[slate]}, slip int, leg int, {key} {kinds[key]}"
    )


def safe_slip(legs: Column) -> Column:
    """True where no two legs of an array of picks relate negatively."""

    def clash(p: Column, q: Column) -> Column:
        same_team = p["team"] == q["team"]
        crowd = same_team & (p["prop"] == q["prop"]) & (p["side"] == "OVER") & (q["side"] == "OVER")
        mates = same_team & F.array_contains(F.array(p["prop"], q["prop"]), "POINTS") & F.array_contains(
            F.array(p["prop"], q["prop"]), "ASSISTS"
        )
        opposing = (p["opponent"] == q["team"]) | (p["team"] == q["opponent"])
        wide = F.greatest(F.abs(F.coalesce(p["spread"], F.lit(0.0))), F.abs(F.coalesce(q["spread"], F.lit(0.0)))) > 12
        return crowd | (~mates & opposing & wide)

    return ~F.exists(legs, lambda p: F.exists(legs, lambda q: (p["pick"] < q["pick"]) & clash(p, q)))
