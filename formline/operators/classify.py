"""Tiers, tags, gates and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline import config
from formline.functions import scalars as S
from formline.operators.ordered import Frame, rolling


def quantiles(df: DataFrame, column: str, at: dict[str, float]) -> DataFrame:
    """One row of exact discrete quantiles of a column's values that are not null, by name; null without any.

    Values are counted map-side first, so running counts go over distinct values only. The same at every size.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.agg(F.sum("__n")).scalar()
    run = rolling(counts, [], ["__v"], [Frame("__before", "sum", "__n")])
    upto = F.coalesce("__before", F.lit(0)) + F.col("__n")
    return run.agg(*[F.min(F.when(upto >= F.ceil(F.lit(q) * total), F.col("__v"))).alias(n) for n, q in at.items()])


def tier_limits(df: DataFrame, points: str, minutes: str) -> DataFrame:
    """One row of slate percentiles; missing or zero falls back to the fixed defaults."""
    rows = [quantiles(df, points, {"p80_pts": 0.8}), quantiles(df, minutes, {"p80_min": 0.8, "p60_min": 0.6, "p40_min": 0.4})]
    one = df.sparkSession.range(1).select(
        *[r.select(F.struct(*r.columns)).scalar().alias(f"__{i}") for i, r in enumerate(rows)])
    return one.select(*[
        S.or_default(F.col(f"__{i}.{n}"), config.TIER_DEFAULTS[n]).alias(n) for i, r in enumerate(rows) for n in r.columns])


def player_tier(df: DataFrame, points: str, minutes: str, out: str = "Player_Tier") -> DataFrame:
    """Percentiles enter the plan as one scalar subquery; no driver round trip."""
    limits = tier_limits(df, points, minutes)
    cut = limits.select(F.struct(*limits.columns)).scalar()
    p, m = F.col(points), F.col(minutes)
    return df.withColumn("__cut", cut).withColumn(
        out,
        F.when((p > F.col("__cut.p80_pts")) & (m > F.col("__cut.p80_min")), "STAR")
        .when(m > F.col("__cut.p60_min"), "STARTER")
        .when(m > F.col("__cut.p40_min"), "ROTATION")
        .otherwise("BENCH"),
    ).drop("__cut")


def reliability_tag(df: DataFrame, prop: str, out: str = "Reliability_Tag") -> DataFrame:
    by_prop = {
        t: (F.col(f"L5_StdDev_{t}"), F.col(f"L10_StdDev_{t}"), F.col(f"Season_Avg_{t}"))
        for t in config.PROP_TYPES
    }
    return df.withColumn(out, S.reliability(S.coefficient_of_variation(F.col(prop), by_prop)))


def encode_ordinal(df: DataFrame, default: int = 1) -> DataFrame:
    """Tier and reliability as integers on one scale."""
    return df.withColumn(
        "Player_Tier_encoded", S.case_of(F.col("Player_Tier"), config.TIER_SCALE, F.lit(default))
    ).withColumn(
        "Reliability_Tag_encoded",
        S.case_of(F.col("Reliability_Tag"), config.RELIABILITY_SCALE, F.lit(default)),
    )


def quality_gate(df: DataFrame, strict: bool = True) -> DataFrame:
    """Strict mode drops bench players and volatile ones; relaxed keeps all."""
    if not strict:
        return df
    return df.filter((F.col("Player_Tier") != "BENCH") & (F.col("Reliability_Tag") != "VOLATILE"))


def gate_counts(df: DataFrame) -> DataFrame:
    """What each gate leaves, in one pass."""
    kept = F.col("Player_Tier") != "BENCH"
    return df.agg(
        F.count(F.lit(1)).alias("before"),
        F.count_if(kept).alias("after_tier"),
        F.count_if(kept & (F.col("Reliability_Tag") != "VOLATILE")).alias("after_reliability"),
    )


def edge_filter(df: DataFrame, edge: str = "edge") -> DataFrame:
    e = F.col(edge)
    return df.filter((e > 0) | (e < -0.05)).withColumn("direction", S.side_of(e))


def route_review(df: DataFrame, prop: str = "prop", confidence: str = "confidence", b2b: str = "is_b2b",
                 tag: str = "Reliability_Tag", strong=("AST", "3PM"), weak=("PTS", "REB"), high: int = 7,
                 low: int = 5) -> DataFrame:
    """Which predictions need a second look, and why."""
    is_weak = F.col(prop).isin(*weak)
    unsure = F.coalesce(F.col(confidence) < low, F.lit(False))
    tired = F.coalesce(F.col(b2b) == 1, F.lit(False))
    wild = F.coalesce(F.col(tag) == "VOLATILE", F.lit(False))
    trusted = F.col(prop).isin(*strong) & (F.col(confidence) >= high) & ~tired
    reasons = F.concat_ws(
        "; ",
        F.when(is_weak, F.concat(F.col(prop), F.lit(" model is weak"))),
        F.when(unsure, F.concat(F.lit("low ML confidence ("), F.col(confidence).cast("string"), F.lit(")"))),
        F.when(tired, "B2B game"),
        F.when(wild, "volatile player"),
    )
    return df.withColumn("needs_review", (is_weak | unsure | tired | wild) & ~F.coalesce(trusted, F.lit(False))).withColumn(
        "reason", F.when(reasons == "", "edge case").otherwise(reasons)
    )


def route_shares(routed: DataFrame) -> DataFrame:
    """Rows and percent of all per route."""
    total = F.greatest(routed.agg(F.count(F.lit(1))).scalar(), F.lit(1))
    return routed.groupBy("needs_review").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "pct", F.col("n") / total * 100.0
    )


def matchup_context(df: DataFrame, l5_min: str, season_min: str, team_pace: str, opp_pace: str,
                    opp_rating: str, recent: str, line: str) -> DataFrame:
    zero = F.lit(0.0)
    pace = (S.or_default(F.col(team_pace), 100) + S.or_default(F.col(opp_pace), 100)) / 2.0
    return df.select(
        "*",
        (F.coalesce(F.col(l5_min), zero) - F.coalesce(F.col(season_min), zero)).alias("minutes_trend"),
        pace.alias("projected_pace"),
        (pace - 100.0).alias("pace_vs_average"),
        S.defence_band(F.col(opp_rating)).alias("defence"),
        S.line_band(F.col(recent), F.col(line)).alias("line_band"),
    )


def add_severity(df: DataFrame, actual: str, line: str, side: str) -> DataFrame:
    rows = df.withColumn("miss_margin", S.miss_margin(F.col(actual), F.col(line), F.col(side)))
    rows = rows.withColumn("miss_pct", S.miss_percent(F.col("miss_margin"), F.col(line)))
    return rows.withColumn("severity", S.severity(F.col("miss_margin"), F.col("miss_pct")))


def impute_median(train: DataFrame, df: DataFrame, columns: list[str]) -> DataFrame:
    """Fill nulls with the training rows' lower median, 0 where a column is all null."""
    medians = F.struct(*[quantiles(train, c, {"m": 0.5}).scalar().alias(c) for c in columns])
    rows = df.withColumn("__median", medians)
    return rows.select(
        *[c for c in df.columns if c not in columns],
        *[F.coalesce(F.col(c).cast("double"), F.col(f"__median.{c}").cast("double"), F.lit(0.0)).alias(c) for c in columns],
    )


def fill_numeric_zero(df: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """Null numbers of any type to 0, at the model edge only: tiers and tags come before."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]
    return df.fillna(0, subset=cols) if cols else df


def column_plan(names: list[str], order: list[str], drop: set[str], prefixes: list[str]) -> list[int]:
    """Places of the columns to keep: listed ones by the list, then those of a prefix by the prefixes, then the others as they
    come; of equal names the first."""
    def rank(i: int) -> tuple[int, int, int]:
        name = names[i]
        if name in order:
            return 0, order.index(name), i
        group = next((k for k, p in enumerate(prefixes) if name.startswith(p)), None)
        return (2, 0, i) if group is None else (1, group, i)

    return sorted((i for i, n in enumerate(names) if n not in drop and names.index(n) == i), key=rank)


def shape_schema(df: DataFrame, order: list[str], drop: list[str] | None = None,
                 prefixes: list[str] | None = None) -> DataFrame:
    """The columns that ``column_plan`` keeps, in its order."""
    plan = column_plan(df.columns, order, set(config.NOISE_COLUMNS if drop is None else drop), prefixes or [])
    if len(set(df.columns)) == len(df.columns):
        return df.select(*[f"`{df.columns[i]}`" for i in plan])
    # equal names cannot be told apart by name
    numbered = df.toDF(*map(str, range(len(df.columns))))
    return numbered.select(*[F.col(str(i)).alias(df.columns[i]) for i in plan])


def feature_select(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted features, all of which the table must have."""
    if absent := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"no columns {absent}")
    return wanted
