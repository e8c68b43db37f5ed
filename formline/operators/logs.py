"""Tables over prediction logs, miss studies, slips and request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.operators.evaluate import accuracy_table
from formline.operators.ordered import top_n



def session_metrics(log: DataFrame, studies: DataFrame) -> DataFrame:
    """Accuracy overall, by tier, type, tag, day and at high confidence; studies counted per day.

    Each row states the (dimension, value) pairs it counts under, so one pass and one reduce do it all.
    """
    day = F.coalesce(F.col("game_date").cast("string"), F.lit("Unknown"))

    def pair(dimension: str, value: Column) -> Column:
        return F.struct(F.lit(dimension).alias("dimension"), value.alias("value"))

    fixed = F.array_compact(F.array(
        pair("overall", F.lit("all")), pair("tier", F.col("tier")), pair("prop", F.col("prop")), pair("day", day),
        F.when(F.col("confidence") >= 8, pair("band", F.lit("8+"))),
    ))
    tags = F.transform("context_tags", lambda t: pair("tag", t))
    rows = log.select("is_correct", F.explode(F.concat(fixed, tags)).alias("d")).groupBy("d.dimension", "d.value").agg(
        F.count("*").alias("total"), F.count_if("is_correct").alias("correct")
    )
    per_day = studies.groupBy(day.alias("value")).agg(F.count("*").alias("case_studies"))
    per_day = per_day.withColumn("dimension", F.lit("day"))
    rows = rows.join(per_day, ["dimension", "value"], "left")
    return rows.withColumn("accuracy", F.col("correct") / F.col("total") * 100.0).withColumn(
        "case_studies", F.when(F.col("dimension") == "day", F.coalesce("case_studies", F.lit(0)))
    )


def parlay_stats(slips: DataFrame) -> DataFrame:
    """Wins, losses and win rate by size, theme and risk, and overall, in one pass."""
    won = slips.withColumn("__won", F.col("outcome") == "WIN")
    rows = accuracy_table(won, ["parlay_size", "theme", "risk_level"], "__won")
    return rows.select(
        "dimension", "value", "total", F.col("correct").alias("wins"),
        (F.col("total") - F.col("correct")).alias("losses"), F.col("accuracy").alias("win_rate"),
    ).withColumn("discouraged", (F.col("dimension") == "parlay_size") & (F.col("win_rate") < 30))


def archetype_counts(studies: DataFrame, recency: list[str], last: int = 50, at_least: int = 3) -> DataFrame:
    """Patterns of the latest studies that recur, most frequent first, with the first example."""
    recent = studies.orderBy(*[F.desc(c) for c in recency]).limit(last)
    return (
        recent.groupBy("archetype")
        .agg(F.count("*").alias("n"), F.min_by("study_id", F.struct(*recency)).alias("first_study"))
        .filter(F.col("n") >= at_least)
    )


def latest_n(df: DataFrame, recency: list[str], n: int = 200) -> DataFrame:
    return df.orderBy(*[F.desc(c) for c in recency]).limit(n)


def feature_requests(log: DataFrame, contexts: int = 3, top: int = 10) -> DataFrame:
    """Most requested features with first sight, a few contexts and a priority."""
    counts = log.groupBy("feature").agg(F.count("*").alias("requests"), F.min("timestamp").alias("first_seen"))
    lead = counts.orderBy(F.desc("requests"), F.asc("feature")).limit(top)
    shown = top_n(log, ["feature"], ["timestamp", "request_id"], contexts, "__i")
    listed = shown.groupBy("feature").agg(
        F.array_sort(F.collect_list(F.struct("__i", "context"))).alias("__ctx")
    )
    text = F.array_join(F.transform("__ctx", lambda s: s["context"]), "; ")
    priority = F.when(F.col("requests") >= 5, "HIGH").when(F.col("requests") >= 3, "MEDIUM").otherwise("LOW")
    return lead.join(listed, "feature", "left").select(
        "feature", "requests", "first_seen", text.alias("contexts"), priority.alias("priority")
    )


def study_lookup(studies: DataFrame, tier: str | None, prop: str | None, tags: list[str] | None,
                 order: list[str], n: int = 5) -> DataFrame:
    """Studies of the tier, the type and any of the tags; a criterion no study meets is skipped."""
    hits = {}
    if tier:
        hits["tier"] = F.col("tier") == tier
    if prop:
        hits["prop"] = F.col("prop") == prop
    if tags:
        hits["tags"] = F.arrays_overlap("context_tags", F.array(*[F.lit(t) for t in tags]))
    rows = studies
    if hits:
        met = studies.agg(F.struct(*[F.bool_or(h).alias(k) for k, h in hits.items()])).scalar()
        rows = rows.withColumn("__met", met)
        for k, h in hits.items():
            rows = rows.filter(h | ~F.coalesce(F.col(f"__met.{k}"), F.lit(False)))
        rows = rows.drop("__met")
    return rows.orderBy(*order).limit(n)


def slip_lookup(studies: DataFrame, size: int, theme: str, order: list[str], n: int = 5) -> DataFrame:
    """Slip studies of this size or of a theme that contains, or is contained in, the given one."""
    mine, given = F.lower("theme"), F.lit(theme.lower())
    by_theme = mine.contains(given) | given.contains(mine)
    return studies.filter((F.col("parlay_size") == size) | by_theme).orderBy(*order).limit(n)


def best_model_registry(runs: DataFrame, prop: str, accuracy: str, run: list[str], keep: int = 10) -> DataFrame:
    """Best run per type (the earliest among equals) and the latest ``keep`` other runs."""
    best = runs.groupBy(prop).agg(
        F.max_by(F.struct(*run), F.struct(accuracy, *[(-F.col(r)).alias(r) for r in run])).alias("__best")
    )
    flagged = runs.join(best, prop).withColumn("is_best", F.struct(*run) == F.col("__best")).drop("__best")
    ranked = top_n(flagged, [prop, "is_best"], [f"-{r}" for r in run], keep, "__rank")
    return ranked.drop("__rank")
