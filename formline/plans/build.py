"""The labelled dataset in one plan: box rows and lines in, features and labels out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.operators import classify, features, joins
from formline.operators.ordered import Frame, rolling
from formline.session import staged


@dataclass(frozen=True)
class Columns:
    """Names of the box table's roles."""

    entity: str = "entity_id"
    game: str = "game_id"
    day: str = "game_date"
    season: str = "season"
    home: str = "home"
    minutes: str = "minutes"
    stats: dict = field(default_factory=dict)  # prop type -> measure column


def engineer(box: DataFrame, c: Columns, rates: dict | None = None) -> DataFrame:
    """Every feature of the entity's own history: four partitions (entity, season, venue, venue and
    season), one exchange."""
    stats = {**c.stats, "MIN": c.minutes}
    raw = box.select("*", *[v.alias(f"__r_{n}") for n, v in (rates or {}).items()])
    rows = rolling(raw, [c.entity], [c.day, c.game], [
        *features.mean_frames(stats, c.season), *features.std_frames(c.stats),
        *[Frame(f"Player_{n}", "mean", f"__r_{n}") for n in rates or {}],
        Frame("__prev", "lag", c.day, 1), *features.venue_frames(c.stats, c.home, c.season),
    ])
    rest = F.coalesce(F.datediff(c.day, "__prev"), F.lit(7))
    rows = features.form_delta(rows, list(c.stats)).withColumn("rest_days", rest)
    return rows.withColumn("is_b2b", (F.col("rest_days") == 1).cast("int")).drop(
        "__prev", *[f"__r_{n}" for n in rates or {}]
    )


def build_dataset(box: DataFrame, lines: DataFrame, c: Columns, rates: dict | None = None,
                  context: DataFrame | None = None, context_on: dict | None = None,
                  context_columns: list[str] | None = None, stage: str | None = None) -> DataFrame:
    """Features x lines with labels, tiers, tags and codes. ``lines`` is keyed by entity and game and
    carries ``prop``, ``line`` and ``odds``; outcome measures leave the table once they have settled it.

    Tier limits are percentiles of all rows, so the rows are read twice: with ``stage`` they are written
    there once and read back, else the plan below them runs a second time.
    """
    rows = engineer(box, c, rates)
    if context is not None:
        rows = joins.attach(rows, context, context_on, context_columns)
    rows = joins.features_with_lines(rows, lines, [c.entity, c.game])
    rows = rows.withColumn("actual_value", _settled(c)).withColumn(
        "outcome", S.outcome(F.col("actual_value"), F.col("line"))
    ).filter("outcome IS NOT NULL")
    if stage:
        rows = staged(rows, stage)
    rows = classify.player_tier(rows, "Season_Avg_PTS", "Season_Avg_MIN")
    rows = classify.encode_ordinal(classify.reliability_tag(rows, "prop"))
    return rows.drop(*c.stats.values(), c.minutes)


def _settled(c: Columns):
    out = None
    for prop, measure in c.stats.items():
        hit = F.col("prop") == prop
        out = F.when(hit, F.col(measure)) if out is None else out.when(hit, F.col(measure))
    return out
