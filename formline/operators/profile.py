"""Profiles of a dataset: one aggregate each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def profile_freshness(df: DataFrame, day: str, game: str, player: str, cutoff: Column, today: Column) -> DataFrame:
    d = F.col(day)
    return df.agg(
        F.min(d).alias("first_day"), F.max(d).alias("last_day"),
        F.count_distinct(game).alias("games"), F.count_distinct(player).alias("players"),
        F.count_distinct(F.when(d >= cutoff, F.col(game))).alias("games_since"),
        F.datediff(today, F.max(d)).alias("age_days"),
    )


BITS = 62  # of one mask


def _marks(column: Column, values: list) -> list[Column]:
    """Masks with the bit of the value that ``column`` holds."""
    out = []
    for k in range(0, len(values), BITS):
        mask = F.lit(0).cast("long")
        for i, v in enumerate(values[k:k + BITS]):
            mask = F.when(column.eqNullSafe(F.lit(v)), F.lit(1 << i).cast("long")).otherwise(mask)
        out.append(mask)
    return out


def profile_dataset(df: DataFrame, day: str, game: str, player: str, season: str, prop: str,
                    outcome: str) -> DataFrame:
    """Records, range, distinct keys and outcome share overall, by season and by type.

    Distinct keys are counted by a mask: each key is reduced to the bits of the seasons and types it occurs in, so one pass a
    key counts it for all scopes and no row is multiplied. The scopes themselves, one row a season and type, are few.
    """
    base = df.groupBy(F.col(season).alias("season"), F.col(prop).alias("prop")).agg(
        F.count("*").alias("n"), F.sum(F.col(outcome).cast("long")).alias("pos"), F.min(day).alias("lo"), F.max(day).alias("hi"))
    found = base.select("season", "prop").collect()
    values = {c: sorted({r[c] for r in found}, key=lambda v: (v is None, v)) for c in ("season", "prop")}
    scopes = [("all", None, None), *[("season", "season", v) for v in values["season"]], *[("type", "prop", v) for v in values["prop"]]]

    def distinct(key: str, out: str) -> Column:
        """Array of the number of distinct keys of each scope."""
        masks = [*_marks(F.col(season), values["season"]), *_marks(F.col(prop), values["prop"])] or [F.lit(0).cast("long")]
        keys = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*[F.bit_or(m).alias(f"m{i}") for i, m in enumerate(masks)])
        bits, first = [F.count(F.lit(1))], 0
        for c in ("season", "prop"):
            for i in range(len(values[c])):
                bits.append(F.count_if(F.shiftright(f"m{first + i // BITS}", i % BITS).bitwiseAND(1) == 1))
            first += -(-len(values[c]) // BITS)
        return keys.agg(F.array(*bits).alias(out)).scalar()

    rows = []
    for kind, column, value in scopes:
        mine = F.lit(True) if column is None else F.col(column).eqNullSafe(F.lit(value))
        rows.append(F.struct(
            F.lit("all" if column is None else None if value is None else f"{kind} {value}").alias("scope"),
            F.sum(F.when(mine, F.col("n"))).alias("records"), F.min(F.when(mine, F.col("lo"))).alias("first_day"),
            F.max(F.when(mine, F.col("hi"))).alias("last_day"),
            (F.sum(F.when(mine, F.col("pos"))) / F.sum(F.when(mine, F.col("n")))).alias("over_share")))
    one = base.agg(F.array(*rows).alias("rows"), F.count("*").alias("some")).filter((F.col("some") > 0) | F.lit(len(scopes) == 1))
    table = one.select(F.posexplode("rows").alias("i", "r"), distinct(game, "games").alias("games"), distinct(player, "players").alias("players"))
    return table.select(
        "r.scope", F.coalesce("r.records", F.lit(0)).alias("records"), "r.first_day", "r.last_day",
        F.get("games", F.col("i")).alias("games"), F.get("players", F.col("i")).alias("players"), "r.over_share")


def profile_missing(df: DataFrame, features: list[str]) -> DataFrame:
    """Mean, sample deviation and missing percent of each feature, one pass turned into rows."""
    stats = F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.avg(F.col(f).cast("double")).alias("mean"),
            F.stddev_samp(F.col(f).cast("double")).alias("sd"),
            (F.count_if(F.col(f).isNull()) / F.count("*") * 100.0).alias("missing_pct"),
        )
        for f in features
    ])
    return df.agg(stats.alias("s")).select(F.explode("s").alias("s")).select("s.*")


def column_groups(df: DataFrame, groups: dict[str, str]) -> dict[str, int]:
    """Number of columns per name prefix; schema only, nothing runs."""
    return {g: sum(c.startswith(p) for c in df.columns) for g, p in groups.items()}


def funnel_counts(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Rows left after each stage and percent of all, one pass; stages apply one after another."""
    kept = F.lit(True)
    items = [F.struct(F.lit(0).alias("step"), F.lit("all").alias("stage"), F.count("*").alias("n"))]
    for i, (name, cond) in enumerate(stages.items(), 1):
        kept = kept & F.coalesce(cond, F.lit(False))
        items.append(F.struct(F.lit(i).alias("step"), F.lit(name).alias("stage"), F.count_if(kept).alias("n")))
    one = df.agg(F.array(*items).alias("s"), F.count("*").alias("total"))
    return one.select(F.explode("s").alias("s"), "total").select(
        "s.step", "s.stage", "s.n", (F.col("s.n") / F.greatest("total", F.lit(1)) * 100.0).alias("retained_pct")
    )


def group_counts(df: DataFrame, dims: list[str]) -> DataFrame:
    """Rows per value of each dimension."""
    pairs = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims
    ])
    pre = df.groupBy(*dims).agg(F.count("*").alias("n"))
    return pre.select(F.explode(pairs).alias("d"), "n").groupBy("d.dimension", "d.value").agg(F.sum("n").alias("n"))


def per_group(df: DataFrame, key: str) -> DataFrame:
    """Groups covered and rows per group on average and at most."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(
        F.count("*").alias("groups"), F.avg("n").alias("mean_rows"), F.max("n").alias("max_rows")
    )
