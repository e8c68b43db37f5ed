"""Joins that attach context, lines and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.functions import scalars as S
from formline.session import leaf_bytes, setting

SMALL_SIDE_BYTES = 16 * 1024 * 1024


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast hint only where everything below ``df`` is provably small; else Spark chooses."""
    limit = setting(df.sparkSession, "broadcastBytes", SMALL_SIDE_BYTES)
    return F.broadcast(df) if leaf_bytes(df) <= limit else df


def map_code(df: DataFrame, name: Column, codes: DataFrame, out: str, default: Column) -> DataFrame:
    """Name to code through a map table (``name``, ``code``), ``default`` where unknown."""
    table = codes.select(F.col("name").alias("__name"), F.col("code").alias("__code")).dropDuplicates(["__name"])
    joined = df.join(small_side(table), name == F.col("__name"), "left")
    return joined.withColumn(out, F.coalesce("__code", default)).drop("__name", "__code")


def attach(df: DataFrame, context: DataFrame, on: dict[str, str], take: list[str], prefix: str = "") -> DataFrame:
    """Left join one context row per key. Duplicate keys collapse first, so rows never fan out."""
    keys = list(on.values())
    firsts = context.groupBy(*keys).agg(F.min(F.struct(*take)).alias("__ctx"))
    side = firsts.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        *[F.col(f"__ctx.{c}").alias(prefix + c) for c in take],
    )
    cond = None
    for i, mine in enumerate(on):
        one = df[mine] == side[f"__k{i}"]
        cond = one if cond is None else cond & one
    return df.join(side, cond, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def features_with_lines(features: DataFrame, lines: DataFrame, on: list[str]) -> DataFrame:
    """One row per entity and offered line."""
    return features.join(lines, on, "inner")


def attach_actuals(df: DataFrame, actuals: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Outcomes by entity and game: the game in the key keeps the join from fanning out."""
    return df.join(actuals, on, how)


def keep_active(df: DataFrame, box: DataFrame, on: list[str], minutes: str) -> DataFrame:
    return df.join(box.filter(F.col(minutes) > 0).select(*on), on, "left_semi")


def unmatched(lines: DataFrame, box: DataFrame, on: list[str], minutes: str, report: list[str],
              n: int = 10) -> DataFrame:
    """Lines without an active entity that day, a short distinct sample of them."""
    left = lines.join(box.filter(F.col(minutes) > 0).select(*on), on, "left_anti")
    return left.select(*report).distinct().orderBy(*report).limit(n)


def asof_latest(props: DataFrame, history: DataFrame, on: list[str], time: list[str], take: list[str]) -> DataFrame:
    """Latest history row per key with the prop's own columns laid over it.

    The latest row is an aggregate, so it shrinks before the shuffle however long a history is.
    """
    latest = history.groupBy(*on).agg(
        F.max_by(F.struct(*take), F.struct(*time)).alias("__last")
    )
    return props.join(latest, on, "inner").select(props["*"], *[F.col(f"__last.{c}").alias(c) for c in take])


GRAM = 3


def _grams(text: Column, n: Column) -> Column:
    """Distinct stretches of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, n)))).otherwise(F.array().cast("array<string>"))


def containing_names(needles: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """Rows (kind, needle, name) with the needle inside the name, from distinct needles and names of a kind.

    An inverted index of names by kind and stretch of ``GRAM`` characters (all of it for a shorter needle) is asked for the
    rarest stretch of each needle alone; a name it lists is then looked at whole. A needle with a stretch that no name has
    asks for nothing.
    """
    size = F.least(F.length("needle"), F.lit(GRAM))
    left = needles.filter(F.length("needle") > 0).select(kind, "needle").distinct()
    sizes = left.agg(F.collect_set(size)).scalar()  # at most GRAM of them
    listed = F.flatten(F.transform("__sizes", lambda n: _grams(F.col("name"), n)))
    posted = names.select(kind, "name").distinct().withColumn("__sizes", sizes).select(kind, "name", F.explode(listed).alias("__gram"))
    counts = posted.groupBy(kind, "__gram").agg(F.count(F.lit(1)).alias("__n"))
    asked = left.select(kind, "needle", F.explode(_grams(F.col("needle"), size)).alias("__gram"))
    rarest = asked.join(counts, [kind, "__gram"], "left").groupBy(kind, "needle").agg(
        F.min_by("__gram", F.struct("__n", "__gram")).alias("__gram"), F.min(F.coalesce("__n", F.lit(0))).alias("__n"))
    found = rarest.filter("__n > 0").drop("__n").join(posted, [kind, "__gram"])
    return found.filter(F.contains("name", "needle")).select(kind, "needle", "name")


def asof_by_last_token(props: DataFrame, history: DataFrame, name: str, kind: str, time: list[str],
                       take: list[str]) -> DataFrame:
    """Props without an exact (name, type) history: latest row of any name holding the last token."""
    have = history.select(name, kind).distinct()
    rest = props.join(have, [name, kind], "left_anti").withColumn(
        "__token", F.lower(F.element_at(F.split(F.trim(name), r"\s+"), -1))
    )
    latest = history.groupBy(name, kind).agg(
        F.max(F.struct(F.struct(*time).alias("at"), F.struct(*take).alias("row"))).alias("__last")
    ).withColumn("__low", F.lower(name))
    lows = latest.groupBy(F.col("__low").alias("name"), kind).agg(F.max("__last").alias("__last"))
    pairs = containing_names(rest.select(kind, F.col("__token").alias("needle")), lows, kind)
    best = pairs.join(lows, [kind, "name"]).groupBy(F.col("needle").alias("__token"), kind).agg(F.max("__last").alias("__best"))
    return rest.join(best, ["__token", kind]).select(
        props["*"], *[F.col(f"__best.row.{c}").alias(c) for c in take]
    )


def recent_hit_rate(props: DataFrame, history: DataFrame, on: list[str], order: list[str], stat: str,
                    line: str, odds: str, n: int = 10, outcome: str = "outcome", average: str | None = None) -> DataFrame:
    """Share of the last n history rows above today's line, even odds if none, and the edge.

    A history without the ``stat`` is judged by what it has: the share of its past overs, without ``outcome`` too whether its
    latest ``average`` is above the line, without any of them even odds.
    """
    from formline.operators.ordered import top_n

    kind = next((k for k, c in (("stat", stat), ("outcome", outcome), ("average", average)) if c and c in history.columns), None)
    taken = {"stat": stat, "outcome": outcome, "average": average}.get(kind)
    value = F.lit(None).cast("double") if kind is None else F.col(taken).cast("double")
    if kind != "average":
        value = F.coalesce(value, F.lit(float("-inf")))  # a missing value is no over
    last = top_n(history.withColumn("__value", value), on, order, 1 if kind == "average" else n).groupBy(*on).agg(
        F.collect_list("__value").alias("__recent"))
    joined = props.join(last, on, "left")
    bar = F.lit(0.5) if kind == "outcome" else F.col(line)
    over = F.size(F.filter("__recent", lambda v: v > bar))
    rate = F.when((F.size("__recent") > 0) & F.lit(kind is not None), over / F.size("__recent")).otherwise(0.5)
    implied = S.implied_probability(F.col(odds))
    return (
        joined.withColumn("recent_prob", F.coalesce(rate, F.lit(0.5)))
        .withColumn("implied_prob", implied)
        .withColumn("edge", F.col("recent_prob") - F.col("implied_prob"))
        .drop("__recent")
    )


def compare_predictions(predictions: DataFrame, actuals: DataFrame, on: list[str], actual: Column,
                        high: int = 75) -> DataFrame:
    """Prediction against outcome: side that came in, hit, and confident misses."""
    rows = predictions.join(actuals, on, "inner").withColumn("actual", actual)
    came = F.when(F.col("actual") > F.col("line"), "OVER").otherwise("UNDER")
    return (
        rows.withColumn("actual_side", came)
        .withColumn("hit", F.upper("side") == F.col("actual_side"))
        .withColumn("confident_miss", (F.col("confidence") >= high) & ~F.col("hit"))
    )


def match_names(predictions: DataFrame, lines: DataFrame, name: str, kind: str, pick: list[str],
                take: list[str]) -> DataFrame:
    """Match where one name contains the other and the type agrees; the first by ``pick`` wins."""
    def named(df: DataFrame, out: str) -> DataFrame:
        return df.select(kind, F.lower(F.trim(name)).alias(out))

    inside = containing_names(named(predictions, "needle"), named(lines, "name"), kind)
    around = containing_names(named(lines, "needle"), named(predictions, "name"), kind)
    pairs = (
        inside.select(kind, F.col("needle").alias("__want"), F.col("name").alias("__offer"))
        .unionByName(around.select(kind, F.col("name").alias("__want"), F.col("needle").alias("__offer")))
        .distinct()
    )
    firsts = lines.groupBy(F.lower(F.trim(name)).alias("__offer"), F.col(kind)).agg(
        F.min(F.struct(*pick, *[c for c in take if c not in pick])).alias("__row")
    )
    best = pairs.join(firsts, [kind, "__offer"]).groupBy("__want", kind).agg(F.min("__row").alias("__best"))
    keyed = predictions.withColumn("__want", F.lower(F.trim(name)))
    return keyed.join(best, ["__want", kind]).select(
        predictions["*"], *[F.col(f"__best.{c}").alias(f"matched_{c}") for c in take]
    )


def min_games(history: DataFrame, earlier: DataFrame, entity: str, game: str, k: int) -> DataFrame:
    """Rows of entities with at least k distinct games in the earlier season."""
    enough = (
        earlier.groupBy(entity).agg(F.count_distinct(game).alias("__n"))
        .filter(F.col("__n") >= k).select(entity)
    )
    return history.join(enough, entity, "left_semi")


