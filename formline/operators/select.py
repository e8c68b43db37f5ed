"""Top-k, quota, sampling and constrained selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline import config
from formline.functions import scalars as S
from formline.operators.ordered import top_n


def with_asc_nulls_last(df: DataFrame, col: str) -> tuple[DataFrame, list[str]]:
    """Order spec that puts nulls last: a null flag first, then the value."""
    flag = f"__null_{col}"
    return df.withColumn(flag, F.col(col).isNull()), [flag, col]


def dedup_best(df: DataFrame, entity: list[str], odds: str, tiebreak: list[str]) -> DataFrame:
    """One row per entity and type: lowest odds, nulls last."""
    rows, order = with_asc_nulls_last(df, odds)
    return top_n(rows, entity, [*order, *tiebreak], 1).drop(order[0])


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def balanced_top(df: DataFrame, game: str, prop: str, odds: str, line: str, tiebreak: list[str],
                 limit: int | None = None, low: int = 8, high: int = 50, per_game: int = 10) -> DataFrame:
    """Best n rows of every (game, type), n from the number of games on the slate."""
    games = df.select(F.count_distinct(game).cast("int")).scalar()
    total = F.lit(limit) if limit is not None else clamp(games * per_game, low, high)
    share = F.floor(total / F.greatest(games, F.lit(1)))
    n = F.greatest(F.lit(2), F.floor(F.greatest(F.lit(8), share) / 4))
    most = max(2, max(8, limit if limit is not None else high) // 4)
    rows, first = with_asc_nulls_last(df, odds)
    rows, second = with_asc_nulls_last(rows, line)
    ranked = top_n(rows, [game, prop], [*first, *second, *tiebreak], most, "__rank")
    return ranked.filter(F.col("__rank") <= n).drop("__rank", first[0], second[0])


def balanced_by_type(df: DataFrame, prop: str, odds: str, tiebreak: list[str], limit: int) -> DataFrame:
    """Without a game column: an equal share of the limit for each type."""
    rows, order = with_asc_nulls_last(df, odds)
    return top_n(rows, [prop], [*order, *tiebreak], max(1, limit // 4)).drop(order[0])


def stratified_sample(df: DataFrame, game: str, prop: str, key: list[str], total: int, seed: str = "42") -> DataFrame:
    """Repeatable random n rows of every (game, type)."""
    games = df.select(F.count_distinct(game).cast("int")).scalar()
    share = F.ceil(F.lit(total) / games)
    n = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(4), share) / 4))
    most = max(1, max(4, total) // 4)
    rows = df.withColumn("__draw", S.stable_order(seed, *[F.col(k) for k in key]))
    ranked = top_n(rows, [game, prop], ["__draw", *key], most, "__rank")
    return ranked.filter(F.col("__rank") <= n).drop("__rank", "__draw")


def diverse_sample(df: DataFrame, prop: str, player: str, order: list[str], key: list[str], n: int,
                   seed: str = "42") -> DataFrame:
    """First row per player, n // 4 players of each type, topped up to n from the other rows."""
    cols = df.columns
    row = F.struct(*cols)
    firsts = df.groupBy(prop, player).agg(F.min_by(row, F.struct(*order)).alias("__row")).select("__row.*")
    drawn = firsts.withColumn("__draw", S.stable_order(seed, F.col(player)))
    picks = top_n(drawn, [prop], ["__draw", player], max(1, n // 4)).select(*cols)
    rest = df.join(picks.select(*key), key, "left_anti")
    more = rest.withColumn("__draw", S.stable_order(seed + "+", *[F.col(k) for k in key]))
    more = more.orderBy("__draw", *key).limit(n)
    both = picks.withColumn("__turn", F.lit(0)).withColumn("__draw", F.lit("")).unionByName(
        more.withColumn("__turn", F.lit(1))
    )
    return both.orderBy("__turn", "__draw", *key).limit(n).select(*cols)


def prop_rank(prop: Column) -> Column:
    return S.case_of(prop, {p: i for i, p in enumerate(config.PROP_TYPES)}, F.lit(len(config.PROP_TYPES)))


def quota_fill(df: DataFrame, game: str, prop: str, order: list[str], per_game: int = 15) -> DataFrame:
    """At most ``per_game`` rows a game: a quota of each type, then what is left in type order."""
    quota = max(1, per_game // 4)
    ranked = top_n(df, [game, prop], order, per_game, "__in_type")
    ranked = ranked.withColumn("__late", (F.col("__in_type") > quota).cast("int")).withColumn(
        "__type", prop_rank(F.col(prop))
    )
    return top_n(ranked, [game], ["__late", "__type", "__in_type"], per_game).drop(
        "__in_type", "__late", "__type"
    )


def greedy_reach(per_player: int, per_type: int, total: int) -> tuple[int, int, int]:
    """How far down a slate a capped scan can look, per type, per player and in all.

    After a player's first ``per_player`` rows of one type the rest are never taken, because caps
    only close. At most ``total // per_player`` players close, and each then holds at most
    ``per_player`` rows of a type, so a type is settled within ``per_type + total`` rows. An open
    player's row is skipped only if its type is closed, and at most ``total // per_type`` types
    close, so a player is settled within ``per_player`` rows of each of them and of one open type.
    Every row the scan passes is taken, or lies in a closed type, or belongs to a closed player.
    """
    in_type = per_type + total
    of_player = per_player * (1 + total // per_type)
    return in_type, of_player, total + (total // per_type) * in_type + (total // per_player) * of_player


def greedy_caps(df: DataFrame, slate: list[str], player: str, prop: str, order: list[str],
                per_player: int, per_type: int, total: int) -> DataFrame:
    """Scan a slate in order, skip closed players and types, stop at the total.

    Rows the scan can never take are cut by window limits first, losing nothing, so a slate reaches its scan at a fixed size
    whatever its length was. The scan itself is one fold over that slate's array, whose state are the players and types taken
    so far. Missing players count as one player, missing types as one type.
    """
    in_type, of_player, in_all = greedy_reach(per_player, per_type, total)
    rows = top_n(df, [*slate, player, prop], order, per_player)
    rows = top_n(rows, [*slate, player], order, of_player)
    rows = top_n(rows, [*slate, prop], order, in_type)
    rows = top_n(rows, slate, order, in_all, "__seq")

    leg = F.struct("__seq", F.col(player).alias("who"), F.col(prop).alias("what"), F.struct(*[F.col(c) for c in df.columns]).alias("row"))
    keys = [F.col(c).alias(f"__s{i}") for i, c in enumerate(slate)]
    slates = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(leg)).alias("legs"))
    who, what = df.schema[player].dataType.simpleString(), df.schema[prop].dataType.simpleString()
    taken = F.expr(f"""aggregate(legs,
        cast(named_struct('who', array(), 'what', array(), 'seq', array()) as struct<who:array<{who}>,what:array<{what}>,seq:array<int>>),
        (s, r) -> if(size(s.seq) < {total} and size(filter(s.who, x -> x <=> r.who)) < {per_player}
                     and size(filter(s.what, x -> x <=> r.what)) < {per_type},
                     named_struct('who', concat(s.who, array(r.who)), 'what', concat(s.what, array(r.what)), 'seq', concat(s.seq, array(r.__seq))), s),
        s -> s.seq)""")
    picked = slates.withColumn("taken", taken).select(
        F.explode(F.filter("legs", lambda r: F.array_contains("taken", r["__seq"]))).alias("leg"))
    return picked.select("leg.row.*")


def quality(edge: Column, l5: Column, l10: Column, season: Column, odds: Column, rest: Column,
            b2b: Column, context: list[Column]) -> Column:
    """How well supported a candidate is: edge size plus what is known about it."""

    def known(c: Column, points: float) -> Column:
        return F.when(c.isNotNull(), points).otherwise(0.0)

    price = F.when(
        odds.isNotNull(), 0.5 + F.greatest(F.lit(0.0), 1.5 - F.abs(odds.cast("double")) / 150.0)
    ).otherwise(0.0)
    present = F.lit(0)
    for c in context:
        present = present + F.when(c.isNotNull(), 1).otherwise(0)
    return (
        F.coalesce(F.abs(edge) * 2.0, F.lit(0.0)) + known(l5, 2.0) + known(l10, 1.0)
        + known(season, 0.5) + price + known(rest, 0.3) + known(b2b, 0.2) + present * 0.05
    )


def best_candidates(scored: DataFrame, keys: list[str], tiebreak: list[str]) -> DataFrame:
    """Best row per (player, type): quality, then edge size, then mildest odds."""
    rows = scored.withColumn("__edge", F.abs("edge")).withColumn(
        "__odds", F.abs(F.coalesce(F.col("odds"), F.lit(0)))
    )
    return top_n(rows, keys, ["-quality", "-__edge", "__odds", *tiebreak], 1).drop("__edge", "__odds")


def smart_filter(scored: DataFrame, slate: list[str], player: str, prop: str, line: str,
                 tiebreak: list[str], n: int) -> DataFrame:
    """Best candidates of a slate under the player and type caps."""
    rows = best_candidates(scored, [*slate, player, prop], tiebreak).withColumn("__edge", F.abs("edge"))
    order = ["-quality", "-__edge", line, *tiebreak]
    return greedy_caps(rows, slate, player, prop, order, 2, max(3, n // 3), n).drop("__edge")


def top_confidence(df: DataFrame, confidence: str, tiebreak: list[str], n: int, at_least: int = 0) -> DataFrame:
    return df.filter(F.col(confidence) >= at_least).orderBy(F.desc(confidence), *tiebreak).limit(n)


def best_price(df: DataFrame, keys: list[str], odds: str, tiebreak: list[str], take: list[str]) -> DataFrame:
    """Highest odds per line across books."""
    ready = df.withColumn("__o", F.coalesce(F.col(odds), F.lit(-1_000_000)))
    best = ready.groupBy(*keys).agg(
        F.max_by(F.struct(odds, *take), F.struct("__o", *[(-F.col(t)).alias(t) for t in tiebreak])).alias("__b")
    )
    return best.select(*keys, "__b.*")
