"""Ordered per-entity computations that stay bounded when one entity owns much of the data.

A window over an entity runs in one task. That is the right plan for ordinary entities and the
wrong one for an entity with a third of all rows. Here each input is checked first: entities
above ``spark.formline.splitRows`` rows are *hot*. Cold entities take the plain window, one
shuffle. The rows of hot entities are sorted across tasks, cut by splitters sampled over the whole sort
key; rows get their exact position from per-piece counts, and the work then runs over chunks of exactly
``splitRows`` positions. A frame of k rows sees the k last rows of the chunk before it as copies; an
unbounded frame adds the states of earlier chunks. Both paths give the same values.

The check and the split path read their input several times. A large input that is more than a scan is
therefore written once to the shared folder and read back, so the plan below it runs once.

Order specs are column names; a leading ``-`` means descending. Nulls sort first ascending and last
descending.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formline.session import leaf_bytes, run_dir, setting, staged

SPLIT_ROWS = 4_000_000
SMALL_INPUT_BYTES = 256 * 1024 * 1024  # one entity may hold all of it
SMALL_TOTAL_BYTES = 64 * 1024 * 1024  # the same where there is no entity and one task orders all rows
LOCAL_KEYS = 10_000
BROADCAST_VALUES = 2_000_000
TASK_BYTES = 4 * 1024 * 1024  # of a large input's files that one task takes: its rows are wider in memory, and plans above explode them
UNKNOWN_BYTES = 1 << 62  # Spark's size of a relation it cannot tell
WINDOW_LIMIT = 1000  # Spark's own default for limiting groups before a shuffle
TOP_BUCKETS = 64


@dataclass(frozen=True)
class Frame:
    """One output column: ``fn`` of ``col`` over the ``rows`` rows before the current one."""

    out: str
    fn: str  # mean | std | sum | count | lag
    col: str
    rows: int | None = None  # None: everything before
    by: tuple[str, ...] = ()  # further partition columns inside the entity (season, venue)


@dataclass
class Hot:
    keys: DataFrame
    n_keys: int | None  # None: too many to list
    rows: int  # of all of them


def sort_columns(order: list[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def split_rows(df: DataFrame) -> int:
    return setting(df.sparkSession, "splitRows", SPLIT_ROWS)


SCAN_NODES = {"Project", "Filter", "SubqueryAlias", "View", "Relation", "LogicalRDD", "LocalRelation", "Range"}


def is_scan(df: DataFrame) -> bool:
    """True where reading ``df`` again costs no more than reading its source."""
    tree = df._jdf.queryExecution().analyzed().toString()
    return set(re.findall(r"^[\s:+\-|]*([A-Z]\w*)", tree, re.M)) <= SCAN_NODES


def is_small(df: DataFrame, keyed: bool = True) -> bool:
    limit = setting(df.sparkSession, "smallInputBytes", SMALL_INPUT_BYTES if keyed else SMALL_TOTAL_BYTES)
    return leaf_bytes(df) <= limit


def settled(df: DataFrame, entity: list[str]) -> tuple[DataFrame, Hot | None]:
    """The input to work on and its hot entities. Inputs that are small as a whole need no job."""
    if is_small(df, bool(entity)):
        return df, None
    if not is_scan(df):
        df = staged(df, run_dir(df.sparkSession, "ordered"))
    return df, hot_keys(df, entity)


def dealt(df: DataFrame, keys: list[str], source: DataFrame | None = None) -> DataFrame:
    """A large input dealt by key to as many tasks as its files have ``taskBytes``, so that what a task sorts does not grow with
    the input. Left to itself Spark joins small pieces again until each has 64 MB in the shuffle, many times that in memory.
    The size is that of ``source``, the input itself if not given; rows without files are of unknown size and stay."""
    size = leaf_bytes(df if source is None else source)
    if not keys or size >= UNKNOWN_BYTES or is_small(df):
        return df
    pieces = math.ceil(size / setting(df.sparkSession, "taskBytes", TASK_BYTES))
    return df.repartition(max(pieces, df.sparkSession.sparkContext.defaultParallelism), *keys)


def hot_keys(df: DataFrame, entity: list[str]) -> Hot | None:
    """Entities above the row limit, or None: one map-side reduced count."""
    spark = df.sparkSession
    cap = split_rows(df)
    over = df.groupBy(*entity).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > cap)
    listed = over.limit(LOCAL_KEYS + 1).collect()
    if not listed:
        return None
    if len(listed) <= LOCAL_KEYS:
        schema = T.StructType([df.schema[c] for c in entity])
        keys = [tuple(r[c] for c in entity) for r in listed]
        local = F.broadcast(spark.createDataFrame(keys, schema)) if entity else spark.range(1).select()
        return Hot(local, len(listed), sum(r["__n"] for r in listed))
    return Hot(over.select(*entity), None, over.agg(F.sum("__n")).first()[0])


def _part(df: DataFrame, hot: Hot, entity: list[str], how: str) -> DataFrame:
    if not entity:
        return df if how == "left_semi" else df.filter(F.lit(False))
    renamed = hot.keys.toDF(*[f"__k_{c}" for c in entity])
    cond = None
    for c in entity:
        one = df[c].eqNullSafe(renamed[f"__k_{c}"])
        cond = one if cond is None else cond & one
    return df.join(renamed, cond, how)


def _join_small(left: DataFrame, right: DataFrame, keys: list[str], small: bool) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"__j_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__j_{k}"])
        cond = one if cond is None else cond & one
    out = left.join(F.broadcast(renamed) if small else renamed, cond, "left")
    return out.drop(*[f"__j_{k}" for k in keys])


def _hot_positions(df: DataFrame, hot: Hot, entity: list[str], order: list[str], out: str) -> DataFrame:
    """Exact 1-based position in the order of hot entities, no task above one piece.

    Spark samples splitters over the whole sort key, entity first, so a piece is a stretch of the sorted rows however long the
    common beginnings of the keys are; a last key, the place of the row in the input, parts equal rows. Sorted pieces are
    written once, as a second sample would cut them elsewhere, and a position is the number of an entity's rows in earlier
    pieces plus the place in its own.
    """
    rows = _part(df, hot, entity, "left_semi").withColumn("__tie", F.monotonically_increasing_id())
    pieces = max(2, math.ceil(2 * hot.rows / split_rows(df)))
    keys = [*[F.col(c).asc() for c in entity], *sort_columns(order), F.col("__tie").asc()]
    cut = rows.repartitionByRange(pieces, *keys).sortWithinPartitions(*keys).drop("__tie")
    place = F.monotonically_increasing_id()  # the number of the piece above 33 bits of the row's number in it
    cut = cut.withColumn("__at", place).withColumns(
        {"__piece": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    cut = staged(cut, run_dir(df.sparkSession, "pieces"))
    counts = cut.groupBy(*entity, "__piece").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*entity).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).drop("__n", "__first")
    # an entity's rows are together, so these are no more than the entities and the pieces
    small = hot.n_keys is not None and hot.n_keys + pieces <= BROADCAST_VALUES
    cut = _join_small(cut, offsets, [*entity, "__piece"], small)
    return cut.select(*df.columns, (F.col("__before") + F.col("__at") + 1).cast("long").alias(out))


def positions(df: DataFrame, entity: list[str], order: list[str], out: str = "position",
              bounded: bool = False) -> DataFrame:
    """1-based position of each row in its entity's order; ``entity=[]`` numbers all rows.

    ``bounded`` states that every entity is small by construction (days, bins, types): no check job.
    """
    df, hot = (df, None) if bounded else settled(df, entity)
    window = Window.partitionBy(*entity).orderBy(*sort_columns(order))
    number = F.row_number().over(window).cast("long").alias(out)
    if hot is None:
        return df.select("*", number)
    cold = _part(df, hot, entity, "left_anti").select("*", number)
    return cold.unionByName(_hot_positions(df, hot, entity, order, out))


def _over(frame: Frame, base) -> Column:
    start = Window.unboundedPreceding if frame.rows is None else -frame.rows
    c = F.col(frame.col)
    if frame.fn == "lag":
        return F.lag(c, frame.rows or 1).over(base)
    window = base.rowsBetween(start, -1)
    fn = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "count": F.count}[frame.fn]
    return fn(c).over(window)


def rolling(df: DataFrame, entity: list[str], order: list[str], frames: list[Frame],
            bounded: bool = False) -> DataFrame:
    """Append frame columns that read only rows before the current one.

    Frames with ``by`` columns run inside finer partitions of the same entity. One exchange on the entity
    serves them all while no entity is hot; a finer partition can then not be hot either.
    """
    columns = df.columns
    df, hot = (df, None) if bounded else settled(df, entity)
    if hot is None and not bounded:
        df = dealt(df, entity)
    groups: dict[tuple[str, ...], list[Frame]] = {}
    for f in frames:
        groups.setdefault(f.by, []).append(f)
    for by, mine in groups.items():
        keys = [*entity, *by]
        if hot is not None and by:
            df, finer = settled(df, keys)
        else:
            finer = hot
        df = _plain(df, keys, order, mine) if finer is None else _split(df, finer, keys, order, mine)
    return df.select(*columns, *[f.out for f in frames])


def _plain(df: DataFrame, keys: list[str], order: list[str], frames: list[Frame]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    return df.select("*", *[_over(f, window).alias(f.out) for f in frames])


def _split(df: DataFrame, hot: Hot, keys: list[str], order: list[str], frames: list[Frame]) -> DataFrame:
    cold = _plain(dealt(_part(df, hot, keys, "left_anti"), keys, df), keys, order, frames)
    return cold.unionByName(_hot_rolling(df, hot, keys, order, frames))


def _hot_rolling(df, hot, entity, order, frames) -> DataFrame:
    cap = split_rows(df)
    reach = max([f.rows or 1 for f in frames if f.rows is not None or f.fn == "lag"], default=1)
    cap = max(cap, reach)
    key = entity or ["__all"]
    placed = _hot_positions(df, hot, entity, order, "__p")
    if not entity:
        placed = placed.withColumn("__all", F.lit(0))
    index = F.floor((F.col("__p") - 1) / cap).cast("long")
    placed = placed.withColumn("__own", index)
    tail = ((F.col("__p") - 1) % cap) >= (cap - reach)
    copies = F.when(tail, F.array("__own", F.col("__own") + 1)).otherwise(F.array("__own"))
    rows = placed.withColumn("__chunk", F.explode(copies))
    rows = rows.withColumn("__home", F.col("__chunk") == F.col("__own"))
    window = Window.partitionBy(*key, "__chunk").orderBy("__p")

    upto = window.rowsBetween(Window.unboundedPreceding, -1)
    bounded = [f for f in frames if f.rows is not None or f.fn == "lag"]
    whole = [f for f in frames if f not in bounded]
    spread = {f.col for f in whole if f.fn == "std"}

    def state(c: str, value: Column, over=None) -> dict[str, Column]:
        """Count and sum of a column, with a deviation to come also its mean and centred squares."""
        fns = {"n": F.count(value), "s": F.sum(value)}
        if c in spread:
            fns |= {"m": F.avg(value), "q": F.var_pop(value) * F.count(value)}
        if over is not None and c in spread:
            fns["q"] = F.var_pop(value).over(over) * F.count(value).over(over)
        return {k: v if over is None or (k == "q") else v.over(over) for k, v in fns.items()}

    cols = sorted({f.col for f in whole})
    own = {c: state(c, F.when(F.col("__home"), F.col(c)), upto) for c in cols}
    rows = rows.select("*", *[v.alias(f"__{k}_{c}") for c in cols for k, v in own[c].items()],
                       *[_over(f, window).alias(f.out) for f in bounded]).filter("__home")
    if cols:
        rows = _join_small(rows, _earlier(placed, key, {c: state(c, F.col(c)) for c in cols}), [*key, "__chunk"], False)
        for f in whole:
            rows = rows.withColumn(f.out, _merged(f))
    return rows.select(*df.columns, *[f.out for f in frames])


def _earlier(placed: DataFrame, key: list[str], states: dict[str, dict[str, Column]]) -> DataFrame:
    """Per chunk, the state of all chunks before it (``__k`` columns). Centred squares are put together around the mean of the
    whole entity, so nothing large cancels."""
    totals = placed.groupBy(*key, F.col("__own").alias("__chunk")).agg(
        *[v.alias(f"__t{k}_{c}") for c, parts in states.items() for k, v in parts.items()])
    before = Window.partitionBy(*key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*key)
    out: list[Column] = [F.col(k) for k in [*key, "__chunk"]]
    for c, parts in states.items():
        n = F.sum(f"__tn_{c}").over(before)
        out += [n.alias(f"__kn_{c}"), F.sum(f"__ts_{c}").over(before).alias(f"__ks_{c}")]
        if "q" in parts:
            centre = F.try_divide(F.sum(f"__ts_{c}").over(every), F.sum(f"__tn_{c}").over(every))
            totals = totals.withColumn(f"__off_{c}", F.col(f"__tm_{c}") - centre)
            off = F.sum(F.col(f"__tn_{c}") * F.col(f"__off_{c}")).over(before)
            off = F.try_divide(off, n)
            around = F.sum(F.col(f"__tq_{c}") + F.col(f"__tn_{c}") * F.col(f"__off_{c}") ** 2).over(before)
            out += [(centre + off).alias(f"__km_{c}"), F.greatest(around - n * off ** 2, F.lit(0.0)).alias(f"__kq_{c}")]
    return totals.select(*out)


def _merged(f: Frame) -> Column:
    """The value of an unbounded frame from the state of earlier chunks and of the rows before in the own chunk."""
    def part(kind: str) -> tuple[Column, Column]:
        return F.col(f"__k{kind}_{f.col}"), F.col(f"__{kind}_{f.col}")

    n1, n2 = (F.coalesce(v, F.lit(0)) for v in part("n"))
    n = n1 + n2
    s1, s2 = part("s")
    total = F.coalesce(s1 + s2, s1, s2)
    if f.fn == "std":
        (m1, m2), (q1, q2) = part("m"), part("q")
        squares = [q1, q2, (m2 - m1) ** 2 * (n1 * n2 / n)]  # missing where either side has no value
        return F.when(n > 1, F.sqrt(sum(F.coalesce(q, F.lit(0.0)) for q in squares) / (n - 1)))
    return {"mean": F.when(n > 0, total / n), "sum": F.when(n > 0, total), "count": n}[f.fn]


def ranked(df: DataFrame, entity: list[str], ranks: dict[str, list[str]]) -> DataFrame:
    """SQL ``rank()`` columns by name; hot groups rank their distinct values and join the ranks back."""
    df, hot = settled(df, entity)
    if hot is None:
        part = Window.partitionBy(*entity)
        return df.select("*", *[F.rank().over(part.orderBy(*sort_columns(o))).alias(out) for out, o in ranks.items()])
    for out, order in ranks.items():
        names = [c.lstrip("-") for c in order]
        sizes = df.groupBy(*entity, *names).agg(F.count(F.lit(1)).alias("__n"))
        ahead = rolling(sizes, entity, order, [Frame("__ahead", "sum", "__n")])
        place = (F.coalesce("__ahead", F.lit(0)) + 1).cast("int").alias(out)
        df = _join_small(df, ahead.select(*entity, *names, place), [*entity, *names], False)
    return df


def top_n(df: DataFrame, group: list[str], order: list[str], n: int, rank_as: str | None = None) -> DataFrame:
    """First n rows of each group.

    Spark limits each group before the shuffle while n is small. Beyond that each group is first dealt to buckets by a hash
    of its order columns and cut to n rows a bucket, so a group of any size is sorted in parts and only a bounded rest meets in
    one task.
    """
    if n > WINDOW_LIMIT:
        names = [c.lstrip("-") for c in order]
        dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(*names), F.lit(setting(df.sparkSession, "topBuckets", TOP_BUCKETS))))
        part = Window.partitionBy(*group, "__bucket").orderBy(*sort_columns(order))
        df = dealt.withColumn("__rn", F.row_number().over(part)).filter(F.col("__rn") <= n).drop("__rn", "__bucket")
    window = Window.partitionBy(*group).orderBy(*sort_columns(order))
    out = df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n)
    if rank_as:
        return out.withColumnRenamed("__rn", rank_as)
    return out.drop("__rn")


def running_total(df: DataFrame, entity: list[str], order: list[str], col: str, out: str,
                  bounded: bool = False) -> DataFrame:
    """Sum up to and including the current row."""
    rows = rolling(df, entity, order, [Frame("__prior", "sum", col)], bounded)
    return rows.withColumn(out, F.coalesce("__prior", F.lit(0)) + F.col(col)).drop("__prior")
