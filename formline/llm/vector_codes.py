"""Vector codes: product quantisation in whole numbers, searched by a Walsh-Hadamard transform.

Components become floor(``SCALE`` * x) and vectors are cut into ``PARTS`` equal consecutive parts. Each part position has a
codebook of up to ``ENTRIES`` entries, first those parts of the smallest ids, then ``ROUNDS`` times the componentwise floor
means of the parts nearest to them; an entry that no part is nearest to stays. Sums and counts are made in the tasks, one row
a task, part, entry and component, and added up by Spark; only codebooks, whose size is fixed, reach the driver.

Nearest entries: parts and entries are padded with zeros to a power of two, P components, and transformed by Walsh-Hadamard.
Squared differences of the transformed add up to P times the squared distance, and they are added in sequency order, slow
components first. An entry whose sum so far exceeds the whole sum of a first guess is out, as the rest cannot be negative.
All of it is integer arithmetic: 64 bits where the numbers fit, Python's unbounded ones otherwise. Ties go to the lower
index.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped. Vectors shorter than the longest,
or than the next multiple of the parts, count as padded with zeros behind. Repeated rows and ids are rows of their own; among
rows of one id the smaller vector comes first, null ids come last. An empty table gives an empty result. Other columns stay,
those of a result's name are replaced. Errors beyond 64 bits and sums beyond 38 digits raise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

from formline.llm.common import fresh, without

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
BLOCK = 4096  # vectors compared at once
SPARSE = 8  # sums are picked where no more than this part of them is alive
MAX_LABELS = 1_000_000  # totals broadcast up to this number, joined by label and salt beyond
SALTS = 64
SAFE = 1 << 62
SUMS = StructType([
    StructField("part", IntegerType()), StructField("entry", IntegerType()), StructField("position", IntegerType()),
    StructField("total", DecimalType(38, 0)), StructField("n", LongType())])


def finite(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector of finite numbers, read as doubles."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.withColumn(vector, F.col(f"`{vector}`").cast("array<double>")).filter(F.col(f"`{vector}`").isNotNull() & good)


def whole_numbers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exactly: a power of two only moves the exponent."""
    down = np.floor(values.astype(np.float64) * SCALE)
    if not down.size or np.abs(down).max() < SAFE:
        return down.astype(np.int64)
    return np.array([int(v) for v in down.ravel().tolist()], object).reshape(down.shape)


def sequency(n: int) -> list[int]:
    """Rows of the Hadamard matrix of n rows by their number of sign changes."""
    def changes(row: int) -> int:
        signs = [(row & k).bit_count() & 1 for k in range(n)]
        return sum(a != b for a, b in zip(signs, signs[1:], strict=False))
    return sorted(range(n), key=changes)


def walsh(values: np.ndarray) -> np.ndarray:
    """Transform along the last axis, padded with zeros to a power of two, in sequency order."""
    width = values.shape[-1]
    n = 1 << max(0, width - 1).bit_length()
    out = np.zeros((*values.shape[:-1], n), values.dtype)
    out[..., :width] = values
    step = 1
    while step < n:
        pairs = out.reshape(*out.shape[:-1], n // (2 * step), 2, step)
        out = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], -2).reshape(out.shape)
        step *= 2
    return out[..., sequency(n)]


def fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in the narrowest numbers that hold every sum of squared differences of their transforms."""
    top = max((max(int(a.max()), -int(a.min())) for a in arrays if a.size), default=0)
    n = 1 << max(0, arrays[0].shape[-1] - 1).bit_length()
    most = 4 * n ** 3 * top * top
    return [a.astype(np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object) for a in arrays]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each part and the squared distance to it.

    After each component the entry with the least sum so far is the guess, and entries above the whole distance of the best
    guess are out. While many are left, all sums grow side by side, which costs less than picking; then only those left do.
    """
    parts, entries = fitting(parts, entries)
    x, e = walsh(parts), walsh(entries)
    across = np.ascontiguousarray(e.T)
    n, wide = x.shape[1], np.int64 if x.dtype != object else object
    sums, limit, j = np.zeros((len(x), len(e)), x.dtype), None, 0
    while j < n:
        step = x[:, j:j + 1] - across[j]
        sums += step * step
        j += 1
        if j == n:
            break
        guess = sums.argmin(1)
        far = ((x - e[guess]) ** 2).sum(1).astype(x.dtype)
        limit = far if limit is None else np.minimum(limit, far)
        alive = (sums <= limit[:, None]).astype(bool)
        if SPARSE * np.count_nonzero(alive) <= alive.size:
            break
    if j == n:
        best = sums.argmin(1)
        return best, sums[np.arange(len(x)), best].astype(wide) // n
    row, col = np.nonzero(alive)
    sums = sums[row, col]
    for k in range(j, n):
        step = x[row, k] - across[k, col]
        sums = sums + step * step
        alive = np.flatnonzero((sums <= limit[row]).astype(bool))
        row, col, sums = row[alive], col[alive], sums[alive]
    # pairs are by row, then entry; the guess of each row is still there
    first = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(sums, first) if len(x) else sums
    hit = np.flatnonzero((sums == least[row]).astype(bool))
    return col[hit[np.searchsorted(row[hit], np.arange(len(x)))]], least.astype(wide) // n


@dataclass
class Codebooks:
    width: int  # components of a part
    entries: list[list[list[int]]]  # by part, entry and position

    def digest(self) -> str:
        """SHA-256 of all components as decimal numbers, by part, entry and position."""
        flat = ",".join(str(v) for part in self.entries for entry in part for v in entry)
        return hashlib.sha256(flat.encode()).hexdigest()

    def arrays(self) -> list[np.ndarray]:
        flat = [np.array(part, object).reshape(len(part), self.width) for part in self.entries]
        small = all(abs(v) < SAFE for part in flat for v in part.ravel().tolist())
        return [a.astype(np.int64) for a in flat] if small else flat

    def decode(self, code: str) -> list[int]:
        """The components of the entries that a code names."""
        return [v for p, part in enumerate(self.entries) for v in part[int(code[2 * p:2 * p + 2], 16)]]


def cut(column: pa.Array, width: int, parts: int) -> np.ndarray:
    """Whole numbers of a batch's vectors as (vector, part, position)."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    values = np.zeros((len(column), parts * width))
    row = np.repeat(np.arange(len(column)), sizes)
    values[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return whole_numbers(values).reshape(len(column), parts, width)


def blocks(batches: Iterable[pa.RecordBatch], at: int, width: int, parts: int):
    for batch in batches:
        for k in range(0, batch.num_rows, BLOCK):
            some = batch.slice(k, BLOCK)
            yield some, cut(some.column(at), width, parts)


def sums(rows: DataFrame, vector: str, books: Codebooks) -> DataFrame:
    """Total and count of the parts nearest to each entry, by component."""
    parts, width = len(books.entries), books.width

    def task(batches: Iterable[pa.RecordBatch]):
        tables = books.arrays()
        total = [np.zeros((len(t), width), object) for t in tables]
        count = [np.zeros(len(t), np.int64) for t in tables]
        for _, values in blocks(batches, 0, width, parts):
            for p, table in enumerate(tables):
                code, _ = nearest(values[:, p], table)
                order = np.argsort(code, kind="stable")
                used, first, n = np.unique(code[order], return_index=True, return_counts=True)
                total[p][used] += np.add.reduceat(values[order, p], first).astype(object)
                count[p][used] += n
        out = [(p, e, j, Decimal(int(total[p][e, j])), int(count[p][e]))
               for p in range(parts) for e in np.flatnonzero(count[p]).tolist() for j in range(width)]
        if out:
            yield pa.RecordBatch.from_arrays([
                pa.array(c, t) for c, t in zip(zip(*out, strict=True), [
                    pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()], strict=True)], names=SUMS.names)

    return rows.select(f"`{vector}`").mapInArrow(task, SUMS)


def moved(books: Codebooks, totals: list) -> Codebooks:
    entries = [[list(e) for e in part] for part in books.entries]
    for part, entry, position, total, n in totals:
        entries[part][entry][position] = int(total) // n
    return Codebooks(books.width, entries)


def train(rows: DataFrame, vector: str = "embedding", by: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of all rows with a finite vector."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    kept = finite(rows.select(f"`{by}`", f"`{vector}`"), vector)
    longest = kept.agg(F.max(F.size(vector))).first()[0]
    width = -(-(longest or 0) // parts)
    heads = kept.orderBy(F.col(f"`{by}`").asc_nulls_last(), vector).limit(entries).collect()
    values = np.zeros((len(heads), parts * width))
    for k, r in enumerate(heads):
        values[k, :len(r[1])] = r[1]
    first = whole_numbers(values).reshape(len(heads), parts, width).transpose(1, 0, 2)
    books = Codebooks(width, [[[int(v) for v in e] for e in part] for part in first])
    if not heads or not width:
        return books
    for _ in range(rounds):
        # no more rows than components in all codebooks, whatever the input
        found = sums(kept, vector, books).groupBy("part", "entry", "position").agg(F.sum("total"), F.sum("n"))
        books = moved(books, found.collect())
    return books


def encode(rows: DataFrame, books: Codebooks, vector: str = "embedding") -> DataFrame:
    """Rows with a finite vector, without it, with ``code`` (two hex digits a part) and ``error``, the squared distance of
    the vector from the entries of its code."""
    kept = without(finite(rows, vector), ["code", "error"])
    rest = [c for c in kept.columns if c != vector]
    schema = StructType([*[kept.schema[c] for c in rest], StructField("code", StringType()), StructField("error", LongType())])
    parts, width = len(books.entries), books.width

    def task(batches: Iterable[pa.RecordBatch]):
        tables = books.arrays()
        for batch, values in blocks(batches, len(rest), width, parts):
            codes = np.zeros((batch.num_rows, parts), np.uint8)
            error = np.zeros(batch.num_rows, object)
            for p, table in enumerate(tables if width else []):
                codes[:, p], far = nearest(values[:, p], table)
                error = error + far.astype(object)
            text = codes.tobytes().hex()
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pa.array([text[2 * parts * k:2 * parts * (k + 1)] for k in range(batch.num_rows)], pa.string()),
                pa.array(error.tolist(), pa.int64())], names=schema.names)

    return kept.select(*[f"`{c}`" for c in rest], f"`{vector}`").mapInArrow(task, schema)


def with_total(rows: DataFrame, label: str, value: str, out: str, most: int = MAX_LABELS) -> DataFrame:
    """``rows`` with the sum of ``value`` over rows of an equal label, nulls together. Sums are reduced before the shuffle;
    a label that many rows share meets its sum by broadcast, or by label and salt where the labels are too many."""
    key, salt, total = fresh("key", rows), fresh("salt", rows), fresh("total", rows)
    sums_ = rows.groupBy(F.col(f"`{label}`").alias(key)).agg(F.sum(f"`{value}`").alias(total))
    match: Callable = F.col(f"`{label}`").eqNullSafe(F.col(key))
    if sums_.limit(most + 1).count() <= most:
        joined = rows.join(F.broadcast(sums_), match)
    else:
        other = f"{salt}_"
        dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*[f"`{c}`" for c, kind in rows.dtypes if "map<" not in kind]), F.lit(SALTS)))
        spread = sums_.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = dealt.join(spread, match & (F.col(salt) == F.col(other)))
    kept = [f"`{c}`" for c in rows.columns if c != out]
    return joined.select(*kept, F.col(total).alias(out))
