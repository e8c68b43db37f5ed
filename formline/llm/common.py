"""Small helpers of the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

WHITE = " \t\n\v\f\r"  # the characters between words


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no frame has such a column in any letter case."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def trimmed(task: Callable) -> Callable:
    """``task`` over Arrow batches, after which Arrow and the C library give back the memory they keep of what was freed: a
    worker stays alive after its task, beside what other steps need."""

    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
        if trim:
            trim(0)

    return run


def add_struct(df: DataFrame, column: str, name: str, fields: StructType, fn: Callable[[list], pa.Array]) -> DataFrame:
    """``df`` with a struct column made by ``fn`` from the values of ``column``, batch by batch."""
    at = df.columns.index(column)

    def task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, fn(batch.column(at).to_pylist())], names=[*batch.schema.names, name])

    return df.mapInArrow(trimmed(task), StructType([*df.schema.fields, StructField(name, fields)]))


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without columns of these names, in any letter case."""
    gone = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in gone])
