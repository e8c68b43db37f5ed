"""A list of the stored parts of a dataset, committed by rename.

Each commit is a new numbered file below ``_manifest``, written under another name and renamed when it is whole. Data that no
committed list names does not exist for readers, so a write that dies half-way, or before its commit, leaves nothing behind
that looks finished.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def newest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the last commit; 0 and nothing before the first."""
    fs, place = _files(spark, f"{path}/_manifest")
    if not fs.exists(place):
        return 0, {}
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit()]
    if not numbers:
        return 0, {}
    last = max(numbers)
    text = "\n".join(r[0] for r in spark.read.text(f"{path}/_manifest/{last:010d}.json").collect())
    return last, json.loads(text)


def commit(spark: SparkSession, path: str, after: int, content: dict) -> int:
    """Write the list that follows commit ``after``. Raises where another writer was first."""
    fs, draft = _files(spark, f"{path}/_manifest/draft-{uuid.uuid4().hex}")
    _, final = _files(spark, f"{path}/_manifest/{after + 1:010d}.json")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        raise RuntimeError(f"{path} was changed by another writer")
    return after + 1
