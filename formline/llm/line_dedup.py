"""Repeated runs of lines, found by winnowing over line hashes and deleted where they occur again.

A run is a sequence of consecutive lines of one document with ``MIN_WORDS`` words or more. A line is deleted if it lies in
a run that also occurs earlier, earlier meaning a smaller doc_id or the same document further up. The first occurrence
stays. Shorter repeats (a licence line alone) stay.

1. Winnowing. Each line that begins a run opens a window: the fewest lines from it on that have ``MIN_WORDS`` words. The
   smallest line hash of each window (the leftmost of equals) is a fingerprint. Windows depend on lines only, so equal runs
   hold equal fingerprints at equal places: no repeat is missed, and a document keeps about two fingerprints a window length.
2. Positions are joined: a fingerprint value that occurs at one place only is dropped by a map-side reduced count.
3. Around each position that is left, matches are extended both ways: the minimal runs through it, forwards and backwards,
   are hashed as sequences, and the first place of each sequence is a map-side reduced minimum. No pairs are formed, so
   a passage with a million copies costs a million rows. Minimal runs cover every longer run (each line of a run is in a
   minimal run that starts or ends in it), so the union of all that occur earlier is the extended match.

Lines are compared as they stand. Sequences are compared by 128-bit hashes, lines by 64-bit hashes within them.

Defined cases: null and empty texts and texts without a long run come back unchanged. Rows with equal doc_id and equal text
are one document: they come back alike. Rows with one doc_id and different texts are told apart, the smaller text hash
being earlier. A null doc_id is smaller than all others. Other columns and their names are untouched. Documents are read
whole; what one task holds is one document.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formline.llm.common import fresh, trimmed
from formline.session import run_dir, staged

MIN_WORDS = 50
LINES = "doc_id bigint, text_hash bigint, hashes array<bigint>, words array<int>, marks array<int>"
RUNS = "doc_id bigint, text_hash bigint, begin int, end int, h1 bigint, h2 bigint"


def forward_ends(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the end (exclusive) of the shortest run from it on with ``least`` words; -1 where there is none."""
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + least, side="left")
    return np.where(end < len(total), end, -1)


def backward_begins(words: np.ndarray, least: int) -> np.ndarray:
    """For each line the begin of the shortest run that ends with it and has ``least`` words; -1 where there is none."""
    end = forward_ends(words[::-1], least)[::-1]
    return np.where(end >= 0, len(words) - end, -1)


def fingerprints(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Lines that are the leftmost smallest hash of a window [i, ends[i])."""
    marks = set()
    at = -1
    for i in np.flatnonzero(ends >= 0).tolist():
        end = int(ends[i])
        if at < i:
            at = i + int(np.argmin(hashes[i:end]))
        else:  # the old minimum is still inside: only new lines can beat it
            new = done + int(np.argmin(hashes[done:end])) if end > done else at
            if hashes[new] < hashes[at]:
                at = new
        done = end
        marks.add(at)
    return np.array(sorted(marks), np.int32)


def text_lines(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and number of words of each line."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in lines), np.uint64, len(lines)).view(np.int64)
    return hashes, np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))


def lines_of(docs: DataFrame, text: str, least: int) -> DataFrame:
    """Line hashes, word counts and fingerprint lines of each document that has a run."""

    def task(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out = []
            for doc, key, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, words = text_lines(value)
                marks = fingerprints(hashes, forward_ends(words, least))
                if len(marks):
                    out.append((doc, key, hashes, words, marks))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.list_(pa.int32())),
                pa.array([r[4] for r in out], pa.list_(pa.int32())),
            ], names=["doc_id", "text_hash", "hashes", "words", "marks"])

    some = docs.where(f"`{text}` is not null and `{text}` <> ''")
    return some.select("doc_id", F.xxhash64(f"`{text}`").alias("text_hash"), f"`{text}`").mapInArrow(trimmed(task), LINES)


def runs_through(doc, key, hashes: np.ndarray, words: np.ndarray, at: np.ndarray, least: int) -> list[tuple]:
    """The minimal runs, forwards and backwards, that hold one of the lines ``at``, with 128-bit sequence hashes."""
    ends, begins = forward_ends(words, least), backward_begins(words, least)
    spans = {(i, int(e)) for i, e in enumerate(ends) if e >= 0} | {(int(b), i + 1) for i, b in enumerate(begins) if b >= 0}
    held = np.zeros(len(hashes) + 1, np.int64)
    held[1:] = np.cumsum(np.isin(np.arange(len(hashes)), at))
    out = []
    for b, e in sorted(spans):
        if held[e] > held[b]:
            digest = xxhash.xxh3_128_intdigest(hashes[b:e].tobytes())
            out.append((doc, key, b, e, (digest >> 64) - (1 << 63), (digest & (1 << 64) - 1) - (1 << 63)))
    return out


def extend(positions: DataFrame, least: int) -> DataFrame:
    """Minimal runs through the repeated fingerprints of each document."""

    def task(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            out = []
            for doc, key, hashes, words, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += runs_through(doc, key, np.array(hashes, np.int64), np.array(words, np.int64), np.array(at), least)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                             names=["doc_id", "text_hash", "begin", "end", "h1", "h2"])

    return positions.select("doc_id", "text_hash", "hashes", "words", "at").mapInArrow(trimmed(task), RUNS)


def repeated_runs(docs: DataFrame, text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, begin and end (lines) of every minimal run that occurs earlier."""
    folder = run_dir(docs.sparkSession, "lines")
    one = docs.select("doc_id", text).where(f"`{text}` is not null")
    # repeated rows of a document count once
    lines = staged(lines_of(one, text, least).dropDuplicates(["doc_id", "text_hash"]), f"{folder}/lines")
    marks = lines.select("doc_id", "text_hash", F.explode("marks").alias("at"), F.col("hashes").alias("h")).select(
        "doc_id", "text_hash", "at", F.element_at("h", F.col("at") + 1).alias("mark"))
    often = marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    repeated = marks.join(often, "mark", "left_semi").groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("at"))
    positions = lines.alias("l").join(
        repeated.alias("r"), F.expr("l.doc_id <=> r.doc_id and l.text_hash = r.text_hash")).select("l.*", "r.at")
    runs = staged(extend(positions, least), f"{folder}/runs")
    place = F.struct("doc_id", "text_hash", "begin")
    first = runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    behind = F.col("first.begin") + F.col("end") - F.col("begin")  # where the first occurrence ends
    return runs.join(first.drop("n"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select(
        "doc_id", "text_hash", F.when(same, F.greatest("begin", behind)).otherwise(F.col("begin")).alias("begin"), "end")


def merged(spans: list[dict]) -> list[dict]:
    """The spans as ordered, disjoint spans."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["begin"], s["end"])):
        if out and s["begin"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def document_cuts(runs: DataFrame) -> DataFrame:
    """doc_id, text_hash and the disjoint spans to cut."""

    def task(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            spans = pa.array([merged(x) for x in batch.column(2).to_pylist()], batch.schema.field(2).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], spans], schema=batch.schema)

    grouped = runs.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    return grouped.mapInArrow(trimmed(task), grouped.schema)


def dedup(docs: DataFrame, text: str = "text", least: int = MIN_WORDS, deleted: str | None = None) -> DataFrame:
    """``docs`` with the later repeats cut out of ``text``; with ``deleted``, also the number of lines cut by that name."""
    hash_name, key_name, doc_name, spans_name = (fresh(n, docs) for n in ("text_hash", "text_key", "cut_id", "cut_spans"))
    spans = document_cuts(repeated_runs(docs, text, least)).toDF(doc_name, hash_name, spans_name)
    joined = docs.withColumn(key_name, F.xxhash64(f"`{text}`")).join(
        spans, F.expr(f"doc_id <=> `{doc_name}` and `{key_name}` = `{hash_name}`"), "left")
    # native: lines whose index lies in no span
    kept = F.filter(
        F.split(f"`{text}`", "\n", -1),
        lambda _, i: ~F.exists(spans_name, lambda s: (s["begin"] <= i) & (i < s["end"])))
    cut = F.when(F.col(spans_name).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    count = F.when(F.col(spans_name).isNull(), F.lit(0)).otherwise(
        F.size(F.split(f"`{text}`", "\n", -1)) - F.size(kept)).cast("long")
    columns = [cut.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, *([count.alias(deleted)] if deleted else []))
