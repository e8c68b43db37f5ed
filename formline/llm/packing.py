"""Packing by concatenate and cut: texts become ids, ids one long line, the line fixed windows.

First pass: texts are encoded partition by partition and written with the number of ids before them in their partition.
Prefix sums over the partitions' totals then give every document its place on the line. Second pass: windows of ``LENGTH``
ids cut the line; a document inside one window is one piece, a document across window ends gives a boundary record for each
window it touches. All windows but the last are full, so only the last may need padding.

Texts are encoded by the tokenizers library. Where its pre-tokenizer never joins a word with the one before a single space
(byte level), a text is put together from the ids of its words, and a worker encodes each distinct word once; it forgets its
words beyond ``MAX_WORDS`` and keeps none longer than ``MAX_LETTERS``. Other tokenizers get whole texts.

Shuffled are only the partitions' totals: one row a partition, broadcast up to ``MAX_PARTS`` of them and joined beyond.

Defined cases: null and empty texts are documents of the end id alone. Texts are encoded whole; a long one costs time in
proportion and spans many windows. Rows are independent, so repeated rows, equal and null ids are packed one by one. An
empty table gives no pieces. Other columns are kept; columns of a result's name are replaced. Special strings in a text
become special ids, as is the library's default.
"""

from __future__ import annotations

import functools
import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from formline.llm.common import fresh
from formline.session import run_dir

LENGTH = 2048
END = 1
MAX_WORDS = 1_000_000
MAX_LETTERS = 64
MAX_PARTS = 1_000_000
SLICE = 4_000_000  # characters encoded at once
NEW = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

SINGLE = re.compile(r"(?<!\s) (?!\s)")  # a space beside another white character belongs to one pre-token with it
# Fixed value: the pre-token pattern of byte-level vocabularies
UNITS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
FAMILIAR = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\u017f\n]*")  # characters whose class is the same in all versions of Unicode


def byte_names() -> dict[int, str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def splits_at_spaces(path: str) -> bool:
    """True where no token crosses a single space between two words."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec["model"]
    return (
        spec.get("normalizer") is None and model["type"] == "BPE" and model.get("dropout") is None
        and not spec.get("truncation") and not spec.get("padding")
        and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex")) == ("ByteLevel", False, True)
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                    for t in spec.get("added_tokens", [])))


class Memory(dict):
    """Ids by string, made when first asked for; all are forgotten beyond ``MAX_WORDS``, long strings are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= MAX_LETTERS:
            if len(self) >= MAX_WORDS:
                self.clear()
            self[key] = found
        return found


class Mixed(Exception):
    """A word that begins or ends with white space, so the space before it is no word start."""


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_at_spaces(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.names = byte_names()
        self.units, self.words, self.heads = Memory(self.unit), Memory(self.word), Memory(lambda w: self.whole([w])[0])

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def unit(self, unit: str) -> bytes:
        """Ids of one pre-token."""
        named = unit.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(named)]).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word with a space in front."""
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.tokenizer.model.tokenize("Ġ" + word)]).tobytes()
        if not word or word[0].isspace() or word[-1].isspace():
            raise Mixed
        if not FAMILIAR.fullmatch(word) or any(s in word for s in self.special):
            return self.whole([f" {word}"])[0]
        head, *rest = UNITS.findall(f" {word}")
        return b"".join([self.words[head[1:]], *map(self.units.__getitem__, rest)]) if rest else self.unit(head)

    def text(self, text: str) -> bytes:
        words = text.split(" ")
        try:
            if len(words) > 1 and words[0][-1:].isspace():
                raise Mixed
            return b"".join([self.heads[words[0]], *map(self.words.__getitem__, words[1:])])
        except Mixed:
            words = SINGLE.split(text)
            ids = [self.heads[words[0]]]
            for w in words[1:]:
                odd = not w or w[0].isspace() or w[-1].isspace()
                ids.append(self.whole([f" {w}"])[0] if odd else self.words[w])
            return b"".join(ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        return [self.text(t) for t in texts] if self.by_word else self.whole(texts)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_batch(machine: Encoder, texts: Iterable[str | None]) -> list[bytes]:
    out, part, size = [], [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= SLICE:
            out += machine.encode(part)
            part, size = [], 0
    return out + (machine.encode(part) if part else [])


def encoded(docs: DataFrame, path: str, text: str, kept: list[str], names: tuple[str, str], end: int) -> DataFrame:
    """``kept`` columns, ids, doc_tokens and, by ``names``, the partition and the ids before the document in it."""
    part, before = names
    schema = StructType([docs.schema[c] for c in kept] + [
        StructField("ids", BinaryType()), StructField("doc_tokens", LongType()),
        StructField(part, IntegerType()), StructField(before, LongType())])
    tail = np.array([end], "<u4").tobytes()

    def task(batches: Iterable[pa.RecordBatch]):
        machine, mine, at = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [i + tail for i in encode_batch(machine, batch.column(batch.num_columns - 1).to_pylist())]
            sizes = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
            upto = at + np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pa.array(ids, pa.binary()), pa.array(sizes),
                pa.array(np.full(len(ids), mine, np.int32)), pa.array(upto - sizes)], names=schema.names)
            at = int(upto[-1]) if len(upto) else at

    return docs.select(*[f"`{c}`" for c in kept], f"`{text}`").mapInArrow(task, schema)


def place(rows: DataFrame, part: str, before: str, out: str) -> DataFrame:
    """``rows`` with the number of ids before each document on the whole line."""
    key, base = fresh("key", rows), fresh("base", rows)
    totals = rows.groupBy(F.col(part).alias(key)).agg(F.max(F.col(before) + F.col("doc_tokens")).alias("n"))
    earlier = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(key, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(base))
    few = totals.limit(MAX_PARTS + 1).count() <= MAX_PARTS
    joined = rows.join(F.broadcast(bases) if few else bases, F.col(part) == F.col(key))
    return joined.withColumn(out, F.col(base) + F.col(before)).drop(key, base, part, before)


def cut(rows: DataFrame, at: str, length: int) -> DataFrame:
    """A record for every window that a document touches. Pieces are made before rows are multiplied, so a long document's
    ids are not copied once a window."""
    window = fresh("pieces", rows)
    begin = f"greatest(w * {length} - `{at}`, 0L)"
    size = f"(least((w + 1) * {length} - `{at}`, doc_tokens) - {begin})"
    pieces = F.expr(
        f"transform(sequence(`{at}` div {length}, (`{at}` + doc_tokens - 1) div {length}), w -> struct({begin} as start, "
        f"{size} as length, substring(ids, cast(4 * {begin} + 1 as int), cast(4 * {size} as int)) as ids, "
        f"w as sequence_id, `{at}` + {begin} - w * {length} as offset))")
    rest = [f"`{c}`" for c in rows.columns if c not in ("ids", at)]
    made = rows.select(*rest, F.explode(pieces).alias(window))
    return made.select(*rest, f"`{window}`.*")


def pack(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, length: int = LENGTH,
         end: int = END) -> DataFrame:
    """Pieces: the columns ``keep`` (all but the text if not given), start, length, ids (little-endian 32-bit numbers),
    doc_tokens, sequence_id and offset."""
    taken = {n.lower() for n in NEW}
    kept = [c for c in (keep if keep is not None else docs.columns) if c != text and c.lower() not in taken]
    part, before = fresh("in_part", docs), fresh("before_in_part", docs)
    rows = encoded(docs, path, text, kept, (part, before), end)
    folder = f"{run_dir(docs.sparkSession, 'packing')}/encoded"
    rows.write.option("compression", "zstd").parquet(folder)
    stored = docs.sparkSession.read.schema(rows.schema).parquet(folder)
    at = fresh("on_line", stored)
    return cut(place(stored, part, before, at), at, length).select(*[f"`{c}`" for c in kept], *NEW)


def sequences(pieces: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids of whole sequences, padded to ``length``; one whose tokens number a power of two stays
    as it is."""
    one = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), one.alias("p"))
    filler = F.lit(np.array([pad] * length, "<u4").tobytes())
    short = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(F.greatest(length - F.col("n_tokens"), F.lit(0)))
    ids = F.aggregate("p", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return rows.select("sequence_id", "n_tokens", F.concat(ids, F.substring(filler, F.lit(1), (4 * short).cast("int"))).alias("ids"))
