"""SentencePiece encoding and decoding on the tokenizers library.

``build`` parses the model protobuf and rebuilds it as a tokenizers pipeline: normaliser (precompiled character map, extra
spaces, dummy prefix, space marker), model (unigram scores, or BPE with every split of a piece into two pieces as a merge
ranked by the piece's score) with byte fallback, and decoder. Batches are encoded and decoded by the library's threads.

Where no piece carries the space marker behind another character, tokens never cross a word start. Texts whose words are
separated by single spaces are then put together from the ids of their words; each distinct word of a worker is encoded
once, and a worker forgets its words beyond ``MAX_WORDS``. All other texts are encoded whole.

Parity is verified on everything that is encoded: each distinct word, or whole text, is also encoded by the sentencepiece
library and must give the same ids (``parity`` is false for a text with any difference), and its ids are decoded again and
must give it back (``round_trip``).

Defined cases: null and empty texts have no ids and round-trip to the empty text. Special strings in texts are ordinary
text. Texts are encoded whole, whatever their length. Rows are independent; other columns stay, and columns of a result's
name are replaced. ``decode`` of null gives null; ids outside the model raise.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from formline.llm.common import add_struct, fresh, without

MARK = "▁"
MAX_WORDS = 300_000
THREADS = 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
FIELDS = StructType([
    StructField("ids", ArrayType(IntegerType(), False)), StructField("n_tokens", IntegerType()),
    StructField("round_trip", BooleanType()), StructField("parity", BooleanType()),
])
SLICE = 2_000_000  # characters encoded at once
LEARN = 8_192  # words encoded at once: the libraries hold far more than the ids of each


def read_model(path: str):
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return model


def build(model):
    """A tokenizers pipeline equal to the sentencepiece model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    spec, norm = model.trainer_spec, model.normalizer_spec
    if any(p.type in (USER, UNUSED) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    if not norm.escape_whitespaces or spec.treat_whitespace_as_suffix:
        raise ValueError("only models that mark spaces before words are supported")
    unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
    if spec.model_type == 1:
        core = models.Unigram([(p.piece, p.score) for p in model.pieces], unknown, spec.byte_fallback)
    elif spec.model_type == 2:
        rank = {p.piece: (-p.score, i) for i, p in enumerate(model.pieces) if p.type == NORMAL}
        merges = sorted((rank[p], p[:k], p[k:]) for p in rank for k in range(1, len(p)) if p[:k] in rank and p[k:] in rank)
        core = models.BPE(
            vocab={p.piece: i for i, p in enumerate(model.pieces)}, merges=[m[1:] for m in merges],
            unk_token=model.pieces[unknown].piece, fuse_unk=not spec.byte_fallback, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError("only unigram and BPE models are supported")
    steps = [normalizers.Precompiled(norm.precompiled_charsmap)] if norm.precompiled_charsmap else []
    if norm.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if norm.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(core)
    out.normalizer = normalizers.Sequence(steps)
    strip = [decoders.Strip(" ", 1, 0)] if norm.add_dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return out


class Codec:
    def __init__(self, path: str, threads: int = THREADS):
        # read by the library when its threads first start
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        import sentencepiece

        model = read_model(path)
        self.threads = threads
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.tokenizer = build(model)
        norm = model.normalizer_spec
        self.by_word = (
            norm.add_dummy_prefix and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
            and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces if p.type == NORMAL))
        self.words: dict[str, bytes] = {}
        self.odd: set[str] = set()  # words whose ids the library has otherwise
        self.lossy: set[str] = set()  # words that do not come back

    def encode_whole(self, texts: list[str]) -> tuple[list[list[int]], list[bool]]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        want = self.library.encode(texts, num_threads=self.threads) if texts else []
        return ids, [a == b for a, b in zip(ids, want, strict=True)]

    def learn(self, words: set[str]) -> None:
        """Remember the ids of words, each with its space marker in front; the empty word is a lone marker."""
        new = sorted(words - self.words.keys())
        if len(self.words) + len(new) > MAX_WORDS:
            self.words, self.odd, self.lossy = {}, set(), set()
            new = sorted(words)
        # an empty text has no ids, so the lone marker is written out
        new = [w for w in new if w]
        for some in (new[k:k + LEARN] for k in range(0, len(new), LEARN)):
            ids, same = self.encode_whole(some)
            for word, i, ok, back in zip(some, ids, same, self.decode(ids), strict=True):
                self.words[word] = np.array(i, np.int32).tobytes()
                if not ok:
                    self.odd.add(word)
                if back != word:
                    self.lossy.add(word)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Ids of each text, whether sentencepiece agrees, and whether they decode to the text.

        A word's ids begin with its space marker, so no run of byte pieces goes on from word to word: a text put together from
        words comes back if its words do."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
        parity, back = np.ones(len(texts), bool), np.ones(len(texts), bool)
        split: dict[int, list[str]] = {}
        whole = []
        for i, text in enumerate(texts):
            if not text:
                continue
            words = text.split(" ") if self.by_word and MARK not in text else [""]
            if all(words):
                split[i] = words
            else:
                whole.append(i)
        self.learn({w for words in split.values() for w in words})
        for i, words in split.items():
            out[i] = np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int32)
            parity[i] = not self.odd or self.odd.isdisjoint(words)
            back[i] = not self.lossy or self.lossy.isdisjoint(words)
        ids, same = self.encode_whole([texts[i] for i in whole])
        for i, x, ok, text in zip(whole, ids, same, self.decode(ids), strict=True):
            out[i], parity[i], back[i] = np.array(x, np.int32), ok, text == texts[i]
        return out, parity, back

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False) if ids else []


@functools.lru_cache(maxsize=2)
def codec(path: str, threads: int = THREADS) -> Codec:
    return Codec(path, threads)


def slices(values: list, size) -> list[list]:
    """Consecutive parts of about ``SLICE`` characters or ids."""
    out, n = [[]], 0
    for v in values:
        out[-1].append(v)
        n += size(v)
        if n >= SLICE:
            out.append([])
            n = 0
    return out


def encode(docs: DataFrame, path: str, text: str = "text", threads: int = THREADS) -> DataFrame:
    """``docs`` with ids, n_tokens, round_trip and parity."""
    name = fresh("encoded", docs)

    def batch(texts: list) -> pa.Array:
        machine, arrays, parity, back = codec(path, threads), [], [], []
        for part in slices([t or "" for t in texts], len):
            ids, same, whole = machine.encode(part)
            arrays += ids
            parity.append(same)
            back.append(whole)
        sizes = np.fromiter((len(x) for x in arrays), np.int32, len(arrays))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = np.concatenate([np.empty(0, np.int32), *arrays])
        return pa.StructArray.from_arrays([
            pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array(sizes),
            *[pa.array(np.concatenate(f) if arrays else [], pa.bool_()) for f in (back, parity)],
        ], names=FIELDS.names)

    added = add_struct(docs, text, name, FIELDS, batch)
    rest = without(docs, FIELDS.names).columns
    return added.select(*[f"`{c}`" for c in rest], f"`{name}`.*")


def decode(rows: DataFrame, path: str, ids: str = "ids", threads: int = THREADS) -> DataFrame:
    """``rows`` with the decoded ``text``."""
    name = fresh("decoded", rows)
    fields = StructType([StructField("text", StringType())])

    def batch(values: list) -> pa.Array:
        machine, out = codec(path, threads), []
        for part in slices(values, lambda v: len(v or ())):
            texts = iter(machine.decode([v for v in part if v is not None]))
            out += [None if v is None else next(texts) for v in part]
        return pa.StructArray.from_arrays([pa.array(out, pa.string())], names=["text"])

    added = add_struct(rows, ids, name, fields, batch)
    rest = without(rows, ["text"]).columns
    return added.select(*[f"`{c}`" for c in rest], F.col(f"`{name}`.text").alias("text"))
