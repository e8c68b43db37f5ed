"""Token counts by a finite-state transducer compiled from a BPE piece model.

The transducer reads a text character by character. A state holds what later characters can still depend on: the open
suffix that some piece may continue and, at each of its cut points, the last token there. Each transition carries the
change of the token count, so the sum along a path is the number of tokens. It is deterministic by two facts about
merging adjacent symbols by best score: the tokens of a prefix that ends between two tokens are the first tokens of the
whole, and a token may follow another exactly if the two, encoded together, come out as those two. Transitions are
compiled when first met and stay for the worker's life; the tables start afresh beyond ``MAX_CELLS``, so memory is bounded
and no result changes.

A batch of texts is one array of symbols cut into chunks of ``CHUNK`` characters. The state after a word start (a space
after a non-space) does not depend on what came before, so the map of a chunk from entry state to (exit state, count) is
constant behind its first word start. All chunks run in lock step from there; then the scan composes the maps: every chunk
whose predecessor's exit is known runs its head from that state, all of them in lock step, until none is open.

Defined cases: null and empty texts have 0 tokens; special strings inside a text are ordinary characters; texts of any
length are read whole; rows are independent, so repeated rows and ids and null ids stay as they are. Columns beside
``text`` are passed on untouched by ``count_tokens``.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

LIMIT = 4096
CHUNK = 512
SLICE = 4_000_000  # characters read at once
MAX_CELLS = 40_000_000  # of the transition table, 4 bytes each
SPACE = "▁"
SHIFT, BIAS = 6, 32  # a cell is next state << SHIFT | change of the count + BIAS


def read_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces and scores of a model file whose normaliser only marks spaces."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, train = model.normalizer_spec, model.trainer_spec
    if (train.model_type, train.byte_fallback, norm.add_dummy_prefix, norm.escape_whitespaces,
            norm.remove_extra_whitespaces, bool(norm.precompiled_charsmap)) != (2, True, True, True, False, False):
        raise ValueError("only BPE models with byte fallback and an identity normaliser compile to this transducer")
    if any(p.type in (4, 5) for p in model.pieces):
        raise ValueError("user-defined or unused pieces are not supported")
    pieces = {p.piece: p.score for p in model.pieces if p.type == 1}
    if lacking := {c for p in pieces for c in p} - set(pieces):
        raise ValueError(f"characters without a piece of their own: {sorted(lacking)[:5]}")
    return pieces


class Transducer:
    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.open = {p[:i] for p in pieces for i in range(1, len(p))}  # proper beginnings of pieces
        self.pairs = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        self.valid: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.lut = np.full(0x110000, -1, np.int16)
        self.chars = [None] * 4  # symbols 0 to 3: a character outside the model, of 1 to 4 bytes
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.table = np.full((256, 64), -1, np.int32)
        self.start = self.state("", ((0, "", 0),))

    def merge(self, text: str) -> list[str]:
        parts = list(text)
        while True:
            best = max(((self.pieces[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                        if a + b in self.pieces), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, last: str, token: str) -> bool:
        known = self.valid.get((last, token))
        if known is None:
            known = self.valid[last, token] = self.merge(last + token) == ([last, token] if last else [token])
        return known

    def state(self, suffix: str, cuts: tuple) -> int:
        """Number of the state with this open suffix and (depth, last token, count from here) at its cuts."""
        key = suffix, cuts
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            if found >= len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return found

    def compile(self, state: int, symbol: int) -> None:
        """Fill the cell of one transition."""
        char = self.chars[symbol]
        if char is None:
            nxt, change = self.start, symbol + 1  # byte pieces; nothing merges with them
        else:
            suffix, cuts = self.states[state]
            for depth, last, count in cuts:
                token = (suffix[-depth:] if depth else "") + char
                if token in self.pieces and self.follows(last, token):
                    break
            else:
                raise AssertionError(f"no token ends at {suffix + char!r}")
            change = count + 1
            grown = suffix + char
            kept = [(0, token, 0)]
            for depth, before, n in cuts:
                if grown[len(grown) - depth - 1:] in self.open:
                    # a last token that nothing behind the cut can merge with is forgotten
                    if before and before[-1] + grown[len(grown) - depth - 1] not in self.pairs:
                        before = ""
                    kept.append((depth + 1, before, n - change))
            kept.sort()
            nxt = self.state(grown[len(grown) - kept[-1][0]:], tuple(kept))
        self.table[state, symbol] = nxt << SHIFT | change + BIAS

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        out = self.lut[codes]
        if (out < 0).any():
            for code in np.unique(codes[out < 0]).tolist():
                char = SPACE if code == 32 else chr(code)
                if char not in self.pieces:
                    self.lut[code] = len(char.encode("utf-8", "surrogatepass")) - 1
                    continue
                space = self.lut[0x2581] if char == SPACE else -1
                if space < 0:
                    space = len(self.chars)
                    self.chars.append(char)
                    if space >= self.table.shape[1]:
                        self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                self.lut[code] = space
                if char == SPACE:
                    self.lut[[32, 0x2581]] = space
            out = self.lut[codes]
        return out

    def run(self, symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray):
        """Exit states and counts of lanes symbols[begin:end], all read in lock step."""
        order = np.argsort(begin - end, kind="stable")
        at, left, state = begin[order], (end - begin)[order], state[order].astype(np.int64)
        count = np.zeros(len(order), np.int64)
        live = len(order) - np.searchsorted(left[::-1], np.arange(left[0] if len(left) else 0), side="right")
        for k, n in enumerate(live.tolist()):
            symbol = symbols[at[:n] + k]
            cell = self.table[state[:n], symbol]
            if (missing := cell < 0).any():
                todo = np.unique(np.stack([state[:n][missing], symbol[missing].astype(np.int64)], 1), axis=0)
                for s, c in todo.tolist():
                    self.compile(s, c)
                cell = self.table[state[:n], symbol]
            state[:n] = cell >> SHIFT
            count[:n] += (cell & (1 << SHIFT) - 1) - BIAS
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], count[back]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; all of them are read at once."""
        if self.table.size > MAX_CELLS:
            self.reset()
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        total = int(sizes.sum())
        if not total:
            return np.zeros(len(texts), np.int64)
        codes = np.frombuffer("".join(f" {t}" for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbols(codes)
        space = symbols == self.lut[0x2581] if self.lut[0x2581] >= 0 else np.zeros(total, bool)
        ends = np.cumsum(sizes)
        first = ends - sizes
        word = space.copy()
        word[1:] &= ~space[:-1]
        word[first[sizes > 0]] = True  # a text begins in the start state
        points = np.flatnonzero(word)
        # chunks of each text
        per = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(texts)), per)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        begin = first[text] + nth * CHUNK
        end = np.minimum(begin + CHUNK, ends[text])
        where = np.searchsorted(points, begin)
        sync = np.minimum(np.append(points, total)[where], end)
        exits, counts = self.run(symbols, sync, end, np.full(len(text), self.start))
        known = sync < end
        # the scan: heads read from the exit of the chunk before, once that is known
        todo = np.flatnonzero(sync > begin)
        while len(todo):
            ready = todo[known[todo - 1]]
            state, more = self.run(symbols, begin[ready], sync[ready], exits[ready - 1])
            counts[ready] += more
            whole = ready[~known[ready]]
            exits[whole] = state[~known[ready]]
            known[whole] = True
            todo = np.setdiff1d(todo, ready, assume_unique=True)
        return np.bincount(text, counts, len(texts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(read_pieces(path))


def count_batch(machine: Transducer, texts: list[str | None]) -> np.ndarray:
    """Counts of a batch, in slices that bound the memory."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= SLICE:
            out.append(machine.count(part))
            part, size = [], 0
    out.append(machine.count(part))
    return np.concatenate(out)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text if not given), n_bytes, n_tokens and over_limit; new columns replace old
    ones of the same name."""
    new = ["n_bytes", "n_tokens", "over_limit"]
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in (text, *new)]
    schema = StructType([docs.schema[c] for c in kept] + [
        StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def task(batches: Iterable[pa.RecordBatch]):
        machine = transducer(path)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            counts = count_batch(machine, column.to_pylist())
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:-1], pc.cast(pc.fill_null(pc.binary_length(column), 0), pa.int64()),
                pa.array(counts, pa.int64()), pa.array(counts > limit, pa.bool_())], names=kept + new)

    return docs.select(*[f"`{c}`" for c in kept], f"`{text}`").mapInArrow(task, schema)
