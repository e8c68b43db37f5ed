"""Periodic runs of words by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period q, at least ``REPEATS`` periods and ``WORDS`` words long, that no neighbour
extends. All prefixes of a word sequence are added to a suffix automaton; its suffix links form a tree in which the path
from a prefix to the root holds all suffixes of that prefix. Paths are kept as splay trees of one colour each, the colour
being the end of the last occurrence. An access for each word recolours the path of its prefix; the pieces of older colours
it meets, a logarithmic number in the mean, each name the previous end p of a longest repeated suffix of length l. With
d = end - p, words d apart are equal over l + d words, which is a square where l >= d; where the next word breaks the
period, it is a whole run. Smaller periods of the same stretch would have left a later colour, so d is the smallest.

Only stretches that can hold a run get an automaton. In a run every window of ``grain`` words occurs one period earlier, so
windows are hashed for a whole batch at once, the distance to the previous equal window is taken, and unbroken stretches of
repeats are kept with as many words before them as their longest possible period. Equal windows have equal hashes, so the
hashes can only add a stretch and lose none.

Dropped are the words of a run behind its first period (``collapsed``).

Defined cases: words are split at ASCII white space. Null and empty texts and texts without a word have no runs and collapse
to the empty text. Texts are read whole; time is the number of words times its logarithm, memory some 400 bytes a word of the
longest stretch. Rows are independent, so repeated rows and null ids stay. Other columns stay, columns of a result's name
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from formline.llm.common import add_struct, fresh, without

REPEATS = 4
WORDS = 6
SLICE = 2_000_000  # words looked through at once
MIX = np.uint64(0x9E3779B97F4A7C15)
RUN = StructType([StructField("start", LongType()), StructField("length", LongType()), StructField("period", LongType())])
FIELDS = StructType([StructField("runs", ArrayType(RUN, False)), StructField("collapsed", StringType())])

Run = tuple[int, int, int]


def suffix_tree(words: list) -> tuple[list[int], list[int], list[int]]:
    """Suffix link and longest length of each state of the suffix automaton, and the state of each prefix."""
    step: list[dict] = [{}]
    link, size, ends, last = [-1], [0], [], 0
    for w in words:
        new = len(size)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in step[p]:
            step[p][w] = new
            p = link[p]
        if p >= 0:
            q = step[p][w]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(size)
                step.append(step[q].copy())
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(w) == q:
                    step[p][w] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
        ends.append(new)
    return link, size, ends


class Paths:
    """The tree cut into vertical paths of one colour, each a splay tree ordered by depth."""

    def __init__(self, link: list[int]):
        self.up = list(link)  # parent in the splay tree; of its root, the node above the path
        self.high = [-1] * len(link)  # child nearer to the root of the tree
        self.low = [-1] * len(link)
        self.colour = [-1] * len(link)  # kept at splay roots

    def rotate(self, x: int) -> None:
        up, high, low = self.up, self.high, self.low
        p = up[x]
        g = up[p]
        if high[p] == x:
            c = high[p] = low[x]
            low[x] = p
        else:
            c = low[p] = high[x]
            high[x] = p
        if c >= 0:
            up[c] = p
        up[p] = x
        up[x] = g
        if g >= 0 and high[g] == p:
            high[g] = x
        elif g >= 0 and low[g] == p:
            low[g] = x
        else:
            self.colour[x] = self.colour[p]

    def splay(self, x: int) -> None:
        up, high, low = self.up, self.high, self.low
        while True:
            p = up[x]
            if p < 0 or (high[p] != x and low[p] != x):
                return
            g = up[p]
            if g >= 0 and (high[g] == p or low[g] == p):
                self.rotate(p if (high[g] == p) == (high[p] == x) else x)
            self.rotate(x)

    def access(self, x: int, colour: int) -> list[tuple[int, int]]:
        """Give the path from ``x`` to the root this colour; the older colours on it, each with its deepest node there."""
        up, low, met, below, node = self.up, self.low, [], -1, x
        while node >= 0:
            self.splay(node)
            if self.colour[node] >= 0:
                met.append((self.colour[node], node))
            if low[node] >= 0:
                self.colour[low[node]] = self.colour[node]
            low[node] = below
            below = node
            node = up[node]
        self.colour[below] = colour
        return met


def runs_of(words: list, repeats: int = REPEATS, least: int = WORDS) -> list[Run]:
    """(start, length, period) of all runs of a sequence, by start, then period."""
    link, size, ends = suffix_tree(words)
    paths, out, n = Paths(link), [], len(words)
    for end, state in enumerate(ends):
        for before, node in paths.access(state, end):
            period = end - before
            length = size[node] + period
            if length < least or length < repeats * period:
                continue
            if end + 1 == n or words[end + 1] != words[end + 1 - period]:
                out.append((end + 1 - length, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def grain(repeats: int, least: int) -> int:
    """Words of a run behind its first period, at least, over all periods."""
    return min(max(least - q, (repeats - 1) * q) for q in range(1, least + 1))


def stretches(hashes: np.ndarray, first: np.ndarray, repeats: int, least: int) -> list[tuple[int, int]]:
    """Disjoint (begin, end) of a batch's words that hold all runs. Text k is hashes[first[k]:first[k + 1]]."""
    g = grain(repeats, least)
    total = len(hashes)
    if total < g:
        return []
    sizes = np.diff(first)
    begin, end = np.repeat(first[:-1], sizes), np.repeat(first[1:], sizes)
    key = np.zeros(total - g + 1, np.uint64)
    for j in range(g):
        key = key * MIX + hashes[j:total - g + 1 + j]
    whole = np.flatnonzero(end[:len(key)] - np.arange(len(key)) >= g)  # windows inside one text
    order = whole[np.argsort(key[whole], kind="stable")]
    prior, here = order[:-1], order[1:]
    same = (key[prior] == key[here]) & (prior >= begin[here])
    far = np.zeros(len(key) + 2, np.int64)  # distance to the previous equal window, 0 if none; shifted by one
    far[here[same] + 1] = (here - prior)[same]
    edge = np.diff((far > 0).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # windows a to b - 1 repeat
    if not len(a):
        return []
    nearest = np.minimum.reduceat(np.where(far[1:] > 0, far[1:], total), np.stack([a, b], 1).ravel())[::2]
    most = (b - a + g - 1) // (repeats - 1)
    hold = nearest <= most
    out: list[tuple[int, int]] = []
    for x, y in zip(np.maximum(a - most, begin[a])[hold].tolist(), (b + g - 1)[hold].tolist(), strict=True):
        while out and x < out[-1][1]:
            x = min(x, out.pop()[0])
        out.append((x, y))
    return out


def batch_runs(texts: list[list[bytes]], repeats: int, least: int) -> list[list[Run]]:
    """Runs of each text, by start, then period."""
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    hashes = np.fromiter(map(hash, chain.from_iterable(texts)), np.int64, int(first[-1])).view(np.uint64)
    found: list[list[Run]] = [[] for _ in texts]
    for x, y in stretches(hashes, first, repeats, least):
        k = int(np.searchsorted(first, x, side="right")) - 1
        at = x - int(first[k])
        found[k] += [(at + s, n, q) for s, n, q in runs_of(texts[k][at:y - int(first[k])], repeats, least)]
    return found


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by single spaces, without those behind the first period of a run."""
    if not runs:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        cover[s + q] += 1
        cover[s + n] -= 1
    keep = np.cumsum(cover[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def read_batch(values: Iterable, repeats: int, least: int) -> pa.Array:
    counts, flat, collapsed = [], [], []

    def flush(part: list[list[bytes]]) -> None:
        for words, runs in zip(part, batch_runs(part, repeats, least), strict=True):
            counts.append(len(runs))
            flat.extend(runs)
            collapsed.append(collapse(words, runs))

    part, size = [], 0
    for value in values:
        part.append((value or "").encode().split())
        size += len(part[-1])
        if size >= SLICE:
            flush(part)
            part, size = [], 0
    flush(part)
    table = np.array(flat, np.int64).reshape(-1, 3)
    struct = pa.StructArray.from_arrays([pa.array(table[:, j]) for j in range(3)], names=RUN.names)
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(offsets, struct), pa.array(collapsed, pa.binary()).cast(pa.string())], names=FIELDS.names)


def find_runs(docs: DataFrame, text: str = "text", repeats: int = REPEATS, least: int = WORDS) -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words, by start, then period) and ``collapsed``."""
    if repeats < 2:
        raise ValueError("a run needs two periods at least")
    name = fresh("periodic", docs)
    added = add_struct(docs, text, name, FIELDS, lambda values: read_batch(values, repeats, least))
    rest = without(docs, FIELDS.names).columns
    return added.select(*[f"`{c}`" for c in rest], f"`{name}`.*")


def strongest(runs: str) -> F.Column:
    """The run with the greatest exact length / period, the first of equals; null where there is none."""
    return F.expr(
        f"aggregate(`{runs}`, cast(null as struct<start:bigint,length:bigint,period:bigint>), (m, r) -> "
        "case when m is null or r.length * m.period > m.length * r.period then r else m end)")
