"""Size-aware Jaccard join on word shingles, exact, and its connected groups.

Words are lower-cased (A-Z) and split at ASCII white space. A document's set holds its distinct ``k``-word shingles (with
fewer words the whole sequence as one; without words it is empty and linked with nothing). Two documents link when
``100 * intersection >= percent * union``. Documents of equal sets form one class, named by a 128-bit hash; everything
behind the first pass works on classes, so exact copies cost nothing more.

* Small sets enumerate subsets. Sets of n and m elements link exactly if they share a subset of c(n, m) elements, c the
  overlap they need. Each small set lists those subsets for every partner size; whoever lists the same one is linked,
  without a check and without pairs: each class links to the smallest class of the other size.
* Large sets scan inverted lists of parts. Sizes are cut into bands, and the sets of a band into p parts by the hashes of their
  elements. Linked sets have at most d elements apart (``apart``), so p - d of their parts are equal. Each set lists the
  d + 1 parts that come first in one order of all parts (most elements first, then by hash), so linked sets meet in a list.
  A list holds the sets that are equal in a whole part, some nine shingles at 90 percent; no table of frequencies is needed
  and lists do not get longer because shingles that occur once can no longer be told. Sets whose partners may lie in a
  larger band are listed there too.
* All members of a list are tested against one hub, its first class in an order of all classes; what lies in one group
  afterwards needs no more tests. The next turn takes ``MORE`` hubs a list, and all members of lists of at most
  ``SHORT``; then ``MORE`` times as many, so turns are few. A hub leaves its list, as it has met everybody. A list ends when
  all its members are in one group; as soon as the pairs between different groups are few, they are all tested. So every
  two classes that share a list are tested or already connected: no link between groups is lost, and a list of N near copies
  costs N tests, not N squared. Members of long lists that do not link (a shared passage) cost the square of their number.
* Before two sets are compared their sketches are: a bit for each of 1,024 slots, set where an odd number of elements falls
  into it. Every element that only one of the sets has turns one bit, so more differing bits than the sets may have elements
  apart rule the pair out, exactly. Within long lists sketches are compared where the list lies. Only pairs that are left
  move their sets, each made again from one document of its class.
* The boundary is the largest size up to which listing subsets costs less than lists and checks (``boundary``).

Lists and pairs name classes by 8 of their 16 bytes; groups are made of whole names. A list is found by one shuffle and sort, so
its keys lie in one task, which keeps none of them in memory beyond Spark's spilled window. A bitmap of 2^24 bits is the
only thing sent to all tasks; it spares them sets nobody asks for, and an exact join follows it.

Tables that later steps read are written to the shared folder. Groups come from alternating large-star and small-star
steps, as joins and map-side reduced minima, until all links are stars. Before the first and after each step, the links are
dealt to a task for each ``LINKS`` of them, which contracts what it holds to stars by union-find, ``FOREST`` classes at a time,
so that few links and few steps are left: none where one task holds all links.

Defined cases: null and empty texts have 0 shingles. Rows with equal doc_id and equal text are one document. A null doc_id
takes part; component_id is the smallest id that is not null, or null if there is none. Other columns are untouched.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import fresh, trimmed
from formline.session import run_dir, staged

MAP_BITS = 24
BAND = 1.5  # ratio of the ends of a band of sizes
SPARE = 1.1  # parts of a set for each that is listed by the largest sets of a band
SHORT = 32  # a list of at most so many classes gives its pairs at once
FEW = 16  # pairs between groups, for each member of a list, that are all tested in the first turn
MORE = 32  # a turn has so many times the hubs, and tests so many times the pairs at once, of the turn before
FOREST = 500_000  # classes a task contracts at once
LINKS = 50_000  # links that are worth a task of their own when they are contracted
SKETCH = 16  # words of 64 bits of a sketch
PART = 50_000  # rows a task hands over at once; of sets, eight times as many shingles
K1, K2, K3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- sets -----------------------------------------------------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.full(n, np.uint64(min(len(words), k)), np.uint64)
    for i in range(min(k, len(words))):
        out = mix(out * K1 + h[i:i + n])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def class_name(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def overlap(n: int, m: int, percent: int) -> int:
    """Common elements that sets of n and m elements need: the least i with 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int) -> range:
    """Sizes a set of n elements can link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def subset_cost(n: int, percent: int) -> int:
    return sum(math.comb(n, overlap(n, m, percent)) for m in partners(n, percent))


def list_cost(n: int, percent: int) -> int:
    """Postings, each of which is counted as leading to one check of two sets."""
    return prefix(n, percent) * (1 + 2 * n)


def prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


@functools.cache
def boundary(percent: int) -> int:
    """The largest size whose subsets, and those of all smaller sizes, cost less than lists and checks."""
    return next(n for n in itertools.count(1) if subset_cost(n, percent) > list_cost(n, percent)) - 1


def subsets(tokens: np.ndarray, percent: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(key, second key, partner size) of the subsets of a small set. A key is a sum of element hashes, the sizes in it."""
    n = len(tokens)
    a, b = (mix(tokens * c) for c in (K2, K3))
    for m in partners(n, percent):
        if m > most:
            continue
        c = overlap(n, m, percent)
        gone = np.array(list(itertools.combinations(range(n), n - c)), np.int64).reshape(math.comb(n, c), n - c)
        sizes = np.uint64(min(n, m) * 1_000_003 + max(n, m))
        k1, k2 = (x.sum(dtype=np.uint64) - x[gone].sum(axis=1, dtype=np.uint64) + sizes for x in (a, b))
        yield from zip(mix(k1).view(np.int64).tolist(), mix(k2).view(np.int64).tolist(), itertools.repeat(m))


# --- passes over the texts ------------------------------------------------------------------------------------------

def apart(n: int, percent: int) -> int:
    """At most so many elements lie in only one of two linked sets, one of which has n elements."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


@functools.cache
def band(n: int) -> int:
    """Sizes are cut into bands whose ends grow by about ``BAND``; band 0 is size 1."""
    return bisect.bisect_right(ends(n), n) - 1


@functools.cache
def ends(n: int) -> tuple[int, ...]:
    """The least sizes of the bands up to the first that begins above n."""
    out = [1]
    while out[-1] <= n:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return tuple(out)


@functools.cache
def slices(b: int, percent: int) -> int:
    """Parts that the sets of a band are cut into, some more than linked sets of it can differ in."""
    top = 1
    for _ in range(b + 1):
        top = max(top + 1, int(top * BAND))
    return math.ceil(SPARE * (apart(top - 1, percent) + 1))


def parts(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the parts of a set under which it is listed, for each band that its larger partners lie in.

    Two linked sets differ in at most d = ``apart`` parts of the p of a band, so p - d are equal. Each lists the d + 1 that
    come first in one order of all parts (larger ones first), so one equal part is listed by both.
    """
    n = len(tokens)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens * K2), dtype=np.uint64)])
    out = []
    for b in range(band(n), band(100 * n // percent) + 1):
        p = slices(b, percent)
        counts = np.bincount((((tokens >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)).astype(np.int64), minlength=p)
        stop = np.cumsum(counts)
        keys = mix(sums[stop] - sums[stop - counts] + np.arange(1, p + 1, dtype=np.uint64) * K1 + np.uint64((b + 1) * int(K3) & (1 << 64) - 1))
        out.append(keys[np.lexsort((keys, -counts))[:apart(n, percent) + 1]])
    return np.concatenate(out).view(np.int64)


def sketch(tokens: np.ndarray) -> np.ndarray:
    """``SKETCH`` words of bits: whether an odd number of elements falls into a slot."""
    at = (mix(tokens * K3) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=64 * SKETCH).astype(np.uint8) & 1).view(np.int64)


WORDS = [f"s{i}" for i in range(SKETCH)]


def first_pass(docs: DataFrame, text: str, k: int, percent: int) -> DataFrame:
    """A row for each document: doc_id, text_hash, n, cid. The first of a class in a task has its part keys, its subsets
    (two keys and the size they are for) and its sketch as well."""
    most = boundary(percent)
    lists = [pa.list_(pa.int64())] * 3 + [pa.list_(pa.int32())]
    names = ["doc_id", "text_hash", "n", "cid", "parts", "k1", "k2", "partner", *WORDS]

    def task(batches):
        seen = set()
        for batch in batches:
            out = []
            for value in batch.column(2):
                tokens = shingles(value.as_py(), k)
                n, cid = len(tokens), class_name(tokens)
                if not n or cid in seen:
                    out.append((n, cid, None, None, None, None, [None] * SKETCH))
                    continue
                seen.add(cid)
                k1, k2, partner = list(zip(*subsets(tokens, percent, most), strict=True)) or [(), (), ()] if n <= most else [()] * 3
                listed = parts(tokens, percent) if n >= -(-percent * (most + 1) // 100) else ()
                out.append((n, cid, listed, k1, k2, partner, sketch(tokens).tolist()))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.binary()),
                *[pa.array([x[i + 2] for x in out], t) for i, t in enumerate(lists)],
                *[pa.array([x[6][i] for x in out], pa.int64()) for i in range(SKETCH)]], names=names)

    rows = docs.select(F.col("doc_id").cast("bigint"), F.xxhash64(f"`{text}`"), f"`{text}`")
    return rows.mapInArrow(trimmed(task), "doc_id bigint, text_hash bigint, n bigint, cid binary, parts array<bigint>, "
                           "k1 array<bigint>, k2 array<bigint>, partner array<int>, " + ", ".join(f"{w} bigint" for w in WORDS))


def short_name(cid: str = "cid"):
    """The first 8 bytes of a class name, by which lists and pairs are kept; links have whole names."""
    return F.conv(F.hex(F.substring(cid, 1, 8)), 16, -10).cast("bigint")


def place(text_hash: str, doc_id: str):
    """The bit of a document in the bitmap."""
    return F.xxhash64(text_hash, doc_id).bitwiseAND((1 << MAP_BITS) - 1)


def second_pass(docs: DataFrame, text: str, k: int, wanted) -> DataFrame:
    """doc_id, text_hash, short class name and shingles of the documents in the bitmap; repeated rows once a task."""

    def task(batches):
        bits, seen = wanted.value, set()

        def part(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)],
                                              names=["doc_id", "text_hash", "c", "tokens"])

        for batch in batches:
            out, size = [], 0
            at = batch.column(2).to_numpy()
            for i in np.flatnonzero(bits[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).tolist():
                if size >= 8 * PART:
                    yield part(out)
                    out, size = [], 0
                who = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                tokens = shingles(batch.column(3)[i].as_py(), k)
                name = int.from_bytes(class_name(tokens)[:8], "big", signed=True)
                if (*who, name) not in seen:
                    seen.add((*who, name))
                    out.append((*who, name, tokens.view(np.int64)))
                    size += len(tokens)
            yield part(out)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(f"`{text}`").alias("text_hash"), f"`{text}`")
    return rows.select("doc_id", "text_hash", place("text_hash", "doc_id"), f"`{text}`").mapInArrow(
        trimmed(task), "doc_id bigint, text_hash bigint, c bigint, tokens array<bigint>")


def bitmap(at) -> np.ndarray:
    """2^24 bits, those of the places ``at`` set; or-ed together by Spark."""
    words = at.select(
        F.shiftright("at", 6).alias("word"),
        F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("at").bitwiseAND(63).cast("int")).alias("bit"),
    ).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # 2^18 rows at most, by one job
    out = np.zeros(1 << MAP_BITS - 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


# --- links ----------------------------------------------------------------------------------------------------------

def subset_links(subsets_: DataFrame) -> DataFrame:
    """(a, b): each class and the smallest class of the other size that listed the same subset."""
    keys = ["k1", "k2", "low", "high"]
    rows = subsets_.withColumns({"low": F.least("n", "partner"), "high": F.greatest("n", "partner")}).select(
        *keys, "n", "cid").distinct()
    heads = rows.groupBy(keys).agg(
        F.min(F.when(F.col("n") == F.col("low"), F.col("cid"))).alias("of_low"),
        F.min(F.when(F.col("n") == F.col("high"), F.col("cid"))).alias("of_high"),
        F.min("cid").alias("first"), F.max("cid").alias("last"),
    ).where("first < last and of_low is not null and of_high is not null")
    other = F.when(F.col("n") == F.col("low"), F.col("of_high")).otherwise(F.col("of_low"))
    return rows.join(heads, keys).select(F.col("cid").alias("a"), other.alias("b")).where("a <> b").distinct()


def fits(n: str, m: str, percent: int, most: int):
    """Whether two sizes can be those of linked sets that are not both small."""
    return F.expr(f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m}) and greatest({n}, {m}) > {most}")


def close(n: str, m: str, x: str, y: str, percent: int):
    """Whether two sketches, columns that begin with x and y, do not rule a link out. Linked sets have at most
    n + m - 2 * overlap elements apart."""
    differ = functools.reduce(operator.add, [F.bit_count(F.col(f"{x}{w}").bitwiseXOR(F.col(f"{y}{w}"))) for w in WORDS])
    return (F.col(n) + F.col(m) - differ) * (100 + percent) >= 2 * percent * (F.col(n) + F.col(m))


def near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out."""
    x = sets.select(F.col("cid").alias("a"), F.col("n").alias("xn"), *[F.col(w).alias(f"x{w}") for w in WORDS])
    y = sets.select(F.col("cid").alias("b"), F.col("n").alias("yn"), *[F.col(w).alias(f"y{w}") for w in WORDS])
    return pairs.join(x, "a").join(y, "b").where(close("xn", "yn", "x", "y", percent)).select("a", "b")


def check(pairs: DataFrame, classes: DataFrame, pass_over, percent: int, folder: str) -> DataFrame:
    """The pairs of whole class names (a, b) that link, of the pairs (a, b) of short names. The sets of each class are made
    from one document, moved once to meet the pairs, and once more with them."""
    pairs = staged(pairs, f"{folder}-near")
    if pairs.isEmpty():
        return pairs.select(F.lit(b"").alias("a"), F.lit(b"").alias("b"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    asked = staged(classes.join(ids, "c", "left_semi").select("c", "cid", "rep"), f"{folder}-asked")
    found = pass_over(bitmap(asked.select(place("rep.text_hash", "rep.doc_id").alias("at")))).alias("t")
    sets = found.join(asked.hint("merge"), "c").where(
        "t.text_hash = rep.text_hash and t.doc_id <=> rep.doc_id").select("c", "cid", "tokens")
    x = sets.select(F.col("c").alias("a"), F.col("cid").alias("xc"), F.col("tokens").alias("x")).hint("merge")
    y = sets.select(F.col("c").alias("b"), F.col("cid").alias("yc"), F.col("tokens").alias("y")).hint("merge")
    both, most = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    links = pairs.join(y, "b").join(x, "a").where(both * (100 + percent) >= percent * most)
    return staged(links.select(F.col("xc").alias("a"), F.col("yc").alias("b")), f"{folder}-links")


def contract(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that join the same classes: each task's own groups as stars around their smallest class."""

    def task(batches):
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def stars() -> pa.RecordBatch:
            found = [(x, r) for x in list(parent) if (r := root(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in range(2)], names=["u", "v"])

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = sorted((root(u), root(v)))
                parent[high] = low
            if len(parent) >= FOREST:
                yield stars()
                parent.clear()
        yield stars()

    return edges.select("u", "v").mapInArrow(trimmed(task), "u binary, v binary")


def groups(links: DataFrame, folder: str) -> DataFrame:
    """(cid, label): every class with a link and the smallest class of its group."""
    def settled(edges: DataFrame) -> bool:
        """Whether every class that has a smaller one has one only, which has none."""
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")),
                                              F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        return ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where(
            "ups > 1 or (ups > 0 and least = 0)").isEmpty()

    def contracted(links: DataFrame, most: int, path: str) -> tuple[DataFrame, bool]:
        """``links``, ``most`` at most, contracted by few tasks, and whether one task had them all."""
        tasks = -(-most // LINKS)
        whole = tasks <= 1 and most <= FOREST // 2
        return staged(contract(links.coalesce(max(tasks, 1))), path), whole

    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, done = contracted(links, links.count(), f"{folder}/edges")
    for step in itertools.count():
        if done or settled(edges):
            break
        # large star: the larger neighbours of u go to its smallest
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # small star: the smaller neighbours of u, and u itself, go to its smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).distinct()
        # at most two links for each one there was
        edges, done = contracted(small, 2 * edges.count(), f"{folder}/star-{step}")
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("label")).union(
        edges.select(F.col("v").alias("cid"), F.col("v").alias("label")).distinct())


def list_groups(rows: DataFrame, classes: DataFrame, known: DataFrame, pass_over, percent: int, folder: str) -> DataFrame:
    """(cid, label) of the groups that ``known`` links and those found by lists make. ``rows``: n, c and parts of classes."""
    most = boundary(percent)
    # the first class of a list is its first hub; lists of one class end here
    in_order = Window.partitionBy("k1").orderBy("c")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    lists = rows.select(F.explode("parts").alias("k1"), "c", F.col("n").cast("int").alias("n")).withColumns({
        "hub": F.first("c").over(so_far), "m": F.first("n").over(so_far), "before": F.lag("c").over(in_order)})
    lists = staged(lists.where("c <> hub and c <> before").drop("before"), f"{folder}/lists")

    def ordered(rows: DataFrame, other: str) -> DataFrame:
        return rows.select(F.least("c", other).alias("a"), F.greatest("c", other).alias("b")).distinct()

    def grown(label: DataFrame, tests: DataFrame, name: str) -> DataFrame:
        """The groups of ``label`` and the new links; known groups enter as stars."""
        new = check(tests, classes, pass_over, percent, f"{folder}/{name}")
        stars = label.where("cid <> label").select(F.col("cid").alias("a"), F.col("label").alias("b"))
        return label if new.isEmpty() else groups(stars.union(new), f"{folder}/{name}-groups")

    by_hub = ordered(lists.where(fits("n", "m", percent, most)), "hub")
    by_hub = near(by_hub, classes.select(F.col("c").alias("cid"), "n", *WORDS).hint("merge"), percent)
    first = check(by_hub, classes, pass_over, percent, f"{folder}/first")
    label = groups(known.union(first), f"{folder}/first-groups")
    left = lists.select("k1", "c", "n")
    for turn in itertools.count(1):
        left = left.join(label.select(short_name().alias("c"), "label"), "c", "left").withColumn(
            "label", F.coalesce("label", F.unhex(F.hex("c"))))
        open_ = left.groupBy("k1").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select("k1")
        left = left.join(open_, "k1", "left_semi")
        if turn == 1:
            left = left.join(classes.select("c", *WORDS), "c")
        left = staged(left.select("k1", "c", "n", "label", *WORDS), f"{folder}/left-{turn}")
        # pairs between groups, list by list
        of_group = left.groupBy("k1", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
        of_list = of_group.groupBy("k1").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("pairs"),
                                             F.sum("n").alias("rows"))
        pairs, held = of_list.agg(F.sum("pairs"), F.sum("rows")).first()
        if not held:
            return label
        whole = pairs <= FEW * MORE ** (turn - 1) * held
        nth, size = F.row_number().over(Window.partitionBy("k1").orderBy("c")), F.count(F.lit(1)).over(Window.partitionBy("k1"))
        hubs = left if whole else left.withColumns({"nth": nth, "size": size}).where(
            (F.col("nth") <= MORE ** turn) | (F.col("size") <= SHORT))
        hubs = hubs.select("k1", F.col("c").alias("hub"), F.col("n").alias("m"), F.col("label").alias("of"),
                           *[F.col(w).alias(f"h{w}") for w in WORDS])
        tests = ordered(left.join(hubs, "k1").where(
            F.expr("label <> of") & fits("n", "m", percent, most) & close("n", "m", "", "h", percent)), "hub")
        label = grown(label, tests, f"turn-{turn}")
        if whole:
            return label
        # a hub has met everybody of its list
        left = left.join(hubs.select("k1", F.col("hub").alias("c")).hint("merge"), ["k1", "c"], "left_anti").drop("label")


def labelled(docs: DataFrame, text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, text_hash, n, cid and label: documents (repeated rows once or more) and the class that names their group."""
    spark = docs.sparkSession
    folder = run_dir(spark, "jaccard")
    rows = staged(first_pass(docs, text, k, percent).withColumn("c", short_name()), f"{folder}/first")
    of_task = rows.where("parts is not null")
    one = F.min(F.struct("text_hash", "doc_id", F.col("n").cast("int").alias("n"), *WORDS)).alias("rep")
    classes = staged(of_task.groupBy("c", "cid").agg(one).select(
        "c", "cid", "rep.n", *[f"rep.{w}" for w in WORDS], F.struct("rep.text_hash", "rep.doc_id").alias("rep")), f"{folder}/classes")

    def pass_over(bits: np.ndarray) -> DataFrame:
        return second_pass(docs, text, k, spark.sparkContext.broadcast(bits))

    small = staged(subset_links(of_task.select(F.explode(F.arrays_zip("k1", "k2", "partner")).alias("s"), "n", "cid").select(
        "s.*", F.col("n").cast("int").alias("n"), "cid")), f"{folder}/small")
    label = list_groups(of_task, classes, small, pass_over, percent, folder)
    documents = rows.select("doc_id", "text_hash", "n", "cid")
    return documents.join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def components(docs: DataFrame, text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id of the group) of every row."""
    found = labelled(docs, text, k, percent)
    first = found.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("first_id"))
    return found.join(first, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_each(docs: DataFrame, text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest doc_id (null first), then of the smallest text hash."""
    found = labelled(docs, text, k, percent)
    place = F.struct("doc_id", "text_hash")
    group = F.when(F.col("n") > 0, F.struct("label", F.lit(None).cast("bigint").alias("i"), F.lit(None).cast("bigint").alias("h")))
    alone = F.struct("label", F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    stay = found.groupBy(F.coalesce(group, alone).alias("g")).agg(F.min(place).alias("p"))
    i, h, c = (fresh(x, docs) for x in ("stay_id", "stay_hash", "stay_copy"))
    stay = stay.select(F.col("p.doc_id").alias(i), F.col("p.text_hash").alias(h))
    keyed = docs.withColumn(c, F.xxhash64(f"`{text}`"))
    kept = keyed.join(stay, F.expr(f"cast(doc_id as bigint) <=> `{i}` and `{c}` = `{h}`"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", f"`{c}`").orderBy(*[F.col(f"`{x}`") for x in docs.columns if x != text]))
    return kept.withColumn(i, nth).where(f"`{i}` = 1").select(*[f"`{x}`" for x in docs.columns])
