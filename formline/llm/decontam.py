"""Benchmark decontamination by template canonicalisation, in SQL functions only.

Words are split at white space. The template of a word is a typed placeholder for a number (``<num>``), a unit behind a
number (``<unit>``) and a name (``<name>``: a capitalised word that does not begin a sentence), else the word in lower
case without punctuation at its ends. A placeholder's own text is its slot. A capitalised word that begins a sentence may be
either, so a window that holds such words is read twice, with all of them as words and with all of them as names. Windows of ``WINDOW`` template words of documents and
benchmark items are joined by hash; items with fewer words are matched as a whole.

A window with few literal words says little, so below ``LITERALS`` of them its slots belong to its hash: it only matches
with equal values, or as part of a window of ``WIDE`` times its length (or of its whole item) that has so many literal words.
A passage with fewer even there, as a bare list of numbers, says nothing by its template and is found as an exact copy. The matched windows of a document and item are then judged by alignment (document position less item
position): a window counts if its slots equal the item's, or if they follow the renaming that most positions of the
alignment agree on, as in a re-parameterised question. So one edited name or number costs only the windows it stands in. The
item is found where the windows that count, of all alignments together, cover ``COVER`` of its windows, so an inserted or
left out word costs no more than the windows around it.

The benchmark side is broadcast only if its windows measure at most ``BROADCAST_ROWS``, a bound on its bytes; beyond it the
same join shuffles. Three bitmaps go in front of the join. One of 2^24 bits holds the ``HEAD`` words that windows of the benchmark begin
with, ``CHUNK`` words at a time, in each form that a document may give them: every word of a document is a place, and a place
stays if the words from there on are in it. Lower-case words are compared as such, of others only whether they have capitals.
Only for such places templates are made, of as many words as a window holds. Two of 2^19 bits hold
the first template words and the template windows: windows are read only at a place whose bit is set in either reading, and a
window becomes a row only if its own is. The document side is never held whole.

Defined cases: null and empty texts hold nothing. Empty items are never found. Rows with equal doc_id and equal text are
one document; a null doc_id is an id like any other. Other columns are untouched. An empty benchmark finds nothing.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.llm.common import fresh

WINDOW = 8
LITERALS = 4
WIDE = 2  # windows' length
HEAD, CHUNK = 8, 4  # words that let a window be read at all, looked up so many at a time
OPEN = "<name?>"
COVER = 0.3
BROADCAST_ROWS = 1_000_000  # hash, item, position and slots: at most about 100 MB
#: Units that make the word behind a number a unit.
UNITS = ("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l dl gal s sec secs second seconds min mins minute minutes h hr hrs "
         "hour hours day days week weeks month months year years % percent usd eur gbp dollar dollars euro euros cent cents "
         "meter meters metre metres kilometer kilometers kilometre kilometres mile miles gram grams kilogram kilograms liter "
         "liters litre litres degree degrees mph kmh kw kwh w v a hz khz mhz ghz kb mb gb tb").split()
NUMBER = r"^[$€£(+-]*[0-9][0-9.,:/]*(%|st|nd|rd|th)?$"
PLAIN = r"^\p{Ll}+$"
PAIR = ["doc_id", "text_hash", "item_id"]
WORD_BITS = 13
MASK_BITS = 18  # words of 64 bits, as a power of two
EDGE = r"^[^\p{L}\p{N}$€£%+-]+|[^\p{L}\p{N}%]+$"
BREAK = r"[\n\r\x{85}\x{2028}\x{2029}]"
ANY, OTHER = 0, 1
STEM = r"^[^\p{L}\p{N}$€£%+-]*(\p{Ll}+)[^\p{L}\p{N}%\n\r\x{85}\x{2028}\x{2029}]*\z"


def words_of(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def codes(ws: Column) -> Column:
    """For each word the hash of it in lower case without punctuation; ``OTHER`` where it has no capitals but more than such a word,
    or may be a unit; else ``ANY``. What has a hash is a literal word in either reading."""
    def one(plain: Column) -> Column:
        return F.transform(plain, lambda c, i: F.when((c == "") & ((F.lower(F.get(ws, i)) != F.get(ws, i)) | F.get(ws, i).rlike(BREAK)), F.lit(ANY).cast("bigint")).when(
            (c == "") | c.isin(*UNITS) & F.coalesce(F.when(i > 0, F.get(plain, i - 1) == ""), F.lit(True)), F.lit(OTHER).cast("bigint")).otherwise(F.xxhash64(c)))

    return F.flatten(F.transform(F.array(F.transform(ws, lambda w: F.regexp_extract(w, STEM, 1))), one))


def codes_of(t: Column) -> Column:
    """Array of the codes that words of a template word may have."""
    pure = t.rlike(r"^\p{Ll}+\z")
    return F.array_compact(F.array(F.lit(ANY).cast("bigint"), F.when(~pure | t.isin(*UNITS), F.lit(OTHER).cast("bigint")), F.when(pure, F.xxhash64(t))))


def is_set(words: Column, of: Column, bits: int = WORD_BITS) -> Column:
    """Whether the key's bit is in a bitmap."""
    word, bit = of.bitwiseAND((1 << bits) - 1).cast("int"), F.shiftright(of, bits).bitwiseAND(63).cast("int")
    return F.call_function("shiftright", F.get(words, word), bit).bitwiseAND(1) == 1


def templates(ws: Column) -> Column:
    """For an array of words, array of (t, s, n): template word, slot (the bare word for a placeholder, else null), and the bare word where it is
    capitalised at the start of a sentence, so that it may be a name."""
    # most words are plain: one pattern decides, and the bare word is the word itself
    words = F.transform(ws, lambda w: F.transform(F.array(w.rlike(PLAIN)), lambda p: F.struct(
        w.alias("w"), F.when(p, w).otherwise(F.regexp_replace(w, EDGE, "")).alias("b"), p.alias("plain")))[0])
    nothing = F.lit(None).cast("string")

    def one(all_words: Column, x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(all_words, i - 1))
        unit = F.lower(x["b"]).isin(*UNITS) & F.coalesce(before["b"].rlike(NUMBER), F.lit(False))
        upper = x["b"].rlike(r"^\p{Lu}[\p{Ll}'’-]+$")
        inside = F.coalesce(~before["w"].rlike(r"[.!?:;\"”»|]$"), F.lit(False))
        kind = F.when(unit, "<unit>").when(x["plain"], F.lit(None)).when(x["b"].rlike(NUMBER), "<num>").when(
            upper, F.when(inside, "<name>").otherwise(OPEN))
        full = F.transform(F.array(kind), lambda k: F.struct(
            F.when(k != OPEN, k).otherwise(F.when(x["b"] == "", x["w"]).otherwise(F.lower(x["b"]))).alias("t"),
            F.when(k != OPEN, x["b"]).alias("s"), F.when(k == OPEN, x["b"]).alias("n")))[0]
        return F.when(x["plain"] & ~x["w"].isin(*UNITS), F.struct(
            x["w"].alias("t"), nothing.alias("s"), nothing.alias("n"))).otherwise(full)

    # bound once by the outer lambda, so no step computes the words again
    return F.flatten(F.transform(F.array(words), lambda ws: F.transform(ws, lambda x, i: one(ws, x, i))))


def heads(words: Column, head: int, skip: Column) -> Column:
    """Array of one (literal, named): hash of the first ``head`` template words behind ``skip`` in both readings, the second one
    null without an open word."""
    def both(ts: Column) -> Column:
        named = F.transform(ts, lambda x: F.when(x["n"].isNotNull(), "<name>").otherwise(x["t"]))
        return F.struct(F.xxhash64(F.transform(ts, lambda x: x["t"])).alias("literal"),
                        F.when(F.exists(ts, lambda x: x["n"].isNotNull()), F.xxhash64(named)).alias("named"))

    return F.transform(F.array(behind(F.slice(words, 1, skip + head), skip)), both)


def behind(words: Column, skip: Column) -> Column:
    """Templates of the words behind ``skip`` ones, which only tell what the next one is."""
    return F.slice(templates(words), skip + 1, F.size(words))


def windows(words: Column, sizes: list[int], wides: Column | None = None, window: int = WINDOW, head: int = 1,
            skip: Column | None = None) -> Column:
    """Array of (h, at, slots, key, size, head) of each window of each size; slots are (offset, value).

    ``key`` hashes the template words alone, ``head`` are the first ``head`` of them. With ``skip`` only windows that
    begin behind so many words are read.
    Windows that hold an open word come twice, the second time with all their open words as names. ``wides`` are the sizes
    to read around windows of ``window`` words with too few literal words, where the longer one has enough."""

    def key(keys: Column, size, i: Column) -> Column:
        return F.xxhash64(size, F.slice(keys, i, size))

    def spelled(ts: Column, keys: Column, size: Column, places: Column) -> Column:
        def one(i: Column) -> Column:
            slots = F.filter(F.transform(F.slice(ts, i, size), lambda x, k: F.struct(k.alias("o"), x["s"].alias("v"))),
                             lambda x: x["v"].isNotNull())
            return F.transform(F.array(slots), lambda z: F.struct(
                F.when(size - F.size(z) < F.least(F.lit(LITERALS), size), F.xxhash64(key(keys, size, i), z)).otherwise(
                    key(keys, size, i)).alias("h"),
                (i - 1).alias("at"), z.alias("slots"), key(keys, size, i).alias("key"), size.alias("size"),
                F.transform(F.slice(ts, i, head), lambda x: x["t"]).alias("head")))[0]

        return F.when(F.size(ts) >= size, F.transform(places, one))

    none = F.expr("cast(array() as array<struct<h: bigint, at: int, slots: array<struct<o: int, v: string>>, key: bigint, size: int, head: array<string>>>)")
    nowhere = F.expr("cast(array() as array<int>)")

    def positions(ts: Column, field: str) -> Column:
        return F.filter(F.transform(ts, lambda x, i: F.when(x[field].isNotNull(), i + 1)), lambda i: i.isNotNull())

    def around(ts: Column, size: Column, ranges: Column) -> Column:
        """Begins of the windows that hold a range (lo, hi) of positions."""
        return F.array_distinct(F.flatten(F.transform(ranges, lambda r: F.sequence(
            F.greatest(F.lit(1), r["hi"] - size + 1), F.least(r["lo"], F.size(ts) - size + 1)))))

    def dense(ts: Column) -> Column:
        """Ranges of slots that leave a window too few literal words."""
        gap = max(0, window - LITERALS)
        return F.flatten(F.transform(F.array(positions(ts, "s")), lambda q: F.filter(
            F.transform(F.slice(q, 1, F.greatest(F.size(q) - gap, F.lit(0))), lambda lo, j: F.struct(lo.alias("lo"), F.get(q, j + gap).alias("hi"))),
            lambda r: r["hi"] - r["lo"] < window)))

    def begins(ts: Column, size: Column, live: Column | None, ranges: Column | None, holds) -> Column:
        """Begins of windows: of all, or those around ``ranges``; of the ``live`` ones those that ``holds``."""
        if live is not None:
            return F.filter(live, lambda i: holds(F.slice(ts, i, size))) if holds else live
        return F.sequence(F.lit(1), F.size(ts) - size + 1) if ranges is None else around(ts, size, ranges)

    def reading(ts: Column, keys: Column, opened: Column | None, live: Column | None) -> Column:
        parts = []
        for n in sizes:
            holds = None if opened is None else lambda part: F.exists(part, lambda x: x["o"])
            parts.append(F.coalesce(spelled(ts, keys, F.lit(n), begins(ts, F.lit(n), live, opened, holds)), none))
        if wides is not None:
            def wide(size: Column, runs: Column | None) -> Column:
                places = begins(ts, size, live, runs, lambda part: F.size(dense(part)) > 0)
                return F.coalesce(spelled(ts, keys, size, F.filter(places, lambda i: (
                    F.size(F.filter(F.slice(ts, i, size), lambda x: x["s"].isNull())) >= LITERALS))), none)

            if live is None:
                parts.append(F.flatten(F.flatten(F.transform(F.array(dense(ts)), lambda runs: F.transform(
                    F.when(F.size(runs) > 0, wides).otherwise(nowhere), lambda size: wide(size, runs))))))
            else:
                parts.append(F.flatten(F.transform(wides, lambda size: wide(size, None))))
        return F.flatten(F.array(*parts))

    def both(ts: Column, keys: Column, live: Column | None) -> Column:
        named = F.transform(ts, lambda x: F.struct(
            F.coalesce(x["n"], x["s"]).alias("s"), x["n"].isNotNull().alias("o"),
            F.when(x["n"].isNotNull(), "<name>").otherwise(x["t"]).alias("t")))
        opened = F.transform(positions(ts, "n"), lambda i: F.struct(i.alias("lo"), i.alias("hi")))
        second = F.flatten(F.transform(F.array(named), lambda us: F.flatten(F.transform(
            F.array(F.transform(us, lambda x: F.xxhash64(x["t"]))), lambda ks: F.flatten(F.transform(
                F.array(opened), lambda o: F.when(F.size(o) > 0, reading(us, ks, o, live)).otherwise(none)))))))
        return F.concat(reading(ts, keys, None, live), second)

    live = None if skip is None else F.array(F.lit(1))
    found = F.array(templates(words) if skip is None else behind(words, skip))
    return F.flatten(F.transform(found, lambda ts: F.flatten(F.transform(
        F.array(F.transform(ts, lambda x: F.xxhash64(x["t"]))), lambda keys: both(ts, keys, live)))))


def bitmap(spark, keys: DataFrame, bits: int = WORD_BITS) -> Column:
    """The keys' bitmap of 2^bits words of 64 bits as one array (low bits of a key name the word, the six above them the bit):
    it only spares rows, the join decides. A fuller one spares fewer."""
    found = keys.select(F.col("key").bitwiseAND((1 << bits) - 1).cast("int").alias("word"), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.shiftright("key", bits).bitwiseAND(63).cast("int")).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = spark.range(1 << bits).select(F.col("id").cast("int").alias("word")).join(found, "word", "left").select(
        F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")).alias("x"))
    return every.agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["bits"]).alias("bits")).scalar()


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[int], list[int]]:
    """(item_id, h, item_at, item_slots, windows of the item), the window sizes that occur (at most ``window`` of them), and
    the longer sizes."""
    sized = benchmark.select("item_id", "text", F.size(words_of(F.col("text"))).alias("n")).where("n > 0").distinct()
    sizes = sorted(r[0] for r in sized.select(F.least("n", F.lit(window))).distinct().collect())
    longer = sorted(r[0] for r in sized.where(F.col("n") > window).select(F.least("n", F.lit(WIDE * window))).distinct().collect())
    found, head = None, min([HEAD, *sizes])
    for size in sizes:
        some = sized.where(F.col("n") == size if size < window else F.col("n") >= window)
        wides = F.when(F.col("n") > window, F.array(F.least("n", F.lit(WIDE * window)))).otherwise(F.expr("cast(array() as array<int>)"))
        one = some.select("item_id", (F.col("n") - size + 1).alias("n_windows"), F.explode(
            windows(words_of(F.col("text")), [size], wides=wides if size == window else None, window=window, head=head)).alias("w"))
        found = one if found is None else found.union(one)
    if found is None:
        found = sized.select("item_id", F.col("n").alias("n_windows"), F.explode(windows(words_of(F.col("text")), [1])).alias("w"))
    return found.select("item_id", "n_windows", F.col("w.h").alias("h"), F.col("w.at").alias("item_at"),
                        F.col("w.slots").alias("item_slots"), F.col("w.key").alias("key"), F.col("w.head").alias("head")), sizes, longer


def places(docs: DataFrame, items: DataFrame, text: str, head: int, longest: int) -> DataFrame:
    """doc_id, text_hash, begin, skip and words of the places of documents where a window of the benchmark's may begin: the
    ``longest`` words from there on, behind the one before them (``skip`` is 0 where there is none)."""
    chunks = [range(k, min(k + CHUNK, head)) for k in range(0, head, CHUNK)]
    known = None
    for chunk in chunks:
        rows = items.select("head").distinct().select(*[codes_of(F.get("head", F.lit(k))).alias(f"c{k}") for k in chunk])
        for k in chunk:
            rows = rows.withColumn(f"c{k}", F.explode(f"c{k}"))
        rows = rows.select(F.xxhash64(F.lit(chunk[0]), *[f"c{k}" for k in chunk]).alias("key"))
        known = rows if known is None else known.union(rows)
    masks = bitmap(docs.sparkSession, known, MASK_BITS)
    value = docs.select("doc_id", F.xxhash64(f"`{text}`").alias("text_hash"), words_of(F.col(f"`{text}`")).alias("ws")).withColumn(
        "codes", codes(F.col("ws")))
    # a row for each word; Spark compiles all of this step, and what leaves it is short
    rows = value.select("*", F.posexplode_outer("codes").alias("begin", "code"))
    found = functools.reduce(operator.and_, [is_set(masks, F.xxhash64(F.lit(chunk[0]), *[
        F.get("codes", F.col("begin") + k) for k in chunk]), MASK_BITS) for chunk in chunks], F.col("begin") <= F.size("codes") - head)
    skip = F.least(F.col("begin"), F.lit(1))
    return rows.where(found).select("doc_id", "text_hash", "begin", skip.alias("skip"), F.slice(
        "ws", F.col("begin") + 1 - skip, skip + longest).alias("words"))


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, text_hash, item_id, shift and windows that match at that alignment, with slots (position, item value, document value)."""
    items, sizes, longer = benchmark_windows(benchmark, window)
    head, longest = min([HEAD, *sizes]), max([1, *sizes, *longer])
    keys = bitmap(docs.sparkSession, items.select("key"))
    begun = bitmap(docs.sparkSession, items.select(F.xxhash64("head").alias("key")))
    # exploded, so that no filter on templates moves down into the compiled step
    parts = places(docs, items, text, head, longest).select("*", F.explode(heads(F.col("words"), head, F.col("skip"))).alias("head"))
    parts = parts.where(is_set(begun, F.col("head.literal")) | F.col("head.named").isNotNull() & is_set(begun, F.col("head.named")))
    items = items.drop("key", "head")
    if items.count() <= BROADCAST_ROWS:
        items = F.broadcast(items)
    wides = F.array(*[F.lit(n) for n in longer]) if longer else None
    rows = parts.select("doc_id", "text_hash", "begin", F.explode(
        windows(F.col("words"), sizes or [1], wides, window, head, F.col("skip"))).alias("w")).where(is_set(keys, F.col("w.key")))
    rows = rows.select("doc_id", "text_hash", F.col("w.h").alias("h"), (F.col("begin") + F.col("w.at")).alias("at"),
                       F.col("w.slots").alias("slots"), F.col("w.size").alias("size"))
    hits = rows.join(items, "h").select(
        "doc_id", "text_hash", "item_id", "n_windows", (F.col("at") - F.col("item_at")).alias("shift"),
        F.zip_with("item_slots", "slots", lambda a, b: F.struct(
            (F.col("item_at") + a["o"]).alias("at"), a["v"].alias("item"), b["v"].alias("doc"))).alias("all_slots"),
        # a longer window stands for the windows in it
        F.explode(F.sequence(F.col("item_at"), F.col("item_at") + F.greatest(F.col("size") - window, F.lit(0)))).alias("item_at"))
    return hits.select("doc_id", "text_hash", "item_id", "n_windows", "shift", "item_at", F.filter("all_slots", lambda x: (
        x["at"] >= F.col("item_at")) & (x["at"] < F.col("item_at") + window)).alias("slots"))


def consistent(hits: DataFrame) -> DataFrame:
    """The matched windows whose slots all equal the item's, or all follow their alignment's majority renaming.

    That renaming sends an item value to the document value it meets at most positions of the alignment; of as many, the
    equal value counts first. Two item values may meet one document value. One exchange, by document and item."""
    within = lambda *more: Window.partitionBy(*PAIR, "shift", *more)
    one = [*PAIR, "n_windows", "shift", "item_at", "slots"]
    rows = hits.repartition(*PAIR).select(*one).distinct().select(*one, F.explode_outer("slots").alias("x")).select(*one, "x.*")
    rows = rows.withColumn("once", (F.row_number().over(within("at").orderBy("item_at")) == 1).cast("int"))
    rows = rows.withColumn("votes", F.sum("once").over(within("item", "doc")))
    rows = rows.withColumn("most", F.max_by("doc", F.struct("votes", F.expr("item = doc"), "doc")).over(within("item")))
    same, renamed = (F.every(F.coalesce(F.expr(x), F.lit(True))) for x in ("item = doc", "doc = most"))
    return rows.groupBy(*one).agg(same.alias("same"), renamed.alias("renamed")).where("same or renamed")


def found_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """doc_id, text_hash, item_id and covered (the matched share of the item), for items found in a document."""
    return consistent(matches(docs, benchmark, text, window)).groupBy(*PAIR, "n_windows").agg(
        F.count_distinct("item_at").alias("n")).groupBy(*PAIR).agg(
        F.max(F.col("n") / F.col("n_windows")).alias("covered")).where(F.col("covered") >= cover)


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """doc_id, n_items, item_ids (sorted) and covered (the largest share) of each document that holds an item."""
    return found_items(docs, benchmark, text, window, cover).groupBy("doc_id", "text_hash").agg(
        F.count(F.lit(1)).alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"),
        F.max("covered").alias("covered")).drop("text_hash")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, cover: float = COVER) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    i, h, own = (fresh(x, docs) for x in ("gone_id", "gone_hash", "own_hash"))
    gone = found_items(docs, benchmark, text, window, cover).select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).distinct()
    keyed = docs.withColumn(own, F.xxhash64(f"`{text}`"))
    return keyed.join(gone, F.expr(f"doc_id <=> `{i}` and `{own}` = `{h}`"), "left_anti").drop(own)
