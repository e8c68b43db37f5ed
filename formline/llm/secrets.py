"""Secrets by patterns and by sliding-window entropy, in SQL functions only.

Base kinds, leftmost and without overlaps: ``assign`` (a credential name, colon or equals sign, a value of 8 characters or
more), ``access`` (AKIA and capitals or digits, 16 or more), ``hex`` (32 or more lower-case hex digits). Positions come
from the lengths of matches and of the text between them, so a text is scanned twice for each kind it can hold.

``entropy`` adds random-looking strings. A candidate is a run of base-64 characters with a digit and a letter. It is read
by a window of its class: hex digits only, letters and digits, or any. The window keeps a count for each character and the
sum of c log2 c over the counts; one step adds the incoming and takes the outgoing character, so it costs one array update.
The sum is kept in millionths, as whole numbers, so no rounding builds up. The span covers all windows whose entropy
reaches the class's limit. An allow list suppresses candidates that are well known and harmless (UUIDs, dates, numbers with
a unit, counted-up or repeated characters), and spans inside base spans are left out.

Positions are code points, end exclusive. Null and empty texts have no spans. Rows are independent: repeated rows and ids
give equal results; other columns stay, and columns of a result's name are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formline.llm.common import fresh, without

BASE = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Pattern and the test its matches must pass. In access and hex the least length is in the pattern: a run of one class
#: holds the same matches either way.
PATTERNS = {
    "assign": (ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8),
    "access": (r"AKIA[A-Z0-9]{12,}", None),
    "hex": (r"[0-9a-f]{32,}", None),
}
CANDIDATE = r"[A-Za-z0-9+/=_-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"
#: Class by pattern of the whole candidate, in this order: window, least entropy in millionths of a bit.
CLASSES = [("[0-9a-fA-F]+", 20, 3_000_000), ("[A-Za-z0-9]+", 20, 3_500_000), (".+", 20, 3_700_000)]
#: Candidates that are no secrets.
ALLOW = [
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", r"[0-9_/=+-]+[A-Za-z]{0,3}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T_-].*", r"(?i).*(example|sample|dummy|placeholder).*", r"(.{1,8})\1+.{0,8}",
    r"(?i).*(0123456789|abcdefghij).*", r"[A-Za-z]+[0-9]{1,4}", r"(?:[A-Za-z]{2,}[0-9]{0,2}[/_=+-])+[A-Za-z]*[0-9]{0,4}",
]
F_OF = [round(c * math.log2(c) * 1e6) if c else 0 for c in range(65)]  # c log2 c in millionths


def spans_of(text: Column, kind: str) -> Column:
    """Spans of one kind, in order."""
    pattern, test = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(text.rlike(pattern), place(text, matches, pattern, kind, test)).otherwise(no_spans())


def no_spans() -> Column:
    return F.expr("cast(array() as array<struct<kind: string, begin: int, end: int>>)")


def span(kind: str, begin: Column, end: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), begin.cast("int").alias("begin"), end.cast("int").alias("end"))


def located(text: Column, matches: Column, pattern: str) -> Column:
    """Structs (m, e) of each match and the position behind it."""
    pairs = F.arrays_zip(matches.alias("m"), F.split(text, pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<m: string, e: int>>)").alias("out"))

    def step(acc, x):
        end = acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(
            F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), end.alias("e"))))).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def place(text: Column, matches: Column, pattern: str, kind: str, test) -> Column:
    at = located(text, matches, pattern)
    if test:
        at = F.filter(at, lambda x: test(x["m"]))
    return F.transform(at, lambda x: span(kind, x["e"] - F.length(x["m"]), x["e"]))


def window_hits(word: Column, window: int, limit: int) -> Column:
    """Array of the window begins (from 0) whose entropy is ``limit`` or more, by incremental counts.

    Entropy is log2 W - S / W with S the sum of c log2 c, so it reaches the limit where S <= W (log2 W - limit)."""
    most = math.floor(window * (math.log2(window) * 1e6 - limit))
    table = F.array(*[F.lit(x).cast("bigint") for x in F_OF[:window + 2]])

    def step(acc: Column, i: Column) -> Column:
        code = F.position(F.substring(word, i, F.lit(1)), F.lit(ALPHABET))
        old = F.position(F.substring(word, i - window, F.lit(1)), F.lit(ALPHABET))
        leaves = i > window
        # the outgoing character first
        c_old = F.get(acc["counts"], old - 1)
        sum_out = acc["sum"] - F.when(leaves, F.get(table, c_old) - F.get(table, c_old - 1)).otherwise(F.lit(0))
        c_new = F.get(acc["counts"], code - 1) - F.when(leaves & (old == code), 1).otherwise(0)
        total = sum_out + F.get(table, c_new + 1) - F.get(table, c_new)
        counts = F.transform(acc["counts"], lambda c, k: (
            c + F.when(k + 1 == code, 1).otherwise(0) - F.when(leaves & (k + 1 == old), 1).otherwise(0)))
        hit = (i >= window) & (total <= most)
        return F.struct(
            counts.alias("counts"), total.alias("sum"),
            F.when(hit, F.concat(acc["hits"], F.array(i - window))).otherwise(acc["hits"]).alias("hits"))

    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).cast("bigint").alias("sum"),
        F.expr("cast(array() as array<int>)").alias("hits"))
    return F.aggregate(F.sequence(F.lit(1), F.length(word)), start, step, lambda acc: acc["hits"])


def entropy_hits(word: Column) -> Column:
    """Hits and window of a candidate by its class; none if the allow list has it."""
    out = F.when(word.rlike("^(?:" + "|".join(f"(?:{p})" for p in unnested(ALLOW)) + ")$"), F.expr("cast(array() as array<int>)"))
    for pattern, window, limit in CLASSES:
        out = out.when(word.rlike(f"^{pattern}$"), window_hits(word, window, limit))
    return out


def unnested(patterns: list[str]) -> list[str]:
    """The patterns with inline flags kept to themselves and back references by name."""
    out = []
    for i, p in enumerate(patterns):
        if p.startswith("(?i)"):
            p = f"(?i:{p[4:]})"
        out.append(p.replace(r"(.{1,8})\1", rf"(?<r{i}>.{{1,8}})\k<r{i}>"))
    return out


def find(docs: DataFrame, text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with an array ``name`` of (kind, begin, end) by begin, then kind as listed."""
    base, words = fresh("base_spans", docs), fresh("candidates", docs)
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.withColumn(base, F.concat(*[spans_of(value, k) for k in BASE]))
    # candidates with a digit and a letter
    at = located(value, F.regexp_extract_all(value, F.lit(CANDIDATE), F.lit(0)), CANDIDATE)
    mixed = F.filter(at, lambda x: x["m"].rlike("[0-9]") & x["m"].rlike("[A-Za-z]"))
    found = found.withColumn(words, F.when(value.rlike(CANDIDATE), mixed).otherwise(
        F.expr("cast(array() as array<struct<m: string, e: int>>)")))
    window = CLASSES[0][1]  # all classes read the same width

    def hot(x: Column) -> Column:
        begin = x["e"] - F.length(x["m"])
        return F.transform(F.array(entropy_hits(x["m"])), lambda h: F.when(F.size(h) > 0, span(
            "entropy", begin + F.array_min(h), begin + F.array_max(h) + window)))[0]

    hits = F.filter(F.transform(F.col(words), hot), lambda s: s.isNotNull())
    outside = F.filter(hits, lambda s: ~F.exists(base, lambda b: (b["begin"] <= s["begin"]) & (s["end"] <= b["end"])))
    order = {k: i for i, k in enumerate([*BASE, "entropy"])}

    def rank(s: Column) -> Column:
        out = F.lit(order["entropy"])
        for k in BASE:
            out = F.when(s["kind"] == k, F.lit(order[k])).otherwise(out)
        return out

    keyed = F.array_sort(F.transform(F.concat(F.col(base), outside), lambda s: F.struct(
        s["begin"].alias("b"), rank(s).alias("r"), s["end"].alias("e"), s["kind"].alias("k"))))
    result = F.transform(keyed, lambda s: F.struct(s["k"].alias("kind"), s["b"].alias("begin"), s["e"].alias("end")))
    rest = [f"`{c}`" for c in without(docs, [name]).columns]
    return found.select(*rest, result.alias(name))
