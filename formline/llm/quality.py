"""Quality rules: fixed base rules, and a decision list learned from labelled documents.

``with_stats`` counts words, symbols, repeated lines and repeated 8-word windows of whole texts. ``learn`` grows an ordered
list of conjunctions of thresholds on ratios of these counts by sequential covering: a rule grows by the condition of the
best information gain on one part of the labelled rows and is pruned on the other part, then the rows it covers are
removed. ``verdict`` turns the list into one ordered Spark conditional expression (rejected where a rule fires, else kept).

Learning takes at most ``SAMPLE_ROWS`` labelled documents, those of the smallest hash of their id; this is the only bound,
and everything else covers all rows. Without labels the list is empty and only the base rules reject.

Defined cases: a null text has no words and fails the base rules. Rows are judged one by one, so repeated rows get equal
verdicts. Labels with a null id or quality are left out; of contradicting labels the lower quality counts. Columns of the
input that have a result's name are replaced in ``judge``; ``keep_good`` returns the input's columns unchanged.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from formline.llm.common import WHITE, add_struct, fresh, without

WINDOW = 8
SAMPLE_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bangs", "n_distinct"]
#: Ratios that rules may test, by name: numerator and denominator.
FEATURES = {
    "symbols_per_word": ("n_symbols", "n_words"), "bangs_per_word": ("n_bangs", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "mean_word": ("word_chars", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "distinct_share": ("n_distinct", "n_words"), "words_per_line": ("n_words", "n_lines"),
}
POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], np.uint64)
_upper: np.ndarray | None = None


def upper_table() -> np.ndarray:
    global _upper
    if _upper is None:
        _upper = np.fromiter((chr(c).isupper() for c in range(0x110000)), bool, 0x110000)
    return _upper


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of ``WINDOW`` words that occur twice or more. Hashes propose, the words themselves decide."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    window = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        window += h[k:k + n] * POWERS[k]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    if not same.any():
        return 0
    often = np.zeros(n, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    at = np.flatnonzero(often).tolist()
    exact = Counter(tuple(words[i:i + WINDOW]) for i in at)
    edge = np.zeros(len(words) + 1, np.int64)
    for i in at:
        if exact[tuple(words[i:i + WINDOW])] > 1:
            edge[i] += 1
            edge[i + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(WHITE)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), int(upper_table()[codes].sum()), text.count("!"), len(set(words)),
    )


def with_stats(docs: DataFrame, text: str = "text", name: str = "stats") -> DataFrame:
    """``docs`` with a struct column of ``COUNTS``."""
    fields = StructType([StructField(c, LongType()) for c in COUNTS])
    kind = pa.struct([(c, pa.int64()) for c in COUNTS])

    def batch(texts: list) -> pa.Array:
        rows = np.array([text_stats(t) for t in texts], np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(rows[:, i], pa.int64()) for i in range(len(COUNTS))], fields=list(kind))

    return add_struct(docs, text, name, fields, batch)


def base_failed(stats: str) -> Column:
    n, again = F.col(f"`{stats}`.n_words"), F.col(f"`{stats}`.n_repeat_words")
    return (n < 20) | (again * 100 > n * 30)


# --- learning -------------------------------------------------------------------------------------------------------

Rule = list[tuple[str, str, float]]  # (feature, "<=" or ">", threshold), all of which hold


def matches(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for name, op, cut in rule:
        hit &= x[name] <= cut if op == "<=" else x[name] > cut
    return hit


def gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gain of covering p rejects and n keeps instead of p0 and n0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    rule: Rule = []
    live = np.ones(len(bad), bool)
    while len(rule) < most and (bad & live).any() and (~bad & live).any():
        best = (1e-9, None)
        p0, n0 = int((bad & live).sum()), int((~bad & live).sum())
        for name, values in x.items():
            v, b = values[live], bad[live]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            ends = np.flatnonzero(v[1:] > v[:-1])
            p = np.cumsum(b)[ends]
            n = ends + 1 - p
            for op, pp, nn in (("<=", p, n), (">", p0 - p, n0 - n)):
                if len(ends):
                    scores = gain(p0, n0, pp, nn)
                    k = int(np.argmax(scores))
                    if scores[k] > best[0]:
                        best = (scores[k], (name, op, float((v[ends[k]] + v[ends[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        live &= matches(rule[-1:], x, len(bad))
    return rule


def prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that does best on rows it was not grown on; the shorter of equals."""
    def worth(k: int) -> float:
        hit = matches(rule[:k], x, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0
    return rule[:max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.95, least: int = 3, most_rules: int = 12,
               most_conditions: int = 4) -> list[Rule]:
    """Sequential covering. A rule stays if it is ``precision`` right on the grown and on the pruning part and covers
    ``least`` rejects; every third row is for pruning."""
    found: list[Rule] = []
    at = np.arange(len(bad))
    left = np.ones(len(bad), bool)
    while len(found) < most_rules:
        a, b = left & (at % 3 != 0), left & (at % 3 == 0)
        rule = prune(grow({k: v[a] for k, v in x.items()}, bad[a], most_conditions), {k: v[b] for k, v in x.items()}, bad[b])
        hit = matches(rule, x, len(bad)) & left
        right = [(hit & part & bad).sum() >= precision * (hit & part).sum() for part in (a, b)]
        if not rule or (hit & bad).sum() < least or not all(right):
            break
        found.append(rule)
        left &= ~hit
    return found


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The decision list from at most ``rows`` labelled documents that pass the base rules."""
    picked = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    # at most ``rows`` pairs of numbers, so the hint has a bound
    texts = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "doc_id")
    table = with_stats(texts, "text").where(~base_failed("stats")).select("doc_id", "quality", "stats.*").toPandas()
    table = table.sort_values(["doc_id", *COUNTS], kind="stable")
    x = {k: table[a].to_numpy(float) / np.maximum(table[b].to_numpy(float), 1) for k, (a, b) in FEATURES.items()}
    return learn_list(x, table["quality"].to_numpy() == 0) if len(table) else []


def verdict(rules: list[Rule], stats: str) -> Column:
    """True where no rule fires: one conditional with a branch a rule, in the order of the list."""
    def value(name: str) -> Column:
        a, b = FEATURES[name]
        return F.col(f"`{stats}`.{a}").cast("double") / F.greatest(F.col(f"`{stats}`.{b}"), F.lit(1)).cast("double")
    out = None
    for rule in rules:
        fires = F.lit(True)
        for name, op, cut in rule:
            fires = fires & (value(name) <= F.lit(cut) if op == "<=" else value(name) > F.lit(cut))
        out = F.when(fires, F.lit(False)) if out is None else out.when(fires, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` without the text, with the counts, base_failed and kept."""
    stats = fresh("stats", docs)
    counted = with_stats(docs, text, stats)
    rest = [f"`{c}`" for c in without(docs, [text, *COUNTS, "base_failed", "kept"]).columns]
    failed = base_failed(stats)
    return counted.select(
        *rest, f"`{stats}`.*", failed.alias("base_failed"), (~failed & verdict(rules, stats)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The documents that pass, with their own columns."""
    stats = fresh("stats", docs)
    return with_stats(docs, text, stats).where(~base_failed(stats) & verdict(rules, stats)).drop(stats)
