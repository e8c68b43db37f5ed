import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from formline.llm import quality, queries

SF = "/root/testdata/sf0.01"


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


EDGES = [None, "", " \t\n\v\f\r", "a", "a b c d e f g h " * 3, "x\nx\n\n \nx ", "a\x85b　c\x1cd", "é" * 9 + "#|", "w " * 90_000,
         "a b c d e f g h i " * 2 + "a b c d e f g h"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c ", " ", "\n", "é", "#", "\x85", "\t"]), max_size=120).map("".join))
def test_counts_equal_brute_force(text):
    assert quality.text_stats(text)[:5] == by_hand(text)


def test_edges_and_whole_table(spark):
    for text in EDGES:
        assert quality.text_stats(text)[:5] == by_hand(text)
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_quality_rules"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == by_hand(docs[r.doc_id])
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [r for r in rows if not r.base_failed and r.doc_id in labels]
    assert all(r.kept for r in judged if labels[r.doc_id] == 1)
    bad = [r for r in judged if labels[r.doc_id] == 0]
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)


def test_covering_finds_two_planted_rules_in_order():
    rng = np.random.default_rng(0)
    x = {"u": rng.random(3000), "v": rng.random(3000), "w": rng.random(3000)}
    bad = (x["u"] > 0.8) | ((x["v"] <= 0.3) & (x["w"] > 0.6))
    rules = quality.learn_list(x, bad)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= quality.matches(rule, x, 3000)
    assert rules[0][0][:2] == ("u", ">") and (hit == bad).mean() > 0.99


def test_conditional_expression_equals_the_list(spark):
    rules = [[("mean_word", ">", 6.5)], [("distinct_share", "<=", 0.5), ("words_per_line", ">", 3.0)]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abcdefgh " * 30, "a b c d " * 9, "ab cd\n" * 40, None])],
                                 "doc_id int, text string")
    for r in quality.judge(docs, rules).collect():
        c = dict(zip(quality.COUNTS, quality.text_stats(docs.where(f"doc_id = {r.doc_id}").first().text), strict=True))
        x = {k: np.array([c[a] / max(c[b], 1)]) for k, (a, b) in quality.FEATURES.items()}
        fires = any(quality.matches(rule, x, 1)[0] for rule in rules)
        assert r.kept == (not r.base_failed and not fires)


def test_nulls_clashes_repeats_and_empty_tables(spark):
    schema = "doc_id bigint, text string, stats int, kept string, N_Words int"
    docs = spark.createDataFrame([(None, t, 1, "k", 2) for t in EDGES + EDGES[-1:]], schema)
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, quality int")
    rules = quality.learn(docs, labels)
    assert rules == []
    got = quality.judge(docs, rules)
    assert [c for c in got.columns if c.lower() in ("kept", "n_words")] == ["n_words", "kept"] and got.count() == len(EDGES) + 1
    good = quality.keep_good(docs, rules)
    assert good.columns == docs.columns and good.schema == docs.schema
    none = docs.limit(0)
    assert quality.learn(none, labels.limit(0)) == [] and quality.judge(none, []).collect() == []
