import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formline.llm import line_dedup


def by_hand(docs, least):
    """Every run of ``least`` words or more, compared with every earlier one. docs: (doc_id, text), distinct."""
    seen, out = {}, {}
    for key in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = (key[1] or "").split("\n")
        words = [len(x.encode().split()) for x in lines]
        gone = set()
        runs = [(b, e) for b in range(len(lines)) for e in range(b + 1, len(lines) + 1) if sum(words[b:e]) >= least]
        for b, e in runs:
            run = tuple(lines[b:e])
            doc, at = seen.setdefault(run, (key, b))
            if (doc, at) != (key, b):
                gone |= set(range(max(b, at + e - b) if doc == key else b, e))
        out[key] = None if key[1] is None else "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def run(spark, docs, least):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, text_hash int, cut_id string")
    got = line_dedup.dedup(df.repartition(3), least=least)
    assert got.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 4))) for _ in range(12)]
    passages = [[rng.choice(pool) for _ in range(rng.randint(2, 6))] for _ in range(4)]
    docs = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 5)):
            lines += rng.choice(passages) if rng.random() < 0.4 else [rng.choice(pool) + f" {rng.randint(0, 9)}"]
        docs.append((i, "\n".join(lines)))
    want = by_hand(docs, 6)
    assert run(spark, docs, 6) == sorted(((k[0], v) for k, v in want.items()), key=repr)


def test_edges(spark):
    long = "\n".join(f"line {i} of a very long text" for i in range(30_000))
    passage = "p " * 60
    docs = [(None, passage), (1, None), (2, ""), (3, passage + "\nown words here"), (4, f"{passage}\n{passage}\n{passage}"),
            (5, long), (6, long + "\ntail"), (7, "short\nshort"), (8, "short\nshort"), (9, "x\n" * 100)]
    got = run(spark, docs + docs[3:5], 50)
    want = by_hand([d for d in docs if d[0] not in (5, 6, 9)], 50)
    for i, t in got:
        if i in (5, 6):
            assert t == (long if i == 5 else "tail")
        elif i != 9:
            assert t == want[i, dict(docs)[i]]
    # repeats within one document go too, the first 50 lines of the period stay
    assert dict(got)[9] == "\n".join([*["x"] * 50, ""])
    assert len(got) == len(docs) + 2 and dict(got)[4] == "" and dict(got)[3] == "own words here"


def test_clashing_names(spark):
    names = ["k_text_hash", "text_hash", "text_key", "cut_id", "CUT_SPANS"]
    rows = [(i, "p " * 60, 7 + i, *"abcd") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, k_text_hash int, text_hash string, text_key string, cut_id string, CUT_SPANS string")
    got = line_dedup.dedup(docs)
    assert got.schema == docs.schema and got.columns[2:] == names
    assert sorted(tuple(r) for r in got.collect()) == [rows[0], *[(i, "", 7 + i, *"abcd") for i in (1, 2)]]


def test_empty_table(spark):
    assert line_dedup.dedup(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5)), max_size=40), st.integers(1, 12))
def test_every_window_has_its_leftmost_minimum(lines, least):
    hashes, words = (np.array([x[k] for x in lines], np.int64) for k in (0, 1))
    ends = line_dedup.forward_ends(words, least)
    want = set()
    for i in range(len(lines)):
        e = next((e for e in range(i + 1, len(lines) + 1) if words[i:e].sum() >= least), -1)
        assert ends[i] == e
        if e > 0:
            want.add(i + int(np.argmin(hashes[i:e])))
    assert line_dedup.fingerprints(hashes, ends).tolist() == sorted(want)
    begins = line_dedup.backward_begins(words, least)
    for i in range(len(lines)):
        assert begins[i] == next((b for b in range(i, -1, -1) if words[b:i + 1].sum() >= least), -1)


def test_memory_is_given_back_after_the_task(monkeypatch):
    """What a task holds ends before the allocators are asked to give memory back; its batches pass as they are."""
    import weakref

    import pyarrow as pa

    from formline.llm import common

    class Held:
        pass

    alive, seen = [], []

    def task(batches):
        held = Held()
        alive.append(weakref.ref(held))
        yield from batches

    class Pool:
        def release_unused(self):
            seen.append(alive[0]() is None)

    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert list(common.trimmed(task)(iter([1, 2, 3]))) == [1, 2, 3] and seen == [True]
