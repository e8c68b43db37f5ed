import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formline.llm import vector_codes as V
from formline.llm.queries import QUERIES
from formline.session import shared_dir


def plain(rows, parts=16, entries=64, rounds=2):
    """The same by Python's whole numbers, one comparison at a time."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: r[0])
    wide = max((len(r[1]) for r in kept), default=0)
    width = -(-wide // parts)
    cut = []
    for r in kept:
        v = [math.floor(256 * x) for x in r[1]] + [0] * (parts * width - len(r[1]))
        cut.append([v[p * width:(p + 1) * width] for p in range(parts)])
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(c[p], books[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(groups[i]) for col in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out, label_error = {}, {}
    for r, c in zip(kept, cut):
        best = [near(c[p], books[p]) for p in range(parts)]
        out[r[0]] = ("".join(f"{i:02x}" for _, i in best), sum(d for d, _ in best), r[2])
        label_error[r[2]] = label_error.get(r[2], 0) + out[r[0]][1]
    flat = ",".join(str(v) for b in books for e in b for v in e)
    return {k: (c, e, label_error[lb]) for k, (c, e, lb) in out.items()}, hashlib.sha256(flat.encode()).hexdigest()


def found(spark, rows, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")
    folder = f"{shared_dir(spark)}/vectors-{abs(hash(str(rows))):x}"
    frame.repartition(3).write.mode("overwrite").parquet(f"{folder}/embeddings.parquet")
    out = QUERIES["op13_vector_codes"](spark, folder).collect()
    return {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in out}, {r["codebooks_sha256"] for r in out}


def test_query_equals_plain(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.2, 48).astype(np.float32)], [None, 1, 2][i % 3]) for i in rng.permutation(150)]
    rows[3] = (rows[3][0], None, 1)
    rows[4][1][5] = None
    rows[5][1][0] = float("nan")
    rows[6][1][0] = float("-inf")
    rows[7] = (rows[7][0], list(rows[8][1]), None)  # ties
    want, digest = plain(rows)
    assert found(spark, rows) == (want, {digest})


def test_few_rows_and_odd_lengths(spark):
    rows = [(1, [0.5] * 20, 1), (2, [0.5] * 20, None), (3, [-0.001, 0.25], None), (9, [], 4)]
    want, digest = plain(rows)
    assert found(spark, rows) == (want, {digest})
    assert found(spark, [])[0] == {} and found(spark, [(1, None, 1)])[0] == {}
    assert found(spark, [(1, [], 1)])[0] == {1: ("00" * 16, 0, 0)}


def test_numbers_beyond_64_bits(spark):
    rows = [(i, [(-1) ** i * 1e20 * (i % 64 + j) for j in range(32)], 0) for i in range(70)]
    want, digest = plain(rows)
    assert {e for _, e, _ in want.values()} == {0}
    assert found(spark, rows, "double") == (want, {digest})


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, [0.1] * 16, 1, "c", 7), (1, [0.1] * 16, 1, "c", 7), (2, [0.4] * 16, 1, "c", 7), (None, [0.9] * 16, 1, "c", 7)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, CODE string, key int")
    books = V.train(frame, entries=2)
    coded = V.encode(frame, books)
    assert coded.columns == ["vec_id", "label", "key", "code", "error"] and coded.count() == 4
    total = V.with_total(coded, "label", "error", "label_error")
    assert {r["label_error"] for r in total.collect()} == {sum(r["error"] for r in coded.collect())}
    assert sorted(map(repr, V.with_total(coded, "label", "error", "label_error", most=0).collect())) == sorted(map(repr, total.collect()))


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 20), st.integers(1, 64), st.integers(0, 30), st.sampled_from([1, 3, 200, 10**6, 10**12]), st.integers(0, 10**6))
def test_nearest_equals_plain(width, entries, rows, top, seed):
    rng = np.random.default_rng(seed)
    x, e = rng.integers(-top, top + 1, (rows, width)), rng.integers(-top, top + 1, (entries, width))
    code, far = V.nearest(x, e)
    want = ((x[:, None].astype(object) - e[None].astype(object)) ** 2).sum(2)
    assert code.tolist() == [int(np.argmin(r)) for r in want] and far.tolist() == [min(r) for r in want.tolist()]


def test_sparse_and_dense_sums_agree(monkeypatch):
    rng = np.random.default_rng(4)
    x, e = rng.integers(-90, 90, (500, 16)), rng.integers(-90, 90, (64, 16))
    dense = V.nearest(x, e)
    monkeypatch.setattr(V, "SPARSE", 1)
    assert all((a == b).all() for a, b in zip(dense, V.nearest(x, e)))


def test_sequency_order():
    signs = V.walsh(np.eye(8, dtype=int)).T
    assert [sum(a != b for a, b in zip(r, r[1:])) for r in signs.tolist()] == list(range(8))


def test_decode():
    books = V.Codebooks(2, [[[1, 2], [3, 4]], [[5, 6], [7, 8]]])
    assert books.decode("0100") == [3, 4, 5, 6]
    with pytest.raises(ValueError):
        V.train(None, entries=300)
