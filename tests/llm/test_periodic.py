import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from formline.llm import periodic as P
from formline.llm.queries import QUERIES


def brute(w, repeats=P.REPEATS, least=P.WORDS):
    """Runs by comparing words at every distance; of the periods of one stretch the smallest."""
    out = {}
    for q in range(1, len(w) // repeats + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                out.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted([(s, n, q) for (s, n), q in out.items()], key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_with_periods(rng):
    k = rng.choice([1, 2, 3, 6])
    w = [bytes([97 + rng.randrange(k)]) for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        at, q = rng.randint(0, len(w)), rng.randint(1, 7)
        period = [bytes([97 + rng.randrange(k + 3)]) for _ in range(q)]
        w[at:at] = (period * 9)[:rng.randint(1, 9 * q)]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(1500):
        repeats, least = rng.choice([2, 3, 4, 5]), rng.choice([2, 4, 6, 9])
        texts = [words_with_periods(rng) for _ in range(3)] + [[]]
        want = [brute(w, repeats, least) for w in texts]
        assert P.batch_runs(texts, repeats, least) == want
        assert [P.runs_of(w, repeats, least) for w in texts] == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=80))
def test_few_words(w):
    assert P.batch_runs([w], 4, 6) == [brute(w)]
    assert P.collapse(w, brute(w)).decode() == kept([x.decode() for x in w], brute(w))


def test_equal_hashes_add_stretches_and_lose_none(monkeypatch):
    monkeypatch.setattr(P, "MIX", P.np.uint64(0))
    rng = random.Random(6)
    for _ in range(200):
        texts = [words_with_periods(rng) for _ in range(2)]
        assert P.batch_runs(texts, 4, 6) == [brute(w) for w in texts]


def test_slices_do_not_change_results(monkeypatch):
    rng = random.Random(7)
    texts = [b" ".join(words_with_periods(rng)).decode() for _ in range(60)]
    whole = P.read_batch(texts, 4, 6).to_pylist()
    monkeypatch.setattr(P, "SLICE", 50)
    assert P.read_batch(texts, 4, 6).to_pylist() == whole


@pytest.mark.parametrize("w", [[b"a"] * 200_000, [b"a", b"b"] * 100_000, [str(i % 40_000).encode() for i in range(200_000)]])
def test_long_texts(w):
    q = len(set(w))
    assert P.batch_runs([w], 4, 6) == [[(0, len(w), q)]]


def periodic_words(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    found = 0
    for doc_id, text in docs:
        w = [x.decode() for x in periodic_words(doc_id, text)]
        runs, r = brute(w), got[doc_id]
        found += len(runs)
        assert r["n_runs"] == len(runs)
        assert r["runs_sha256"] == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r["collapsed_sha256"] == sha(kept(w, runs))
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=None)
        shown = (r["start"], r["length"], r["period"], r["exponent_milli"])
        assert shown == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
    assert found > 5


def test_edges(spark):
    rows = [(1, None, 1, 2), (2, "", 1, 2), (3, " \n\t", 1, 2), (4, "x " * 6, 1, 2), (None, "x " * 6, 1, 2), (4, "x " * 6, 1, 2),
            (5, "a b " * 7 + "c\vd", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, RUNS int, periodic int")
    out = P.find_runs(docs)
    assert out.columns == ["doc_id", "text", "periodic", "runs", "collapsed"]
    got = sorted([(r["doc_id"] or 0, r["collapsed"], [tuple(x) for x in r["runs"]]) for r in out.collect()])
    assert got == [(0, "x", [(0, 6, 1)]), (1, "", []), (2, "", []), (3, "", []), (4, "x", [(0, 6, 1)]), (4, "x", [(0, 6, 1)]),
                   (5, "a b c d", [(0, 7, 1)])]
    assert P.find_runs(docs.limit(0)).count() == 0
    assert out.select(P.strongest("runs").alias("b")).where("b is null").count() == 3
