import random
import re

import numpy as np
import pytest

from formline.llm import ngram_join as nj
from formline.llm import queries


def shingle_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def by_hand(docs, k, percent):
    """All pairs of distinct sets that share a shingle. docs: [(id, text)]; result: sorted rows."""
    sets = [shingle_set(t, k) for _, t in docs]
    names = {s: i for i, s in enumerate(dict.fromkeys(s for s in sets if s))}
    kinds = list(names)
    where = {}
    for i, s in enumerate(kinds):
        for x in s:
            where.setdefault(x, []).append(i)
    parent = list(range(len(kinds)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(kinds):
        counts = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, c in counts.items():
            if 100 * c >= percent * (len(s) + len(kinds[j]) - c):
                parent[top(i)] = top(j)
    least = {}
    for (d, _), s in zip(docs, sets, strict=True):
        if s and d is not None:
            g = top(names[s])
            least[g] = min(d, least.get(g, d))
    return sorted(((d, len(s), least.get(top(names[s])) if s else d) for (d, _), s in zip(docs, sets, strict=True)), key=repr)


def run(spark, docs, k, percent):
    df = spark.createDataFrame([(d, t, 5, "c") for d, t in docs], "doc_id bigint, text string, n int, cid string")
    return sorted(map(tuple, nj.components(df.repartition(4), k=k, percent=percent).collect()), key=repr)


def corpus(seed, sizes, copies):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 60))
    docs = []
    for size in sizes:
        base = [word() for _ in range(size)]
        docs.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(text) + 1)
                text[at:at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            docs.append(" ".join(text))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    docs = corpus(1, [1, 2, 3, 6, 11, 13, 14, 17, 20, 21, 22, 25, 40, 60, 61, 90] * 3, 8)
    docs += [(900, None), (901, ""), (902, " \n"), (None, docs[3][1]), (None, "only here alone"), docs[5], docs[5]]
    assert run(spark, docs, k, percent) == by_hand(docs, k, percent)


def test_long_lists_and_chains(spark, monkeypatch):
    """A group of near copies far above a short list, a chain, and a passage that many share."""
    monkeypatch.setattr(nj, "SHORT", 3)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    docs = []
    for i in range(60):
        text = list(base)
        text[rng.randrange(80)] = f"x{i}"
        docs.append(" ".join(text))
    chain = [f"v{i}" for i in range(150)]
    docs += [" ".join(chain[i:i + 100]) for i in range(0, 40, 2)]
    passage = " ".join(f"p{i}" for i in range(30))
    docs += [passage + " " + " ".join(f"q{i}-{j}" for j in range(25)) for i in range(40)]
    docs = list(enumerate(docs))
    want = by_hand(docs, 3, 90)
    assert len({r[2] for r in want}) > 40
    for few in (1, 4):
        monkeypatch.setattr(nj, "FEW", few)
        assert run(spark, docs, 3, 90) == want


def test_whole_small_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op10_ngram_jaccard_join"](spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(docs, 3, 90)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "a"), (3, text + " tail", "b"), (3, text + " tail", "a"), (7, "", "x"), (8, "", "y"), (8, "", "y"),
            (9, None, "z"), (None, "alone in the world", "n"), (4, "alone in this world", "m")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, stay_id string")
    got = nj.one_each(docs)
    assert got.schema == docs.schema
    want = [rows[2], rows[3], rows[4], rows[6], rows[7], rows[8]]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert nj.components(none).collect() == [] and nj.one_each(none).collect() == []


def test_overlap_and_subsets():
    for percent in (80, 90):
        for n in range(1, 40):
            for m in nj.partners(n, percent):
                need = nj.overlap(n, m, percent)
                assert 100 * need >= percent * (n + m - need) and 100 * (need - 1) < percent * (n + m - need + 1)
        most = nj.boundary(percent)
        rng = np.random.default_rng(0)
        for _ in range(200):
            n, m = rng.integers(1, most + 1, 2)
            a = rng.choice(30, n, replace=False).astype(np.uint64)
            b = a.copy() if rng.random() < 0.7 else rng.choice(30, m, replace=False).astype(np.uint64)
            b = b[rng.random(len(b)) < 0.93]
            if not len(b):
                continue
            common = len(set(a.tolist()) & set(b.tolist()))
            linked = 100 * common >= percent * (len(a) + len(b) - common)
            ka = {x[:2] for x in nj.subsets(np.sort(a), percent, most) if x[2] == len(b)}
            kb = {x[:2] for x in nj.subsets(np.sort(b), percent, most) if x[2] == len(a)}
            assert bool(ka & kb) == linked


def test_sketches_rule_out_no_link(spark):
    """Whatever their sizes, linked sets pass; sets with nothing in common do not, unless they are too large to tell."""
    rng = np.random.default_rng(3)
    rows, pairs, links = [], [], set()
    for i, n in enumerate([1, 2, 7, 40, 300, 1000, 6000] * 3):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.concatenate([a[rng.integers(0, 1 + n // 15):], rng.integers(0, 1 << 63, rng.integers(0, 1 + n // 15), np.uint64)])
        other = rng.integers(0, 1 << 63, n, np.uint64)
        for kind, x in (("a", a), ("b", b), ("c", other)):
            words = {f"s{k}": int(w) for k, w in enumerate(nj.sketch(x))}
            rows.append({"cid": f"{kind}{i}".encode(), "n": len(x), **words})
        pairs += [(f"a{i}".encode(), f"b{i}".encode()), (f"a{i}".encode(), f"c{i}".encode())]
        common = len(np.intersect1d(a, b))
        if 100 * common >= 90 * (len(a) + len(b) - common):
            links.add((f"a{i}", f"b{i}"))
    words = ", ".join(f"s{k} bigint" for k in range(nj.SKETCH))
    sets = spark.createDataFrame(rows, f"cid binary, n int, {words}")
    left = {(bytes(r.a).decode(), bytes(r.b).decode()) for r in nj.near(
        spark.createDataFrame(pairs, "a binary, b binary"), sets, 90).collect()}
    assert links <= left and len(links) > 10
    assert {b for _, b in left if b[0] == "c"} <= {f"c{i}" for i in range(21) if i % 7 == 6}


@pytest.mark.parametrize("forest", [2, 10**6])
def test_contracted_links_join_the_same_classes(spark, monkeypatch, tmp_path, forest):
    monkeypatch.setattr(nj, "FOREST", forest)
    rng = random.Random(forest)
    name = lambda i: f"{i:03d}".encode()
    pairs = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)]
    least = list(range(200))
    for _ in range(200):
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    links = spark.createDataFrame([(name(a), name(b)) for a, b in pairs if a != b], "a binary, b binary").repartition(5)
    got = {int(bytes(r.cid)): int(bytes(r.label)) for r in nj.groups(links, f"{tmp_path}/g").collect()}
    assert got == {i: least[i] for p in pairs if p[0] != p[1] for i in p}


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_list_an_equal_part(percent):
    """Linked sets share a key at every size and few keys are listed; sets with nothing in common hardly ever meet."""
    rng = np.random.default_rng(percent)
    links, met = 0, 0
    for _ in range(400):
        n = int(rng.integers(10, 700))
        a = rng.integers(0, 1 << 64, n, np.uint64)
        gone, new = rng.integers(0, 2 + n * (100 - percent) // 100, 2)
        b = np.concatenate([a[gone:], rng.integers(0, 1 << 64, new, np.uint64)])
        c = rng.integers(0, 1 << 64, n, np.uint64)
        ka, kb, kc = (set(nj.parts(np.sort(x), percent).tolist()) for x in (a, b, c))
        assert len(ka) <= 2 * (nj.apart(n, percent) + 1)
        if 100 * (n - gone) >= percent * (n + new):
            links += 1
            assert ka & kb
        met += n > 100 and bool(ka & kc)
    assert links > 50 and met < 10


def jobs_of(spark, step):
    """The result of ``step`` and the number of Spark jobs it ran."""
    sc = spark.sparkContext
    group = f"jobs-{random.random()}"
    sc.setJobGroup(group, "")
    try:
        return step(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_bitmap_takes_few_jobs(spark):
    """However many partitions the shuffle has, its words come by one job, not by one for each partition."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    at = [0, 5, 63, 64, 5, (1 << nj.MAP_BITS) - 1, 12345, 12345 + 64]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        bits, jobs = jobs_of(spark, lambda: nj.bitmap(spark.createDataFrame([(x,) for x in at], "at bigint")))
        none = nj.bitmap(spark.createDataFrame([], "at bigint"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert jobs <= 5
    assert not none.any() and len(none) == len(bits) == 1 << nj.MAP_BITS - 6
    assert np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")).tolist() == sorted(set(at))


@pytest.mark.parametrize("links_a_task", [None, 7])
def test_few_links_are_contracted_at_once(spark, tmp_path, monkeypatch, links_a_task):
    """Links in many partitions: few of them meet in one task and need no star steps; dealt to several they give the same."""
    if links_a_task:
        monkeypatch.setattr(nj, "LINKS", links_a_task)
    rng = random.Random(4)
    name = lambda i: i.to_bytes(16, "big")
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 200), (200, 201)]
    rng.shuffle(pairs)
    pairs = [p[::rng.choice((1, -1))] for p in pairs]
    links = spark.createDataFrame([(bytearray(name(a)), bytearray(name(b))) for a, b in pairs], "a binary, b binary").repartition(20)
    got = [(int.from_bytes(r.cid, "big"), int.from_bytes(r.label, "big")) for r in nj.groups(links, str(tmp_path)).collect()]
    want = [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 130)] + [(200, 200), (201, 200)]
    assert sorted(got) == want
    assert any(p.name.startswith("star") for p in tmp_path.iterdir()) == bool(links_a_task)
