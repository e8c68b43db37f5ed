import random
import re
from collections import Counter

import pytest

from formline.llm import decontam, queries

ITEM = ("A farmer named Alice has 12 apples and gives 5 apples to Bob before Alice walks 3 km to the market "
        "and sells the rest of the apples there for 40 dollars in total")


EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w%]+$|^_+|_+$")
DIGITS = re.compile(r"^[$€£(+-]*[0-9][0-9.,:/]*(%|st|nd|rd|th)?$")


def readings(text):
    """The (template word, slot) lists of a text: capitalised words that begin sentences as words, then as names; and where
    those words stand."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    bare = [EDGES.sub("", w) for w in words]
    plain, named, opened = [], [], set()
    for i, (w, b) in enumerate(zip(words, bare, strict=True)):
        name = b[:1].isupper() and len(b) > 1 and all(c.islower() or c in "'’-" for c in b[1:])
        kind = None
        if i and b.lower() in decontam.UNITS and DIGITS.match(bare[i - 1]):
            kind = "<unit>"
        elif DIGITS.match(b):
            kind = "<num>"
        elif name and i and words[i - 1][-1] not in ".!?:;\"”»|":
            kind = "<name>"
        plain.append((kind or b.lower() or w, b if kind else None))
        named.append(("<name>", b) if name and not kind else plain[-1])
        if name and not kind:
            opened.add(i)
    return plain, named, opened


def wins(text, sizes, wides, size=decontam.WINDOW):
    """(hash, begin, slots, length) of the windows of both readings."""
    plain, named, opened = readings(text)
    for ts, must in ((plain, None), (named, opened)):
        if must is not None and not must:
            continue
        slot = [i for i, (_, s) in enumerate(ts) if s is not None]
        gap = max(0, size - decontam.LITERALS)
        dense = [(lo, hi) for lo, hi in zip(slot, slot[gap:], strict=False) if hi - lo < size]
        for n in [*sizes, *wides]:
            for i in range(len(ts) - n + 1):
                part = ts[i:i + n]
                slots = [(k, s) for k, (_, s) in enumerate(part) if s is not None]
                if n in sizes and must is not None and not must & set(range(i, i + n)):
                    continue
                if n not in sizes and (n - len(slots) < decontam.LITERALS or not any(i <= lo and hi < i + n for lo, hi in dense)):
                    continue
                poor = n - len(slots) < min(decontam.LITERALS, n)
                yield (n, tuple(t for t, _ in part), tuple(slots) if poor else None), i, slots, n


def by_hand(docs, items, size=decontam.WINDOW, cover=decontam.COVER):
    """The same rules on Python lists: {doc row: {item: share}}."""
    lengths = {item: len(readings(body)[0]) for item, body in items}
    wide = decontam.WIDE * size
    sizes = sorted({min(n, size) for n in lengths.values() if n})
    longer = sorted({min(n, wide) for n in lengths.values() if n > size})
    place = {}
    for item, body in items:
        n = lengths[item]
        for key, i, slots, _ in wins(body, [min(n, size)] if n else [], [min(n, wide)] if n > size else [], size):
            place.setdefault(key, set()).add((item, i, tuple(slots)))
    found = []
    for text in docs:
        hits = {}  # (item, shift) to windows, and to the values at each position
        for key, at, slots, n in wins(text, sizes, longer, size):
            for item, i, own in place.get(key, ()):
                windows, values = hits.setdefault((item, at - i), (set(), {}))
                pairs = [(i + k, a, b) for (k, a), (_, b) in zip(own, slots, strict=True)]
                for j in range(i, i + max(n - size, 0) + 1):
                    mine = tuple(x for x in pairs if j <= x[0] < j + size)
                    windows.add((j, mine))
                    values.update({p: (a, b) for p, a, b in mine})
        best = {}
        for (item, _), (windows, values) in hits.items():
            votes = {}
            for a, b in values.values():
                votes.setdefault(a, Counter())[b] += 1
            most = {a: max(v, key=lambda b: (v[b], a == b, b)) for a, v in votes.items()}
            good = {j for j, mine in windows if all(a == b for _, a, b in mine) or all(b == most[a] for _, a, b in mine)}
            best.setdefault(item, set()).update(good)
        share = {item: len(g) / (lengths[item] - min(lengths[item], size) + 1) for item, g in best.items()}
        found.append({item: s for item, s in share.items() if s >= cover})
    return found


def run(spark, docs, items):
    df = spark.createDataFrame([(i, t, "x", 2) for i, t in enumerate(docs)], "doc_id bigint, text string, h string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (list(r.item_ids), r.covered) for r in decontam.contaminated(df, bench).collect()}
    want = {i: (sorted(b), max(b.values())) for i, b in enumerate(by_hand(docs, items)) if b}
    assert got == want
    return got


def test_reparameterised_questions(spark):
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "99").replace(" 5 ", " 7 ").replace("km", "miles")
    mixed = ITEM.replace("Alice has", "Carol has")  # the second Alice stays
    docs = [ITEM, "Intro words here. " + other + " and more words", mixed, "nothing of the kind at all", None, "", ITEM[:60],
            ITEM.upper(), f"{ITEM}\n{other}", "1 2 3 4 5 6 7 8 9 10 11 12", "x " * 30_000 + other, other, other]
    items = [(1, ITEM), (2, "1 2 3 4 5 6 7 8 9"), (3, ""), (4, None), (5, "short item"), (6, "9 8 7 6 5 4 3 2 1 0")]
    got = run(spark, docs + ["a short item here"], items)
    assert all(1 in got[i][0] for i in (0, 1, 2, 10)) and got[2][1] < 1 and 3 not in got
    assert got[9][0] == [2] and got[13][0] == [5]


def test_edited_and_dense_passages(spark):
    """Two readings, wide windows, several alignments and edits at random places."""
    rng = random.Random(4)
    texts = [ITEM, "Tom has 5 apples. Tom eats 2 apples. Tom buys 7 pears. Tom sells 3 pears.",
             "we add 3 4 5 6 7 8 and then take away 9 10 11 12 13 from all", "Points: Ann 4 Bob 5 Cid 6 are all there", "A. B. Cee 4"]
    docs = []
    for _ in range(60):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(words))
            words[k:k + rng.randrange(2)] = [rng.choice(["Anna", "Tom.", "7", "12", "km", "and", "Bob", "apples."])]
        docs.append(" ".join(rng.choice(texts).split()[:rng.randrange(9)] + words))
    run(spark, docs, list(enumerate(texts)))


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = [(b.item_id, b.text) for b in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: list(r.item_ids) for r in queries.QUERIES["op1_decontamination"](spark, sf).collect()}
    want = {d.doc_id: sorted(b) for d, b in zip(docs, by_hand([d.text for d in docs], items), strict=True) if b}
    assert got == want and got


def test_filter_keeps_clean_rows_and_columns(spark):
    rows = [(None, ITEM, "a", 1), (1, ITEM, "b", 2), (2, "clean text", "c", 3), (None, None, "d", 4), (2, "clean text", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, gone_id string, own_hash int")
    bench = spark.createDataFrame([(1, ITEM)], "item_id bigint, text string")
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.schema == docs.schema and sorted(map(tuple, kept.collect()), key=repr) == sorted(rows[2:], key=repr)
    assert decontam.drop_contaminated(docs, bench.limit(0)).count() == 5
    assert decontam.contaminated(docs.limit(0), bench).collect() == []


@pytest.mark.parametrize("rows", [1, 10**9])
def test_broadcast_is_only_a_plan(spark, monkeypatch, rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    assert run(spark, [ITEM, "none"], [(7, ITEM)]) == {0: ([7], 1.0)}


def test_no_python_in_the_plan(spark):
    plan = queries.QUERIES["op1_decontamination"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
