"""The filters in front of the templates lose no window and leave few places."""

import random

from pyspark.sql import functions as F

from formline.llm import decontam as D

ODD = ["a", "in", "m", "5", "7,5", "(12)", "Berlin", "The", "the", "the,", '"the', "end.", "abc ", "abc", "abc,", "abc,\u2028", "x2", "iPad", "--", "ß", "ÉTÉ",
       "été", "min", "min.", "Min", "%", "5%", "3rd", "and", "or", "sum"]


def plain_codes(words):
    import re
    breaks = "\\n\\r\x85\u2028\u2029"
    stem = lambda w: (m := re.fullmatch(rf"[^\w$€£%+-]*([a-zß-öø-ÿ]+)[^\w%{breaks}]*", w)) and m[1] or ""
    out = [stem(w) for w in words]
    return [(D.ANY if w.lower() != w or re.search(f"[{breaks}]", w) else D.OTHER) if not c else
            D.OTHER if c in D.UNITS and (i == 0 or not out[i - 1]) else c for i, (c, w) in enumerate(zip(out, words, strict=True))]


def test_codes(spark):
    rng = random.Random(1)
    texts = [[rng.choice(ODD) for _ in range(12)] for _ in range(200)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, ws array<string>").select(
        "i", D.codes(F.col("ws")).alias("codes")).collect()
    words = sorted({c for t in texts for c in plain_codes(t) if isinstance(c, str)})
    named = dict(spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w")).collect())
    for r in rows:
        assert r.codes == [named.get(c, c) for c in plain_codes(texts[r.i])]


def test_no_window_is_lost(spark):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(ODD) for _ in range(rng.choice([2, 5, 8, 9, 15, 16, 30])))) for i in range(40)]
    docs = []
    for i in range(60):
        words = [rng.choice(ODD) for _ in range(10)]
        for _ in range(2):
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(items)[1].split(" ")
        docs.append((i, " ".join(words)))
    docs += [(90, ""), (91, None), (92, items[0][1]), (93, "a")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = D.matches(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), bench)
    own, sizes, longer = D.benchmark_windows(bench)
    wides = F.array(*[F.lit(n) for n in longer])
    whole = spark.createDataFrame(docs, "doc_id bigint, text string").select("doc_id", F.explode(
        D.windows(D.words_of(F.col("text")), sizes, wides)).alias("w")).select("doc_id", "w.h", "w.at", "w.size")
    want = whole.join(own, "h").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift"), F.explode(
        F.sequence("item_at", F.col("item_at") + F.greatest(F.col("size") - D.WINDOW, F.lit(0)))).alias("item_at"))
    cols = ["doc_id", "item_id", "shift", "item_at"]
    want, got = ({tuple(r) for r in x.select(*cols).distinct().collect()} for x in (want, got))
    assert want == got and len(got) > 300


def test_few_places_get_templates(spark):
    """Words that are not the benchmark's leave the plan before templates are made."""
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id bigint, text string")
    text = " ".join(f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr") + " one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    places = D.places(docs, D.benchmark_windows(bench)[0], "text", 8, 16)
    assert sorted(r.begin for r in places.collect()) == [64, 65, 66]
