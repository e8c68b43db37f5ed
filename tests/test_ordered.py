"""Plain and split plans must give the same rows, and frames must never see the current row."""

import random
import statistics

import pandas as pd
import pytest

from pyspark.sql import functions as F

from formline.operators.ordered import Frame, _hot_positions, hot_keys, positions, ranked, rolling, running_total, top_n


def skewed(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else (None if rng.random() < 0.1 else f"e{rng.randrange(12)}")
        day = rng.randrange(40)
        value = None if rng.random() < 0.1 else rng.randrange(100)
        rows.append((key, day, i, value))
    return spark.createDataFrame(rows, "k string, day int, id int, v long")


FRAMES = [
    Frame("m5", "mean", "v", 5), Frame("m10", "mean", "v", 10), Frame("mall", "mean", "v"),
    Frame("s5", "std", "v", 5), Frame("nall", "count", "v"), Frame("tall", "sum", "v"),
    Frame("prev", "lag", "day", 1), Frame("sall", "std", "v"), Frame("days", "std", "day"),
]


def frame_of(df):
    pdf = df.toPandas().sort_values("id").reset_index(drop=True)
    return pdf.reindex(sorted(pdf.columns), axis=1)


def brute(rows):
    out = []
    for r in rows:
        prior = sorted(
            (q for q in rows if q["k"] == r["k"] and (q["day"], q["id"]) < (r["day"], r["id"])),
            key=lambda q: (q["day"], q["id"]),
        )
        vals = [q["v"] for q in prior]

        def mean(xs):
            xs = [x for x in xs if x is not None]
            return sum(xs) / len(xs) if xs else None

        out.append((r["id"], mean(vals[-5:]), mean(vals[-10:]), mean(vals),
                    len([v for v in vals if v is not None])))
    return out


def test_rolling_matches_brute_force(spark):
    df = skewed(spark)
    got = {r["id"]: r for r in rolling(df, ["k"], ["day", "id"], FRAMES).collect()}
    for i, m5, m10, mall, n in brute([r.asDict() for r in df.collect()]):
        assert got[i]["m5"] == m5 and got[i]["m10"] == m10 and got[i]["mall"] == mall
        assert got[i]["nall"] == n


def test_split_equals_plain(spark):
    df = skewed(spark)
    plain = frame_of(rolling(df, ["k"], ["day", "id"], FRAMES))
    spark.conf.set("spark.formline.smallInputBytes", "0")
    spark.conf.set("spark.formline.splitRows", "12")
    try:
        cut = rolling(df, ["k"], ["day", "id"], FRAMES)
        assert "__chunk" in cut._jdf.queryExecution().toString()
        pd.testing.assert_frame_equal(plain, frame_of(cut))
    finally:
        spark.conf.unset("spark.formline.smallInputBytes")
        spark.conf.unset("spark.formline.splitRows")


def test_positions_and_ranks_split(split):
    df = skewed(split).fillna({"k": "none"})
    rows = [r.asDict() for r in df.collect()]
    got = {r["id"]: r["position"] for r in positions(df, ["k"], ["-day", "id"]).collect()}
    everyone = {r["id"]: r["position"] for r in positions(df, [], ["day", "id"]).collect()}
    rank = {r["id"]: r["r"] for r in ranked(df, ["k"], {"r": ["-day"]}).collect()}
    total = sorted(rows, key=lambda r: (r["day"], r["id"]))
    for i, r in enumerate(total):
        assert everyone[r["id"]] == i + 1
    for r in rows:
        mine = [q for q in rows if q["k"] == r["k"]]
        assert got[r["id"]] == 1 + sum((-q["day"], q["id"]) < (-r["day"], r["id"]) for q in mine)
        assert rank[r["id"]] == 1 + sum(q["day"] > r["day"] for q in mine)


def test_string_and_time_order_split(split):
    df = skewed(split).selectExpr(
        "k", "id", "md5(cast(id as string)) as h", "timestamp_seconds(day * 86400) as ts", "date_add(date'2024-01-01', day) d"
    )
    rows = df.collect()
    for col in ("h", "ts", "d"):
        got = {r["id"]: r["position"] for r in positions(df, [], [col, "id"]).collect()}
        for i, r in enumerate(sorted(rows, key=lambda r: (r[col], r["id"]))):
            assert got[r["id"]] == i + 1


def test_large_derived_input_is_written_once(split):
    from formline.operators.ordered import is_scan, settled

    scan = skewed(split)
    derived = scan.groupBy("k", "day", "id").agg({"v": "max"}).withColumnRenamed("max(v)", "v")
    assert is_scan(scan.filter("day > 1").select("k", "day")) and not is_scan(derived)
    files, hot = settled(derived, ["k"])
    assert is_scan(files) and hot is not None and hot.rows > 12
    got = frame_of(rolling(derived, ["k"], ["day", "id"], FRAMES))
    split.conf.set("spark.formline.smallInputBytes", str(2**62))
    pd.testing.assert_frame_equal(got, frame_of(rolling(scan, ["k"], ["day", "id"], FRAMES)))


def test_running_total_and_top(split):
    df = split.createDataFrame([(d, d * 2) for d in range(50)], "d int, x int")
    rows = {r["d"]: r["t"] for r in running_total(df, [], ["d"], "x", "t").collect()}
    assert all(rows[d] == d * (d + 1) for d in range(50))
    assert [r["d"] for r in top_n(df, [], ["-d"], 2).collect()] == [49, 48]


def test_future_change_leaves_past_features(spark):
    df = skewed(spark)
    changed = df.selectExpr("k", "day", "id", "CASE WHEN day >= 20 THEN 9999L ELSE v END v")
    a = rolling(df, ["k"], ["day", "id"], FRAMES).filter("day <= 20").drop("v")
    b = rolling(changed, ["k"], ["day", "id"], FRAMES).filter("day <= 20").drop("v")
    first_of_day20 = a.filter("day < 20")
    pd.testing.assert_frame_equal(frame_of(first_of_day20), frame_of(b.filter("day < 20")))


def test_partitioning_does_not_matter(spark):
    df = skewed(spark)
    a = frame_of(rolling(df.repartition(1), ["k"], ["day", "id"], FRAMES))
    b = frame_of(rolling(df.repartition(7).orderBy("v"), ["k"], ["day", "id"], FRAMES))
    pd.testing.assert_frame_equal(a, b)


def test_nan_descending_and_zoneless_time_on_the_split_path(spark, split):
    from formline.operators.ordered import positions

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = [("a", i, float("nan") if i % 10 == 0 else (None if i % 7 == 0 else float(i % 23)),
                 f"2024-11-03 0{i % 3}:{i % 60:02d}:00.{i:06d}") for i in range(90)]
        df = spark.createDataFrame(rows, "k string, i int, v double, s string").withColumn("t", F.to_timestamp_ntz("s"))
        for order in (["-v", "i"], ["v", "i"], ["t", "i"], ["-t", "i"]):
            got = {r["i"]: r["n"] for r in positions(df, ["k"], order, "n").collect()}
            spark.conf.set("spark.formline.smallInputBytes", str(1 << 30))
            want = {r["i"]: r["n"] for r in positions(df, ["k"], order, "n").collect()}
            spark.conf.set("spark.formline.smallInputBytes", "0")
            assert got == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def pieces_of(df, entity, order):
    """Rows in the largest and the number of pieces of the split path."""
    hot = hot_keys(df, entity)
    placed = _hot_positions(df, hot, entity, order, "p")
    paths = {f.rsplit("/", 1)[0] for f in placed.inputFiles() if "formline-pieces" in f}
    sizes = df.sparkSession.read.parquet(*paths).groupBy("__piece").count().collect()
    return max(r["count"] for r in sizes), len(sizes)


def test_long_common_beginnings_and_equal_first_keys_are_cut(split):
    df = split.range(600).selectExpr("id", "concat(repeat('same beginning ', 40), lpad(id * 37 % 600, 4, '0')) s", "date'2024-01-01' d", "1 one")
    for order in (["s", "id"], ["-s", "id"], ["d", "id"], ["one"]):
        most, n = pieces_of(df, [], order)
        assert n > 50 and most < 60, (order, most, n)
    got = {r["id"]: r["position"] for r in positions(df, [], ["d", "-s"]).collect()}
    assert got == {i: 600 - i * 37 % 600 for i in range(600)}
    # rows that are equal in all order columns still get different places
    assert sorted(r["position"] for r in positions(df, [], ["one"]).collect()) == list(range(1, 601))


def test_unbounded_deviation_of_far_and_missing_values(split):
    rows = [("a", i, None if i < 40 or i % 7 == 0 else 1e9 + i % 5) for i in range(300)] + [("b", 1, 2.0), ("b", 2, None)]
    df = split.createDataFrame(rows, "k string, id int, v double")
    got = {(r["k"], r["id"]): r["s"] for r in rolling(df, ["k"], ["id"], [Frame("s", "std", "v")]).collect()}
    for k, i, _ in rows:
        mine = [v for kk, j, v in rows if kk == k and j < i and v is not None]
        want = statistics.stdev(mine) if len(mine) > 1 else None
        assert got[k, i] == (None if want is None else pytest.approx(want, rel=1e-6)), (k, i)
