"""Constrained selection against plain Python over whole slates."""

import random
from itertools import combinations

import pytest

from formline.operators import select as T
from formline.operators import slips
from formline.operators.ordered import top_n
from pyspark.sql import functions as F


def slate_rows(n=300, seed=1, players=25, slates=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        slate = "big" if rng.random() < 0.5 else f"s{rng.randrange(slates)}"
        rows.append((slate, i, f"p{rng.randrange(players)}", rng.choice(["PTS", "REB", "AST", "3PM"]), rng.randrange(6)))
    return rows


def scan(rows, per_player, per_type, total):
    out = []
    for slate in sorted({r[0] for r in rows}):
        players, types, taken = {}, {}, []
        for r in sorted((r for r in rows if r[0] == slate), key=lambda r: (-r[4], r[1])):
            if len(taken) >= total:
                break
            if players.get(r[2], 0) >= per_player or types.get(r[3], 0) >= per_type:
                continue
            players[r[2]] = players.get(r[2], 0) + 1
            types[r[3]] = types.get(r[3], 0) + 1
            taken.append(r[1])
        out += [(slate, i) for i in taken]
    return set(out)


@pytest.mark.parametrize("caps,players,seed", [((3, 8, 20), 25, 1), ((1, 2, 5), 4, 2), ((2, 3, 100), 3, 3), ((2, 50, 9), 2, 4)])
def test_greedy_caps_equals_full_scan(spark, caps, players, seed):
    rows = slate_rows(seed=seed, players=players)
    df = spark.createDataFrame(rows, "slate string, id int, player string, prop string, conf int")
    got = {(r["slate"], r["id"]) for r in T.greedy_caps(df, ["slate"], "player", "prop", ["-conf", "id"], *caps).collect()}
    assert got == scan(rows, *caps)


def test_greedy_reach_is_enough_without_spark():
    """The cut keeps everything a scan takes, on many random slates."""
    rng = random.Random(9)
    for _ in range(300):
        caps = (rng.randrange(1, 4), rng.randrange(1, 6), rng.randrange(1, 15))
        rows = slate_rows(n=rng.randrange(5, 200), seed=rng.random(), players=rng.randrange(1, 12))
        kinds = rng.choice([4, 30, 2000])
        rows = [(s, i, p, f"t{rng.randrange(kinds)}", c) for s, i, p, _, c in rows]
        per_player, per_type, total = caps
        in_type, of_player, in_all = T.greedy_reach(*caps)

        def cut(rows, key, n):
            seen, out = {}, []
            for r in sorted(rows, key=lambda r: (-r[4], r[1])):
                k = key(r)
                seen[k] = seen.get(k, 0) + 1
                if seen[k] <= n:
                    out.append(r)
            return out

        kept = cut(rows, lambda r: (r[0], r[2], r[3]), per_player)
        kept = cut(kept, lambda r: (r[0], r[2]), of_player)
        kept = cut(kept, lambda r: (r[0], r[3]), in_type)
        kept = cut(kept, lambda r: r[0], in_all)
        assert scan(kept, *caps) == scan(rows, *caps)


def picks(spark, n=60, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.randrange(6)
        rows.append(("a" if i % 3 else "b", i, t, t ^ 1, rng.choice(["POINTS", "ASSISTS", "REB"]), rng.choice(["OVER", "UNDER"]),
                     float(rng.choice([0, 5, 13])), float(rng.choice([210, 240])), rng.randrange(1, 10)))
    cols = "slate string, pick int, team int, opponent int, prop string, side string, spread double, total double, confidence int"
    return rows, spark.createDataFrame(rows, cols)


NAMES = ["slate", "pick", "team", "opponent", "prop", "side", "spread", "total", "confidence"]


def label(p, q):
    same = p["team"] == q["team"]
    over = p["side"] == q["side"] == "OVER"
    if same and p["prop"] == q["prop"] and over:
        return "negative"
    if same and {p["prop"], q["prop"]} == {"POINTS", "ASSISTS"}:
        return "positive"
    if (p["opponent"] == q["team"] or p["team"] == q["opponent"]) and max(p["spread"], q["spread"]) > 12:
        return "negative"
    if min(p["total"], q["total"]) > 235 and over:
        return "positive"
    return "neutral"


def test_pair_counts_match_all_pairs(spark):
    rows, df = picks(spark)
    want = {}
    for slate in "ab":
        mine = [dict(zip(NAMES, r)) for r in rows if r[0] == slate]
        for p, q in combinations(mine, 2):
            want[slate, label(p, q)] = want.get((slate, label(p, q)), 0) + 1
            assert slips.negative(p, q) == (label(p, q) == "negative")
    got = {(r["slate"], r["relation"]): r["pairs"] for r in slips.pair_correlation(df, "slate").collect()}
    assert got == want


def test_slips_hold_no_negative_pair_and_use_picks_once(spark):
    rows, df = picks(spark)
    by_id = {r[1]: dict(zip(NAMES, r)) for r in rows}
    for build, size in ((slips.power_slips, 2), (slips.flex_slips, 5)):
        legs = build(df, "slate", "pick", ["-confidence", "pick"]).collect()
        groups = {}
        for r in legs:
            groups.setdefault((r["slate"], r["slip"]), []).append(r["pick"])
        assert groups and all(len(g) == size for g in groups.values())
        used = [p for g in groups.values() for p in g]
        assert len(used) == len(set(used))
        for g in groups.values():
            pairs = combinations([by_id[p] for p in g], 2)
            assert all(label(p, q) != "negative" for p, q in pairs)


def test_safe_slip_agrees_with_pairs(spark):
    rows, df = picks(spark, 80, 6)
    leg = F.struct("pick", "team", "opponent", "prop", "side", "spread", "total")
    got = df.withColumn("slip", F.floor(F.col("pick") / 4)).groupBy("slip").agg(F.collect_list(leg).alias("legs"))
    got = {r["slip"]: r["safe"] for r in got.select("slip", slips.safe_slip(F.col("legs")).alias("safe")).collect()}
    for k, safe in got.items():
        mine = [dict(zip(NAMES, r)) for r in rows if r[1] // 4 == k]
        assert safe == all(label(p, q) != "negative" for p, q in combinations(mine, 2))


def test_long_slate_has_no_limit(spark):
    df = spark.range(6000).selectExpr("'s' slate", "int(id) pick", "int(id) team", "-1 opponent", "'REB' prop", "'OVER' side",
                                      "0D spread", "220D total", "5 confidence")
    got = slips.power_slips(df, "slate", "pick", ["pick"]).collect()
    assert {(r["slip"], r["leg"], r["pick"]) for r in got} == {(i // 2 + 1, i % 2 + 1, i) for i in range(6000)}


def test_quota_fill_order(spark):
    rows = [("g", p, i) for p, n in (("PTS", 6), ("REB", 1), ("3PM", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "game string, prop string, i int")
    got = {(r["prop"], r["i"]) for r in T.quota_fill(df, "game", "prop", ["i"], 8).collect()}
    first = {("PTS", 0), ("PTS", 1), ("REB", 0), ("3PM", 0), ("3PM", 1)}
    assert got == first | {("PTS", 2), ("PTS", 3), ("PTS", 4)}


def test_samples_repeat_and_cover(spark):
    df = spark.createDataFrame([(f"g{i % 5}", ["PTS", "REB"][i % 2], i) for i in range(200)], "game string, prop string, id int")
    a = T.stratified_sample(df, "game", "prop", ["id"], 40).collect()
    b = T.stratified_sample(df.repartition(7), "game", "prop", ["id"], 40).collect()
    assert sorted(a) == sorted(b)
    counts = {}
    for r in a:
        counts[r["game"], r["prop"]] = counts.get((r["game"], r["prop"]), 0) + 1
    assert set(counts.values()) == {2} and len(counts) == 10
    d = T.diverse_sample(df.withColumn("p", F.col("id") % 11), "prop", "p", ["id"], ["id"], 23)
    assert d.count() == 23 and d.select("id").distinct().count() == 23


def test_one_player_in_many_types_costs_no_pick(spark):
    """A closed player that holds a row in every type must not push others out of reach."""
    rows = [("s", i, "p0", f"t{i}", 9) for i in range(1200)] + [("s", 2000 + i, f"q{i}", f"t{i}", 1) for i in range(50)]
    df = spark.createDataFrame(rows, "slate string, id int, player string, prop string, conf int")
    for caps in ((1, 8, 75), (3, 8, 75)):
        got = {(r["slate"], r["id"]) for r in T.greedy_caps(df, ["slate"], "player", "prop", ["-conf", "id"], *caps).collect()}
        assert got == scan(rows, *caps) and len(got) == 50 + caps[0]


def test_missing_spreads_and_teams_in_slips(spark):
    cols = "slate string, pick int, team int, opponent int, prop string, side string, spread double, total double, confidence int"
    rows = [("s", 1, 1, 2, "REB", "OVER", 13.0, 220.0, 9), ("s", 2, 2, 1, "REB", "UNDER", None, 220.0, 8),
            ("s", 3, None, None, "REB", "OVER", None, None, 7), ("s", 4, None, None, "REB", "OVER", None, None, 6)]
    df = spark.createDataFrame(rows, cols)
    got = {(r["slip"], r["pick"]) for r in slips.power_slips(df, "slate", "pick", ["-confidence", "pick"]).collect()}
    assert got == {(1, 1), (1, 3), (2, 2), (2, 4)}
    count = {r["relation"]: r["pairs"] for r in slips.pair_correlation(df.filter("pick < 3"), "slate").collect()}
    assert count == {"negative": 1}


def test_power_slips_equal_a_scan_of_all_picks(spark):
    for seed, size in ((5, 2), (6, 3), (7, 2)):
        rows, df = picks(spark, 90, seed)
        want = set()
        for slate in "ab":
            legs = sorted((dict(zip(NAMES, r)) for r in rows if r[0] == slate), key=lambda p: (-p["confidence"], p["pick"]))
            used, n = set(), 0
            for lead in legs:
                if lead["pick"] in used:
                    continue
                used.add(lead["pick"])
                slip = [lead["pick"]]
                for other in legs:
                    if len(slip) < size and other["pick"] not in used and label(lead, other) != "negative":
                        slip.append(other["pick"])
                        used.add(other["pick"])
                if len(slip) == size:
                    n += 1
                    want |= {(slate, n, j + 1, p) for j, p in enumerate(slip)}
        got = slips.power_slips(df, "slate", "pick", ["-confidence", "pick"], size).collect()
        assert {tuple(r) for r in got} == want


def test_many_picks_on_one_slate_are_matched_in_time(spark):
    df = spark.range(60_000).selectExpr("'s' slate", "int(id) pick", "int(id % 30) team", "int((id % 30) + 1 - 2 * (id % 2)) opponent",
                                        "if(id % 3 = 0, 'REB', 'POINTS') prop", "if(id % 5 = 0, 'UNDER', 'OVER') side", "double(id % 17) spread",
                                        "220D total", "5 confidence")
    assert slips.power_slips(df, "slate", "pick", ["pick"]).count() == 60_000


def test_a_million_rows_on_one_slate(spark):
    df = spark.range(1_000_000).selectExpr("'s' slate", "id", "concat('p', hash(id) % 5000) player", "concat('t', id % 40) prop", "hash(id, 7) % 1000 conf")
    got = T.greedy_caps(df, ["slate"], "player", "prop", ["-conf", "id"], 3, 8, 75).collect()
    rows = [("s", r["id"], r["player"], r["prop"], r["conf"]) for r in df.orderBy(F.desc("conf"), "id").limit(20_000).collect()]
    assert {("s", r["id"]) for r in got} == scan(rows, 3, 8, 75)


def test_missing_players_are_one_player(spark):
    rows = [("s", i, None if i % 2 else "p", None if i % 3 else "t", 1) for i in range(12)]
    df = spark.createDataFrame(rows, "slate string, id int, player string, prop string, conf int")
    got = {(r["slate"], r["id"]) for r in T.greedy_caps(df, ["slate"], "player", "prop", ["-conf", "id"], 2, 3, 9).collect()}
    assert got == scan(rows, 2, 3, 9)


def test_long_tops_are_cut_bucket_by_bucket(spark):
    rows = [("g" if i % 3 else "h", (i * 7919) % 500, i) for i in range(6000)] + [("g", None, 6000), ("g", 3, 6001)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    for order, key in ((["v", "id"], lambda r: (r[1] is not None, r[1] or 0, r[2])), (["-v", "id"], lambda r: (r[1] is None, -(r[1] or 0), r[2]))):
        got = {(r["g"], r["id"], r["r"]) for r in top_n(df, ["g"], order, 1500, "r").collect()}
        want = set()
        for g in "gh":
            mine = sorted((r for r in rows if r[0] == g), key=key)[:1500]
            want |= {(g, r[2], i + 1) for i, r in enumerate(mine)}
        assert got == want
        plan = top_n(df, ["g"], order, 1500)._jdf.queryExecution().optimizedPlan().toString()
        assert "__bucket" in plan and "__bucket" not in top_n(df, ["g"], order, 1000)._jdf.queryExecution().optimizedPlan().toString()


def test_pair_counts_of_odd_picks(spark):
    """Missing values, teams that are their own opponents, equal picks."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        rows.append((rng.choice(["a", "b", None]), i, rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2, 3]),
                     rng.choice(["POINTS", "ASSISTS", "REB", None]), rng.choice(["OVER", "UNDER", None]),
                     rng.choice([None, 0.0, -13.0, 13.0]), rng.choice([None, 210.0, 240.0]), 1))
    df = spark.createDataFrame(rows, "slate string, pick int, team int, opponent int, prop string, side string, spread double, total double, confidence int")

    def same(a, b):
        return a is not None and a == b

    def relation(p, q):
        over = p["side"] == q["side"] == "OVER"
        team = same(p["team"], q["team"])
        if team and same(p["prop"], q["prop"]) and over:
            return "negative"
        if team and {p["prop"], q["prop"]} == {"POINTS", "ASSISTS"}:
            return "positive"
        if (same(p["opponent"], q["team"]) or same(p["team"], q["opponent"])) and max(abs(p["spread"] or 0), abs(q["spread"] or 0)) > 12:
            return "negative"
        return "positive" if over and min(p["total"] or 0, q["total"] or 0) > 235 else "neutral"

    want = {}
    for slate in ("a", "b", None):
        for p, q in combinations([dict(zip(NAMES, r)) for r in rows if r[0] == slate], 2):
            want[slate, relation(p, q)] = want.get((slate, relation(p, q)), 0) + 1
    got = slips.pair_correlation(df, "slate")
    assert {(r["slate"], r["relation"]): r["pairs"] for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert slips.pair_correlation(df.limit(0), "slate").count() == 0
