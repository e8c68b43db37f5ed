"""Joins on small frames, against plain Python."""

import random

from pyspark.sql import functions as F

from formline.operators import features as X
from formline.operators import joins as J
from formline.operators import logs as L
from formline.plans import build


def test_containing_names_equals_all_pairs(spark):
    rng = random.Random(3)
    names = [("".join(rng.choice("ab c") for _ in range(rng.randrange(12))), rng.choice("xyz")) for _ in range(80)] + [(None, "x"), ("abc", None)]
    needles = [("".join(rng.choice("abcd ") for _ in range(rng.randrange(6))), rng.choice("xy")) for _ in range(60)] + [(None, "x"), ("a", None)]
    got = J.containing_names(spark.createDataFrame(needles, "needle string, k string"), spark.createDataFrame(names, "name string, k string"), "k")
    want = {(k, n, m) for n, k in needles for m, j in names if k and k == j and n and m and n in m}
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and want


def test_fallback_only_without_exact_history(spark):
    props = spark.createDataFrame([(1, "Al Smith", "PTS"), (2, "J SMITH", "PTS"), (3, "No One", "PTS"), (4, "Al Smith", "REB")],
                                  "i int, name string, kind string")
    history = spark.createDataFrame([("Al Smith", "PTS", 1, 10.0), ("Smithson", "PTS", 5, 11.0), ("Bo Smith", "PTS", 3, 12.0)],
                                    "name string, kind string, t int, v double")
    got = J.asof_by_last_token(props, history, "name", "kind", ["t"], ["v"]).collect()
    assert {(r["i"], r["v"]) for r in got} == {(2, 11.0)}


def test_attach_never_fans_out(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "g int, k string")
    ctx = spark.createDataFrame([("a", 5), ("a", 4), ("c", 1)], "k string, v int")
    assert sorted((r["g"], r["C_v"]) for r in J.attach(rows, ctx, {"k": "k"}, ["v"], "C_").fillna(0).collect()) == [(1, 4), (2, 0), (3, 0)]


def test_recent_hit_rate(spark):
    props = spark.createDataFrame([("a", 3.0, 100), ("b", 3.0, None)], "k string, line double, odds int")
    hist = spark.createDataFrame([("a", d, v) for d, v in enumerate([9, 9, 1, 5, 3, None])], "k string, d int, v int")
    got = {r["k"]: r for r in J.recent_hit_rate(props, hist, ["k"], ["-d"], "v", "line", "odds", 4).collect()}
    assert got["a"]["recent_prob"] == 0.25 and got["a"]["edge"] == -0.25
    assert (got["b"]["recent_prob"], got["b"]["implied_prob"]) == (0.5, 0.5)


def test_study_lookup_skips_unknown_criteria(spark):
    rows = spark.createDataFrame([(1, "STAR", "PTS", ["x"]), (2, "BENCH", "PTS", ["y"]), (3, "STAR", "REB", [])],
                                 "study_id int, tier string, prop string, context_tags array<string>")

    def find(*a):
        return [r["study_id"] for r in L.study_lookup(rows, *a, ["study_id"]).collect()]

    assert find("STAR", None, None) == [1, 3] and find("NOBODY", "PTS", None) == [1, 2]
    assert find(None, "PTS", ["y", "z"]) == [2] and find("STAR", "PTS", ["none"]) == [1]


def test_feature_requests_bounds(spark):
    rows = [(f"f{i % 12}", f"c{i}", i, i) for i in range(70)] + [("f0", "late", 999, 999)]
    log = spark.createDataFrame(rows, "feature string, context string, timestamp int, request_id int")
    got = {r["feature"]: r for r in L.feature_requests(log, 2).collect()}
    assert len(got) == 10 and got["f0"]["requests"] == 7 and got["f0"]["contexts"] == "c0; c12" and got["f0"]["priority"] == "HIGH"


def test_team_rates_survive_zero_minutes_and_missing_opponent(spark):
    cols = "game int, team string, opponent string, fga int, fta int, oreb int, tov int, reb int, ast int, fg3a int, score int, allowed int, minutes double"
    team = spark.createDataFrame([(1, "a", "b", 80, 20, 10, 12, 40, 20, 30, 100, 90, 240.0), (1, "b", "a", 0, 0, 0, 0, 1, 1, 1, 90, 100, 0.0),
                                  (2, "a", "c", 80, 20, 10, 12, 40, 20, 30, 100, 90, 240.0)], cols)
    take = ["fga", "fta", "oreb", "tov", "reb", "ast", "fg3a"]
    got = {(r["game"], r["team"]): r for r in X.team_rates(X.opponent_rows(team, "game", "team", "opponent", take)).collect()}
    assert got[1, "b"]["Team_Pace_Game"] is None and got[1, "b"]["Team_Def_Rating_Game"] is None
    assert got[2, "a"]["Allowed_REB_Game"] is None and abs(got[1, "a"]["Team_Def_Rating_Game"] - 9000 / 90.8) < 1e-9


STATS = {"PTS": "points", "REB": "rebounds", "AST": "assists", "3PM": "threes"}


def box(spark, bump=0):
    rng = random.Random(8)
    rows = []
    for e in range(4):
        for g in range(20):
            v = [rng.randrange(30) for _ in range(5)]
            if e == 1 and g == 12:
                v = [x + bump for x in v]
            rows.append((e, e * 100 + g, g, "s1" if g < 10 else "s2", g % 2, *v))
    df = spark.createDataFrame(rows, "entity_id int, game_id int, g int, season string, home int, points int, rebounds int, assists int, threes int, minutes int")
    return df.withColumn("game_date", F.date_add(F.lit("2025-01-01").cast("date"), F.col("g"))).drop("g")


def test_changing_a_game_changes_only_later_rows_of_its_entity(spark):
    cols = build.Columns(stats=STATS)
    drop = list(STATS.values()) + ["minutes"]
    a = {r["game_id"]: r for r in build.engineer(box(spark), cols).drop(*drop).collect()}
    b = {r["game_id"]: r for r in build.engineer(box(spark, 50), cols).drop(*drop).collect()}
    changed = {g for g in a if a[g] != b[g]}
    assert changed and all(100 < g < 200 and g > 112 for g in changed)


def test_dataset_keeps_no_outcome_measure(spark):
    lines = box(spark).select("entity_id", "game_id", F.explode(F.array(*[F.lit(p) for p in STATS])).alias("prop"),
                              F.lit(15.0).alias("line"), F.lit(-110).alias("odds"))
    out = build.build_dataset(box(spark), lines, build.Columns(stats=STATS))
    assert not set(out.columns) & ({*STATS.values(), "minutes"}) and out.count() == 320
    for r in out.select("actual_value", "line", "outcome").collect():
        assert r["outcome"] == int(r["actual_value"] > r["line"])


def test_season_restarts_the_season_mean(spark):
    rows = build.engineer(box(spark), build.Columns(stats=STATS)).filter("entity_id = 0").orderBy("game_id").collect()
    assert rows[0]["Season_Avg_PTS"] is None and rows[1]["Season_Avg_PTS"] == rows[0]["points"]
    assert rows[10]["Season_Avg_PTS"] is None and rows[11]["Season_Avg_PTS"] == rows[10]["points"]
    assert rows[10]["L5_Avg_PTS"] == sum(r["points"] for r in rows[5:10]) / 5
