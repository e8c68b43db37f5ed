"""Metrics, splits and model helpers on small frames."""

import math
import random

import pytest
from pyspark.sql import functions as F

from formline.operators import classify as C
from formline.operators import evaluate as E
from formline.operators import splits as P
from formline.plans import models as M


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, y int, p double")


def test_metrics_by_hand(spark):
    rows = [("a", 1, 1.0), ("a", 0, 0.0), ("a", 1, 0.5), ("a", 0, 0.5), ("a", 0, 0.7), ("b", 1, 0.2)]
    got = {r["g"]: r for r in E.binary_metrics(frame(spark, rows), "y", "p", ["g"]).collect()}
    a = got["a"]
    assert (a["total_bets"], a["wins"], a["losses"]) == (5, 3, 2)
    pairs = [(p > q) + 0.5 * (p == q) for y, p in [(r[1], r[2]) for r in rows[:5]] if y for z, q in [(r[1], r[2]) for r in rows[:5]] if not z]
    assert a["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    assert a["brier_score"] == pytest.approx((0 + 0 + 0.25 + 0.25 + 0.49) / 5)
    assert a["log_loss"] == pytest.approx((2 * math.log(2) - math.log(0.3)) / 5, abs=1e-9)
    assert a["hit_rate_70"] == 0.5 and a["n_bets_70"] == 2
    assert got["b"]["roc_auc"] is None and got["b"]["hit_rate_55"] is None
    assert E.metrics_by_type(frame(spark, rows), "y", "p", "g").count() == 1


def test_auc_equals_pairs_on_random_scores(spark):
    rng = random.Random(4)
    rows = [("x", rng.randrange(2), round(rng.random(), 1)) for _ in range(300)]
    auc = E.binary_metrics(frame(spark, rows), "y", "p").first()["roc_auc"]
    ones, zeros = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    want = sum((p > q) + 0.5 * (p == q) for p in ones for q in zeros) / len(ones) / len(zeros)
    assert auc == pytest.approx(want, abs=1e-12)


def pav(points):
    """Pool adjacent violators on (x, y, w) sorted by x."""
    pools = []
    for x, y, w in points:
        pools.append([y, w, [x]])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            w = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2] + b[2]])
    return {x: y for y, _, xs in pools for x in xs}


def test_isotonic_equals_pav_and_clips(spark):
    rng = random.Random(2)
    rows = [("x", int(rng.random() < i % 20 / 19), (i % 20) / 20) for i in range(400)]
    df = frame(spark, rows)
    out = {r["p"]: r["c"] for r in M.isotonic_calibrate(df, "p", "y").apply(df, "p", "c").collect()}
    groups = {}
    for _, y, p in rows:
        groups.setdefault(p, []).append(y)
    want = pav([(p, sum(v) / len(v), len(v)) for p, v in sorted(groups.items())])
    for p, c in out.items():
        assert c == pytest.approx(min(max(want[p], 0.01), 0.99), abs=1e-9)
    values = [out[p] for p in sorted(out)]
    assert values == sorted(values)


def days(spark, n=100, per=1):
    return spark.range(n * per).selectExpr(f"date_add(date'2024-01-01', int(id / {per})) d", "id", "int(id % 17) who", "int(id % 2) y")


def test_temporal_split_keeps_days_whole(spark):
    rows = P.temporal_split(days(spark, 10, 7), "d").collect()
    train, test = ({r["d"] for r in rows if r["split"] == s} for s in ("train", "test"))
    assert max(train) < min(test) and len(train) == 8
    three = P.three_way_split(days(spark, 100), "d").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in three} == {"train": 60, "calibrate": 20, "test": 20}


@pytest.mark.parametrize("n", [100, 103, 7])
def test_folds_expand_in_time(spark, n):
    rows = P.timeseries_folds(days(spark, n), ["d", "id"], 5).collect()
    size = n // 6
    for f in range(1, 6):
        val = [r["id"] for r in rows if r["block"] == f]
        assert len(val) == size
        assert max(r["id"] for r in rows if r["block"] < f) < min(val)
    roles = P.fold_roles(P.timeseries_folds(days(spark, n), ["d", "id"], 5)).filter("role = 'validate'")
    assert roles.count() == 5 * size


def test_group_holdout_whole_entities(spark):
    held = P.group_holdout(days(spark, 170), "who", 4).collect()
    for f in range(1, 5):
        assert len({r["who"] for r in held if r["fold"] == f}) == math.ceil(17 * 0.2)
    assert P.group_holdout(days(spark, 5), "who", 4).count() == 0


def test_calibration_last_bin_and_strict(spark):
    df = frame(spark, [("a", 1, 1.0), ("a", 0, 0.95), ("a", 1, 0.05)])
    loose = {r["bin"]: r["n"] for r in E.calibration_bins(df, "p", "y").collect()}
    strict = {r["bin"]: r["n"] for r in E.calibration_bins(df, "p", "y", True).collect()}
    assert loose == {9: 2, 0: 1} and strict == {9: 1, 0: 1}


def test_backtest_sides(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 0.6), ("2024-01-01", 0, 0.4), ("2024-01-02", 0, 0.7)], "d string, y int, p double")
    one = E.backtest_daily(df, "d", "p", "y").orderBy("day").collect()
    two = E.backtest_daily(df, "d", "p", "y", two_sided=True).orderBy("day").collect()
    assert [r["profit"] for r in one] == [100, -110] and one[1]["cumulative_profit"] == -10
    assert two[0]["profit"] == 200 and two[0]["n_bets"] == 2


def test_confidence_adjust(spark):
    log = spark.createDataFrame([(9, "STAR", "PTS", i < 3) for i in range(12)] + [(5, "BENCH", "REB", True)] * 3,
                                "confidence int, tier string, prop string, is_correct boolean")
    table = E.accuracy_table(log, ["confidence", "tier", "prop"], "is_correct")
    got = {r["confidence"]: r["calibrated_confidence"] for r in E.confidence_adjust(log, table, "confidence", "tier", "prop").collect()}
    assert got == {9: 6, 5: 5}


def test_tier_defaults_on_empty_statistics(spark):
    df = spark.createDataFrame([(40.0, None), (None, 26.0)], "pts double, mins double").selectExpr("pts", "mins * 0 + mins mins")
    empty = df.selectExpr("cast(null as double) pts", "cast(null as double) mins")
    limits = C.tier_limits(empty, "pts", "mins").first()
    assert (limits["p80_pts"], limits["p60_min"]) == (15.0, 25.0)
    assert {r["t"] for r in C.player_tier(empty, "pts", "mins", "t").collect()} == {"BENCH"}


def test_impute_fits_on_train_only(spark):
    train = spark.createDataFrame([(1.0, None), (3.0, None), (9.0, None)], "a double, b double")
    got = C.impute_median(train, spark.createDataFrame([(None, None), (100.0, 2.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [(3.0, 0.0), (100.0, 2.0)]


def test_shape_schema_duplicates(spark):
    df = spark.range(1).selectExpr("1 a", "2 x_1", "3 a", "4 b", "5 gameLabel", "6 x_2")
    out = C.shape_schema(df, ["b"], prefixes=["x_"])
    assert out.columns == ["b", "x_1", "x_2", "a"] and out.first()["a"] == 1


def test_trees_learn_and_score(spark):
    df = spark.range(400).selectExpr("'PTS' prop", "double(id % 10) f", "if(id % 3 = 0, null, 1D) g", "cast(null as double) h",
                                     "int(id % 10 >= 5) y", "id")
    models = M.train_per_type(df, "prop", ["PTS", "REB"], lambda t: ["f", "g", "h"], "y", M.TreeParams(max_iter=3, max_depth=2, step=0.3))
    assert list(models) == ["PTS"] and models["PTS"].importance()[0][0] == "f"
    more = df.unionByName(df.limit(5).withColumn("prop", F.lit("STL")))
    scored = M.score_props(more, "prop", models).collect()
    assert len(scored) == 405
    for r in scored:
        if r["prop"] == "STL":
            assert (r["ml_prediction"], r["ml_prob_over"], r["ml_confidence"], r["ml_edge"]) == ("UNKNOWN", 0.5, 5, 0.0)
        else:
            assert (r["ml_prediction"] == "OVER") == (r["y"] == 1)


def test_holdout_cv_sees_only_other_players(spark):
    df = spark.range(400).selectExpr("int(id % 20) who", "double(id % 10) f", "int(id % 10 >= 5) y")
    held = P.group_holdout(df, "who", 2)
    got = M.player_holdout_cv(df, held, "who", ["f"], "y", 2, M.TreeParams(max_iter=2, max_depth=2, step=0.3)).first()
    assert got["folds"] == 2 and got["accuracy"] == 1.0 and got["roc_auc_std"] == 0.0


def test_numbers_of_all_types_are_filled_and_absent_features_raise(spark):
    df = spark.sql("select cast(null as tinyint) a, cast(null as decimal(9, 2)) b, cast(null as float) c, cast(null as string) d, cast(null as bigint) e")
    assert tuple(C.fill_numeric_zero(df, ("e",)).first()) == (0, 0, 0.0, None, None)
    assert C.feature_select(df, ["b", "a"]) == ["b", "a"]
    with pytest.raises(ValueError, match="zz"):
        C.feature_select(df, ["a", "zz"])
    assert C.column_plan(["x", "p2", "a", "x", "p1", "gone", "b"], ["b", "a"], {"gone"}, ["p1", "p"]) == [6, 2, 4, 1, 0]


@pytest.mark.parametrize("how", ["players", "time"])
def test_folds_of_large_rows_are_held_narrow_and_from_files(spark, how, monkeypatch):
    """Every task over held rows reports the counters of the whole plan below them, so that plan must end at a scan."""
    from formline.operators.ordered import is_scan

    df = spark.range(600).selectExpr("id", "int(id % 20) who", "double(id % 10) f", "int(id % 10 >= 5) y", "'long text' other")
    p, seen, kept = M.TreeParams(max_iter=2, max_depth=2, step=0.3, subsample=1.0), [], M.kept

    def spy(rows):
        seen.append(rows)
        return kept(rows)

    def run():
        if how == "players":
            return M.player_holdout_cv(df, P.group_holdout(df, "who", 2), "who", ["f"], "y", 2, p).first()
        return M.time_cv(P.timeseries_folds(df, ["id"], 2), ["f"], "y", 2, p).first()

    small = run()
    monkeypatch.setattr(M, "kept", spy)
    spark.conf.set("spark.formline.smallInputBytes", "0")
    try:
        large = run()
    finally:
        spark.conf.unset("spark.formline.smallInputBytes")
    assert is_scan(seen[0]) and "other" not in seen[0].columns
    assert tuple(large) == pytest.approx(tuple(small), abs=1e-9)
