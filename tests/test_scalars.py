"""Column expressions on hand-made values."""

import datetime

import pytest
from pyspark.sql import functions as F

from formline.functions import scalars as S


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def d(text):
    return F.lit(text).cast("date")


CASES = [
    (lambda: S.season_of(d("2024-10-01")), "2024-25"), (lambda: S.season_of(d("2025-09-30")), "2024-25"),
    (lambda: S.season_of(d("1999-12-31")), "1999-00"),
    (lambda: S.implied_probability(F.lit(None).cast("int")), 0.5), (lambda: S.implied_probability(F.lit(0)), 0.5),
    (lambda: S.implied_probability(F.lit(150)), 0.4), (lambda: S.implied_probability(F.lit(-150)), 0.6),
    (lambda: S.outcome(F.lit(20), F.lit(20.0)), 0), (lambda: S.outcome(F.lit(21), F.lit(20.5)), 1),
    (lambda: S.outcome(F.lit(None).cast("int"), F.lit(20.5)), None),
    (lambda: S.normalize_prop(F.lit("THREES")), "3PM"), (lambda: S.normalize_prop(F.lit("STL")), "STL"),
    (lambda: S.ten_point_confidence(F.lit(0.5)), 1), (lambda: S.ten_point_confidence(F.lit(1.0)), 10),
    (lambda: S.ten_point_confidence(F.lit(0.84)), 6), (lambda: S.five_to_ten_confidence(F.lit(0.95)), 9),
    (lambda: S.side_of(F.lit(-0.05)), "NEUTRAL"), (lambda: S.side_of(F.lit(-0.06)), "UNDER"),
    (lambda: S.reliability(F.lit(0.25)), "STANDARD"), (lambda: S.reliability(F.lit(0.45)), "VOLATILE"),
    (lambda: S.usage_tier(F.lit(0.23), F.lit(None).cast("double")), "SECONDARY"),
    (lambda: S.severity(F.lit(-0.5), F.lit(50.0)), "MINOR"), (lambda: S.severity(F.lit(-3.0), F.lit(24.0)), "MODERATE"),
    (lambda: S.severity(F.lit(-3.0), F.lit(25.0)), "MAJOR"), (lambda: S.miss_percent(F.lit(-3.0), F.lit(0.0)), 0.0),
    (lambda: S.feature_group(F.lit("Opp_L5_Avg_PTS")), "Player Recent Form"),
    (lambda: S.feature_group(F.lit("Opp_Season_Allowed")), "Opponent Defense"), (lambda: S.feature_group(F.lit("xyz")), "Other"),
    (lambda: S.probability_bin(F.lit(0.3)), 2), (lambda: S.probability_bin(F.lit(0.5)), 5),
    (lambda: S.probability_bin(F.lit(1.0)), 9), (lambda: S.probability_bin(F.lit(1.0), True), None),
    (lambda: S.defence_band(F.lit(0.0)), "Good Defense"), (lambda: S.line_band(F.lit(12.1), F.lit(10.0)), "LOW"),
    (lambda: S.join_key(d("2025-01-02"), F.lit("BOS"), F.lit("MIA"), F.lit(0)), "2025-01-02_MIA_BOS"),
    (lambda: S.parse_time(F.lit("2025-01-02T01:30:00Z")).cast("date"), datetime.date(2025, 1, 2)),
    (lambda: S.parse_time(F.lit("never")), None),
    (lambda: S.game_day_eastern(F.lit("2025-07-02 03:30:00").cast("timestamp")), datetime.date(2025, 7, 1)),
    (lambda: S.game_day_eastern(F.lit("2025-07-02 04:30:00").cast("timestamp")), datetime.date(2025, 7, 2)),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scalar(spark, i):
    make, want = CASES[i]
    got = one(spark, make())
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_context_tags(spark):
    tags = S.context_tags(F.lit(1), F.lit(5), F.lit(103.0), F.lit(-15.0), F.lit(None).cast("double"), F.lit(0.5))
    assert one(spark, tags) == ["b2b", "elite_defense", "fast_pace", "blowout_risk", "small_edge"]
    zero = F.lit(0)
    assert one(spark, S.context_tags(zero, zero, zero, zero, zero, F.lit(3.0))) == []


def test_roi(spark):
    assert one(spark, S.roi_percent(F.lit(0.5), F.lit(-110))) == pytest.approx(-4.545454, abs=1e-5)
    assert one(spark, S.roi_percent(F.lit(0.5), F.lit(120))) == pytest.approx(10.0)
