"""Whole plans and model jobs over the test tables."""

from functools import reduce

from pyspark.sql import functions as F

from bindings.base import STATS, box, predicted, prop_rows, query, r6, r6_sql, tagged
from bindings.evaluating import rounded
from bindings.joining import LATEST_SQL, TODAY_SQL, todays
from bindings.project import ODDS_SQL, REL_NUM, TIER_NUM
from bindings.rolling import RATE_SQL, SHOTS_SQL, _rates
from bindings.selecting import boundary_sql
from formline.functions import scalars as S
from formline.operators import isotonic as I
from formline.operators import splits
from formline.operators.ordered import is_small
from formline.plans import build as B
from formline.plans import daily as D
from formline.plans import models as M
from formline.plans import search as Q
from formline.session import run_dir, staged

COLUMNS = B.Columns(stats=STATS)
SHOW = ["L5_Avg_PTS", "L10_StdDev_REB", "Season_Avg_AST", "Form_3PM", "L5_Avg_PTS_SameVenue", "Season_Avg_PTS_SameVenue", "Player_TS_Pct"]


@query("build_dataset", f"""SELECT game_id, prop, line, outcome, tier AS "Player_Tier", "Reliability_Tag", {TIER_NUM} AS "Player_Tier_encoded",
    {REL_NUM} AS "Reliability_Tag_encoded", CAST(rest_days AS INTEGER) AS rest_days, {r6_sql(*SHOW)} FROM q_log JOIN (SELECT game_id AS gid, "L10_StdDev_REB", "Season_Avg_AST",
    "L5_Avg_3PM" - "Season_Avg_3PM" AS "Form_3PM", "L5_Avg_PTS",
    avg(points) OVER (PARTITION BY entity_id, home ORDER BY game_date, game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS "L5_Avg_PTS_SameVenue",
    avg(points) OVER (PARTITION BY entity_id, home, season ORDER BY game_date, game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "Season_Avg_PTS_SameVenue"
    FROM q_feat) f ON gid = game_id JOIN (SELECT game_id AS rid, avg({RATE_SQL['TS_Pct']}) OVER (PARTITION BY entity_id ORDER BY game_date, game_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS "Player_TS_Pct" FROM ({SHOTS_SQL})) r ON rid = game_id""")
def build_dataset(spark, sf):
    players = box(spark, sf)
    if not is_small(players):
        players = staged(players, run_dir(spark, "players"))
    lines = prop_rows(spark, sf, players).select("entity_id", "game_id", "prop", "line", "odds")
    rows = B.build_dataset(players, lines, COLUMNS, _rates(), stage=run_dir(spark, "features"))
    return rows.select("game_id", "prop", "line", "outcome", "Player_Tier", "Reliability_Tag", "Player_Tier_encoded",
                       "Reliability_Tag_encoded", "rest_days", *r6(*SHOW))


@query("todays_edges", f"""SELECT c_name, prop, game_id, round(recent, 6) AS recent_prob, round(recent - implied, 6) AS edge,
    CASE WHEN recent - implied > 0 THEN 'OVER' ELSE 'UNDER' END AS direction FROM (SELECT t.*, h.game_id, CAST({ODDS_SQL.replace('odds', 't.odds')} AS DOUBLE) AS implied,
    r.rate AS recent FROM ({TODAY_SQL}) t JOIN ({LATEST_SQL}) h USING (c_name, prop) JOIN (SELECT h.c_name, h.prop, avg(CASE WHEN h.actual > t.line THEN 1 ELSE 0 END) AS rate
    FROM (SELECT * FROM q_lab QUALIFY row_number() OVER (PARTITION BY c_name, prop ORDER BY game_date DESC, game_id DESC) <= 10) h
    JOIN ({TODAY_SQL}) t USING (c_name, prop) GROUP BY ALL) r USING (c_name, prop)) WHERE recent - implied > 0 OR recent - implied < -0.05""")
def todays_edges(spark, sf):
    rows = D.todays_edges(todays(spark, sf), predicted(spark, sf), ["c_name", "prop"], ["game_date", "game_id"],
                          ["game_id"], "actual", "line", "odds")
    return rows.select("c_name", "prop", "game_id", *r6("recent_prob", "edge"), "direction")


@query("reveal_by_day", """SELECT game_date AS day, count(*) AS picks, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) * 100.0::DOUBLE / count(*), 6) AS accuracy,
    count(*) FILTER (WHERE NOT hit AND abs(m) >= 2 AND pct >= 25) AS major_misses, count(*) FILTER (WHERE NOT hit AND confidence >= 7) AS confident_misses FROM
    (SELECT *, side = CASE WHEN actual > line THEN 'OVER' ELSE 'UNDER' END AS hit, CASE WHEN side = 'OVER' THEN actual - line ELSE line - actual END AS m,
     CASE WHEN line > 0 THEN abs(actual - line) / line * 100 ELSE 0 END AS pct FROM q_pred
     QUALIFY row_number() OVER (PARTITION BY game_date, prop ORDER BY odds NULLS LAST, line, entity_id, game_id) <= 2) GROUP BY 1""")
def reveal_by_day(spark, sf):
    rows = D.reveal_by_day(predicted(spark, sf), "actual", "line", "game_date", "prop", "odds", ["line", "entity_id", "game_id"])
    return rounded(rows, ["accuracy"])


FEATURES = ["l5", "l10", "sm", "sd5", "sd10", "line", "home", "rest_days", "is_b2b"]
LIGHT = M.TreeParams(max_iter=5, max_depth=3, step=0.1)


def _rows(spark, sf):
    return tagged(spark, sf).select("game_id", "entity_id", "game_date", "prop", "outcome", "odds", "tier",
                                    "Reliability_Tag", "p", *FEATURES)


@query("train_per_type")
def train_per_type(spark, sf):
    models = M.train_per_type(_rows(spark, sf), "prop", list(STATS), lambda t: FEATURES, "outcome", LIGHT)
    return M.importance_table(spark, models)


FOLDS = 5
SEARCHES = 500


def _blocks(rows, k):
    return splits.timeseries_folds(rows, ["game_date", "game_id"], k)


def _typed_rows(spark, sf):
    """What folds and fits read of the rows; large rows are made once for all types."""
    rows = _rows(spark, sf).select("game_id", "entity_id", "game_date", "prop", "outcome", *FEATURES)
    return rows if is_small(rows) else staged(rows, run_dir(spark, "typed"))


def _each_type(rows, one):
    """``one`` of the rows of every type, with the type as first column."""
    parts = [one(rows.filter(F.col("prop") == p)).drop("prop") for p in STATS]
    return reduce(lambda a, b: a.unionByName(b), [t.select(F.lit(p).alias("prop"), *t.columns) for p, t in zip(STATS, parts, strict=True)])


def _by_type(spark, sf, one):
    return _each_type(_typed_rows(spark, sf), one)


@query("time_cv")
def time_cv(spark, sf):
    blocks = _by_type(spark, sf, lambda rows: _blocks(rows, FOLDS))
    return M.time_cv(blocks, FEATURES, "outcome", FOLDS, prop="prop", types=list(STATS))


@query("player_holdout_cv")
def player_holdout_cv(spark, sf):
    rows = _typed_rows(spark, sf)
    held = _each_type(rows, lambda mine: splits.group_holdout(mine.select("entity_id"), "entity_id", FOLDS))
    return M.player_holdout_cv(rows, held, "entity_id", FEATURES, "outcome", FOLDS, prop="prop", types=list(STATS))


@query("random_search")
def random_search(spark, sf):
    """``SEARCHES`` configurations of the whole grid for each type, over the folds of ``time_cv``."""
    rows = _rows(spark, sf)
    blocks = reduce(lambda a, b: a.unionByName(b), [_blocks(rows.filter(F.col("prop") == p), FOLDS) for p in STATS])
    return Q.random_search(blocks, "prop", ["game_id"], FEATURES, "outcome", FOLDS, n=SEARCHES)


# the greatest lower mean: max over starts of the min over ends of the mean between them, then linear between scores
ISO_SQL = f"""WITH split AS (SELECT *, CASE WHEN game_date <= {boundary_sql(0.6)} THEN 'train' WHEN game_date <= {boundary_sql(0.8)} THEN 'calibrate'
    ELSE 'test' END AS split FROM q_pred),
    sums AS (SELECT p AS x, sum(outcome)::DOUBLE AS s, count(*) AS w FROM split WHERE split = 'calibrate' GROUP BY p),
    upto AS (SELECT x, s, w, row_number() OVER (ORDER BY x) AS i, sum(s) OVER (ORDER BY x) AS cs, sum(w) OVER (ORDER BY x) AS cw FROM sums),
    low AS (SELECT b.i, min((b.cs - a.cs + a.s) / (b.cw - a.cw + a.w)) OVER (PARTITION BY a.i ORDER BY b.i DESC) AS m FROM upto a JOIN upto b ON a.i <= b.i),
    fit AS (SELECT i, x, g FROM (SELECT i, max(m) AS g FROM low GROUP BY i) JOIN upto USING (i))"""
CALIBRATED_SQL = """greatest(0.01, least(0.99, CASE WHEN l.x IS NULL THEN h.g WHEN h.x IS NULL THEN l.g WHEN h.x > l.x
    THEN l.g + (h.g - l.g) * (p - l.x) / (h.x - l.x) ELSE l.g END))"""


@query("isotonic_calibrate", f"""{ISO_SQL} SELECT game_id, prop, p, outcome, round({CALIBRATED_SQL}, 6) AS calibrated FROM
    (SELECT t.*, (SELECT max(i) FROM fit WHERE x <= p) AS li, (SELECT min(i) FROM fit WHERE x >= p) AS hi FROM split t WHERE split = 'test') r
    LEFT JOIN fit l ON l.i = li LEFT JOIN fit h ON h.i = hi""")
def isotonic_calibrate(spark, sf):
    """Fit on the calibration days, applied to the later ones."""
    rows = splits.three_way_split(_rows(spark, sf), "game_date")
    cal = M.isotonic_calibrate(rows.filter("split = 'calibrate'"), "p", "outcome")
    out = cal.apply(rows.filter("split = 'test'"), "p", "calibrated")
    return out.select("game_id", "prop", "p", "outcome", *r6("calibrated"))


@query("isotonic_blocks", f"""{ISO_SQL} SELECT min(x) AS low, max(x) AS high, round(g, 6) AS mean, CAST(sum(w) AS BIGINT) AS weight
    FROM fit JOIN upto USING (i, x) GROUP BY g""")
def isotonic_blocks(spark, sf):
    rows = splits.three_way_split(_rows(spark, sf), "game_date").filter("split = 'calibrate'")
    return I.isotonic_blocks(rows, "p", "outcome").select("low", "high", *r6("mean"), "weight")


@query("score_props")
def score_props(spark, sf):
    """Train, calibrate and score on three disjoint ranges of days."""
    rows = splits.three_way_split(_rows(spark, sf), "game_date").withColumn("implied", S.implied_probability(F.col("odds")))
    with M.kept(rows) as held:
        train, later = held.filter("split = 'train'"), held.filter("split = 'calibrate'")
        models = M.train_per_type(train, "prop", list(STATS), lambda t: FEATURES, "outcome", LIGHT)
        cals = {t: M.isotonic_calibrate(m.score(later.filter(F.col("prop") == t)), "ml_prob_raw", "outcome") for t, m in models.items()}
    scored = M.score_props(rows.filter("split = 'test'"), "prop", models, cals, F.col("implied"))
    return scored.select("game_id", "prop", "ml_prob_over", "ml_prediction", "ml_confidence", "ml_edge", "outcome")


@query("meta_ensemble")
def meta_ensemble(spark, sf):
    from formline.operators.classify import encode_ordinal

    rows = encode_ordinal(_rows(spark, sf).withColumnRenamed("tier", "Player_Tier"))
    rows = rows.withColumn("implied", S.implied_probability(F.col("odds"))).withColumn("ml_edge", F.col("p") - F.col("implied"))
    rows = splits.temporal_split(rows, "game_date")
    names = ["p", "Player_Tier_encoded", "Reliability_Tag_encoded", "ml_edge", "implied", "rest_days", "is_b2b", "home"]
    model = M.meta_ensemble(rows.filter("split = 'train'"), names, "outcome")
    out = model.apply(rows.filter("split = 'test'"), "ml_edge")
    return out.select("game_id", "prop", "meta_prob_over", "meta_prediction", "meta_confidence", "combined_edge")
