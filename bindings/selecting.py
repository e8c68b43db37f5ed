"""Selection, sampling, splits and set operations."""

from functools import reduce

from pyspark.sql import functions as F

from bindings.base import STATS, box, labelled, predicted, prop_rows, query, table
from bindings.evaluating import rounded
from bindings.joining import LABEL_SQL, PICK_SQL, slate_picks
from bindings.scans import RAW_SQL, raw_lines
from formline.operators import select as T
from formline.operators import slips
from formline.operators import splits as P
from formline.operators.ordered import is_small
from formline.session import run_dir, staged


@query("dedup_best", """SELECT entity_id, prop, game_id, odds FROM q_prop
    QUALIFY row_number() OVER (PARTITION BY entity_id, prop ORDER BY odds ASC NULLS LAST, game_id) = 1""")
def dedup_best(spark, sf):
    return T.dedup_best(prop_rows(spark, sf), ["entity_id", "prop"], "odds", ["game_id"]).select("entity_id", "prop", "game_id", "odds")


def _slate(spark, sf):
    return prop_rows(spark, sf).withColumn("slate", F.date_format("game_date", "yyyy-MM"))


SLATE_SQL = "(SELECT *, strftime(game_date, '%Y-%m') AS slate FROM q_prop)"


@query("topn_per_group", f"""SELECT slate, prop, game_id, line FROM (SELECT *, row_number() OVER (PARTITION BY slate, prop ORDER BY odds NULLS LAST, line NULLS LAST, entity_id, game_id) AS r,
    (SELECT count(DISTINCT slate) FROM {SLATE_SQL}) AS games FROM {SLATE_SQL})
    WHERE r <= greatest(2, floor(greatest(8, floor(greatest(8, least(50, games * 10)) / greatest(games, 1))) / 4))""")
def topn_per_group(spark, sf):
    rows = T.balanced_top(_slate(spark, sf), "slate", "prop", "odds", "line", ["entity_id", "game_id"])
    return rows.select("slate", "prop", "game_id", "line")


@query("topn_wide_limit", f"""SELECT slate, prop, game_id FROM (SELECT *, row_number() OVER (PARTITION BY slate, prop ORDER BY odds NULLS LAST, line NULLS LAST, entity_id, game_id) AS r,
    (SELECT count(DISTINCT slate) FROM {SLATE_SQL}) AS games FROM {SLATE_SQL})
    WHERE r <= greatest(2, floor(greatest(8, floor(4000 / greatest(games, 1))) / 4))""")
def topn_wide_limit(spark, sf):
    rows = T.balanced_top(_slate(spark, sf), "slate", "prop", "odds", "line", ["entity_id", "game_id"], limit=4000)
    return rows.select("slate", "prop", "game_id")


@query("topn_by_type", """SELECT prop, game_id FROM q_prop QUALIFY row_number() OVER (PARTITION BY prop ORDER BY odds NULLS LAST, game_id) <= 12""")
def topn_by_type(spark, sf):
    return T.balanced_by_type(prop_rows(spark, sf), "prop", "odds", ["game_id"], 48).select("prop", "game_id")


@query("stratified_sample", f"""SELECT slate, prop, game_id FROM (SELECT *, row_number() OVER (PARTITION BY slate, prop ORDER BY md5('42|' || game_id || '|' || prop), game_id) AS r,
    (SELECT count(DISTINCT slate) FROM {SLATE_SQL}) AS games FROM {SLATE_SQL}) WHERE r <= greatest(1, floor(greatest(4, ceil(2000 / games)) / 4))""")
def stratified_sample(spark, sf):
    return T.stratified_sample(_slate(spark, sf), "slate", "prop", ["game_id", "prop"], 2000).select("slate", "prop", "game_id")


@query("diverse_sample", """WITH f AS (SELECT * FROM q_lab QUALIFY row_number() OVER (PARTITION BY prop, entity_id ORDER BY game_date, game_id) = 1),
    picks AS (SELECT prop, entity_id, game_id FROM f QUALIFY row_number() OVER (PARTITION BY prop ORDER BY md5('42|' || entity_id), entity_id) <= 5),
    more AS (SELECT prop, entity_id, game_id FROM q_lab WHERE (prop, game_id) NOT IN (SELECT (prop, game_id) FROM picks)
      ORDER BY md5('42+|' || prop || '|' || game_id), prop, game_id LIMIT 22)
    SELECT * FROM (SELECT prop, entity_id, game_id FROM (SELECT *, 0 AS turn, '' AS h FROM picks UNION ALL SELECT *, 1, md5('42+|' || prop || '|' || game_id) FROM more)
    ORDER BY turn, h, prop, game_id LIMIT 22)""")
def diverse_sample(spark, sf):
    rows = labelled(spark, sf).select("prop", "entity_id", "game_id", "game_date")
    return T.diverse_sample(rows, "prop", "entity_id", ["game_date", "game_id"], ["prop", "game_id"], 22).select("prop", "entity_id", "game_id")


@query("quota_fill", f"""SELECT game_id, market, line, odds FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY late, ty, t) AS r FROM
    (SELECT *, t > 3 AS late, CASE market WHEN 'PTS' THEN 0 WHEN 'REB' THEN 1 WHEN 'AST' THEN 2 WHEN '3PM' THEN 3 ELSE 4 END AS ty FROM
    (SELECT *, row_number() OVER (PARTITION BY game_id, market ORDER BY player_name, line, odds, book, side) AS t FROM
      (SELECT DISTINCT game_id, CASE market WHEN 'player_points' THEN 'PTS' WHEN 'player_rebounds' THEN 'REB' WHEN 'player_assists' THEN 'AST'
        WHEN 'player_threes' THEN '3PM' END AS market, player_name, line, odds, book, side FROM ({RAW_SQL})
        WHERE market LIKE 'player%' AND line IS NOT NULL AND player_name IS NOT NULL)))) WHERE r <= 15""")
def quota_fill(spark, sf):
    from formline.sources.odds import market_prop

    rows = raw_lines(spark, sf).filter("market LIKE 'player%' AND line IS NOT NULL AND player_name IS NOT NULL")
    rows = rows.select("game_id", market_prop(F.col("market")).alias("market"), "player_name", "line", "odds", "book", "side").distinct()
    out = T.quota_fill(rows, "game_id", "market", ["player_name", "line", "odds", "book", "side"], 15)
    return out.select("game_id", "market", "line", "odds")


def greedy_sql(source: str, order: str, per_player: int, per_type: int, total: int) -> str:
    """The scan one row a turn, all slates side by side, as common tables up to ``chosen``."""
    return f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY slate ORDER BY {order}) AS i FROM ({source})),
    scan(slate, i, who, what, ok) AS (SELECT slate, 0::BIGINT, []::BIGINT[], []::VARCHAR[], false FROM (SELECT DISTINCT slate FROM ranked)
      UNION ALL SELECT slate, i, CASE WHEN good THEN list_append(who, w) ELSE who END, CASE WHEN good THEN list_append(what, k) ELSE what END, good
      FROM (SELECT s.slate, r.i, s.who, s.what, r.entity_id AS w, r.prop AS k, len(list_filter(s.who, lambda x: x = r.entity_id)) < {per_player}
        AND len(list_filter(s.what, lambda x: x = r.prop)) < {per_type} AS good
        FROM scan s JOIN ranked r ON s.slate = r.slate AND r.i = s.i + 1 WHERE len(s.who) < {total})),
    chosen AS (SELECT r.* EXCLUDE (i) FROM ranked r JOIN scan s ON r.slate = s.slate AND r.i = s.i WHERE s.ok)"""


GREEDY_SQL = greedy_sql(PICK_SQL + " WHERE confidence >= 1", "confidence DESC, p DESC, pick", 3, 8, 75)
LEG = "{'pick': pick, 'team': team, 'opponent': opponent, 'prop': prop, 'side': side, 'spread': spread, 'total': total}"
PAIR_SQL = f"({LABEL_SQL}) = 'negative'"


def _greedy(spark, sf):
    picks = slate_picks(spark, sf).filter("confidence >= 1")
    return T.greedy_caps(picks, ["slate"], "entity_id", "prop", ["-confidence", "-p", "pick"], 3, 8, 75)


@query("greedy_caps", f"{GREEDY_SQL} SELECT * REPLACE (CAST(spread AS DOUBLE) AS spread, CAST(total AS DOUBLE) AS total) FROM chosen")
def greedy_caps(spark, sf):
    return _greedy(spark, sf)


@query("power_slips", f"""{GREEDY_SQL}, legs AS (SELECT slate, list({LEG} ORDER BY confidence DESC, pick) AS l FROM chosen GROUP BY slate),
    slips(slate, l, n, made, one, two) AS (SELECT slate, l, 0, false, NULL::BIGINT, NULL::BIGINT FROM legs
      UNION ALL SELECT slate, list_filter(l[2:], lambda x: two IS NULL OR x.pick <> two), n + CASE WHEN two IS NULL THEN 0 ELSE 1 END,
        two IS NOT NULL, l[1].pick, two
      FROM (SELECT *, list_filter(l[2:], lambda b: NOT coalesce({PAIR_SQL.replace("a.", "l[1].")}, false))[1].pick AS two
        FROM (SELECT slate, l, n FROM slips WHERE len(l) > 0)))
    SELECT slate, n AS slip, CAST(leg AS INTEGER) AS leg, CASE leg WHEN 1 THEN one ELSE two END AS pick FROM slips, range(1, 3) t(leg) WHERE made""")
def power_slips(spark, sf):
    return slips.power_slips(_greedy(spark, sf), "slate", "pick", ["-confidence", "pick"])


@query("flex_slips", f"""{GREEDY_SQL}, legs AS (SELECT slate, row_number() OVER (PARTITION BY slate ORDER BY confidence DESC, pick) AS i, {LEG} AS b FROM chosen),
    slips(slate, i, held, n, ok, leg) AS (SELECT slate, i - 1, list_filter([b], lambda x: false), 1, false, 0::BIGINT FROM legs WHERE i = 1
      UNION ALL SELECT slate, i, CASE WHEN NOT good THEN held WHEN len(held) = 4 THEN held[1:0] ELSE list_append(held, b) END,
        n + CASE WHEN len(held) = 0 AND i > 1 THEN 1 ELSE 0 END, good, len(held) + 1
      FROM (SELECT s.slate, r.i, s.held, s.n, r.b, len(list_filter(s.held, lambda a: coalesce({PAIR_SQL.replace("b.", "r.b.")}, false))) = 0 AS good
        FROM slips s JOIN legs r ON s.slate = r.slate AND r.i = s.i + 1))
    SELECT slate, CAST(n AS INTEGER) AS slip, CAST(leg AS INTEGER) AS leg, pick FROM (SELECT s.slate, s.n, s.leg, r.b.pick AS pick,
      max(s.leg) OVER (PARTITION BY s.slate, s.n) AS most FROM slips s JOIN legs r ON s.slate = r.slate AND s.i = r.i WHERE s.ok) WHERE most = 5""")
def flex_slips(spark, sf):
    return slips.flex_slips(_greedy(spark, sf), "slate", "pick", ["-confidence", "pick"])


def _scored(spark, sf):
    edge = F.coalesce("l5", "l10", "sm") - F.col("line")
    rows = _slate(spark, sf).withColumn("edge", F.round(edge, 9))
    q = T.quality(F.col("edge"), F.col("l5"), F.col("l10"), F.col("sm"), F.col("odds"), F.col("rest_days"), F.col("is_b2b"),
                  [F.col("sd5"), F.col("sd10")])
    return rows.withColumn("quality", F.round(q, 6))


SMART_SQL = f"""(SELECT *, round(coalesce(abs(edge) * 2, 0) + CASE WHEN l5 IS NOT NULL THEN 2 ELSE 0 END
    + CASE WHEN l10 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN sm IS NOT NULL THEN 0.5 ELSE 0 END
    + CASE WHEN odds IS NOT NULL THEN 0.5 + greatest(0, 1.5 - abs(odds) / 150.0::DOUBLE) ELSE 0 END + 0.3 + 0.2
    + (CASE WHEN sd5 IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN sd10 IS NOT NULL THEN 1 ELSE 0 END) * 0.05, 6) AS quality
    FROM (SELECT *, round(coalesce(l5, l10, sm) - line, 9) AS edge FROM {SLATE_SQL}))"""
BEST_SQL = f"""SELECT *, abs(edge) AS size FROM {SMART_SQL}
    QUALIFY row_number() OVER (PARTITION BY slate, entity_id, prop ORDER BY quality DESC, abs(edge) DESC, abs(coalesce(odds, 0)), game_id) = 1"""


@query("smart_score", f"SELECT slate, entity_id, prop, game_id, quality FROM ({BEST_SQL})")
def smart_score(spark, sf):
    rows = T.best_candidates(_scored(spark, sf), ["slate", "entity_id", "prop"], ["game_id"])
    return rows.select("slate", "entity_id", "prop", "game_id", "quality")


@query("smart_filter", greedy_sql(BEST_SQL, "quality DESC, size DESC, line, entity_id, game_id, prop", 2, 8, 25)
       + " SELECT slate, entity_id, prop, game_id, quality FROM chosen")
def smart_filter(spark, sf):
    scored = _scored(spark, sf).select("slate", "entity_id", "prop", "game_id", "line", "odds", "edge", "quality")
    rows = T.smart_filter(scored, ["slate"], "entity_id", "prop", "line", ["entity_id", "game_id", "prop"], 25)
    return rows.select("slate", "entity_id", "prop", "game_id", "quality")


@query("top_confidence", "SELECT game_id, prop, confidence FROM q_pred WHERE confidence >= 2 ORDER BY confidence DESC, game_id, prop LIMIT 50")
def top_confidence(spark, sf):
    return T.top_confidence(predicted(spark, sf), "confidence", ["game_id", "prop"], 50, 2).select("game_id", "prop", "confidence")


@query("union_selected", """SELECT prop, game_id FROM q_prop
    QUALIFY row_number() OVER (PARTITION BY prop ORDER BY odds NULLS LAST, game_id) <= 12""")
def union_selected(spark, sf):
    """Each type selected by itself, all types united; the plan of the rows runs once."""
    rows = prop_rows(spark, sf).select("prop", "odds", "game_id")
    if not is_small(rows):
        rows = staged(rows, run_dir(spark, "props"))
    picks = [T.balanced_by_type(rows.filter(F.col("prop") == p), "prop", "odds", ["game_id"], 48).select("prop", "game_id") for p in STATS]
    return reduce(lambda a, b: a.unionByName(b), picks)


@query("set_intersect_except", """SELECT 'both' AS part, count(*) AS n FROM (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A')
    UNION ALL SELECT 'only_first', count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def set_intersect_except(spark, sf):
    rows = table(spark, sf, "lineitem")

    def keys(flag, col):
        return rows.filter(F.col("l_returnflag") == flag).select(col)

    both = keys("R", "l_suppkey").intersect(keys("A", "l_suppkey"))
    only = keys("R", "l_partkey").subtract(keys("A", "l_partkey"))
    n = F.count(F.lit(1)).alias("n")
    return both.agg(n).select(F.lit("both").alias("part"), "n").unionByName(only.agg(n).select(F.lit("only_first").alias("part"), "n"))


@query("distinct_keys", "SELECT DISTINCT entity_id, season FROM q_box")
def distinct_keys(spark, sf):
    return box(spark, sf).select("entity_id", "season").distinct()


def boundary_sql(part: float, source: str = "q_lab") -> str:
    return f"""(SELECT min(d) FROM (SELECT d, sum(n) OVER (ORDER BY d) AS upto, sum(n) OVER () AS total FROM
    (SELECT game_date AS d, count(*) AS n FROM {source} GROUP BY 1)) WHERE upto >= floor(total * {part}))"""


@query("temporal_split", f"""SELECT split, count(*) AS n, min(game_date) AS first_day, max(game_date) AS last_day FROM
    (SELECT *, CASE WHEN game_date <= {boundary_sql(0.8)} THEN 'train' ELSE 'test' END AS split FROM q_lab) GROUP BY split""")
def temporal_split(spark, sf):
    rows = P.temporal_split(labelled(spark, sf).select("game_date", "game_id"), "game_date")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("game_date").alias("first_day"), F.max("game_date").alias("last_day"))


@query("three_way_split", f"""SELECT split, count(*) AS n, min(game_date) AS first_day FROM (SELECT *, CASE WHEN game_date <= {boundary_sql(0.6)} THEN 'train'
    WHEN game_date <= {boundary_sql(0.8)} THEN 'calibrate' ELSE 'test' END AS split FROM q_lab) GROUP BY split""")
def three_way_split(spark, sf):
    rows = P.three_way_split(labelled(spark, sf).select("game_date", "game_id"), "game_date")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.min("game_date").alias("first_day"))


BLOCK_SQL = """(SELECT *, CAST(CASE WHEN n // 6 > 0 THEN greatest(5 - (n - pos) // (n // 6), 0) ELSE 0 END AS INTEGER) AS block FROM
    (SELECT game_id, prop, row_number() OVER (ORDER BY game_date, game_id, prop) AS pos, count(*) OVER () AS n FROM q_lab))"""


@query("timeseries_folds", f"SELECT game_id, prop, block FROM {BLOCK_SQL}")
def timeseries_folds(spark, sf):
    rows = labelled(spark, sf).select("game_id", "prop", "game_date")
    return P.timeseries_folds(rows, ["game_date", "game_id", "prop"]).select("game_id", "prop", "block")


@query("fold_sizes", f"""SELECT CAST(f AS INTEGER) AS fold, CASE WHEN block = f THEN 'validate' ELSE 'train' END AS role, count(*) AS n
    FROM {BLOCK_SQL} JOIN range(1, 6) t(f) ON f >= block GROUP BY ALL""")
def fold_sizes(spark, sf):
    rows = labelled(spark, sf).select("game_id", "prop", "game_date")
    blocks = P.timeseries_folds(rows, ["game_date", "game_id", "prop"]).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    return P.fold_roles(blocks).groupBy("fold", "role").agg(F.sum("n").alias("n"))


@query("group_holdout", """SELECT CAST(f AS INTEGER) AS fold, entity_id FROM (SELECT f, entity_id, row_number() OVER (PARTITION BY f ORDER BY md5('holdout|' || f || '|' || entity_id), entity_id) AS pos,
    count(*) OVER (PARTITION BY f) AS n FROM (SELECT DISTINCT entity_id FROM q_lab), range(1, 6) t(f)) WHERE n >= 10 AND pos <= ceil(n * 0.2)""")
def group_holdout(spark, sf):
    return P.group_holdout(labelled(spark, sf).select("entity_id"), "entity_id")


@query("player_overlap", f"""WITH c AS (SELECT entity_id, count(*) FILTER (WHERE game_date <= cut) AS a, count(*) FILTER (WHERE game_date > cut) AS b FROM
    (SELECT *, {boundary_sql(0.7)} AS cut FROM q_lab) GROUP BY 1) SELECT count(*) FILTER (WHERE a > 0) AS train_entities, count(*) FILTER (WHERE b > 0) AS test_entities,
    count(*) FILTER (WHERE a > 0 AND b > 0) AS overlap, count(*) FILTER (WHERE b > 0 AND a = 0) AS test_only,
    round(count(*) FILTER (WHERE a > 0 AND b > 0) * 100.0::DOUBLE / greatest(count(*) FILTER (WHERE b > 0), 1), 6) AS overlap_pct,
    CAST(sum(CASE WHEN a > 0 THEN b ELSE 0 END) AS BIGINT) AS rows_seen, CAST(sum(CASE WHEN a = 0 THEN b ELSE 0 END) AS BIGINT) AS rows_unseen FROM c""")
def player_overlap(spark, sf):
    rows = P.player_overlap(labelled(spark, sf).select("entity_id", "game_date"), "entity_id", "game_date")
    return rounded(rows, ["overlap_pct"])
