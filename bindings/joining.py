"""Joins: context, lines, outcomes, as-of lookups and names."""

from pyspark.sql import functions as F

from bindings.base import STATS, box, events, featured, labelled, predicted, prop_rows, query, r6, table
from bindings.project import ODDS_SQL
from bindings.rolling import ROLLED_SQL, team_context
from formline.operators import joins as J
from formline.operators import slips

CTX = ["L5_Team_Pace", "Season_Allowed_REB"]


def _ctx(prefix=""):
    return ", ".join(f'round(c."{c}", 6) AS "{prefix}{c}"' for c in CTX)


@query("attach_team", f"SELECT event_id, {_ctx()} FROM q_ev e LEFT JOIN ({ROLLED_SQL}) c USING (game_date, team)")
def attach_team(spark, sf):
    rows = J.attach(events(spark, sf), team_context(spark, sf), {"game_date": "game_date", "team": "team"}, CTX)
    return rows.select("event_id", *r6(*CTX))


@query("attach_opponent", f"""SELECT event_id, {_ctx('Opp_')} FROM q_ev e LEFT JOIN ({ROLLED_SQL}) c
    ON e.game_date = c.game_date AND e.team = c.opponent""")
def attach_opponent(spark, sf):
    rows = J.attach(events(spark, sf), team_context(spark, sf), {"game_date": "game_date", "team": "opponent"}, CTX, "Opp_")
    return rows.select("event_id", *r6(*[f"Opp_{c}" for c in CTX]))


@query("features_x_lines", """SELECT f.game_id, p.prop, p.line, round(f."L5_Avg_PTS", 6) AS "L5_Avg_PTS" FROM q_feat f
    JOIN q_prop p ON f.game_id = p.game_id AND f.c_name = p.c_name""")
def features_x_lines(spark, sf):
    lines = prop_rows(spark, sf).select("game_id", "c_name", "prop", "line")
    rows = J.features_with_lines(featured(spark, sf).select("game_id", "c_name", "L5_Avg_PTS"), lines, ["game_id", "c_name"])
    return rows.select("game_id", "prop", "line", *r6("L5_Avg_PTS"))


@query("attach_actuals", "SELECT p.game_id, p.prop, p.line, b.points, b.rebounds FROM q_prop p LEFT JOIN q_box b USING (entity_id, game_id)")
def attach_actuals(spark, sf):
    lines = prop_rows(spark, sf).select("entity_id", "game_id", "prop", "line")
    rows = J.attach_actuals(lines, box(spark, sf).select("entity_id", "game_id", "points", "rebounds"), ["entity_id", "game_id"])
    return rows.select("game_id", "prop", "line", "points", "rebounds")


@query("active_filter", """SELECT game_id, prop FROM q_prop WHERE (entity_id, game_date) IN
    (SELECT (entity_id, game_date) FROM q_box WHERE minutes > 0)""")
def active_filter(spark, sf):
    return J.keep_active(prop_rows(spark, sf), box(spark, sf), ["entity_id", "game_date"], "minutes").select("game_id", "prop")


@query("unmatched_lines", """SELECT DISTINCT entity_id, game_date FROM q_prop p WHERE NOT EXISTS (SELECT 1 FROM q_box b
    WHERE b.minutes > 0 AND b.entity_id = p.entity_id AND b.game_date = p.game_date) ORDER BY 1, 2 LIMIT 10""")
def unmatched_lines(spark, sf):
    return J.unmatched(prop_rows(spark, sf), box(spark, sf), ["entity_id", "game_date"], "minutes", ["entity_id", "game_date"])


def todays(spark, sf):
    """Today's props: every customer and type at a new line against the whole order history."""
    c = F.col("c_custkey")
    kinds = F.array(*[F.lit(p) for p in ("PTS", "REB", "AST", "3PM")])
    return table(spark, sf, "customer").select(
        F.col("c_name"), F.explode(kinds).alias("prop"), (c % 40 + 3).cast("double").alias("line"),
        F.when(c % 5 != 0, (c % 9) * 30 - 130).cast("int").alias("odds"), (c % 25).cast("int").alias("today_home"))


TODAY_SQL = """SELECT c_name, unnest(['PTS', 'REB', 'AST', '3PM']) AS prop, CAST(c_custkey % 40 + 3 AS DOUBLE) AS line,
    CAST(CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 9) * 30 - 130 END AS INTEGER) AS odds FROM customer"""
LATEST_SQL = """SELECT * FROM q_lab QUALIFY row_number() OVER (PARTITION BY c_name, prop ORDER BY game_date DESC, game_id DESC) = 1"""


@query("asof_latest", f"""SELECT t.c_name, t.prop, t.line, h.game_id, round(h.l5, 6) AS l5, round(h.sm, 6) AS sm
    FROM ({TODAY_SQL}) t JOIN ({LATEST_SQL}) h USING (c_name, prop)""")
def asof_latest(spark, sf):
    rows = J.asof_latest(todays(spark, sf), labelled(spark, sf), ["c_name", "prop"], ["game_date", "game_id"],
                         ["game_id", "l5", "sm"])
    return rows.select("c_name", "prop", "line", "game_id", *r6("l5", "sm"))


def part_history(spark, sf):
    """Sales of named parts as a history: two-word names, part type as the prop type."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    lines = table(spark, sf, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", F.to_date("l_shipdate").alias("day"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))


PART_SQL = "SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, CAST(l_shipdate AS DATE) AS day, p_name, p_type FROM lineitem JOIN part ON l_partkey = p_partkey"
WANTED_SQL = """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN 'Mr ' || upper(split_part(p_name, ' ', 2))
    ELSE 'new ' || substr(split_part(p_name, ' ', 2), 2) END AS p_name, p_type FROM part"""


def _wanted(spark, sf):
    last = F.element_at(F.split("p_name", " "), 2)
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("Mr "), F.upper(last))).otherwise(
        F.concat(F.lit("new "), F.substring(last, 2, 100)))
    return table(spark, sf, "part").select("p_partkey", name.alias("p_name"), "p_type")


@query("asof_fallback_name", f"""WITH w AS ({WANTED_SQL}), h AS ({PART_SQL}),
    g AS (SELECT p_name, p_type, max((day, l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS m FROM h GROUP BY ALL)
    SELECT w.p_partkey, max(g.m)[1] AS day, max(g.m)[2] AS l_orderkey FROM w JOIN g ON g.p_type = w.p_type AND contains(lower(g.p_name),
    lower(split_part(w.p_name, ' ', 2))) WHERE NOT EXISTS (SELECT 1 FROM g x WHERE x.p_name = w.p_name AND x.p_type = w.p_type) GROUP BY w.p_partkey""")
def asof_fallback_name(spark, sf):
    rows = J.asof_by_last_token(_wanted(spark, sf), part_history(spark, sf), "p_name", "p_type",
                                ["day", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["day", "l_orderkey"])
    return rows.select("p_partkey", "day", "l_orderkey")


@query("match_names", f"""WITH w AS ({WANTED_SQL}) SELECT w.p_partkey, min(o.p_partkey) AS matched_p_partkey FROM w JOIN part o ON w.p_type = o.p_type
    AND (contains(lower(w.p_name), lower(o.p_name)) OR contains(lower(o.p_name), lower(w.p_name))) GROUP BY w.p_partkey""")
def match_names(spark, sf):
    offered = table(spark, sf, "part").select("p_partkey", "p_name", "p_type")
    rows = J.match_names(_wanted(spark, sf), offered, "p_name", "p_type", ["p_partkey"], ["p_partkey"])
    return rows.select("p_partkey", "matched_p_partkey")


@query("recent_hit_rate", f"""SELECT t.c_name, t.prop, round(coalesce(r.rate, 0.5), 6) AS recent_prob,
    round(CAST({ODDS_SQL} AS DOUBLE), 6) AS implied_prob, round(coalesce(r.rate, 0.5) - {ODDS_SQL}, 6) AS edge FROM ({TODAY_SQL}) t
    LEFT JOIN (SELECT h.c_name, h.prop, avg(CASE WHEN h.actual > t.line THEN 1 ELSE 0 END) AS rate
    FROM (SELECT * FROM q_lab QUALIFY row_number() OVER (PARTITION BY c_name, prop ORDER BY game_date DESC, game_id DESC) <= 10) h
    JOIN ({TODAY_SQL}) t USING (c_name, prop) GROUP BY ALL) r USING (c_name, prop)""")
def recent_hit_rate(spark, sf):
    rows = J.recent_hit_rate(todays(spark, sf), labelled(spark, sf), ["c_name", "prop"], ["-game_date", "-game_id"],
                             "actual", "line", "odds")
    return rows.select("c_name", "prop", *r6("recent_prob", "implied_prob", "edge"))


@query("recent_hit_rate_fallback", f"""SELECT t.c_name, t.prop, coalesce(o.rate, 0.5) AS by_outcome, CASE WHEN a.l10 IS NULL THEN 0.5
    WHEN a.l10 > t.line THEN 1.0 ELSE 0.0 END::DOUBLE AS by_average FROM ({TODAY_SQL}) t
    LEFT JOIN (SELECT c_name, prop, round(avg(outcome), 6) AS rate FROM (SELECT * FROM q_lab QUALIFY row_number() OVER
      (PARTITION BY c_name, prop ORDER BY game_date DESC, game_id DESC) <= 10) GROUP BY ALL) o USING (c_name, prop)
    LEFT JOIN ({LATEST_SQL}) a USING (c_name, prop)""")
def recent_hit_rate_fallback(spark, sf):
    """Histories that keep no measures: by past overs, and by the latest average alone."""
    history, props = labelled(spark, sf), todays(spark, sf).select("c_name", "prop", "line", "odds")

    def by(columns, out):
        some = history.select("c_name", "prop", "game_date", "game_id", *columns)
        rows = J.recent_hit_rate(props, some, ["c_name", "prop"], ["-game_date", "-game_id"], "actual", "line", "odds", average="l10")
        return rows.select("c_name", "prop", F.round("recent_prob", 6).alias(out))

    return by(["outcome", "l10"], "by_outcome").join(by(["l10"], "by_average"), ["c_name", "prop"])


@query("compare_predictions", """SELECT game_id, prop, CASE WHEN got > line THEN 'OVER' ELSE 'UNDER' END AS actual_side,
    side = CASE WHEN got > line THEN 'OVER' ELSE 'UNDER' END AS hit,
    confidence2 >= 7 AND side <> CASE WHEN got > line THEN 'OVER' ELSE 'UNDER' END AS confident_miss
    FROM (SELECT p.*, CASE prop WHEN 'PTS' THEN points WHEN 'REB' THEN rebounds WHEN 'AST' THEN assists ELSE threes END AS got
      FROM q_pred p JOIN (SELECT game_id, entity_id, points, rebounds, assists, threes FROM q_box) b USING (game_id, entity_id))""")
def compare_predictions(spark, sf):
    rows = predicted(spark, sf).select("game_id", "entity_id", "prop", "line", "side", F.col("confidence2").alias("confidence"))
    settled = box(spark, sf).select("game_id", "entity_id", *STATS.values())
    got = F.coalesce(*[F.when(F.col("prop") == p, F.col(c)) for p, c in STATS.items()])
    out = J.compare_predictions(rows, settled, ["game_id", "entity_id"], got, 7)
    return out.select("game_id", "prop", "actual_side", "hit", "confident_miss")


@query("min_games_semi", """SELECT game_id, entity_id FROM q_box WHERE season <> '2000-01' AND entity_id IN
    (SELECT entity_id FROM q_box WHERE season = '2000-01' GROUP BY entity_id HAVING count(DISTINCT game_id) >= 2)
    UNION ALL SELECT game_id, entity_id FROM q_box WHERE season = '2000-01'""")
def min_games_semi(spark, sf):
    rows = box(spark, sf).select("game_id", "entity_id", "season")
    last = rows.filter("season = '2000-01'")
    kept = J.min_games(rows.filter("season <> '2000-01'"), last, "entity_id", "game_id", 2)
    return kept.select("game_id", "entity_id").unionByName(last.select("game_id", "entity_id"))


def slate_picks(spark, sf):
    """Predictions as picks: slate = calendar month, spread and total from the game."""
    g = F.col("game_id")
    market = F.when(F.col("prop") == "PTS", "POINTS").when(F.col("prop") == "AST", "ASSISTS").otherwise(F.col("prop"))
    return predicted(spark, sf).select(
        F.date_format("game_date", "yyyy-MM").alias("slate"), (g * 4 + F.expr("array_position(array('PTS','REB','AST','3PM'), prop)") - 1).alias("pick"),
        "entity_id", "team", "opponent", market.alias("prop"), "side", (g % 17).cast("double").alias("spread"),
        (g % 45 + 200).cast("double").alias("total"), "confidence", "p")


PICK_SQL = """SELECT strftime(game_date, '%Y-%m') AS slate, game_id * 4 + list_position(['PTS','REB','AST','3PM'], prop) - 1 AS pick, entity_id, team, opponent,
    CASE prop WHEN 'PTS' THEN 'POINTS' WHEN 'AST' THEN 'ASSISTS' ELSE prop END AS prop, side, game_id % 17 AS spread,
    game_id % 45 + 200 AS total, confidence, p FROM q_pred"""
LABEL_SQL = """CASE WHEN a.team = b.team AND a.prop = b.prop AND a.side = 'OVER' AND b.side = 'OVER' THEN 'negative'
    WHEN a.team = b.team AND ((a.prop = 'POINTS' AND b.prop = 'ASSISTS') OR (a.prop = 'ASSISTS' AND b.prop = 'POINTS')) THEN 'positive'
    WHEN (a.opponent = b.team OR a.team = b.opponent) AND (a.spread > 12 OR b.spread > 12) THEN 'negative'
    WHEN a.total > 235 AND b.total > 235 AND a.side = 'OVER' AND b.side = 'OVER' THEN 'positive' ELSE 'neutral' END"""


@query("pair_correlation", f"""SELECT a.slate, {LABEL_SQL} AS relation, count(*) AS pairs FROM ({PICK_SQL}) a JOIN ({PICK_SQL}) b
    ON a.slate = b.slate AND a.pick < b.pick GROUP BY ALL""")
def pair_correlation(spark, sf):
    return slips.pair_correlation(slate_picks(spark, sf), "slate")


@query("safe_combination", f"""SELECT a.game_id, NOT bool_or({LABEL_SQL} = 'negative') AS safe FROM
    (SELECT pick // 4 AS game_id, * FROM ({PICK_SQL})) a JOIN (SELECT pick // 4 AS game_id, * FROM ({PICK_SQL})) b
    ON a.game_id = b.game_id AND a.pick < b.pick GROUP BY a.game_id""")
def safe_combination(spark, sf):
    """Each order's picks as one slip of at most four legs."""
    picks = slate_picks(spark, sf).withColumn("game_id", F.floor(F.col("pick") / 4))
    leg = F.struct("pick", "team", "opponent", "prop", "side", "spread", "total")
    rows = picks.groupBy("game_id").agg(F.collect_list(leg).alias("legs")).filter(F.size("legs") > 1)
    return rows.select("game_id", slips.safe_slip(F.col("legs")).alias("safe"))
