"""Metrics, back-tests, calibration, logs and baselines."""

from pyspark.sql import functions as F

from bindings.base import predicted, query, r6, table, tagged
from bindings.scans import RAW_SQL, raw_lines
from formline.operators import evaluate as E
from formline.operators import logs as L
from formline.operators import select as T

AUC_SQL = """(sum(CASE WHEN outcome = 1 THEN rk END) - count(*) FILTER (WHERE outcome = 1) * (count(*) FILTER (WHERE outcome = 1) + 1) / 2.0::DOUBLE)
    / (count(*) FILTER (WHERE outcome = 1) * count(*) FILTER (WHERE outcome = 0))"""


def metrics_sql(group: str, source: str = "q_pred", having: str = "") -> str:
    part = f"PARTITION BY {group} " if group else ""
    head = f"{group}, " if group else ""
    tail = f"GROUP BY {group} {having}" if group else ""
    hits = ", ".join(
        f"round(avg(outcome) FILTER (WHERE p >= {t}), 6) AS hit_rate_{int(round(t * 100))}, "
        f"count(*) FILTER (WHERE p >= {t}) AS n_bets_{int(round(t * 100))}" for t in E.THRESHOLDS)
    return f"""SELECT {head}count(*) AS total_bets, count(*) FILTER (WHERE hit) AS wins, count(*) FILTER (WHERE NOT hit) AS losses,
        round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 6) AS accuracy,
        round(avg(-CASE WHEN outcome = 1 THEN ln(pc) ELSE ln(1 - pc) END), 6) AS log_loss,
        round(avg((p - outcome) * (p - outcome)), 6) AS brier_score,
        count(*) FILTER (WHERE p >= 0.5 AND outcome = 1) AS true_positives, count(*) FILTER (WHERE p < 0.5 AND outcome = 0) AS true_negatives,
        count(*) FILTER (WHERE p >= 0.5 AND outcome = 0) AS false_positives, count(*) FILTER (WHERE p < 0.5 AND outcome = 1) AS false_negatives,
        {hits}, round({AUC_SQL}, 6) AS roc_auc,
        round((count(*) FILTER (WHERE hit) * 210 - count(*) * 110)::DOUBLE / (count(*) * 110), 6) AS simulated_roi,
        round((count(*) FILTER (WHERE hit) * 100 - count(*) FILTER (WHERE NOT hit) * 110)::DOUBLE / 100, 6) AS profit_units
        FROM (SELECT *, (p >= 0.5) = (outcome = 1) AS hit, least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS pc,
              rank() OVER ({part}ORDER BY p) + (count(*) OVER ({part}{',' if part else 'PARTITION BY'} p) - 1) / 2.0::DOUBLE AS rk FROM {source}) {tail}""".replace(
        f"{part},", f"{part.rstrip()}, " if part else ",")


FLOATS = ["accuracy", "log_loss", "brier_score", "hit_rate_55", "hit_rate_60", "hit_rate_65", "hit_rate_70", "roc_auc",
          "simulated_roi", "profit_units"]


def rounded(df, names):
    return df.select(*[c for c in df.columns if c not in names], *r6(*names))


@query("binary_metrics", metrics_sql(""))
def binary_metrics(spark, sf):
    return rounded(E.binary_metrics(predicted(spark, sf), "outcome", "p"), FLOATS)


@query("metrics_by_type", metrics_sql("prop", having="HAVING count(*) >= 5"))
def metrics_by_type(spark, sf):
    return rounded(E.metrics_by_type(predicted(spark, sf), "outcome", "p", "prop"), FLOATS)


DOCS_SQL = """(SELECT quality AS outcome, lang, n_chars / (n_chars + 2000)::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"""


@query("metrics_documents", metrics_sql("lang", DOCS_SQL, "HAVING count(*) >= 5"))
def metrics_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("quality").alias("outcome"), "lang", (F.col("n_chars") / (F.col("n_chars") + 2000)).alias("p"))
    return rounded(E.binary_metrics(rows, "outcome", "p", ["lang"], 5), FLOATS)


HYB = """count(*) AS total, count(*) FILTER (WHERE a) AS first_correct, count(*) FILTER (WHERE b) AS second_correct,
    round(avg(CASE WHEN a THEN 100 ELSE 0 END), 6) AS first_accuracy, round(avg(CASE WHEN b THEN 100 ELSE 0 END), 6) AS second_accuracy,
    count(*) FILTER (WHERE side <> side2) AS disagreements, count(*) FILTER (WHERE side <> side2 AND a) AS first_right,
    count(*) FILTER (WHERE side <> side2 AND b) AS second_right, count(*) FILTER (WHERE confidence2 >= 7) AS high_n,
    round(avg(CASE WHEN b THEN 100 ELSE 0 END) FILTER (WHERE confidence2 >= 7), 6) AS high_accuracy,
    count(*) FILTER (WHERE confidence2 <= 4) AS low_n, round(avg(CASE WHEN b THEN 100 ELSE 0 END) FILTER (WHERE confidence2 <= 4), 6) AS low_accuracy
    FROM (SELECT *, (side = 'OVER') = (outcome = 1) AS a, (side2 = 'OVER') = (outcome = 1) AS b FROM q_pred)"""


@query("hybrid_metrics", f"SELECT prop, {HYB} GROUP BY prop UNION ALL SELECT 'ALL', {HYB}")
def hybrid_metrics(spark, sf):
    rows = E.hybrid_metrics(predicted(spark, sf), "side", "side2", "confidence2", "outcome", "prop")
    return rounded(rows, ["first_accuracy", "second_accuracy", "high_accuracy", "low_accuracy"])


def backtest_sql(bet: str) -> str:
    return f"""SELECT day, n_bets, n_wins, profit, CAST(sum(profit) OVER (ORDER BY day) AS BIGINT) AS cumulative_profit,
    round(n_wins / greatest(n_bets, 1)::DOUBLE, 6) AS win_rate FROM (SELECT game_date AS day, count(*) FILTER (WHERE bet) AS n_bets,
    count(*) FILTER (WHERE bet AND win) AS n_wins, CAST(sum(CASE WHEN bet AND win THEN 100 WHEN bet THEN -110 ELSE 0 END) AS BIGINT) AS profit
    FROM (SELECT *, {bet} AS bet, CASE WHEN p >= 0.5 THEN outcome = 1 ELSE outcome = 0 END AS win FROM q_pred) GROUP BY 1)"""


@query("backtest_daily", backtest_sql("p >= 0.55"))
def backtest_daily(spark, sf):
    return rounded(E.backtest_daily(predicted(spark, sf), "game_date", "p", "outcome"), ["win_rate"])


@query("backtest_two_sided", backtest_sql("(p >= 0.55 OR p <= 0.45)"))
def backtest_two_sided(spark, sf):
    return rounded(E.backtest_daily(predicted(spark, sf), "game_date", "p", "outcome", two_sided=True), ["win_rate"])


def bins_sql(strict: bool) -> str:
    top = "CASE WHEN p < 1 THEN b END" if strict else "least(b, 9)"
    return f"""SELECT bin, n, round(acc, 6) AS accuracy, round(conf, 6) AS confidence, round(err, 6) AS error,
    round(sum(n / total * err) OVER (), 6) AS ece, round(max(err) OVER (), 6) AS mce FROM
    (SELECT *, abs(acc - conf) AS err FROM (SELECT CAST({top} AS INTEGER) AS bin, count(*) AS n, avg(outcome) AS acc, avg(p) AS conf,
     (SELECT count(*) FROM q_pred)::DOUBLE AS total
     FROM (SELECT *, CASE WHEN p < r * 0.1::DOUBLE THEN r - 1 ELSE r END AS b FROM (SELECT *, floor(p * 10) AS r FROM q_pred)) GROUP BY 1) WHERE bin IS NOT NULL)"""


@query("calibration_bins", bins_sql(False))
def calibration_bins(spark, sf):
    return rounded(E.calibration_bins(predicted(spark, sf), "p", "outcome"), ["accuracy", "confidence", "error", "ece", "mce"])


@query("calibration_bins_strict", bins_sql(True))
def calibration_bins_strict(spark, sf):
    return rounded(E.calibration_bins(predicted(spark, sf), "p", "outcome", True), ["accuracy", "confidence", "error", "ece", "mce"])


def acc_sql(dim: str, value: str, source: str, where: str = "", ok: str = "is_correct") -> str:
    return (f"SELECT '{dim}' AS dimension, CAST({value} AS VARCHAR) AS value, count(*) AS total, count(*) FILTER (WHERE {ok}) AS correct, "
            f"round(count(*) FILTER (WHERE {ok}) * 100.0::DOUBLE / count(*), 6) AS accuracy FROM {source} {where} GROUP BY 2")


CONF_SQL = " UNION ALL ".join([acc_sql("confidence", "confidence2", "q_log"), acc_sql("tier", "tier", "q_log"),
                               acc_sql("prop", "prop", "q_log"), acc_sql("overall", "'all'", "q_log")])


def _log(spark, sf):
    return tagged(spark, sf).drop("confidence").withColumnRenamed("confidence2", "confidence")


def confidence_rows(log):
    return E.accuracy_table(log, ["confidence", "tier", "prop"], "is_correct")


@query("confidence_table", CONF_SQL)
def confidence_table(spark, sf):
    return rounded(confidence_rows(_log(spark, sf)), ["accuracy"])


@query("confidence_adjust", f"""WITH_T SELECT game_id, prop, CAST(CASE WHEN cn >= 10 THEN greatest(greatest(least(greatest(confidence2 -
    CASE WHEN ca < 50 + (confidence2 - 5) * 10 - 10 THEN 1 ELSE 0 END, 1), 10) - CASE WHEN tn >= 10 AND ta < 50 THEN 1 ELSE 0 END, 1)
    - CASE WHEN pn >= 10 AND pa < 50 THEN 1 ELSE 0 END, 1) ELSE confidence2 END AS INTEGER) AS calibrated_confidence FROM (
    SELECT l.*, c.total AS cn, c.accuracy AS ca, t.total AS tn, t.accuracy AS ta, o.total AS pn, o.accuracy AS pa FROM q_log l
    LEFT JOIN (SELECT * FROM q_conf WHERE dimension = 'confidence') c ON c.value = CAST(confidence2 AS VARCHAR)
    LEFT JOIN (SELECT * FROM q_conf WHERE dimension = 'tier') t ON t.value = l.tier
    LEFT JOIN (SELECT * FROM q_conf WHERE dimension = 'prop') o ON o.value = l.prop)""".replace("WITH_T ", ""))
def confidence_adjust(spark, sf):
    log = _log(spark, sf)
    rows = E.confidence_adjust(log, confidence_rows(log), "confidence", "tier", "prop")
    return rows.select("game_id", "prop", "calibrated_confidence")


BAND = "(SELECT * FROM q_log)"
SESSION_SQL = " UNION ALL ".join([
    f"SELECT *, CAST(NULL AS BIGINT) AS case_studies FROM ({acc_sql('tier', 'tier', 'q_log')})",
    f"SELECT *, NULL FROM ({acc_sql('prop', 'prop', 'q_log')})",
    f"SELECT *, NULL FROM ({acc_sql('band', chr(39) + '8+' + chr(39), 'q_log', 'WHERE confidence2 >= 8')})",
    f"SELECT *, NULL FROM ({acc_sql('overall', chr(39) + 'all' + chr(39), 'q_log')})",
    f"""SELECT *, NULL FROM ({acc_sql('tag', 'tag', "(SELECT unnest(string_split(tags, ',')) AS tag, is_correct FROM q_log WHERE tags <> '')")})""",
    f"""SELECT a.*, coalesce(s.n, 0) FROM ({acc_sql('day', 'game_date', 'q_log')}) a
        LEFT JOIN (SELECT CAST(game_date AS VARCHAR) AS value, count(*) AS n FROM q_log WHERE NOT is_correct GROUP BY 1) s USING (value)""",
])


@query("session_metrics", SESSION_SQL)
def session_metrics(spark, sf):
    log = _log(spark, sf)
    return rounded(L.session_metrics(log, log.filter("NOT is_correct").select("game_date")), ["accuracy"])


def slip_log(spark, sf):
    """Orders as slips: size from the line count, theme from the priority, risk from the status."""
    sizes = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf, "orders").join(sizes, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(
        F.col("o_orderkey").alias("study_id"), (F.col("n") % 5 + 2).cast("int").alias("parlay_size"),
        F.col("o_orderpriority").alias("theme"), F.col("o_orderstatus").alias("risk_level"),
        F.when(F.col("o_orderkey") % 3 == 0, "WIN").otherwise("LOSS").alias("outcome"))


SLIP_SQL = """SELECT o_orderkey AS study_id, CAST(n % 5 + 2 AS INTEGER) AS parlay_size, o_orderpriority AS theme, o_orderstatus AS risk_level,
    o_orderkey % 3 = 0 AS won FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""
SLIP_PART = """count(*) AS total, count(*) FILTER (WHERE won) AS wins, count(*) FILTER (WHERE NOT won) AS losses,
    round(count(*) FILTER (WHERE won) * 100.0::DOUBLE / count(*), 6) AS win_rate"""


@query("parlay_stats", f"""SELECT *, dimension = 'parlay_size' AND win_rate < 30 AS discouraged FROM (""" + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({v} AS VARCHAR) AS value, {SLIP_PART} FROM ({SLIP_SQL}) GROUP BY 2"
    for d, v in (("parlay_size", "parlay_size"), ("theme", "theme"), ("risk_level", "risk_level"), ("overall", "'all'"))) + ")")
def parlay_stats(spark, sf):
    return rounded(L.parlay_stats(slip_log(spark, sf)), ["win_rate"])


def studies(spark, sf):
    """Missed predictions as studies with an archetype."""
    rows = tagged(spark, sf).filter("NOT is_correct")
    return rows.select(
        (F.col("game_id") * 4 + F.expr("array_position(array('PTS','REB','AST','3PM'), prop)") - 1).alias("study_id"), "game_date",
        F.concat_ws("-", "tier", "prop", "side").alias("archetype"), "tier", "prop", "context_tags")


STUDY_SQL = """SELECT game_id * 4 + list_position(['PTS','REB','AST','3PM'], prop) - 1 AS study_id, game_date,
    tier || '-' || prop || '-' || side AS archetype, tier, prop, tags FROM q_log WHERE NOT is_correct"""


@query("archetype_counts", f"""SELECT archetype, count(*) AS n, arg_min(study_id, (game_date, study_id)) AS first_study FROM
    (SELECT * FROM ({STUDY_SQL}) ORDER BY game_date DESC, study_id DESC LIMIT 50) GROUP BY archetype HAVING count(*) >= 3""")
def archetype_counts(spark, sf):
    return L.archetype_counts(studies(spark, sf), ["game_date", "study_id"])


@query("latest_n", f"SELECT study_id, archetype FROM ({STUDY_SQL}) ORDER BY game_date DESC, study_id DESC LIMIT 200")
def latest_n(spark, sf):
    return L.latest_n(studies(spark, sf), ["game_date", "study_id"]).select("study_id", "archetype")


@query("study_lookup", f"""SELECT study_id, archetype FROM ({STUDY_SQL}) WHERE tier = 'STAR' AND prop = 'REB'
    AND (list_contains(string_split(tags, ','), 'b2b') OR list_contains(string_split(tags, ','), 'large_edge')) ORDER BY study_id LIMIT 5""")
def study_lookup(spark, sf):
    rows = L.study_lookup(studies(spark, sf), "STAR", "REB", ["b2b", "large_edge"], ["study_id"])
    return rows.select("study_id", "archetype")


@query("slip_lookup", f"""SELECT study_id, parlay_size, theme FROM ({SLIP_SQL}) WHERE parlay_size = 6 OR contains(lower(theme), 'high')
    OR contains('high', lower(theme)) ORDER BY study_id LIMIT 5""")
def slip_lookup(spark, sf):
    return L.slip_lookup(slip_log(spark, sf), 6, "HIGH", ["study_id"]).select("study_id", "parlay_size", "theme")


@query("feature_requests", """WITH g AS (SELECT k, count(*) AS requests, min(ts) AS ts, min(event_id) AS e FROM q_ev GROUP BY k),
    t AS (SELECT * FROM g ORDER BY requests DESC, 'feature_' || k LIMIT 10),
    c AS (SELECT k, string_agg(team, '; ' ORDER BY ts, event_id) AS contexts FROM
      (SELECT * FROM q_ev QUALIFY row_number() OVER (PARTITION BY k ORDER BY ts, event_id) <= 3) GROUP BY k)
    SELECT 'feature_' || k AS feature, requests, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_seen, contexts,
    CASE WHEN requests >= 5 THEN 'HIGH' WHEN requests >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM t JOIN c USING (k)""")
def feature_requests(spark, sf):
    log = table(spark, sf, "events").select(
        F.concat(F.lit("feature_"), F.from_json("props", "struct<k:long>")["k"]).alias("feature"),
        F.col("event_type").alias("context"), F.col("ts").alias("timestamp"), F.col("event_id").alias("request_id"))
    rows = L.feature_requests(log)
    return rows.withColumn("first_seen", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss"))


IMP = ["l5", "l10", "sm", "sd5", "sd10", "line", "home", "rest_days", "is_b2b", "odds"]


def importances(spark, sf):
    """|correlation with the outcome| of each feature per type, as importances of four models."""
    cols = [F.abs(F.corr(F.col(c).cast("double"), F.col("outcome").cast("double"))).alias(c) for c in IMP]
    wide = predicted(spark, sf).groupBy("prop").agg(*cols)
    rows = wide.unpivot(["prop"], IMP, "feature", "importance").filter("importance IS NOT NULL")
    return E.importance_share(rows, "prop", "feature", "importance")


IMP_SQL = "SELECT *, row_number() OVER (PARTITION BY prop ORDER BY pct DESC, feature) AS rank FROM (SELECT prop, feature, importance / sum(importance) OVER (PARTITION BY prop) * 100 AS pct FROM (" + " UNION ALL ".join(
    f"SELECT prop, '{c}' AS feature, abs(corr({c}, outcome)) AS importance FROM q_pred GROUP BY prop" for c in IMP) + ") WHERE importance IS NOT NULL)"


@query("importance_rollup", f"""SELECT feature, round(avg(pct), 5) AS mean_pct, count(*) AS models, avg(pct) < 0.5 AS noise FROM ({IMP_SQL}) WHERE rank <= 15 GROUP BY feature""")
def importance_rollup(spark, sf):
    return E.importance_by_feature(importances(spark, sf), "prop", "feature").withColumn("mean_pct", F.round("mean_pct", 5))


CAT = "CASE WHEN feature IN ('rest_days', 'is_b2b') THEN 'Rest & Schedule' WHEN feature = 'home' THEN 'Home/Away' WHEN feature IN ('line', 'odds') THEN 'Market/Odds' ELSE 'Other' END"


@query("importance_by_category", f"""SELECT category, round(total, 5) AS total, round(share, 5) AS share,
    CASE category WHEN 'Market/Odds' THEN share > 40 WHEN 'Rest & Schedule' THEN share < 5 ELSE false END AS flagged FROM
    (SELECT *, total / sum(total) OVER () * 100 AS share FROM (SELECT {CAT} AS category, sum(pct) AS total FROM ({IMP_SQL}) WHERE rank <= 15 GROUP BY 1))""")
def importance_by_category(spark, sf):
    rows = E.importance_by_category(importances(spark, sf), "feature")
    return rows.select("category", F.round("total", 5).alias("total"), F.round("share", 5).alias("share"), "flagged")


BASE_SQL = """SELECT {scope} AS scope, CAST(sum(n) AS BIGINT) AS samples, count(*) AS players, round(sum(pos) / sum(n), 6) AS over_rate,
    round(1 - sum(pos) / sum(n), 6) AS under_rate, round(greatest(sum(pos) / sum(n), 1 - sum(pos) / sum(n)), 6) AS majority_accuracy,
    CASE WHEN sum(pos) / sum(n) > 0.5 THEN 'OVER' ELSE 'UNDER' END AS majority, round(avg(n), 6) AS props_per_player, max(n) AS max_props,
    count(*) FILTER (WHERE n >= 10) AS players_10_plus FROM (SELECT {keys}, count(*) AS n, sum(outcome)::DOUBLE AS pos FROM q_lab GROUP BY {keys}) {tail}"""


@query("label_baseline", BASE_SQL.format(scope="prop", keys="prop, entity_id", tail="GROUP BY prop") + " UNION ALL "
       + BASE_SQL.format(scope="'ALL'", keys="entity_id", tail=""))
def label_baseline(spark, sf):
    rows = E.label_baseline(predicted(spark, sf), "outcome", "entity_id", "prop")
    return rounded(rows, ["over_rate", "under_rate", "majority_accuracy", "props_per_player"])


@query("feature_outcome_corr", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(corr({c}, outcome), 6) AS r, coalesce(abs(corr({c}, outcome)) > 0.8, false) AS suspicious FROM q_pred" for c in [*IMP, "actual"]))
def feature_outcome_corr(spark, sf):
    return E.feature_outcome_corr(predicted(spark, sf), [*IMP, "actual"], "outcome").withColumn("r", F.round("r", 6))


SPLIT_DAY = "(SELECT d FROM (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT game_date AS d FROM q_lab)) WHERE i = floor(n * 0.6))"


@query("time_gap_accuracy", " UNION ALL ".join(
    f"""SELECT {g} AS gap, count(*) AS test_size, round(avg(CASE WHEN (p > 0.5) = (outcome = 1) THEN 1 ELSE 0 END), 6) AS accuracy,
    round(coalesce({AUC_SQL}, 0.5), 6) AS roc_auc FROM (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS rk
    FROM q_pred WHERE game_date >= {SPLIT_DAY} + {g}) HAVING count(*) >= 50""" for g in E.GAPS))
def time_gap_accuracy(spark, sf):
    return rounded(E.time_gap_accuracy(predicted(spark, sf), "game_date", "p", "outcome"), ["accuracy", "roc_auc"])


@query("walk_forward_majority", """SELECT CAST(sum(n) AS BIGINT) AS test_rows, round(sum(CASE WHEN pp / pn > 0.5 THEN pos ELSE n - pos END) / sum(n), 6) AS accuracy,
    round(sum(pos) / sum(n), 6) AS over_rate FROM (SELECT *, sum(n) OVER w AS pn, sum(pos) OVER w AS pp, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS days
    FROM (SELECT game_date AS d, count(*) AS n, sum(outcome)::DOUBLE AS pos FROM q_lab GROUP BY 1)
    WINDOW w AS (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE i >= floor(days * 0.6) AND i < floor(days * 0.6) + 30""")
def walk_forward_majority(spark, sf):
    return rounded(E.walk_forward_majority(predicted(spark, sf), "game_date", "outcome"), ["accuracy", "over_rate"])


@query("best_model_registry", """WITH runs AS (SELECT prop, CAST(year(game_date) * 12 + month(game_date) AS INTEGER) AS run, round(avg(CASE WHEN is_correct THEN 1 ELSE 0 END), 6) AS accuracy
    FROM q_log GROUP BY 1, 2), b AS (SELECT prop, run FROM runs QUALIFY row_number() OVER (PARTITION BY prop ORDER BY accuracy DESC, run) = 1)
    SELECT prop, run, accuracy, is_best FROM (SELECT r.*, b.run IS NOT NULL AS is_best FROM runs r LEFT JOIN b USING (prop, run))
    QUALIFY row_number() OVER (PARTITION BY prop, is_best ORDER BY run DESC) <= 10""")
def best_model_registry(spark, sf):
    run = (F.year("game_date") * 12 + F.month("game_date")).alias("run")
    runs = tagged(spark, sf).groupBy("prop", run).agg(
        F.round(F.avg(F.when(F.col("is_correct"), 1).otherwise(0)), 6).alias("accuracy"))
    return L.best_model_registry(runs, "prop", "accuracy", ["run"]).select("prop", "run", "accuracy", "is_best")


@query("best_price", f"""SELECT game_id, player_name, market, line, book, odds FROM ({RAW_SQL}) WHERE line IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY game_id, player_name, market, line ORDER BY odds DESC, book DESC) = 1""")
def best_price(spark, sf):
    rows = raw_lines(spark, sf).filter("line IS NOT NULL").withColumn("book_no", -F.substring("book", 5, 1).cast("int"))
    out = T.best_price(rows, ["game_id", "player_name", "market", "line"], "odds", ["book_no"], ["book"])
    return out.select("game_id", "player_name", "market", "line", "book", "odds")
