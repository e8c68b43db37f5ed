"""Metrics of predictions, back-tests and calibration. One pass where the metric allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formline.operators.ordered import Frame, rolling, running_total

THRESHOLDS = (0.55, 0.60, 0.65, 0.70)
CLIP = 1e-15


def share(num: Column, den: Column, scale: float = 1.0) -> Column:
    return F.when(den > 0, num / den * scale)


def score_histogram(df: DataFrame, group: list[str], outcome: str, prob: str) -> DataFrame:
    """Rows and positives per distinct score: all that the metrics below need to know."""
    return df.groupBy(*group, F.col(prob).alias("p")).agg(
        F.count("*").alias("n"), F.sum(F.col(outcome).cast("long")).alias("pos")
    )


def roc_auc() -> Column:
    """Exact AUC with ties from ``__below``, the rows under each score; no rows are sorted."""
    rank = F.coalesce(F.col("__below"), F.lit(0)) + (F.col("n") + 1) / 2.0
    n_pos, n_neg = F.sum("pos").cast("double"), F.sum(F.col("n") - F.col("pos")).cast("double")
    auc = (F.sum(F.col("pos") * rank) - n_pos * (n_pos + 1.0) / 2.0) / (n_pos * n_neg)
    return F.when((n_pos > 0) & (n_neg > 0), auc)


def metric_columns() -> list[Column]:
    """Metrics as sums over the histogram."""
    p, n, pos = F.col("p"), F.col("n"), F.col("pos")
    neg = n - pos
    call = p >= 0.5
    total, wins = F.sum(n), F.sum(F.when(call, pos).otherwise(neg))
    safe = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1.0 - CLIP))

    def rows(cond: Column, value: Column) -> Column:
        return F.sum(F.when(cond, value).otherwise(0))

    cols = [
        total.alias("total_bets"), wins.alias("wins"), (total - wins).alias("losses"),
        (wins / total).alias("accuracy"),
        (F.sum(-(pos * F.log(safe) + neg * F.log(1.0 - safe))) / total).alias("log_loss"),
        (F.sum(pos * (p - 1.0) * (p - 1.0) + neg * p * p) / total).alias("brier_score"),
        roc_auc().alias("roc_auc"),
        rows(call, pos).alias("true_positives"), rows(~call, neg).alias("true_negatives"),
        rows(call, neg).alias("false_positives"), rows(~call, pos).alias("false_negatives"),
        ((wins * 210 - total * 110) / (total * 110)).alias("simulated_roi"),
        ((wins * 100 - (total - wins) * 110) / 100.0).alias("profit_units"),
    ]
    for t in THRESHOLDS:
        name = int(round(t * 100))
        bets = rows(p >= t, n)
        cols += [share(rows(p >= t, pos), bets).alias(f"hit_rate_{name}"), bets.alias(f"n_bets_{name}")]
    return cols


def metrics_of_histogram(hist: DataFrame, group: list[str]) -> DataFrame:
    ahead = rolling(hist, group, ["p"], [Frame("__below", "sum", "n")])
    return ahead.groupBy(*group).agg(*metric_columns())


def binary_metrics(df: DataFrame, outcome: str, prob: str, group: list[str] | None = None,
                   at_least: int = 1) -> DataFrame:
    """Accuracy, log-loss, Brier, AUC, hit rates, wins, flat-stake return and confusion counts."""
    keys = list(group or [])
    rows = df.filter(F.col(outcome).isNotNull() & F.col(prob).isNotNull())
    out = metrics_of_histogram(score_histogram(rows, keys, outcome, prob), keys)
    return out.filter(F.col("total_bets") >= at_least)


def metrics_by_type(df: DataFrame, outcome: str, prob: str, prop: str, at_least: int = 5) -> DataFrame:
    return binary_metrics(df, outcome, prob, [prop], at_least)


def hybrid_metrics(df: DataFrame, first: str, second: str, confidence: str, outcome: str,
                   prop: str | None = None) -> DataFrame:
    """Two predictors against the outcome, and who was right where they disagreed."""
    y = F.col(outcome) == 1
    a = (F.col(first) == "OVER") == y
    b = (F.col(second) == "OVER") == y
    differ = F.col(first) != F.col(second)
    high, low = F.col(confidence) >= 7, F.col(confidence) <= 4

    def pct(cond: Column, where: Column | None = None) -> Column:
        v = F.when(cond, 100.0).otherwise(0.0)
        return F.avg(v if where is None else F.when(where, v))

    cols = [
        F.count("*").alias("total"),
        F.count_if(a).alias("first_correct"), F.count_if(b).alias("second_correct"),
        pct(a).alias("first_accuracy"), pct(b).alias("second_accuracy"),
        F.count_if(differ).alias("disagreements"),
        F.count_if(differ & a).alias("first_right"), F.count_if(differ & b).alias("second_right"),
        F.count_if(high).alias("high_n"), pct(b, high).alias("high_accuracy"),
        F.count_if(low).alias("low_n"), pct(b, low).alias("low_accuracy"),
    ]
    if prop is None:
        return df.agg(*cols)
    label = F.coalesce(F.col(prop), F.lit("ALL")).alias("prop")
    return df.groupingSets([[F.col(prop)], []], F.col(prop)).agg(*cols).select(label, *[F.col(n) for n in (
        "total", "first_correct", "second_correct", "first_accuracy", "second_accuracy", "disagreements",
        "first_right", "second_right", "high_n", "high_accuracy", "low_n", "low_accuracy")])


def backtest_daily(df: DataFrame, day: str, prob: str, outcome: str, at_least: float = 0.55,
                   two_sided: bool = False) -> DataFrame:
    """Flat stakes at -110 by day with the running balance. One-sided stakes only on high p."""
    p, y = F.col(prob), F.col(outcome)
    bet = p >= at_least
    if two_sided:
        bet = bet | (F.round(1.0 - p, 9) >= at_least)
    win = F.when(p >= 0.5, y == 1).otherwise(y == 0)
    profit = F.when(bet & win, 100).when(bet, -110).otherwise(0)
    daily = df.groupBy(F.col(day).alias("day")).agg(
        F.count_if(bet).alias("n_bets"),
        F.count_if(bet & win).alias("n_wins"),
        F.sum(profit).alias("profit"),
    )
    rows = running_total(daily, [], ["day"], "profit", "cumulative_profit", bounded=True)
    return rows.withColumn("win_rate", F.col("n_wins") / F.greatest(F.col("n_bets"), F.lit(1)))


def calibration_bins(df: DataFrame, prob: str, outcome: str, strict: bool = False) -> DataFrame:
    """Ten equal bins with n, accuracy, mean p and error; ECE and MCE ride along on every bin."""
    from formline.functions.scalars import probability_bin

    bins = (
        df.withColumn("bin", probability_bin(F.col(prob), strict)).groupBy("bin").agg(
            F.count("*").alias("n"),
            F.avg(F.col(outcome).cast("double")).alias("accuracy"),
            F.avg(prob).alias("confidence"),
        )
    )
    all_bins = Window.partitionBy()
    rows = bins.withColumn("error", F.abs(F.col("accuracy") - F.col("confidence"))).withColumn(
        "__all", F.sum("n").over(all_bins)
    )
    inside = F.col("bin").isNotNull()
    return rows.withColumn(
        "ece", F.sum(F.when(inside, F.col("n") / F.col("__all") * F.col("error"))).over(all_bins)
    ).withColumn("mce", F.max(F.when(inside, F.col("error"))).over(all_bins)).filter(inside).drop("__all")


def accuracy_table(df: DataFrame, dims: list[str], correct: str) -> DataFrame:
    """Totals, correct and accuracy for each value of each dimension and overall, one pass."""
    cols = [F.col(d) for d in dims]
    rows = df.groupingSets([[c] for c in cols] + [[]], *cols).agg(
        F.grouping_id(*cols).alias("__gid"),
        F.count("*").alias("total"),
        F.count_if(F.col(correct)).alias("correct"),
    )
    k = len(dims)
    dim = F.lit("overall")
    value = F.lit("all")
    for i, d in enumerate(dims):
        mine = (2**k - 1) ^ (1 << (k - 1 - i))
        dim = F.when(F.col("__gid") == mine, d).otherwise(dim)
        value = F.when(F.col("__gid") == mine, F.coalesce(F.col(d).cast("string"), F.lit("Unknown"))).otherwise(value)
    return rows.select(
        dim.alias("dimension"), value.alias("value"), "total", "correct",
        (F.col("correct") / F.col("total") * 100.0).alias("accuracy"),
    )


def confidence_adjust(df: DataFrame, table: DataFrame, confidence: str, tier: str, prop: str) -> DataFrame:
    """Lower a confidence whose past accuracy fell short; weak tiers and types cost one more each.

    The table holds ten confidences and the tier and type names, so it enters as one map (a scalar
    subquery) and the predictions are neither joined nor shuffled.
    """
    kept = table.filter(
        F.col("dimension").isin("tier", "prop")
        | ((F.col("dimension") == "confidence") & F.col("value").isin(*[str(i) for i in range(1, 11)]))
    )
    entry = F.struct(F.concat_ws(":", "dimension", "value").alias("k"), F.struct("total", "accuracy").alias("v"))
    past = kept.agg(F.map_from_entries(F.collect_list(entry))).scalar()

    def of(dim: str, key: Column) -> Column:
        return F.try_element_at("__past", F.concat_ws(":", F.lit(dim), key.cast("string")))

    def weak(entry: str) -> Column:
        return F.when((F.col(f"{entry}.total") >= 10) & (F.col(f"{entry}.accuracy") < 50), 1).otherwise(0)

    c = F.col(confidence)
    rows = df.withColumn("__past", past).withColumns({
        "__c": of("confidence", c), "__t": of("tier", F.col(tier)), "__p": of("prop", F.col(prop)),
    })
    known = F.coalesce(F.col("__c.total") >= 10, F.lit(False))
    short = F.when(F.col("__c.accuracy") < 50 + (c - 5) * 10 - 10, 1).otherwise(0)
    first = F.least(F.greatest(c - short, F.lit(1)), F.lit(10))
    second = F.greatest(first - weak("__t"), F.lit(1))
    third = F.greatest(second - weak("__p"), F.lit(1))
    out = rows.withColumn("calibrated_confidence", F.when(known, third).otherwise(c).cast("int"))
    return out.drop("__past", "__c", "__t", "__p")


def day_at_share(df: DataFrame, day: str, part: float) -> Column:
    """The distinct day at index ``int(part * n_days)``, as a scalar subquery."""
    days = df.groupBy(F.col(day).alias("__d")).agg(F.count("*").alias("__n"))
    w = Window.orderBy("__d")
    numbered = days.select("__d", (F.row_number().over(w) - 1).alias("__i"), F.count("*").over(Window.partitionBy()).alias("__days"))
    return numbered.filter(F.col("__i") == F.floor(F.col("__days") * part)).agg(F.max("__d")).scalar()


GAPS = (0, 7, 14, 30)


def time_gap_accuracy(df: DataFrame, day: str, prob: str, outcome: str, part: float = 0.6,
                      at_least: int = 50) -> DataFrame:
    """Accuracy and AUC on rows at least 0, 7, 14 and 30 days past the split day."""
    since = F.datediff(F.col(day), F.col("__split"))
    level = F.lit(0)
    for i, g in enumerate(GAPS):
        level = F.when(since >= g, i + 1).otherwise(level)
    rows = df.withColumn("__split", day_at_share(df, day, part)).withColumn("level", level).filter("level > 0")
    hist = score_histogram(rows, ["level"], outcome, prob)
    gaps = F.slice(F.array(*[F.lit(g) for g in GAPS]), F.lit(1), F.col("level"))
    spread = hist.withColumn("gap", F.explode(gaps)).groupBy("gap", "p").agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")
    )
    over = F.col("p") > 0.5
    right = F.sum(F.when(over, F.col("pos")).otherwise(F.col("n") - F.col("pos")))
    out = rolling(spread, ["gap"], ["p"], [Frame("__below", "sum", "n")]).groupBy("gap").agg(
        F.sum("n").alias("total_bets"), (right / F.sum("n")).alias("accuracy"), roc_auc().alias("roc_auc")
    )
    return out.filter(F.col("total_bets") >= at_least).select(
        "gap", F.col("total_bets").alias("test_size"), "accuracy", F.coalesce("roc_auc", F.lit(0.5)).alias("roc_auc")
    )


def walk_forward_majority(df: DataFrame, day: str, outcome: str, part: float = 0.6, days: int = 30) -> DataFrame:
    """Day by day, predict the majority of strictly earlier rows; accuracy over up to ``days`` days."""
    daily = df.groupBy(F.col(day).alias("d")).agg(
        F.count("*").alias("n"), F.sum(F.col(outcome).cast("long")).alias("pos")
    )
    rows = rolling(daily, [], ["d"], [Frame("pn", "sum", "n"), Frame("pp", "sum", "pos"), Frame("i", "count", "n")],
                   bounded=True)
    total = F.count("*").over(Window.partitionBy())
    start = F.floor(F.col("days") * part)
    rows = rows.withColumn("days", total).filter((F.col("i") >= start) & (F.col("i") < start + days))
    right = F.when(F.coalesce(F.col("pp") / F.col("pn"), F.lit(0.0)) > 0.5, F.col("pos")).otherwise(F.col("n") - F.col("pos"))
    return rows.agg(
        F.sum("n").alias("test_rows"), (F.sum(right) / F.sum("n")).alias("accuracy"),
        (F.sum("pos") / F.sum("n")).alias("over_rate"),
    )


def label_baseline(df: DataFrame, outcome: str, player: str, prop: str) -> DataFrame:
    """Over and under rates, majority accuracy and how props spread over players, all and by type."""
    y = F.col(outcome).cast("long")
    per = df.groupBy(prop, player).agg(F.count("*").alias("n"), F.sum(y).alias("pos"))
    p = F.col(prop)
    # One row per (scope, player): the overall scope re-sums the per-type rows, not the input.
    scoped = per.withColumn("scope", F.explode(F.array(p, F.lit("ALL")))).groupBy("scope", player).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos")
    )
    rate = F.sum("pos") / F.sum("n")
    return scoped.groupBy("scope").agg(
        F.sum("n").alias("samples"), F.count("*").alias("players"),
        rate.alias("over_rate"), (1.0 - rate).alias("under_rate"),
        F.greatest(rate, 1.0 - rate).alias("majority_accuracy"),
        F.when(rate > 0.5, "OVER").otherwise("UNDER").alias("majority"),
        F.avg("n").alias("props_per_player"), F.max("n").alias("max_props"),
        F.count_if(F.col("n") >= 10).alias("players_10_plus"),
    )


def feature_outcome_corr(df: DataFrame, features: list[str], outcome: str, limit: float = 0.8) -> DataFrame:
    """Correlation of each feature with the outcome, in one aggregate turned into rows."""
    wide = df.agg(*[F.corr(F.col(f).cast("double"), F.col(outcome).cast("double")).alias(f) for f in features])
    rows = wide.unpivot([], features, "feature", "r")
    return rows.withColumn("suspicious", F.coalesce(F.abs("r") > limit, F.lit(False)))


def importance_share(df: DataFrame, model: str, feature: str, value: str) -> DataFrame:
    """Importance in percent of its model, with the rank inside the model."""
    w = Window.partitionBy(model)
    rows = df.withColumn("pct", F.col(value) / F.sum(value).over(w) * 100.0)
    return rows.withColumn(
        "rank", F.row_number().over(w.orderBy(F.desc("pct"), F.asc(feature)))
    )


def importance_by_feature(shares: DataFrame, model: str, feature: str, top: int = 15) -> DataFrame:
    """Mean share over models and the noise flag, from each model's leading features."""
    lead = shares.filter(F.col("rank") <= top)
    return lead.groupBy(feature).agg(F.avg("pct").alias("mean_pct"), F.count("*").alias("models")).withColumn(
        "noise", F.col("mean_pct") < 0.5
    )


# Category shares (percent) that raise a remark.
SHARE_REMARKS = {
    "Market/Odds": (">", 40.0), "Player Recent Form": (">", 50.0),
    "Opponent Defense": ("<", 10.0), "Rest & Schedule": ("<", 5.0),
}


def importance_by_category(shares: DataFrame, feature: str, top: int = 15) -> DataFrame:
    from formline.functions.scalars import feature_group

    lead = shares.filter(F.col("rank") <= top).withColumn("category", feature_group(F.col(feature)))
    sums = lead.groupBy("category").agg(F.sum("pct").alias("total"))
    rows = sums.withColumn("share", F.col("total") / F.sum("total").over(Window.partitionBy()) * 100.0)
    flag = F.lit(False)
    for name, (op, cut) in SHARE_REMARKS.items():
        hit = F.col("share") > cut if op == ">" else F.col("share") < cut
        flag = F.when(F.col("category") == name, hit).otherwise(flag)
    return rows.withColumn("flagged", flag)
