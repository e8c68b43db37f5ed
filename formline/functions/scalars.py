"""Column expressions: every function takes Columns and gives a Column, nothing runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from formline import config


def case_of(subject: Column, mapping: dict, default: Column) -> Column:
    """CASE over a fixed mapping."""
    out = None
    for key, value in mapping.items():
        hit = subject == F.lit(key)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(default)


def season_of(day: Column) -> Column:
    """Label ``2024-25``: October to December open a season, other months belong to the one before."""
    start = F.year(day) - F.when(F.month(day) >= 10, 0).otherwise(1)
    return F.concat(
        start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0")
    )


def parse_time(text: Column, formats: list[str] | None = None) -> Column:
    """First of several timestamp forms that fits; null when none does."""
    formats = formats or [
        "yyyy-MM-dd HH:mm:ss",
        "yyyy-MM-dd'T'HH:mm:ssXXX",
        "yyyy-MM-dd HH:mm:ssXXX",
        "yyyy-MM-dd",
    ]
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def game_day_eastern(utc: Column) -> Column:
    """Calendar day of a UTC instant at the venue clock, summer time included."""
    return F.to_date(F.from_utc_timestamp(utc, "America/New_York"))


def join_key(day: Column, team: Column, opponent: Column, home: Column) -> Column:
    """``yyyy-MM-dd_HOME_AWAY``."""
    return F.concat_ws(
        "_",
        F.date_format(day, "yyyy-MM-dd"),
        F.when(home == 1, team).otherwise(opponent),
        F.when(home == 1, opponent).otherwise(team),
    )


def normalize_prop(prop: Column) -> Column:
    return case_of(prop, config.PROP_ALIASES, prop)


def ratio(num: Column, den: Column) -> Column:
    """num / den where den is positive, else null."""
    return F.when(den > 0, num / den)


def implied_probability(odds: Column) -> Column:
    """American odds to probability; missing or zero odds count as even."""
    o = odds.cast("double")
    return (
        F.when(o.isNull() | (o == 0), 0.5)
        .when(o > 0, 100.0 / (o + 100.0))
        .otherwise(F.abs(o) / (F.abs(o) + 100.0))
    )


def decimal_probability(price: Column) -> Column:
    """Decimal odds to a percentage."""
    return F.when(price > 0, 100.0 / price)


def roi_percent(accuracy: Column, odds: Column) -> Column:
    """Expected return in percent of the stake."""
    o = odds.cast("double")
    payout = F.when(o < 0, 100.0 / F.abs(o)).otherwise(o / 100.0)
    return (accuracy * payout - (1.0 - accuracy)) * 100.0


def outcome(actual: Column, line: Column) -> Column:
    """1 over, 0 under or push, null while the actual is missing."""
    return F.when(actual.isNull() | line.isNull(), F.lit(None).cast("int")).otherwise(
        (actual > line).cast("int")
    )


def side_of(edge: Column) -> Column:
    return F.when(edge > 0, "OVER").when(edge < -0.05, "UNDER").otherwise("NEUTRAL")


def coefficient_of_variation(prop: Column, by_prop: dict[str, tuple[Column, Column, Column]]) -> Column:
    """Spread over level for the row's own prop type: L5 sd, else L10 sd, else the type's default."""
    out = None
    for name, (sd5, sd10, mean) in by_prop.items():
        cv = F.when(
            mean > 0, F.coalesce(sd5, sd10, F.lit(config.SPREAD_DEFAULTS[name])) / mean
        ).otherwise(1.0)
        hit = prop == name
        out = F.when(hit, cv) if out is None else out.when(hit, cv)
    return out.otherwise(1.0)


def reliability(cv: Column) -> Column:
    """Tag of a coefficient of variation; nine digits, so summation noise cannot cross a limit."""
    cv = F.round(cv, 9)
    return F.when(cv < 0.25, "SNIPER").when(cv < 0.45, "STANDARD").otherwise("VOLATILE")


def usage_tier(usage: Column, impact: Column) -> Column:
    def above(u: float, i: float) -> Column:
        return F.coalesce(usage > u, F.lit(False)) | F.coalesce(impact > i, F.lit(False))

    return (
        F.when(above(0.25, 0.15), "STAR")
        .when(above(0.22, 0.12), "SECONDARY")
        .when(above(0.18, 0.08), "ROTATION")
        .otherwise("ROLE")
    )


def ten_point_confidence(p: Column) -> Column:
    """Distance from even on a 1 to 10 scale, cut to an integer."""
    return F.least(F.greatest(F.abs(p - 0.5) * 20.0, F.lit(1.0)), F.lit(10.0)).cast("int")


def five_to_ten_confidence(p: Column) -> Column:
    """Distance from even on a 5 to 10 scale."""
    return F.least(
        F.greatest((5.0 + 10.0 * F.abs(p - 0.5)).cast("int"), F.lit(5)), F.lit(10)
    )


def or_default(value: Column, default: float) -> Column:
    """Missing and zero both stand for the default."""
    v = value.cast("double")
    return F.when(v.isNull() | (v == 0), F.lit(float(default))).otherwise(v)


def context_tags(b2b: Column, opp_rank: Column, pace: Column, spread: Column, total: Column,
                 edge: Column) -> Column:
    """Array of situation tags, one at most per dimension, in this order."""
    rank = or_default(opp_rank, 15)
    speed = or_default(pace, 100)
    gap = F.abs(or_default(spread, 0))
    points = or_default(total, 220)
    margin = F.abs(or_default(edge, 0))
    return F.array_compact(
        F.array(
            F.when(b2b == 1, "b2b"),
            F.when(rank <= 5, "elite_defense").when(rank <= 10, "good_defense")
            .when(rank >= 25, "weak_defense"),
            F.when(speed > 102, "fast_pace").when(speed < 97, "slow_pace"),
            F.when(gap > 14, "blowout_risk").when(gap > 10, "moderate_spread"),
            F.when(points > 235, "high_total").when(points < 215, "low_total"),
            F.when(margin > 5, "large_edge").when(margin < 2, "small_edge"),
        )
    )


def miss_margin(actual: Column, line: Column, side: Column) -> Column:
    """Signed distance to the line, positive on the side that was called."""
    return F.when(F.upper(side) == "OVER", actual - line).otherwise(line - actual)


def miss_percent(margin: Column, line: Column) -> Column:
    return F.when(line > 0, F.abs(margin) / line * 100.0).otherwise(0.0)


def severity(margin: Column, percent: Column) -> Column:
    size = F.abs(margin)
    return (
        F.when((size < 1.0) | (percent < 10), "MINOR")
        .when((size < 2.0) | (percent < 25), "MODERATE")
        .otherwise("MAJOR")
    )


def feature_group(name: Column) -> Column:
    """Group of a feature by its name; rules are tried in their listed order."""
    low = F.lower(name)
    out = None
    for group, fragments in config.FEATURE_GROUPS:
        hit = reduce(lambda a, b: a | b, [low.contains(f) for f in fragments])
        out = F.when(hit, group) if out is None else out.when(hit, group)
    return out.otherwise("Other")


def defence_band(rating: Column) -> Column:
    r = or_default(rating, 110)
    return (
        F.when(r < 108, "Elite Defense").when(r < 112, "Good Defense")
        .when(r < 115, "Average Defense").otherwise("Weak Defense")
    )


def line_band(recent: Column, line: Column) -> Column:
    gap = F.coalesce(recent, F.lit(0.0)) - line
    return F.when(gap > 2, "LOW").when(gap < -2, "HIGH").otherwise("FAIR")


def probability_bin(p: Column, strict: bool = False) -> Column:
    """Bin 0..9 with edges at i * 0.1, lower edge inside. p = 1 goes to bin 9, or to none if strict."""
    raw = F.floor(p * 10.0)
    low = F.when(p < raw * 0.1, raw - 1).otherwise(raw)
    if strict:
        return F.when((p >= 0) & (p < 1.0), low.cast("int"))
    return F.least(low, F.lit(9)).cast("int")


def stable_order(seed: str, *keys: Column) -> Column:
    """Repeatable pseudo-random order: same rows, same seed, same draw on every run."""
    return F.md5(F.concat_ws("|", F.lit(seed), *[k.cast("string") for k in keys]))
