"""Constants of the domain. Values that results depend on are fixed; the rest are parameters."""

from __future__ import annotations

# Season bounds, regular-season bounds and training bounds
# (an open end means "up to yesterday").
SEASON_RANGES = {
    "2024-25": ("2024-10-22", "2025-06-22"),
    "2025-26": ("2025-10-28", "2026-06-21"),
}
REGULAR_SEASON_RANGES = {
    "2024-25": ("2024-10-22", "2025-04-13"),
    "2025-26": ("2025-11-13", "2026-04-12"),
}
TRAINING_RANGES = {
    "2024-25": ("2024-11-10", "2025-04-13"),
    "2025-26": ("2025-11-13", None),
}

# Market names and the outcome column that settles each prop type.
PROP_TYPES = ["PTS", "REB", "AST", "3PM"]
PROP_ALIASES = {"POINTS": "PTS", "REBOUNDS": "REB", "ASSISTS": "AST", "THREES": "3PM"}
PROP_TO_ACTUAL = {
    "PTS": "points",
    "REB": "reboundsTotal",
    "AST": "assists",
    "3PM": "threePointersMade",
}

# Team name to code, two spellings for one team.
TEAM_CODES = {
    "Atlanta Hawks": "ATL",
    "Boston Celtics": "BOS",
    "Brooklyn Nets": "BKN",
    "Charlotte Hornets": "CHA",
    "Chicago Bulls": "CHI",
    "Cleveland Cavaliers": "CLE",
    "Dallas Mavericks": "DAL",
    "Denver Nuggets": "DEN",
    "Detroit Pistons": "DET",
    "Golden State Warriors": "GSW",
    "Houston Rockets": "HOU",
    "Indiana Pacers": "IND",
    "LA Clippers": "LAC",
    "Los Angeles Clippers": "LAC",
    "Los Angeles Lakers": "LAL",
    "Memphis Grizzlies": "MEM",
    "Miami Heat": "MIA",
    "Milwaukee Bucks": "MIL",
    "Minnesota Timberwolves": "MIN",
    "New Orleans Pelicans": "NOP",
    "New York Knicks": "NYK",
    "Oklahoma City Thunder": "OKC",
    "Orlando Magic": "ORL",
    "Philadelphia 76ers": "PHI",
    "Phoenix Suns": "PHX",
    "Portland Trail Blazers": "POR",
    "Sacramento Kings": "SAC",
    "San Antonio Spurs": "SAS",
    "Toronto Raptors": "TOR",
    "Utah Jazz": "UTA",
    "Washington Wizards": "WAS",
}

# Thresholds of tiers, reliability tags and their ordinal scales.
TIER_DEFAULTS = {"p80_pts": 15.0, "p80_min": 30.0, "p60_min": 25.0, "p40_min": 20.0}
SPREAD_DEFAULTS = {"PTS": 5.0, "REB": 2.5, "AST": 2.0, "3PM": 1.0}
TIER_SCALE = {"STAR": 3, "STARTER": 2, "ROTATION": 1, "BENCH": 0}
RELIABILITY_SCALE = {"SNIPER": 2, "STANDARD": 1, "VOLATILE": 0}

# Name fragments of each feature group, first match wins.
FEATURE_GROUPS = [
    ("Player Recent Form", ["l5_avg", "l10_avg", "season_avg", "l5_stddev", "l10_stddev"]),
    ("Opponent Defense", ["opp_l5", "opp_l10", "opp_season", "opp_rank", "rank_allows"]),
    ("Pace & Efficiency", ["pace", "def_rating", "off_rating"]),
    ("Rest & Schedule", ["rest_days", "is_b2b", "b2b"]),
    ("Home/Away", ["home", "away", "venue"]),
    ("Market/Odds", ["line", "odds", "ev", "kelly", "z_score", "edge", "quality", "implied"]),
    ("Player Classification", ["tier", "reliability", "cv"]),
    ("Advanced Stats", ["usg", "pie", "ts_", "efg", "per_100"]),
]

# Columns that never reach a model-facing table.
NOISE_COLUMNS = [
    "gameSubLabel", "gameLabel", "gameType", "seriesGameNumber",
    "playerteamCity", "playerteamName", "opponentteamCity", "opponentteamName",
    "HomeTeamAbbrev", "AwayTeamAbbrev", "Prop_Type", "_player_key",
]
OUTCOME_COLUMNS = [
    "win", "numMinutes", "points", "assists", "blocks", "steals",
    "reboundsTotal", "reboundsDefensive", "reboundsOffensive",
    "fieldGoalsAttempted", "fieldGoalsMade", "fieldGoalsPercentage",
    "threePointersAttempted", "threePointersMade", "threePointersPercentage",
    "freeThrowsAttempted", "freeThrowsMade", "freeThrowsPercentage",
    "foulsPersonal", "turnovers", "plusMinusPoints",
]


def stat_columns(prefix: str, stats: list[str], suffix: str = "") -> list[str]:
    return [f"{prefix}{s}{suffix}" for s in stats]


def model_features(prop: str) -> list[str]:
    """Names of the features offered to the model of one prop type."""
    return [
        "home", "is_b2b", "rest_days", "Player_Tier_encoded", "Reliability_Tag_encoded",
        "L5_Avg_MIN", "L10_Avg_MIN", "Season_Avg_MIN", "Opp_is_b2b", "Opp_rest_days",
        *[f"{w}_Avg_{prop}" for w in ("L5", "L10", "Season")],
        f"L5_Avg_{prop}_SameVenue", f"Season_Avg_{prop}_SameVenue", f"Form_{prop}",
        f"L5_StdDev_{prop}", f"L10_StdDev_{prop}", f"Player_{prop}_per100",
        "Player_TS_Pct", "Player_eFG_Pct", "Player_3PA_Rate", "Player_FT_Rate",
        *[f"Opp_{w}_Allowed_{prop}" for w in ("L5", "L10", "Season")],
        *[f"Opp_{w}_Team_Pace" for w in ("L5", "L10")],
        "Line",
    ]
