"""Canonical delivery schema, column aliases and fixed domain values.

FIXED VALUES — these must equal the reference's values for results to match:
canonical names and their aliases, the default phase bins, the dismissal kinds
that do not credit the bowler, and the role labels.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: canonical column -> accepted aliases (first present wins) ---
COLUMN_ALIASES: dict[str, list[str]] = {
    "match_id": ["match_id", "Match_Id", "matchid"],
    "season": ["season", "Season", "match_season"],
    "date": ["date", "match_date", "start_date"],
    "venue": ["venue", "stadium"],
    "city": ["city", "match_city"],
    "innings": ["innings", "inning"],
    "over": ["over", "overs"],
    "ball_in_over": ["ball_in_over", "ball_number", "ball", "ball_no"],
    "batter": ["batter", "striker", "batsman"],
    "non_striker": ["non_striker", "non-striker"],
    "bowler": ["bowler"],
    "batting_team": ["batting_team", "team_batting", "bat_team"],
    "bowling_team": ["bowling_team", "team_bowling", "bowl_team"],
    "runs_batter": ["runs_batter", "batsman_runs", "runs_off_bat", "runs_batsman", "batter_runs"],
    "runs_total": ["runs_total", "total_runs", "total"],
    "runs_extras": ["runs_extras", "extras", "extra_runs"],
    "extra_type": ["extra_type", "extras_type", "extra_kind"],
    "player_out": ["player_out", "dismissed_player", "player_dismissed"],
    "wicket_kind": ["wicket_kind", "dismissal_kind", "kind"],
    "fielder": ["fielder", "fielders_involved", "fielders"],
    "is_wicket": ["is_wicket", "wicket", "striker_out"],
    "win_team": ["win_team", "match_won_by", "winner", "winning_team", "match_winner"],
}

REQUIRED_COLUMNS = ["match_id", "batter", "bowler", "batting_team", "bowling_team"]

# --- fixed values: default phase bins (name, first over, last over), first match wins ---
DEFAULT_PHASE_BINS: list[tuple[str, int, int]] = [
    ("Powerplay", 1, 6),
    ("Middle", 7, 15),
    ("Death", 16, 20),
]
OTHER_PHASE = "Other"

# --- fixed values: dismissal kinds that do not credit the bowler (compared lower-case) ---
NON_BOWLER_DISMISSALS = ["run out", "retired hurt", "retired out", "obstructing the field"]

# --- fixed values: role labels ---
BATTING_ROLES = ["Power Hitter", "Anchor", "Accumulator", "Finisher"]
BOWLING_ROLES = ["Death Specialist", "Strike Bowler", "Powerplay Controller", "Middle Overs"]
ALLROUNDER = "Allrounder"
SPECIALIST = "Specialist"

# --- fixed values: metric groups ---
BATTING_METRICS = ["batting_strike_rate", "batting_average", "boundary_percentage", "dot_percentage"]
BOWLING_METRICS = ["bowling_economy", "bowling_strike_rate", "wickets_per_match", "phase_efficacy"]
METRIC_COLUMNS = BATTING_METRICS + BOWLING_METRICS
INDEX_COLUMNS = ["batting_index", "bowling_index", "overall_index"]
# Model features: the 8 metrics, the 3 indices and overs bowled (12 features).
MODEL_FEATURES = METRIC_COLUMNS + INDEX_COLUMNS + ["overs_bowled"]
# Raw counts the reference lists for the matrix but loses to merge suffixes.
OPTIONAL_RAW_FEATURES = ["runs_scored", "balls_faced", "wickets"]
BATTER_CLUSTER_FEATURES = ["batting_strike_rate", "batting_average", "boundary_percentage",
                           "dot_percentage", "batting_index"]
BOWLER_CLUSTER_FEATURES = ["bowling_economy", "bowling_strike_rate", "wickets_per_match",
                           "phase_efficacy", "bowling_index"]

PLAYER_MATCH_KEYS = ["match_id", "season", "team", "player"]

# Canonical raw delivery schema (what a clean source file holds).
DELIVERY_SCHEMA = T.StructType([
    T.StructField("match_id", T.LongType()),
    T.StructField("season", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("innings", T.IntegerType()),
    T.StructField("over", T.IntegerType()),
    T.StructField("ball_in_over", T.IntegerType()),
    T.StructField("batter", T.StringType()),
    T.StructField("non_striker", T.StringType()),
    T.StructField("bowler", T.StringType()),
    T.StructField("batting_team", T.StringType()),
    T.StructField("bowling_team", T.StringType()),
    T.StructField("runs_batter", T.IntegerType()),
    T.StructField("runs_extras", T.IntegerType()),
    T.StructField("runs_total", T.IntegerType()),
    T.StructField("extra_type", T.StringType()),
    T.StructField("player_out", T.StringType()),
    T.StructField("wicket_kind", T.StringType()),
    T.StructField("fielder", T.StringType()),
    T.StructField("is_wicket", T.StringType()),
    T.StructField("win_team", T.StringType()),
    T.StructField("valid_ball", T.IntegerType()),
])
