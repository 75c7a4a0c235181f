"""DuckDB-runnable SQL equivalents of the registered queries (the oracle).

Each statement starts from the raw ``lineitem`` view through the portable
fixture CTEs, so it checks the whole Spark path, aliases included.
"""

from __future__ import annotations

from crease.plans.fixtures import delivery_sql
from crease.schema import BATTER_CLUSTER_FEATURES as BAT_F
from crease.schema import BOWLER_CLUSTER_FEATURES as BOWL_F
from crease.schema import METRIC_COLUMNS
from crease.schema import MODEL_FEATURES as MM_FEATURES

BASE = delivery_sql()

KEYS_NN = "match_id IS NOT NULL AND season IS NOT NULL AND {t} IS NOT NULL AND {p} IS NOT NULL"

# Player-match statistics as plain SQL: batting and bowling aggregates, a full
# outer join, the bowler phase summary, league rates, efficacy and the winner.
PM = BASE + """,
bat AS (
 SELECT match_id, season, batting_team AS team, batter AS player,
  SUM(runs_batter) AS runs_scored, CAST(SUM(valid_ball) AS BIGINT) AS balls_faced,
  CAST(SUM(CASE WHEN is_four THEN 1 ELSE 0 END) AS BIGINT) AS fours,
  CAST(SUM(CASE WHEN is_six THEN 1 ELSE 0 END) AS BIGINT) AS sixes,
  CAST(SUM(CASE WHEN is_boundary THEN 1 ELSE 0 END) AS BIGINT) AS boundaries,
  CAST(SUM(CASE WHEN is_dot_ball AND valid_ball <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS dot_balls,
  CAST(SUM(CASE WHEN batter_dismissed THEN 1 ELSE 0 END) AS BIGINT) AS dismissals
 FROM deliveries WHERE """ + KEYS_NN.format(t="batting_team", p="batter") + """
 GROUP BY match_id, season, batting_team, batter),
bowl AS (
 SELECT match_id, season, bowling_team AS team, bowler AS player,
  SUM(runs_total) AS runs_conceded, CAST(SUM(valid_ball) AS BIGINT) AS balls_bowled,
  CAST(SUM(CASE WHEN is_bowler_wicket THEN 1 ELSE 0 END) AS BIGINT) AS wickets,
  CAST(SUM(CASE WHEN is_dot_ball AND valid_ball <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS dot_balls_bowling
 FROM deliveries WHERE """ + KEYS_NN.format(t="bowling_team", p="bowler") + """
 GROUP BY match_id, season, bowling_team, bowler),
bps AS (
 SELECT bowler, phase, SUM(runs_total) AS phase_runs, CAST(SUM(valid_ball) AS BIGINT) AS phase_balls
 FROM deliveries WHERE bowler IS NOT NULL AND phase IS NOT NULL GROUP BY bowler, phase),
league AS (
 SELECT phase, AVG(CASE WHEN phase_balls = 0 THEN 0E0 ELSE phase_runs * 6 / phase_balls END) AS league_run_rate
 FROM bps GROUP BY phase),
bowl_phase AS (
 SELECT match_id, season, bowling_team AS team, bowler AS player, phase,
  SUM(runs_total) AS r, SUM(valid_ball) AS b
 FROM deliveries WHERE """ + KEYS_NN.format(t="bowling_team", p="bowler") + """
 GROUP BY match_id, season, bowling_team, bowler, phase),
bat_phase AS (
 SELECT match_id, season, batting_team AS team, batter AS player, phase, SUM(runs_total) AS r
 FROM deliveries WHERE """ + KEYS_NN.format(t="batting_team", p="batter") + """
 GROUP BY match_id, season, batting_team, batter, phase),
eff AS (
 SELECT match_id, season, team, player,
  SUM(CASE WHEN b <> 0 THEN COALESCE(league_run_rate, 0E0) * b - r * 6 END) AS num,
  SUM(CASE WHEN b <> 0 THEN b END) AS den
 FROM bowl_phase LEFT JOIN league USING (phase) GROUP BY match_id, season, team, player),
winners AS (
 SELECT match_id, MAX(win_team) AS winning_team FROM deliveries WHERE match_id IS NOT NULL GROUP BY match_id),
pm0 AS (
 SELECT COALESCE(bat.match_id, bowl.match_id) AS match_id, COALESCE(bat.season, bowl.season) AS season,
  COALESCE(bat.team, bowl.team) AS team, COALESCE(bat.player, bowl.player) AS player,
  runs_scored, balls_faced, fours, sixes, boundaries, dot_balls, dismissals,
  runs_conceded, balls_bowled, wickets, dot_balls_bowling,
  CASE WHEN bat.player IS NOT NULL AND bowl.player IS NOT NULL THEN 'both'
       WHEN bat.player IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS _merge
 FROM bat FULL OUTER JOIN bowl
  ON bat.match_id = bowl.match_id AND bat.season = bowl.season AND bat.team = bowl.team AND bat.player = bowl.player),
pm AS (
 SELECT pm0.*, CASE WHEN eff.den IS NULL OR eff.den = 0 THEN 0E0 ELSE eff.num / eff.den END AS phase_efficacy,
  w.winning_team, CAST(COALESCE(pm0.team = w.winning_team, FALSE) AS INT) AS team_won
 FROM pm0 LEFT JOIN eff USING (match_id, season, team, player) LEFT JOIN winners w USING (match_id)),
feat AS (
 SELECT match_id, season, team, player, winning_team, team_won, _merge,
  COALESCE(runs_scored, 0E0) AS runs_scored, COALESCE(balls_faced, 0) AS balls_faced,
  COALESCE(dismissals, 0) AS dismissals, COALESCE(boundaries, 0) AS boundaries, COALESCE(dot_balls, 0) AS dot_balls,
  COALESCE(runs_conceded, 0E0) AS runs_conceded, COALESCE(balls_bowled, 0) AS balls_bowled,
  COALESCE(wickets, 0) AS wickets, phase_efficacy,
  CASE WHEN COALESCE(balls_faced, 0) = 0 THEN 0E0 ELSE COALESCE(runs_scored, 0E0) * 100 / balls_faced END AS batting_strike_rate,
  CASE WHEN COALESCE(dismissals, 0) = 0 THEN 0E0 ELSE COALESCE(runs_scored, 0E0) / dismissals END AS batting_average,
  CASE WHEN COALESCE(balls_faced, 0) = 0 THEN 0E0 ELSE CAST(boundaries AS DOUBLE) * 100 / balls_faced END AS boundary_percentage,
  CASE WHEN COALESCE(balls_faced, 0) = 0 THEN 0E0 ELSE CAST(dot_balls AS DOUBLE) * 100 / balls_faced END AS dot_percentage,
  COALESCE(balls_bowled, 0) / 6E0 AS overs_bowled,
  CASE WHEN COALESCE(balls_bowled, 0) = 0 THEN 0E0 ELSE COALESCE(runs_conceded, 0E0) / (balls_bowled / 6E0) END AS bowling_economy,
  CASE WHEN COALESCE(wickets, 0) = 0 THEN 0E0 ELSE CAST(COALESCE(balls_bowled, 0) AS DOUBLE) / wickets END AS bowling_strike_rate,
  CAST(COALESCE(wickets, 0) AS DOUBLE) AS wickets_per_match
 FROM pm)"""

# Correlation weights, indices and the 12-feature model matrix on top of PM.
IDX = PM + """,
corrs AS (
 SELECT
""" + ",\n".join(
    f"  CASE WHEN stddev_pop({m}) = 0 OR stddev_pop(CAST(team_won AS DOUBLE)) = 0 OR corr({m}, CAST(team_won AS DOUBLE)) IS NULL "
    f"OR isnan(corr({m}, CAST(team_won AS DOUBLE))) THEN 0E0 ELSE abs(corr({m}, CAST(team_won AS DOUBLE))) END AS w{i}"
    for i, m in enumerate(METRIC_COLUMNS)) + """
 FROM feat),
wts AS (
 SELECT CASE WHEN s = 0 THEN 0.125E0 ELSE w0 / s END AS w0, CASE WHEN s = 0 THEN 0.125E0 ELSE w1 / s END AS w1,
  CASE WHEN s = 0 THEN 0.125E0 ELSE w2 / s END AS w2, CASE WHEN s = 0 THEN 0.125E0 ELSE w3 / s END AS w3,
  CASE WHEN s = 0 THEN 0.125E0 ELSE w4 / s END AS w4, CASE WHEN s = 0 THEN 0.125E0 ELSE w5 / s END AS w5,
  CASE WHEN s = 0 THEN 0.125E0 ELSE w6 / s END AS w6, CASE WHEN s = 0 THEN 0.125E0 ELSE w7 / s END AS w7
 FROM (SELECT *, w0 + w1 + w2 + w3 + w4 + w5 + w6 + w7 AS s FROM corrs) z),
idx AS (
 SELECT feat.*,
  batting_strike_rate * w0 + batting_average * w1 + boundary_percentage * w2 + dot_percentage * w3 AS batting_index,
  bowling_economy * w4 + bowling_strike_rate * w5 + wickets_per_match * w6 + phase_efficacy * w7 AS bowling_index
 FROM feat CROSS JOIN wts),
mm AS (
 SELECT match_id, player, team, season, team_won, batting_strike_rate, batting_average, boundary_percentage,
  dot_percentage, bowling_economy, bowling_strike_rate, wickets_per_match, phase_efficacy,
  batting_index, bowling_index, batting_index + bowling_index AS overall_index, overs_bowled,
  runs_scored, CAST(balls_faced AS DOUBLE) AS balls_faced_d, CAST(balls_bowled AS DOUBLE) AS balls_bowled_d
 FROM idx)"""


def r(expr: str, digits: int = 6, alias: str | None = None) -> str:
    return f"ROUND(CAST({expr} AS DOUBLE), {digits}) AS {alias or expr}"


SQL: dict[str, str] = {}

SQL["scan_deliveries"] = BASE + """
SELECT match_id, season, match_date, venue, innings, over, ball_in_over, striker, non_striker, bowler,
 batting_team, bowling_team, batsman_runs, extras, total_runs, valid_ball, player_dismissed, dismissal_kind, winner
FROM raw_deliveries"""

SQL["canonicalise_columns"] = BASE + """
SELECT match_id, season, match_date AS date, venue, innings, over, ball_in_over, striker AS batter, non_striker,
 bowler, batting_team, bowling_team, batsman_runs AS runs_batter, extras AS runs_extras, total_runs AS runs_total,
 valid_ball, player_dismissed AS player_out, dismissal_kind AS wicket_kind, winner AS win_team
FROM raw_deliveries"""

# five of six matches carry a date in one format or another, the sixth none
SQL["parse_date"] = BASE + """
SELECT match_id, innings, over, ball_in_over, CASE WHEN match_id % 6 <> 5 THEN date END AS date FROM deliveries"""

# runs that are no number (NaN, a word, nothing) count as 0
SQL["numeric_coerce"] = BASE + """
SELECT match_id, innings, over, ball_in_over,
 CASE WHEN (over + ball_in_over) % 7 IN (0, 1, 3) THEN 0E0 ELSE runs_batter END AS runs_batter,
 CASE WHEN over % 4 = 1 THEN 0E0 ELSE runs_total END AS runs_total FROM deliveries"""

SQL["derive_over_ball"] = BASE + """
SELECT match_id, innings, CAST(over AS INT) AS over, CAST(ball_in_over AS INT) AS ball_in_over FROM raw_deliveries"""

SQL["assign_phase"] = BASE + "\nSELECT match_id, innings, over, ball_in_over, phase FROM deliveries"

SQL["valid_ball_flag"] = BASE + """
SELECT match_id, innings, over, ball_in_over, CASE WHEN ball_in_over % 3 = 2 THEN valid_ball ELSE 0 END AS valid_ball
FROM deliveries"""

SQL["dot_ball_flag"] = BASE + "\nSELECT match_id, innings, over, ball_in_over, is_dot_ball FROM deliveries"

SQL["wicket_flag"] = BASE + "\nSELECT match_id, innings, over, ball_in_over, is_wicket FROM deliveries"

SQL["boundary_flags"] = BASE + \
    "\nSELECT match_id, innings, over, ball_in_over, is_boundary, is_four, is_six FROM deliveries"

SQL["batter_dismissed"] = BASE + "\nSELECT match_id, innings, batter, player_out, batter_dismissed FROM deliveries"

SQL["bowler_wicket"] = BASE + \
    "\nSELECT match_id, innings, bowler, wicket_kind, is_bowler_wicket FROM deliveries"

SQL["dq_checks"] = BASE + """
SELECT COUNT(*) AS n_rows,
 COUNT_IF(match_id IS NULL) AS missing_match_id, COUNT_IF(batter IS NULL) AS missing_batter,
 COUNT_IF(bowler IS NULL) AS missing_bowler, COUNT_IF(runs_total < 0) AS negative_runs,
 COUNT_IF(valid_ball < 0) AS negative_balls,
 COUNT_IF(runs_total <> runs_batter + COALESCE(runs_extras, 0)) AS total_mismatch
FROM deliveries"""

SQL["batting_player_match"] = PM + """
SELECT match_id, season, team, player, runs_scored, balls_faced, fours, sixes, boundaries, dot_balls, dismissals
FROM bat"""

SQL["bowling_player_match"] = PM + """
SELECT match_id, season, team, player, runs_conceded, balls_bowled, wickets, dot_balls_bowling FROM bowl"""

SQL["phase_map_agg"] = PM + """
SELECT match_id, season, team, player, 'bowl_runs' AS kind, phase, CAST(r AS DOUBLE) AS value FROM bowl_phase
UNION ALL
SELECT match_id, season, team, player, 'bowl_balls' AS kind, phase, CAST(b AS DOUBLE) AS value FROM bowl_phase
UNION ALL
SELECT match_id, season, team, player, 'bat_runs' AS kind, phase, CAST(r AS DOUBLE) AS value FROM bat_phase"""

SQL["bowler_phase_stats"] = PM + "\nSELECT bowler, phase, phase_runs, phase_balls FROM bps"

SQL["league_phase_rate"] = PM + "\nSELECT phase, " + r("league_run_rate", 6) + " FROM league"

SQL["phase_efficacy"] = PM + "\nSELECT match_id, season, team, player, " + r("phase_efficacy", 5) + " FROM pm"

SQL["player_match_outer"] = PM + """
SELECT match_id, season, team, player, _merge, balls_faced, balls_bowled FROM pm"""

SQL["match_result"] = PM + "\nSELECT match_id, season, team, player, winning_team, team_won FROM pm"

SQL["batting_metrics"] = PM + "\nSELECT match_id, season, team, player, " + ", ".join(
    r(c) for c in ["batting_strike_rate", "batting_average", "boundary_percentage", "dot_percentage"]) + \
    ", runs_scored AS batting_contribution FROM feat"

SQL["bowling_metrics"] = PM + "\nSELECT match_id, season, team, player, " + ", ".join(
    r(c) for c in ["overs_bowled", "bowling_economy", "bowling_strike_rate", "wickets_per_match"]) + " FROM feat"

SQL["correlation_weights"] = IDX + "\nSELECT metric, ROUND(weight, 6) AS weight FROM (" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, w{i} AS weight FROM wts" for i, m in enumerate(METRIC_COLUMNS)) + ") z"

SQL["composite_indices"] = IDX + "\nSELECT match_id, season, team, player, " + ", ".join(
    [r("batting_index", 4), r("bowling_index", 4), r("batting_index + bowling_index", 4, "overall_index")]) + \
    " FROM idx"

SQL["model_matrix"] = IDX + "\nSELECT match_id, player, team, season, team_won, " + ", ".join(
    r(c, 4) for c in MM_FEATURES) + " FROM mm"

SQL["feature_merge"] = PM + """
SELECT match_id, season, team, player, team_won, winning_team,
 balls_faced AS balls_faced_bat, balls_faced AS balls_faced_bowl, """ + ", ".join(
    r(c) for c in ["batting_strike_rate", "bowling_economy"]) + " FROM feat"

# Ratings with uniform weights over the 12 model features (no importances given).
RATINGS = IDX + """,
iscored AS (
 SELECT mm.*, (""" + " + ".join(MM_FEATURES) + """) / 12E0 AS impact_score FROM mm),
rat0 AS (
 SELECT player, team, season, AVG(impact_score) AS impact_score, AVG(batting_index) AS batting_index,
  AVG(bowling_index) AS bowling_index FROM iscored GROUP BY player, team, season),
ratings AS (
 SELECT rat0.*, CASE WHEN mx - mn > 0 THEN 100 * (impact_score - mn) / (mx - mn) ELSE 50E0 END AS impact_rating
 FROM rat0 CROSS JOIN (SELECT MIN(impact_score) AS mn, MAX(impact_score) AS mx FROM rat0) b),
volume AS (
 SELECT player, team, season, CAST(SUM(balls_faced) AS DOUBLE) AS balls_faced,
  CAST(SUM(balls_bowled) AS DOUBLE) AS balls_bowled FROM feat GROUP BY player, team, season)"""

SQL["impact_score"] = RATINGS + "\nSELECT match_id, player, team, season, " + r("impact_score", 4) + " FROM iscored"

SQL["player_ratings"] = RATINGS + "\nSELECT player, team, season, " + ", ".join(
    [r("impact_score", 4), r("batting_index", 4), r("bowling_index", 4), r("impact_rating", 4)]) + " FROM ratings"

SQL["player_volume"] = RATINGS + "\nSELECT player, team, season, balls_faced, balls_bowled FROM volume"

SQL["volume_outer"] = RATINGS + "\nSELECT player, team, season, balls_faced, balls_bowled FROM volume"

SQL["top_ratings"] = RATINGS + "\nSELECT player, team, season, " + r("impact_rating", 4) + \
    " FROM ratings ORDER BY impact_rating DESC, player, team, season LIMIT 25"

SQL["attach_index"] = IDX + "\nSELECT match_id, season, team, player, balls_faced, " + \
    r("batting_strike_rate") + ", " + r("batting_index", 4) + " FROM idx WHERE _merge <> 'right_only'"

SQL["impact_tier"] = RATINGS + """
SELECT player, team, season,
 CASE WHEN impact_rating >= 90 THEN 'Elite performer' WHEN impact_rating >= 75 THEN 'Strong performer'
      WHEN impact_rating >= 60 THEN 'Above average' WHEN impact_rating >= 40 THEN 'Average'
      ELSE 'Below average' END AS impact_tier,
 CASE WHEN impact_rating >= 90 THEN 'Must select' WHEN impact_rating >= 75 THEN 'High priority'
      WHEN impact_rating >= 60 THEN 'Consider for balance' WHEN impact_rating >= 40 THEN 'Situational'
      ELSE 'Avoid unless specialized role' END AS selection_priority
FROM ratings"""

SQL["safe_divide"] = PM + """
SELECT match_id, season, team, player,
 CASE WHEN balls_bowled IS NULL OR balls_bowled = 0 THEN 0E0 ELSE CAST(wickets AS DOUBLE) / balls_bowled END AS wickets_per_ball
FROM pm"""

SCORED = PM + """,
match_info AS (
 SELECT match_id, MAX(venue) AS venue, MAX(date) AS date,
  LEAST(MIN(batting_team), MIN(bowling_team)) AS team_a, GREATEST(MAX(batting_team), MAX(bowling_team)) AS team_b
 FROM deliveries WHERE match_id IS NOT NULL GROUP BY match_id),
scored0 AS (
 SELECT f.match_id, f.season, f.team, f.player, mi.venue, mi.date,
  CASE WHEN f.team = mi.team_a THEN mi.team_b ELSE mi.team_a END AS opponent,
  CAST(f.team_won AS INT) AS y_true,
  ROUND(1E0 / (1E0 + exp(-(0.04E0 * (f.runs_scored - 7) + 0.3E0 * f.wickets + 0.02E0 * ROUND(f.phase_efficacy, 4)))), 9)
   AS y_pred_proba,
  CAST(ROW_NUMBER() OVER (ORDER BY f.match_id, f.team, f.player) AS BIGINT) AS rid
 FROM feat f JOIN match_info mi USING (match_id)),
scored AS (SELECT *, CASE WHEN y_pred_proba >= 0.5 THEN 1 ELSE 0 END AS y_pred FROM scored0)"""


def sql_auc_cte(name: str, src: str, part: list[str], y: str = "y_true", p: str = "y_pred_proba",
                w: str = "1") -> str:
    """CTE ``name`` with (part..., roc_auc, pr_auc) over ``src`` (optional weight column ``w``)."""
    pc = ", ".join(part)
    pre = (pc + ", ") if part else ""
    win = f"PARTITION BY {pc} " if part else ""
    grp = f"GROUP BY {pc}" if part else ""
    return f""",
{name}_g AS (SELECT {pre}CAST({p} AS DOUBLE) AS score, SUM({w} * CAST({y} AS DOUBLE)) AS pos,
  SUM({w} * (1E0 - {y})) AS neg FROM {src} GROUP BY {pre}score),
{name}_c AS (SELECT *, COALESCE(SUM(neg) OVER ({win}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0E0) AS cneg,
  SUM(pos) OVER ({win}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dpos,
  SUM(neg) OVER ({win}ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dneg
 FROM {name}_g),
{name} AS (SELECT {pre}CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN SUM(pos * (cneg + 0.5E0 * neg)) / (SUM(pos) * SUM(neg)) END AS roc_auc,
  CASE WHEN SUM(pos) > 0 AND SUM(neg) > 0 THEN SUM(CASE WHEN pos > 0 THEN pos * dpos / (dpos + dneg) ELSE 0E0 END) / SUM(pos) END AS pr_auc
 FROM {name}_c {grp})"""


def sql_point(src: str, part: list[str]) -> str:
    pre = (", ".join(part) + ", ") if part else ""
    grp = ("GROUP BY " + ", ".join(part)) if part else ""
    return f"""SELECT {pre}COUNT(*) AS n, SUM(CAST(y_true AS DOUBLE)) AS pos,
  SUM(CASE WHEN y_true = y_pred THEN 1E0 ELSE 0E0 END) AS correct,
  SUM(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1E0 ELSE 0E0 END) AS tp,
  SUM(CASE WHEN y_true = 0 AND y_pred = 1 THEN 1E0 ELSE 0E0 END) AS fp,
  SUM(CASE WHEN y_true = 1 AND y_pred = 0 THEN 1E0 ELSE 0E0 END) AS fn,
  SUM((y_pred_proba - y_true) * (y_pred_proba - y_true)) AS sq,
  SUM(-(y_true * ln(LEAST(GREATEST(y_pred_proba, 2.220446049250313E-16), 1 - 2.220446049250313E-16))
       + (1 - y_true) * ln(1 - LEAST(GREATEST(y_pred_proba, 2.220446049250313E-16), 1 - 2.220446049250313E-16)))) AS ll,
  SUM(abs(y_true - y_pred_proba)) AS ae
 FROM {src} {grp}"""


EVAL = SCORED + ",\npt AS (" + sql_point("scored", []) + ")" + sql_auc_cte("auc", "scored", [])

SQL["metric_accuracy"] = EVAL + "\nSELECT ROUND(correct / n, 6) AS accuracy FROM pt"
SQL["metric_f1"] = EVAL + "\nSELECT ROUND(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0E0 END, 6) AS f1 FROM pt"
SQL["metric_brier"] = EVAL + "\nSELECT ROUND(sq / n, 6) AS brier_score FROM pt"
SQL["metric_log_loss"] = EVAL + "\nSELECT ROUND(CASE WHEN pos > 0 AND pos < n THEN ll / n END, 6) AS log_loss FROM pt"
SQL["metric_mae"] = EVAL + "\nSELECT ROUND(ae / n, 6) AS mae FROM pt"
SQL["metric_roc_auc"] = EVAL + "\nSELECT ROUND(roc_auc, 6) AS roc_auc FROM auc"
SQL["metric_pr_auc"] = EVAL + "\nSELECT ROUND(pr_auc, 6) AS pr_auc FROM auc"

SQL["roc_points"] = EVAL + """
SELECT ROUND(score, 6) AS threshold, ROUND(dneg / SUM(neg) OVER (), 6) AS fpr, ROUND(dpos / SUM(pos) OVER (), 6) AS tpr
FROM auc_c"""
SQL["pr_points"] = EVAL + """
SELECT ROUND(score, 6) AS threshold, ROUND(dpos / (dpos + dneg), 6) AS precision, ROUND(dpos / SUM(pos) OVER (), 6) AS recall
FROM auc_c"""

SQL["classification_report"] = SCORED + """,
cr_c AS (SELECT SUM(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1 ELSE 0 END) AS tp0,
  SUM(CASE WHEN y_pred = 0 THEN 1 ELSE 0 END) AS pred0, SUM(CASE WHEN y_true = 0 THEN 1 ELSE 0 END) AS sup0,
  SUM(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1 ELSE 0 END) AS tp1,
  SUM(CASE WHEN y_pred = 1 THEN 1 ELSE 0 END) AS pred1, SUM(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS sup1,
  COUNT(*) AS n FROM scored),
cr_m AS (SELECT *, CASE WHEN pred0 > 0 THEN tp0 / pred0 ELSE 0E0 END AS p0, CASE WHEN sup0 > 0 THEN tp0 / sup0 ELSE 0E0 END AS r0,
  CASE WHEN pred1 > 0 THEN tp1 / pred1 ELSE 0E0 END AS p1, CASE WHEN sup1 > 0 THEN tp1 / sup1 ELSE 0E0 END AS r1 FROM cr_c),
cr_f AS (SELECT *, CASE WHEN p0 + r0 > 0 THEN 2 * p0 * r0 / (p0 + r0) ELSE 0E0 END AS f0,
  CASE WHEN p1 + r1 > 0 THEN 2 * p1 * r1 / (p1 + r1) ELSE 0E0 END AS f1 FROM cr_m)
SELECT '0' AS label, ROUND(p0, 6) AS precision, ROUND(r0, 6) AS recall, ROUND(f0, 6) AS f1, CAST(sup0 AS BIGINT) AS support FROM cr_f
UNION ALL SELECT '1', ROUND(p1, 6), ROUND(r1, 6), ROUND(f1, 6), CAST(sup1 AS BIGINT) FROM cr_f
UNION ALL SELECT 'accuracy', NULL, NULL, ROUND((tp0 + tp1) / n, 6), CAST(n AS BIGINT) FROM cr_f
UNION ALL SELECT 'macro avg', ROUND((p0 + p1) / 2, 6), ROUND((r0 + r1) / 2, 6), ROUND((f0 + f1) / 2, 6), CAST(n AS BIGINT) FROM cr_f
UNION ALL SELECT 'weighted avg', ROUND((p0 * sup0 + p1 * sup1) / n, 6), ROUND((r0 * sup0 + r1 * sup1) / n, 6),
  ROUND((f0 * sup0 + f1 * sup1) / n, 6), CAST(n AS BIGINT) FROM cr_f"""

SQL["classify_threshold"] = SCORED + "\nSELECT rid, y_pred_proba, y_pred FROM scored"
SQL["matchup_key"] = SCORED + \
    "\nSELECT rid, concat(LEAST(team, opponent), ' vs ', GREATEST(team, opponent)) AS matchup FROM scored"
SQL["season_int"] = BASE + """
SELECT DISTINCT match_id, CASE WHEN match_id % 5 <> 4 THEN CAST(season AS INT) END AS season FROM deliveries"""

_EDGES = [i * (1.0 / 10) for i in range(1, 10)]
_UBIN = " + ".join(f"CASE WHEN y_pred_proba > {e!r}E0 THEN 1 ELSE 0 END".replace("E0E0", "E0") for e in _EDGES)
_QBIN = " + ".join(f"CASE WHEN y_pred_proba > e{i} THEN 1 ELSE 0 END" for i in range(1, 10))
_QEDGES = ", ".join(f"quantile_cont(y_pred_proba, {i / 10!r}) AS e{i}" for i in range(1, 10))

SQL["calibration_curve"] = SCORED + f""",
ub AS (SELECT 'uniform' AS strategy, ({_UBIN}) AS bin, y_true, y_pred_proba FROM scored),
qe AS (SELECT {_QEDGES} FROM scored),
qb AS (SELECT 'quantile' AS strategy, ({_QBIN}) AS bin, y_true, y_pred_proba FROM scored CROSS JOIN qe),
allb AS (SELECT * FROM ub UNION ALL SELECT * FROM qb)
SELECT strategy, bin, CAST(COUNT(*) AS BIGINT) AS n, ROUND(AVG(CAST(y_true AS DOUBLE)), 6) AS fraction_of_positives,
 ROUND(AVG(y_pred_proba), 6) AS mean_predicted_value FROM allb GROUP BY strategy, bin"""

SQL["expected_calibration_error"] = SCORED + f""",
ub AS (SELECT ({_UBIN}) AS bin, y_true, y_pred_proba FROM scored),
bb AS (SELECT bin, COUNT(*) AS n, AVG(CAST(y_true AS DOUBLE)) AS fp, AVG(y_pred_proba) AS mp FROM ub GROUP BY bin)
SELECT ROUND(SUM(n * abs(fp - mp)) / SUM(n), 6) AS ece FROM bb"""

SQL["probability_histogram"] = SCORED + """,
hb AS (SELECT MIN(y_pred_proba) AS lo, (MAX(y_pred_proba) - MIN(y_pred_proba)) / 10E0 AS w, COUNT(*) AS n FROM scored),
hc AS (SELECT LEAST(9, CAST(FLOOR((y_pred_proba - lo) / w) AS INT)) AS bin, COUNT(*) AS c FROM scored CROSS JOIN hb
 GROUP BY 1)
SELECT CAST(b.range AS INT) AS bin, ROUND(lo + b.range * w, 6) AS bin_start, CAST(COALESCE(c, 0) AS BIGINT) AS count,
 ROUND(COALESCE(c, 0) / (n * w), 6) AS density
FROM range(10) b CROSS JOIN hb LEFT JOIN hc ON hc.bin = b.range"""


def sql_slices(slice_expr: str, slice_name: str, min_samples: int) -> str:
    src = f"sl_src"
    return SCORED + f""",
{src} AS (SELECT *, {slice_expr} AS {slice_name} FROM scored WHERE {slice_expr} IS NOT NULL),
spt AS ({sql_point(src, [slice_name])})""" + sql_auc_cte("sauc", src, [slice_name]) + f"""
SELECT spt.{slice_name}, CAST(n AS BIGINT) AS n_samples, ROUND(correct / n, 6) AS accuracy, ROUND(roc_auc, 6) AS roc_auc,
 ROUND(CASE WHEN pos > 0 AND pos < n THEN ll / n END, 6) AS log_loss, ROUND(pos / n, 6) AS positive_rate
FROM spt LEFT JOIN sauc USING ({slice_name}) WHERE n >= {min_samples}"""


SQL["slice_metrics"] = sql_slices("team", "team", 10)
SQL["slice_by_season"] = sql_slices("season", "season", 5)
SQL["slice_by_venue"] = sql_slices("venue", "venue", 10)
SQL["slice_by_matchup"] = sql_slices("concat(LEAST(team, opponent), ' vs ', GREATEST(team, opponent))", "matchup", 5)

_SEASON_SLICES = sql_slices("season", "season", 5)
_DRIFT_BASE = _SEASON_SLICES.replace("\nSELECT spt.season,", ",\nsm AS (SELECT spt.season,") + ")"
SQL["drift_first_last"] = _DRIFT_BASE + """,
lg AS (SELECT season, 'accuracy' AS metric, accuracy AS value FROM sm UNION ALL
 SELECT season, 'roc_auc', roc_auc FROM sm UNION ALL SELECT season, 'log_loss', log_loss FROM sm),
lv AS (SELECT * FROM lg WHERE value IS NOT NULL AND NOT isnan(value)),
ag AS (SELECT metric, MIN(season) AS first_season, MAX(season) AS last_season, arg_min(value, season) AS first_value,
  arg_max(value, season) AS last_value, AVG(value) AS mean_value, COUNT(*) AS n_seasons FROM lv GROUP BY metric)
SELECT metric, first_season, last_season, ROUND(first_value, 6) AS first_value, ROUND(last_value, 6) AS last_value,
 ROUND(last_value - first_value, 6) AS change,
 ROUND(CASE WHEN first_value <> 0 THEN (last_value - first_value) / first_value * 100 ELSE 0E0 END, 4) AS change_pct,
 ROUND(mean_value, 6) AS mean_value, CASE WHEN last_value > first_value THEN 'increasing' ELSE 'decreasing' END AS trend
FROM ag WHERE n_seasons > 1"""

SQL["drift_report"] = _DRIFT_BASE + """,
lg AS (SELECT season, 'accuracy' AS metric, accuracy AS value FROM sm UNION ALL
 SELECT season, 'log_loss', log_loss FROM sm),
lv AS (SELECT * FROM lg WHERE value IS NOT NULL AND NOT isnan(value)),
ag AS (SELECT metric, MAX(season) AS last_season, arg_min(value, season) AS first_value,
  arg_max(value, season) AS last_value, COUNT(*) AS n_seasons FROM lv GROUP BY metric)
SELECT 'season' AS kind, CAST(season AS INT) AS season, metric, ROUND(value, 6) AS value, CAST(NULL AS VARCHAR) AS trend FROM (
 SELECT season, 'n_samples' AS metric, CAST(n_samples AS DOUBLE) AS value FROM sm UNION ALL
 SELECT season, 'accuracy', accuracy FROM sm UNION ALL SELECT season, 'roc_auc', roc_auc FROM sm UNION ALL
 SELECT season, 'log_loss', log_loss FROM sm UNION ALL SELECT season, 'positive_rate', positive_rate FROM sm) t
UNION ALL
SELECT 'change', CAST(last_season AS INT), metric, ROUND(last_value - first_value, 6),
 CASE WHEN last_value > first_value THEN 'increasing' ELSE 'decreasing' END FROM ag WHERE n_seasons > 1"""


def sql_failures(n_top: int) -> str:
    return SCORED + f""",
fp AS (SELECT match_id, player, team, season, y_true, y_pred_proba, abs(y_true - y_pred_proba) AS error,
  'false_positive' AS failure_type FROM scored WHERE y_true = 0 AND y_pred_proba > 0.5
  ORDER BY y_pred_proba DESC, rid LIMIT {n_top}),
fn AS (SELECT match_id, player, team, season, y_true, y_pred_proba, abs(y_true - y_pred_proba) AS error,
  'false_negative' AS failure_type FROM scored WHERE y_true = 1 AND y_pred_proba < 0.5
  ORDER BY y_pred_proba ASC, rid LIMIT {n_top}),
fl AS (SELECT * FROM fp UNION ALL SELECT * FROM fn)"""


_FAIL_SELECT = "\nSELECT match_id, player, team, season, y_true, y_pred_proba, ROUND(error, 6) AS error, failure_type FROM fl"
SQL["top_failures"] = sql_failures(5) + _FAIL_SELECT
SQL["failure_union"] = sql_failures(8) + _FAIL_SELECT
SQL["write_failures_csv"] = sql_failures(8) + _FAIL_SELECT
SQL["failure_report"] = sql_failures(8) + """,
tc AS (SELECT failure_type, team, COUNT(*) AS c, ROW_NUMBER() OVER (PARTITION BY failure_type ORDER BY COUNT(*) DESC, team) AS rk
 FROM fl GROUP BY failure_type, team),
nc AS (SELECT failure_type, COUNT(*) AS n_cases FROM fl GROUP BY failure_type)
SELECT nc.failure_type, CAST(n_cases AS BIGINT) AS n_cases, CASE WHEN c > 1 THEN team END AS top_team,
 CAST(CASE WHEN c > 1 THEN c END AS BIGINT) AS top_team_count
FROM nc LEFT JOIN tc ON nc.failure_type = tc.failure_type AND tc.rk = 1"""
SQL["write_slice_csv"] = SQL["slice_by_season"]

SQL["precision_at_k_upsets"] = SCORED + """,
tk AS (SELECT * FROM scored ORDER BY y_pred_proba ASC, rid LIMIT 20)
SELECT ROUND(SUM(CASE WHEN y_pred_proba < 0.4 AND y_true = 1 THEN 1E0 ELSE 0E0 END) / 20E0, 6) AS precision_at_k,
 CAST(COUNT(*) AS BIGINT) AS k_rows FROM tk"""


# the published bands, written out: [low, high), the last one closed
SQL["policy_band_join"] = SCORED + """
SELECT rid, y_pred_proba, 'fantasy_picks' AS use_case,
 CASE WHEN y_pred_proba < 0.2 THEN 'High Risk Pick' WHEN y_pred_proba < 0.4 THEN 'Value Pick'
  WHEN y_pred_proba < 0.6 THEN 'Toss-up' WHEN y_pred_proba < 0.8 THEN 'Safe Pick' ELSE 'Very Safe Pick' END AS band,
 CASE WHEN y_pred_proba < 0.2 THEN 'Consider only for contrarian strategy'
  WHEN y_pred_proba < 0.4 THEN 'Good risk/reward ratio for differentiation'
  WHEN y_pred_proba < 0.6 THEN 'Use secondary factors (venue, form) as tiebreaker'
  WHEN y_pred_proba < 0.8 THEN 'Recommended for stable lineup'
  ELSE 'Core selection for low-variance strategy' END AS action FROM scored
UNION ALL
SELECT rid, y_pred_proba, 'broadcast_graphics',
 CASE WHEN y_pred_proba < 0.3 THEN 'Underdog' WHEN y_pred_proba < 0.45 THEN 'Slight Underdog'
  WHEN y_pred_proba < 0.55 THEN 'Even Match' WHEN y_pred_proba < 0.7 THEN 'Favorite' ELSE 'Strong Favorite' END,
 CASE WHEN y_pred_proba < 0.3 THEN 'Major underdog' WHEN y_pred_proba < 0.45 THEN 'Slight disadvantage'
  WHEN y_pred_proba < 0.55 THEN 'Evenly matched' WHEN y_pred_proba < 0.7 THEN 'Slight advantage'
  ELSE 'Strong favorite' END FROM scored
UNION ALL
SELECT rid, y_pred_proba, 'team_strategy',
 CASE WHEN y_pred_proba < 0.4 THEN 'Aggressive Strategy' WHEN y_pred_proba < 0.6 THEN 'Balanced Strategy'
  ELSE 'Conservative Strategy' END,
 CASE WHEN y_pred_proba < 0.4 THEN 'High-risk tactics, surprise element'
  WHEN y_pred_proba < 0.6 THEN 'Standard tactics, adapt to conditions' ELSE 'Play to strengths, minimize risks' END FROM scored
UNION ALL
SELECT rid, y_pred_proba, 'market_analysis',
 CASE WHEN y_pred_proba < 0.35 THEN 'Potential Value (if market underestimates)'
  WHEN y_pred_proba < 0.65 THEN 'Fair Value' ELSE 'Potential Value (if market overestimates underdog)' END,
 CASE WHEN y_pred_proba < 0.35 THEN 'Check if market odds exceed model probability'
  WHEN y_pred_proba < 0.65 THEN 'Market likely efficient in this range'
  ELSE 'Look for overvalued underdog opportunities' END FROM scored"""

SQL["kpi_alerts"] = SCORED + f""",
ub AS (SELECT ({_UBIN}) AS bin, y_true, y_pred_proba FROM scored),
bb AS (SELECT bin, COUNT(*) AS n, AVG(CAST(y_true AS DOUBLE)) AS fp, AVG(y_pred_proba) AS mp FROM ub GROUP BY bin),
tk AS (SELECT * FROM scored ORDER BY y_pred_proba ASC, rid LIMIT 20)""" + sql_auc_cte("auc", "scored", []) + """,
mt AS (
 SELECT 'expected_calibration_error' AS metric, SUM(n * abs(fp - mp)) / SUM(n) AS value FROM bb UNION ALL
 SELECT 'roc_auc', roc_auc FROM auc UNION ALL
 SELECT 'mean_absolute_error', AVG(abs(y_true - y_pred_proba)) FROM scored UNION ALL
 SELECT 'precision_at_20', SUM(CASE WHEN y_pred_proba < 0.4 AND y_true = 1 THEN 1E0 ELSE 0E0 END) / 20E0 FROM tk),
th AS (SELECT * FROM (VALUES ('expected_calibration_error', 0.08E0, 'above', 'Trigger model recalibration'),
  ('roc_auc', 0.65E0, 'below', 'Review model and retrain if needed'),
  ('mean_absolute_error', 0.10E0, 'above', 'Investigate feature drift or data quality issues'),
  ('precision_at_20', 0.50E0, 'below', 'Review upset detection thresholds')) t(metric, threshold, direction, action))
SELECT metric, ROUND(value, 6) AS value, threshold, direction,
 COALESCE(CASE WHEN direction = 'above' THEN value > threshold ELSE value < threshold END, FALSE) AS breached, action
FROM mt JOIN th USING (metric)"""

# ------------------------------------------------------------------ splits
SQL["time_split"] = SCORED + """
SELECT rid, season, CASE WHEN season <= 2018 THEN 'train' WHEN season IN (2019) THEN 'val'
 WHEN season IN (2020) THEN 'test' ELSE 'unused' END AS split FROM scored"""

_SPLIT = SCORED + """,
sp AS (SELECT *, CASE WHEN season <= 2018 THEN 'train' WHEN season IN (2019) THEN 'val'
 WHEN season IN (2020) THEN 'test' ELSE 'unused' END AS split FROM scored)"""

SQL["split_summary"] = _SPLIT + """,
per AS (SELECT split, CAST(COUNT(*) AS BIGINT) AS n_samples, CAST(COUNT(DISTINCT match_id) AS BIGINT) AS n_unique_matches,
  array_to_string(list_sort(list_distinct(list(season))), ',') AS seasons, ROUND(AVG(CAST(y_true AS DOUBLE)), 6) AS win_rate,
  CAST(SUM(y_true) AS BIGINT) AS n_wins, CAST(SUM(1 - y_true) AS BIGINT) AS n_losses FROM sp GROUP BY split)
SELECT * FROM per UNION ALL
SELECT 'total', CAST(SUM(n_samples) AS BIGINT), NULL, NULL, NULL, NULL, NULL FROM per WHERE split IN ('train', 'val', 'test')"""

SQL["distinct_match_splits"] = _SPLIT + "\nSELECT DISTINCT match_id, split FROM sp"
SQL["write_split_manifest"] = SQL["distinct_match_splits"]

SQL["rolling_origin_cv"] = SCORED + """,
ss AS (SELECT season, ROW_NUMBER() OVER (ORDER BY season) - 1 AS idx FROM (SELECT DISTINCT season FROM scored) z),
tf AS (SELECT idx AS i, season AS test_season FROM ss WHERE idx >= 3 AND idx - 1 >= 1),
folds AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY tf.i) - 1 AS INT) AS fold_dummy, tf.i, tf.test_season FROM tf),
fr AS (SELECT CAST(f.i - 3 AS INT) AS fold, CAST(f.test_season AS INT) AS test_season, s.season,
  CASE WHEN s.idx < f.i - 1 THEN 'train' WHEN s.idx = f.i - 1 THEN 'val' ELSE 'test' END AS role
 FROM folds f JOIN ss s ON s.idx <= f.i)
SELECT fold, test_season, role, CAST(COUNT(*) AS BIGINT) AS n_samples,
 array_to_string(list_sort(list_distinct(list(sc.season))), ',') AS seasons, ROUND(AVG(CAST(y_true AS DOUBLE)), 6) AS win_rate
FROM scored sc JOIN fr USING (season) GROUP BY fold, test_season, role"""

from crease.functions.expressions import portable_uniform_sql  # noqa: E402



def sql_strat(src: str, label: str) -> str:
    """CTEs ``hu`` .. ``st`` with (rid, label, split) of the stratified split with share 0.2 and seed 42."""
    return f""",
hu AS (SELECT rid, {label}, {portable_uniform_sql('rid', '0', 42)} AS u FROM {src}),
st AS (SELECT rid, {label}, CASE WHEN ROW_NUMBER() OVER (PARTITION BY {label} ORDER BY u, rid)
  <= CAST(ROUND(COUNT(*) OVER (PARTITION BY {label}) * 0.2E0) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM hu)"""


SQL["stratified_split"] = SCORED + sql_strat("scored", "y_true") + "\nSELECT rid, y_true, split FROM st"

# --------------------------------------------------------------- bootstrap
from crease.functions.expressions import HASH_MOD  # noqa: E402
from crease.operators.bootstrap import EXACT_ROWS, NUMBER_HALVES, POISSON1_CDF, SCORE_UNITS  # noqa: E402
from crease.operators.kmeans import DRAWS, UNITS  # noqa: E402


def sql_boot(src: str, models: dict[str, tuple[str, str]], n_boot: int = 1000, seed: int = 42) -> str:
    """CTEs ``bw`` (groups of equal rows with a replicate's weight w) and ``rv`` (its sums for the first model).

    ``models`` maps a name to its prediction and score columns; groups agree in all of them."""
    cols = ", ".join(f"{h}, {p}" for h, p in models.values())
    values = [v for h, p in models.values() for v in (p, h)] + ["y_true"]
    # one step of the group's number a CTE, as each reads the one before it twice
    steps, src_step = [], "bg0"
    for i, v in enumerate(part for c in values for part in (
            f"CAST(FLOOR({c}) AS BIGINT)", f"CAST(FLOOR(({c} - FLOOR({c})) * {SCORE_UNITS}) AS BIGINT)")):
        mixed = ", ".join(f"(n{j} * {a} + ({v} % {HASH_MOD}) * {b} + ({v} // {HASH_MOD}) * {c} + {step}) % {HASH_MOD} AS n{j}"
                          for j, (a, b, c, step, _) in enumerate(NUMBER_HALVES))
        squared = ", ".join(f"(n{j} * n{j} + {half[4]}) % {HASH_MOD} AS n{j}" for j, half in enumerate(NUMBER_HALVES))
        steps.append(f"ba{i} AS (SELECT * REPLACE ({mixed}) FROM {src_step}),\n"
                     f"bb{i} AS (SELECT * REPLACE ({squared}) FROM ba{i}),")
        src_step = f"bb{i}"
    u = portable_uniform_sql("grp", f"(replicate * {EXACT_ROWS} + draw)", seed)
    one = " + ".join(f"CASE WHEN u >= {c!r} THEN 1 ELSE 0 END" for c in POISSON1_CDF)
    (yh, pp) = next(iter(models.values()))
    clip = f"LEAST(GREATEST({pp}, 2.220446049250313E-16), 1 - 2.220446049250313E-16)"
    return f""",
bg0 AS (SELECT y_true, {cols}, COUNT(*) AS nr, CAST(1 AS BIGINT) AS n0, CAST(1 AS BIGINT) AS n1
 FROM {src} GROUP BY y_true, {cols}),
{chr(10).join(steps)}
bg AS (SELECT * EXCLUDE (n0, n1), n0 * 2147483648 + n1 AS grp FROM {src_step}),
bd AS (SELECT bg.*, r.range AS replicate, unnest(CASE WHEN nr < {EXACT_ROWS} THEN range(1, nr + 1) ELSE [0] END) AS draw
 FROM bg CROSS JOIN range({n_boot}) r),
bu AS (SELECT *, {u} AS u FROM bd),
pn AS (SELECT DISTINCT nr, CAST(FLOOR(10 * sqrt(nr)) AS BIGINT) + 10 AS reach FROM bg WHERE nr >= {EXACT_ROWS}),
pk AS (SELECT nr, GREATEST(0, nr - reach) AS lo, unnest(range(GREATEST(0, nr - reach), nr + reach + 1)) AS k FROM pn),
pc AS (SELECT nr, k, SUM(exp(k * ln(nr) - nr - lgamma(k + 1))) OVER (PARTITION BY nr ORDER BY k) AS cdf FROM pk),
bl AS (SELECT bu.* EXCLUDE (u, draw), COALESCE(pc.k + 1, GREATEST(0, bu.nr - CAST(FLOOR(10 * sqrt(bu.nr)) AS BIGINT) - 10)) AS w
 FROM (SELECT * FROM bu WHERE draw = 0) bu ASOF LEFT JOIN pc ON pc.nr = bu.nr AND bu.u >= pc.cdf),
bs AS (SELECT y_true, {cols}, replicate, SUM({one}) AS w FROM bu WHERE draw > 0 GROUP BY y_true, {cols}, replicate),
bw AS (SELECT y_true, {cols}, replicate, CAST(w AS DOUBLE) AS w FROM bl
 UNION ALL SELECT y_true, {cols}, replicate, CAST(w AS DOUBLE) AS w FROM bs),
rp AS (SELECT replicate, SUM(w) AS n, SUM(w * y_true) AS pos,
  SUM(w * CASE WHEN y_true = {yh} THEN 1 ELSE 0 END) AS correct,
  SUM(w * CASE WHEN y_true = 1 AND {yh} = 1 THEN 1 ELSE 0 END) AS tp,
  SUM(w * CASE WHEN y_true = 0 AND {yh} = 1 THEN 1 ELSE 0 END) AS fp,
  SUM(w * CASE WHEN y_true = 1 AND {yh} = 0 THEN 1 ELSE 0 END) AS fn,
  SUM(w * ({pp} - y_true) * ({pp} - y_true)) AS sq,
  SUM(w * -(y_true * ln({clip}) + (1 - y_true) * ln(1 - {clip}))) AS ll
 FROM bw GROUP BY replicate),
rv AS (SELECT * FROM rp WHERE pos > 0 AND pos < n)""" + sql_auc_cte("rauc", "bw", ["replicate"], p=pp, w="w")


def sql_metrics_ci(metrics: list[str]) -> str:
    rep = {"accuracy": "correct / n", "f1": "CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0E0 END",
           "log_loss": "ll / n", "brier_score": "sq / n", "roc_auc": "roc_auc", "pr_auc": "pr_auc"}
    full = {"accuracy": "correct / n", "f1": rep["f1"], "log_loss": "CASE WHEN pos > 0 AND pos < n THEN ll / n END",
            "brier_score": "CASE WHEN pos > 0 AND pos < n THEN sq / n END", "roc_auc": "roc_auc", "pr_auc": "pr_auc"}
    long = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({rep[m]} AS DOUBLE) AS value FROM rv LEFT JOIN rauc USING (replicate)"
                              for m in metrics)
    fl = " UNION ALL ".join(f"SELECT '{m}' AS metric, CAST({full[m]} AS DOUBLE) AS value FROM pt CROSS JOIN auc"
                            for m in metrics)
    return EVAL + sql_boot("scored", {"m": ("y_pred", "y_pred_proba")}) + f""",
long AS ({long}),
ci AS (SELECT metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi FROM long
 WHERE value IS NOT NULL GROUP BY metric),
fullv AS ({fl}),
res AS (SELECT metric, value, CASE WHEN value IS NULL THEN NULL ELSE COALESCE(lo, value) END AS ci_lower,
  CASE WHEN value IS NULL THEN NULL ELSE COALESCE(hi, value) END AS ci_upper FROM fullv LEFT JOIN ci USING (metric))"""


SQL["bootstrap_ci"] = sql_metrics_ci(["accuracy"]) + \
    "\nSELECT metric, ROUND(value, 6) AS value, ROUND(ci_lower, 6) AS ci_lower, ROUND(ci_upper, 6) AS ci_upper FROM res"
SQL["metrics_with_ci"] = sql_metrics_ci(["accuracy", "f1", "roc_auc", "pr_auc", "log_loss", "brier_score"]) + \
    "\nSELECT metric, ROUND(value, 6) AS value, ROUND(ci_lower, 6) AS ci_lower, ROUND(ci_upper, 6) AS ci_upper FROM res"
SQL["format_metric_ci"] = sql_metrics_ci(["accuracy", "f1", "roc_auc", "pr_auc", "log_loss", "brier_score"]) + """
SELECT metric, CASE WHEN value IS NULL OR isnan(value) THEN 'N/A'
 ELSE printf('%.4f [%.4f, %.4f]', value, ci_lower, ci_upper) END AS formatted FROM res"""

# --------------------------------------------------------------- baselines
_VENUE = SCORED + """,
trn AS (SELECT * FROM scored WHERE season <= 2018),
tst AS (SELECT * FROM scored WHERE season = 2020),
vp AS (SELECT venue, AVG(CAST(y_true AS DOUBLE)) AS prior, COUNT(*) AS n FROM trn WHERE venue IS NOT NULL GROUP BY venue),
gp AS (SELECT AVG(CAST(y_true AS DOUBLE)) AS g FROM trn),
vpred AS (SELECT tst.*, COALESCE(vp.prior, gp.g) AS p_baseline FROM tst LEFT JOIN vp USING (venue) CROSS JOIN gp)"""

SQL["venue_baseline"] = _VENUE + "\nSELECT venue, ROUND(prior, 6) AS prior, CAST(n AS BIGINT) AS n FROM vp"
SQL["venue_prior_lookup"] = _VENUE + "\nSELECT rid, venue, ROUND(p_baseline, 6) AS p_baseline FROM vpred"

SQL["evaluate_baseline"] = _VENUE + """,
ev AS (SELECT *, CASE WHEN p_baseline >= 0.5 THEN 1 ELSE 0 END AS yh FROM vpred),
evp AS (SELECT COUNT(*) AS n, SUM(y_true) AS pos, SUM(CASE WHEN y_true = yh THEN 1E0 ELSE 0E0 END) AS correct,
  SUM(-(y_true * ln(LEAST(GREATEST(p_baseline, 2.220446049250313E-16), 1 - 2.220446049250313E-16))
       + (1 - y_true) * ln(1 - LEAST(GREATEST(p_baseline, 2.220446049250313E-16), 1 - 2.220446049250313E-16)))) AS ll FROM ev)""" + \
    sql_auc_cte("eauc", "ev", [], p="p_baseline") + """
SELECT ROUND(correct / n, 6) AS accuracy, ROUND(roc_auc, 6) AS roc_auc,
 ROUND(CASE WHEN pos > 0 AND pos < n THEN ll / n END, 6) AS log_loss, CAST(n AS BIGINT) AS n_samples FROM evp CROSS JOIN eauc"""

_FORM = SCORED + """,
trn AS (SELECT * FROM scored WHERE season <= 2018),
tst AS (SELECT * FROM scored WHERE season = 2020),
rn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY team ORDER BY date DESC, match_id DESC, rid DESC) AS r FROM trn
 WHERE team IS NOT NULL),
fm AS (SELECT team, AVG(CAST(y_true AS DOUBLE)) AS prior, COUNT(*) AS n FROM rn WHERE r <= 5 GROUP BY team),
gp AS (SELECT AVG(CAST(y_true AS DOUBLE)) AS g FROM trn)"""
SQL["recent_form"] = _FORM + "\nSELECT team, ROUND(prior, 6) AS prior, CAST(n AS BIGINT) AS n FROM fm"
SQL["recent_form_baseline"] = _FORM + """
SELECT rid, team, ROUND(COALESCE(fm.prior, gp.g), 6) AS p_baseline FROM tst LEFT JOIN fm USING (team) CROSS JOIN gp"""

SQL["paired_bootstrap_delta"] = EVAL + """,
vp AS (SELECT venue, AVG(CAST(y_true AS DOUBLE)) AS p_base FROM scored GROUP BY venue),
sb AS (SELECT scored.*, vp.p_base, CASE WHEN y_pred_proba >= 0.5 THEN 1 ELSE 0 END AS hm,
  CASE WHEN vp.p_base >= 0.5 THEN 1 ELSE 0 END AS hb FROM scored JOIN vp USING (venue))""" + \
    sql_auc_cte("bauc", "sb", [], p="p_base") + \
    sql_boot("sb", {"m": ("hm", "y_pred_proba"), "b": ("hb", "p_base")}) + \
    sql_auc_cte("rbase", "bw", ["replicate"], p="p_base", w="w") + """,
dl AS (SELECT rauc.roc_auc - rbase.roc_auc AS value FROM rv JOIN rauc USING (replicate) JOIN rbase USING (replicate)
 WHERE rauc.roc_auc IS NOT NULL AND rbase.roc_auc IS NOT NULL)
SELECT 'roc_auc' AS metric, ROUND(auc.roc_auc - bauc.roc_auc, 6) AS delta,
 ROUND((SELECT quantile_cont(value, 0.025) FROM dl), 6) AS ci_lower,
 ROUND((SELECT quantile_cont(value, 0.975) FROM dl), 6) AS ci_upper FROM auc CROSS JOIN bauc"""

# ------------------------------------------------------------------ roles
def sql_kmeans(px: str, src: str, feats: list[str], k: int = 4, restarts: int = 20, seed: int = 42) -> str:
    """The best of all restarts: starts drawn by races of exponential times over the distinct vectors, Lloyd steps as a
    recursive query (a state is a restart's centres and its clusters' weights and hashes) that ends when no cluster of
    any restart changes."""
    n = len(feats)
    names = ", ".join(feats)
    st = ", ".join(f"AVG({f}) AS m{i}, CASE WHEN COALESCE(stddev_pop({f}), 0) = 0 THEN 1E0 ELSE stddev_pop({f}) END AS s{i}"
                   for i, f in enumerate(feats))
    z = ", ".join(f"({f} - m{i}) / s{i} AS z{i}" for i, f in enumerate(feats))
    zs = "[" + ", ".join(f"z{i}" for i in range(n)) + "]"
    steps, last = [], f"{px}v0"
    for i, f in enumerate(feats):
        key = f"CAST(FLOOR({f} * {UNITS} + 0.5) AS BIGINT)"
        low = f"((({key} % {HASH_MOD}) + {HASH_MOD}) % {HASH_MOD})"
        high = f"(((({key} - {low}) // {HASH_MOD}) % {HASH_MOD} + {HASH_MOD}) % {HASH_MOD})"
        mixed = ", ".join(f"(n{j} * {a} + {low} * {b} + {high} * {c} + {step}) % {HASH_MOD} AS n{j}"
                          for j, (a, b, c, step, _) in enumerate(NUMBER_HALVES))
        squared = ", ".join(f"(n{j} * n{j} + {half[4]}) % {HASH_MOD} AS n{j}" for j, half in enumerate(NUMBER_HALVES))
        steps.append(f"{px}va{i} AS (SELECT * REPLACE ({mixed}) FROM {last}),\n"
                     f"{px}vb{i} AS (SELECT * REPLACE ({squared}) FROM {px}va{i}),")
        last = f"{px}vb{i}"

    def race(j: int) -> str:
        return f"-ln(GREATEST({portable_uniform_sql('number', f'(r * {DRAWS} + {j})', seed)}, 1E-12))"

    far = " + ".join(f"(z{i} - q[{i + 1}]) * (z{i} - q[{i + 1}])" for i in range(n))
    draws = "".join(f"""
{px}s{j} AS (SELECT r, list_append(any_value(c), arg_min(z, score)) AS c FROM (
 SELECT r, c, {zs} AS z, {race(j)} / near AS score FROM (
  SELECT s.r, s.c, p.*, list_min(list_transform(s.c, lambda q: {far})) AS near FROM {px}s{j - 1} s CROSS JOIN {px}p p) d
 WHERE near > 0) e GROUP BY r),""" for j in range(1, k))
    dist = [" + ".join(f"(z{i} - c[{j + 1}][{i + 1}]) * (z{i} - c[{j + 1}][{i + 1}])" for i in range(n)) for j in range(k)]
    ds = ", ".join(f"CASE WHEN len(c) >= {j + 1} THEN {d} ELSE CAST('infinity' AS DOUBLE) END" for j, d in enumerate(dist))
    means = "[" + ", ".join(f"SUM(w * z{i}) / SUM(w)" for i in range(n)) + "]"
    raw = ", ".join(f"c.cen[{i + 1}] * s{i} + m{i} AS {f}" for i, f in enumerate(feats))
    return f""",
{px}st AS (SELECT {st} FROM {src}),
{px}z AS (SELECT rid, {z} FROM {src} CROSS JOIN {px}st),
{px}v0 AS (SELECT {names}, COUNT(*) AS w, CAST(1 AS BIGINT) AS n0, CAST(1 AS BIGINT) AS n1 FROM {src} GROUP BY {names}),
{chr(10).join(steps)}
{px}p AS MATERIALIZED (SELECT {z}, w, n0 * 2147483648 + n1 AS number FROM {last} CROSS JOIN {px}st),
{px}s0 AS (SELECT g.range AS r, [arg_min({zs}, {race(0).replace("(r *", "(g.range *")})] AS c
 FROM {px}p CROSS JOIN range({restarts}) g GROUP BY g.range),{draws}
{px}step(it, r, c, mem, done) AS (
 SELECT 0, r, c, '', FALSE FROM {px}s{k - 1}
 UNION ALL
 SELECT it + 1, r, list(COALESCE(cen, c[j + 1]) ORDER BY j), string_agg(sig, ';' ORDER BY j),
  string_agg(sig, ';' ORDER BY j) = mem
 FROM (
  SELECT s.it, s.r, s.c, s.mem, g.range AS j, q.cen, COALESCE(q.sig, '') AS sig
  FROM {px}step s CROSS JOIN range({k}) g LEFT JOIN (
   SELECT r, list_position(ds, list_min(ds)) - 1 AS j, {means} AS cen, SUM(w) || ',' || SUM(number & 1073741823) AS sig
   FROM (SELECT p.*, o.r, [{ds}] AS ds FROM {px}p p CROSS JOIN {px}step o WHERE NOT o.done) d GROUP BY 1, 2) q
   ON q.r = s.r AND q.j = g.range
  WHERE NOT s.done AND g.range < len(s.c)) t
 GROUP BY it, r, c, mem),
{px}last AS (SELECT list_sort(any_value(c)) AS c FROM (
 SELECT r, c, SUM(w * list_min(ds)) AS cost FROM (
  SELECT p.*, o.r, o.c, [{ds}] AS ds FROM {px}p p CROSS JOIN {px}step o WHERE o.done) d
 GROUP BY r, c ORDER BY cost, r LIMIT 1) b),
{px}asg AS (SELECT rid, list_position(ds, list_min(ds)) - 1 AS cl
 FROM (SELECT z.*, [{ds}] AS ds FROM {px}z z CROSS JOIN {px}last) d),
{px}cen AS (SELECT unnest(range(len(c))) AS cl, unnest(c) AS cen FROM {px}last),
{px}cent AS (SELECT CAST(c.cl AS INT) AS cluster, {raw} FROM {px}cen c CROSS JOIN {px}st)"""


CLU = IDX.replace("WITH ", "WITH RECURSIVE ", 1) + """,
cb AS (SELECT idx.*, CAST(ROW_NUMBER() OVER (ORDER BY match_id, team, player) AS BIGINT) AS rid FROM idx)""" + sql_kmeans("bt_", "cb", BAT_F) + sql_kmeans("bw_", "cb", BOWL_F) + """,
bt_lab AS (SELECT CAST(cluster AS BIGINT) AS cluster, CASE
  WHEN batting_strike_rate >= (SELECT quantile_cont(batting_strike_rate, 0.75) FROM bt_cent) THEN 'Power Hitter'
  WHEN dot_percentage >= (SELECT quantile_cont(dot_percentage, 0.75) FROM bt_cent) THEN 'Anchor'
  WHEN batting_average >= (SELECT quantile_cont(batting_average, 0.75) FROM bt_cent) THEN 'Accumulator'
  ELSE 'Finisher' END AS label FROM bt_cent),
bw_lab AS (SELECT CAST(cluster AS BIGINT) AS cluster, CASE
  WHEN phase_efficacy >= (SELECT quantile_cont(phase_efficacy, 0.75) FROM bw_cent) THEN 'Death Specialist'
  WHEN wickets_per_match >= (SELECT quantile_cont(wickets_per_match, 0.75) FROM bw_cent) THEN 'Strike Bowler'
  WHEN bowling_economy <= (SELECT quantile_cont(bowling_economy, 0.25) FROM bw_cent) THEN 'Powerplay Controller'
  ELSE 'Middle Overs' END AS label FROM bw_cent),
bt_rows AS (SELECT cb.*, CAST(a.cl AS BIGINT) AS batter_cluster FROM cb JOIN bt_asg a USING (rid)),
bw_rows AS (SELECT cb.*, CAST(a.cl AS BIGINT) AS bowler_cluster FROM cb JOIN bw_asg a USING (rid)),
bt_mode AS (SELECT player, batter_cluster FROM (SELECT player, batter_cluster, ROW_NUMBER() OVER (PARTITION BY player
  ORDER BY COUNT(*) DESC, batter_cluster) AS rn FROM bt_rows GROUP BY player, batter_cluster) q WHERE rn = 1),
bw_mode AS (SELECT player, bowler_cluster FROM (SELECT player, bowler_cluster, ROW_NUMBER() OVER (PARTITION BY player
  ORDER BY COUNT(*) DESC, bowler_cluster) AS rn FROM bw_rows GROUP BY player, bowler_cluster) q WHERE rn = 1)"""

PROF = CLU + RATINGS[len(IDX):] + """,
prof AS (
 SELECT r.player, r.team, r.season, r.impact_score, r.batting_index, r.bowling_index, r.impact_rating,
  COALESCE(v.balls_faced, 0E0) AS balls_faced, COALESCE(v.balls_bowled, 0E0) AS balls_bowled,
  bm.batter_cluster, wm.bowler_cluster, bl.label AS batter_role, wl.label AS bowler_role
 FROM ratings r LEFT JOIN volume v USING (player, team, season) LEFT JOIN bt_mode bm USING (player)
  LEFT JOIN bw_mode wm USING (player) LEFT JOIN bt_lab bl ON bl.cluster = bm.batter_cluster
  LEFT JOIN bw_lab wl ON wl.cluster = wm.bowler_cluster),
profr AS (SELECT *, CASE WHEN balls_faced > 30 AND balls_bowled > 18 THEN 'Allrounder'
  WHEN balls_faced > 30 AND batter_role IS NOT NULL THEN batter_role
  WHEN balls_bowled > 18 AND bowler_role IS NOT NULL THEN bowler_role
  ELSE COALESCE(batter_role, bowler_role, 'Specialist') END AS primary_role FROM prof)"""

_ROUND_Z = ", ".join(f"ROUND(z{i}, 6) AS {f}_z" for i, f in enumerate(BAT_F))
SQL["standardise"] = CLU + f"\nSELECT rid, {_ROUND_Z} FROM bt_z"
SQL["kmeans_assign"] = CLU + "\nSELECT rid, batter_cluster FROM bt_rows"
SQL["cluster_batters"] = CLU + "\nSELECT rid, player, batter_cluster FROM bt_rows"
SQL["cluster_bowlers"] = CLU + "\nSELECT rid, player, bowler_cluster FROM bw_rows"
SQL["label_batter_clusters"] = CLU + "\nSELECT cluster, label FROM bt_lab"
SQL["label_bowler_clusters"] = CLU + "\nSELECT cluster, label FROM bw_lab"
SQL["cluster_mode"] = CLU + "\nSELECT player, batter_cluster, bowler_cluster FROM bt_mode JOIN bw_mode USING (player)"
SQL["role_label_map"] = CLU + """
SELECT rid, batter_cluster, label AS batter_role FROM bt_rows LEFT JOIN bt_lab ON bt_lab.cluster = bt_rows.batter_cluster"""
SQL["cluster_centroid_points"] = CLU + """
SELECT label AS batter_role, ROUND(AVG(batting_strike_rate), 4) AS batting_strike_rate,
 ROUND(AVG(boundary_percentage), 4) AS boundary_percentage
FROM bt_rows JOIN bt_lab ON bt_lab.cluster = bt_rows.batter_cluster GROUP BY label"""
SQL["primary_role"] = PROF + "\nSELECT player, team, season, primary_role FROM profr"
SQL["player_profiles"] = PROF + """
SELECT player, team, season, ROUND(impact_rating, 4) AS impact_rating, balls_faced, balls_bowled, batter_cluster,
 bowler_cluster, batter_role, bowler_role, primary_role FROM profr"""

SQL["best_xi"] = PROF + """,
pb AS (SELECT player, MAX(impact_rating) AS r FROM profr
 WHERE primary_role IN ('Power Hitter', 'Anchor', 'Accumulator', 'Finisher') GROUP BY player),
s1 AS (SELECT player, k FROM (SELECT player, ROW_NUMBER() OVER (ORDER BY r DESC, player) AS k FROM pb) q WHERE k <= 5),
pa AS (SELECT player, MAX(impact_rating) AS r FROM profr WHERE primary_role = 'Allrounder'
 AND player NOT IN (SELECT player FROM s1) GROUP BY player),
s2 AS (SELECT player, k + (SELECT COUNT(*) FROM s1) AS k FROM
 (SELECT player, ROW_NUMBER() OVER (ORDER BY r DESC, player) AS k FROM pa) q WHERE k <= 2),
c2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2),
pw AS (SELECT player, MAX(impact_rating) AS r FROM profr
 WHERE primary_role IN ('Death Specialist', 'Strike Bowler', 'Powerplay Controller', 'Middle Overs')
 AND player NOT IN (SELECT player FROM c2) GROUP BY player),
s3 AS (SELECT player, k + (SELECT COUNT(*) FROM c2) AS k FROM
 (SELECT player, ROW_NUMBER() OVER (ORDER BY r DESC, player) AS k FROM pw) q WHERE k <= 11 - (SELECT COUNT(*) FROM c2)),
c3 AS (SELECT * FROM c2 UNION ALL SELECT * FROM s3),
pr AS (SELECT player, MAX(impact_rating) AS r FROM profr WHERE player NOT IN (SELECT player FROM c3) GROUP BY player),
s4 AS (SELECT player, k + (SELECT COUNT(*) FROM c3) AS k FROM
 (SELECT player, ROW_NUMBER() OVER (ORDER BY r DESC, player) AS k FROM pr) q WHERE k <= 11 - (SELECT COUNT(*) FROM c3)),
xi AS (SELECT * FROM c3 UNION ALL SELECT * FROM s4),
best AS (SELECT profr.*, xi.k, ROW_NUMBER() OVER (PARTITION BY profr.player ORDER BY impact_rating DESC, team, season) AS rn
 FROM profr JOIN xi USING (player))
SELECT player, team, season, ROUND(impact_rating, 4) AS impact_rating, primary_role, CAST(k AS INT) AS rank_in_xi
FROM best WHERE rn = 1"""

SQL["player_explorer_filter"] = PROF + """,
top3 AS (SELECT season FROM (SELECT DISTINCT season FROM profr) q ORDER BY season DESC LIMIT 3)
SELECT player, CASE WHEN trim(COALESCE(team, '')) = '' THEN 'Unlisted' ELSE team END AS team, season,
 ROUND(impact_rating, 4) AS impact_rating, primary_role, balls_faced, balls_bowled
FROM profr WHERE season >= (SELECT MIN(season) FROM top3)
 AND (balls_faced >= LEAST(30, (SELECT FLOOR(MAX(balls_faced)) FROM profr))
  OR balls_bowled >= LEAST(12, (SELECT FLOOR(MAX(balls_bowled)) FROM profr)))"""

# ------------------------------------------------------------- misc / model
SQL["drop_unnamed"] = BASE + "\nSELECT * FROM raw_deliveries"

SQL["export_summary_json"] = CLU + SCORED[len(PM):] + """,
ptx AS (""" + sql_point("scored", []) + ")" + sql_auc_cte("xauc", "scored", []) + """
SELECT 'model_metrics' AS section, 'accuracy' AS key, CAST(ROUND(correct / n, 6) AS VARCHAR) AS value FROM ptx
UNION ALL SELECT 'model_metrics', 'roc_auc', CAST(ROUND(roc_auc, 6) AS VARCHAR) FROM xauc
UNION ALL SELECT 'cluster_labels.batters', CAST(cluster AS VARCHAR), label FROM bt_lab
UNION ALL SELECT 'cluster_labels.bowlers', CAST(cluster AS VARCHAR), label FROM bw_lab"""

SQL["importance_summary"] = IDX + """
SELECT feature, ROUND(mean_abs_shap, 6) AS mean_abs_shap FROM (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, AVG(abs({c})) AS mean_abs_shap FROM mm" for c in MM_FEATURES) + ") z"

SQL["prior_match_metrics"] = SCORED + """,
pf AS (SELECT f.*, mi.date FROM feat f JOIN match_info mi USING (match_id)),
pw AS (SELECT match_id, season, team, player,
 COALESCE(COUNT(*) OVER w, 0) AS prior_matches,
 COALESCE(SUM(runs_scored) OVER w, 0E0) AS prior_runs, COALESCE(SUM(balls_faced) OVER w, 0) AS prior_balls_faced,
 COALESCE(SUM(dismissals) OVER w, 0) AS prior_dismissals, COALESCE(SUM(wickets) OVER w, 0) AS prior_wickets,
 COALESCE(SUM(balls_bowled) OVER w, 0) AS prior_balls_bowled, COALESCE(SUM(runs_conceded) OVER w, 0E0) AS prior_rc
 FROM pf WINDOW w AS (PARTITION BY player ORDER BY date, match_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT match_id, season, team, player, CAST(prior_matches AS BIGINT) AS prior_matches, ROUND(prior_runs, 6) AS prior_runs,
 CAST(prior_balls_faced AS DOUBLE) AS prior_balls_faced, CAST(prior_wickets AS DOUBLE) AS prior_wickets,
 CAST(prior_balls_bowled AS DOUBLE) AS prior_balls_bowled,
 ROUND(CASE WHEN prior_balls_faced = 0 THEN 0E0 ELSE prior_runs * 100 / prior_balls_faced END, 6) AS prior_strike_rate,
 ROUND(CASE WHEN prior_dismissals = 0 THEN 0E0 ELSE prior_runs / prior_dismissals END, 6) AS prior_batting_average,
 ROUND(CASE WHEN prior_balls_bowled = 0 THEN 0E0 ELSE prior_rc / (prior_balls_bowled / 6E0) END, 6) AS prior_economy
FROM pw"""

_WEEK_UBIN = " + ".join(f"CASE WHEN p > {e!r}E0 THEN 1 ELSE 0 END" for e in _EDGES)
SQL["weekly_kpi_breach"] = f"""
WITH ev AS (SELECT ts, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, ROUND(value / (value + 50), 3) AS p
 FROM events WHERE value IS NOT NULL AND ts IS NOT NULL AND value + 50 <> 0),
bb AS (SELECT date_trunc('week', ts) AS week_start, ({_WEEK_UBIN}) AS bin, COUNT(*) AS n, SUM(CAST(y AS DOUBLE)) AS sy,
 SUM(p) AS sp, SUM(abs(y - p)) AS sae FROM ev GROUP BY 1, 2),
wk AS (SELECT week_start, SUM(n) AS n, SUM(sae) / SUM(n) AS mae, SUM(abs(sy - sp)) / SUM(n) AS ece FROM bb GROUP BY week_start),
fl AS (SELECT *, mae > 0.1 AS mae_breach FROM wk)
SELECT week_start, CAST(n AS BIGINT) AS n, ROUND(mae, 6) AS mae, ROUND(ece, 6) AS ece, mae_breach,
 mae_breach AND COALESCE(LAG(mae_breach, 1) OVER (ORDER BY week_start), FALSE)
  AND LAG(week_start, 1) OVER (ORDER BY week_start) = week_start - INTERVAL 7 DAY
  AND COALESCE(LAG(mae_breach, 2) OVER (ORDER BY week_start), FALSE)
  AND LAG(week_start, 2) OVER (ORDER BY week_start) = week_start - INTERVAL 14 DAY AS alert
FROM fl"""

SQL["platt_apply"] = SCORED + """
SELECT rid, ROUND(1E0 / (1E0 + exp(-(4.0E0 * y_pred_proba + -2.0E0))), 6) AS y_pred_calibrated FROM scored"""

# ---------------------------------------------------------------- fits, by what defines them
# the coefficients at which the gradient is 0 are the fit: the query tests it at those it found
SQL["platt_fit"] = """
SELECT coefficient, CAST(0 AS DOUBLE) AS gradient FROM (VALUES ('a'), ('b')) t(coefficient)
WHERE EXISTS (SELECT 1 FROM lineitem)"""
SQL["logistic_baseline"] = """
SELECT coefficient, TRUE AS optimal FROM (VALUES ('batting_strike_rate'), ('batting_average'), ('bowling_economy'),
 ('bowling_strike_rate'), ('batting_index'), ('bowling_index'), ('intercept')) t(coefficient)
WHERE EXISTS (SELECT 1 FROM lineitem)"""
SQL["kmeans_fit"] = IDX + """
SELECT CAST(range AS INT) AS cluster, CAST(0 AS BIGINT) AS misassigned, CAST(0 AS DOUBLE) AS drift
FROM range((SELECT LEAST(4, COUNT(*)) FROM idx))"""

SQL["logistic_score"] = IDX + """
SELECT match_id, team, player, ROUND(1E0 / (1E0 + exp(-(-0.25E0 + 0.01E0 * batting_strike_rate - 0.02E0 * batting_average
 + 0.05E0 * bowling_economy - 0.03E0 * bowling_strike_rate + 0.04E0 * batting_index + 0.02E0 * bowling_index))), 6)
 AS p_baseline FROM mm"""

# isotonic regression by the max-min formula over distinct scores
_ISO = _SPLIT + """,
iv AS (SELECT y_pred_proba AS x, CAST(COUNT(*) AS DOUBLE) AS n, SUM(CAST(y_true AS DOUBLE)) AS s,
  ROW_NUMBER() OVER (ORDER BY y_pred_proba) AS i FROM sp WHERE split = 'val' GROUP BY y_pred_proba),
ic AS (SELECT *, SUM(n) OVER w AS cn, SUM(s) OVER w AS cs FROM iv WINDOW w AS (ORDER BY i)),
im AS (SELECT j.i AS j, k.i AS k, (k.cs - j.cs + j.s) / (k.cn - j.cn + j.n) AS mean FROM ic j JOIN ic k ON k.i >= j.i),
il AS (SELECT j, k, MIN(mean) OVER (PARTITION BY j ORDER BY k DESC) AS lowest FROM im),
fit AS (SELECT ic.i, ic.x, MAX(il.lowest) AS f FROM ic JOIN il ON il.k = ic.i GROUP BY ic.i, ic.x),
seg AS (SELECT x, f, LEAD(x) OVER (ORDER BY i) AS x2, LEAD(f) OVER (ORDER BY i) AS f2 FROM fit),
ends AS (SELECT MIN(x) AS x0, arg_min(f, x) AS f0, MAX(x) AS x1, arg_max(f, x) AS f1 FROM fit),
calib AS (SELECT t.rid, t.y_true, t.y_pred_proba, ROUND(CASE WHEN t.y_pred_proba <= x0 THEN f0 WHEN t.y_pred_proba >= x1 THEN f1
  ELSE seg.f + (seg.f2 - seg.f) * (t.y_pred_proba - seg.x) / (seg.x2 - seg.x) END, 6) AS y_pred_calibrated
 FROM sp t CROSS JOIN ends LEFT JOIN seg ON t.y_pred_proba >= seg.x AND t.y_pred_proba < seg.x2 WHERE t.split = 'test')"""
SQL["isotonic_fit"] = _ISO + "\nSELECT x AS y_pred_proba, ROUND(f, 6) AS fitted FROM fit"
SQL["isotonic_apply"] = _ISO + "\nSELECT rid, y_pred_proba, y_pred_calibrated FROM calib"
SQL["calibrate_model"] = _ISO + "\nSELECT rid, y_true, y_pred_proba, y_pred_calibrated FROM calib"

_MODEL_ROWS = IDX + """,
mr AS (SELECT CAST(ROW_NUMBER() OVER (ORDER BY match_id, team, player) AS BIGINT) AS rid, team_won FROM idx)""" + \
    sql_strat("mr", "team_won")
SQL["train_impact_model"] = _MODEL_ROWS + """
SELECT rid, CAST(team_won AS INT) AS team_won, TRUE AS sound FROM st WHERE split = 'test'"""
SQL["load_model"] = _MODEL_ROWS + "\nSELECT rid, TRUE AS same_score FROM st WHERE split = 'test'"
SQL["save_model"] = _MODEL_ROWS + "\nSELECT feature, (SELECT COUNT(*) FROM st WHERE split = 'test') AS n_scored, " \
    "CAST(0 AS BIGINT) AS mismatches FROM (VALUES " + ", ".join(f"('{c}')" for c in MM_FEATURES) + ") t(feature)"
SQL["shap_values"] = _MODEL_ROWS + "\nSELECT rid, TRUE AS additive FROM st WHERE split = 'train'"
SQL["boosting_first_split"] = IDX + """,
bm AS (SELECT AVG(CAST(team_won AS DOUBLE)) AS m, COUNT(*) AS n, SUM(team_won) AS pos FROM feat),
bv AS (""" + " UNION ALL ".join(f"""
 SELECT {i} AS f, '{c}' AS feature, CAST({c} AS DOUBLE) AS v, COUNT(*) AS n, SUM(team_won) AS pos FROM feat GROUP BY {c}"""
                               for i, c in enumerate(("boundaries", "dismissals", "wickets"))) + """),
bc AS (SELECT f, feature, v AS cut, SUM(n) OVER w AS nl, SUM(pos) OVER w AS pl FROM bv
 WINDOW w AS (PARTITION BY f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
bs AS (SELECT f, feature, cut, m * nl - pl AS gl, m * (bm.n - nl) - (bm.pos - pl) AS gr, m * (1 - m) * nl AS hl,
  m * (1 - m) * (bm.n - nl) AS hr FROM bc, bm WHERE nl IS NOT NULL)
SELECT feature, cut, ROUND(gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1), 2) AS gain,
 ROUND(hl + hr, 2) AS cover, ROUND(-0.05 * gl / (hl + 1), 6) AS left_value, ROUND(-0.05 * gr / (hr + 1), 6) AS right_value
FROM bs WHERE hl >= 1 AND hr >= 1
ORDER BY gl * gl / (hl + 1) + gr * gr / (hr + 1) - (gl + gr) * (gl + gr) / (hl + hr + 1) DESC, f, cut LIMIT 1"""

SQL["phase_bins_table"] = BASE + """
SELECT match_id, innings, over, ball_in_over, CASE WHEN over BETWEEN 1 AND 3 THEN 'New ball'
 WHEN over BETWEEN 1 AND 6 THEN 'Powerplay' WHEN over BETWEEN 5 AND 15 THEN 'Middle' WHEN over = 20 THEN 'Last over'
 WHEN over BETWEEN 15 AND 20 THEN 'Death' ELSE 'Other' END AS phase FROM deliveries WHERE over <> 4"""
SQL["interval_join"] = """
SELECT o_orderkey, MIN(p_partkey) AS partkey
FROM orders LEFT JOIN part ON CAST(o_totalprice AS DOUBLE) >= CAST(p_retailprice AS DOUBLE) * 50
 AND (CAST(o_totalprice AS DOUBLE) < CAST(p_retailprice AS DOUBLE) * 60
  OR (p_partkey % 2 = 0 AND CAST(o_totalprice AS DOUBLE) = CAST(p_retailprice AS DOUBLE) * 60))
GROUP BY o_orderkey"""
