"""Portable SQL that derives test inputs from the supplied tables.

The same text runs in Spark SQL and in DuckDB. The delivery fixture maps each
``lineitem`` row to one ball; its column names are deliberately aliases
(striker, batsman_runs, winner, ...) so that canonicalisation is exercised.
"""

from __future__ import annotations

# Common table expressions; the last one, ``raw_deliveries``, is the fixture.
DELIVERY_CTES = """
b AS (
 SELECT CAST(FLOOR(CAST(l_orderkey AS DOUBLE) / 60) AS BIGINT) AS m,
   1 + CAST((l_linenumber + l_suppkey) % 2 AS INT) AS innings,
   1 + CAST(l_partkey % 20 AS INT) AS over_no,
   1 + CAST(l_suppkey % 6 AS INT) AS ball_no,
   CAST(l_quantity AS INT) % 11 AS bat_i,
   5 + CAST(l_suppkey % 6 AS INT) AS bowl_i,
   CAST(ROUND(l_discount * 100) AS INT) AS d, CAST(ROUND(l_tax * 100) AS INT) AS t,
   l_orderkey, l_linenumber, l_returnflag, l_linestatus
 FROM {lineitem}),
c AS (
 SELECT *, m % 8 AS home, (m + 1 + m % 7) % 8 AS away,
   CASE WHEN d <= 3 THEN 0 WHEN d <= 6 THEN 1 WHEN d = 7 THEN 2 WHEN d = 8 THEN 4 WHEN d = 9 THEN 6 ELSE 3 END AS rb,
   CASE WHEN t >= 7 THEN 1 ELSE 0 END AS ex, CASE WHEN t = 8 THEN 0 ELSE 1 END AS vb,
   CASE WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN 1 ELSE 0 END AS w FROM b),
e AS (
 SELECT *, CASE WHEN innings = 1 THEN home ELSE away END AS bt, CASE WHEN innings = 1 THEN away ELSE home END AS ft,
  SUM(CASE WHEN innings = 1 THEN rb + ex ELSE 0 END) OVER (PARTITION BY m) AS r1,
  SUM(CASE WHEN innings = 2 THEN rb + ex ELSE 0 END) OVER (PARTITION BY m) AS r2 FROM c),
raw_deliveries AS (
SELECT m AS match_id, CAST(2008 + m % 13 AS INT) AS season,
  make_date(CAST(2008 + m % 13 AS INT), 4, CAST(1 + m % 28 AS INT)) AS match_date,
  concat('V', CAST(m % 6 AS STRING)) AS venue, innings, over_no AS over, ball_no AS ball_in_over,
  concat('T', CAST(bt AS STRING), '_P', CAST(bat_i AS STRING)) AS striker,
  concat('T', CAST(bt AS STRING), '_P', CAST((bat_i + 1) % 11 AS STRING)) AS non_striker,
  concat('T', CAST(ft AS STRING), '_P', CAST(bowl_i AS STRING)) AS bowler,
  concat('T', CAST(bt AS STRING)) AS batting_team, concat('T', CAST(ft AS STRING)) AS bowling_team,
  rb AS batsman_runs, ex AS extras, rb + ex AS total_runs, vb AS valid_ball,
  CASE WHEN w = 0 THEN NULL WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN concat('T', CAST(bt AS STRING), '_P', CAST((bat_i + 1) % 11 AS STRING)) ELSE concat('T', CAST(bt AS STRING), '_P', CAST(bat_i AS STRING)) END AS player_dismissed,
  CASE WHEN w = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'Caught' WHEN l_returnflag = 'N' THEN 'bowled' ELSE 'run out' END AS dismissal_kind,
  CASE WHEN m % 37 = 36 OR r1 = r2 THEN NULL WHEN r1 > r2 THEN concat('T', CAST(home AS STRING)) ELSE concat('T', CAST(away AS STRING)) END AS winner
FROM e)"""

# The fixture as a messy file would carry it (Spark SQL; the oracle states what must come out).
DIRTY_SELECT = """
SELECT match_id, innings, over, ball_in_over, striker, bowler, batting_team, bowling_team,
  CASE match_id % 6 WHEN 0 THEN CAST(match_date AS STRING) WHEN 1 THEN date_format(match_date, 'dd/MM/yyyy')
    WHEN 2 THEN date_format(match_date, 'd-M-yyyy') WHEN 3 THEN date_format(match_date, 'MMM d, yyyy')
    WHEN 4 THEN concat(CAST(match_date AS STRING), ' 19:30:00') ELSE 'rain' END AS match_date,
  CASE WHEN match_id % 5 = 4 THEN concat(CAST(season - 1 AS STRING), '/', substr(CAST(season AS STRING), 3))
    ELSE CAST(season AS STRING) END AS season,
  CASE (over + ball_in_over) % 7 WHEN 0 THEN 'NaN' WHEN 1 THEN 'four' WHEN 2 THEN concat(' ', CAST(batsman_runs AS STRING), ' ')
    WHEN 3 THEN NULL ELSE CAST(batsman_runs AS STRING) END AS batsman_runs,
  CASE WHEN over % 4 = 0 THEN CAST(total_runs AS STRING) || '.0' WHEN over % 4 = 1 THEN '' ELSE CAST(total_runs AS STRING)
    END AS total_runs,
  CASE ball_in_over % 3 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN NULL ELSE CAST(valid_ball AS DOUBLE) END AS valid_ball
FROM raw_deliveries"""

# One row per match of the fixture: its winner, from sums per match instead of sums beside every ball.
WINNERS_SELECT = """
SELECT m AS match_id, CASE WHEN m % 37 = 36 OR r1 = r2 THEN NULL WHEN r1 > r2 THEN concat('T', CAST(home AS STRING)) ELSE concat('T', CAST(away AS STRING)) END AS winner
FROM (SELECT m, home, away, SUM(CASE WHEN innings = 1 THEN rb + ex ELSE 0 END) AS r1,
  SUM(CASE WHEN innings = 2 THEN rb + ex ELSE 0 END) AS r2 FROM c GROUP BY m, home, away)"""

# Canonical, prepared deliveries in portable SQL (what ``prepare_deliveries``
# produces on the fixture): aliases renamed, phase and flags derived.
PREPARED_CTE = """
deliveries AS (
SELECT match_id, season, CAST(match_date AS DATE) AS date, venue, innings,
  CAST(over AS INT) AS over, CAST(ball_in_over AS INT) AS ball_in_over,
  striker AS batter, non_striker, bowler, batting_team, bowling_team,
  CAST(batsman_runs AS DOUBLE) AS runs_batter, extras AS runs_extras, CAST(total_runs AS DOUBLE) AS runs_total,
  player_dismissed AS player_out, dismissal_kind AS wicket_kind, winner AS win_team,
  CASE WHEN over BETWEEN 1 AND 6 THEN 'Powerplay' WHEN over BETWEEN 7 AND 15 THEN 'Middle'
       WHEN over BETWEEN 16 AND 20 THEN 'Death' ELSE 'Other' END AS phase,
  CAST(valid_ball AS INT) AS valid_ball,
  (total_runs = 0 AND valid_ball <> 0) AS is_dot_ball,
  (player_dismissed IS NOT NULL) AS is_wicket,
  (batsman_runs IN (4, 6)) AS is_boundary, (batsman_runs = 4) AS is_four, (batsman_runs = 6) AS is_six,
  COALESCE(player_dismissed = striker, FALSE) AS batter_dismissed,
  COALESCE(player_dismissed = striker, FALSE)
    AND lower(COALESCE(dismissal_kind, '')) NOT IN ('run out', 'retired hurt', 'retired out', 'obstructing the field')
    AS is_bowler_wicket
FROM raw_deliveries)"""


def delivery_sql(lineitem: str = "lineitem") -> str:
    """``WITH`` prefix (no trailing comma) defining ``raw_deliveries`` and ``deliveries``."""
    return "WITH " + DELIVERY_CTES.format(lineitem=lineitem) + "," + PREPARED_CTE
