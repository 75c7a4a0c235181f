"""Ball -> player-match aggregation.

Design: deliveries are dealt by match, then each is emitted once per role
(batter row, bowler row) and aggregated ONCE to a long (match, season, team,
player, role, phase) table. The balls of a match may lie anywhere in the input;
summed up before they are dealt, nearly every ball keeps two groups of its own,
and tasks spill tables of them. A task adds up whole matches, one at a time or
many, in a table that only grows with their players; ``partitions``, which callers
take from the number of balls, keeps a task's share of matches the same as the
table grows (``BALLS_OF_TASK``). The same task brings the
long rows of a player-match together (``player_match_sums``), as they lie in it
already: no row is moved again, and the side indicator of an outer join falls out
of the roles present. The league's rates are read off these sums. Batting or
bowling alone is one aggregate of the deliveries (``batting_player_match``,
``bowling_player_match``).

Nothing here starts a job; callers that read a result more than once
materialise it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crease.functions.expressions import safe_divide

KEYS = ["match_id", "season", "team", "player"]
BAT, BOWL = "bat", "bowl"
#: Balls a task adds up, and at most; their sums take about 200 bytes a ball.
BALLS_OF_TASK = (250_000, 2_000_000)


def player_phase_long(deliveries: DataFrame, partitions: int | None = None) -> DataFrame:
    """Long table: one row per (match_id, season, team, player, role, phase). ``partitions`` to deal the balls into;
    None leaves it to Spark.

    Null keys are kept here (Spark groups nulls); the player-match step drops
    them as pandas does, while ``bowler_phase_stats`` keeps null match/season.
    """
    d = deliveries
    valid = F.col("valid_ball").cast("long")
    dot = (F.col("is_dot_ball") & (F.col("valid_ball") != 0)).cast("long")
    zero = F.lit(0).cast("long")

    def role_row(role, team, player, wickets):
        return F.struct(
            F.lit(role).alias("role"), F.col(team).alias("team"), F.col(player).alias("player"),
            F.col("runs_batter").alias("runs_bat"), F.col("runs_total").alias("runs_tot"),
            valid.alias("balls"), dot.alias("dots"),
            F.col("is_four").cast("long").alias("fours"), F.col("is_six").cast("long").alias("sixes"),
            F.col("is_boundary").cast("long").alias("boundaries"),
            F.col("batter_dismissed").cast("long").alias("dismissals"),
            wickets.alias("wickets"),
        )

    read = ["match_id", "season", "phase", "batting_team", "batter", "bowling_team", "bowler", "runs_batter", "runs_total",
            "valid_ball", "is_dot_ball", "is_four", "is_six", "is_boundary", "batter_dismissed", "is_bowler_wicket"]
    keys = ["match_id", "season"]
    exploded = d.select(*read).repartition(*([partitions] if partitions else []), *keys).select(
        "match_id", "season", "phase",
        F.explode(F.array(
            role_row(BAT, "batting_team", "batter", zero),
            role_row(BOWL, "bowling_team", "bowler", F.col("is_bowler_wicket").cast("long")),
        )).alias("r"),
    ).select("match_id", "season", "phase", "r.*")
    return exploded.groupBy("match_id", "season", "team", "player", "role", "phase").agg(
        F.sum("runs_bat").alias("runs_bat"), F.sum("runs_tot").alias("runs_tot"),
        F.sum("balls").alias("balls"), F.sum("dots").alias("dots"),
        F.sum("fours").alias("fours"), F.sum("sixes").alias("sixes"),
        F.sum("boundaries").alias("boundaries"), F.sum("dismissals").alias("dismissals"),
        F.sum("wickets").alias("wickets"),
    )


def bowler_phase_stats(long: DataFrame) -> DataFrame:
    """Σruns, Σballs per (bowler, phase) over all matches."""
    return (long.filter((F.col("role") == BOWL) & F.col("player").isNotNull() & F.col("phase").isNotNull())
            .groupBy(F.col("player").alias("bowler"), "phase")
            .agg(F.sum("runs_tot").alias("phase_runs"), F.sum("balls").alias("phase_balls")))


def league_phase_rate(phase_stats: DataFrame) -> DataFrame:
    """Per phase: unweighted mean over bowlers of runs*6/balls (0 balls -> 0)."""
    return phase_stats.groupBy("phase").agg(
        F.avg(safe_divide(F.col("phase_runs") * 6, F.col("phase_balls"))).alias("league_run_rate"))


def match_winners(deliveries: DataFrame, winner: str = "win_team") -> DataFrame:
    """One winner per match (quirk Q13): the maximum non-null winner name.

    Distinct (match, winner) pairs first: a hash aggregate on keys only, so
    the string max afterwards (a sort-based aggregate) sees one row per pair."""
    pairs = deliveries.filter(F.col("match_id").isNotNull() & F.col(winner).isNotNull()) \
        .select("match_id", winner).distinct()
    return pairs.groupBy("match_id").agg(F.max(winner).alias("winning_team"))


def player_match_sums(long: DataFrame) -> DataFrame:
    """One row per (match_id, season, team, player), null keys included: both roles' sums, which roles there are, and
    ``_phase_rows``, the sums of each role and phase."""
    is_bat, is_bowl = F.col("role") == BAT, F.col("role") == BOWL

    def bat(c):
        return F.sum(F.when(is_bat, F.col(c)))

    def bowl(c):
        return F.sum(F.when(is_bowl, F.col(c)))

    of_phase = F.when(F.col("phase").isNotNull(), F.struct("role", "phase", "runs_tot", "balls"))
    return long.groupBy(*KEYS).agg(
        F.max(is_bat).alias("_has_bat"), F.max(is_bowl).alias("_has_bowl"),
        bat("runs_bat").cast("double").alias("runs_scored"), bat("balls").alias("balls_faced"),
        bat("fours").alias("fours"), bat("sixes").alias("sixes"), bat("boundaries").alias("boundaries"),
        bat("dots").alias("dot_balls"), bat("dismissals").alias("dismissals"),
        F.collect_list(of_phase).alias("_phase_rows"),
        bowl("runs_tot").cast("double").alias("runs_conceded"), bowl("balls").alias("balls_bowled"),
        bowl("wickets").alias("wickets"), bowl("dots").alias("dot_balls_bowling"),
    )


def phase_rows(sums: DataFrame) -> DataFrame:
    """The rows of the long table that have a phase, from ``player_match_sums``."""
    return sums.select(*KEYS, F.explode("_phase_rows").alias("r")).select(*KEYS, "r.*")


def _phase_map(role: str, value: str) -> Column:
    """Phase -> value of one role's ``_phase_rows``; a null phase has no entry."""
    of_role = F.filter("_phase_rows", lambda row: row["role"] == role)
    return F.map_from_entries(F.array_sort(F.transform(
        of_role, lambda row: F.struct(row["phase"], row[value].cast("double")))))


def league_map(league: DataFrame) -> Column:
    """Phase -> league run rate as a scalar subquery (one entry a phase)."""
    return league.filter(F.col("phase").isNotNull()).agg(
        F.map_from_entries(F.collect_list(F.struct("phase", "league_run_rate"))).alias("rates")).scalar()


def phase_efficacy(rates: Column, runs: str = "phase_runs", balls: str = "phase_balls") -> Column:
    """Σ over phases with balls of (league_rr · balls − 6 · runs) / Σ balls, from the row's own phase maps; no phases
    or no balls -> 0."""
    phases = F.map_keys(F.col(runs))

    def of(phase: Column, kind: str) -> Column:
        return F.coalesce(F.try_element_at(F.col(kind), phase), F.lit(0.0))

    def rate(phase: Column) -> Column:
        return F.coalesce(F.try_element_at(rates, phase), F.lit(0.0))

    def total(term) -> Column:
        return F.aggregate(phases, F.lit(0.0), lambda acc, ph: acc + F.when(of(ph, balls) != 0, term(ph)).otherwise(0.0))

    return safe_divide(total(lambda ph: rate(ph) * of(ph, balls) - of(ph, runs) * 6), total(lambda ph: of(ph, balls)))


def player_match_stats(deliveries: DataFrame, league: DataFrame | None = None,
                       long: DataFrame | None = None, sums: DataFrame | None = None) -> DataFrame:
    """Player-match statistics: batting and bowling sums, phase maps, the
    outer-join side indicator ``_merge``, the winner and ``team_won``, and the
    bowler's ``phase_efficacy`` against the league phase rates.

    ``league`` defaults to the unweighted mean over bowlers of their phase run
    rates (``league_phase_rate``), which has one row per phase. It and the rows
    are both taken from ``sums``, which callers store.
    """
    if sums is None:
        sums = player_match_sums(long if long is not None else player_phase_long(deliveries))
    if league is None:
        league = league_phase_rate(bowler_phase_stats(phase_rows(sums)))
    stats = sums.filter(F.col("match_id").isNotNull() & F.col("season").isNotNull()
                        & F.col("team").isNotNull() & F.col("player").isNotNull())
    stats = stats.withColumns({
        "phases": F.when(F.col("_has_bat"), _phase_map(BAT, "runs_tot")),
        "phase_runs": F.when(F.col("_has_bowl"), _phase_map(BOWL, "runs_tot")),
        "phase_balls": F.when(F.col("_has_bowl"), _phase_map(BOWL, "balls")),
        "_merge": F.when(F.col("_has_bat") & F.col("_has_bowl"), F.lit("both"))
                   .when(F.col("_has_bat"), F.lit("left_only")).otherwise(F.lit("right_only")),
    }).drop("_has_bat", "_has_bowl", "_phase_rows")
    # a column of its own: subqueries cannot stand inside the function over the phases
    stats = stats.withColumn("_rates", league_map(league)) \
        .withColumn("phase_efficacy", phase_efficacy(F.col("_rates"))).drop("_rates")
    return match_result(stats, match_winners(deliveries) if deliveries is not None else None)


def match_result(player_stats: DataFrame, winners: DataFrame | None) -> DataFrame:
    """Attach ``winning_team`` and ``team_won`` (null/no winner -> 0).

    The winners table has one row per match; its size grows with the data, so
    the join strategy is left to AQE (broadcast at runtime when it is small).
    """
    if winners is None:
        return player_stats.withColumns({"winning_team": F.lit(None).cast("string"),
                                         "team_won": F.lit(0)})
    out = player_stats.join(winners, "match_id", "left")
    return out.withColumn("team_won", F.coalesce(F.col("team") == F.col("winning_team"), F.lit(False)).cast("int"))


def _side(deliveries: DataFrame, team: str, player: str, **sums: Column) -> DataFrame:
    keys = [F.col("match_id"), F.col("season"), F.col(team).alias("team"), F.col(player).alias("player")]
    named = F.col("match_id").isNotNull() & F.col("season").isNotNull() & F.col(team).isNotNull() & \
        F.col(player).isNotNull()
    return deliveries.filter(named).groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])


def _flag(c: str) -> Column:
    return F.col(c).cast("long")


def batting_player_match(deliveries: DataFrame) -> DataFrame:
    """Batting sums per player-match: one aggregate of the deliveries."""
    return _side(deliveries, "batting_team", "batter", runs_scored=F.col("runs_batter"),
                 balls_faced=F.col("valid_ball").cast("long"), fours=_flag("is_four"), sixes=_flag("is_six"),
                 boundaries=_flag("is_boundary"),
                 dot_balls=(F.col("is_dot_ball") & (F.col("valid_ball") != 0)).cast("long"),
                 dismissals=_flag("batter_dismissed"))


def bowling_player_match(deliveries: DataFrame) -> DataFrame:
    """Bowling sums per player-match: one aggregate of the deliveries."""
    return _side(deliveries, "bowling_team", "bowler", runs_conceded=F.col("runs_total"),
                 balls_bowled=F.col("valid_ball").cast("long"), wickets=_flag("is_bowler_wicket"),
                 dot_balls_bowling=(F.col("is_dot_ball") & (F.col("valid_ball") != 0)).cast("long"))


def phase_map_long(player_stats: DataFrame, map_col: str = "phase_runs") -> DataFrame:
    """Explode a phase map column to ``(keys, phase, value)`` rows."""
    return player_stats.select(*KEYS, F.explode(F.col(map_col)).alias("phase", "value"))
