"""Profiles, the balanced best XI and the player explorer filter."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crease.operators.roles import primary_role, role_label_map
from crease.schema import ALLROUNDER, BATTING_ROLES, BOWLING_ROLES

TEAM_SIZE = 11
MAX_BATTERS, MAX_ALLROUNDERS = 5, 2


def player_profiles(ratings: DataFrame, volume: DataFrame, batter_mode: DataFrame, bowler_mode: DataFrame,
                    batter_labels: DataFrame, bowler_labels: DataFrame,
                    keys: Sequence[str] = ("player", "team", "season")) -> DataFrame:
    """Ratings ⟕ volumes (per player-team-season) ⟕ modal clusters (per player),
    roles from the label maps, volumes filled with 0, and the primary role."""
    p = ratings.join(volume, list(keys), "left").join(batter_mode, "player", "left").join(bowler_mode, "player", "left")
    p = p.fillna(0.0, subset=["balls_faced", "balls_bowled"])
    p = role_label_map(p, batter_labels, "batter_cluster", "batter_role")
    p = role_label_map(p, bowler_labels, "bowler_cluster", "bowler_role")
    return p.withColumn("primary_role", primary_role())


def xi_candidates(profiles: DataFrame, rating: str = "impact_rating") -> DataFrame:
    """``(pool, player, rating)``: the best ``TEAM_SIZE`` players of each pool (batters, all-rounders, bowlers, all),
    44 rows at most. No choice can need more: a pool is asked for 11 players at most, less those chosen before."""
    role = F.col("primary_role")
    pools = F.array(F.when(role.isin(*BATTING_ROLES), "bat"), F.when(role == ALLROUNDER, "all"),
                    F.when(role.isin(*BOWLING_ROLES), "bowl"), F.lit("any"))
    best = profiles.select("player", rating, F.explode(F.array_compact(pools)).alias("pool")) \
        .groupBy("pool", "player").agg(F.max(rating).alias("rating"))
    w = Window.partitionBy("pool").orderBy(F.col("rating").desc(), F.col("player").asc())
    return best.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= 2 * TEAM_SIZE)


def choose_xi(candidates: Sequence[tuple[str, str, int]]) -> list[str]:
    """Greedy choice from (pool, player, place in the pool): up to 5 batters, up to 2 all-rounders, bowlers to 11,
    then the best remaining players."""
    pools: dict[str, list[str]] = {}
    for pool, player, _ in sorted(candidates, key=lambda c: c[2]):
        pools.setdefault(pool, []).append(player)
    chosen: list[str] = []
    for pool, most in (("bat", MAX_BATTERS), ("all", MAX_ALLROUNDERS), ("bowl", TEAM_SIZE), ("any", TEAM_SIZE)):
        free = [p for p in pools.get(pool, []) if p not in chosen]
        chosen += free[:min(most, TEAM_SIZE - len(chosen))]
    return chosen


def best_xi(profiles: DataFrame, rating: str = "impact_rating", all_rows: bool = False) -> DataFrame:
    """The balanced XI: one best profile row per chosen player with ``rank_in_xi``
    (``all_rows`` returns every season row, quirk Q10). One aggregate brings the
    candidates (22 a pool at most) to the driver, where they are chosen from."""
    rows = xi_candidates(profiles, rating).select("pool", "player", "nth").collect()
    order = {name: i + 1 for i, name in enumerate(choose_xi([tuple(r) for r in rows]))}
    picked = profiles.filter(F.col("player").isin(*order)) if order else profiles.limit(0)
    w = Window.partitionBy("player").orderBy(F.col(rating).desc(), F.col("team").asc(), F.col("season").asc())
    if not all_rows:
        picked = picked.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    rank = F.create_map(*[x for kv in order.items() for x in (F.lit(kv[0]), F.lit(kv[1]))]) if order else None
    return picked.withColumn("rank_in_xi", rank[F.col("player")] if rank is not None else F.lit(None).cast("int"))


def player_explorer_filter(profiles: DataFrame, seasons: Sequence[int] | None = None,
                           teams: Sequence[str] | None = None, roles: Sequence[str] | None = None,
                           min_balls_faced: float = 30, min_balls_bowled: float = 12,
                           last_n_seasons: int = 3) -> DataFrame:
    """Season/team/role filters plus a workload floor (faced >= a OR bowled >= b).
    Default seasons: the latest ``last_n_seasons``. A floor is never above the
    largest workload there is. Both are scalar subqueries. Blank teams are shown
    as "Unlisted"."""
    most = profiles.agg(F.array(F.floor(F.max("balls_faced").cast("double")),
                                F.floor(F.max("balls_bowled").cast("double")))).scalar()
    p = profiles.withColumn("team", F.when(F.trim(F.coalesce(F.col("team"), F.lit(""))) == "", F.lit("Unlisted"))
                            .otherwise(F.col("team")))
    if seasons is None:
        top = p.select("season").distinct().orderBy(F.col("season").desc()).limit(last_n_seasons)
        cutoff = top.agg(F.min("season")).scalar()
        p = p.filter(F.col("season") >= cutoff)
    else:
        p = p.filter(F.col("season").isin(*seasons))
    if teams:
        p = p.filter(F.col("team").isin(*teams))
    if roles:
        p = p.filter(F.col("primary_role").isin(*roles))
    faced = F.least(F.lit(float(min_balls_faced)), F.coalesce(most[0], F.lit(0)).cast("double"))
    bowled = F.least(F.lit(float(min_balls_bowled)), F.coalesce(most[1], F.lit(0)).cast("double"))
    return p.filter((F.col("balls_faced") >= faced) | (F.col("balls_bowled") >= bowled))
