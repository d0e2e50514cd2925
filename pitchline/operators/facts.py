"""Fact tables: innings totals, team-long rows and side-by-side results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def innings_totals(
    deliveries: DataFrame, keys: Sequence[str], powerplay_until: int = 6, death_from: int = 16
) -> DataFrame:
    """Runs, deliveries, wickets, powerplay and death runs; every delivery counts."""
    over = F.col("over_no")
    return deliveries.groupBy(*keys).agg(
        F.sum("runs").alias("runs"),
        F.count("*").alias("balls"),
        F.sum("wicket").alias("wkts"),
        F.sum(F.when(over < powerplay_until, F.col("runs")).otherwise(0)).alias("pp_runs"),
        F.sum(F.when(over >= death_from, F.col("runs")).otherwise(0)).alias("death_runs"),
    )


def innings_wide(deliveries: DataFrame, powerplay_until: int = 6, death_from: int = 16) -> DataFrame:
    """Totals of both sides as ``<value>_1`` / ``<value>_2`` per match.

    One aggregation straight from the deliveries: they are shuffled once, as
    one partial row per match and map task, and stay partitioned for joins on
    the match id.
    """
    over, runs = F.col("over_no"), F.col("runs")
    values = {
        "runs": runs, "balls": F.lit(1).cast("bigint"), "wkts": F.col("wicket").cast("bigint"),
        "pp_runs": F.when(over < powerplay_until, runs), "death_runs": F.when(over >= death_from, runs),
    }
    return deliveries.groupBy("match_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("side") == s, v)), F.lit(0).cast("bigint")).alias(f"{n}_{s}")
        for s in (1, 2) for n, v in values.items()
    ])


def batting_order(innings: DataFrame) -> DataFrame:
    """Side that batted first and second per match, from the innings number."""
    pos = F.col("innings_no")
    return innings.groupBy("match_id").agg(
        F.min_by("team", pos).alias("batting_first"),
        F.max(F.when(pos == 1, F.col("team"))).alias("batting_second"),
    )


def team_long(matches: DataFrame, extra: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Two rows per match in one pass; ``extra`` maps a name to (side 1, side 2) values."""
    extra = extra or {}

    def row(side: int) -> Column:
        me, other = ("team1", "team2") if side == 1 else ("team2", "team1")
        return F.struct(
            F.lit(side).alias("side"), F.col(me).alias("team"), F.col(other).alias("opponent"),
            *[pair[side - 1].alias(n) for n, pair in extra.items()],
        )

    return matches.withColumn("_r", F.explode(F.array(row(1), row(2)))).select(*matches.columns, "_r.*")


def both_sides(long: DataFrame, keys: Sequence[str], values: Sequence[str], prefix: str = "team") -> DataFrame:
    """Long rows back to one row per match: ``team1_<value>``, ``team2_<value>``."""
    return long.groupBy(*keys).agg(*[
        F.max(F.when(F.col("side") == s, F.col(v))).alias(f"{prefix}{s}_{v}") for s in (1, 2) for v in values
    ])
