"""Profiles, ratings from seasons and recent-history snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pitchline import presets as P
from pitchline.functions import rules as R, text as X
from pitchline.operators.ordered import modes, top_n
from pitchline.session import durable


def team_profiles(sides: DataFrame, values: Sequence[str]) -> DataFrame:
    """Mean of each skill per team over both roles."""
    return sides.groupBy("team").agg(*[F.avg(c).alias(c) for c in values])


def venue_profiles(df: DataFrame, venue: str, means: Sequence[str], mode_of: Sequence[str]) -> DataFrame:
    """Means, toss-win share and most frequent categories per venue."""
    out = df.groupBy(venue).agg(
        *[F.avg(c).alias(c) for c in means],
        F.avg(R.flag(F.col("toss_winner") == F.col("winner"))).alias("toss_advantage"),
    )
    for c in mode_of:
        out = out.join(modes(df, [venue], c, c), venue, "left")
    return out


def batting_score(runs: Column, innings: Column, strike_rate: Column, fours: Column, sixes: Column,
                  fifties: Column, hundreds: Column) -> Column:
    per = runs / F.when(innings == 0, 1).otherwise(innings)
    return per * 2.0 + strike_rate / 20.0 + (fours + sixes) / 5.0 + fifties * 1.5 + hundreds * 4.0


def bowling_score(wickets: Column, innings: Column, dot_share: Column, economy: Column, maidens: Column) -> Column:
    per = wickets / F.when(innings == 0, 1).otherwise(innings)
    return per * 25.0 + dot_share / 2.0 + F.greatest(F.lit(0.0), 9.0 - economy) * 8.0 + maidens * 2.0


def number_or_zero(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def recency_weighted(df: DataFrame, keys: Sequence[str], score: str, weight: Column, name: str) -> DataFrame:
    """Weighted mean of a score per key."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(
        (F.sum(F.col(score) * weight) / F.when(total == 0, 1.0).otherwise(total)).alias(name))


def rating_scale(df: DataFrame, score: str, name: str = "rating", digits: int = 3) -> DataFrame:
    """1000 + 150·z with population deviation; a constant score rates 1000."""
    stats = df.agg(F.struct(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))).scalar()
    z = df.withColumn("_s", stats)
    std = F.when(F.col("_s.std") > 1e-9, F.col("_s.std")).otherwise(1.0)
    value = P.START_RATING + P.RATING_SCALE * ((F.col(score) - F.col("_s.mean")) / std)
    return z.withColumn(name, F.bround(value, digits)).drop("_s")


def player_ratings(seasons: DataFrame) -> DataFrame:
    """Season rows (player, season, batting_raw, bowling_raw) to one rating per player, in one aggregation."""
    w = R.season_weight(F.col("season"), P.RATING_SEASON_WEIGHTS)
    total = F.sum(w)
    mean = lambda score: F.sum(F.col(score) * w) / F.when(total == 0, 1.0).otherwise(total)
    both = seasons.groupBy(X.join_key(F.col("player")).alias("player_key")).agg(
        mean("batting_raw").alias("batting_score"), mean("bowling_raw").alias("bowling_score")).fillna(0.0)
    both = both.withColumn("performance", 0.60 * F.col("batting_score") + 0.40 * F.col("bowling_score"))
    # One row per player, read twice: for the mean and deviation, and for the ratings.
    return rating_scale(durable(both), "performance")


def missing_share(df: DataFrame) -> DataFrame:
    """Percentage of nulls per column, one row per column."""
    shares = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in df.columns])
    return shares.unpivot([], df.columns, "column_name", "missing_pct")


def distinct_profile(df: DataFrame, columns: Sequence[str], show: int = 10) -> DataFrame:
    """Distinct count per column; the values themselves when there are few."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "v")
    values = long.filter(F.col("v").isNotNull()).distinct()
    counts = values.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    few = top_n(values, ["column_name"], [F.col("v")], show).groupBy("column_name").agg(
        F.concat_ws("|", F.sort_array(F.collect_list("v"))).alias("shown"))
    out = counts.join(few, "column_name")
    return out.select("column_name", "n_distinct", F.when(F.col("n_distinct") <= show, F.col("shown")).alias("shown"))


def team_snapshot(long: DataFrame, teams: DataFrame, values: dict[str, float], n: int = 5) -> DataFrame:
    """Means over each team's last n completed matches; defaults for teams without any."""
    order = [F.col("match_date").desc(), F.col("match_id").desc()]
    last = top_n(long.filter(F.col("winner").isNotNull()), ["team"], order, n)
    agg = last.groupBy("team").agg(*[F.avg(c).alias(c) for c in values], F.max_by("match_id", F.struct(
        "match_date", "match_id")).alias("as_of_match_id"))
    return teams.join(agg, "team", "left").fillna(values)


def recent_venue_stats(log: DataFrame, n: int = 20) -> DataFrame:
    """Mean first score and toss share over the last n closed rows of a venue."""
    order = [F.col("match_date").desc(), F.col("match_id").desc()]
    last = top_n(log.filter(F.col("actual").isNotNull()), ["venue"], order, n)
    toss = (F.col("toss_winner").isNotNull()) & (F.col("toss_winner") != "")
    return last.groupBy("venue").agg(
        F.coalesce(F.avg("first_score"), F.lit(170.0)).alias("avg_score"),
        F.coalesce(F.avg(F.when(toss, R.flag(F.col("toss_winner") == F.col("actual")))), F.lit(0.5)).alias("toss_share"),
    )


def recent_team_form(log_long: DataFrame, n: int = 5) -> DataFrame:
    """Win share over the last n closed rows of a team."""
    order = [F.col("match_date").desc(), F.col("match_id").desc()]
    last = top_n(log_long.filter(F.col("actual").isNotNull()), ["team"], order, n)
    return last.groupBy("team").agg(F.avg(R.flag(F.col("actual") == F.col("team"))).alias("recent_form"))


def hit_rate(log: DataFrame) -> DataFrame:
    """Closed predictions, hits and their share."""
    hit = R.flag(F.col("predicted") == F.col("actual"))
    closed = log.filter(F.col("actual").isNotNull()).agg(
        F.count("*").alias("closed"), F.coalesce(F.sum(hit), F.lit(0)).alias("hits"))
    return closed.withColumn("hit_rate", F.col("hits") / F.nullif(F.col("closed"), F.lit(0)))


def summary(df: DataFrame, columns: Sequence[str], **bounds) -> DataFrame:
    """count, mean, std, min, quartiles and max per numeric column, one row each."""
    from pitchline.operators.ordered import exact_quantiles

    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "v")
    basic = long.groupBy("column_name").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = exact_quantiles(long, "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["column_name"], **bounds)
    return basic.join(q, "column_name")
