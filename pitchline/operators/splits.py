"""Holdouts, stratified splits and folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pitchline.operators.ordered import positions


def holdout_year(df: DataFrame, year: Column, holdout: int, order: Sequence[str], share: float = 0.8, **bounds) -> DataFrame:
    """Flag ``is_test``: the given year, or the last rows by position when it is empty."""
    has_year = df.filter(year == holdout).agg((F.count("*") > 0)).scalar()
    placed = positions(df, order, **bounds)
    cut = F.floor(F.lit(share) * df.agg(F.count("*")).scalar())
    return placed.withColumn("is_test", F.when(has_year, year == holdout).otherwise(F.col("pos") > cut)).drop("pos")


def split_by_position(df: DataFrame, order: Sequence[str], share: float, **bounds) -> DataFrame:
    """Flag ``is_test`` on everything after the first ``share`` of rows."""
    placed = positions(df, order, **bounds)
    cut = F.floor(F.lit(share) * df.agg(F.count("*")).scalar())
    return placed.withColumn("is_test", F.col("pos") > cut).drop("pos")


def spread(key: Column, seed: int = 31, modulus: int = 1009) -> Column:
    """Deterministic, engine-independent shuffle value of an integer key."""
    return (key * seed) % modulus


def stratified_split(df: DataFrame, label: str, key: str, share: float = 0.8, **bounds) -> DataFrame:
    """Flag ``is_test`` keeping the label mix: the first ``share`` of each label trains."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    placed = positions(df.withColumn("_h", spread(F.col(key))), ["_h", key], [label], **bounds)
    joined = placed.join(sizes, label)
    return joined.withColumn("is_test", F.col("pos") > F.floor(F.col("_size") * share)).drop("_h", "pos", "_size")


def stratified_folds(df: DataFrame, label: str, key: str, k: int, **bounds) -> DataFrame:
    """Column ``fold`` in 0..k-1, balanced within each label."""
    placed = positions(df.withColumn("_h", spread(F.col(key))), ["_h", key], [label], **bounds)
    return placed.withColumn("fold", ((F.col("pos") - 1) % k).cast("int")).drop("_h", "pos")
