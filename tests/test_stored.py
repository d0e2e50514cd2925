"""What is stored between steps, and what is read of it."""

from pyspark.sql import functions as F

from pitchline.operators import ratings
from pitchline.plans.views import Tables
from pitchline.session import stored


def test_stored_rows_are_the_rows(spark):
    df = spark.createDataFrame([(1, "a", ["x", None]), (2, None, None), (2, None, None)], "id bigint, k string, xs array<string>")
    got = stored(df.repartition("k"))
    assert got.schema == df.schema and sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    by = stored(df, "id")
    assert sorted(by.columns) == sorted(df.columns) and by.filter("id = 2").count() == 2
    assert stored(df.filter("false")).count() == 0


def test_one_slice_of_a_rating_reads_its_own_rows(spark):
    df = spark.range(1000).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("match_date"),
                                  F.col("id").alias("match_id"))
    sliced = ratings.cut_into_slices(df, ratings.ORDER, 5)
    assert sliced.columns == ["match_date", "match_id", ratings.SLICE] and sliced.count() == 1000
    edges = [r for r in sliced.groupBy(ratings.SLICE).agg(F.min(F.struct(*ratings.ORDER)).alias("lo"), F.max(F.struct(*ratings.ORDER)).alias("hi"))
             .orderBy(ratings.SLICE).collect()]
    assert len(edges) == 5 and all(a.hi < b.lo for a, b in zip(edges, edges[1:]))
    part = sliced.filter(F.col(ratings.SLICE) == 2)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_slice" in plan
    assert all(f"{ratings.SLICE}=2/" in r.f for r in part.select(F.col("_metadata.file_path").alias("f")).distinct().collect())


def test_lineups_take_one_shuffle(spark, tmp_path):
    rows = [(1, 2, 1, 4.0, "R"), (1, 2, 2, 1.0, "N"), (1, 4, 3, 0.0, "N"), (1, 3, 4, 6.0, "N"), (2, None, 1, 1.0, "N")]
    spark.createDataFrame(rows, "l_orderkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    lineups = Tables(spark, str(tmp_path)).lineups
    assert {(r.match_id, r.side): r.players for r in lineups.collect()} == {
        (1, 1): ["Player 2", "Player 4"], (1, 2): ["Player 3"], (2, None): []}
    assert lineups._jdf.queryExecution().sparkPlan().toString().count("ObjectHashAggregate") == 2
    assert Tables(spark, str(tmp_path)).lineups._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
