"""Sliced history equals plain history, whatever the skew."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.operators.ordered import (
    SLICE, SLICES_CONF, _slices_joined, Latest, Recent, Total, exact_median, exact_quantiles, history_context, long_keys, modes, positions, sliced_by, slices_of, top_n,
    with_history,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.6 else rng.choice("abcde"), d // 4, i, rng.randint(0, 50), None if rng.random() < 0.3 else i)
            for i, d in enumerate(rng.sample(range(4000), 600))]
    return spark.createDataFrame(rows, "k string, day int, id bigint, v int, opt bigint")


SPECS = lambda: [
    Total("n", F.lit(1), "count"), Total("s", F.col("v")), Total("hi", F.col("v"), "max"), Total("s_in", F.col("v"), inclusive=True),
    Recent("avg5", F.col("v"), 5), Recent("prev", F.col("v"), 1, "last"), Recent("sum3", F.col("v"), 3, "sum", True),
    Recent("l4", F.col("v"), 4, "list"), Latest("opt_before", F.col("opt")),
]


def as_rows(df):
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def brute(rows):
    out = {}
    for key in {r.k for r in rows}:
        past = []
        for r in sorted((r for r in rows if r.k == key), key=lambda r: (r.day, r.id)):
            vs = [p.v for p in past]
            opts = [p.opt for p in past if p.opt is not None]
            out[r.id] = (len(vs), sum(vs) if vs else None, max(vs, default=None), sum(vs) + r.v, np.mean(vs[-5:]) if vs else None,
                         vs[-1] if vs else None, sum((vs + [r.v])[-3:]), vs[-4:], opts[-1] if opts else None)
            past.append(r)
    return out


@pytest.fixture(params=[1, 3, 16, 100])
def slices(spark, request):
    spark.conf.set(SLICES_CONF, request.param)
    yield request.param
    spark.conf.unset(SLICES_CONF)


def test_history_equals_brute_force(skewed, slices):
    got = with_history(skewed, ["k"], ["day", "id"], SPECS()).collect()
    want = brute(skewed.collect())
    assert len(got) == len(want)
    for r in got:
        w = want[r.id]
        assert (r.n, r.s, r.hi, r.s_in, r.prev, r.sum3, r.l4, r.opt_before) == (w[0], w[1], w[2], w[3], w[5], w[6], w[7], w[8])
        assert (r.avg5 is None) == (w[4] is None) and (w[4] is None or abs(r.avg5 - w[4]) < 1e-9)


def test_context_continues_where_the_last_batch_ended(skewed, slices):
    order, keys = ["day", "id"], ["k"]
    whole = as_rows(with_history(skewed, keys, order, SPECS()))
    context, parts = None, []
    for lo, hi in ((0, 200), (200, 650), (650, 1001)):
        batch = skewed.filter((F.col("day") >= lo) & (F.col("day") < hi))
        parts += as_rows(with_history(batch, keys, order, SPECS(), context=context))
        context = history_context(batch, keys, order, SPECS(), context)
    assert sorted(parts) == whole
    # State is bounded by keys: one totals row and at most four carried rows each.
    assert context.groupBy("k").count().agg(F.max("count")).first()[0] <= 6


def test_positions_are_a_permutation(skewed):
    got = [r.pos for r in positions(skewed, ["day", "id"]).orderBy("day", "id").collect()]
    assert got == list(range(1, len(got) + 1))


def test_quantiles_match_numpy(skewed):
    v = np.array([r.v for r in skewed.collect()])
    got = exact_quantiles(skewed, "v", {"a": 0.25, "b": 0.5, "c": 0.9}).first()
    assert np.allclose([got.a, got.b, got.c], np.quantile(v, [0.25, 0.5, 0.9]))
    per = {r.k: r.median for r in exact_median(skewed, "v", ["k"]).collect()}
    for k in per:
        assert per[k] == np.median([r.v for r in skewed.collect() if r.k == k])


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", "c"), ("y", "c"), ("y", "a"), ("z", None)], "g string, v string")
    assert {(r.g, r.mode) for r in modes(df, ["g"], "v").collect()} == {("x", "a"), ("y", "c")}


def test_top_n_limits_before_the_shuffle(skewed):
    plan = top_n(skewed, ["k"], [F.col("v").desc(), F.col("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def shares(df, order):
    """Greatest slice over the mean, as with_history would cut the rows."""
    n = slices_of(df)
    counts = [r["count"] for r in sliced_by(df, order).groupBy(SLICE).count().collect()]
    return max(counts) * n / sum(counts)


@pytest.mark.parametrize("n", [8, 100])
def test_slices_hold_about_equal_counts(spark, n):
    spark.conf.set(SLICES_CONF, n)
    try:
        ids = spark.range(20_000)
        outlier = ids.select(F.when(F.col("id") == 7, F.lit("9999-12-31")).when(F.col("id") == 8, F.lit("0001-01-01"))
                             .otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 900).cast("int")).cast("string"))
                             .cast("date").alias("day"), "id")
        assert shares(outlier, ["day", "id"]) < 2
        assert shares(outlier.withColumn("day", F.lit("2020-01-01").cast("date")), ["day", "id"]) < 2  # one day owns all rows
        texts = ids.select(F.concat(F.lit("the same long beginning "), F.sha1(F.col("id").cast("string"))).alias("t"), "id")
        assert shares(texts.unionAll(spark.createDataFrame([("zzz", -1), ("", -2)], texts.schema)), ["t"]) < 2
        assert shares(ids.select(F.pow(F.lit(1.001), F.col("id")).alias("x")), ["x"]) < 2
    finally:
        spark.conf.unset(SLICES_CONF)


def test_slice_numbers_follow_the_order(spark):
    """Whatever the number of cuts, and however they are searched, a later row is in no earlier slice."""
    rows = spark.range(5_000).select((F.col("id") * 7919 % 5003).alias("v"))
    for n in (2, 32, 33, 64, 65, 200):
        spark.conf.set(SLICES_CONF, n)
        got = [r[SLICE] for r in sliced_by(rows, ["v"]).orderBy("v").collect()]
        spark.conf.unset(SLICES_CONF)
        assert got == sorted(got) and got[0] == 0 and n * 0.8 < len(set(got)) <= n and max(got) <= n - 1


def test_cuts_stand_once_in_each_branch(skewed, spark):
    """The search of a slice adds no copy of the subquery per step: plans stay small however many slices there are."""
    spark.conf.set(SLICES_CONF, 100)
    try:
        tagged = sliced_by(skewed, ["day", "id"])
        assert tagged.columns == [*skewed.columns, SLICE]
        assert tagged._jdf.queryExecution().optimizedPlan().toString().count("scalar-subquery#") == 1
    finally:
        spark.conf.unset(SLICES_CONF)


def test_only_long_keys_are_cut(spark, slices):
    """Each row in as few slices as its key needs, and every result as with plain windows, unknown keys included."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 != 1, F.concat(F.lit("k"), F.col("id") % 700)).alias("k"),
        (F.col("id") * 7 % 1009).alias("day"), "id", (F.col("id") % 51).alias("v"), F.when(F.col("id") % 4 == 0, F.col("id")).alias("opt"))
    long = long_keys(rows, ["k"], 300)
    assert [(r["_k_k"], r["_parts"]) for r in long.collect()] == [("hot", 4)]
    got = with_history(rows, ["k"], ["day", "id"], SPECS(), long=long)
    want = brute(rows.collect())
    found = got.collect()
    assert len(found) == len(want) == 3000
    for r in found:
        w = want[r.id]
        assert (r.n, r.s, r.hi, r.s_in, r.prev, r.sum3, r.l4, r.opt_before) == (w[0], w[1], w[2], w[3], w[5], w[6], w[7], w[8])
    cut = _slices_joined(sliced_by(rows, ["day", "id"]), ["k"], long).groupBy("k").agg(F.countDistinct(SLICE).alias("n")).collect()
    assert {r.n for r in cut if r.k != "hot"} == {1} and {r.n for r in cut if r.k == "hot"} == {min(slices, 4)}


def test_recent_counted_rows_by_brute_force(skewed, slices):
    known = F.col("opt").isNotNull()
    specs = [Recent("a3", F.col("v"), 3, where=known), Recent("l2", F.col("v"), 2, "list", where=known), Total("n", F.when(known, 1), "count")]
    got = {r.id: r for r in with_history(skewed, ["k"], ["day", "id"], specs).collect()}
    rows = skewed.collect()
    for key in {r.k for r in rows}:
        past = []
        for r in sorted((r for r in rows if r.k == key), key=lambda r: (r.day, r.id)):
            g = got[r.id]
            assert sorted(g.l2) == sorted(past[-2:]) and g.n == len(past)
            assert (g.a3 is None) == (not past) and (not past or abs(g.a3 - np.mean(past[-3:])) < 1e-9)
            if r.opt is not None:
                past.append(r.v)
    with pytest.raises(ValueError):
        with_history(skewed, ["k"], ["day", "id"], [*specs, Recent("x", F.col("v"), 2)])


def test_counted_context_continues(skewed, slices):
    specs = [Recent("a3", F.col("v"), 3, where=F.col("opt").isNotNull()), Total("n", F.lit(1), "count")]
    whole = as_rows(with_history(skewed, ["k"], ["day", "id"], specs))
    early, late = skewed.filter("day < 400"), skewed.filter("day >= 400")
    context = history_context(early, ["k"], ["day", "id"], specs)
    parts = as_rows(with_history(early, ["k"], ["day", "id"], specs)) + as_rows(with_history(late, ["k"], ["day", "id"], specs, context=context))
    assert sorted(parts) == whole
