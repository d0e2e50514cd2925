"""Encoding and model selection on a small frame."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from pitchline import presets as P
from pitchline.operators import encode as EN, models as M, splits as S
from pitchline.plans.model_queries import feature_frame, splits, stages
from pitchline.plans.views import Tables


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def test_cardinality_reducer(spark, tmp_path):
    df = spark.createDataFrame([(v,) for v in ["a"] * 5 + ["b"] * 3 + ["c"] * 3 + ["d"] + [None]], "x string")
    model = EN.CardinalityReducer(inputCols=["x"], minCount=2, maxValues=2).fit(df)
    seen = spark.createDataFrame([("a",), ("b",), ("c",), ("zz",), (None,), (P.UNKNOWN_PLAYER,)], "x string")
    want = ["a", "b", P.OTHER_PLAYER, P.OTHER_PLAYER, P.UNKNOWN_PLAYER, P.UNKNOWN_PLAYER]
    assert [r.x for r in model.transform(seen).collect()] == want
    model.write().overwrite().save(str(tmp_path / "m"))
    again = EN.CardinalityReducerModel.load(str(tmp_path / "m"))
    assert [r.x for r in again.transform(seen).collect()] == want


def test_folds_are_balanced(spark):
    df = spark.range(1000).select(F.col("id").alias("match_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    counts = {(r.label, r.fold): r["count"] for r in S.stratified_folds(df, "label", "match_id", 5).groupBy("label", "fold").count().collect()}
    assert set(counts.values()) == {50, 150} and len(counts) == 10


def test_out_of_fold_scores_each_row_once(tables):
    f = feature_frame(tables)
    oof = M.out_of_fold(f, stages(), M.learner("logistic"), 3)
    assert oof.count() == f.count() == oof.select("match_id").distinct().count()


def test_stacking_and_choice(tables):
    train, test = splits(tables)
    model = M.stack(train, stages(), {"l": M.learner("logistic"), "f": M.learner("forest", numTrees=3)}, 3, ["team1_form"])
    assert M.score(model, test).count() == test.count()
    table = train.sparkSession.createDataFrame(
        [("a", 0.9, 0.30, 0.7), ("b", 0.8, 0.05, 0.6)], "model string, generalization double, fit_gap double, test_accuracy double")
    pick = lambda gap: [r.model for r in M.choose(table, max_gap=gap).filter("deploy").collect()]
    assert pick(None) == ["a"] and pick(0.1) == ["b"] and pick(0.01) == ["a"]


def test_candidates_are_reproducible():
    space = {"a": [1, 2, 3], "b": (0.1, 0.2)}
    assert M.draw_candidates(space, 5) == M.draw_candidates(space, 5)
    assert all(0.1 <= c["b"] <= 0.2 for c in M.draw_candidates(space, 20))


def test_bundle_round_trip(spark, tables, tmp_path):
    from pitchline.sources import tables as T

    train, test = splits(tables)
    model = M.fit(train, stages(), M.learner("logistic"))
    T.save_model(model, {"target": "label"}, str(tmp_path / "b"), spark)
    again, meta = T.load_model(str(tmp_path / "b"), spark)
    assert isinstance(again, PipelineModel) and meta == {"target": "label"}
    key = lambda m: sorted(tuple(r) for r in M.score(m, test).collect())
    assert key(model) == key(again)


def test_many_values_become_a_table(spark, tmp_path):
    """A dictionary of 300,000 values, never listed anywhere, gives the places of the sorted values."""
    rows = spark.range(300_000).select(F.sha1(F.col("id").cast("string")).alias("x"), (F.col("id") % 7).cast("string").alias("y"))
    model = EN.ValueIndexer(inputCols=["x", "y"], outputCols=["i", "j"], planValues=1000).fit(rows)
    assert isinstance(model, EN.ValueIndexerModel)
    model.write().overwrite().save(str(tmp_path / "m"))
    out = EN.ValueIndexerModel.load(str(tmp_path / "m")).transform(rows.unionAll(spark.createDataFrame([("none", None)], "x string, y string")))
    want = {x: i for i, x in enumerate(sorted(r.x for r in rows.collect()))}
    got = out.select("x", "i", "y", "j").collect()
    assert len(got) == 300_001
    for r in got:
        assert r.i == want.get(r.x, 300_000) and r.j == (7 if r.y is None else int(r.y))


def test_both_indexers_agree(spark):
    rows = spark.createDataFrame([(v,) for v in ["b", "a", None, "Ä", "é", "Z", "😀", "￿", ""]], "x string")
    few, table = (EN.ValueIndexer(inputCols=["x"], outputCols=["i"], planValues=n).fit(rows).transform(rows) for n in (100, 0))
    assert sorted(map(str, few.collect())) == sorted(map(str, table.select(few.columns).collect()))


def test_many_frequent_values_stay_a_table(spark):
    rows = spark.range(4000).select((F.col("id") % 1500).cast("string").alias("x"))
    few, table = (EN.CardinalityReducer(inputCols=["x"], minCount=3, maxValues=0, planValues=n).fit(rows) for n in (10_000, 10))
    asked = rows.unionAll(spark.createDataFrame([(None,), ("new",), (P.UNKNOWN_PLAYER,)], "x string"))
    assert table.getOrDefault("path") and not few.getOrDefault("path")
    assert sorted(r.x for r in few.transform(asked).collect()) == sorted(r.x for r in table.transform(asked).collect())


def test_encoders_are_fitted_once_per_fold(tables, monkeypatch):
    train, _ = splits(tables)
    fits = []
    old = EN.MostFrequentFill._fit
    monkeypatch.setattr(EN.MostFrequentFill, "_fit", lambda self, df: fits.append(1) or old(self, df))
    cands = M.draw_candidates({"regParam": [0.001, 0.01, 0.1]}, 3)
    found = M.search(M.encoded_folds(train, stages(), 3), "logistic", cands)
    assert len(fits) == 3 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    fits.clear()
    trace = M.halving(train, stages(), "logistic", cands, 3, "spread")
    assert len(fits) == 3 and [share for share, _, _ in trace] == [0.25] * 3 + [0.5]


def test_models_on_the_same_rows_share_encoders(tables, monkeypatch):
    train, test = splits(tables)
    apart = [M.score(M.fit(train, stages(), M.learner("forest", s, numTrees=3)), test).select("match_id", "p1") for s in (1, 2)]
    want = {r.match_id: r.p1 for r in apart[0].unionAll(apart[1]).groupBy("match_id").agg(F.avg("p1").alias("p1")).collect()}
    fits = []
    old = EN.MostFrequentFill._fit
    monkeypatch.setattr(EN.MostFrequentFill, "_fit", lambda self, df: fits.append(1) or old(self, df))
    got = M.seed_average(train, test, stages(), "forest", [1, 2], numTrees=3).collect()
    assert len(fits) == 1 and len(got) == len(want) and all(abs(r.p1 - want[r.match_id]) < 1e-9 for r in got)
    fits.clear()
    M.stack(train, stages(), {"a": M.learner("logistic"), "b": M.learner("logistic", regParam=0.1)}, 3, ["team1_form"])
    assert len(fits) == 4  # three folds, and all rows


def test_search_on_folds_equals_fitting_whole_pipelines(tables):
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    train, _ = splits(tables)
    (params, got), = M.search(M.encoded_folds(train, stages(), 3), "logistic", [{"regParam": 0.05}])
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName="f1")
    parts = [judge.evaluate(Pipeline(stages=[*stages(), M.learner("logistic", **params)]).fit(train.filter(F.col("fold") != i)).transform(
        train.filter(F.col("fold") == i))) for i in range(3)]
    assert abs(got - sum(parts) / 3) < 1e-6
