"""Training and model selection on MLlib.

Trees and solvers are MLlib's own distributed ones.  Loops here run over
candidates and folds, never over rows; metrics come from one aggregation.
"""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from pitchline.operators.evaluate import fit_gaps, log_loss
from pitchline.session import durable

LABEL = "label"


def learner(kind: str, seed: int = 42, **params):
    """A classifier by name; ``extra_trees`` uses all rows per tree with best (not random) thresholds."""
    if kind == "logistic":
        return LogisticRegression(labelCol=LABEL, **{"maxIter": 50, "regParam": 0.01, **params})
    if kind == "forest":
        return RandomForestClassifier(labelCol=LABEL, seed=seed, **{"numTrees": 20, "maxDepth": 5, **params})
    if kind == "extra_trees":
        return RandomForestClassifier(labelCol=LABEL, seed=seed, bootstrap=False,
                                      **{"numTrees": 20, "maxDepth": 5, "featureSubsetStrategy": "sqrt", **params})
    if kind == "boosted":
        return GBTClassifier(labelCol=LABEL, seed=seed, **{"maxIter": 10, "maxDepth": 3, **params})
    if kind == "boosted_ovr":
        return OneVsRest(labelCol=LABEL, classifier=GBTClassifier(labelCol=LABEL, seed=seed, **{"maxIter": 5, "maxDepth": 3, **params}))
    raise ValueError(f"unknown learner: {kind}")


def fit(train: DataFrame, stages: Sequence, clf) -> PipelineModel:
    return Pipeline(stages=[*stages, clf]).fit(train)


def fitted(train: DataFrame, stages: Sequence) -> list:
    """The stages as fitted on these rows: models that learn from the same rows share them."""
    return list(Pipeline(stages=list(stages)).fit(train).stages)


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str] = ("match_id",)) -> DataFrame:
    """keep columns, label, p1 and the predicted class."""
    out = model.transform(df)
    if "probability" in out.columns:
        p1 = vector_to_array("probability")[1]
    else:  # one boosted model per class: its margin as a probability, normalised over the classes
        per_class = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        p1 = per_class[1] / F.aggregate(per_class, F.lit(0.0), lambda a, x: a + x)
    return out.select(*keep, F.col(LABEL).cast("int").alias(LABEL), p1.alias("p1"), F.col("prediction").cast("int").alias("pred"))


def metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """accuracy, weighted F1 and log loss per group, from one pass of counts."""
    y, p = F.col(LABEL), F.col("pred")
    hit = lambda a, b: F.sum(((y == a) & (p == b)).cast("int"))
    p_true = F.when(y == 1, F.col("p1")).otherwise(1 - F.col("p1"))
    c = scored.groupBy(*by).agg(F.count("*").alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"),
                                hit(1, 0).alias("fn"), hit(0, 0).alias("tn"), log_loss(p_true).alias("log_loss"))
    tp, fp, fn, tn, n = (F.col(x) for x in ("tp", "fp", "fn", "tn", "n"))
    f1 = lambda t: F.coalesce(2 * t / F.nullif(2 * t + fp + fn, F.lit(0)), F.lit(0.0))
    weighted = (f1(tp) * (tp + fn) + f1(tn) * (tn + fp)) / n
    return c.select(*by, "n", ((tp + tn) / n).alias("accuracy"), weighted.alias("f1"), "log_loss")


def train_and_test_metrics(models: Mapping[str, PipelineModel], train: DataFrame, test: DataFrame) -> DataFrame:
    """One row per model with both splits and the fit gaps."""
    parts = [score(m, df).withColumns({"model": F.lit(name), "split": F.lit(split)})
             for name, m in models.items() for split, df in (("train", train), ("test", test))]
    m = metrics(reduce(DataFrame.unionByName, parts), ["model", "split"])
    pick = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    return fit_gaps(m.groupBy("model").agg(*[pick(s, c) for s in ("train", "test") for c in ("accuracy", "f1", "log_loss")]))


def fold_encoders(df: DataFrame, stages: Sequence, k: int, fold: str = "fold") -> list[list]:
    """The stages per fold, as fitted on all rows outside it."""
    return [fitted(df.filter(F.col(fold) != i), stages) for i in range(k)]


def out_of_fold(df: DataFrame, stages: Sequence, clf, k: int, fold: str = "fold", encoders: Sequence[Sequence] | None = None) -> DataFrame:
    """Every row scored by a model that never saw its fold; ``encoders`` are its ``fold_encoders`` where several models share them."""
    own = encoders or [stages] * k
    parts = [score(fit(df.filter(F.col(fold) != i), own[i], clf), df.filter(F.col(fold) == i), ("match_id", fold)) for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


class Stacked:
    """Base models on the raw features, a logistic model on their scores plus those features."""

    def __init__(self, bases: dict[str, PipelineModel], meta: PipelineModel):
        self.bases, self.meta = bases, meta

    def transform(self, df: DataFrame) -> DataFrame:
        return self.meta.transform(with_base_scores(df, {n: score(m, df) for n, m in self.bases.items()}))


def with_base_scores(df: DataFrame, scores: Mapping[str, DataFrame]) -> DataFrame:
    for name, s in scores.items():
        df = df.join(s.select("match_id", F.col("p1").alias(f"base_{name}")), "match_id")
    return df


def stack(train: DataFrame, stages: Sequence, bases: Mapping[str, object], k: int, meta_columns: Sequence[str]) -> Stacked:
    """Meta model learns from out-of-fold scores; bases are then refitted on all rows."""
    encoders, whole = fold_encoders(train, stages, k), fitted(train, stages)
    oof = {n: out_of_fold(train, stages, clf, k, encoders=encoders) for n, clf in bases.items()}
    frame = with_base_scores(train, oof)
    inputs = VectorAssembler(inputCols=[*[f"base_{n}" for n in bases], *meta_columns], outputCol="features", handleInvalid="keep")
    meta = fit(frame.fillna(0.0, list(meta_columns)), [inputs], learner("logistic"))
    return Stacked({n: fit(train, whole, clf) for n, clf in bases.items()}, meta)


def seed_average(train: DataFrame, df: DataFrame, stages: Sequence, kind: str, seeds: Sequence[int], **params) -> DataFrame:
    """Mean probability over models that differ by seed only."""
    whole = fitted(train, stages)
    parts = [score(fit(train, whole, learner(kind, s, **params)), df) for s in seeds]
    mean = reduce(DataFrame.unionByName, parts).groupBy("match_id", LABEL).agg(F.avg("p1").alias("p1"))
    return mean.withColumn("pred", (F.col("p1") >= 0.5).cast("int"))


def draw_candidates(space: Mapping[str, Sequence | tuple[float, float]], n: int, seed: int = 7) -> list[dict]:
    """n different parameter sets: a list is drawn from, a (low, high) pair of floats is uniform."""
    rng = random.Random(seed)
    uniform = lambda v: isinstance(v, tuple) and len(v) == 2 and all(isinstance(x, float) for x in v)
    one = lambda: {k: rng.uniform(*v) if uniform(v) else rng.choice(list(v)) for k, v in space.items()}
    if not any(uniform(v) for v in space.values()):
        n = min(n, math.prod(len(v) for v in space.values()))
    out: list[dict] = []
    while len(out) < n:  # none twice
        candidate = one()
        if candidate not in out:
            out.append(candidate)
    return out


def encoded_folds(train: DataFrame, stages: Sequence, k: int, fold: str = "fold", keep: Sequence[str] = ()) -> list[tuple[DataFrame, DataFrame]]:
    """(learning rows, held-out rows) per fold, encoded by stages that saw the learning rows only, stored once for all candidates."""
    out = []
    for i in range(k):
        rest, held = train.filter(F.col(fold) != i), train.filter(F.col(fold) == i)
        model = Pipeline(stages=list(stages)).fit(rest)
        out.append(tuple(durable(model.transform(df).select(LABEL, "features", *keep)) for df in (rest, held)))
    return out


def search(folds: Sequence[tuple[DataFrame, DataFrame]], kind: str, candidates: Sequence[dict], metric: str = "f1",
           parallelism: int = 4) -> list[tuple[dict, float]]:
    """Cross-validated score per candidate over stored encoded folds, best first."""
    clf, judge = learner(kind), MulticlassClassificationEvaluator(labelCol=LABEL, metricName=metric)
    tasks = [(j, {clf.getParam(p): v for p, v in c.items()}, *fold) for j, c in enumerate(candidates) for fold in folds]
    sums = [0.0] * len(candidates)
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        run = inheritable_thread_target(folds[0][0].sparkSession)(lambda t: (t[0], judge.evaluate(clf.fit(t[2], t[1]).transform(t[3]))))
        for j, value in pool.map(run, tasks):
            sums[j] += value
    return sorted(zip(candidates, [s / len(folds) for s in sums]), key=lambda r: (-r[1], str(r[0])))


def halving(train: DataFrame, stages: Sequence, kind: str, candidates: Sequence[dict], k: int, spread: str,
            start: float = 0.25) -> list[tuple[float, dict, float]]:
    """Each rung doubles the share of rows (by the uniform column ``spread``) and keeps the better half."""
    folds = encoded_folds(train, stages, k, keep=[spread])
    left, share, trace = list(candidates), start, []
    while True:
        ranked = search([tuple(df.filter(F.col(spread) < share) for df in fold) for fold in folds], kind, left)
        trace += [(share, c, s) for c, s in ranked]
        if len(ranked) == 1 or share >= 1.0:
            return trace
        left = [c for c, _ in ranked[:max(1, len(ranked) // 2)]]
        share = min(1.0, share * 2)


def two_stage(train: DataFrame, stages: Sequence, spaces: Mapping[str, Mapping], k: int, quick: int = 1, full: int = 3,
              keep: int = 2) -> list[tuple[str, dict, float]]:
    """A quick search over every learner, a fuller one over the best ``keep``, all on the same encoded folds."""
    folds = encoded_folds(train, stages, k)
    first = {kind: search(folds, kind, draw_candidates(s, quick))[0] for kind, s in spaces.items()}
    best = sorted(first, key=lambda n: (-first[n][1], n))[:keep]
    found = [(n, *search(folds, n, draw_candidates(spaces[n], full))[0]) for n in best]
    return sorted(found, key=lambda r: -r[2])


def choose(table: DataFrame, metric: str = "generalization", max_gap: float | None = None) -> DataFrame:
    """Metric rows with rank and ``deploy`` flag; the gap cap is ignored when nobody meets it."""
    ok = F.lit(True) if max_gap is None else F.col("fit_gap") <= max_gap
    any_ok = table.agg(F.max(ok.cast("int")) == 1).scalar()
    marked = table.withColumn("eligible", F.when(any_ok, ok).otherwise(F.lit(True)))
    # One row per trained model, so the ranking is a handful of rows.
    best = marked.filter("eligible").agg(F.max_by("model", F.struct(metric, "test_accuracy", "model"))).scalar()
    return marked.withColumn("deploy", F.col("model") == best)


def importances(model: PipelineModel, df: DataFrame, n: int = 20) -> DataFrame:
    """The n most important inputs of a tree model, named from the assembled vector."""
    spark = df.sparkSession
    attrs = model.transform(df.limit(1)).schema["features"].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a.get("name", str(a["idx"])) for group in attrs.values() for a in group}
    values = model.stages[-1].featureImportances.toArray()
    rows = [(names.get(i, str(i)), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature").limit(n)
