"""Evaluation, calibration, drift and simple statistics as aggregations."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from pitchline.functions import rules as R
from pitchline.operators.ordered import Total, with_history
from pitchline.session import durable

EPS = 1e-15


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Counts per (actual, predicted); everything class-based starts from this small table."""
    return df.groupBy(F.col(label).alias("actual"), F.col(pred).alias("predicted")).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, label: str, pred: str, classes: Sequence) -> DataFrame:
    """One row per actual class: counts and row shares per predicted class."""
    c = confusion(df, label, pred)
    wide = c.groupBy("actual").agg(
        *[F.sum(F.when(F.col("predicted") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in classes],
        F.sum("n").alias("support"))
    return wide.select("actual", *[f"n_{k}" for k in classes],
                       *[(F.col(f"n_{k}") / F.col("support")).alias(f"share_{k}") for k in classes])


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class; undefined ratios are 0."""
    c = confusion(df, label, pred)
    role = F.explode(F.array(
        F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted_n"),
                 F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted_n"), F.lit(0).cast("bigint").alias("tp")),
    ))
    per = c.select(role.alias("r")).select("r.*").groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted_n").alias("predicted_n"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("predicted_n")), ratio(F.col("tp"), F.col("support"))
    out = per.withColumns({"precision": p, "recall": r})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.withColumn("f1", f1)


def averages(report: DataFrame) -> DataFrame:
    """One row: accuracy, balanced accuracy, macro and weighted precision, recall, F1."""
    n = F.sum("support")
    cols = [(F.sum("tp") / n).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy")]
    for m in ("precision", "recall", "f1"):
        cols += [F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * F.col("support")) / n).alias(f"{m}_weighted")]
    return report.agg(*cols)


def full_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Class rows followed by the macro and weighted average rows."""
    rep = class_report(df, label, pred)
    rows = rep.select(F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support")
    a = averages(rep)
    n = rep.agg(F.sum("support")).scalar()
    for kind in ("macro", "weighted"):
        rows = rows.unionByName(a.select(
            F.lit(f"{kind} avg").alias("row"), *[F.col(f"{m}_{kind}").alias(m) for m in ("precision", "recall", "f1")],
            n.alias("support")))
    return rows


def log_loss(p_true: Column) -> Column:
    """Aggregate: mean negative log of the clipped probability of the true class."""
    return F.avg(-F.ln(R.clamp(p_true, EPS, 1 - EPS)))


def brier(prob: Column, label: Column) -> Column:
    """Aggregate: mean over rows of the summed squared error over classes."""
    err = F.aggregate(F.transform(prob, lambda p, i: F.pow(p - (i == label).cast("double"), F.lit(2.0))),
                      F.lit(0.0), lambda a, x: a + x)
    return F.avg(err)


def true_rank(prob: Column, label: Column) -> Column:
    """1-based rank of the true class, ties to the smaller class index."""
    mine = F.get(prob, label)
    ahead = F.filter(F.transform(prob, lambda p, i: (p > mine) | ((p == mine) & (i < label))), lambda x: x)
    return F.size(ahead) + 1


def top_k_accuracy(prob: Column, label: Column, k: int) -> Column:
    return F.avg((true_rank(prob, label) <= k).cast("int"))


def calibration_bins(df: DataFrame, conf: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Rows, accuracy and mean confidence per half-open bin; confidence 1 falls out."""
    binned = df.select(F.floor(conf * bins).cast("int").alias("bin"), conf.alias("_c"), correct.cast("int").alias("_ok"))
    return binned.filter(F.col("bin") < bins).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("_ok").alias("accuracy"), F.avg("_c").alias("confidence"),
    ).withColumn("center", (F.col("bin") + 0.5) / bins)


def expected_calibration_error(df: DataFrame, conf: Column, correct: Column, bins: int = 10) -> DataFrame:
    total = df.agg(F.count("*")).scalar()
    b = calibration_bins(df, conf, correct, bins)
    gap = F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))
    return b.agg(F.sum(gap).alias("_g")).select((F.coalesce("_g", F.lit(0.0)) / total).alias("ece"))


def roc_points(df: DataFrame, score: Column, positive: Column, keys: Sequence[str] = (), **bounds) -> DataFrame:
    """True and false positive rates per distinct score, highest score first."""
    keys = list(keys)
    hist = durable(df.groupBy(*keys, score.alias("score")).agg(
        F.sum(positive.cast("bigint")).alias("pos"), F.sum(1 - positive.cast("bigint")).alias("neg")))
    cum = with_history(hist.withColumn("_down", -F.col("score")), keys, ["_down"], [
        Total("tp", F.col("pos"), inclusive=True), Total("fp", F.col("neg"), inclusive=True)], **bounds)
    sums = [F.sum("pos").alias("_p"), F.sum("neg").alias("_n")]
    if keys:
        cum = cum.join(hist.groupBy(*keys).agg(*sums), keys)
    else:
        cum = cum.withColumn("_t", hist.agg(F.struct(*sums)).scalar()).select("*", "_t.*").drop("_t")
    return cum.select(*keys, "score", "pos", "neg", "tp", "fp", "_p", "_n",
                      (F.col("tp") / F.nullif(F.col("_p"), F.lit(0))).alias("tpr"),
                      (F.col("fp") / F.nullif(F.col("_n"), F.lit(0))).alias("fpr"))


def auc(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the trapezoids between neighbouring points."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return points.groupBy(*keys).agg(
        (area / F.nullif(F.max("_p") * F.max("_n"), F.lit(0))).alias("auc"), F.max("_p").alias("support"))


def auc_ovr_weighted(df: DataFrame, prob: str, label: str, **bounds) -> DataFrame:
    """One-vs-rest AUC averaged over the classes by support."""
    long = df.select(label, F.posexplode(prob).alias("class", "p"))
    per = auc(roc_points(long, F.col("p"), F.col(label) == F.col("class"), ["class"], **bounds), ["class"])
    return per.agg((F.sum(F.col("auc") * F.col("support")) / F.sum("support")).alias("auc_weighted"))


def fit_gaps(metrics: DataFrame, penalty: float = 0.25) -> DataFrame:
    """Adds fit gap, log-loss gap and the penalised generalisation score."""
    gap = F.col("train_f1") - F.col("test_f1")
    return metrics.withColumns({
        "fit_gap": gap,
        "log_loss_gap": F.col("test_log_loss") - F.col("train_log_loss"),
        "generalization": F.col("test_accuracy") - penalty * F.greatest(gap, F.lit(0.0)),
    })


def fit_status(train_f1: Column, test_f1: Column) -> Column:
    """Risk label from the weighted F1 of both splits."""
    return (
        F.when(train_f1 - test_f1 > 0.12, "overfitting_risk")
        .when((train_f1 < 0.50) & (test_f1 < 0.50), "underfitting_risk")
        .otherwise("balanced")
    )


def fit_diagnosis(train_acc: Column, test_acc: Column) -> Column:
    """Plain-text label from the accuracy of both splits."""
    return (
        F.when((train_acc >= 0.85) & (train_acc - test_acc > 0.12), "Overfitting")
        .when((train_acc < 0.60) & (test_acc < 0.60), "Underfitting")
        .otherwise("Reasonable Fit")
    )


def health_status(accuracy: Column, threshold: float) -> Column:
    return F.when(accuracy.isNull(), "unknown").when(accuracy >= threshold, "good").otherwise("needs_attention")


# --- drift ------------------------------------------------------------------

def drift_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.endswith("_prior") or c.endswith("_5")]


def numeric_drift(df: DataFrame, is_test: str, columns: Sequence[str]) -> DataFrame:
    """Means per split and the shift in training deviations (0 for a constant column)."""
    long = df.select(is_test, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [is_test], list(columns), "column_name", "v")
    tr, te = F.when(~F.col(is_test), F.col("v")), F.when(F.col(is_test), F.col("v"))
    per = long.groupBy("column_name").agg(
        F.avg(tr).alias("a"), F.avg(te).alias("b"), F.stddev_samp(tr).alias("s"))
    z = F.when(F.col("s") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.col("s"))
    return per.filter(F.col("a").isNotNull() & F.col("b").isNotNull()).select(
        "column_name", F.bround("a", 4).alias("train_mean"), F.bround("b", 4).alias("test_mean"),
        F.bround(z, 4).alias("mean_shift_z"))


def unseen_categories(df: DataFrame, is_test: str, columns: Sequence[str]) -> DataFrame:
    """Share of test rows per column whose value never occurs in training."""
    counts = df.select(is_test, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [is_test], list(columns), "column_name", "v").groupBy("column_name", "v").agg(
        F.sum((~F.col(is_test)).cast("bigint")).alias("train_n"), F.sum(F.col(is_test).cast("bigint")).alias("test_n"))
    unseen = F.sum(F.when(F.col("train_n") == 0, F.col("test_n")).otherwise(0))
    return counts.groupBy("column_name").agg((unseen / F.nullif(F.sum("test_n"), F.lit(0))).alias("unseen_rate"))


def unseen_players(slots: DataFrame, is_test: str) -> DataFrame:
    """Unseen rate per slot, slot i against training values of slots 1..i, and overall (slot 0)."""
    per = slots.groupBy("player", "slot").agg(
        F.sum((~F.col(is_test)).cast("bigint")).alias("train_n"), F.sum(F.col(is_test).cast("bigint")).alias("test_n"))
    first = per.filter("train_n > 0").groupBy("player").agg(F.min("slot").alias("first_slot"))
    j = per.join(first, "player", "left")
    seen = F.coalesce(F.col("first_slot") <= F.col("slot"), F.lit(False))
    tests = F.nullif(F.sum("test_n"), F.lit(0))
    by_slot = j.groupBy("slot").agg((F.sum(F.when(seen, 0).otherwise(F.col("test_n"))) / tests).alias("unseen_rate"))
    total = j.agg(F.lit(0).alias("slot"), (
        F.sum(F.when(F.col("first_slot").isNull(), F.col("test_n")).otherwise(0)) / tests).alias("unseen_rate"))
    return by_slot.unionByName(total).withColumn("unseen_rate", F.bround("unseen_rate", 4))


# --- statistics -------------------------------------------------------------

# The continued fraction takes about the root of its larger parameter in steps.
_MOST_STEPS = 1_000_000
# From here on, the normal limit is closer than differences of log-gammas can be.
_NORMAL_FROM = 1e8

def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0 or x >= 1.0 or math.isnan(x):
        return 0.0 if x <= 0.0 else 1.0 if x >= 1.0 else math.nan
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    total, c, d = 1.0, 1.0, 0.0
    for i in itertools.count():
        if i > _MOST_STEPS:
            raise ArithmeticError(f"no convergence for a={a}, b={b}, x={x}")
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + term * d) or 1e-300)
        c = (1.0 + term / c) or 1e-300
        total *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (total - 1.0)


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation over n rows."""
    df = n - 2

    def tail(a: float, k: float) -> float:
        if abs(a) >= 1:
            return 0.0
        t2 = a * a * k / (1 - a * a)
        return math.erfc(math.sqrt(t2 / 2)) if k >= _NORMAL_FROM else _beta_tail(k / 2.0, 0.5, k / (k + t2))

    return pd.Series([tail(a, k) for a, k in zip(r, df)])


@F.pandas_udf(DoubleType())
def f_test_p(f: pd.Series, k1: pd.Series, k2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    return pd.Series([_beta_tail(b / 2.0, a / 2.0, b / (b + a * x)) if not np.isnan(x) else np.nan
                      for x, a, b in zip(f, k1, k2)])


def correlations(df: DataFrame, columns: Sequence[str], target: str, **bounds) -> DataFrame:
    """Pearson and Spearman per feature; constant or tiny columns are left out."""
    long = df.select(F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["_y"], list(columns), "feature", "_x").filter(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    # Equal pairs are counted first, so a hot value is one row from here on.
    pairs = durable(long.groupBy("feature", "_x", "_y").agg(F.count("*").alias("_w")))
    n = pairs.groupBy("feature").agg(F.sum("_w").alias("n"))

    def ranks(col: str, name: str) -> DataFrame:
        hist = pairs.groupBy("feature", col).agg(F.sum("_w").alias("_k"))
        cum = with_history(hist, ["feature"], [col], [Total("_c", F.col("_k"), inclusive=True)], **bounds)
        return cum.select("feature", col, (F.col("_c") - (F.col("_k") - 1) / 2.0).alias(name))

    j = pairs.join(ranks("_x", "_rx"), ["feature", "_x"]).join(ranks("_y", "_ry"), ["feature", "_y"]).join(n, "feature")
    mean = pairs.groupBy("feature").agg(
        (F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_mx"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("_my"))
    j = j.join(mean, "feature")
    mid = (F.col("n") + 1) / 2.0
    dx, dy, rx, ry = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my"), F.col("_rx") - mid, F.col("_ry") - mid
    w = F.col("_w")
    corr = lambda a, b: F.sum(w * a * b) / F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))
    out = j.groupBy("feature", "n").agg(
        corr(dx, dy).alias("pearson"), corr(rx, ry).alias("spearman"),
        F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.min("_y").alias("_ylo"), F.max("_y").alias("_yhi"))
    out = out.filter((F.col("n") >= 3) & (F.col("_lo") < F.col("_hi")) & (F.col("_ylo") < F.col("_yhi")))
    return out.select("feature", "n", "pearson", "spearman")


def with_p_values(corr: DataFrame) -> DataFrame:
    return corr.withColumns({"pearson_p": correlation_p("pearson", "n"), "spearman_p": correlation_p("spearman", "n")})


def anova(df: DataFrame, columns: Sequence[str], target: str, **bounds) -> DataFrame:
    """One-way F per categorical column over target codes re-encoded inside each group."""
    long = df.select(F.col(target).cast("string").alias("_y"), *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        ["_y"], list(columns), "feature", "_g").filter(F.col("_y").isNotNull() & F.col("_g").isNotNull())
    counts = durable(long.groupBy("feature", "_g", "_y").agg(F.count("*").alias("_n")))
    coded = with_history(counts, ["feature", "_g"], ["_y"], [Total("_code", F.lit(1), "count")], **bounds)
    groups = coded.groupBy("feature", "_g").agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("_code")).alias("s"),
        F.sum(F.col("_n") * F.col("_code") * F.col("_code")).alias("q"), F.count("*").alias("k"),
    ).filter("k >= 2")
    t = groups.groupBy("feature").agg(
        F.count("*").alias("groups_used"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b")).filter("groups_used >= 2")
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("groups_used") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("groups_used"))
    return t.select("feature", "groups_used", "n", (between / within).alias("f_stat"))


def with_f_p(table: DataFrame) -> DataFrame:
    return table.withColumn("p_value", f_test_p(
        "f_stat", (F.col("groups_used") - 1).cast("double"), (F.col("n") - F.col("groups_used")).cast("double")))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Count per equal-width bin 1..bins (0 and bins+1 hold the outliers)."""
    b = F.width_bucket(F.col(column).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins))
    return df.filter(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
