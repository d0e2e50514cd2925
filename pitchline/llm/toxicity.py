"""Toxicity from class-conditional Kneser-Ney models over bytes.

Two models, of toxic and of ordinary texts, count in how many different documents each gram occurs. Both back off to
one model of the pooled counts: a gram that a class has rarely seen gets the shared probability in it, and where both
classes do so the gram says nothing. A text's log-likelihood ratio, normalised by its length, becomes a probability
through a logistic curve fitted on labelled texts that neither model has seen.

The models are fitted on a bounded sample of labelled rows: ``max_toxic`` and ``max_ordinary`` documents, with copies
and most near copies (equal least word n-gram) counted once, and ``max_calibration`` for the curve. Every text is
scored whole. Defined results: null and empty texts have ratio 0 and get the curve's value there; null labels are
unlabelled; several labels of one document count as toxic if any is; without labels of both classes each score is the
smoothed share of toxic labels; an empty table gives an empty result; equal texts get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.llm import kneser_ney as kn
from pitchline.llm.byte_grams import merged, padded, windows
from pitchline.llm.common import appended, crc_bucket, row_sums, slices, staged, utf8
from pitchline.llm.shingles import row_minimum, shingle_hashes, word_hashes


@dataclass(frozen=True)
class Fit:
    order: int = 4
    min_count: int = 2  # a gram of fewer documents in both classes together is left to the shared counts
    max_toxic: int = 8000  # labelled documents that the class models are fitted on
    max_ordinary: int = 24000
    max_calibration: int = 8000  # labelled documents that the logistic curve is fitted on
    folds: int = 5  # crc32 of the id, modulo this: 0 is held out, 1 fits the curve, the rest fits the models
    shingle: int = 5  # words in the n-grams that tell near copies


@dataclass(frozen=True)
class Model:
    ratios: kn.Backoff  # log of toxic over ordinary probability
    curve: np.ndarray  # intercept, and weights of the ratio per byte and per root of bytes


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def sample(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic") -> DataFrame:
    """(text, toxic, calibrates): a bounded number of labelled rows, picked by a hash of the id."""
    known = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("toxic"))
             .withColumn("fold", crc_bucket("id", fit.folds)).filter("fold <> 0"))
    parts = (("fold = 1", fit.max_calibration, True), ("fold <> 1 and toxic = 1", fit.max_toxic, False),
             ("fold <> 1 and toxic = 0", fit.max_ordinary, False))
    chosen = reduce(DataFrame.unionByName, [
        known.filter(which).orderBy(F.xxhash64("id"), "id").limit(most).select("id", "toxic", F.lit(use).alias("calibrates"))
        for which, most, use in parts])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("text", "toxic", "calibrates")  # bounded by the limits above
    size = fit.shingle

    def make():
        def step(texts: pa.Array) -> list:
            data, offsets = utf8(texts)
            return [pa.array(row_minimum(*shingle_hashes(*word_hashes(lowered(data), offsets), size)).astype(np.int64))]

        return step

    marked = appended(found, make, [T.StructField("least", T.LongType())], "text")
    alone = F.when(F.col("calibrates"), F.monotonically_increasing_id())  # the curve keeps the copies: it needs true shares
    return marked.withColumn("alone", alone).dropDuplicates(["calibrates", "toxic", "least", "alone"]).drop("least", "alone")


def document_counts(texts: DataFrame, order: int) -> DataFrame:
    """(gram, t, o, a): documents of the toxic class, of the ordinary class, and of both that contain the gram."""

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, 0)):
            data, offsets = utf8(batch.column(0))
            stream, lengths = padded(lowered(data), offsets, order - 1)
            doc = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
            pair = merged((windows(stream, order) << np.uint64(64 - 8 * order)) | doc)[0]  # each gram once a document
            toxic = batch.column(1).to_numpy(zero_copy_only=False)[(pair & np.uint64((1 << 64 - 8 * order) - 1)).astype(np.int64)]
            for value in (0, 1):
                grams, n = merged(pair[toxic == value] >> np.uint64(64 - 8 * order))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams.astype(np.int64)), pa.array(n * value), pa.array(n * (1 - value))], names=["gram", "t", "o"])

    counted = texts.select("text", "toxic").mapInArrow(run, "gram long, t long, o long")
    return counted.groupBy("gram").agg(F.sum("t").alias("t"), F.sum("o").alias("o"), F.sum(F.col("t") + F.col("o")).alias("a"))


def ratios(texts: DataFrame, fit: Fit = Fit()) -> kn.Backoff:
    """Log-ratios of the stored grams, and of the mass that each context leaves to the shared model."""
    grams = staged(document_counts(texts, fit.order), "toxicity-grams")
    tables = kn.levels(grams, fit.order, ["t", "o"], types="a")
    found = kn.discounts(tables, ["t", "o", "a"])
    kept = kn.stored(tables, ["t", "o", "a"], found, lambda size: F.col("a") >= (fit.min_count if size == fit.order else 1))
    pooled = kn.interpolated(kept, lambda size: "a")
    top = kept[fit.order]
    share = np.exp(pooled.values(top["gram"]).astype(np.float64))
    logs = []
    for name in ("t", "o"):
        contexts, mass, number = kn.remaining(top["gram"], top[name])
        logs.append((np.log(top[name] + mass[number] * share), np.log(mass)))
    out = kn.Backoff(0.0)
    out.add(fit.order, top["gram"], logs[0][0] - logs[1][0], contexts, logs[0][1] - logs[1][1])
    return out


def features(total: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    n = np.maximum(lengths, 1)
    return np.stack([np.ones(len(n)), 100 * total / n, total / np.sqrt(n)], axis=1)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with a small ridge on standardised columns; the smoothed share alone where one class is missing."""
    w = np.zeros(3)
    w[0] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    if not 0 < y.sum() < len(y):
        return w
    center, scale = x.mean(axis=0), x.std(axis=0)
    center[0], scale = 0.0, np.where(scale > 1e-12, scale, 1.0)
    z, penalty = (x - center) / scale, np.array([0.0, ridge, ridge])

    def loss(w: np.ndarray) -> float:
        margin = z @ w
        return float(np.logaddexp(0, margin).sum() - y @ margin + 0.5 * penalty @ (w * w))

    for _ in range(100):  # Newton steps, halved until the loss falls
        p = logistic(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        size = 1.0
        while loss(w + size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    w = w / scale
    w[0] -= w[1:] @ center[1:]
    return w


def with_ratio(docs: DataFrame, table: kn.Backoff, fit: Fit, text_col: str, finish, fields, drop=()) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(table.state())  # grams of a bounded sample
    order = fit.order

    def make():
        lm = kn.Backoff.restore(shared.value)

        def step(texts: pa.Array) -> list:
            data, offsets = utf8(texts)
            stream, lengths = padded(lowered(data), offsets, order - 1)
            return finish(row_sums(lm.along(stream, order), lengths), lengths)

        return step

    return appended(docs, make, fields, text_col, drop)


def train(docs: DataFrame, labels: DataFrame, fit: Fit = Fit(), id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Model:
    texts = staged(sample(docs, labels, fit, id_col, text_col, label_col), "toxicity-sample")
    table = ratios(texts.filter("not calibrates"), fit)
    rows = with_ratio(
        texts.filter("calibrates").select("text", "toxic"), table, fit, "text", lambda r, n: [pa.array(r), pa.array(n)],
        [T.StructField("ratio", T.DoubleType()), T.StructField("size", T.LongType())], ("text",)).toPandas()
    x = features(rows["ratio"].to_numpy(np.float64), rows["size"].to_numpy(np.float64))
    return Model(table, curve(x, rows["toxic"].to_numpy(np.float64)))


def scored(docs: DataFrame, model: Model, fit: Fit = Fit(), text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5 on)."""
    weights = model.curve

    def finish(total: np.ndarray, lengths: np.ndarray) -> list:
        score = logistic(features(total, lengths) @ weights)
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return with_ratio(docs, model.ratios, fit, text_col, finish, fields, drop)
