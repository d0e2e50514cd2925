"""Model-ready encoding: rare values, imputation, one-hot, labels and weights."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F

from pitchline import presets as P
from pitchline.operators.ordered import exact_median, modes, positions, top_n
from pitchline.session import checkpoint_dir


def frequent_values(df: DataFrame, columns: Sequence[str], min_count: int, max_values: int) -> DataFrame:
    """(column_name, value) kept per column: count >= min_count, the most frequent first; 0 keeps all of them."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column_name", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") >= min_count)
    return often if not max_values else top_n(often, ["column_name"], [F.col("n").desc(), F.col("value")], max_values)


# Up to so many values of all columns ride along in a plan; more of them stay a table that is joined.
PLAN_VALUES = 10_000


class _TableParams(Params):
    """Where a fitted stage keeps the values that are too many for its own parameters."""

    path = Param(Params._dummy(), "path", "folder of the table of values, empty without one", TypeConverters.toString)
    planValues = Param(Params._dummy(), "planValues", "most values kept in the plan", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(path="", planValues=PLAN_VALUES)

    def _table(self, dataset: DataFrame, column: str) -> DataFrame:
        table = dataset.sparkSession.read.parquet(self.getOrDefault("path"))
        return table.filter(F.col("column_name") == column).drop("column_name")


def stored_values(values: DataFrame) -> str:
    """Write a table of values to the shared folder."""
    path = f"{checkpoint_dir(values.sparkSession)}/values-{uuid.uuid4().hex}"
    values.write.parquet(path)
    return path


class _ReducerParams(HasInputCols, _TableParams):
    minCount = Param(Params._dummy(), "minCount", "smallest count to keep", TypeConverters.toInt)
    maxValues = Param(Params._dummy(), "maxValues", "most values kept per column", TypeConverters.toInt)

    def __init__(self, *args):
        super().__init__(*args)
        self._setDefault(minCount=2, maxValues=500)


class CardinalityReducer(Estimator, _ReducerParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns the frequent values per text column; the rest becomes one marker."""

    @keyword_only
    def __init__(self, *, inputCols=None, minCount=2, maxValues=500, planValues=PLAN_VALUES):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "CardinalityReducerModel":
        cols, most = self.getInputCols(), self.getOrDefault("planValues")
        values = frequent_values(dataset, cols, self.getOrDefault("minCount"), self.getOrDefault("maxValues"))
        few = values.limit(most + 1).collect()
        if len(few) > most:
            return CardinalityReducerModel(inputCols=cols, kept="{}", path=stored_values(values.select("column_name", "value")))
        kept: dict[str, list[str]] = {c: [] for c in cols}
        for row in few:
            kept[row.column_name].append(row.value)
        return CardinalityReducerModel(inputCols=cols, kept=json.dumps({c: sorted(v) for c, v in kept.items()}))


class CardinalityReducerModel(Model, _ReducerParams, DefaultParamsReadable, DefaultParamsWritable):
    kept = Param(Params._dummy(), "kept", "kept values per column as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, kept=None, path=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        kept = json.loads(self.getOrDefault("kept"))
        if self.getOrDefault("path"):
            out = dataset
            for c in self.getInputCols():
                text = F.coalesce(F.col(c).cast("string"), F.lit(P.UNKNOWN_PLAYER))
                known = self._table(dataset, c).select(F.col("value").alias("_v"), F.lit(True).alias("_kept"))
                keep = F.coalesce("_kept", F.lit(False)) | text.isin(P.UNKNOWN_PLAYER, P.OTHER_PLAYER)
                out = out.join(known, text == F.col("_v"), "left").withColumn(
                    c, F.when(keep, text).otherwise(F.lit(P.OTHER_PLAYER))).drop("_v", "_kept")
            return out
        return dataset.withColumns({c: reduced(F.col(c), kept[c]) for c in self.getInputCols()})


def reduced(value: Column, kept: Sequence[str]) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(P.UNKNOWN_PLAYER))
    return F.when(text.isin(*kept, P.UNKNOWN_PLAYER, P.OTHER_PLAYER), text).otherwise(F.lit(P.OTHER_PLAYER))


def fill_most_frequent(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls of text columns become the training mode (ties to the smallest)."""
    out = df
    for c in columns:
        mode = modes(train.select(F.lit(0).alias("_g"), c), ["_g"], c, "_m").select("_m").scalar()
        out = out.withColumn(c, F.coalesce(c, mode))
    return out


def median_and_scale(train: DataFrame, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Nulls become the training median, then zero mean and unit population deviation."""
    out = df
    for c in columns:
        mid = exact_median(train, c).scalar()
        stats = train.select(F.coalesce(F.col(c).cast("double"), mid).alias("x")).agg(
            F.struct(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))).scalar()
        out = out.withColumn("_s", stats).withColumn(c, F.coalesce(F.col(c).cast("double"), mid))
        std = F.when(F.col("_s.std") > 0, F.col("_s.std")).otherwise(1.0)
        out = out.withColumn(c, (F.col(c) - F.col("_s.mean")) / std).drop("_s")
    return out


def column_roles(df: DataFrame, skip: Sequence[str]) -> tuple[list[str], list[str]]:
    """(text columns, numeric columns) in table order."""
    text = [c for c, t in df.dtypes if t == "string" and c not in skip]
    number = [c for c, t in df.dtypes if t in ("int", "bigint", "double", "float", "smallint", "tinyint") and c not in skip]
    return text, number


class _IndexParams(HasInputCols, HasOutputCols, _TableParams):
    sizes = Param(Params._dummy(), "sizes", "number of values per column as JSON", TypeConverters.toString)


class ValueIndexer(Estimator, _IndexParams, DefaultParamsReadable, DefaultParamsWritable):
    """Alphabetical index of every value of text columns; a value not seen has the index after the last.

    Few values are MLlib's own indexer.  Many become a dictionary table: their
    ranks are found slice by slice and values meet their index by a join, so
    no list of values stands on the driver or in a task.
    """

    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, planValues=PLAN_VALUES):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame):
        cols, outs, most = self.getInputCols(), self.getOutputCols(), self.getOrDefault("planValues")
        values = frequent_values(dataset, cols, 1, 0).select("column_name", "value")
        few = values.limit(most + 1).collect()
        if len(few) <= most:
            labels = {c: sorted((r.value for r in few if r.column_name == c), key=str.encode) for c in cols}
            return PipelineModel([StringIndexerModel.from_labels(labels[c], inputCol=c, outputCol=o, handleInvalid="keep") for c, o in zip(cols, outs)])
        path = stored_values(dictionary(values))
        sizes = dataset.sparkSession.read.parquet(path).groupBy("column_name").count().collect()  # one row per column
        return ValueIndexerModel(inputCols=cols, outputCols=outs, path=path, sizes=json.dumps({c: 0 for c in cols} | {r[0]: r[1] for r in sizes}))


class ValueIndexerModel(Model, _IndexParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, outputCols=None, path=None, sizes=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        sizes, out = json.loads(self.getOrDefault("sizes")), dataset
        for c, o in zip(self.getInputCols(), self.getOutputCols()):
            ranks = self._table(dataset, c).select(F.col("value").alias("_v"), F.col("code").alias("_code"))
            out = out.join(ranks, F.col(c).cast("string") == F.col("_v"), "left").withColumn(
                o, F.coalesce(F.col("_code").cast("double"), F.lit(float(sizes[c])))).drop("_v", "_code")
        return out


def dictionary(values: DataFrame) -> DataFrame:
    """(column_name, value, code): the place of each value among its column's, from 0, by slices of the values."""
    ranked = positions(values.distinct(), ["value"], ["column_name"])
    return ranked.select("column_name", "value", (F.col("pos") - 1).alias("code"))


class MostFrequentFill(Estimator, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Learns one value per text column: the most frequent, ties to the smallest."""

    @keyword_only
    def __init__(self, *, inputCols=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "MostFrequentFillModel":
        cols = self.getInputCols()
        long = dataset.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "column_name", "value")
        found = {r.column_name: r.mode for r in modes(long, ["column_name"], "value").collect()}  # one row per column
        return MostFrequentFillModel(inputCols=cols, found=json.dumps(found))


class MostFrequentFillModel(Model, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    found = Param(Params._dummy(), "found", "fill value per column as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCols=None, found=None):
        super().__init__()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        found = json.loads(self.getOrDefault("found"))
        return dataset.withColumns({
            c: F.coalesce(F.col(c).cast("string"), F.lit(found.get(c))) for c in self.getInputCols()})


def encoder_stages(
    text: Sequence[str], number: Sequence[str], min_count: int = 1, players: Sequence[str] = (), max_players: int = 500
) -> list:
    """Fill, rare values, one-hot with unknown ignored, median fill, scaling, assembly.

    Text columns take the training mode for nulls and keep every value seen
    ``min_count`` times; ``players`` are text columns with their own marker
    for nulls and at most ``max_players`` values.
    """
    players, number = list(players), list(number)
    plain = [c for c in text if c not in players]
    stages, parts = [], []
    if plain:
        stages.append(MostFrequentFill(inputCols=plain))
        if min_count > 1:
            stages.append(CardinalityReducer(inputCols=plain, minCount=min_count, maxValues=0))
    if players:
        stages.append(CardinalityReducer(inputCols=players, minCount=min_count, maxValues=max_players))
    text = plain + players
    if text:
        idx, hot = [f"_i_{c}" for c in text], [f"_o_{c}" for c in text]
        stages += [
            ValueIndexer(inputCols=text, outputCols=idx),
            OneHotEncoder(inputCols=idx, outputCols=hot, handleInvalid="keep"),
        ]
        parts += hot
    if number:
        filled = [f"_n_{c}" for c in number]
        stages += [
            Imputer(inputCols=number, outputCols=filled, strategy="median", relativeError=1e-4),
            VectorAssembler(inputCols=filled, outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
        ]
        parts.append("_scaled")
    return stages + [VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def one_hot_index(model: PipelineModel, df: DataFrame, hot: str, name: str) -> DataFrame:
    """Position of the one in an encoded column, -1 for an unknown value."""
    from pyspark.ml.functions import vector_to_array

    return df.withColumn(name, F.array_position(vector_to_array(hot), 1.0).cast("int") - 1)


def label_codes(train: DataFrame, label: str, **bounds) -> DataFrame:
    """(label, code): classes of the training split in alphabetical order from 0."""
    classes = train.select(F.col(label).cast("string").alias(label)).filter(F.col(label).isNotNull()).distinct()
    return positions(classes, [label], **bounds).select(label, (F.col("pos") - 1).cast("int").alias("code"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes · count) per label."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("n"), F.count("*").alias("k"))).scalar()
    return counts.withColumn("_t", totals).select(label, (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("class_weight"))
