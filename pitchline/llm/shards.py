"""Sharding by a two-pass external shuffle.

The first pass scatters rows uniformly, by a seeded hash, into buckets that fit in memory; the second shuffles each
bucket (Fisher-Yates) and writes it. Buckets follow one another in the global order, which is cut into shards of equal
row counts, so counts differ by one at most, and slots count up within each shard. Rows are scattered by id and text;
where equal ones alone would outgrow a bucket, they are counted, numbered, and scattered by their number as well.

Defined results: a null text counts as empty (one byte of size); null ids are scattered by their text; rows equal in id
and text are alike in every position, so their mutual order has no meaning; a text longer than a bucket is a bucket's
row all the same; an empty table gives no rows; other columns travel along, and input columns named shard or slot are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.llm.common import staged


@dataclass(frozen=True)
class Plan:
    shards: int = 16
    seed: int = 20
    bucket_bytes: int = 16 << 20  # text bytes of a bucket
    cells: int = 1 << 18  # hash cells counted beforehand, more where a bucket would be less than CELLS of them


CELLS = 4
STRIP = 4096  # copies of a repeated row that are made at a time


def text_size(text):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def write(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> None:
    rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")])
    cells, counted = plan.cells, _counted(rows, id_col, text_col, plan, plan.cells)
    total, size = int(counted["n"].sum()), int(counted["bytes"].sum())
    buckets = max(1, -(-size // plan.bucket_bytes))
    if buckets * CELLS > cells:
        cells = buckets * CELLS
        counted = _counted(rows, id_col, text_col, plan, cells)
    hot = counted["bytes"] > plan.bucket_bytes
    cold = counted[~hot]
    per_bucket = np.bincount(cold["cell"].to_numpy(np.int64) * buckets // cells, cold["n"], buckets).astype(np.int64)
    scattered = rows.withColumn("__cell", _cell(id_col, text_col, plan, cells))
    spread = None
    if hot.any():
        large = rows.sparkSession.createDataFrame(counted.loc[hot, ["cell"]].rename(columns={"cell": "__cell"}))
        spread = _numbered(scattered.join(large, "__cell", "left_semi").drop("__cell"), plan, buckets)
        more = spread.groupBy("__bucket").agg(F.count(F.lit(1)).alias("n")).toPandas()  # at most one row per bucket
        per_bucket += np.bincount(more["__bucket"].to_numpy(np.int64), more["n"], buckets).astype(np.int64)
        scattered = scattered.join(large, "__cell", "left_anti")
    first = np.concatenate([[0], np.cumsum(per_bucket)])[:-1]
    cuts = np.array([total * s // plan.shards for s in range(plan.shards + 1)], np.int64)
    seed, names = plan.seed, rows.columns
    ids, texts = names.index(id_col), names.index(text_col)

    def shuffled(key: tuple, table: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        keys = pa.table({"id": table.column(ids), "text": pc.fill_null(table.column(texts), "")})
        order = pc.sort_indices(keys, [("id", "ascending"), ("text", "ascending")]).to_numpy()  # whatever order they came in
        order = order[np.random.default_rng([seed, bucket]).permutation(len(order))]
        place = first[bucket] + np.arange(len(order))
        shard = np.searchsorted(cuts, place, side="right") - 1
        out = table.select(range(len(names))).take(pa.array(order))
        return out.append_column("shard", pa.array(shard.astype(np.int32))).append_column("slot", pa.array(place - cuts[shard]))

    bucket = F.expr(f"__cell * {buckets}L div {cells}L")
    scattered = scattered.select(*[F.col(f"`{c}`") for c in names], bucket.alias("__bucket"))
    scattered = scattered if spread is None else scattered.unionByName(spread)
    schema = T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    scattered.groupBy("__bucket").applyInArrow(shuffled, schema).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _cell(id_col: str, text_col: str, plan: Plan, cells: int):
    return F.pmod(F.xxhash64(F.lit(plan.seed), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(cells).cast("long"))


def _counted(rows: DataFrame, id_col: str, text_col: str, plan: Plan, cells: int):
    """Rows and bytes of every hash cell: at most ``cells`` rows, in proportion to the buckets."""
    return rows.groupBy(_cell(id_col, text_col, plan, cells).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(text_size(F.col(f"`{text_col}`"))).alias("bytes")).toPandas()


def _numbered(rows: DataFrame, plan: Plan, buckets: int) -> DataFrame:
    """Rows that repeat, each with a bucket of its own: equal rows are counted first and made again by number.

    A repeated row is one row for every STRIP copies while it moves, so that no task makes them all.
    """
    names = [F.col(f"`{c}`") for c in rows.columns]
    equal = staged(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__copies")), "shard-copies")
    strips = equal.withColumn("__strip", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__copies") - 1) / STRIP))))
    spread = strips.repartition(F.xxhash64("__strip", *names))
    upto = F.least(F.lit(STRIP).cast("long"), F.col("__copies") - F.col("__strip") * STRIP)
    copy = spread.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), upto)))
    bucket = F.pmod(F.xxhash64(F.lit(plan.seed), F.col("__strip"), F.col("__copy"), *names), F.lit(buckets).cast("long"))
    return copy.select(*names, bucket.alias("__bucket"))


def read(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """The written shards with their shard and slot."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("shard", "slot")]
    schema = T.StructType([*kept, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)
