"""Byte n-grams: padded streams, counting in tasks, one Spark aggregation over all of them.

Values of grams reach the texts by joins, not by a broadcast, so a table of values may be of any size. Rows are read
once and stored in chunks, stretches of one partition: their rows packed and compressed, and their distinct grams. The
grams are joined with the values, and rows and values of a chunk meet in one task. Chunks are stored in buckets, so only
the values move to them: the rows are written once and never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pitchline.llm.common import HashArray, give_back, slices, tidy, utf8
from pitchline.session import checkpoint_dir

# Bytes that UTF-8 never uses mark the start and the end of a text.
START, END = 0xFE, 0xFF
# Windows that a task counts before it sorts them together.
PENDING = 1 << 22
# Text bytes of a chunk. A task may have several.
CHUNK_BYTES = 32 << 20
CHUNK_STEP = 1_000_003  # more than a table has partitions
BUCKETS = 50_000  # of stored chunks, at most; a bucket's chunks are taken one after the other
LEVEL = 6  # of the compression of stored rows


def padded(data: np.ndarray, offsets: np.ndarray, front: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text with ``front`` start marks before and one end mark after it; and the marked lengths."""
    lengths = np.diff(offsets)
    ends = np.cumsum(lengths + front + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, START, np.uint8)
    for a, n, end in zip(offsets[:-1].tolist(), lengths.tolist(), ends.tolist()):
        out[end - 1 - n:end - 1] = data[a:a + n]
        out[end - 1] = END
    return out, lengths + 1


def windows(stream: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes that end at each non-start byte, packed into one number, last byte lowest."""
    if len(stream) < order:
        return np.zeros(0, np.uint64)
    n = len(stream) - order + 1
    wide = stream.astype(np.uint64)
    parts, at = np.zeros(n, np.uint64), 0
    double, size = wide, 1
    while True:  # powers of two by doubling, then the binary digits of the order
        if order & size:
            parts <<= np.uint64(8 * size)
            parts |= double[at:at + n]
            at += size
        if size * 2 > order:
            break
        double = (double[:-size] << np.uint64(8 * size)) | double[size:]
        size *= 2
    return parts[stream[order - 1:] != START]


def stretches(stream: np.ndarray, order: int, size: int = 1 << 20) -> Iterator[np.ndarray]:
    """``windows`` of the stream piece by piece, for texts of any length."""
    for a in range(0, max(1, len(stream) - order + 1), size):
        yield windows(stream[a:a + size + order - 1], order)


def merged(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    if not len(keys):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[edge], np.diff(np.append(edge, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[edge], np.add.reduceat(counts, edge)


def count_grams(df: DataFrame, text_col: str, order: int, prepare: Callable | None = None) -> DataFrame:
    """(gram, n) over all texts; ``prepare`` may rewrite the bytes first.

    Each task adds up its own windows first, so a gram crosses the shuffle once per task however often it occurs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = merged(np.zeros(0, np.uint64))
        waiting: list[np.ndarray] = []

        def settled() -> tuple[np.ndarray, np.ndarray]:
            fresh, n = merged(np.concatenate(waiting)) if waiting else (keys[:0], counts[:0])
            waiting.clear()
            return merged(np.concatenate([keys, fresh]), np.concatenate([counts, n]))

        for batch in (part for whole in batches for part in slices(whole, 0)):
            data, offsets = utf8(batch.column(0))
            if prepare is not None:
                data, offsets = prepare(data, offsets)
            for grams in stretches(padded(data, offsets, order - 1)[0], order):
                waiting.append(grams)
                if sum(map(len, waiting)) > PENDING:
                    keys, counts = settled()
        keys, counts = settled()
        for a in range(0, len(keys), 1 << 17):
            part = slice(a, a + (1 << 17))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[part].astype(np.int64)), pa.array(counts[part].astype(np.int64))], names=["gram", "n"])

    out = df.select(F.col(text_col).alias("text")).mapInArrow(tidy(run), "gram long, n long")
    return out.groupBy("gram").agg(F.sum("n").alias("n"))


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, size: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of the batches with the number of their chunk, which depends on the partition and the bytes before a row."""
    partition, seen = TaskContext.get().partitionId(), 0
    for batch in (part for whole in batches for part in slices(whole, text_at)):
        offsets = utf8(batch.column(text_at))[1]
        number = (seen + offsets[:-1]) // size
        seen += int(offsets[-1])
        edges = np.flatnonzero(np.diff(number)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
            yield int(number[a]) * CHUNK_STEP + partition, batch.slice(a, b - a)


def partitions(df: DataFrame) -> int:
    """How many tasks read the rows."""
    return df.select().rdd.getNumPartitions()


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """``staged`` with the rows of a chunk in one bucket, so that chunks are grouped where they lie."""
    spark = df.sparkSession
    name = f"{name}-{uuid.uuid4().hex}"
    known = name.replace("-", "_")
    df.write.bucketBy(max(1, min(buckets, BUCKETS)), "chunk").option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(known)
    return spark.table(known)


class Chunks:
    """Stored rows: ``pairs`` (chunk, gram, n) has the distinct grams of every chunk, ``bodies`` (chunk, body) its rows.

    ``n`` counts the grams of rows where the column ``learn`` holds, or of all rows if it is not given.
    """

    def __init__(self, df: DataFrame, text_col: str, order: int, name: str, prepare: Callable | None = None,
                 learn: str | None = None, size: int = CHUNK_BYTES):
        self.columns, self.schema, self.text_col = df.columns, df.schema, text_col
        text_at, learn_at = df.columns.index(text_col), None if learn is None else df.columns.index(learn)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, counts = merged(np.zeros(0, np.uint64))
            waiting: tuple[list, list] = [], []  # not to be learned, to be learned
            now = None

            def settled() -> tuple[np.ndarray, np.ndarray]:
                all_keys, all_counts = [keys], [counts]
                for known, grams in enumerate(waiting):
                    if grams:
                        fresh, n = merged(np.concatenate(grams))
                        all_keys.append(fresh)
                        all_counts.append(n * known)
                    grams.clear()
                return merged(np.concatenate(all_keys), np.concatenate(all_counts))

            def listed() -> Iterator[pa.RecordBatch]:
                for a in range(0, len(keys), 1 << 17):
                    part = keys[a:a + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), now, np.int64)), pa.array(part.astype(np.int64)),
                         pa.array(counts[a:a + (1 << 17)].astype(np.int64)), pa.nulls(len(part), pa.binary())], names=["chunk", "gram", "n", "body"])

            for chunk, batch in chunks(batches, text_at, size):
                if now is not None and chunk != now:
                    keys, counts = settled()
                    yield from listed()
                    keys, counts = merged(np.zeros(0, np.uint64))
                now = chunk
                texts = batch.column(text_at)
                for known in (0, 1):
                    if learn_at is not None:
                        data, offsets = utf8(texts.filter(pc.equal(batch.column(learn_at), bool(known))))
                    elif known:
                        data, offsets = utf8(texts)
                    else:
                        continue
                    if len(offsets) == 1:
                        continue
                    if prepare is not None:
                        data, offsets = prepare(data, offsets)
                    for grams in stretches(padded(data, offsets, order - 1)[0], order):
                        waiting[known].append(grams)
                        if sum(map(len, waiting[known])) > PENDING:
                            keys, counts = settled()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
                    out.write_batch(batch)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), *[pa.nulls(1, pa.int64())] * 2, pa.array([sink.getvalue().to_pybytes()], pa.binary())],
                    names=["chunk", "gram", "n", "body"])
            if now is not None:
                keys, counts = settled()
                yield from listed()

        table = bucketed(df.mapInArrow(tidy(run), "chunk long, gram long, n long, body binary"), name, 8 * partitions(df))
        self.pairs = table.filter("body is null").select("chunk", "gram", "n")
        self.bodies = table.filter("body is not null").select("chunk", "body")

    def grams(self) -> DataFrame:
        """(gram, n) over all chunks."""
        return self.pairs.groupBy("gram").agg(F.sum("n").alias("n"))


class Values:
    """The values of one chunk's grams."""

    def __init__(self, grams: list[np.ndarray], values: list[np.ndarray]):
        self.finder = HashArray(np.concatenate(grams).astype(np.uint64))
        self.values = np.concatenate(values)[self.finder.order]

    def along(self, stream: np.ndarray, order: int, step: int = 1 << 18) -> np.ndarray:
        """Values of the grams that end at each non-start byte of a padded stream."""
        out = []
        for grams in stretches(stream, order, step):
            at = self.finder.find(grams)
            if (at < 0).any():
                raise RuntimeError("a gram of the chunk has no value")
            out.append(self.values[at])
        return np.concatenate(out)


def with_values(chunked: Chunks, values: DataFrame, make: Callable[[], Callable[[pa.Array, Values], list]],
                fields: list[T.StructField], drop: tuple[str, ...] = ()) -> DataFrame:
    """Append Arrow-computed columns to every row, as ``appended`` does; the function also gets its chunk's values.

    ``values`` has (gram, value) for all grams of the chunks.
    """
    taken = {f.name.lower() for f in fields}
    kept = [i for i, f in enumerate(chunked.schema.fields) if f.name.lower() not in taken and f.name not in drop]
    schema = T.StructType([chunked.schema.fields[i] for i in kept] + fields)
    names, text_at = schema.names, chunked.columns.index(chunked.text_col)
    arrow = to_arrow_schema(schema)

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        step, out = make(), []
        if rows.num_rows:
            found = Values([known.column("gram").to_numpy()], [known.column("value").to_numpy()])
            for body in (x for part in rows.column("body").chunks for x in part):
                for part in pa.ipc.open_stream(body.as_buffer()):
                    out.append(pa.RecordBatch.from_arrays([part.column(i) for i in kept] + step(part.column(text_at), found), names=names))
        give_back()
        return pa.Table.from_batches(out).cast(arrow) if out else arrow.empty_table()

    valued = chunked.pairs.join(values, "gram").select(F.col("chunk").alias("at"), "gram", F.col("value").cast("float").alias("value"))
    return chunked.bodies.groupBy("chunk").cogroup(valued.groupBy("at")).applyInArrow(run, schema)


def suffix(gram, size: int):
    """The last ``size`` bytes of a packed gram."""
    return gram.bitwiseAND(F.lit((1 << 8 * size) - 1))


def context(gram):
    """A packed gram without its last byte."""
    return F.shiftright(gram, 8)
