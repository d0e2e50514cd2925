"""What the training-data operators share: inputs, staged tables, Arrow text buffers, seeded hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.session import checkpoint_dir

# A word: a run of anything but ASCII white space. bytes.split() cuts at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def joined_totals(rows: DataFrame, totals: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with one row of totals per key (never null), whose column ``size`` counts the key's rows.

    Keys with over a thousandth of all rows are a thousand at most, so they are broadcast and their rows stay where
    they are; the others meet by a shuffle in which no key weighs more than that.
    """
    hot = F.col(size) * 1000 > F.lit(total)
    few = F.broadcast(totals.filter(hot))
    return rows.join(few, key).unionByName(
        rows.join(few.select(key), key, "left_anti").join(totals.filter(~hot), key))


def crc_bucket(column: str, buckets: int):
    """crc32 of an id written as text, modulo the bucket count; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(buckets)


def give_back() -> None:
    """Hand free memory back to the system: workers live on after their task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # other C libraries have none
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with free memory handed back at the end of the task."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From here on in this session rows go to Python in batches of some 4 MB, or one longer row each.

    A task holds its batch several times over outside the heap (vectors that double as they grow, the stream, the worker's copy).
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


SLICE = 2 << 20


def slices(batch: pa.RecordBatch, text_at: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``size`` bytes of text each, or one longer text, so memory stays bounded."""
    column = batch.column(text_at)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, int(offsets[a]) + size, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def appended(df: DataFrame, make: Callable[[], Callable[[pa.Array], list]], fields: list[T.StructField],
             text_col: str, drop: tuple[str, ...] = (), size: int = SLICE) -> DataFrame:
    """Append Arrow-computed columns to every row.

    ``make`` runs once per task and returns the function from a part of the text column to the
    new columns. Columns that already
    have one of the new names are replaced; those in ``drop`` are read but not returned.
    """
    taken = {f.name.lower() for f in fields}
    base = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
    kept = [i for i, f in enumerate(base.schema.fields) if f.name not in drop]
    schema = T.StructType([base.schema.fields[i] for i in kept] + fields)
    names, text_at = schema.names, base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for whole in batches:
            for batch in slices(whole, text_at, size):
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + step(batch.column(text_at)), names=names)

    return base.mapInArrow(tidy(run), schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the row offsets into them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def mix(keys: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit keys: different keys never collide."""
    h = keys.astype(np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... for each row i, laid end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def row_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each row's stretch of ``values``; empty rows give 0."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


class HashArray:
    """Sorted hash array: scrambled keys in order, found through an index of their leading bits."""

    def __init__(self, keys: np.ndarray):
        hashed = mix(np.asarray(keys, np.uint64))
        self.order = np.argsort(hashed, kind="stable")
        self.hashes = np.append(hashed[self.order], np.uint64(0xFFFFFFFFFFFFFFFF))
        bits = min(24, max(4, int(len(keys)).bit_length() + 1))
        self.shift = np.uint64(64 - bits)
        edges = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.first = np.searchsorted(hashed[self.order], edges).astype(np.int32)
        sizes = np.diff(np.append(self.first, len(keys)))
        self.longest = int(sizes.max()) if len(keys) else 0

    def state(self) -> dict:
        """Plain arrays: what a broadcast carries, since workers may not have this class installed."""
        return self.__dict__

    @classmethod
    def restore(cls, state: dict) -> HashArray:
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def __len__(self) -> int:
        return len(self.hashes) - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key in hash order, -1 where it is absent."""
        found = np.full(len(keys), -1, np.int32)
        if not len(self):
            return found
        wanted = mix(keys)
        at = self.first[(wanted >> self.shift).astype(np.int64)]
        hit = self.hashes[at] == wanted
        found[hit] = at[hit]
        left = np.flatnonzero(~hit)
        for _ in range(1, self.longest):
            if not len(left):
                break
            at = np.minimum(at[left] if len(at) != len(left) else at, len(self) - 1) + 1
            now = self.hashes[at]
            hit = now == wanted[left]
            found[left[hit]] = at[hit]
            more = ~hit & (now < wanted[left])
            left, at = left[more], at[more]
        found[found == len(self)] = -1
        return found
