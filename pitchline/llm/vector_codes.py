"""Product codes of vectors, trained and written in exact integers over Hilbert-sorted blocks.

Components become floor(scale * x); a vector is cut into equal parts, and each part has a codebook of a few entries,
refined by rounds of nearest-entry assignment and componentwise floored means.

Rows are packed, where they lie and without a shuffle, into chunks. In a chunk each part's subvectors are sorted along a
Hilbert curve and cut into flat blocks, stored once with their least and greatest components and their sums. A round
compares boxes with entries: an entry whose least distance to a box is more than another entry's greatest distance
cannot be nearest to any row of it. A block with one entry left is assigned by its stored sums without looking at its
rows; in the others only the entries on the shortlist are evaluated, in 64-bit integers, so results do not depend on
order or partitions. Codebooks are the only thing that a round sends or brings back (parts x entries rows).

Defined results: rows whose vector is null or holds a null or non-finite component are dropped; integers are kept within
-2^27 and 2^27, where all sums of squares are exact; vectors shorter than the longest, or not divisible into parts, are
filled up with zeros; codebooks start from the first rows by id (null last), then vector, fewer than ``entries`` rows
giving fewer entries; repeated rows count each time; ties go to the lower entry; an empty table gives no rows. Other
columns travel along but for those in ``drop``, and input columns named code or error are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.llm.common import staged

LIMIT = 1 << 27


@dataclass(frozen=True)
class Plan:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096
    block: int = 64  # rows of a block
    chunk: int = 8192  # rows of a chunk


def hilbert_keys(points: np.ndarray) -> np.ndarray:
    """Places along a Hilbert curve through the points' own grid (integers, one row each)."""
    n, width = points.shape
    width = min(width, 32)
    bits = max(1, min(16, 64 // max(1, width)))
    x = points[:, :width].astype(np.float64)
    low = x.min(0, initial=np.inf)
    high = x.max(0, initial=-np.inf)
    cells = (x - low) / np.maximum(high - low, 1) * ((1 << bits) - 1)
    axes = [c.astype(np.uint64) for c in cells.T]
    one, zero = np.uint64(1), np.uint64(0)
    for b in range(bits - 1, 0, -1):  # undo the turns of the curve, from the coarsest level on
        low_bits = np.uint64((1 << b) - 1)
        for i in range(width):
            inverted = (axes[i] >> np.uint64(b)) & one == one
            swap = np.where(inverted, zero, (axes[0] ^ axes[i]) & low_bits)
            axes[0] = axes[0] ^ np.where(inverted, low_bits, swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, width):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(n, np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint64(b)) & one == one, np.uint64((1 << b) - 1), zero)
    key = np.zeros(n, np.uint64)
    for b in range(bits - 1, -1, -1):
        for a in axes:
            key = key << one | ((a ^ turn) >> np.uint64(b)) & one
    return key


@dataclass
class Chunk:
    """Per part, sorted: points (rows x width), places in the chunk, and the boxes and sums of its blocks."""

    points: np.ndarray
    places: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    edges: np.ndarray

    @classmethod
    def pack(cls, rows: np.ndarray, plan: Plan) -> Chunk:
        n, width = len(rows), rows.shape[1] // plan.parts
        edges = np.append(np.arange(0, n, plan.block), n)
        points = rows.reshape(n, plan.parts, width).transpose(1, 0, 2)
        places = np.stack([np.argsort(hilbert_keys(p), kind="stable") for p in points]).astype(np.int32)
        points = np.stack([p[at] for p, at in zip(points, places)]).astype(np.int32)
        fold = lambda how, x: how.reduceat(x, edges[:-1], axis=1)
        return cls(points, places, fold(np.minimum, points), fold(np.maximum, points),
                   fold(np.add, points.astype(np.int64)), edges)

    FIELDS = ("points", "places", "low", "high", "sums")

    def columns(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS]

    @classmethod
    def read(cls, n: int, width: int, stored: list, plan: Plan) -> Chunk:
        edges = np.append(np.arange(0, n, plan.block), n)
        blocks = len(edges) - 1
        kinds = [(np.int32, (n, width)), (np.int32, (n,)), (np.int32, (blocks, width)), (np.int32, (blocks, width)),
                 (np.int64, (blocks, width))]
        return cls(*[np.frombuffer(b, k).reshape(plan.parts, *s) for b, (k, s) in zip(stored, kinds)], edges)


def shortlists(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Blocks x entries: whether an entry may be nearest to a row of the block."""
    low, high = low[:, None, :].astype(np.int64), high[:, None, :].astype(np.int64)
    near = np.maximum(np.maximum(low - book, book - high), 0)
    far = np.maximum(np.abs(book - low), np.abs(high - book))
    return (near * near).sum(2) <= (far * far).sum(2).min(1, keepdims=True)


def nearest(points: np.ndarray, listed: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every row; ``listed`` (rows x entries) says which entries to evaluate."""
    best = np.full(len(points), np.iinfo(np.int64).max)
    entry = np.zeros(len(points), np.int64)
    for e in range(len(book)):
        at = np.flatnonzero(listed[:, e])
        gap = points[at].astype(np.int64) - book[e]
        far = np.einsum("ij,ij->i", gap, gap)
        less = far < best[at]  # a tie stays with the lower entry
        at = at[less]
        best[at], entry[at] = far[less], e
    return entry, best


def round_sums(chunk: Chunk, books: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add the chunk's rows to the counts and sums of their nearest entries."""
    sizes = np.diff(chunk.edges)
    for p, book in enumerate(books):
        listed = shortlists(chunk.low[p], chunk.high[p], book)
        sole = listed.sum(1) == 1
        entry = listed[sole].argmax(1)
        np.add.at(counts[p], entry, sizes[sole])
        np.add.at(sums[p], entry, chunk.sums[p][sole])
        if sole.all():
            continue
        rows = np.repeat(~sole, sizes)
        points = chunk.points[p][rows]
        entry, _ = nearest(points, np.repeat(listed[~sole], sizes[~sole], axis=0), book)
        for e in np.unique(entry):
            mine = points[entry == e]
            counts[p, e] += len(mine)
            sums[p, e] += mine.sum(0, dtype=np.int64)


def integers(column: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """Rows x dims of floor(scale * x), filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((len(column), dims), np.int64)
    if len(flat):
        at = np.repeat(np.arange(len(column)), lengths)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        out[at, pos] = np.clip(np.floor(flat * scale), -LIMIT, LIMIT)
    return out


def usable(rows: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector has only finite components."""
    finite = F.forall(F.col(f"`{vector_col}`"), lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    return rows.filter(F.col(f"`{vector_col}`").isNotNull() & F.coalesce(finite, F.lit(False)))


BLOCKS = "n int, given array<struct<{given}>>, points binary, places binary, low binary, high binary, sums binary"


def packed(rows: DataFrame, vector_col: str, dims: int, drop: tuple[str, ...], plan: Plan) -> DataFrame:
    """Chunks of the kept rows: their other columns, and per part the sorted blocks."""
    taken = {"code", "error"}
    carried = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in taken and c not in drop]
    base = rows.select(F.struct(F.lit(0).alias("_"), *carried).alias("given"),
                       F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("vector"))
    given = base.schema["given"].dataType
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("given", T.ArrayType(given)),
                           *[T.StructField(f, T.BinaryType()) for f in Chunk.FIELDS]])

    def chunked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        n = table.num_rows
        chunk = Chunk.pack(integers(table.column("vector").combine_chunks(), dims, plan.scale), plan)
        others = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), table.column("given").combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), others, *[pa.array([b], pa.binary()) for b in chunk.columns()]],
                                          names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_held = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, plan.chunk - rows_held)
                held.append(part)
                rows_held += part.num_rows
                batch = batch.slice(part.num_rows)
                if rows_held == plan.chunk:
                    yield chunked(held)
                    held, rows_held = [], 0
        if rows_held:
            yield chunked(held)

    return base.mapInArrow(run, schema)


def _chunks(batch: pa.RecordBatch, width: int, plan: Plan) -> Iterator[Chunk]:
    for i in range(batch.num_rows):
        stored = [batch.column(f)[i].as_buffer() for f in Chunk.FIELDS]
        yield Chunk.read(batch.column("n")[i].as_py(), width, stored, plan)


def trained(chunks: DataFrame, books: np.ndarray, plan: Plan) -> np.ndarray:
    """The codebooks (parts x entries x width) after all rounds, each one job over the chunks."""
    width = books.shape[2]
    schema = "part int, entry int, n long, sums array<long>"
    for _ in range(plan.rounds):
        now = books

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts, sums = np.zeros(now.shape[:2], np.int64), np.zeros(now.shape, np.int64)
            for batch in batches:
                for chunk in _chunks(batch, width, plan):
                    round_sums(chunk, now, counts, sums)
            part, entry = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]),
                 pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        per_task = chunks.select("n", *Chunk.FIELDS).mapInArrow(run, schema)
        whole = per_task.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
        books = books.copy()
        for row in whole.collect():  # parts x entries rows at most
            books[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    return books


def coded(chunks: DataFrame, books: np.ndarray, plan: Plan) -> DataFrame:
    """The rows with code and error, taken out of their chunks."""
    width = books.shape[2]
    given = chunks.schema["given"].dataType.elementType
    schema = T.StructType([T.StructField("given", given), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, chunk in enumerate(_chunks(batch, width, plan)):
                n = chunk.edges[-1]
                codes, error = np.zeros((n, plan.parts), np.uint8), np.zeros(n, np.int64)
                for p, book in enumerate(books):
                    listed = np.repeat(shortlists(chunk.low[p], chunk.high[p], book), np.diff(chunk.edges), axis=0)
                    entry, far = nearest(chunk.points[p], listed, book)
                    codes[chunk.places[p], p] = entry
                    error[chunk.places[p]] += far
                said = codes.tobytes().hex()
                step = 2 * plan.parts
                yield pa.RecordBatch.from_arrays(
                    [batch.column("given")[i].values, pa.array([said[k:k + step] for k in range(0, len(said), step)], pa.string()),
                     pa.array(error)], names=schema.names)

    return chunks.mapInArrow(run, schema)


@dataclass
class Codes:
    rows: DataFrame  # the kept rows with code and error
    books: np.ndarray  # parts x entries x width


def compressed(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", drop: tuple[str, ...] = (),
               plan: Plan = Plan()) -> Codes:
    """Train codebooks on all rows and code all rows."""
    kept = usable(rows, vector_col)
    vector = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    first = kept.select(F.col(f"`{id_col}`").alias("id"), vector.alias("vector")).orderBy(F.col("id").asc_nulls_last(), "vector").limit(plan.entries).collect()
    longest = kept.agg(F.max(F.size(F.col(f"`{vector_col}`")))).first()[0] or 1
    width = max(1, -(-longest // plan.parts))
    start = integers(pa.array([r["vector"] for r in first], pa.list_(pa.float64())), width * plan.parts, plan.scale)
    books = start.reshape(len(start), plan.parts, width).transpose(1, 0, 2)
    chunks = staged(packed(kept, vector_col, width * plan.parts, drop, plan), "vector-chunks")
    if len(start):
        books = trained(chunks, books, plan)
    return Codes(coded(chunks, books, plan).select("given.*", "code", "error").drop("_"), books)
