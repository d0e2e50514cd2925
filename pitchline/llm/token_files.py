"""Token-id files in patched frame-of-reference blocks.

Documents are cut into shards by ranges of their id, so that the files in shard order hold them in ascending order.
A file row is a segment of whole documents: their ids and token counts, and a payload of blocks. Each block subtracts
its minimum, packs at the width that a percentile of its values needs (bit plane by bit plane), and lists the values beyond as exceptions; the
payload indexes where each block starts. Spark writes the rows as Parquet, so a lost executor leaves no half file.

Defined results: a null or empty text has only the end id; a null id sorts first; rows with equal ids sort by text and
each keeps its own tokens; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchline.llm.common import ragged, row_sums, slices, tidy, utf8

MAGIC = b"PFR1"
BLOCK = 512
RUN = 1000  # pieces of one text for the tokenizer


@dataclass(frozen=True)
class Format:
    percentile: float = 0.95  # share of a block's values that its width must hold
    shard_bytes: int = 64 << 20  # text of a shard, about: the larger, the more often a task meets a piece again
    segment: int = 1 << 18  # ids after which a segment closes at the next document end
    cached: int = 400_000  # distinct text pieces whose ids a task remembers


def widths(deltas: np.ndarray, percentile: float) -> np.ndarray:
    """Bits per block: what the given percentile of its values needs."""
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    limit = np.partition(deltas, at, axis=1)[:, at]
    return np.ceil(np.log2(limit.astype(np.float64) + 1)).astype(np.uint8)


def pack(values: np.ndarray, percentile: float = Format.percentile) -> bytes:
    """A payload of blocks: header, block starts, minima, widths, exception counts, packed bits, exceptions."""
    n = len(values)
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[:n] = values
    if n:
        grid[n:] = values[n - 1]  # fills the last block without widening it
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    deltas = grid - low[:, None]
    bits = widths(deltas, percentile) if blocks else np.zeros(0, np.uint8)
    sizes = bits.astype(np.int64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint32)
    packed = np.zeros(int(starts[-1]), np.uint8)
    patched = np.zeros((blocks, BLOCK), bool)
    for w in np.unique(bits).tolist():
        rows = np.flatnonzero(bits == w)
        part = deltas[rows]
        patched[rows] = part >= np.uint64(1) << np.uint64(w)
        if w:
            planes = [np.packbits(((part >> np.uint32(k)) & np.uint32(1)).astype(np.uint8), axis=1) for k in range(w)]
            body = np.stack(planes, axis=1).reshape(len(rows), -1)
            packed[ragged(starts[rows].astype(np.int64), np.full(len(rows), body.shape[1]))] = body.reshape(-1)
    where = np.nonzero(patched)
    head = MAGIC + np.array([n, blocks, len(where[0])], "<u4").tobytes()
    parts = (starts.astype("<u4"), low.astype("<u4"), bits, patched.sum(axis=1).astype("<u2"), packed,
             where[1].astype("<u2"), deltas[where].astype("<u4"))
    return head + b"".join(p.tobytes() for p in parts)


def unpack(payload: bytes) -> np.ndarray:
    if payload[:4] != MAGIC:
        raise ValueError("not a token payload")
    n, blocks, exceptions = np.frombuffer(payload, "<u4", 3, 4).tolist()
    at = 16

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, count, at)
        at += out.nbytes
        return out

    starts, low, bits, patched = take("<u4", blocks + 1), take("<u4", blocks), take("u1", blocks), take("<u2", blocks)
    packed = take("u1", int(starts[-1]))
    place, value = take("<u2", exceptions), take("<u4", exceptions)
    grid = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(bits).tolist():
        if w:
            rows = np.flatnonzero(bits == w)
            body = packed[ragged(starts[rows].astype(np.int64), np.full(len(rows), w * BLOCK // 8))].reshape(len(rows), w, -1)
            part = np.zeros((len(rows), BLOCK), np.uint32)
            for k in range(w):
                part |= np.unpackbits(body[:, k], axis=1).astype(np.uint32) << np.uint32(k)
            grid[rows] = part
    grid[np.repeat(np.arange(blocks), patched), place] = value
    return (grid + low[:, None]).reshape(-1)[:n]


# An A-Z before one of these would be put together differently once it is in lower case.
ACCENTED = re.compile("[A-Z][\u0300-\u036f]")
MARKS = "!#$%&*+,./:;=?@~"
# No token spans one of these letters or digits and a mark behind it.
BEHIND = f"([a-z0-9ß-öø-ÿ])([{MARKS}])"
# A word of letters and perhaps one of marks behind it; the tokenizer never makes fewer words of these.
SIMPLE = re.compile(rf"[^\W\d_]+([{MARKS}]*)")


def plain(text: str) -> str:
    """The text with A-Z in lower case where the tokenizer, which lower-cases itself, sees no difference.

    Special tokens are found in the text as it is, so pieces with their opening mark stay as they are.
    """
    if "<|" in text:
        return " ".join(piece if "<|" in piece else plain(piece) for piece in text.replace("\n", " ").split(" "))
    if text.isascii() or not ACCENTED.search(text):
        return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return text


class Pieces(dict):
    """Numbers for text pieces; new ones wait until the tokenizer has given their ids."""

    def __init__(self, tokenizer, last: np.ndarray | None = None):
        super().__init__()
        self.tokenizer = tokenizer
        if last is None:
            last = self.word_ends(tokenizer)
        self.last = last
        self.waiting: list[tuple[int, str]] = []  # for the tokenizer
        self.ids = np.zeros(1 << 16, np.uint32)
        self.end = 0
        self.starts = np.zeros(1 << 16, np.int64)
        self.sizes = np.zeros(1 << 16, np.int64)
        self.uses = np.zeros(1 << 16, np.int64)

    @staticmethod
    def word_ends(tokenizer) -> np.ndarray:
        """Of each id: whether a word ends with it; empty if the tokenizer does not tell."""
        suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
        if not suffix:
            return np.zeros(0, bool)
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return last

    def trimmed(self, most: int) -> Pieces:
        """Itself up to ``most`` pieces; beyond, half as many: those used most often, of equal ones those met first."""
        if len(self) <= most:
            return self
        out = Pieces(self.tokenizer, self.last)
        kept = np.sort(np.argsort(-self.uses[:len(self)], kind="stable")[:most // 2])
        stays = np.zeros(len(self), bool)
        stays[kept] = True
        out.update(zip(compress(self, stays.tolist()), range(len(kept))))  # a piece's number is its place
        out.ids, out.end = self.ids[ragged(self.starts[kept], self.sizes[kept])], int(self.sizes[kept].sum())
        out.sizes, out.uses = self.sizes[kept], self.uses[kept]
        out.starts = np.cumsum(out.sizes) - out.sizes
        return out

    def __missing__(self, piece: str) -> int:
        number = self[piece] = len(self)
        self.waiting.append((number, piece))
        return number

    def _place(self, numbers: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        if self.end + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(flat), np.uint32)])
        self.ids[self.end:self.end + len(flat)] = flat
        self.starts[numbers], self.sizes[numbers] = self.end + np.cumsum(sizes) - sizes, sizes
        self.end += len(flat)

    def settle(self) -> None:
        """Give all new pieces their ids.

        Most pieces are one or two words, so many go to the tokenizer as one text, whose word ends part them again.
        """
        if len(self) > len(self.starts):
            more = np.zeros(len(self), np.int64)
            self.starts, self.sizes, self.uses = (np.concatenate([x, more]) for x in (self.starts, self.sizes, self.uses))
        simple, others = [], []
        for number, piece in self.waiting:
            if not len(self.last):
                others.append((number, piece))
            elif piece.isalpha():
                simple.append((number, piece, 1))
            elif found := SIMPLE.fullmatch(piece):
                simple.append((number, piece, 2 if found[1] else 1))
            else:
                others.append((number, piece))
        for a in range(0, len(simple), RUN):
            number, part, made = zip(*simple[a:a + RUN])
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends, words = np.flatnonzero(self.last[ids]) + 1, np.cumsum(made)
            if len(ends) == words[-1] and ends[-1] == len(ids):
                self._place(np.array(number, np.int64), np.diff(ends[words - 1], prepend=0), ids)
            else:
                others += zip(number, part)
        for a in range(0, len(others), 2_000):  # an encoding is large until its ids are taken
            part = others[a:a + 2_000]
            fresh = [e.ids for e in self.tokenizer.encode_batch_fast([p for _, p in part], add_special_tokens=False)]
            sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
            flat = np.fromiter(chain.from_iterable(fresh), np.uint32, int(sizes.sum()))
            self._place(np.fromiter((n for n, _ in part), np.int64, len(part)), sizes, flat)
        self.waiting.clear()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and each text's count.

        No token spans white space, so a text's ids are those of its pieces between blanks, line ends and before marks.
        """
        cut = pc.replace_substring_regex(pa.array([plain(text).replace("\n", " ") if text else None for text in texts], pa.large_string()),
                                         BEHIND, r"\1 \2")
        counts = pc.fill_null(pc.add(pc.count_substring(cut, " "), 1), 0).to_numpy()
        if not counts.any():
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        found = pc.split_pattern(cut, " ").flatten().dictionary_encode()
        data, offsets = utf8(found.dictionary)
        different = np.insert(data, offsets[1:-1], ord(" ")).tobytes().decode().split(" ")  # a list, as pieces have no blanks
        numbers = np.fromiter(map(self.__getitem__, different), np.int64, len(different))
        self.settle()
        which = found.indices.to_numpy()
        self.uses[numbers] += np.bincount(which, minlength=len(numbers))
        number = numbers[which]
        length = self.sizes[number]
        return self.ids[ragged(self.starts[number], length)], row_sums(length, counts).astype(np.int64)


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id",
          text_col: str = "text", form: Format = Format()) -> None:
    """Encode whole texts in ascending id order and write the shards under ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_file)
        shard, segment, first = TaskContext.get().partitionId(), 0, 0
        pieces = Pieces(tokenizer)
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal segment, first, size
            ids, sizes, tokens = ([x[i] for x in held] for i in range(3))
            body = np.concatenate(tokens)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([segment], pa.int32()), pa.array([first], pa.int64()),
                 pa.array([len(body)], pa.int64()), pa.array([[i for x in ids for i in x]], pa.list_(pa.int64())),
                 pa.array([np.concatenate(sizes)], pa.list_(pa.int64())),
                 pa.array([pack(body, form.percentile)], pa.binary())],
                names=["shard", "segment", "first", "n", "doc_ids", "sizes", "payload"])
            segment, first, size = segment + 1, first + len(body), 0
            held.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole, 1)):
            pieces = pieces.trimmed(form.cached)
            tokens, counts = pieces.encode(batch.column(1).to_pylist())
            ends = np.cumsum(counts + 1)
            body = np.full(int(ends[-1]) if len(ends) else 0, end_id, np.uint32)
            body[ragged(ends - counts - 1, counts)] = tokens
            ids = batch.column(0).to_pylist()
            a = 0
            while a < len(ids):  # whole documents up to the segment's size
                base = int(ends[a - 1]) if a else 0
                b = min(len(ids), int(np.searchsorted(ends, base + form.segment - size, side="left")) + 1)
                held.append((ids[a:b], counts[a:b] + 1, body[base:int(ends[b - 1])]))
                size += int(ends[b - 1]) - base
                if size >= form.segment:
                    yield close()
                a = b
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    ordered = rows.repartitionByRange(size // form.shard_bytes + 1, "doc_id").sortWithinPartitions("doc_id", "text")
    schema = "shard int, segment int, first long, n long, doc_ids array<long>, sizes array<long>, payload binary"
    ordered.mapInArrow(tidy(run), schema).write.parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The file rows with ``start``: the ids in all files before each segment."""
    files = spark.read.parquet(path)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    bases = files.groupBy("shard").agg(F.sum("n").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return files.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("first"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files."""
    return _decoded(segments(spark, path), "ids array<long>", lambda ids: ids.astype(np.int64),
                    lambda parts: pa.array(parts, pa.list_(pa.int64())))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files."""
    return _decoded(segments(spark, path), "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()),
                    lambda parts: pa.array(parts, pa.int64()))


def _decoded(files: DataFrame, column: str, of, collect) -> DataFrame:
    name = column.split()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, sizes, payload, start = (batch.column(k)[i] for k in range(4))
                tokens = unpack(payload.as_py())
                size = sizes.values.to_numpy()
                ends = np.cumsum(size)
                parts = [of(tokens[a:b]) for a, b in zip((ends - size).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(start.as_py() + ends - size), pa.array(size), collect(parts)],
                    names=["doc_id", "start", "n_tokens", name])

    return files.select("doc_ids", "sizes", "payload", "start").mapInArrow(
        tidy(run), f"doc_id long, start long, n_tokens long, {column}")
