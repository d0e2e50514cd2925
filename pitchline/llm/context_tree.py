"""Code length of texts by context-tree weighting over bytes.

Texts are lower-cased (A-Z) and their words joined by one blank, with an end mark. Each byte is eight binary decisions;
every decision is predicted by a mixture, over all context depths from none to ``depth`` bytes, of Krichevsky-
Trofimov estimates, weighted by how well each depth would have coded the training texts. Every context that occurs is
in the tree: it lies in tables, one per depth, and grows with the corpus. Weights are worked out depth by depth, the
deepest first: the log probabilities of a context's extensions are summed by Spark under the (depth + 1)-gram they
share, and a task sees one context (at most 256 next bytes) at a time. Predictions go the other way, each gram from the
one a byte shorter, for the distinct grams of all texts, and reach the texts by a join (``byte_grams``).

The base model scores words alone: frequent ones (``word_share`` of all tokens, so at most ``1 / word_share`` words)
from a broadcast table, all others by a join with the counts. Defined results: null and empty texts have one token,
the end; null ids count as the empty text when folds are drawn; without training texts all counts are 0 and each byte
decision has probability one half; an empty table gives an empty result; every row gets its own scores.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.llm.byte_grams import Chunks, Values, context, padded, suffix, with_values
from pitchline.llm.common import crc_bucket, row_sums, slices, staged, utf8


CHUNK = 1024  # contexts whose binary nodes are worked out at a time


@dataclass(frozen=True)
class Tree:
    depth: int = 5
    share: float = 0.0  # the share of the training bytes that a context needs: none, and nothing else is accepted
    word_share: float = 1e-6
    folds: int = 10  # crc32 of the id, modulo this: 0 is held out
    add: float = 0.1  # the base model's additive smoothing


def words_joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one blank between them."""
    body = data.tobytes().lower()
    texts = [b" ".join(body[a:b].split()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Natural log of the gamma function for x >= 0.5 (shifted Stirling series)."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        shift[small] += np.log(y[small])
        y[small] += 1
    r = 1 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - shift


def node_counts(by_byte: np.ndarray) -> np.ndarray:
    """Counts of all binary prefixes of the next byte: node k has 2k for bit 0 and 2k+1 for bit 1."""
    out = np.zeros((len(by_byte), 512))
    out[:, 256:] = by_byte
    for k in range(255, 0, -1):
        out[:, k] = out[:, 2 * k] + out[:, 2 * k + 1]
    return out


def block_logs(counts: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov block probability of each of the 255 nodes."""
    zero, one = counts[:, 2:512:2], counts[:, 3:512:2]
    return log_gamma(zero + 0.5) + log_gamma(one + 0.5) - np.log(np.pi) - log_gamma(zero + one + 1)


def next_one(counts: np.ndarray) -> np.ndarray:
    zero, one = counts[:, 2:512:2], counts[:, 3:512:2]
    return (one + 0.5) / (zero + one + 1)


def byte_logs(one: np.ndarray) -> np.ndarray:
    """log10 of each byte's probability from the 255 binary predictions."""
    out = np.zeros((len(one), 512))
    for k in range(1, 256):
        out[:, 2 * k] = out[:, k] + np.log10(1 - one[:, k - 1])
        out[:, 2 * k + 1] = out[:, k] + np.log10(one[:, k - 1])
    return out[:, 256:].astype(np.float32)


class ContextTree:
    """The tree of given contexts in memory, with each one's byte logs: the tests' second way to the same values."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """``levels[d]``: the kept contexts of d bytes, sorted, and their [contexts, 256] next-byte counts."""
        depth = len(levels) - 1
        stop, below, parent = [], [], []  # by level: weight of ending here, counts in kept extensions, number above
        logs_below = np.zeros(0)
        for d in range(depth, -1, -1):
            contexts, by_byte = levels[d]
            n = len(contexts)
            if d == depth:
                below.insert(0, np.zeros((n, 0)))
            if d:
                above = len(levels[d - 1][0])
                up = np.searchsorted(levels[d - 1][0], contexts & np.uint64((1 << 8 * (d - 1)) - 1))
                next_below, next_logs = np.zeros((above, 256)), np.zeros((above, 255))
                np.add.at(next_below, up, by_byte)
            else:
                up = np.zeros(1, np.int64)
            parent.insert(0, up)
            weights = np.ones((n, 255), np.float32)
            for a in range(0, n, CHUNK):
                part = slice(a, a + CHUNK)
                logs = block_logs(node_counts(by_byte[part]))
                if d == depth:
                    weighted = logs
                else:
                    split = logs_below[part] + block_logs(node_counts(by_byte[part] - below[0][part]))
                    weighted = np.logaddexp(logs, split) + np.log(0.5)
                    weights[part] = np.exp(np.log(0.5) + logs - weighted)
                if d:
                    np.add.at(next_logs, up[part], weighted)
            stop.insert(0, weights)
            if d:
                below.insert(0, next_below)
                logs_below = next_logs
        tables = []
        mixed, left = np.zeros((1, 255), np.float32), np.ones((1, 255), np.float32)
        for d in range(depth + 1):
            contexts, by_byte = levels[d]
            n = len(contexts)
            table, new_mixed, new_left = np.empty((n, 256), np.float32), *(np.empty((n, 255), np.float32) for _ in range(2))
            for a in range(0, n, CHUNK):
                part = slice(a, a + CHUNK)
                up = parent[d][part]
                one = mixed[up] + left[up] * stop[d][part] * next_one(node_counts(by_byte[part]))
                new_mixed[part], new_left[part] = one, left[up] * (1 - stop[d][part])
                if d < depth:
                    one = one + new_left[part] * next_one(node_counts(by_byte[part] - below[d][part]))
                table[part] = byte_logs(np.clip(one, 1e-12, 1 - 1e-12))
            mixed, left = new_mixed, new_left
            tables.append(table)
        self.table = np.concatenate(tables).reshape(-1)


def weighted_nodes(grams: np.ndarray, n: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted grams of whole contexts, by bit of the last byte: the node's log probability, shares of this depth.

    A node (a context and the leading bits of the next byte) is shared by the grams that begin with those bits. Its log
    probability stands at the least of them and is 0 at the others, so that sums over grams count each node once.
    ``below`` has such sums of the context's extensions; without it, contexts end here. The share of this depth in a
    prediction is (weight of ending here) * (estimate of the gram's own bit), what is left to deeper ones the rest.
    """
    logs, here, left = np.zeros((len(grams), 8)), np.zeros((len(grams), 8), np.float32), np.zeros((len(grams), 8), np.float32)
    n = n.astype(np.float64)
    for j in range(8):
        node = grams >> (8 - j)
        edge = np.concatenate([[True], node[1:] != node[:-1]])
        first, number = np.flatnonzero(edge), np.cumsum(edge) - 1
        bit = (grams >> (7 - j)) & 1
        ones, visits = np.add.reduceat(n * bit, first), np.add.reduceat(n, first)
        block = log_gamma(visits - ones + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(visits + 1)
        if below is None:
            weighted, stop = block, np.ones(len(first))
        else:
            weighted = np.logaddexp(block, np.add.reduceat(below[:, j], first)) + np.log(0.5)
            stop = np.exp(np.log(0.5) + block - weighted)
        logs[first, j] = weighted
        estimate = (np.where(bit == 1, ones[number], (visits - ones)[number]) + 0.5) / (visits[number] + 1)
        here[:, j], left[:, j] = stop[number] * estimate, 1 - stop[number]
    return logs, here, left


BITS = range(8)
NODES = [*[f"v{j}" for j in BITS], *[f"h{j}" for j in BITS], *[f"l{j}" for j in BITS]]


def weighted_level(table: DataFrame, deepest: bool) -> DataFrame:
    """``table`` (gram, n and, unless it is the deepest, the sums v0 .. v7 of the extensions) with its nodes' columns."""

    def run(batches):
        held: pa.RecordBatch | None = None

        def done(t: pa.Table) -> pa.RecordBatch:
            grams, n = (t.column(c).to_numpy() for c in ("gram", "n"))
            below = None if deepest else np.column_stack([t.column(f"v{j}").to_numpy() for j in BITS])
            columns = [x[:, j] for x in weighted_nodes(grams, n, below) for j in BITS]
            return pa.RecordBatch.from_arrays([pa.array(grams), pa.array(n), *map(pa.array, map(np.ascontiguousarray, columns))], names=["gram", "n", *NODES])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            contexts = rows.column("gram").to_numpy() >> 8
            whole = int(np.searchsorted(contexts, contexts[-1]))  # the last context may go on in the next batch
            if whole:
                yield done(rows.slice(0, whole))
            held = rows.slice(whole).combine_chunks()
        if held is not None:
            yield done(held)

    schema = "gram long, n long, " + ", ".join(f"{c} {'double' if c[0] == 'v' else 'float'}" for c in NODES)
    dealt = table.repartition(context(F.col("gram"))).sortWithinPartitions("gram")
    return dealt.mapInArrow(run, schema)


def train(grams: DataFrame, depth: int) -> list[DataFrame]:
    """The weighted contexts of every depth, none to ``depth`` bytes, from (gram, n) of depth + 1 bytes; n may be 0."""
    tables: list[DataFrame] = []
    table = grams
    for d in range(depth, -1, -1):
        if tables:
            sums = [F.sum(c).alias(c) for c in ("n", *NODES[:8])]
            table = tables[0].groupBy(suffix(F.col("gram"), d + 1).alias("gram")).agg(*sums)
        tables.insert(0, staged(weighted_level(table, d == depth), "context-level"))
    return tables


def predicted(tables: list[DataFrame]) -> DataFrame:
    """(gram, value) for the grams of the deepest table: log10 of the last byte's probability after the bytes before it."""
    out = tables[0].select("gram", *[F.col(f"h{j}").cast("double").alias(f"p{j}") for j in BITS], *[F.col(f"l{j}").cast("double").alias(f"r{j}") for j in BITS])
    for d, table in enumerate(tables[1:], 1):
        own = table.select(F.col("gram").alias("own"), suffix(F.col("gram"), d).alias("gram"), *NODES[8:])
        mixed = [(F.col(f"p{j}") + F.col(f"r{j}") * F.col(f"h{j}")).alias(f"p{j}") for j in BITS]
        out = own.join(out, "gram").select(F.col("own").alias("gram"), *mixed, *[(F.col(f"r{j}") * F.col(f"l{j}")).alias(f"r{j}") for j in BITS])
    return out.select("gram", reduce(lambda a, b: a + b, [F.log10(f"p{j}") for j in BITS]).alias("value"))


def word_counts(docs: DataFrame, text_col: str = "text", most: int = 500_000) -> DataFrame:
    """(word, n) over all texts; each task adds up its words first, in tables of a bounded size."""

    def run(batches):
        held: Counter = Counter()

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in (part for whole in batches for part in slices(whole, 0)):
            data, _ = utf8(batch.column(0))
            # Words do not cross texts: a line end is put between them.
            held.update(b"\n".join((t or "").encode() for t in batch.column(0).to_pylist()).lower().split())
            if len(held) > most:
                yield emptied()
        if held:
            yield emptied()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tree: Tree = Tree()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte for every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("held_out", crc_bucket("doc_id", tree.folds) == 0)
    learn = rows.filter("not held_out")
    if tree.share:
        raise ValueError("no context is left out of the tree: share has to be 0")
    order = tree.depth + 1
    chunked = Chunks(rows.withColumn("learn", ~F.col("held_out")), "text", order, "context-grams", words_joined, "learn")
    values = predicted(train(chunked.grams(), tree.depth))
    counts = staged(word_counts(learn), "word-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = learn.count()
    train_tokens, distinct = sums["n"] + ends, sums["v"] + (ends > 0)
    frequent = F.col("n") >= max(1.0, tree.word_share * train_tokens)
    head = counts.filter(frequent).toPandas()  # at most 1 / word_share words
    logs = {bytes(w): float(np.log10(n + tree.add)) for w, n in zip(head["word"], head["n"])}
    shared = spark.sparkContext.broadcast(logs)
    end_log, end_known = float(np.log10(ends + tree.add)), int(ends > 0)

    def make():
        known = shared.value

        def step(texts: pa.Array, lm: Values) -> list:
            data, offsets = words_joined(*utf8(texts))
            stream, lengths = padded(data, offsets, order - 1)
            total = row_sums(lm.along(stream, order), lengths)
            body = data.tobytes()
            n, found, base, tail, cuts = [], [], [], [], [0]
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                words = body[a:b].split()
                values = list(map(known.get, words))
                rare = [w for w, v in zip(words, values) if v is None]
                n.append(len(words) + 1)
                found.append(len(words) - len(rare) + end_known)
                base.append(sum(v for v in values if v is not None) + end_log)
                tail.extend(rare)
                cuts.append(len(tail))
            rare = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(tail, pa.binary()))
            return [pa.array(n, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()), pa.array(total),
                    pa.array(-total / np.log10(2) / lengths), rare]

        return step

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("head_known", T.LongType()),
              T.StructField("head_log", T.DoubleType()), T.StructField("score", T.DoubleType()),
              T.StructField("bits_per_byte", T.DoubleType()), T.StructField("rare", T.ArrayType(T.BinaryType()))]
    first = staged(with_values(chunked, values, make, fields, ("text", "learn")).withColumn("row", F.monotonically_increasing_id()), "context-scores")
    others = first.select("row", F.explode("rare").alias("word")).join(counts.filter(~frequent), "word", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    tails = others.groupBy("row").agg(F.sum((n > 0).cast("long")).alias("tail_known"),
                                      F.sum(F.log10(n + F.lit(tree.add))).alias("tail_log"))
    each = float(np.log10(train_tokens + tree.add * (distinct + 1)))
    return first.drop("rare").join(tails, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(int(train_tokens)).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        "score", "bits_per_byte")
