"""N-gram Jaccard join by MinHash banding.

Texts are sets of word n-grams (words lower-cased A-Z; a shorter text is one n-gram of all its words). The number of
bands follows from the target recall at the threshold. One row per different word sequence goes into the banding, with
its number of copies, so copies never meet as pairs. Band hashes are shuffled; each group of equal hashes links its
members to its least one, and what is connected so forms a cell: every pair that shares a band lies within one. In a
cell, texts are dealt into tiles, and each pair of tiles is one task group, in which all pairs of texts are verified on
their full n-gram sets (64-bit n-gram hashes). A tile pair returns one row per text: links found and a text it
is connected to; pairs are never rows. Verified links make the groups.

Defined results: null texts and texts without words have no n-grams and no links, not even to each other; n_links
counts all other rows whose text is similar enough, copies included; a group's id is the least id of its rows; ids may
be null (greater than none) or repeated; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.llm.common import WORD, appended, mix, staged, utf8
from pitchline.llm.shingles import row_minimum, shingle_hashes, word_hashes

PART = 1 << 18  # bytes of text taken at once: hashes need some fifty times as much


@dataclass(frozen=True)
class Join:
    size: int = 5
    similarity: float = 0.8
    recall: float = 0.99999  # chance that a pair at the threshold shares a band
    rows: int = 6  # minhashes in a band
    tile: int = 256  # texts in a tile, on average
    seed: int = 7

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity ** self.rows))


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def text_keys(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text's word sequence."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
    value = mix(words + mix(place + np.uint64(1)))
    out = np.zeros(len(counts), np.uint64)
    full = counts > 0
    if full.any():
        out[full] = np.add.reduceat(value, (np.cumsum(counts) - counts)[full])
    return mix(out + counts.astype(np.uint64))


def band_hashes(grams: np.ndarray, counts: np.ndarray, join: Join) -> np.ndarray:
    """[texts, bands]: one hash of ``rows`` minhashes per band."""
    factors = mix(np.arange(1, join.bands * join.rows + 1, dtype=np.uint64) + np.uint64(join.seed << 32)) | np.uint64(1)
    out = np.empty((len(counts), join.bands), np.uint64)
    for band in range(join.bands):
        key = np.full(len(counts), band, np.uint64)
        for factor in factors[band * join.rows:(band + 1) * join.rows]:
            key = mix(key + row_minimum(grams * factor, counts))
        out[:, band] = key
    return out


def signed(docs: DataFrame, text_col: str, join: Join, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with __key (word sequence; null without words) and __bands."""

    def make():
        def step(texts: pa.Array) -> list:
            data, offsets = utf8(texts)
            words, counts = word_hashes(lowered(data), offsets)
            keys = pa.array(text_keys(words, counts).view(np.int64), mask=counts == 0)
            bands = band_hashes(*shingle_hashes(words, counts, join.size), join).view(np.int64)
            cuts = np.arange(len(counts) + 1, dtype=np.int32) * join.bands
            return [keys, pa.ListArray.from_arrays(pa.array(cuts), pa.array(bands.reshape(-1)))]

        return step

    return appended(docs, make, [T.StructField("__key", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType()))], text_col, drop, PART)


def sets(docs: DataFrame, text_col: str, join: Join) -> DataFrame:
    """``docs`` with __key and __grams, the sorted distinct n-gram hashes; without the text."""

    def make():
        def step(texts: pa.Array) -> list:
            data, offsets = utf8(texts)
            words, counts = word_hashes(lowered(data), offsets)
            grams, made = shingle_hashes(words, counts, join.size)
            parts = [np.unique(p) for p in np.split(grams, np.cumsum(made)[:-1])] if len(made) else []
            cuts = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
            return [pa.array(text_keys(words, counts).view(np.int64), mask=counts == 0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))]

        return step

    fields = [T.StructField("__key", T.LongType()), T.StructField("__grams", T.ArrayType(T.LongType()))]
    return appended(docs, make, fields, text_col, (text_col,), PART)


def contracted(edges: DataFrame) -> DataFrame:
    """Edges that connect the same nodes: each node with its least neighbour, and its other lesser ones with that one.

    ``node`` is greater than ``other``, before and after.
    """
    least = edges.groupBy("node").agg(F.min("other").alias("least"))
    rest = edges.join(least, "node").filter("other <> least").select(F.col("other").alias("node"), F.col("least").alias("other"))
    return least.select("node", F.col("least").alias("other")).unionByName(rest).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for the nodes of (node, other) edges: label is the least node connected. Rounds double the reach.

    Two contractions leave about one edge a node, so a round's rows grow with the nodes and not with bands or tiles.
    """
    few = edges.filter("node <> other").select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct()
    for _ in range(2):
        few = staged(contracted(few), name)
    both = staged(few.unionByName(few.select(F.col("other").alias("node"), F.col("node").alias("other"))), name)
    labels = staged(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        # A neighbour's label may itself have a lower label by now.
        far = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = labels.join(near, "node").join(far, "near", "left")
        new = staged(new.select("node", F.least("label", "near", "far").alias("new"), F.col("label").alias("old")), name)
        if new.filter("new <> old").isEmpty():
            return labels
        labels = new.select("node", F.col("new").alias("label"))


def least_linked(keys: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The least key that each text is connected to: labels spread along links until nothing changes."""
    least = keys.copy()
    while True:
        reach = np.minimum(least, np.where(linked, least[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (reach == least).all():
            return least
        least = reach


def verified(part: pa.Table, similarity: float) -> pa.Table:
    """All similar pairs of one tile pair, reduced to a row per text: copies linked to it, and a text it is connected to.

    Each tile's own task connects its texts to the least of their group within the tile; a pair of tiles connects only
    these least texts, so the edges of one large group are its texts and one for each pair of tiles.
    """
    keys = part.column("__key").to_numpy()
    copies = part.column("copies").to_numpy()
    tile = part.column("tile").to_numpy()
    column = part.column("__grams").combine_chunks()
    grams = column.flatten().to_numpy()
    sizes = np.diff(np.asarray(column.offsets))
    owner = np.repeat(np.arange(len(keys)), sizes)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    new = np.concatenate([[True], grams[1:] != grams[:-1]]) if len(grams) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    often = np.bincount(number, minlength=1) > 1  # an n-gram of one text is in no intersection
    use = often[number] if len(number) else np.zeros(0, bool)
    dense = np.cumsum(often) - 1
    column_of, owner = dense[number[use]], owner[use]
    both = np.zeros((len(keys), len(keys)), np.float32)
    step = 4096
    for a in range(0, int(often.sum()), step):
        lo, hi = np.searchsorted(column_of, [a, a + step])
        block = np.zeros((len(keys), step), np.float32)
        block[owner[lo:hi], column_of[lo:hi] - a] = 1
        both += block @ block.T  # counts stay far below the exact range of a 32-bit float, per block
    linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    same = tile[:, None] == tile[None, :]
    least = least_linked(keys, linked & same)
    if tile.min() != tile.max():
        least = np.where(least == keys, least_linked(keys, linked), keys)
        linked &= ~same
    return pa.table({"__key": keys, "links": linked @ copies, "label": least})


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """(doc_id, class_id, n_links, text_key, group, text_hash) for every row; the group is null where a text has no words."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    rows = staged(signed(base, "text", join, ("text",)), "join-signatures")
    worded = rows.filter("__key is not null")
    classes = worded.groupBy("__key").agg(F.count(F.lit(1)).alias("copies"), F.first("__bands").alias("bands"))
    members = staged(classes.select("__key", "copies", F.posexplode("bands").alias("band", "hash")), "join-bands")
    groups = members.groupBy("band", "hash").agg(F.min("__key").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    edges = members.join(groups, ["band", "hash"]).select(F.col("__key").alias("node"), F.col("least").alias("other")).distinct()
    cells = components(edges, "join-cells")
    sized = cells.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / join.tile).cast("int").alias("tiles"))
    counted = worded.groupBy("__key").agg(F.count(F.lit(1)).alias("copies"), F.min_by("doc_id", F.struct(F.col("doc_id").isNull(), "doc_id")).alias("doc_id"))
    dealt = staged(cells.join(sized, "label").join(counted, F.col("node") == F.col("__key")).select(
        "__key", "doc_id", "copies", F.col("label").alias("cell"), "tiles",
        F.pmod(F.xxhash64("__key"), F.col("tiles")).cast("int").alias("tile")), "join-dealt")
    # One row per text of a cell: its own document's n-grams, found again by id and checked by key.
    found = base.join(dealt.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    grams = sets(found.select("text"), "text", join).dropDuplicates(["__key"])
    spread = dealt.join(grams, "__key").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    spread = spread.select("__key", "copies", "tile", "__grams", "cell", F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j"))
    similarity = join.similarity
    checked = staged(spread.groupBy("cell", "i", "j").applyInArrow(
        lambda part: verified(part, similarity), "__key long, links long, label long"), "join-links")
    links = checked.groupBy("__key").agg(F.sum("links").alias("links"))
    labels = components(checked.filter("label <> __key").select(F.col("__key").alias("node"), F.col("label").alias("other")), "join-groups")
    facts = worded.groupBy("__key").agg(F.count(F.lit(1)).alias("copies")).join(links, "__key", "left").join(
        labels.withColumnRenamed("node", "__key"), "__key", "left")
    facts = facts.select("__key", F.coalesce("label", "__key").alias("group"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    marked = rows.select("doc_id", "__key", "text_hash").join(facts, "__key", "left")
    ids = marked.filter("group is not null").groupBy("group").agg(F.min("doc_id").alias("class_id"))
    return marked.join(ids, "group", "left").select(
        "doc_id", F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("__key").alias("text_key"), "group", "text_hash")


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """(doc_id, class_id, n_links, text_key) for every row."""
    return grouped(docs, id_col, text_col, join).drop("group", "text_hash")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", join: Join = Join()) -> DataFrame:
    """``docs`` with one row of each group: the least id (null if all are), then the least key and hash of the text; rows
    without words all stay. The rows themselves do not pass through Python: their id and hash find them again."""
    marked = grouped(docs, id_col, text_col, join).filter("text_key is not null")
    least = marked.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "text_hash")).alias("least"))
    kept = staged(least.select(F.col("least.doc_id").alias("__id"), F.col("least.text_hash").alias("__hash")), "join-kept")
    worded = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    rows = docs.withColumn("__text_hash", F.xxhash64(F.col(text_col)))
    chosen = rows.filter(worded).join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__text_hash") == F.col("__hash")), "left_semi")
    one = chosen.dropDuplicates([id_col, "__text_hash"])
    return one.unionByName(rows.filter(~worded)).select(*[F.col(f"`{c}`") for c in docs.columns])
