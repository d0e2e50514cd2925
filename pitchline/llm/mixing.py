"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is permuted by a seeded hash and cut into equal stretches of words, its blocks. A source's quota is a
number of blocks (more than it has, if it is repeated). The quotas of all sources are split exactly among the output
shards by a binary tree: at each node the left half draws its blocks without replacement from the node's blocks, so
the sources' counts are multivariate-hypergeometric. The shards then take disjoint runs of each source's permuted
blocks, and rows are shuffled within their shard. DataFrame functions only; all large steps work on ids and sizes.

Defined results: a null text counts as empty; a null source is a source of its own and comes last; a source without
words has target 0 and is not drawn; empty texts go with their block; rows equal in id, source and text share their
draws; ids may be null; an empty table gives an empty result; other columns travel along and those named like a new
column (size, source_size, target, block, draws, shard, position_key) are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchline.llm.common import WORD, staged


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (5.0, 2.0, 1.0)  # by source in code-point order, repeating
    most: int = 3  # a source's target stops at this multiple of its size
    blocks: int = 1024  # blocks of a source, and of its target where that is smaller
    levels: int = 4  # of the splitting tree: 2 ** levels output shards
    seed: int = 8
    strips: int = 4096  # hash strips in which running sums and ranks are taken; copies of one row made at a time

    @property
    def shards(self) -> int:
        return 1 << self.levels


NEW = ("size", "source_size", "target", "block", "draws", "shard", "position_key")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def units(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """Distinct (id, source, text hash) with the words of one row and the number of equal rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
                       F.xxhash64(text_col).alias("hash"), word_count(F.col(text_col)).alias("size"))
    return rows.groupBy("id", "source", "hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("copies"))


def targets(rows: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sid, source, source_size, target, blocks, quota (blocks): one row per source, so the windows here are small.

    A source's blocks are small against its target too, however small a part of the source that is.

    With sources ordered by how soon they reach their limit, the ones before the first that stays below it stop at
    their limits, and the rest share what is left by weight.
    """
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod(F.col("sid"), F.lit(len(mix.weights))) + 1).cast("int"))
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"))
    listed = sums.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    whole = Window.partitionBy()
    listed = listed.withColumn("weight", weight).withColumn("limit", (mix.most * F.col("source_size")).cast("double"))
    listed = listed.withColumn("total", F.sum("source_size").over(whole)).withColumn("weights", F.sum("weight").over(whole))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    rate = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    listed = listed.withColumn("rate", rate)
    at = F.col("limit") / F.col("weight")
    rate = F.min(F.when(F.col("rate") <= at, F.struct(at, "sid", "rate"))).over(whole)["rate"]
    target = F.least(F.col("limit"), F.coalesce(rate * F.col("weight"), F.col("limit")))
    share = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    finer = F.least(F.ceil(mix.blocks / F.nullif(share, F.lit(0.0))), F.col("source_size"))
    blocks = F.greatest(F.lit(mix.blocks), F.coalesce(finer, F.lit(0))).cast("long")
    return listed.withColumn("target", target).select(
        "sid", "source", "source_size", "target", blocks.alias("blocks"), F.round(share * blocks).cast("long").alias("quota"))


def split(quotas: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(sid, shard, quota) from (sid, quota): the splitting tree, level by level.

    The blocks of a node that have the smallest seeded hashes go left. Only the hash strip in which the left half
    ends is ranked row by row; whole strips before it go left.
    """
    nodes = quotas.select(F.lit(1).cast("long").alias("node"), "sid", "quota")
    for level in range(mix.levels):
        drawn = nodes.filter("quota > 0").select("node", "sid", F.explode(F.sequence(F.lit(1).cast("long"), "quota")).alias("u"))
        key = F.xxhash64(F.lit(mix.seed + level), "node", "sid", "u")
        drawn = drawn.withColumn("key", key).withColumn("strip", F.pmod("key", F.lit(mix.strips)))
        sizes = drawn.groupBy("node", "strip").agg(F.count(F.lit(1)).alias("n"))
        by_node = Window.partitionBy("node")
        edges = sizes.select(
            "node", "strip", (F.sum("n").over(by_node.orderBy("strip").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"),
            F.expr("sum(n) over (partition by node) div 2").alias("half"))
        within = F.row_number().over(Window.partitionBy("node", "strip").orderBy("key", "sid", "u"))
        ranked = drawn.withColumn("within", within).join(edges, ["node", "strip"])
        left = F.col("before") + F.col("within") <= F.col("half")
        child = 2 * F.col("node") + F.when(left, 0).otherwise(1)
        nodes = ranked.groupBy(child.alias("node"), "sid").agg(F.count(F.lit(1)).alias("quota"))
    return nodes.select("sid", (F.col("node") - mix.shards).cast("int").alias("shard"), "quota")


def drawn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          mix: Mix = Mix()) -> DataFrame:
    """(id, source, hash, size, copies, source_size, target, block, draws): draws are the shards that take the unit.

    Running sums go strip by strip: a source of any size is summed in parallel, and then once over its strips.
    """
    rows = staged(units(docs, id_col, text_col, source_col), "mix-units")
    sources = staged(targets(rows, mix), "mix-targets")
    parts = split(sources.select("sid", "quota"), mix)
    upto = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = parts.withColumn("end", F.sum("quota").over(upto)).groupBy("sid").agg(
        F.collect_list(F.struct("end", "shard")).alias("runs"))  # one entry per shard
    facts = sources.join(runs, "sid", "left").withColumnRenamed("source", "name")
    key = F.xxhash64(F.lit(mix.seed), "id", "hash")
    keyed = rows.join(facts, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("key", key)
    keyed = keyed.withColumn("strip", F.pmod("key", F.lit(mix.strips))).withColumn("words", F.col("size") * F.col("copies"))
    sums = keyed.groupBy("sid", "strip").agg(F.sum("words").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "strip", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("sid", "strip").orderBy("key", "id", "hash").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("upto", F.sum("words").over(inside)).join(offsets, ["sid", "strip"])
    middle = F.col("offset") + F.col("upto") - F.col("words") / 2
    block = F.coalesce(F.floor(middle / F.nullif(F.col("source_size"), F.lit(0)) * F.col("blocks")), F.lit(0))
    placed = placed.withColumn("block", F.least(block, F.col("blocks") - 1).cast("long"))
    draws = F.expr(
        f"transform(filter(transform(sequence(0, {mix.most - 1}), e -> e * blocks + block), d -> d < quota),"
        " d -> array_min(filter(runs, r -> r.end > d)).shard)")
    return placed.select("id", "source", "hash", "size", "copies", "source_size", "target", "block",
                         F.coalesce(draws, F.expr("cast(array() as array<int>)")).alias("draws"))


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          mix: Mix = Mix()) -> DataFrame:
    """Per row: doc_id, size, source_size, target and the words that the mix takes of it.

    The copies of one row are made a strip at a time, by as many tasks as there are strips.
    """
    rows = drawn(docs, id_col, text_col, source_col, mix).select(
        "id", "hash", "size", "source_size", "target", "copies", (F.col("size") * F.size("draws")).alias("taken"))
    last = F.floor((F.col("copies") - 1) / mix.strips)
    strips = rows.withColumn("strip", F.explode(F.sequence(F.lit(0).cast("long"), last))).repartition("id", "hash", "strip")
    upto = F.least(F.lit(mix.strips).cast("long"), F.col("copies") - F.col("strip") * mix.strips)
    each = strips.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), upto)))
    return each.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          mix: Mix = Mix()) -> DataFrame:
    """The mix itself: each row once per draw, with its shard, in a shuffled order within the shard."""
    rows = drawn(docs, id_col, text_col, source_col, mix).filter(F.size("draws") > 0)
    takes = rows.select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("hash").alias("__hash"), "size",
                        "source_size", "target", "block", F.posexplode("draws").alias("__turn", "shard"))
    base = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW])
    same = (F.col(id_col).eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
            & (F.xxhash64(text_col) == F.col("__hash")))
    joined = base.join(takes, same)
    key = F.xxhash64(F.lit(mix.seed), "shard", "__hash", "__id", "__turn")
    out = joined.withColumn("position_key", key).drop("__id", "__source", "__hash", "__turn")
    return out.repartition("shard", F.pmod("position_key", F.lit(64))).sortWithinPartitions("shard", "position_key")
