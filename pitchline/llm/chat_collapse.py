"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again as it grows. Every turn gets a rolling hash of all turns up to it; a
conversation whose whole hash is the prefix hash of a longer one is dropped by an anti-join, and of equal
conversations the one with the least id stays. The maximal conversations are rendered. DataFrame functions only.

A rolling hash is the exclusive-or of 128-bit hashes of (position, role, text), so it can be taken over slices of a
conversation and combined: no conversation, however long, is gathered in one task. Rendered text comes in parts of
``slice`` turns.

Defined results: turns are ordered by turn, role, text with nulls first, and equal turns stay repeated; null roles and
texts render as empty and differ from empty ones in the hash; rows without a conversation id are one conversation of
id null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchline.llm.common import staged

SLICE = 256


def numbered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv, cid, role, text, place (from 1) and the prefix hashes a, b of every turn.

    ``cid`` is the id as text and never null, so that the text is shuffled once, by (cid, part), for all steps.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("cid", F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")))
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / SLICE), F.lit(-(1 << 60))))
    rows = rows.withColumn("digest", F.xxhash64(F.col("role").isNull(), "role", F.col("text").isNull(), "text")).withColumn(
        "second", F.crc32(F.concat_ws("\x1f", "role", "text").cast("binary")))
    inside = Window.partitionBy("cid", "part").orderBy("turn", "role", "text")
    earlier = Window.partitionBy("cid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(frame: DataFrame, aggregates: dict) -> DataFrame:
        """Per (cid, part), the aggregates of all earlier parts; one row a part, so the window is short."""
        sums = frame.groupBy("cid", "part").agg(*[how(of).alias(name) for name, (how, of) in aggregates.items()])
        over = {"count": F.sum, "bit_xor": F.bit_xor}
        return sums.select("cid", "part", *[F.coalesce(over[how.__name__](name).over(earlier), F.lit(0)).alias(name)
                                            for name, (how, _) in aggregates.items()])

    placed = rows.withColumn("at", F.row_number().over(inside)).join(carried(rows, {"start": (F.count, F.lit(1))}), ["cid", "part"])
    placed = placed.withColumn("place", F.col("start") + F.col("at"))
    placed = placed.withColumn("ha", F.xxhash64(F.lit(1), "place", "digest", "second")).withColumn(
        "hb", F.xxhash64(F.lit(2), "second", "digest", "place"))
    before = carried(placed, {"xa": (F.bit_xor, "ha"), "xb": (F.bit_xor, "hb")})
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rolled = placed.withColumn("ra", F.bit_xor("ha").over(upto)).withColumn("rb", F.bit_xor("hb").over(upto)).join(before, ["cid", "part"])
    return rolled.select("conv", "cid", "role", "text", "place", F.col("ra").bitwiseXOR(F.col("xa")).alias("a"),
                         F.col("rb").bitwiseXOR(F.col("xb")).alias("b"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """(cid, turns) of conversations that are no prefix of a longer one; the least id of equal ones (null is least)."""
    lengths = prefixes.groupBy("cid").agg(F.max("place").alias("turns"))
    known = prefixes.join(lengths, "cid")
    ends = known.filter("place = turns")
    alone = ends.groupBy("turns", "a", "b").agg(F.min(F.struct(F.col("conv").isNotNull(), "conv", "cid")).alias("least"))
    alone = alone.select(F.col("least.cid").alias("cid"), "turns", "a", "b")
    inner = known.filter("place < turns").select(F.col("place").alias("turns"), "a", "b").distinct()  # a shared opening counts once
    return alone.join(inner, ["turns", "a", "b"], "left_anti").select("cid", "turns")


def rendered(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", start: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, n_turns, part and the rendered text of every maximal conversation."""
    rows = staged(numbered(turns, conv_col, turn_col, role_col, text_col), "chat-turns")
    kept = maximal(rows.select("conv", "cid", "place", "a", "b"))
    turn = F.concat(F.lit(start), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{end}\n"))
    said = rows.join(kept, "cid").select(
        "conv", "cid", "turns", F.floor((F.col("place") - 1) / SLICE).cast("int").alias("part"), F.struct("place", turn.alias("said")).alias("s"))
    parts = said.groupBy("cid", "conv", "turns", "part").agg(F.array_sort(F.collect_list("s")).alias("all"))  # SLICE turns at most
    return parts.select(F.col("conv").alias("conv_id"), F.col("turns").alias("n_turns"), "part",
                        F.concat_ws("", F.col("all.said")).alias("text"))
