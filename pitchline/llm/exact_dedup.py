"""Exact duplicates by two-pass Bloom filtering. DataFrame functions only.

The first pass sets, for the hash of every text, three bits of one 64-bit word of a Bloom filter with one word a row,
and keeps the bits that two or more rows have set. The second pass looks every row up: a row that misses one of its
bits is the only one with its text and passes straight through, wherever it lies; rows whose bits are all kept possibly
repeat, and only those are shuffled, grouped by SHA-256 and decided exactly.

Only words with kept bits are stored, so the filter grows with the repeated texts. It is broadcast up to a bound on its
counted rows (``Plan.broadcast_words``); beyond it the same lookup is an ordinary join. Texts never travel unless the
caller keeps them among the columns. A hot text is counted before the shuffle, and its rows meet its count by a
broadcast of the few hot groups (``joined_totals``).

Defined results: a null text counts as empty, and both are equal; of equal texts the row with the largest id stays, a
null id being the least; of rows equal in id and text one stays; every input row gives one row, an empty table none;
other columns travel along (those in ``drop`` do not), and input columns named like a new one are replaced. Texts of
any length are hashed whole, by ``normal`` of the text where it is given.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchline.llm.common import joined_totals, staged

NEW = ("keep_id", "group_size", "kept", "text_sha256")


@dataclass(frozen=True)
class Plan:
    seed: int = 11
    broadcast_words: int = 2 << 20  # 16 bytes each: 32 MB


def _bits() -> list[Column]:
    """Three places of a word, from a second hash."""
    return [F.shiftright("second", 6 * k).bitwiseAND(F.lit(63)).cast("int") for k in range(3)]


def repeated_bits(hashes: DataFrame) -> DataFrame:
    """First pass over (word, second): word and the bits that two rows or more have set."""
    places = hashes.select("word", F.explode(F.array_distinct(F.array(*_bits()))).alias("bit"))
    twice = places.groupBy("word", "bit").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: tuple[str, ...] = (),
           normal: Callable[[Column], Column] = lambda text: text, plan: Plan = Plan()) -> DataFrame:
    """Every row with keep_id, group_size, kept and text_sha256."""
    carried = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in NEW and c not in drop]
    text = normal(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    # The input columns stay in a struct of their own, where no name can clash; one scan of the texts.
    rows = staged(docs.select(F.struct(F.lit(0).alias("_"), *carried).alias("given"), F.col(f"`{id_col}`").alias("id"),
                              F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha"),
                              F.monotonically_increasing_id().alias("row")), "dedup-keys")
    total = rows.count()
    placed = rows.withColumn("word", F.pmod(F.xxhash64(F.lit(plan.seed), "sha"), F.lit(max(1, total)))).withColumn(
        "second", F.xxhash64("sha", F.lit(plan.seed)))
    bits = staged(repeated_bits(placed.select("word", "second")), "dedup-bloom")
    if bits.count() <= plan.broadcast_words:
        bits = F.broadcast(bits)
    mask = F.lit(0).cast("long")
    for place in ("b0", "b1", "b2"):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, {place})"))
    looked = placed.withColumns({f"b{k}": b for k, b in enumerate(_bits())}).withColumn("mask", mask).join(bits, "word", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False))
    once = looked.filter(~maybe).select("given", "sha", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                        F.lit(True).alias("kept"))
    again = staged(looked.filter(maybe).select("given", "id", "sha", "row"), "dedup-possible")
    groups = again.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("id", "row")).alias("last"))
    decided = joined_totals(again, staged(groups, "dedup-groups"), "sha", "group_size", total).select(
        "given", "sha", F.col("last.id").alias("keep_id"), "group_size", (F.col("row") == F.col("last.row")).alias("kept"))
    return once.unionByName(decided).select("given.*", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")).drop("_")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that stay, with the columns of the input."""
    given = [c for c in docs.columns if c.lower() in NEW]
    safe = docs.withColumnsRenamed({c: f"given {c}" for c in given})
    rows = marked(safe, id_col, text_col, **options).filter("kept").drop(*NEW)
    return rows.withColumnsRenamed({f"given {c}": c for c in given})
