"""Quality rules with n-gram perplexity.

A modified Kneser-Ney model over the bytes of all documents gives every text a log-perplexity, per word and per letter
byte (A-Z, a-z and the bytes of other scripts). The second is judged: marks, digits and blanks cost bytes but count for
nothing, so tables and symbols cannot pass for easy prose. Each language has a lower and an upper limit, set apart from
each other from its own lower and upper tail; a text beyond one is rejected, as is one that fails the plain rules.
Limits come from different texts, so copies, however many, move none. Defined results: a null or empty text has no words
and fails the rules; a text of any length is judged whole; a null language is a language of its own; an empty table
gives an empty result; repeated rows are judged alike, each on its own row; a column of the input that has the name of a
result, or ``__text_key``, is replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pitchline.llm import kneser_ney as kn
from pitchline.llm.byte_grams import Chunks, Values, count_grams, padded, with_values
from pitchline.llm.common import mix, row_sums, staged, utf8

SYMBOLS = b"[#*$%&|<>]"
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[list(SYMBOLS[1:-1])] = True
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SPAN = 8


@dataclass(frozen=True)
class Rules:
    order: int = 5
    min_words: int = 20
    max_repeat_pct: int = 30
    lower: float = 15.0  # the lower limit, in distances of the first quartile from the median
    upper: float = 8.0  # the upper limit, in distances of the third quartile from the median
    least_spread: float = 0.01  # such a distance counts as this much at least
    bins: int = 10000  # log-perplexity is binned to 1/bins when quartiles are taken


COUNTS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
SCORES = [T.StructField("log_ppl", T.DoubleType()), T.StructField("letter_ppl", T.DoubleType())]
TEXT_KEY = "__text_key"


def repeat_words(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window of eight words found twice or more in it (64-bit fingerprints)."""
    n = len(ids)
    if n < SPAN:
        return np.zeros(len(lengths), np.int64)
    doc = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    key = mix(doc[:n - SPAN + 1])
    for j in range(SPAN):
        key = mix(key + ids[j:n - SPAN + 1 + j] + np.uint64(1))
    inside = doc[:n - SPAN + 1] == doc[SPAN - 1:]
    key, at = key[inside], np.flatnonzero(inside)
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return np.zeros(len(lengths), np.int64)
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    start = at[twice[place] == key]
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, start, 1)
    np.add.at(change, start + SPAN, -1)
    return row_sums(np.cumsum(change[:n]) > 0, lengths).astype(np.int64)


def rule_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    lengths = np.diff(offsets)
    solid = ~BLANK[data]
    chars = row_sums(solid & ((data & 0xC0) != 0x80), lengths)
    symbols = row_sums(SYMBOL[data], lengths)
    n_words, dup, ids = [], [], []
    body = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        text = body[a:b]
        known: dict[bytes, int] = {}
        number = [known.setdefault(w, len(known)) for w in text.split()]
        ids.append(np.array(number, np.uint64))
        n_words.append(len(number))
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dup.append(len(lines) - len(set(lines)))
    n = np.array(n_words, np.int64)
    repeats = repeat_words(np.concatenate(ids) if ids else np.zeros(0, np.uint64), n)
    return [n, chars.astype(np.int64), symbols.astype(np.int64), np.array(dup, np.int64), repeats]


@dataclass(frozen=True)
class Model:
    """Adjusted counts of all grams by order, the longest first, and their discounts. No gram is too rare."""

    tables: list[DataFrame]
    found: dict


def trained(grams: DataFrame, rules: Rules = Rules()) -> Model:
    """Every order is stored once and counted from the stored order above it."""
    tables = [staged(grams, "perplexity-level")]
    for size in range(rules.order, 1, -1):
        tables.append(staged(kn.levels(tables[-1], 2, ["n"], size=size)[1], "perplexity-level"))
    return Model(tables, kn.discounts(tables, ["n"]))


def train(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> Model:
    """The model of all texts: one pass over them, then aggregations over distinct grams."""
    return trained(count_grams(docs, text_col, rules.order), rules)


def chunks(docs: DataFrame, text_col: str, rules: Rules) -> Chunks:
    return Chunks(docs, text_col, rules.order, "perplexity-chunks")


def scored(docs: DataFrame, model: Model, text_col: str = "text", rules: Rules = Rules(),
           drop: tuple[str, ...] = (), chunked: Chunks | None = None) -> DataFrame:
    """``docs`` with the rule counts and the log-perplexity per word and per letter byte (end mark included).

    ``chunked`` holds the docs where the model was made of its very grams.
    """
    own = chunked is not None
    chunked = chunked or chunks(docs, text_col, rules)
    values = kn.probabilities(model.tables, "n", model.found, None if own else chunked.grams())
    order = rules.order

    def make():
        def step(texts: pa.Array, lm: Values) -> list:
            data, offsets = utf8(texts)
            stream, lengths = padded(data, offsets, order - 1)
            total = row_sums(lm.along(stream, order), lengths)
            counts = rule_counts(data, offsets)
            letters = row_sums(LETTER[data], np.diff(offsets))
            body = data.tobytes()
            keys = [int.from_bytes(blake2b(body[a:b], digest_size=8).digest(), "little", signed=True)
                    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return [pa.array(x) for x in counts] + [
                pa.array(-total / np.maximum(counts[0], 1)), pa.array(-total / np.maximum(letters, 1)), pa.array(keys, pa.int64())]

        return step

    return with_values(chunked, values, make, [*COUNTS, *SCORES, T.StructField(TEXT_KEY, T.LongType())], drop)


def failed(rules: Rules = Rules()):
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))


def bands(rows: DataFrame, lang_col: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """(__lang, __null, __low, __high) per language from the different texts that pass the plain rules.

    Quartiles come from a histogram per language, so a language of any size is one small group of bins.
    """
    language = [F.coalesce(F.col(lang_col), F.lit("")).alias("__lang"), F.col(lang_col).isNull().alias("__null")]
    texts = rows.filter(~failed(rules)).groupBy(*language, TEXT_KEY).agg(F.min("letter_ppl").alias("score"))
    binned = texts.groupBy("__lang", "__null", F.floor(F.col("score") * rules.bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("__lang", "__null")
    upto = F.sum("n").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    cum = binned.select("*", upto.alias("upto"), F.sum("n").over(by).alias("all"))

    def quartile(q: float):
        return F.min(F.when(F.col("upto") >= q * F.col("all"), (F.col("bin") + 0.5) / rules.bins))

    q = cum.groupBy("__lang", "__null").agg(
        quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"))
    below, above = (F.greatest(d, F.lit(rules.least_spread)) for d in (F.col("q2") - F.col("q1"), F.col("q3") - F.col("q2")))
    return q.select("__lang", "__null", (F.col("q2") - rules.lower * below).alias("__low"), (F.col("q2") + rules.upper * above).alias("__high"))


def judged(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", rules: Rules = Rules(),
           drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with counts, log_ppl, letter_ppl, base_failed and kept. A language without limits keeps what passes the rules."""
    chunked = chunks(docs, text_col, rules)
    model = trained(chunked.grams(), rules)
    rows = staged(scored(docs, model, text_col, rules, drop, chunked), "perplexity-scores")
    limits = bands(rows, lang_col, rules)
    base = [F.col(f"`{c}`") for c in rows.columns if c.lower() not in ("base_failed", "kept", TEXT_KEY)]
    own = "__limits"
    while own in rows.columns:
        own += "_"
    on = (F.coalesce(F.col(lang_col), F.lit("")) == F.col(f"{own}.__lang")) & (F.col(lang_col).isNull() == F.col(f"{own}.__null"))
    within = F.coalesce(F.col("letter_ppl").between(F.col(f"{own}.__low"), F.col(f"{own}.__high")), F.lit(True))
    return rows.join(limits.select(F.struct("*").alias(own)), on, "left").select(*base, failed(rules).alias("base_failed"), (~failed(rules) & within).alias("kept"))
