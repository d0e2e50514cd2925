"""Modified Kneser-Ney models over byte n-grams: counted by Spark, looked up in sorted hash arrays.

Counts, continuation counts and discounts come from every gram. ``probabilities`` works in tables of any size and is
what the perplexity uses. ``stored`` collects the grams that its caller keeps and ``Backoff`` is broadcast, so callers
bound them. The probability of a gram that is not stored goes back to its context's backoff weight, so that each context
still adds up to one.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pitchline.llm.byte_grams import context, stretches, suffix
from pitchline.llm.common import HashArray

CHUNK = 1 << 18


def levels(grams: DataFrame, order: int, columns: list[str], types: str | None = None, size: int | None = None) -> list[DataFrame]:
    """Adjusted counts for ``order`` orders from ``size`` bytes (``order`` if not given) down: at the top as they are,
    below it the number of distinct left extensions.

    ``columns`` are counted per class; ``types`` names a column that counts extensions in any class.
    """
    out = [grams]
    for size in range((size or order) - 1, (size or order) - order, -1):
        sums = [F.sum((F.col(c) > 0).cast("long")).alias(c) for c in columns]
        if types:
            sums.append(F.count(F.lit(1)).alias(types))
        out.append(out[-1].groupBy(suffix(F.col("gram"), size).alias("gram")).agg(*sums))
    return out


def discounts(tables: list[DataFrame], columns: list[str]) -> dict[tuple[int, str], tuple[float, list[float]]]:
    """Total and the three discounts by (order, column), from the counts of counts; one job for all orders."""
    order = len(tables)
    parts = [
        t.agg(*[F.sum(c).alias(f"{c}_all") for c in columns],
              *[F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in columns for k in (1, 2, 3, 4)])
        .withColumn("size", F.lit(order - i))
        for i, t in enumerate(tables)
    ]
    out = {}
    for row in reduce(DataFrame.unionByName, parts).collect():  # one row per order
        for c in columns:
            n = [row[f"{c}_{k}"] for k in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
            d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k * 0.5 for k in (1, 2, 3)]
            # Kept inside (0, k): tiny tables can give values outside.
            out[row["size"], c] = (float(row[f"{c}_all"] or 0), [min(max(x, 0.05 * k), 0.95 * k) for k, x in zip((1, 2, 3), d)])
    return out


def stored(tables: list[DataFrame], columns: list[str], found: dict, keep) -> dict[int, dict[str, np.ndarray]]:
    """Discounted weights of the grams to store, by order: {"gram": ..., column: ...}.

    ``keep(size)`` is the condition on a gram. The window spans one context, which has at most 256 next bytes.
    """
    order, parts = len(tables), []
    for i, t in enumerate(tables):
        size = order - i
        per_context = Window.partitionBy(context(F.col("gram")))
        weights = []
        for c in columns:
            d = found[size, c][1]
            taken = F.when(F.col(c) >= 3, d[2]).when(F.col(c) == 2, d[1]).when(F.col(c) == 1, d[0]).otherwise(0.0)
            weights.append(F.coalesce((F.col(c) - taken) / F.nullif(F.col(f"{c}_context"), F.lit(0)), F.lit(0.0)).alias(c))
        sums = t.select("gram", *columns, *[F.sum(c).over(per_context).alias(f"{c}_context") for c in columns])
        parts.append(sums.filter(keep(size)).select(F.lit(size).alias("size"), "gram", *weights))
    rows = reduce(DataFrame.unionByName, parts).toPandas()
    out = {}
    for size in range(1, order + 1):
        part = rows[rows["size"] == size].sort_values("gram")
        out[size] = {"gram": part["gram"].to_numpy().astype(np.uint64)} | {c: part[c].to_numpy(np.float64) for c in columns}
    return out


def probabilities(tables: list[DataFrame], column: str, found: dict, asked: DataFrame | None = None) -> DataFrame:
    """(gram, value): natural log of the interpolated probability of every asked gram, worked out in tables.

    Each order is joined with the one below it by suffix, of which a gram has at most 256 longer ones. A gram that was
    not counted takes its context's backoff. Without ``asked``, the model's own grams are; then the suffixes of all of
    them stand in the tables already, and nothing is added or grouped again.
    """
    order, lower = len(tables), None
    for size in range(1, order + 1):
        d = found[size, column][1]
        rows = tables[order - size].select("gram", F.col(column).alias("n"), F.lit(1 if asked is None else 0).alias("asked"))
        if asked is not None:
            wanted = asked.select(suffix(F.col("gram"), size).alias("gram"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked"))
            rows = rows.unionByName(wanted).groupBy("gram").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
        per_context = Window.partitionBy(context(F.col("gram")))
        taken = F.when(F.col("n") >= 3, d[2]).when(F.col("n") == 2, d[1]).when(F.col("n") == 1, d[0]).otherwise(0.0)
        visits = F.nullif(F.sum("n").over(per_context), F.lit(0))
        own = F.coalesce((F.col("n") - taken) / visits, F.lit(0.0))
        rows = rows.withColumn("own", own).withColumn("mass", F.greatest(1 - F.sum("own").over(per_context), F.lit(1e-9))).filter("asked = 1")
        if lower is None:
            out = rows.select("gram", (F.col("own") + F.col("mass") / 256).alias("p"))
        else:
            out = rows.withColumn("suffix", suffix(F.col("gram"), size - 1)).join(lower, "suffix").select(
                "gram", (F.col("own") + F.col("mass") * F.col("p_lower")).alias("p"))
        lower = out.select(F.col("gram").alias("suffix"), F.col("p").alias("p_lower"))
    return out.select("gram", F.log("p").alias("value"))


class Backoff:
    """Values of grams with backoff: a stored gram's value, else its context's weight plus the shorter gram's value."""

    def __init__(self, base: float):
        self.base = base
        self.rows: list[tuple] = []  # longest first: size, grams, values, contexts, weights

    def add(self, size: int, grams: np.ndarray, values: np.ndarray, contexts: np.ndarray, weights: np.ndarray) -> None:
        g, c = HashArray(grams), HashArray(contexts)
        self.rows.insert(0, (size, g, values[g.order].astype(np.float32), c, weights[c.order].astype(np.float32)))

    def state(self) -> tuple:
        """Plain arrays for a broadcast."""
        return self.base, [(size, g.state(), v, c.state(), w) for size, g, v, c, w in self.rows]

    @classmethod
    def restore(cls, state: tuple) -> Backoff:
        out = cls(state[0])
        out.rows = [(size, HashArray.restore(g), v, HashArray.restore(c), w) for size, g, v, c, w in state[1]]
        return out

    def values(self, grams: np.ndarray) -> np.ndarray:
        out = np.empty(len(grams), np.float32)
        for a in range(0, len(grams), CHUNK):
            self._values(grams[a:a + CHUNK], out[a:a + CHUNK])
        return out

    def along(self, stream: np.ndarray, order: int) -> np.ndarray:
        """Values of the grams that end at each non-start byte of a padded stream."""
        return np.concatenate([self.values(part) for part in stretches(stream, order)])

    def _values(self, grams: np.ndarray, out: np.ndarray) -> None:
        out[:] = 0
        left = np.arange(len(grams))
        for size, g, values, c, weights in self.rows:
            part = grams[left] & np.uint64((1 << 8 * size) - 1)
            at = g.find(part)
            hit = at >= 0
            out[left[hit]] += values[at[hit]]
            left, part = left[~hit], part[~hit] >> np.uint64(8)
            if not len(left):
                return
            at = c.find(part)
            hit = at >= 0
            out[left[hit]] += weights[at[hit]]
        out[left] += self.base


def remaining(grams: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of the stored grams, the mass each leaves to shorter contexts, and each gram's context number."""
    contexts, number = np.unique(grams >> np.uint64(8), return_inverse=True)
    taken = np.bincount(number, weights=weights, minlength=len(contexts)) if len(grams) else np.zeros(0)
    return contexts, np.maximum(1.0 - taken, 1e-9), number


def interpolated(kept: dict[int, dict[str, np.ndarray]], column_of) -> Backoff:
    """Natural-log probabilities of all stored grams, shortest first; ``column_of(size)`` picks the class to use."""
    model = Backoff(float(np.log(1 / 256)))
    for size in sorted(kept):
        grams, weights = kept[size]["gram"], kept[size][column_of(size)]
        contexts, mass, number = remaining(grams, weights)
        lower = model.values(grams & np.uint64((1 << 8 * (size - 1)) - 1)).astype(np.float64)
        value = np.log(weights + mass[number] * np.exp(lower))
        model.add(size, grams, value, contexts, np.log(mass))
    return model
