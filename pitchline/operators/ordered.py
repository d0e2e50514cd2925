"""Ordered history per key that stays parallel when one key owns most rows.

A plain ``Window.partitionBy(key)`` puts a whole key into one task.  Here the
rows are cut into *slices* of about equal row counts along the order columns.
The cuts come from a sketch of the order values: one pass that keeps, in every
cell of a hash of the values, the one with the least hash, which is an even
sample whatever the values' spread, type or common beginnings.  The slice
number is a plain expression of the order columns and the cuts, so it is the
same wherever it is computed, and how many slices there are is set by the
cluster.  No window ever spans more than one (key, slice); what a slice needs
from earlier ones arrives as a few extra rows:

* totals of all earlier slices (pre-aggregated, one row per key and slice);
* the last ``n`` rows before the slice, for frames over the previous n rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql import types as T

from pitchline.session import durable

SLICES_CONF = "spark.pitchline.slices"
SLICE, _CUTS = "_slice", "_cuts"


@dataclass(frozen=True)
class Total:
    """``how`` (sum, count, max, min) over all earlier rows of the key."""

    name: str
    value: Column
    how: str = "sum"
    inclusive: bool = False


@dataclass(frozen=True)
class Recent:
    """``how`` (avg, sum, count, max, min, list, last) over the previous ``n`` rows.

    With ``where``, over the previous n rows for which it holds; rows for which
    it does not hold see the same as the next one for which it does.
    """

    name: str
    value: Column
    n: int
    how: str = "avg"
    inclusive: bool = False
    where: Column | None = None

    @property
    def reach(self) -> int:
        return self.n - 1 if self.inclusive else self.n


@dataclass(frozen=True)
class Latest:
    """Last non-null earlier value of the key."""

    name: str
    value: Column
    inclusive: bool = False


Spec = Total | Recent | Latest

_AGG = {
    "avg": F.avg, "sum": F.sum, "count": F.count, "max": F.max, "min": F.min,
    "list": F.collect_list, "last": F.last,
}


# A key with no more rows than this is one slice where its number of rows is known.
LONG_ROWS = 100_000

# Sampled order values per slice: a slice's share then strays by less than a fifth, as standard deviation.
SAMPLES = 32


@dataclass(frozen=True)
class Span:
    """Cuts between slices, ascending: an array of structs of the first order columns."""

    columns: tuple[str, ...]
    cuts: Column


def slices_of(df: DataFrame) -> int:
    """As many slices as the session has shuffle partitions, unless set."""
    conf = df.sparkSession.conf
    return int(conf.get(SLICES_CONF, None) or conf.get("spark.sql.shuffle.partitions"))


def span_of(df: DataFrame, columns: Sequence[str]) -> Span:
    """The cuts as one subquery over ``df``: nothing runs before the query that uses them."""
    n = slices_of(df)
    at = F.xxhash64(*columns)
    sample = df.groupBy(F.pmod(at, F.lit(SAMPLES * n)).alias("_cell")).agg(*[F.min_by(c, at).alias(c) for c in columns])
    values = sample.agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_all"))
    places = F.sequence(F.lit(1), F.lit(max(1, n - 1)))
    cuts = F.transform(places, lambda i: F.get("_all", (i * F.size("_all") / n).cast("int")))
    return Span(tuple(columns), values.select(F.filter(cuts, lambda c: c.isNotNull())).scalar())


def sliced_by(df: DataFrame, order: Sequence[str], span: Span | None = None) -> DataFrame:
    """Tag rows with their slice, the number of cuts not above them, by a binary search of one column a step."""
    n = slices_of(df)
    out = df.withColumn(SLICE, F.lit(0))
    if n == 1:
        return out
    if span is None or tuple(order[:len(span.columns)]) != span.columns:
        span = span_of(df, order)

    def reached(cut: Column) -> Column:
        """Whether the row is at the cut or after it, by one order column after the other."""
        *first, last = span.columns
        yes = cut[last] <= F.col(last)
        for c in reversed(first):
            yes = (cut[c] < F.col(c)) | ((cut[c] == F.col(c)) & yes)
        return F.coalesce(yes, F.lit(False))

    # The subquery stands in the plan once; each step reads a column.
    out = out.withColumn(_CUTS, span.cuts)
    step = 1 << (n - 1).bit_length() - 1
    while step:
        out = out.withColumn(SLICE, F.col(SLICE) + F.when(reached(F.get(_CUTS, F.col(SLICE) + (step - 1))), step).otherwise(0))
        step >>= 1
    return out.drop(_CUTS)


def long_keys(df: DataFrame, keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """The keys with many rows, at most one for so many rows of the table, and into how many slices each is cut."""
    rows = rows or LONG_ROWS
    counts = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > rows)
    return durable(counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.ceil(F.col("_n") / rows).cast("int").alias("_parts")))


def _slices_joined(sliced: DataFrame, keys: Sequence[str], long: DataFrame) -> DataFrame:
    """Neighbouring slices of a key become one, until it has as many as its rows need: one, if it is not long."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    n = slices_of(sliced)
    parts = F.least(F.coalesce("_parts", F.lit(1)), F.lit(n))
    joined = sliced.join(F.broadcast(long), same, "left")
    return joined.withColumn(SLICE, (F.col(SLICE) * parts / n).cast("int")).select(*sliced.columns)


def _input(spec: Spec) -> Column:
    if isinstance(spec, Total) and spec.how == "count":
        return F.when(spec.value.isNotNull(), F.lit(1).cast("bigint"))
    return spec.value


def _result(spec: Spec, col: str, w) -> Column:
    if isinstance(spec, Recent):
        frame = w.rowsBetween(-(spec.n - 1), 0) if spec.inclusive else w.rowsBetween(-spec.n, -1)
        return _AGG[spec.how](col).over(frame)
    frame = w.rowsBetween(W.unboundedPreceding, 0 if spec.inclusive else -1)
    if isinstance(spec, Latest):
        return F.last(col, ignorenulls=True).over(frame)
    if spec.how == "count":
        return F.coalesce(F.sum(col).over(frame), F.lit(0).cast("bigint"))
    return _AGG[spec.how](col).over(frame)


def _slice_total(spec: Spec, col: str, order: Sequence[str]) -> Column:
    if isinstance(spec, Latest):
        known = F.col(col).isNotNull()
        return F.max_by(F.when(known, F.col(col)), F.when(known, F.struct(*order)))
    return F.sum(col) if spec.how == "count" else _AGG[spec.how](col)


def _before_slice(spec: Spec, col: str, w) -> Column:
    frame = w.rowsBetween(W.unboundedPreceding, -1)
    if isinstance(spec, Latest):
        return F.last(col, ignorenulls=True).over(frame)
    return (F.sum(col) if spec.how == "count" else _AGG[spec.how](col)).over(frame)


def with_history(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: Sequence[Spec],
    *,
    span: Span | None = None,
    context: DataFrame | None = None,
    long: DataFrame | None = None,
) -> DataFrame:
    """Add one column per spec, computed over the earlier rows of the same key.

    ``order`` must be unique per key and free of nulls.  ``span`` holds cuts of
    its first columns where they are known more cheaply than from ``df``.
    ``context`` (see ``history_context``) stands for rows seen before ``df``.
    ``long`` (see ``long_keys``) names the keys that are cut into slices, where
    most keys have so few rows that what slices carry would outgrow them.
    """
    keys, order, specs = list(keys), list(order), list(specs)
    cols, where = _input_names(specs), _where(specs)
    staged = df.withColumns({c: _input(s) for c, s in zip(cols, specs)}).withColumn(_EXTRA, F.lit(False))
    if where is not None:
        staged = staged.withColumn(_COUNTS, F.coalesce(where, F.lit(False)))
    sliced = sliced_by(staged, order, span)
    if long is not None:
        sliced = _slices_joined(sliced, keys, long)
    if context is not None:
        before = context.withColumn(_EXTRA, F.lit(True)).withColumn(SLICE, F.lit(-1))
        sliced = sliced.unionByName(before, allowMissingColumns=True)
    w_slices = W.partitionBy(*keys).orderBy(SLICE)
    merged = sliced

    totals = [(c, s) for c, s in zip(cols, specs) if not isinstance(s, Recent)]
    if totals:
        per = sliced.groupBy(*keys, SLICE).agg(
            *[_slice_total(s, c, order).alias(c) for c, s in totals]
        )
        carried = per.select(*keys, SLICE, F.lit(True).alias(_EXTRA),
                             *[_before_slice(s, c, w_slices).alias(c) for c, s in totals])
        merged = merged.unionByName(carried, allowMissingColumns=True)

    recents = [c for c, s in zip(cols, specs) if isinstance(s, Recent)]
    reach = _reach(specs)
    if reach:
        counted = F.lit(True)
        if where is not None:
            recents, counted = [*recents, _COUNTS], F.col(_COUNTS)
        last = top_n(sliced.select(*keys, SLICE, *order, counted.alias("_on"), F.struct(*order, *recents).alias("_row")), [*keys, SLICE],
                     [F.col("_on").desc(), *[F.col(c).desc() for c in order]], reach)
        # Before the first row that a slice keeps, the number of counted rows finds the last ones of earlier slices.
        along = W.partitionBy(*keys).orderBy(SLICE, *order)
        place = F.coalesce(F.sum(F.col("_on").cast("long")).over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
        opens = F.coalesce(F.lag(SLICE).over(along) != F.col(SLICE), F.lit(True))
        earlier = F.collect_list(F.when(F.col("_on"), F.col("_row"))).over(W.partitionBy(*keys).orderBy(_PLACE).rangeBetween(-reach, -1))
        carried = (
            last.withColumns({_PLACE: place, "_opens": opens}).withColumn("_rows", earlier).filter("_opens")
            .select(*keys, SLICE, F.lit(True).alias(_EXTRA), F.explode("_rows").alias("_row"))
            .select(*keys, SLICE, _EXTRA, "_row.*")
        )
        merged = merged.unionByName(carried, allowMissingColumns=True)
    return _windowed(merged, [*keys, SLICE], order, specs).drop(SLICE)


_EXTRA, _COUNTS, _PLACE = "_extra", "_counts", "_place"


def _where(specs: Sequence[Spec]) -> Column | None:
    """The condition of the Recent specs of one pass, which must share it."""
    found = [s.where for s in specs if isinstance(s, Recent)]
    if any((w is None) != (found[0] is None) or w is not found[0] for w in found):
        raise ValueError("Recent specs of one history share one condition")
    if found and found[0] is not None and any(s.inclusive for s in specs if isinstance(s, Recent)):
        raise ValueError("a conditional Recent spec looks at earlier rows only")
    return found[0] if found else None


def _input_names(specs: Sequence[Spec]) -> list[str]:
    return [f"_in{i}" for i in range(len(specs))]


def _reach(specs: Sequence[Spec]) -> int:
    return max((s.reach for s in specs if isinstance(s, Recent)), default=0)


def _windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Sequence[Spec]) -> DataFrame:
    """Extra rows sort first: totals carry no order value, carried rows an earlier one."""
    cols, where = _input_names(specs), _where(specs)
    w = W.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    plain = {s.name: _result(s, c, w) for c, s in zip(cols, specs) if where is None or not isinstance(s, Recent)}
    if where is not None:  # the number of counted rows before a row orders the frame over the last n of them
        before = F.sum(F.col(_COUNTS).cast("long")).over(w.rowsBetween(W.unboundedPreceding, -1))
        plain[_PLACE] = F.coalesce(before, F.lit(0).cast("long"))
    out = df.withColumns(plain)
    if where is not None:
        by_place = W.partitionBy(*keys).orderBy(_PLACE)
        out = out.withColumns({
            s.name: _AGG[s.how](F.when(F.col(_COUNTS), F.col(c))).over(by_place.rangeBetween(-s.n, -1))
            for c, s in zip(cols, specs) if isinstance(s, Recent)}).drop(_PLACE, _COUNTS)
    return out.filter(~F.col(_EXTRA)).drop(_EXTRA, *cols)


def history_context(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Sequence[Spec], context: DataFrame | None = None
) -> DataFrame:
    """What later rows need to know about ``df`` (and ``context`` before it).

    Per key: one row of totals (null order) and the last few rows.  Its size
    depends on the number of keys, not on the length of their history.
    """
    keys, order, specs = list(keys), list(order), list(specs)
    cols = _input_names(specs)
    where = _where(specs)
    counts = [] if where is None else [F.coalesce(where, F.lit(False)).alias(_COUNTS)]
    seen = df.select(*keys, *order, *[_input(s).alias(c) for c, s in zip(cols, specs)], *counts)
    if context is not None:
        seen = seen.unionByName(context, allowMissingColumns=True)
    recents = [c for c, s in zip(cols, specs) if isinstance(s, Recent)]
    totals = [(c, s) for c, s in zip(cols, specs) if not isinstance(s, Recent)]
    parts = []
    if totals:
        parts.append(seen.groupBy(*keys).agg(*[_slice_total(s, c, order).alias(c) for c, s in totals]))
    if _reach(specs):
        real = seen.filter(F.col(order[0]).isNotNull() if where is None else F.col(_COUNTS))
        real = real.select(*keys, *order, *recents, *([] if where is None else [_COUNTS]))
        parts.append(top_n(real, keys, [F.col(c).desc() for c in order], _reach(specs)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    missing = [c for c in order if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in missing}) if missing else out


def history_now(context: DataFrame, keys: Sequence[str], order: Sequence[str], specs: Sequence[Spec]) -> DataFrame:
    """One row per key with the specs as a row after everything in the context would see them."""
    real = F.col(order[0]).isNotNull()

    def value(s: Spec, c: str) -> Column:
        only = F.when(~real, F.col(c))  # totals carry no order value
        if not isinstance(s, Recent):
            return F.coalesce(F.sum(only), F.lit(0).cast("bigint")) if isinstance(s, Total) and s.how == "count" else F.first(only, True)
        last = F.sort_array(F.collect_list(F.when(real, F.struct(*order, F.col(c).alias("_v")))), asc=False)
        values = F.transform(F.slice(last, 1, s.n), lambda x: x["_v"])
        known = F.filter(values, lambda v: v.isNotNull())
        total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v.cast("double"))
        return {"avg": total / F.nullif(F.size(known), F.lit(0)), "sum": F.when(F.size(known) > 0, total), "count": F.size(known),
                "max": F.array_max(values), "min": F.array_min(values), "list": F.reverse(known), "last": F.get(values, F.lit(0))}[s.how]

    return context.groupBy(*keys).agg(*[value(s, c).alias(s.name) for s, c in zip(specs, _input_names(specs))])


def positions(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), name: str = "pos", **bounds
) -> DataFrame:
    """1-based position in the order, over the whole table or per key."""
    return with_history(df, keys, order, [Total(name, F.lit(1), "count", inclusive=True)], **bounds)


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; map tasks keep at most n rows per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), **bounds
) -> DataFrame:
    """Linearly interpolated quantiles per key, one column per name in ``probs``.

    Built on the histogram of distinct values and its running count, so no
    task ever holds all values of a key.
    """
    keys = list(keys)
    # Read three times below (row count, running count, size), computed once.
    hist = durable(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n")))
    cum = with_history(hist, keys, [value], [Total("_hi", F.col("_n"), "sum", inclusive=True)], **bounds)
    if keys:
        cum = cum.join(hist.groupBy(*keys).agg(F.sum("_n").alias("_size")), keys)
    else:
        cum = cum.withColumn("_size", hist.agg(F.sum("_n")).scalar())

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_hi") - F.col("_n") < rank) & (rank <= F.col("_hi")), F.col(value)))

    aggs = [F.max("_size").alias("_size")]
    for i, p in enumerate(probs.values()):
        spot = (F.col("_size") - 1) * F.lit(float(p))
        aggs += [at(F.floor(spot) + 1).alias(f"_lo{i}"), at(F.ceil(spot) + 1).alias(f"_hi{i}")]
    ends = cum.groupBy(*keys).agg(*aggs)

    def between(i: int, p: float) -> Column:
        spot = (F.col("_size") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo{i}").cast("double"), F.col(f"_hi{i}").cast("double")
        return lo + (spot - F.floor(spot)) * (hi - lo)

    return ends.select(*keys, *[between(i, p).alias(n) for i, (n, p) in enumerate(probs.items())])


def exact_median(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median", **bounds) -> DataFrame:
    """Median per key; the mean of the middle two for an even count."""
    return exact_quantiles(df, value, {name: 0.5}, keys, **bounds)


def modes(df: DataFrame, keys: Sequence[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value per key, ties to the smallest value."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    most = top_n(counts, keys, [F.col("_n").desc(), F.col(value).asc()], 1)
    return most.select(*keys, F.col(value).alias(name))
