"""Runs (maximal repetitions) of words in each text, by suffix-tree LCE and Lyndon roots.

A run is a stretch whose words repeat with a smallest period q, at least twice, and that no neighbour extends. Every run
has a conjugate of its period that is the longest Lyndon word starting at its place, in the order of the words or in the
reversed order, so each place gives two candidates: the longest Lyndon words, found as next smaller suffixes. Each is
extended to the right and to the left by longest common extensions, which are depths of lowest common ancestors in two
suffix trees (Ukkonen): of the words and of their reversal. The trees' Euler tours leave, between neighbouring leaves,
the depth of their lowest common ancestor; a table of minima over powers of two answers any pair in constant time.

Stretches without a repeated six-gram near enough hold no run of ``least`` words and are left out before trees are
built (``stretches`` gives the reason); this loses nothing. A text is one unit of work; texts are taken in slices of
bounded size, without a shuffle. A tree takes some 400 bytes a word of its stretch.

Defined results: a null text has no words; an empty one neither; rows repeat as they come; null ids change nothing; an
empty table gives no rows; texts of any length are read whole; other columns travel along (those in ``drop`` do not), and
input columns named n_words, runs or collapsed are replaced. Runs come by start, then period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pitchline.llm.common import mix, slices

GRAM = 6
RUN = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
NEW = [T.StructField("n_words", T.LongType()), T.StructField("runs", RUN), T.StructField("collapsed", T.StringType())]


def split_words(row_id, text: bytes) -> list[bytes]:
    """bytes.split() cuts at exactly the six ASCII white-space bytes."""
    return text.split()


class SuffixTree:
    """Ukkonen's tree of a list of codes from 1 on; place n is the end mark, code 0."""

    def __init__(self, codes: list[int]):
        self.text = [*codes, 0]
        self.width = max(self.text) + 1
        self._build()
        self._tour()

    def _build(self) -> None:
        text, width, size = self.text, self.width, len(self.text)
        begin, end, link, child = [0], [0], [0], {}
        node = at = depth = pending = 0
        for i, code in enumerate(text):
            pending += 1
            unlinked = 0
            while pending:
                if not depth:
                    at = i
                key = node * width + text[at]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i)
                    end.append(size)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    span = end[below] - begin[below]
                    if depth >= span:
                        node, at, depth = below, at + span, depth - span
                        continue
                    middle = begin[below] + depth
                    if text[middle] == code:
                        if unlinked:
                            link[unlinked] = node
                        depth += 1
                        break
                    fork = len(begin)
                    begin += (begin[below], i)
                    end += (middle, size)
                    link += (0, 0)
                    child[key] = fork
                    child[fork * width + code] = fork + 1
                    child[fork * width + text[middle]] = below
                    begin[below] = middle
                    if unlinked:
                        link[unlinked] = fork
                    unlinked = fork
                pending -= 1
                if node:
                    node = link[node]
                elif depth:
                    depth -= 1
                    at = i - pending + 1
        count = len(begin)
        self.spans = (np.asarray(end) - np.asarray(begin)).tolist()
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self.children = np.fromiter(child.values(), np.int64, len(child))[order]
        self.parents, self.codes = keys[order] // width, keys[order] % width
        self.first = np.searchsorted(self.parents, np.arange(count + 1)).tolist()

    def _walk(self, backward: bool) -> tuple[list[int], list[int]]:
        """Leaves in the order of the codes, or of the codes reversed (the end mark is least in both); the depths between."""
        first, spans, size = self.first, self.spans, len(self.text)
        if backward:  # children of a node from the greatest code on, but a child by the end mark first
            order = np.lexsort((-self.codes, self.codes != 0, self.parents))
            children = self.children[order].tolist()
        else:
            children = self.children.tolist()
        up = np.zeros(len(spans), np.int64)
        up[self.children] = self.parents
        up = up.tolist()
        depths = [0] * len(spans)
        leaves, between, stack, fresh = [], [], [0], False
        while stack:
            node = stack.pop()
            above = depths[up[node]]
            if fresh:
                between.append(above)
                fresh = False
            depths[node] = above + spans[node]
            a, b = first[node], first[node + 1]
            if a == b:
                leaves.append(size - depths[node])
                fresh = True
            else:
                stack += children[a:b][::-1]
        return leaves, between

    def _tour(self) -> None:
        leaves, between = self._walk(False)
        self.rank = np.empty(len(leaves), np.int64)
        self.rank[leaves] = np.arange(len(leaves))
        level = np.asarray(between, np.int32)
        self.minima = [level]
        while len(level) > 1 and 2 << len(self.minima) - 1 <= len(between):
            half = 1 << len(self.minima) - 1
            level = np.minimum(level[:-half], level[half:])
            self.minima.append(level)

    def reversed_rank(self) -> np.ndarray:
        leaves, _ = self._walk(True)
        rank = np.empty(len(leaves), np.int64)
        rank[leaves] = np.arange(len(leaves))
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of the suffixes at a and b (a != b)."""
        lo, hi = np.minimum(self.rank[a], self.rank[b]), np.maximum(self.rank[a], self.rank[b])
        power = np.frexp((hi - lo).astype(np.float64))[1] - 1  # floor(log2)
        out = np.zeros(len(lo), np.int64)
        for k in np.unique(power):
            at = np.flatnonzero(power == k)
            level = self.minima[k]
            out[at] = np.minimum(level[lo[at]], level[hi[at] - (1 << k)])
        return out


def next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every place but the end mark, the next one with a smaller rank: its longest Lyndon word ends before it."""
    values = rank.tolist()
    out, open_places = [0] * len(values), []
    for j, v in enumerate(values):
        while open_places and values[open_places[-1]] > v:
            out[open_places.pop()] = j
        open_places.append(j)
    return np.asarray(out[:-1], np.int64)


def runs_of(codes: list[int], least: int = 2) -> np.ndarray:
    """All runs (start, length, period) of at least ``least`` codes, by start, then period."""
    n = len(codes)
    if n < 2:
        return np.zeros((0, 3), np.int64)
    forward, back = SuffixTree(codes), SuffixTree(codes[::-1])
    starts = np.arange(n)
    found = []
    for rank in (forward.rank, forward.reversed_rank()):
        stops = next_smaller(rank)
        right = forward.common(starts, stops)
        left = back.common(n - starts, n - stops)
        period = stops - starts
        length = left + period + right
        hit = length >= np.maximum(2 * period, least)
        found.append(np.stack([starts - left, period, length], 1)[hit])
    return np.unique(np.concatenate(found), axis=0)[:, [0, 2, 1]]


def stretches(codes: np.ndarray, starts: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches [a, b) of the words, within one text each, that hold all runs of ``least`` >= 12 words.

    In a run of L >= max(12, 2q) words every word lies in a six-gram that occurs again q words on or before, inside the
    run, and q <= L / 2. So a run lies inside one stretch of such six-grams, at most half its length apart; what is no
    such stretch is dropped, until nothing changes. Colliding hashes only keep more.
    """
    n = len(codes)
    if n < least:
        return []
    owner = np.zeros(n + 1, np.int64)
    np.add.at(owner, starts[:-1], 1)
    owner = np.cumsum(owner)[:n]
    mixed = mix(codes.astype(np.uint64) + np.uint64(1))
    gram = owner[:n - GRAM + 1].astype(np.uint64)
    for k in range(GRAM):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + mixed[k:n - GRAM + 1 + k]
    at = np.flatnonzero(owner[:n - GRAM + 1] == owner[GRAM - 1:])
    at = at[np.argsort(gram[at], kind="stable")]
    same = gram[at[1:]] == gram[at[:-1]]
    one, two = at[:-1][same], at[1:][same]  # neighbouring places of one six-gram
    while True:
        live = np.zeros(n + 1, np.int32)
        places = np.unique(np.concatenate([one, two]))
        np.add.at(live, places, 1)
        np.add.at(live, places + GRAM, -1)
        covered = np.cumsum(live[:n]) > 0
        edge = np.flatnonzero(covered & np.concatenate([[True], ~covered[:-1] | (owner[1:] != owner[:-1])]))
        stop = np.flatnonzero(covered & np.concatenate([~covered[1:] | (owner[1:] != owner[:-1]), [True]])) + 1
        if not len(edge):
            return []
        inside = np.searchsorted(edge, one, side="right") - 1
        long = stop - edge
        near = (two < stop[inside]) & (2 * (two - one) <= long[inside]) & (long[inside] >= least)
        if near.all():
            return list(zip(edge.tolist(), stop.tolist()))
        one, two = one[near], two[near]


def _runs_of_slice(words: list[list[bytes]], least: int) -> dict[int, np.ndarray]:
    """Runs by row, for the rows that have any."""
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    codes = pa.array(chain.from_iterable(words), pa.binary(), size=int(starts[-1])).dictionary_encode().indices.to_numpy()
    out: dict[int, list] = {}
    for a, b in stretches(codes, starts, max(least, 2 * GRAM)):
        _, own = np.unique(codes[a:b], return_inverse=True)
        runs = runs_of((own + 1).tolist(), least)
        if len(runs):
            row = int(np.searchsorted(starts, a, side="right")) - 1
            out.setdefault(row, []).append(runs + [a - int(starts[row]), 0, 0])
    return {row: np.concatenate(parts) for row, parts in out.items()}


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words joined by a blank, without those that a run contains after its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0)])


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop: tuple[str, ...] = (), least: int = 12,
          words_of: Callable[[object, bytes], list[bytes]] = split_words) -> DataFrame:
    """Every row with n_words, runs and collapsed. ``least`` is 12 at least; ``words_of`` makes words of (id, text)."""
    if least < 2 * GRAM:
        raise ValueError(f"runs shorter than {2 * GRAM} words are not kept whole by the stretches")
    taken = {f.name.lower() for f in NEW}
    base = docs.select(*[f"`{c}`" for c in docs.columns if c.lower() not in taken])
    kept = [i for i, f in enumerate(base.schema.fields) if f.name not in drop]
    schema = T.StructType([base.schema.fields[i] for i in kept] + NEW)
    names, text_at, id_at = schema.names, base.columns.index(text_col), base.columns.index(id_col)
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_at):
                texts = pc.fill_null(batch.column(text_at), "").cast(pa.binary()).to_pylist()
                words = [words_of(i, t) for i, t in zip(batch.column(id_at).to_pylist(), texts)]
                by_row = _runs_of_slice(words, least)
                rows = np.concatenate([by_row.get(i, np.zeros((0, 3), np.int64)) for i in range(len(words))])
                ends = np.cumsum([0] + [len(by_row.get(i, ())) for i in range(len(words))])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(rows[:, k]) for k in range(3)], ["start", "length", "period"])).cast(run_type)
                short = [collapsed(w, by_row[i]) if i in by_row else b" ".join(w) for i, w in enumerate(words)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i) for i in kept] + [pa.array([len(w) for w in words], pa.int64()), lists,
                                                       pa.array(short, pa.binary()).cast(pa.string())], names=names)

    return base.mapInArrow(run, schema)
