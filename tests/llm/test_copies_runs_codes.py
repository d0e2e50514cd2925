import hashlib
import math
import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitchline.llm import exact_dedup, periodic_runs, vector_codes
from pitchline.llm.queries import planted_words
from tests.llm import fixtures

CLASHES = ["keep_id", "Kept", "group_size", "text_sha256", "n_words", "runs", "collapsed", "given", "id", "sha", "row", "word",
           "bits", "second", "mask", "b0", "last", "code", "error", "n", "points", "vector", "_0"]


def with_clashes(df):
    return df.select(*[c for c in df.columns if c not in CLASHES], *[F.lit(f"old {c}").alias(c) for c in CLASHES])


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


# ---- exact copies


def check_copies(rows, got):
    """Every row once; per text the largest id, the count, and exactly one row kept."""
    ids = defaultdict(list)
    for i, text in rows:
        ids[sha(text)].append(i)
    want = sorted(repr((i, max((x for x in ids[sha(t)] if x is not None), default=None), len(ids[sha(t)]), sha(t))) for i, t in rows)
    assert sorted(repr((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == want
    kept = Counter(r["text_sha256"] for r in got if r["kept"])
    assert kept == {k: 1 for k in ids}
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


@pytest.mark.parametrize("words", [0, 1 << 20])
def test_copies_awkward_rows(spark, words):
    docs = with_clashes(fixtures.documents(spark))
    out = exact_dedup.marked(docs, plan=exact_dedup.Plan(broadcast_words=words))
    assert set(out.columns) == (set(docs.columns) - {"Kept"}) | {"kept"} and len(out.columns) == len(docs.columns)
    got = out.collect()
    check_copies([(r[0], r[1]) for r in fixtures.rows()], got)
    assert {r["sha"] for r in got} == {"old sha"} and {r["given"] for r in got} == {"old given"} and {r["_0"] for r in got} == {"old _0"}


def test_copies_hot_group(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 2500}") for i in range(6000)] + [(1 << 40, "the same text")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check_copies(rows, exact_dedup.marked(docs, drop=("text",)).collect())
    kept = exact_dedup.deduplicated(docs).collect()
    assert len(kept) == len({t for _, t in rows}) and Counter(r["text"] for r in kept) == {t: 1 for _, t in rows}


def test_copies_once_rows_do_not_shuffle(spark):
    """The filter lets nearly all single rows pass: of 20,000 different texts hardly any is taken for a copy."""
    hashes = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("word"), F.xxhash64("id", F.lit(1)).alias("second"))
    mask = F.lit(0).cast("long")
    for k, b in enumerate(exact_dedup._bits()):
        hashes = hashes.withColumn(f"b{k}", b)
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, b{k})"))
    bits = exact_dedup.repeated_bits(hashes)
    possible = hashes.withColumn("mask", mask).join(bits, "word").filter("(bits & mask) = mask").count()
    assert possible < 400
    twice = hashes.unionAll(hashes.limit(50))
    assert twice.withColumn("mask", mask).join(exact_dedup.repeated_bits(twice), "word").filter("(bits & mask) = mask").count() >= 100


def test_copies_normal_empty_and_long(spark):
    long = fixtures.prose(5, 1000) * 1500
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + "x"), (4, "A b"), (5, "a B")], "doc_id long, text string")
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.marked(docs).collect()} == {(1, 2), (2, 2), (3, 3), (4, 4), (5, 5)}
    folded = exact_dedup.marked(docs, normal=F.lower).collect()
    assert {(r["doc_id"], r["keep_id"]) for r in folded if r["doc_id"] > 3} == {(4, 5), (5, 5)}
    assert exact_dedup.marked(fixtures.empty(spark)).count() == 0
    assert exact_dedup.deduplicated(with_clashes(fixtures.empty(spark))).columns == with_clashes(fixtures.empty(spark)).columns


# ---- runs


def plain_runs(words, least):
    """Every lag's stretches of equal pairs; the smallest lag of a stretch is its period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(2 * q, least):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return b" ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_all_runs_by_brute_force(letters):
    r = random.Random(letters)
    for _ in range(250):
        codes = [r.randint(1, letters) for _ in range(r.randint(0, 48))]
        assert [tuple(x) for x in periodic_runs.runs_of(codes).tolist()] == plain_runs(codes, 2)


def periodic_texts():
    r = random.Random(12)
    texts = []
    for k in range(150):
        words = fixtures.prose(k, r.randint(0, 120), vocabulary=r.choice([2, 5, 60, 400])).split()
        for _ in range(r.randint(0, 3)):  # runs of several periods, side by side and one within another
            at, p = r.randint(0, len(words)), r.randint(1, 14)
            piece = [f"w{r.randint(0, 6)}" for _ in range(p)]
            words[at:at] = (piece * r.randint(2, 9))[:r.randint(p, 9 * p)]
        texts.append(r.choice([" ", "\n", " \t ", "\r\n"]).join(words))
    return texts


def test_runs_of_texts_by_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(periodic_texts())] + [(r[0], r[1]) for r in fixtures.rows()]
    docs = with_clashes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    got = periodic_runs.found(docs).collect()
    want = []
    for i, t in rows:
        words = (t or "").encode().split()
        runs = plain_runs(words, 12)
        want.append(repr((i, len(words), runs, plain_collapsed(words, runs).decode())))
    assert sorted(repr((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"])) for r in got) == sorted(want)
    assert sum(len(r["runs"]) for r in got) > 100 and {r["given"] for r in got} == {"old given"}


def test_planted_periods_are_found(spark):
    rows = [(i, fixtures.prose(i, 200, vocabulary=3000)) for i in range(120)] + [(None, "some words " * 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in periodic_runs.found(docs, words_of=planted_words).collect():
        text = next(t for i, t in rows if i == r["doc_id"])
        assert [tuple(x) for x in r["runs"]] == plain_runs(planted_words(r["doc_id"], text.encode()), 12)


def test_runs_in_a_long_text(spark):
    head = " ".join(f"h{i * 7919 % 1_000_003}" for i in range(1_200_000))
    text = f"{head} {'again and once more ' * 5000}tail"
    assert len(text) > 9_000_000
    row = periodic_runs.found(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in row["runs"]] == [(1_200_000, 20_000, 4)]
    assert row["collapsed"] == f"{head} again and once more tail"
    assert periodic_runs.found(fixtures.empty(spark)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.found(fixtures.empty(spark), least=5)


# ---- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """The contract in plain integers: rows of (id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    cut = lambda v: [[math.floor(4096 * x) for x in v[p * len(v) // parts:(p + 1) * len(v) // parts]] for p in range(parts)]
    points = [cut(r[1]) for r in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0], kept[i][1]))[:entries]
    books = [[points[i][p] for i in first] for p in range(parts)]
    gap = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    assign = lambda: [[min((gap(x[p], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for x in points]
    for _ in range(rounds):
        at, new = assign(), [list(b) for b in books]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [x[p] for x, a in zip(points, at) if a[p][1] == k]
                if mine:
                    new[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
        books = new
    out = [(r[0], "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a)) for r, a in zip(kept, assign())]
    return out, books


def float32(x):
    return struct.unpack("f", struct.pack("f", x))[0]


def vectors(n, dims, spread):
    r = random.Random(n)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = [(i, [float32(c + r.gauss(0, spread)) for c in r.choice(centres)], i % 3 or None) for i in range(n)]
    rows += [(n + i, list(rows[7][1]), 1) for i in range(n // 2)]  # one vector owns a third
    rows += [rows[3], rows[3], (None, list(rows[4][1]), None), (n * 2, None, 1), (n * 2 + 1, [None] * dims, 2),
             (n * 2 + 2, [math.nan] + [0.0] * (dims - 1), 2), (n * 2 + 3, [math.inf] * dims, 2), (n * 2 + 4, [-0.0] * dims, 2)]
    return rows


@pytest.mark.parametrize("n,dims,spread,block", [(300, 64, 0.05, 64), (90, 16, 0.5, 8), (9, 8, 1.0, 4), (400, 24, 0.01, 16)])
def test_codes_by_brute_force(spark, n, dims, spread, block):
    rows = vectors(n, dims, spread)
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4))
    codes = vector_codes.compressed(df, plan=vector_codes.Plan(block=block, chunk=100))
    want, books = plain_codes(rows)
    got = codes.rows.collect()
    assert sorted(repr((r["vec_id"], r["code"], r["error"])) for r in got) == sorted(map(repr, want))
    assert codes.books.tolist() == books
    assert {r["given"] for r in got} == {"old given"}


def test_boxes_leave_short_lists():
    """Near rows lie in one block, so most entries are never evaluated, and a tie keeps both entries."""
    r = np.random.default_rng(1)
    centres = r.integers(-4000, 4000, (16, 8))
    points = (centres[r.integers(0, 16, 4096)] + r.integers(-50, 50, (4096, 8))).astype(np.int64)
    plan = vector_codes.Plan(parts=1)
    chunk = vector_codes.Chunk.pack(points, plan)
    listed = vector_codes.shortlists(chunk.low[0], chunk.high[0], centres)
    assert listed.any(1).all() and listed.mean() < 0.25 and (listed.sum(1) == 1).mean() > 0.5
    counts, sums = np.zeros((1, 16), np.int64), np.zeros((1, 16, 8), np.int64)
    vector_codes.round_sums(chunk, centres[None], counts, sums)
    near = ((points[:, None, :] - centres) ** 2).sum(2).argmin(1)
    assert counts[0].tolist() == np.bincount(near, minlength=16).tolist()
    assert all(sums[0, e].tolist() == points[near == e].sum(0).tolist() for e in range(16))
    tied = vector_codes.shortlists(np.zeros((1, 2), np.int32), np.zeros((1, 2), np.int32), np.array([[3, 4], [5, 0], [4, 4]]))
    assert tied.tolist() == [[True, True, False]]


def test_hilbert_order_visits_neighbours():
    for dims in (2, 3):
        grid = np.stack(np.meshgrid(*[np.arange(16)] * dims), -1).reshape(-1, dims)
        steps = np.abs(np.diff(grid[np.argsort(vector_codes.hilbert_keys(grid))], axis=0)).sum(1)
        assert set(steps.tolist()) == {1}


def test_codes_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.compressed(empty).rows.collect() == []
    odd = spark.createDataFrame([(1, [1.0] * 9), (2, [1e30] * 9), (3, [-1e30] * 2), (4, [])], "vec_id long, embedding array<float>")
    codes = vector_codes.compressed(odd)
    assert codes.books.shape == (8, 4, 2) and sorted(r["vec_id"] for r in codes.rows.collect()) == [1, 2, 3, 4]
    assert abs(codes.books).max() == vector_codes.LIMIT
