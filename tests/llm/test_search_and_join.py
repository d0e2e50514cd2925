import math
from collections import Counter

import duckdb
import pytest

from pitchline.llm import bm25_search, ngram_join
from pitchline.llm.queries import ORACLES, QUERIES
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = want.select(*columns).fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, rows))


@pytest.mark.parametrize("search", [bm25_search.Search(), bm25_search.Search(k=3, block=2, common=2, shard_docs=7, block_terms=50)])
def test_search_equals_scoring_everything(spark, search):
    data = [(r[0], words(r[1])) for r in fixtures.rows()]
    docs = fixtures.documents(spark)
    got = sorted(map(tuple, bm25_search.search_all(docs, docs.filter("doc_id % 4 = 0"), search=search).collect()))
    df = Counter(w for _, t in data for w in set(t))
    mean = sum(len(t) for _, t in data) / len(data)
    want = []
    for q, terms in {i: t for i, t in data if i is not None and i % 4 == 0}.items():
        scores = []
        for i, t in data:
            tf = Counter(t)
            s = sum(n * math.log(1 + (len(data) - df[w] + 0.5) / (df[w] + 0.5)) * 2.2 * tf[w] / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean))
                    for w, n in Counter(terms).items() if tf[w])
            if s > 0:
                scores.append((-round(s, 6), i is None, i or 0))
        want += [(q, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:search.k])]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)]
    assert all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(got, sorted(want)))


def grams(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(data):
    """Every pair compared: links per row, and the least id of each connected group."""
    sets = [grams(t) for _, t in data]
    links = [[k for k, b in enumerate(sets) if k != i and a and b and len(a & b) >= 0.8 * len(a | b)] for i, a in enumerate(sets)]
    label = list(range(len(data)))
    changed = True
    while changed:
        changed = False
        for i, near in enumerate(links):
            least = min([label[i], *(label[k] for k in near)])
            changed |= least < label[i]
            label[i] = least
    ids = {}
    for i, (doc, _) in enumerate(data):
        ids.setdefault(label[i], []).append(doc)
    out = []
    for i, (doc, _) in enumerate(data):
        known = [x for x in ids[label[i]] if x is not None]
        out.append((doc, min(known) if known else None, len(links[i])))
    return out


@pytest.mark.parametrize("join", [ngram_join.Join(), ngram_join.Join(tile=2)])
def test_join_equals_comparing_all_pairs(spark, join):
    data = [r[:2] for r in fixtures.rows()]
    base = fixtures.prose(500, 200).split()
    for i in range(12):  # a chain of near copies, each one word further from the first
        near = list(base)
        for k in range(i):
            near[10 + 13 * k] = f"changed{k}"
        data.append((1000 + i, " ".join(near)))
    rows = [(*r, "en", "s1", 1, *["x"] * 7) for r in data]

    def order(r):
        return tuple((x is not None, x or 0) for x in r)

    got = sorted((tuple(r)[:3] for r in ngram_join.joined(fixtures.documents(spark, rows), join=join).collect()), key=order)
    assert got == sorted(groups(data), key=order)


def test_deduplicated_keeps_one_of_each_group(spark):
    data = fixtures.rows()
    got = ngram_join.deduplicated(fixtures.documents(spark)).collect()
    want = Counter()
    for doc, least, _ in groups([r[:2] for r in data]):
        want[least] += 0
    kept = Counter(r["doc_id"] for r in got if words(r["text"]))
    assert set(kept.values()) == {1}
    assert set(kept) == {least for (doc, least, _), r in zip(groups([r[:2] for r in data]), data) if words(r[1])}
    assert sum(not words(r["text"]) for r in got) == sum(not words(r[1]) for r in data)


@pytest.mark.parametrize("doc_id", [None, 7])
def test_near_copies_under_one_id_or_none_are_one_group(spark, doc_id):
    base = fixtures.prose(500, 200)
    data = [(doc_id, t, "en", "s1", 0, *["x"] * 7) for t in (base, base + " one", base + " two", base)]
    assert ngram_join.deduplicated(fixtures.documents(spark, data)).count() == 1


def test_bands_follow_from_recall():
    join = ngram_join.Join()
    assert 1 - (1 - 0.8 ** join.rows) ** join.bands >= join.recall > 1 - (1 - 0.8 ** join.rows) ** (join.bands - 1)


def test_empty_tables(spark):
    empty = fixtures.empty(spark)
    assert bm25_search.search_all(empty, empty).count() == 0
    assert ngram_join.joined(empty).count() == 0
    assert ngram_join.deduplicated(empty).count() == 0


def test_search_asks_the_least_of_several_texts_under_one_id(spark):
    data = [(i, fixtures.prose(i, 40)) for i in range(50)] + [(200, fixtures.prose(3, 40)), (200, fixtures.prose(30, 40)), (200, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    least = min(fixtures.prose(3, 40), fixtures.prose(30, 40))
    found = []
    for order in (docs.orderBy("text"), docs.orderBy(docs.text.desc())):
        rows = bm25_search.search_all(docs, order.filter("doc_id = 200").coalesce(1)).orderBy("rank", "doc_id").collect()
        found.append([(r["rank"], r["doc_id"], r["score"]) for r in rows])
    one = bm25_search.search_all(docs, spark.createDataFrame([(200, least)], "doc_id long, text string")).orderBy("rank", "doc_id").collect()
    assert found[0] == found[1] == [(r["rank"], r["doc_id"], r["score"]) for r in one]


def test_rounds_of_components_take_about_an_edge_a_node(spark, monkeypatch):
    """Texts of one group meet another least text in each band; the rows of a round must not grow with the bands."""
    nodes, hubs = 400, 30
    edges = [(1000 + i, h) for i in range(nodes) for h in range(i % 7, hubs, 7)] + [(h, h) for h in range(hubs)]
    edges += [(1000 + i, 7 + i % 2) for i in range(nodes)] + [(5001, 5000), (5002, 5001)]
    sizes = []

    def staged(df, name):
        out = ngram_join_staged(df, name)
        sizes.append(out.count())
        return out

    ngram_join_staged = ngram_join.staged
    monkeypatch.setattr(ngram_join, "staged", staged)
    labels = {r["node"]: r["label"] for r in ngram_join.components(spark.createDataFrame(edges, "node long, other long"), "test").collect()}
    want = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(10):
        for a, b in edges:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert labels == want
    assert max(sizes[1:]) <= 2 * (nodes + 2 * hubs)


def test_a_pair_of_tiles_connects_only_what_the_tiles_do_not():
    import pyarrow as pa

    n = 40
    part = pa.table({"__key": pa.array(range(100, 100 + n)), "copies": pa.array([1 + i % 2 for i in range(n)]), "tile": pa.array([i % 2 for i in range(n)], pa.int32()),
                     "__grams": pa.array([list(range(20))] * (n - 2) + [list(range(50, 60))] * 2)})
    rows = ngram_join.verified(part, 0.8).to_pylist()
    assert [(r["__key"], r["label"]) for r in rows if r["label"] != r["__key"]] == [(101, 100), (139, 138)]
    assert rows[0]["links"] == sum(1 + i % 2 for i in range(1, n - 2, 2)) and rows[-1]["links"] == 1
    one = ngram_join.verified(part.filter(pa.compute.equal(part["tile"], 0)), 0.8).to_pylist()
    assert {r["label"] for r in one} == {100, 138}


def test_lists_of_a_tenth_of_a_shard_are_walked(spark):
    """A list that misses few blocks bounds nothing, so that most documents would be scored in full."""
    data = [(i, f"all mid{i % 10} " + fixtures.prose(i, 5, 2000)) for i in range(640)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    batch = bm25_search.index(docs, "doc_id", "text", bm25_search.Search()).toArrow().combine_chunks().to_batches()[0]
    shard = bm25_search.Shard(batch, 0, 7.0, bm25_search.Search())
    assert (shard.sizes[shard.common] * 4 >= 640).all() and len(shard.common) >= 1
