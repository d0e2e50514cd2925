import uuid
import zlib
from collections import Counter

import pytest

from pitchline.llm import chat_collapse, mixing, shards
from pitchline.session import checkpoint_dir
from tests.llm import fixtures


def plain_targets(sizes):
    """Reshare by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: 3.0 * sizes[s] for s in over}


@pytest.mark.parametrize("skew", [1, 400])
def test_mix_meets_its_targets(spark, skew):
    data = fixtures.rows()
    data += [(5000 + i, fixtures.prose(5000 + i, 20 + i % 50), "en", f"s{1 if i < 150 else i % 9}", 1, *["x"] * 7) for i in range(skew)]
    docs = fixtures.documents(spark, data)
    got = mixing.taken(docs).collect()
    again = mixing.taken(docs.repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    words = [len((r[1] or "").encode().split()) for r in data]
    sizes, most = Counter(), Counter()
    for r, n in zip(data, words):
        sizes[r[3]] += n
        most[r[3]] = max(most[r[3]], n)
    want = plain_targets(sizes)
    assert len(got) == len(data) and sorted(r["size"] for r in got) == sorted(words)
    facts = {(r["source_size"], round(r["target"], 6)) for r in got}
    assert facts == {(sizes[s], round(want[s], 6)) for s in sizes}
    by_source = Counter()
    for r in got:
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by_source[r["source_size"]] += r["taken"]
    for s in sizes:
        assert abs(by_source[sizes[s]] - want[s]) <= 3 * most[s] + sizes[s] / 1024


def test_a_small_part_of_a_large_source_is_met(spark):
    rows = [(k, f"s{k:03d}", "w " * 100) for k in range(200)] + [(1000 + k, "z", "w " * 10) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = [r for r in mixing.taken(docs, mix=mixing.Mix(blocks=16)).collect() if r["source_size"] == 4000]
    assert 40 < got[0]["target"] < 50
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 10


def test_copies_come_in_strips(spark):
    rows = [(5, "a", "two words")] * 23 + [(5, "a", "three more words")] * 10 + [(None, "a", None)] * 11 + [(6, "b", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.taken(docs, mix=mixing.Mix(strips=10)).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == {(5, 2): 23, (5, 3): 10, (None, 0): 11, (6, 1): 1}


def test_tree_splits_quotas_exactly(spark):
    mix = mixing.Mix(levels=3)
    quotas = {0: 1000, 1: 37, 2: 0, 3: 3}
    parts = mixing.split(spark.createDataFrame(list(quotas.items()), "sid int, quota long"), mix).collect()
    totals, per_shard = Counter(), Counter()
    for r in parts:
        totals[r["sid"]] += r["quota"]
        per_shard[r["shard"]] += r["quota"]
    assert {s: totals[s] for s in quotas} == quotas
    assert set(per_shard) == set(range(8)) and max(per_shard.values()) - min(per_shard.values()) <= 3


def test_mixed_rows_are_the_takes(spark):
    docs = fixtures.documents(spark)
    takes = Counter(r["doc_id"] for r in mixing.mixed(docs).collect())
    plain = mixing.drawn(docs).collect()
    want = Counter()
    for r in plain:
        want[r["id"]] += r["copies"] * len(r["draws"])
    assert {k: v for k, v in takes.items() if v} == {k: v for k, v in want.items() if v}
    assert mixing.taken(fixtures.empty(spark)).count() == 0 and mixing.mixed(fixtures.empty(spark)).count() == 0


def collapsed(turns):
    convs: dict = {}
    for c, t, r, x in turns:
        convs.setdefault(c, []).append(((t is not None, t or 0), (r is not None, r or ""), (x is not None, x or "")))
    lists = {c: [v[1:] for v in sorted(vs)] for c, vs in convs.items()}
    out = {}
    for c, said in lists.items():
        if any(len(o) > len(said) and o[:len(said)] == said for o in lists.values()):
            continue
        if any(o == said and (k is not None, k or 0) < (c is not None, c or 0) for k, o in lists.items()):
            continue
        out[c] = "".join(f"<|im_start|>{r[1]}\n{x[1]}<|im_end|>\n" for r, x in said)
    return out


def test_maximal_conversations(spark):
    turns = []
    for conv, n in ((1, 2), (2, 5), (3, 5), (4, 600), (5, 300), (6, 1)):
        turns += [(conv, t, ["user", "bot"][t % 2], f"say {t}") for t in range(n)]
    turns += [(7, t, "user", f"say {t}") for t in range(3)]  # other roles
    turns += [(8, 0, None, "say 0"), (9, 0, "", "say 0"), (10, None, "user", None), (11, 1, "user", ""), (11, 1, "user", "")]
    turns += [(None, 0, "user", "own"), (None, 1, "bot", "words"), (12, 0, "user", "own")]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, part string").repartition(3)
    rows = chat_collapse.rendered(frame).collect()
    got: dict = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        got[r["conv_id"]] = got.get(r["conv_id"], "") + r["text"]
    assert got == collapsed(turns)
    assert {r["part"] for r in rows if r["conv_id"] == 4} == {0, 1, 2}
    assert chat_collapse.rendered(frame.limit(0)).count() == 0


@pytest.mark.parametrize("plan", [shards.Plan(), shards.Plan(shards=3, bucket_bytes=500)])
def test_shards_are_even_and_whole(spark, plan):
    docs = fixtures.documents(spark)
    path = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    shards.write(docs, path, plan=plan)
    got = shards.read(spark, path, docs).collect()
    data = fixtures.rows()
    assert sorted(str((r["doc_id"], r["text"], r["size"])) for r in got) == sorted(str((r[0], r[1], r[10])) for r in data)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.get(s, 0) for s in range(plan.shards)) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sizes[s]))
    second = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    shards.write(docs.repartition(5), second, plan=plan)
    place = sorted((r["shard"], r["slot"], zlib.crc32((r["text"] or "").encode())) for r in got)
    assert place == sorted((r["shard"], r["slot"], zlib.crc32((r["text"] or "").encode())) for r in shards.read(spark, second, docs).collect())


def test_copies_of_one_row_fill_many_buckets(spark):
    plan = shards.Plan(shards=4, bucket_bytes=4000)
    rows = [(None, "same words")] * 9000 + [(7, None)] * 9000 + [(k, f"own {k}") for k in range(2000)] + [(8, "long " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    places = []
    for n in (7, 3):
        path = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
        shards.write(docs.repartition(n), path, plan=plan)
        got = shards.read(spark, path, docs).collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(rows)
        sizes = Counter(r["shard"] for r in got)
        assert max(sizes.values()) - min(sizes.values()) <= 1
        same = Counter(r["shard"] for r in got if r["text"] == "same words")
        assert min(same.values()) > 9000 / 4 * 0.7  # scattered over all shards
        places.append(sorted((r["shard"], r["slot"], str(r["doc_id"]), str(r["text"])) for r in got))
    assert places[0] == places[1]
    spread = shards._numbered(docs.filter("doc_id is null"), plan, 50).groupBy("__bucket").count().collect()
    assert len(spread) == 50 and max(r["count"] for r in spread) < 2 * 9000 / 50


def test_no_rows_to_shard(spark):
    path = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    shards.write(fixtures.empty(spark), path)
    assert shards.read(spark, path, fixtures.empty(spark)).count() == 0
