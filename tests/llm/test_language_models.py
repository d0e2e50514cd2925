import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitchline.llm import byte_grams, context_tree, perplexity
from pitchline.llm.common import row_sums, utf8
from pitchline.llm.queries import QUERIES
from tests.llm import fixtures

SF = "/root/testdata/sf0.001"


def kneser_ney(streams, order):
    """Plain dictionaries: interpolated modified Kneser-Ney over bytes, every gram kept."""
    tables = {order: Counter(s[i:i + order] for s in streams for i in range(len(s) - order + 1) if s[i + order - 1] != 0xFE)}
    for size in range(order - 1, 0, -1):
        tables[size] = Counter(g[1:] for g in tables[size + 1])
    cuts, sums = {}, {}
    for size, t in tables.items():
        n = Counter(t.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else k * 0.5 for k in (1, 2, 3)]
        cuts[size] = [min(max(x, 0.05 * k), 0.95 * k) for k, x in zip((1, 2, 3), d)]
        sums[size] = Counter()
        for g, c in t.items():
            sums[size][g[:-1]] += c
    mass = {}
    for size, t in tables.items():
        for g, c in t.items():
            key = (size, g[:-1])
            mass[key] = mass.get(key, 0) + cuts[size][min(c, 3) - 1] / sums[size][g[:-1]]

    def p(gram):
        size = len(gram)
        if not size:
            return 1 / 256
        c = tables[size][gram]
        own = (c - cuts[size][min(c, 3) - 1]) / sums[size][gram[:-1]] if c else 0
        return own + mass.get((size, gram[:-1]), 1.0) * p(gram[1:])

    return p


def test_perplexity_is_the_plain_models(spark):
    data = fixtures.rows()
    rules = perplexity.Rules(order=3)
    docs = fixtures.documents(spark)
    got = perplexity.scored(docs, perplexity.train(docs, rules=rules), rules=rules).select("doc_id", "text", "log_ppl").collect()
    streams = [b"\xfe" * 2 + (r[1] or "").encode() + b"\xff" for r in data]
    p = kneser_ney(streams, 3)
    for r in got:
        s = b"\xfe" * 2 + (r["text"] or "").encode() + b"\xff"
        want = -sum(math.log(p(s[i - 2:i + 1])) for i in range(2, len(s))) / max(1, len((r["text"] or "").encode().split()))
        assert r["log_ppl"] == pytest.approx(want, rel=1e-4)


def test_rare_grams_have_values_of_their_own(spark):
    data = [(i, fixtures.prose(i, 20000, 500), "en", "s", 0, *["x"] * 7) for i in range(12)]  # over a million bytes
    data.append((100, "qzxjv", "xx", "s", 0, *["x"] * 7))
    docs = fixtures.documents(spark, data)
    got = [r["log_ppl"] for r in perplexity.judged(docs).collect() if r["doc_id"] == 100]
    rules = perplexity.Rules()
    want = [r["log_ppl"] for r in perplexity.scored(docs, perplexity.train(docs, rules=rules), rules=rules).collect() if r["doc_id"] == 100]
    assert got == pytest.approx(want, rel=1e-6)


def plain_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(words) - 7):
        at.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {j for places in at.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "[#*$%&|<>]" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_rules_and_bands(spark):
    docs = fixtures.documents(spark)
    got = perplexity.judged(docs).collect()
    assert len(got) == len(fixtures.rows())
    for r in got:
        want = plain_rules(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert sum(r["kept"] for r in got) > 25
    assert perplexity.judged(fixtures.empty(spark)).count() == 0


def quartile_limits(scores, rules):
    """Limits of one language from its different texts: from sorted values, without bins."""
    s = sorted(scores)
    q1, q2, q3 = (s[max(1, math.ceil(q * len(s))) - 1] for q in (0.25, 0.5, 0.75))
    return q2 - rules.lower * max(q2 - q1, rules.least_spread), q2 + rules.upper * max(q3 - q2, rules.least_spread)


def judged_by_hand(data, rules):
    """(doc_id, kept, letter log-perplexity) from plain dictionaries, for rows (doc_id, text, lang)."""
    order = rules.order
    streams = [b"\xfe" * (order - 1) + (t or "").encode() + b"\xff" for _, t, _ in data]
    p = kneser_ney(streams, order)
    seen, out, texts = {}, [], {}
    for (doc, text, lang), s in zip(data, streams):
        if text not in seen:
            letters = sum(b >= 0x80 or chr(b).isalpha() for b in (text or "").encode())
            seen[text] = -sum(math.log(p(s[i - order + 1:i + 1])) for i in range(order - 1, len(s))) / max(1, letters)
        words, _, _, _, repeated = plain_rules(text)
        bad = words < rules.min_words or 100 * repeated > rules.max_repeat_pct * words
        if not bad:
            texts.setdefault(lang, {})[text] = seen[text]
        out.append((doc, lang, bad, seen[text]))
    limits = {lang: quartile_limits(v.values(), rules) for lang, v in texts.items()}
    return [(doc, not bad and limits[lang][0] <= score <= limits[lang][1], score) for doc, lang, bad, score in out]


def planted():
    """(doc_id, text, lang): two languages of plain prose, one text copied often, and junk for either limit."""
    r = random.Random(5)
    data = [(i, fixtures.prose(i, 120 + 9 * (i % 30)).replace("1", "e").replace("2", "o"), ["en", "de"][i % 2]) for i in range(120)]
    copied = fixtures.prose(500, 200)
    data += [(1000 + i, copied, "en") for i in range(60)]
    words = sorted({w for _, t, _ in data for w in t.split()})
    table = " | ".join(r.choice(words) for _ in range(150))
    noise = "".join(chr(r.randrange(33, 127)) + (" " if r.random() < 0.2 else "") for _ in range(900))
    # One long word in ever other lengths: no window of eight words comes twice, yet nearly every letter is foreseen.
    dull = " ".join("holdingcompanyincorporated" * n for n in r.sample(range(1, 60), 40))
    return data + [(2000, table, "en"), (2001, noise, "de"), (2002, dull, "en"), (2003, "", "en"), (2004, None, None)]


def test_both_limits_reject_planted_junk_and_no_prose(spark):
    data = planted()
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    rules = perplexity.Rules(order=3)
    got = {r["doc_id"]: r for r in perplexity.judged(docs, rules=rules).collect()}
    for doc, kept, score in judged_by_hand(data, rules):
        assert got[doc]["letter_ppl"] == pytest.approx(score, rel=1e-4)
        assert got[doc]["kept"] == kept, (doc, score)
    assert [d for d in (2000, 2001, 2002, 2003, 2004) if got[d]["kept"]] == []
    assert not any(got[d]["base_failed"] for d in (2000, 2001, 2002))
    assert all(got[i]["kept"] for i in range(120)) and all(got[1000 + i]["kept"] for i in range(60))


def test_columns_of_the_input_stay_or_are_replaced_by_results(spark):
    names = ("__low", "band_lang", "low", "high", "letter_ppl", "kept", "chunk", "gram", "n", "value", "body")
    docs = spark.createDataFrame([(i, fixtures.prose(i, 60), "en", *["x"] * 11) for i in range(9)],
                                 "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in names))
    got = perplexity.judged(docs)
    assert len(got.columns) == len(set(got.columns))
    for r in got.collect():
        assert all(r[c] == "x" for c in names if c not in ("letter_ppl", "kept")) and isinstance(r["letter_ppl"], float)
        assert r["kept"] is True


def test_perplexity_query_over_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_ngram_perplexity"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_rules(texts[r["doc_id"]])


def weighted_tree(streams, depth):
    """The defining recursion over all contexts, without pruning; predictions from the trained weights."""
    counts: dict = {}
    for s in streams:
        for i in range(depth, len(s)):
            for d in range(depth + 1):
                node = 1
                for k in range(7, -1, -1):
                    bit = s[i] >> k & 1
                    counts.setdefault((s[i - d:i], node), [0, 0])[bit] += 1
                    node = 2 * node + bit

    def block(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.log(math.pi) - math.lgamma(c[0] + c[1] + 1)

    below: dict = {}
    for (context, node) in counts:
        if context:
            below.setdefault((context[1:], node), []).append((context, node))
    weighted, stop = {}, {}
    for d in range(depth, -1, -1):
        for key, c in counts.items():
            if len(key[0]) == d:
                own = block(c)
                if d == depth:
                    weighted[key], stop[key] = own, 1.0
                else:
                    split = sum(weighted[k] for k in below[key])
                    weighted[key] = np.logaddexp(own, split) + math.log(0.5)
                    stop[key] = math.exp(math.log(0.5) + own - weighted[key])

    def p(context, byte):
        total, node = 0.0, 1
        for k in range(7, -1, -1):
            bit, one, left = byte >> k & 1, 0.0, 1.0
            known = 0
            while known < depth and (context[len(context) - known - 1:], 0) and any((context[len(context) - known - 1:], n) in counts for n in (1,)):
                known += 1
            for d in range(known + 1):
                c = counts.get((context[len(context) - d:], node), [0, 0])
                s = stop.get((context[len(context) - d:], node), 1.0 if d == depth else 0.5)
                one += left * s * (c[1] + 0.5) / (c[0] + c[1] + 1)
                left *= 1 - s
            one += left * 0.5 if known < depth else 0.0
            total += math.log10(one if bit else 1 - one)
            node = 2 * node + bit
        return total

    return p


def test_code_length_is_the_defining_recursions(spark):
    tree = context_tree.Tree(depth=2, share=0.0)
    docs = fixtures.documents(spark)
    got = context_tree.scored(docs, tree=tree).collect()
    data = [(r[0], b" ".join((r[1] or "").encode().lower().split())) for r in fixtures.rows()]

    def held(i):
        return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0

    p = weighted_tree([b"\xfe" * 2 + t + b"\xff" for i, t in data if not held(i)], 2)
    want = []
    tokens = Counter(w for i, t in data if not held(i) for w in [*t.split(), None])
    n, v = sum(tokens.values()), len(tokens)
    for i, t in data:
        s = b"\xfe" * 2 + t + b"\xff"
        words = [*t.split(), None]
        want.append((i, held(i), len(words), sum(tokens[w] > 0 for w in words), n,
                     sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), sum(p(s[k - 2:k], s[k]) for k in range(2, len(s)))))

    def order(r):
        return (r[0] is not None, r[0] or 0, r[2], r[5])

    rows = sorted((tuple(r)[:7] for r in got), key=order)
    for a, b in zip(rows, sorted(want, key=order), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] == pytest.approx(b[6], rel=1e-3, abs=1e-2)


def test_pruned_trees_still_give_distributions():
    r = np.random.default_rng(1)
    contexts = [np.zeros(1, np.uint64), np.array([1, 2, 3], np.uint64), np.array([1, 259, 514], np.uint64)]
    levels, below = [], None
    for d in (2, 1, 0):
        counts = r.integers(0, 50, (len(contexts[d]), 256)).astype(float)
        if below is not None:
            parent = np.searchsorted(contexts[d], contexts[d + 1] & np.uint64((1 << 8 * d) - 1))
            np.add.at(counts, parent, below)
        levels.insert(0, (contexts[d], counts))
        below = counts
    tree = context_tree.ContextTree(levels)
    assert np.allclose((10.0 ** tree.table.reshape(-1, 256)).sum(axis=1), 1, atol=1e-4)


def test_rare_contexts_stay_however_large_the_corpus(spark):
    odd = "qzxjv wkqyh"  # a few dozen visits among 800 kB
    data = [(i, fixtures.prose(i, 10000, 500), "en", "s", 0, *["x"] * 7) for i in range(1, 17)]
    data += [(i, odd, "en", "s", 0, *["x"] * 7) for i in range(100, 140)]
    got = context_tree.scored(fixtures.documents(spark, data)).collect()
    plain = context_tree.scored(fixtures.documents(spark, data), tree=context_tree.Tree(share=0.0)).collect()
    by = {r["doc_id"]: r["bits_per_byte"] for r in plain}
    assert all(r["bits_per_byte"] == pytest.approx(by[r["doc_id"]], rel=1e-6) for r in got)


def test_chunks_of_any_size_give_the_same_scores(spark):
    rows = fixtures.documents(spark).select("doc_id", "text")
    plain = None
    for size in (1, 3000, 1 << 25):
        chunked = byte_grams.Chunks(rows, "text", 3, "test-grams", size=size)
        values = chunked.grams().select("gram", F.col("n").cast("double").alias("value"))

        def make():
            def step(texts, found):
                data, offsets = utf8(texts)
                stream, lengths = byte_grams.padded(data, offsets, 2)
                return [pa.array(row_sums(found.along(stream, 3), lengths))]

            return step

        out = byte_grams.with_values(chunked, values, make, [T.StructField("total", T.DoubleType())])
        got = sorted((str(r["doc_id"]), r["text"] or "", r["total"]) for r in out.collect())
        assert plain is None or got == plain
        plain = got


def test_score_beats_the_base_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.1"
    rows = [r for r in QUERIES["op5_context_tree_weighting"](spark, sf).collect() if r["held_out"]]
    assert rows and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_no_texts_to_score(spark):
    assert context_tree.scored(fixtures.empty(spark)).count() == 0
