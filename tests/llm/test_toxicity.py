import random
import zlib

from pitchline.llm import toxicity
from pitchline.llm.queries import QUERIES
from tests.llm import fixtures


def labelled(spark, n=600):
    r = random.Random(3)
    data, labels = [], []
    for i in range(n):
        words = fixtures.prose(1000 + i, 60).split()
        bad = r.random() < 0.3
        for _ in range(4 * bad):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "moron"]))
        data.append((i, " ".join(words), "en", "s", 1, *["x"] * 7))
        labels.append((i, int(bad)))
    return fixtures.documents(spark, data), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_planted_words_are_found_in_held_out_texts(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and (r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows)


def test_awkward_rows_and_missing_labels(spark):
    docs = fixtures.documents(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (4, 0), (4, 1), (999, 1)], "doc_id long, toxic int")
    for labels in (none, some):
        rows = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
        assert len(rows) == len(fixtures.rows()) and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if not r["text"]}) == 1
    assert toxicity.scored(fixtures.empty(spark), toxicity.train(fixtures.empty(spark), some)).count() == 0


def test_held_out_accuracy_on_the_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in QUERIES["op4_class_conditional_toxicity"](spark, sf).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[i]["predicted"], t) for i, t in truth.items() if rows[i]["held_out"]]
    assert len(rows) == 10000
    right = sum(p == t for p, t in held)
    assert right >= 0.9 * len(held) and right > sum(t == 0 for _, t in held)  # only some 160 toxic documents to learn from
