from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from pitchline.llm import mixing, ngram_join, piece_lattice, toxicity
from pitchline.llm.common import table
from pitchline.session import checkpoint_dir
from tests.llm.test_language_models import plain_rules
from tests.llm.test_search_and_join import groups

SF = "/root/testdata/sf0.001"


def test_stages_step_by_step(spark):
    """Each stage against a plain version of its decision on the rows that the stage before it kept."""
    docs = table(spark, SF, "documents")
    scores = toxicity.scored(docs, toxicity.train(docs, table(spark, SF, "labels"))).collect()
    inputs, outputs = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, inputs, SF)
        path = f"{checkpoint_dir(spark)}/stage-{k}-{id(out)}"
        out.write.parquet(path)
        inputs = spark.read.parquet(path)
        outputs.append(inputs.collect())
        assert k == 4 or inputs.columns == docs.columns, name
    clean, good, single, mixed, encoded = outputs
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in scores if r["score"] < 0.5}
    passed = {r["doc_id"] for r in clean if (c := plain_rules(r["text"]))[0] >= 20 and 100 * c[4] <= 30 * c[0]}
    assert {r["doc_id"] for r in good} <= passed and len(good) >= 0.8 * len(passed)
    assert {r["doc_id"] for r in single} == {least for _, least, _ in groups([(r["doc_id"], r["text"]) for r in good])}
    takes = Counter()
    for r in mixing.drawn(spark.createDataFrame(single, docs.schema)).collect():
        takes[r["id"]] = len(r["draws"])
    assert Counter(r["doc_id"] for r in mixed) == Counter({k: v for k, v in takes.items() if v})
    vocabulary = piece_lattice.Vocabulary(piece_lattice_file())
    texts = {r["doc_id"]: r["text"] for r in single}
    assert Counter(r["doc_id"] for r in encoded) == Counter(r["doc_id"] for r in mixed)
    assert all(r["ids"] == [i for w in vocabulary.words(texts[r["doc_id"]]) for i in vocabulary.best(w)[0]] for r in encoded)


def piece_lattice_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_run_gives_the_same_rows_again(spark):
    first, second = (sorted((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == second and first


def test_rows_go_to_python_in_small_batches(spark, monkeypatch):
    """Few rows, but long ones: a batch is closed by its bytes."""
    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    seen = lambda docs, *a, **k: docs.mapInArrow(sizes, "n long")
    monkeypatch.setattr(piece_lattice, "encoded", seen)
    monkeypatch.setattr(ngram_join, "deduplicated", seen)
    docs = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("word "), 100_000).alias("text"))  # 30 MB
    for stage in (corpus_pipeline.encode_pieces, corpus_pipeline.drop_near_duplicates):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        found = [r["n"] for r in stage(spark, docs, SF).collect()]
        assert len(found) >= 5 and max(found) <= 8 << 20 and sum(found) >= 30_000_000
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
