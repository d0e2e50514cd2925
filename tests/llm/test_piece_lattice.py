import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from pitchline.llm import piece_lattice
from pitchline.llm.queries import QUERIES
from tests.llm import fixtures

FILE = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    """The library's own N-best search over the same pieces and scores."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(FILE, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    return SentencePieceProcessor(model_proto=model.SerializeToString())


@pytest.fixture(scope="module")
def vocabulary():
    return piece_lattice.Vocabulary(FILE)


def score(vocabulary, ids):
    scores = {i: s for v in vocabulary.pieces.values() if v for s, i in [v]}
    return [scores.get(i) for i in ids]


@pytest.mark.parametrize("text", ["Hello world", "the cat sat on it", "aaaaaaa", "therein lies a reason", "Schadenfreude über alles"])
def test_same_scores_as_the_library(vocabulary, library, text):
    mine = vocabulary.search(vocabulary.words(text), 6)
    theirs = library.nbest_encode_as_ids(text, 6)
    assert [s for s, _ in mine] == [sum(score(vocabulary, ids)) for ids in theirs]
    assert [i for w in mine[0][1] for i in w] == theirs[0]


@pytest.mark.parametrize("text", ["a  b   c", "x\ny z ", "日本語 テスト", "  lead", "odd\x00 ▁ mark", "on\n\n  the"])
def test_chain_of_words_is_the_whole_lattice(vocabulary, text):
    parts = vocabulary.words(text)
    assert "".join(parts) == piece_lattice.MARK + text.replace(" ", piece_lattice.MARK)
    chain, whole = vocabulary.search(parts, 8), vocabulary.search(["".join(parts)], 8)
    assert [s for s, _ in chain] == [s for s, _ in whole]
    assert len({tuple(i for w in ids for i in w) for _, ids in chain}) == len(chain)


def test_awkward_rows(spark, vocabulary):
    docs = fixtures.documents(spark)
    rows = piece_lattice.encoded(docs, FILE)
    assert set(docs.columns) <= set(rows.columns)
    got = piece_lattice.decoded(rows, FILE).collect()
    assert len(got) == len(fixtures.rows())
    for r in got:
        text = r["text"] or ""
        assert r["n_pieces"] == len(r["ids"])
        assert r["decodes_back"] == ("▁" not in text)
        assert "▁" in text or r["decoded"] == text
        if len(text) < 2000:
            ways = vocabulary.search(vocabulary.words(text), 4) if text else []
            assert r["best_scores"] == [s for s, _ in ways]
            assert r["best_sizes"][:1] == [sum(map(len, ids)) for _, ids in ways[:1]]


def test_empty_table(spark):
    assert piece_lattice.encoded(fixtures.empty(spark), FILE).count() == 0


def test_query_takes_the_best_way(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_nbest_pieces"](spark, sf).collect()
    assert len(rows) == len(texts)
    vocabulary = piece_lattice.Vocabulary(FILE)
    for r in rows:
        assert r["decodes_back"]
        words = vocabulary.words(texts[r["doc_id"]])
        assert r["best_scores"][0] == pytest.approx(sum(vocabulary.best(w)[1] for w in words))
        assert r["best_scores"] == sorted(r["best_scores"], reverse=True)
    assert len(library.encode(texts[0])) == len(rows[[r["doc_id"] for r in rows].index(0)]["ids"])


WORDS = ["▁the", "▁Schadenfreude", "\n", "▁", "▁▁▁", "x" * 3000, "▁日本語テスト", "▁odd\x00", "aaaaaaa", "▁über,", "✓", "▁" + "therein" * 9]


def test_words_side_by_side_are_as_each_alone(vocabulary):
    import random

    r = random.Random(3)
    made = WORDS + ["▁" + "".join(r.choice("abcdetionsüßñ日ε✓#1.▁") for _ in range(r.randint(0, 40))) for _ in range(500)]
    words = piece_lattice.Words(vocabulary, piece_lattice.Search())
    for part in (made[:200], made[150:]):  # some of the second part are known
        numbers = [words[w] for w in part]
        scores, gaps = words.settle()
        got = [(words.flat[words.starts[k]:words.starts[k + 1]].tolist(), scores[k], gaps[k]) for k in numbers]
        assert got == [vocabulary.best(w) for w in part]


def test_common_words_are_not_passed_through_one_by_one(vocabulary, monkeypatch):
    monkeypatch.setattr(piece_lattice.Vocabulary, "best", None)
    words = piece_lattice.Words(vocabulary, piece_lattice.Search())
    numbers = [words[w] for w in vocabulary.words("Hello world, it is a café in Zürich.")]
    assert len(words.settle()[0]) == len(set(numbers))
