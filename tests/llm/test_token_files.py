import uuid
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pitchline.llm import token_files
from pitchline.llm.queries import QUERIES
from pitchline.session import checkpoint_dir
from tests.llm import fixtures

FILE = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(0, 50)), max_size=1600), st.floats(0.5, 1.0))
def test_blocks_give_their_values_back(values, percentile):
    values = np.array(values, np.uint32)
    assert (token_files.unpack(token_files.pack(values, percentile)) == values).all()


def test_outliers_are_exceptions_and_do_not_widen_blocks():
    values = np.full(token_files.BLOCK, 7, np.uint32)
    values[5] = 2**31
    assert len(token_files.pack(values)) < 100


def expected(data):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(FILE)
    out, start = [], 0
    for i, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def files(spark, docs, form=token_files.Format()):
    path = f"{checkpoint_dir(spark)}/t-{uuid.uuid4().hex}"
    token_files.write(docs, path, FILE, form=form)
    return path


@pytest.mark.parametrize("form", [token_files.Format(), token_files.Format(segment=100, cached=5)])
def test_awkward_rows(spark, form):
    path = files(spark, fixtures.documents(spark), form)
    got = [tuple(r) for r in token_files.digests(spark, path).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected([r[:2] for r in fixtures.rows()])
    ids = {r["start"]: r["ids"] for r in token_files.read(spark, path).collect()}
    assert all(zlib.crc32(np.array(ids[s], "<u4").tobytes()) == c for _, s, _, c in got)


def test_special_tokens_in_capitals_are_plain_text(spark):
    texts = ["<|ENDOFTEXT|>", "Some <|EndOfText|>, More\n<|endoftext|> End", "A<|StartOfText|>B", "<|startoftext|>Word."]
    data = [(i, t, "en", "s1", 0, *["x"] * 7) for i, t in enumerate(texts)]
    got = [tuple(r) for r in token_files.digests(spark, files(spark, fixtures.documents(spark, data))).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected([r[:2] for r in data])


def test_empty_table(spark):
    assert token_files.digests(spark, files(spark, fixtures.empty(spark))).count() == 0


def test_query_matches_the_tokenizer_document_by_document(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r)[:4] for r in QUERIES["op1_pfor_token_files"](spark, sf).collect())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == expected([tuple(r) for r in docs])


class Counting:
    """A tokenizer that counts the texts it is given."""

    def __init__(self):
        from tokenizers import Tokenizer

        self.inner, self.texts = Tokenizer.from_file(FILE), 0

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def encode_batch_fast(self, texts, **how):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **how)


def test_new_words_go_to_the_tokenizer_together():
    tokenizer = Counting()
    texts = [" ".join(f"{a}{b}{c}" + ("$$$" if c == "é" else "") for a in "abxyé" for b in "nmop" for c in "stué") + " İx it's 12 日本 ,"]
    pieces = token_files.Pieces(tokenizer)
    ids, counts = pieces.encode(texts)
    assert ids.tolist() == tokenizer.inner.encode(texts[0], add_special_tokens=False).ids and counts.tolist() == [len(ids)]
    many = token_files.Pieces(tokenizer)
    tokenizer.texts = 0
    plain = " ".join(f"{a}{b}{c}{d}" for a in "abxy" for b in "nmop" for c in "stué" for d in "aeio")
    assert many.encode([plain])[0].tolist() == tokenizer.inner.encode(plain, add_special_tokens=False).ids
    assert tokenizer.texts == 1


def test_a_trimmed_table_keeps_the_early_pieces():
    tokenizer = Counting()
    pieces = token_files.Pieces(tokenizer)
    first = pieces.encode(["the, cat it's on ünder mats"])[0]
    pieces.encode([" ".join(f"word{k}" for k in range(50))])
    small = pieces.trimmed(20)
    assert len(small) == 10
    tokenizer.texts = 0
    assert small.encode(["the, cat it's on ünder mats"])[0].tolist() == first.tolist() and tokenizer.texts == 0
    assert pieces.trimmed(1000) is pieces


def test_marks_are_parted_from_words():
    tokenizer = Counting()
    pieces = token_files.Pieces(tokenizer)
    marked = "haus&&& haus.*** haus,### haus! Haus? größe&&& größe.*** größe 12&&& 12.***"
    assert pieces.encode([marked])[0].tolist() == tokenizer.inner.encode(marked, add_special_tokens=False).ids
    assert {"haus", "größe", "12", "&&&", ".***"} <= set(pieces) and not any(p[:1].isalnum() and not p.isalnum() for p in pieces)
    odd = ["İ, x İ. a.b,c 1,2.3 it's, we'll. <|endoftext|>, A̧, e,̈x ≠ a≠ ÷, x÷. ², ½. Ⅷ, ŉ! ªº. ñ@ß#",
           None, "", " ", "a,", ",a", "\n.\n", "ö, Ö. ÿ, Ÿ. ĳ, Σ, ς.", "日本, 日. ✓, ,"]
    ids, counts = pieces.encode(odd)
    wanted = [tokenizer.inner.encode(t or "", add_special_tokens=False).ids for t in odd]
    assert counts.tolist() == [len(w) for w in wanted] and ids.tolist() == [i for w in wanted for i in w]


def test_a_trimmed_table_keeps_the_pieces_used_most():
    pieces = token_files.Pieces(Counting())
    pieces.encode([" ".join(f"early{k}" for k in range(30))])
    late = pieces.encode(["later words later words"])[0]
    small = pieces.trimmed(20)
    assert len(small) == 10 and {"later", "words"} <= set(small)
    tokens = small.tokenizer.texts
    assert small.encode(["later words later words"])[0].tolist() == late.tolist() and small.tokenizer.texts == tokens
    assert all(small.encode([p])[0].tolist() == small.tokenizer.inner.encode(p, add_special_tokens=False).ids for p in small)
