import hashlib

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quadrille.llm import bpe

PATH, PATTERN = bpe.public_vocabulary()
CODEC = bpe.Codec.load(PATH, PATTERN)
TRUTH = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_random_texts(text):
    assert CODEC.encode(text) == TRUTH.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode(text)) == text.encode()


def test_long_pieces():
    for text in ["a" * 5000, "ab" * 3000, " " * 3000, "thethe" * 1000, "\n" * 500 + "x"]:
        assert CODEC.encode(text) == TRUTH.encode_ordinary(text)


def test_blocks_of_very_long_texts(monkeypatch):
    text = "Some words, 123 and more.\n" * 50
    whole = CODEC.digest(text)
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "islice", lambda it, n: __import__("itertools").islice(it, 7))
    assert CODEC.digest(text) == whole


def test_query(spark, sf_dir):
    got = {r.doc_id: tuple(r) for r in bpe.op9_byte_bpe(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = TRUTH.encode_ordinary(d.text or "")
        assert got[d.doc_id] == (d.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (None, "a b", None), (3, "a b", 7), (3, "a b", 7)], "doc_id long, text string, token_ids int")
    rows = bpe.token_digests(docs, PATH, PATTERN).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2, 2]
    assert bpe.token_digests(docs.limit(0), PATH, PATTERN).count() == 0
    coded = bpe.encode_documents(docs, PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "token_ids"]
    back = bpe.decode_documents(coded, PATH, PATTERN).collect()
    assert sorted(r.decoded for r in back) == ["", "", "a b", "a b", "a b"]
