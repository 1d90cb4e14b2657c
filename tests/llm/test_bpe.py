import random

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxmill.llm.bpe import LEAF_CHARS, TreeBpe, decode_documents, encode_documents, round_trip_digests

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tiny():
    """Leaves of a few characters, so that every text has many seams."""
    return TreeBpe(RANKS, P.PATTERN, leaf_chars=5, leaf_bytes=7)


_TINY = []


def _tiny():
    if not _TINY:
        _TINY.append(TreeBpe(RANKS, P.PATTERN, leaf_chars=5, leaf_bytes=7))
    return _TINY[0]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcdefgst ve're'll\n\t\r  1234  !?.é日本  \x1c\x85")), st.characters(codec="utf-8")), max_size=120))
def test_tree_equals_library(text):
    c = _tiny()
    want = c._bpe.encode_ordinary(text)
    assert c.encode(text) == want
    assert c.decode(want) == text.encode()


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, " " * 3001, "\n " * 900, "thequick" * 700, "x" * 999 + " y" + "'ll" * 400, "漢字" * 900, "!?" * 2000, "0123456789" * 300, "\U0001f600" * 500])
def test_extreme_texts(tiny, text):
    assert tiny.encode(text) == tiny._bpe.encode_ordinary(text)
    assert TreeBpe(RANKS, P.PATTERN, leaf_chars=64, leaf_bytes=32).encode(text) == tiny._bpe.encode_ordinary(text)


def test_random_words(tiny):
    rnd = random.Random(5)
    for _ in range(60):
        text = "".join(rnd.choice([" ", "  ", "\n", "ing", "tion", "the", "'s", "don't", "99", "...", "Straße", "\t"]) for _ in range(rnd.randrange(400)))
        assert tiny.encode(text) == tiny._bpe.encode_ordinary(text)


def test_documents(spark):
    rows = [(1, "Hello there, it's 2024.", "x"), (2, None, "y"), (3, "", None), (1, "Hello there, it's 2024.", "x"), (None, "word " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = encode_documents(docs, RANKS, P.PATTERN)
    back = decode_documents(coded, RANKS, P.PATTERN)
    got = sorted(((r.doc_id, bytes(r.bytes).decode()) for r in back.collect()), key=str)
    assert got == sorted(((i, t or "") for i, t, _ in rows), key=str)
    assert len(round_trip_digests(docs, RANKS, P.PATTERN).collect()) == 5
    assert round_trip_digests(docs.limit(0), RANKS, P.PATTERN).collect() == []


def test_query_digests_equal_the_library(spark):
    """All documents: counts and digests of what the tiktoken library gives for the whole texts."""
    import hashlib

    from voxmill.llm.queries import op4_bpe

    d = "/root/testdata/sf0.01"
    plain = TreeBpe(RANKS, P.PATTERN)._bpe
    want = []
    for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect():
        ids = plain.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(tuple, op4_bpe(spark, d).collect())) == sorted(want)


def test_most_texts_go_through_the_tree(spark):
    """Not only the longest texts are halved and joined."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    assert sum(len(t or "") > LEAF_CHARS for t in texts) > 0.6 * len(texts)
