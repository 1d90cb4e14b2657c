import heapq
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from voxmill.llm.huffman import Code, code_lengths
from voxmill.llm.token_files import ChunkCoder, token_round_trip

PATH = P.path("word_bpe_49k.json")
_T = Tokenizer.from_file(PATH)
_C = ChunkCoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([*"abcdstß ÀÉøœŒ'revmll\n\t\r 019!?.—“<|endoftext>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]), st.characters(codec="utf-8")), max_size=80))
def test_pieces_equal_whole_text(parts):
    text = "".join(parts)
    want = _T.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(_C.encode([text], b"")[0], _C.kind).tolist() == want


@pytest.mark.parametrize("text", [None, "", "   ", "A" * 9000, "don't DON'T it's", "<|endoftext|> x", "say <|endoftext|> now", "a<|startoftext|>b", "é<|endoftext|>\u0301", "<|endoftext|", "é é ́x", "İstanbul ΣΑΣ", "a\x1cb\x85c d", "1,234 º ª µ × ÷"])
def test_cases(text):
    assert np.frombuffer(_C.encode([text], b"")[0], _C.kind).tolist() == _T.encode(text or "", add_special_tokens=False).ids


def test_another_tokenizer_gets_whole_texts():
    """A file whose normalizer and pattern are not those that fall into pieces is encoded by the library alone."""
    path = P.path("byte_bpe_50k.json")
    coder, plain = ChunkCoder(path), Tokenizer.from_file(path)
    for text in ("two  spaces and\nlines", "don't <|endoftext|> stop", ""):
        assert np.frombuffer(coder.encode([text], b"")[0], coder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 3, 40, 3000])
def test_huffman(n):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(0.7, n) * 10).astype(int) + 1
    lengths = code_lengths(counts, 24)
    heap, total = counts.tolist(), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        pair = heapq.heappop(heap) + heapq.heappop(heap)
        total += pair
        heapq.heappush(heap, pair)
    if n > 1:
        assert (lengths * counts).sum() == total
    short = code_lengths(counts, max(1, int(np.ceil(np.log2(n)))))
    assert sum(2.0 ** -int(x) for x in short if x) <= 1
    for k in (0, 1, 63, 64, 65, 5000):
        ids = rng.choice(n, k)
        code = Code(lengths)
        assert code.unpack(*code.pack(ids), k).tolist() == ids.tolist()


def test_round_trip(spark):
    rows = [(3, "Hello there", 1), (1, None, 2), (2, "", 3), (3, "Hello there", 4), (None, "null id", 5), (9, "word " * 70000, 6), (-5, "It's 42.", 7)]
    got = token_round_trip(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH).collect()
    want, start = [], 0
    for i, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*_T.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
