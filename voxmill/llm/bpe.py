"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved down to leaves, leaves are encoded, and neighbours are joined by encoding anew a window around the seam,
grown until what lies outside is proven stable. Two levels share that scheme:

- Text. A place where white space follows a non-space character ends a match of the pattern whatever stands around it, since no
  alternative goes from a non-space to a white-space character and none looks back. So a window that reaches from such a place on the left
  to one on the right is encoded just as in the whole text, and the tokens outside keep.
- Bytes of one match too long for a leaf. A sequence of tokens is the encoding of its bytes if and only if each pair of neighbours is the encoding of
  the pair's bytes. Both sides and the window are encodings, so only the two pairs at the window's edges are left to test;
  a pair that fails grows the window.

Decoding concatenates the bytes of tokens up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import slices

#: Characters of a leaf, bytes of a leaf inside one match, and the first window of either kind.
LEAF_CHARS, LEAF_BYTES, WINDOW_CHARS, WINDOW_TOKENS = 512, 1024, 16, 8
#: What every engine takes for a non-space and a white-space character.
_EDGE = r"(?<=[^\s\p{White_Space}\x1c-\x1f])(?=[ \t\n\r])"
_LEFT, _RIGHT = regex.compile("(?r)" + _EDGE), regex.compile(_EDGE)


class TreeBpe:
    """Encoder and decoder for the ranks of one file and a pattern that never matches across a non-space/white-space edge."""

    def __init__(self, ranks_path: str, pattern: str, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.table = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.table[rank] = piece
        self.size = [len(x) for x in self.table]
        self._bpe = tiktoken.Encoding("tree", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the library's \\s is the White_Space property; regex has some more in \\s
        self._pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes

    def encode(self, text: str) -> list[int]:
        return self._text(text, 0, len(text))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= 4096:
            return b"".join(map(self.table.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])

    def _text(self, text: str, a: int, b: int) -> list[int]:
        if b - a <= self.leaf_chars:
            return self._leaf(text[a:b])
        mid = (a + b) // 2
        return self._join(text, a, mid, b, self._text(text, a, mid), self._text(text, mid, b))

    def _leaf(self, part: str) -> list[int]:
        """Encode a part of at most a leaf's size; a match longer than the leaf of bytes goes through the tree of bytes."""
        if len(part) <= self.leaf_bytes // 4 or not self._has_long(part):
            return self._bpe.encode_ordinary(part)
        return [i for m in self._pattern.finditer(part) for i in self._bytes(m[0].encode())]

    def _has_long(self, part: str) -> bool:
        """Whether some run without an edge may hold a match of over leaf_bytes bytes (4 bytes a character at most)."""
        most = self.leaf_bytes // 4
        at = 0
        while len(part) - at > most:
            if not (found := _LEFT.search(part, at + 1, at + most + 1)):
                return True
            at = found.start()
        return False

    def _join(self, text: str, a: int, mid: int, b: int, left: list[int], right: list[int]) -> list[int]:
        grow = WINDOW_CHARS
        while True:
            lo, hi = max(a, mid - grow), min(b, mid + grow)
            # an edge needs the characters on both sides, so it is sought strictly inside either half
            p = next((m.start() for m in [_LEFT.search(text, max(a, lo - 1), mid)] if m and m.start() > a), None)
            q = next((m.start() for m in [_RIGHT.search(text, mid, min(b, hi + 1))] if m and mid < m.start() < b), None)
            if p is None and lo == a:
                p = a
            if q is None and hi == b:
                q = b
            if p is not None and q is not None:
                return self._spliced(text, a, p, mid, q, b, left, right)
            grow *= 2

    def _spliced(self, text: str, a: int, p: int, mid: int, q: int, b: int, left: list[int], right: list[int]) -> list[int]:
        n, drop, skip = len(text[p:mid].encode()), 0, 0
        while n > 0:
            drop += 1
            n -= self.size[left[-drop]]
        n = len(text[mid:q].encode())
        while n > 0:
            n -= self.size[right[skip]]
            skip += 1
        return left[: len(left) - drop] + self._leaf(text[p:q]) + right[skip:]

    def _bytes(self, piece: bytes) -> list[int]:
        """The encoding of one match of the pattern."""
        if len(piece) <= self.leaf_bytes:
            return self._bpe._encode_single_piece(piece)
        mid = len(piece) // 2
        return self._join_bytes(self._bytes(piece[:mid]), self._bytes(piece[mid:]))

    def _keeps(self, x: int, y: int) -> bool:
        return self._bpe._encode_single_piece(self.table[x] + self.table[y]) == [x, y]

    def _join_bytes(self, left: list[int], right: list[int]) -> list[int]:
        take = WINDOW_TOKENS
        while True:
            i, j = max(0, len(left) - take), min(len(right), take)
            window = self._bpe._encode_single_piece(b"".join(self.table[t] for t in left[i:] + right[:j]))
            if (i == 0 or self._keeps(left[i - 1], window[0])) and (j == len(right) or self._keeps(window[-1], right[j])):
                return left[:i] + window + right[j:]
            take *= 2


@lru_cache(maxsize=4)
def coder(ranks_path: str, pattern: str) -> TreeBpe:
    """One coder for each file and worker."""
    return TreeBpe(ranks_path, pattern)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with the column ids (array of int) in place of text; a null text is empty. Row by row: no shuffle, repeated rows stay."""
    return _mapped(docs, text, "ids array<int>", pa.list_(pa.int32()), lambda c, x: c.encode(x or ""), ranks_path, pattern)


def decode_documents(docs: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """docs with the column bytes (binary) in place of ids; null ids give none."""
    return _mapped(docs, ids, "bytes binary", pa.binary(), lambda c, x: c.decode(list(x or ())), ranks_path, pattern)


def _mapped(docs: DataFrame, column: str, new: str, kind: pa.DataType, f, ranks_path: str, pattern: str) -> DataFrame:
    name = new.split()[0]
    others = [c for c in docs.columns if c not in (column, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for batch in slices(batches):
            values = pa.array([f(c, x) for x in batch.column(column).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in others), values], [*others, name])

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema if x.name in others), new])
    return docs.select(*others, column).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs (doc_id, text): encoding, decoding and digests in one pass, so that ids need not travel.

    A null or empty text has no tokens. Texts of any length are encoded whole; repeated rows and null ids stay rows of their own; other columns are ignored, whatever
    they are called; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        said = [str(i) for i in range(len(c.table))]
        for batch in slices(batches):
            n, ids_sha, out_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = c.encode(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(said.__getitem__, ids)).encode()).hexdigest())
                out_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(out_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
