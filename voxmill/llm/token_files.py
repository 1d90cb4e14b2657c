"""Token ids in compressed binary files: canonical length-limited Huffman codes from global counts, blocks with bit-offset checkpoints.

A file: MAGIC, then blocks (u32 ids, u32 lanes, u32 stream bytes; u16 bits of each lane; bit stream), then a footer (zlib of the code lengths,
one byte an id; document ids, with a null mask, and token counts; block offsets) and its size (u32) with MAGIC again. Each block decodes without the others,
and each lane of a block from its own bit offset. Documents lie in ascending doc_id order over the files of a manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import open_store, work_path, written
from .huffman import Code, code_lengths

MAGIC = b"VXHF"
#: Ids of a block, of a file, and pieces a worker remembers.
BLOCK_IDS, FILE_IDS, CACHE_WORDS = 1 << 16, 16 << 20, 1_000_000
_CHUNK = re.compile(r"[^\x20\x09-\x0D]+")


class ChunkCoder:
    """Encodes texts with the tokenizers library in its default settings, piece by piece, remembering the ids of pieces seen before.

    For a tokenizer like word_bpe_49k, whose normalizer composes and lower-cases characters on their own and whose pre-tokenizer splits by a
    pattern that drops white space, a text's ids are the ids of its pieces in a row. Texts of characters that are already composed, and whose class and
    lower case no library disputes, are cut by the pattern; new pieces are encoded together as one text, and fall apart again after each token that ends a word.
    Other texts, and those that hold an added token's string (which the library takes for that token), are cut at ASCII white space only, which no
    normalisation or match crosses, and each chunk is encoded whole. A tokenizer whose file names another normalizer or pattern gets whole texts.
    """

    #: The normalizer and the pattern under which texts fall into pieces.
    _NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    _SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
    _LETTERS = "a-zß-öø-ÿœ"
    _PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿŒœ¡¿«»–—‘’“”…€§°]*")
    _PIECE = re.compile(rf"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[0-9]|[^\s{_LETTERS}0-9]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._t = Tokenizer.from_file(path)
        told = json.loads(self._t.to_str())
        first = ((told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        pieces = (told.get("normalizer") or {}).get("normalizers") == self._NORMAL and first.get("type") == "Split" and first.get("pattern") == {"Regex": self._SPLIT} and first.get("invert")
        added = [x["content"] for x in told["added_tokens"]]
        #: Whether texts fall apart at white space and pieces; what an added token's string looks like.
        self._cut = bool(pieces and told["model"].get("end_of_word_suffix") == "</w>" and not any(x["normalized"] or _CHUNK.fullmatch(x["content"]) is None for x in told["added_tokens"]))
        self._added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.size = self._t.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self._ends = np.zeros(self.size, bool)
        for token, i in self._t.get_vocab().items():
            self._ends[i] = token.endswith("</w>")
        self._known: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self._t.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        (ids,) = self._ids([" ".join(pieces)])
        ends = (np.flatnonzero(self._ends[ids]) + 1) * self.kind.itemsize
        if len(ends) != len(pieces):
            raise ValueError("this tokenizer doesn't end every piece with one end-of-word token")
        raw, at = ids.tobytes(), 0
        for piece, end in zip(pieces, ends.tolist(), strict=True):
            self._known[piece] = raw[at:end]
            at = end

    def encode(self, texts: list[str | None], end: bytes) -> list[bytes]:
        """The ids of each text as bytes of kind, followed by end; a null text is empty."""
        if len(self._known) > CACHE_WORDS:
            self._known = {}
        known, out = self._known, []
        for i in range(0, len(texts), 256):
            parts, holes = [], []
            for text in texts[i : i + 256]:
                if not text:
                    parts.append([])
                elif not self._cut:
                    parts.append([x.tobytes() for x in self._ids([text])])
                elif not self._PLAIN.fullmatch(text) or self._added.search(text):
                    parts.append([x.tobytes() for x in self._ids(_CHUNK.findall(text))])
                else:
                    pieces = self._PIECE.findall(text.lower())
                    ids = list(map(known.get, pieces))
                    parts.append(ids)
                    if None in ids:
                        at = -1
                        for _ in range(ids.count(None)):
                            at = ids.index(None, at + 1)
                            holes.append((ids, at, pieces[at]))
            if holes:
                self._learn(list({piece for _, _, piece in holes}))
                for ids, at, piece in holes:
                    ids[at] = known[piece]
            out += [b"".join(p) + end for p in parts]
        return out


@lru_cache(maxsize=2)
def _coder(path: str) -> ChunkCoder:
    return ChunkCoder(path)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text") -> DataFrame:
    """(doc_id, ids: bytes), written to the shared folder; every text's ids are followed by end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _coder(tokenizer)
        end = np.array([end_id], c.kind).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(c.encode(part.column(text).to_pylist(), end), pa.binary())], ["doc_id", "ids"])

    return written(docs.select("doc_id", text).mapInArrow(run, "doc_id long, ids binary"), "ids")


def id_counts(coded: DataFrame, size: int, width: int) -> np.ndarray:
    """How often each of the size ids occurs in all documents; the driver gets at most one row per id."""
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                if ids.is_valid:
                    flat = np.frombuffer(ids.as_buffer(), kind)
                    # a short text costs its own length, not that of the vocabulary
                    if len(flat) < size // 8:
                        np.add.at(total, flat, 1)
                    else:
                        total += np.bincount(flat, minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def write_files(coded: DataFrame, lengths: np.ndarray, width: int, folder: str, n_files: int) -> DataFrame:
    """Write documents (doc_id, ids) into about n_files files in ascending doc_id order (nulls first, repeated rows by their ids).

    Returns the manifest (shard, file, n_docs, n_ids) as a written table; files of lost attempts are in no manifest.
    """
    kind, table = f"<u{width}", zlib.compress(lengths.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, names, nulls, sizes, offsets, rest, waiting = Code(lengths), [], [], [], [], [], 0
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.vxh"
        out, at = None, len(MAGIC)

        def blocks(ids: np.ndarray, last: bool) -> np.ndarray:
            nonlocal at
            while len(ids) >= BLOCK_IDS or last and len(ids):
                part, ids = ids[:BLOCK_IDS], ids[BLOCK_IDS:]
                stream, lanes = code.pack(part)
                raw = struct.pack("<III", len(part), len(lanes), len(stream)) + lanes.astype("<u2").tobytes() + stream
                offsets.append(at)
                out.write(raw)
                at += len(raw)
            return ids

        for batch in batches:
            if out is None and batch.num_rows:
                out = store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(MAGIC)
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), kind)
                names.append(doc or 0)
                nulls.append(doc is None)
                sizes.append(len(ids))
                rest.append(ids)
                waiting += len(ids)
                if waiting >= 8 * BLOCK_IDS:
                    rest = [blocks(np.concatenate(rest), False).copy()]
                    waiting = len(rest[0])
        if out is not None:
            blocks(np.concatenate(rest), True)
            foot = [table, np.array(names, "<i8").tobytes(), np.packbits(nulls).tobytes(), np.array(sizes, "<i8").tobytes(), np.array(offsets, "<i8").tobytes()]
            raw = struct.pack("<5I", *map(len, foot)) + b"".join(foot)
            out.write(raw + struct.pack("<I", len(raw)) + MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([len(names)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["shard", "file", "n_docs", "n_ids"])

    ordered = coded.repartitionByRange(n_files, F.col("doc_id").asc_nulls_first(), F.xxhash64("ids")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    return written(ordered.mapInArrow(run, "shard long, file string, n_docs long, n_ids long"), "manifest")


def read_file(store, path: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """(doc_id, ids) of each document of a file, in order; one block is held at a time."""
    with store.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 8)
        tail = f.read(8)
        if tail[4:] != MAGIC:
            raise ValueError(f"{path} was not written whole")
        (n,) = struct.unpack("<I", tail[:4])
        f.seek(size - 8 - n)
        foot = f.read(n)
        parts, at = [], 20
        for k in struct.unpack("<5I", foot[:20]):
            parts.append(foot[at : at + k])
            at += k
        code = Code(np.frombuffer(zlib.decompress(parts[0]), np.uint8))
        names, sizes, offsets = (np.frombuffer(parts[i], "<i8") for i in (1, 3, 4))
        nulls = np.unpackbits(np.frombuffer(parts[2], np.uint8))
        have, k = np.zeros(0, np.uint32), 0
        for name, null, size in zip(names.tolist(), nulls.tolist(), sizes.tolist(), strict=False):
            parts = [have]
            got = len(have)
            while got < size:
                f.seek(offsets[k])
                n_ids, n_lanes, n_bytes = struct.unpack("<III", f.read(12))
                raw = f.read(2 * n_lanes + n_bytes)
                parts.append(code.unpack(raw[2 * n_lanes :], np.frombuffer(raw[: 2 * n_lanes], "<u2"), n_ids))
                got += n_ids
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield None if null else name, have[:size]
            have = have[size:]


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, read from the files. The driver sums up one number per file for the starts."""
    rows, start, shards = sorted(manifest.collect(), key=lambda r: r.shard), 0, []
    for r in rows:
        shards.append((r.shard, r.file, start))
        start += r.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            for file, at in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                out: list[tuple] = []
                for doc, ids in read_file(store, f"{path}/{file}"):
                    out.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spark = manifest.sparkSession
    todo = spark.createDataFrame(shards, "shard long, file string, start long")
    return todo.repartitionByRange(max(1, len(shards)), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Tokenise docs (doc_id, text; others are ignored), write their ids to files below the shared folder, and read the files back: doc_id, start, n_tokens, ids_crc32.

    A null or empty text has the end id alone; texts of any length are encoded whole. Rows with one doc_id lie next to each other in the order of their ids' hash, null
    doc_ids first; repeated rows are documents of their own. No rows give none.
    """
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(tokenizer).get_vocab_size()
    width = 2 if size <= 1 << 16 else 4
    coded = tokenised(docs, tokenizer, end_id)
    counts = id_counts(coded, size, width)
    n_files = max(2 * spark.sparkContext.defaultParallelism, -(-int(counts.sum()) // FILE_IDS))
    folder = work_path(spark, "token-files")
    return read_files(write_files(coded, code_lengths(counts), width, folder, n_files), folder)
