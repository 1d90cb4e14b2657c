"""WARC archives, index first: writing leaves one index row per record, and reading coalesces sorted byte ranges of the records asked for.

Archives (.warc.gz, one gzip member per record) lie in the shared folder under unique names, so a task that is tried again
never meets what a lost attempt left; only the index says which files count. The store may be local, S3, GCS or HDFS (pyarrow.fs).
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, join_unique, open_store, work_path, written

#: Payloads below so many bytes are always stored.
SMALLEST = 100
#: Bytes after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes of a range that is dealt to one reader at a time, and the gap up to which two reads become one.
RANGE_BYTES, GAP_BYTES = 8 << 20, 64 << 10
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"


def mark_revisits(pages: DataFrame) -> DataFrame:
    """pages as page_id, url, payload (binary; null for revisits), bytes, digest (hex SHA-256) and response_id: the smallest page_id among equal payloads of
    SMALLEST bytes or more that are more than one.

    Only digests and ids are aggregated, with map-side minima. Rows whose digest a bitmap of the repeated digests doesn't hold stay where they are; of the others,
    those that revisit another travel without their payload, and only a response that is revisited travels with it. A null html is the empty payload; rows that
    repeat the smallest page_id are all stored; a null page_id revisits the smallest id, or is stored if all ids are null.
    """
    p = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    p = p.withColumns({"dh": F.xxhash64("digest"), "ph": F.xxhash64("digest", "page_id")})
    repeats = p.filter(F.col("bytes") >= SMALLEST).groupBy("digest").agg(F.min("page_id").alias("response_id"), F.count("*").alias("n")).filter("n > 1 and response_id is not null")
    repeats = written(repeats.select("digest", "response_id", F.xxhash64("digest").alias("dh")), "repeats")
    maybe = flagged(p, "dh", repeats, "dh", "repeated")
    once = maybe.filter("not repeated").withColumn("response_id", F.lit(None).cast(dict(p.dtypes)["page_id"]))
    light = written(maybe.filter("repeated").select("page_id", "url", "bytes", "digest", "ph"), "digests")
    light = written(join_unique(light, repeats.drop("dh"), ["digest"], "left"), "told")
    again = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    stored = written(light.filter(~again).select(F.col("page_id").alias("id"), F.col("digest").alias("sha"), "response_id", "ph").distinct(), "stored")
    whole = flagged(maybe.filter("repeated").drop("repeated"), "ph", stored, "ph", "kept").filter("kept")
    whole = whole.join(stored.drop("ph"), (F.col("digest") == F.col("sha")) & F.col("page_id").eqNullSafe(F.col("id")))
    names = ["page_id", "url", "payload", "bytes", "digest", "response_id"]
    revisits = light.filter(again).withColumn("payload", F.lit(None).cast("binary"))
    return once.select(*names).unionByName(whole.select(*names)).unionByName(revisits.select(*names))


def _record(page_id, url, payload: bytes | None, size: int, digest: str, response_id) -> tuple[str, bytes]:
    """(record type, the record's bytes before compression)."""
    revisit = response_id is not None and page_id != response_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    name = lambda x: f"<urn:voxmill:page:{'' if x is None else x}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(response_id)}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "revisit" if revisit else "response", "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(marked: DataFrame, folder: str) -> DataFrame:
    """Write what mark_revisits() returned into archives below folder; returns the index (INDEX), itself written to the shared folder."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, size, digest, response_id in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "bytes", "digest", "response_id")), strict=True):
                kind, raw = _record(page_id, url, payload, size, digest, response_id)
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip.compress(raw, 6, mtime=0)
                out.write(member)
                rows.append((name, at, len(member), url, digest, page_id, kind))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())], ["file", "offset", "length", "url", "digest", "page_id", "record_type"])
        if out is not None:
            out.close()

    return written(marked.select("page_id", "url", "payload", "bytes", "digest", "response_id").mapInArrow(write, INDEX), "warc-index")


def _parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    number = lambda x: int(x.rpartition(":")[2].rstrip(">")) if x and not x.endswith(":>") else None
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"][7:] or len(payload) != size):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return number(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, fields["WARC-Payload-Digest"][7:], size, number(fields.get("WARC-Refers-To")), payload if kind == "response" else None


def read_records(selected: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of index rows (file, offset, length): page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload.

    Rows are dealt by ranges of RANGE_BYTES of a file and sorted by offset; neighbours at most GAP_BYTES apart are read at once. Stored payloads are
    checked against their digests. payloads=False leaves the payload null.
    """
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary())
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        opened = [None, None]

        def read(file: str, spans: list[tuple[int, int]]) -> pa.RecordBatch:
            if opened[0] != file:
                opened[:] = [file, store.open_input_file(f"{path}/{file}")]
            first = spans[0][0]
            opened[1].seek(first)
            data = memoryview(opened[1].read(spans[-1][0] + spans[-1][1] - first))
            rows = [_parse(zlib.decompress(data[o - first : o - first + n], 31)) for o, n in spans]
            cols = [list(c) for c in zip(*rows, strict=True)]
            if not payloads:
                cols[-1] = [None] * len(rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

        file, spans = None, []
        for batch in batches:
            for f, o, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if spans and (f != file or o > sum(spans[-1]) + GAP_BYTES or o + n - spans[0][0] > RANGE_BYTES):
                    yield read(file, spans)
                    spans = []
                file = f
                spans.append((o, n))
        if spans:
            yield read(file, spans)

    dealt = selected.select("file", "offset", "length", F.floor(F.col("offset") / RANGE_BYTES).alias("part"))
    return dealt.repartition("file", "part").sortWithinPartitions("file", "offset").mapInArrow(fetch, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages (page_id, url, html; others are ignored), then read every record back through the index: page_id, payload_bytes, payload_digest,
    record_type, refers_to, one row a page. Null and repeated ids, null, empty and very long payloads are as in mark_revisits(); no pages give no rows."""
    folder = work_path(pages.sparkSession, "warc")
    index = write_archives(mark_revisits(pages), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
