"""SimHash near-duplicates by meeting in the middle: fingerprints within 2r bits share a variant within r bits of both.

Documents are reduced to distinct fingerprints first, so copies cost nothing. Every fingerprint emits itself and all variants within half of
the radius; variants are shuffled, and fingerprints that meet at one are within the radius of each other, so sorted
neighbours are linked (verified by bit count) instead of all pairs. A variant is met by at most 65 distinct fingerprints for radius 2.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import flagged, hidden, join_unique, slices, written
from .components import components

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})
_SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of the shingles of size words (repeats count each time): a bit is 1 if set in over half of the XXH64 values."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) < size:
        return h64(" ".join(words).encode(), _SEED)
    joined = " ".join(words).encode()
    ends = np.fromiter((len(w.encode()) if not w.isascii() else len(w) for w in words), np.int64, len(words)).cumsum() + np.arange(len(words))
    starts = [0, *(ends[:-1] + 1).tolist()]
    hashes = np.fromiter((h64(joined[a:b], _SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=False)), np.uint64, len(words) - size + 1)
    over = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the column out (long, the bits of the fingerprint) in place of text. No shuffle."""
    others = [c for c in docs.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x) for x in batch.column(text).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(found, pa.int64())], [*others, out])

    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema if x.name in others), f"`{out}` long"])
    return docs.select(*others, text).mapInArrow(run, schema)


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) within an even radius; enough of them to connect all that are linked."""
    if radius % 2:
        raise ValueError("the radius must be even")
    bit = lambda i: (1 << i) - (1 << 64 if i == 63 else 0)
    masks = [0, *(sum(map(bit, c)) for k in range(1, radius // 2 + 1) for c in combinations(range(64), k))]
    variants = prints.select("fp", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    met = variants.withColumn("before", F.lag("fp").over(W.partitionBy("variant").orderBy("fp")))
    return met.filter(F.col("before").isNotNull() & (F.bit_count(F.col("fp").bitwiseXOR(F.col("before"))) <= radius)).select(F.col("before").alias("a"), F.col("fp").alias("b")).distinct()


def near_copies(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text).

    component_id: the smallest doc_id that links reach. Other columns are ignored, and no rows give none. A null or wordless text has fingerprint zero, linked like any other. Repeated rows keep their
    number; null doc_ids join their component but never name it, unless all of its ids are null.
    """
    marked = written(fingerprints(docs.select("doc_id", "text")), "prints")
    prints = written(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(ball_links(prints.select("fp"), radius))
    named = prints.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.filter(F.col("root") != F.col("fp")).select("root").distinct().join(named, "root").groupBy("root").agg(F.min("first").alias("least"))
    table = written(named.join(least, "root", "left").select(F.col("fp").alias("fingerprint"), F.coalesce("least", "first").alias("component_id")), "classes")
    return join_unique(marked, table, ["fingerprint"], "inner").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 2) -> DataFrame:
    """The rows of docs that are their component's first by doc_id, with all columns.

    A null or wordless text has fingerprint zero, so of all such rows one stays. Columns keep their names, whatever they are; no rows give none.
    What goes is found on fingerprints; only rows that a bitmap of their text hashes picks are shuffled to be taken out. Rows that
    share the first doc_id are told apart by their text's hash and size, and of exact repeats one stays; a null doc_id comes last.
    """
    key, size, fp, gone, flag = hidden(docs, "key", "size", "fp", "gone", "flag")
    told = {key: F.xxhash64("text"), size: F.octet_length(F.coalesce("text", F.lit("")))}
    marked = written(fingerprints(docs.select("doc_id", *(c.alias(k) for k, c in told.items()), "text"), out=fp), "prints")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", key, size)
    rows = marked.groupBy(F.col(fp).alias("fp"), "doc_id", key, size).agg(F.count("*").alias("n"))
    prints = written(rows.groupBy("fp").agg(F.min(order).alias("first")), "distinct")
    roots = components(ball_links(prints.select("fp"), radius))
    named = prints.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = named.groupBy("root").agg(F.min("first").alias("least"))
    least = written(named.join(firsts, "root").select("fp", "least"), "firsts")
    special = join_unique(written(rows, "rows"), least, ["fp"], "inner").withColumn("lost", ~order.eqNullSafe(F.col("least"))).filter("lost or n > 1")
    special = written(special.select(F.col("doc_id").alias(fp), F.col(key).alias(key + "r"), F.col(size).alias(size + "r"), F.col("lost").alias(gone)), "lost")

    split = flagged(docs.withColumns(told), key, special, key + "r", flag)
    some, rest = split.filter(flag).drop(flag), split.filter(~F.col(flag)).select(*docs.columns)
    same = some["doc_id"].eqNullSafe(special[fp]) & (some[key] == special[key + "r"]) & (some[size] == special[size + "r"])
    kept = some.join(special, same, "left").filter(~F.coalesce(gone, F.lit(False)))
    again = kept.filter(F.col(gone).isNotNull())  # exact repeats of a first row
    one = W.partitionBy("doc_id", key, size).orderBy(F.lit(0))
    again = again.withColumn(flag, F.row_number().over(one)).filter(F.col(flag) == 1)
    return rest.unionByName(kept.filter(F.col(gone).isNull()).select(*docs.columns)).unionByName(again.select(*docs.columns))
