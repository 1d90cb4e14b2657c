"""Length buckets of least padding and token-budget batches.

Texts are tokenised and cut into windows of at most max_len tokens, so the global histogram of lengths has at most max_len rows whatever the
corpus. A dynamic programme over it picks the bucket bounds that minimise padding. Inside a bucket, batches of as many windows as fit the token budget
are formed within hashed groups of bounded size, each group leaving at most one batch part-filled, so no bucket goes through one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .bpe import coder
from .common import slices, written

#: Batches that a group of a bucket holds at least (and rows, for buckets of long windows).
GROUP_BATCHES, GROUP_ROWS = 16, 4096


def best_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending upper bounds of at most buckets buckets that minimise the sum of count * (bound - length); lengths ascend."""
    n = len(lengths)
    if not n:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(counts * lengths)]).astype(np.int64)
    best = lengths * c[1:] - s[1:]  # one bucket for the first j + 1 lengths
    cuts = []
    for _ in range(min(buckets, n) - 1):
        new, cut = best.copy(), np.full(n, -1)
        for j in range(1, n):
            total = best[:j] + lengths[j] * (c[j + 1] - c[1 : j + 1]) - (s[j + 1] - s[1 : j + 1])
            i = int(total.argmin())
            if total[i] < new[j]:
                new[j], cut[j] = total[i], i
        cuts.append(cut)
        best = new
    bounds, j = [], n - 1
    for cut in reversed(cuts):
        if cut[j] >= 0:
            bounds.append(int(lengths[j]))
            j = int(cut[j])
    return [*([int(lengths[j])]), *reversed(bounds)]


def token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, salt, n) of every row of docs (doc_id, text): the number of byte-level BPE tokens, and a number that deals rows out, repeated ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(ranks_path, pattern)
        for batch in slices(batches):
            n = [len(c.encode(text or "")) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("salt"), pa.array(n, pa.int64())], ["doc_id", "salt", "n"])

    salted = docs.select("doc_id", F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("salt"), "text")
    kind = dict(docs.dtypes)["doc_id"]
    return salted.mapInArrow(run, f"doc_id {kind}, salt long, n long")


def windows(counted: DataFrame, max_len: int) -> DataFrame:
    """(doc_id, salt, part, start, length): the tokens of each text in windows of max_len; a text without tokens has one of length 0."""
    parts = F.sequence(F.lit(0), F.greatest(F.floor((F.col("n") - 1) / max_len), F.lit(0)).cast("int"))
    cut = counted.select("doc_id", "salt", "n", F.explode(parts).alias("part"))
    return cut.select("doc_id", "salt", "part", (F.col("part") * max_len).cast("long").alias("start"), F.least(F.lit(max_len), F.col("n") - F.col("part") * max_len).cast("long").alias("length"))


def pack(docs: DataFrame, ranks_path: str, pattern: str, max_len: int = 2048, buckets: int = 16, budget: int = 32768) -> DataFrame:
    """One row per window of docs (doc_id, text; others are ignored): doc_id, part, start, length (in tokens), bucket_length, batch (string), slot (place in the batch).

    A batch holds budget // bucket_length windows (one at least). Null and empty texts have length 0 and no bucket or batch (null). Very long texts have many
    windows; null ids and repeated rows are packed like any others; windows of equal length share a bucket. No rows give none.
    """
    cut = written(windows(token_counts(docs, ranks_path, pattern), max_len), "windows")
    hist = sorted((r.length, r.n) for r in cut.filter("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect())
    lengths, counts = np.array([x for x, _ in hist], np.int64), np.array([x for _, x in hist], np.int64)
    bounds = best_bounds(lengths, counts, buckets)
    bound, size, groups = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1)
    low = 0
    for b in bounds:
        rows = max(1, budget // b)
        total = int(counts[(lengths > low) & (lengths <= b)].sum())
        inside = (F.col("length") > low) & (F.col("length") <= b)
        bound, size = F.when(inside, F.lit(b)).otherwise(bound), F.when(inside, F.lit(rows)).otherwise(size)
        groups = F.when(inside, F.lit(max(1, total // max(GROUP_ROWS, GROUP_BATCHES * rows)))).otherwise(groups)
        low = b
    dealt = cut.filter("length > 0").withColumns({"bucket_length": bound, "rows": size, "groups": groups}).withColumn("grp", F.pmod(F.xxhash64("salt", "part"), F.col("groups")))
    order = W.partitionBy("bucket_length", "grp").orderBy("salt", "doc_id", "part")
    placed = dealt.withColumn("at", F.row_number().over(order) - 1)
    batch = F.concat_ws("-", F.col("bucket_length").cast("string"), F.col("grp").cast("string"), F.floor(F.col("at") / F.col("rows")).cast("string"))
    out = placed.select("doc_id", "part", "start", "length", "bucket_length", batch.alias("batch"), (F.col("at") % F.col("rows")).cast("long").alias("slot"))
    none = cut.filter("length <= 0").select("doc_id", "part", "start", "length", F.lit(None).cast("long").alias("bucket_length"), F.lit(None).cast("string").alias("batch"), F.lit(None).cast("long").alias("slot"))
    return out.unionByName(none)
