"""Helpers that the training-data operators share: the shared folder, written intermediates, byte storage and text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: \x20 and \x09-\x0D.
WHITE = " \t\n\x0b\x0c\r"
#: Least and most bits of a bitmap that picks rows, and bits for each hash in between: at most 32 MB, so it may be broadcast whatever the data; a full one only picks more
#: than it must.
BITMAP_BITS, MOST_BITS, BITS_EACH = 1 << 20, 1 << 28, 16
_WHITE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset, on a local master only (tests), a temporary one of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(found)
        return found.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="voxmill-"))
    return sc.getCheckpointDir().rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/voxmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, which cuts its lineage: what follows survives lost executors without redoing df."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder through Hadoop's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this library has written to the shared folder, once no result that reads it is wanted any more."""
    remove(spark, f"{shared_dir(spark)}/voxmill")


def forget(df: DataFrame) -> None:
    """Delete the files of a DataFrame that written() returned, once nothing reads it any more."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)


def open_store(uri: str):
    """(file system, path) of a URI or path for pyarrow: local, S3, GCS and HDFS stores behave alike. Works on executors."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def words_of(text: Column) -> Column:
    """The words [^\\x20\\x09-\\x0D]+ of a text as an array; null gives an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE_RUN))


def keep_if(df: DataFrame, condition: Column) -> DataFrame:
    """df.filter(condition), with the columns that df computes computed once.

    The optimizer pushes a filter below the projections under it by putting their expressions in the place of their columns, once for every mention; with array
    functions nested over several projections that multiplies their cost. A projection that is not deterministic stops it.
    """
    (mark,) = hidden(df, "mark")
    return df.withColumn(mark, F.monotonically_increasing_id()).filter(condition & (F.col(mark) >= 0)).drop(mark)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces, so that a worker holds Python objects for few rows at a time, however long their texts are."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def hidden(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = f"__{name}"
        while new in taken:
            new = "_" + new
        taken.add(new)
        out.append(new)
    return out


def join_unique(rows: DataFrame, table: DataFrame, on: list[str], how: str, share: int = 1000) -> DataFrame:
    """rows.join(table, on, how) (inner or left) for a table with one row for each key, without a task for each key that many rows have.

    The table's rows for the keys of over 1 / share of all rows (and 1,000 rows) are broadcast, at most share of them; the other keys are joined by shuffle.
    """
    counts = written(rows.groupBy(*on).agg(F.count("*").alias("__n")).filter("__n > 1000"), "counts")
    heavy = counts.filter(F.col("__n") > rows.count() / share).select(*on) if not counts.isEmpty() else counts.limit(0)
    if heavy.isEmpty():
        return rows.join(table, on, how)
    top = table.join(F.broadcast(heavy), on, "left_semi")
    light = rows.join(F.broadcast(heavy), on, "left_anti").join(table, on, how)
    return light.unionByName(rows.join(F.broadcast(heavy), on, "left_semi").join(F.broadcast(top), on, how))


def flagged(rows: DataFrame, by: str, wanted: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with flag: whether the hash `by` may be among the hashes `key` of wanted, by a bitmap sized by their number; false hits are possible, false misses not."""
    part, bits = hidden(rows, "part", "bits")
    size = min(MOST_BITS, max(BITMAP_BITS, 1 << (BITS_EACH * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.col(c), F.lit(size)) + 1
    maps = wanted.groupBy(F.bitmap_bucket_number(place(key)).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(key))).alias(bits))
    spot = F.bitmap_bit_position(place(by)).cast("int")
    # a byte's number is that of its Latin-1 character
    byte = F.ascii(F.decode(F.substring(bits, F.shiftright(spot, 3) + 1, F.lit(1)), "ISO-8859-1"))
    bit = F.getbit(byte, spot % 8)
    return rows.withColumn(part, F.bitmap_bucket_number(place(by))).join(F.broadcast(maps), part, "left").withColumn(flag, F.coalesce(bit == 1, F.lit(False))).drop(part, bits)


def picked(rows: DataFrame, by: str, wanted: DataFrame, key: str) -> DataFrame:
    (flag,) = hidden(rows, "flag")
    return flagged(rows, by, wanted, key, flag).filter(flag).select(*rows.columns)
