"""Incremental import of arriving files and of energies, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed

FILES = "path string, modificationTime timestamp, length long"


def quiet(modified: Column, now: Column, seconds: float) -> Column:
    """Whether a file has not changed for so many seconds (whole age, days included)."""
    return F.unix_timestamp(now) - F.unix_timestamp(modified) >= seconds


def binary_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """A stream of the files of a folder, each once, with its content."""
    return spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


def listings(spark: SparkSession, folder: str, schema: str = FILES) -> DataFrame:
    """A stream of file listings that arrive as Parquet."""
    return spark.readStream.schema(schema).parquet(folder)


def import_stream(files: DataFrame, target: str, pending: str, checkpoint: str, quiet_seconds: float = 30.0, now: Column | None = None):
    """Append files that are quiet to the Parquet set `target`, each path once.

    What has arrived but isn't quiet waits in the latest version below `pending`, and is looked at again with every batch and by import_pending(), so no file
    is lost, however old it is or late it comes. Of listings of one path the latest counts; a path that is in the set already stays out. Returns the query; with availableNow it
    ends when all that has arrived is in or waits, and a later start goes on from the checkpoint.
    """
    return files.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: _import_batch(rows, number, target, pending, quiet_seconds, now)).trigger(availableNow=True).start()


def import_pending(spark: SparkSession, target: str, pending: str, quiet_seconds: float = 30.0, now: Column | None = None) -> None:
    """Look again at the files that waited, without a new listing."""
    _import_batch(spark.createDataFrame([], FILES), None, target, pending, quiet_seconds, now)


def _folder(spark: SparkSession, path: str):
    """(Hadoop's path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, pending: str) -> list[int]:
    """The numbers of the whole versions of what waits."""
    p, fs = _folder(spark, pending)
    names = [x.getPath().getName() for x in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit() and fs.exists(_folder(spark, f"{pending}/{n}/_SUCCESS")[0]))


def _import_batch(rows: DataFrame, number: int | None, target: str, pending: str, quiet_seconds: float, now: Column | None) -> None:
    """One step: the rows and what waits are dealt into what goes to the target and the next version of what waits. A repeated step adds nothing twice."""
    spark = rows.sparkSession
    names = [x.split()[0] for x in FILES.split(", ")]
    versions = _versions(spark, pending)
    rows = rows.select(*names)
    if versions:
        rows = rows.unionByName(spark.read.schema(FILES).parquet(f"{pending}/{versions[-1]}"))
    latest = rows.filter("path is not null").groupBy("path").agg(F.max(F.struct("modificationTime", "length")).alias("f")).select("path", "f.*")
    folder, fs = _folder(spark, target)
    if fs.exists(folder):
        latest = latest.join(spark.read.schema(FILES).parquet(target).select("path"), "path", "left_anti")
    ready = F.coalesce(quiet(F.col("modificationTime"), F.current_timestamp() if now is None else now, quiet_seconds), F.lit(False))
    told = checkpointed(latest.withColumn("ready", ready))
    # first the target: a step that is lost between the two writes is made again, and finds its paths there
    told.filter("ready").select(*names).write.mode("append").parquet(target)
    new = versions[-1] + 1 if versions else 0
    told.filter("not ready").select(*names).write.mode("overwrite").parquet(f"{pending}/{new}")
    for old in versions[:-1]:
        fs.delete(_folder(spark, f"{pending}/{old}")[0], True)


def each_batch(stream: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], None]):
    """Call f(rows, number) for every batch of new rows, such as a dashboard's refresh."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(f).trigger(availableNow=True).start()


def live_energies(rows: DataFrame) -> DataFrame:
    """Mean energy per epoch of a stream (epoch, view_id, energy)."""
    return rows.groupBy("epoch").agg(F.avg("energy").alias("energy"), F.count("*").alias("n"))


def windowed_values(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Tumbling-window counts and sums of events (ts, event_type, value), late rows allowed for. An extension: the operators above don't need windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
