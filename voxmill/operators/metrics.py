"""Metrics, running bests, stopping rules, ranks and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import checkpointed


def confusion(rows: DataFrame, classes: list[int], truth: str = "truth", guess: str = "guess") -> DataFrame:
    """One row per true class that occurs, with the counts of every guessed class (p0, p1, ...)."""
    return rows.groupBy(truth).agg(*(F.count_if(F.col(guess) == c).alias(f"p{c}") for c in classes))


def accuracy(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    return rows.agg(F.avg((F.col(truth) == F.col(guess)).cast("double")).alias("accuracy"))


def argmax(scores: Column) -> Column:
    """Index from 0 of the first greatest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def f1(rows: DataFrame, truth: str, logit: str) -> DataFrame:
    """Precision, recall and f1 of rint(sigmoid(logit)) for truth 1; zero denominators give 0."""
    guess = F.rint(1 / (1 + F.exp(-F.col(logit)))).cast("int")
    hit = F.count_if((guess == 1) & (F.col(truth) == 1)).cast("double")
    said, real = F.count_if(guess == 1), F.count_if(F.col(truth) == 1)
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return rows.agg(hit.alias("tp"), said.alias("said"), real.alias("real")).select(over(F.col("tp"), F.col("said")).alias("precision"), over(F.col("tp"), F.col("real")).alias("recall"), over(2 * F.col("tp"), F.col("said") + F.col("real")).alias("f1"))


def running_best(series: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """best so far and whether the step is at least as good as all before it."""
    up = W.partitionBy(key).orderBy(step)
    return series.withColumn("best", F.min(value).over(up)).withColumn("is_best", F.col(value) <= F.col("best"))


def early_stop(series: DataFrame, key: str, step: str, value: str, patience: int) -> DataFrame:
    """The first step after `patience` steps without a new best, null if none: (key, stop)."""
    up = W.partitionBy(key).orderBy(step)
    before = F.min(value).over(up.rowsBetween(W.unboundedPreceding, -1))
    marked = series.withColumn("better", F.coalesce(F.col(value) < before, F.lit(True)).cast("int")).withColumn("run", F.sum("better").over(up))
    waits = marked.withColumn("wait", F.row_number().over(W.partitionBy(key, "run").orderBy(step)) - 1)
    return waits.groupBy(key).agg(F.min(F.when(F.col("wait") >= patience, F.col(step))).alias("stop"))


def settled(series: DataFrame, key: str, step: str, value: str, eps: float, n: int, m: int) -> DataFrame:
    """Per step: whether the mean of the first m of the last n values is less than eps above the mean of the last m (false before n values)."""
    up = W.partitionBy(key).orderBy(step)
    first = F.avg(value).over(up.rowsBetween(-n + 1, -n + m))
    last = F.avg(value).over(up.rowsBetween(-m + 1, 0))
    full = F.row_number().over(up) >= n
    return series.withColumn("drop", F.when(full, first - last)).withColumn("settled", F.coalesce(F.col("drop") < eps, F.lit(False)))


def top_per_group(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter(F.col("rank") <= n)


def halve_then_best(rows: DataFrame, key: str, value: str, n: int, *ties: str) -> DataFrame:
    """Keep the half of each group that is at most its median, then the n least of those."""
    med = rows.groupBy(key).agg(F.median(value).alias("median"))
    half = rows.join(med, key).filter(F.col(value) <= F.col("median")).drop("median")
    return top_per_group(half, [key], [F.col(value), *map(F.col, ties)], n)


def split_by_rank(rows: DataFrame, by: list[str], order: list[str], share: float) -> DataFrame:
    """rows with part: the first int(share * n) of each group are train, the others test."""
    w = W.partitionBy(*by)
    at, n = F.row_number().over(w.orderBy(*order)) - 1, F.count("*").over(w)
    return rows.withColumn("part", F.when(at < F.floor(n * share + 1e-9), "train").otherwise("test"))


def per_class_limit(rows: DataFrame, cls: str, order: list[str], limit: int) -> DataFrame:
    return top_per_group(rows, [cls], [F.col(c) for c in order], limit).drop("rank")


def encode_index(image: Column, at: Column) -> Column:
    """image * 2**32 + at."""
    return F.shiftleft(image.cast("long"), 32) + at


def decode_index(code: Column) -> tuple[Column, Column]:
    return F.shiftright(code, 32), code.bitwiseAND(F.lit((1 << 32) - 1))


def pu_batches(rows: DataFrame, positive: str, order: Column, batch: int, share: float) -> DataFrame:
    """rows with batch: each takes int(share * batch) positives and fills up with the others, both in the given order.

    Rows are sorted by range, counted by partition and class, and numbered within each, so neither class goes through one task; the counts are a few per partition.
    """
    take = int(share * batch)
    quota = F.when(F.col(positive), F.lit(take)).otherwise(F.lit(batch - take))
    placed = checkpointed(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()))
    counts = placed.groupBy(positive, "__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(positive).orderBy("__part")) - F.col("__n")
    offsets = counts.select(F.col(positive).alias("__class"), F.col("__part").alias("__at"), before.alias("__before"))
    # one row for each partition and class
    joined = placed.join(F.broadcast(offsets), F.col(positive).eqNullSafe(F.col("__class")) & (F.col("__part") == F.col("__at")))
    at = F.row_number().over(W.partitionBy(positive, "__part").orderBy(order)) - 1 + F.col("__before")
    return joined.withColumn("batch", F.floor(at / quota)).drop("__part", "__class", "__at", "__before")


def hash_shuffle(rows: DataFrame, key: str, epoch: int) -> DataFrame:
    """A seeded shuffle that is the same for any partitioning."""
    return rows.orderBy(F.xxhash64(F.lit(epoch), F.col(key)), F.col(key))


def view_of(angle: Column, margin: float) -> Column:
    """Top 0, side 1, other 2 from a tilt angle in degrees."""
    a = F.pmod(angle, F.lit(180.0))
    return F.when((a <= margin) | (a >= 180 - margin), 0).when(F.abs(a - 90) <= margin, 1).otherwise(2)


def binomial_bce(logit: Column) -> Column:
    """Cross-entropy of a positive: log(1 + exp(-logit)), without overflow."""
    return F.greatest(F.lit(0.0), -logit) + F.log1p(F.exp(-F.abs(logit)))


def dice(rows: DataFrame, key: str, p: str, t: str, eps: float = 1e-6) -> DataFrame:
    """Dice overlap 2 sum(p t) / (sum(p p) + sum(t t)) per group."""
    a, b = F.col(p), F.col(t)
    return rows.groupBy(key).agg((2 * F.sum(a * b) / F.greatest(F.sum(a * a) + F.sum(b * b), F.lit(eps))).alias("dice"))
