"""Losses of detection and segmentation networks as aggregations over score tables, for evaluation without a training framework."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def positive_unlabelled(rows: DataFrame, share: float, slack: float = 1.0) -> DataFrame:
    """(positives, penalty, loss): cross-entropy of the positives plus slack times the cross-entropy of the unlabelled rows' count of positives.

    rows: logit, target (1 positive, 0 unlabelled). The classifier's count is taken as a discretised normal distribution with the mean and variance of
    its scores, and compared with the binomial of probability share. Counts farther than 40 deviations from the mean have no weight and are left out.
    """
    p = sigmoid(F.col("logit"))
    one, zero = F.col("target") == 1, F.col("target") == 0
    bce = F.greatest(F.lit(0.0), -F.col("logit")) + F.log1p(F.exp(-F.abs("logit")))
    sums = rows.agg(F.avg(F.when(one, bce)).alias("positives"), F.count_if(zero).alias("n"), F.sum(F.when(zero, p)).alias("mu"), F.sum(F.when(zero, p * (1 - p))).alias("var"))
    r = sums.first()
    if not r.n:
        return sums.select("positives", F.lit(0.0).alias("penalty"), F.col("positives").alias("loss"))
    var = r["var"] + 1e-10
    reach = 40 * math.sqrt(var) + 1
    low, high = max(0, math.floor(r.mu - reach)), min(r.n, math.ceil(r.mu + reach))
    best = min(max(round(r.mu), 0), r.n)
    k = rows.sparkSession.range(low, high + 1).withColumnRenamed("id", "k").withColumn("w", F.exp(-0.5 * ((F.col("k") - r.mu) ** 2 - (best - r.mu) ** 2) / var))
    # log k! by Stirling's series from 10 up, and by products below
    small = [math.lgamma(i + 1) for i in range(10)]
    x = lambda c: F.when(c < 10, F.element_at(F.array(*map(F.lit, small)), F.least(c, F.lit(9)).cast("int") + 1)).otherwise(c * F.log(c) - c + 0.5 * F.log(2 * math.pi * c) + 1 / (12 * c) - 1 / (360 * c**3))
    log_p = math.lgamma(r.n + 1) - x(F.col("k").cast("double")) - x((r.n - F.col("k")).cast("double")) + F.col("k") * math.log(share) + (r.n - F.col("k")) * math.log(1 - share)
    penalty = k.agg((-F.sum(log_p * F.col("w")) / F.sum("w")).alias("penalty"))
    return sums.select("positives").crossJoin(penalty).select("positives", "penalty", (F.coalesce("positives", F.lit(0.0)) + slack * F.col("penalty")).alias("loss"))  # two single rows


def multi_task(losses: DataFrame) -> DataFrame:
    """Sum of loss * exp(-eta) + eta over rows (loss, eta)."""
    return losses.agg(F.sum(F.col("loss") * F.exp(-F.col("eta")) + F.col("eta")).alias("total"))


def inside_outside(rows: DataFrame, key: str, alpha: float = 1.0, beta: float = 0.0, eps: float = 1e-6) -> DataFrame:
    """Per channel key, minus the mean score inside label 1, plus alpha times that inside labels over 1, minus beta times their share of all scores (0 for empty masks).

    rows: key, logit, label.
    """
    p, a, b = sigmoid(F.col("logit")), F.col("label") == 1, F.col("label") > 1
    g = rows.groupBy(key).agg(F.sum(F.when(a, p).otherwise(0.0)).alias("p1"), F.sum(F.when(b, p).otherwise(0.0)).alias("p2"), F.count_if(a).alias("n1"), F.count_if(b).alias("n2"), F.sum(p).alias("all"))
    n1, n2 = F.greatest(F.col("n1"), F.lit(eps)), F.greatest(F.col("n2"), F.lit(eps))
    third = F.when((F.col("n1") + F.col("n2")) > 0, beta * F.col("all") / (n1 + n2)).otherwise(0.0)
    return g.select(key, (-(F.col("p1") / n1 - alpha * F.col("p2") / n2 + third)).alias("loss"))


def generalised_dice(rows: DataFrame, eps: float = 1e-6) -> DataFrame:
    """One minus twice the weighted overlap over all channels (channel, p, t), channels weighted by the inverse square of their size."""
    c = rows.groupBy("channel").agg(F.sum(F.col("p") * F.col("t")).alias("i"), F.sum(F.col("p") + F.col("t")).alias("u"), F.sum("t").alias("s"))
    w = 1 / F.greatest(F.col("s") * F.col("s"), F.lit(eps))
    return c.agg((1 - 2 * F.sum(w * F.col("i")) / F.greatest(F.sum(w * F.col("u")), F.lit(eps))).alias("loss"))


def weighted_cross_entropy(rows: DataFrame) -> DataFrame:
    """Mean cross-entropy of (label, p: array of class probabilities), classes weighted by the ratio of what other classes get to what they get."""
    flat = rows.select("label", "p", F.posexplode("p").alias("c", "v"))
    mass = flat.groupBy("c").agg((F.sum(1 - F.col("v")) / F.greatest(F.sum("v"), F.lit(1e-6))).alias("w"))
    own = flat.filter("c = label").join(F.broadcast(mass), "c")  # one row per class
    return own.agg((F.sum(-F.log(F.greatest(F.col("v"), F.lit(1e-12))) * F.col("w")) / F.sum("w")).alias("loss"))


def smooth_l1(rows: DataFrame, threshold: float = 0.0, weight: float = 1.0) -> DataFrame:
    """Mean Huber loss of (guess, target), rows whose target is below the threshold times weight."""
    d = F.abs(F.col("guess") - F.col("target"))
    one = F.when(d < 1, 0.5 * d * d).otherwise(d - 0.5)
    return rows.agg(F.avg(F.when(F.col("target") < threshold, one * weight).otherwise(one)).alias("loss"))
