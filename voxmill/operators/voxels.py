"""Voxel statistics and scalar filters on volumes held as arrays, or as rows (volume_id, z, y, x, v)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def voxels(volumes: DataFrame, ny: int = 4, nx: int = 4) -> DataFrame:
    """(volume_id, label, z, y, x, v) of volumes (volume_id, label, data) in z, y, x order."""
    out = volumes.select("volume_id", "label", F.posexplode("data").alias("i", "v"))
    at = unravel(F.col("i"), ny, nx)
    return out.select("volume_id", "label", *(c.cast("long").alias(a) for a, c in zip("zyx", at, strict=True)), "v")


def unravel(i: Column, ny: int, nx: int) -> tuple[Column, Column, Column]:
    """(z, y, x) of a linear index."""
    return F.floor(i / (ny * nx)), F.floor(i / nx) % ny, i % nx


def center_of_mass(rows: DataFrame) -> DataFrame:
    """Intensity-weighted mean position of each volume; null where the intensities sum to 0."""
    total = F.sum("v")
    return rows.groupBy("volume_id").agg(*(F.when(total != 0, F.sum(F.col("v") * F.col(a)) / total).alias(f"c{a}") for a in "zyx"))


def project_z(rows: DataFrame) -> DataFrame:
    return rows.groupBy("volume_id", "y", "x").agg(F.sum("v").alias("v"))


def brightest_slice(rows: DataFrame) -> DataFrame:
    """The z of the greatest mean intensity (ties: the least z)."""
    mean = rows.groupBy("volume_id", "z").agg(F.avg("v").alias("mean"))
    return mean.groupBy("volume_id").agg(F.min_by("z", F.struct(-F.round("mean", 9), "z")).alias("z"))


def stretch(data: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Min-max scaling to [low, high]; a constant array becomes low."""
    a, b = F.array_min(data), F.array_max(data)
    return F.transform(data, lambda v: F.when(b > a, low + (v - a) / (b - a) * (high - low)).otherwise(F.lit(low)))


def zscore(data: Column) -> Column:
    """Mean 0 and population deviation 1; a constant array becomes 0."""
    n = F.nullif(F.size(data), F.lit(0)).cast("double")
    mean = F.aggregate(data, F.lit(0.0), lambda s, v: s + v) / n
    dev = lambda m: F.sqrt(F.aggregate(data, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / n)
    scaled = lambda m, d: F.transform(data, lambda v: F.when(d > 0, (v - m) / d).otherwise(0.0))
    # lambdas hold mean and deviation, which would be computed again for every value
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    return once(mean, lambda m: once(dev(m), lambda d: scaled(m, d)))


def threshold(data: Column, t: Column | float) -> Column:
    """Values below t become 0."""
    return F.transform(data, lambda v: F.when(v >= t, v).otherwise(0.0))


def above_share(data: Column, t: float) -> Column:
    """1 where a value is over the share t of the greatest."""
    top = F.array_max(data)
    return F.transform(data, lambda v: F.when(v > t * top, 1).otherwise(0))


def gamma(data: Column, g: float) -> Column:
    return F.transform(stretch(data), lambda v: F.pow(v, F.lit(g)))


def otsu(rows: DataFrame, bins: int = 256) -> DataFrame:
    """Otsu's threshold of each volume: of the bin centres of an even histogram, the one that separates two classes best (ties: the least)."""
    span = rows.groupBy("volume_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(F.col("high") > F.col("low"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / width))).otherwise(0)
    hist = rows.join(span, "volume_id").groupBy("volume_id", "low", "high", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    hist = hist.withColumn("center", F.col("low") + (F.col("bin") + 0.5) * width)
    w = W.partitionBy("volume_id")
    up = w.orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    mass = F.col("n") * F.col("center")
    h = hist.withColumns({"w1": F.sum("n").over(up), "s1": F.sum(mass).over(up), "w": F.sum("n").over(w), "s": F.sum(mass).over(w)})
    gap = F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / (F.col("w") - F.col("w1"))
    spread = F.when(F.col("w") > F.col("w1"), F.col("w1") * (F.col("w") - F.col("w1")) * gap * gap).otherwise(0.0)
    return h.withColumn("spread", F.round(spread, 6)).groupBy("volume_id").agg(F.min_by("center", F.struct(-F.col("spread"), "bin")).alias("threshold"))


def gradient(rows: DataFrame) -> DataFrame:
    """Forward differences along z, y and x on the grid without its last planes."""
    out = rows
    for a, others in (("z", "yx"), ("y", "zx"), ("x", "zy")):
        out = out.withColumn(f"g{a}", F.lead("v").over(W.partitionBy("volume_id", *others).orderBy(a)) - F.col("v"))
    return out.dropna(subset=["gz", "gy", "gx"]).select("volume_id", "z", "y", "x", "gz", "gy", "gx")


def correlation(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pearson correlation over the voxels of volumes a and b that are paired by (volume_id, z, y, x)."""
    both = a.select("volume_id", "z", "y", "x", F.col("v").alias("p")).join(b.select("volume_id", "z", "y", "x", F.col("v").alias("q")), ["volume_id", "z", "y", "x"])
    return both.groupBy("volume_id").agg(F.corr("p", "q").alias("corr"))


def bounding_box(rows: DataFrame, border: float = 0.0) -> DataFrame:
    """Least and greatest coordinate of the voxels above a border value."""
    inside = rows.filter(F.col("v") > border)
    return inside.groupBy("volume_id").agg(*(f(a).alias(f"{a}{k}") for a in "zyx" for f, k in ((F.min, 1), (F.max, 2))))


def ball_size(radius: int) -> int:
    """Voxels of a ball, by counting."""
    r = range(-radius, radius + 1)
    return sum(z * z + y * y + x * x <= radius * radius for z in r for y in r for x in r)


def ball_mask(centers: DataFrame, radius: int) -> DataFrame:
    """Distinct voxels (image_id, z, y, x) within a radius of a centre (integer z, y, x): a fixed stencil per centre, so no distance join."""
    r = range(-radius, radius + 1)
    spots = [(z, y, x) for z in r for y in r for x in r if z * z + y * y + x * x <= radius * radius]
    stencil = F.array(*(F.struct(*(F.lit(v).alias("d" + a) for a, v in zip("zyx", s, strict=True))) for s in spots))
    out = centers.select("image_id", "z", "y", "x", F.explode(stencil).alias("d"))
    return out.select("image_id", *((F.col(a) + F.col(f"d.d{a}")).alias(a) for a in "zyx")).distinct()


def tukey(i: Column, n: int, alpha: float) -> Column:
    """Tukey window value at index i of n."""
    x = i / (n - 1)
    edge = alpha / 2
    return F.when(x < edge, 0.5 * (1 + F.cos(F.lit(math.pi) * (x / edge - 1)))).when(x > 1 - edge, 0.5 * (1 + F.cos(F.lit(math.pi) * ((x - 1) / edge + 1)))).otherwise(1.0)


def hann(i: Column, n: int) -> Column:
    return 0.5 - 0.5 * F.cos(2 * math.pi * i / (n - 1))


def gaussian_psf(spark, sigma: tuple[float, float, float], half: int) -> DataFrame:
    """(z, y, x, v): Gaussian stretched to [0, 1] and then scaled to sum 1, on a cube of side 2 * half + 1."""
    n = 2 * half + 1
    cells = spark.range(n**3).select(*(c.cast("long").alias(a) for a, c in zip("zyx", unravel(F.col("id"), n, n), strict=True)))
    power = sum(((F.col(a) - half) / float(s)) ** 2 for a, s in zip("zyx", sigma, strict=True))
    cells = cells.withColumn("g", F.exp(-0.5 * power))
    low, high = cells.agg(F.min("g"), F.max("g")).first()
    total = cells.agg(F.sum((F.col("g") - low) / (high - low))).first()[0]
    return cells.select("z", "y", "x", ((F.col("g") - low) / (high - low) / total).alias("v"))


def flip(rows: DataFrame, axis: str, n: int) -> DataFrame:
    return rows.withColumn(axis, n - 1 - F.col(axis))


def rotate90(rows: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """A quarter turn from axis a to axis b, exact by index arithmetic."""
    return rows.withColumns({a: n - 1 - F.col(b), b: F.col(a)})


def nearest_grid(samples: DataFrame, step: float, reach: int = 1) -> DataFrame:
    """(gy, gx, value): the value of the nearest sample (y, x, value) to each grid point within `reach` cells of one; ties take the least value."""
    around = F.sequence(F.lit(-reach), F.lit(reach))
    s = samples.withColumn("i", F.explode(around)).withColumn("j", F.explode(around))
    s = s.withColumns({"gy": (F.rint(F.col("y") / step) + F.col("i")).cast("long"), "gx": (F.rint(F.col("x") / step) + F.col("j")).cast("long")})
    d2 = (F.col("gy") * step - F.col("y")) ** 2 + (F.col("gx") * step - F.col("x")) ** 2
    return s.groupBy("gy", "gx").agg(F.min_by("value", F.struct(F.round(d2, 9), "value")).alias("value"))
