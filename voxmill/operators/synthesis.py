"""Seeded synthetic points, poses and images. Random columns come from hashes of (seed, id), so a table is the same for any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, key: Column, stream: int = 0) -> Column:
    """A uniform number in [0, 1) of a key."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(stream), key), F.lit(1 << 52)) / float(1 << 52)


def normal(seed: int, key: Column, stream: int = 0) -> Column:
    """A standard normal number of a key (Box-Muller)."""
    return F.sqrt(-2 * F.log(1 - uniform(seed, key, 2 * stream + 1000))) * F.cos(2 * math.pi * uniform(seed, key, 2 * stream + 1001))


def in_sphere(spark: SparkSession, n: int, radius: float, seed: int) -> DataFrame:
    """n points (id, z, y, x) uniform in a ball, from a direction and the cube root of a uniform number; no rejection."""
    key = F.col("id")
    r = radius * F.pow(uniform(seed, key, 0), F.lit(1 / 3))
    c, phi = 2 * uniform(seed, key, 1) - 1, 2 * math.pi * uniform(seed, key, 2)
    s = F.sqrt(1 - c * c)
    return spark.range(n).select("id", (r * c).alias("z"), (r * s * F.sin(phi)).alias("y"), (r * s * F.cos(phi)).alias("x"))


def dig(points: DataFrame, center: tuple[float, float, float], sigma: float, seed: int) -> DataFrame:
    """Drop points with probability exp(-d^2 / (2 sigma^2)) around a centre."""
    d2 = sum((F.col(a) - c) ** 2 for a, c in zip("zyx", center, strict=True))
    return points.filter(uniform(seed, F.col("id"), 7) >= F.exp(-d2 / (2 * sigma * sigma)))


def shrink(points: DataFrame, factor: float) -> DataFrame:
    return points.withColumns({a: F.col(a) / factor for a in "zyx"})


def move(points: DataFrame, pose: tuple[float, ...]) -> DataFrame:
    """points turned by XZX angles in degrees and moved."""
    from .geometry import apply, euler_matrix

    m = euler_matrix(*(F.lit(float(a)) for a in pose[:3]))
    at = apply(m, [F.col(a) for a in "zyx"])
    return points.select(*[c for c in points.columns if c not in "zyx"], *((at[i] + float(pose[3 + i])).alias(a) for i, a in enumerate("zyx")))


def cylinder(spark: SparkSession, triplets: int = 9, height: float = 10.0, radius: float = 4.0, per_line: int = 20) -> DataFrame:
    """(id, z, y, x): points on lines along z, evenly around a cylinder."""
    i, j = F.floor(F.col("id") / per_line), F.col("id") % per_line
    angle = 2 * math.pi * i / triplets
    return spark.range(triplets * per_line).select("id", (j * (height / max(1, per_line - 1)) - height / 2).alias("z"), (radius * F.sin(angle)).alias("y"), (radius * F.cos(angle)).alias("x"))


def voxelise(points: DataFrame, n: int, sigma: float, reach: float = 4.0) -> DataFrame:
    """(z, y, x, v) on an n^3 grid centred on the origin: Gaussian kernel density, stretched to [0, 1].

    Each point adds to the cells within reach * sigma of it, a stencil of fixed size; cells that none reaches have no row.
    """
    r = math.ceil(reach * sigma)
    steps = F.sequence(F.lit(-r), F.lit(r))
    half = (n - 1) / 2
    cells = points.select(*((F.col(a) + half).alias(a) for a in "zyx"))
    for a in "zyx":
        cells = cells.withColumn("k" + a, F.explode(steps)).withColumn("c" + a, (F.rint(a) + F.col("k" + a)).cast("long")).filter((F.col("c" + a) >= 0) & (F.col("c" + a) < n))
    d2 = sum((F.col("c" + a) - F.col(a)) ** 2 for a in "zyx")
    grid = cells.groupBy(*(F.col("c" + a).alias(a) for a in "zyx")).agg(F.sum(F.exp(-d2 / (2 * sigma * sigma))).alias("v"))
    top = grid.agg(F.max("v").alias("top"))
    return grid.crossJoin(F.broadcast(top)).select("z", "y", "x", (F.col("v") / F.col("top")).alias("v"))  # one row is broadcast


def add_noise(voxels: DataFrame, snr_db: float, seed: int) -> DataFrame:
    """Gaussian noise whose power is the mean signal power over 10^(snr / 10)."""
    power = voxels.agg(F.avg(F.col("v") * F.col("v")).alias("power"))
    key = F.xxhash64("z", "y", "x")
    sigma = F.sqrt(F.col("power") / 10 ** (snr_db / 10))
    return voxels.crossJoin(F.broadcast(power)).withColumn("v", F.col("v") + sigma * normal(seed, key)).drop("power")  # one row is broadcast


def random_poses(spark: SparkSession, n: int, spread: float, seed: int) -> DataFrame:
    """n poses with uniform rotations (angles of axes even on the sphere) and translations in [-spread, spread]."""
    key = F.col("id")
    angles = [360 * uniform(seed, key, 0), F.degrees(F.acos(1 - 2 * uniform(seed, key, 1))), 360 * uniform(seed, key, 2)]
    return spark.range(n).select(F.col("id").alias("pose_id"), *(a.alias(f"rot{i + 1}") for i, a in enumerate(angles)), *((spread * (2 * uniform(seed, key, 3 + i) - 1)).alias(f"t{i + 1}") for i in range(3)))


def apart(candidates: DataFrame, centers: DataFrame, least: float) -> DataFrame:
    """Candidates (image_id, z, y, x) farther than `least` from all centres of their image, by an anti-join over cells of that side."""
    cell = lambda c: F.floor(F.col(c) / least)
    near = F.transform(F.sequence(F.lit(0), F.lit(26)), lambda i: F.struct((F.floor(i / 9) - 1).alias("a"), (F.floor(i / 3) % 3 - 1).alias("b"), (i % 3 - 1).alias("c")))
    b = centers.select("image_id", *(F.col(a).alias("q" + a) for a in "zyx"), F.explode(near).alias("d"))
    b = b.select("image_id", "qz", "qy", "qx", *((F.floor(F.col("q" + a) / least) + F.col("d." + k)).alias("cell_" + a) for a, k in zip("zyx", "abc", strict=True)))
    left = candidates.withColumns({"cell_" + a: cell(a) for a in "zyx"})
    d2 = sum((F.col(a) - F.col("q" + a)) ** 2 for a in "zyx")
    same = (left["image_id"] == b["image_id"]) & (left["cell_z"] == b["cell_z"]) & (left["cell_y"] == b["cell_y"]) & (left["cell_x"] == b["cell_x"]) & (d2 <= least * least)
    return left.join(b, same, "left_anti").select(*candidates.columns)
