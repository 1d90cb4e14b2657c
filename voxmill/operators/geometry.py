"""Poses: XZX Euler angles in degrees (rot1, rot2, rot3) and translations (t1, t2, t3), as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = list[list[Column]]


def _x(a: Column) -> Matrix:
    return [[F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.lit(0.0), F.cos(a), -F.sin(a)], [F.lit(0.0), F.sin(a), F.cos(a)]]


def _z(a: Column) -> Matrix:
    return [[F.cos(a), -F.sin(a), F.lit(0.0)], [F.sin(a), F.cos(a), F.lit(0.0)], [F.lit(0.0), F.lit(0.0), F.lit(1.0)]]


def multiply(a: Matrix, b: Matrix) -> Matrix:
    return [[a[i][0] * b[0][j] + a[i][1] * b[1][j] + a[i][2] * b[2][j] for j in range(3)] for i in range(3)]


def transpose(a: Matrix) -> Matrix:
    return [list(row) for row in zip(*a, strict=True)]


def apply(a: Matrix, v: list[Column]) -> list[Column]:
    return [a[i][0] * v[0] + a[i][1] * v[1] + a[i][2] * v[2] for i in range(3)]


def euler_matrix(rot1: Column, rot2: Column, rot3: Column) -> Matrix:
    """Rx(rot1) Rz(rot2) Rx(rot3), in closed form."""
    c1, s1, c2, s2, c3, s3 = (f(F.radians(a)) for a in (rot1, rot2, rot3) for f in (F.cos, F.sin))
    return [[c2, -c3 * s2, s2 * s3], [c1 * s2, c1 * c2 * c3 - s1 * s3, -c3 * s1 - c1 * c2 * s3], [s1 * s2, c1 * s3 + c2 * c3 * s1, c1 * c3 - c2 * s1 * s3]]


def euler_angles(m: Matrix) -> list[Column]:
    """The XZX angles in degrees, rot2 in [0, 180]. In gimbal lock (rot2 0 or 180) rot3 is 0."""
    c2 = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), m[0][0]))
    locked = F.abs(c2) > 1 - 1e-12
    flat = F.atan2(m[2][1], m[1][1])
    one = F.when(locked, F.when(c2 > 0, flat).otherwise(F.atan2(-m[1][2], m[2][2]))).otherwise(F.atan2(m[2][0], m[1][0]))
    three = F.when(locked, F.lit(0.0)).otherwise(F.atan2(m[0][2], -m[0][1]))
    return [F.degrees(one), F.degrees(F.acos(c2)), F.degrees(three)]


def pose_matrix(p: str = "") -> Matrix:
    return euler_matrix(*(F.col(f"{p}rot{k}") for k in (1, 2, 3)))


def shift(p: str = "") -> list[Column]:
    return [F.col(f"{p}t{k}") for k in (1, 2, 3)]


def compose(p: str, q: str) -> tuple[Matrix, list[Column]]:
    """First p, then q: rotation Rq Rp and translation tq + Rq tp."""
    r = pose_matrix(q)
    return multiply(r, pose_matrix(p)), [a + b for a, b in zip(shift(q), apply(r, shift(p)), strict=True)]


def invert(p: str = "") -> tuple[Matrix, list[Column]]:
    back = transpose(pose_matrix(p))
    return back, [-x for x in apply(back, shift(p))]


def about_center(m: Matrix, shape: list[float]) -> tuple[Matrix, list[Column]]:
    """(rotation, offset) of the rotation about the centre (shape - 1) / 2 of a volume."""
    c = [F.lit((n - 1) / 2) for n in shape]
    return m, [a - b for a, b in zip(c, apply(m, c), strict=True)]


def angle_between(a: Matrix, b: Matrix) -> Column:
    """Angle in degrees of the rotation between two, its cosine clamped on both sides."""
    trace = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            trace = trace + a[i][j] * b[i][j]
    return F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (trace - 1) / 2))))


def symmetrize(poses: DataFrame, k: int, angle: str = "rot3") -> DataFrame:
    """k copies of each pose, copy s with s * 360 / k added to an angle; the column sym is s."""
    return poses.withColumn("sym", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(angle, F.col(angle) + F.col("sym") * (360.0 / k))


def pose_distances(pairs: DataFrame, p: str, q: str, k: int = 1) -> DataFrame:
    """angle and distance of each pair of poses under one symmetry index, the one whose mean angle over all pairs is least (ties: the least index)."""
    copies = pairs.withColumn("sym", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn(f"{q}rot3", F.col(f"{q}rot3") + F.col("sym") * (360.0 / k))
    copies = copies.withColumn("angle", angle_between(pose_matrix(p), pose_matrix(q)))
    best = copies.groupBy("sym").agg(F.avg("angle").alias("mean")).agg(F.min(F.struct(F.round("mean", 9), "sym"))["sym"].alias("sym"))
    far = F.sqrt(sum((a - b) ** 2 for a, b in zip(shift(p), shift(q), strict=True)))
    return copies.join(F.broadcast(best), "sym").withColumn("distance", far)  # one row is broadcast


def family_distances(poses: DataFrame, other: DataFrame, k: int, family: str) -> DataFrame:
    """For each pose of `other` the median over the reference poses of its family of the least rotation error, all errors being taken relative to that reference.

    Poses (pose_id, family, rot1..) meet within a family only, in the frame of each of its poses; symmetry acts on the first angle. Quadratic in a family by definition, so a
    family should be the views of one set; families are dealt out by their key and the pose.
    """
    rots = ("rot1", "rot2", "rot3")
    a = poses.select("pose_id", family, *(F.col(c).alias(f"a_{c}") for c in rots))
    both = a.join(other.select("pose_id", *(F.col(c).alias(f"b_{c}") for c in rots)), "pose_id")
    ref = both.select(family, F.col("pose_id").alias("ref_id"), *(F.col(f"{s}_{c}").alias(f"r{s}_{c}") for s in "ab" for c in rots))
    pairs = both.join(ref, family).withColumn("sym", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).withColumn("b_rot1", F.col("b_rot1") + F.col("sym") * (360.0 / k))
    one = multiply(transpose(pose_matrix("ra_")), pose_matrix("a_"))
    two = multiply(transpose(pose_matrix("rb_")), pose_matrix("b_"))
    least = pairs.withColumn("angle", angle_between(one, two)).groupBy("pose_id", "ref_id").agg(F.min("angle").alias("angle"))
    return least.groupBy("pose_id").agg(F.median("angle").alias("angle"))


def sphere_axes(spark, n_axes: int, n_rot: int, k: int = 1) -> DataFrame:
    """Fibonacci axes times in-plane rotations: (axis, turn, rot1, rot2, rot3); both ends of the turns' range 360 / k are there."""
    golden = math.pi * (3 - math.sqrt(5))
    i = F.col("axis")
    z = 1 - (2 * i + 1) / n_axes
    base = spark.range(n_axes).select(F.col("id").alias("axis"))
    turns = F.explode(F.sequence(F.lit(0), F.lit(n_rot - 1))).alias("turn")
    out = base.select("axis", turns, F.degrees(i * golden).alias("phi"), F.degrees(F.acos(z)).alias("theta"))
    step = 360.0 / k / max(1, n_rot - 1)
    return out.select("axis", "turn", F.pmod("phi", F.lit(360.0)).alias("rot1"), F.col("theta").alias("rot2"), (F.col("turn") * step).alias("rot3"))


def rotation_between(a: list[Column], b: list[Column]) -> Matrix:
    """Rodrigues' rotation of unit vector a to b; a half turn for opposite vectors about some axis across a."""
    v = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    c = a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    zero = F.lit(0.0)
    k = [[zero, -v[2], v[1]], [v[2], zero, -v[0]], [-v[1], v[0], zero]]
    kk = multiply(k, k)
    back = F.abs(1 + c) < 1e-12
    # across a: the unit vector of the axis in which a is least, made orthogonal
    least = F.least(F.abs(a[0]), F.abs(a[1]), F.abs(a[2]))
    e = [F.when(F.abs(a[0]) == least, 1.0).otherwise(0.0), F.when((F.abs(a[1]) == least) & (F.abs(a[0]) != least), 1.0).otherwise(0.0), F.when((F.abs(a[1]) != least) & (F.abs(a[0]) != least), 1.0).otherwise(0.0)]
    dot = a[0] * e[0] + a[1] * e[1] + a[2] * e[2]
    u = [e[i] - dot * a[i] for i in range(3)]
    n2 = u[0] * u[0] + u[1] * u[1] + u[2] * u[2]
    return [[F.when(back, 2 * u[i] * u[j] / n2 - (1.0 if i == j else 0.0)).otherwise((1.0 if i == j else 0.0) + k[i][j] + kk[i][j] / (1 + c)) for j in range(3)] for i in range(3)]


def refined_grid(poses: DataFrame, spread: float, n: int) -> DataFrame:
    """n ** 3 poses around each, every angle over linspace(-spread / 2, spread / 2, n), translations zero."""
    out = poses
    for c in ("rot1", "rot2", "rot3"):
        step = spread / max(1, n - 1)
        out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(c, F.col(c) - spread / 2 + F.col("k") * step).drop("k")
    return out.withColumns({c: F.lit(0.0) for c in ("t1", "t2", "t3")})


def xyz_angles(m: Matrix) -> list[Column]:
    """Angles about x, y and z in radians, the last one 0 where the middle one is a quarter turn."""
    sy = F.sqrt(m[0][0] * m[0][0] + m[1][0] * m[1][0])
    singular = sy < 1e-6
    return [F.when(singular, F.atan2(-m[1][2], m[1][1])).otherwise(F.atan2(m[2][1], m[2][2])), F.atan2(-m[2][0], sy), F.when(singular, F.lit(0.0)).otherwise(F.atan2(m[1][0], m[0][0]))]


def default_origin() -> dict[str, Column]:
    """Origin of an image (dim_*, voxel_*): minus half its width and height, plus its depth."""
    return {"ox": F.col("dim_x") / -2.0 * F.col("voxel_xy"), "oy": F.col("dim_y") / -2.0 * F.col("voxel_xy"), "oz": F.col("dim_z") * F.col("voxel_z")}


def in_plane_angle(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Signed angle in degrees of a drawn line against the x axis."""
    dx, dy = x2 - x1, y2 - y1
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n > 0, F.when(dy < 0, -1.0).otherwise(1.0) * F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dx / n)))))


def points_seen(points: DataFrame, by: str) -> DataFrame:
    """Mean centre, greatest distance from it and field of view of each cloud of points (by, z, y, x)."""
    c = points.groupBy(by).agg(*(F.avg(a).alias("c" + a) for a in "zyx"), *(f(a).alias(f"{a}_{k}") for a in "zyx" for f, k in ((F.min, "low"), (F.max, "high"))))
    far = points.join(c.select(by, "cz", "cy", "cx"), by).groupBy(by).agg(F.max(F.sqrt(sum((F.col(a) - F.col("c" + a)) ** 2 for a in "zyx"))).alias("radius"))
    return c.join(far, by)


def oriented_boxes_meet(p: str, q: str) -> Column:
    """Whether two oriented boxes meet, by the fifteen separating directions. Columns <p>rot1..3, <p>t1..3 (centre) and <p>h1..3 (half sizes)."""
    a, b = transpose(pose_matrix(p)), transpose(pose_matrix(q))  # rows: the boxes' axes
    gap = [y - x for x, y in zip(shift(p), shift(q), strict=True)]
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    cross = lambda u, v: [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    meet = F.lit(True)
    for axis in [*a, *b, *(cross(u, v) for u in a for v in b)]:
        reach = sum(F.col(f"{p}h{i + 1}") * F.abs(dot(a[i], axis)) + F.col(f"{q}h{i + 1}") * F.abs(dot(b[i], axis)) for i in range(3))
        meet = meet & (F.abs(dot(gap, axis)) <= reach + 1e-9)
    return meet
