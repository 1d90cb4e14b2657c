"""Preparation of positive-unlabelled training: chosen annotations, positive and unlabelled voxels, and the share of positives to expect."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from .detection import rank_in_image
from .voxels import ball_size

VOXELS = "image_id long, at long"


def chosen(annotations: DataFrame, limit: int | None = None, epoch: int = 0) -> DataFrame:
    """annotations (image_id, z, y, x) with whole coordinates and their rank in the image; with a limit, that many of all in a seeded random order (a distributed top-k)."""
    whole = annotations.withColumns({a: F.col(a).cast("long") for a in "zyx"})
    ranked = rank_in_image(whole, "z", "y", "x")
    return ranked if limit is None else ranked.orderBy(F.xxhash64(F.lit(epoch), "image_id", "rank"), "image_id", "rank").limit(limit)


def positives(images: DataFrame, annotations: DataFrame, radius: int) -> DataFrame:
    """Distinct voxels (image_id, at: linear index, z slowest) of the balls around annotations in images (image_id, dim_z, dim_y, dim_x).

    A ball's box is moved inside its image; an image smaller than the box cuts the ball about the middle of what is left.
    """
    rows = annotations.join(images.select("image_id", "dim_z", "dim_y", "dim_x"), "image_id")
    box = {a: F.least(F.col(f"dim_{a}").cast("long"), F.lit(2 * radius + 1)) for a in "zyx"}
    low = {a: F.greatest(F.lit(0), F.least(F.col(a) - F.floor(box[a] / 2), F.col(f"dim_{a}") - box[a])) for a in "zyx"}
    rows = rows.select("image_id", *(f"dim_{a}" for a in "zyx"), *((low[a] + F.floor(box[a] / 2)).alias(a) for a in "zyx")).distinct()
    r = range(-radius, radius + 1)
    spots = [(z, y, x) for z in r for y in r for x in r if z * z + y * y + x * x <= radius * radius]
    stencil = F.explode(F.array(*(F.struct(*(F.lit(v).alias(a) for a, v in zip("zyx", s, strict=True))) for s in spots))).alias("d")
    moved = rows.select("image_id", *(f"dim_{a}" for a in "zyx"), *"zyx", stencil)
    at = {a: F.col(a) + F.col(f"d.{a}") for a in "zyx"}
    inside = moved
    for a in "zyx":
        inside = inside.filter((at[a] >= 0) & (at[a] < F.col(f"dim_{a}")))
    return inside.select("image_id", ((at["z"] * F.col("dim_y") + at["y"]) * F.col("dim_x") + at["x"]).cast("long").alias("at")).distinct()


def unlabelled(images: DataFrame, **mask) -> DataFrame:
    """Foreground voxels (image_id, at) of images (image_id, shape, data), one image at a time; mask: arguments of kernels.foreground_mask."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                found = np.flatnonzero(k.foreground_mask(np.asarray(r.data, float).reshape([int(n) for n in r.shape]), **mask))
                yield pd.DataFrame({"image_id": np.full(len(found), r.image_id), "at": found})

    return images.select("image_id", "shape", "data").mapInPandas(run, VOXELS)


def expected_share(unlabelled: DataFrame, n_images: int, per_image: int, radius: int) -> DataFrame:
    """One row (share): voxels of the balls to expect, over the unlabelled voxels; null without any."""
    return unlabelled.agg((F.lit(float(ball_size(radius) * per_image * n_images)) / F.nullif(F.count("*"), F.lit(0))).alias("share"))
