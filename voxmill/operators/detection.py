"""Boxes: geometry, overlap joins, suppression, grouping and evaluation. A box is x1, y1, z1, x2, y2, z2 in an image_id."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

AXES = "xyz"


def corners(center: dict[str, Column], size: dict[str, Column]) -> dict[str, Column]:
    """Corners of boxes given by centre and size: min = centre - size // 2, max = min + size."""
    low = {a: center[a] - F.floor(size[a] / 2) for a in AXES}
    return {f"{a}1": low[a] for a in AXES} | {f"{a}2": low[a] + size[a] for a in AXES}


def volume(p: str = "") -> Column:
    out = F.lit(1)
    for a in AXES:
        out = out * (F.col(f"{p}{a}2") - F.col(f"{p}{a}1"))
    return out


def iou(p: str, q: str) -> Column:
    """Intersection over union of two boxes whose columns are prefixed p and q; 0 for two empty boxes."""
    both = F.lit(1)
    for a in AXES:
        both = both * F.greatest(F.lit(0), F.least(F.col(f"{p}{a}2"), F.col(f"{q}{a}2")) - F.greatest(F.col(f"{p}{a}1"), F.col(f"{q}{a}1")))
    union = volume(p) + volume(q) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def _prefixed(boxes: DataFrame, p: str, *keep: str) -> DataFrame:
    return boxes.select(*keep, *(F.col(c).alias(p + c) for c in ["box_id", *(f"{a}{k}" for a in AXES for k in "12")]))


def overlap_join(left: DataFrame, right: DataFrame, cell: int = 16) -> DataFrame:
    """Pairs of boxes of one image that overlap: image_id, p_box_id, q_box_id, iou.

    Boxes are put in the grid cells that they touch along x and y, and a pair is made only in the first cell that both touch, so a crowded image is dealt out
    by cells and no pair is made twice.
    """

    def cells(boxes: DataFrame, p: str) -> DataFrame:
        out = _prefixed(boxes, p, "image_id")
        for a in "xy":
            out = out.withColumn(f"cell_{a}", F.explode(F.sequence(F.floor(F.col(f"{p}{a}1") / cell), F.floor((F.col(f"{p}{a}2") - 1) / cell))))
        return out

    meet = [F.col(f"p_{x}1") < F.col(f"q_{x}2") for x in AXES] + [F.col(f"q_{x}1") < F.col(f"p_{x}2") for x in AXES]
    meet += [F.col(f"cell_{a}") == F.floor(F.greatest(f"p_{a}1", f"q_{a}1") / cell) for a in "xy"]
    pairs = cells(left, "p_").join(cells(right, "q_"), ["image_id", "cell_x", "cell_y"])
    for m in meet:
        pairs = pairs.filter(m)
    return pairs.select("image_id", "p_box_id", "q_box_id", iou("p_", "q_").alias("iou"))


def match_counts(pred: DataFrame, truth: DataFrame, threshold: float = 0.2) -> DataFrame:
    """tp, fp, fn of every image with a box on either side.

    A prediction is false if its best overlap is below the threshold; a truth box is found if its best is above it, else missed (an overlap that
    equals the threshold makes neither a hit nor a false prediction). Images with one side only count.
    """
    rows = _best_overlaps(pred, truth)
    p, t, best = F.col("side") == "p", F.col("side") == "q", F.col("best")
    return rows.groupBy("image_id").agg(F.count_if(t & (best > threshold)).alias("tp"), F.count_if(p & (best < threshold)).alias("fp"), F.count_if(t & (best <= threshold)).alias("fn"))


def _best_overlaps(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """(image_id, side, box_id, best): every prediction (side p) and truth box (side q) with its best overlap, 0 for none; one overlap join serves both sides."""
    pairs = overlap_join(pred, truth)
    sides = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_box_id").alias("box_id")) for s in "pq"))).alias("b")
    best = pairs.select("image_id", sides, "iou").groupBy("image_id", "b.side", "b.box_id").agg(F.max("iou").alias("best"))
    rows = pred.select("image_id", F.lit("p").alias("side"), "box_id").unionByName(truth.select("image_id", F.lit("q").alias("side"), "box_id"))
    return rows.join(best, ["image_id", "side", "box_id"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))


def scores() -> dict[str, Column]:
    """precision, recall and f1 of columns tp, fp, fn; 0/0 is 0."""
    tiny = 1e-20
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp") + tiny), F.col("tp") / (F.col("tp") + F.col("fn") + tiny)
    return {"precision": precision, "recall": recall, "f1": 2 * precision * recall / (precision + recall + tiny)}


def _against(boxes: np.ndarray, k: int, rest: np.ndarray) -> np.ndarray:
    low, high = np.maximum(boxes[k, :3], boxes[rest, :3]), np.minimum(boxes[k, 3:], boxes[rest, 3:])
    both = np.clip(high - low, 0, None).prod(1)
    size = (boxes[:, 3:] - boxes[:, :3]).prod(1)
    return both / np.maximum(size[k] + size[rest] - both, 1e-300)


def _greedy(boxes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For boxes in order of priority: (which are kept, the kept box that claims each one)."""
    claimed = np.full(len(boxes), -1)
    for k in range(len(boxes)):
        if claimed[k] < 0:
            claimed[k] = k
            rest = np.flatnonzero(claimed < 0)
            claimed[rest[_against(boxes, k, rest) > threshold]] = k
    return claimed == np.arange(len(boxes)), claimed


_COLS = [f"{a}1" for a in AXES] + [f"{a}2" for a in AXES]


def suppress(boxes: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Greedy non-maximum suppression per image: by descending score (ties by box_id), boxes overlapping a kept one by more than the threshold go."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "box_id"], ascending=[False, True], kind="stable")
        return pdf[_greedy(pdf[_COLS].to_numpy(float), threshold)[0]]

    return boxes.groupBy("image_id").applyInPandas(run, boxes.schema)


def star_groups(boxes: DataFrame) -> DataFrame:
    """boxes with group_id: in order of box_id, the first box left claims all boxes left that overlap it (itself always)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("box_id", kind="stable")
        return pdf.assign(group_id=pdf["box_id"].to_numpy()[_greedy(pdf[_COLS].to_numpy(float), 0.0)[1]])

    return boxes.groupBy("image_id").applyInPandas(run, boxes.schema.simpleString()[7:-1].replace(":", " ") + ", group_id string")


def spatial_average(groups: DataFrame) -> DataFrame:
    """The mean box of each group."""
    return groups.groupBy("image_id", "group_id").agg(*(F.avg(c).alias(c) for c in _COLS), F.count("*").alias("n"))


def patch_grid(images: DataFrame, patch: int, stride: int) -> DataFrame:
    """(image_id, z, y, x): starts of the sliding windows of each image (dim_x, dim_y, dim_z)."""
    out = images.select("image_id", *(F.sequence(F.lit(0), F.col(f"dim_{a}") - patch, F.lit(stride)).alias(a) for a in "zyx"))
    for a in "zyx":
        out = out.withColumn(a, F.explode(a))
    return out


def patch_center(index: Column, n_y: Column, n_x: Column, patch: int, stride: int) -> dict[str, Column]:
    """Voxel centre of a patch from its linear index (z slowest)."""
    z, y, x = F.floor(index / (n_y * n_x)), F.floor(index / n_x) % n_y, index % n_x
    return {a: v * stride + patch // 2 for a, v in zip("zyx", (z, y, x), strict=True)}


def shifted_inside(low: Column, size: Column, limit: Column) -> Column:
    """The least corner of a box moved inside [0, limit], its size kept."""
    return F.greatest(F.lit(0), F.least(low, limit - size))


def clipped_inside(c: Column, limit: Column) -> Column:
    """A corner clipped to [0, limit], so that a box may shrink."""
    return F.least(F.greatest(c, F.lit(0)), limit)


def crop_box(center: Column, size: Column, whole: str = "rint") -> tuple[Column, Column]:
    """First and end index of a crop around a centre in voxels. whole: rint (half to even) or ceil of the size."""
    n = (F.rint(size) if whole == "rint" else F.ceil(size)).cast("long")
    low = F.rint(center - n / 2).cast("long")
    return low, low + n


def rank_in_image(rows: DataFrame, *order: str) -> DataFrame:
    """rows with rank: 0, 1, ... within the image in the given order."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("image_id").orderBy(*order)) - 1)


def score_patches(patches: DataFrame, score, keep_above: float = 0.0) -> DataFrame:
    """patches (image_id, z, y, x, data: array of double) whose score(array of patches) -> logits is above keep_above, with the column score.

    Each patch is stretched to [0, 1] first (a constant patch to 0), as the networks expect.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            data = np.stack(pdf["data"].to_numpy()).astype(float)
            low, high = data.min(1, keepdims=True), data.max(1, keepdims=True)
            logits = np.asarray(score((data - low) / np.where(high > low, high - low, 1)), float)
            yield pdf.drop(columns="data").assign(score=logits)[logits > keep_above]

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in patches.schema if f.name != "data"]
    return patches.mapInPandas(run, ", ".join([*kept, "score double"]))


def keep_bright(images: DataFrame, boxes: DataFrame, margin: float = 0.5) -> DataFrame:
    """Boxes whose summed intensity, stretched to [0, 1] over the image, is over margin times its Otsu threshold. Intensities are ranked into [0, 1] first, so that a few
    very bright voxels don't decide (in place of local histogram equalisation)."""
    from ..functions.kernels import otsu

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = [int(n) for n in pdf["shape"].iloc[0]]
        flat = np.asarray(pdf["data"].iloc[0], float)
        values, place = np.unique(flat, return_inverse=True)
        image = (place / max(1, len(values) - 1)).reshape(shape)
        total = np.array([image[max(0, int(r.z1)) : int(r.z2), max(0, int(r.y1)) : int(r.y2), max(0, int(r.x1)) : int(r.x2)].sum() for r in pdf.itertuples(index=False)])
        if total.max() > total.min():
            total = (total - total.min()) / (total.max() - total.min())
            pdf = pdf[total > margin * otsu(total)]
        return pdf.drop(columns=["shape", "data"])

    both = boxes.join(images.select("image_id", "shape", "data"), "image_id")
    return both.groupBy("image_id").applyInPandas(run, boxes.schema)


def averaged(boxes: DataFrame) -> DataFrame:
    """One box (image_id, box_id, corners) per star group, named by its first box."""
    return spatial_average(star_groups(boxes)).withColumnRenamed("group_id", "box_id").select("image_id", "box_id", *_COLS)


def postprocess(images: DataFrame, boxes: DataFrame, threshold: float = 0.2, min_distance: float | None = None, last: str = "spatial_average", margin: float = 0.5) -> DataFrame:
    """(step, image_id, box_id, corners) after each step: raw, nms, first_spatial_average, center_of_mass_correction, last_step.

    last: spatial_average, or otsu for keep_bright(). min_distance defaults to the suppression threshold.
    """
    from .volumes import recentered

    cols = ["image_id", "box_id", *(F.col(c).cast("double").alias(c) for c in _COLS)]
    kept = suppress(boxes, threshold)
    first = averaged(kept)
    moved = recentered(images, first, threshold if min_distance is None else min_distance)
    final = keep_bright(images, moved, margin) if last == "otsu" else averaged(moved)
    out = None
    for name, rows in (("raw", boxes), ("nms", kept), ("first_spatial_average", first), ("center_of_mass_correction", moved), ("last_step", final)):
        part = rows.select(F.lit(name).alias("step"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def box_edges(boxes: DataFrame, colour: Column) -> DataFrame:
    """(image_id, z, y, x, colour): the voxels of the twelve edges of each box, for drawing."""
    b = boxes.withColumn("colour", colour)
    parts = None
    for a in AXES:
        p, q = [x for x in AXES if x != a]
        run = b.withColumn(a, F.explode(F.sequence(F.col(f"{a}1"), F.col(f"{a}2") - 1)))
        for c in (p, q):
            run = run.withColumn(c, F.explode(F.array(F.col(f"{c}1"), F.col(f"{c}2") - 1)))
        run = run.select("image_id", "z", "y", "x", "colour")
        parts = run if parts is None else parts.unionByName(run)
    return parts.distinct()


def verdicts(pred: DataFrame, truth: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(image_id, box_id, verdict): fp and other predictions, tp and fn truth boxes, as match_counts() counts them."""
    best, p = F.col("best"), F.col("side") == "p"
    verdict = F.when(p, F.when(best < threshold, "fp").otherwise("hit")).otherwise(F.when(best > threshold, "tp").otherwise("fn"))
    return _best_overlaps(pred, truth).select("image_id", "box_id", verdict.alias("verdict"))
