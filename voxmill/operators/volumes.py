"""Distributed volume operators: NumPy kernels run over Arrow batches, sums merged by key. A volume is (volume_id, shape: array<int>, data: array<double>)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..sources.shared import checkpointed

VOLUME = "volume_id long, shape array<int>, data array<double>"


def shaped(row) -> np.ndarray:
    return np.asarray(row.data, float).reshape([int(n) for n in row.shape])


def map_volumes(volumes: DataFrame, f: Callable[[np.ndarray, pd.Series], np.ndarray]) -> DataFrame:
    """volumes with each array replaced by f(array, row); other columns stay."""
    names = volumes.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = [f(shaped(r), r) for r in pdf.itertuples(index=False)]
            yield pdf.assign(shape=[list(m.shape) for m in made], data=[m.ravel() for m in made])[names]

    return volumes.mapInPandas(run, volumes.schema)


def measure(volumes: DataFrame, f: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """(volume_id, what f(array) tells)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([{"volume_id": r.volume_id, **f(shaped(r))} for r in pdf.itertuples(index=False)], columns=["volume_id", *[x.split()[0] for x in schema.split(", ")]])

    return volumes.select("volume_id", "shape", "data").mapInPandas(run, f"volume_id long, {schema}")


def _pose(r) -> np.ndarray:
    return np.array([r.rot1, r.rot2, r.rot3, r.t1, r.t2, r.t3], float)


def rotated(volumes: DataFrame, poses: DataFrame, inverse: bool = False) -> DataFrame:
    """Each volume moved by its pose (volume_id, rot1.., t1..)."""
    both = volumes.join(poses, "volume_id")
    return map_volumes(both, lambda v, r: k.rotate(v, _pose(r), inverse)).select("volume_id", "shape", "data")


def extract(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(image_id, box_id, shape, data): crops of images (image_id, shape, data) by boxes, 0 outside the image."""
    spec = boxes.groupBy("image_id").agg(F.collect_list(F.struct("box_id", "x1", "y1", "z1", "x2", "y2", "z2")).alias("boxes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                image, rows = shaped(r), []
                for b in r.boxes:
                    b = b if isinstance(b, dict) else b.asDict()
                    crop = k.crop_padded(image, np.array([b["z1"], b["y1"], b["x1"]]), np.array([b["z2"], b["y2"], b["x2"]]))
                    rows.append((r.image_id, b["box_id"], list(crop.shape), crop.ravel()))
                yield pd.DataFrame(rows, columns=["image_id", "box_id", "shape", "data"])

    return images.join(spec, "image_id").mapInPandas(run, "image_id long, box_id string, shape array<int>, data array<double>")


def recentered(images: DataFrame, boxes: DataFrame, least: float = 1.0) -> DataFrame:
    """boxes moved onto their bright parts; those that hold nothing go."""
    cols = ["x1", "y1", "z1", "x2", "y2", "z2"]
    both = boxes.select("image_id", "box_id", *cols).join(images, "image_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(r.image_id, r.box_id, *k.recenter_box(np.array([getattr(r, c) for c in cols]), shaped(r), least)) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["image_id", "box_id", *cols]).dropna()

    return both.mapInPandas(run, "image_id long, box_id string, " + ", ".join(f"{c} double" for c in cols))


def reconstruct(volumes: DataFrame, poses: DataFrame, psf: np.ndarray, weight: float = 1e-3, symmetry: int = 1) -> np.ndarray:
    """Least-squares reconstruction of particles with poses. Each task sums its own particles' spectra, so what is merged is one pair of arrays per task.

    The driver gets as many pairs of arrays of one volume's size as there are tasks.
    """
    both = volumes.join(poses, "volume_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        num = den = None
        n, shape = 0, None
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                v, pose = shaped(r), _pose(r)
                for s in range(symmetry):
                    a, b = k.reconstruction_sums(v, psf, pose + [0, 0, s * 360 / symmetry, 0, 0, 0])
                    num, den, n, shape = (a, b, 1, v.shape) if num is None else (num + a, den + b, n + 1, shape)
        if n:
            yield pd.DataFrame({"n": [n], "shape": [list(shape)], "re": [num.real.ravel()], "im": [num.imag.ravel()], "den": [den.ravel()]})

    parts = both.mapInPandas(run, "n long, shape array<int>, re array<double>, im array<double>, den array<double>")
    summed = parts.select("n", "shape", F.posexplode(F.arrays_zip("re", "im", "den")).alias("i", "v")).groupBy("i").agg(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"), F.sum("v.den").alias("den"), F.sum("n").alias("n"), F.first("shape").alias("shape"))
    rows = summed.orderBy("i").toPandas()
    if not len(rows):
        raise ValueError("no particle has a pose")
    shape = tuple(rows["shape"][0])
    return k.reconstruct((rows["re"] + 1j * rows["im"]).to_numpy().reshape(shape), rows["den"].to_numpy().reshape(shape), int(rows["n"][0]), weight)


def match(volumes: DataFrame, reference: np.ndarray, psf: np.ndarray, candidates: DataFrame) -> DataFrame:
    """The best pose of each volume among its candidates (volume_id, rot1, rot2, rot3): volume_id, rot1.., t1.., error.

    Candidates of a volume are dealt out in groups of 64, each group giving its best, and the least error wins (ties: least angles).
    """
    spread = candidates.withColumn("grp", F.pmod(F.xxhash64("rot1", "rot2", "rot3"), F.greatest(F.lit(1), F.ceil(F.count("*").over(_by("volume_id")) / 64))))
    grouped = spread.groupBy("volume_id", "grp").agg(F.sort_array(F.collect_list(F.array("rot1", "rot2", "rot3"))).alias("angles"))
    names = ["rot1", "rot2", "rot3", "t1", "t2", "t3"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(r.volume_id, *pose, error) for r in pdf.itertuples(index=False) for pose, error in [k.match_pose(reference, shaped(r), psf, np.array([list(a) for a in r.angles], float))]]
            yield pd.DataFrame(rows, columns=["volume_id", *names, "error"])

    found = volumes.join(grouped, "volume_id").mapInPandas(run, "volume_id long, " + ", ".join(f"{c} double" for c in [*names, "error"]))
    best = found.groupBy("volume_id").agg(F.min_by(F.struct(*names, "error"), F.struct(F.round("error", 9), "rot1", "rot2", "rot3")).alias("b"))
    return best.select("volume_id", "b.*")


def _by(*cols):
    from pyspark.sql.window import Window

    return Window.partitionBy(*cols)


def refine(volumes: DataFrame, poses: DataFrame, psf: np.ndarray, steps: list[tuple[float, int]], weight: float = 1e-3, symmetry: int = 1) -> tuple[np.ndarray, DataFrame]:
    """Alternate pose search and reconstruction; steps are (range in degrees, poses per angle). Poses are checkpointed after each step, which cuts their lineage."""
    from .geometry import refined_grid

    reference = reconstruct(volumes, poses, psf, weight, symmetry)
    for spread, n in steps:
        grid = refined_grid(poses.select("volume_id", "rot1", "rot2", "rot3"), spread, n).select("volume_id", "rot1", "rot2", "rot3")
        poses = checkpointed(match(volumes, reference, psf, grid).drop("error"))
        reference = reconstruct(volumes, poses, psf, weight, symmetry)
    return reference, poses


def simulate(poses: DataFrame, truth: np.ndarray, sigma: tuple[float, float, float], snr_db: float | None = None, photons: float | None = None, seed: int = 0) -> DataFrame:
    """One seeded particle per pose (volume_id, rot1.., t1..): the true volume moved, blurred, and with Poisson and Gaussian noise if asked for.

    Each particle draws from a generator of (seed, volume_id), so a data set is the same for any partitioning.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            made = []
            for r in pdf.itertuples(index=False):
                rng = np.random.default_rng((seed, int(r.volume_id)))
                v = k.gaussian_blur(k.rotate(truth, _pose(r)), sigma)
                if photons:
                    v = rng.poisson(np.maximum(v, 0) * photons) / photons
                if snr_db is not None:
                    v = v + rng.normal(0, np.sqrt((v * v).mean() / 10 ** (snr_db / 10)), v.shape)
                made.append(v)
            yield pd.DataFrame({"volume_id": pdf["volume_id"], "shape": [list(v.shape) for v in made], "data": [v.ravel() for v in made]})

    return poses.mapInPandas(run, VOLUME)


def smallest_footprint(volume: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """Of candidate poses the one after which the z projection covers the fewest pixels over Otsu's threshold (ties: the first)."""
    sizes = [int((p > k.otsu(p)).sum()) for p in (k.rotate(volume, t).sum(0) for t in turns)]
    return turns[int(np.argmin(sizes))]
