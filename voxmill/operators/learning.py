"""Clustering and small models on point and voxel tables, with Spark ML or grouped kernels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as k


def _vectors(rows: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol="features").transform(rows)


def kmeans(rows: DataFrame, cols: list[str], n: int = 2, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(rows with label, centres)."""
    from pyspark.ml.clustering import KMeans

    v = _vectors(rows, cols)
    model = KMeans(k=n, seed=seed, predictionCol="label").fit(v)
    return model.transform(v).drop("features"), np.array(model.clusterCenters())


def separating_plane(rows: DataFrame, cols: list[str], label: str, weight: str | None = None) -> tuple[np.ndarray, float]:
    """(normal, intercept) of a linear support-vector plane between labels 0 and 1."""
    from pyspark.ml.classification import LinearSVC

    svc = LinearSVC(labelCol=label, maxIter=100, regParam=1e-3)
    model = (svc.setWeightCol(weight) if weight else svc).fit(_vectors(rows, cols))
    return model.coefficients.toArray(), float(model.intercept)


def two_gaussians(rows: DataFrame, col: str, seed: int = 1) -> tuple[float, float]:
    """Ascending means of a mixture of two normal distributions."""
    from pyspark.ml.clustering import GaussianMixture

    model = GaussianMixture(k=2, seed=seed, tol=1e-6, maxIter=500).fit(_vectors(rows, [col]))
    return tuple(sorted(float(g.mean[0]) for g in model.gaussians))


def principal_axes(rows: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(axes as rows, singular values) of points, from one aggregation of their moments."""
    n = len(cols)
    m = rows.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)), *(F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"c{i}_{j}") for i in range(n) for j in range(i + 1))).first()
    mean = np.array([m[f"s{i}"] for i in range(n)]) / m.n
    cov = np.array([[m[f"c{max(i, j)}_{min(i, j)}"] for j in range(n)] for i in range(n)]) - m.n * np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    return vectors.T[::-1], np.sqrt(np.maximum(values[::-1], 0))


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """points (image_id, z, y, x) with cluster: density clusters of each image from 1, noise 0."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x"], kind="stable")
        return pdf.assign(cluster=k.dbscan(pdf[["z", "y", "x"]].to_numpy(float), eps, least))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.groupBy("image_id").applyInPandas(run, schema + ", cluster long")


def density_tree(points: DataFrame, least: int = 5, samples: int | None = None) -> DataFrame:
    """points (image_id, z, y, x) with cluster: hierarchical density clusters of each image from 1, noise 0. One image's points are held by one task, with their distances."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "y", "x"], kind="stable")
        return pdf.assign(cluster=k.density_tree(pdf[["z", "y", "x"]].to_numpy(float), least, samples))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.groupBy("image_id").applyInPandas(run, schema + ", cluster long")


def separate(volumes: DataFrame, share: float = 0.5) -> DataFrame:
    """(volume_id, part, z, y, x, v): voxels over a share of the greatest, split in two by k-means on their places (deterministic start: the two farthest along the main axis)."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                v = np.asarray(r.data, float).reshape([int(n) for n in r.shape])
                at = np.argwhere(v > share * v.max())
                if not len(at):
                    continue
                c = at - at.mean(0)
                along = c @ np.linalg.svd(c, full_matrices=False)[2][0]
                centers = at[[along.argmin(), along.argmax()]].astype(float)
                for _ in range(50):
                    part = ((at[:, None] - centers) ** 2).sum(2).argmin(1)
                    new = np.array([at[part == i].mean(0) if (part == i).any() else centers[i] for i in (0, 1)])
                    if np.allclose(new, centers):
                        break
                    centers = new
                rows += [(r.volume_id, int(p), *map(int, a), float(v[tuple(a)])) for p, a in zip(part, at, strict=True)]
            yield pd.DataFrame(rows, columns=["volume_id", "part", "z", "y", "x", "v"])

    return volumes.select("volume_id", "shape", "data").mapInPandas(run, "volume_id long, part int, z int, y int, x int, v double")
