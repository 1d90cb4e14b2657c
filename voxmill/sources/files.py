"""Interchange files: poses, annotations, bounding boxes, ROI markup, registries and TIFF headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSES = "name string, rot1 double, rot2 double, rot3 double, t1 double, t2 double, t3 double"
ANNOTATIONS = "image string, particle_id string, z double, y double, x double"
ANGLES = "image string, particle_id string, a1 double, a2 double, a3 double"
VIEWS = "image string, particle_id string, label int"
BOXES = "index string, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double"

#: Micrometres per unit.
MICROMETRES = {
    "m": 1e6, "meter": 1e6, "dm": 1e5, "decimeter": 1e5, "cm": 1e4, "centimeter": 1e4, "mm": 1e3, "millimeter": 1e3,
    "um": 1.0, "µm": 1.0, "micron": 1.0, "micrometer": 1.0, "nm": 1e-3, "nanometer": 1e-3, "pm": 1e-6, "picometer": 1e-6,
    "inch": 25400.0, "in": 25400.0,
}


def read_table(spark: SparkSession, path: str, schema: str, header: bool = False) -> DataFrame:
    """A comma-separated file of a fixed schema."""
    return spark.read.csv(path, schema=schema, header=header)


def read_poses(spark: SparkSession, path: str, ordered: bool = True) -> DataFrame:
    poses = read_table(spark, path, POSES, header=True)
    return poses.orderBy("name") if ordered else poses


def write_poses(poses: DataFrame, path: str) -> None:
    poses.select("name", "rot1", "rot2", "rot3", "t1", "t2", "t3").write.mode("overwrite").csv(path, header=True)


def boxes_to_centers(boxes: DataFrame) -> DataFrame:
    """Corners (x1, y1, z1, x2, y2, z2) to centre and size."""
    return boxes.select("index", *(((F.col(f"{a}1") + F.col(f"{a}2")) / 2).alias(a) for a in "xyz"), *((F.col(f"{a}2") - F.col(f"{a}1")).alias(f"size_{a}") for a in "xyz"))


def centers_to_boxes(rows: DataFrame) -> DataFrame:
    return rows.select("index", *((F.col(a) - F.col(f"size_{a}") / 2).alias(f"{a}1") for a in "xyz"), *((F.col(a) + F.col(f"size_{a}") / 2).alias(f"{a}2") for a in "xyz"))


def read_markups(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y, z, size) of JSON files with markups[0].center and .size; size is the greatest of the three."""
    rows = spark.read.json(path, schema="markups array<struct<center: array<double>, size: array<double>>>", multiLine=True)
    m = F.col("markups")[0]
    return rows.select(F.col("_metadata.file_path").alias("path"), *(m["center"][i].alias(a) for i, a in enumerate("xyz")), F.array_max(m["size"]).alias("size"))


def patch_names(views: DataFrame) -> DataFrame:
    """views with patch: stem_id.ext of the image."""
    stem, ext = F.regexp_extract("image", "^(.*?)(\\.[^.]*)?$", 1), F.regexp_extract("image", "(\\.[^.]*)$", 1)
    return views.withColumn("patch", F.concat(stem, F.lit("_"), "particle_id", ext))


def registry(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def stale(found: DataFrame, known: DataFrame) -> DataFrame:
    """Registered files (path, sha256) that are missing or differ."""
    return known.join(found.select("path", "sha256"), ["path", "sha256"], "left_anti")


def tiff_header(content: bytes) -> dict:
    """Width, height, pages, bits, description and resolution (per unit) of a classic TIFF; None where it is not one."""
    out: dict = {"width": None, "height": None, "pages": None, "bits": None, "description": None, "x_resolution": None, "unit": None}
    order = {b"II": "<", b"MM": ">"}.get(bytes(content[:2]))
    if order is None or len(content) < 8 or struct.unpack(order + "H", content[2:4])[0] != 42:
        return out
    (at,) = struct.unpack(order + "I", content[4:8])
    pages, seen = 0, set()
    while at and at not in seen and at + 2 <= len(content):
        seen.add(at)
        (n,) = struct.unpack(order + "H", content[at : at + 2])
        if pages == 0:
            for i in range(n):
                e = at + 2 + 12 * i
                tag, kind, count = struct.unpack(order + "HHI", content[e : e + 8])
                raw = content[e + 8 : e + 12]
                value = struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
                if tag == 256:
                    out["width"] = value
                elif tag == 257:
                    out["height"] = value
                elif tag == 258 and count == 1:
                    out["bits"] = value
                elif tag == 270:
                    text = content[value : value + count] if count > 4 else raw[:count]
                    out["description"] = text.rstrip(b"\0").decode("utf-8", "replace")
                elif tag == 282:
                    a, b = struct.unpack(order + "II", content[value : value + 8])
                    out["x_resolution"] = a / b if b else None
                elif tag == 296:
                    out["unit"] = {2: "inch", 3: "cm"}.get(value)
        pages += 1
        (at,) = struct.unpack(order + "I", content[at + 2 + 12 * n : at + 6 + 12 * n])
    out["pages"] = pages
    return out


def image_metadata(spark: SparkSession, path: str, pattern: str = "*.tif*") -> DataFrame:
    """(path, width, height, pages, bits, description, voxel_xy in micrometres) of TIFF files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                h = tiff_header(r.content)
                voxel = MICROMETRES[h["unit"]] / h["x_resolution"] if h["unit"] and h["x_resolution"] else None
                rows.append((r.path, h["width"], h["height"], h["pages"], h["bits"], h["description"], voxel))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "pages", "bits", "description", "voxel_xy"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.mapInPandas(run, "path string, width int, height int, pages int, bits int, description string, voxel_xy double")
