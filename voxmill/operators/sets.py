"""Operations on sets of images, particles and coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window as W


def scan(rows: DataFrame, where: Column | None = None, order: list[Column] | None = None, limit: int | None = None) -> DataFrame:
    """Filter, sort, limit; sorting with a limit is a distributed top-k."""
    out = rows if where is None else rows.filter(where)
    out = out.orderBy(*order) if order else out
    return out if limit is None else out.limit(limit)


def summary(images: DataFrame) -> DataFrame:
    """One row for the set: size and what all images share; null for a property in which they differ."""
    one = lambda c: F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)).alias(c)
    return images.agg(F.count("*").alias("n"), *(one(c) for c in ("voxel_xy", "voxel_z", "dim_x", "dim_y", "dim_z", "n_channels")))


def largest_extent(images: DataFrame) -> DataFrame:
    return images.agg(F.max(F.greatest(F.col("dim_x") * F.col("voxel_xy"), F.col("dim_y") * F.col("voxel_xy"), F.col("dim_z") * F.col("voxel_z"))).alias("extent"))


def downsample(images: DataFrame, factor: float) -> DataFrame:
    return images.withColumns({"voxel_xy": F.col("voxel_xy") * factor, "voxel_z": F.col("voxel_z") * factor})


def box_sizes(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """Largest and smallest box of a set in pixels: size divided by voxel size, in the plane and in depth."""
    b = boxes.join(images.select("image_id", "voxel_xy", "voxel_z"), "image_id")
    w, h, d = ((F.col(f"{a}2") - F.col(f"{a}1")) for a in "xyz")
    return b.agg(F.max(F.greatest(w / F.col("voxel_xy"), h / F.col("voxel_xy"))).alias("max_xy"), F.max(d / F.col("voxel_z")).alias("max_z"), F.min(F.least(w / F.col("voxel_xy"), h / F.col("voxel_xy"))).alias("min_xy"), F.min(d / F.col("voxel_z")).alias("min_z"))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "position") -> DataFrame:
    """rows with their position (from 0) within the groups of `by`."""
    return rows.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)


def zip_positions(a: DataFrame, b: DataFrame, by: list[str], order_a: list[str], order_b: list[str]) -> DataFrame:
    """Positional zip within groups: the k-th row of a with the k-th of b; rows without a partner go."""
    return numbered(a, by, order_a).join(numbered(b, by, order_b), [*by, "position"])


def pick(rows: DataFrame, positions: DataFrame, order: list[str], by: list[str], complement: bool = False) -> DataFrame:
    """Rows whose position in their group is (or is not) listed in positions (position)."""
    return numbered(rows, by, order).join(positions, "position", "left_anti" if complement else "left_semi")


def attach_poses(particles: DataFrame, poses: DataFrame) -> DataFrame:
    """particles (name: *.ome.tiff) joined with poses (name: *.tiff) by base name."""
    base = lambda c: F.regexp_replace(F.regexp_extract(c, "([^/]*)$", 1), "(\\.ome)?\\.tiff?$", "")
    return particles.withColumn("base", base("name")).join(poses.withColumn("base", base("name")).drop("name"), "base").drop("base")


def split_name(path: Column) -> dict[str, Column]:
    """folder, stem and extension of a path; .ome.tif and .ome.tiff are one extension."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    ext = F.regexp_extract(name, "((\\.ome\\.tiff?)|(\\.[^.]*))$", 1)
    return {"folder": F.regexp_extract(path, "^(.*)/[^/]*$", 1), "stem": F.substring(name, F.lit(1), F.length(name) - F.length(ext)), "ext": ext}


def unique_names(paths: DataFrame) -> DataFrame:
    """paths (path) with target: the base name, or for base names that repeat the path with its slashes folded to underscores."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    counted = paths.withColumn("name", name)
    repeated = counted.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name", F.lit(True).alias("again"))
    out = counted.join(repeated, "name", "left")
    return out.select("path", F.when(F.col("again"), F.regexp_replace(F.regexp_replace("path", "^/", ""), "/", "_")).otherwise(F.col("name")).alias("target"))


def pattern_regex(pattern: str) -> str:
    """Regular expression of a file pattern: *, ? and runs of #, which capture a numeric id."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "#":
            n = len(pattern[i:]) - len(pattern[i:].lstrip("#"))
            out.append(f"([0-9]{{{n}}})")
            i += n
            continue
        out.append({"*": "[^/]*", "?": "[^/]"}.get(ch) or (ch if ch.isalnum() or ch in "/_-" else "\\" + ch))
        i += 1
    return "^" + "".join(out) + "$"


def match_files(paths: DataFrame, pattern: str, blacklist: DataFrame | None = None) -> DataFrame:
    """(path, file_id) of the paths that match and aren't in blacklist (path); file_id is null without a # run."""
    r = pattern_regex(pattern)
    paths = paths if blacklist is None else paths.join(blacklist.select("path"), "path", "left_anti")
    number = F.regexp_extract("path", r, 1).cast("long") if "#" in pattern else F.lit(None).cast("long")
    return paths.filter(F.col("path").rlike(r)).withColumn("file_id", number)


def latest_epoch(paths: DataFrame, *regexes: str) -> DataFrame:
    """The path with the largest number captured by the first regex, then by the others (ties: the last name); paths without the first number don't count."""
    n = [F.regexp_extract("path", r, 1) for r in regexes]
    return paths.filter(n[0] != "").agg(F.max_by("path", F.struct(*(F.when(k != "", k).cast("long").alias(f"n{i}") for i, k in enumerate(n)), F.col("path"))).alias("path"))


def copy_items(items: DataFrame, data: DataFrame, order_items: list[str], order_data: list[str], update: dict[str, Column], keep: Column | None = None) -> DataFrame:
    """Enabled items, the k-th with the k-th row of data, columns updated; rows for which keep is false go. Positions are within the set `set_id` of both."""
    out = zip_positions(items.filter("enabled"), data, ["set_id"], order_items, order_data).withColumns(update)
    return out if keep is None else out.filter(keep)


def store(rows: DataFrame, path: str, parents: list[str], kind: str, lineage: str) -> None:
    """Write a set and append its lineage edges (parent, child, kind) to the table at `lineage`."""
    rows.write.mode("overwrite").parquet(path)
    spark = rows.sparkSession
    spark.createDataFrame([(p, path, kind) for p in parents], "parent string, child string, kind string").write.mode("append").parquet(lineage)


def consistent(items: DataFrame, column: str) -> Column:
    """Whether all items of a set share a value, as an aggregate."""
    return F.count_distinct(column) <= 1


def one_psf(images: DataFrame) -> DataFrame:
    """images if they name one point spread function at most; a run that meets another fails."""
    told = images.agg(F.count_distinct("psf_id").alias("n"))
    check = told.select(F.assert_true(F.col("n") <= 1, F.lit("a set has one point spread function at most")).alias("ok"))
    return images.join(F.broadcast(check.select(F.coalesce(F.col("ok").isNull(), F.lit(True)).alias("__ok"))), F.col("__ok")).drop("__ok")


def flattened(rows: DataFrame, sep: str = "_") -> DataFrame:
    """rows with every struct in them, however deep, as columns named by their path."""

    def leaves(kind: StructType, at: Column | None, name: str) -> list[Column]:
        out = []
        for f in kind.fields:
            here = F.col(f"`{f.name}`") if at is None else at.getField(f.name)
            path = f"{name}{sep}{f.name}" if name else f.name
            out += leaves(f.dataType, here, path) if isinstance(f.dataType, StructType) else [here.alias(path)]
        return out

    return rows.select(*leaves(rows.schema, None, ""))


def told(rows: dict[str, object], title: str) -> str:
    """A boxed report of names and values."""
    wide = max(map(len, rows), default=0)
    lines = [f"{k.ljust(wide)} : {v}" for k, v in rows.items()]
    size = max([len(title), *map(len, lines)])
    bar = "+" + "-" * (size + 2) + "+"
    return "\n".join([bar, f"| {title.center(size)} |", bar, *(f"| {x.ljust(size)} |" for x in lines), bar])
