"""Image, box, pose, volume and time-ordered tables derived from the driver's tables, as DataFrames and as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: DuckDB CTEs by fixture name; SQL for a query starts with with_(...).
CTE = {
    "image": """image as (select s_suppkey as image_id, s_nationkey as nation_id, cast(0.1 as double) * (1 + s_nationkey % 3) as voxel_xy, cast(0.3 as double) as voxel_z,
        113 as dim_x, 105 as dim_y, 29 as dim_z, 1 + s_suppkey % 2 as n_channels, s_acctbal > 0 as enabled, s_acctbal as balance from supplier)""",
    "item": """item as (select concat_ws('-', lpad(l_orderkey::varchar, 12, '0'), lpad(l_linenumber::varchar, 3, '0'), lpad(l_partkey::varchar, 10, '0'), lpad(l_suppkey::varchar, 10, '0')) as box_id,
        l_suppkey as image_id, l_partkey * 7 % 97 as x1, l_orderkey * 5 % 89 as y1, l_linenumber * 11 % 13 as z1, 8 + cast(floor(l_quantity) as bigint) % 8 as e,
        cast(l_extendedprice as double) as score, l_returnflag as flag, l_partkey as part from lineitem)""",
    "pred": "pred as (select box_id, image_id, x1, y1, z1, x1 + e as x2, y1 + e as y2, z1 + e as z2, score from item where flag = 'R')",
    "truth": """truth as (select box_id, image_id, x1 + 1 as x1, y1 + 1 as y1, z1, x1 + 1 + e as x2, y1 + 1 + e as y2, z1 + e as z2 from item where flag = 'R' and part % 3 <> 0
        union all select box_id, image_id, x1, y1, z1, x1 + e, y1 + e, z1 + e from item where flag = 'A' and part % 5 = 0)""",
    "pose": """pose as (select p_partkey as pose_id, 'particles/' || p_partkey || '.tiff' as name, cast(p_partkey * 37 % 360 as double) as rot1, cast(5 + p_size * 3 % 170 as double) as rot2,
        cast(p_partkey * 11 % 360 as double) as rot3, cast(p_size % 7 - 3 as double) as t1, cast(p_size % 5 - 2 as double) as t2, cast(p_size % 3 - 1 as double) as t3 from part)""",
    "voxel": """voxel as (select vec_id as volume_id, label, cast(i // 16 as bigint) as z, cast((i // 4) % 4 as bigint) as y, cast(i % 4 as bigint) as x, cast(embedding[i + 1] as double) as v
        from embeddings, (select unnest(range(64)) as i))""",
    "view": "view_ as (select doc_id, quality, toxic, quality + toxic as truth, quality as guess from labels)",
    "energy": "energy as (select date_diff('day', date '2024-01-01', cast(ts as date)) as epoch, user_id as view_id, avg(value) as energy from events group by all)",
    "path": """path as (select '/data/day' || lpad(l_suppkey::varchar, 3, '0') || '/img_' || l_orderkey || '_' || lpad(l_linenumber::varchar, 2, '0') || '.ome.tiff' as path,
        l_suppkey as day, l_orderkey as num, l_linenumber as line from lineitem)""",
}
_NEEDS = {"pred": ["item"], "truth": ["item"]}


def with_(*names: str) -> str:
    """WITH clause (recursive, so that a query can go on with its own) of the named fixtures and what they need."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "with recursive " + ",\n".join(CTE[n] for n in order)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("image_id"), F.col("s_nationkey").alias("nation_id"), (0.1 * (1 + F.col("s_nationkey") % 3)).alias("voxel_xy"), F.lit(0.3).alias("voxel_z"),
        F.lit(113).alias("dim_x"), F.lit(105).alias("dim_y"), F.lit(29).alias("dim_z"), (1 + F.col("s_suppkey") % 2).alias("n_channels"), (F.col("s_acctbal") > 0).alias("enabled"), F.col("s_acctbal").alias("balance"))


def _item(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    pad = lambda c, n: F.lpad(F.col(c).cast("string"), n, "0")
    return t.select(F.concat_ws("-", pad("l_orderkey", 12), pad("l_linenumber", 3), pad("l_partkey", 10), pad("l_suppkey", 10)).alias("box_id"), F.col("l_suppkey").alias("image_id"),
        (F.col("l_partkey") * 7 % 97).alias("x1"), (F.col("l_orderkey") * 5 % 89).alias("y1"), (F.col("l_linenumber") * 11 % 13).alias("z1"), (8 + F.floor("l_quantity") % 8).alias("e"),
        F.col("l_extendedprice").cast("double").alias("score"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").alias("part"))


def _boxes(items: DataFrame, shift: int = 0, *more: str) -> DataFrame:
    return items.select("box_id", "image_id", (F.col("x1") + shift).alias("x1"), (F.col("y1") + shift).alias("y1"), "z1", (F.col("x1") + shift + F.col("e")).alias("x2"), (F.col("y1") + shift + F.col("e")).alias("y2"), (F.col("z1") + F.col("e")).alias("z2"), *more)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(_item(spark, sf_dir).filter("flag = 'R'"), 0, "score")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = _item(spark, sf_dir)
    return _boxes(item.filter("flag = 'R' and part % 3 <> 0"), 1).unionByName(_boxes(item.filter("flag = 'A' and part % 5 = 0")))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, s = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    number = {"rot1": k * 37 % 360, "rot2": 5 + s * 3 % 170, "rot3": k * 11 % 360, "t1": s % 7 - 3, "t2": s % 5 - 2, "t3": s % 3 - 1}
    return p.select(k.alias("pose_id"), F.concat(F.lit("particles/"), k.cast("string"), F.lit(".tiff")).alias("name"), *(v.cast("double").alias(c) for c, v in number.items()))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(volume_id, label, data: array of 64 doubles), 4 x 4 x 4 in z, y, x order."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("volume_id"), "label", F.col("embedding").cast("array<double>").alias("data"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", (F.col("quality") + F.col("toxic")).alias("truth"), F.col("quality").alias("guess"))


def mean(value: str) -> Column:
    """The mean of doubles, the same in any order of rows: where all have at most six decimals, sum and mean are decimal, so that equal means are equal doubles."""
    exact = F.col(value).try_cast("decimal(18,6)")
    fits = F.bool_and(exact.cast("double").eqNullSafe(F.col(value)))
    return F.when(fits, (F.sum(exact) / F.nullif(F.count(value), F.lit(0))).cast("double")).otherwise(F.avg(value))


def energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long").alias("epoch"), F.col("user_id").alias("view_id")).agg(mean("value").alias("energy"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem")
    text = F.concat(F.lit("/data/day"), F.lpad(F.col("l_suppkey").cast("string"), 3, "0"), F.lit("/img_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), F.lit(".ome.tiff"))
    return t.select(text.alias("path"), F.col("l_suppkey").alias("day"), F.col("l_orderkey").alias("num"), F.col("l_linenumber").alias("line"))
