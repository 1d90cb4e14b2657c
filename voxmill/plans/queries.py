"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import detection as det
from ..operators import geometry as geo
from ..operators import metrics as met
from ..operators import sets
from ..operators import voxels as vox
from ..sources import fixtures as fx
from ..sources.fixtures import with_

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def query(sql: str | None = None, *fixtures: str):
    """Register a query under its function's name; sql goes on after the WITH clause of the fixtures."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = f"{with_(*fixtures)}\n{sql}" if fixtures else sql
        return f

    return add


def r6(c: Column | str) -> Column:
    """Six decimals, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def _voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vox.voxels(fx.volumes(spark, sf_dir))


# ---- sets -------------------------------------------------------------------------------------------------------------


@query("select image_id, balance from image where enabled order by balance desc, image_id limit 10", "image")
def rel_scan_filter_sort_limit(spark, d):
    return sets.scan(fx.image(spark, d), F.col("enabled"), [F.desc("balance"), F.col("image_id")], 10).select("image_id", "balance")


@query("select image_id, count(*) as n from pred group by image_id", "pred")
def rel_group_count(spark, d):
    return fx.predictions(spark, d).groupBy("image_id").agg(F.count("*").alias("n"))


@query("select count(distinct image_id) as n from pred", "pred")
def rel_distinct_images(spark, d):
    return fx.predictions(spark, d).agg(F.count_distinct("image_id").alias("n"))


@query("select image_id, max(score) as top from pred group by image_id", "pred")
def rel_group_max(spark, d):
    return fx.predictions(spark, d).groupBy("image_id").agg(F.max("score").alias("top"))


@query("select box_id, x1, y1, z1 from pred where image_id = 7", "pred")
def rel_lookup_by_image(spark, d):
    return fx.predictions(spark, d).filter("image_id = 7").select("box_id", "x1", "y1", "z1")


@query("select box_id, image_id, voxel_xy, n_channels from pred join image using (image_id)", "pred", "image")
def rel_relink(spark, d):
    return fx.predictions(spark, d).join(fx.image(spark, d), "image_id").select("box_id", "image_id", "voxel_xy", "n_channels")


@query("select i.image_id, count(b.box_id) as n from image i left join pred b using (image_id) group by i.image_id", "pred", "image")
def rel_left_relink(spark, d):
    return fx.image(spark, d).join(fx.predictions(spark, d), "image_id", "left").groupBy("image_id").agg(F.count("box_id").alias("n"))


@query("select image_id, dim_x, dim_y, dim_z from image order by image_id limit 1", "image")
def rel_first_item(spark, d):
    return sets.scan(fx.image(spark, d), None, [F.col("image_id")], 1).select("image_id", "dim_x", "dim_y", "dim_z")


@query(
    """select count(*) as n, case when min(voxel_xy) = max(voxel_xy) then min(voxel_xy) end as voxel_xy, case when min(voxel_z) = max(voxel_z) then min(voxel_z) end as voxel_z,
    case when min(dim_x) = max(dim_x) then min(dim_x) end as dim_x, case when min(dim_y) = max(dim_y) then min(dim_y) end as dim_y, case when min(dim_z) = max(dim_z) then min(dim_z) end as dim_z,
    case when min(n_channels) = max(n_channels) then min(n_channels) end as n_channels from image""",
    "image",
)
def rel_set_summary(spark, d):
    return sets.summary(fx.image(spark, d))


@query("select round(max(greatest(dim_x * voxel_xy, dim_y * voxel_xy, dim_z * voxel_z)), 6) as extent from image", "image")
def rel_largest_extent(spark, d):
    return sets.largest_extent(fx.image(spark, d)).select(r6("extent").alias("extent"))


@query("select image_id, round(voxel_xy * 2, 6) as voxel_xy, round(voxel_z * 2, 6) as voxel_z from image", "image")
def rel_downsample(spark, d):
    return sets.downsample(fx.image(spark, d), 2.0).select("image_id", r6("voxel_xy").alias("voxel_xy"), r6("voxel_z").alias("voxel_z"))


@query(
    """select round(max(greatest(x2 - x1, y2 - y1) / voxel_xy), 6) as max_xy, round(max((z2 - z1) / voxel_z), 6) as max_z,
    round(min(least(x2 - x1, y2 - y1) / voxel_xy), 6) as min_xy, round(min((z2 - z1) / voxel_z), 6) as min_z from pred join image using (image_id)""",
    "pred",
    "image",
)
def rel_box_sizes(spark, d):
    return sets.box_sizes(fx.predictions(spark, d), fx.image(spark, d)).select(*(r6(c).alias(c) for c in ("max_xy", "max_z", "min_xy", "min_z")))


@query(
    """, p as (select *, row_number() over (partition by image_id order by box_id) - 1 as position from pred), t as (select *, row_number() over (partition by image_id order by box_id) - 1 as position from truth)
    select p.image_id, p.position, p.box_id as pred_id, t.box_id as truth_id from p join t using (image_id, position)""",
    "pred",
    "truth",
)
def rel_positional_zip(spark, d):
    a = fx.predictions(spark, d).select("image_id", F.col("box_id").alias("pred_id"))
    b = fx.truths(spark, d).select("image_id", F.col("box_id").alias("truth_id"))
    return sets.zip_positions(a, b, ["image_id"], ["pred_id"], ["truth_id"]).select("image_id", F.col("position").cast("long").alias("position"), "pred_id", "truth_id")


@query("select image_id, box_id from (select *, row_number() over (partition by image_id order by box_id) - 1 as k from pred) where k in (0, 3, 5)", "pred")
def rel_select_positions(spark, d):
    wanted = spark.createDataFrame([(0,), (3,), (5,)], "position int")
    return sets.pick(fx.predictions(spark, d), wanted, ["box_id"], ["image_id"]).select("image_id", "box_id")


@query("select image_id, box_id from (select *, row_number() over (partition by image_id order by box_id) - 1 as k from pred) where k not in (0, 3, 5)", "pred")
def rel_delete_positions(spark, d):
    wanted = spark.createDataFrame([(0,), (3,), (5,)], "position int")
    return sets.pick(fx.predictions(spark, d), wanted, ["box_id"], ["image_id"], complement=True).select("image_id", "box_id")


@query("select s_suppkey as particle_id, rot1, t1 from supplier join pose on pose_id = s_suppkey", "pose")
def rel_attach_poses(spark, d):
    particles = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("particle_id"), F.concat(F.lit("/set/"), F.col("s_suppkey").cast("string"), F.lit(".ome.tiff")).alias("name"))
    return sets.attach_poses(particles, fx.poses(spark, d)).select("particle_id", "rot1", "t1")


@query("select s_suppkey as particle_id from supplier where s_suppkey not in (select pose_id from pose where pose_id % 3 = 0)", "pose")
def rel_unmatched_particles(spark, d):
    p = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("particle_id"))
    return p.join(fx.poses(spark, d).filter("pose_id % 3 = 0").select(F.col("pose_id").alias("particle_id")), "particle_id", "left_anti")


@query("select image_id from image where enabled union all select image_id + 100000 from image where enabled", "image")
def rel_append_enabled(spark, d):
    on = fx.image(spark, d).filter("enabled").select("image_id")
    return on.unionByName(on.select((F.col("image_id") + 100000).alias("image_id")))


@query(
    "select r_name as kind, n_name as class, c_custkey as item from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey where n_nationkey % 4 <> 0 and c_acctbal > 0"
)
def rel_append_classes(spark, d):
    r, n, c = (fx.table(spark, d, t) for t in ("region", "nation", "customer"))
    classes = n.join(r, n.n_regionkey == r.r_regionkey).filter("n_nationkey % 4 <> 0")
    return c.filter("c_acctbal > 0").join(classes, c.c_nationkey == classes.n_nationkey).select(F.col("r_name").alias("kind"), F.col("n_name").alias("class"), F.col("c_custkey").alias("item"))


@query("select image_id, box_id, cast(round_even((x1 + x2) / 2.0 * 1.5, 0) as bigint) as x, cast(round_even((y1 + y2) / 2.0 * 1.5, 0) as bigint) as y, cast(round_even((z1 + z2) / 2.0 * 1.5, 0) as bigint) as z from pred", "pred")
def rel_export_centers(spark, d):
    return fx.predictions(spark, d).select("image_id", "box_id", *(F.rint((F.col(f"{a}1") + F.col(f"{a}2")) / 2.0 * 1.5).cast("long").alias(a) for a in "xyz"))


@query("select box_id, round((x1 + x2) / 2.0 * voxel_xy, 6) as x, round((y1 + y2) / 2.0 * voxel_xy, 6) as y, round((z1 + z2) / 2.0 * voxel_z, 6) as z from pred join image using (image_id)", "pred", "image")
def rel_world_coordinates(spark, d):
    b = fx.predictions(spark, d).join(fx.image(spark, d).select("image_id", "voxel_xy", "voxel_z"), "image_id")
    return b.select("box_id", *(r6((F.col(f"{a}1") + F.col(f"{a}2")) / 2.0 * F.col("voxel_z" if a == "z" else "voxel_xy")).alias(a) for a in "xyz"))


@query("select distinct path, '/data/day' || lpad(day::varchar, 3, '0') as folder, 'img_' || num || '_' || lpad(line::varchar, 2, '0') as stem, '.ome.tiff' as ext from path", "path")
def src_split_names(spark, d):
    return fx.paths(spark, d).select("path").distinct().select("path", *(c.alias(k) for k, c in sets.split_name(F.col("path")).items()))


@query("select distinct path, num as file_id from path where num >= 100 and num < 1000", "path")
def src_pattern_match(spark, d):
    return sets.match_files(fx.paths(spark, d).select("path").distinct(), "/data/*/img_###_*.ome.tiff")


@query(
    """, u as (select distinct path, 'img_' || num || '_' || lpad(line::varchar, 2, '0') || '.ome.tiff' as name from path)
    select path, case when count(*) over (partition by name) > 1 then replace(ltrim(path, '/'), '/', '_') else name end as target from u""",
    "path",
)
def src_unique_names(spark, d):
    return sets.unique_names(fx.paths(spark, d).select("path").distinct())


@query("select max_by(path, num * 1000000 + line * 1000 + day) as path from (select distinct path, num, line, day from path) where num = (select max(num) from path) and line = (select max(line) from path where num = (select max(num) from path))", "path")
def src_latest_epoch(spark, d):
    return sets.latest_epoch(fx.paths(spark, d).select("path").distinct(), "img_([0-9]+)_", "_([0-9]+)\\.ome")


@query("select path, cast(regexp_extract(path, '_([0-9]+)\\.ome', 1) as integer) as tail, row_number() over (partition by regexp_extract(path, '^(.*)_', 1) order by cast(regexp_extract(path, '_([0-9]+)\\.ome', 1) as integer)) - 1 as k from (select distinct path from path)", "path")
def rel_trailing_integer_rank(spark, d):
    p = fx.paths(spark, d).select("path").distinct().withColumns({"tail": F.regexp_extract("path", "_([0-9]+)\\.ome", 1).cast("int"), "stem": F.regexp_extract("path", "^(.*)_", 1)})
    return sets.numbered(p, ["stem"], ["tail"], "k").select("path", "tail", F.col("k").cast("long").alias("k"))


@query("select distinct round(voxel_xy, 6) as size from image", "image")
def misc_voxel_sizes(spark, d):
    return fx.image(spark, d).select(F.round("voxel_xy", 6).alias("size")).distinct()


# ---- boxes ------------------------------------------------------------------------------------------------------------

_IOU = """(greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1)) * greatest(0, least(p.z2, q.z2) - greatest(p.z1, q.z1)))"""
_PAIRS = f""", pairs as (select image_id, p_id, q_id, i / (vp + vq - i) as iou from (select p.image_id, p.box_id as p_id, q.box_id as q_id, cast({_IOU} as double) as i,
    (p.x2 - p.x1) * (p.y2 - p.y1) * (p.z2 - p.z1) as vp, (q.x2 - q.x1) * (q.y2 - q.y1) * (q.z2 - q.z1) as vq from pred p join truth q using (image_id)) where i > 0)"""
_COUNTS = (
    _PAIRS
    + """, c as (select image_id, 0 as tp, case when coalesce(best, 0) < 0.2 then 1 else 0 end as fp, 0 as fn from pred left join (select p_id as box_id, max(iou) as best from pairs group by 1) using (box_id)
    union all select image_id, case when coalesce(best, 0) > 0.2 then 1 else 0 end, 0, case when coalesce(best, 0) > 0.2 then 0 else 1 end
    from truth left join (select image_id, q_id as box_id, max(iou) as best from pairs group by all) using (image_id, box_id)),
    counts as (select image_id, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from c group by image_id),
    m as (select *, tp / (tp + fp + 1e-20) as precision, tp / (tp + fn + 1e-20) as recall from counts)"""
)


@query("select image_id, box_id, " + ", ".join(f"{a}1 + ({a}2 - {a}1) // 2 - ({a}2 - {a}1) // 2 as {a}1, {a}1 + ({a}2 - {a}1) // 2 - ({a}2 - {a}1) // 2 + ({a}2 - {a}1) as {a}2" for a in "xyz") + " from pred", "pred")
def det_center_to_corners(spark, d):
    b = fx.predictions(spark, d)
    size = {a: F.col(f"{a}2") - F.col(f"{a}1") for a in "xyz"}
    box = det.corners({a: F.col(f"{a}1") + F.floor(size[a] / 2) for a in "xyz"}, size)
    return b.select("image_id", "box_id", *(c.alias(k) for k, c in box.items()))


@query(_PAIRS + " select image_id, p_id as pred_id, q_id as truth_id, round(iou, 6) as iou from pairs", "pred", "truth")
def det_iou_join(spark, d):
    return det.overlap_join(fx.predictions(spark, d), fx.truths(spark, d)).select("image_id", F.col("p_box_id").alias("pred_id"), F.col("q_box_id").alias("truth_id"), r6("iou").alias("iou"))


@query(_COUNTS + " select image_id, tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(2 * precision * recall / (precision + recall + 1e-20), 6) as f1 from m", "pred", "truth")
def eval_pr_counts(spark, d):
    c = det.match_counts(fx.predictions(spark, d), fx.truths(spark, d))
    return c.select("image_id", "tp", "fp", "fn", *(r6(v).alias(k) for k, v in det.scores().items()))


@query(_COUNTS + " select round(avg(precision), 6) as precision, round(avg(recall), 6) as recall, round(avg(2 * precision * recall / (precision + recall + 1e-20)), 6) as f1 from m", "pred", "truth")
def eval_picking_mean(spark, d):
    c = det.match_counts(fx.predictions(spark, d), fx.truths(spark, d)).withColumns(det.scores())
    return c.agg(*(r6(F.avg(k)).alias(k) for k in ("precision", "recall", "f1")))


_STRUCT = "{'box_id': b.box_id, 'x1': b.x1, 'y1': b.y1, 'z1': b.z1, 'x2': b.x2, 'y2': b.y2, 'z2': b.z2}"
_LIST_IOU = _IOU.replace("p.", "k.").replace("q.", "b.")


def _kept(order: str, threshold: float) -> str:
    over = f"{_LIST_IOU} > {threshold} * ((k.x2 - k.x1) * (k.y2 - k.y1) * (k.z2 - k.z1) + (b.x2 - b.x1) * (b.y2 - b.y1) * (b.z2 - b.z1) - {_LIST_IOU})"
    return f""", ranked as (select *, row_number() over (partition by image_id order by {order}) as r from pred),
    walk as (select image_id, r, [{_STRUCT}] as kept from ranked b where r = 1 union all
        select b.image_id, b.r, case when len(list_filter(w.kept, lambda k: {over})) = 0 then list_append(w.kept, {_STRUCT}) else w.kept end
        from walk w join ranked b on b.image_id = w.image_id and b.r = w.r + 1),
    kept as (select image_id, unnest(kept) as k from (select image_id, max_by(kept, r) as kept from walk group by image_id))"""


@query(_kept("score desc, box_id", 0.2) + " select image_id, k.box_id as box_id from kept", "pred")
def det_nms(spark, d):
    return det.suppress(fx.predictions(spark, d), 0.2).select("image_id", "box_id")


@query(
    _kept("box_id", 0.0)
    + f""", g as (select b.image_id, b.box_id, b.x1, b.y1, b.z1, b.x2, b.y2, b.z2, min(k.box_id) as group_id from pred b join (select image_id, unnest(k) from kept) k on k.image_id = b.image_id where {_LIST_IOU} > 0 or k.box_id = b.box_id group by all)
    select image_id, group_id, count(*) as n, {", ".join(f"round(avg({c}), 6) as {c}" for c in ("x1", "y1", "z1", "x2", "y2", "z2"))} from g group by image_id, group_id""",
    "pred",
)
def det_star_groups(spark, d):
    g = det.spatial_average(det.star_groups(fx.predictions(spark, d)))
    return g.select("image_id", "group_id", "n", *(r6(f"{a}{k}").alias(f"{a}{k}") for a in "xyz" for k in "12"))


@query("select image_id, z, y, x from image, (select unnest(range(0, 29 - 16 + 1, 8)) as z), (select unnest(range(0, 105 - 16 + 1, 8)) as y), (select unnest(range(0, 113 - 16 + 1, 8)) as x)", "image")
def det_patch_grid(spark, d):
    return det.patch_grid(fx.image(spark, d), 16, 8).select("image_id", *(F.col(a).cast("long").alias(a) for a in "zyx"))


@query("select box_id, (i // 120) * 8 + 8 as z, (i // 12) % 10 * 8 + 8 as y, i % 12 * 8 + 8 as x from (select box_id, x1 * 3 as i from pred)", "pred")
def det_patch_center(spark, d):
    c = det.patch_center(F.col("x1") * 3, F.lit(10), F.lit(12), 16, 8)
    return fx.predictions(spark, d).select("box_id", *(v.cast("long").alias(k) for k, v in c.items()))


_FRAME = {"x": 90, "y": 80, "z": 12}


@query("select box_id, " + ", ".join(f"greatest(0, least({a}1, {n} - ({a}2 - {a}1))) as shifted_{a}, least(greatest({a}1, 0), {n}) as low_{a}, least(greatest({a}2, 0), {n}) as high_{a}" for a, n in _FRAME.items()) + " from pred", "pred")
def det_reframe(spark, d):
    c = F.col
    cut = {a: (det.shifted_inside(c(f"{a}1"), c(f"{a}2") - c(f"{a}1"), F.lit(n)), det.clipped_inside(c(f"{a}1"), F.lit(n)), det.clipped_inside(c(f"{a}2"), F.lit(n))) for a, n in _FRAME.items()}
    return fx.predictions(spark, d).select("box_id", *(v.alias(f"{k}_{a}") for a, some in cut.items() for k, v in zip(("shifted", "low", "high"), some, strict=True)))


@query("select box_id, (x2 - x1) * (y2 - y1) * (z2 - z1) as volume from pred", "pred")
def det_volume(spark, d):
    return fx.predictions(spark, d).select("box_id", det.volume().cast("long").alias("volume"))


def _crop_sql(whole: str) -> str:
    n = "cast(cast(round_even((x2 - x1) * 0.75, 0) as double) as bigint)" if whole == "rint" else "cast(ceil((x2 - x1) * 0.75) as bigint)"
    return f"select box_id, low, low + n as high from (select box_id, n, cast(cast(round_even((x1 + x2) / 2.0 - n / 2.0, 0) as double) as bigint) as low from (select *, {n} as n from pred))"


@query(_crop_sql("rint"), "pred")
def det_crop_rint(spark, d):
    low, high = det.crop_box((F.col("x1") + F.col("x2")) / 2.0, (F.col("x2") - F.col("x1")) * 0.75)
    return fx.predictions(spark, d).select("box_id", low.alias("low"), high.alias("high"))


@query(_crop_sql("ceil"), "pred")
def det_crop_ceil(spark, d):
    low, high = det.crop_box((F.col("x1") + F.col("x2")) / 2.0, (F.col("x2") - F.col("x1")) * 0.75, "ceil")
    return fx.predictions(spark, d).select("box_id", low.alias("low"), high.alias("high"))


@query("select image_id, box_id, row_number() over (partition by image_id order by score desc, box_id) - 1 as rank from pred", "pred")
def rel_rank_in_image(spark, d):
    b = fx.predictions(spark, d).withColumn("down", -F.col("score"))
    return det.rank_in_image(b, "down", "box_id").select("image_id", "box_id", F.col("rank").cast("long").alias("rank"))


# ---- metrics, splits --------------------------------------------------------------------------------------------------


@query("select truth, count(*) filter (guess = 0) as p0, count(*) filter (guess = 1) as p1, count(*) filter (guess = 2) as p2 from view_ group by truth", "view")
def agg_confusion(spark, d):
    return met.confusion(fx.views(spark, d), [0, 1, 2])


@query("select round(avg(case when truth = guess then 1.0 else 0.0 end), 6) as accuracy from view_", "view")
def agg_accuracy(spark, d):
    return met.accuracy(fx.views(spark, d)).select(r6("accuracy").alias("accuracy"))


@query("select vec_id, list_position(embedding, list_max(embedding)) - 1 as k from embeddings")
def agg_argmax(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", met.argmax(F.col("embedding")).cast("int").alias("k"))


@query("select round(tp / said, 6) as precision, round(tp / real_, 6) as recall, round(2 * tp / (said + real_), 6) as f1 from (select count(*) filter (toxic = 0 and quality = 1) as tp, count(*) filter (toxic = 0) as said, count(*) filter (quality = 1) as real_ from labels)")
def agg_f1(spark, d):
    rows = fx.views(spark, d).withColumn("logit", 1.0 - 2.0 * F.col("toxic"))
    return met.f1(rows, "quality", "logit").select(*(r6(c).alias(c) for c in ("precision", "recall", "f1")))


@query(", b as (select view_id, epoch, energy, min(energy) over (partition by view_id order by epoch) as best from energy) select view_id, epoch, round(best, 6) as best, energy <= best as is_best from b", "energy")
def agg_running_best(spark, d):
    return met.running_best(fx.energies(spark, d), "view_id", "epoch", "energy").select("view_id", "epoch", r6("best").alias("best"), "is_best")


@query(
    """, b as (select *, coalesce(energy < min(energy) over (partition by view_id order by epoch rows between unbounded preceding and 1 preceding), true) as better from energy),
    i as (select *, sum(better::int) over (partition by view_id order by epoch) as run from b), w as (select *, row_number() over (partition by view_id, run order by epoch) - 1 as wait from i)
    select view_id, min(epoch) filter (wait >= 3) as stop from w group by view_id""",
    "energy",
)
def agg_early_stop(spark, d):
    return met.early_stop(fx.energies(spark, d), "view_id", "epoch", "energy", 3).select("view_id", F.col("stop").cast("long").alias("stop"))


@query(
    """, s as (select view_id, epoch, row_number() over w as k, avg(energy) over (partition by view_id order by epoch rows between 5 preceding and 4 preceding) as a,
    avg(energy) over (partition by view_id order by epoch rows between 1 preceding and current row) as b from energy window w as (partition by view_id order by epoch))
    select view_id, epoch, case when k >= 6 then round(a - b, 6) + 0.0 end as fall, coalesce(k >= 6 and a - b < 5.0, false) as settled from s""",
    "energy",
)
def agg_stopping_rule(spark, d):
    s = met.settled(fx.energies(spark, d), "view_id", "epoch", "energy", 5.0, 6, 2)
    return s.select("view_id", "epoch", r6("drop").alias("fall"), "settled")


@query("select epoch, round(avg(energy), 6) as mean, round(median(energy), 6) as median, round(stddev_pop(energy), 6) as std from energy group by epoch", "energy")
def agg_energy_per_epoch(spark, d):
    return fx.energies(spark, d).groupBy("epoch").agg(r6(F.avg("energy")).alias("mean"), r6(F.median("energy")).alias("median"), r6(F.stddev_pop("energy")).alias("std"))


@query("select view_id, epoch, round(energy, 6) as energy from energy qualify row_number() over (partition by view_id order by energy, epoch) = 1", "energy")
def agg_best_candidate(spark, d):
    return met.top_per_group(fx.energies(spark, d), ["view_id"], [F.col("energy"), F.col("epoch")]).select("view_id", "epoch", r6("energy").alias("energy"))


@query(", h as (select e.*, median(energy) over (partition by epoch) as m from energy e) select epoch, view_id from (select *, row_number() over (partition by epoch order by energy, view_id) as k from h where energy <= m) where k <= 5", "energy")
def agg_halve_then_best(spark, d):
    return met.halve_then_best(fx.energies(spark, d), "epoch", "energy", 5, "view_id").select("epoch", "view_id")


@query("select box_id, score from pred order by score desc, box_id limit 50", "pred")
def sort_by_score(spark, d):
    return sets.scan(fx.predictions(spark, d), None, [F.desc("score"), F.col("box_id")], 50).select("box_id", "score")


@query("select nation_id, image_id, case when row_number() over w - 1 < floor(0.7 * count(*) over (partition by nation_id) + 1e-9) then 'train' else 'test' end as part from image window w as (partition by nation_id order by image_id)", "image")
def samp_train_test(spark, d):
    return met.split_by_rank(fx.image(spark, d), ["nation_id"], ["image_id"], 0.7).select("nation_id", "image_id", "part")


@query("select image_id, box_id, case when row_number() over w - 1 < floor(0.8 * count(*) over (partition by image_id) + 1e-9) then 'train' else 'test' end as part from truth window w as (partition by image_id order by box_id)", "truth")
def samp_annotation_split(spark, d):
    return met.split_by_rank(fx.truths(spark, d), ["image_id"], ["box_id"], 0.8).select("image_id", "box_id", "part")


@query("select doc_id, truth from view_ qualify row_number() over (partition by truth order by doc_id) <= 20", "view")
def samp_per_class_limit(spark, d):
    return met.per_class_limit(fx.views(spark, d), "truth", ["doc_id"], 20).select("doc_id", "truth")


@query("select box_id, image_id * 4294967296 + x1 as code, image_id as image, x1 as at from pred", "pred")
def samp_encode_index(spark, d):
    b = fx.predictions(spark, d).withColumn("code", met.encode_index(F.col("image_id"), F.col("x1")))
    image, at = met.decode_index(F.col("code"))
    return b.select("box_id", "code", image.alias("image"), at.alias("at"))


@query("select volume_id, z, y, x from voxel where v > 0.2", "voxel")
def samp_positive_voxels(spark, d):
    return _voxels(spark, d).filter("v > 0.2").select("volume_id", "z", "y", "x")


@query("select doc_id, quality = 1 as positive, (row_number() over (partition by quality = 1 order by doc_id) - 1) // case when quality = 1 then 3 else 7 end as batch from view_", "view")
def samp_pu_batches(spark, d):
    rows = fx.views(spark, d).withColumn("positive", F.col("quality") == 1)
    return met.pu_batches(rows, "positive", F.col("doc_id"), 10, 0.3).select("doc_id", "positive", "batch")


@query("select name, case when least(a, 180 - a) <= 20 then 0 when abs(a - 90) <= 20 then 1 else 2 end as view from (select name, rot2 as a from pose)", "pose")
def gen_view_of_angle(spark, d):
    return fx.poses(spark, d).select("name", met.view_of(F.col("rot2"), 20.0).alias("view"))


# ---- voxels -----------------------------------------------------------------------------------------------------------


@query("select volume_id, round(sum(v * z) / sum(v), 6) + 0.0 as cz, round(sum(v * y) / sum(v), 6) + 0.0 as cy, round(sum(v * x) / sum(v), 6) + 0.0 as cx from (select volume_id, z, y, x, v + 10 as v from voxel) group by volume_id", "voxel")
def vox_center_of_mass(spark, d):
    rows = _voxels(spark, d).withColumn("v", F.col("v") + 10)
    return vox.center_of_mass(rows).select("volume_id", *(r6(c).alias(c) for c in ("cz", "cy", "cx")))


@query("select volume_id, y, x, round(sum(v), 6) + 0.0 as v from voxel group by all", "voxel")
def vox_project_z(spark, d):
    return vox.project_z(_voxels(spark, d)).select("volume_id", "y", "x", r6("v").alias("v"))


@query(", m as (select volume_id, z, round(avg(v), 9) as mean from voxel group by all) select volume_id, z from m qualify row_number() over (partition by volume_id order by mean desc, z) = 1", "voxel")
def vox_brightest_slice(spark, d):
    return vox.brightest_slice(_voxels(spark, d))


@query(", s as (select *, min(v) over w as a, max(v) over w as b from voxel window w as (partition by volume_id)) select volume_id, z, y, x, round((v - a) / (b - a), 6) + 0.0 as v from s", "voxel")
def vox_stretch(spark, d):
    vols = fx.volumes(spark, d).withColumn("data", vox.stretch(F.col("data")))
    return vox.voxels(vols).select("volume_id", "z", "y", "x", r6("v").alias("v"))


@query(", s as (select *, avg(v) over w as a, stddev_pop(v) over w as b from voxel window w as (partition by volume_id)) select volume_id, z, y, x, round((v - a) / b, 6) + 0.0 as v from s", "voxel")
def aug_normalize(spark, d):
    vols = fx.volumes(spark, d).withColumn("data", vox.zscore(F.col("data")))
    return vox.voxels(vols).select("volume_id", "z", "y", "x", r6("v").alias("v"))


@query(", s as (select *, min(v) over w as a, max(v) over w as b from voxel window w as (partition by volume_id)) select volume_id, z, y, x, round(pow((v - a) / (b - a), 2.0), 6) + 0.0 as v from s", "voxel")
def aug_gamma(spark, d):
    vols = fx.volumes(spark, d).withColumn("data", vox.gamma(F.col("data"), 2.0))
    return vox.voxels(vols).select("volume_id", "z", "y", "x", r6("v").alias("v"))


@query("select volume_id, count(*) filter (v >= 0.1) as n from voxel group by volume_id", "voxel")
def vox_threshold(spark, d):
    vols = fx.volumes(spark, d).withColumn("data", vox.threshold(F.col("data"), 0.1))
    return vols.select("volume_id", F.size(F.filter("data", lambda v: v > 0)).cast("long").alias("n"))


@query(", s as (select volume_id, v > 0.3 * max(v) over (partition by volume_id) as one from voxel) select volume_id, count(*) filter (one) as n from s group by volume_id", "voxel")
def vox_above_share(spark, d):
    vols = fx.volumes(spark, d).withColumn("data", vox.above_share(F.col("data"), 0.3))
    return vols.select("volume_id", F.aggregate("data", F.lit(0).cast("long"), lambda s, v: s + v).alias("n"))


@query(
    """, span as (select volume_id, min(v) as low, max(v) as high from voxel group by 1),
    h as (select volume_id, low, high, least(255, cast(floor((v - low) / ((high - low) / 256)) as bigint)) as bin, count(*) as n from voxel join span using (volume_id) group by all),
    c as (select *, low + (bin + 0.5) * ((high - low) / 256) as center from h),
    w as (select *, sum(n) over u as w1, sum(n * center) over u as s1, sum(n) over p as w, sum(n * center) over p as s from c window p as (partition by volume_id), u as (partition by volume_id order by bin rows between unbounded preceding and current row)),
    g as (select volume_id, bin, center, case when w > w1 then round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2), 6) else 0 end as spread from w)
    select volume_id, round(center, 6) + 0.0 as threshold from g qualify row_number() over (partition by volume_id order by spread desc, bin) = 1""",
    "voxel",
)
def vox_otsu(spark, d):
    return vox.otsu(_voxels(spark, d)).select("volume_id", r6("threshold").alias("threshold"))


@query(
    """, g as (select volume_id, z, y, x, lead(v) over (partition by volume_id, y, x order by z) - v as gz, lead(v) over (partition by volume_id, z, x order by y) - v as gy, lead(v) over (partition by volume_id, z, y order by x) - v as gx from voxel)
    select volume_id, z, y, x, round(gz, 6) + 0.0 as gz, round(gy, 6) + 0.0 as gy, round(gx, 6) + 0.0 as gx from g where gz is not null and gy is not null and gx is not null""",
    "voxel",
)
def vox_gradient(spark, d):
    return vox.gradient(_voxels(spark, d)).select("volume_id", "z", "y", "x", *(r6(c).alias(c) for c in ("gz", "gy", "gx")))


@query("select a.volume_id, round(corr(a.v, b.v), 6) + 0.0 as corr from voxel a join voxel b on a.volume_id = b.volume_id and a.z = b.z and a.y = b.x and a.x = b.y group by 1", "voxel")
def vox_correlation(spark, d):
    v = _voxels(spark, d)
    turned = v.select("volume_id", "z", F.col("x").alias("y"), F.col("y").alias("x"), "v")
    return vox.correlation(v, turned).select("volume_id", r6("corr").alias("corr"))


@query("select volume_id, min(z) as z1, max(z) as z2, min(y) as y1, max(y) as y2, min(x) as x1, max(x) as x2 from voxel where v > 0.15 group by volume_id", "voxel")
def aug_remove_border(spark, d):
    return vox.bounding_box(_voxels(spark, d), 0.15)


@query("select volume_id, z, 3 - x as y, y as x, round(v, 6) + 0.0 as v from voxel", "voxel")
def aug_rotate90(spark, d):
    return vox.rotate90(_voxels(spark, d), "y", "x", 4).select("volume_id", "z", "y", "x", r6("v").alias("v"))


@query("select volume_id, 3 - z as z, y, x, round(v, 6) + 0.0 as v from voxel", "voxel")
def aug_flip(spark, d):
    return vox.flip(_voxels(spark, d), "z", 4).select("volume_id", "z", "y", "x", r6("v").alias("v"))


@query(
    """, r as (select unnest(range(-2, 3)) as k), s as (select a.k as dz, b.k as dy, c.k as dx from r a, r b, r c where a.k * a.k + b.k * b.k + c.k * c.k <= 4)
    select distinct image_id, z1 + dz as z, y1 + dy as y, x1 + dx as x from pred, s""",
    "pred",
)
def vox_ball_mask(spark, d):
    c = fx.predictions(spark, d).select("image_id", F.col("z1").alias("z"), F.col("y1").alias("y"), F.col("x1").alias("x"))
    return vox.ball_mask(c, 2).select("image_id", *(F.col(a).cast("long").alias(a) for a in "zyx"))


@query("select i, round(case when x < 0.25 then 0.5 * (1 + cos(pi() * (x / 0.25 - 1))) when x > 0.75 then 0.5 * (1 + cos(pi() * ((x - 1) / 0.25 + 1))) else 1.0 end, 6) + 0.0 as tukey, round(0.5 - 0.5 * cos(2 * pi() * x), 6) + 0.0 as hann from (select i, i / 63.0::double as x from (select unnest(range(64)) as i))")
def vox_windows(spark, d):
    return spark.range(64).select(F.col("id").alias("i"), r6(vox.tukey(F.col("id"), 64, 0.5)).alias("tukey"), r6(vox.hann(F.col("id"), 64)).alias("hann"))


@query(
    """with g as (select i // 121 as z, (i // 11) % 11 as y, i % 11 as x from (select unnest(range(1331)) as i)), e as (select *, exp(-0.5 * (pow((z - 5) / 2.0, 2) + pow(y - 5, 2) + pow(x - 5, 2))) as g from g),
    s as (select z, y, x, (g - min(g) over ()) / (max(g) over () - min(g) over ()) as g from e) select z, y, x, round(g / sum(g) over (), 6) + 0.0 as v from s"""
)
def gen_gaussian_psf(spark, d):
    return vox.gaussian_psf(spark, (2.0, 1.0, 1.0), 5).select("z", "y", "x", r6("v").alias("v"))


@query("select label, round(sum(v), 4) + 0.0 as total, count(*) filter (v > 0) as n from voxel group by label", "voxel")
def vox_label_totals(spark, d):
    return _voxels(spark, d).groupBy("label").agg((F.round(F.sum("v"), 4) + 0.0).alias("total"), F.count_if(F.col("v") > 0).alias("n"))


# ---- poses ------------------------------------------------------------------------------------------------------------

_R = """, m as (select *, cos(radians(rot1)) as c1, sin(radians(rot1)) as s1, cos(radians(rot2)) as c2, sin(radians(rot2)) as s2, cos(radians(rot3)) as c3, sin(radians(rot3)) as s3 from pose),
    r as (select *, c2 as r00, -c3 * s2 as r01, s2 * s3 as r02, c1 * s2 as r10, c1 * c2 * c3 - s1 * s3 as r11, -c3 * s1 - c1 * c2 * s3 as r12, s1 * s2 as r20, c1 * s3 + c2 * c3 * s1 as r21, c1 * c3 - c2 * s1 * s3 as r22 from m)"""


@query(_R + " select name, " + ", ".join(f"round(r{i}{j}, 6) + 0.0 as r{i}{j}" for i in range(3) for j in range(3)) + " from r", "pose")
def geo_euler_to_matrix(spark, d):
    m = geo.pose_matrix()
    return fx.poses(spark, d).select("name", *(r6(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)))


def _with_locked(poses: DataFrame) -> DataFrame:
    """Poses, and each with its middle angle 0 and 180, where the outer angles turn about one axis."""
    return poses.withColumn("rot2", F.explode(F.array("rot2", F.lit(0.0), F.lit(180.0)))).withColumn("name", F.concat_ws("@", "name", F.col("rot2").cast("int").cast("string")))


_LOCKED = ", lock as (select name || '@' || cast(cast(r as integer) as varchar) as name, rot1, r as rot2, rot3 from (select name, rot1, rot3, unnest([rot2, 0.0::double, 180.0::double]) as r from pose))"


@query(
    _LOCKED + """ select name, cast(case rot2 when 0 then rot1 + rot3 when 180 then rot1 - rot3 + 360 else rot1 end as double) % 360.0::double as rot1, rot2, case when rot2 in (0, 180) then 0.0::double else rot3 % 360.0::double end as rot3 from lock""",
    "pose",
)
def geo_matrix_to_euler(spark, d):
    """Angles modulo a full turn; in gimbal lock the last one is 0."""
    a = geo.euler_angles(geo.pose_matrix())
    turn = lambda c: F.pmod(r6(c), F.lit(360.0)) + F.lit(0.0)
    return _with_locked(fx.poses(spark, d)).select("name", turn(a[0]).alias("rot1"), r6(a[1]).alias("rot2"), turn(a[2]).alias("rot3"))


@query(_R + " select name, round(-(r00 * t1 + r10 * t2 + r20 * t3), 6) + 0.0 as t1, round(-(r01 * t1 + r11 * t2 + r21 * t3), 6) + 0.0 as t2, round(-(r02 * t1 + r12 * t2 + r22 * t3), 6) + 0.0 as t3, " + ", ".join(f"round(r{j}{i}, 6) + 0.0 as r{i}{j}" for i in range(3) for j in range(3)) + " from r", "pose")
def geo_invert(spark, d):
    m, t = geo.invert()
    return fx.poses(spark, d).select("name", *(r6(c).alias(k) for k, c in zip(("t1", "t2", "t3"), t, strict=True)), *(r6(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)))


def _pose_pairs(spark, d):
    p = fx.poses(spark, d)
    return p.select("name", *(F.col(c).alias(f"p_{c}") for c in p.columns[2:]), (F.col("rot1") + 10).alias("q_rot1"), F.col("rot2").alias("q_rot2"), (F.col("rot3") + 20).alias("q_rot3"), *((F.col(f"t{k}") + 1).alias(f"q_t{k}") for k in (1, 2, 3)))


_R2 = _R + """, m2 as (select *, cos(radians(rot1 + 10)) as d1, sin(radians(rot1 + 10)) as e1, cos(radians(rot3 + 20)) as d3, sin(radians(rot3 + 20)) as e3 from r),
    q as (select *, c2 as q00, -d3 * s2 as q01, s2 * e3 as q02, d1 * s2 as q10, d1 * c2 * d3 - e1 * e3 as q11, -d3 * e1 - d1 * c2 * e3 as q12, e1 * s2 as q20, d1 * e3 + c2 * d3 * e1 as q21, d1 * d3 - c2 * e1 * e3 as q22 from m2)"""


@query(
    _R2 + " select name, " + ", ".join(f"round(q{i}0 * r0{j} + q{i}1 * r1{j} + q{i}2 * r2{j}, 6) + 0.0 as r{i}{j}" for i in range(3) for j in range(3)) + ", " + ", ".join(f"round(t{i + 1} + 1 + q{i}0 * t1 + q{i}1 * t2 + q{i}2 * t3, 6) + 0.0 as t{i + 1}" for i in range(3)) + " from q",
    "pose",
)
def geo_compose(spark, d):
    m, t = geo.compose("p_", "q_")
    return _pose_pairs(spark, d).select("name", *(r6(m[i][j]).alias(f"r{i}{j}") for i in range(3) for j in range(3)), *(r6(t[i]).alias(f"t{i + 1}") for i in range(3)))


@query(_R + " select name, " + ", ".join(f"round({c} - ({c} * r{i}0 + {c} * r{i}1 + {c} * r{i}2), 6) + 0.0 as o{i + 1}" for i, c in enumerate(("24.5",) * 3)) + " from r", "pose")
def geo_about_center(spark, d):
    _, o = geo.about_center(geo.pose_matrix(), [50, 50, 50])
    return fx.poses(spark, d).select("name", *(r6(c).alias(f"o{k + 1}") for k, c in enumerate(o)))


@query("select name, s as sym, rot3 + s * 40.0 as rot3 from pose, (select unnest(range(9)) as s)", "pose")
def geo_symmetrize(spark, d):
    return geo.symmetrize(fx.poses(spark, d), 9).select("name", F.col("sym").cast("long").alias("sym"), r6("rot3").alias("rot3"))


@query(
    _R2 + """, a as (select name, degrees(acos(least(1.0, greatest(-1.0, (r00 * q00 + r01 * q01 + r02 * q02 + r10 * q10 + r11 * q11 + r12 * q12 + r20 * q20 + r21 * q21 + r22 * q22 - 1) / 2)))) as angle from q)
    select name, round(angle, 5) + 0.0 as angle, round(sqrt(3), 6) as distance from a""",
    "pose",
)
def geo_pose_distance(spark, d):
    return geo.pose_distances(_pose_pairs(spark, d), "p_", "q_").select("name", (F.round("angle", 5) + 0.0).alias("angle"), r6("distance").alias("distance"))


def _matrix_sql(p: str, rot1: str, rot2: str, rot3: str) -> str:
    """Columns p00 to p22 of the rotation of three angles in degrees."""
    c, n = (lambda x: f"cos(radians({x}))"), (lambda x: f"sin(radians({x}))")
    (c1, s1), (c2, s2), (c3, s3) = ((c(x), n(x)) for x in (rot1, rot2, rot3))
    m = [[c2, f"-{c3} * {s2}", f"{s2} * {s3}"], [f"{c1} * {s2}", f"{c1} * {c2} * {c3} - {s1} * {s3}", f"-{c3} * {s1} - {c1} * {c2} * {s3}"], [f"{s1} * {s2}", f"{c1} * {s3} + {c2} * {c3} * {s1}", f"{c1} * {c3} - {c2} * {s1} * {s3}"]]
    return ", ".join(f"{m[i][j]} as {p}{i}{j}" for i in range(3) for j in range(3))


def _relative_sql(r: str, a: str, p: str, i: int, j: int) -> str:
    return "(" + " + ".join(f"{r}.{p}{k}{i} * {a}.{p}{k}{j}" for k in range(3)) + ")"


@query(
    f""", fam as (select pose_id, pose_id // 40 as family, {_matrix_sql("a", "rot1", "rot2", "rot3")} from pose),
    near as (select pose_id, s, {_matrix_sql("b", "(rot1 + pose_id % 7 + s * 120.0)", "rot2", "(rot3 + pose_id % 5)")} from pose, (select unnest(range(3)) as s)),
    e as (select x.pose_id, r.pose_id as ref, min(degrees(acos(least(1.0, greatest(-1.0, ({" + ".join(_relative_sql("r", "x", "a", i, j) + " * " + _relative_sql("q", "y", "b", i, j) for i in range(3) for j in range(3))} - 1) / 2))))) as angle
        from fam x join fam r on x.family = r.family join near y on y.pose_id = x.pose_id join near q on q.pose_id = r.pose_id and q.s = 0 group by 1, 2)
    select pose_id, round(median(angle), 3) + 0.0 as angle from e group by pose_id""",
    "pose",
)
def geo_family_distance(spark, d):
    """Every family of forty poses against itself with each pose turned a little in its own way."""
    p = fx.poses(spark, d).select("pose_id", F.floor(F.col("pose_id") / 40).alias("family"), "rot1", "rot2", "rot3")
    other = p.withColumns({"rot1": F.col("rot1") + F.col("pose_id") % 7, "rot3": F.col("rot3") + F.col("pose_id") % 5})
    return geo.family_distances(p, other, 3, "family").select("pose_id", (F.round("angle", 3) + 0.0).alias("angle"))


@query(
    """with a as (select i, 1 - (2 * i + 1) / 200.0::double as z, i * pi() * (3 - sqrt(5)) as phi from (select unnest(range(200)) as i))
    select i as axis, t as turn, round(degrees(phi) - 360 * floor(degrees(phi) / 360), 6) + 0.0 as rot1, round(degrees(acos(z)), 6) + 0.0 as rot2, t * 10.0 as rot3 from a, (select unnest(range(5)) as t)"""
)
def geo_sphere_axes(spark, d):
    return geo.sphere_axes(spark, 200, 5, 9).select("axis", F.col("turn").cast("long").alias("turn"), r6("rot1").alias("rot1"), r6("rot2").alias("rot2"), r6("rot3").alias("rot3"))


@query(_LOCKED + f", m as (select name, {_matrix_sql('r', 'rot1', 'rot2', 'rot3')} from lock) select name, round(r00, 6) + 0.0 as x, round(r10, 6) + 0.0 as y, round(r20, 6) + 0.0 as z, 1.0::double as det from m", "pose")
def geo_rotation_between(spark, d):
    """The rotation that takes the first axis to a pose's axis (itself and its opposite too), applied to the first axis, and its determinant."""
    m = geo.pose_matrix()
    p = _with_locked(fx.poses(spark, d)).select("name", *(m[i][0].alias(f"b{i}") for i in range(3)))
    r = geo.rotation_between([F.lit(1.0), F.lit(0.0), F.lit(0.0)], [F.col(f"b{i}") for i in range(3)])
    det = sum((r[0][i] * (r[1][(i + 1) % 3] * r[2][(i + 2) % 3] - r[1][(i + 2) % 3] * r[2][(i + 1) % 3]) for i in range(3)), F.lit(0.0))
    return p.select("name", *(r6(r[i][0]).alias(a) for i, a in enumerate("xyz")), r6(det).alias("det"))


@query("select pose_id, count(*) as n, round(min(rot1 + i * 2.5 - 5), 6) + 0.0 as low, round(max(rot3 + k * 2.5 - 5), 6) + 0.0 as high from pose, (select unnest(range(5)) as i), (select unnest(range(5)) as j), (select unnest(range(5)) as k) group by pose_id", "pose")
def rec_refined_grid(spark, d):
    g = geo.refined_grid(fx.poses(spark, d), 10.0, 5)
    return g.groupBy("pose_id").agg(F.count("*").alias("n"), r6(F.min("rot1")).alias("low"), r6(F.max("rot3")).alias("high"))


@query("select p, cast(ceil(pow(360.0 / p, 2) / pi()) as bigint) as n_axes from (select unnest([1.0, 2.0, 5.0, 10.0, 30.0]) as p)")
def rec_axes_for_precision(spark, d):
    p = spark.createDataFrame([(x,) for x in (1.0, 2.0, 5.0, 10.0, 30.0)], "p double")
    return p.select("p", F.ceil(F.pow(360.0 / F.col("p"), 2) / F.lit(3.141592653589793)).alias("n_axes"))


@query("select round(avg(x1), 6) as cx, round(avg(y1), 6) as cy, round(avg(z1), 6) as cz, min(x1) as x_low, max(x1) as x_high, min(z1) as z_low, max(z1) as z_high from pred", "pred")
def geo_field_of_view(spark, d):
    b = fx.predictions(spark, d)
    return b.agg(*(r6(F.avg(f"{a}1")).alias(f"c{a}") for a in "xyz"), *(f(f"{a}1").alias(f"{a}_{k}") for a in "xz" for f, k in ((F.min, "low"), (F.max, "high"))))


@query("select view_id, epoch, round(greatest(0, -x) + ln(1 + exp(-abs(x))), 6) + 0.0 as loss from (select view_id, epoch, energy / 10 - 5 as x from energy)", "energy")
def nn_binomial_bce(spark, d):
    return fx.energies(spark, d).select("view_id", "epoch", r6(met.binomial_bce(F.col("energy") / 10 - 5)).alias("loss"))


@query("select truth, round(2.0 * sum(quality * toxic) / greatest(sum(quality * quality) + sum(toxic * toxic), 1e-6), 6) as dice from view_ group by truth", "view")
def nn_dice(spark, d):
    return met.dice(fx.views(spark, d), "truth", "quality", "toxic").select("truth", r6("dice").alias("dice"))


@query(
    _R + """, e as (select name, sqrt(r00 * r00 + r10 * r10) as sy, r00, r10, r20, r21, r22, r11, r12 from r), a as (select name, case when sy < 1e-6 then atan2(-r12, r11) else atan2(r21, r22) end as a, atan2(-r20, sy) as b, case when sy < 1e-6 then 0 else atan2(r10, r00) end as c from e)
    select name, """ + ", ".join(f"round({f}({x}), 5) + 0.0 as {f}_{x}" for x in "abc" for f in ("cos", "sin")) + " from a",
    "pose",
)
def geo_xyz_angles(spark, d):
    """Cosines and sines of the angles, which are the same on both sides of the half turn."""
    a = geo.xyz_angles(geo.pose_matrix())
    return fx.poses(spark, d).select("name", *((F.round(f(c), 5) + 0.0).alias(f"{k}_{x}") for x, c in zip("abc", a, strict=True) for k, f in (("cos", F.cos), ("sin", F.sin))))


@query("select image_id, round(dim_x / -2.0 * voxel_xy, 6) as ox, round(dim_y / -2.0 * voxel_xy, 6) as oy, round(dim_z * voxel_z, 6) as oz from image", "image")
def geo_default_origin(spark, d):
    return fx.image(spark, d).select("image_id", *(r6(c).alias(k) for k, c in geo.default_origin().items()))


@query("select box_id, round(case when y2 < y1 then -1.0 else 1.0 end * degrees(acos((x2 - x1) / sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)))), 5) + 0.0 as angle from pred", "pred")
def geo_drawn_angle(spark, d):
    a = geo.in_plane_angle(*(F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")))
    return fx.predictions(spark, d).select("box_id", (F.round(a, 5) + 0.0).alias("angle"))


@query(
    """, c as (select image_id, avg(z1) as cz, avg(y1) as cy, avg(x1) as cx, min(x1) as x_low, max(x1) as x_high from pred group by 1)
    select image_id, round(cz, 6) as cz, x_low, x_high, round(max(sqrt(pow(z1 - cz, 2) + pow(y1 - cy, 2) + pow(x1 - cx, 2))), 6) as radius from pred join c using (image_id) group by all""",
    "pred",
)
def geo_points_seen(spark, d):
    p = fx.predictions(spark, d).select("image_id", F.col("z1").alias("z"), F.col("y1").alias("y"), F.col("x1").alias("x"))
    return geo.points_seen(p, "image_id").select("image_id", r6("cz").alias("cz"), "x_low", "x_high", r6("radius").alias("radius"))


@query("select step, count(*) as n from (select unnest(['nms', 'first_spatial_average', 'last_step']) as step), pred group by step", "pred")
def rel_unpivot_steps(spark, d):
    b = fx.predictions(spark, d).select("box_id", F.explode(F.array(*map(F.lit, ("raw", "nms", "first_spatial_average", "last_step")))).alias("step"))
    return b.filter("step <> 'raw'").groupBy("step").agg(F.count("*").alias("n"))


@query("select vec_id as id, 'embedding_' || i as key, round(cast(embedding[i + 1] as double), 6) + 0.0 as value from embeddings, (select unnest(range(64)) as i)")
def rel_flatten_arrays(spark, d):
    e = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return e.select("id", F.concat(F.lit("embedding_"), F.col("i").cast("string")).alias("key"), r6("v").alias("value"))


@query("select coalesce(max(cast(regexp_extract(name, '_([0-9]+)$', 1) as integer)), 0) + 1 as suffix from (select 'output_' || (image_id % 7) as name from image)", "image")
def rel_next_suffix(spark, d):
    names = fx.image(spark, d).select(F.concat(F.lit("output_"), (F.col("image_id") % 7).cast("string")).alias("name"))
    return names.agg((F.coalesce(F.max(F.regexp_extract("name", "_([0-9]+)$", 1).cast("int")), F.lit(0)) + 1).alias("suffix"))


@query("select path, sha256(path) as sha256 from (select distinct path from path)", "path")
def src_registry_hash(spark, d):
    return fx.paths(spark, d).select("path").distinct().select("path", F.sha2("path", 256).alias("sha256"))


@query("select doc_id, truth = 0 as c0, truth = 1 as c1, truth = 2 as c2 from view_", "view")
def vox_one_hot(spark, d):
    return fx.views(spark, d).select("doc_id", *((F.col("truth") == c).alias(f"c{c}") for c in range(3)))


@query("select volume_id, case when label = 3 then 1 else label end as label, count(*) as n from voxel group by all", "voxel")
def vox_merge_labels(spark, d):
    return _voxels(spark, d).withColumn("label", F.when(F.col("label") == 3, 1).otherwise(F.col("label"))).groupBy("volume_id", "label").agg(F.count("*").alias("n"))


@query(
    """, p as (select view_id, epoch, 1 / (1 + exp(-(energy / 10 - 5))) as p, epoch % 3 as label from energy),
    g as (select view_id, sum(p) filter (label = 1) as p1, sum(p) filter (label = 2) as p2, count(*) filter (label = 1) as n1, count(*) filter (label = 2) as n2, sum(p) as a from p group by view_id)
    select view_id, round(-(coalesce(p1, 0) / greatest(n1, 1e-6) - coalesce(p2, 0) / greatest(n2, 1e-6) + case when n1 + n2 > 0 then 0.1 * a / (greatest(n1, 1e-6) + greatest(n2, 1e-6)) else 0 end), 5) + 0.0 as loss from g""",
    "energy",
)
def nn_inside_outside(spark, d):
    from ..operators import losses

    rows = fx.energies(spark, d).select("view_id", (F.col("energy") / 10 - 5).alias("logit"), (F.col("epoch") % 3).alias("label"))
    return losses.inside_outside(rows, "view_id", 1.0, 0.1).select("view_id", (F.round("loss", 5) + 0.0).alias("loss"))


@query("select round(sum(l * exp(-0.1 * k) + 0.1 * k), 5) + 0.0 as total from (select epoch % 5 as k, avg(energy) as l from energy group by 1)", "energy")
def nn_multi_task(spark, d):
    from ..operators import losses

    rows = fx.energies(spark, d).groupBy((F.col("epoch") % 5).alias("k")).agg(F.avg("energy").alias("loss")).withColumn("eta", 0.1 * F.col("k"))
    return losses.multi_task(rows).select((F.round("total", 5) + 0.0).alias("total"))


@query(
    """with g as (select unnest(range(9)) as i), c as (select a.i as z, b.i as y, c.i as x from g a, g b, g c), p(pz, py, px) as (values (4.0, 4.0, 4.0), (5.5, 3.0, 4.0)),
    d as (select z, y, x, sum(exp(-(pow(z - pz, 2) + pow(y - py, 2) + pow(x - px, 2)) / 2)) as v from c, p where abs(z - round_even(pz, 0)) <= 4 and abs(y - round_even(py, 0)) <= 4 and abs(x - round_even(px, 0)) <= 4 group by all)
    select z, y, x, round(v / max(v) over (), 6) + 0.0 as v from d"""
)
def gen_voxelise(spark, d):
    from ..operators import synthesis

    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.5, -1.0, 0.0)], "id long, z double, y double, x double")
    return synthesis.voxelise(pts, 9, 1.0).select("z", "y", "x", r6("v").alias("v"))


# ---- operators that SQL can't express: the tests compare them with plain Python ----------------------------------------


@query()
def samp_hash_shuffle(spark, d):
    return met.hash_shuffle(fx.views(spark, d), "doc_id", 1).select("doc_id")


@query()
def gen_points_in_sphere(spark, d):
    from ..operators import synthesis

    return synthesis.dig(synthesis.in_sphere(spark, 2000, 2.0, 3), (0.0, 0.0, 0.0), 0.5, 1)


@query()
def gen_random_poses(spark, d):
    from ..operators import synthesis

    return synthesis.random_poses(spark, 500, 2.0, 11)


def _shaped(spark, d, most: int | None = None):
    v = fx.volumes(spark, d)
    v = v if most is None else v.filter(F.col("volume_id") < most)
    return v.select("volume_id", F.array(F.lit(4), F.lit(4), F.lit(4)).alias("shape"), "data")


@query()
def vox_otsu_components(spark, d):
    """Number and largest size of the components over Otsu's threshold of each volume."""
    import numpy as np

    from ..functions import kernels
    from ..operators import volumes

    def f(v):
        ids, n = kernels.label(v > kernels.otsu(v))
        return {"n": n, "largest": int(np.bincount(ids.ravel())[1:].max()) if n else 0}

    return volumes.measure(_shaped(spark, d), f, "n long, largest long")


@query("select vec_id as volume_id, -1.0::double as dz, 0.0::double as dy, 0.0::double as dx, 0.0::double as error from embeddings")
def vox_registration(spark, d):
    """Shift of each volume against itself rolled by one voxel: -1 along z."""
    import numpy as np

    from ..functions import kernels
    from ..operators import volumes

    def f(v):
        shift, error = kernels.register(v, np.roll(v, 1, 0))
        return dict(zip(("dz", "dy", "dx"), (float(x) + 0.0 for x in shift), strict=True)) | {"error": round(error, 6) + 0.0}

    return volumes.measure(_shaped(spark, d), f, "dz double, dy double, dx double, error double")


@query()
def vox_rotate_by_pose(spark, d):
    from ..operators import volumes

    poses = fx.poses(spark, d).withColumnRenamed("pose_id", "volume_id").drop("name")
    return volumes.rotated(_shaped(spark, d), poses)


@query()
def vox_deconvolve(spark, d):
    import numpy as np

    from ..functions import kernels
    from ..operators import volumes

    psf = kernels.gaussian_blur(np.pad(np.ones((1, 1, 1)), 1), (0.5,) * 3)
    return volumes.map_volumes(_shaped(spark, d), lambda v, r: kernels.deconvolve(v - v.min(), psf, 1e-2))


@query()
def rec_match_poses(spark, d):
    """Best of eight candidate poses for the first volumes against the mean volume."""
    import numpy as np

    from ..operators import volumes

    vols = _shaped(spark, d)
    mean = np.array([r.m for r in vols.select(F.posexplode("data").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).orderBy("i").collect()]).reshape(4, 4, 4)
    turns = spark.createDataFrame([(float(a), float(b), 0.0) for a in (0, 90, 180, 270) for b in (0, 90)], "rot1 double, rot2 double, rot3 double")
    psf = np.zeros((3, 3, 3))
    psf[1, 1, 1] = 1
    return volumes.match(vols, mean, psf, vols.select("volume_id").crossJoin(turns))


@query()
def ml_kmeans(spark, d):
    from ..operators import learning

    p = fx.predictions(spark, d).select("box_id", *(F.col(f"{a}1").cast("double").alias(a) for a in "zyx"))
    return learning.kmeans(p, ["z", "y", "x"])[0].select("box_id", "label")


@query()
def ml_dbscan(spark, d):
    from ..operators import learning

    p = fx.predictions(spark, d).select("image_id", "box_id", *(F.col(f"{a}1").cast("double").alias(a) for a in "zyx"))
    return learning.dbscan(p, 8.0, 4)


@query()
def ml_separate(spark, d):
    from ..operators import learning

    return learning.separate(_shaped(spark, d))


@query()
def aug_policy(spark, d):
    """A seeded flip, turn and noise policy on every volume."""
    from ..functions import augment
    from ..operators import volumes

    policy = augment.compose([(0.5, augment.flip(0)), (0.5, augment.quarter_turn((1, 2))), (0.5, augment.gaussian_noise())])
    return volumes.map_volumes(_shaped(spark, d), lambda v, r: policy(v, int(r.volume_id)))


@query("select date_trunc('hour', cast(ts as timestamp)) as hour, event_type, count(*) as n, round(sum(value), 4) + 0.0 as total from events group by all")
def str_windowed_events(spark, d):
    """Hourly counts per event type; the same function serves a stream."""
    from ..streaming.arrivals import windowed_values

    e = fx.table(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return windowed_values(e).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", (F.round("total", 4) + 0.0).alias("total"))


# ---- image files ------------------------------------------------------------------------------------------------------


@query("select volume_id, 4 as dim_x, 4 as dim_y, 4 as dim_z, 'ome' as kind, round(sum(v), 4) + 0.0 as total, round(sum(v * (16 * z + 4 * y + x)), 3) + 0.0 as moment from voxel group by volume_id", "voxel")
def src_image_round_trip(spark, d):
    """Every volume as an OME-TIFF file, its metadata and its pixels read back."""
    from ..sources import images

    files = images.encoded(_shaped(spark, d), 0.1, 0.3)
    told = images.metadata(files).select("volume_id", "dim_x", "dim_y", "dim_z", "kind")
    pixels = images.decoded(files, 0).select("volume_id", F.posexplode("data").alias("i", "v")).groupBy("volume_id").agg((F.round(F.sum("v"), 4) + 0.0).alias("total"), (F.round(F.sum(F.col("v") * F.col("i")), 3) + 0.0).alias("moment"))
    return told.join(pixels, "volume_id")


@query("select image_id, 3 + nation_id % 3 as dim_x, 2 as dim_y, 2 + nation_id % 2 as dim_z, n_channels, round(voxel_xy, 6) as voxel_xy, round(case when enabled then 0.5 else voxel_z end, 6) as voxel_z from image", "image")
def src_image_metadata(spark, d):
    """Files of several sizes, channels and voxel sizes; the depth of enabled images is given by hand."""
    import numpy as np

    from ..sources import images

    def run(frames):
        for pdf in frames:
            yield pdf.assign(content=[images.encode(np.zeros((r.n_channels, 2 + r.nation_id % 2, 2, 3 + r.nation_id % 3), np.uint16), (r.voxel_xy, r.voxel_z)) for r in pdf.itertuples()])[["image_id", "enabled", "content"]]

    rows = fx.image(spark, d).select("image_id", "nation_id", "n_channels", "voxel_xy", "voxel_z", "enabled")
    files = rows.mapInPandas(run, f"image_id {dict(rows.dtypes)['image_id']}, enabled boolean, content binary")
    found = images.metadata(files, voxel_z=F.when(F.col("enabled"), 0.5))
    return found.select("image_id", *(F.col(c).cast("long").alias(c) for c in ("dim_x", "dim_y", "dim_z", "n_channels")), r6("voxel_xy").alias("voxel_xy"), r6("voxel_z").alias("voxel_z"))


@query("select a.volume_id, a.z, a.y, a.x, round(coalesce(b.v, 0), 6) + 0.0 as v from voxel a left join voxel b on a.volume_id = b.volume_id and b.z = a.z - 1 and b.y = a.y and b.x = a.x", "voxel")
def vox_spline_shift(spark, d):
    """Cubic splines go through the voxels, so a shift by a whole voxel along z moves them and leaves 0 behind."""
    from ..functions import kernels
    from ..operators import volumes

    moved = volumes.map_volumes(_shaped(spark, d), lambda v, r: kernels.translate(v, (1, 0, 0), order=3))
    at = moved.select("volume_id", F.posexplode("data").alias("i", "v"))
    return at.select("volume_id", F.floor(F.col("i") / 16).alias("z"), (F.floor(F.col("i") / 4) % 4).alias("y"), (F.col("i") % 4).cast("long").alias("x"), r6("v").alias("v"))


@query()
def ml_density_tree(spark, d):
    from ..operators import learning

    p = fx.predictions(spark, d).select("image_id", "box_id", *(F.col(f"{a}1").cast("double").alias(a) for a in "zyx"))
    return learning.density_tree(p, 5)


@query(
    """, c as (select distinct image_id, greatest(2, least((z1 + z2) // 2, 26)) as z, greatest(2, least((y1 + y2) // 2, 102)) as y, greatest(2, least((x1 + x2) // 2, 110)) as x from truth),
    r as (select unnest(range(-2, 3)) as k), s as (select a.k as dz, b.k as dy, c.k as dx from r a, r b, r c where a.k * a.k + b.k * b.k + c.k * c.k <= 4),
    v as (select distinct image_id, ((z + dz) * 105 + y + dy) * 113 + x + dx as spot from c, s)
    select image_id, count(*) as n, cast(sum(spot) as bigint) as total from v group by image_id""",
    "truth",
)
def samp_positive_mask(spark, d):
    """Voxels around the annotations of every image, balls moved inside it."""
    from ..operators import pu

    c = fx.truths(spark, d).select("image_id", *(F.floor((F.col(f"{a}1") + F.col(f"{a}2")) / 2).alias(a) for a in "zyx"))
    found = pu.positives(fx.image(spark, d), pu.chosen(c), 2)
    return found.groupBy("image_id").agg(F.count("*").alias("n"), F.sum("at").alias("total"))
