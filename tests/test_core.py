"""Kernels, streaming, sources and detection against plain Python."""

import os
import struct

import numpy as np
import pytest

from voxmill.functions import kernels as k
from voxmill.operators import detection, geometry, metrics, sets, volumes
from voxmill.sources import files
from voxmill.streaming import arrivals


def blob(n=13, at=(6, 6, 6), s=1.5):
    g = np.indices((n, n, n))
    return np.exp(-sum((g[i] - at[i]) ** 2 for i in range(3)) / (2 * s * s))


def test_affine_identity_and_turns():
    v = np.random.default_rng(0).random((5, 5, 5))
    assert np.allclose(k.rotate(v, np.zeros(6)), v)
    out = v
    for _ in range(4):
        out = k.rotate(out, np.array([90, 0, 0, 0, 0, 0]))
    assert np.allclose(out, v)
    assert np.allclose(k.rotate(k.rotate(v, np.array([90, 90, 0, 0, 0, 0])), np.array([90, 90, 0, 0, 0, 0]), inverse=True), v)
    assert np.allclose(k.translate(v, (1, 0, 0))[1:], v[:-1])


def test_resampling_keeps_the_centre():
    v = blob()
    assert np.allclose(k.mass_center(k.to_size(v, (17, 17, 17))), [8, 8, 8], atol=1e-6)
    assert k.resample(v, 0.5).shape == (6, 6, 6)
    assert np.allclose(k.mass_center(k.centered(blob(at=(5, 7, 6)))), [6, 6, 6], atol=0.05)
    assert (k.crop_padded(np.ones((4, 4, 4)), np.array([-1, 0, 2]), np.array([3, 4, 6])).sum()) == 3 * 4 * 2


@pytest.mark.parametrize("shift", [(1, 0, 0), (2, -3, 1), (0.5, 0.3, -1.2)])
def test_registration(shift):
    v = blob(16, (8, 8, 8))
    moved = np.fft.ifftn(k.fourier_shift(np.fft.fftn(v), shift)).real
    found, error = k.register(v, moved, upsample=10)
    assert np.allclose(found, -np.array(shift), atol=0.051) and error < 0.05


def test_deconvolution_sharpens():
    v = blob(15, (7, 7, 7), 1.0)
    psf = blob(9, (4, 4, 4), 1.0)
    psf /= psf.sum()
    seen = np.fft.ifftn(np.fft.fftn(v) * k.centered_transfer(psf, v.shape)).real
    assert np.abs(k.deconvolve(seen, psf, 1e-6) - v).max() < 0.1 < np.abs(seen - v).max()


def test_labels_and_small_objects():
    rng = np.random.default_rng(1)
    mask = rng.random((7, 7, 7)) < 0.3
    ids, n = k.label(mask)
    assert ((ids > 0) == mask).all() and len(np.unique(ids[mask])) == n
    for axis in range(3):
        a, b = np.moveaxis(mask, axis, 0), np.moveaxis(ids, axis, 0)
        both = a[1:] & a[:-1]
        assert (b[1:][both] == b[:-1][both]).all()
    areas = np.bincount(ids.ravel())
    assert (k.remove_small(mask, 3) == (mask & (areas[ids] >= 3))).all()


def test_tiles_cover_once():
    for shape, most in (((10,), 1), ((100, 120, 7), 84), ((1000,), 2048), ((5, 7), 6)):
        seen = np.zeros(shape, int)
        for t in k.tiles(shape, most):
            cut = tuple(slice(a, b) for a, b in t)
            seen[cut] += 1
            assert seen[cut].size <= most
        assert (seen == 1).all()


def test_dbscan_and_otsu():
    pts = np.concatenate([np.random.default_rng(2).normal(c, 0.2, (30, 3)) for c in (0, 5)] + [[[20, 20, 20]]])
    out = k.dbscan(pts, 1.0, 4)
    assert set(out[:30]) == {1} and set(out[30:60]) == {2} and out[60] == 0
    values = np.concatenate([np.zeros(50), np.ones(50)]) + 0.01 * np.arange(100) / 100
    assert 45 <= (values > k.otsu(values)).sum() <= 75 and (values[50:] > k.otsu(values)).all()


def test_recentring():
    v = np.zeros((20, 20, 20))
    v[9:12, 10:13, 11:14] = 1
    box = k.recenter_box(np.array([8, 8, 6, 14, 14, 12]), v)
    assert np.allclose((box[:3] + box[3:]) / 2, [12, 11, 10], atol=1.01)
    assert np.isnan(k.recenter_box(np.array([30, 30, 30, 36, 36, 36]), v)).all()


def test_reconstruction_and_matching(spark):
    rng = np.random.default_rng(3)
    n = 9
    truth = blob(n, (4, 4, 4), 1.2) + 0.6 * blob(n, (6, 4, 3), 0.9)
    psf = np.zeros((3, 3, 3))
    psf[1, 1, 1] = 1
    angles = [(0, 0, 0), (90, 0, 0), (0, 90, 0), (90, 90, 0), (180, 0, 0), (0, 90, 90)]
    rows = [(i, [n] * 3, [float(x) for x in k.rotate(truth, np.array([*a, 0, 0, 0])).ravel()]) for i, a in enumerate(angles)]
    vols = spark.createDataFrame(rows, volumes.VOLUME)
    poses = spark.createDataFrame([(i, *map(float, a), 0.0, 0.0, 0.0) for i, a in enumerate(angles)], "volume_id long, rot1 double, rot2 double, rot3 double, t1 double, t2 double, t3 double")
    found = volumes.reconstruct(vols, poses, psf, 1e-6)
    assert np.corrcoef(found.ravel(), truth.ravel())[0, 1] > 0.98
    candidates = poses.select("volume_id").crossJoin(poses.select("rot1", "rot2", "rot3").distinct())
    best = {r.volume_id: (r.rot1, r.rot2, r.rot3) for r in volumes.match(vols, truth, psf, candidates).collect()}
    for i, a in enumerate(angles):
        assert np.allclose(k.rotation_matrix(*best[i]), k.rotation_matrix(*a), atol=1e-6)
    back = {r.volume_id: volumes.shaped(r) for r in volumes.rotated(vols, poses, inverse=True).collect()}
    assert all(np.corrcoef(v.ravel(), truth.ravel())[0, 1] > 0.95 for v in back.values())
    noisy = k.rotate(truth, np.array([90.0, 0, 0, 0, 0, 0])) + rng.normal(0, 0.02, truth.shape)
    (best,) = volumes.match(spark.createDataFrame([(0, [n] * 3, [float(x) for x in noisy.ravel()])], volumes.VOLUME), truth, psf, candidates.filter("volume_id = 0")).collect()
    assert np.allclose(k.rotation_matrix(best.rot1, best.rot2, best.rot3), k.rotation_matrix(90, 0, 0), atol=1e-6)


def test_extract_and_recenter(spark):
    v = np.arange(6**3, dtype=float).reshape(6, 6, 6)
    images = spark.createDataFrame([(1, [6, 6, 6], v.ravel().tolist())], "image_id long, shape array<int>, data array<double>")
    boxes = spark.createDataFrame([(1, "a", 1, 2, 3, 3, 4, 5), (1, "b", -1, 0, 4, 2, 3, 7)], "image_id long, box_id string, x1 int, y1 int, z1 int, x2 int, y2 int, z2 int")
    got = {r.box_id: volumes.shaped(r) for r in volumes.extract(images, boxes).collect()}
    assert (got["a"] == v[3:5, 2:4, 1:3]).all() and got["b"].shape == (3, 3, 3) and (got["b"][:2, :, 1:] == v[4:6, 0:3, 0:2]).all() and not got["b"][2].any()


def test_nms_and_groups_match_plain_python(spark):
    rng = np.random.default_rng(4)
    rows = [(1 + i % 3, f"{i:03d}", *map(int, lo), *map(int, lo + rng.integers(3, 9, 3)), float(rng.integers(0, 20))) for i, lo in enumerate(rng.integers(0, 15, (90, 3)))]
    boxes = spark.createDataFrame(rows, "image_id int, box_id string, x1 int, y1 int, z1 int, x2 int, y2 int, z2 int, score double")

    def iou(a, b):
        inter = np.prod([max(0, min(a[5 + i], b[5 + i]) - max(a[2 + i], b[2 + i])) for i in range(3)])
        return inter / (np.prod([a[5 + i] - a[2 + i] for i in range(3)]) + np.prod([b[5 + i] - b[2 + i] for i in range(3)]) - inter)

    want, groups = set(), {}
    for image in (1, 2, 3):
        kept = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[8], r[1])):
            if all(iou(r, s) <= 0.2 for s in kept):
                kept.append(r)
        want |= {r[1] for r in kept}
        leaders = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: r[1]):
            mine = next((s for s in leaders if iou(r, s) > 0), None)
            if mine is None:
                leaders.append(r)
            groups[r[1]] = (mine or r)[1]
    assert {r.box_id for r in detection.suppress(boxes, 0.2).collect()} == want
    assert {r.box_id: r.group_id for r in detection.star_groups(boxes).collect()} == groups
    pairs = detection.overlap_join(boxes, boxes).collect()
    assert len(pairs) == len({(r.p_box_id, r.q_box_id) for r in pairs}) == sum(a[0] == b[0] and iou(a, b) > 0 for a in rows for b in rows)


def test_rotation_between_opposite(spark):
    from pyspark.sql import functions as F

    r = geometry.rotation_between([F.lit(x) for x in (0.0, 0.0, 1.0)], [F.lit(x) for x in (0.0, 0.0, -1.0)])
    (row,) = spark.range(1).select(*(r[i][2].alias(f"c{i}") for i in range(3))).collect()
    assert np.allclose(list(row), [0, 0, -1])


def test_family_distance_is_zero_for_a_common_rotation(spark):
    from pyspark.sql import functions as F

    p = spark.createDataFrame([(i, i // 3, float(37 * i % 360), float(20 + 11 * i % 140), float(53 * i % 360)) for i in range(6)], "pose_id long, family long, rot1 double, rot2 double, rot3 double")
    turned = p.withColumn("rot1", F.col("rot1") + 25.0 * (1 + F.col("family")))
    assert all(r.angle < 1e-3 for r in geometry.family_distances(p, turned, 1, "family").collect())
    assert max(r.angle for r in geometry.family_distances(p.withColumn("family", F.lit(0)), turned.withColumn("rot2", F.col("rot2") + 9.0 * F.col("family")), 1, "family").collect()) > 1


def test_files(spark, tmp_path):
    poses = spark.createDataFrame([("b.tiff", 1.0, 2.0, 3.0, 0.5, 0.0, -1.0), ("a.tiff", 4.0, 5.0, 6.0, 0.0, 0.0, 0.0)], files.POSES)
    files.write_poses(poses, str(tmp_path / "poses"))
    assert [tuple(r) for r in files.read_poses(spark, str(tmp_path / "poses")).collect()] == sorted(map(tuple, poses.collect()))
    boxes = spark.createDataFrame([("0", 0.0, 1.0, 2.0, 4.0, 5.0, 8.0)], files.BOXES)
    assert files.centers_to_boxes(files.boxes_to_centers(boxes)).collect()[0][1:] == (0.0, 1.0, 2.0, 4.0, 5.0, 8.0)
    (tmp_path / "m.json").write_text('{"markups": [{"center": [1, 2, 3], "size": [4, 9, 5]}]}')
    (m,) = files.read_markups(spark, str(tmp_path / "m.json")).collect()
    assert (m.x, m.y, m.z, m.size) == (1, 2, 3, 9)
    v = spark.createDataFrame([("a.b.tiff", "07", 1)], files.VIEWS)
    assert files.patch_names(v).collect()[0].patch == "a.b_07.tiff"
    desc = b"hello\0"
    entries = [(256, 4, 1, 30), (257, 3, 1, 20), (258, 3, 1, 16), (270, 2, len(desc), 200), (282, 5, 1, 210), (296, 3, 1, 3)]
    ifd = struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHI", *e[:3]) + (struct.pack("<HH", e[3], 0) if e[1] == 3 else struct.pack("<I", e[3])) for e in entries) + struct.pack("<I", 0)
    raw = (b"II*\0" + struct.pack("<I", 8) + ifd).ljust(200, b"\0") + desc.ljust(10, b"\0") + struct.pack("<II", 100000, 1)
    os.makedirs(tmp_path / "t")
    (tmp_path / "t/x.ome.tiff").write_bytes(raw)
    (tmp_path / "t/bad.tif").write_bytes(b"no")
    got = {r.path.rpartition("/")[2]: r for r in files.image_metadata(spark, str(tmp_path / "t")).collect()}
    r = got["x.ome.tiff"]
    assert (r.width, r.height, r.pages, r.bits, r.description) == (30, 20, 1, 16, "hello") and abs(r.voxel_xy - 0.1) < 1e-9
    assert got["bad.tif"].width is None
    found = files.registry(spark, str(tmp_path / "t"))
    assert files.stale(found, found.select("path", "sha256")).count() == 0


def test_streaming(spark, tmp_path):
    from pyspark.sql import functions as F

    src, dst, wait, ck = (str(tmp_path / x) for x in ("src", "dst", "wait", "ck"))

    def arrive(*rows):
        spark.createDataFrame(rows, "path string, modificationTime string, length long").withColumn("modificationTime", F.col("modificationTime").cast("timestamp")).write.mode("append").parquet(src)

    def imported(clock):
        now = F.lit(f"2024-01-0{clock}").cast("timestamp")
        arrivals.import_stream(arrivals.listings(spark, src), dst, wait, ck, 30, now).awaitTermination(120)
        arrivals.import_pending(spark, dst, wait, 30, now)
        return sorted(r.path for r in spark.read.parquet(dst).collect())

    arrive(("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 11:59:50", 2), (None, None, None), ("n", None, 1))
    assert imported("1 12:00:00") == ["a"]
    # an old file arrives late, a listing is repeated, one that waits is still written to
    arrive(("c", "2023-01-01 01:00:00", 3), ("a", "2024-01-01 00:00:00", 1), ("b", "2024-01-01 12:00:20", 4))
    assert imported("1 12:00:30") == ["a", "c"]
    assert imported("2 00:00:00") == ["a", "b", "c"]
    assert [r.length for r in spark.read.parquet(dst).filter("path = 'b'").collect()] == [4]
    got = []
    arrivals.each_batch(arrivals.listings(spark, src), str(tmp_path / "ck2"), lambda df, i: got.append(df.count())).awaitTermination(60)
    assert sum(got) == 7


def test_patterns(spark):
    paths = spark.createDataFrame([(p,) for p in ("/a/img_001.tif", "/a/img_12.tif", "/b/img_003.tif", "/a/x.tif")], "path string")
    assert {(r.path, r.file_id) for r in sets.match_files(paths, "/a/img_###.tif").collect()} == {("/a/img_001.tif", 1)}
    assert sets.match_files(paths, "/?/*.tif").count() == 4
    assert sets.latest_epoch(paths, "img_([0-9]+)").collect()[0].path == "/a/img_12.tif"


def test_scoring(spark):
    patches = spark.createDataFrame([(1, 0, 0, 0, [1.0, 2.0, 3.0]), (1, 0, 0, 1, [5.0, 5.0, 5.0])], "image_id int, z int, y int, x int, data array<double>")
    (r,) = detection.score_patches(patches, lambda a: a.mean(1) - 0.25).collect()
    assert r.x == 0 and abs(r.score - 0.25) < 1e-9
    kept = detection.score_patches(patches, lambda a: a.mean(1) - 0.25, keep_above=-1.0)
    assert {r.x: round(r.score, 6) for r in metrics.top_per_group(kept, ["image_id"], [kept.score.desc()], 2).collect()} == {0: 0.25, 1: -0.25}


def test_learning(spark):
    from voxmill.operators import learning

    rng = np.random.default_rng(5)
    pts = np.concatenate([rng.normal(c, 0.5, (60, 3)) for c in (0, 6)])
    rows = spark.createDataFrame([(1, *map(float, p), int(i >= 60)) for i, p in enumerate(pts)], "image_id int, z double, y double, x double, cls int")
    labelled, centers = learning.kmeans(rows, ["z", "y", "x"])
    assert len({(r.cls, r.label) for r in labelled.collect()}) == 2 and np.allclose(np.sort(centers[:, 0]), [0, 6], atol=0.4)
    normal, intercept = learning.separating_plane(rows, ["z", "y", "x"], "cls")
    assert ((pts @ normal + intercept > 0) == (np.arange(120) >= 60)).all()
    low, high = learning.two_gaussians(rows, "z")
    assert abs(low) < 0.4 and abs(high - 6) < 0.4
    axes, sizes = learning.principal_axes(rows, ["z", "y", "x"])
    c = pts - pts.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(sizes, s) and abs(abs(axes[0] @ v[0]) - 1) < 1e-9
    assert {r.cluster for r in learning.dbscan(rows.drop("cls"), 1.5, 4).collect()} >= {1, 2}
    v = np.zeros((4, 4, 12))
    v[1:3, 1:3, 1:3] = v[1:3, 1:3, 9:11] = 1
    vols = spark.createDataFrame([(7, [4, 4, 12], v.ravel().tolist())], volumes.VOLUME)
    got = learning.separate(vols).collect()
    assert len(got) == 16 and len({r.part for r in got if r.x < 6}) == 1 and len({r.part for r in got}) == 2


def test_synthesis(spark):
    from voxmill.operators import synthesis as syn

    pts = syn.in_sphere(spark, 4000, 2.0, 3)
    p = np.array([(r.z, r.y, r.x) for r in pts.collect()])
    r = np.linalg.norm(p, axis=1)
    assert r.max() <= 2 and abs((r**3).mean() - 4) < 0.2 and np.abs(p.mean(0)).max() < 0.1
    assert [tuple(x) for x in pts.repartition(7).orderBy("id").collect()] == [tuple(x) for x in pts.orderBy("id").collect()]
    left = syn.dig(pts, (0, 0, 0), 1.0, 1).count()
    assert 0.3 * 4000 < left < 0.9 * 4000
    moved = syn.move(syn.shrink(pts, 2.0), (90, 0, 0, 1, 0, 0)).orderBy("id").collect()
    want = p / 2 @ k.rotation_matrix(90, 0, 0).T + [1, 0, 0]
    assert np.allclose([(m.z, m.y, m.x) for m in moved], want)
    one = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "id long, z double, y double, x double")
    grid = {(g.z, g.y, g.x): g.v for g in syn.voxelise(one, 9, 1.0).collect()}
    assert abs(grid[4, 4, 4] - 1) < 1e-12 and abs(grid[4, 4, 5] - np.exp(-0.5)) < 1e-12
    noisy = np.array([g.v for g in syn.add_noise(spark.range(20000).selectExpr("id as z", "id as y", "id as x", "1.0D as v"), 10, 2).collect()])
    assert abs(noisy.std() - 10**-0.5) < 0.01 and abs(noisy.mean() - 1) < 0.01
    assert syn.cylinder(spark).count() == 180 and syn.random_poses(spark, 10, 1.0, 4).count() == 10
    a = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 9.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "image_id int, z double, y double, x double")
    b = spark.createDataFrame([(1, 2.9, 0.0, 0.0)], "image_id int, z double, y double, x double")
    assert {(x.image_id, x.z) for x in syn.apart(a, b, 3.0).collect()} == {(1, 9.0), (2, 0.0)}


def test_losses(spark):
    import math

    from voxmill.operators import losses

    rng = np.random.default_rng(6)
    logits, target = rng.normal(0, 2, 60), (rng.random(60) < 0.3).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(logits, target, strict=True)], "logit double, target int")
    got = losses.positive_unlabelled(rows, 0.25, 0.5).first()
    p = 1 / (1 + np.exp(-logits))
    bce = -np.log(p[target == 1]).mean()
    q, n = p[target == 0], int((target == 0).sum())
    w = np.exp(-0.5 * (q.sum() - np.arange(n + 1)) ** 2 / ((q * (1 - q)).sum() + 1e-10))
    binom = np.array([math.log(math.comb(n, i)) + i * math.log(0.25) + (n - i) * math.log(0.75) for i in range(n + 1)])
    penalty = -(binom * w).sum() / w.sum()
    assert abs(got.positives - bce) < 1e-9 and abs(got.penalty - penalty) < 1e-6 and abs(got.loss - bce - 0.5 * penalty) < 1e-6
    t = spark.createDataFrame([(1.0, 0.5), (2.0, 0.0)], "loss double, eta double")
    assert abs(losses.multi_task(t).first().total - (math.exp(-0.5) + 0.5 + 2)) < 1e-12
    seg = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(logits, rng.integers(0, 3, 60), strict=True)], "c int, logit double, label int")
    lab = np.array([r.label for r in seg.collect()])
    want = -(p[lab == 1].mean() - p[lab > 1].mean() + 0.1 * p.sum() / ((lab == 1).sum() + (lab > 1).sum()))
    assert abs(losses.inside_outside(seg, "c", 1.0, 0.1).first().loss - want) < 1e-9
    ch = spark.createDataFrame([(0, 1.0, 1.0), (0, 0.0, 0.0), (1, 0.0, 0.0), (1, 1.0, 1.0)], "channel int, p double, t double")
    assert abs(losses.generalised_dice(ch).first().loss) < 1e-9
    wce = spark.createDataFrame([(0, [0.5, 0.5]), (1, [0.5, 0.5])], "label int, p array<double>")
    assert abs(losses.weighted_cross_entropy(wce).first().loss - math.log(2)) < 1e-9
    h = spark.createDataFrame([(0.5, 0.0), (3.0, 0.0)], "guess double, target double")
    assert abs(losses.smooth_l1(h).first().loss - (0.125 + 2.5) / 2) < 1e-12


def test_augmentation():
    from voxmill.functions import augment as aug

    v = np.random.default_rng(7).random((6, 7, 8))
    policy = aug.compose([(1, aug.flip(0)), (1, aug.flip(0)), (1, aug.transpose((2, 1, 0))), (1, aug.pad_to((10, 10, 10))), (1, aug.center_crop((8, 7, 6)))])
    assert np.allclose(policy(v, 1), v.transpose(2, 1, 0))
    for step in (aug.gaussian_noise(), aug.quarter_turn((1, 2)), aug.rotate((10, 10, 10)), aug.scale((0.9, 1.1)), aug.normalize(), aug.gamma(), aug.random_crop((3, 3, 3)), aug.random_crop((3, 3, 3), lambda a: a > 0.99), aug.elastic(), aug.remove_border()):
        f = aug.compose([(1, step)])
        assert np.array_equal(f(v, 5), f(v, 5)) and np.isfinite(f(v, 5)).all()
    assert np.array_equal(aug.compose([(1, aug.flip(1))], share=0)(v, 3), v)
    w = np.zeros((6, 6, 6))
    w[2:4, 1:5, 3] = 1
    assert aug.compose([(1, aug.remove_border())])(w, 0).shape == (2, 4, 1)


def test_alignment_kernels():
    n = 9
    v = blob(n, (4, 4, 4), 1.2) + 0.7 * blob(n, (4, 6, 4), 0.8)
    candidates = np.array([[a, b, 0, 0, 0, 0] for a in (0, 90, 180, 270) for b in (0, 90)], float)
    parts = [v, k.rotate(v, np.array([90, 0, 0, 0, 0, 0]), inverse=True), k.rotate(v, np.array([180, 0, 0, 0, 0, 0]), inverse=True)]
    mean, poses = k.iterative_average(parts, candidates, 1)
    assert mean.shape == v.shape and np.isfinite(poses).all() and mean.std() > 0.9 * v.std()
    assert k.suppress_outliers([v, v, v + 5, v], 3) == [0, 1, 3]
    y, x = np.mgrid[:33, :33] - 16.0
    image = lambda t: np.exp(-((x - 9 * np.cos(t)) ** 2 + (y - 9 * np.sin(t)) ** 2) / 8)
    assert abs(k.in_plane_angle(image(0.3), image(0.3 + np.radians(40))) - 40) <= 2
    mask = np.zeros((7, 7, 7), bool)
    mask[3, 3, 3] = True
    assert k.dilate(mask).sum() == 7 and (k.erode(k.dilate(mask)) == mask).all()
    scene = blob(21, (10, 10, 10), 2.0)
    out = k.foreground_mask(scene, grow=1)
    assert out[10, 10, 10] and not out[0, 0, 0]


def test_postprocess(spark):
    v = np.zeros((16, 16, 16))
    v[4:8, 4:8, 4:8] = 1
    images = spark.createDataFrame([(1, [16] * 3, v.ravel().tolist())], "image_id long, shape array<int>, data array<double>")
    boxes = spark.createDataFrame([(1, "a", 2, 3, 4, 8, 9, 10, 0.9), (1, "b", 3, 3, 3, 9, 9, 9, 0.8)], "image_id long, box_id string, x1 int, y1 int, z1 int, x2 int, y2 int, z2 int, score double")
    got = {}
    for r in detection.postprocess(images, boxes).collect():
        got.setdefault(r.step, []).append((r.x1, r.y1, r.z1, r.x2, r.y2, r.z2))
    assert len(got["raw"]) == 2 and got["nms"] == [(2, 3, 4, 8, 9, 10)]
    (last,) = got["last_step"]
    assert np.allclose([(last[i] + last[i + 3]) / 2 for i in range(3)], [5.5] * 3, atol=0.6)
    assert detection.keep_bright(images, boxes).count() >= 1


def test_more_kernels():
    mask = np.zeros((2, 7, 7), bool)
    mask[0, [1, 1, 5, 5], [1, 5, 1, 5]] = True
    out = k.hull_fill(mask)
    assert out[0, 1:6, 1:6].all() and out.sum() == 25
    v = np.random.default_rng(8).random((8, 8, 8))
    assert np.allclose(k.keep_low_frequencies(v, 8), v) and k.keep_low_frequencies(v, 2).std() < v.std()
    assert np.array_equal(k.keep_low_frequencies(v, 2, 3), k.keep_low_frequencies(v, 2, 3))
    assert k.to_bytes(np.array([0, 255] * 999 + [300, 9])).dtype == np.uint8
    assert k.to_bytes(np.arange(1000)).dtype == np.int16 and k.to_bytes(np.arange(1000), True).max() == 255
    axis = np.array([0.2, 0.5, -0.8])
    assert np.allclose(k.axis_rotation(axis) @ [1, 0, 0], axis / np.linalg.norm(axis))
    rod = np.zeros((15, 15, 15))
    rod[1:14, 6:9, 6:9] = 1
    assert abs(abs(k.symmetry_axis(rod, 0.5)[0]) - 1) < 1e-6
    y, x = np.mgrid[:21, :21] - 10.0
    ring = sum(np.exp(-((x - 2 - 5 * np.cos(t)) ** 2 + (y + 1 - 5 * np.sin(t)) ** 2) / 2) for t in 2 * np.pi * np.arange(4) / 4)
    assert np.allclose(k.ring_center(ring, 4, 0.5), [1, -2], atol=0.6)


def test_more_operators(spark, tmp_path):
    from pyspark.sql import functions as F

    from voxmill.operators import voxels

    b = spark.createDataFrame([(1, "a", 0, 0, 0, 4, 3, 2)], "image_id int, box_id string, x1 int, y1 int, z1 int, x2 int, y2 int, z2 int")
    got = {(r.z, r.y, r.x) for r in detection.box_edges(b, F.lit("red")).collect()}
    want = {(z, y, x) for z in range(2) for y in range(3) for x in range(4) if (z in (0, 1)) + (y in (0, 2)) + (x in (0, 3)) >= 2}
    assert got == want
    cols = "p_rot1 double, p_rot2 double, p_rot3 double, p_t1 double, p_t2 double, p_t3 double, p_h1 double, p_h2 double, p_h3 double"
    rows = [((0.0,) * 6 + (1.0,) * 3, (0.0, 0.0, 0.0, 0.0, 0.0, 2.5) + (1.0,) * 3, False), ((0.0,) * 6 + (1.0,) * 3, (45.0, 0.0, 0.0, 0.0, 0.0, 2.3) + (1.0,) * 3, True), ((0.0,) * 6 + (1.0,) * 3, (45.0, 0.0, 0.0, 0.0, 0.0, 2.5) + (1.0,) * 3, False)]
    df = spark.createDataFrame([(*p, *q, w) for p, q, w in rows], f"{cols}, {cols.replace('p_', 'q_')}, want boolean")
    assert all(r.got == r.want for r in df.select("want", geometry.oriented_boxes_meet("p_", "q_").alias("got")).collect())
    s = spark.createDataFrame([(0.1, 0.2, 5.0), (0.9, 1.2, 7.0)], "y double, x double, value double")
    grid = {(r.gy, r.gx): r.value for r in voxels.nearest_grid(s, 1.0).collect()}
    assert grid[0, 0] == 5 and grid[1, 1] == 7 and grid[2, 2] == 7
    items = spark.createDataFrame([(1, "a", True), (1, "b", False), (1, "c", True)], "set_id int, name string, enabled boolean")
    data = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "set_id int, key string, v double")
    out = sets.copy_items(items, data, ["name"], ["key"], {"w": F.col("v") * 2}, F.col("v") < 2)
    assert [(r["name"], r.w) for r in out.collect()] == [("a", 2.0)]
    sets.store(items, str(tmp_path / "s1"), ["s0"], "transform", str(tmp_path / "lineage"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "lineage")).collect()] == [("s0", str(tmp_path / "s1"), "transform")]
    assert items.agg(sets.consistent(items, "set_id").alias("c")).first().c
    p = spark.createDataFrame([(1, "a", 0, 0, 0, 4, 4, 4), (1, "b", 9, 9, 9, 12, 12, 12)], "image_id int, box_id string, x1 int, y1 int, z1 int, x2 int, y2 int, z2 int")
    t = spark.createDataFrame([(1, "t", 0, 0, 0, 4, 4, 4), (1, "u", 20, 0, 0, 24, 4, 4)], p.schema)
    assert {(r.box_id, r.verdict) for r in detection.verdicts(p, t).collect()} == {("a", "hit"), ("b", "fp"), ("t", "tp"), ("u", "fn")}


def test_simulation_and_refinement(spark):
    n = 9
    truth = blob(n, (4, 4, 4), 1.2) + 0.6 * blob(n, (6, 4, 3), 0.9)
    rows = [(i, float(90 * (i % 4)), float(90 * (i % 2)), 0.0, 0.0, 0.0, 0.0) for i in range(5)]
    schema = "volume_id long, rot1 double, rot2 double, rot3 double, t1 double, t2 double, t3 double"
    poses = spark.createDataFrame(rows, schema)
    made = volumes.simulate(poses, truth, (0, 0, 0), 20.0, 1000.0, 4)
    a = {r.volume_id: volumes.shaped(r) for r in made.collect()}
    b = {r.volume_id: volumes.shaped(r) for r in volumes.simulate(poses.repartition(3), truth, (0, 0, 0), 20.0, 1000.0, 4).collect()}
    assert all(np.array_equal(a[i], b[i]) for i in a)
    assert all(np.corrcoef(a[i].ravel(), k.rotate(truth, np.array(rows[i][1:])).ravel())[0, 1] > 0.95 for i in a)
    psf = np.zeros((3, 3, 3))
    psf[1, 1, 1] = 1
    clean = volumes.simulate(poses, truth, (0, 0, 0))
    found, better = volumes.refine(clean, poses, psf, [(20.0, 2)], 1e-6)
    assert found.shape == truth.shape and better.count() == 5
    rod = np.zeros((9, 9, 9))
    rod[4, 1:8, 4] = 1
    turn = volumes.smallest_footprint(rod, np.array([[0, 0, 0, 0, 0, 0], [0, 90, 0, 0, 0, 0]], float))
    assert turn[1] == 90


def test_energies_are_equal_whatever_the_order(spark, tmp_path):
    """Two days of one mean, whose sums of doubles differ: the earlier is best, and the later is as good."""
    from voxmill.plans.queries import agg_best_candidate, agg_running_best

    days = {"2024-01-22": [23.8, 10.28], "2024-01-27": [25.67, 25.34, 10.9, 4.45, 18.84]}
    rows = [(1312, day, v) for _ in range(6) for day, values in days.items() for v in values]
    more = [(7, "2024-01-01", None), (8, "2024-01-01", 1e300), (8, "2024-01-01", 0.0), (9, "2024-01-01", 1 / 3), (9, "2024-01-01", 1 / 6), (10, "2024-01-01", float("nan"))]
    df = spark.createDataFrame(rows + more, "user_id long, day string, value double").selectExpr("user_id", "cast(day as timestamp) as ts", "value")
    df.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    best = {r.view_id: (r.epoch, r.energy) for r in agg_best_candidate(spark, str(tmp_path)).collect()}
    assert best[1312] == (21, 17.04) and best[7] == (0, None) and best[8][1] == 5e299 and best[9][1] == 0.25 and np.isnan(best[10][1])
    steps = {r.epoch: (r.best, r.is_best) for r in agg_running_best(spark, str(tmp_path)).filter("view_id = 1312").collect()}
    assert steps == {21: (17.04, True), 26: (17.04, True)}


def test_zscore_computes_mean_and_deviation_once(spark):
    """The work grows with the number of values, not with its cube: 4,000 values would take minutes."""
    import time

    from pyspark.sql import functions as F

    from voxmill.operators import voxels

    v = np.random.default_rng(3).random(4000) * 9 - 4
    df = spark.createDataFrame([(v.tolist(),), ([2.0, 2.0],), ([],), (None,)], "data array<double>")
    begun = time.monotonic()
    got = [r[0] for r in df.select(voxels.zscore(F.col("data"))).collect()]
    assert time.monotonic() - begun < 30
    assert np.allclose(got[0], (v - v.mean()) / v.std()) and got[1] == [0.0, 0.0] and got[2] == [] and got[3] is None
