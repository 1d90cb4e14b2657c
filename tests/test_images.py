"""Image files against arrays that are known, splines, density clusters and small set operations."""

import struct
import zlib

import numpy as np
import pytest

from voxmill.functions import kernels as k
from voxmill.operators import learning, sets
from voxmill.sources import images


def plain_tiff(pages, description=b"", order="<", big=False, deflate=False, predictor=1, unit=None, resolution=None, samples=1):
    """A TIFF file with one or two strips a page, written by hand."""
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    mark = b"II" if order == "<" else b"MM"
    out = bytearray(mark + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = 8 if big else 4
    for i, page in enumerate(pages):
        height, width = page.shape[:2]
        values = page.copy()
        if predictor == 2:
            values[:, 1:] = page[:, 1:] - page[:, :-1]
        raw = values.astype(values.dtype.newbyteorder(order))
        strips = [raw[: height // 2].tobytes(), raw[height // 2 :].tobytes()]
        strips = [zlib.compress(s) for s in strips] if deflate else strips
        at = []
        for s in strips:
            at.append(len(out))
            out += s
        lists = len(out)
        out += struct.pack(f"{order}2I2I", *at, *map(len, strips))
        text = len(out)
        out += description + b"\0"
        ratio = len(out)
        out += struct.pack(order + "4I", *(resolution or (1, 1)), *(resolution or (1, 1)))
        tags = [(256, 4, 1, width), (257, 4, 1, height), (258, 3, 1, 8 * page.dtype.itemsize), (259, 3, 1, 8 if deflate else 1)]
        tags += [(270, 2, len(description) + 1, text)] if description and i == 0 else []
        tags += [(273, 4, 2, lists), (277, 3, 1, samples), (279, 4, 2, lists + 8)]
        tags += [(282, 5, 1, ratio), (283, 5, 1, ratio + 8)] if resolution else []
        tags += [(296, 3, 1, unit)] if unit else []
        tags += [(317, 3, 1, predictor), (339, 3, 1, {"u": 1, "i": 2, "f": 3}[page.dtype.kind])]
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + count, len(tags))
        for tag, kind, n, value in tags:
            size = {2: 1, 3: 2, 4: 4, 5: 8}[kind] * n
            inline = struct.pack(order + {3: "H", 4: "I"}.get(kind, "I"), value) if size <= struct.calcsize(word) and kind in (3, 4) and n == 1 else struct.pack(order + word, value)
            if big and (kind, n) in ((4, 2), (5, 1)):
                inline = out[value : value + 8]
            out += struct.pack(order + "HH" + word, tag, kind, n) + bytes(inline).ljust(struct.calcsize(word), b"\0")
        link = len(out)
        out += struct.pack(order + word, 0)
    return bytes(out)


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "i4", "f4", "f8"])
@pytest.mark.parametrize("deflate", [False, True])
def test_ome_round_trip(dtype, deflate):
    rng = np.random.default_rng(1)
    data = (rng.random((2, 3, 4, 5)) * 200).astype(dtype)
    t = images.parse(images.encode(data, (0.1, 0.3), deflate))
    assert images.describe(t) == {"dim_x": 5, "dim_y": 4, "dim_z": 3, "n_channels": 2, "voxel_xy": 0.1, "voxel_z": 0.3, "kind": "ome"}
    assert (images.volume(t) == data).all() and images.volume(t).dtype == data.dtype
    assert (images.volume(t, "XYZC") == data.transpose(3, 2, 1, 0)).all()


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("big", [False, True])
def test_plain_stacks(order, big):
    rng = np.random.default_rng(2)
    pages = rng.integers(0, 60000, (3, 4, 6)).astype("u2")
    for deflate, predictor in ((False, 1), (True, 2)):
        t = images.parse(plain_tiff(pages, order=order, big=big, deflate=deflate, predictor=predictor, unit=3, resolution=(100000, 1)))
        assert (images.volume(t) == pages[None]).all()
        got = images.describe(t)
        assert (got["dim_x"], got["dim_y"], got["dim_z"], got["n_channels"], got["kind"]) == (6, 4, 3, None, "plain") and abs(got["voxel_xy"] - 0.1) < 1e-12
    assert images.describe(images.parse(plain_tiff(pages, unit=2, resolution=(254, 1))))["voxel_xy"] == 100.0
    assert images.describe(images.parse(plain_tiff(pages)))["voxel_xy"] is None


def test_imagej_stacks():
    pages = np.arange(2 * 3 * 4 * 5).astype("u2").reshape(6, 4, 5)
    text = b"ImageJ=1.53\nimages=6\nchannels=2\nslices=3\nunit=micron\nspacing=0.4\n"
    t = images.parse(plain_tiff(pages, text, resolution=(5, 1)))
    assert images.describe(t) == {"dim_x": 5, "dim_y": 4, "dim_z": 3, "n_channels": 2, "voxel_xy": 0.2, "voxel_z": 0.4, "kind": "imagej"}
    # channels are fastest
    assert (images.volume(t) == pages.reshape(3, 2, 4, 5).transpose(1, 0, 2, 3)).all()
    frames = images.parse(plain_tiff(pages, b"ImageJ=1.53\nimages=6\nframes=6\n"))
    assert images.describe(frames)["dim_z"] == 6 and images.describe(frames)["voxel_z"] is None


def test_ome_orders_and_times():
    data = np.arange(2 * 3 * 4 * 5).astype("u1").reshape(2, 3, 4, 5)
    raw = images.encode(data)
    t = images.parse(raw.replace(b'DimensionOrder="XYZCT"', b'DimensionOrder="XYCZT"'))
    assert (images.volume(t) == data.reshape(3, 2, 4, 5).transpose(1, 0, 2, 3)).all()
    times = images.parse(raw.replace(b'SizeC="2" SizeT="1"', b'SizeC="1" SizeT="2"'))
    assert (images.volume(times) == data).all() and images.describe(times)["n_channels"] == 2
    both = images.parse(raw.replace(b'SizeZ="3" SizeC="2" SizeT="1"', b'SizeZ="1" SizeC="2" SizeT="3"'))
    with pytest.raises(ValueError):
        images.volume(both)
    assert images.volume(both, "TCYX").shape == (3, 2, 4, 5)
    with pytest.raises(ValueError):
        images.describe(images.parse(images.encode(data, (0.1, 0.3)).replace(b'PhysicalSizeY="0.1"', b'PhysicalSizeY="0.2"')))
    nm = images.describe(images.parse(images.encode(data, (0.1, 0.3)).replace("µm".encode(), b"nm ".strip() + b" ")))
    assert nm["voxel_xy"] is None
    rgb = np.arange(4 * 5 * 3).astype("u1").reshape(4, 5, 3)
    assert (images.volume(images.parse(plain_tiff([rgb], samples=3))) == rgb.transpose(2, 0, 1)[:, None]).all()


def test_axes():
    data = np.arange(24).reshape(2, 3, 4)
    assert (images.reordered(data, "CYX", "XYC") == data.T).all()
    assert (images.reordered(data, "CYX", "YX", C=1) == data[1]).all()
    assert images.reordered(data, "CYX", "TCYX", C=[0]).shape == (1, 1, 3, 4)
    assert images.reordered(data, "CYX", "CYX", X=slice(0, 4, 2)).shape == (2, 3, 2)
    assert (images.reordered(data, "CYX", "YX") == data[0]).all()
    with pytest.raises(ValueError):
        images.transposed(data, "CYX", "CYZ")
    few = np.full(3000, 7)
    few[0] = 900
    assert images.as_bytes(few).max() == 255 and images.as_bytes(few).dtype == np.uint8
    many = np.arange(3000)
    assert images.as_bytes(many).dtype == np.int16 and images.as_bytes(many, rescale=True).max() == 255


def test_tables(spark, tmp_path):
    rng = np.random.default_rng(4)
    vols = spark.createDataFrame([(f"{i}.ome.tiff", [2, 3, 4], rng.random(24).round(3).tolist()) for i in range(3)], "name string, shape array<int>, data array<double>")
    sent = images.saved(images.encoded(vols, 0.2, 0.5), str(tmp_path / "out")).collect()
    assert {r.name for r in sent} == {"0.ome.tiff", "1.ome.tiff", "2.ome.tiff"}
    (tmp_path / "out" / "bad.tif").write_bytes(b"no image")
    (tmp_path / "out" / "short.tif").write_bytes(images.encode(np.zeros((1, 1, 2, 2), np.uint8))[:60])
    listed = images.listed(spark, str(tmp_path / "out"))
    skip = listed.filter("path like '%2.ome.tiff'").select("path")
    found = {r.path.rpartition("/")[2]: r for r in images.metadata(images.listed(spark, str(tmp_path / "out"), blacklist=skip)).collect()}
    assert set(found) == {"0.ome.tiff", "1.ome.tiff", "bad.tif", "short.tif"} and found["bad.tif"].error and found["short.tif"].error
    assert (found["0.ome.tiff"].dim_z, found["0.ome.tiff"].voxel_xy, found["0.ome.tiff"].voxel_z) == (2, 0.2, 0.5)
    pixels = {r.path.rpartition("/")[2]: r for r in images.decoded(listed).collect()}
    for r in vols.collect():
        assert np.allclose(pixels[r.name].data, r.data, atol=1e-6) and pixels[r.name].shape == [2, 3, 4]


def test_cubic_splines():
    rng = np.random.default_rng(5)
    v = rng.random((6, 7, 8))
    assert np.allclose(k.affine(v, np.eye(3), np.zeros(3), order=3), v)
    assert np.allclose(k.translate(v, (1, 0, 2), order=3)[1:, :, 2:], v[:-1, :, :-2])
    z, y, x = np.indices((14, 14, 14)).astype(float)
    f = lambda z, y, x: 0.1 * z**2 - 0.3 * y * z + x + 0.05 * x**2
    got = k.affine(f(z, y, x), np.eye(3), np.array([0.3, 0.6, 0.45]), order=3)[5:8, 5:8, 5:8]
    assert np.allclose(got, f(z + 0.3, y + 0.6, x + 0.45)[5:8, 5:8, 5:8], atol=2e-3)
    line = k.affine(f(z, y, x), np.eye(3), np.array([0.3, 0.6, 0.45]))[5:8, 5:8, 5:8]
    assert np.abs(line - f(z + 0.3, y + 0.6, x + 0.45)[5:8, 5:8, 5:8]).max() > 10 * np.abs(got - f(z + 0.3, y + 0.6, x + 0.45)[5:8, 5:8, 5:8]).max()
    two = np.stack([v, 2 * v])
    assert np.allclose(k.rotate(two, np.array([90.0, 0, 0, 0, 0, 0]), order=3)[1], 2 * k.rotate(v, np.array([90.0, 0, 0, 0, 0, 0]), order=3))
    assert k.centered(two, 3).shape == two.shape


def test_density_tree(spark):
    rng = np.random.default_rng(6)
    tight, loose = rng.normal(0, 0.2, (60, 3)), rng.normal(8, 1.0, (60, 3))
    noise = rng.uniform(-20, 30, (12, 3))
    got = k.density_tree(np.concatenate([tight, loose, noise]), 8)
    assert len(set(got[:60])) == 1 and got[0] > 0
    main = np.bincount(got[60:120]).argmax()
    assert main not in (0, got[0]) and (got[60:120] == main).mean() > 0.8
    assert (got[120:] == 0).mean() > 0.6
    assert (k.density_tree(tight[:4], 8) == 0).all()
    rows = spark.createDataFrame([(i // 60, *map(float, p)) for i, p in enumerate(np.concatenate([tight, loose]))], "image_id int, z double, y double, x double")
    assert learning.density_tree(rows, 8).count() == 120


def test_set_helpers(spark):
    paths = spark.createDataFrame([("/a/1.tif",), ("/a/2.tif",)], "path string")
    assert [r.path for r in sets.match_files(paths, "/a/*.tif", paths.filter("path like '%1.tif'")).collect()] == ["/a/2.tif"]
    deep = spark.createDataFrame([((1, (2.0, "x")), 3)], "a struct<b:int,c:struct<d:double,e:string>>, f int")
    assert sets.flattened(deep).columns == ["a_b", "a_c_d", "a_c_e", "f"] and tuple(sets.flattened(deep).first()) == (1, 2.0, "x", 3)
    images_ = spark.createDataFrame([(1, 7), (2, 7), (3, None)], "image_id int, psf_id int")
    assert sets.one_psf(images_).count() == 3
    with pytest.raises(Exception, match="one point spread function"):
        sets.one_psf(images_.unionByName(spark.createDataFrame([(4, 8)], "image_id int, psf_id int"))).collect()
    assert sets.told({"n": 3, "size": "4 x 4"}, "Set").split("\n")[1].strip("| ") == "Set"


def test_positive_unlabelled(spark):
    from voxmill.operators import pu

    v = np.zeros((12, 14, 16))
    v[4:9, 5:10, 6:11] = 1
    sets_ = spark.createDataFrame([(1, list(v.shape), v.ravel().tolist())], "image_id long, shape array<int>, data array<double>")
    u = pu.unlabelled(sets_, gamma=1.0, least=4, grow=1)
    n = len({r.at for r in u.collect()})
    assert {r.at for r in u.collect()} == set(np.flatnonzero(k.foreground_mask(v, 1.0, 4, 1)).tolist()) and 27 <= n <= 343 and (6 * 14 + 7) * 16 + 8 in {r.at for r in u.collect()}
    dims = spark.createDataFrame([(1, 12, 14, 16), (2, 2, 14, 16)], "image_id long, dim_z int, dim_y int, dim_x int")
    marks = spark.createDataFrame([(1, 6.0, 7.0, 8.0), (1, 0.0, 0.0, 0.0), (1, 11.0, 13.0, 15.0), (2, 1.0, 7.0, 8.0), (2, 1.0, 7.0, 8.0)], "image_id long, z double, y double, x double")
    assert sorted(r["rank"] for r in pu.chosen(marks).filter("image_id = 1").collect()) == [0, 1, 2]
    assert pu.chosen(marks, 2, epoch=1).count() == 2
    z, y, x = np.indices((12, 14, 16))
    ball = lambda a, b, c: (z - a) ** 2 + (y - b) ** 2 + (x - c) ** 2 <= 4
    got = pu.positives(dims, pu.chosen(marks), 2)
    assert {r.at for r in got.filter("image_id = 1").collect()} == set(np.flatnonzero(ball(6, 7, 8) | ball(2, 2, 2) | ball(9, 11, 13)).tolist())
    z, y, x = np.indices((2, 14, 16))
    assert {r.at for r in got.filter("image_id = 2").collect()} == set(np.flatnonzero(ball(1, 7, 8)).tolist())
    assert pu.expected_share(u, 1, 2, 2).first().share == 33 * 2 / n
    assert pu.expected_share(u.limit(0), 1, 2, 2).first().share is None
