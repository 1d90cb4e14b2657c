"""Image files: TIFF, OME-TIFF and ImageJ stacks as tables of metadata and of pixels, and back.

A file is parsed from its bytes (the content column of Spark's binaryFile source), one file at a time on the executors; only the wanted parts are touched.
Pixels are (channel, z, y, x); lengths are micrometres.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import MICROMETRES

METADATA = "dim_x int, dim_y int, dim_z int, n_channels int, voxel_xy double, voxel_z double, kind string, error string"
PIXELS = "channel int, shape array<int>, data array<double>, error string"

#: TIFF tags, the sizes of TIFF's field types, and pixel types of OME files.
_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _DESCRIPTION, _OFFSETS, _SAMPLES, _ROWS, _COUNTS = 256, 257, 258, 259, 270, 273, 277, 278, 279
_X_RESOLUTION, _Y_RESOLUTION, _UNIT, _PREDICTOR, _FORMAT = 282, 283, 296, 317, 339
_FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_OME_TYPE = {"uint8": "u1", "uint16": "u2", "uint32": "u4", "int8": "i1", "int16": "i2", "int32": "i4", "float": "f4", "double": "f8"}
_OME = "http://www.openmicroscopy.org/Schemas/OME/2016-06"


@dataclass
class Page:
    tags: dict[int, tuple] = field(default_factory=dict)

    def one(self, tag: int, default=None):
        found = self.tags.get(tag)
        return found[0] if found else default


@dataclass
class Tiff:
    """The pages of a file, and the bytes they lie in."""

    raw: bytes
    order: str
    pages: list[Page]

    @property
    def description(self) -> str:
        return (self.pages[0].one(_DESCRIPTION) or b"").rstrip(b"\0").decode("utf-8", "replace") if self.pages else ""

    def pixels(self, k: int) -> np.ndarray:
        """The (height, width) or (height, width, samples) array of a page: stored or deflated strips, with or without horizontal differences."""
        page = self.pages[k]
        width, height, samples = page.one(_WIDTH), page.one(_HEIGHT), page.one(_SAMPLES, 1)
        bits, kind = page.one(_BITS, 8), {1: "u", 2: "i", 3: "f"}[page.one(_FORMAT, 1)]
        if bits % 8 or _OFFSETS not in page.tags:
            raise ValueError("only strips of whole bytes can be read")
        packed = page.one(_COMPRESSION, 1)
        strips = [self.raw[o : o + n] for o, n in zip(page.tags[_OFFSETS], page.tags[_COUNTS], strict=True)]
        if packed in (8, 32946):
            strips = [zlib.decompress(s) for s in strips]
        elif packed != 1:
            raise ValueError(f"compression {packed} can't be read")
        flat = np.frombuffer(b"".join(strips), f"{self.order}{kind}{bits // 8}")
        out = flat[: height * width * samples].reshape(height, width, samples)
        if page.one(_PREDICTOR, 1) == 2:
            out = np.cumsum(out, axis=1, dtype=out.dtype)
        return out[:, :, 0] if samples == 1 else out


def parse(content: bytes) -> Tiff:
    """A classic or big TIFF of either byte order; ValueError for what isn't one."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(content[:2]))
    version = struct.unpack(order + "H", content[2:4])[0] if order and len(content) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    word, count_kind, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    word_size, count_size = struct.calcsize(word), struct.calcsize(count_kind)
    (at,) = struct.unpack_from(order + word, content, 8 if big else 4)
    pages, seen = [], set()
    while at and at not in seen and at + count_size <= len(content):
        seen.add(at)
        (n,) = struct.unpack_from(order + count_kind, content, at)
        page = Page()
        for i in range(n):
            e = at + count_size + entry * i
            tag, kind = struct.unpack_from(order + "HH", content, e)
            (count,) = struct.unpack_from(order + word, content, e + 4)
            code = _FIELD.get(kind)
            if code is None:
                continue
            size = struct.calcsize("=" + code) * count
            where = e + 4 + word_size
            if size > word_size:
                (where,) = struct.unpack_from(order + word, content, where)
            if kind == 2:
                page.tags[tag] = (bytes(content[where : where + count]),)
            else:
                page.tags[tag] = struct.unpack_from(f"{order}{code * count}" if kind == 5 else f"{order}{count}{code}", content, where)
        pages.append(page)
        (at,) = struct.unpack_from(order + word, content, at + count_size + entry * n)
    return Tiff(content, order, pages)


def _ratio(page: Page, tag: int) -> float | None:
    found = page.tags.get(tag)
    return found[1] / found[0] if found and found[0] else None


def _imagej(description: str) -> dict[str, str]:
    return dict(line.partition("=")[::2] for line in description.split("\n") if "=" in line) if description.startswith("ImageJ=") else {}


def _ome_pixels(description: str) -> dict[str, str] | None:
    """The attributes of the first Pixels element, or None for what isn't OME-XML."""
    if "<OME" not in description:
        return None
    try:
        root = ElementTree.fromstring(description.encode())
    except ElementTree.ParseError:
        return None
    pixels = next((x for x in root.iter() if x.tag.rpartition("}")[2] == "Pixels"), None)
    return None if pixels is None else dict(pixels.attrib) | {"channels": str(sum(x.tag.rpartition("}")[2] == "Channel" for x in pixels))}


def _length(attributes: dict[str, str], axis: str) -> float | None:
    """A physical size in micrometres; unknown units and no size give None."""
    value, unit = attributes.get(f"PhysicalSize{axis}"), attributes.get(f"PhysicalSize{axis}Unit", "µm")
    return float(value) * MICROMETRES[unit] if value and unit in MICROMETRES else None


def describe(t: Tiff) -> dict:
    """METADATA without error: dims, channels and voxel sizes; None for what a file doesn't tell.

    OME files with one channel and several times have the times as channels; their x and y sizes must agree. ImageJ stacks whose x and y spacing differ have no spacing in the plane.
    Other files are a stack in z, without a number of channels.
    """
    first, ome, ij = t.pages[0], _ome_pixels(t.description), _imagej(t.description)
    if ome is not None:
        size = {a: int(ome[f"Size{a}"]) for a in "XYZCT"}
        x, y = _length(ome, "X"), _length(ome, "Y")
        if x != y:
            raise ValueError("voxels differ in x and y")
        channels = size["T"] if size["C"] == 1 and size["T"] > 1 else size["C"]
        return {"dim_x": size["X"], "dim_y": size["Y"], "dim_z": size["Z"], "n_channels": channels, "voxel_xy": x, "voxel_z": _length(ome, "Z"), "kind": "ome"}
    unit = MICROMETRES.get(ij["unit"].replace("\\u00B5", "µ")) if "unit" in ij else None if ij else {2: MICROMETRES["inch"], 3: MICROMETRES["cm"]}.get(first.one(_UNIT))
    x, y = (_ratio(first, tag) for tag in (_X_RESOLUTION, _Y_RESOLUTION))
    x, y = (v * unit if v is not None and unit is not None else None for v in (x, y))
    out = {"dim_x": first.one(_WIDTH), "dim_y": first.one(_HEIGHT), "voxel_xy": x}
    if not ij:
        return out | {"dim_z": len(t.pages), "n_channels": None, "voxel_z": None, "kind": "plain"}
    depth = ij.get("slices", ij.get("frames"))
    spacing = float(ij["spacing"]) * unit if "spacing" in ij and unit is not None else None
    return out | {"dim_z": int(depth) if depth else None, "n_channels": int(ij.get("channels", 1)), "voxel_xy": x if x == y else None, "voxel_z": spacing, "kind": "imagej"}


def axes_of(t: Tiff) -> tuple[str, tuple[int, ...]]:
    """The axes of the pages, slowest first, and their sizes; the pages' own axes Y, X (and S for samples) are last."""
    first, ome, ij = t.pages[0], _ome_pixels(t.description), _imagej(t.description)
    if ome is not None:
        slow = ome["DimensionOrder"][:1:-1]
        samples = first.one(_SAMPLES, 1)
        sizes = [int(ome[f"Size{a}"]) // (samples if a == "C" else 1) for a in slow]
    elif ij:
        # an ImageJ stack counts channels first, then slices, then frames
        slow, sizes = "TZC", [int(ij.get(k, 1)) for k in ("frames", "slices", "channels")]
        if "slices" not in ij and "channels" not in ij and "frames" not in ij:
            sizes = [1, len(t.pages), 1]
    else:
        slow, sizes = "TCZ", [1, 1, len(t.pages)]
    own = ("YX", (first.one(_HEIGHT), first.one(_WIDTH)))
    if first.one(_SAMPLES, 1) > 1:
        own = ("YXS", (*own[1], first.one(_SAMPLES)))
    return slow + own[0], (*sizes, *own[1])


def transposed(data: np.ndarray, given: str, wanted: str) -> np.ndarray:
    """data with its axes in another order; both orders name the same axes once."""
    if sorted(given) != sorted(wanted) or len(set(given)) != len(given):
        raise ValueError(f"{given} and {wanted} differ in their axes")
    return data.transpose([given.index(a) for a in wanted])


def reordered(data: np.ndarray, given: str, wanted: str, **pick) -> np.ndarray:
    """data with the axes wanted: those named in pick are indexed by a number (which drops them), a list or a slice; others that are not wanted are cut at 0; new
    ones have size 1."""
    for a in list(given):
        if a in pick:
            chosen = pick[a]
            data = data[(slice(None),) * given.index(a) + (chosen if not isinstance(chosen, tuple) else list(chosen),)]
            if isinstance(chosen, int):
                given = given.replace(a, "")
        elif a not in wanted:
            data = data.take(0, axis=given.index(a))
            given = given.replace(a, "")
    for a in wanted:
        if a not in given:
            data, given = data[None], a + given
    return transposed(data, given, wanted)


def volume(t: Tiff, wanted: str = "CZYX") -> np.ndarray:
    """All pixels in the wanted axes. Times stand in for channels where there is one channel and T isn't wanted; other axes that are not wanted must have size 1."""
    axes, sizes = axes_of(t)
    n = int(np.prod(sizes[: len(axes.partition("Y")[0])]))
    if n > len(t.pages):
        raise ValueError(f"{n} pages were told and {len(t.pages)} found")
    data = np.stack([t.pixels(k) for k in range(n)]).reshape(sizes)
    if "S" in axes:
        # samples of a pixel are channels
        data = transposed(data, axes, axes.replace("S", "").replace("C", "CS"))
        axes = axes.replace("S", "")
        c = axes.index("C")
        data = data.reshape(*data.shape[:c], -1, *data.shape[c + 2 :])
    if "C" in wanted and "T" not in wanted and data.shape[axes.index("T")] > 1 and data.shape[axes.index("C")] == 1:
        axes = axes.translate(str.maketrans("TC", "CT"))
    for a in axes:
        if a not in wanted and data.shape[axes.index(a)] != 1:
            raise ValueError(f"axis {a} has size {data.shape[axes.index(a)]} and isn't wanted")
    return reordered(data, axes, wanted)


def as_bytes(data: np.ndarray, rescale: bool = False) -> np.ndarray:
    """Pixels as 16-bit numbers, or as bytes if under one in a thousand is over 255 (those become 255); rescale: others are stretched to 0 to 255."""
    data = data.astype(np.int16)
    if (data > 255).mean() < 1e-3:
        return np.minimum(data, 255).astype(np.uint8)
    if not rescale:
        return data
    low, high = int(data.min()), int(data.max())
    return ((data.astype(float) - low) / max(1, high - low) * 255).astype(np.uint8)


def encode(data: np.ndarray, voxel: tuple[float | None, float | None] = (None, None), deflate: bool = False) -> bytes:
    """An OME-TIFF file of (channel, z, y, x) pixels with its voxel size in the plane and in depth; a big TIFF if it has to be."""
    kind = f"{data.dtype.kind}{data.dtype.itemsize}"
    name = next((k for k, v in _OME_TYPE.items() if v == kind), None)
    if data.ndim != 4 or name is None:
        raise ValueError(f"{data.ndim} axes of {data.dtype} can't be written")
    c, z, y, x = data.shape
    sizes = "".join(f' PhysicalSize{a}="{v!r}" PhysicalSize{a}Unit="µm"' for a, v in (("X", voxel[0]), ("Y", voxel[0]), ("Z", voxel[1])) if v is not None)
    parts = "".join(f'<Channel ID="Channel:0:{i}" SamplesPerPixel="1"/>' for i in range(c))
    text = f'<?xml version="1.0" encoding="UTF-8"?><OME xmlns="{_OME}"><Image ID="Image:0"><Pixels ID="Pixels:0" DimensionOrder="XYZCT" Type="{name}" SizeX="{x}" SizeY="{y}" SizeZ="{z}" SizeC="{c}" SizeT="1"{sizes}>{parts}<TiffData/></Pixels></Image></OME>'.encode() + b"\0"
    pages = data.reshape(-1, y, x).astype(data.dtype.newbyteorder("<"))
    blocks = [zlib.compress(p.tobytes()) if deflate else p.tobytes() for p in pages]
    big = sum(map(len, blocks)) + len(text) + 256 * len(blocks) > 0xF0000000
    word, entry, count = ("Q", 20, "Q") if big else ("I", 12, "H")
    out = bytearray(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
    link = 8 if big else 4
    text_at = len(out)
    out += text
    for i, block in enumerate(blocks):
        at = len(out)
        out += block + b"\0" * (-len(block) % 8)
        tags = [(_WIDTH, 4, 1, x), (_HEIGHT, 4, 1, y), (_BITS, 3, 1, 8 * data.dtype.itemsize), (_COMPRESSION, 3, 1, 8 if deflate else 1), (262, 3, 1, 1)]
        tags += [(_DESCRIPTION, 2, len(text), text_at)] if i == 0 else []
        tags += [(_OFFSETS, 16 if big else 4, 1, at), (_SAMPLES, 3, 1, 1), (_ROWS, 4, 1, y), (_COUNTS, 16 if big else 4, 1, len(block)), (_FORMAT, 3, 1, {"u": 1, "i": 2, "f": 3}[data.dtype.kind])]
        struct.pack_into("<" + word, out, link, len(out))
        out += struct.pack("<" + count, len(tags))
        for tag, field_kind, n, value in tags:
            out += struct.pack("<HH" + word, tag, field_kind, n) + struct.pack("<" + word, value)
        link = len(out)
        out += struct.pack("<" + word, 0)
    return bytes(out)


def listed(spark: SparkSession, path: str, pattern: str = "*.tif*", blacklist: DataFrame | None = None) -> DataFrame:
    """(path, content) of the files of a folder, without those of blacklist (path)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return found if blacklist is None else found.join(blacklist.select("path"), "path", "left_anti")


def _each(rows: DataFrame, f, schema: str) -> DataFrame:
    """rows (content and more) with the columns of schema from f(bytes) -> list of dicts in the place of content. A file that can't be read has its reason in error."""
    names = [c.split()[0] for c in schema.split(", ")]
    others = [x for x in rows.schema if x.name != "content"]
    kinds = {x.split()[0]: x.split()[1] for x in schema.split(", ")}
    arrow = {"int": pa.int32(), "double": pa.float64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column("content")[i].as_py()
                try:
                    found = f(content or b"")
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    found = [{"error": f"{type(e).__name__}: {e}"}]
                kept = [batch.column(x.name).slice(i, 1).take(pa.array([0] * len(found))) for x in others]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r.get(c) for r in found], arrow[kinds[c]]) for c in names)], [*(x.name for x in others), *names])

    told = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in others), schema])
    return rows.select(*(x.name for x in others), "content").mapInArrow(run, told)


def metadata(files: DataFrame, **overrides: Column) -> DataFrame:
    """files (path, content) with METADATA in place of content; an override that isn't null wins over what a file tells."""
    out = _each(files, lambda raw: [describe(parse(raw))], METADATA)
    return out.withColumns({k: F.coalesce(v, F.col(k)) for k, v in overrides.items()})


def decoded(files: DataFrame, channel: int | None = None) -> DataFrame:
    """files (path, content) as one row for each channel (or the given one): channel, shape (z, y, x) and data, row by row."""

    def read(raw: bytes) -> list[dict]:
        data = volume(parse(raw)).astype(float)
        return [{"channel": c, "shape": list(v.shape), "data": v.ravel()} for c, v in enumerate(data) if channel in (None, c)]

    return _each(files, read, PIXELS)


def encoded(volumes: DataFrame, voxel_xy: float | None = None, voxel_z: float | None = None) -> DataFrame:
    """Rows (shape, data and more) as files (content) of 32-bit numbers, one channel each."""
    others = [x for x in volumes.schema if x.name not in ("shape", "data")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [encode(np.asarray(v, np.float32).reshape(1, *shape), (voxel_xy, voxel_z)) for shape, v in zip(batch.column("shape").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(x.name) for x in others), pa.array(files, pa.binary())], [*(x.name for x in others), "content"])

    told = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in others), "content binary"])
    return volumes.select(*(x.name for x in others), "shape", "data").mapInArrow(run, told)


def saved(files: DataFrame, folder: str) -> DataFrame:
    """Write files (name, content) below a folder that all executors reach; (name, length) of what was written. A task that is tried again writes the same files."""
    from pyarrow import fs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        store.create_dir(base, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                    out.write(content)
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(sizes, pa.int64())], ["name", "length"])

    return files.select("name", "content").mapInArrow(run, "name string, length long")
