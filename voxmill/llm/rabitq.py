"""Embedding near-duplicates by binary codes of randomised rotations.

A vector's code is the signs of its unit vector after a random rotation; with it are stored a correction factor and the rotated vector itself, scalar-quantised
to 4 bits. The inner product of one vector's code with another's quantised rotation, divided by the factor, estimates the cosine without bias. Were the cosine at the
threshold, the estimate would lie within SPREAD standard deviations of it (and within a bound that always holds, if that is less); pairs whose estimate is
lower are left out, the others are computed exactly, in double precision.

Codes and factors are computed once and stored. Candidates meet in tables keyed by groups of sign bits; the number of tables follows from the wanted recall at the
threshold. Only codes are shuffled to the tables' buckets; what is undecided there is reported as the vectors of a bucket that have an undecided pair, and
raw vectors are fetched for these alone. Equal vectors are one class with a count. A pair is counted in the first table in which it meets and in no
other, so link counts need no list of pairs, and of each block only a spanning forest of its links is passed on. Buckets of over BLOCK classes are cut into
blocks, and pairs of blocks dealt out, so none meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_unique, written
from .components import components

BLOCK, SEED = 1024, 20240
#: Standard deviations of an estimate's error that still count as possible: one pair at the threshold in three million is left out.
SPREAD = 5.0
_PLANES = 4


def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of a dimension, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng((SEED, dim, k)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(classes: int, threshold: float, recall: float) -> tuple[int, int]:
    """(tables, bits): bits so that a bucket of random vectors stays small, tables so that a pair at the threshold meets with probability recall."""
    bits = min(40, max(4, round(math.log2(max(2, classes) / 64))))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet))), bits


def _words(signs: np.ndarray) -> np.ndarray:
    """Rows of signs (bool) as rows of uint64."""
    padded = np.zeros((len(signs), -(-signs.shape[1] // 64) * 64), bool)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Coder:
    """Stored records of unit vectors, and the estimates that two records allow. A record: words of the code, of the planes of the quantised vector (least bit first), and
    the factors (agreement of code and vector, least value, step, sum of levels) as float64."""

    def __init__(self, dim: int, tables: int, bits: int, threshold: float = 0.95):
        self.dim, self.tables, self.bits, self.threshold = dim, tables, bits, threshold
        self.turn = rotation(dim, 0)
        self.dither = np.random.default_rng((SEED, dim)).random(dim)
        more = -(-tables * bits // dim)
        self.planes = np.concatenate([rotation(dim, 1 << 16 | k) for k in range(more)])[: tables * bits]
        self.words = -(-dim // 64)
        self.key_bytes = -(-tables * bits // 8)

    def signs(self, unit: np.ndarray) -> np.ndarray:
        """Packed sign bits of all tables, a row of key_bytes bytes for each vector."""
        return np.packbits(unit @ self.planes.T > 0, axis=1, bitorder="little")

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        flat = np.unpackbits(signs, axis=1, count=self.tables * self.bits, bitorder="little").reshape(len(signs), self.tables, self.bits)
        return (flat @ (1 << np.arange(self.bits, dtype=np.int64))).astype(np.int64)

    def records(self, unit: np.ndarray) -> np.ndarray:
        """The stored records, as rows of uint64."""
        x = unit @ self.turn.T
        agree = np.maximum(np.abs(x).sum(1) / self.dim**0.5, 1e-9)
        low, top = x.min(1), x.max(1)
        step = np.maximum((top - low) / (2**_PLANES - 1), 1e-12)
        level = np.clip(np.floor((x - low[:, None]) / step[:, None] + self.dither), 0, 2**_PLANES - 1).astype(np.uint8)
        factors = np.stack([agree, low, step, level.sum(1, dtype=np.int64).astype(float)], 1)
        return np.hstack([_words(x > 0), *(_words(level >> p & 1 > 0) for p in range(_PLANES)), factors.view(np.uint64)])

    def estimate(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimates of the cosines of the vectors of records a[i] and b[j], how far below the threshold they may lie if the cosine is at the threshold)."""
        w = self.words
        code, factors = a[:, :w], np.ascontiguousarray(a[:, w * (1 + _PLANES) :]).view(float)
        other = np.ascontiguousarray(b[:, w * (1 + _PLANES) :]).view(float)
        dot = np.zeros(len(i))
        for p in range(_PLANES):
            dot += np.bitwise_count(code[i] & b[j, w * (1 + p) : w * (2 + p)]).sum(1) * float(1 << p)
        ones = np.bitwise_count(code).sum(1).astype(float)
        low, step, levels = other[j, 1], other[j, 2], other[j, 3]
        agree = factors[i, 0]
        # sum of signs * vector, from the bits set and the sum of all
        signed = (2 * (step * dot + low * ones[i]) - (step * levels + low * self.dim)) / self.dim**0.5
        return signed / agree, self.far(agree, step)

    def far(self, agree: np.ndarray, step: np.ndarray | float) -> np.ndarray:
        """How far below the threshold the estimate of a pair may lie if its cosine is at the threshold."""
        side = math.sqrt(max(0.0, 1 - self.threshold**2))
        ratio = np.sqrt(np.maximum(0, 1 - np.minimum(agree, 1) ** 2)) / agree * side
        rounding = step / agree / 2
        far = SPREAD * np.sqrt(ratio**2 / max(1, self.dim - 1) + rounding**2)
        # Cauchy-Schwarz; a rounded part is off by a step at most
        return np.minimum(far, ratio + 2 * rounding * self.dim**0.5)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that the links a-b connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _coarse(coder: Coder, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the estimate of each pair of a row of a and one of b may be near enough: a product of matrices in single precision, less all that it may be wrong by."""
    w, d = coder.words, coder.dim
    bits = lambda x: np.unpackbits(np.ascontiguousarray(x).view(np.uint8), axis=1, count=d, bitorder="little")
    agree = np.ascontiguousarray(a[:, w * (1 + _PLANES) :]).view(float)[:, 0]
    low, step, levels = np.ascontiguousarray(b[:, w * (1 + _PLANES) :]).view(float).T[1:]
    level = sum(bits(b[:, w * (1 + p) : w * (2 + p)]).astype(np.float32) * (1 << p) for p in range(_PLANES))
    code = bits(a[:, :w]).astype(np.float32)
    left = np.hstack([code, code.sum(1, keepdims=True), np.ones((len(a), 1), np.float32)])
    right = np.hstack([level * (2 * step)[:, None].astype(np.float32), (2 * low)[:, None], -(step * levels + low * d)[:, None]]).astype(np.float32)
    # the widest allowance that a vector of b gives; terms of the sums add up to less than 8 * d
    least = coder.threshold - coder.far(agree, step.max())
    return left @ right.T >= (agree * least * d**0.5 - 2.0**-23 * (d + 8) * 8 * d).astype(np.float32)[:, None]


def undecided(coder: Coder, table: int, records: np.ndarray, signs: np.ndarray, m: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slices (i, j) of the pairs of a block (m is None) or between its first m rows and the others that meet in no table before this one and may reach the threshold."""
    n, rows = len(records), len(records) if m is None else m
    for lo in range(0, rows, 256):
        hi = min(rows, lo + 256)
        start = lo if m is None else m
        if start == n:
            return
        i, j = np.nonzero(_coarse(coder, records[lo:hi], records[start:]))
        i, j = i + lo, j + start
        if m is None:
            i, j = i[i < j], j[i < j]
        if len(i):
            about, far = coder.estimate(records, records, i, j)
            maybe = about >= coder.threshold - far
            i, j = i[maybe], j[maybe]
        if len(i) and table:
            used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            keys = coder.keys(signs[used])[:, :table]
            new = (keys[at[: len(i)]] != keys[at[len(i) :]]).all(1)
            i, j = i[new], j[new]
        if len(i):
            yield i, j


def link_block(coder: Coder, table: int, ids: np.ndarray, records: np.ndarray, signs: np.ndarray, raw: np.ndarray, weight: np.ndarray, m: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links counted here for each, an id to connect each with) of one block (m is None), or of the pairs between its first m rows and the others."""
    n = len(ids)
    norm = np.sqrt((raw * raw).sum(1))
    links, label = np.zeros(n, np.int64), np.arange(n)
    for i, j in undecided(coder, table, records, signs, m):
        exact = np.einsum("ij,ij->i", raw[i], raw[j]) / (norm[i] * norm[j]) >= coder.threshold
        i, j = i[exact], j[exact]
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        # only a forest of what is linked so far is kept
        if len(i):
            label = _forest(n, np.concatenate([i, np.arange(n)]), np.concatenate([j, label]))
    used = np.flatnonzero(links)
    return ids[used], links[used], ids[label[used]]


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length as float64, each times a power of two that keeps squares in range and changes no cosine."""
    raw = np.asarray(lists.flatten(), dtype=np.float64).reshape(-1, dim)
    top = np.abs(raw).max(1, initial=0)
    return np.where(((top > 1e100) | (top < 1e-100))[:, None], np.ldexp(raw, -np.frexp(top)[1][:, None]), raw)


def _rows(column: pa.ChunkedArray | pa.Array, kind) -> np.ndarray:
    """Binary values of one size as rows."""
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(kind).reshape(len(values), -1)


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole runs of equal keys of sorted batches, and where the runs begin and end."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*waiting, batch]).combine_chunks()
        cuts = _cuts(table, keys)
        if len(cuts) > 2:
            yield table.slice(0, cuts[-2]), cuts[:-1]
        waiting = table.slice(cuts[-2]).to_batches()
    if waiting:
        table = pa.Table.from_batches(waiting)
        yield table, [0, len(table)]


def _cuts(table: pa.Table, keys: list[str]) -> list[int]:
    code = np.stack([table.column(c).to_numpy() for c in keys], 1)
    return [0, *(np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1).tolist(), len(code)]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding: array of float or double; others are ignored).

    n_links: other rows at cosine threshold or more; component_id: the smallest vec_id that links reach; kept: it is the row's own. Vectors that are
    null, empty, zero or hold null or non-finite parts link with nothing, nor do vectors of different lengths. Repeated rows are rows; null ids link like
    others and never name a component unless all of its ids are null. No rows give none.
    """
    wide = dict(vectors.dtypes)["embedding"]
    wide = "array<float>" if "float" in wide else "array<double>"
    v = F.col("embedding").cast(wide)
    big = F.array_max(F.transform(v, lambda x: F.abs(x)))
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & (big > 0) & (big < float("inf"))
    rows = vectors.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.transform(v, lambda x: x + F.lit(0).cast("float" if wide == "array<float>" else "double"))).alias("v"))
    classes = written(rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("cls", F.monotonically_increasing_id()), "vectors")
    tables, bits = table_plan(classes.count(), threshold, recall)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders: dict[int, Coder] = {}
        for batch in batches:
            lists = batch.column("v")
            sizes = np.asarray(pa.compute.list_value_length(lists))
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                raw = _matrix(lists.take(pa.array(at)), dim)
                unit = raw / np.sqrt((raw * raw).sum(1))[:, None]
                coder = coders.setdefault(dim, Coder(dim, tables, bits, threshold))
                signs, records = coder.signs(unit), coder.records(unit)
                cols = [pa.array([x.tobytes() for x in signs], pa.binary()), pa.array([x.tobytes() for x in records], pa.binary()), pa.array(list(coder.keys(signs)), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(at)), batch.column("n").take(pa.array(at)), pa.array(np.full(len(at), dim), pa.int32()), *cols], ["cls", "n", "dim", "signs", "record", "keys"])

    coded = written(classes.select("cls", "n", "v").mapInArrow(store, "cls long, n long, dim int, signs binary, record binary, keys array<long>"), "codes")
    bucket, block = ["dim", "t", "key"], ["dim", "t", "key", "p", "q"]
    met = coded.select("cls", "n", "dim", "signs", "record", F.posexplode("keys").alias("t", "key"))
    sizes = met.groupBy(*bucket).agg(F.count("*").alias("m")).filter("m > 1").withColumn("g", F.ceil(F.col("m") / BLOCK).cast("int")).drop("m")
    placed = join_unique(met, written(sizes, "buckets"), bucket, "inner").withColumn("i", F.pmod(F.xxhash64("cls"), F.col("g")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q")))
    dealt = placed.select("cls", "n", "dim", "signs", "record", "t", "key", "i", F.explode(pairs).alias("pq")).select("cls", "n", "dim", "signs", "record", "t", "key", "pq.p", "pq.q", "i")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(rows, blocks) of sorted batches; a block: its first row and the next one's, coder, table, records, signs and m."""
        coders: dict[int, Coder] = {}
        for rows, cuts in _whole(batches, block):
            dim, t, p, q, i = (rows.column(c).to_numpy() for c in ("dim", "t", "p", "q", "i"))
            # vectors of different lengths have records of different sizes, and are never in one block
            far = [0, *(np.flatnonzero(dim[1:] != dim[:-1]) + 1).tolist(), len(dim)]
            parts = [(a, _rows(rows.column("record").slice(a, b - a), np.uint64), _rows(rows.column("signs").slice(a, b - a), np.uint8)) for a, b in zip(far, far[1:], strict=False)]

            def blocks(part=0, cuts=cuts, far=far, parts=parts, dim=dim, t=t, p=p, q=q, i=i):
                for a, b in zip(cuts, cuts[1:], strict=False):
                    part += a >= far[part + 1]
                    at, records, signs = parts[part]
                    d = int(dim[a])
                    if d not in coders:
                        coders[d] = Coder(d, tables, bits, threshold)
                    yield a, b, coders[d], int(t[a]), records[a - at : b - at], signs[a - at : b - at], None if p[a] == q[a] else int((i[a:b] == p[a]).sum())

            yield rows, blocks()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, blocks in opened(batches):
            wanted = np.zeros(len(rows), bool)
            for a, _, coder, t, records, signs, m in blocks:
                for i, j in undecided(coder, t, records, signs, m):
                    wanted[a + i] = wanted[a + j] = True
            yield from rows.filter(pa.array(wanted)).to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    open_ = written(dealt.repartition(*block).sortWithinPartitions(*block, (F.col("i") != F.col("p")).cast("int")).mapInArrow(sift, schema), "undecided")
    full = open_.join(classes.select("cls", "v"), "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, blocks in opened(batches):
            ids, weight = rows.column("cls").to_numpy(), rows.column("n").to_numpy()
            for a, b, coder, t, records, signs, m in blocks:
                raw = _matrix(rows.column("v").slice(a, b - a).combine_chunks(), coder.dim)
                one, k, to = link_block(coder, t, ids[a:b], records, signs, raw, weight[a:b], m)
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(k, pa.int64()), pa.array(to, pa.int64())], ["cls", "links", "to"])

    found = written(full.repartition(*block).sortWithinPartitions(*block, (F.col("i") != F.col("p")).cast("int")).mapInArrow(compare, "cls long, links long, `to` long"), "links")
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.filter("cls <> `to`"), "cls", "to").withColumnRenamed("v", "cls")
    named = written(classes.join(links, "cls", "left").join(roots, "cls", "left").select("v", "first", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cls").alias("root")), "named")
    least = written(named.groupBy("root").agg(F.min("first").alias("component")), "least")
    table = written(join_unique(named, least, ["root"], "inner").select("v", (F.col("n") - 1 + F.col("links")).alias("links"), "component"), "table")
    told = join_unique(rows.filter("v is not null"), table, ["v"], "left").select("vec_id", "links", "component")
    out = told.unionByName(rows.filter("v is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.lit(None).cast(dict(rows.dtypes)["vec_id"]).alias("component")))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.col("vec_id").eqNullSafe(F.coalesce("component", "vec_id")).alias("kept"))
