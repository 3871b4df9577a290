"""Embedding near-duplicates by spherical-cap filters.

A filter is a unit vector of a structured random product code: the (randomly
rotated) space is cut into two halves, each with ``B`` random code words, and
each pair of code words is a filter, so ``B * B`` filters need only ``2 * B``
inner products a vector.  List decoding then finds all filters whose inner
product exceeds the threshold, looking only at code words that can still reach
it.  Vectors that share a filter are compared exactly in double precision.

``B`` grows with the square root of the number of vectors, so a filter holds
about ``OCCUPANCY`` vectors of isotropic data at any size.  Filters with more
are cut into blocks, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, mix
from .scratch import Scratch, components, join_counted

#: Mean number of filters of an isotropic vector; vectors of a filter; rows of a block of a hot filter.
MEAN_FILTERS, OCCUPANCY, BLOCK_ROWS = 40, 160, 1500
#: A vector with fewer exceeding filters gets its nearest ones up to this number.
LEAST_FILTERS = 8


class ProductCode:
    """Two rotated halves with ``size`` code words each; built from a seed, the same in every process."""

    def __init__(self, dim: int, size: int, seed: int = 5):
        rng = np.random.default_rng([seed, dim, size])
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.half = max(1, dim // 2)
        self.codes = []
        for width in (self.half, dim - self.half):
            c = rng.standard_normal((size, max(width, 1)))[:, :width]
            self.codes.append(c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300) / math.sqrt(2))
        self.size = size
        probe = rng.standard_normal((400, dim))
        x, y = self.products(probe / np.linalg.norm(probe, axis=1, keepdims=True))
        low, high = 0.0, 1.0  # threshold at which a random vector exceeds MEAN_FILTERS filters on average
        xs, ys = np.sort(x, axis=1), np.sort(y, axis=1)
        for _ in range(30):
            mid = (low + high) / 2
            many = np.mean([(size - np.searchsorted(b, mid - a)).sum() for a, b in zip(xs, ys, strict=True)])
            low, high = (mid, high) if many > MEAN_FILTERS else (low, mid)
        self.threshold = low

    def products(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turned = unit @ self.rotation
        return turned[:, : self.half] @ self.codes[0].T, turned[:, self.half :] @ self.codes[1].T

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        out = []
        for x, y in zip(*self.products(unit), strict=True):
            t = self.threshold
            while True:
                i, j = np.flatnonzero(x >= t - y.max()), np.flatnonzero(y >= t - x.max())
                a, b = np.nonzero(x[i][:, None] + y[j][None, :] >= t)
                if len(a) >= min(LEAST_FILTERS, self.size * self.size):
                    break
                t -= 0.03
            out.append(np.sort(i[a].astype(np.int64) * self.size + j[b]))
        return out


_codes: dict[tuple[int, int], ProductCode] = {}


def _code(dim: int, size: int) -> ProductCode:
    if (dim, size) not in _codes:
        _codes[dim, size] = ProductCode(dim, size)
    return _codes[dim, size]


def _unit(values) -> np.ndarray | None:
    """The unit vector in double precision; None for null, empty, zero or non-finite vectors."""
    if values is None or len(values) == 0 or any(v is None for v in values):
        return None
    v = np.asarray(values, dtype=np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top
    return v / np.sqrt((v * v).sum())


def _units(rows: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision from stored components (4 or 8 bytes each)."""
    wide = len(rows[0]) // dim
    v = np.frombuffer(b"".join(rows), dtype=np.float32 if wide == 4 else np.float64).reshape(len(rows), dim).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, embedding -> vec_id, 128 bits of the unit vector, its dimension (0: none), the components."""
    for batch in batches:
        stored = np.float32 if pa.types.is_float32(batch.column(1).type.value_type) else np.float64
        ids, k0, k1, dims, units = batch.column(0), [], [], [], []
        column = batch.column(1)
        for values in column:
            numbers = values.values.to_numpy(zero_copy_only=False) if values.is_valid and values.values.null_count == 0 else values.as_py()
            u = _unit(numbers)
            if u is None:
                k0.append(0), k1.append(0), dims.append(0), units.append(None)
                continue
            bits = (u + 0.0).view(U64)
            place = mix(np.arange(1, len(bits) + 1, dtype=U64))
            with np.errstate(over="ignore"):
                k0.append(int(mix(bits ^ place).sum(dtype=U64).astype(np.int64)))
                k1.append(int(mix((bits + place) * U64(0x9E3779B97F4A7C15)).sum(dtype=U64).astype(np.int64)))
            dims.append(len(u))
            units.append(np.asarray(numbers, dtype=stored).tobytes())
        yield pa.RecordBatch.from_arrays([ids, pa.array(k0, pa.int64()), pa.array(k1, pa.int64()), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "k0", "k1", "dim", "unit"])


def _decode(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        units = batch.column("unit").to_pylist()
        lists: list = [None] * len(units)
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            matrix = _units([units[i] for i in at], int(dim))
            for i, found in zip(at, _code(int(dim), size).decode(matrix), strict=True):
                lists[i] = found
        out = [*(batch.column(c) for c in ("node", "copies", "dim", "unit")), pa.array(lists, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, names=["node", "copies", "dim", "unit", "filters"])


def _counted_here(lists: list[np.ndarray], p: np.ndarray, q: np.ndarray, f: int) -> np.ndarray:
    """Whether ``f`` is the first filter that the two vectors of each pair share."""
    width = max(int(np.searchsorted(x, f)) for x in lists)
    if width == 0:
        return np.ones(len(p), dtype=bool)
    table = np.full((len(lists), width), -1, dtype=np.int64)
    for i, x in enumerate(lists):
        n = int(np.searchsorted(x, f))
        table[i, :n] = x[:n]
    out = np.empty(len(p), dtype=bool)
    step = max(1, 4_000_000 // (width * width))
    for lo in range(0, len(p), step):
        a, b = table[p[lo : lo + step]], table[q[lo : lo + step]]
        out[lo : lo + step] = ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] >= 0)).any(axis=(1, 2))
    return out


def _compare(rows: list[tuple], least: float, size: int) -> list[tuple]:
    """One filter's block, or pair of blocks: node, links first found here, smallest node linked here."""
    f, i, j = rows[0][:3]
    nodes = np.array([r[4] for r in rows])
    if len(rows) < 2:
        return []
    block = np.array([r[3] for r in rows])
    weight = np.array([r[5] for r in rows], dtype=np.int64)
    unit = _units([r[6] for r in rows], rows[0][7])
    left, right = (np.arange(len(rows)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
    p, q = np.nonzero(unit[left] @ unit[right].T >= least)
    p, q = left[p], right[q]
    if i == j:
        p, q = p[p < q], q[p < q]
    if not len(p):
        return []
    links = np.zeros(len(rows), dtype=np.int64)
    touched, again = np.unique(np.concatenate([p, q]), return_inverse=True)
    lists = _code(rows[0][7], size).decode(unit[touched])
    mine = _counted_here(lists, again[: len(p)], again[len(p) :], f)
    np.add.at(links, p[mine], weight[q[mine]])
    np.add.at(links, q[mine], weight[p[mine]])
    root = np.argsort(np.argsort(nodes, kind="stable"), kind="stable")  # local labels in order of node
    while True:
        before = root.copy()
        low = np.minimum(root[p], root[q])
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        if (root == before).all():
            break
    by_rank = np.sort(nodes)
    return [(int(nodes[k]), int(links[k]), int(by_rank[root[k]])) for k in touched]


def _buckets(batches: Iterator[pa.RecordBatch], least: float, size: int) -> Iterator[pa.RecordBatch]:
    """Rows filter, i, j, block, node, copies, unit, dim sorted by dim, filter, i, j."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    held, at, out = [], None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("filter", "i", "j", "block", "node", "copies", "unit", "dim")), strict=True):
            key = (row[7], *row[:3])
            if key != at:
                out += _compare(held, least, size) if held else []
                held, at = [], key
                if len(out) > 20_000:
                    yield packed(out)
                    out = []
            held.append(row)
    out += _compare(held, least, size) if held else []
    if out:
        yield packed(out)


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95) -> DataFrame:
    """Link vectors of cosine ``>= least`` and number their components.

    Cosines are taken in double precision; nothing below ``least`` is linked.
    A pair at cosine 0.95 in 64 dimensions shares a filter with probability
    above 0.999 (measured: README).  Equal directions are one class, so their
    copies are never expanded into pairs.

    Returns a row for each input row: vec_id, n_links (other vectors linked
    directly), component_id (smallest id reachable, itself included), kept
    (vec_id = component_id).  Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing; vectors of different dimension
    do not link.  Repeated rows, and rows that share an id, are vectors of
    their own.  A null id's vector links as any other but names no component;
    it is kept when its component has no id.  Ids are integers; a text id that
    is no number stops the run.  Other columns are ignored; an empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "caps")
    keyed = scratch.save(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).mapInArrow(_keys, "vec_id long, k0 long, k1 long, dim int, unit binary"), "keyed")
    # a node is a class of equal directions, whatever ids hold it
    classes = keyed.where("dim > 0").groupBy("k0", "k1", "dim").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min("unit").alias("unit"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    size = max(8, math.ceil(math.sqrt(classes.count() * MEAN_FILTERS / OCCUPANCY)))
    first = classes.select("node", "copies", "dim", "unit")
    decoded = scratch.save(first.mapInArrow(partial(_decode, size=size), "node long, copies long, dim int, unit binary, filters array<long>"), "decoded")
    rows = decoded.select("node", "copies", "dim", "unit", F.explode("filters").alias("filter"))
    counts = decoded.select("dim", F.explode("filters").alias("filter")).groupBy("dim", "filter").agg(F.count("*").alias("rows_of_key")).where("rows_of_key > 1")
    counts = counts.withColumn("blocks", F.ceil(F.col("rows_of_key") / BLOCK_ROWS).cast("int"))
    filters = decoded.agg(F.sum(F.size("filters"))).first()[0] or 0
    rows = join_counted(rows, counts, ["dim", "filter"], filters, "inner").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("filter", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "unit", "dim")
    rows = rows.repartition("dim", "filter", "i", "j").sortWithinPartitions("dim", "filter", "i", "j", "node")
    found = scratch.save(rows.mapInArrow(partial(_buckets, least=least, size=size), "node long, links long, root long"), "found")
    stars = components(scratch, found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    of_class = classes.join(links, "node", "left").join(stars.select(F.col("a").alias("node"), "b"), "node", "left")
    of_class = scratch.save(of_class.select("k0", "k1", "dim", "least", "copies", F.coalesce("b", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "linked")
    total = keyed.count()
    roots = of_class.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("rows_of_key"))
    of_class = join_counted(of_class, roots, ["root"], total, "inner").select("k0", "k1", "dim", "component_id", "links", F.col("copies").alias("rows_of_key"))
    out = join_counted(keyed.select("vec_id", "k0", "k1", "dim"), of_class, ["k0", "k1", "dim"], total)
    component = F.when(F.col("dim") > 0, F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
