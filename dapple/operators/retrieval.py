"""Cosine retrieval of probes against a gallery at photo and identity level.

Two physical ways give the same rows: a gallery of checked size is broadcast as
one matrix and each batch of probes multiplies with it; a larger one is cut into
blocks and each probe batch meets each block.  Results at identity level leave
the tasks already reduced to one row for each probe and identity (of a block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dapple.functions.geometry import dot
from dapple.session import ship

#: Gallery bytes up to which one matrix is broadcast; rows of a block beyond.
BROADCAST_BYTES, BLOCK_ROWS = 64 << 20, 20_000
#: Bytes of the vectors of a block.
BLOCK_BYTES = 16 << 20
#: Products that a step of the matrix itself makes at most, about, and those of a task.
CELLS, PAIRS = 1 << 20, 20_000_000
#: Digits of similarities that ranks and results use, so that any order of summation gives the same ranks.
DIGITS = 9


def _matrix(column: pa.Array, normalise: bool) -> np.ndarray:
    flat, sizes = column.flatten(), pc.list_value_length(column)
    if len(column) and not column.null_count and not flat.null_count and pc.min(sizes).as_py() == pc.max(sizes).as_py():
        m = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    else:
        rows = column.to_pylist()
        m = np.array(rows, dtype=np.float64) if rows else np.zeros((0, 1))
    return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9) if normalise else m


def matrix_of(column: pa.Array) -> np.ndarray:
    return _matrix(column, False)


def gallery_matrix(gallery: DataFrame, identity: str, broadcast_bytes: int = BROADCAST_BYTES):
    """Rows id, embedding; their number; and, up to a size, the broadcast ids (sorted), matrix and identities, else None."""
    ship(gallery.sparkSession)
    rows = gallery.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size["n"] * max(size["d"] or 1, 1) * 8 > broadcast_bytes:
        return rows, size["n"], None
    found = rows.join(gallery.select(F.col("id").cast("long").alias("id"), F.col(identity).cast("string").alias("who")), "id").orderBy("id").collect()
    held = (np.array([r["id"] for r in found], dtype=np.int64), np.array([r["embedding"] for r in found], dtype=np.float64).reshape(len(found), -1), np.array([r["who"] for r in found], dtype=object))
    return rows, size["n"], gallery.sparkSession.sparkContext.broadcast(held)


def _scan(probes: DataFrame, gallery: DataFrame, emit, schema: str, *, identity: str | None, extra: tuple[str, ...] = (), normalise: bool = False, broadcast_bytes: int = BROADCAST_BYTES, cells: int | None = None) -> tuple[DataFrame, bool]:
    """What ``emit`` makes of every batch of probes with every block of the gallery, and whether there is one block only.

    ``emit(probes, sims, ids, who)`` gets the probes' id and ``extra`` columns as
    arrays, their rounded inner products with the block, and its ids (rising)
    and identities; with ``cells`` of as many probes as make so many products.
    """
    ship(probes.sparkSession)
    side = gallery.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), (F.col(identity).cast("string") if identity else F.lit("")).alias("who"))
    size = side.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n, dim = size["n"] or 0, max(size["d"] or 0, 1)
    p = probes.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"), *extra)

    def step(part, g, ids, who):
        a = _matrix(part.field("embedding"), normalise)
        sims = np.round(a @ g.T, DIGITS) if len(ids) else np.zeros((len(a), 0))
        return emit({c: np.array(part.field(c).to_pylist(), dtype=np.int64 if c == "id" else object) for c in ("id", *extra)}, sims, ids, who)

    def many(ids) -> int:
        return 256 if cells is None else max(1, min(256, cells // max(1, len(ids))))

    if n * dim * 8 <= broadcast_bytes:
        rows = side.orderBy("id").toArrow().combine_chunks()  # no object a number on the driver
        held = (np.array(rows["id"].to_pylist(), dtype=np.int64), _matrix(rows["embedding"].combine_chunks(), normalise) if len(rows) else np.zeros((0, 1)), np.array(rows["who"].to_pylist(), dtype=object))
        held = probes.sparkSession.sparkContext.broadcast(held)

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, g, who = held.value
            for batch in batches:
                for lo in range(0, batch.num_rows, many(ids)):
                    yield step(batch.slice(lo, many(ids)).to_struct_array(), g, ids, who)

        return p.mapInArrow(whole, schema), True
    block_rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * dim)))
    blocks, parts = -(-n // block_rows), max(1, -(-p.count() // block_rows))
    packed = side.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "embedding", "who"))).alias("rows"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    tiles = p.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("part").agg(F.collect_list(F.struct(*p.columns)).alias("probes")).withColumn("block", every).join(packed, "block").select("probes", "rows")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ps, gs in zip(batch.column(0), batch.column(1), strict=True):
                a, b = ps.values, gs.values
                g, ids, who = _matrix(b.field("embedding"), normalise), b.field("id").to_numpy(), np.array(b.field("who").to_pylist(), dtype=object)
                for lo in range(0, len(a), many(ids)):
                    yield step(a.slice(lo, many(ids)), g, ids, who)

    return tiles.mapInArrow(tiled, schema), False


def similarities(probes: DataFrame, gallery: DataFrame, *, identity: str | None = None, how: str = "max", normalise: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Inner products of all probes with all gallery rows.

    ``probes`` and ``gallery`` have id (long) and embedding; the gallery may have
    ``identity``.  Returns pid, gid, sim, the matrix itself; with ``identity``
    pid, identity, sim, the best or mean over the identity's gallery rows.
    """
    if identity and how == "max":
        return identity_photos(probes, gallery, identity, normalise=normalise, broadcast_bytes=broadcast_bytes).select("pid", "identity", "sim")

    def pairs(own, sims, ids, who):
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own["id"], len(ids))), pa.array(np.tile(ids, len(sims))), pa.array(sims.ravel())], names=["pid", "gid", "sim"])

    def sums(own, sims, ids, who):
        names, code = np.unique(who.astype(str), return_inverse=True)
        count = np.bincount(code, minlength=len(names))
        out = sims @ np.eye(len(names))[code] if len(ids) else np.zeros((len(sims), 0))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own["id"], len(names))), pa.array(np.tile(names, len(sims)).tolist(), pa.string()), pa.array(out.ravel()), pa.array(np.tile(count, len(sims)).astype(np.int64))], names=["pid", "identity", "sim", "n"])

    shape = {"identity": identity, "normalise": normalise, "broadcast_bytes": broadcast_bytes}
    if not identity:
        return _scan(probes, gallery, pairs, "pid long, gid long, sim double", cells=CELLS, **shape)[0]
    out, _ = _scan(probes, gallery, sums, "pid long, identity string, sim double, n long", **shape)
    return out.groupBy("pid", "identity").agg(F.round(F.sum("sim") / F.sum("n"), DIGITS).alias("sim"))


def dot_matrix(probes: DataFrame, gallery: DataFrame, digits: int) -> DataFrame:
    """pid, gid and sim, rounded once more to ``digits``, of all probes with all gallery rows.

    Vectors of the usual length without nulls go through ``similarities``, dealt
    over tasks of about ``PAIRS`` products; pairs with another vector come from
    the native expression, which gives null where lengths differ.
    """
    dim = probes.select("embedding").unionByName(gallery.select("embedding")).groupBy(F.size("embedding").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    usual = F.coalesce((F.size("embedding") == (dim["d"] if dim else 0)) & F.forall("embedding", lambda x: x.isNotNull()), F.lit(False))
    # multiplied, not BigDecimal as F.round: half away from zero of the scaled double, as the SQL's round
    scale, rest = F.lit(10.0**digits), lambda x: F.abs(x) - F.floor(F.abs(x))
    away = lambda x: F.signum(x) * (F.floor(F.abs(x)) + F.when(rest(x) >= 0.5, 1).otherwise(0))
    n_p, n_g = (df.agg(F.count("*").alias("n"), F.count_if(~usual).alias("odd")).first() for df in (probes, gallery))
    parts = max(4 * probes.sparkSession.sparkContext.defaultParallelism, n_p["n"] * n_g["n"] // PAIRS)
    out = similarities(probes.where(usual).select("id", "embedding").repartition(parts), gallery.where(usual).select("id", "embedding"))
    finite = F.abs("sim") < 2.0**53 / 10.0**digits
    out = out.select("pid", "gid", F.when(finite, away(F.col("sim") * scale) / scale).otherwise(F.round("sim", digits)).alias("sim"))
    native = lambda p, g: p.select(F.col("id").cast("long").alias("pid"), F.col("embedding").alias("a")).crossJoin(g.select(F.col("id").cast("long").alias("gid"), F.col("embedding").alias("b"))).select("pid", "gid", F.round(F.round(dot(F.col("a"), F.col("b")), DIGITS), digits).alias("sim"))
    if n_p["odd"]:
        out = out.unionByName(native(probes.where(~usual), gallery))
    if n_g["odd"]:
        out = out.unionByName(native(probes.where(usual), gallery.where(~usual)))
    return out


def identity_photos(probes: DataFrame, gallery: DataFrame, identity: str = "identity", *, normalise: bool = False, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pid, identity, sim of its best photo, best_photo (ties: smaller gid) and n_photos: a row a probe and identity, none a pair of photos."""

    def best(own, sims, ids, who):
        names, code = np.unique(who.astype(str), return_inverse=True)
        sim, photo = np.zeros((len(sims), len(names))), np.zeros((len(sims), len(names)), dtype=np.int64)
        for k in range(len(names)):
            at = np.flatnonzero(code == k)
            first = sims[:, at].argmax(axis=1)  # ids rise, so the first of equals has the smallest
            sim[:, k], photo[:, k] = sims[np.arange(len(sims)), at[first]], ids[at[first]]
        count = np.tile(np.bincount(code, minlength=len(names)), len(sims)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(own["id"], len(names))), pa.array(np.tile(names, len(sims)).tolist(), pa.string()), pa.array(sim.ravel()), pa.array(photo.ravel()), pa.array(count)], names=["pid", "identity", "sim", "best_photo", "n_photos"])

    out, whole = _scan(probes, gallery, best, "pid long, identity string, sim double, best_photo long, n_photos long", identity=identity, normalise=normalise, broadcast_bytes=broadcast_bytes)
    if whole:
        return out
    top = out.groupBy("pid", "identity").agg(F.max(F.struct("sim", (-F.col("best_photo")).alias("g"))).alias("t"), F.sum("n_photos").alias("n_photos"))
    return top.select("pid", "identity", "t.sim", (-F.col("t.g")).alias("best_photo"), "n_photos")


def photo_ranks(probes: DataFrame, gallery: DataFrame, identity: str = "identity", *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """pid and the rank of its identity's best photo among all gallery photos (ties: smaller gid; null: none): a row a probe and block."""
    own = identity_photos(probes, gallery, identity, broadcast_bytes=broadcast_bytes)
    who = probes.select(F.col("id").cast("long").alias("pid"), F.col(identity).alias("identity"))
    true = own.join(who, ["pid", "identity"]).select("pid", F.col("sim").alias("own_sim"), F.col("best_photo").alias("own_photo"))
    marked = probes.select("id", "embedding").join(true, F.col("id") == F.col("pid"), "left").drop("pid")

    def ahead(own, sims, ids, who):
        known = np.array([x is not None for x in own["own_sim"]], dtype=bool)
        sim = np.array([np.inf if x is None else x for x in own["own_sim"]], dtype=float)[:, None]
        photo = np.array([0 if x is None else x for x in own["own_photo"]], dtype=np.int64)[:, None]
        n = ((sims > sim) | ((sims == sim) & (ids[None, :] <= photo))).sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(own["id"]), pa.array(np.where(known, n, 0).astype(np.int64), mask=~known)], names=["pid", "rank"])

    out, whole = _scan(marked, gallery, ahead, "pid long, rank long", identity=identity, extra=("own_sim", "own_photo"), broadcast_bytes=broadcast_bytes)
    return out if whole else out.groupBy("pid").agg(F.sum("rank").alias("rank"))


def _hit(rank: str, k: int) -> Column:
    return F.coalesce(F.col(rank) <= k, F.lit(False)).alias(f"hit_at_{k}")


def photo_hits(ranks: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Whether the true identity is among a probe's first k gallery photos. ``ranks``: those of ``photo_ranks``; ``truth``: pid, identity."""
    return truth.join(ranks, "pid", "left").select("pid", "identity", "rank", *(_hit("rank", k) for k in ks))


def identity_ranks(scores: DataFrame, by: str = "sim") -> DataFrame:
    """pid, identity, score and rank (ties: smaller identity)."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("pid").orderBy(F.desc(by), "identity")))


def identity_hits(scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5), by: str = "sim") -> DataFrame:
    """Whether the true identity ranks among a probe's first k identities; probes whose identity is not in the gallery miss."""
    own = scores.join(truth, ["pid", "identity"]).select("pid", F.col("identity").alias("me"), F.col(by).alias("mine"))
    ahead = scores.join(own, "pid").where((F.col(by) > F.col("mine")) | ((F.col(by) == F.col("mine")) & (F.col("identity") <= F.col("me"))))
    rank = ahead.groupBy("pid").agg(F.count("*").alias("rank"))
    return truth.join(rank, "pid", "left").select("pid", "identity", "rank", *(_hit("rank", k) for k in ks))


def known_new_scores(photos: DataFrame) -> DataFrame:
    """pid, max_sim, pred_id (of the best photo), margin to the best photo of another identity (0 if there is none). ``photos``: those of ``identity_photos``."""
    place = F.row_number().over(Window.partitionBy("pid").orderBy(F.desc("sim"), "best_photo"))
    two = photos.withColumn("place", place).where("place <= 2").groupBy("pid")
    first, second = F.max(F.when(F.col("place") == 1, F.col("sim"))), F.max(F.when(F.col("place") == 2, F.col("sim")))
    return two.agg(first.alias("max_sim"), F.max(F.when(F.col("place") == 1, F.col("identity"))).alias("pred_id"), F.coalesce(first - second, F.lit(0.0)).alias("margin"))


def rank_individuals(photos: DataFrame, k: int, lo: Column, hi: Column) -> DataFrame:
    """A probe's first k identities with confidence, best photo and number of photos. ``photos``: those of ``identity_photos``."""
    from dapple.functions.geometry import calibrated

    ranked = identity_ranks(photos).where(F.col("rank") <= k)
    return ranked.withColumn("confidence", F.round(calibrated(F.col("sim"), lo, hi), 1))


def top_photos(probes: DataFrame, gallery: DataFrame, pid: int, k: int) -> DataFrame:
    """The k best gallery photos of one probe; only its own products are made."""
    return similarities(probes.where(F.col("id") == pid), gallery).orderBy(F.desc("sim"), "gid").limit(k)


def verdict(ranked: DataFrame, probes: DataFrame, least: float = 70.0, gap: float = 8.0) -> DataFrame:
    """known if the first confidence is high and far enough above the second; else new_candidate."""
    first = ranked.groupBy("pid").agg(F.max(F.when(F.col("rank") == 1, F.col("confidence"))).alias("top1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("confidence"))), F.lit(0.0)).alias("top2"))
    known = F.coalesce((F.col("top1") >= least) & (F.round(F.col("top1") - F.col("top2"), 6) >= gap), F.lit(False))
    return probes.select("pid").join(first, "pid", "left").select("pid", "top1", "top2", F.when(known, "known").otherwise("new_candidate").alias("verdict"))


def detailed(photos: DataFrame, ranks: DataFrame, truth: DataFrame) -> DataFrame:
    """Per-probe audit: photo rank (-1 if absent), identity rank, first five identities, true photos, scores and margins.

    ``photos`` and ``ranks``: those of ``identity_photos`` and ``photo_ranks``.
    """
    per = identity_ranks(photos).join(truth.withColumnRenamed("identity", "me"), "pid")
    own = F.col("identity") == F.col("me")
    at = lambda k: F.max(F.when(F.col("rank") == k, F.col("sim")))
    out = per.groupBy("pid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= 5, F.struct("rank", "identity")))), lambda s: s["identity"]), ",").alias("top5"),
        F.coalesce(at(1) - at(2), F.lit(0.0)).alias("id_margin"),
        F.max(F.when(own, F.col("rank"))).cast("long").alias("identity_rank"),
        F.coalesce(F.sum(F.when(own, F.col("n_photos"))), F.lit(0).cast("long")).alias("n_true"),
        F.max(F.when(own, F.col("sim"))).alias("max_true"),
        F.max(F.when(~own, F.col("sim"))).alias("best_wrong"),
    )
    placed = ranks.select("pid", F.col("rank").alias("photo_rank"))
    out = truth.join(placed, "pid", "left").join(out, "pid", "left")
    return out.withColumns({"photo_rank": F.coalesce("photo_rank", F.lit(-1).cast("long")), "identity_rank": F.coalesce("identity_rank", F.lit(-1).cast("long"))})


def temporal_probes(probes: DataFrame, gallery: DataFrame) -> DataFrame:
    """Probes with a gallery photo of their identity from another session."""
    g = gallery.select(F.col("identity").alias("g_identity"), F.col("session").alias("g_session")).distinct()
    return probes.join(g, (F.col("identity") == F.col("g_identity")) & ~F.col("session").eqNullSafe(F.col("g_session")), "left_semi")


def in_gallery(probes: DataFrame, gallery: DataFrame) -> DataFrame:
    return probes.join(gallery.select("identity").distinct(), "identity", "left_semi")


def variant_embeddings(raw: str, crop: str, confidence: str, threshold: float | None) -> Column:
    """The crop's embedding where the segmentation is sure enough, else the raw one."""
    return F.col(raw) if threshold is None else F.when(F.col(confidence) >= threshold, F.col(crop)).otherwise(F.col(raw))


# Names that mean the whole gallery.
ALL_SCOPES = (None, "", "all", "Вся база")


def filter_scope(gallery: DataFrame, scope: str | None) -> DataFrame:
    """The gallery of one cohort; no scope, or a name for all of it, keeps everything."""
    return gallery if scope in ALL_SCOPES else gallery.where(F.col("cohort") == scope)


def align(gallery: DataFrame, probes: DataFrame, with_vectors: DataFrame, with_spots: DataFrame, key: str = "md5") -> tuple[DataFrame, DataFrame]:
    """Both sides restricted to photos that have a vector and spots; roles stay apart."""
    both = with_vectors.select(key).distinct().join(with_spots.select(key).distinct(), key)
    return gallery.join(both, key, "left_semi"), probes.join(both, key, "left_semi").join(gallery.select(key), key, "left_anti")


def recall(hits: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """recall_at_k over all probes and n_probe; 0 without probes."""
    return hits.agg(*(F.coalesce(F.avg(F.col(f"hit_at_{k}").cast("double")), F.lit(0.0)).alias(f"recall_at_{k}") for k in ks), F.count("*").alias("n_probe"))


def detailed_pair(embed_scores: DataFrame, match_scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Per-probe audit of two score sets (pid, identity, sim): the true identity's ranks (null if absent), first identities and hits at 1."""
    out = truth.select("pid", "identity")
    for name, scores in (("embed", embed_scores), ("match", match_scores)):
        ranks = identity_ranks(scores)
        own = ranks.join(truth.select("pid", "identity"), ["pid", "identity"]).select("pid", F.col("rank").cast("long").alias(f"{name}_rank"))
        first = ranks.where("rank = 1").select("pid", F.col("identity").alias(f"{name}_top1"))
        out = out.join(own, "pid", "left").join(first, "pid", "left").withColumn(f"{name}_hit", F.coalesce(F.col(f"{name}_rank") == 1, F.lit(False)))
    return out
