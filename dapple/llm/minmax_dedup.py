"""MinHash near-duplicate removal with min-max hashing.

Each of ``n_hashes`` multiply-add permutations of a document's shingle hashes
gives two signature values, its minimum and its maximum, so a signature of
``bands * rows`` values costs half as many hash evaluations as MinHash, and
both halves estimate the Jaccard similarity without bias.  Documents with an
equal band are candidates; every link is confirmed on the full shingle sets.

No group is expanded into rows of pairs.  Equal sets form one class first.
Then each bucket compares its hub, the member with most neighbours over all its
buckets (the centre of a group of copies), with its other members.  Buckets
whose members are in one component then are finished: comparing further could
not change the components.  In the others, members with a possible partner in
another component (their signatures agree in no fewer values than a pair at the
threshold does, less ``doubt`` standard deviations) are compared with each other,
block by block, and only links that join components come out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, as_bytes, mix, odd_constants, shingle_sets
from .scratch import Scratch, components, join_counted

#: Members of a hub that one streamed group of the verification holds at most, about.
SALT_ROWS = 64
#: Rows and shingles of a block of an unfinished bucket, about.
BLOCK_ROWS, BLOCK_SHINGLES = 1000, 400_000
#: Standard deviations below the expected agreement of signatures at which a pair is passed over (3e-7 at the threshold).
DOUBT = 5.0
_LANES = 16


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        return (int(mix(s).sum(dtype=U64).astype(np.int64)), int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64)))


def min_max(sets: list[np.ndarray], n_hashes: int, seed: int = 1) -> np.ndarray:
    """Signature of each non-empty set: n_hashes minima, then n_hashes maxima."""
    out = np.zeros((len(sets), 2 * n_hashes), dtype=U64)
    a, b = odd_constants(n_hashes, seed), odd_constants(n_hashes, seed + 1)
    lo = 0
    while lo < len(sets):  # blocks of about 100,000 shingles
        hi, total = lo, 0
        while hi < len(sets) and (hi == lo or total + len(sets[hi]) < 100_000):
            total += len(sets[hi])
            hi += 1
        flat = np.concatenate(sets[lo:hi])
        at = np.cumsum([0] + [len(s) for s in sets[lo : hi - 1]])
        with np.errstate(over="ignore"):
            for k in range(n_hashes):
                x = flat * a[k] + b[k]
                out[lo:hi, k] = np.minimum.reduceat(x, at)
                out[lo:hi, n_hashes + k] = np.maximum.reduceat(x, at)
        lo = hi
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band. A band holds values of different permutations, minima and maxima in turn."""
    half = signature.shape[1] // 2
    order = np.array([v for k in range(half) for v in (k, half + k)])
    # the minimum and the maximum of one permutation stand in different bands
    order = np.concatenate([order[0::2], order[1::2]])[: bands * rows].reshape(bands, rows)
    with np.errstate(over="ignore"):
        key = (signature[:, order] * odd_constants(rows, 77)[None, None, :]).sum(axis=2, dtype=U64)
        return mix(key + mix(np.arange(1, bands + 1, dtype=U64))[None, :]).astype(np.int64)


def sketch(signature: np.ndarray) -> np.ndarray:
    """Four bits of each signature value, 16 to a word."""
    nibbles = mix(signature) & U64(15)
    pad = -nibbles.shape[1] % _LANES
    nibbles = np.pad(nibbles, ((0, 0), (0, pad))).reshape(len(nibbles), -1, _LANES)
    return (nibbles << (U64(4) * np.arange(_LANES, dtype=U64))).sum(axis=2, dtype=U64).astype(np.int64)


def most_mismatches(values: int, percent: int, doubt: float = DOUBT) -> int:
    """Differing sketch values that a pair at the threshold may have."""
    apart = (1 - percent / 100) * 15 / 16
    return math.ceil(values * apart + doubt * math.sqrt(values * apart * (1 - apart)))


def _mismatches(a: str, b: str, count: int):
    """How many sketch values of two columns differ, as a native expression."""
    total = F.lit(0)
    for k in range(count):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def _signatures(batches: Iterator[pa.RecordBatch], n: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    n_hashes = (bands * rows + 1) // 2
    for batch in batches:
        sets = list(shingle_sets(as_bytes(batch.column(2)), n))
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [[] for _ in sets]
        small: list = [[] for _ in sets]
        if full:
            signature = min_max([sets[i] for i in full], n_hashes)
            for i, k, z in zip(full, band_keys(signature, bands, rows), sketch(signature), strict=True):
                keys[i], small[i] = k, z
        prints = [_fingerprint(s) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([p[0] for p in prints], pa.int64()),
                pa.array([p[1] for p in prints], pa.int64()),
                pa.array(keys, pa.list_(pa.int64())),
                pa.array(small, pa.list_(pa.int64())),
            ],
            names=["doc_id", "text_key", "n_shingles", "p0", "p1", "bands", "sketch"],
        )


def _confirm(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows hub, part, member, text sorted by hub, part, member <> hub: each hub stands before its members."""
    hub, hub_set = None, None
    for batch in batches:
        a, b = [], []
        sets = shingle_sets(as_bytes(batch.column("text")), n)
        for h, m, s in zip(batch.column("hub").to_pylist(), batch.column("member").to_pylist(), sets, strict=True):
            if h == m:
                hub, hub_set = h, s
            elif h == hub and min(len(s), len(hub_set)) * 100 >= percent * max(len(s), len(hub_set)):
                both = len(np.intersect1d(s, hub_set, assume_unique=True))
                if 100 * both >= percent * (len(s) + len(hub_set) - both):
                    a.append(h)
                    b.append(m)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _joined(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which of left x right are similar enough: intersection sizes are products of the incidence of shared shingles."""
    size = np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count >= 2
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = np.repeat(np.arange(len(sets)), size)[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((len(left), len(right)), dtype=np.float32)
    step = 4096
    for lo in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        part = np.zeros((len(sets), step), dtype=np.float32)
        part[row[a:b], column[a:b] - lo] = 1
        both += part[left] @ part[right].T
    return 100 * both >= percent * (size[left][:, None] + size[right][None, :] - both)


def _span(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """rows: i, j, block, node, comp, set of one block or pair of blocks -> links that join components."""
    i, j = rows[0][:2]
    comp = np.unique(np.array([r[4] for r in rows]), return_inverse=True)[1]
    if comp.max() == 0:
        return []
    block = np.array([r[2] for r in rows])
    left, right = (np.arange(len(rows)),) * 2 if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))
    if not len(left) or not len(right):
        return []
    near = _joined([r[5] for r in rows], left, right, percent) & (comp[left][:, None] != comp[right][None, :])
    out, root = [], list(range(int(comp.max()) + 1))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in zip(*np.nonzero(near), strict=True):
        a, b = find(int(comp[left[p]])), find(int(comp[right[q]]))
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((rows[left[p]][3], rows[right[q]][3]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows bucket, i, j, block, node, comp, text sorted by bucket, i, j."""

    def packed(links):
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["a", "b"])

    at, held = None, []
    for batch in batches:
        sets = shingle_sets(as_bytes(batch.column("text")), n)
        for *key, block, node, comp, s in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "node", "comp")), sets, strict=True):
            if key != at:
                if len(held) > 1:
                    yield packed(_span(held, percent))
                at, held = key, []
            held.append((key[1], key[2], block, node, comp, s))
    if len(held) > 1:
        yield packed(_span(held, percent))


def _links(scratch: Scratch, pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the pairs hub, member that are similar enough, as a, b.

    A hub's members are dealt over parts of about SALT_ROWS, with the hub's text
    in each, so a hub of any size is read by many tasks, one text at a time.
    """
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / SALT_ROWS).cast("long").alias("parts"))
    dealt = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("member"), "parts").alias("part"), "member")
    rows = dealt.union(dealt.select("hub", "part", F.col("hub").alias("member")).distinct())
    rows = rows.join(texts.withColumnRenamed("node", "member"), "member").select("hub", "part", "member", "text")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("member") != F.col("hub"), "member")
    return scratch.save(rows.mapInArrow(partial(_confirm, n=n, percent=percent), "a long, b long"), "links")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5, doubt: float | None = DOUBT
) -> DataFrame:
    """Near-duplicate components of documents.

    Links documents whose sets of ``shingle_words``-word shingles have
    ``100 * intersection >= percent * union``.  A pair at similarity s is missed
    with probability ``(1 - s ** rows) ** bands``: 3e-6 at 0.80, 7e-9 at 0.85,
    and passed over by its sketch with 3e-7 at the threshold; without ``doubt``
    (None) every pair of a bucket that sizes allow is held against the full sets.

    Returns a row for each input row: doc_id, text_key (xxhash64 of the text),
    n_shingles, component_id (smallest id reachable, itself included) and kept
    (doc_id = component_id; of repeated rows with one id all are marked alike).
    Null and empty texts have no shingles and link with nothing.  Rows that
    share an id are one document, which has the links of each of its texts.  A
    row without an id links with nothing; its component_id is null and it is
    kept.  Ids are integers; a text id that is no number stops the run.  Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minmax")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    schema = "doc_id long, text_key long, n_shingles long, p0 long, p1 long, bands array<long>, sketch array<long>"
    signed = scratch.save(base.mapInArrow(partial(_signatures, n=shingle_words, bands=bands, rows=rows), schema), "signed")
    total = signed.count()

    # a node is a class of equal sets, whatever ids hold it; its first text stands for it
    equal = ["p0", "p1", "n_shingles"]
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy(*equal).agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.count("*").alias("rows_of_key"))
    classes = scratch.save(classes.select(*equal, "first.*", "rows_of_key", F.monotonically_increasing_id().alias("node")), "classes")
    first = full.join(classes.select("doc_id", "text_key", *equal, "node"), ["doc_id", "text_key", *equal]).dropDuplicates(["doc_id", "text_key", *equal]).select("node", "doc_id", "text_key", "n_shingles", "bands", "sketch")
    first = scratch.save(first, "first")
    # from here on signatures are needed of the classes only
    whole, signed = signed, scratch.save(signed.select("doc_id", "text_key", *equal), "ids")
    scratch.drop(whole)
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # the texts of one id are one document: its classes are linked
    several = full.groupBy("doc_id").agg(F.min(F.struct(*equal)).alias("x"), F.max(F.struct(*equal)).alias("y")).where("x <> y").select("doc_id")
    own = full.join(several, "doc_id", "left_semi").select("doc_id", *equal).distinct().join(classes.select(*equal, "node"), equal)
    reused = own.join(own.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").select(F.col("node").alias("a"), "b").where("a <> b")

    exploded = first.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.min("node").alias("x"), F.max("node").alias("y"), F.count("*").alias("k")).where("x <> y").select("bucket", "k")
    met = scratch.save(exploded.join(shared, "bucket").select("bucket", "node", "n", "k"), "met")
    score = met.groupBy("node").agg(F.sum("k").alias("score"))
    live = scratch.save(met.join(score, "node").select("bucket", "node", "n", "score"), "buckets")
    scratch.drop(met)
    hub = live.groupBy("bucket").agg(F.max(F.struct("score", "node", F.col("n").alias("n_hub"))).alias("h"), F.count("*").alias("rows_of_key"))
    hub = hub.select("bucket", F.col("h.node").alias("hub"), F.col("h.n_hub").alias("n_hub"), "rows_of_key")
    wanted = live.select("node").distinct()
    of_node = first.select(F.col("node"), F.col("doc_id").alias("d"), F.col("text_key").alias("k")).join(wanted, "node", "left_semi")
    texts = scratch.save(base.join(of_node, (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("k"))).dropDuplicates(["doc_id", "text_key", "node"]).select("node", "text"), "texts")

    values = 2 * ((bands * rows + 1) // 2)
    sized = F.expr(f"100 * least(n, n_hub) >= {percent} * greatest(n, n_hub)")
    alike = F.lit(True) if doubt is None else _mismatches("sketch", "hub_sketch", -(-values // _LANES)) <= most_mismatches(values, percent, doubt)
    with_hub = join_counted(live.select("bucket", "node", "n"), hub, ["bucket"], live.count(), "inner").where("node <> hub")
    # sketches meet the few different pairs, not the rows of every bucket
    sketches = first.select("node", "sketch")
    pairs = with_hub.where(sized).select("hub", F.col("node").alias("member")).distinct()
    pairs = pairs.join(sketches.withColumnRenamed("node", "member"), "member").join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub").where(alike).select("hub", "member")
    pairs = scratch.save(pairs, "pairs")
    links = _links(scratch, pairs, texts, shingle_words, percent)
    stars = components(scratch, links.union(reused))
    # buckets that are not of one component yet, and their members with a possible partner in another one
    placed = with_hub.select("bucket", "node", "n").join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left")
    placed = placed.withColumn("comp", F.coalesce("root", "node")).drop("root")
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    placed = scratch.save(placed.join(mixed, "bucket", "left_semi").join(sketches, "node"), "placed")
    scratch.drop(live)
    other = placed.select("bucket", F.col("n").alias("n_hub"), F.col("sketch").alias("hub_sketch"), F.col("comp").alias("hub_comp"))
    able = scratch.save(placed.join(other, (placed["bucket"] == other["bucket"]) & (F.col("comp") != F.col("hub_comp")) & sized & alike, "left_semi").select("bucket", "node", "n", "comp"), "able")
    scratch.drop(placed, first)
    blocks = able.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    rows_ = able.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows_ = rows_.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp").join(texts, "node")
    rows_ = rows_.select("bucket", "i", "j", "block", "node", "comp", "text").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    more = scratch.save(rows_.mapInArrow(partial(_blocks, n=shingle_words, percent=percent), "a long, b long"), "more")
    stars = components(scratch, stars.union(more))
    scratch.drop(texts, able)

    # the smallest id of a component, then the ids of each class
    placed = classes.join(stars.select(F.col("a").alias("node"), "b"), "node", "left").select(*equal, "doc_id", "rows_of_key", F.coalesce("b", "node").alias("root"))
    placed = scratch.save(placed, "roots")
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows_of_key"))
    named = join_counted(placed.withColumnRenamed("rows_of_key", "copies"), least, ["root"], total, "inner").withColumnRenamed("copies", "rows_of_key")
    of_class = named.select(*equal, "component_id", "rows_of_key")
    linked = join_counted(full.select("doc_id", "text_key", *equal), of_class, equal, total, "inner")
    # a set without shingles, or a row without an id, is of no class; of an id's other texts it has the component
    alone = signed.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "text_key", "n_shingles")
    beside = full.join(alone.where("doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", *equal).distinct()
    beside = beside.join(of_class, equal).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    alone = alone.join(beside, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    out = linked.select("doc_id", "text_key", "n_shingles", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
