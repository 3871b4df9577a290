"""Shortlist fusion: the embedder's first K identities, ranked anew with a matcher's scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The grid of shortlist lengths and weights.
GRID_K, GRID_ALPHA = (5, 10, 20), (0.3, 0.5, 0.7)
PROVENANCE = ("gallery", "probes", "variant", "detector", "matcher", "seed", "crops_sha256")


def check_provenance(a: dict, b: dict, keys: tuple[str, ...] = PROVENANCE) -> None:
    """Raises naming the keys on which two cached score sets differ."""
    bad = [k for k in keys if str(a.get(k)) != str(b.get(k))]
    if bad:
        raise ValueError("provenance differs in " + ", ".join(f"{k}: {a.get(k)!r} / {b.get(k)!r}" for k in bad))


def fuse(scores: DataFrame, k: int, method: str = "rerank", alpha: float = 0.5, embed: str = "es", match: str = "ms") -> DataFrame:
    """Adds embed_rank and hybrid_rank to pid, identity, es, ms.

    rerank orders the first k identities by matcher score (ties: embedder rank);
    linear by ``alpha`` z(es) + (1 - alpha) z(ms), z taken over the k candidates
    with population deviation (0 if that is at most 1e-9).  The tail keeps the
    embedder's order.
    """
    if method not in ("rerank", "linear"):
        raise ValueError(f"unknown fusion method {method!r}")
    by_probe = Window.partitionBy("pid")
    ranked = scores.withColumn("embed_rank", F.row_number().over(by_probe.orderBy(F.desc(embed), "identity")))
    ranked = ranked.withColumn("tail", (F.col("embed_rank") > k).cast("int"))
    if method == "rerank":
        key = F.col(match)
    else:
        part = Window.partitionBy("pid", "tail")

        def z(c: str):
            mean, sd = F.avg(c).over(part), F.stddev_pop(c).over(part)
            return F.when(sd > 1e-9, (F.col(c) - mean) / sd).otherwise(0.0)

        # rounded, so that equal scores stay equal whatever the order of summation
        key = F.round(alpha * z(embed) + (1 - alpha) * z(match), 9)
    ranked = ranked.withColumn("fused", F.when(F.col("tail") == 0, key))
    return ranked.withColumn("hybrid_rank", F.row_number().over(by_probe.orderBy("tail", F.desc("fused"), "embed_rank"))).drop("tail")


def fuse_hits(fused: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Hits of the true identity by embedder and hybrid rank; absent identities miss."""
    own = fused.join(truth.select("pid", "identity"), ["pid", "identity"]).select("pid", "embed_rank", "hybrid_rank")
    joined = truth.join(own, "pid", "left")
    hits = [F.coalesce(F.col(f"{kind}_rank") <= k, F.lit(False)).alias(f"{kind}_at_{k}") for kind in ("embed", "hybrid") for k in ks]
    return joined.select(*truth.columns, *hits)


def fuse_grid(scores: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 5), grid_k: tuple[int, ...] = GRID_K, grid_alpha: tuple[float, ...] = GRID_ALPHA) -> DataFrame:
    """Recall of every combination, in grid order, and which is best (recall@1, then recall at the largest k; the first wins ties)."""
    combos = [(k, "rerank", None) for k in grid_k] + [(k, "linear", a) for k in grid_k for a in grid_alpha]
    table = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(k).alias("k"), F.lit(m).alias("method"), F.lit(a).cast("double").alias("alpha")) for i, (k, m, a) in enumerate(combos)))
    by_probe = Window.partitionBy("pid")
    ranked = scores.withColumn("embed_rank", F.row_number().over(by_probe.orderBy(F.desc("es"), "identity")))
    # every combination in one plan, a window for each probe and combination
    rows = ranked.withColumn("g", F.explode(table)).select(*ranked.columns, "g.*").withColumn("tail", (F.col("embed_rank") > F.col("k")).cast("int"))
    part = Window.partitionBy("pid", "ord", "tail")

    def z(c: str):
        mean, sd = F.avg(c).over(part), F.stddev_pop(c).over(part)
        return F.when(sd > 1e-9, (F.col(c) - mean) / sd).otherwise(0.0)

    linear = F.round(F.col("alpha") * z("es") + (1 - F.col("alpha")) * z("ms"), 9)
    rows = rows.withColumn("fused", F.when(F.col("tail") == 0, F.when(F.col("method") == "rerank", F.col("ms")).otherwise(linear)))
    rows = rows.withColumn("hybrid_rank", F.row_number().over(Window.partitionBy("pid", "ord").orderBy("tail", F.desc("fused"), "embed_rank")))
    own = rows.join(truth.select("pid", "identity"), ["pid", "identity"])
    total = truth.agg(F.count("*").alias("n"))
    found = own.groupBy("ord", "k", "method", "alpha").agg(*(F.count_if(F.col("hybrid_rank") <= n).alias(f"h{n}") for n in ks)).crossJoin(F.broadcast(total))  # total is one row
    out = found.select("ord", "k", "method", "alpha", *(F.coalesce(F.try_divide(F.col(f"h{n}").cast("double"), F.col("n").cast("double")), F.lit(0.0)).alias(f"recall_at_{n}") for n in ks))
    order = Window.orderBy(F.desc(f"recall_at_{ks[0]}"), F.desc(f"recall_at_{ks[-1]}"), "ord")  # a row a combination
    return out.withColumn("best", F.row_number().over(order) == 1)
