"""Recall summaries, coverage splits, paired tests, open-set statistics and calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.functions.stats import bootstrap, mcnemar_udf, wilson
from dapple.operators.prefix import running_sums
from dapple.operators.retrieval import DIGITS, gallery_matrix, matrix_of, similarities
from dapple.session import ship

D = "double"
#: Rows up to which a bootstrap draws row by row.
SEED_ROWS = 100_000


def summarize(hits: DataFrame, ks: tuple[int, ...] = (1, 5), by: str = "cohort") -> DataFrame:
    """One row overall, with Wilson intervals, and one for each cohort, without: GROUPING SETS ((), (cohort)).

    Counted once by cohort; the overall row adds those counts up, so there is
    one even without probes (recall 0).
    """
    per = hits.groupBy(by).agg(F.count("*").alias("n"), *(F.count_if(F.col(f"hit_at_{k}")).alias(f"h{k}") for k in ks))
    overall = per.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in per.columns[1:])).select(F.lit("overall").alias("slice"), F.lit(True).alias("all"), *per.columns[1:])
    rows = overall.union(per.select(F.col(by).cast("string"), F.lit(False), *per.columns[1:]))
    out = [F.col("slice"), F.col("n")]
    for k in ks:
        h = F.col(f"h{k}")
        ci = wilson(h, F.col("n"))
        recall = F.coalesce(F.try_divide(h.cast(D), F.col("n").cast(D)), F.lit(0.0))
        out += [F.round(recall, 6).alias(f"recall_at_{k}"), F.when(F.col("all"), F.round(ci["lo"], 4)).alias(f"lo_{k}"), F.when(F.col("all"), F.round(ci["hi"], 4)).alias(f"hi_{k}")]
    return rows.select(*out)


def recall_split(hits: DataFrame, known: str, official: int | None = None, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Recall over probes whose identity is in the gallery, and over the official number of probes."""
    n = F.lit(official) if official is not None else F.count("*")
    aggs = [F.count("*").alias("n_probe"), F.count_if(F.col(known)).alias("n_closed"), F.count_if(~F.col(known)).alias("n_excluded")]
    for k in ks:
        inside = F.count_if(F.col(f"hit_at_{k}") & F.col(known)).cast(D)
        aggs += [F.round(F.coalesce(F.try_divide(inside, F.count_if(F.col(known)).cast(D)), F.lit(0.0)), 6).alias(f"closed_at_{k}"), F.round(F.coalesce(F.try_divide(inside, n.cast(D)), F.lit(0.0)), 6).alias(f"pipeline_at_{k}")]
    return hits.agg(*aggs)


def discordant(pairs: DataFrame, base: str, challenger: str, by: list[str] | None = None) -> DataFrame:
    """McNemar counts: b, only the base hits; c, only the challenger."""
    a, z = F.col(base), F.col(challenger)
    return pairs.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(a & ~z).alias("b"), F.count_if(~a & z).alias("c"))


def mcnemar(counts: DataFrame) -> DataFrame:
    ship(counts.sparkSession)
    return counts.withColumn("p", mcnemar_udf("b", "c"))


def paired_bootstrap(pairs: DataFrame, base: str, challenger: str, order: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """diff, lo and hi of the recall difference over paired resamples.

    Up to SEED_ROWS rows one task draws them in order of ``order``, exactly as
    the seed says.  Beyond, only three counts matter (differences are -1, 0 and
    1), whose resamples are multinomial: the same law from one row.
    """
    ship(pairs.sparkSession)
    counts = discordant(pairs, base, challenger)
    if counts.first()["n"] > SEED_ROWS:

        def draw(groups):
            import numpy as np
            import pandas as pd

            for g in groups:
                for n, b, c in zip(g["n"], g["b"], g["c"], strict=True):
                    drawn = np.random.RandomState(seed).multinomial(n, [b / n, c / n, (n - b - c) / n], resamples)
                    lo, hi = np.percentile((drawn[:, 1] - drawn[:, 0]) / n, [2.5, 97.5])
                    yield pd.DataFrame({"diff": [(c - b) / n], "lo": [lo], "hi": [hi]})

        return counts.mapInPandas(draw, "diff double, lo double, hi double")

    def run(groups):
        import pandas as pd

        rows = pd.concat(list(groups), ignore_index=True) if groups else None
        if rows is None or not len(rows):
            yield pd.DataFrame({"diff": [0.0], "lo": [0.0], "hi": [0.0]})
            return
        rows = rows.sort_values(order)
        d, lo, hi = bootstrap(rows[base].to_numpy(), rows[challenger].to_numpy(), resamples, seed)
        yield pd.DataFrame({"diff": [d], "lo": [lo], "hi": [hi]})

    return pairs.select(order, base, challenger).coalesce(1).mapInPandas(run, "diff double, lo double, hi double")


def scaled_bootstrap(pairs: DataFrame, base: str, challenger: str, order: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """The same interval for any number of rows: Poisson resampling, each row's weights drawn from a hash of its key.

    A task keeps two sums a resample, so nothing but those moves.
    """
    ship(pairs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        gain, weight = np.zeros(resamples), np.zeros(resamples)
        steps = np.cumsum([np.exp(-1.0) / math.factorial(k) for k in range(12)])
        salt = np.arange(resamples, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            d = batch.column("d").to_numpy()
            for lo in range(0, len(h), 4096):
                x = h[lo : lo + 4096, None] + salt
                x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(steps, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), side="right")
                gain += (w * d[lo : lo + 4096, None]).sum(axis=0)
                weight += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(gain), pa.array(weight)], names=["r", "gain", "weight"])

    d = (F.col(challenger).cast("int") - F.col(base).cast("int")).cast(D)
    rows = pairs.select(F.xxhash64(F.lit(seed), order).alias("h"), d.alias("d"))
    sums = rows.mapInArrow(run, "r long, gain double, weight double").groupBy("r").agg(F.try_divide(F.sum("gain"), F.sum("weight")).alias("m"))
    return sums.agg(F.percentile("m", 0.025).alias("lo"), F.percentile("m", 0.975).alias("hi")).crossJoin(rows.agg(F.avg("d").alias("diff"))).select("diff", "lo", "hi")  # one row each


def auroc(scores: DataFrame, score: str = "score", is_new: str = "is_new") -> DataFrame:
    """Chance that a known probe outscores a new one, ties half; null with one class only.

    Works on distinct scores with their class counts, and running sums over
    them, rather than ranking every row.
    """
    per = scores.groupBy(score).agg(F.count_if(~F.col(is_new)).alias("k"), F.count_if(F.col(is_new)).alias("w"))
    below = running_sums(per, score, {"w_below": "w"}, inclusive=False)
    wins = F.sum(F.col("k") * (F.coalesce("w_below", F.lit(0)) + F.col("w") * F.lit(0.5)))
    out = below.agg(wins.cast(D).alias("wins"), F.sum("k").alias("n_known"), F.sum("w").alias("n_new"))
    return out.select("n_known", "n_new", F.try_divide(F.col("wins"), (F.col("n_known") * F.col("n_new")).cast(D)).alias("auroc"))


def youden(scores: DataFrame, score: str = "score", is_new: str = "is_new") -> DataFrame:
    """threshold and j of the largest TPR - FPR over the corners of the ROC curve; the highest threshold wins ties.

    With one class the threshold is the median score (0 without scores) and j 0.
    """
    per = scores.groupBy(score).agg(F.count_if(~F.col(is_new)).alias("k"), F.count_if(F.col(is_new)).alias("w"))
    run = running_sums(per, score, {"tp": "k", "fp": "w"}, descending=True)
    total = scores.agg(F.count_if(~F.col(is_new)).alias("pos"), F.count_if(F.col(is_new)).alias("neg"), F.median(score).alias("mid"))
    # J is linear along a straight piece of the curve, so the highest threshold of its maximum is a corner
    points = run.crossJoin(F.broadcast(total)).where("pos > 0 AND neg > 0")  # total is one row
    j = F.col("tp") / F.col("pos").cast(D) - F.col("fp") / F.col("neg").cast(D)
    best = points.agg(F.max(F.struct(F.round(j, 12).alias("j"), F.col(score).alias("t"))).alias("best"))
    one = total.crossJoin(best)
    return one.select(F.coalesce("best.t", "mid", F.lit(0.0)).cast(D).alias("threshold"), F.coalesce("best.j", F.lit(0.0)).alias("j"))


def policy(scores: DataFrame, threshold: Column, margin_min: float = 0.0) -> DataFrame:
    return scores.withColumn("is_known", (F.col("max_sim") >= threshold) & (F.col("margin") >= margin_min))


def policy_rates(scores: DataFrame) -> DataFrame:
    """Share of known probes kept and of new ones falsely taken for known."""
    kept = F.avg(F.when(~F.col("is_new"), F.col("is_known").cast(D)))
    false = F.avg(F.when(F.col("is_new"), F.col("is_known").cast(D)))
    return scores.agg(F.round(kept, 6).alias("known_kept"), F.round(false, 6).alias("new_falsely_known"))


def pair_calibration(pairs: DataFrame, rows: int, impostor: float = 0.95, genuine: float = 0.90) -> DataFrame:
    """Confidence range from gallery pairs sim, same (of one identity); ``rows`` gallery photos.

    Under three photos it is (0.15, 0.55); with five pairs of each kind the
    impostors' and the genuine pairs' percentiles; else the 75th and 99.5th of
    all.  The upper end lies above the lower by 0.001 at least.
    """
    aggs = pairs.agg(
        F.count_if("same").alias("g"), F.count_if(~F.col("same")).alias("i"),
        F.percentile(F.when(~F.col("same"), F.col("sim")), impostor).alias("pi"), F.percentile(F.when(F.col("same"), F.col("sim")), genuine).alias("pg"),
        F.percentile("sim", 0.75).alias("p75"), F.percentile("sim", 0.995).alias("p995"),
    )
    both = (F.col("g") >= 5) & (F.col("i") >= 5)
    lo, hi = F.when(both, F.col("pi")).otherwise(F.col("p75")), F.when(both, F.col("pg")).otherwise(F.col("p995"))
    few = F.lit(rows < 3)
    out = aggs.select(F.when(few, 0.15).otherwise(lo).alias("lo"), F.when(few, 0.55).otherwise(hi).alias("hi"))
    return out.select("lo", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1e-3).otherwise(F.col("hi")).alias("hi"))


def gallery_calibration(gallery: DataFrame, identity: str = "identity", impostor: float = 0.95, genuine: float = 0.90, bins: int = 1 << 16) -> DataFrame:
    """``pair_calibration`` of all gallery pairs, one row, without a row for each pair.

    Exact percentiles in two passes: tasks count similarities in ``bins`` bins
    by kind; then only the values of the few bins that hold the wanted ranks
    are gathered.
    """
    import numpy as np

    spark = gallery.sparkSession
    rows, n, matrix = gallery_matrix(gallery, identity)
    if matrix is None:  # too large to hold in one piece
        who = gallery.select("id", F.col(identity).alias("who"))
        sims = similarities(gallery, gallery).where("pid < gid")
        pairs = sims.join(who.select(F.col("id").alias("pid"), F.col("who").alias("a")), "pid").join(who.select(F.col("id").alias("gid"), F.col("who").alias("b")), "gid")
        return pair_calibration(pairs.select("sim", (F.col("a") == F.col("b")).alias("same")), n, impostor, genuine)

    def pairs_of(batches):
        ids, vectors, who = matrix.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                pid = part.column(0).to_numpy()
                sims = np.round(matrix_of(part.column(1)) @ vectors.T, DIGITS)
                own = np.searchsorted(ids, pid)
                later = ids[None, :] > pid[:, None]
                yield sims[later], (who[own][:, None] == who[None, :])[later]

    def place(sims):
        return np.clip(((sims + 1.0) * (bins / 2)).astype(np.int64), 0, bins - 1)

    def count(batches):
        import pyarrow as pa

        total = np.zeros((2, bins), dtype=np.int64)
        for sims, same in pairs_of(batches):
            at = place(sims)
            total[1] += np.bincount(at[same], minlength=bins)
            total[0] += np.bincount(at[~same], minlength=bins)
        kind, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(at), pa.array(total[kind, at])], names=["same", "bin", "n"])

    counted = rows.mapInArrow(count, "same long, bin long, n long").groupBy("same", "bin").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((2, bins), dtype=np.int64)
    for r in counted:
        table[r["same"], r["bin"]] = r["n"]
    wanted = {"pi": (table[0], impostor, (0,)), "pg": (table[1], genuine, (1,)), "p75": (table.sum(axis=0), 0.75, (0, 1)), "p995": (table.sum(axis=0), 0.995, (0, 1))}
    ranks, need = {}, set()
    for name, (hist, q, _) in wanted.items():
        if hist.sum():
            at = (hist.sum() - 1) * q
            ends = np.cumsum(hist)
            found = [(r, int(np.searchsorted(ends, r, side="right"))) for r in (math.floor(at), math.ceil(at))]
            ranks[name] = (at, found, ends)
            need |= {b for _, b in found}
    keep = np.array(sorted(need), dtype=np.int64)

    def gather(batches):
        import pyarrow as pa

        for sims, same in pairs_of(batches):
            inside = np.isin(place(sims), keep)
            yield pa.RecordBatch.from_arrays([pa.array(sims[inside]), pa.array(same[inside].astype(np.int64))], names=["sim", "same"])

    values = np.array([(r["sim"], r["same"]) for r in rows.mapInArrow(gather, "sim double, same long").collect()]).reshape(-1, 2)
    where = place(values[:, 0])

    def value(name, rank, b):
        _, _, ends = ranks[name]
        inside = np.sort(values[(where == b) & np.isin(values[:, 1], wanted[name][2]), 0])
        return inside[rank - (ends[b - 1] if b else 0)]

    p = {}
    for name, (at, ((r0, b0), (r1, b1)), _) in ranks.items():
        low, high = value(name, r0, b0), value(name, r1, b1)
        p[name] = float(low + (at - r0) * (high - low))
    both = table[1].sum() >= 5 and table[0].sum() >= 5
    lo, hi = (0.15, 0.55) if n < 3 else (p["pi"], p["pg"]) if both else (p["p75"], p["p995"])
    return spark.createDataFrame([(lo, hi if hi > lo else lo + 1e-3)], "lo double, hi double").coalesce(1)


def sweep(pairs: DataFrame, thresholds: tuple[float, ...], confidence: str, base: str, challenger: str) -> DataFrame:
    """For each threshold the share of rows above it and the recall of taking the challenger only there."""
    rows = pairs.withColumn("threshold", F.explode(F.array(*(F.lit(float(t)) for t in thresholds))))
    use = F.col(confidence) >= F.col("threshold")
    hit = F.when(use, F.col(challenger)).otherwise(F.col(base))
    return rows.groupBy("threshold").agg(F.round(F.avg(use.cast(D)), 3).alias("coverage"), F.round(F.avg(hit.cast(D)), 4).alias("recall"))


def sealed_report(hits: DataFrame, known: str, scores: DataFrame, threshold: float, official: int, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """One row: recall with intervals, closed-set and pipeline recall, AUROC and policy rates at a threshold tuned elsewhere."""
    overall = summarize(hits, ks).where("slice = 'overall'").drop("slice")
    split = recall_split(hits, known, official, ks)
    rates = policy_rates(policy(scores, F.lit(threshold)))
    area = auroc(scores, "max_sim").select("auroc")
    return overall.crossJoin(split).crossJoin(area).crossJoin(rates).withColumn("threshold", F.lit(threshold))  # one row each
