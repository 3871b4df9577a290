"""Mixing sources to target weights by entropy balancing.

Among document rates r that meet token constraints, such as a target for each
source, the ones of least relative entropy to the corpus, sum of size * (r log r
- r), are an exponential tilt: ``r = exp(sum of the multipliers of a document's
constraints)``.  A document may be under any number of constraints at once (its
source, its language, its length class).  The multipliers maximise a concave
dual (minimise its convex negative) by Newton steps: each step sums the tilted
tokens of every constraint (gradient) and of every pair of constraints (Hessian)
over the documents' cells, distributed, and the driver solves for the step.
Rates are then rounded into whole copies by error diffusion over each source's
documents, large ones first, so that the tokens taken come within about one
small document of the target in each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Rows of a source that one rounding bucket holds, about.
BUCKET_ROWS = 2_000
WORD = r"[^\x20\x09-\x0D]+"


def share_targets(sizes: dict, weights: dict, total: float, cap: float) -> dict:
    """Targets by weight that stop at ``cap`` times a source's size; the excess is shared again by weight."""
    out: dict = {}
    left, active = float(total), [k for k in sizes if weights.get(k, 0) > 0]
    out |= {k: 0.0 for k in sizes if k not in active}
    while active:
        weight = sum(weights[k] for k in active)
        share = {k: left * weights[k] / weight for k in active}
        over = [k for k in active if share[k] > cap * sizes[k]]
        if not over:
            return out | share
        for k in over:
            out[k] = float(cap * sizes[k])
        left -= sum(out[k] for k in over)
        active = [k for k in active if k not in over]
    return out


def balance(cells: DataFrame, groups: list[str], targets: list[dict], steps: int = 100, tolerance: float = 1e-10) -> list[dict]:
    """Multipliers of each constraint: damped Newton steps on the dual of the balance.

    ``cells`` has the columns ``groups`` and tokens, in any number of rows; a
    constraint is a value of a group, its target the tokens that rows of that
    value shall have.  Values without a target are free; values with target 0
    get minus infinity, rate 0, and their cells count no more; values without
    tokens too.  Constraints may overlap and depend on each other; ones that
    cannot be met together are met as nearly as the dual comes.  The driver
    holds a number for each constraint and pair of constraints that share a cell.
    """
    names = [(g, v) for g, t in enumerate(targets) for v in t]
    out = [{v: -math.inf for v in t} for t in targets]
    live = cells.where("tokens > 0")
    for g, t in zip(groups, targets, strict=True):
        for v in (v for v, x in t.items() if x <= 0):
            live = live.where(~F.col(g).eqNullSafe(F.lit(v)))
    # the numbers of a cell's constraints
    number = {x: k for k, x in enumerate(names)}

    for g, t in enumerate(targets):
        # one row a constraint
        rows = cells.sparkSession.createDataFrame([(v, number[g, v]) for v in t], f"v{g} string, k{g} int")
        live = live.join(F.broadcast(rows), F.col(groups[g]).eqNullSafe(F.col(f"v{g}")), "left")
    held = live.select(F.filter(F.array(*(F.col(f"k{g}") for g in range(len(groups)))), lambda k: k.isNotNull()).alias("ks"), "tokens").groupBy("ks").agg(F.sum("tokens").alias("tokens"))
    seen = sorted({r["k"] for r in held.select(F.explode("ks").alias("k")).distinct().collect()})
    place = {k: i for i, k in enumerate(seen)}
    goal = np.array([targets[names[k][0]][names[k][1]] for k in seen], dtype=np.float64)
    lam = np.zeros(len(seen))

    def moments(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Tilted tokens in all, of each constraint and of each pair."""
        table = F.array(*(F.lit(float(at[place[k]]) if k in place else 0.0) for k in range(len(names))))
        mass = F.col("tokens") * F.exp(F.aggregate("ks", F.lit(0.0), lambda acc, k: acc + F.element_at(table, k + 1)))
        tilted = held.select("ks", mass.alias("mass"))
        pairs = tilted.select(F.explode("ks").alias("a"), "ks", "mass").select("a", F.explode("ks").alias("b"), "mass").groupBy("a", "b").agg(F.sum("mass").alias("mass")).collect()
        hessian = np.zeros((len(seen), len(seen)))
        for r in pairs:
            hessian[place[r["a"]], place[r["b"]]] = r["mass"]
        return float(tilted.agg(F.sum("mass")).first()[0] or 0.0), np.diag(hessian).copy(), hessian

    if not seen:
        return out
    total, mass, hessian = moments(lam)
    for _ in range(steps):
        gap = goal - mass
        if np.abs(gap / goal).max() < tolerance:
            break
        scale = 1 / np.sqrt(np.maximum(np.diag(hessian), 1e-300))
        # dependent constraints leave directions without curvature, which the least-norm solution stays out of
        step = scale * np.linalg.lstsq(hessian * scale[:, None] * scale[None, :], gap * scale, rcond=1e-12)[0]
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))
        value, rise, length = goal @ lam - total, gap @ step, 1.0
        while True:  # the dual must rise
            tried = moments(lam + length * step)
            if goal @ (lam + length * step) - tried[0] >= value + 1e-4 * length * rise - 1e-12 * max(1.0, abs(value)) or length < 1e-4:
                break
            length /= 2
        lam = lam + length * step
        total, mass, hessian = tried
        if np.abs(length * step).max() < tolerance:
            break
    for k in seen:
        out[names[k][0]][names[k][1]] = float(lam[place[k]])
    return out


def _diffuse(batches: Iterator[pa.RecordBatch], cap: float) -> Iterator[pa.RecordBatch]:
    """Rows sorted by source, bucket and falling size. Chooses the floor or ceiling of each rate, carrying the error on."""
    at, error = None, 0.0
    for batch in batches:
        c = batch.to_pydict()
        copies = []
        for source, bucket, size, n, rate in zip(c["source"], c["bucket"], c["size"], c["n"], c["rate"], strict=True):
            if (source, bucket) != at:
                at, error = (source, bucket), 0.0
            near = round(rate)
            low, high = (near, near) if abs(rate - near) < 1e-7 else (math.floor(rate), math.ceil(rate))
            mass = size * n
            want = rate * mass + error
            pick = low if abs(want - low * mass) <= abs(want - high * mass) else high
            pick = min(pick, math.floor(cap))
            error = want - pick * mass
            copies.append(pick)
        extra = batch.schema.names[7:]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(copies, pa.int64()), *batch.columns[7:]], names=["source", "doc_id", "text_key", "copies", *extra])


def length_class(size: Column) -> Column:
    """The number of decimal digits of a size, as text."""
    return F.length(size.cast("string")).cast("string")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, cap: float = 3.0, also: dict[str, dict] | None = None) -> DataFrame:
    """Copies of each document so that the sources' tokens meet their target weights.

    Sizes are words ``[^\\x20\\x09-\\x0D]+`` (null text: 0).  Sources, in code
    point order with null last, weigh ``weights`` repeating and share 100% of
    all sizes; a target stops at ``cap`` times its source's size, the excess
    shared again by weight.  ``also`` names further columns of ``docs`` (or
    ``length``, the class of ``length_class``) and the share of all sizes that
    each of their values shall have, which hold at the same time.  Sources and
    values are few enough for one row each on the driver, as their weights are.

    Returns a row for each input row: doc_id, text_key, source, size,
    source_size, target, rate, copies, taken (= size * copies).  Equal rows (id,
    text, source and values of ``also``) get equal copies.  Null ids are ids
    like any other; empty texts have size 0 and rate as their source; texts of
    any length count whole; an empty table gives no rows.  Ids are integers; a
    text id that is no number stops the run.  The same rows always give the same
    copies.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    also = also or {}
    extra = [f"g{k}" for k in range(len(also))]
    values = [(length_class(size) if c == "length" else F.col(c).cast("string")).alias(e) for c, e in zip(also, extra, strict=True)]
    sized = docs.select(F.col(source_col).cast("string").alias("source"), F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), size.alias("size"), *values)
    sized = scratch.save(sized, "sized")
    cells = scratch.save(sized.groupBy("source", *extra, length_class(F.col("size")).alias("digits")).agg(F.sum("size").alias("tokens"), F.count("*").alias("rows")), "cells")
    found = cells.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("rows").alias("rows")).collect()
    sizes = {r["source"]: r["tokens"] for r in sorted(found, key=lambda r: (r["source"] is None, r["source"] or ""))}
    weight = {k: weights[i % len(weights)] for i, k in enumerate(sizes)}
    targets = share_targets(sizes, weight, sum(sizes.values()), cap)
    lam = balance(cells, ["source", *extra], [targets, *({v: share * sum(sizes.values()) for v, share in t.items()} for t in also.values())])
    rows = {r["source"]: r["rows"] for r in found}
    schema = T.StructType([T.StructField("name", T.StringType()), *(T.StructField(n, t) for n, t in (("source_size", T.LongType()), ("target", T.DoubleType()), ("lam", T.DoubleType()), ("buckets", T.LongType())))])
    # one row a source
    plan = F.broadcast(spark.createDataFrame([(k, sizes[k], targets[k], lam[0][k], max(1, math.ceil(rows[k] / BUCKET_ROWS))) for k in sizes], schema))
    planned = sized.join(plan, sized["source"].eqNullSafe(plan["name"])).drop("name")
    tilt = F.col("lam")
    for e, t in zip(extra, lam[1:], strict=True):
        part = F.lit(0.0)
        for v, x in t.items():
            part = F.when(F.col(e).eqNullSafe(F.lit(v)), F.lit(x)).otherwise(part)
        tilt = tilt + part
    planned = planned.withColumn("rate", F.least(F.lit(float(cap)), F.exp(tilt)))
    equal = ["source", "doc_id", "text_key", *extra]
    keys = planned.groupBy(*equal, "size", "rate", "buckets").agg(F.count("*").alias("n"))
    dealt = keys.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_key"), "buckets"))
    dealt = dealt.select("source", "doc_id", "text_key", "size", "n", "rate", "bucket", *extra)
    dealt = dealt.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), "doc_id", "text_key", *extra)
    picked = dealt.mapInArrow(partial(_diffuse, cap=cap), "source string, doc_id long, text_key long, copies long" + "".join(f", {e} string" for e in extra))
    p = scratch.save(picked, "copies").select(*(F.col(c).alias(f"p_{c}") for c in equal), "copies")
    same = F.lit(True)
    for c in equal:
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    out = planned.join(p, same, "left")
    return out.select("doc_id", "text_key", "source", "size", "source_size", "target", "rate", "copies", (F.col("size") * F.col("copies")).alias("taken"))
