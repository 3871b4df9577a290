"""Declarative data-quality gates: each is a DataFrame of violations.

A gate takes the tables it needs by name and returns columns gate and key; no
rows means it holds.  ``run_gates`` unites any number of them in one plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.operators.decide import adopt_variant_by
from dapple.schema import ALPHA, EXPECTED_DIMS, FIRST_YEAR, LAST_YEAR, SCOPES

Gate = Callable[[dict[str, DataFrame]], DataFrame]
GATES: dict[str, tuple[Gate, bool]] = {}


class GateError(ValueError):
    """A hard gate has violations."""


def gate(name: str, hard: bool = True) -> Callable[[Gate], Gate]:
    def add(f: Gate) -> Gate:
        GATES[name] = (f, hard)
        return f

    return add


def _bad(df: DataFrame, key: str | Column) -> DataFrame:
    return df.select((F.col(key) if isinstance(key, str) else key).cast("string").alias("key"))


def _kept(t: dict[str, DataFrame]) -> DataFrame:
    return t["target"].where("dup_keep")


def _live(t: dict[str, DataFrame]) -> DataFrame:
    return _kept(t).where("NOT is_new_open")


@gate("g1_md5_in_one_role")
def _(t):
    k = _kept(t)
    return _bad(k.where("split_role = 'gallery'").select("md5").intersect(k.where("split_role = 'probe'").select("md5")), "md5")


@gate("g2_closed_probes_in_gallery")
def _(t):
    g = _kept(t).where("split_role = 'gallery'").select("individual_id")
    return _bad(_live(t).where("split_role = 'probe'").select("individual_id").distinct().join(g, "individual_id", "left_anti"), "individual_id")


@gate("g3_external_apart")
def _(t):
    a = _bad(t["external"].where("role <> 'external' OR role IS NULL"), "md5")
    return a.union(_bad(t["target"].where("cohort = 'GCN'"), "md5"))


@gate("g4_one_survivor")
def _(t):
    both = t["target"].select("dup_group", "dup_keep").union(t["external"].select("dup_group", "dup_keep"))
    return _bad(both.where("dup_group >= 0").groupBy("dup_group").agg(F.count_if("dup_keep").alias("n")).where("n <> 1"), "dup_group")


@gate("g5_complete")
def _(t):
    return _bad(t["target"].where("dup_keep IS NULL OR (dup_keep AND split_scheme IS NULL)"), "md5")


@gate("g6_folds")
def _(t):
    return _bad(_kept(t).where("(split_role = 'probe' AND (split_fold IS NULL OR split_fold NOT IN ('dev', 'test'))) OR (split_role = 'gallery' AND (split_fold IS NULL OR split_fold <> 'train'))"), "md5")


@gate("g7_paths")
def _(t):
    both = t["target"].select("rel_path", "md5").union(t["external"].select("rel_path", "md5"))
    absolute = _bad(both.where("rel_path LIKE '/%' OR rel_path RLIKE '^[A-Za-z]:'"), "rel_path")
    if "files" not in t:
        return absolute
    return absolute.union(_bad(both.where("md5 NOT LIKE 'MISSING:%'").join(t["files"].select("rel_path"), "rel_path", "left_anti"), "rel_path"))


@gate("g8_one_cohort")
def _(t):
    both = t["target"].select("individual_id", "cohort").union(t["external"].select("individual_id", "cohort"))
    per = both.groupBy("individual_id").agg(F.count_distinct("cohort").alias("n"), F.min("cohort").alias("c"))
    return _bad(per.where((F.col("n") > 1) | (F.split_part("individual_id", F.lit("-"), F.lit(1)) != F.col("c"))), "individual_id")


@gate("g9_dates")
def _(t):
    d = F.col("date")
    fmt = d.rlike("^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$")
    real = F.try_to_timestamp(F.when(F.length(d) == 7, F.concat(d, F.lit("-01"))).otherwise(d), F.lit("yyyy-MM-dd")).isNotNull()
    year = F.substring(d, 1, 4).try_cast("int").between(FIRST_YEAR, LAST_YEAR)
    bad = d.isNotNull() & ~F.coalesce(fmt & real & year, F.lit(False))
    return _bad(t["target"].where(bad | ~F.coalesce(F.col("date_source").isin("filename", "subfolder", "none", "unparsed"), F.lit(False))), "md5")


@gate("g10_dimensions", hard=False)
def _(t):
    dims = F.array_sort(F.array("width", "height"))
    expected = F.create_map(*(x for c, (a, b) in EXPECTED_DIMS.items() for x in (F.lit(c), F.array(F.lit(a), F.lit(b)))))
    return _bad(t["target"].where(F.col("cohort").isin(*EXPECTED_DIMS) & (dims != expected[F.col("cohort")])), "md5")


@gate("g11_unique_survivors")
def _(t):
    both = _kept(t).select("md5").union(t["external"].where("dup_keep").select("md5"))
    return _bad(both.groupBy("md5").count().where("count > 1"), "md5")


@gate("g12_stage_rules")
def _(t):
    k = _kept(t)
    gallery = k.where("split_role = 'gallery'")
    opened = k.where("is_new_open")
    out = _bad(k.where("split_fold = 'train' AND split_role <> 'gallery'"), "md5")
    out = out.union(_bad(opened.where("split_role <> 'probe'"), "md5"))
    out = out.union(_bad(opened.select("individual_id").distinct().join(gallery.select("individual_id"), "individual_id", "left_semi"), "individual_id"))
    out = out.union(_bad(k.where("split_fold = 'dev'").select("md5").intersect(k.where("split_fold = 'test'").select("md5")), "md5"))
    scope = F.when(F.col("cohort").isin("TK", "PW"), SCOPES[0]).when(F.col("cohort") == "LAB", SCOPES[1])
    return out.union(_bad(t["target"].where(~F.col("kpi_scope").eqNullSafe(scope)), "md5"))


def _core(t: dict[str, DataFrame]) -> DataFrame:
    return t["target"].where("kpi_scope = 'kpi_core'")


def _sealed(t: dict[str, DataFrame]) -> DataFrame:
    """Every photo of the sealed set, open individuals and dropped duplicates too."""
    return _core(t).where("split_fold = 'test'").select("md5").distinct()


@gate("c1_crop_for_each_row")
def _(t):
    wanted = _core(t).where("dup_keep AND NOT is_new_open AND split_role IN ('gallery', 'probe') AND split_fold IN ('train', 'dev')")
    return _bad(wanted.join(t["crops"].select("md5"), "md5", "left_anti"), "md5")


@gate("c2_no_orphan_crop")
def _(t):
    return _bad(t["crops"].select("md5").distinct().join(t["target"].select("md5").union(t["external"].select("md5")), "md5", "left_anti"), "md5")


@gate("c3_never_mirrored")
def _(t):
    return _bad(t["crops"].where("mirrored"), "md5")


@gate("c4_one_geometry")
def _(t):
    cut = t["crops"].where("variant <> 'full'")
    several = cut.agg(F.count_distinct("canon_size").alias("a"), F.count_distinct("pipeline_version").alias("b")).where("a > 1 OR b > 1")
    out = _bad(several, F.lit("canon_size, pipeline_version"))
    if "config" not in t:
        return out
    # one row: the configured canon_size
    other = cut.select("canon_size").distinct().join(F.broadcast(t["config"].select(F.col("canon_size").alias("wanted"))), F.col("canon_size") != F.col("wanted"))
    return out.union(_bad(other, F.concat(F.lit("canon_size "), F.col("canon_size").cast("string"))))


@gate("c6_head_up", hard=False)
def _(t):
    return _bad(t["crops"].where("variant = 'belly_oriented' AND head_y IS NOT NULL").agg(F.avg((F.col("head_y") < F.col("cloaca_y")).cast("double")).alias("s")).where("s < 0.85"), "s")


@gate("c7_fallback_budget")
def _(t):
    cut = t["crops"].where("variant NOT LIKE 'unroll\\_%'").join(_core(t).select("md5"), "md5", "left_semi")
    return _bad(cut.agg(F.avg((~F.col("crop_status").isin("ok", "clipped_after_rotation")).cast("double")).alias("s")).where("s > 0.10"), "s")


@gate("c8_decision_stands")
def _(t):
    """The stated variant decision against its recomputation from the comparison's metrics.

    ``ab_metrics``: variant, pattern_safe, recall_1, recall_5, p_1, p_5, the
    baseline among them; ``ab_decision``: one row with stated, baseline, alpha, allow_at_1.
    """
    straight = t["crops"].where("variant LIKE 'unroll\\_%'").select("variant").distinct()
    if "ab_metrics" not in t or "ab_decision" not in t:
        return _bad(straight.limit(1), F.lit("unroll variants without a comparison"))
    known = t["ab_metrics"].select("variant")
    missing = straight.join(known, "variant", "left_anti")
    stated = t["ab_decision"]
    domain = straight.withColumnRenamed("variant", "stated").union(stated.select("baseline"))
    foreign = stated.join(domain, "stated", "left_anti")
    # one row; without unroll variants nothing has to be decided
    rows = t["ab_metrics"].where("variant LIKE 'unroll\\_%'").select("*", F.lit(False).alias("is_base"))
    base = t["ab_metrics"].join(F.broadcast(stated.select(F.col("baseline").alias("variant"))), "variant", "left_semi").select("*", F.lit(True).alias("is_base"))
    found = adopt_variant_by(rows.union(base), stated)
    wrong = found.where("NOT (stated <=> decision)")
    any_straight = straight.limit(1).select(F.lit(1).alias("one"))
    return _bad(missing, "variant").union(_bad(foreign.crossJoin(any_straight), F.coalesce("stated", F.lit("no decision")))).union(_bad(wrong.crossJoin(any_straight), F.concat(F.lit("recomputed "), F.col("decision"))))


@gate("c9_sealed_crops")
def _(t):
    return _bad(t["crops"].join(_sealed(t), "md5", "left_semi"), "md5")


@gate("s1_spot_coverage", hard=False)
def _(t):
    return _bad(t["spots"].agg(F.avg((F.col("n_spots") >= 3).cast("double")).alias("s")).where("s < 0.5"), "s")


@gate("s5_matcher_decision")
def _(t):
    """The stated matcher decision against its recomputation. ``matcher_decision``: one row with stated, primary_k; ``matcher_compare``: k, base, challenger, b, c, p."""
    if "matcher_decision" not in t:
        return _bad(t["spots"].limit(0), F.lit("")) if "matcher_compare" not in t else _bad(t["matcher_compare"].limit(1), F.lit("no decision"))
    stated = t["matcher_decision"]
    out = _bad(stated.where("stated IS NULL OR stated NOT IN ('embedder', 'matcher')"), F.coalesce("stated", F.lit("no decision")))
    if "matcher_compare" not in t:
        return out
    joined = t["matcher_compare"].crossJoin(F.broadcast(stated.select("primary_k")))  # one row
    at = F.col("k") == F.col("primary_k")
    worse = F.bool_or(F.coalesce(F.col("challenger") < F.col("base"), F.lit(True)))
    won = F.max(F.when(at, F.coalesce((F.col("p") < ALPHA) & (F.col("c") > F.col("b")), F.lit(False))))
    decided = joined.agg(F.when(~worse & F.coalesce(won, F.lit(False)), "matcher").otherwise("embedder").alias("decision"))
    return out.union(_bad(stated.crossJoin(decided).where("stated <> decision"), F.concat(F.lit("recomputed "), F.col("decision"))))


@gate("s6_detect_variant")
def _(t):
    return _bad(t["spots"].where("detect_variant IS NULL OR detect_variant NOT IN ('belly_oriented', 'unroll_debend')"), "md5")


@gate("s7_sealed_spots")
def _(t):
    return _bad(t["spots"].join(_sealed(t), "md5", "left_semi"), "md5")


@gate("e1_embedding_audit")
def _(t):
    e = t["embeddings"]
    dim = e.agg(F.count_distinct(F.size("embedding")).alias("n")).where("n > 1")
    sealed = e.join(_sealed(t), "md5", "left_semi")
    twice = e.groupBy("md5", "variant").count().where("count > 1")
    return _bad(dim, F.lit("dimensions differ")).union(_bad(sealed, "md5")).union(_bad(twice, "md5"))


def violations(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """gate, hard, key of every violation of the named gates."""
    out = None
    for name in names:
        check, hard = GATES[name]
        rows = check(tables).select(F.lit(name).alias("gate"), F.lit(hard).alias("hard"), "key")
        out = rows if out is None else out.union(rows)
    return out


def gate_counts(tables: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """gate, hard and number of violations, 0 included."""
    spark = next(iter(tables.values())).sparkSession
    all_names = spark.createDataFrame([(n, GATES[n][1]) for n in names], "gate string, hard boolean")
    n = violations(tables, names).groupBy("gate").agg(F.count("*").alias("violations"))
    return all_names.join(n, "gate", "left").select("gate", "hard", F.coalesce("violations", F.lit(0)).alias("violations"))


def run_gates(tables: dict[str, DataFrame], names: list[str]) -> list[tuple[str, int]]:
    """Raises on violations of hard gates; returns warnings as gate and count."""
    held = {k: t.persist() for k, t in tables.items()}
    try:
        rows = gate_counts(held, names).where("violations > 0").collect()
    finally:
        for t in held.values():
            t.unpersist()
    hard = [f"{r['gate']}: {r['violations']}" for r in rows if r["hard"]]
    if hard:
        raise GateError("; ".join(sorted(hard)))
    return sorted((r["gate"], r["violations"]) for r in rows)
