"""Resolution of derived variants: inner and prioritised joins, upsert, parity, one row a variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assert_unique(crops: DataFrame, variant: str) -> DataFrame:
    """The variant's crops, md5 unique; more than one row of an md5 raises when read."""
    own = crops.where(F.col("variant") == variant)
    seen = F.count("*").over(Window.partitionBy("md5"))
    return own.withColumn("_seen", seen).where(F.assert_true(F.col("_seen") == 1, F.lit(f"md5 is not unique in variant {variant}")).isNull()).drop("_seen")


def select_crops(rows: DataFrame, crops: DataFrame, variant: str) -> DataFrame:
    """Rows that have the variant, with the crop's columns and those of the row that the crop lacks."""
    own = assert_unique(crops, variant)
    extra = [c for c in rows.columns if c != "md5" and c not in crops.columns]
    return own.join(rows.select("md5", *extra), "md5")


def select_with_fallback(rows: DataFrame, crops: DataFrame, variant: str, fallback: str) -> DataFrame:
    """One row for each of ``rows``: the variant's crop, else the fallback's, else md5 with null variant_used."""
    wanted = crops.where(F.col("variant").isin(variant, fallback))
    w = Window.partitionBy("md5").orderBy((F.col("variant") != variant).cast("int"), "crop_path")
    best = wanted.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    joined = rows.select("md5").join(best, "md5", "left")
    return joined.withColumn("variant_used", F.col("variant"))


def build_records(rows: DataFrame, crops: DataFrame, variant: str, fallback: str) -> DataFrame:
    joined = select_with_fallback(rows, crops, variant, fallback).where("variant_used IS NOT NULL")
    return joined.join(rows.select("md5", "individual_id", "cohort", "split_role"), "md5").select("md5", "individual_id", "cohort", "split_role", "crop_path", "variant_used")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("md5", "variant")) -> DataFrame:
    """Union in which new rows replace old ones of the same keys."""
    both = old.withColumn("_src", F.lit(1)).unionByName(new.withColumn("_src", F.lit(0)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in (*keys, "_src")]
    w = Window.partitionBy(*keys).orderBy("_src", *rest)
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_src")


def parity(a: DataFrame, b: DataFrame, key: str = "md5") -> DataFrame:
    """How many keys are in a only, in b only, in both."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, key, "full")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both")
    )


def variant_rows(results: DataFrame, pipeline_version: str, canon_size: int) -> DataFrame:
    """One base row and one row for each straightened variant, keyed by md5 and variant.

    ``results``: md5, variant, crop_status, crop_path, seg_conf, unroll_variants (map of
    method to path), unroll_status (map).
    """
    base = results.select("md5", "variant", "crop_status", "crop_path", "seg_conf", F.lit(None).cast("string").alias("unroll_method"))
    more = results.select("md5", F.explode(F.map_entries("unroll_variants")).alias("e"), "unroll_status", "seg_conf")
    more = more.select("md5", F.concat(F.lit("unroll_"), F.col("e.key")).alias("variant"), F.coalesce(F.col("unroll_status")[F.col("e.key")], F.lit("ok")).alias("crop_status"), F.col("e.value").alias("crop_path"), "seg_conf", F.col("e.key").alias("unroll_method"))
    return base.unionByName(more).withColumn("canon_size", F.lit(canon_size)).withColumn("mirrored", F.lit(False)).withColumn("pipeline_version", F.lit(pipeline_version))


def oof_records(gallery: DataFrame, probes: DataFrame, crops: DataFrame, variants: list[str], folds: DataFrame) -> DataFrame:
    """Both roles with a path for each variant, session (md5 if none) and the individual's fold; rows lacking a variant are left out."""
    rows = gallery.withColumn("role", F.lit("gallery")).unionByName(probes.withColumn("role", F.lit("probe")), allowMissingColumns=True)
    out = rows.select("md5", "individual_id", "cohort", "role", F.coalesce(F.col("session"), F.col("md5")).alias("session"))
    for v in variants:
        out = out.join(crops.where(F.col("variant") == v).select("md5", F.col("crop_path").alias(f"path_{v}")), "md5", "left")
    return out.na.drop(subset=[f"path_{v}" for v in variants]).join(folds, "individual_id")


def reuse_labels(pool: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pool's rows with a usable manual label, and those still to be made."""
    done = labels.where("source = 'manual'").select("md5").distinct()
    return pool.join(done, "md5", "left_semi"), pool.join(done, "md5", "left_anti")


def usable_label() -> Column:
    geometry = F.col("belly_polygon").isNotNull() & (F.size("belly_polygon") >= 3) & F.col("head_xy").isNotNull() & F.col("cloaca_xy").isNotNull()
    return F.coalesce((F.col("status") == "corrected") | (F.col("source") == "manual"), F.lit(False)) & ~F.coalesce(F.col("status").isin("skip", "redraw"), F.lit(False)) & geometry


def derive_flags() -> Column:
    return F.array_compact(F.array(F.when(F.col("head_conf") < 0.2, "low_head_conf"), F.when(F.contains(F.coalesce("notes", F.lit("")), F.lit("band_suspect")), "band_suspect")))


def edit_label(labels: DataFrame, **changes: Column) -> DataFrame:
    """Any change makes a label manual; flags are merged in order without repeats."""
    flags = changes.pop("flags", None)
    out = labels.withColumns({k: F.coalesce(v, F.col(k)) for k, v in changes.items()} | {"source": F.lit("manual")})
    return out if flags is None else out.withColumn("flags", F.array_distinct(F.concat(F.coalesce("flags", F.array().cast("array<string>")), flags)))


def flip_label(labels: DataFrame) -> DataFrame:
    """Head and cloaca change places."""
    return labels.withColumns({"head_xy": F.col("cloaca_xy"), "cloaca_xy": F.col("head_xy"), "source": F.lit("manual")})
