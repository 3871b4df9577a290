"""Manifest and crop reports as aggregate DataFrames, and a Markdown renderer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _n(condition: Column, name: str) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False))).alias(name)


def cohort_counts(target: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Files, kept, individuals, gallery, probe, train, dev and test of each cohort; external rows have zeros."""
    kept = F.col("dup_keep")
    out = target.groupBy("cohort").agg(
        F.count("*").alias("files"), _n(kept, "kept"), F.count_distinct(F.when(kept, F.col("individual_id"))).alias("individuals"),
        *(_n(kept & (F.col("split_role") == r), r) for r in ("gallery", "probe")), *(_n(kept & (F.col("split_fold") == f), f) for f in ("train", "dev", "test")),
    )
    if external is None:
        return out
    zero = [F.lit(0).cast("long").alias(c) for c in ("gallery", "probe", "train", "dev", "test")]
    more = external.groupBy("cohort").agg(F.count("*").alias("files"), _n(kept, "kept"), F.count_distinct(F.when(kept, F.col("individual_id"))).alias("individuals")).select("cohort", "files", "kept", "individuals", *zero)
    return out.unionByName(more)


def photos_per_individual(target: DataFrame) -> DataFrame:
    per = target.where("dup_keep").groupBy("cohort", "individual_id").agg(F.count("*").alias("n"))
    return per.groupBy("cohort").agg(F.count("*").alias("individuals"), F.min("n").alias("least"), F.floor(F.median("n")).cast("long").alias("median"), F.max("n").alias("most"))


def date_coverage(target: DataFrame) -> DataFrame:
    return target.where("date IS NOT NULL").groupBy("cohort", "date").agg(F.count("*").alias("n"))


def date_pivot(target: DataFrame, cohort: str, dates: list[str]) -> DataFrame:
    """Individuals by date of one cohort, counts filled with 0; the dates are given, so no extra pass looks for them."""
    return target.where(F.col("cohort") == cohort).groupBy("individual_id").pivot("date", dates).count().na.fill(0)


def resolution_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cohort", "width", "height", "orientation").agg(F.count("*").alias("n"))


def split_summary(target: DataFrame) -> DataFrame:
    return target.groupBy("cohort", "split_scheme", "split_role").agg(F.count("*").alias("n"))


def anomaly_log(rows: DataFrame, key: str, first: int = 100) -> tuple[DataFrame, DataFrame]:
    """The first noted rows in order of key, and how many more there are."""
    noted = rows.where(~F.lower(F.trim(F.coalesce("notes", F.lit("")))).isin("", "nan", "none"))
    return noted.select(key, "notes").orderBy(key).limit(first), noted.agg(F.greatest(F.count("*") - first, F.lit(0)).alias("more"))


def crop_coverage(crops: DataFrame) -> DataFrame:
    """Rows and share of ok by variant and status."""
    return crops.groupBy("variant").agg(F.count("*").alias("n"), F.count_if(F.col("crop_status") == "ok").alias("ok"), F.round(F.avg((F.col("crop_status") == "ok").cast("double")), 4).alias("ok_share"))


def markdown(df: DataFrame, title: str, empty: str = "(no rows)") -> str:
    """A section with a table of all rows in order of their columns, for reports that people read.

    Rows come to the driver partition by partition; the text grows with them, so it is for aggregated tables.
    """
    found = df.orderBy(*df.columns).toLocalIterator()
    head = f"## {title}\n\n"
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    rows = ["| " + " | ".join(cell(v) for v in r) + " |" for r in found]
    if not rows:
        return head + empty + "\n"
    return head + "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *rows]) + "\n"
