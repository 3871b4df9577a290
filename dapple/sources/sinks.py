"""Sinks: manifests, labels, spots, metrics, audits, similarity caches and training packs."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dapple.functions.geometry import polygon_bbox, pose_line, seg_line
from dapple.functions.hashing import yolo_split
from dapple.operators.variants import usable_label


def write_manifest(df: DataFrame, path: str, keys: tuple[str, ...] = ("cohort", "individual_id", "rel_path"), fmt: str = "parquet") -> None:
    """Rows in order of the keys, range-partitioned; the same rows give the same files."""
    ordered = df.orderBy(*(F.col(k).asc_nulls_last() for k in keys))
    writer = ordered.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path))


def write_labels(labels: DataFrame, path: str) -> None:
    """JSON by md5, one folder each."""
    labels.write.mode("overwrite").partitionBy("md5").json(path)


def spots_json(spots: Column) -> Column:
    """Spots as a JSON list of lists: places to 2 digits, area to 1, score to 3."""
    return F.to_json(F.transform(spots, lambda s: F.array(F.round(s["x"], 2), F.round(s["y"], 2), F.round(s["area"], 1), F.round(s["score"], 3))))


def metrics_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_metrics(df: DataFrame, path: str) -> None:
    metrics_json(df).coalesce(1).write.mode("overwrite").text(path)


def write_with_provenance(df: DataFrame, path: str, provenance: dict) -> None:
    """A cached score set with what it was made from beside it."""
    df.write.mode("overwrite").parquet(path)
    text = json.dumps({k: str(v) for k, v in sorted(provenance.items())})
    df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.provenance")


def read_provenance(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}.provenance").first()["value"])


def yolo_lines(labels: DataFrame, val_frac: float = 0.2, seed: int = 42, mode: str = "sql") -> DataFrame:
    """md5, fold and the segmentation and pose lines of usable labels; folds go by individual."""
    box = polygon_bbox(F.col("belly_polygon"), 0.05)
    return labels.where(usable_label()).select("md5", yolo_split(F.col("individual_id"), val_frac, seed, mode).alias("fold"), seg_line(F.col("belly_polygon")).alias("seg"), pose_line(box, [F.col("head_xy"), F.col("cloaca_xy")]).alias("pose"))


def pack_manifest(spark, folder: str) -> DataFrame:
    """path, length and sha256 of the files of a training pack."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def file_sha256(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()
