"""Typed inputs for the engine's queries, derived from the synthetic star schema; each has the same text in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.functions.parse import namespaced_id
from dapple.plans.pipelines import Sides


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cohort_of(n: Column) -> Column:
    return F.when(n % 3 == 0, "PW").when(n % 3 == 1, "TK").otherwise("LAB")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    label, vec = F.col("label"), F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        vec.alias("id"), F.md5(vec.cast("string")).alias("md5"), label, cohort_of(label).alias("cohort"), namespaced_id(cohort_of(label), label).alias("identity"),
        F.when(vec % 5 == 0, "probe").otherwise("gallery").alias("role"), (vec % 4).alias("session"), "embedding",
    )


PHOTOS = """photos AS (SELECT vec_id AS id, md5(CAST(vec_id AS VARCHAR)) AS md5, label, CASE label % 3 WHEN 0 THEN 'PW' WHEN 1 THEN 'TK' ELSE 'LAB' END AS cohort,
  (CASE label % 3 WHEN 0 THEN 'PW' WHEN 1 THEN 'TK' ELSE 'LAB' END) || '-' || printf('%03d', label) AS identity,
  CASE WHEN vec_id % 5 = 0 THEN 'probe' ELSE 'gallery' END AS role, vec_id % 4 AS session, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"""


def sides(spark: SparkSession, sf_dir: str, dims: tuple[int, int] | None = None, where: str = "true", gallery_where: str = "true") -> Sides:
    rows = photos(spark, sf_dir)
    if dims:
        rows = rows.withColumn("embedding", F.slice("embedding", dims[0], dims[1]))
    return Sides(rows.where(f"role = 'gallery' AND {gallery_where}"), rows.where(f"role = 'probe' AND {where}"))


def sims_sql(vector: str = "e", where: str = "true", gallery_where: str = "true", name: str = "sims") -> str:
    """pid, pind, cohort, session, gid, gind, gsession, sim of probes and gallery rows."""
    cut = {"e": "{0}.e", "es": "{0}.e[1:32]", "ms": "{0}.e[33:64]"}[vector]
    return f"""{name} AS (SELECT p.id AS pid, p.identity AS pind, p.cohort, p.session, p.label, g.id AS gid, g.identity AS gind, g.session AS gsession,
  round(list_dot_product({cut.format('p')}, {cut.format('g')}), 9) AS sim
  FROM (SELECT * FROM photos WHERE role = 'probe' AND {where}) p CROSS JOIN (SELECT * FROM photos WHERE role = 'gallery' AND {gallery_where}) g)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    cohort = cohort_of(user)
    return table(spark, sf_dir, "events").select(
        event.alias("event_id"), F.md5(event.cast("string")).alias("md5"), cohort.alias("cohort"), F.lit("target").alias("role"), F.lit(True).alias("dup_keep"), user.alias("local_id"),
        namespaced_id(cohort, user).alias("individual_id"), F.concat_ws("/", user.cast("string"), "event_type", F.concat(event.cast("string"), F.lit(".JPG"))).alias("rel_path"),
        F.when(user % 3 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("date"), F.col("event_type").alias("session"), "value",
        F.when(event % 50 == 0, F.lit(3000)).otherwise(F.when(user % 3 == 2, 3000).otherwise(3024)).alias("width"), F.when(user % 3 == 2, 4000).otherwise(4032).alias("height"),
    )


SHOTS = """shots AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS md5, c AS cohort, 'target' AS role, true AS dup_keep, user_id AS local_id, c || '-' || printf('%03d', user_id) AS individual_id,
  CAST(user_id AS VARCHAR) || '/' || event_type || '/' || CAST(event_id AS VARCHAR) || '.JPG' AS rel_path, CASE WHEN user_id % 3 <> 0 THEN strftime(ts, '%Y-%m-%d') END AS date, event_type AS session, value,
  CASE WHEN event_id % 50 = 0 THEN 3000 WHEN user_id % 3 = 2 THEN 3000 ELSE 3024 END AS width, CASE WHEN user_id % 3 = 2 THEN 4000 ELSE 4032 END AS height
  FROM (SELECT *, CASE user_id % 3 WHEN 0 THEN 'PW' WHEN 1 THEN 'TK' ELSE 'LAB' END AS c FROM events))"""

COIN = "CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT) / 4503599627370496.0"

#: assign_splits over the table shots: split.
SPLITS = f"""people AS (SELECT individual_id, cohort, count(DISTINCT date) AS n_dates, min(date) AS first_date, count(*) AS n_photos FROM shots GROUP BY ALL),
opened AS (SELECT individual_id FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY md5('42-open:' || individual_id), individual_id) AS rn, count(*) OVER (PARTITION BY cohort) AS n
  FROM people WHERE n_dates < 2) WHERE rn <= ceil(CAST(0.15 AS DOUBLE) * n)),
chance AS (SELECT s.* FROM shots s JOIN people p USING (individual_id) WHERE p.n_dates < 2 AND p.n_photos >= 2),
least AS (SELECT individual_id, session FROM (SELECT individual_id, session, row_number() OVER (PARTITION BY individual_id ORDER BY count(*), session) AS rn, count(*) OVER (PARTITION BY individual_id) AS n
  FROM chance GROUP BY individual_id, session) WHERE rn = 1 AND n >= 2),
pool AS (SELECT c.*, row_number() OVER (PARTITION BY c.individual_id ORDER BY rel_path, md5) AS rn, count(*) OVER (PARTITION BY c.individual_id) AS n
  FROM chance c LEFT JOIN least l USING (individual_id) WHERE l.session IS NULL OR l.session = c.session),
picked AS (SELECT individual_id, rel_path AS probe_path FROM pool WHERE rn = floor({COIN.format("'42-probe:' || individual_id")} * n) + 1),
placed AS (SELECT s.*, p.n_dates, p.first_date, p.n_photos, s.individual_id IN (SELECT individual_id FROM opened) AS is_new_open, k.probe_path,
  CASE s.cohort WHEN 'LAB' THEN 'temporal_aux' ELSE 'kpi_core' END AS kpi_scope FROM shots s JOIN people p USING (individual_id) LEFT JOIN picked k USING (individual_id)),
schemed AS (SELECT *, CASE WHEN is_new_open THEN 'open_new' WHEN n_dates >= 2 THEN 'temporal' WHEN n_photos >= 2 THEN 'random' ELSE 'gallery_only' END AS split_scheme FROM placed),
roled AS (SELECT *, CASE WHEN split_scheme = 'open_new' OR (split_scheme = 'temporal' AND date > first_date) OR (split_scheme = 'random' AND rel_path = probe_path) THEN 'probe' ELSE 'gallery' END AS split_role FROM schemed),
split AS (SELECT *, CASE WHEN split_role = 'gallery' THEN 'train' WHEN {COIN.format("'42-fold:' || rel_path")} < 0.5 THEN 'test' ELSE 'dev' END AS split_fold FROM roled)"""


def docs_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("md5"), F.col("lang").alias("cohort"), "source", "n_chars", F.lit("").alias("notes"))


DOCS = "docs AS (SELECT doc_id, md5(text) AS md5, lang AS cohort, source, n_chars FROM documents)"


def ab_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("cohort"), F.col("l_discount").alias("seg_conf"), (F.col("l_quantity") > 25).alias("base_hit"), (F.col("l_extendedprice") > 35000).alias("var_hit"))


AB = "ab AS (SELECT l_returnflag AS cohort, l_discount AS seg_conf, l_quantity > 25 AS base_hit, l_extendedprice > 35000 AS var_hit FROM lineitem)"


def crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of the photos: belly_oriented of most, unroll_ribbon of seven in ten."""
    p = photos(spark, sf_dir)
    kinds = F.array(F.when(F.col("id") % 23 != 0, "belly_oriented"), F.when(F.col("id") % 10 < 7, "unroll_ribbon"))
    rows = p.select("id", "md5", "cohort", F.explode(F.array_compact(kinds)).alias("variant"))
    return rows.select(
        "md5", "variant", F.concat("variant", F.lit("/"), "md5", F.lit(".png")).alias("crop_path"), F.when(F.col("id") % 13 == 0, "low_pose_conf").otherwise("ok").alias("crop_status"), F.lit(384).alias("canon_size"),
        (F.col("id") % 97 == 0).alias("mirrored"), F.when(F.col("id") % 101 == 0, "v0").otherwise("v1").alias("pipeline_version"), (F.col("id") % 10).cast("double").alias("head_y"), F.lit(5.0).alias("cloaca_y"),
        ((F.col("id") % 20) / F.lit(20.0)).alias("seg_conf"), "id",
    )


CROPS = """crops AS (SELECT md5, variant, variant || '/' || md5 || '.png' AS crop_path, CASE WHEN id % 13 = 0 THEN 'low_pose_conf' ELSE 'ok' END AS crop_status, 384 AS canon_size, id % 97 = 0 AS mirrored,
  CASE WHEN id % 101 = 0 THEN 'v0' ELSE 'v1' END AS pipeline_version, CAST(id % 10 AS DOUBLE) AS head_y, 5.0 AS cloaca_y, (id % 20) / 20.0 AS seg_conf, id
  FROM (SELECT id, md5, 'belly_oriented' AS variant FROM photos WHERE id % 23 <> 0 UNION ALL SELECT id, md5, 'unroll_ribbon' FROM photos WHERE id % 10 < 7))"""


def points(embedding: Column, first: int, n: int) -> Column:
    """``n`` points from consecutive components, from 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(F.element_at(embedding, 2 * k + first).cast("double").alias("x"), F.element_at(embedding, 2 * k + first + 1).cast("double").alias("y")))


def points_sql(column: str, first: int, n: int) -> str:
    return f"list_transform(range(0, {n}), lambda k: {{'x': {column}[2 * k + {first}], 'y': {column}[2 * k + {first} + 1]}})"
