"""Queries opN_<name>: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, chat, decontaminate, licences, line_templates, minmax_dedup, mixing, quality, secret_scan, warc

#: Score from which a document counts as good.
GOOD = 0.3
#: Conversation -7 of the chat query: control strings inside texts.
TRICKY = r"\### Assistant: </turn> ok"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    scored = quality.score(docs, model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("phrases", lambda p: p["start"])
    base = F.transform("phrases", lambda p: p["label"])
    more = F.transform("blocks", lambda b: b["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["share"])), F.lit(0.0)), F.when(F.size("phrases") > 0, 1.0).otherwise(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        score.alias("score"),
    )


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return minmax_dedup.near_duplicates(docs, shingle_words=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat.read_back(chat.format_events(chat.streamed(rows.unionByName(extra))))


def op5_spherical_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), path_col="source")
    return found.select("doc_id", "kind", "start", "end", "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def op7_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(warc.crawl_log(_read(spark, sf_dir, "pages").select("page_id", "url", "html")))
    pairs = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return found.withColumn("headers", F.array_join(pairs, ";"))


def op8_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_templates.drop_recurring(docs).select("__row.doc_id", "n_dropped", "text")


def op9_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    pairs = decontaminate.contaminated(docs, _read(spark, sf_dir, "benchmark")).where("consistent")
    return pairs.groupBy("doc_id", "item_id").agg(F.min("first").alias("first_word"), F.sum("windows").alias("windows"))


def op10_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {
    "op1_nbsvm_quality": op1_nbsvm_quality,
    "op2_licence_scan": op2_licence_scan,
    "op3_minmax_dedup": op3_minmax_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_spherical_caps": op5_spherical_caps,
    "op6_secret_scan": op6_secret_scan,
    "op7_revisit_resolution": op7_revisit_resolution,
    "op8_line_templates": op8_line_templates,
    "op9_template_decontamination": op9_template_decontamination,
    "op10_entropy_mixing": op10_entropy_mixing,
}

_REACH = """ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS n, id AS m FROM own UNION SELECT reach.n, ends.b FROM reach JOIN ends ON reach.m = ends.a),
root AS (SELECT n AS id, min(m) AS component_id FROM reach GROUP BY n)"""
#: Brute force: all pairs that share a shingle, or all pairs.
_NEAR = rf"""
WITH RECURSIVE w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
own AS (SELECT id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
e AS (SELECT id, len(g) AS k, unnest(g) AS t FROM own),
links AS (SELECT x.id AS a, y.id AS b FROM e x JOIN e y ON x.t = y.t AND x.id < y.id GROUP BY x.id, y.id, x.k, y.k HAVING 100 * count(*) >= 85 * (x.k + y.k - count(*))),
{_REACH}
SELECT own.id AS doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, own.id = component_id AS kept FROM own JOIN root ON own.id = root.id"""
_VECTORS = f"""
WITH RECURSIVE own AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
unit AS (SELECT id, v, sqrt(list_dot_product(v, v)) AS n FROM own WHERE sqrt(list_dot_product(v, v)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM unit x JOIN unit y ON x.id < y.id WHERE list_dot_product(x.v, y.v) / x.n / y.n >= 0.95),
{_REACH}, degree AS (SELECT a, count(*) AS k FROM ends GROUP BY a)
SELECT own.id AS vec_id, coalesce(k, 0) AS n_links, component_id, own.id = component_id AS kept FROM own JOIN root ON own.id = root.id LEFT JOIN degree ON own.id = degree.a"""
_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '#', '\#'), '<', '\<')"
ORACLES: dict[str, str] = {
    "op2_licence_scan": licences.sql(),
    "op3_minmax_dedup": _NEAR,
    "op5_spherical_caps": _VECTORS,
    "op4_chat_format": rf"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{TRICKY}'), (-7, 1, 'assistant', '{TRICKY}'))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(14 + length(replace({_ESCAPED.format('role')}, ':', '\:')) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
    "op7_revisit_resolution": warc.sql(),
    "op8_line_templates": line_templates.sql(),
}
