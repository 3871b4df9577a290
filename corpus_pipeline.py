"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dapple.llm import decontaminate, line_templates, minmax_dedup, mixing, quality
from dapple.llm.scratch import Scratch

#: Documents that score less are rejected.
GOOD = 0.3
#: Of a document cut to less than this share of its characters and to fewer words than this nothing of worth is left.
SCRAP, SCRAP_WORDS = 0.05, 20
#: Cut documents up to which their ids and two words each are broadcast; characters of such a word.
FEW, WORD_START = 200_000, 20


def _rows(docs: DataFrame) -> DataFrame:
    """The rows as one column, so that their own columns clash with nothing: r, i (id), t (text), k (hash of the text)."""
    return docs.select(F.struct("*").alias("r"), F.col("doc_id").cast("long").alias("i"), F.col("text").alias("t"), F.xxhash64("text").alias("k"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier takes for good. The labels come with the corpus, not with ``docs``.

    Null and empty texts get the score of the model's bias; repeated rows score
    alike; columns of any name pass unchanged; an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.where(~quality.held_out(F.col("doc_id"))))
    return quality.score(docs.select(F.struct("*").alias("r")), model, keep=("r",), row_col="r").where(F.col("score") >= GOOD).select("r.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts recurring lines, and recurring sentences inside lines; n_chars follows the text.

    A document of which the cut leaves less than ``SCRAP`` of its characters and
    fewer than ``SCRAP_WORDS`` words goes: the rest of it stands elsewhere.
    Null and empty texts stay as they are, columns of any name pass unchanged
    but for n_chars, an empty table stays empty.
    """
    cut = line_templates.drop_recurring(docs, inline=True)
    words = F.regexp_count("text", F.lit(mixing.WORD))
    scrap = (F.length("text") < SCRAP * F.length("__row.text")) & (words < SCRAP_WORDS)
    cut = cut.where((F.col("n_dropped") == 0) | ~((F.trim("text") == "") | scrap))
    changed = F.col("n_dropped") > 0
    new = {"text": F.col("text"), "n_chars": F.when(changed, F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("__row")["n_chars"]) if "n_chars" in docs.columns else None}
    return cut.select(*(new[c].alias(c) if c in new else F.col("__row")[c].alias(c) for c in docs.columns))


def whole_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and whole text in the corpus of the documents that an earlier stage has cut.

    A corpus text is a document's whole text if it is longer and holds the first
    and last word of what is left.  Ids and those words, not texts, tell which
    documents are cut; up to ``FEW`` of them are broadcast.
    """
    corpus = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = [F.regexp_extract("text", rf"\S{{1,{WORD_START}}}", 0), F.regexp_extract(F.right("text", F.lit(4 * WORD_START)), rf"(\S{{1,{WORD_START}}})\s*$", 1)]
    now = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), F.array(*marks).alias("marks"), F.length("text").alias("left"))
    same = corpus.select("doc_id", F.xxhash64("text").alias("k"))
    changed = Scratch(spark, "changed").save(now.join(same, ["doc_id", "k"], "left_anti").select("doc_id", "marks", "left").distinct(), "changed")
    few = changed.count() <= FEW
    # at most FEW rows of two short words
    found = corpus.join(F.broadcast(changed) if few else changed, "doc_id").where((F.length("text") > F.col("left")) & F.forall("marks", lambda m: F.contains(F.col("text"), m)))
    found = found.select("doc_id", "text")
    return found if few else Scratch(spark, "whole").save(found, "whole")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id.

    Documents that the line stage has cut are compared by what is left of them
    and by their whole texts in the corpus, so what is left of a copy goes as the
    copy would.  Of rows that repeat an id and text the least by its other
    columns stays.  Rows without id, and null and empty texts, stay.  Columns of
    any name pass unchanged; an empty table stays empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = minmax_dedup.near_duplicates(own.unionByName(whole_texts(spark, docs, sf_dir)))
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("own")).distinct()
    rows = _rows(docs).join(kept, F.col("i") == F.col("own"), "left_semi")
    others = [F.col("r")[c].alias(f"c{n}") for n, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    first = F.row_number().over(Window.partitionBy("i", "k").orderBy(F.to_json(F.struct(F.lit(0).alias("c"), *others))))
    rows = rows.withColumn("first", first).where("first = 1")
    return rows.select("r.*").unionByName(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or part of one with consistent values, go.

    Rows without id, and null and empty texts, stay; of repeated rows all go or
    stay; columns of any name pass unchanged; an empty table stays empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = decontaminate.contaminated(own, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("consistent")
    bad = Scratch(spark, "leaks").save(pairs.select(F.col("doc_id").alias("own")).distinct(), "leaks")
    return _rows(docs).join(bad, F.col("i") == F.col("own"), "left_anti").select("r.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies.

    Texts without words have size 0 and their source's rate; equal rows are
    taken alike; columns of any name pass unchanged, but a column ``copies`` is
    replaced; an empty table stays empty.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")
    picks = mixing.mix(own).where("copies > 0").select(F.col("doc_id").alias("d"), F.col("text_key").alias("x"), F.col("source").alias("s"), F.col("copies").alias("n")).distinct()
    same = F.col("i").eqNullSafe(F.col("d")) & F.col("r")["source"].cast("string").eqNullSafe(F.col("s")) & (F.col("k") == F.col("x"))
    names = [c for c in docs.columns if c.lower() != "copies"]  # a column of that name would be the mix of an earlier run
    return _rows(docs).join(picks, same).select(*(F.col("r")[c].alias(c) for c in names), F.col("n").alias("copies"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("source mixing", mixed),
]

#: The classifier's fit and the mix's iterations have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
