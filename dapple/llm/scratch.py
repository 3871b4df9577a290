"""Written tables in the cluster's shared folder, session settings and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dapple.session import ship

#: Rows and bytes of an Arrow batch at most (a batch holds one row at least); texts can be long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: A key with this share of all rows is hot: there are at most as many hot keys as the inverse.
HOT = 1 / 1000


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a temporary folder of this machine if the session is local (tests), else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="dapple-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Settings that every operator with Python workers needs.

    They stay on the session: the plans returned are run after this call, and read them then.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], total: int, how: str = "left", fits: Column | None = None) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row a key and how many rows of ``left`` hold it as ``rows_of_key``.

    Rows of hot keys never move: of ``total`` rows at most ``1 / HOT`` keys can be hot, so these rows of ``right`` are
    broadcast, and only the rest is shuffled.  ``fits`` bounds what a broadcast row may hold.
    """
    is_hot = F.col("rows_of_key") >= F.lit(max(2.0, total * HOT))
    if fits is not None:
        is_hot = is_hot & fits
    hot, rest = right.where(is_hot).drop("rows_of_key"), right.where(~is_hot).drop("rows_of_key")
    # the broadcast side has at most 1 / HOT rows
    return left.join(F.broadcast(hot), on).unionByName(left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how))


class Scratch:
    """Tables of one operator run. A saved table cuts the lineage and survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/dapple/{name}-{uuid.uuid4().hex}"
        self.count = 0
        small_batches(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete saved tables that no later step reads."""
        jvm = self.spark._jvm
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Star forest of an undirected graph: columns ``a`` (node) and ``b`` (smallest node it reaches), a > b.

    Alternates large-star and small-star steps, each a partial minimum and a
    join, until the edge set no longer changes.  Nodes without edges, and roots,
    have no row.
    """

    def pull(directed: DataFrame, least: DataFrame) -> DataFrame:
        return directed.join(least, "u")

    stars = scratch.save(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    mark = _mark(stars)
    while mark[0]:
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).union(stars.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = pull(both.where("v > u"), least).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = pull(down, least).select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = scratch.save(small.where("a <> b").distinct(), "stars")
        scratch.drop(stars)
        stars, old = new, mark
        mark = _mark(stars)
        if mark == old:
            break
    return stars
