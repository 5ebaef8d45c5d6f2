"""Tables between the jobs of one operator, and connected components."""

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or the context's. Where neither is set, a new temporary one, if the master is local; elsewhere an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """df written to the shared folder and read again, and where. The table goes when the application ends, or before by `drop`."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    files, at = _place(spark, path)
    files.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def stash(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: its rows no longer depend on the executors that made them."""
    return written(df)[0]


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    files, at = _place(spark, path)
    files.delete(at, True)


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def connected(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node that it reaches) for all nodes of the edges (a, b).

    Alternates large and small stars: nodes hand their neighbours to the smallest one that they know, until each node knows only
    its root. Each round is two aggregates that combine before the exchange, and two joins whose large partitions Spark may split.
    """
    spark = edges.sparkSession
    edges, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # the greater neighbours go to the smallest
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m"))
        edges, now_at = written(small.where("a <> b").distinct())
        drop(spark, path)
        path = now_at
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
