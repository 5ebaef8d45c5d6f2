"""Relations that queries start from."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEALTHY = "ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of a data directory, read through Spark's reader so any Spark file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def health(spark: SparkSession) -> DataFrame:
    """The constant health relation: one row, `status string not null`. Reads no table and checks no dependency."""
    return spark.range(1).select(F.lit(HEALTHY).alias("status"))
