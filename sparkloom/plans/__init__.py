"""The registered queries of the engine proper, with their SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import as_json, or_default
from sparkloom.sources import health

DEFAULT_ADDRESS = "127.0.0.1:8080"


def health_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health record."""
    return health(spark)


def health_json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The health record as the JSON text that a client of the service reads."""
    return health(spark).select(as_json("status").alias("body"))


def listen_address_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listen address for each kind of setting: unset, empty and given."""
    given = spark.createDataFrame([(0, None), (1, ""), (2, "0.0.0.0:9000")], "case_id int, setting string")
    return given.select("case_id", or_default(F.col("setting"), DEFAULT_ADDRESS).alias("address"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "health": health_query,
    "health_json": health_json_query,
    "listen_address": listen_address_query,
}

ORACLE_SQL: dict[str, str] = {
    "health": "SELECT 'ok' AS status",
    "health_json": """SELECT '{"status":"ok"}' AS body""",
    "listen_address": f"""
        SELECT case_id, coalesce(nullif(setting, ''), '{DEFAULT_ADDRESS}') AS address
        FROM (VALUES (0::INTEGER, NULL::VARCHAR), (1, ''), (2, '0.0.0.0:9000')) AS t(case_id, setting)""",
}
