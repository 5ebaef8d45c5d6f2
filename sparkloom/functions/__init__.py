"""Column expressions shared by operators and queries."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(value: Column, default: str) -> Column:
    """`value`, or `default` where it is null or the empty string (an empty setting counts as unset)."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def as_json(*columns: str) -> Column:
    """The named columns as one compact JSON object, keys in the given order."""
    return F.to_json(F.struct(*columns))
