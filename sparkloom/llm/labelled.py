"""Bounded samples of labelled texts, which the classifiers are trained on.

A sample takes the rows of the lowest hashes. How many rows each level of the hash has is counted first, so that only rows of the
levels needed are ranked: no task gets all rows of a group, nor a sample's worth of rows from every other task. What comes to the driver is bounded
in rows and in bytes, also where ids repeat: a text that doesn't fit into what is left of the bytes is passed over.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled rows that a classifier is trained on at most: those of the smallest hash of their id.
MAX_ROWS = 6000
#: Bytes of their texts at most.
MAX_BYTES = 64 << 20


def level(order: Column) -> Column:
    """The level of a 64-bit hash. Levels rise with the hash, and each is wider than the one before by 2^(1/16)."""
    return F.floor(16 * F.log2(order / F.lit(2.0**64) + F.lit(0.5 + 2.0**-52))).cast("int")


def lowest(rows: DataFrame, k: int, group: str) -> DataFrame:
    """Of each value of `group`, the rows with the k lowest `order`, and the rank of each. There are few groups."""
    counts = rows.groupBy(group, level(F.col("order")).alias("level")).count()
    before = F.sum("count").over(Window.partitionBy(group).orderBy("level")) - F.col("count")
    bounds = counts.withColumn("before", before).where(F.col("before") < k).groupBy(group).agg(F.max("level").alias("bound"))
    near = rows.join(F.broadcast(bounds), group).where(level(F.col("order")) <= F.col("bound")).drop("bound")  # a row for each group
    return near.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("order", "doc_id"))).where(F.col("rank") <= k)


def fitting(sizes: list[int], most: int) -> list[bool]:
    """Which of the sizes, one after the other, fit into what is left of `most`."""
    out = []
    for n in sizes:
        out.append(n <= most)
        most -= n * out[-1]
    return out


def sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> tuple[list[str], list[int]]:
    """Texts and labels of at most max_rows labelled documents with at most max_bytes of text, in the order of a hash of the id.

    docs: doc_id, text. labels: doc_id and `label`, 0 or 1; rows with a null are left out. Only max_rows ids go to the
    executors, and only their texts come to the driver, once their sizes are known. Rows that are alike count once.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).select(F.col("doc_id"), F.col(label).cast("int").alias("y"), F.xxhash64("doc_id").alias("order"))
    total, bound = 0, None
    for row in sorted(usable.groupBy(level(F.col("order")).alias("level")).count().collect()):  # some hundred levels at most
        if total < max_rows:
            total, bound = total + row["count"], row["level"]
    chosen = usable.where(level(F.col("order")) <= F.lit(bound)).distinct().orderBy("order", "doc_id", "y").limit(max_rows)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")).join(F.broadcast(chosen), "doc_id")
    keys = ["order", "y", "tie"]
    sizes = found.groupBy(keys).agg(F.first(F.octet_length("text")).alias("bytes")).orderBy(keys).limit(max_rows).collect()
    fit = fitting([r["bytes"] for r in sizes], max_bytes)
    taken = docs.sparkSession.createDataFrame([tuple(r)[:3] for r, fits in zip(sizes, fit, strict=True) if fits], "order bigint, y int, tie bigint")
    texts = found.join(F.broadcast(taken), keys, "left_semi").groupBy(keys).agg(F.first("text").alias("text")).collect()
    texts = sorted(map(tuple, texts))
    return [t for *_, t in texts], [y for _, y, *_ in texts]
