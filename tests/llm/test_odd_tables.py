"""Every stage and operator over odd tables: nulls in any column, empty tables, repeated rows, very long texts, and columns that are called like the operators' own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe, decontaminate, ngram_join, queries, substring_dedup

SF = "/root/testdata/sf0.001"
NAMES = ["block", "bucket", "n_words", "n_removed", "score", "row", "text_key", "begin", "ids", "node", "a.b", "odd name", "`tick`", "chunk", "y", "order", "tie", "text_", "bits", "keys"]


def odd(spark):
    """A few documents, some with nulls in every column, repeated rows, and one long text, with many more columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    none = docs.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    long = docs.limit(1).withColumn("text", F.expr("repeat(concat('word ', string(doc_id), ' and more, '), 60000)"))
    rows = docs.union(docs.limit(3)).union(none).union(none).union(docs.limit(2).withColumn("text", F.lit(""))).union(docs.limit(2).withColumn("doc_id", F.lit(None).cast("bigint"))).union(long)
    return rows.select("*", *(F.when(F.col("doc_id") % 2 == 0, F.lit(k)).alias(c) for k, c in enumerate(NAMES)))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, name, stage):
    docs = odd(spark)
    out = stage(spark, docs, SF)
    if name == "tokens":
        assert out.count() == docs.count()
        assert stage(spark, docs.limit(0), SF).collect() == []
        return
    assert out.columns == docs.columns
    found = out.collect()
    assert 0 < len(found) <= docs.count()
    for r in found:  # the other columns are as they were
        assert [r[4 + 1 + k] for k in range(len(NAMES))] == [k if r["doc_id"] is not None and r["doc_id"] % 2 == 0 else None for k in range(len(NAMES))]
    empty = stage(spark, docs.limit(0), SF)
    assert empty.columns == docs.columns and empty.collect() == []


def test_operators(spark):
    docs = odd(spark)
    n = docs.count()
    assert substring_dedup.dedup(docs).count() == n
    assert ngram_join.components(docs).count() == n
    assert bpe.encode(docs, *queries_tokens()).count() == n
    assert decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet").withColumn("a.b", F.lit(1))).columns == ["doc_id", "item_id", "coverage", "n_tiles"]


def queries_tokens():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_over_empty_and_odd_tables(spark, tmp_path, name):
    for kind, docs in (("empty", odd(spark).limit(0)), ("odd", odd(spark))):
        at = f"{tmp_path}/{kind}"
        docs.write.parquet(f"{at}/documents.parquet")
        for t in ("labels", "benchmark", "pages", "conversations"):
            table = spark.read.parquet(f"{SF}/{t}.parquet")
            none = table.limit(1).select(*(F.lit(None).cast(k).alias(c) for c, k in table.dtypes))
            rows = table.limit(0) if kind == "empty" else table.union(table.limit(4)).union(none)
            rows.withColumns({"a.b": F.lit(1), "score": F.lit("s"), "role_": F.lit(None).cast("int")}).write.parquet(f"{at}/{t}.parquet")
        found = queries.QUERIES[name](spark, at).collect()
        if kind == "odd" and name not in ("op3_decontaminate", "op4_chat", "op8_url_filter"):
            assert len(found) == docs.count()
        if kind == "empty":
            assert len(found) == (1 if name == "op4_chat" else 0)
