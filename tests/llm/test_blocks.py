"""Blocks and buckets: many of each, rows in changing order, and several executors that fetch over the network."""

import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import blocks, ngram_join, substring_dedup
from test_text_operators import ODD, brute_components, brute_substrings, corpus, docs

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture
def many_blocks(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 1500)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 4000)


@pytest.mark.parametrize("rows,window", [(corpus(), 35), (corpus(2), 7), (ODD * 3, 3)])
def test_substring_dedup_over_many_blocks(spark, many_blocks, rows, window):
    df = docs(spark, rows).repartition(5)  # an exchange in the input
    assert blocks.counts(df)[0] > 10
    assert sorted(map(tuple, substring_dedup.digests(df, window).collect()), key=repr) == brute_substrings(rows, window)


def test_ngram_join_over_many_blocks(spark, many_blocks):
    rows = corpus(7, 90) + [(1000 + i if i is not None else None, t) for i, t in ODD]
    assert sorted(map(tuple, ngram_join.components(docs(spark, rows).repartition(5)).collect()), key=repr) == brute_components(rows)


@pytest.mark.parametrize("rows,window", [(corpus(), 35), (corpus(2), 7), ([(k, " ".join(f"w{j}" for j in range(50))) for k in range(60)], 9)])
def test_many_slices_of_blocks(spark, many_blocks, monkeypatch, rows, window):
    monkeypatch.setattr(blocks, "SLICE", 3)  # several levels
    assert sorted(map(tuple, substring_dedup.digests(docs(spark, rows), window).collect()), key=repr) == brute_substrings(rows, window)


def test_ngram_join_over_many_slices(spark, many_blocks, monkeypatch):
    monkeypatch.setattr(blocks, "SLICE", 5)
    rows = corpus(9, 60)
    assert sorted(map(tuple, ngram_join.components(docs(spark, rows)).collect()), key=repr) == brute_components(rows)


def test_equal_rows_part(spark, many_blocks):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.range(400).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    dealt, block = blocks.deal(df, blocks.counts(df)[0])
    assert dealt.groupBy(block).count().agg(F.max("count")).first()[0] < 40
    assert {tuple(r)[:3] for r in substring_dedup.digests(df).collect()} == {(7, 60, 60)}


def test_a_block_is_the_same_in_any_order():
    table = pa.table({"doc_id": range(60), "text": pa.array([t for _, t in corpus(3, 58)] + [None, ""])})
    rng, seals = np.random.default_rng(1), set()
    for _ in range(5):
        own = substring_dedup.Block(blocks.in_order(table.take(pa.array(rng.permutation(60)))).column("text"))
        seals.add(own.seal())
    assert len(seals) == 1
    other = substring_dedup.Block(blocks.in_order(table.slice(1)).column("text"))
    assert other.seal() not in seals


@pytest.mark.parametrize("n_buckets", [1, 3, 1000, 1 << 31])
def test_bucket_slices_cover_all_keys(n_buckets):
    keys = np.sort(np.random.default_rng(2).integers(0, 2**64, 500, np.uint64))
    found = list(blocks.bucket_slices(keys, n_buckets))
    assert [k for _, s in found for k in keys[s].tolist()] == keys.tolist()
    assert all((int(k) >> 32) * n_buckets >> 32 == b for b, s in found for k in keys[s].tolist())
    assert len({b for b, _ in found}) == len(found) <= len(keys)
    assert list(blocks.bucket_slices(keys[:0], n_buckets)) == []


CLUSTER = """
import sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[3,1,1024]").config("spark.shuffle.readHostLocalDisk", "false")
    .config("spark.reducer.maxSizeInFlight", "64k").config("spark.sql.shuffle.partitions", "6").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", sys.argv[1] + "/shared").config("spark.sql.warehouse.dir", sys.argv[1] + "/warehouse").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
from sparkloom.llm import blocks, substring_dedup
blocks.BLOCK_BYTES = 100_000
df = spark.read.parquet(sys.argv[1] + "/documents")
for k in range(3):
    substring_dedup.digests(df).coalesce(1).write.parquet(f"{sys.argv[1]}/out{k}")
"""


def test_substring_dedup_on_several_executors(spark, tmp_path):
    start = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    start.repartition(16).write.parquet(f"{tmp_path}/documents")
    done = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path)], cwd=tmp_path, env=os.environ | {"PYTHONPATH": REPO}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    want = brute_substrings([tuple(r) for r in start.collect()], 35)
    for k in range(3):
        assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out{k}").collect()), key=repr) == want
