"""Bounded samples, and the trees of many languages."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.llm import kernels, labelled, langid
from test_text_operators import brute_code_length, docs


def test_samples_are_bounded_in_rows_and_bytes(spark):
    rows = [(k, "x" * (k % 50) + "é" * 10) for k in range(400)] + [(7, "again"), (7, "again")] * 30 + [(1000, "y" * 5000), (None, "z")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)] + [(1000, 1), (None, 1), (3, None)], "doc_id bigint, y int")
    everything, y = labelled.sample(docs(spark, rows), labels, "y")
    assert len(everything) == 402 and set(everything) == {t for i, t in rows if i is not None}  # rows that are alike count once
    few, y = labelled.sample(docs(spark, rows), labels, "y", max_rows=50)
    assert len(few) == len(y) == 50 and few == everything[:50] and all(t == "again" or t[0] == "y" or (len(t) - 10) % 2 == own for t, own in zip(few, y, strict=True))
    small, _ = labelled.sample(docs(spark, rows), labels, "y", max_bytes=3000)
    assert 2900 < sum(len(t.encode()) for t in small) <= 3000 and "y" * 5000 not in small
    assert labelled.sample(docs(spark, rows), labels, "y", max_bytes=0) == ([], [])


def test_langid_training_is_bounded(spark):
    rows = [(k, f"text number {k} " * 20, "ab"[k % 2]) for k in range(60)] + [(5, "same", "a")] * 50 + [(1, "w" * 9000, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    trees = langid.train(df, 600, 6000)
    assert trees.languages == ["a", "b"]  # the one text of c doesn't fit
    assert langid.train(df.where(F.lit(False))).languages == []


def test_code_lengths_of_many_languages():
    rng = random.Random(1)
    texts = {f"l{k:02}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzäßé漢 "[k % 9 :], k=80)) for _ in range(3)] for k in range(30)}
    trees = langid.Trees(texts)
    some = ["".join(rng.choices("abcxyzäé漢 🙂Q", k=rng.randint(0, 60))) for _ in range(8)] + [texts["l03"][0], ""]
    found = trees.lengths(*kernels.flat(pa.array(some)))
    for t, own in zip(some, found, strict=True):
        assert np.allclose(own, [brute_code_length(texts[x], "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for x in trees.languages], rtol=1e-5), t


def test_tables_are_in_proportion_to_what_was_seen():
    rng = np.random.default_rng(2)
    texts = {f"l{k}": [bytes(rng.integers(1, 128, 2000, np.uint8)).decode()] for k in range(40)}
    trees = langid.Trees(texts)
    assert sum(x.nbytes for x in (*trees.bits, *trees.leave, trees.entry_less, trees.entry_language, trees.table.keys)) < 60 << 20


def test_hash_table():
    keys = np.unique(np.random.default_rng(4).integers(0, 1 << 32, 5000))
    table = kernels.HashTable(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    assert (table.find(np.setdiff1d(np.arange(20000), keys)) == -1).all()
    assert kernels.HashTable(keys[:0]).find(keys[:3]).tolist() == [-1] * 3
