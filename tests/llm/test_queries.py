"""The registered queries over a whole small data directory, against brute force or on held-out rows."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkloom.llm import bpe, chat, labelled, queries
from test_text_operators import brute_components, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def held(i, k, remainder):
    return zlib.crc32(str(i).encode()) % k == remainder


@pytest.mark.parametrize("name,k,remainder,column,least", [("op1_toxicity", 3, 1, "toxic", 0.7), ("op6_quality", 5, 0, "quality", 0.3)])
def test_classifiers(spark, name, k, remainder, column, least):
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = queries.QUERIES[name](spark, sf).collect()
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right = []
    for r in found:
        assert r["held_out"] == held(r["doc_id"], k, remainder) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= least)
        if r["held_out"] and label.get(r["doc_id"]) is not None:
            right.append(r["predicted"] == label[r["doc_id"]])
    assert len(right) > 50 and np.mean(right) > 0.85


def test_langid(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.QUERIES["op2_langid"](spark, SF).collect()
    assert len(found) == len(lang) and all(r["held_out"] == held(r["doc_id"], 5, 0) for r in found)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in found if r["held_out"]]) > 0.9


def test_decontamination_finds_every_whole_item(spark, rows):
    found = {(r["doc_id"], r["item_id"]): r["coverage"] for r in queries.QUERIES["op3_decontaminate"](spark, SF).collect()}
    items = [(r["item_id"], b" ".join(words(r["text"].lower()))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    have = {i: b" ".join(words(t.lower())) for i, t in rows}
    whole = {(i, k) for i, t in have.items() for k, x in items if x in t}
    assert whole and all(found[p] == 1 for p in whole)
    # What is found shares half of the item in runs of five words at least.
    for (i, k), coverage in found.items():
        item, text = dict(items)[k].split(), have[i].split()
        runs = {tuple(text[a : a + 5]) for a in range(len(text) - 4)}
        shared = {b for a in range(len(item) - 4) if tuple(item[a : a + 5]) in runs for b in range(a, a + 5)}
        assert 0.5 <= coverage <= 1 and len(shared) >= 0.4 * len(item)


def test_media(spark, rows):
    found = {r["doc_id"]: r for r in queries.QUERIES["op7_media"](spark, SF).collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        raw = (t or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        r = found[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_bpe(spark, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = set()
    for i, t in rows:
        ids = whole.encode_ordinary(t)
        want.add((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert {tuple(r) for r in queries.QUERIES["op9_bpe"](spark, SF).collect()} == want


def test_ngram_join(spark, rows):
    assert sorted(map(tuple, queries.QUERIES["op10_ngram_join"](spark, SF).collect()), key=repr) == brute_components(rows)


def test_mask_decides_what_is_learned(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a#"), (1, 1, "assistant", "b<"), (1, 2, "assistant", ""), (1, 3, "assistant", "\\d")], "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_chats(turns)
    r = chat.summary(formatted).first()
    assert (r["loss_chars"], r["loss_sha256"]) == (4, hashlib.sha256(b"b<\\d").hexdigest())
    off = F.transform("loss_runs", lambda x: F.struct(x["skip"], F.lit(0).cast("bigint").alias("take")))
    assert chat.summary(formatted.withColumn("loss_runs", off)).first()["loss_chars"] == 0


def test_lowest_is_exact(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("lang"), F.col("id").alias("doc_id"), F.xxhash64("id").alias("order"))
    every = sorted((r["order"], r["doc_id"], r["lang"]) for r in df.collect())
    want = {x[1] for g in range(3) for x in [x for x in every if x[2] == g][:40]}
    assert {r["doc_id"] for r in labelled.lowest(df, 40, "lang").collect()} == want


def test_quality_stage_with_clashing_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("s"), "text_": F.lit(1), "row": F.lit(2), "odd name": F.lit(None).cast("int")})
    found = corpus_pipeline.quality_stage(spark, docs, SF)
    assert found.columns == docs.columns and found.where("score = 's' and row = 2").count() == found.count() > 0
