"""Own merges and stitched chunks against the tiktoken library, in one process and over rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from sparkloom.llm import bpe
from test_text_operators import ODD, TEXTS, docs

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: A pattern whose digits go by threes, so that chunks in a long number may never agree.
THREES = r"\p{N}{1,3}| ?\p{L}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def library(pattern=PATTERN):
    return tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def pieces():
    rng = random.Random(8)
    out = ["a" * 5000, "ab" * 700, "é" * 500, " " * 4000, "0" * 3001, "!?" * 900]
    return out + ["".join(rng.choices("abcdeé漢ß🙂", k=rng.randint(1, 400))) for _ in range(120)]


def test_merges_equal_the_library():
    own, whole = bpe.Codec(PATH, PATTERN), library()
    raw = [p.encode() for p in pieces()]
    want = [np.array(whole._encode_single_piece(p), "<u4").tobytes() for p in pieces()]
    assert own.merge(raw) == want
    assert [own.merge_long(p) for p in raw if p not in own.ranks] == [x for p, x in zip(raw, want, strict=True) if p not in own.ranks]
    assert own.merge([b"", b"a"]) == [b"", own.ranks[b"a"].to_bytes(4, "little")] and own.merge([]) == []


def test_kept_pre_tokens_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 10)
    own, whole, text = bpe.Codec(PATH, PATTERN), library(), " ".join(f"word{k}x" for k in range(300))
    assert own.encode(text).tolist() == whole.encode_ordinary(text) and len(own.known) <= 10


@pytest.mark.parametrize("pattern", [PATTERN, THREES])
@pytest.mark.parametrize("chunk,overlap", [(16, 4), (64, 16), (300, 40)])
def test_stitched_chunks_equal_the_library(pattern, chunk, overlap):
    own, whole, rng = bpe.Codec(PATH, pattern, chunk, overlap), library(pattern), random.Random(chunk)
    for t in [*TEXTS, *pieces()[:6], "7" * 1000 + " end", *("".join(rng.choices(["a", "bc ", "'s", "\n", "\t ", "123", "é", " ", "'r", "'re "], k=800)) for _ in range(30))]:
        ids = own.encode(t)
        assert ids.tolist() == whole.encode_ordinary(t) and own.decode(ids) == t.encode()


@pytest.mark.parametrize("chunk,overlap", [(40, 8), (1 << 16, 1 << 8)])
def test_rows_of_chunks(spark, monkeypatch, chunk, overlap):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OVERLAP", overlap)
    rows = [(100 + k, t) for k, t in enumerate([*TEXTS, *pieces()[:6], "z" * 70_000, ("word " * 9 + "12 \n") * 4000, ""])] + ODD
    whole, want = library(), []
    for i, t in rows:
        ids = np.array(whole.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    df = docs(spark, rows, ", row int, begin string").repartition(3)
    assert sorted(map(tuple, bpe.digests(df, PATH, PATTERN).collect()), key=repr) == sorted(want, key=repr)
    found = bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted(((r["doc_id"], bytes(r["raw"]).decode()) for r in found), key=repr) == sorted(((i, t or "") for i, t in rows), key=repr)
