"""Greedy string tiling against its definition, and texts of repeated words."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import decontaminate, kernels, queries
from test_text_operators import words

SF = "/root/testdata/sf0.01"


def brute_tiles(pattern, pieces, least):
    """The longest common run of free words, the first in the pattern and then in the text, again and again."""
    text = [(k, x) for k, p in enumerate(pieces) for x in p]
    free_p, free_t, tiles = [True] * len(pattern), [True] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(pattern)):
            for t in range(len(text)):
                n = 0
                while p + n < len(pattern) and t + n < len(text) and free_p[p + n] and free_t[t + n] and text[t + n] == (text[t][0], pattern[p + n]):
                    n += 1
                if n > best[0]:
                    best = (n, p, t)
        n, p, t = best
        if n < least:
            return tiles
        free_p[p : p + n] = free_t[t : t + n] = [False] * n
        tiles.append((p, n))


def hashed(x):
    return kernels.mix(np.array(x, np.uint64) + np.uint64(7))


@pytest.mark.parametrize("letters", [1, 2, 4, 9])
def test_tiles_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(150):
        pattern = [rng.randrange(letters) for _ in range(rng.randint(0, 22))]
        pieces = [[rng.randrange(letters) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(0, 3))]
        least = rng.randint(1, 4)
        assert decontaminate.tile(hashed(pattern), [hashed(p) for p in pieces], least) == brute_tiles(pattern, pieces, least)


def brute_matches(texts, items, coverage=0.5, least=5):
    out = []
    for r, text in enumerate(texts):
        for k, item in enumerate(items):
            tiles = brute_tiles(item, [text], min(len(item), least)) if len(item) >= 3 else []
            covered = sum(n for _, n in tiles)
            if tiles and covered >= coverage * len(item):
                out.append((r, k, covered, len(tiles)))
    return out


def test_matches_equal_brute_force():
    rng = random.Random(3)
    items = [[f"q{rng.randrange(12)}" for _ in range(rng.randint(0, 24))] for _ in range(12)]
    texts = []
    for _ in range(30):
        text = [f"q{rng.randrange(12)}" for _ in range(rng.randint(0, 10))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)
            a, b = sorted(rng.randint(0, len(item)) for _ in range(2))
            text += item[a:b] + [f"n{rng.randrange(9)}"] * rng.randint(0, 1)
        texts.append(text)
    index = decontaminate.Index([(k, " ".join(x)) for k, x in enumerate(items)])
    found = decontaminate.matches(pa.array([" ".join(t) for t in texts]), index)
    assert found == brute_matches(texts, items) and len(found) > 5


def test_query_equals_brute_force_over_its_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: [x for w in words((t or "").lower()) if (x := bytes(c for c in w if c > 127 or chr(c).isalnum()))]
    own = [(i, plain(t)) for i, t in rows]
    runs = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, w in own]
    want = set()
    for k, t in items:
        item = plain(t)
        seeds = {tuple(item[a : a + 5]) for a in range(len(item) - 4)}
        for (i, text), have in zip(own, runs, strict=True):
            if seeds & have:  # without one, no tile
                tiles = brute_tiles(item, [text], 5)
                if 2 * sum(n for _, n in tiles) >= len(item):
                    want.add((i, k, sum(n for _, n in tiles) / len(item), len(tiles)))
    found = queries.QUERIES["op3_decontaminate"](spark, SF).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want) > 3


def test_texts_of_one_repeated_word_are_quick():
    began = time.time()
    index = decontaminate.Index([(1, "same " * 3000), (2, "same other " * 1500), (3, "a b c d e f")])
    found = decontaminate.matches(pa.array(["same " * 200_000, "other same " * 50_000, "same " * 1499, "x"]), index)
    assert found == [(0, 0, 3000, 1), (1, 1, 3000, 1)]
    assert time.time() - began < 20
