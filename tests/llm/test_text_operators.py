import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from sparkloom.llm import bpe, decontaminate, kernels, langid, ngram_join, quality, substring_dedup, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, "  \t\n"), (4, "one"), (4, "one"), (5, "a b c d e f g"), (6, "A B C D E F G"), (None, "a b c d e f g"), (7, "é ü ß"), (8, "x" * 5000 + " y" * 3000)]


def docs(spark, rows, extra=""):
    return spark.createDataFrame([(i, t, *(9, "z")[: extra.count(",")]) for i, t in rows], "doc_id bigint, text string" + extra)


def words(text):
    return WORD.findall((text or "").encode())


def corpus(seed=1, n=120):
    """Texts with copies, near copies, shared passages and runs of one word."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        kind = i % 6
        own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 150))]
        if kind == 1 and out:
            own = out[rng.randrange(len(out))].split()
        elif kind == 2 and out:
            own = out[rng.randrange(len(out))].split()
            for _ in range(max(1, len(own) // 60)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
        elif kind == 3:
            own = own + passage[rng.randint(0, 20) :] + own[:5]
        elif kind == 4:
            own = own[:20] + ["same"] * rng.randint(1, 90) + own[20:]
        out.append(" ".join(own))
    return list(enumerate(out))


def brute_substrings(rows, window):
    split = [words(t) for _, t in rows]
    seen = {}
    for w in split:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("rows,window", [(corpus(), 35), (corpus(2), 7), (ODD, 3), (ODD, 35), ([], 35)])
def test_substring_dedup(spark, rows, window):
    found = substring_dedup.digests(docs(spark, rows), window).collect()
    assert sorted(map(tuple, found), key=repr) == brute_substrings(rows, window)


LONG = " ".join(f"w{k * k % 9973}x{k}" for k in range(120_000))  # a step of its own
BLANK = [(1, None), (2, ""), (3, " \t\n"), (3, " \t\n")]


@pytest.mark.parametrize("rows", [[(1, LONG), (2, LONG)], [(1, LONG), (2, "one"), (3, LONG), (4, None)], BLANK, [(1, LONG[:3000]), (2, LONG[:3000])]], ids=["long copies", "a copy among others", "blank", "short copies"])
def test_substring_dedup_of_steps_without_a_word_left(spark, rows):
    assert len(LONG) > kernels.STEP_BYTES
    found = substring_dedup.digests(docs(spark, rows)).collect()
    assert sorted(map(tuple, found), key=repr) == brute_substrings(rows, 35)


def test_substring_dedup_keeps_other_columns(spark):
    found = substring_dedup.dedup(docs(spark, ODD, ", block int, n_words string"), 3)
    assert found.columns == ["doc_id", "text", "block", "n_words", "n_words_", "n_removed"]
    rows = {r["doc_id"]: r for r in found.collect()}
    assert rows[1]["text"] is None and rows[2]["text"] == "" and rows[7]["text"] == "é ü ß" and rows[7]["block"] == 9


def test_recompressed_interiors_agree():
    rng = np.random.default_rng(3)
    same = rng.integers(0, 40, 35).astype(np.uint64)
    a = kernels.mix(np.concatenate([rng.integers(0, 40, 50).astype(np.uint64), same, rng.integers(0, 40, 20).astype(np.uint64)]))
    b = kernels.mix(np.concatenate([rng.integers(0, 40, 7).astype(np.uint64), same]))
    inner = []
    for w, at in ((a, 50), (b, 7)):
        name, low, high = substring_dedup.recompress(w, np.array([0, len(w)]))
        own = (low >= at) & (high <= at + 35)
        inner.append((name[own].tolist(), (low[own] - at).tolist()))
    assert inner[0] == inner[1] and inner[0][0]


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        out.append((i, len(sets[k]), min(ids) if sets[k] and ids else i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [None, 2])
def test_ngram_join(spark, monkeypatch, limit):
    if limit:  # every group is large
        monkeypatch.setattr(ngram_join, "SETS", limit)
        monkeypatch.setattr(ngram_join, "POINTS", limit)
    rows = corpus(4, 90) + [(1000 + i if i is not None else None, t) for i, t in ODD]
    assert sorted(map(tuple, ngram_join.components(docs(spark, rows)).collect()), key=repr) == brute_components(rows)


def test_ngram_join_of_nothing(spark):
    assert ngram_join.components(docs(spark, [])).collect() == []


def test_keep_one_keeps_one_of_each_component_where_a_doc_id_repeats(spark):
    one, two, three = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(5, one), (8, one), (9, one + " z"), (3, two), (5, two), (5, three), (5, three), (6, None), (6, ""), (None, two)]
    found = ngram_join.keep_one(docs(spark, rows, ", text_key int, n string"))
    assert found.columns == ["doc_id", "text", "text_key", "n"]
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == sorted([(5, one), (3, two), (5, three), (5, three), (6, None), (6, ""), (None, two)], key=repr)


def test_rtree_yields_all_pairs_within_the_bounds():
    rng = np.random.default_rng(1)
    points = rng.poisson(2, (300, ngram_join.GROUPS))
    points[150:] = points[:150] + (rng.random((150, ngram_join.GROUPS)) < 0.05)
    size = points.sum(axis=1)
    tree = ngram_join.RTree(size, points)
    for q in range(0, 300, 7):
        found = set(tree.query(q, np.ones(300, bool)).tolist())
        for k in range(300):
            fits = ngram_join.near_in_size(tree.size[q], tree.size[k], tree.size[k]) and np.minimum(tree.points[q], tree.points[k]).sum() >= ngram_join.needed(tree.size[q], tree.size[k])
            assert (k in found) == bool(fits)


PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TEXTS = ["", "hello world's  end", "a" * 3000, " " * 700 + "x", "tab\t\n \n x" * 300, "Straße 12345 ée 漢字 🙂 " * 60, "\x1c\x1d a　b ​" * 90, "<|endoftext|> it's"]


@pytest.mark.parametrize("chunk,overlap", [(16, 4), (64, 16), (1 << 14, 1 << 8)])
def test_bpe_equals_tiktoken(chunk, overlap):
    own = bpe.Codec(PATH, PATTERN, chunk, overlap)
    whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    for t in [*TEXTS, "".join(random.Random(5).choices("ab 's\n\t1é.", k=4000))]:
        ids = own.encode(t)
        assert ids.tolist() == whole.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_bpe_chunks_are_read_from_their_own_begin(monkeypatch):
    own = bpe.Codec(PATH, PATTERN, 64, 16)
    whole = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    text, read = "It's one of 12 texts, é and so on. " * 40, []
    boundaries = own.boundaries
    monkeypatch.setattr(own, "boundaries", lambda t, a, b: read.append((a, b)) or boundaries(t, a, b))
    assert own.encode(text).tolist() == whole.encode_ordinary(text)
    assert read == [(a, min(len(text), a + 64 + 16)) for a in range(0, len(text), 64)]


def test_bpe_tables(spark):
    df = docs(spark, ODD, ", ids int, raw string")
    ids = bpe.encode(df, PATH, PATTERN)
    raw = bpe.decode(ids, PATH, PATTERN)
    assert sorted(((r["doc_id"], bytes(r["raw"])) for r in raw.collect()), key=repr) == sorted(((i, (t or "").encode()) for i, t in ODD), key=repr)
    assert bpe.digests(docs(spark, []), PATH, PATTERN).collect() == []


def test_decontamination(spark):
    rng = random.Random(2)
    item = [f"q{k}" for k in range(40)]
    noise = [[f"n{rng.randrange(500)}" for _ in range(200)] for _ in range(4)]
    moved = item[20:] + noise[1][:30] + item[:20]
    rows = [
        (1, " ".join(noise[0] + item + noise[0])),
        (2, " ".join(moved)),
        (3, " ".join(noise[2])),
        (4, " ".join(noise[3] + item[:12])),  # less than half
        (5, " ".join(x.upper() + "," for x in item)),
        (6, None),
        (7, ""),
        (1, " ".join(noise[0] + item + noise[0])),
    ]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too short"), (12, None), (13, "the only four words"), (10, " ".join(item))], "item_id bigint, text string")
    found = decontaminate.contaminated(docs(spark, rows, ", item_id int, coverage string"), bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(1, 10), (2, 10), (5, 10)}
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs(spark, rows), bench).collect()) == [3, 4, 6, 7]
    assert decontaminate.contaminated(docs(spark, []), bench).collect() == []
    assert decontaminate.contaminated(docs(spark, rows), bench.limit(0)).collect() == []


def test_decontamination_of_items_of_few_long_words():
    passage = "一九八四年的春天他第一次来到这座城市那时候河边还没有桥人们坐船过河"
    thai, link, dull = "กรุงเทพมหานครเป็นเมืองหลวงของประเทศไทย", "https://example.org/a/long/path/without/any/space.html", "artificial intelligence"
    items = [(1, passage), (2, thai + " " + thai[::-1]), (3, link), (4, dull), (5, "你好"), (6, "法国的首都是哪里")]
    index = decontaminate.Index(items)
    texts = [
        passage,
        "前言。" + passage[:17] + "，\n" + passage[17:] + "后记",
        passage[20:] + "中间有别的话" + passage[:10],  # in another order
        passage[:12] + "完全不同的一段话",  # less than half
        thai + thai[::-1],
        f"See {link} for more.",
        link[:-10] + " and other pages",
        dull + " and 你好",
        "问：法国的首都是哪里？",
        "法国的首都很大",
        None,
    ]
    found = decontaminate.matches(pa.array(texts), index)
    assert [(r, items[k][0]) for r, k, *_ in found] == [(0, 1), (1, 1), (2, 1), (4, 2), (5, 3), (8, 6)]
    assert all(n == index.size[k] for r, k, n, _ in found if r != 2)


def test_tiles_are_common_runs_that_do_not_overlap():
    rng = random.Random(9)
    for _ in range(200):
        p, t = ([rng.randrange(4) for _ in range(rng.randint(0, 30))] for _ in range(2))
        tiles = decontaminate.tile(p, [t], 3)
        used = [k for a, n in tiles for k in range(a, a + n)]
        assert len(used) == len(set(used)) and all(n >= 3 for _, n in tiles)
        shared = max((n for n in range(len(p) + 1) for a in range(len(p) - n + 1) for b in range(len(t) - n + 1) if p[a : a + n] == t[b : b + n]), default=0)
        assert max((n for _, n in tiles), default=0) == (shared if shared >= 3 else 0)


def brute_code_length(trees_texts, text):
    """Bits of a text by the definition, with dictionaries."""
    counts = {}
    for t in trees_texts:
        b = t.encode().lower()
        for k in range(4):
            for i in range(k, len(b)):
                counts.setdefault(b[i - k : i], {}).setdefault(b[i], 0)
                counts[b[i - k : i]][b[i]] += 1
    total, b = 0.0, text.encode().lower()
    for i in range(len(b)):
        for k in range(min(i, 3), -1, -1):
            seen = counts.get(b[i - k : i], {})
            n, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                total += np.log2((n + d) / seen[b[i]])
                break
            total += np.log2((n + d) / d) if d else 0
        else:
            total += 8
    return total


def test_code_lengths():
    texts = {"aa": ["banana bandana", "an ant"], "bb": ["zoo zebra", "buzz"]}
    trees = langid.Trees(texts)
    for t in ("banana", "b", "", "zx", "an ox at the zoo!", "ZEBRA ant"):
        found = trees.lengths(*kernels.flat(pa.array([t])))[0]
        want = [brute_code_length(texts[x], t) for x in trees.languages]
        assert np.allclose(found, want, rtol=1e-5), t


def test_langid(spark):
    en, de = "the cat and the dog went over there with the other", "der hund und die katze gingen nicht auf das haus"
    labelled = spark.createDataFrame([(1, en, "en"), (2, de, "de"), (3, None, "de"), (4, "was auch", None)], "doc_id bigint, text string, lang string")
    trees = langid.train(labelled)
    found = {r["doc_id"]: r for r in langid.predict(docs(spark, [(1, "the other cat"), (2, "die katze und der hund"), (3, None), (4, ""), (5, "12 !?"), (6, "é")], ", lang_pred int, score string"), trees).collect()}
    assert [found[k]["lang_pred"] for k in range(1, 7)][:5] == ["en", "de", "und", "und", "und"]
    assert found[6]["lang_pred"] in ("en", "de") and all(0 <= r["score"] <= 1 for r in found.values())
    none = langid.predict(docs(spark, [(1, "text")]), langid.train(labelled.limit(0))).collect()
    assert [(r["lang_pred"], r["score"]) for r in none] == [("und", 0.0)]


def test_classifiers_on_held_out_rows(spark):
    rng = random.Random(3)
    text = lambda bad: " ".join(rng.choice(["idiot", "scum"]) if bad and k % 7 == 3 else f"w{rng.randrange(80)}" for k in range(40))
    junk = lambda bad: " ".join(f"w{rng.randrange(80)}" + ("***" if bad else "") for k in range(40))
    for module, make in ((toxicity, text), (quality, junk)):
        rows = [(i, make(i % 3 == 0)) for i in range(300)]
        labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)] + [(None, 1), (5000, 1)], "doc_id bigint, y int")
        model = module.train(docs(spark, rows), labels, "y")
        found = toxicity.score(docs(spark, [*rows, *((9000 + k, t) for k, (_, t) in enumerate(ODD))], ", score int"), model, "doc_id").collect()
        assert len(found) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in found)
        right = [(r["score"] >= 0.5) == (r["doc_id"] % 3 == 0) for r in found if 200 <= r["doc_id"] < 300]
        assert np.mean(right) > 0.95, module
        one = module.train(docs(spark, rows), labels.where("y = 1"), "y")
        assert set(one.score(pa.array(["a", None]))) == {1.0}
        assert set(module.train(docs(spark, []), labels.limit(0), "y").score(pa.array(["a"]))) == {0.0}


def test_isotonic_rises():
    x, y = np.array([0.1, 0.2, 0.3, 0.4, 0.5]), np.array([0, 1, 0, 1, 1.0])
    found = toxicity.Isotonic(x, y)(np.linspace(0, 1, 20))
    assert (np.diff(found) >= 0).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    start = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r["item_id"], words(r["text"].lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    at = start
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"]) for r in at.collect()]
        found = stage(spark, at, sf)
        if name == "near_duplicates":
            assert {r["doc_id"] for r in found.collect()} == {i for i, _, c in brute_components(rows) if i == c}
        if name == "substrings":
            assert sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in found.collect()) == sorted((i, h) for i, _, _, h in brute_substrings(rows, 35))
        if name == "decontamination":
            kept = {r["doc_id"] for r in found.collect()}
            for i, t in rows:
                have = words(t.lower())
                holds = any(b" ".join(w) in b" ".join(have) for _, w in bench)
                assert i not in kept if holds else True
        if name == "tokens":
            assert {(r["doc_id"], r["decoded_sha256"]) for r in found.collect()} == {(i, hashlib.sha256(t.encode()).hexdigest()) for i, t in rows}
        else:
            assert found.columns == start.columns
            from sparkloom.llm.graph import stash

            at = stash(found)
