import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm import decontaminate, kernels, ngram_join, substring_dedup
from test_text_operators import brute_components, brute_substrings, docs


def thue_morse(n, a, b):
    return [b if bin(k).count("1") & 1 else a for k in range(n)]


@pytest.mark.parametrize("size", [64, 1024, 4096])
def test_words_whose_polynomials_are_equal_have_different_hashes(size):
    one, two = "".join(thue_morse(size, "a", "b")), "".join(thue_morse(size, "b", "a"))
    w = kernels.Words(pa.array([one, two]))
    for lane in (0, 1):
        assert len(set(w.hashes(lane).tolist())) == 2
    x, y = kernels.mix(np.arange(2, dtype=np.uint64) + np.uint64(5))
    for lane in (0, 1):
        assert kernels.runs_hash(np.array(thue_morse(size, x, y)), size, lane) != kernels.runs_hash(np.array(thue_morse(size, y, x)), size, lane)


def test_operators_tell_such_words_apart(spark):
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    rest = [f"w{k}" for k in range(40)]
    rows = [(1, " ".join([one, *rest[:34]])), (2, " ".join([two, *rest[:34]])), (3, " ".join([*rest[:4], one])), (4, " ".join([*rest[:4], two])), (5, one), (6, two)]
    assert sorted(map(tuple, substring_dedup.digests(docs(spark, rows)).collect()), key=repr) == brute_substrings(rows, 35)
    assert sorted(map(tuple, ngram_join.components(docs(spark, rows)).collect()), key=repr) == brute_components(rows)
    assert decontaminate.matches(pa.array([two, one]), decontaminate.Index([(1, one)])) == [(1, 0, 1024, 1)]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    rng = random.Random(4)
    words = ["".join(rng.choice("abé") for _ in range(rng.choice([1, 2, 3, 63, 64, 65, 128, 200]))) for _ in range(60)]
    texts = [(" " * rng.randint(0, 200)).join(rng.choices(words, k=30)) + " " * rng.randint(0, 3) for _ in range(20)] + [None, "", "  "]
    w = kernels.Words(pa.array(texts))
    raw = [w.data[a:b].tobytes() for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
    assert raw == [x.encode() for t in texts for x in (t or "").split(" ") if x]
    for lane in (0, 1):
        names = dict(zip(raw, w.hashes(lane).tolist(), strict=True))
        assert [names[x] for x in raw] == w.hashes(lane).tolist() and len(set(names.values())) == len(names)


def test_a_long_text_is_hashed_in_pieces():
    text = " ".join(f"word{k % 999}" + "x" * (k % 400 == 7) * 5000 for k in range(300_000))
    assert len(text) > 3 * 4 * kernels.STEP_BYTES
    w = kernels.Words(pa.array([text]))
    names = dict(zip(text.split(" ")[:2000], w.hashes()[:2000].tolist(), strict=True))
    assert all(names[x] == h for x, h in zip(text.split(" "), w.hashes().tolist(), strict=True) if x in names)
    assert len(set(w.hashes().tolist())) == len(set(text.split(" ")))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 35, 64])
def test_runs_have_equal_hashes_if_they_are_equal(size):
    values = kernels.mix(np.random.default_rng(size).integers(0, 2, 300).astype(np.uint64))
    own = kernels.runs_hash(values, size)
    runs = [values[k : k + size].tobytes() for k in range(len(values) - size + 1)]
    assert len(own) == len(runs) and len({*zip(runs, own.tolist(), strict=True)}) == len(set(runs)) == len(set(own.tolist()))
    assert len(kernels.runs_hash(values[: size - 1], size)) == 0


def test_sums_over_tasks(spark, monkeypatch):
    from sparkloom.llm import sums

    monkeypatch.setattr(sums, "FAN", 3)
    df = spark.range(0, 1000, 1, 40)

    def count(batches):
        total = np.zeros(10)
        for batch in batches:
            total += np.bincount(np.asarray(batch.column("id")) % 10, minlength=10)
        return total

    assert sums.over_tasks(df, count, 3, np.uint32).tolist() == [100] * 10
    assert sums.over_tasks(df.where("id < 7"), count, 3, np.float32).tolist() == [1.0] * 7 + [0.0] * 3


def test_stashed_tables_need_a_shared_folder_off_a_local_master(spark, monkeypatch):
    import os

    from sparkloom.llm import graph

    df, path = graph.written(spark.range(3))
    assert df.count() == 3 and path.startswith(graph.shared_folder(spark)) and os.path.isdir(path.removeprefix("file://"))
    graph.drop(spark, path)
    assert not os.path.exists(path.removeprefix("file://"))

    class Session:
        conf = type("conf", (), {"get": staticmethod(lambda *a: None), "set": staticmethod(lambda *a: None)})

        class sparkContext:
            master = "local-cluster[2,1,1024]"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        graph.shared_folder(Session)
    Session.sparkContext.master = "local[4]"
    assert graph.shared_folder(Session).startswith("file:///")
