"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case without punctuation. A document and a benchmark item that share a seed, a run of `MIN_MATCH`
words, are joined; a pair whose seeds together cover less of the item than the threshold can't reach it and is left. For the
others, the longest common runs of unmarked words are found by running Karp-Rabin hashes and marked, again and again
down to MIN_MATCH words, so that passages in another order count too. Of equally long runs, the first in the item goes first, and with
the first in the text. A document is contaminated if the tiles cover at least `COVERAGE` of an item's words.

Equal seeds are counted once for each text and item, and tiles are found without forming pairs of places, so a text of one
repeated word costs no more than any other.

The benchmark is the query set: it goes to the executors in blocks of bounded size, each against all documents, which are not
exchanged. An item with fewer than MIN_MATCH words must occur as a whole.

Scripts without spaces have few and long words. An item of fewer than MIN_MATCH words that is mostly in such a script is compared by
characters instead, `CHARACTERS` for a word, as is any item of fewer than `MIN_ITEM` words and at least `MIN_LONG` characters, which must
occur as a whole. Spaces and ASCII punctuation don't count. What is shorter than that is too short to tell and matches nothing. Null and empty texts share nothing. Repeated rows are judged alike.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernels
from sparkloom.llm.blocks import plain

MIN_MATCH, MIN_ITEM, COVERAGE = 5, 3, 0.5
CHARACTERS, MIN_LONG = 2, 30
#: Text bytes of benchmark items that are sent to the executors at once.
BLOCK_BYTES = 8 << 20
#: Karp-Rabin hashes are two numbers modulo a prime, side by side.
PRIME, BASES = (1 << 31) - 1, (1_000_003, 998_244_353)

_kept = np.zeros(256, bool)
_kept[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
# Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese characters.
_spaceless = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


class Tokens:
    """Word hashes, or character hashes, of a batch of texts, without punctuation and capitals."""

    def __init__(self, texts: pa.Array, characters: bool = False):
        w = kernels.Words(texts, lower=True)
        keep = _kept[w.data]
        place = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        if characters:
            data = w.data[keep]
            start = np.flatnonzero(data & 0xC0 != 0x80)
            self.hash = kernels.spans_hash(data, start, np.append(start, len(data))[1:])
            self.first = np.searchsorted(start, place[w.off])
            self.count = np.diff(self.first)
            return
        start, end = place[w.start], place[w.end]
        some = end > start
        self.hash = kernels.spans_hash(w.data[keep], start[some], end[some])
        total = np.zeros(len(some) + 1, np.int64)
        np.cumsum(some, out=total[1:])
        self.first = total[w.first]
        self.count = np.diff(self.first)


class Index:
    """The seeds of a block of benchmark items, by hash."""

    def __init__(self, items: list[tuple[int, str]], min_match: int = MIN_MATCH):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        by_word, by_character = Tokens(texts), Tokens(texts, True)
        self.ids = [i for i, _ in items]
        self.words, kinds = [], []  # kinds: whether characters, and the seed's size or 0
        for k, (_, t) in enumerate(items):
            n, long = int(by_word.count[k]), int(by_character.count[k])
            few = n < min_match and 2 * len(_spaceless.findall(t or "")) > long >= CHARACTERS * MIN_ITEM
            if few:
                kinds.append((True, min(long, CHARACTERS * min_match)))
            elif n < MIN_ITEM and long >= MIN_LONG:
                kinds.append((True, long))
            else:
                kinds.append((False, min(n, min_match) if n >= MIN_ITEM else 0))
            tokens = by_character if kinds[-1][0] else by_word
            self.words.append(tokens.hash[tokens.first[k] : tokens.first[k + 1]])
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.min_match = min_match
        self.seeds: dict[tuple[bool, int], Seeds] = {}
        for kind in sorted({x for x in kinds if x[1]}):
            own = [k for k in range(len(self.words)) if kinds[k] == kind]
            self.seeds[kind] = Seeds(own, [kernels.runs_hash(self.words[k], kind[1]) for k in own])


class Seeds:
    """The seeds of one kind of all items. An entry is a place of a seed in an item, in the order of seeds, items and places."""

    def __init__(self, items: list[int], hashes: list[np.ndarray]):
        self.known, seed = np.unique(np.concatenate(hashes), return_inverse=True)
        item = np.repeat(items, [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes])
        order = np.lexsort((place, item, seed))
        self.item, self.place = item[order], place[order]
        self.first = np.searchsorted(seed[order], np.arange(len(self.known) + 1))
        cut = np.cumsum([len(h) for h in hashes])[:-1]
        self.of_item = dict(zip(items, map(np.unique, np.split(seed, cut)), strict=True))
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.known & np.uint64(len(self.sieve) - 1)] = True

    def hits(self, tokens: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in the batch's words (or characters) where a seed stands, and its number."""
        h = kernels.runs_hash(tokens.hash, size)
        at = np.flatnonzero(self.sieve[h & np.uint64(len(self.sieve) - 1)])
        at = at[at + size <= tokens.first[np.searchsorted(tokens.first, at, "right")]]  # seeds don't go over a text's end
        seed = np.minimum(np.searchsorted(self.known, h[at]), len(self.known) - 1)
        found = self.known[seed] == h[at]
        return at[found], seed[found]

    def cover(self, pair: np.ndarray, entry: np.ndarray, size: int) -> np.ndarray:
        """For each pair, how many words of its item the given entries cover."""
        place = self.place[entry]
        order = np.lexsort((place, pair))
        pair, place = pair[order], place[order]
        gain = np.full(len(pair), size)
        same = pair[1:] == pair[:-1]
        gain[:-1][same] = np.minimum(size, np.diff(place)[same])
        return np.bincount(pair, gain)


def powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n - 1) modulo PRIME, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), PRIME)) % np.uint64(PRIME)])
    return out[:n]


class Running:
    """Karp-Rabin hashes of the runs of words, of any size, from running sums."""

    def __init__(self, words: np.ndarray):
        n, prime = len(words), np.uint64(PRIME)
        self.words, self.lanes = words, []
        for k, base in enumerate(BASES):
            own = (words >> np.uint64(31 * k)) % prime
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * powers(base, n) % prime)])  # at most 2^31 a word
            self.lanes.append((sums, powers(pow(base, -1, PRIME), n)))

    def runs(self, size: int) -> np.ndarray:
        one, two = ((sums[size:] - sums[:-size]) % np.uint64(PRIME) * inverse[: len(self.words) - size + 1] % np.uint64(PRIME) for sums, inverse in self.lanes)
        return one << np.uint64(31) | two


def free_runs(marked: np.ndarray, size: int) -> np.ndarray:
    """Where runs of `size` words without a marked one begin."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(marked)])
    return np.flatnonzero(total[size:] == total[:-size]) if size < len(total) else np.zeros(0, np.int64)


def tile(pattern: np.ndarray, pieces: list[np.ndarray], min_match: int = MIN_MATCH) -> list[tuple[int, int]]:
    """Greedy string tiling: (place in pattern, length) of the tiles, in the order in which they are marked. pieces: runs of the text; no tile spans two."""
    pattern = np.asarray(pattern, np.uint64)
    text = np.concatenate([np.zeros(0, np.uint64), *(x for p in pieces for x in (np.zeros(1, np.uint64), np.asarray(p, np.uint64)))])
    marked_p, marked_t = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    marked_t[np.cumsum([0, *(len(p) + 1 for p in pieces)])[:-1]] = True  # what parts the pieces is never free
    p_runs, t_runs = Running(pattern), Running(text)

    def common(size: int) -> tuple[np.ndarray, ...]:
        """Places of free runs of the pattern that the text has too, free, and their hashes; and the same for the text."""
        p, t = free_runs(marked_p, size), free_runs(marked_t, size)
        if not len(p) or not len(t):
            return p[:0], p[:0], t[:0], t[:0]
        hp, ht = p_runs.runs(size)[p], t_runs.runs(size)[t]
        in_p, in_t = np.isin(hp, ht), np.isin(ht, hp)
        return p[in_p], hp[in_p], t[in_t], ht[in_t]

    tiles: list[tuple[int, int]] = []
    most = min(len(pattern), max(map(len, pieces), default=0))
    while most >= min_match:
        # If there are common runs of some size, there are of any smaller one: the longest is found by halving.
        low, high = min_match - 1, most
        while low < high:
            size = (low + high + 1) // 2
            low, high = (size, high) if len(common(size)[0]) else (low, size - 1)
        if low < min_match:
            break
        # All of this size: each place of the pattern in turn with the first free place in the text. A place that isn't free any more never is again.
        p, hp, t, ht = common(low)
        places: dict[int, list[int]] = {}
        for h, k in zip(ht[::-1].tolist(), t[::-1].tolist(), strict=True):
            places.setdefault(h, []).append(k)
        for h, k in zip(hp.tolist(), p.tolist(), strict=True):
            if marked_p[k] or marked_p[k + low - 1]:  # marked runs are at least as long, so they cover an end of what they touch
                continue
            own, others = places[h], []
            while own:
                j = own.pop()
                if marked_t[j] or marked_t[j + low - 1]:
                    continue
                if (text[j : j + low] == pattern[k : k + low]).all():
                    marked_p[k : k + low] = marked_t[j : j + low] = True
                    tiles.append((k, low))
                    break
                others.append(j)  # other words of the same hash
            own += reversed(others)
        most = low - 1
    return tiles


def matches(texts: pa.Array, index: Index, coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(row, item, covered words or characters, tiles) of each pair that reaches the coverage."""
    read, out = {c: Tokens(texts, c) for c in {c for c, _ in index.seeds}}, []
    for kind, seeds in index.seeds.items():
        tokens, size = read[kind[0]], kind[1]
        at, seed = seeds.hits(tokens, size)
        if not len(at):
            continue
        doc = np.searchsorted(tokens.first, at, "right") - 1
        # Each seed of a text once, with each item that has it.
        once = np.unique(doc * len(seeds.known) + seed)
        own_doc, own_seed = once // len(seeds.known), once % len(seeds.known)
        row, entry = spread(own_doc, seeds.first[own_seed], seeds.first[own_seed + 1])
        pair, place = np.unique(row * len(index.ids) + seeds.item[entry], return_inverse=True)
        # What the seeds cover of an item: of each entry, the words that the next one of the same item doesn't cover.
        bound = seeds.cover(place, entry, size)
        for k in np.flatnonzero(bound >= coverage * index.size[pair % len(index.ids)]).tolist():
            r, item = divmod(int(pair[k]), len(index.ids))
            a, b = np.searchsorted(doc, [r, r + 1])
            here = at[a:b][np.isin(seed[a:b], seeds.of_item[item])]
            cuts = np.flatnonzero(np.diff(here) > size)  # seeds that don't touch lie in different runs of the text
            firsts, lasts = here[np.append(0, cuts + 1)], here[np.append(cuts, len(here) - 1)] + size
            tiles = tile(index.words[item], [tokens.hash[x:y] for x, y in zip(firsts.tolist(), lasts.tolist(), strict=True)], size)
            covered = sum(n for _, n in tiles)
            if covered >= coverage * index.size[item]:
                out.append((r, item, covered, len(tiles)))
    return sorted(out)


def spread(keys: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key as often as its range from first to end is long, and the numbers of the ranges."""
    n = end - first
    return np.repeat(keys, n), np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Index]:
    """The benchmark's items in blocks, dealt by a hash."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        yield Index(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda x: (x[0] is None, x)))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles: a row for each document and benchmark item that it holds."""
    schema = "doc_id bigint, item_id bigint, coverage double, n_tiles int"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in kernels.steps(batches):
                found = matches(batch.column("text"), own, coverage)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array([r for r, *_ in found], pa.int64())),
                        pa.array([own.ids[k] for _, k, *_ in found], pa.int64()),
                        pa.array([c / int(own.size[k]) for _, k, c, _ in found], pa.float64()),
                        pa.array([n for *_, n in found], pa.int32()),
                    ],
                    ["doc_id", "item_id", "coverage", "n_tiles"],
                )

        out = out.unionAll(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, unchanged, that hold no benchmark item."""
    names = docs.columns
    docs = plain(docs, "text")
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in kernels.steps(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, *_ in matches(batch.column("text"), shared.value, coverage)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.toDF(*names)
