"""Substring deduplication by recompression.

Rounds rewrite each document, at first its words: a run of one symbol becomes a symbol, then each pair of a left and a right
symbol becomes one, sides being dealt by a hash of the symbol and the round. A symbol is named by a hash of what it stands for,
so all executors give the same run or pair the same name without an exchange, and equal word sequences have equal
symbols in their interiors. (Names given out by Spark rounds would be exchanged once in each of the four rounds, four times as many bytes as the
input in all; the README has the figures. What Spark rounds settle is which of the last round's symbols, and then which windows, are shared.) Each symbol knows the words that its being there depends on. A window of `WINDOW` words that
occurs twice has every symbol that depends on its words alone in common; so only windows whose interior symbols are all shared can
repeat. These are verified by 128-bit hashes of their words. A symbol that two places have by chance costs a check and no more.

A window is removed by what it says: wherever its words start at least twice, in one document or in several. Words are
`[^\\x20\\x09-\\x0D]+`, unchanged; windows are judged on the input. Texts of fewer words than a window, null and empty ones
lose nothing. Repeated rows are places of their own, so they remove each other.

Three passes read the blocks of one exchange: symbols, then windows, then the words that remain. Where windows may repeat goes from the
second to the third as a bit a word; both put the block's texts in order, and the third checks that they are the ones that the bits are for.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import blocks, kernels

WINDOW, ROUNDS = 35, 4
_salt = np.random.default_rng(5).integers(1, 2**63, (ROUNDS, 3)).astype(np.uint64)
_odd = np.uint64(0x9E3779B97F4A7C15)


def recompress(words: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The last round's symbols of all texts: name, and the first and last-but-one of the words that it depends on.

    words: hashes; first: where each text begins, and the end. What depends on a text's edge depends on a word outside.
    """
    n = len(words)
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    place = np.int32 if n < 1 << 30 else np.int64
    behind = np.array([n], place)
    name, start = words, np.arange(n, dtype=place)
    low, high = np.arange(n, dtype=place), np.arange(1, n + 1, dtype=place)
    for k in range(rounds):
        m = len(name)
        if not m:
            break
        begins = edge[start]
        end = np.concatenate([start[1:], behind])
        # Runs. That a neighbour differs shows from its nearest word, if that differs; else it takes the whole neighbour.
        joins = np.zeros(m, bool)
        joins[1:] = (name[1:] == name[:-1]) & ~begins[1:]
        last = edge[end]
        after = np.where(last, end + 1, place(0))
        before = np.where(begins, start - 1, place(n + 1))
        inner = np.flatnonzero(~last)
        plain = words[end[inner]] != words[start[inner]]
        after[inner] = np.where(plain, end[inner] + 1, high[np.minimum(inner + 1, m - 1)])
        inner = np.flatnonzero(~begins)
        plain = words[start[inner] - 1] != words[end[inner] - 1]
        before[inner] = np.where(plain, start[inner] - 1, low[inner - 1])
        heads = np.flatnonzero(~joins)
        tails = np.append(heads[1:], m) - 1
        size = tails - heads + 1
        low, high = np.minimum(low, before)[heads], np.maximum(high, after)[tails]
        name, start = name[heads], start[heads]
        long = size > 1
        name[long] = kernels.mix(name[long] ^ (size[long].astype(np.uint64) * _odd + _salt[k, 0]))
        # Pairs. What stays single depends on the neighbour that it might have joined.
        m = len(name)
        begins = edge[start]
        right = kernels.mix(name ^ _salt[k, 1]) & np.uint64(1) > 0
        pair = np.zeros(m, bool)  # joins the one before
        pair[1:] = ~right[:-1] & right[1:] & ~begins[1:]
        first_of = np.zeros(m, bool)
        first_of[:-1] = pair[1:]
        single_left, single_right = ~right & ~first_of, right & ~pair
        new_low, new_high = low.copy(), high.copy()
        at = np.flatnonzero(single_right)
        new_low[at] = np.where(begins[at], start[at] - 1, np.minimum(low[at], low[at - 1]))
        at = np.flatnonzero(single_left)
        end = np.concatenate([start[1:], behind])
        new_high[at] = np.where(edge[end[at]], end[at] + 1, np.maximum(high[at], high[np.minimum(at + 1, m - 1)]))
        at = np.flatnonzero(first_of)
        new_low[at], new_high[at] = np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
        name = name.copy()
        name[at] = kernels.mix((name[at] * _odd) ^ (kernels.mix(name[at + 1] + _salt[k, 2])))
        keep = ~pair
        name, start, low, high = name[keep], start[keep], new_low[keep], new_high[keep]
    return name, low, high


class Block:
    """A block's words, symbols and windows."""

    def __init__(self, texts: pa.ChunkedArray):
        self.parts = [kernels.Words(b.column("text")) for b in kernels.steps(pa.table({"text": texts}).to_batches())]
        self.words = np.concatenate([w.hashes() for w in self.parts] or [np.zeros(0, np.uint64)])
        self.count = np.concatenate([w.count for w in self.parts] or [np.zeros(0, np.int64)])
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def seal(self) -> bytes:
        """A hash of the words and of where texts begin."""
        places = np.arange(len(self.words) + len(self.first), dtype=np.uint64) * _odd
        return kernels.mix(np.concatenate([self.words, self.first.astype(np.uint64)]) ^ kernels.mix(places)).sum(dtype=np.uint64).tobytes()

    def symbols(self) -> tuple[np.ndarray, ...]:
        """The names that occur, sorted, how often, and for each symbol its name's place, and the words it depends on."""
        name, low, high = recompress(self.words, self.first)
        names, place, times = np.unique(name, return_inverse=True, return_counts=True)
        return names, times, place, low, high

    def whole(self, window: int) -> np.ndarray:
        """Whether a window begins at each word."""
        out = np.zeros(len(self.words), bool)
        left = np.repeat(self.first[1:], self.count) - np.arange(len(out))
        return left >= window

    def possible(self, shared: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
        """Where windows begin all of whose interior symbols are shared."""
        lone = ~shared[place] & (high - low <= window)
        n = len(self.words)
        ruled = np.bincount(np.clip(high[lone] - window, 0, n), minlength=n + 2)[: n + 2].astype(np.int64)
        ruled -= np.bincount(np.clip(low[lone] + 1, 0, n + 1), minlength=n + 2)[: n + 2]
        return self.whole(window) & (np.cumsum(ruled)[:n] == 0)

    def windows(self, at: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """128-bit hashes of the windows at the given words, sorted without repeats, how often, and each window's place."""
        other = np.concatenate([w.hashes(1) for w in self.parts] or [np.zeros(0, np.uint64)])
        one, two = (kernels.runs_hash(h, window, k)[at] for k, h in enumerate((self.words, other)))
        order = np.lexsort((two, one))
        one, two = one[order], two[order]
        new = np.ones(len(one), bool)
        new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        place = np.empty(len(one), np.int64)
        place[order] = np.cumsum(new) - 1
        return one[new], two[new], np.diff(np.append(np.flatnonzero(new), len(one))), place

    def rest(self, gone: np.ndarray) -> pa.Array:
        """The words of each text that aren't gone, joined by one space."""
        out, at = [], 0
        for w in self.parts:
            n = len(w.start)
            keep = ~gone[at : at + n]
            at += n
            end = np.zeros(n, bool)  # the last kept word of a text has no space behind it
            kept = np.flatnonzero(keep)
            doc = np.searchsorted(w.first, kept, "right") - 1
            if len(kept):
                end[kept[np.append(np.flatnonzero(doc[1:] != doc[:-1]), len(kept) - 1)]] = True
            flag = np.zeros(len(w.data) + 1, np.int8)
            np.add.at(flag, w.start[keep], 1)
            np.add.at(flag, w.end[keep], -1)
            flag = np.cumsum(flag[:-1]).astype(bool)
            gap = w.end[keep & ~end]
            data = w.data.copy()
            data[gap] = 32
            flag[gap] = True
            total = np.concatenate([[0], np.cumsum(flag)])[w.off]
            out.append(pa.Array.from_buffers(pa.large_string(), len(w.off) - 1, [None, pa.py_buffer(np.ascontiguousarray(total, np.int64)), pa.py_buffer(data[flag])]))
        return pa.concat_arrays(out) if out else pa.array([], pa.large_string())


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs with text replaced by the words that remain, and n_words and n_removed."""
    names = docs.columns
    docs = blocks.plain(docs, "doc_id", "text")
    n_blocks, n_buckets = blocks.counts(docs)
    dealt, block = blocks.deal(docs, n_blocks)

    def symbols(found: pa.Table) -> pa.Table:
        names, *_ = Block(found.column("text")).symbols()
        return blocks.table_of(blocks.key_rows(found.column(block)[0].as_py(), names, None, n_buckets), blocks.KEYS_SCHEMA)

    def windows(found: pa.Table, answer: pa.Table) -> pa.Table:
        own = Block(blocks.in_order(found).column("text"))
        names, times, place, low, high = own.symbols()
        shared = blocks.read_bits(answer, names, n_buckets)
        possible = own.possible(shared | (times > 1), place, low, high, window)
        one, two, *_ = own.windows(np.flatnonzero(possible), window)
        k = found.column(block)[0].as_py()
        message = (-1 - k, k, own.seal() + np.packbits(possible).tobytes(), None)
        return blocks.table_of([message, *blocks.key_rows(k, one, two, n_buckets)], blocks.KEYS_SCHEMA)

    def words(found: pa.Table, answer: pa.Table) -> pa.Table:
        found = blocks.in_order(found)
        own = Block(found.column("text"))
        message = next(x for b, x in zip(answer.column("bucket").to_pylist(), answer.column("bits").to_pylist(), strict=True) if b == -1)
        if message[:8] != own.seal():
            raise RuntimeError("a block has other texts than in the pass before; its input doesn't give the same rows when it is read again")
        at = np.flatnonzero(np.unpackbits(np.frombuffer(message, np.uint8)[8:], count=len(own.words)))
        one, _, times, place = own.windows(at, window)
        shared = blocks.read_bits(answer, one, n_buckets)
        at = at[(shared | (times > 1))[place]]
        cover = np.bincount(at, minlength=len(own.words) + window + 1)
        cover -= np.bincount(at + window, minlength=len(cover))[: len(cover)]
        gone = np.cumsum(cover)[: len(own.words)] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = np.diff(total[own.first])
        columns = {c: found.column(c) for c in found.column_names if c != block}
        rest = own.rest(gone)
        columns["text"] = pa.array(np.where(np.asarray(found.column("text").is_null()), None, rest.to_numpy(zero_copy_only=False)), pa.string()) if found.column("text").null_count else rest.cast(found.schema.field("text").type)
        return pa.table(columns | {"n_words": pa.array(own.count, pa.int64()), "n_removed": pa.array(removed, pa.int64())})

    keyed = blocks.mark_shared(dealt.groupBy(block).applyInArrow(symbols, blocks.KEYS), n_buckets, n_blocks)
    grouped = dealt.groupBy(block)
    seen = blocks.mark_shared(grouped.cogroup(keyed.groupBy("block")).applyInArrow(windows, blocks.KEYS), n_buckets, n_blocks)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    rest = dealt.groupBy(block).cogroup(seen.groupBy("block")).applyInArrow(words, schema)
    return rest.toDF(*names, *(blocks.fresh(c, names) for c in ("n_words", "n_removed")))


def digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """What op5 returns: doc_id, n_words, n_removed, kept_sha256."""
    rest = dedup(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), window)
    return rest.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
