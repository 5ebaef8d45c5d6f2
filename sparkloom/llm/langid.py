"""Language identification by prediction by partial matching over bytes.

Each language has a context tree of orders 0 to 3 over A-Z-lower-cased bytes. A byte seen behind its context costs
-log2(n / (N + D)) bits, where N bytes of D kinds were seen there; one not seen costs the escape, -log2(D / (N + D)),
and is looked for in the next shorter context; at order -1 all 256 bytes cost 8 bits. A context never seen costs nothing
to leave. The counts are frozen after training, so a text's exact code length is a sum over its bytes (the first
three of which have shorter contexts). The language of the shortest code wins; equal lengths go to the first name.

Training takes whole texts of at most `per_language` documents of each language, those of the smallest hash of their
id, and at most `TEXT_BYTES` over all languages, of which each has the same share: documented bounds. Scoring takes whole texts of all rows.

Null texts and those without a letter are `und` with score 0. With no training row at all, every text is `und`.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import kernels
from sparkloom.llm.labelled import fitting, lowest

PER_LANGUAGE = 600
#: Bytes of training texts of all languages together; the tables are in proportion to the different runs that these have.
TEXT_BYTES = 32 << 20
UNKNOWN = "und"
ORDER = 3
#: Bits of a byte in no context.
UNSEEN = 8.0


class Trees:
    """The frozen trees of all languages, as tables of bits.

    Bytes outside the training texts share one class, 0; runs of bytes are numbers to the base of the classes. `at[k]` has the row
    of each run of k + 1 <= ORDER bytes, 0 if no language has it. `bits[k]` has what the last byte of such a run costs behind
    the others, and `leave[k]` the escape behind a run of k bytes, for each language. Runs of ORDER + 1 bytes are in a hash table;
    only languages that have such a run have an entry for it: what it costs less there than by way of the shorter context.
    """

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        streams = [[kernels.LOWER[np.frombuffer(t.encode(), np.uint8)] for t in texts[x]] for x in self.languages]
        seen = np.zeros(256, bool)
        for s in streams:
            for t in s:
                seen[t] = True
        self.kind = np.where(seen, np.cumsum(seen), 0).astype(np.int32)
        self.size = a = int(seen.sum()) + 1
        n = len(streams)
        self.at: list[np.ndarray] = []
        self.bits: list[np.ndarray] = []
        self.leave: list[np.ndarray] = []
        for k in range(ORDER + 1):
            grams = [self.runs(s, k + 1) for s in streams]
            every = np.unique(np.concatenate([g[0] for g in grams] or [np.zeros(0, np.int64)]))
            context = self.at[k - 1][every // a] if k else np.zeros(len(every), np.int64)
            leave = np.zeros((len(self.bits[k - 1]) if k else 1, n), np.float32)
            costs = []
            for j, (keys, often) in enumerate(grams):
                own = context[np.searchsorted(every, keys)]
                total, kinds = np.bincount(own, often, len(leave)), np.bincount(own, minlength=len(leave))
                leave[:, j] = np.where(kinds > 0, np.log2(np.maximum(total + kinds, 1)) - np.log2(np.maximum(kinds, 1)), 0)
                costs.append(np.log2(total[own] + kinds[own]) - np.log2(often))
            self.leave.append(leave)
            if k < ORDER:
                at = np.zeros(a ** (k + 1), np.int32)
                at[every] = np.arange(1, len(every) + 1)
                bits = np.zeros((len(every) + 1, n), np.float32)
                bits[1:] = leave[context] + (self.cost(k - 1, every % a**k) if k else np.float32(UNSEEN))
                for j, (keys, _) in enumerate(grams):
                    bits[at[keys], j] = costs[j]
                self.at.append(at)
                self.bits.append(bits)
        # Of the longest runs: the entries of each, one behind the other.
        run = np.concatenate([np.searchsorted(every, keys) for keys, _ in grams] or [np.zeros(0, np.int64)])
        language = np.repeat(np.arange(n), [len(keys) for keys, _ in grams])
        less = np.concatenate(costs or [np.zeros(0)]) - (leave[context[run], language] + self.cost(ORDER - 1, every[run] % a**ORDER)[np.arange(len(run)), language])
        order = np.lexsort((language, run))
        self.entry_language, self.entry_less = language[order].astype(np.int32), less[order].astype(np.float32)
        self.entries = np.searchsorted(run[order], np.arange(len(every) + 1)).astype(np.int32)
        self.table = kernels.HashTable(every)
        self.both = self.bits[ORDER - 1] + self.leave[ORDER]

    def cost(self, k: int, run: np.ndarray) -> np.ndarray:
        """Runs x languages: the bits of the last byte of each run of k + 1 bytes behind the others."""
        row = self.at[k][run]
        out = self.bits[k][row]
        new = np.flatnonzero(row == 0)
        if len(new):
            run = run[new]
            context = self.at[k - 1][run // self.size] if k else 0
            out[new] = self.leave[k][context] + (self.cost(k - 1, run % self.size**k) if k else np.float32(UNSEEN))
        return out

    def runs(self, stream: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """The runs of k bytes within the texts, as numbers, and how often each occurs."""
        found = []
        for t in stream:
            c = self.kind[t].astype(np.int64)
            if len(c) >= k:
                key = np.zeros(len(c) - k + 1, np.int64)
                for i in range(k):
                    key = key * self.size + c[i : len(c) - k + 1 + i]
                found.append(key)
        return np.unique(np.concatenate(found or [np.zeros(0, np.int64)]), return_counts=True)

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """The code length in bits of each text by each language."""
        n, a, count = len(data), self.size, np.diff(off)
        out = np.zeros((len(off) - 1, len(self.languages)))
        some = np.flatnonzero(count)
        if not len(some):
            return out
        c = self.kind[kernels.LOWER[data]]  # runs of ORDER bytes fit into 32 bits
        runs = [c]  # at each byte, the run that ends there; wrong where it would begin before the text
        for k in range(1, ORDER):
            longer = runs[-1].copy()
            longer[k:] += c[:-k] * a**k
            runs.append(longer)
        # A byte behind ORDER others costs the escape from those and what the shorter run costs; so each run of ORDER bytes has a cost of its
        # own and, but for a text's last one, an escape behind it.
        row = self.at[ORDER - 1][runs[-1]]
        place = np.minimum(np.arange(n) - np.repeat(off[:-1], count), ORDER)
        bits = self.both[row]
        last = off[1:][some] - 1
        bits[last] = self.bits[ORDER - 1][row[last]]
        new = np.flatnonzero((row == 0) & (place >= ORDER - 1))
        bits[new] = self.cost(ORDER - 1, runs[-1][new])
        for k in range(ORDER - 1):
            at = np.flatnonzero(place == k)
            bits[at] = self.cost(k, runs[k][at])
        out[some] = np.add.reduceat(bits, off[:-1][some], axis=0, dtype=np.float64)
        full = np.flatnonzero(place == ORDER)
        row = self.table.find(runs[-1][full - 1].astype(np.int64) * a + c[full])
        full, row = full[row >= 0], row[row >= 0]
        many = self.entries[row + 1] - self.entries[row]
        entry = np.repeat(self.entries[row] - np.cumsum(many) + many, many) + np.arange(many.sum())
        doc = np.repeat(np.repeat(np.arange(len(count)), count)[full], many)
        out += np.bincount(doc * out.shape[1] + self.entry_language[entry], self.entry_less[entry], out.size).reshape(out.shape)
        return out


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, text_bytes: int = TEXT_BYTES) -> Trees:
    """Trees from doc_id, text, lang. Takes at most per_language texts of each language, in the order of a hash. Rows that are alike count once."""
    usable = labelled.where("lang is not null and text is not null")
    keyed = usable.select("lang", F.xxhash64("doc_id").alias("order"), F.xxhash64("text").alias("doc_id"), F.octet_length("text").alias("bytes"))  # the text's hash for the id
    sizes = lowest(keyed, per_language, "lang").select("lang", "order", F.col("doc_id").alias("tie"), "bytes").distinct().collect()  # per_language rows of each language
    by_language: dict[str, list] = {}
    for r in sorted(map(tuple, sizes)):
        by_language.setdefault(r[0], []).append(r)
    taken = [r[:3] for rows in by_language.values() for r, fits in zip(rows, fitting([r[3] for r in rows], text_bytes // len(by_language)), strict=True) if fits]
    if not taken:
        return Trees({})
    keys = ["lang", "order", "tie"]
    chosen = labelled.sparkSession.createDataFrame(taken, "lang string, order bigint, tie bigint")
    texts = usable.select("lang", F.xxhash64("doc_id").alias("order"), F.xxhash64("text").alias("tie"), "text").join(F.broadcast(chosen), keys, "left_semi")
    kept: dict[str, list[str]] = {}
    for r in sorted(map(tuple, texts.groupBy(keys).agg(F.first("text").alias("text")).collect())):
        kept.setdefault(r[0], []).append(r[3])
    return Trees(kept)


def has_letter(texts: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))


def predict(docs: DataFrame, trees: Trees, *keep: Column | str) -> DataFrame:
    """doc_id, the columns `keep`, lang_pred and score (the winner's share of the codes' probability). No exchange."""
    out = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *keep, "text")
    names = [c for c in out.columns if c != "text"]
    context = out.sparkSession.sparkContext.broadcast(trees)  # its size is bounded by the training texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = context.value
        for batch in kernels.steps(batches, limit=min(kernels.STEP_BYTES, (4 << 20) // max(1, len(own.languages)))):
            texts = batch.column("text")
            letters = has_letter(texts) & bool(own.languages)
            name, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if letters.any():
                bits = own.lengths(*kernels.flat(texts))
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000)).sum(axis=1)
                name[letters], score[letters] = np.array(own.languages, object)[best[letters]], share[letters]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(name, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in out.schema if f.name != "text"]
    return out.mapInArrow(run, ", ".join([*kinds, "lang_pred string", "score double"]))
