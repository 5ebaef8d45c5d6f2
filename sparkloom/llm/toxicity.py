"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities and counts of lexicon words, how near they stand to second-person words, rates of
capitals, punctuation, exclamation marks and obfuscated words, and its length. The lexicon is learnt: words that documents
labelled 1 have far more often than others, after letters are lower-cased, look-alikes such as 1 and $ read as letters, and
other signs dropped. Within training, lexicon, trees and calibration of a row never come from the row's own fold.

Null and empty texts have a score like any other text: that of a document without words. A sample with one label only
gives that label's share as every score.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm import kernels
from sparkloom.llm.labelled import MAX_ROWS, sample

FOLDS, TREES, DEPTH, RATE, BINS, RIDGE = 4, 40, 3, 0.2, 32, 1.0
NEAR = 4
#: Second-person words, and signs that stand for letters.
SECOND_PERSON = "you your yours youre yourself u ur ya tu te toi vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti vosotros"
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

_letter = np.zeros(256, np.uint8)
_letter[65:91] = _letter[97:123] = np.arange(97, 123)
_letter[128:] = np.arange(128, 256)
_plain = _letter > 0
for _a, _b in LOOKALIKES.items():
    _letter[ord(_a)] = ord(_b)
_punctuation = np.zeros(256, bool)
_punctuation[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_capital = np.zeros(256, bool)
_capital[65:91] = True


def within(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many flags are set in each span."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


class Read:
    """A batch of texts as words with normal forms."""

    def __init__(self, texts: pa.Array):
        w = self.words = kernels.Words(texts)
        letters = _letter[w.data]
        # Only a look-alike inside a word stands for a letter; trailing signs are punctuation.
        edge = np.zeros(len(w.data), bool)
        edge[w.end - 1] = True
        keep = (letters > 0) & ~(edge & ~_plain[w.data])
        place = np.zeros(len(keep) + 1, np.int64)
        np.cumsum(keep, out=place[1:])
        start, end = place[w.start], place[w.end]
        self.form = kernels.spans_hash(letters[keep], start, end)
        self.size = end - start
        plain = within(_plain[w.data], w.start, w.end)
        odd = np.zeros(len(w.data), bool)
        odd[1:-1] = ~_plain[w.data[1:-1]] & _plain[w.data[:-2]] & _plain[w.data[2:]]
        self.obfuscated = (within(odd, w.start, w.end) > 0) & (plain > 1)


def forms(words: list[str]) -> np.ndarray:
    return np.sort(Read(pa.array([" ".join(words)])).form)


def member(x: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(x), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, x), len(sorted_set) - 1)] == x


def distinct_words(read: Read) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct normal forms of three letters and more: text and form."""
    long = read.size >= 3
    doc, form = read.words.doc()[long], read.form[long]
    order = np.lexsort((form, doc))
    doc, form = doc[order], form[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (form[1:] != form[:-1])
    return doc[new], form[new]


class WordTable:
    """Which labelled texts have which normal forms."""

    def __init__(self, batches: list[pa.RecordBatch], label: np.ndarray):
        docs, found, at = [], [], 0
        for b in batches:
            doc, form = distinct_words(Read(b.column(0)))
            docs.append((doc + at).astype(np.int32))
            found.append(form)
            at += b.num_rows
        self.doc, self.label = np.concatenate(docs), label > 0
        self.word, place = np.unique(np.concatenate(found), return_inverse=True)
        self.place = place.astype(np.int32)

    def lexicon(self, rows: np.ndarray) -> list[np.ndarray]:
        """Normal forms in two tiers: how strongly a word's presence in a document of these rows speaks for label 1."""
        with_ = np.bincount(self.place[(rows & self.label)[self.doc]], minlength=len(self.word))
        without = np.bincount(self.place[(rows & ~self.label)[self.doc]], minlength=len(self.word))
        p, n = max(1, (rows & self.label).sum()), max(1, (rows & ~self.label).sum())
        lift = np.log((with_ + 0.5) / (p + 1)) - np.log((without + 0.5) / (n + 1))
        often = with_ >= max(3, 0.004 * p)
        return [self.word[often & (lift > np.log(6))], self.word[often & (lift > np.log(2.5)) & (lift <= np.log(6))]]


def features(read: Read, lexicon: list[np.ndarray]) -> np.ndarray:
    w = read.words
    n, size = np.maximum(w.count, 1), np.maximum(np.diff(w.off), 1)
    first, last = w.first[:-1], w.first[1:]
    strong, weak = member(read.form, lexicon[0]), member(read.form, lexicon[1])
    you = member(read.form, _second_person())
    total = np.zeros(len(you) + 1, np.int64)
    np.cumsum(you, out=total[1:])
    at, doc = np.arange(len(you)), w.doc()
    near = strong & (total[np.minimum(at + NEAR + 1, last[doc])] > total[np.maximum(at - NEAR, first[doc])])
    strong_n, weak_n = within(strong, first, last), within(weak, first, last)
    letters = np.maximum(within(_plain[w.data], w.off[:-1], w.off[1:]), 1)
    return np.stack(
        [
            strong_n / n,
            np.minimum(strong_n, 20),
            weak_n / n,
            np.minimum(weak_n, 20),
            within(you, first, last) / n,
            within(near, first, last) / n,
            within(_capital[w.data], w.off[:-1], w.off[1:]) / letters,
            within(_punctuation[w.data], w.off[:-1], w.off[1:]) / size,
            within(w.data == ord("!"), w.off[:-1], w.off[1:]) / size,
            within(read.obfuscated, first, last) / n,
            within(read.obfuscated & strong, first, last) / n,
            np.log1p(w.count),
        ],
        axis=1,
    ).astype(np.float64)


_you: list[np.ndarray] = []


def _second_person() -> np.ndarray:
    if not _you:
        _you.append(forms(SECOND_PERSON.split()))
    return _you[0]


class Boosted:
    """Gradient-boosted trees for a 0/1 label, of fixed depth, on quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        share = np.clip(y.mean(), 0.01, 0.99)
        self.base = np.log(share / (1 - share))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        binned, margin = self.bin(x), np.full(len(y), self.base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree = self.grow(binned, p - y, p * (1 - p))
            self.trees.append(tree)
            margin += self.leaf(tree, binned)

    def bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature and bin of each inner node (a row goes right if its bin is greater), and the leaves' values."""
        feature, cut = np.zeros(2**DEPTH - 1, int), np.full(2**DEPTH - 1, BINS)
        node = np.zeros(len(x), int)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for f in range(x.shape[1]):
                key = (node - first) * (BINS + 1) + x[:, f]
                gs = np.bincount(key, g, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                hs = np.bincount(key, h, width * (BINS + 1)).reshape(width, -1).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < 1) | (ht - hs < 1)] = 0
                at = gain.argmax(axis=1)
                found = gain[np.arange(width), at]
                better = found > best + 1e-9
                best[better] = found[better]
                feature[first : first + width][better], cut[first : first + width][better] = f, at[better]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        at = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(at, g, 2**DEPTH) / (np.bincount(at, h, 2**DEPTH) + RIDGE)
        return feature, cut, value

    @staticmethod
    def leaf(tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node, at = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
        return value[node - (2**DEPTH - 1)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = self.bin(x)
        return self.base + sum(self.leaf(t, binned) for t in self.trees)


class Isotonic:
    """The rising step function nearest to the labels in squares, by pooling neighbours; linear between steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []  # sum of labels, rows, sum of x
        for a, b in zip(x[order], y[order], strict=True):
            pools.append([b, 1, a])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                last = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
        self.x = np.array([p[2] / p[1] for p in pools])
        self.y = np.array([(p[0] + 0.5 * y.mean()) / (p[1] + 0.5) for p in pools])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(x, self.x, self.y), 0, 1)


class Model:
    def __init__(self, texts: list[str], labels: list[int]):
        y = np.array(labels, float)
        self.constant = None
        if len(set(labels)) < 2 or len(y) < 2 * FOLDS:
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        batches = list(kernels.steps(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])])))
        table, fold = WordTable(batches, y), np.arange(len(y)) % FOLDS  # the sample is in the order of a hash
        lexicons, parts, at = [table.lexicon(fold != k) for k in range(FOLDS)], [], 0
        for b in batches:
            read, own = Read(b.column(0)), fold[at : at + b.num_rows]
            at += b.num_rows
            parts.append(np.stack([features(read, x) for x in lexicons])[own, np.arange(len(own))])
        x = np.concatenate(parts)
        held = np.zeros(len(y))
        for k in range(FOLDS):
            held[fold == k] = Boosted(x[fold != k], y[fold != k]).margin(x[fold == k])
        self.lexicon = table.lexicon(np.ones(len(y), bool))
        self.trees = Boosted(x, y)
        self.calibrate = Isotonic(held, y)

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return self.calibrate(self.trees.margin(features(Read(texts), self.lexicon)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> Model:
    """A model of at most max_rows labelled rows."""
    return Model(*sample(docs, labels, label, max_rows))


def score(docs: DataFrame, model, *keep: Column | str) -> DataFrame:
    """The columns `keep` and score of each text, by any model with score(texts). No exchange."""
    out = docs.select(*keep, F.col("text").alias("text"))
    names = [c for c in out.columns if c != "text"]
    shared = out.sparkSession.sparkContext.broadcast(model)  # its size doesn't depend on the number of documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernels.steps(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(shared.value.score(batch.column("text")))], [*names, "score"])

    return out.mapInArrow(run, T.StructType([*(f for f in out.schema if f.name != "text"), T.StructField("score", T.DoubleType())]))
