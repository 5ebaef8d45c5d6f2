"""Quality: random-indexing word vectors pooled per document, and a two-layer network with a calibrated temperature.

Each word has two names: its hash, folded into a fixed number of slots, and its shape (cases, digits, signs, a repeated
word, length). Each name has a sparse random index vector; a name's word vector is the sum of the index vectors of its neighbours
over all documents, scaled to length one. A document is the mean vector of its words and of their shapes. The
vectors are fitted on all texts; the sums have a fixed size whatever the corpus. The network is trained on a bounded sample of
labelled rows, and its temperature on those held out from it.

Null and empty texts are documents of the mean vector zero. A sample with one label only gives that label's share as
every score.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm import kernels, sums
from sparkloom.llm.labelled import MAX_ROWS, sample

SLOTS, SHAPES, DIM, NONZERO = 1 << 13, 1 << 8, 32, 2
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.02, 1e-3
#: Parts that the sums are cut into, each added up by itself.
PARTS = 16

_names = SLOTS + SHAPES
_rng = np.random.default_rng(7)
INDEX_AT = _rng.integers(0, DIM, (_names, NONZERO))
INDEX_SIGN = _rng.choice([-1.0, 1.0], (_names, NONZERO))

_class = np.full(256, 8, np.uint8)  # signs
_class[97:123] = _class[128:] = 1
_class[65:91] = 2
_class[48:58] = 4


def names(texts: pa.Array) -> tuple[kernels.Words, np.ndarray, np.ndarray]:
    """The words of the texts, and the slot and the shape of each."""
    w = kernels.Words(texts)
    h = w.hashes()
    if not len(h):
        return w, np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _class[w.data]
    has = np.bitwise_or.reduceat(kind, w.start)  # spaces between words count as signs, so signs are looked at on their own
    signs = np.zeros(len(kind) + 1, np.int32)
    np.cumsum((kind == 8) & ~kernels.SPACE[w.data], out=signs[1:])
    n_signs = signs[w.end] - signs[w.start]
    shape = (has & 7).astype(np.int64)
    shape |= np.minimum(n_signs, 3) << 3
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[w.first[:-1][w.count > 0]] = False
    shape |= same.astype(np.int64) << 5
    shape |= (w.end - w.start > 20).astype(np.int64) << 6
    shape |= (w.end - w.start == 1).astype(np.int64) << 7
    return w, (h & np.uint64(SLOTS - 1)).astype(np.int64), shape + SLOTS


def neighbour_sums(texts: pa.Array) -> np.ndarray:
    """For each name, the sum of the index vectors of the names of the words just before and after."""
    w, slot, shape = names(texts)
    out = np.zeros(_names * DIM)
    if len(slot) < 2:
        return out
    doc = w.doc()
    joined = np.flatnonzero(doc[1:] == doc[:-1])
    for own in (slot, shape):
        for other in (slot, shape):
            for a, b in ((joined, joined + 1), (joined + 1, joined)):
                for k in range(NONZERO):
                    out += np.bincount(own[a] * DIM + INDEX_AT[other[b], k], INDEX_SIGN[other[b], k], len(out))
    return out


def fit_vectors(docs: DataFrame) -> np.ndarray:
    """The word vectors of all names from all texts. Each task sends sums of a fixed size."""

    def add(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(_names * DIM)
        for batch in kernels.steps(batches):
            total += neighbour_sums(batch.column("text"))
        return total

    flat = sums.over_tasks(docs.select("text"), add, PARTS, np.float32)
    if not len(flat):
        flat = np.zeros(_names * DIM)
    vectors = flat.reshape(_names, DIM)
    return (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)


class Model:
    def __init__(self, vectors: np.ndarray, texts: list[str], labels: list[int]):
        self.vectors, self.constant = vectors, None
        y = np.array(labels, float)
        if len(set(labels)) < 2 or len(y) < 10:
            self.constant = float(y.mean()) if len(y) else 0.0
            return
        x = np.concatenate([self.pool(b.column(0)) for b in kernels.steps(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])]))])
        held = np.arange(len(y)) % 5 == 0  # the sample is in the order of a hash
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        x = (x - self.mean) / self.scale
        self.fit(x[~held], y[~held])
        z = self.logit(x[held])
        grid = np.geomspace(0.3, 6, 40)
        self.temperature = 1.0
        loss = [np.mean(np.logaddexp(0, z / t) - y[held] * z / t) for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def pool(self, texts: pa.Array) -> np.ndarray:
        """The mean vector of the words and that of their shapes, for each text."""
        w, slot, shape = names(texts)
        out = np.zeros((len(texts), 2 * DIM), np.float32)
        some = w.count > 0
        if some.any():
            for k, own in enumerate((slot, shape)):
                out[some, k * DIM : (k + 1) * DIM] = np.add.reduceat(self.vectors[own], w.first[:-1][some], axis=0) / w.count[some, None]
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)
        params = [self.w1, self.b1, self.w2, self.b2]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, EPOCHS + 1):
            hidden = np.tanh(x @ self.w1 + self.b1)
            d = (1 / (1 + np.exp(-(hidden @ self.w2 + self.b2))) - y) / len(y)
            back = np.outer(d, self.w2) * (1 - hidden**2)
            grads = [x.T @ back + DECAY * self.w1, back.sum(axis=0), hidden.T @ d + DECAY * self.w2, np.array([d.sum()])]
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit((self.pool(texts) - self.mean) / self.scale) / self.temperature, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Vectors of all of docs, and a network of at most max_rows labelled rows."""
    return Model(fit_vectors(docs), *sample(docs, labels, label, max_rows))
