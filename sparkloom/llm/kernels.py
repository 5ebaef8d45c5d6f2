"""Array kernels that the operators share: Arrow texts as flat bytes, words, hashes.

Hashes are 64-bit unless said otherwise. They name words, shingles and windows the same way everywhere, so no
dictionary is exchanged. A word's hash adds up one random number for each byte and place; a run's is made of its parts' hashes and
scrambled at each step. Neither is a polynomial, whose sums cancel out for some texts whatever the base. The chance that
two different things share a name is about pairs / 2^64; nothing keeps an adversary who knows the random numbers from making such a pair.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Text bytes that one step of a kernel works on; a longer text is one step of its own.
STEP_BYTES = 1 << 18

#: Places of a word that have random numbers of their own; those of later places are made from them.
PLACES = 64
_random = np.random.default_rng(20240229)
_of_byte = _random.integers(0, 2**64, (2, 256 * PLACES), np.uint64)
_odd = _random.integers(0, 2**63, (2, 3), np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of the bytes data[start:end] for each span. Spans are in order and don't overlap."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = int(start[0])
    cut = np.searchsorted(start, np.arange(first, int(start[-1]) + 1, 4 * STEP_BYTES))
    if len(cut) > 1:  # a long text: some megabytes at a time, as there are many bytes of numbers for one of text
        return np.concatenate([spans_hash(data, start[a:b], end[a:b], lane) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(start)], strict=True)])
    data = data[first : int(end[-1])]
    place = np.arange(len(data), dtype=np.int32)
    place -= np.repeat((start - first).astype(np.int32), np.diff(np.append(start, first + len(data))))
    far = np.flatnonzero(place >= PLACES)
    later = place[far] // PLACES
    place[far] %= PLACES
    place += data.astype(np.int32) * PLACES
    values = _of_byte[lane].take(place)
    values[far] = mix(values[far] + later.astype(np.uint64) * _odd[lane, 0])
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mix(total[end - first] - total[start - first] + (end - start).astype(np.uint64) * _odd[lane, 1])


def runs_hash(values: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """A hash of each run of `size` values, by doubling: of neighbouring runs' hashes."""
    n = len(values) - size + 1
    if n <= 0 or size < 1:
        return np.zeros(0, np.uint64)
    out, at, width, part = None, 0, 1, values
    while True:
        if size & width:
            own = part[at : at + n]
            out = own if out is None else mix(out * _odd[lane, 2] + own)
            at += width
        if 2 * width > size:
            return out
        part = mix(part[:-width] * _odd[lane, 2] + part[width:])
        width *= 2


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each begins and ends. Null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw, off - off[0]


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `limit` text bytes, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)
        end, at = np.cumsum(size), 0
        while at < len(size):
            done = end[at] - size[at]
            stop = max(at + 1, int(np.searchsorted(end, done + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts: byte spans, and the first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.off = flat(texts)
        if lower:
            self.data = LOWER[self.data]
        space = SPACE[self.data]
        edge = np.ones(len(space) + 1, bool)
        edge[1:] = np.append(space, True)[:-1]  # a word can begin here: the byte before is a space
        edge[self.off] = True
        self.start = np.flatnonzero(~space & edge[:-1])
        edge[:-1] = space
        edge[self.off] = True
        edge[-1] = True
        self.end = np.flatnonzero(~space & edge[1:]) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return spans_hash(self.data, self.start, self.end, lane)


class HashTable:
    """The places of different numbers from 0 on in an array, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(2 * len(keys)).bit_length()))
        self.keys = np.full(1 << int(64 - int(self.shift)), -1, np.int64)
        self.rows = np.zeros(len(self.keys), np.int32)
        left, slot = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[left[free]]  # of several for one slot, the last one stays
            done = self.keys[slot] == keys[left]
            self.rows[slot[done]] = left[done]
            left, slot = left[~done], (slot[~done] + 1) & (len(self.keys) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self.slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.rows[slot], -1)
        left = np.flatnonzero((have != keys) & (have >= 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            have = self.keys[slot]
            found = have == keys[left]
            out[left[found]] = self.rows[slot[found]]
            on = ~found & (have >= 0)
            left, slot = left[on], slot[on]
        return out


def lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    """Each values[off[i]:off[i+1]] as the bytes of row i."""
    raw = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64) * raw.itemsize), pa.py_buffer(raw)])


def rows(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the given columns in the schema's order and types."""
    return pa.RecordBatch.from_arrays([(c if isinstance(c, pa.Array) else pa.array(c)).cast(schema.field(k).type) for k, c in ((f.name, columns[f.name]) for f in schema)], schema=schema)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)
