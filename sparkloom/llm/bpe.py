"""Byte-level BPE encoding by overlapping chunks, and decoding by concatenating raw bytes.

A text is cut into chunks of `CHUNK` characters that overlap by `OVERLAP`; most texts are one chunk. Chunks are rows of their own,
dealt over all tasks: each is pre-tokenised from its own begin, whatever the others hold, and its pre-tokens are merged by the ranks, lowest
first. Then a text's chunks meet again. The pattern only looks forward, so where two neighbours have a pre-token boundary in
common within their overlap, the right one's pre-tokens hold from there on: the left one's ids up to there and the right one's from there on
are the text's. Where they have none, the left chunk is read on through the right one, then through twice as many, so a text
without a boundary is still read in linear time.

Texts of one chunk have no seam and need no exchange; the ids of a longer one meet in one row, as its ids are one value of the result. The
pattern must match every character, and a boundary must be settled by the two pre-tokens behind it.

Null and empty texts have no ids. Rows are handled one by one: repeated rows give repeated results. An input whose plan has an exchange is
written to the shared folder first, as rows of long texts are known by their place.
"""

import base64
import functools
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import islice, pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import blocks, kernels

CHUNK, OVERLAP = 1 << 16, 1 << 8
#: Pre-tokens whose ids a worker keeps at most, and their characters at most; pieces of more bytes are merged with a heap.
KNOWN, KNOWN_CHARS, SHORT = 1 << 19, 64, 48
IDS_SCHEMA = "doc_id bigint, ids binary"
#: In place of a rank: of two parts that have none together, and of a pre-token's last part.
NO_RANK, LAST = 1 << 30, (1 << 30) + 1


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Read(NamedTuple):
    """A chunk's ids, and, by the places of the boundaries in the overlaps at its begin and behind its end, how many bytes of ids precede them."""

    begin: int
    ids: bytes
    left: dict[int, int]
    right: dict[int, int]


class Codec:
    """Encodes texts and decodes ids by one rank file and one pre-token pattern. Ids are bytes: of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.ranks = read_ranks(path)
        self.pattern, self.chunk, self.overlap = regex.compile(pattern), chunk, overlap
        self.known: dict[str, bytes] = {}
        self.raw: list[bytes] = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.raw[rank] = token
        self.of_byte = np.array([self.ranks.get(bytes([k]), -1) for k in range(256)], np.int64)
        # Every way to make a token of two others, and its rank.
        get, found = self.ranks.get, []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := get(token[:k])) is not None and (b := get(token[k:])) is not None:
                    found.append((a << 32 | b, rank))
        pairs, self.pair_rank = np.array(found or [(0, 0)], np.int64)[: len(found)].T
        self.pairs = kernels.HashTable(pairs)
        self.pair_rank = np.append(self.pair_rank, NO_RANK)

    def boundaries(self, text: str, begin: int, end: int) -> list[int]:
        """Where pre-tokens of text[begin:end] begin, as if nothing followed."""
        return [m.start() for m in self.pattern.finditer(text, begin, end)]

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens: of the neighbours whose union has the lowest rank, the first ones are merged, until none has a rank. One merge in each at a time."""
        out = [None if (x := self.ranks.get(p)) is None else x.to_bytes(4, "little") for p in pieces]
        todo = [k for k, x in enumerate(out) if x is None]
        for k in todo:
            if len(pieces[k]) > SHORT:
                out[k] = self.merge_long(pieces[k])
        todo = np.array([k for k in todo if out[k] is None and pieces[k]], np.int64)
        for k in np.flatnonzero([x is None for x in out]).tolist():
            out[k] = b""
        part = self.of_byte[np.frombuffer(b"".join(pieces[k] for k in todo.tolist()), np.uint8)]
        if (part < 0).any():
            raise KeyError("a byte has no rank")
        first = np.concatenate([[0], np.cumsum([len(pieces[k]) for k in todo.tolist()], dtype=np.int64)])
        union = self.unions(part, np.append(part[1:], -1))  # of each part and the next one
        union[first[1:] - 1] = LAST
        while len(todo):
            low = np.minimum.reduceat(union << 32 | np.arange(len(union)), first[:-1])  # the lowest rank, and its first place
            done = np.flatnonzero(low >> 32 >= NO_RANK)
            if len(done):
                raw = part.astype("<u4").tobytes()
                for k, a, b in zip(todo[done].tolist(), (4 * first[done]).tolist(), (4 * first[done + 1]).tolist(), strict=True):
                    out[k] = raw[a:b]
                on = np.ones(len(todo), bool)
                on[done] = False
                size = np.diff(first)
                stay = np.repeat(on, size)
                moved = np.cumsum(stay) - 1
                part, union, todo, low = part[stay], union[stay], todo[on], low[on]
                at = moved[low & 0xFFFFFFFF]
                first = np.concatenate([[0], np.cumsum(size[on])])
                if not len(todo):
                    break
            else:
                at = low & 0xFFFFFFFF
            part[at] = low >> 32  # an id is a rank
            stay = np.ones(len(part), bool)
            stay[at + 1] = False
            union[at] = union[at + 1]  # LAST where the part that went was the last
            at -= np.arange(len(at))  # one part of each piece before goes too
            part, union = part[stay], union[stay]
            first = first - np.arange(len(first))
            inner = at[union[at] < LAST]
            union[inner] = self.unions(part[inner], part[inner + 1])
            inner = at[at > first[:-1]]
            union[inner - 1] = self.unions(part[inner - 1], part[inner])
        return out

    def unions(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of two parts together, or NO_RANK."""
        row = self.pairs.find(left << 32 | right & 0xFFFFFFFF)
        return np.where(row < 0, NO_RANK, self.pair_rank[row])

    def merge_long(self, piece: bytes) -> bytes:
        """The same for a long piece: the unions wait in a heap, by rank and place."""
        get, n = self.ranks.get, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at each place; end 0: no part does
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := get(piece[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, k, stop = heapq.heappop(heap)
            middle = end[k]
            if not middle or middle >= stop or end[middle] != stop:
                continue  # one of its parts has grown since
            end[k], end[middle] = stop, 0
            if stop < n:
                before[stop] = k
                if (r := get(piece[k : end[stop]])) is not None:
                    heapq.heappush(heap, (r, k, end[stop]))
            if k and (r := get(piece[before[k] : stop])) is not None:
                heapq.heappush(heap, (r, before[k], stop))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[piece[k : end[k]]])
            k = end[k]
        return np.array(out, "<u4").tobytes()

    def ids_of(self, texts: list[list[str]]) -> list[list[bytes]]:
        """The ids of the pre-tokens of several texts. What they have in common is merged once."""
        own = {t: self.known.get(t) for t in set().union(*texts)}  # far fewer than known, so looked up faster
        new = [t for t, x in own.items() if x is None]
        if new:
            learnt = dict(zip(new, self.merge([t.encode() for t in new]), strict=True))
            own |= learnt
            if len(self.known) + len(learnt) > KNOWN:
                self.known.clear()
            self.known.update(x for x in islice(learnt.items(), KNOWN) if len(x[0]) <= KNOWN_CHARS)
        return [list(map(own.__getitem__, tokens)) for tokens in texts]

    def read(self, text: str, begin: int, end: int, offset: int = 0) -> Read:
        """The chunk text[begin:end] with its overlap, pre-tokenised from its own begin. offset: the place of `text` in the whole text."""
        stop = min(len(text), end + self.overlap)
        starts = self.boundaries(text, begin, stop)
        ids = self.ids_of([[text[a:b] for a, b in pairwise([*starts, stop])]])[0]
        place, before = np.array(starts, np.int64), np.concatenate([[0], np.cumsum(list(map(len, ids)), dtype=np.int64)])
        left = np.flatnonzero(place < begin + self.overlap)
        right = np.flatnonzero(place >= end)
        right = right[right < len(place) - 2]  # the last two might be others in view of the text behind them
        near = lambda at: dict(zip((place[at] + offset).tolist(), before[at].tolist(), strict=True))
        return Read(begin + offset, b"".join(ids), near(left), near(right))

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text."""
        if len(text) <= self.chunk:
            return np.frombuffer(self.encode_all([text])[0], "<u4")
        chunks = [self.read(text, a, min(a + self.chunk, len(text))) for a in range(0, len(text), self.chunk)]
        return np.frombuffer(self.stitch(chunks, lambda: text), "<u4")

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of one chunk each."""
        split = self.pattern.findall if not self.pattern.groups else lambda t: [m.group() for m in self.pattern.finditer(t)]
        return list(map(b"".join, self.ids_of(list(map(split, texts)))))

    def stitch(self, chunks: list[Read], whole: Callable[[], str]) -> bytes:
        """The ids of a text from those of its chunks. whole: gives the text, which is asked for only where neighbours have no boundary in common."""
        out, k, at, text = [], 0, 0, None
        own, since = chunks[0], 0  # what is read now, and which of its ids are the first to be taken
        step = 1
        while k + step < len(chunks):
            right = chunks[k + step]
            common = next((p for p in own.right if p in right.left), None)
            if common is None:
                text = whole() if text is None else text
                step *= 2
                if k + step < len(chunks):
                    own, since = self.read(text, at, chunks[k + step].begin), 0
                continue
            out.append(own.ids[since : own.right[common]])
            k, at, own, since, step = k + step, common, right, right.left[common], 1
        if step > 1:
            own, since = self.read(text, at, len(text)), 0
        return b"".join([*out, own.ids[since:]])

    def decode(self, ids: bytes | np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(2)
def codec(path: str, pattern: str, chunk: int, overlap: int) -> Codec:
    return Codec(path, pattern, chunk, overlap)


Finish = Callable[[Codec, pa.Array, list[bytes]], pa.RecordBatch]


def encoded(docs: DataFrame, path: str, pattern: str, schema: str, finish: Finish) -> DataFrame:
    """Rows of schema that `finish` makes of doc_id and ids of some texts."""
    chunk, overlap = CHUNK, OVERLAP
    own_codec = lambda: codec(path, pattern, chunk, overlap)
    docs = blocks.replayable(docs).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = own_codec()
        for batch in kernels.steps(batches):
            yield finish(own, batch.column("doc_id"), own.encode_all([x or "" for x in batch.column("text").to_pylist()]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk: the text's row, the chunk's place, and its text with the overlap."""
        for batch in kernels.steps(batches):
            for row, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                begins = range(0, len(text), chunk)
                for first in range(0, len(begins), 64):
                    part = begins[first : first + 64]
                    pieces = [text[a : a + chunk + overlap] for a in part]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(part)), pa.array([doc_id] * len(part), pa.int64()), pa.array(part, pa.int64()), pa.array(pieces, pa.string())], ["row", "doc_id", "begin", "text"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The ids of each chunk, and its boundaries in the overlaps, as pairs of a place and a number of bytes."""
        own = own_codec()
        ends = lambda near: np.array([*near.items()], "<i8").tobytes()
        for batch in kernels.steps(batches):
            found = [own.read(t, 0, min(chunk, len(t)), a) for a, t in zip(batch.column("begin").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            columns = [[x.ids for x in found], [ends(x.left) for x in found], [ends(x.right) for x in found]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.binary()) for c in columns)], [*batch.schema.names, "ids", "left", "right"])

    def join(found: pa.Table) -> pa.Table:
        own, found = own_codec(), found.sort_by("begin")
        near = lambda x: dict(np.frombuffer(x, "<i8").reshape(-1, 2).tolist())
        chunks = [Read(a, i, near(x), near(y)) for a, i, x, y in zip(*(found.column(c).to_pylist() for c in ("begin", "ids", "left", "right")), strict=True)]
        ids = own.stitch(chunks, lambda: "".join(t[:chunk] for t in found.column("text").to_pylist()))
        return pa.Table.from_batches([finish(own, found.column("doc_id").chunk(0)[:1], [ids])])

    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    rows = docs.where(long).withColumn("row", F.monotonically_increasing_id())
    chunks = rows.mapInArrow(cut, "row bigint, doc_id bigint, begin bigint, text string").repartition("row", "begin")
    stitched = chunks.mapInArrow(read, "row bigint, doc_id bigint, begin bigint, text string, ids binary, left binary, right binary").groupBy("row").applyInArrow(join, schema)
    return docs.where(~long).mapInArrow(whole, schema).unionAll(stitched)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the ids of each text as little-endian unsigned 32-bit integers."""

    def finish(own: Codec, doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_id, pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return encoded(docs, path, pattern, IDS_SCHEMA, finish)


def decode(stored: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and the bytes that the ids of each row stand for. No exchange. Null ids count as none."""
    chunk, overlap = CHUNK, OVERLAP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, chunk, overlap)
        for batch in batches:
            raw = [own.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return stored.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, raw binary")


def digests(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids: each text encoded, and its ids decoded again."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * keep_ids]

    def finish(own: Codec, doc_id: pa.Array, ids: list[bytes]) -> pa.RecordBatch:
        columns = [
            doc_id,
            pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string()),
        ]
        return pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * keep_ids], names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return encoded(docs, path, pattern, schema, finish)
