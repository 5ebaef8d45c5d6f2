"""Documents in blocks of bounded size, and keys that more than one place has.

A block is a few megabytes of whole documents, dealt by a hash, so neither a hot source nor a group of copies, nor rows that are
equal in all columns, gather in one. Blocks send their keys, each once, to buckets of the key space; a bucket sees each key at most
once per block, and it answers each block with one bit a key.

Within a block, rows come in whatever order they are fetched, and in another one when a pass or a task is run again. Passes that
refer to each other by place put them in order first (`in_order`).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.graph import stash

#: Text bytes of a block, and text bytes whose keys go to one bucket, about.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 12 << 20
#: Partitions of an exchange at most; beyond, a partition holds several blocks or buckets, one after the other.
MOST_TASKS = 50_000
#: Blocks whose keys for a bucket meet in one task.
SLICE = 1 << 13
KEYS = "bucket int, block int, keys binary, more binary"
BITS = "block int, bucket int, bits binary"


def fresh(name: str, taken: list[str]) -> str:
    """`name`, with underscores behind it until no column is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def columns(names: list[str]) -> list[Column]:
    """The columns of these names, whatever signs are in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def plain(docs: DataFrame, *kept: str) -> DataFrame:
    """docs with its columns called c0, c1 and so on, but for those kept: Python functions over tables can't take names with all signs."""
    return docs.toDF(*(n if n in kept else f"c{k}" for k, n in enumerate(docs.columns)))


def counts(docs: DataFrame) -> tuple[int, int]:
    """Numbers of blocks and buckets for these documents, from the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // BLOCK_BYTES)), max(1, -(-total // BUCKET_BYTES))


def tasks(n: int) -> int:
    return min(n, MOST_TASKS)


def replayable(docs: DataFrame) -> DataFrame:
    """docs, or, where its plan has an exchange, a table of it: scans give their rows in the same order whenever they are run again."""
    return stash(docs) if "Exchange" in docs._jdf.queryExecution().executedPlan().toString() else docs


def deal(docs: DataFrame, n_blocks: int) -> tuple[DataFrame, str]:
    """docs with a column for the block, in one exchange, and that column's name. Rows are salted by their place, so equal ones part."""
    block = fresh("block", docs.columns)
    dealt = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n_blocks)).cast("int")
    return replayable(docs).withColumn(block, dealt).repartition(tasks(n_blocks), block), block


def in_order(found: pa.Table) -> pa.Table:
    """The rows of a block in the order of their texts: the same sequence of texts in each pass. Rows of equal texts may change places."""
    return found.take(pc.sort_indices(found.column("text")))


def bucket_slices(keys: np.ndarray, n_buckets: int) -> Iterator[tuple[int, slice]]:
    """The part of sorted keys that each bucket gets, for the buckets that get any."""
    own = (keys >> np.uint64(32)).astype(np.int64) * n_buckets >> 32
    cut = np.flatnonzero(own[1:] != own[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(own)], strict=True):
        if b > a:
            yield int(own[a]), slice(a, b)


def key_rows(block: int, keys: np.ndarray, more: np.ndarray | None, n_buckets: int) -> list[tuple]:
    """Rows of KEYS for sorted keys without repeats; more: a second half of each key, or None."""
    return [(b, block, keys[s].tobytes(), None if more is None else more[s].tobytes()) for b, s in bucket_slices(keys, n_buckets)]


def table_of(found: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in found], f.type) for k, f in enumerate(schema)], schema=schema)


KEYS_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("more", pa.binary())])
BITS_SCHEMA = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())])


class Keys:
    """The keys of several rows of KEYS, in order, and which of them are the first of equal ones."""

    def __init__(self, found: pa.Table):
        parts = [np.frombuffer(x, np.uint64) for x in found.column("keys").to_pylist()]
        self.cut, self.keys = np.cumsum([len(p) for p in parts])[:-1], np.concatenate(parts)
        self.more = None if found.column("more").null_count else np.concatenate([np.frombuffer(x, np.uint64) for x in found.column("more").to_pylist()])
        self.order = np.argsort(self.keys) if self.more is None else np.lexsort((self.more, self.keys))
        self.new = np.ones(len(self.keys), bool)
        for half in [self.keys] if self.more is None else [self.keys, self.more]:
            own = half[self.order]
            self.new[1:] &= own[1:] == own[:-1]
        self.new[1:] = ~self.new[1:]

    def shared(self, above: np.ndarray | None) -> list[np.ndarray]:
        """For each row, which of its keys another row has, or, if given, of which a bit is set: above has one for each different key."""
        place = np.cumsum(self.new) - 1
        several = np.bincount(place) > 1
        out = np.empty(len(self.keys), bool)
        out[self.order] = (several if above is None else several | above)[place]
        return np.split(out, self.cut)


def mark_shared(keyed: DataFrame, n_buckets: int, n_blocks: int) -> DataFrame:
    """For rows of KEYS, rows of BITS: a bit for each key, set if another block has it. A row of bucket < 0 goes to its block as it is.

    A task gets the keys of one bucket from at most SLICE blocks. Of more blocks, each slice sends its different keys on, once each,
    to be marked among slices in the same way; so a key that all blocks have doesn't fill its bucket.
    """

    def mark(found: pa.Table, above: pa.Table | None = None) -> pa.Table:
        block, bucket = found.column("block").to_pylist(), found.column("bucket")[0].as_py()
        if bucket < 0:
            return table_of([(b, -1, x) for b, x in zip(block, found.column("keys").to_pylist(), strict=True)], BITS_SCHEMA)
        own = Keys(found)
        bits = None if above is None else np.unpackbits(np.frombuffer(above.column("bits")[0].as_py(), np.uint8), count=int(own.new.sum())) > 0
        return table_of([(b, bucket, np.packbits(x).tobytes()) for b, x in zip(block, own.shared(bits), strict=True)], BITS_SCHEMA)

    def different(found: pa.Table) -> pa.Table:
        """One row with the different keys of a slice, which is its block."""
        bucket, part = found.column("bucket")[0].as_py(), found.column("slice")[0].as_py()
        if bucket < 0:
            return KEYS_SCHEMA.empty_table()
        own = Keys(found)
        at = own.order[own.new]
        return table_of([(bucket, part, own.keys[at].tobytes(), None if own.more is None else own.more[at].tobytes())], KEYS_SCHEMA)

    if n_blocks <= SLICE:
        return keyed.repartition(tasks(n_buckets), "bucket").groupBy("bucket").applyInArrow(lambda x: mark(x), BITS)
    n_slices = -(-n_blocks // SLICE)
    sliced = keyed.withColumn("slice", F.floor(F.col("block") / SLICE).cast("int")).repartition(tasks(n_buckets * n_slices), "bucket", "slice")
    above = mark_shared(sliced.groupBy("bucket", "slice").applyInArrow(different, KEYS), n_buckets, n_slices)
    return sliced.groupBy("bucket", "slice").cogroup(above.groupBy("bucket", "block")).applyInArrow(lambda x, y: mark(x, y if y.num_rows else None), BITS)


def read_bits(answer: pa.Table, keys: np.ndarray, n_buckets: int) -> np.ndarray:
    """The bit of each of a block's sorted keys."""
    own = dict(zip(answer.column("bucket").to_pylist(), answer.column("bits").to_pylist(), strict=True))
    out = np.zeros(len(keys), bool)
    for b, s in bucket_slices(keys, n_buckets):
        out[s] = np.unpackbits(np.frombuffer(own[b], np.uint8), count=s.stop - s.start)
    return out
