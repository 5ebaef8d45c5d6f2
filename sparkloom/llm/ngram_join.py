"""N-gram Jaccard join by a count-vector R-tree.

A document's set is its distinct shingles of `SHINGLE` words, A-Z in lower case. A set's shingles are hashed into `GROUPS` groups; the counts
of the groups are a point. Two sets can't have more in common than the sum of the smaller count in each group, and no
set under a node of the R-tree has more in common with a point than the node's largest counts allow; so the tree yields few
pairs, and those are verified on the whole sets.

To index points where their partners are, sets meet on shingles that a link can't do without: of two sets with a similarity of
at least T, k of the first n - ceil(T n) + k shingles of each are the other's too, in any order that is the same for all. With k a tenth
of n, few sets have so many that occur elsewhere; of those, the first of the k in common is never among the last k - 1. The order is by
how often a shingle occurs (by fine levels of a sketch of fixed size over all documents), so passages that many documents have come last.
Sets that are equal count once. Meeting sets that the bounds don't part make a candidate group; within it, links are verified until
all of its sets are joined or all pairs left are refuted. No pair of a joined group is made twice, and no link is lost:
a large group is dealt into chunks, joined within each, and then what isn't in its largest part meets all chunks.

Null and empty texts, and texts without words, have an empty set and link with nothing. Repeated rows and copies share a set and a
component. Component ids are the smallest doc_id of the component.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import blocks, kernels, sums
from sparkloom.llm.graph import connected, stash

SHINGLE, LEAST = 5, (80, 100)
GROUPS = 64
#: Counters of the frequency sketch, and the parts that it is added up in.
COUNTERS, PARTS = 1 << 20, 16
#: Points of one shingle, and sets of one candidate group, that one task looks at together.
POINTS, SETS = 4096, 2000
LEAF = 32
#: Bytes of prefix shingles of a bucket of points, and of whole sets of a pack of groups, about.
SIG_BYTES, PACK_BYTES = 1 << 19, 2 << 20


def shingles(words: kernels.Words) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all texts with repeats, in order, and where each text's begin."""
    h = words.hashes()
    count, first = words.count, words.first[:-1]
    del words  # of a long text, its bytes and places are much more than what follows
    n = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    off = np.concatenate([[0], np.cumsum(n)])
    whole = np.repeat(count >= SHINGLE, n)
    start = np.repeat(first - off[:-1], n)
    start += np.arange(off[-1])
    out = np.empty(off[-1], np.uint64)
    out[whole] = kernels.runs_hash(h, SHINGLE)[start[whole]]
    for size in range(1, SHINGLE):  # texts of fewer words
        at = off[:-1][count == size]
        out[at] = kernels.runs_hash(h[(start[at][:, None] + np.arange(size)).ravel()], size)[::size]
    return out, off


def text_sets(texts: pa.Array) -> list[np.ndarray]:
    """Each text's distinct shingles, sorted."""
    every, off = shingles(kernels.Words(texts, lower=True))
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        s = np.sort(every[a:b])
        out.append(s[np.append(True, s[1:] != s[:-1])] if len(s) else s)
    return out


def frequency_levels(docs: DataFrame) -> np.ndarray:
    """For each counter, 256 times the binary logarithm of how many shingles of all documents fall on it. Tasks send a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(COUNTERS, np.int64)
        for batch in kernels.steps(batches):
            every, _ = shingles(kernels.Words(batch.column("text"), lower=True))
            total += np.bincount((every & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        return total

    total = sums.over_tasks(docs.select("text"), count, PARTS, np.uint32)
    return (256 * np.log2(total + 1)).astype(np.uint16) if len(total) else np.zeros(COUNTERS, np.uint16)


def in_common(n: int) -> int:
    """So many shingles of their prefixes two linked sets have in common at least, if the smaller one has n."""
    return 1 + n // 10


def least_partner(n: int) -> int:
    """The least size of a set that can link with one of n, which is also the least intersection."""
    return -(-LEAST[0] * n // LEAST[1])


def prefix(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, as levels and hashes order them. Any linked set has in_common of them in its own prefix."""
    n = len(s)
    key = levels.take((s & np.uint64(COUNTERS - 1)).view(np.int64)).astype(np.uint64)
    key <<= np.uint64(48)
    key |= s >> np.uint64(16)
    return s[np.argsort(key, kind="stable")[: n - least_partner(n) + in_common(n)]] if n else s


def meeting(shared: np.ndarray, n: int) -> np.ndarray:
    """Those of a set's prefix shingles that occur elsewhere on which it must be indexed: none if they are too few for a link."""
    spare = in_common(least_partner(n)) - 1
    return shared[: max(0, len(shared) - spare)]


def counts_of(s: np.ndarray) -> np.ndarray:
    return np.bincount(((s >> np.uint64(20)) & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)


def packed(v: np.ndarray) -> bytes:
    """A point as bytes: a shift, and each count rounded up to the shift's unit. The bound stays an upper bound."""
    shift = 0
    while int(-(-v.max(initial=0) >> shift)) > 255:
        shift += 1
    return bytes([shift]) + (-(-v >> shift)).astype(np.uint8).tobytes()


def unpacked(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), GROUPS + 1)
    return x[:, 1:].astype(np.int32) << x[:, :1].astype(np.int32)


def needed(a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray:
    """The least intersection of linked sets of these sizes: the whole of T (a + b) / (1 + T), rounded up."""
    return -(-LEAST[0] * (a + b) // (LEAST[0] + LEAST[1]))


def near_in_size(a, least, most):
    return (most * LEAST[1] >= a * LEAST[0]) & (a * LEAST[1] >= least * LEAST[0])


class RTree:
    """Points of counts, loaded in the order of their sizes and counts; each node has its largest counts, and its sizes' range."""

    def __init__(self, size: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((*points[:, :2].T, size))
        self.size, self.points = size[self.order], points[self.order]
        self.levels = []
        low, high, most = self.size, self.size, self.points
        while len(most) > 1:
            cut = np.arange(0, len(most), LEAF)
            below = len(most)
            low, high, most = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(most, cut, axis=0)
            self.levels.append((low, high, most, below))

    def query(self, q: int, alive: np.ndarray) -> np.ndarray:
        """Places, in the tree's order, of the living points that the bounds don't part from point q."""
        size, point = self.size[q], self.points[q]
        at = np.arange(len(self.levels[-1][0])) if self.levels else np.arange(len(self.size))
        for low, high, most, below in reversed(self.levels):
            at = at[near_in_size(size, low[at], high[at])]
            at = at[np.minimum(most[at], point).sum(axis=1) >= needed(size, low[at])]
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < below]
        at = at[alive[at]]
        at = at[near_in_size(size, self.size[at], self.size[at])]
        return at[np.minimum(self.points[at], point).sum(axis=1) >= needed(size, self.size[at])]


def joined(size: np.ndarray, points: np.ndarray, grams: list[np.ndarray] | None = None) -> np.ndarray:
    """For each set, the first set of its component: by the bounds alone, or, given the sets, by verified links."""
    tree = RTree(size, points)
    alive, label = np.ones(len(size), bool), np.arange(len(size))
    order = tree.order
    for first in range(len(size)):
        if not alive[first]:
            continue
        alive[first], queue = False, [first]
        while queue and alive.any():
            q = queue.pop()
            near = tree.query(q, alive)
            if grams is not None and len(near):
                own = grams[order[q]]
                common = np.array([common_size(own, grams[k]) for k in order[near].tolist()])
                near = near[linked(common, len(own), tree.size[near])]
            alive[near] = False
            label[near] = first
            queue += near.tolist()
        label[first] = first
        if not alive.any():
            break
    out = np.empty(len(size), np.int64)
    out[order] = order[label]
    return out


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(common: np.ndarray, a, b) -> np.ndarray:
    return LEAST[1] * common >= LEAST[0] * (a + b - common)


SET_ROWS = "doc_id bigint, n bigint, node bigint, point binary, sigs binary, grams binary"


def set_rows(docs: DataFrame, *more: str) -> DataFrame:
    """A row of SET_ROWS, and the columns `more`, for each document. point, sigs and grams only where enough of its prefix occurs elsewhere."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    n_blocks, n_buckets = blocks.counts(docs)
    shared_levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs))  # 2 COUNTERS bytes
    dealt, block = blocks.deal(docs, n_blocks)

    def read(found: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in kernels.steps(found.to_batches()):
            for s in text_sets(batch.column("text")):
                yield s, prefix(s, shared_levels.value)

    def keys(found: pa.Table) -> pa.Table:
        own = np.unique(np.concatenate([p for _, p in read(found)]))
        return blocks.table_of(blocks.key_rows(found.column(block)[0].as_py(), own, None, n_buckets), blocks.KEYS_SCHEMA)

    def describe(found: pa.Table, answer: pa.Table) -> pa.Table:
        both = list(read(found))
        own, place, times = np.unique(np.concatenate([p for _, p in both] or [np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
        shared = blocks.read_bits(answer, own, n_buckets)
        shared = (shared | (times > 1))[place]
        out, at = {"n": [], "node": [], "point": [], "sigs": [], "grams": []}, 0
        for s, p in both:
            meets = meeting(p[shared[at : at + len(p)]], len(s))
            at += len(p)
            out["n"].append(len(s))
            out["node"].append(int(kernels.mix(np.array([kernels.mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64)).view(np.int64)[0]))
            out["point"].append(packed(counts_of(s)) if len(meets) else None)
            out["sigs"].append(meets.tobytes() if len(meets) else None)
            out["grams"].append(s.tobytes() if len(meets) else None)
        return pa.table({"doc_id": found.column("doc_id"), "n": pa.array(out["n"], pa.int64()), "node": pa.array(out["node"], pa.int64())} | {k: pa.array(out[k], pa.binary()) for k in ("point", "sigs", "grams")} | {c: found.column(c) for c in more})

    marked = blocks.mark_shared(dealt.groupBy(block).applyInArrow(keys, blocks.KEYS), n_buckets, n_blocks)
    return dealt.groupBy(block).cogroup(marked.groupBy("block")).applyInArrow(describe, ", ".join([SET_ROWS, *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)]))


def one_each(rows: DataFrame, *columns: str) -> DataFrame:
    """One row for each set that meets others, however many documents have it. Combines before the exchange."""
    return rows.where("sigs is not null").groupBy("node").agg(F.first("n").alias("n"), *[F.first(c).alias(c) for c in columns])


EDGES = "a bigint, b bigint"


def edge_table(pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
    a, b = (np.concatenate([np.asarray(p[k], np.int64) for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.table({"a": both[:, 0], "b": both[:, 1]})


def candidate_edges(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Edges (a, b) that hold together all sets that share a shingle of their prefixes and that the bounds don't part."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = [np.frombuffer(x, np.int64) for x in batch.column("sigs").to_pylist()]
            each = np.array([len(s) for s in sigs], np.int64)
            for low in range(0, len(sigs), 256):
                part = slice(low, low + 256)
                at = np.repeat(np.arange(low, min(low + 256, len(sigs))), each[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs[part]) if len(at) else np.zeros(0, np.int64)), *(batch.column(c).take(pa.array(at)) for c in ("node", "n", "point"))], ["sig", "node", "n", "point"])

    points = one_each(rows, "point", "sigs").mapInArrow(expand, "sig bigint, node bigint, n bigint, point binary")
    # A shingle with more than POINTS points is dealt into chunks.
    hot = points.groupBy("sig").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > POINTS)
    dealt = points.join(hot, "sig", "left").select(
        F.pmod(F.xxhash64("sig"), F.lit(n_buckets)).cast("int").alias("bucket"),
        F.when(F.col("many").isNotNull(), F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / POINTS))).otherwise(-1).cast("int").alias("chunk"),
        "sig",
        "node",
        F.col("n").alias("least"),
        F.col("n").alias("most"),
        "point",
        F.when(F.col("many").isNotNull(), F.col("sig")).alias("hot"),
    ).repartition(blocks.tasks(n_buckets), "bucket", "chunk", "hot")
    out_rows = "a bigint, b bigint, sig bigint, least bigint, most bigint, point binary"

    def join_points(found: pa.Table) -> pa.Table:
        """Edges; of a chunk also each component: its first set, its sizes' range and largest counts."""
        sig, node, least, most = (found.column(c).to_numpy() for c in ("sig", "node", "least", "most"))
        chunk, points = found.column("chunk")[0].as_py(), unpacked(found.column("point").to_pylist())
        order = np.lexsort((node, least, sig))
        sig, node, least, most, points = sig[order], node[order], least[order], most[order], points[order]
        same = sig[1:] == sig[:-1]
        # Neighbours in size within a shingle. Where all of them hold together, so does the shingle.
        holds = near_in_size(most[:-1], least[1:], most[1:]) & (np.minimum(points[1:], points[:-1]).sum(axis=1) >= needed(least[1:], least[:-1]))
        new = np.append(True, ~same)
        group = np.cumsum(new) - 1
        loose = np.bincount(group[1:], same & ~holds, group[-1] + 1) > 0
        firm = same & ~loose[group[1:]]
        label = np.arange(len(sig))
        starts = np.flatnonzero(new)
        label[~loose[group]] = starts[group[~loose[group]]]
        pairs = [(node[1:][firm], node[:-1][firm])]
        ends = np.append(starts[1:], len(sig))
        for g in np.flatnonzero(loose).tolist():
            a, b = starts[g], ends[g]
            label[a:b] = a + joined(least[a:b], points[a:b])
            pairs.append((node[a:b], node[label[a:b]]))
        edges = edge_table([(p[p != q], q[p != q]) for p, q in pairs])
        extra: list[tuple] = []
        if chunk >= 0:
            for k in np.unique(label).tolist():
                own = label == k
                extra.append((int(node[k]), None, int(sig[k]), int(least[own].min()), int(most[own].max()), packed(points[own].max(axis=0))))
        n = edges.num_rows
        return pa.table(
            {
                "a": pa.concat_arrays([edges.column("a").combine_chunks().cast(pa.int64()), pa.array([x[0] for x in extra], pa.int64())]),
                "b": pa.concat_arrays([edges.column("b").combine_chunks().cast(pa.int64()), pa.nulls(len(extra), pa.int64())]),
            }
            | {c: pa.concat_arrays([pa.nulls(n, t), pa.array([x[k] for x in extra], t)]) for k, c, t in ((2, "sig", pa.int64()), (3, "least", pa.int64()), (4, "most", pa.int64()), (5, "point", pa.binary()))}
        )

    def join_parts(found: pa.Table) -> pa.Table:
        """Edges between the chunks' components of a shingle whose largest counts allow a link."""
        sig, node, least, most = (found.column(c).to_numpy() for c in ("sig", "a", "least", "most"))
        points, pairs = unpacked(found.column("point").to_pylist()), []
        for s in np.unique(sig).tolist():
            at = np.flatnonzero(sig == s)
            for k in range(len(at) - 1):
                q, rest = at[k], at[k + 1 :]
                fits = (most[rest] * LEAST[1] >= least[q] * LEAST[0]) & (most[q] * LEAST[1] >= least[rest] * LEAST[0])
                near = rest[fits & (np.minimum(points[rest], points[q]).sum(axis=1) >= needed(least[q], least[rest]))]
                pairs.append((np.full(len(near), node[q]), node[near]))
                if len(near) == len(rest):
                    break  # the first holds all the others
        return edge_table(pairs)

    found = stash(dealt.groupBy("bucket", "chunk", "hot").applyInArrow(join_points, out_rows))
    parts = found.where("b is null").groupBy("sig").applyInArrow(join_parts, EDGES)
    return found.where("b is not null").select("a", "b").union(parts)


def verified_edges(rows: DataFrame, groups: DataFrame, n_packs: int) -> DataFrame:
    """Edges of verified links that hold together exactly what all links hold together. groups: node, root of candidate groups."""
    full = one_each(rows, "point", "grams")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("many"))
    placed = stash(groups.join(sizes, "root").select("node", "root", F.ceil(F.col("many") / SETS).alias("n_chunks")))
    whole = full.join(placed, "node")

    def verify(found: pa.Table) -> pa.Table:
        """Joins the sets of each root (and chunk) of a pack."""
        root, chunk, node, size = (found.column(c).to_numpy() for c in ("root", "chunk", "node", "n"))
        points = unpacked(found.column("point").to_pylist())
        grams = [np.frombuffer(x, np.uint64) for x in found.column("grams").to_pylist()]
        order = np.lexsort((node, chunk, root))
        new = np.append(True, (root[order][1:] != root[order][:-1]) | (chunk[order][1:] != chunk[order][:-1]))
        pairs = []
        for own in np.split(order, np.flatnonzero(new)[1:]):
            label = joined(size[own], points[own], [grams[k] for k in own.tolist()])
            apart = label != np.arange(len(own))
            pairs.append((node[own[apart]], node[own[label[apart]]]))
        return edge_table(pairs)

    chunked = whole.withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int"))
    # Small groups share packs; a chunk of a large one is a group by itself.
    pack = F.pmod(F.xxhash64("root"), F.lit(n_packs)).cast("int")
    small = chunked.where("n_chunks = 1").withColumn("pack", pack).repartition(blocks.tasks(n_packs), "pack").groupBy("pack").applyInArrow(verify, EDGES)
    large = placed.where("n_chunks > 1")
    if large.isEmpty():
        return small
    edges = stash(chunked.where("n_chunks > 1").groupBy(F.xxhash64("root", "chunk").alias("pack")).applyInArrow(verify, EDGES))
    # Large groups. First one set of each part found so far, dealt anew; then all that isn't in the group's largest part meets every chunk.
    for _ in range(2):
        parts = stash(parts_of(large, edges))
        heads = parts.where("node = part")
        many = heads.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / SETS).alias("n_head_chunks"))
        dealt = heads.join(many, "root").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(7)), F.col("n_head_chunks")).cast("int"))
        edges = stash(edges.union(full.join(dealt.select("node", "root", "chunk"), "node").groupBy(F.xxhash64("root", "chunk").alias("pack")).applyInArrow(verify, EDGES)))
    parts = parts_of(large, edges)
    part_sizes = parts.groupBy("root", "part").agg(F.count(F.lit(1)).alias("many"))
    largest = part_sizes.groupBy("root").agg(F.max_by("part", F.struct("many", "part")).alias("main"), (F.sum("many") - F.max("many")).alias("out"))
    sided = stash(parts.join(largest.where("out > 0"), "root").withColumn("n_out", F.ceil(F.col("out") / SETS)))
    chunk = F.pmod(F.xxhash64("node"), F.col("n_chunks")).cast("int")
    column = F.pmod(F.xxhash64("node", F.lit(1)), F.col("n_out")).cast("int")
    cells = sided.select("node", "root", "part", F.lit(0).alias("side"), chunk.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_out").cast("int") - 1)).alias("j")).union(
        sided.where("part <> main").select("node", "root", "part", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("n_chunks").cast("int") - 1)).alias("i"), column.alias("j"))
    )

    def across(found: pa.Table) -> pa.Table:
        """Verified links between the two sides of a cell, one for each pair of parts at most."""
        side, part, node, size = (found.column(c).to_numpy() for c in ("side", "part", "node", "n"))
        points = unpacked(found.column("point").to_pylist())
        grams = [np.frombuffer(x, np.uint64) for x in found.column("grams").to_pylist()]
        tree, at = RTree(size, points), np.arange(len(size))
        place = np.empty(len(size), np.int64)
        place[tree.order] = at
        pairs, done = [], set()
        for q in np.flatnonzero(side == 1).tolist():
            near = tree.order[tree.query(int(place[q]), ((side == 0) & (part != part[q]))[tree.order])]
            for k in near.tolist():
                both = (min(part[q], part[k]), max(part[q], part[k]))
                if both not in done and linked(common_size(grams[q], grams[k]), size[q], size[k]):
                    done.add(both)
                    pairs.append((node[[q]], node[[k]]))
        return edge_table(pairs)

    return small.union(edges).union(full.join(cells, "node").groupBy("root", "i", "j").applyInArrow(across, EDGES))


def parts_of(large: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root and n_chunks of large, and part, the smallest node of what the edges hold together."""
    found = connected(edges).select("node", F.col("root").alias("part"))
    return large.join(found, "node", "left").select("node", "root", "n_chunks", F.coalesce("part", "node").alias("part"))


def components(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_shingles and component_id of each document, and the columns `more` of docs."""
    rows = stash(set_rows(docs, *more))
    total = rows.agg(F.sum(F.octet_length("sigs")).alias("sigs"), F.sum(F.octet_length("grams")).alias("grams")).first()
    groups = stash(connected(candidate_edges(rows, max(1, (total["sigs"] or 0) // SIG_BYTES))))
    labels = connected(verified_edges(rows, groups, max(1, (total["grams"] or 0) // PACK_BYTES)))
    least = rows.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(labels, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    of_root = least.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = least.join(of_root, "root").select("node", "component_id")
    found = rows.select("doc_id", "n", "node", *more).join(of_node, "node", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *more)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, unchanged, but for those with a smaller doc_id in their component. Rows without a doc_id stay.

    A row is known by its doc_id and a hash of its text: rows that share a doc_id can be in different components.
    """
    key = blocks.fresh("text_key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    gone = components(keyed.select("doc_id", "text", key), key).where("doc_id <> component_id").select("doc_id", key).distinct()
    return keyed.join(gone, ["doc_id", key], "left_anti").select(blocks.columns(docs.columns))
