"""SimHash near-duplicate detection by a Gray-order hierarchical index.

Fingerprints that differ in two bits at most agree on one of three blocks of bits.
So each distinct fingerprint is dealt out under three masked patterns, and a
partition indexes the fingerprints of each pattern: they are sorted by Gray rank,
runs of neighbours become nodes that hold the bits on which all below agree, and a
search goes down from the pattern, adds up the differences on the bits that each
node newly fixes, and drops a whole node when the sum passes the limit. A pattern
with too many fingerprints is split by three blocks of its free bits, again
without losing a pair, so no task holds an unbounded group.

Of the links found, a task passes on a spanning forest only, never all pairs of a
group; components are then joined up over all tasks.

Defined cases: a null text is empty; texts without words have fingerprint zero and
link like any other; equal fingerprints are one node; a null document id never is a
component id unless all of its component's ids are null; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, batch_of, checkpointed, texts_of
from quern.llm.components import connected_components

SHINGLE = 3
SEED = 42
LIMIT = 2
#: Children of an index node.
FAN = 8
#: Fingerprints under one masked pattern beyond which it is split by more bits.
LEAF_MAX = 20_000
#: Rows of a partition that are indexed together; a pattern's rows always are.
CHUNK_ROWS = 200_000
#: Node visits of one step of a search.
VISITS = 2_000_000
_VOTES = 50_000


def fingerprint(text: str | None) -> int:
    """64 majority bits of the XXH64 of all word shingles of an ASCII-lower-cased text, unsigned."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(SHINGLE, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    last = ends[k - 1 :].tolist()
    del words
    votes, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), _VOTES):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + _VOTES], last[at : at + _VOTES])]
        votes += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > len(first)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (the fingerprint as a signed long): one row a document, without a shuffle."""
    fields = pa.schema([("fp", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in texts_of(batch, text)], np.uint64)
            yield batch_of(fields, **{key: batch.column(key)}, fp=pa.array(found.view(np.int64)))

    return arrow_map(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long")


def masks(levels: int, limit: int = LIMIT) -> list[list[int]]:
    """Bit masks by level: the children of mask i are the masks from i * (limit + 1) of the next level on.

    A child adds one of limit + 1 blocks of the bits that its parent leaves free.
    """
    out, parents = [], [0]
    for _ in range(levels):
        level = []
        for parent in parents:
            free = [b for b in range(64) if not parent >> b & 1]
            cuts = [len(free) * i // (limit + 1) for i in range(limit + 2)]
            level += [parent | sum(1 << b for b in free[p:q]) for p, q in zip(cuts, cuts[1:])]
        out.append(level)
        parents = level
    return out


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _dealt(rows: DataFrame, level: list[int], limit: int) -> DataFrame:
    """(fp, node) to a row for each child of the node: fp, node, pattern."""
    node = F.explode(F.sequence(F.col("node") * (limit + 1), F.col("node") * (limit + 1) + limit)).alias("node")
    table = F.array(*map(F.lit, map(_signed, level)))
    return rows.select("fp", node).withColumn("pattern", F.col("fp").bitwiseAND(F.get(table, F.col("node"))))


def patterns(distinct: DataFrame, limit: int = LIMIT, leaf_max: int = LEAF_MAX, levels: int = 4) -> DataFrame:
    """(level, node, pattern, fp): every pair within the limit shares a pattern, and no pattern has many more rows than leaf_max.

    With four levels of three blocks at least 50 bits are fixed, so at most 2 ** 14 distinct fingerprints share a last one.
    """
    parts, rows = [], distinct.select("fp", F.lit(0).alias("node"))
    for k, level in enumerate(masks(levels, limit)):
        dealt = _dealt(rows, level, limit)
        part = dealt.select(F.lit(k).alias("level"), "node", "pattern", "fp")
        hot = None
        if k < levels - 1:
            hot = checkpointed(dealt.groupBy("node", "pattern").count().filter(F.col("count") > leaf_max).select("node", "pattern"))
        if hot is None or hot.isEmpty():
            parts.append(part)
            break
        parts.append(part.join(hot, ["node", "pattern"], "left_anti").select("level", "node", "pattern", "fp"))
        rows = dealt.join(hot, ["node", "pattern"], "left_semi").select("fp", "node")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    out = fp.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayIndex:
    """Groups of fingerprints, each a tree over its members in Gray order; all groups' trees are held level by level."""

    def __init__(self, group: np.ndarray, fp: np.ndarray) -> None:
        order = np.lexsort((gray_rank(fp), group))
        self.fp, group = fp[order], group[order]
        #: of each level from the leaves up: bits set in all below, bits set in any below, first child, past-last child
        self.ones, self.some, self.first, self.last = [self.fp], [self.fp], [], []
        while True:
            begins = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            if len(begins) == len(group) and self.first:
                break
            place = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
            cut = np.flatnonzero(place % FAN == 0)
            self.first.append(cut)
            self.last.append(np.append(cut[1:], len(group)))
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], cut))
            self.some.append(np.bitwise_or.reduceat(self.some[-1], cut))
            group = group[cut]
        #: the tree of each leaf, and past the last leaf of each tree
        top = np.arange(len(group))
        past = np.arange(1, len(self.fp) + 1)
        self.past = [past]
        for last in self.last:
            past = past[last - 1]
            self.past.append(past)
        self.size = np.diff(np.concatenate([[0], past]))
        self.tree = np.repeat(top, self.size)

    def links(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs i < j of leaves of one tree that differ in limit bits at most, in steps of bounded size."""
        work = np.cumsum(self.size[self.tree])
        at = 0
        while at < len(self.fp):
            until = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + VISITS, "right")))
            leaf = np.arange(at, until)
            node, sum_, fixed = self.tree[at:until], np.zeros(until - at, np.int64), np.zeros(until - at, np.uint64)
            for k in range(len(self.first) - 1, -1, -1):
                first, many = self.first[k][node], self.last[k][node] - self.first[k][node]
                leaf, sum_, fixed = np.repeat(leaf, many), np.repeat(sum_, many), np.repeat(fixed, many)
                node = np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(leaf))
                late = self.past[k][node] - 1 > leaf
                leaf, node, sum_, fixed = leaf[late], node[late], sum_[late], fixed[late]
                agreed = self.ones[k][node] | ~self.some[k][node]
                sum_ = sum_ + np.bitwise_count((self.fp[leaf] ^ self.ones[k][node]) & agreed & ~fixed)
                near = sum_ <= limit
                leaf, node, sum_, fixed = leaf[near], node[near], sum_[near], agreed[near]
            yield leaf, node
            at = until


def spanning_forest(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the least node of its component."""
    label = np.arange(n)
    for a, b in links:
        while len(a):
            p, q = label[a], label[b]
            apart = p != q
            a, b, p, q = a[apart], b[apart], p[apart], q[apart]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while not np.array_equal(further := label[label], label):
                label = further
    return label


def links(distinct: DataFrame, limit: int = LIMIT, leaf_max: int = LEAF_MAX) -> DataFrame:
    """(a, b): links between distinct fingerprints that join up exactly those that chains of near ones join."""
    fields = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def joined(level: np.ndarray, node: np.ndarray, pattern: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        new = (level[1:] != level[:-1]) | (node[1:] != node[:-1]) | (pattern[1:] != pattern[:-1])
        group = np.concatenate([[0], np.cumsum(new)])
        shared = np.bincount(group)[group] > 1
        if not shared.any():
            return batch_of(fields, a=[], b=[])
        index = GrayIndex(group[shared], fp[shared].view(np.uint64))
        label = spanning_forest(len(index.fp), index.links(limit))
        a = np.flatnonzero(label != np.arange(len(label)))
        out = index.fp.view(np.int64)
        return batch_of(fields, a=pa.array(out[a]), b=pa.array(out[label[a]]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("level", "node", "pattern", "fp")])
            rows += batch.num_rows
            if rows >= CHUNK_ROWS:
                cols = [np.concatenate(c) for c in zip(*held)]
                ends = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
                if len(ends):
                    yield joined(*(c[: ends[-1]] for c in cols))
                    cols = [c[ends[-1] :].copy() for c in cols]
                held, rows = [cols], len(cols[0])
        if rows:
            yield joined(*(np.concatenate(c) for c in zip(*held)))

    keys = ["level", "node", "pattern"]
    return arrow_map(patterns(distinct, limit, leaf_max).repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, leaf_max: int = LEAF_MAX) -> DataFrame:
    """key, fingerprint (16 hex digits), component_id (the least key that chains of links reach): one row a document."""
    docs = checkpointed(fingerprints(df, key, text))
    classes = docs.groupBy("fp").agg(F.min(key).alias("least"))
    roots = connected_components(links(classes.select("fp"), limit, leaf_max))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.select("fp", "root").join(least, "root").select("fp", "component_id")
    return docs.join(placed, "fp").select(key, hex_of(F.col("fp")).alias("fingerprint"), "component_id")
