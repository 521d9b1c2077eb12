"""Groups of near copies for filtering a corpus: SimHash links, and pairs of five-word shingle sets that are 0.8 alike or more.

Fingerprints of 64 bits that differ in two bits at most are linked by the Gray-order
index of ``simhash``. Texts whose shingle sets are 0.8 alike differ in about seven bits,
and often in more than ten, so that index alone finds few of them (the README has
figures). So each text also has BANDS keys of ROWS minima of its shingles' permuted
hashes: two texts 0.8 alike share one of them but for a chance of 0.0002. All pairs of
texts that share a key are decided by the exact Jaccard similarity of their whole
shingle sets: a key's texts are dealt into blocks, a task holds two blocks against each
other and passes on a spanning forest of what is alike, never all pairs.

Defined cases: a null text is empty; fewer words than five are one shingle; texts
without words are copies of each other; rows without a key are in no group; rows with
one key are one document; an empty table gives no groups. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.common import arrow_map, checkpointed, texts_of
from quern.llm.components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
#: About as many classes and hashes of a key are a block; a key with more has several blocks.
BLOCK_CLASSES, BLOCK_HASHES = 1_024, 1 << 19
_STEP = 4_096
_RNG = np.random.default_rng(11)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, ascending, of the word shingles of an ASCII-lower-cased text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(k, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], simhash.SEED) for a, b in zip(first, ends[k - 1 :].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of ROWS minima."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _STEP):
        part = hashes[at : at + _STEP, None] * _TIMES + _PLUS
        np.minimum(least, part.min(axis=0), out=least)
    rows = (least >> np.uint64(1)).reshape(BANDS, ROWS)
    key = np.zeros(BANDS, np.uint64)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _digested(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, fp, cls, size, keys): fingerprint, digest and size of the shingle set, and band keys of each document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text)
            fps, cls, sizes, keys = [], [], [], []
            for t in texts:
                hashes = shingles(t)
                fps.append(simhash.fingerprint(t))
                cls.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                sizes.append(len(hashes))
                keys.append(band_keys(hashes).view(np.int64))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(key), fp, pa.array(cls, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "fp", "cls", "size", "keys"])

    return arrow_map(df.select(key, text).filter(F.col(key).isNotNull()), run, f"doc {df.schema[key].dataType.simpleString()}, fp long, cls binary, size long, keys array<long>")


def _members(classes: DataFrame) -> DataFrame:
    """(band, k, blocks, cls, doc): the classes of each key that two or more share; of keys with the same classes, one."""
    rows = classes.select("cls", "doc", "size", F.posexplode("keys").alias("band", "k"))
    held = [F.count("*").alias("many"), F.sum("size").alias("words"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "cls")).alias("y")]
    keys = rows.groupBy("band", "k").agg(*held).filter("many > 1")
    keys = keys.groupBy("many", "words", "x", "y").agg(F.min(F.struct("band", "k")).alias("key"))
    blocks = F.greatest(F.ceil(F.col("many") / BLOCK_CLASSES), F.ceil(F.col("words") / BLOCK_HASHES)).cast("int")
    return rows.join(keys.select("key.band", "key.k", blocks.alias("blocks")), ["band", "k"]).select("band", "k", "blocks", "cls", "doc")


def _sets(df: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """(cls, hashes): the whole shingle set of each class of ``wanted`` (doc, cls), made again from its document's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).tobytes() for t in texts_of(batch, "text")]
            own = pa.array([xxhash.xxh3_128_digest(s) == c for s, c in zip(sets, batch.column("cls").to_pylist())], pa.bool_())  # rows with one key may differ
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(sets, pa.binary())], names=["cls", "hashes"]).filter(own)

    texts = df.select(F.col(key).alias("doc"), F.col(text).alias("text")).join(wanted, "doc").select("cls", "text")
    return arrow_map(texts, run, "cls binary, hashes binary").groupBy("cls").agg(F.first("hashes").alias("hashes"))


def forest(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` that join what the pairs of left x right of similarity ``least`` or more join, and no more of them than places.

    All pairs are decided, exactly: shared hashes are counted by products of 0/1 matrices, _STEP hashes at a time.
    """
    sizes = np.array([len(s) for s in sets])
    _, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = counts > 1
    kept = several[place]
    column, row = (np.cumsum(several) - 1)[place[kept]], np.repeat(np.arange(len(sets)), sizes)[kept]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((len(left), len(right)))
    for at in range(0, int(several.sum()), _STEP):
        a, b = np.searchsorted(column, [at, at + _STEP])
        has = np.zeros((len(sets), int(column[b - 1]) + 1 - at), np.float32)
        has[row[a:b], column[a:b] - at] = 1
        both += has[left] @ has[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - both
    alike = np.zeros((len(sets), len(sets)), bool)
    alike[np.ix_(left, right)] = both / np.maximum(union, 1) >= least
    alike |= alike.T
    out, new = [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        todo = [root] if new[root] else []
        new[root] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(alike[i] & new).tolist()
            new[found] = False
            out += [(i, j) for j in found]
            todo += found
    return out


def _alike(members: DataFrame, sets: DataFrame, kind: str, least: float) -> DataFrame:
    """(a, b): links that join all classes that share a key and are ``least`` alike or more.

    The classes of a key are dealt into blocks, and each two blocks (and each with itself) are a cell,
    so a key that very many texts share is spread over tasks, and no pair of it is left out.
    """
    rows = members.join(sets, "cls").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = ["band", "k", "lo", "hi"]
    rows = rows.select("band", "k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc", "hashes")

    def decided(at: tuple, held: list[tuple]) -> list[tuple]:
        own = np.array([x[0] for x in held])
        left, right = np.flatnonzero(own == at[2]), np.flatnonzero(own == at[3])
        return [(held[i][1], held[j][1]) for i, j in forest([x[2] for x in held], left, right, least)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, type_ = None, [], None
        for batch in batches:
            type_, pairs = batch.column("doc").type, []
            cells = zip(*(batch.column(c).to_pylist() for c in cell))
            for here, own, doc, hashes in zip(cells, *(batch.column(c).to_pylist() for c in ("own", "doc", "hashes"))):
                if here != at:
                    pairs += decided(at, held) if held else []
                    at, held = here, []
                held.append((own, doc, np.frombuffer(hashes, np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], type_) for i in (0, 1)], names=["a", "b"])
        if held:
            pairs = decided(at, held)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], type_) for i in (0, 1)], names=["a", "b"])

    return arrow_map(rows.repartition(*cell).sortWithinPartitions(*cell), run, f"a {kind}, b {kind}")


def group_links(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(a, b): links between documents whose chains make up the groups."""
    kind = df.schema[key].dataType.simpleString()
    docs = checkpointed(_digested(df, key, text))
    by_fp = docs.groupBy("fp").agg(F.min("doc").alias("least"))
    by_cls = docs.groupBy("cls").agg(F.min("doc").alias("least"))
    # one document stands for all with its shingle set
    classes = docs.join(by_cls, "cls").filter("doc = least").dropDuplicates(["cls"])
    members = checkpointed(_members(classes))
    near = simhash.links(by_fp.select("fp"))
    near = near.join(by_fp.select(F.col("fp").alias("a"), F.col("least").alias("one")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("least").alias("two")), "b").select(F.col("one").alias("a"), F.col("two").alias("b"))
    same = docs.select("doc", "fp").join(by_fp, "fp").select(F.col("doc").alias("a"), F.col("least").alias("b"))
    equal = docs.select("doc", "cls").join(by_cls, "cls").select(F.col("doc").alias("a"), F.col("least").alias("b"))
    alike = _alike(members, _sets(df, members.select("doc", "cls").distinct(), key, text), kind, least)
    return near.unionByName(same).unionByName(equal).unionByName(alike).filter("a <> b")


def first_of_groups(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df``, all columns kept, of which each group of near copies has one: that of the least key.

    Of rows with one and the same key, the one whose text has the least hash stays; rows without a key all stay.
    """
    gone = connected_components(group_links(df, key, text, least)).select(F.col("node").alias("__gone"))
    rest = df.join(gone, F.col(key) == F.col("__gone"), "left_anti")
    # keys that several rows have are settled apart: of the others no row needs to meet another
    hashed = F.xxhash64(text).alias("__hash")
    twice = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("__key"), hashed).groupBy("__key").agg(F.count("*").alias("__n"), F.min("__hash").alias("__first")).filter("__n > 1").drop("__n")
    twice = checkpointed(twice)
    if twice.isEmpty():
        return rest
    met = F.col(key) == F.col("__key")
    first = rest.withColumn("__hash", hashed).join(twice, met & (F.col("__hash") == F.col("__first")), "left_semi").drop("__hash")
    return rest.join(twice, met, "left_anti").unionByName(first.dropDuplicates([key]))
