"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash of the last seven bytes cuts a text where its value is the last of
its block size's range, so cuts depend on what stands there and not on where it
stands. Each piece gives one of 64 characters. A fingerprint has the block size and
the signatures at it and at twice it, so that texts of somewhat different lengths
still share a block size. Signatures are compared by edit distance (insertions and
deletions), and count only if they share a run of RUN characters.

Rolling and piece hashes are sums over the bytes of a text, so numpy makes them for a
block of texts at once; a piece's hash is a difference of prefix sums of the bytes
times powers of an odd number, modulo 2 ** 64.

Defined cases: a null text is empty; an empty text has empty signatures and likeness
1 to another empty one, else 0; equal texts have equal fingerprints and likeness 1;
repeated rows give equal rows; texts of any length are read whole; an empty table gives
an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, blocks, written

WINDOW = 7
#: Characters of a signature at most.
LENGTH = 64
LEAST_BLOCK = 3
#: Characters in a row that two signatures must share.
RUN = 4
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_STRIDE = 1 << 12
#: Bytes that are hashed at a time.
CHUNK = 1 << 21


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n."""
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _powers_at(base: int, at: np.ndarray) -> np.ndarray:
    """base ** i modulo 2 ** 64 for each i, from two short tables."""
    most = int(at.max(initial=0)) // _STRIDE + 1
    large = _powers(pow(base, _STRIDE, 1 << 64), 1 << (most - 1).bit_length())
    return _powers(base, _STRIDE)[at % _STRIDE] * large[at // _STRIDE]


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the hash of the last WINDOW bytes: their sum, their sum weighted by nearness, and their shifted xor.

    Bytes before the first count as zero.
    """
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint8), data]).astype(np.uint32)
    n = len(data)
    plain, weighted, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for back in range(WINDOW):
        part = padded[WINDOW - 1 - back : WINDOW - 1 - back + n]
        plain += part
        weighted += part * np.uint32(WINDOW - back)
        mixed ^= part << np.uint32(5 * back if 5 * back < 32 else 0)
    h = plain + weighted + mixed
    h *= np.uint32(0x9E3779B1)
    return h ^ (h >> np.uint32(15))


def _block_size(n: int) -> int:
    size = LEAST_BLOCK
    while size * LENGTH < n:
        size *= 2
    return size


def _scan(data: np.ndarray, size: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the rolling hash is the last of ``size``'s range: positions, hashes and sums up to there; and the sums before each mark.

    The sum is of (byte + 1) * _ODD ** position. Bytes are taken CHUNK at a time.
    """
    found, before, carry = [], np.zeros(len(marks), np.uint64), np.uint64(0)
    for a in range(0, len(data), CHUNK):
        b = min(a + CHUNK, len(data))
        lead = min(a, WINDOW - 1)
        h = rolling(data[a - lead : b])[lead:]
        sums = (data[a:b].astype(np.uint64) + np.uint64(1)) * _powers(_ODD, CHUNK)[: b - a]
        sums *= np.uint64(pow(_ODD, a, 1 << 64))
        sums[:1] += carry
        np.cumsum(sums, out=sums)
        at = np.flatnonzero(h % np.uint32(size) == size - 1)
        found.append((at + a, h[at], sums[at]))
        inside = (marks > a) & (marks <= b)
        before[inside] = sums[marks[inside] - 1 - a]
        carry = sums[-1:]
    pos, h, sums = (np.concatenate(c) for c in zip(*found))
    return pos, h, sums, before


def signatures(texts: list[bytes]) -> list[str]:
    """``block:signature:signature`` of each text."""
    if not texts:
        return []
    gap = bytes(WINDOW)  # zeros before each text, so that no window spans two
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    past = np.cumsum(size + WINDOW)
    first = past - size
    data = np.frombuffer(b"".join(x for t in texts for x in (gap, t)), np.uint8)
    least = LEAST_BLOCK
    while len(data) // least > CHUNK:  # one very long text: its short blocks are looked at only if they are asked for
        least *= 2
    marks = np.concatenate([first, past])
    while True:
        pos, h, sums, before = _scan(data, least, marks)
        edges = np.searchsorted(pos, first), np.searchsorted(pos, past)
        out = []
        for i in range(len(texts)):
            at, values, upto = (x[edges[0][i] : edges[1][i]] for x in (pos, h, sums))
            block = _block_size(int(size[i]))
            while (cut := values % np.uint32(block) == block - 1).sum() < LENGTH // 2 and block > LEAST_BLOCK:
                block //= 2
                if block < least:
                    break
            if block < least:
                break
            wide = values % np.uint32(2 * block) == 2 * block - 1
            ends = int(first[i]), int(past[i]), before[i], before[len(texts) + i]
            out.append(f"{block}:{_signature(*ends, at[cut], upto[cut])}:{_signature(*ends, at[wide], upto[wide])}")
        if len(out) == len(texts):
            return out
        least = max(LEAST_BLOCK, least // 8)


def _signature(first: int, past: int, before: np.uint64, whole: np.uint64, cuts: np.ndarray, sums: np.ndarray) -> str:
    """A character for each piece of first to past; what comes after LENGTH - 1 of them is one piece."""
    ends, upto = cuts[: LENGTH - 1] + 1, sums[: LENGTH - 1]
    if past > (ends[-1] if len(ends) else first):
        ends, upto = np.append(ends, past), np.append(upto, whole)
    if not len(ends):
        return ""
    starts = np.append(first, ends[:-1])
    h = (upto - np.append(before, upto[:-1])) * _powers_at(_BACK, starts)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return _CHARS[(h >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time as bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        if hit := row & places.get(c, 0):
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    """1 less the share of insertions and deletions between two signatures; 0 without a common run."""
    if a == b:
        return 1.0
    if len(a) < RUN or len(b) < RUN:
        return 0.0
    if {a[i : i + RUN] for i in range(len(a) - RUN + 1)}.isdisjoint([b[i : i + RUN] for i in range(len(b) - RUN + 1)]):
        return 0.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1, of two fingerprints: of the signatures at block sizes that both have, the best."""
    if a == b:
        return 1.0
    size_a, one_a, two_a = a.split(":")
    size_b, one_b, two_b = b.split(":")
    m, n = int(size_a), int(size_b)
    if m == n:
        pairs = ((one_a, one_b), (two_a, two_b))
    elif m == 2 * n:
        pairs = ((one_a, two_b),)
    elif n == 2 * m:
        pairs = ((two_a, one_b),)
    else:
        return 0.0
    return max(_alike(p, q) if p and q else 0.0 for p, q in pairs)


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint: one row a document, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(text).to_pylist()]
            found = [f for a, b in blocks(raw) for f in signatures(raw[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, pa.string())], names=[key, "fingerprint"])

    return arrow_map(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint string")


#: Characters of consecutive texts that a task holds, about.
HELD_CHARS = 3_000_000


def edited(own: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


_TOLD = [("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
TOLD = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _held_against_next(keys: list, texts: list[str], after: list[str], kind: pa.DataType) -> Iterator[tuple[list[pa.Array], int]]:
    """Columns of key and _TOLD, with their length, for texts and the text that comes after each."""
    for a, b in blocks(texts):
        own, following = texts[a:b], after[a:b]
        changed = [edited(t, n).encode() for t, n in zip(own, following)]
        prints, new = signatures([t.encode() for t in own]), signatures(changed)
        # most texts come after the one before them, and have their fingerprint already
        known = dict(zip(own, prints))
        rest = [t for t in following if t not in known]
        known.update(zip(rest, signatures([t.encode() for t in rest])))
        values = [list(map(len, own)), [hashlib.sha256(t).hexdigest() for t in changed], prints, new, [likeness(p, q) for p, q in zip(prints, new)], [likeness(p, known[t]) for p, t in zip(prints, following)]]
        yield [pa.array(keys[a:b], kind), *(pa.array(v, t) for v, (_, t) in zip(values, _TOLD))], b - a


def edited_likeness(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint held against that of its edited text and of the next document by ascending key.

    Columns: key and TOLD. After the last document comes the first. Keys are of any type that can
    be ordered, null ones come last, and rows with one key go by the hash of their text. Texts are
    shuffled once, by ranges of keys; a range's first and last text are set aside, and the last of
    each range then meets the first of the next: two texts a range, and no limit to the ranges.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    order = [F.asc_nulls_last("key"), F.xxhash64("text")]
    names = ["key", *(n for n, _ in _TOLD), "part", "edge", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is told of all texts but the last; the first (edge 0) and the last (edge 1) are passed on."""
        part, keys, texts, held, first = TaskContext.get().partitionId(), [], [], 0, True

        def told() -> Iterator[pa.RecordBatch]:
            for columns, n in _held_against_next(keys[:-1], texts[:-1], texts[1:], type_):
                yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.string()))], names=names)

        def edge(which: int, own: object, body: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([own], type_), *(pa.nulls(1, t) for _, t in _TOLD), pa.array([part], pa.int32()), pa.array([which], pa.int32()), pa.array([body], pa.string())], names=names)

        for batch in batches:
            type_ = batch.column("key").type
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                if first:
                    yield edge(0, k, t)
                    first = False
                keys.append(k)
                texts.append(t)
                held += len(t)
                if held > HELD_CHARS:
                    yield from told()
                    keys, texts, held = keys[-1:], texts[-1:], len(t)
        if texts:
            yield from told()
            yield edge(1, keys[-1], texts[-1])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    found = written(arrow_map(ranged, run, f"key {kind}, {TOLD}, part int, edge int, text string"), "fingerprints")
    firsts = found.filter("edge = 0").select("part", F.col("text").alias("after"))
    # the range that follows each, by the numbers of the ranges only; the first follows the last
    parts = firsts.select("part", F.lead("part").over(Window.orderBy("part")).alias("next"))
    parts = parts.join(F.broadcast(firsts.agg(F.min("part").alias("least")))).select("part", F.coalesce("next", "least").alias("next"))
    lasts = found.filter("edge = 1").select("part", "key", "text").join(parts, "part").join(firsts.withColumnRenamed("part", "next"), "next").select("key", "text", "after")

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns, _ in _held_against_next(*(batch.column(c).to_pylist() for c in ("key", "text", "after")), batch.column("key").type):
                yield pa.RecordBatch.from_arrays(columns, names=names[:-3])

    out = found.filter("edge is null").select(*names[:-3]).unionByName(arrow_map(lasts, meet, f"key {kind}, {TOLD}"))
    return out.select(F.col("key").alias(key), *(n for n, _ in _TOLD))
