"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document's features are the hashes of its distinct words (each text's word
weights have length one together) and standardised statistics of its structure and
metadata, with their squares. The machine adds to a linear score the products of
all pairs of features, weighted by the inner product of their low-rank vectors; the
identity sum over pairs = half of (square of sum less sum of squares) gives that in
time linear in the features.

Labels are learned from a bounded sample, chosen by the hash of the key; scoring
reads every whole text where it is stored, without a shuffle.

Defined cases: a null text is empty and gets a score as any other; null metadata
counts as the mean; without labelled rows every score is 0.5; of conflicting labels
of one key the lowest counts; repeated rows give equal rows; an empty table gives an
empty one; extra columns are ignored, or kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.chars import DIGIT, HIGH, LINE, LOWER, MARK, N_CLASSES, OTHER_LETTER, SPACE, UPPER, classes, code_points, lowered, run_hashes, runs
from quern.llm.common import arrow_map, batch_of, blocks, texts_of

WORD_BUCKETS = 1 << 15
RANK = 8
#: Labelled rows that the machine is fitted on at most.
SAMPLE_ROWS = 12_000
#: Distinct words of a text that fitting looks at at most, those of the lowest buckets (as good as random ones): with
#: SAMPLE_ROWS it bounds what the driver gets, 50 MB whatever the texts. Scoring looks at all words.
FIT_WORDS = 2_048
EPOCHS = 8
BATCH = 256
KEEP_FROM = 0.3
N_STATISTICS = 18


def _distinct(of: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (text, value), sorted, with how often each is there; value is under 2 ** 32, text under 2 ** 31."""
    key, count = np.unique(of.astype(np.uint64) << np.uint64(32) | value.astype(np.uint64), return_counts=True)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), count


def features(texts: list[str], metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word features as (begins by text, bucket, weight), and the statistics table, texts x (N_STATISTICS + metadata)."""
    n = len(texts)
    codes, begins = code_points(texts)
    kind = classes()[codes]
    own = np.repeat(np.arange(n), np.diff(begins))
    by_class = np.bincount(own * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    size = np.diff(begins) - 1
    by_class[:, LINE] -= 1  # the separator
    first, last = runs((kind != SPACE) & (kind != LINE))
    hashed = run_hashes(lowered()[codes], first, last)
    word_of = own[first] if len(first) else np.zeros(0, np.int64)
    text, value, count = _distinct(word_of, hashed >> np.uint64(32), n)
    words, kinds = np.bincount(word_of, minlength=n), np.bincount(text, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, text, count)
    twice = np.bincount(word_of[1:][(hashed[1:] == hashed[:-1]) & (word_of[1:] == word_of[:-1])], minlength=n)
    length = np.bincount(word_of, weights=last - first, minlength=n)
    square = np.bincount(word_of, weights=(last - first).astype(float) ** 2, minlength=n)
    longest = np.zeros(n)
    np.maximum.at(longest, word_of, last - first)
    ends = np.flatnonzero(kind == LINE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    filled = ends > starts
    lines = run_hashes(codes, starts[filled], ends[filled])
    line_of = own[starts[filled]]
    n_lines, line_text = np.bincount(line_of, minlength=n), _distinct(line_of, lines >> np.uint64(32), n)[0]
    chars, w, rows = np.maximum(size, 1), np.maximum(words, 1), np.maximum(n_lines, 1)
    alpha = by_class[:, LOWER] + by_class[:, UPPER] + by_class[:, OTHER_LETTER]
    mean = length / w
    table = np.stack(
        [
            np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(square / w - mean**2, 0)), np.log1p(longest),
            alpha / chars, by_class[:, UPPER] / np.maximum(alpha, 1), by_class[:, DIGIT] / chars, by_class[:, MARK] / chars, by_class[:, HIGH] / chars, by_class[:, SPACE] / chars, by_class[:, LINE] / chars,
            kinds / w, kinds / np.sqrt(w), top / w, twice / w, 1 - np.bincount(line_text, minlength=n) / rows, np.log1p(size / rows),
            *metadata.T,
        ],
        axis=1,
    )
    # words meet in buckets: each bucket of a text counts once
    text, bucket, _ = _distinct(text, value % WORD_BUCKETS, n)
    per = np.bincount(text, minlength=n)
    weight = (1 / np.sqrt(np.maximum(per, 1)))[text].astype(np.float32)
    return np.concatenate([[0], np.cumsum(per)]), bucket, weight, table


@dataclass
class Machine:
    """w0 + sum of w_i x_i + half the sum over factors of (sum of v_if x_i) squared less the sum of (v_if x_i) squared."""

    n_statistics: int
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.ones(0))
    bias: float = 0.0
    linear: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, RANK), np.float32))

    def rows(self, begins: np.ndarray, bucket: np.ndarray, weight: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows (begins, feature, value): the words, then the standardised statistics and their squares."""
        z = np.where(np.isfinite(table), np.clip((table - self.mean) / self.spread, -4, 4), 0)
        dense = np.concatenate([z, z * z - 1], axis=1).astype(np.float32) / 2
        n, k = dense.shape
        at = begins[:-1] + k * np.arange(n)
        total = begins + k * np.arange(n + 1)
        index, value = np.empty(total[-1], np.int64), np.empty(total[-1], np.float32)
        dense_at = (at + np.diff(begins))[:, None] + np.arange(k)
        is_word = np.ones(total[-1], bool)
        is_word[dense_at] = False
        index[is_word], value[is_word] = bucket, weight
        index[dense_at], value[dense_at] = WORD_BUCKETS + np.arange(k), dense
        return total, index, value

    def raw(self, begins: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic function, with each value times its factors and their sums; every row has features."""
        vx = self.factors[index] * value[:, None]
        sums = np.add.reduceat(vx, begins[:-1], axis=0)
        own = np.add.reduceat((vx * vx).sum(axis=1), begins[:-1])
        return self.bias + np.add.reduceat(self.linear[index] * value, begins[:-1]) + 0.5 * ((sums * sums).sum(axis=1) - own), vx, sums

    def fit(self, begins: np.ndarray, bucket: np.ndarray, weight: np.ndarray, table: np.ndarray, y: np.ndarray) -> None:
        """Adagrad on the logistic loss, in a fixed order of rows."""
        some = np.where(np.isfinite(table), table, np.nan)
        self.mean = np.nan_to_num(np.nanmean(some, axis=0)) if len(y) else np.zeros(table.shape[1])
        self.spread = np.maximum(np.nan_to_num(np.nanstd(some, axis=0)), 1e-6) if len(y) else np.ones(table.shape[1])
        begins, index, value = self.rows(begins, bucket, weight, table)
        n = WORD_BUCKETS + 2 * table.shape[1]
        rng = np.random.default_rng(5)
        self.linear, self.factors = np.zeros(n, np.float32), rng.normal(0, 0.02, (n, RANK)).astype(np.float32)
        rate = min(max(float(y.mean()) if len(y) else 0.5, 0.01), 0.99)
        self.bias = float(np.log(rate / (1 - rate)))
        seen, seen_v, seen_b = np.full(n, 1e-2, np.float32), np.full((n, RANK), 1e-2, np.float32), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for at in range(0, len(y), BATCH):
                pick = order[at : at + BATCH]
                many = begins[pick + 1] - begins[pick]
                edge = np.concatenate([[0], np.cumsum(many)])
                where = np.repeat(begins[pick] - edge[:-1], many) + np.arange(edge[-1])
                i, x = index[where], value[where]
                s, vx, sums = self.raw(edge, i, x)
                slope = ((1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[pick]) / len(pick)).astype(np.float32)
                row = np.repeat(np.arange(len(pick)), many)
                used, inverse = np.unique(i, return_inverse=True)
                gx = slope[row] * x
                g = np.bincount(inverse, gx, len(used)).astype(np.float32) + 1e-5 * self.linear[used]
                gv = np.zeros((len(used), RANK), np.float32)
                np.add.at(gv, inverse, gx[:, None] * (sums[row] - vx))
                gv += 1e-5 * self.factors[used]
                gb = float(slope.sum())
                seen[used] += g * g
                seen_v[used] += gv * gv
                seen_b += gb * gb
                self.linear[used] -= 0.1 * g / np.sqrt(seen[used])
                self.factors[used] -= 0.05 * gv / np.sqrt(seen_v[used])
                self.bias -= 0.1 * gb / seen_b**0.5

    def score(self, begins: np.ndarray, bucket: np.ndarray, weight: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(self.linear):
            return np.full(len(begins) - 1, 0.5)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(begins, bucket, weight, table))[0].astype(float), -30, 30)))


def _metadata(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Signed logarithms of numeric columns; null is not a number."""
    rows = [np.array([np.nan if v is None else float(v) for v in batch.column(c).to_pylist()]) for c in columns]
    table = np.array(rows, float).reshape(len(columns), batch.num_rows).T
    return np.sign(table) * np.log1p(np.abs(table))


def score_texts(machine: Machine, texts: list[str], metadata: np.ndarray) -> np.ndarray:
    return np.concatenate([machine.score(*features(texts[a:b], metadata[a:b])) for a, b in blocks(texts)] or [np.zeros(0)])


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, key: str = "doc_id", text: str = "text", metadata: Sequence[str] = ("n_chars",), label: str = "quality", most: int = SAMPLE_ROWS) -> Machine:
    """A machine fitted on at most ``most`` of the labelled documents for which ``learn_from`` holds.

    The labels chosen are at most ``most`` rows, so they are broadcast; features of as many rows, FIT_WORDS words each at
    most, reach the driver.
    """
    chosen = labels.filter(learn_from & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("__y"))
    chosen = chosen.orderBy(F.xxhash64(key), key).limit(most)
    rows = docs.select(key, text, *metadata).join(F.broadcast(chosen), key)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, table = texts_of(batch, text), _metadata(batch, metadata)
            for a, b in blocks(texts):
                begins, bucket, weight, stats = features(texts[a:b], table[a:b])
                words = [bucket[p : min(q, p + FIT_WORDS)].astype("<u2").tobytes() for p, q in zip(begins, begins[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(key).slice(a, b - a), batch.column("__y").slice(a, b - a), pa.array(words, pa.binary()), pa.array(list(stats), pa.list_(pa.float64()))], names=[key, "y", "words", "stats"])

    kind = docs.schema[key].dataType.simpleString()
    found = arrow_map(rows, run, f"`{key}` {kind}, y int, words binary, stats array<double>").orderBy(F.xxhash64(key), key, F.xxhash64("words")).limit(most).toPandas()
    words = [np.frombuffer(w, "<u2") for w in found["words"]]
    per = np.array([len(w) for w in words], np.int64)
    machine = Machine(N_STATISTICS + len(metadata))
    if len(found):
        weight = np.repeat(1 / np.sqrt(np.maximum(per, 1)), per).astype(np.float32)
        machine.fit(np.concatenate([[0], np.cumsum(per)]), np.concatenate(words).astype(np.int64), weight, np.array(found["stats"].tolist(), float), found["y"].to_numpy(float))
    return machine


def score(df: DataFrame, machine: Machine, held_out: Column, key: str = "doc_id", text: str = "text", metadata: Sequence[str] = ("n_chars",), keep_from: float = KEEP_FROM) -> DataFrame:
    """key, held_out, score, predicted: one row a document."""
    fields = pa.schema([("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(machine, texts_of(batch, text), _metadata(batch, metadata))
            yield batch_of(fields, **{key: batch.column(key)}, held_out=batch.column("__held_out"), score=pa.array(found), predicted=pa.array((found >= keep_from).astype(np.int32)))

    rows = df.select(key, text, *metadata, held_out.alias("__held_out"))
    return arrow_map(rows, run, f"`{key}` {df.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")


def keep_good(df: DataFrame, machine: Machine, text: str = "text", metadata: Sequence[str] = ("n_chars",), keep_from: float = KEEP_FROM) -> DataFrame:
    """The rows of ``df``, all columns kept, that score ``keep_from`` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score_texts(machine, texts_of(batch, text), _metadata(batch, metadata))
            yield batch.filter(pa.array(found >= keep_from))

    return df.mapInArrow(run, df.schema)
