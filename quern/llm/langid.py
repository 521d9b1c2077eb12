"""Language identification of mixed-language text.

A word's script narrows its candidates to the languages that are written in it (to all
where none is); hashed character trigrams, word ends included, score each candidate; Viterbi over
the words, with a penalty for each switch, labels spans. A document's language is
the one whose spans have most letters; its score is their share of all letters, times
the logistic of how far it leads the next language on the words of those spans.

The Viterbi search runs over segments of words, each for every language that it
may be entered in, so that numpy takes a step of all segments at once and a very
long text takes no more steps than a short one; the segments are then chained.
The labels are those of one search over the whole text.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and has
no spans; without any labelled row every text is; ties go to the language that
sorts first; repeated rows give equal rows; an empty table gives an empty one; extra
columns are ignored, or kept by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.chars import N_SCRIPTS, code_points, letters, lowered, runs, scripts
from quern.llm.common import arrow_map, batch_of, blocks, texts_of

BUCKETS = 1 << 16
#: Labelled rows that a model is fitted on: a bounded sample by the hash of the key.
SAMPLE_ROWS = 20_000
SWITCH_PENALTY = 12.0
#: What a language that a word's script excludes loses on it where languages are compared over spans.
FOREIGN_SCRIPT = 60.0
#: Share of a language's letters from which a script counts as its own.
SCRIPT_SHARE = 0.01
SEGMENT = 256
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    #: log-probability by bucket and language
    gram: np.ndarray
    #: is the language written in the script?
    own: np.ndarray


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where letters are, the bucket of the trigram around each, and each word's first and past-last index."""
    is_letter = letters()[codes]
    low = np.where(is_letter, lowered()[codes], np.uint32(32)).astype(np.uint64)
    around = np.concatenate([[np.uint64(32)], low, [np.uint64(32)]])
    at = np.flatnonzero(is_letter)
    h = around[at] * np.uint64(0x9E3779B97F4A7C15) + around[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + around[at + 2] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    first, last = runs(is_letter)
    return at, (h >> np.uint64(48)).astype(np.int64), first, last


def label_kind(k: int) -> type:
    """The smallest unsigned type that holds k labels."""
    return np.min_scalar_type(max(k - 1, 0)).type


def viterbi(score: np.ndarray, begins: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of each text: ``score`` is words x labels, text i has the words begins[i] to begins[i + 1].

    A label that a word cannot have has the score minus infinity; every word can have one at least.
    """
    n, k = score.shape
    label = np.zeros(n, kind := label_kind(k))
    many = np.diff(begins)
    segs = -(-many // SEGMENT)
    text = np.repeat(np.arange(len(many)), segs)
    if not len(text):
        return label
    seg0 = np.cumsum(segs) - segs
    first = begins[:-1][text] + SEGMENT * (np.arange(len(text)) - seg0[text])
    size = np.minimum(SEGMENT, begins[1:][text] - first)
    order = np.argsort(-size, kind="stable")
    by_size, starts = size[order], first[order]
    v = np.full((len(order), k, k), -np.inf, np.float32)
    v[:, np.arange(k), np.arange(k)] = 0
    back, states = [], np.arange(k, dtype=kind)
    for t in range(by_size[0]):
        live = int(np.searchsorted(-by_size, -t, "left"))
        now = v[:live]
        top = now.max(axis=2, keepdims=True) - np.float32(penalty)
        moved = now < top
        back.append(np.where(moved, now.argmax(axis=2).astype(kind)[:, :, None], states))
        np.copyto(now, top, where=moved)
        now += score[starts[:live] + t][:, None, :]
    through = np.empty_like(v)
    through[order] = v
    # chain the segments of each text: exits[s] is the best label at the end of segment s, given what follows
    long = np.argsort(-segs, kind="stable")
    by_segs, head = segs[long], seg0[long]
    cost = np.zeros((len(long), k))
    came = []
    for j in range(int(by_segs[0])):
        live = int(np.searchsorted(-by_segs, -j, "left"))
        ways = cost[:live, :, None] + through[head[:live] + j]
        came.append(ways.argmax(axis=1).astype(kind))
        cost[:live] = ways.max(axis=1)
    entry, exit_ = np.zeros(len(text), kind), np.zeros(len(text), kind)
    state = cost.argmax(axis=1).astype(kind)
    for j in range(int(by_segs[0]) - 1, -1, -1):
        live = int(np.searchsorted(-by_segs, -j, "left"))
        exit_[head[:live] + j] = state[:live]
        state[:live] = came[j][np.arange(live), state[:live]]
        entry[head[:live] + j] = state[:live]
    state, entry = exit_[order], entry[order]
    for t in range(int(by_size[0]) - 1, -1, -1):
        live = int(np.searchsorted(-by_size, -t, "left"))
        label[starts[:live] + t] = state[:live]
        state[:live] = back[t][np.arange(live), entry[:live], state[:live]]
    return label


def detect(model: Model, texts: list[str], spans: bool = False) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """Language, score and, if asked for, spans (first and past-last character, language) of each text."""
    k = len(model.langs)
    if not texts or not k:
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    codes, begins = code_points(texts)
    at, gram, first, last = _words(codes)
    if not len(first):
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
    size = last - first
    script = scripts()[codes[first]]
    narrowed = model.own[script] | ~model.own[script].any(axis=1, keepdims=True)
    score = np.add.reduceat(model.gram[gram], np.cumsum(size) - size, axis=0)
    score -= np.where(narrowed, score, np.float32(-np.inf)).max(axis=1, keepdims=True)
    words = np.searchsorted(first, begins)  # first word of each text
    label = viterbi(np.where(narrowed, score, np.float32(-np.inf)), words, SWITCH_PENALTY)  # a word is of one of its candidates
    score = np.where(narrowed, score, np.minimum(score, 0) - np.float32(FOREIGN_SCRIPT))
    of = np.repeat(np.arange(len(texts)), np.diff(words))
    share = np.bincount(of * k + label, weights=size, minlength=len(texts) * k).reshape(-1, k)
    best, rows = share.argmax(axis=1), np.arange(len(texts))
    mine = label == best[of]
    spanned = np.stack([np.bincount(of[mine], weights=score[mine, c], minlength=len(texts)) for c in range(k)], axis=1)
    rest = spanned.copy()
    rest[rows, best] = -np.inf
    margin = np.clip(spanned[rows, best] - rest.max(axis=1), -50, 50)
    total = share.sum(axis=1)
    found = np.where(total > 0, share[rows, best] / np.maximum(total, 1) / (1 + np.exp(-margin)), 0.0)
    langs = [model.langs[b] if n else UNKNOWN for b, n in zip(best, total)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    if spans:
        cut = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (label[1:] != label[:-1])]))
        ends = np.append(cut[1:], len(of)) - 1
        for a, b in zip(cut.tolist(), ends.tolist()):
            zero = int(begins[of[a]])
            out[of[a]].append((int(first[a]) - zero, int(last[b]) - zero, model.langs[label[a]]))
    return langs, found, out


def _counts(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, kind, bucket, n): trigram counts (kind 0) and letters by script (kind 1), summed over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = texts_of(batch, text), np.array(batch.column(lang).to_pylist(), object)
            for name in set(langs):
                own = [texts[i] for i in np.flatnonzero(langs == name)]
                table = held.setdefault(name, np.zeros(BUCKETS + N_SCRIPTS, np.int64))
                for a, b in blocks(own):
                    codes, _ = code_points(own[a:b])
                    at, gram, _, _ = _words(codes)
                    table[:BUCKETS] += np.bincount(gram, minlength=BUCKETS)
                    table[BUCKETS:] += np.bincount(scripts()[codes[at]], minlength=N_SCRIPTS)
        for name, table in held.items():
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(table[some])], names=["lang", "bucket", "n"])

    return arrow_map(rows.select(text, lang), run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = SAMPLE_ROWS) -> Model:
    """A model of rows with a language, of about ``most`` of them, chosen by the hash of the key whatever their number.

    What reaches the driver is one table of bounded size a language.
    """
    labelled = labelled.filter(F.col(lang).isNotNull())
    share = most / max(1, labelled.count())
    if share < 1:
        labelled = labelled.filter(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = _counts(labelled, text, lang).toPandas()
    langs = sorted(rows["lang"].unique())
    table = np.zeros((BUCKETS + N_SCRIPTS, len(langs)))
    table[rows["bucket"], rows["lang"].map({x: i for i, x in enumerate(langs)})] = rows["n"]
    gram, by_script = table[:BUCKETS] + 0.1, table[BUCKETS:]
    own = by_script >= SCRIPT_SHARE * np.maximum(1, by_script.sum(axis=0))
    return Model(list(langs), np.log(gram / gram.sum(axis=0)).astype(np.float32), own)


def identify(df: DataFrame, model: Model, held_out: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, lang_pred, score: one row a document, without a shuffle."""
    fields = pa.schema([("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, text)
            langs, scores = [], []
            for a, b in blocks(texts):
                some, found, _ = detect(model, texts[a:b])
                langs += some
                scores += found.tolist()
            yield batch_of(fields, **{key: batch.column(key)}, held_out=batch.column("held_out"), lang_pred=langs, score=scores)

    rows = df.select(key, text, held_out.alias("held_out"))
    return arrow_map(rows, run, f"`{key}` {df.schema[key].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def label_spans(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, spans array<struct<first, past, lang>>: the spans of each document, in characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64()), ("lang", pa.string())]))
        for batch in batches:
            texts, out = texts_of(batch, text), []
            for a, b in blocks(texts):
                out += [[dict(zip(("first", "past", "lang"), s)) for s in own] for own in detect(model, texts[a:b], True)[2]]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(out, kind)], names=[key, "spans"])

    return arrow_map(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, spans array<struct<first: long, past: long, lang: string>>")


def keep_identified(df: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``df``, all columns kept, whose text has a language: not ``und``, and a score of ``least`` or more."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = texts_of(batch, text), []
            for a, b in blocks(texts):
                langs, found, _ = detect(model, texts[a:b])
                keep += [x != UNKNOWN and s >= least for x, s in zip(langs, found)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)
