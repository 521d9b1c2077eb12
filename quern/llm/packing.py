"""Bounded-space online best-fit packing of tokenised documents into sequences.

Documents are tokenised where they are read; only longer ones are cut. What is
shuffled is a few numbers a piece, never text or tokens: pieces are dealt evenly
over as many tasks as their tokens ask for, whatever their source, and each task
takes its pieces as they come, by document. The open bins' free spaces are a bitset
(bit f: there is a bin with f tokens free), so the tightest bin that still takes a
piece is found by a shift and the lowest set bit. OPEN_BINS are open at a time; when
one more is needed, the fullest closes for good. Pieces wait in a buffer of LOOK_AHEAD,
which is placed longest first when it is full; a buffer of one is strictly online and
makes about 1 % more sequences.

Defined cases: a null or empty text is its end token alone; the strings of the tokenizer's
special tokens are these tokens, as the library reads them; repeated rows are packed as
often as they are there; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from quern.llm.common import arrow_map, blocks, checkpointed, texts_of

CAPACITY = 2048
#: Bins open at a time in a task; a task makes about 20 times as many.
OPEN_BINS = 1_024
#: Pieces that wait to be placed at a time.
LOOK_AHEAD = 1_024
#: Tokens that one packing task takes; its last open bins are all that it can waste.
TASK_TOKENS = 40_000_000
#: Distinct words in a worker's table of ids; it keeps this and the one that was full before.
WORDS_KEPT = 300_000
#: Characters whose words are looked up together, unless one text alone is longer, and new parts of words encoded by one call.
BLOCK_CHARS = 3_000_000
PARTS_AT_ONCE = 1_000
END = np.array([0], "<u4").tobytes()


class Recent:
    """Ids of the words met of late: a full table becomes the older one, whose words come back as they are met again."""

    def __init__(self, learn: Callable[[list[str], Recent], dict[str, bytes]]) -> None:
        self.learn, self.kept, self.older = learn, {}, {}

    def get(self, word: str) -> bytes | None:
        return self.kept.get(word, self.older.get(word))

    def ids(self, distinct: list[str]) -> list[bytes]:
        new = [w for w in distinct if w not in self.kept]
        if len(self.kept) + len(new) > WORDS_KEPT:
            self.kept, self.older, new = {}, self.kept, distinct
        self.kept.update({w: self.older[w] for w in new if w in self.older})
        self.kept.update(self.learn([w for w in new if w not in self.older], self))
        return list(map(self.kept.__getitem__, distinct))


class Words:
    """Ids of texts by a tokenizer that lower-cases, drops white space, splits into parts and marks a part's last token: each distinct word is encoded once.

    Where a text has plain characters and no special token only, lower-casing and splitting it here is what the tokenizer would do, so
    forms of one word share their entry. Else words go to the tokenizer as they are, parted at spaces and line feeds only, which no
    token, composition or pattern of the tokenizer spans.
    """

    word = re.compile("[^ \n]+")
    #: ASCII text and composed Latin letters, but for the one such letter that lower-cases to two characters
    plain = re.compile("[\t\n\r\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u017f]*")
    part = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        #: strings that the tokenizer finds in a text before all else
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: the same model for parts that are already lower-cased and split, with a space after each
        self.of_parts = Tokenizer(self.library.model)
        self.of_parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        #: by id: does the token end a part?
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.library.model.end_of_word_suffix)]] = True
        self.plain_words, self.odd_words = Recent(self._learn_plain), Recent(self._learn_odd)

    def _learn_odd(self, words: list[str], known: Recent) -> dict[str, bytes]:
        return {w: np.array(got.ids, "<u4").tobytes() for w, got in zip(words, self.library.encode_batch_fast(words, add_special_tokens=False))}

    def _learn_plain(self, words: list[str], known: Recent) -> dict[str, bytes]:
        """Ids of the words and of their parts that were not known; a word of letters alone is one part."""
        split = {w: self.part.findall(w) for w in words if not w.isalpha()}
        parts = set().union(*split.values())
        found = {p: ids for p in parts if (ids := known.get(p)) is not None}
        parts.update(w for w in words if w not in split)
        new = [p for p in parts if p not in found]
        for at in range(0, len(new), PARTS_AT_ONCE):
            some = new[at : at + PARTS_AT_ONCE]
            ids = np.array(self.of_parts.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not mark the last token of each part")
            raw = ids.tobytes()
            found.update(zip(some, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        found.update({w: b"".join([found[p] for p in own]) for w, own in split.items()})
        return found

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(texts, pa.large_string())))
        words = split.flatten().dictionary_encode()
        known = self.plain_words.ids(words.dictionary.to_pylist())
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(lengths) - lengths
        which = words.indices.to_numpy()
        counts = lengths[which]
        until = np.concatenate([[0], np.cumsum(counts)])
        places = np.repeat(starts[which] - until[:-1], counts)
        places += np.arange(until[-1])
        raw = np.frombuffer(b"".join(known), "<u4")[places].tobytes()
        bounds = (until[split.offsets.to_numpy()] * 4).tolist()
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def _encode_odd(self, texts: list[str]) -> list[bytes]:
        split = list(map(self.word.findall, texts))
        distinct = list({w for own in split for w in own})
        known = dict(zip(distinct, self.odd_words.ids(distinct)))
        return [b"".join([known[w] for w in own]) for own in split]

    def is_plain(self, text: str) -> bool:
        return self.plain.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for a, b in blocks(texts, BLOCK_CHARS):
            some = texts[a:b]
            plain = list(map(self.is_plain, some))
            ids = {True: iter(self._encode_plain([t for t, p in zip(some, plain) if p])), False: iter(self._encode_odd([t for t, p in zip(some, plain) if not p]))}
            out += [next(ids[p]) for p in plain]
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Words:
    return Words(path)


class OpenBins:
    """At most ``most`` open bins of ``capacity``; tells for each piece its bin and the place in it."""

    def __init__(self, capacity: int = CAPACITY, most: int = OPEN_BINS) -> None:
        self.capacity, self.most = capacity, most
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = self.open = self.made = 0

    def _take(self, space: int) -> int:
        bin_ = self.free[space].pop()
        if not self.free[space]:
            self.bits &= ~(1 << space)
        self.open -= 1
        return bin_

    def put(self, length: int) -> tuple[int, int]:
        if fits := self.bits >> length:
            space = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(space)
        else:
            if self.open == self.most:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, bin_ = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - space


def pieces(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32 and, if asked for, ids (binary): a row for each piece of each document."""
    kind = df.schema[key].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(path)
        for batch in batches:
            row, rest, raw = [], [], []
            for i, ids in enumerate(words.encode_all(texts_of(batch, text))):
                ids += END
                for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    row.append(i)
                    rest.append((p, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        raw.append(part)
            table = np.array(rest, np.int64).reshape(-1, 4)
            out = [batch.column(key).take(pa.array(row, pa.int64())), pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, c]) for c in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(raw, pa.binary())] * with_ids, names=[key, *names] + ["ids"] * with_ids)

    return arrow_map(df.select(key, text), run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def buffers(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a stream of batches, ``size`` at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, size - rows))
            at, rows = at + held[-1].num_rows, rows + held[-1].num_rows
            if rows == size:
                yield pa.concat_batches(held)
                held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


def place(found: DataFrame, capacity: int = CAPACITY, most: int = OPEN_BINS, task_tokens: int = TASK_TOKENS, ahead: int = LOOK_AHEAD) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of 1 to ``capacity``.

    ``found`` is read twice (its total, then its rows), so it should be checkpointed or written.
    Rows are dealt evenly, not by a key, and come by their other columns, so that a task which runs again gives the same.
    """
    total = found.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, round(total / task_tokens))
    length = found.columns.index("length")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(capacity, most), TaskContext.get().partitionId() << 40
        for held in buffers(batches, ahead):
            lengths = held.column(length).to_numpy()
            at = np.empty((len(lengths), 2), np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                at[i] = bins.put(int(lengths[i]))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array(at[:, 0] + base), pa.array(at[:, 1])], names=[*held.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    order = [c for c in found.columns if c not in ("length", "ids")]
    return arrow_map(found.repartition(tasks).sortWithinPartitions(*order), run, schema)


def pack_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False, most: int = OPEN_BINS, ahead: int = LOOK_AHEAD) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset: where each piece of each document stands."""
    return place(checkpointed(pieces(df, path, key, text, capacity, with_ids)), capacity, most, ahead=ahead)
