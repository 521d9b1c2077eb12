"""Byte-level BPE over Arrow batches with the tokenizers library.

The ranks file gives the vocabulary. Each pair of tokens whose joined bytes are a
token is a merge, in the order of the joined token's rank, so that the library
merges as the ranks say. Every distinct piece (match of the pattern) is encoded
once by the library and kept in a bounded table, which bounds memory and spares
repeated work; where two merges of one rank overlap, the library's order may
differ from leftmost-first, so each new piece is checked against the ranks and the
ranks win.

Defined cases: a null text is empty and has no tokens; special tokens' strings are
ordinary text; repeated rows give equal rows; an empty table gives an empty one; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from tokenizers import Tokenizer, models, pre_tokenizers

from quern.llm.common import arrow_map, batch_of, blocks, texts_of

#: Distinct pieces that a worker keeps; beyond it the table starts anew.
PIECES_KEPT = 600_000
#: Characters of a text that are split at a time.
SPLIT_CHARS = 4_000_000

#: Where a text has only these characters, the two engines' classes agree and the faster one splits it.
_PLAIN = re.compile("[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ſ]")


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where it is visible in Latin-1, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Each split of a token into two tokens, by the joined rank, then by the parts' ranks."""
    found = [(rank, ranks[t[:i]], ranks[t[i:]], t[:i], t[i:]) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return [(a, b) for _, _, _, a, b in sorted(found)]


class ByteBPE:
    """Encodes and decodes texts; one a worker process, kept by ``codec``."""

    def __init__(self, path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        # the same pattern in the standard library's terms, for plain texts only
        self.plain = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
        chars = byte_characters()
        shown = lambda token: "".join(map(chars.__getitem__, token))
        self.library = Tokenizer(models.BPE(vocab={shown(t): r for t, r in self.ranks.items()}, merges=[(shown(a), shown(b)) for a, b in merges_of(self.ranks)], ignore_merges=True))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: takes a piece as one match, whatever is in it
        self.exact = tiktoken.Encoding("ranks", pat_str="(?s:.+)", mergeable_ranks=self.ranks, special_tokens={})
        back = {c: b for b, c in enumerate(chars)}
        self.bytes_of = {self.library.token_to_id(shown(t)): bytes(back[c] for c in shown(t)) for t in self.ranks}
        self.kept: dict[str, bytes] = {}

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded size."""
        split = self.pattern if _PLAIN.search(text) else self.plain
        if len(text) <= SPLIT_CHARS:
            yield split.findall(text)
            return
        held: list[str] = []
        for match in split.finditer(text):
            held.append(match[0])
            if len(held) >= 500_000:
                yield held
                held = []
        yield held

    def _learn(self, distinct: set[str]) -> None:
        """Encodes new pieces by the library, holds them against the ranks and keeps them."""
        new = [p for p in distinct if p not in self.kept]
        if len(self.kept) + len(new) > PIECES_KEPT:
            self.kept, new = {}, list(distinct)
        kept, by_rank, pack = self.kept, self.exact.encode_ordinary, [struct.Struct(f"<{n}I").pack for n in range(64)]
        for piece, got in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False)):
            ids = got.ids
            if len(ids) > 1 and ids != (ranked := by_rank(piece)):
                ids = ranked
            kept[piece] = pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for a, b in blocks(texts):
            if b - a == 1 and len(texts[a]) > SPLIT_CHARS:  # one very long text, piece by piece
                ids = []
                for pieces in self.pieces(texts[a]):
                    self._learn(set(pieces))
                    kept = self.kept
                    ids.append(b"".join([kept[p] for p in pieces]))
                out.append(b"".join(ids))
                continue
            split = [next(self.pieces(t)) for t in texts[a:b]]
            self._learn(set().union(*split))
            kept = self.kept
            out += [b"".join([kept[p] for p in pieces]) for pieces in split]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for; a token may begin or end inside a character."""
        table = self.bytes_of
        return b"".join([table[i] for i in memoryview(ids).cast("I")])

    def offsets(self, text: str, ids: bytes) -> tuple[list[int], list[int]]:
        """First and past-last character of each token; a token with part of a character spans that character."""
        starts = np.cumsum(np.fromiter((len(self.bytes_of[i]) for i in memoryview(ids).cast("I")), np.int64))
        raw = np.frombuffer(text.encode(), np.uint8)
        index = np.cumsum((raw & 0xC0) != 0x80) - 1  # of the character of each byte
        first = np.concatenate([[0], starts[:-1]]) if len(starts) else starts
        return (index[first].tolist(), (index[starts - 1] + 1).tolist()) if len(starts) else ([], [])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> ByteBPE:
    return ByteBPE(path, pattern)


def encode_texts(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids array<int>, starts array<int>, ends array<int> (character offsets)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, many = codec(path, pattern), pa.list_(pa.int32())
        for batch in batches:
            texts = texts_of(batch, text)
            ids = bpe.encode_all(texts)
            spans = [bpe.offsets(t, i) for t, i in zip(texts, ids)]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([np.frombuffer(i, "<i4") for i in ids], many), pa.array([s for s, _ in spans], many), pa.array([e for _, e in spans], many)], names=[key, "ids", "starts", "ends"])

    return arrow_map(df.select(key, text), run, f"`{key}` {kind}, ids array<int>, starts array<int>, ends array<int>")


def decode_ids(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, bytes binary, text string (null where the bytes aren't UTF-8). Null ids are empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            raw = [bpe.decode(np.array(i or [], "<u4").tobytes()) for i in batch.column(ids).to_pylist()]
            texts = []
            for r in raw:
                try:
                    texts.append(r.decode())
                except UnicodeDecodeError:
                    texts.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(raw, pa.binary()), pa.array(texts, pa.string())], names=[key, "bytes", "text"])

    return arrow_map(df.select(key, ids), run, f"`{key}` {kind}, bytes binary, text string")


def token_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 (of the bytes decoded from them)."""
    kind = df.schema[key].dataType.simpleString()
    fields = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            ids = bpe.encode_all(texts_of(batch, text))
            yield batch_of(fields, **{key: batch.column(key)}, n_tokens=[len(i) // 4 for i in ids], ids_sha256=[hashlib.sha256(i).hexdigest() for i in ids], decoded_sha256=[hashlib.sha256(bpe.decode(i)).hexdigest() for i in ids])

    return arrow_map(df.select(key, text), run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
