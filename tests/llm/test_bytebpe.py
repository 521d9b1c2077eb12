import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bytebpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
CODEC = bytebpe.codec(PATH, P.PATTERN)
BY_RANK = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.load_ranks(PATH), special_tokens={})


def ids(text):
    return np.frombuffer(CODEC.encode_all([text])[0], "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encodes_as_the_ranks_say(text):
    assert ids(text) == BY_RANK.encode_ordinary(text)
    assert CODEC.decode(CODEC.encode_all([text])[0]) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé  \n'sS9٣_\x1c\u00a0-", max_size=80))
def test_runs_and_blanks(text):
    assert ids(text) == BY_RANK.encode_ordinary(text)


def test_long_text_is_split_in_steps(monkeypatch):
    text = "word, mot 12\n" * 3000 + "漢"
    whole = ids(text)
    monkeypatch.setattr(bytebpe, "SPLIT_CHARS", 100)
    monkeypatch.setattr(bytebpe, "PIECES_KEPT", 3)
    assert ids(text) == whole == BY_RANK.encode_ordinary(text)


def test_offsets_of_split_characters():
    text = "a漢😀b"
    raw = CODEC.encode_all([text])[0]
    starts, ends = CODEC.offsets(text, raw)
    at = 0
    for token, a, b in zip(np.frombuffer(raw, "<u4"), starts, ends):
        piece = CODEC.bytes_of[token]
        covered = text.encode()[at : at + len(piece)]
        assert piece == covered and text[a:b].encode().find(covered) >= 0 and b > a
        at += len(piece)
    assert CODEC.offsets("", b"") == ([], [])


def test_table(edge, empty):
    rows = bytebpe.token_digests(edge, PATH, P.PATTERN).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in edge.collect()}
    assert len(rows) == edge.count() and bytebpe.token_digests(empty, PATH, P.PATTERN).count() == 0
    for r in rows:
        want = BY_RANK.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    coded = bytebpe.encode_texts(edge, PATH, P.PATTERN)
    assert {(r["doc_id"], r["text"]) for r in bytebpe.decode_ids(coded, PATH, P.PATTERN).collect()} == {(k, v) for k, v in texts.items()}
