import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import packing

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.encode_special_tokens = True


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_words_as_the_tokenizer(text):
    assert np.frombuffer(packing.tokenizer(PATH).encode_all([text])[0], "<u4").tolist() == ids(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aEé İß\n\t'sST9_!́ ", max_size=40), max_size=5))
def test_plain_and_other_texts_together(texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.tokenizer(PATH).encode_all(texts)] == [ids(t) for t in texts]


def plain_best_fit(lengths, capacity, most):
    """Bounded-space best fit, with open bins as a list."""
    open_, made, out = [], 0, []
    for n in lengths:
        fits = [b for b in open_ if b[0] >= n]
        if fits:
            b = min(fits, key=lambda b: b[0])
        else:
            if len(open_) == most:
                open_.remove(min(open_, key=lambda b: b[0]))
            b = [capacity, made]
            open_.append(b)
            made += 1
        out.append(capacity - b[0])
        b[0] -= n
        if not b[0]:
            open_.remove(b)
    return made, out


@given(st.lists(st.integers(1, 20), max_size=80), st.integers(1, 6))
def test_bins_against_a_plain_form(lengths, most):
    bins = packing.OpenBins(20, most)
    got = [bins.put(n) for n in lengths]
    made, places = plain_best_fit(lengths, 20, most)
    assert bins.made == made and sorted(p for _, p in got) == sorted(places)


def check(rows, texts, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc, (text, copies) in texts.items():
        own = [*ids(text or ""), 0]
        parts = [own[i : i + capacity] for i in range(0, len(own), capacity)]
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc])
        assert got == sorted(copies * [(i, i * capacity, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, p in enumerate(parts)])
    for parts in by_seq.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= capacity
    return len(by_seq)


def test_edges(edge, empty):
    texts = defaultdict(lambda: [None, 0])
    for r in edge.collect():
        texts[r["doc_id"]] = [r["text"], texts[r["doc_id"]][1] + 1]
    check(packing.pack_documents(edge, PATH).collect(), texts, 2048)
    check(packing.pack_documents(edge, PATH, capacity=5).collect(), texts, 5)
    assert packing.pack_documents(empty, PATH).count() == 0


def test_few_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    made = check(rows, {r["doc_id"]: (r["text"], 1) for r in docs.collect()}, 2048)
    assert made <= 1.02 * -(-sum(r["length"] for r in rows) // 2048) + 1


def test_many_tasks_and_ids(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = packing.pieces(docs, PATH, with_ids=True).cache()
    rows = packing.place(found, task_tokens=20_000).collect()
    assert len({r["sequence_id"] >> 40 for r in rows}) > 2
    check(rows, {r["doc_id"]: (r["text"], 1) for r in docs.collect()}, 2048)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)


def test_special_strings_as_the_plain_library_reads_them(spark):
    plain = Tokenizer.from_file(PATH)
    texts = ["<|endoftext|>", "A b<|endoftext|>c  <|startoftext|>", "<|ENDOFTEXT|>", "é <|endoftext|>\n\nDon't", "<|endoftext", "<|endoftext|><|endoftext|> x", "plain Words"]
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [49407]
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.tokenizer(PATH).encode_all(texts)] == want
    rows = packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH, with_ids=True).collect()
    assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows} == {i: [*x, 0] for i, x in enumerate(want)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "Ab", "é", " ", "\n", "'s", "1"]), max_size=8).map("".join))
def test_special_strings_anywhere(text):
    assert np.frombuffer(packing.tokenizer(PATH).encode_all([text])[0], "<u4").tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def in_buffers(lengths, ahead):
    """As they come, each buffer longest first."""
    return [n for i in range(0, len(lengths), ahead) for n in sorted(lengths[i : i + ahead], reverse=True)]


@pytest.mark.parametrize("most,ahead", [(2, 1), (2, 50), (5, 7), (packing.OPEN_BINS, 1)])
def test_bins_close_in_packing(spark, most, ahead):
    """One task and few open bins: as many sequences as the plain form makes of the pieces as they come."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs, PATH, most=most, ahead=ahead).collect()
    made = check(rows, {r["doc_id"]: (r["text"], 1) for r in docs.collect()}, 2048)
    lengths = in_buffers([r["length"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"]))], ahead)
    assert made == plain_best_fit(lengths, 2048, most)[0]
    if most == 2:
        assert made > plain_best_fit(lengths, 2048, 1 << 20)[0]


def test_bound_of_production_binds(spark):
    """2,048 pieces that each leave room for one of the 2,048 that follow: only those in open bins are filled up."""
    lengths = [1500] * 2048 + [548] * 2048
    found = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long").repartition(4)
    rows = packing.place(found).collect()
    assert len({r["sequence_id"] for r in rows}) == plain_best_fit(lengths, 2048, packing.OPEN_BINS)[0] == 2048 + -(-(2048 - packing.OPEN_BINS) // 3)


def test_strictly_online(spark):
    """A buffer of one: what comes first opens the first sequences, whatever its length."""
    found = spark.createDataFrame([(i, n) for i, n in enumerate([10, 2048, 30, 2000])], "doc_id long, length long")
    rows = sorted(packing.place(found, ahead=1).collect(), key=lambda r: r["doc_id"])
    assert [(r["sequence_id"], r["offset"]) for r in rows] == [(0, 0), (1, 0), (0, 10), (0, 40)]


def test_words_beyond_the_table(monkeypatch):
    """Tables that are full many times over, and words whose parts were met before or in the older table, change no id."""
    monkeypatch.setattr(packing, "WORDS_KEPT", 20)
    monkeypatch.setattr(packing, "BLOCK_CHARS", 60)
    monkeypatch.setattr(packing, "PARTS_AT_ONCE", 3)
    words = ["Hello", "hello,", "world's", "x9y", "É", "straße,", "a_b", "...", "''s", "don't", "ſ", "日本", "ét", "İx", "_", "2²"]
    texts = ["", " ", "\n\t"] + [" ".join(words[i % 16 :: 3] + [f"w{i}q", "tail."]) for i in range(60)] + [" ".join(words) * 5]
    own, plain = packing.Words(PATH), Tokenizer.from_file(PATH)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(own.plain_words.kept) + len(own.odd_words.kept) <= 200
