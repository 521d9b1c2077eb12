import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import ctph


def brute(rows):
    """(doc_id, text) rows, ids distinct, to the contract's columns."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = {}
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        own, changed, next_ = (ctph.signatures([t.encode()])[0] for t in (text, new, after))
        out[key] = (len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed, ctph.likeness(own, changed), ctph.likeness(own, next_))
    return out


def got(df):
    return {r["doc_id"]: tuple(r)[1:] for r in ctph.edited_likeness(df).collect()}


def test_edges(edge, empty):
    distinct = edge.dropDuplicates(["doc_id"])
    assert got(distinct) == brute([(r["doc_id"], r["text"]) for r in distinct.collect()])
    assert ctph.edited_likeness(empty).count() == 0 and ctph.edited_likeness(edge).count() == edge.count()


@pytest.mark.parametrize("ranges", [1, 7, 211])
def test_ranges(spark, ranges):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(docs) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ids_of_any_type(spark):
    """Text ids, more than any one range has, and dates: the order is that of the type."""
    texts = [(f"d{i}", f"text number {i * i} and some more words {i % 7}") for i in range(3000)]
    found = got(spark.createDataFrame(texts, "doc_id string, text string").repartition(6))
    ordered = sorted(texts)
    assert len(found) == 3000
    for (key, own), (_, after) in list(zip(ordered, ordered[1:] + ordered[:1]))[::97] + [(ordered[-1], ordered[0])]:
        assert found[key][1] == hashlib.sha256((own[: len(own) - len(own) // 2] + after[: len(own) // 2]).encode()).hexdigest()
    days = spark.createDataFrame([(i, f"day {i}") for i in range(5)], "d int, text string").selectExpr("date_add(date'2024-01-01', d) as doc_id", "text")
    assert [r["edited_sha256"] for r in ctph.edited_likeness(days).orderBy("doc_id").collect()][-1] == hashlib.sha256(b"dayda").hexdigest()


def test_one_key_of_a_third_of_all_rows(spark):
    rows = [(7 if i % 3 == 0 else i, f"own text {i} of many") for i in range(3000)]
    out = ctph.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    assert out.count() == 3000 and out.filter("doc_id = 7").count() == 1001 and out.filter("near_next is null").count() == 0


def plain_signatures(data):
    """The method said for one text, byte after byte, in whole numbers."""
    window, hashes = [0] * 7, []
    for b in data:
        window = [b, *window[:6]]
        mixed = 0
        for back, w in enumerate(window):
            mixed ^= w << 5 * back
        h = (sum(window) + sum(w * (7 - back) for back, w in enumerate(window)) + mixed % 2**32) * 0x9E3779B1 % 2**32
        hashes.append(h ^ h >> 15)
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and sum(h % block == block - 1 for h in hashes) < 32:
        block //= 2

    def signature(size):
        ends = [i + 1 for i, h in enumerate(hashes) if h % size == size - 1][:63]
        if (ends[-1] if ends else 0) < len(data):
            ends.append(len(data))
        out = ""
        for a, z in zip([0, *ends], ends):
            h = sum((data[i] + 1) * pow(0x9E3779B97F4A7C15, i - a, 2**64) for i in range(a, z)) % 2**64
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            out += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[h >> 58]
        return out

    return f"{block}:{signature(block)}:{signature(2 * block)}"


def plain_likeness(a, b):
    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            new = [i]
            for j, d in enumerate(y, 1):
                new.append(row[j - 1] if c == d else 1 + min(row[j], new[j - 1]))
            row = new
        return row[-1]

    def alike(x, y):
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        run = any(x[i : i + 4] in y for i in range(len(x) - 3))
        return 1 - edits(x, y) / (len(x) + len(y)) if run else 0.0

    if a == b:
        return 1.0
    (m, a1, a2), (n, b1, b2) = ((int(x.split(":")[0]), *x.split(":")[1:]) for x in (a, b))
    pairs = [(a1, b1), (a2, b2)] if m == n else [(a1, b2)] if m == 2 * n else [(a2, b1)] if n == 2 * m else []
    return max([alike(p, q) for p, q in pairs], default=0.0)


def test_against_the_plain_form(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 4000").orderBy("doc_id").limit(60).collect()
    texts = [(r["text"] or "").encode() for r in rows] + [b"", b"a", bytes(range(256)), b"ab" * 500, b"\0" * 100]
    texts += [t[: len(t) // 2] + u[: len(t) // 2] for t, u in zip(texts, texts[1:])]
    found = ctph.signatures(texts)
    assert found == [plain_signatures(t) for t in texts]
    pairs = [(a, b) for i, a in enumerate(found) for b in found[i :: 9]]
    assert all(ctph.likeness(a, b) == pytest.approx(plain_likeness(a, b)) for a, b in pairs) and any(0 < ctph.likeness(a, b) < 1 for a, b in pairs)


@settings(deadline=None)
@given(st.binary(max_size=400))
def test_signatures_of_any_bytes(data):
    assert ctph.signatures([data, b"x", data]) == [plain_signatures(data), plain_signatures(b"x"), plain_signatures(data)]


def test_one_document(spark):
    assert got(spark.createDataFrame([(4, "abcdef")], "doc_id long, text string")) == brute([(4, "abcdef")])


def test_steps_give_the_same(monkeypatch):
    texts = [("word %d " % (i * i) * 90).encode() for i in range(30)] + [b"", b"x"]
    whole = ctph.signatures(texts)
    assert whole == [ctph.signatures([t])[0] for t in texts]
    monkeypatch.setattr(ctph, "CHUNK", 257)
    assert ctph.signatures(texts) == whole


def test_edits_stay_near():
    text = " ".join(f"{i * 7919 % 10007}x" for i in range(900))
    a = ctph.signatures([text.encode()])[0]
    assert ctph.likeness(a, ctph.signatures([(text[:2000] + " new words " + text[2000:]).encode()])[0]) > 0.8
    assert ctph.likeness(a, ctph.signatures([" ".join(f"{i * 104729 % 99991}y" for i in range(900)).encode()])[0]) == 0


@settings(deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert ctph.common_subsequence(a, b) == table[-1][-1]


def test_likeness_cases():
    assert ctph.likeness("3::", "3::") == 1 and ctph.likeness("3::", "3:A:A") == 0 and ctph.likeness("3:ABCDEFG:A", "6:X:ABCDEFG") == 0
    assert ctph.likeness("6:ABCDEFG:A", "3:X:ABCDEFG") == 1 and ctph.likeness("3:ABCDEFG:A", "12:ABCDEFG:A") == 0
