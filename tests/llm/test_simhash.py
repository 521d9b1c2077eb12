import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm.components import connected_components


def brute_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, limit=2):
    """Label of each fingerprint's component by union-find over all pairs."""
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= limit
    for i, j in zip(*np.nonzero(near)):
        a, b = root(i), root(j)
        label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def clustered(seed, centers=40, each=25):
    rng = np.random.default_rng(seed)
    out = set()
    for base in rng.integers(0, 2**63, centers, dtype=np.uint64):
        x = int(base)
        for _ in range(each):
            y = x
            for b in rng.integers(0, 64, rng.integers(0, 4)):
                y ^= 1 << int(b)
            out.add(y)
            if rng.random() < 0.3:
                x = y  # chains
    return np.array(sorted(out), np.uint64)


def test_fingerprints(edge):
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    for r in simhash.fingerprints(edge).collect():
        assert r["fp"] & (1 << 64) - 1 == brute_fingerprint(texts[r["doc_id"]])


def test_votes_in_steps(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_VOTES", 7)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


@pytest.mark.parametrize("visits", [50, 2_000_000])
def test_index_finds_all_links(monkeypatch, visits):
    monkeypatch.setattr(simhash, "VISITS", visits)
    fps = clustered(1)
    group = (fps & np.uint64(3)).astype(np.int64)
    index = simhash.GrayIndex(group, fps)
    got = {frozenset((int(index.fp[i]), int(index.fp[j]))) for a, b in index.links(2) for i, j in zip(a, b)}
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2, 1) & (group[:, None] == group[None, :]))
    assert got == {frozenset((int(fps[i]), int(fps[j]))) for i, j in near}


@pytest.mark.parametrize("leaf_max,chunk", [(20_000, 200_000), (3, 10)])
def test_links_join_up_as_brute_force(spark, monkeypatch, leaf_max, chunk):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", chunk)
    fps = clustered(2)
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = {r["node"]: r["root"] for r in connected_components(simhash.links(table, leaf_max=leaf_max)).collect()}
    got, want = {}, {}
    for x, label in zip(fps.view(np.int64).tolist(), brute_components(fps)):
        got.setdefault(found.get(x, x), set()).add(x)
        want.setdefault(label, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(130, 129), (7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 31)}, 201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(edge, empty):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == edge.count() and simhash.near_duplicates(empty).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], (r["fingerprint"], r["component_id"]))
    assert by[2] == by[3] == by[4] == ("0" * 16, 2) and by[1] == by[6] and by[6][1] == 1 and by[None][1] is None


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = simhash.near_duplicates(docs).orderBy("doc_id").collect()
    fps = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert [int(f) for f in fps] == [brute_fingerprint(t) for t in texts]
    assert [r["component_id"] for r in rows] == [rows[i]["doc_id"] for i in brute_components(fps)]


def test_hex(spark):
    got = spark.createDataFrame([(0,), (-1,), (255,)], "fp long").select(simhash.hex_of(F.col("fp"))).collect()
    assert [r[0] for r in got] == ["0" * 16, "f" * 16, "00000000000000ff"]
