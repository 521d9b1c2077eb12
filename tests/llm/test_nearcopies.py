import itertools
import random

import numpy as np

from quern.llm import nearcopies, simhash


def brute_kept(texts, least=0.8):
    """Documents that no chain of pairs of exactly ``least`` or more joins to a lower id."""
    sets = {k: set(nearcopies.shingles(t).tolist()) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if (len(x & y) >= least * len(x | y)) if x or y else True:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {k for k in texts if find(k) == k}


def test_shingles():
    assert len(nearcopies.shingles(None)) == len(nearcopies.shingles(" \n")) == 0
    assert len(nearcopies.shingles("a b c")) == 1 and len(nearcopies.shingles("a b c d e f")) == 2
    assert np.array_equal(nearcopies.shingles("A b\nC d E"), nearcopies.shingles("a b c d e"))


def test_edits_are_found(spark):
    rng = random.Random(3)
    texts = {}
    for g in range(25):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([8, 60, 300, 900]))]
        texts[g * 10] = " ".join(words)
        texts[g * 10 + 1] = " ".join(words)
        for c in range(2, 6):
            new = list(words)
            for _ in range(max(1, len(words) // 120)):
                new[rng.randrange(len(new))] = "changed"
            texts[g * 10 + c] = " ".join(new)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = {r["doc_id"] for r in nearcopies.first_of_groups(docs).collect()}
    want = brute_kept(texts)
    # 8 words have too few shingles for one edit to leave 0.8
    assert want <= kept and len(kept - want) <= 0.03 * (len(texts) - len(want))


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r["doc_id"] for r in nearcopies.first_of_groups(docs).collect()}
    assert kept == brute_kept({r["doc_id"]: r["text"] for r in docs.collect()})


def test_edges(edge, empty):
    kept = nearcopies.first_of_groups(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)) == [1, 2, 5, 7, 8] and kept.filter("doc_id is null").count() == 1
    assert nearcopies.first_of_groups(empty).count() == 0


def test_one_key_over_many_tasks(spark):
    docs = spark.createDataFrame([(i, ("alpha one", "beta two")[i % 2] + " the very same words in every one of them") for i in range(500)], "doc_id long, text string").repartition(8)
    assert sorted(r["doc_id"] for r in nearcopies.first_of_groups(docs).collect()) == [0, 1]


def overlapping(n, size, own, rng):
    """Texts that share most words in one order, each with ``own`` words changed at places of its own."""
    base = [f"w{i}" for i in range(size)]
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(size), own):
            words[at] = f"own{i}x{at}"
        yield " ".join(words)


def first_of(texts, least=0.8):
    """As brute_kept, with links of fingerprints within two bits as well."""
    sets = [nearcopies.shingles(t) for t in texts]
    ids, at = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros((len(texts), len(ids)), np.float32)
    has[np.repeat(np.arange(len(texts)), [len(s) for s in sets]), at] = 1
    both = (has @ has.T).astype(float)
    linked = both / (has.sum(1)[:, None] + has.sum(1) - both) >= least
    fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
    linked |= np.bitwise_count(fps[:, None] ^ fps) <= 2
    kept, new = set(), np.ones(len(texts), bool)
    for root in range(len(texts)):
        if new[root]:
            kept.add(root)
            todo = [root]
            while todo:
                found = np.flatnonzero(linked[todo.pop()] & new)
                new[found] = False
                todo += found.tolist()
    return kept


def kept_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return {r["doc_id"] for r in nearcopies.first_of_groups(docs).collect()}


def test_every_pair_of_a_key_is_decided(spark, monkeypatch):
    """Many texts share each key and are alike only here and there; small blocks make many cells."""
    monkeypatch.setattr(nearcopies, "BLOCK_CLASSES", 100, raising=False)
    texts = list(overlapping(600, 200, 4, random.Random(4)))
    assert kept_of(spark, texts) == first_of(texts)


def test_forest_is_exact():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64)) for _ in range(80)]
    left, right = np.arange(0, 40), np.arange(40, 80)

    def joined(pairs):
        root = list(range(80))
        for a, b in pairs:
            root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
        return root

    for some, other in ((left, right), (np.arange(80), np.arange(80))):
        whole = [(a, b) for a in some for b in other if a != b and len(np.intersect1d(sets[a], sets[b])) >= 0.5 * len(np.union1d(sets[a], sets[b]))]
        found = nearcopies.forest(sets, some, other, 0.5)
        assert whole and joined(found) == joined(whole) and len(found) < 80


def test_one_key_of_thousands_of_texts_over_many_tasks(spark):
    """Distinct texts under the same keys, dealt to many tasks; what is kept does not depend on how many."""
    texts = list(overlapping(3000, 200, 4, random.Random(6)))
    want = first_of(texts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (3, 16):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert kept_of(spark, texts) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_texts_are_decided_exactly(spark):
    """Pairs of 3,000 words just at 0.8 or above it, and just below: a sample of the shingles would mistake many."""
    rng, texts = random.Random(8), []
    for g in range(60):
        words = [f"g{g}w{i}" for i in range(3004)]
        # the last m words are new: 3,000 - m shingles in common, so similarity (3000 - m) / (3000 + m)
        m = rng.choice([330, 333, 336, 339])
        texts += [" ".join(words), " ".join([*words[: 3004 - m], *(f"x{g}y{i}" for i in range(m))])]
    assert kept_of(spark, texts) == first_of(texts) and len(first_of(texts)) not in (60, 120)
