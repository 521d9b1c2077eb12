import numpy as np
from pyspark.sql import functions as F

from quern.llm import quality
from quern.llm.common import crc32_is


def sparse(seed, n, k):
    rng = np.random.default_rng(seed)
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd", "e"], rng.integers(0, 12))) for _ in range(n)]
    return quality.features(texts, np.zeros((n, k)))


def test_score_is_the_sum_over_pairs():
    machine = quality.Machine(quality.N_STATISTICS + 1)
    begins, bucket, weight, table = sparse(1, 20, 1)
    machine.fit(begins, bucket, weight, table, np.arange(20) % 2.0)
    got = machine.score(begins, bucket, weight, table)
    at, index, value = machine.rows(begins, bucket, weight, table)
    for r in range(20):
        i, x = index[at[r] : at[r + 1]], value[at[r] : at[r + 1]].astype(float)
        v = machine.factors[i].astype(float)
        s = machine.bias + (machine.linear[i] * x).sum() + sum(v[p] @ v[q] * x[p] * x[q] for p in range(len(i)) for q in range(p))
        assert abs(got[r] - 1 / (1 + np.exp(-s))) < 1e-4


def test_statistics():
    texts = ["The cat the cat\nx1\nx1", "", "É!!"]
    begins, bucket, weight, table = quality.features(texts, np.zeros((3, 0)))
    assert begins.tolist() == [0, 3, 3, 4] and np.allclose(weight, [3**-0.5] * 3 + [1])
    assert np.allclose(table[0, :2], np.log1p([21, 6])) and np.isclose(table[0, 12], 3 / 6) and np.isclose(table[0, 14], 2 / 6)
    assert np.isclose(table[0, 15], 1 / 6) and np.isclose(table[0, 16], 1 / 3) and not table[1, :5].any() and np.isclose(table[2, 8], 2 / 3)
    assert np.array_equal(quality.features(texts[:1], np.zeros((1, 0)))[3], table[:1])


def fitted(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality.fit(docs, labels, ~crc32_is("doc_id", 5, 0))


def test_held_out_auc(spark):
    docs, labels, machine = fitted(spark, "sf0.1")
    rows = quality.score(docs, machine, crc32_is("doc_id", 5, 0)).filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    good, bad = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    auc = (good["score"].to_numpy()[:, None] > bad["score"].to_numpy()).mean()
    assert len(bad) > 60 and auc > 0.97
    assert (good["predicted"] == 1).mean() > 0.99 and (bad["predicted"] == 0).mean() > 0.85


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (5, 1), (7, 0), (7, None), (None, 1), (99, 1)], "doc_id long, quality int")
    machine = quality.fit(edge, labels, F.lit(True))
    rows = quality.score(edge, machine, F.lit(False)).collect()
    assert len(rows) == edge.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], r["score"])
    assert by_text[6] == by_text[1] and quality.score(empty, machine, F.lit(False)).count() == 0
    none = quality.fit(edge, labels.limit(0), F.lit(True))
    assert {(r["score"], r["predicted"]) for r in quality.score(edge, none, F.lit(False)).collect()} == {(0.5, 1)}
    kept = quality.keep_good(edge, none)
    assert kept.columns == edge.columns and kept.count() == edge.count()


def test_sample_is_bounded_and_repeatable(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a, b = (quality.fit(docs.repartition(n), labels, ~crc32_is("doc_id", 5, 0), most=40) for n in (1, 5))
    assert np.allclose(a.factors, b.factors) and a.bias == b.bias


def test_fitting_takes_a_bounded_number_of_words(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_WORDS", 50)
    docs = spark.createDataFrame([(i, " ".join(f"{'good' if i % 2 else 'bad'}{j}" for j in range(400)), 0) for i in range(40)], "doc_id long, text string, n_chars long")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    machine = quality.fit(docs, labels, F.lit(True))
    assert np.count_nonzero(machine.linear[: quality.WORD_BUCKETS]) <= 100
    rows = quality.score(docs, machine, F.lit(False)).collect()
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in rows)
