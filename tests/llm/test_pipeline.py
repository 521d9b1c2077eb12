from collections import defaultdict

import corpus_pipeline
import public_tokenizers as P
from tokenizers import Tokenizer

from test_nearcopies import brute_kept

SF = "/root/testdata/sf0.001"


def test_stages_act_on_what_is_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, kept_by, at = docs.columns, [{r["doc_id"]: r["text"] for r in docs.collect()}], docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, at, SF)
        assert out.columns == names
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        assert kept.join(at, "doc_id", "left_anti").count() == 0
        kept_by.append({r["doc_id"]: r["text"] for r in kept.collect()})
        at = kept
    assert len(kept_by[0]) > len(kept_by[1]) >= len(kept_by[2]) > len(kept_by[3])
    assert set(kept_by[3]) == brute_kept(kept_by[2])
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = {r["doc_id"]: len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in at.collect()}
    got = defaultdict(int)
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
    assert dict(got) == want


def test_labelled_good_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = corpus_pipeline.by_language(spark, corpus_pipeline.by_quality(spark, docs, SF), SF)
    good = labels.filter("quality = 1").join(docs, "doc_id").count()
    assert kept.join(labels.filter("quality = 1"), "doc_id").count() >= 0.98 * good
    assert kept.join(labels.filter("quality = 0"), "doc_id").count() <= 0.2 * labels.filter("quality = 0").count()


def test_edges(spark, edge, tmp_path):
    path = str(tmp_path / "sf")
    edge.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == {1, 5, 7, None}
