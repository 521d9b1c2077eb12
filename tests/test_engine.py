import json

import pytest
from pyspark.sql import functions as F

from quern.engine import Answers, Engine, Prompt, Request, RequestError, UnknownCorpus, session
from quern.functions import vectors as V
from quern.sources import corpus as C
from quern.streaming import events as S

TEXTS = ["elevation of ice sheets", "sea ice freeboard", "vegetation canopy height", "ice sheet elevation change", "api reference for parameters"]


@pytest.fixture(scope="module")
def engine(spark):
    encode = V.hashing_embedder(16)
    units = encode(TEXTS)
    rows = [(i, f"https://h/{i}", "T", f"S{i}", "guide" if i % 2 else None, t, None if i else 3, [float(x) for x in units[i]]) for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(rows, "pos long, url string, title string, section string, category string, text string, source_page int, embedding array<double>")
    e = Engine(spark, encode)
    e.add("docs", chunks, {"built_at": "now", "source_host": "h", "other": 1})
    return e


def test_search(engine):
    answer = engine.search("docs", Request("ice sheet elevation", 3))
    assert answer["query"] == "ice sheet elevation" and len(answer["results"]) == 3
    assert answer["results"][0]["text"] == "ice sheet elevation change" and answer["results"][0]["matched_tokens"] == ["elevation", "ice", "sheet"]
    assert "category" in answer["results"][0] and all("source_page" in r for r in answer["results"])
    assert answer["corpus_meta"].items() >= {"built_at": "now", "source_host": "h", "chunk_count": 5, "embedding_dim": 16, "embedder": None}.items() and set(answer["corpus_meta"]) == {"built_at", "source_host", "corpus_sha256", "chunk_count", "embedder", "embedding_dim"}
    before = engine.answers.hits
    assert engine.search("docs", Request("ice sheet elevation", 3)) is answer and engine.answers.hits == before + 1


def test_categories_and_terms(engine):
    assert engine.search("docs", Request("ice", categories=[]))["results"] == []
    assert {r["category"] for r in engine.search("docs", Request("ice", 50, categories=["guide"]))["results"]} == {"guide"}
    assert all("matched_tokens" not in r for r in engine.search("docs", Request("ice", disable_lexical=True))["results"])
    assert len(engine.search("docs", Request("  "))["results"]) == 5


def test_index_in_the_driver_answers_as_spark_does(spark, engine):
    corpus = engine._of("docs")
    other = Engine(spark, engine.encoder, held_chunks=0)
    other.add("docs", corpus.chunks.drop("terms", "unit"), {"built_at": "now", "source_host": "h"})
    assert corpus.held is not None and other._of("docs").held is None
    for r in (Request("ice sheet elevation", 3), Request("ice", 50, categories=["guide"]), Request("ice", disable_lexical=True), Request("The of"), Request("sea", categories=[]), Request("nothing known", 2)):
        a, b = engine.search("docs", r), other.search("docs", r)
        assert a["results"] == b["results"], r


def test_envelopes(engine):
    status, body = engine.handle("/docs/search", {"query": "ice", "top_k": 2, "junk": 1})
    assert status == 200 and len(body["results"]) == 2
    assert engine.handle("/docs/search", {})[0] == engine.handle("/docs/search")[0] == 422
    assert engine.handle("/docs/search", {"query": "x", "top_k": 0}) == (422, {"error": "validation_error", "detail": "top_k: 1 to 50"})
    assert engine.handle("/none/search", {"query": "x"}) == (404, {"error": "not_found", "path": "/none/search"}) and engine.handle("/docs/x")[0] == 404
    assert engine.handle("/health")[1]["status"] == "ok" and engine.handle("/docs/meta")[1]["chunk_count"] == 5


def test_session(engine):
    said, lines = [], iter([":k 1", "", "ice", ":k 0", ":zz", "x" * 2001, ":cat a", "ice"])

    def read():
        try:
            return next(lines)
        except StopIteration:
            raise EOFError from None

    session(engine, "docs", read, said.append)
    assert said[0] == "top_k=1" and said[1].startswith("  1. ") and "matched=['ice']" in said[1] and said[2].startswith("usage: :k") and "unknown" in said[3] and "2000" in said[4] and said[6] == "  (no results)"


def test_rules(engine):
    for bad in (dict(query=""), dict(query="x" * 2001), dict(query="x", top_k=0), dict(query="x", top_k=51), dict(query=None)):
        with pytest.raises(RequestError):
            Request(**bad)
    with pytest.raises(UnknownCorpus):
        engine.search("none", Request("x"))
    assert engine.health()["corpora"]["docs"] == engine.meta("docs")["corpus_sha256"] and engine.warm() == {"docs": 5}
    with pytest.raises(C.CorpusError):
        engine.add("empty", engine._of("docs").chunks.select("pos", "url", "text", "section", "embedding").limit(0))


def test_answers():
    a = Answers(2)
    a.put(1, "x"), a.put(2, "y"), a.get(1), a.put(3, "z")
    assert a.get(2) is None and a.get(1) == "x" and a.stats() == {"hits": 2, "misses": 1, "hit_rate": 2 / 3, "size": 2, "maxsize": 2}
    a.clear()
    assert a.stats()["hit_rate"] == 0


def test_prompt():
    p = Prompt()
    assert p.command(":k 7") == "top_k=7" and p.command(":lex off") == "lexical=off" and p.command(":cat a, b").startswith("categories=['a'")
    assert p.request("q") == Request("q", 7, True, ["a"]) and p.command(":cat off") == "categories=off" and p.command(":k x").startswith("usage") and "unknown" in p.command(":zz") and "lex" in p.command(":help")


def test_envelope_and_meta(spark, tmp_path):
    doc = {"version": 1, "embedder": C.EMBEDDER, "embedding_dim": 2, "chunks": [{"id": "a", "url": "u", "text": "t", "embedding": [1, 2]}, {"id": "b", "url": "v", "text": "w", "embedding": [0, 0]}]}
    (tmp_path / "c.json").write_text(json.dumps(doc))
    rows = C.read_envelope(spark, str(tmp_path / "c.json")).collect()
    assert [(r["pos"], r["id"], r["embedding"]) for r in rows] == [(0, "a", [1.0, 2.0]), (1, "b", [0.0, 0.0])]
    with pytest.raises(C.CorpusError):
        C.read_envelope(spark, str(tmp_path / "c.json"), "another")
    (tmp_path / "e.json").write_text(json.dumps(doc | {"chunks": []}))
    with pytest.raises(C.CorpusError):
        C.read_envelope(spark, str(tmp_path / "e.json"))
    (tmp_path / "m.json").write_text('{"built_at": "x", "pages_crawled": 3, "junk": 1}')
    (tmp_path / "bad.json").write_text("{")
    assert C.read_meta(spark, str(tmp_path / "m.json")) == {"built_at": "x", "pages_crawled": 3}
    assert C.read_meta(spark, str(tmp_path / "bad.json")) == {} == C.read_meta(spark, str(tmp_path / "absent.json"))
    (tmp_path / "g.jsonl").write_text('{"query": "a"}\n\n{"query": "b", "expected_urls": ["u"]}\n')
    assert C.read_json_lines(spark, str(tmp_path / "g.jsonl"), "query string, expected_urls array<string>").count() == 2
    assert C.file_digests(spark, str(tmp_path / "m.json")).first()["bytes"] == 48


def test_fingerprint_and_publish(spark, tmp_path):
    rows = spark.range(2500).select(F.col("id").alias("pos"), F.concat(F.lit("t"), "id").alias("text"))
    a, b = (C.fingerprint(rows.repartition(n)).first() for n in (1, 7))
    assert a == b and a["chunk_count"] == 2500 and C.fingerprint(rows.withColumn("text", F.lit("x"))).first()["corpus_sha256"] != a["corpus_sha256"]
    path = str(tmp_path / "out")
    C.publish(rows, path, {"pages": 20}, C.SITE_GUARD)
    assert spark.read.parquet(path).count() == 2500
    with pytest.raises(C.PublishError):
        C.publish(rows.limit(10), path, {"pages": 20}, C.SITE_GUARD)
    assert spark.read.parquet(path).count() == 2500


def test_embedders(spark):
    import numpy as np

    states = np.array([[[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]]])
    assert np.allclose(V.pooled(states, np.array([[1, 1, 0]])), [[0.5**0.5, 0.5**0.5]]) and not V.pooled(states, np.array([[0, 0, 0]])).any()
    got = spark.createDataFrame([("a b",), (None,)], "t string").select(V.embed(F.col("t"), V.hashing_embedder(8)).alias("e")).collect()
    assert sum(x * x for x in got[0]["e"]) == pytest.approx(1, abs=1e-5) and not any(got[1]["e"])


def test_streams_give_what_batches_give(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, f, mode in (("hourly", S.hourly, "complete"), ("limited", lambda e: S.over_limit(e, most=1, window="24 hours", step="6 hours"), "update")):
        q = f(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
        want = f(events)
        got = spark.table(name)
        keys = [c for c in want.columns if c not in ("total",)]
        assert {tuple(r) for r in want.select(*keys).collect()} == {tuple(r) for r in got.select(*keys).collect()}


def test_small_numbers_of_a_response_are_written_out(spark):

    numbers = [0.0009, -0.0003, 0.0001, 0.001, 0.0, -0.0, 1.0, -0.25, 0.000001, 1e-9]
    rows = [(1, "q é\"", i, x, 'u"\n', None if i % 2 else ["a", "b"]) for i, x in enumerate(numbers)] + [(2, None, 0, None, None, None)]
    results = spark.createDataFrame(rows, "query_id long, query string, rank int, score double, url string, matched array<string>")
    got = dict(map(tuple, C.response(results, {"host": "h"}).collect()))
    said = ["0.0009", "-0.0003", "0.0001", "0.001", "0.0", "-0.0", "1.0", "-0.25", "0.000001", "1.0E-9"]
    listed = ",".join(f'{{"rank":{i},"score":{x},"url":"u\\"\\n"' + ("" if i % 2 else ',"matched":["a","b"]') + "}" for i, x in enumerate(said))
    assert got == {1: f'{{"query":"q é\\"","results":[{listed}],"corpus_meta":{{"host":"h"}}}}', 2: '{"results":[{"rank":0}],"corpus_meta":{"host":"h"}}'}
    assert [r["score"] for r in json.loads(got[1])["results"]] == numbers
    assert json.loads(C.response(results.limit(0).unionAll(results.filter("query_id = 2")), {}).first()["response"])["corpus_meta"] == {}
