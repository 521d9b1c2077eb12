import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import chars, langid
from quern.llm.common import crc32_is


def plain_viterbi(score, penalty):
    v, back = score[0].copy(), []
    for s in score[1:]:
        top, at = v.max() - penalty, v.argmax()
        moved = v < top
        back.append(np.where(moved, at, np.arange(len(v))))
        v = np.where(moved, top, v) + s
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def worth(score, path, penalty):
    return sum(score[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))


@pytest.mark.parametrize("segment", [1, 7, 256])
def test_viterbi_is_the_best_path(monkeypatch, segment):
    monkeypatch.setattr(langid, "SEGMENT", segment)
    rng = np.random.default_rng(3)
    for _ in range(20):
        begins = np.concatenate([[0], np.cumsum(rng.choice([0, 1, 5, 40, 90], 9))])
        score = (rng.integers(-40, 1, (begins[-1], 3)) / 4).astype(np.float32)
        label = langid.viterbi(score, begins, 4.0)
        for a, b in zip(begins, begins[1:]):
            if b > a:
                assert worth(score[a:b], label[a:b].tolist(), 4.0) == pytest.approx(worth(score[a:b], plain_viterbi(score[a:b].astype(float), 4.0), 4.0))


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter(~crc32_is("doc_id", 4, 2)))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, model, crc32_is("doc_id", 4, 2)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.99 * len(rows) and all(0 <= r["score"] <= 1 for r in rows)


def test_spans_of_mixed_text(spark, model):
    docs = {r["lang"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars between 400 and 900").select("lang", "text").collect()}
    text = "12 " + docs["en"] + " " + docs["fr"] + " " + docs["de"]
    spans = [tuple(s) for s in langid.label_spans(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["spans"]]
    assert [lang for *_, lang in spans] == ["en", "fr", "de"]
    cut = len(docs["en"]) + 4
    assert abs(spans[1][0] - cut) < 40 and spans[0][0] >= 3 and all(a < b for a, b, _ in spans)


def test_scripts_narrow(spark):
    rows = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate([("мама мыла раму", "ru"), ("the cat sat", "en"), ("ένα δύο", "el")] * 4)], "doc_id long, text string, lang string")
    model = langid.fit(rows)
    asked = spark.createDataFrame([(1, "щщщ"), (2, "qqq"), (3, "漢字"), (4, "!"), (5, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(asked, model, F.lit(False)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 4, 5)] == ["ru", "en", "und", "und"] and got[3]["lang_pred"] in ("ru", "en", "el") and got[4]["score"] == 0


def test_edges(edge, empty):
    model = langid.fit(edge.filter(~crc32_is("doc_id", 4, 2)))
    rows = langid.identify(edge, model, crc32_is("doc_id", 4, 2)).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r["lang_pred"] for r in rows}
    assert by[2] == by[3] == by[4] == by[8] == "und" and by[1] in model.langs and by[5] in model.langs
    none = langid.fit(empty)
    assert none.langs == [] and {r["lang_pred"] for r in langid.identify(edge, none, F.lit(True)).collect()} == {"und"}
    assert langid.identify(empty, model, F.lit(False)).count() == 0
    kept = langid.keep_identified(edge, model, 0.1)
    assert kept.columns == edge.columns and {r["doc_id"] for r in kept.collect()} == {1, 5, 6, 7, None}


def test_sample_is_bounded(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("some words here").alias("text"), F.lit("en").alias("lang"))
    seen = langid.fit(docs, most=500)
    assert seen.langs == ["en"]


def test_more_than_256_languages(spark):
    """300 languages, each with a word of its own: the labels keep apart."""
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 9)) for _ in range(300)]
    rows = [(i, f"{w} " * 20, f"l{i:03}") for i, w in enumerate(words)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) == 300
    langs, scores, spans = langid.detect(model, [t for _, t, _ in rows], spans=True)
    assert langs == [x for *_, x in rows] == [s[0][2] for s in spans]


def plain_detect(rows, text):
    """The method said plainly: counts in dicts, one word after another."""
    langs = sorted({x for _, x in rows})

    def bucket(tri):
        h = sum(ord(c) * k for c, k in zip(tri, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))) % 2**64
        return (h ^ h >> 33) * 0xFF51AFD7ED558CCD % 2**64 >> 48

    def trigrams(t):
        low = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in t)
        return [(i, bucket(f" {low} "[i : i + 3])) for i in range(len(low)) if t[i].isalpha()]

    def script(c):
        return next((name for name, ranges in chars.SCRIPT_RANGES if any(a <= ord(c) < b for a, b in ranges)), "other")

    counts, letters = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for t, x in rows:
        counts[x].update(g for _, g in trigrams(t))
        letters[x].update(script(c) for c in t if c.isalpha())
    total = {x: sum(counts[x].values()) + 0.1 * langid.BUCKETS for x in langs}
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", text)]
    if not words:
        return "und", 0.0
    grams, table, compared = dict(trigrams(text)), [], []
    for a, b in words:
        score = np.array([sum(math.log((counts[x][grams[i]] + 0.1) / total[x]) for i in range(a, b)) for x in langs])
        may = np.array([letters[x][script(text[a])] >= langid.SCRIPT_SHARE * max(1, sum(letters[x].values())) for x in langs])
        may = may if may.any() else np.ones(len(langs), bool)
        score -= score[may].max()
        table.append(np.where(may, score, -np.inf))
        compared.append(np.where(may, score, np.minimum(score, 0) - langid.FOREIGN_SCRIPT))
    share, path = np.zeros(len(langs)), plain_viterbi(np.array(table), langid.SWITCH_PENALTY)
    for (a, b), label in zip(words, path):
        share[label] += b - a
    best = int(share.argmax())
    own = sum(s for s, label in zip(compared, path) if label == best)
    margin = min(50, max(-50, own[best] - max(np.delete(own, best), default=-np.inf)))
    return langs[best], share[best] / share.sum() / (1 + math.exp(-margin))


def test_against_the_plain_form(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars < 1500").orderBy("doc_id").collect()
    rows = [(r["text"], r["lang"]) for r in docs[:60] if r["lang"]] + [("мама мыла раму и ушла", "ru"), ("ένα δύο τρία", "el")]
    model = langid.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"))
    texts = [r["text"] or "" for r in docs[60:130]] + ["", "12 !", "мама the cat", "漢字", docs[0]["text"] + " мама мыла раму " + docs[1]["text"], "É\u0301 ß ﬀ x"]
    langs, scores, _ = langid.detect(model, texts)
    for text, lang, score in zip(texts, langs, scores):
        want, sure = plain_detect(rows, text)
        assert lang == want and score == pytest.approx(sure, abs=2e-3), text


def test_score_follows_the_share(spark, model):
    """However strange a minority's words are to the main language, the score falls with its share only."""
    words = {r["lang"]: r["text"].split()[:400] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars between 4000 and 9000").orderBy("doc_id").select("lang", "text").collect()}
    langs = sorted(words)
    for first, second in [(a, b) for a in langs for b in langs if a != b]:
        lang, score, _ = langid.detect(model, [" ".join(words[first][:240] + words[second][:110])])
        assert lang == [first] and 0.55 < score[0] < 0.8
    shuffled = [words[langs[i % 4]][i // 4] for i in range(400)]
    assert langid.detect(model, [" ".join(shuffled)])[1][0] < corpus_pipeline.LEAST_LANGUAGE_SCORE


def test_a_script_excludes(spark):
    """However many Latin words stand around it, a Cyrillic word is not labelled with a language written in Latin letters only."""
    rows = spark.createDataFrame([(1, "мама мыла раму", "ru"), (2, "the cat sat on the mat", "en")], "doc_id long, text string, lang string")
    spans = langid.detect(langid.fit(rows), ["the cat sat " * 5 + "ы " + "on the mat " * 5], spans=True)[2][0]
    assert [x for *_, x in spans] == ["en", "ru", "en"]
