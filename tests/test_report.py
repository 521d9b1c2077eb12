from pyspark.sql import functions as F

from quern.operators import chunking, evaluation, html, report, review, usage
from quern.sources import corpus as C

GOLDEN = "query_id long, corpus string, type string, query string, expected_urls array<string>, expected_sections array<string>, expected_pages array<array<int>>"
RESULTS = "query_id long, rank int, url string, title string, section string, category string, page int, score double, text string"


def data(spark):
    golden = spark.createDataFrame([(1, "a", "t", "one", ["https://h/x"], ["intro"], None), (2, "a", "u", "two", ["https://h/y", "https://h/z"], None, [[3, 4]]), (3, "b", "t", "three", ["https://h/none"], None, None)], GOLDEN)
    results = spark.createDataFrame([(1, 1, "https://h/x", "T", "Intro", "guide", None, 0.9, "some  text"), (2, 6, "https://h/y", "T", "S", None, 3, 0.25, "word " * 200), (2, 1, "https://h/w", "", None, None, None, 0.5, None)], RESULTS)
    return golden, results


def test_report(spark):
    golden, results = data(spark)
    evaluated = evaluation.records(results, golden, "query", "expected_urls", "expected_sections", "expected_pages")
    text = report.document(report.lines(evaluated, ("a", "b", "c")))
    assert [x for x in text.split("\n") if x.startswith("## ")] == [h[0] for h in report.HEADINGS.values()]
    for line in (
        "| recall@5 | 0.333 | ≥ 0.70 | ✗ |", "| a | 2 | 0.500 | 0.500 | 0.583 |", "| c | 0 | 0.000 | 0.000 | 0.000 |", "| b | t | 1 | 0.000 | 0.000 | 0.000 |", "| a | u | 6 | two |", "| b | t | — | three |",
        "- **[a/u]** `two` (rank 6)\n  - expected: https://h/y\n  - top 3 returned:\n    - https://h/w", "- **[b/t]** `three`\n  - expected: https://h/none\n  - top 5 returned: (none)",
    ):
        assert line in text, line
    assert "None." in report.document(report.lines(evaluated.filter("first_rank = 1")))
    assert report.document(report.lines(evaluated.limit(0))).count("None.") == 5


def test_audit(spark):
    golden, results = data(spark)
    evaluated = evaluation.records(results, golden, "query", "expected_urls", "expected_sections", "expected_pages")
    judged = evaluation.judged(results, golden)
    blocks = {r["query_id"]: r["block"] for r in report.audit(judged, evaluated).collect()}
    assert set(blocks) == {1, 2, 3}
    assert "✓ rank 1" in blocks[1] and "1. [✓✓] **score 0.900** — https://h/x" in blocks[1] and "category=`guide`" in blocks[1] and "> some text" in blocks[1] and "- intro" in blocks[1]
    assert "✗ rank 6" in blocks[2] and "- 3–4" in blocks[2] and "**(none)**" in blocks[2] and "not found" in blocks[3] and "Expected sections" not in blocks[3]


def test_forms_are_read_back(spark):
    golden, results = data(spark)
    forms = golden.select(F.concat(F.col("query_id").cast("string"), F.lit("-review.md")).alias("path"), review.form(F.col("query_id"), F.col("query"), F.col("corpus"), ["a", "b"], F.lit("r.md")).alias("value"))
    blank = review.parse(forms, ["a", "b"]).orderBy("row_index").collect()
    assert [(r["row_index"], r["query"], r["labeled_corpus"], r["incomplete"]) for r in blank] == [(1, "one", "a", True), (2, "two", "a", True), (3, "three", "b", True)]
    filled = forms.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"- r2: ", "- r2: Correct"), "- overall: ", "- overall: partial"))
    r = review.parse(filled, ["a", "b"]).first()
    assert r["verdicts"] == {"a": {"r2": "correct"}, "b": {"r2": "correct"}} and r["overall_verdict"] == "partial" and not r["incomplete"]
    assert C.append_missing(forms, forms.limit(2), ["path"]).count() == 1


def test_results_documents(spark):
    golden, results = data(spark)
    blocks = review.result_blocks(results.withColumn("corpus", F.lit("a")))
    found = {r["query_id"]: r["value"] for r in review.results_document(golden, blocks, ["a", "b"]).collect()}
    assert "#### r1 — score 0.900" in found[1] and "some  text" in found[1] and "  - `intro`" in found[1] and "_(no results)_" in found[1] and "- **title:** (none)" in found[2] and "  - 3–4" in found[2]
    assert found[3].count("_(no results)_") == 2


def test_sitemaps(spark):
    good = '<?xml version="1.0"?><s:urlset xmlns:s="x" xmlns:my-x.y="z"><s:url><s:loc> https://h/a?x=1&amp;y=2#f </s:loc></s:url><s:url><my-x.y:loc><![CDATA[https://h/b]]></my-x.y:loc></s:url><s:url><loc>https&#58;//h/c</loc><loc>https://other/d</loc></s:url></s:urlset>'
    rows = spark.createDataFrame([(good,), ("<urlset><loc>https://h/lost</loc>",), (None,), ("no xml",)], "value string")
    assert [r["url"] for r in C.sitemap_urls(rows, "h").collect()] == ["https://h/a?x=1&y=2", "https://h/b", "https://h/c"]
    assert C.sitemap_locations(rows).filter("locations is null").count() == 3
    assert [r["url"] for r in C.sitemap_urls(rows, "h", ~F.col("url").endswith("b")).collect()] == ["https://h/a?x=1&y=2", "https://h/c"]


def test_cache_entries_that_are_damaged_are_fetched_anew(spark):
    cache = spark.createDataFrame([("a", bytearray(b"<p>ok")), ("b", bytearray(b"")), ("c", bytearray(b"\xff\xfe\xfa")), ("d", bytearray(b"%PDF-1.4\xff")), ("e", None)], "key string, body binary")
    wanted = spark.createDataFrame([(k,) for k in "abcdef"], "url string")
    assert sorted(r["url"] for r in C.to_fetch(wanted, cache, F.col("url")).collect()) == ["b", "c", "e", "f"]


def test_pdf_pages(spark):
    def reader(content):
        if not content.startswith(b"%PDF"):
            raise ValueError("no PDF")
        yield from enumerate(content[4:].decode().split("|"), 1)

    files = spark.createDataFrame([("x", bytearray(b"%PDFone|two")), ("y", bytearray(b"junk")), ("z", None)], "path string, content binary")
    rows = {(r["path"], r["page_num"]): r["text"] or r["error"] for r in C.pdf_pages(files, reader).collect()}
    assert rows == {("x", 1): "one", ("x", 2): "two", ("y", None): "ValueError: no PDF", ("z", None): "ValueError: no PDF"}


def test_pages_without_url_or_number_stay(spark):
    pages = spark.createDataFrame([("u", 3, "text"), (None, 4, "text"), ("u", None, "text")], "url string, page_num long, text string")
    toc = spark.createDataFrame([("u", 1, "One", 2, 1)], "url string, level int, title string, page long, seq long")
    assert sorted((str(r["url"]), str(r["page_num"]), r["section"]) for r in chunking.titles_at(pages, toc).collect()) == [("None", "4", "Page 4"), ("u", "3", "One"), ("u", "None", "Page ?")]


def test_long_pages_with_many_headings(spark):
    n = 20_000
    title, found = html.sections("<main>" + "".join(f"<h2>h{i}</h2><p>t{i}</p>" for i in range(n)) + "</main>")
    assert len(found) == n and found[-1] == (f"h{n - 1}", n - 1, f"t{n - 1}")


def test_total_cost_of_times_that_are_none(spark):
    a = spark.createDataFrame([(1, 2.0), (1, 3.0), (None, 4.0)], "ts int, value double")
    rows = {r["ts"]: r["invocations"] for r in usage.cost_by_bucket(a, a.limit(0)).collect()}
    assert rows == {1: 5, None: 9}


def test_times_of_a_zone(spark):
    lines = ["2024-03-31T00:59:00Z\tx", "2024-03-31T01:00:00Z\tx", "2024-10-27T02:30:00+01:00\tx", "1990-07-01T12:00:00\tx", "2024-06-01\tx"]
    df = spark.createDataFrame([(x,) for x in lines], "l string")
    got = [r[0] for r in df.select(usage.local_line(F.col("l"), "Europe/Berlin")).collect()]
    assert got == ["2024-03-31 01:59 CET\tx", "2024-03-31 03:00 CEST\tx", "2024-10-27 02:30 CET\tx", "1990-07-01 12:00 CEST\tx", "2024-06-01 00:00 CEST\tx"] or got[2] == "2024-10-27 03:30 CET\tx"
