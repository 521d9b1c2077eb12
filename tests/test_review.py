import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, review, usage

FORM = """# Row 5 review

**Query:** `what is it`
**Labeled corpus:** `left`

## Per-result verdicts
**left:**
- r1:partial
- r2: Wrong
- r2: CORRECT
- r3:
- r4: maybe
**right:**
- r1: correct
## Overall verdict
- overall: partial
## Cross-corpus routing1 then
- routing: both-corpora
## Human truth (the actual right answer)
- corpus: right
- url: https://h/a#part
- url: https://h/b
- section: S
- pages: 25-30
- pages: 7
- notes: one
- notes: two
"""


def parsed(spark, text):
    return review.parse(spark.createDataFrame([("p", text)], "path string, value string"), ["left", "right"]).collect()


def test_form(spark):
    r = parsed(spark, FORM)[0]
    assert (r["row_index"], r["query"], r["labeled_corpus"], r["overall_verdict"], r["routing"], r["incomplete"]) == (5, "what is it", "left", "partial", "both-corpora", False)
    assert r["verdicts"] == {"left": {"r1": "partial", "r2": "correct", "r4": "INVALID:maybe"}, "right": {"r1": "correct"}}
    t = r["human_truth"]
    assert (t["corpus"], t["urls"], t["sections"], t["pages"], t["notes"]) == ("right", ["https://h/a", "https://h/b"], ["S", "part"], [[25, 30], [7, 7]], "one two")


def test_blank_and_foreign_files(spark):
    blank = "# Row 6 review\n## Per-result verdicts\n**left:**\n- r1: \n## Overall verdict\n- overall: \n## Human truth\n- url: \n"
    assert parsed(spark, blank)[0]["incomplete"] and parsed(spark, "# Row x\n") == []


@pytest.mark.parametrize("value,want", [("25", [[25, 25]]), ("25-30", [[25, 30]]), ("25 – 30", [[25, 30]]), ("25, 30,", [[25, 25], [30, 30]]), ("[[20, 50], [60,70]]", [[20, 50], [60, 70]]), ("[7]", [[7, 7]]), ("x", []), ("[1, x]", []), ("1,x", [])])
def test_page_ranges(spark, value, want):
    assert spark.createDataFrame([([value],)], "v array<string>").select(review.page_ranges(F.col("v"))).first()[0] == want


def test_matches(spark):
    rows = [
        ("https://a/x.html", "Intro ATL", 25, ["http://b/x.html#f"], None, None, True),
        ("https://a/y.html", "Intro", 25, ["http://b/x.html"], None, None, False),
        ("https://a/x.html", "Intro ATL", None, ["/x.html"], ["atl"], None, True),
        ("https://a/x.html", "Intro", 25, ["/x.html"], ["atl"], [[20, 30]], True),
        ("https://a/x.html", "Intro", 31, ["/x.html"], ["atl"], [[20, 30]], False),
        ("https://a/x.html", "Intro", None, ["/x.html"], [], [], True),
        ("https://a/x.html", None, None, ["/x.html"], ["a"], None, False),
    ]
    df = spark.createDataFrame(rows, "url string, section string, page int, u array<string>, s array<string>, p array<array<int>>, want boolean")
    got = df.select("want", evaluation.full_match(*[F.col(c) for c in ("url", "section", "page", "u", "s", "p")]).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_metrics(spark):
    schema = "query_id long, corpus string, type string, first_rank int"
    rows = [(1, "a", "t", 1), (2, "a", "t", 5), (3, "a", "u", 6), (4, "b", "t", None)]
    df = spark.createDataFrame(rows, schema)
    assert tuple(evaluation.overall(df).first()) == (4, 0.5, 0.25, pytest.approx((1 + 1 / 5 + 1 / 6) / 4))
    groups = {(r["corpus"], r["type"]): r["n"] for r in evaluation.by_group(df).collect()}
    assert groups == {(None, None): 4, ("a", None): 3, ("b", None): 1, ("a", "t"): 2, ("a", "u"): 1, ("b", "t"): 1}
    assert tuple(evaluation.overall(df.limit(0)).first()) == (0, 0, 0, 0)
    assert [r["query_id"] for r in evaluation.below_recall(df).collect()] == [3, 4] and evaluation.misses(df).count() == 1
    assert [r["passed"] for r in evaluation.gate(evaluation.overall(df)).orderBy("metric").collect()] == [False, False, False]


def test_cost_and_times(spark):
    a = spark.createDataFrame([(1, 1_000_000.0)], "ts int, value double")
    b = spark.createDataFrame([(2, 1000.0)], "ts int, value double")
    rows = {r["ts"]: r for r in usage.cost_by_bucket(a, b).collect()}
    assert rows[1]["cost_usd"] == pytest.approx(0.2) and rows[2]["cost_usd"] == pytest.approx(2 * 0.0000166667) and rows[None]["invocations"] == 1_000_000
    assert [tuple(r) for r in usage.cost_by_bucket(a.limit(0), b.limit(0)).collect()] == [(None, 0, 0.0, 0.0)]
    lines = ["2024-01-05T10:30:00+00:00\t7", "2024-07-05T10:30:00Z\t7", "nothing", "", "2024-13-05T10:30:00Z\t7", "x\ty"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "l string").select(usage.local_line(F.col("l"), "America/New_York")).collect()]
    assert got == ["2024-01-05 05:30 EST\t7", "2024-07-05 06:30 EDT\t7", *lines[2:]]
