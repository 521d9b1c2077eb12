import re

from pyspark.sql import functions as F

from quern.llm import urlrules

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b", "", "block"), ("", "", "block"), ("x", "/é", "block"), ("x", "/é", "allow"), (None, "/", "block")]
URLS = [
    None, "", "no scheme", "http://", "https://EXAMPLE.org/es/1?x", "https://m.example.org/en/19", "http://example.org", "http://xexample.org/es/", "http://a.com/fr/x#y", "http://A.Com/de/", "http://com/de",
    "ftp://org?/", "x://y://z.org/", "http://org./", "http://.org/", "http://q.a.b", "http://x/é1", "http://É.org/", "http://example.org/en/1\nb", "a\nb://example.org/es/", "http://example.org:80/es/",
]


def brute(url, rules):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), len(h), a == "block", h + p, a) for h, p, a in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


def test_against_brute_force(spark):
    for rules in (RULES, RULES[:5], []):
        pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, rule string").repartition(3)
        table = spark.createDataFrame(rules, "host string, path string, action string")
        got = urlrules.judge(pages, table)
        assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
        rows = got.collect()
        assert len(rows) == 2 * len(URLS)
        for r in rows:
            assert tuple(r)[1:] == brute(URLS[r["page_id"] % len(URLS)], rules), URLS[r["page_id"] % len(URLS)]
        assert urlrules.judge(pages.limit(0), table).count() == 0


def test_many_rules_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "BROADCAST_RULES", 0)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rows = urlrules.judge(pages, spark.createDataFrame(RULES, "host string, path string, action string")).collect()
    assert all(tuple(r)[1:] == brute(URLS[r["page_id"]], RULES) for r in rows)


def test_more_path_lengths_than_are_listed(spark):
    """Rules of 12,000 different path lengths: the longest that fits wins, whatever their number."""
    rules = spark.range(12_000).select(F.lit("long.org").alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("a"), F.col("id").cast("int"))).alias("path"), F.when(F.col("id") % 2 == 0, "allow").otherwise("block").alias("action"))
    pages = spark.createDataFrame([(n, "http://x.long.org/" + "a" * n + "b?q") for n in (0, 1, 255, 256, 257, 1_001)], "page_id long, url string")
    for r in urlrules.judge(pages, rules).collect():
        assert r["rule"] == "long.org/" + "a" * r["page_id"] and r["verdict"] == ("allow", "block")[r["page_id"] % 2]


def test_every_length_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "MOST_LENGTHS", 1)
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    rows = urlrules.judge(pages, spark.createDataFrame(RULES, "host string, path string, action string")).collect()
    assert all(tuple(r)[1:] == brute(URLS[r["page_id"]], RULES) for r in rows)
