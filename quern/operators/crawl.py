"""Discovery of pages over a table of links: breadth first from a seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import urls as U

MOST_PAGES = 200


def breadth_first(links: DataFrame, seeds: DataFrame, most: int | None = MOST_PAGES) -> DataFrame:
    """(url, depth) of what is reached from seeds(url) over links(url, link), by normal form, each once at its least depth.

    Each round joins the last frontier with the links and leaves out what has been seen. A
    frontier is written once, as one part of the table of pages seen, and the rounds end with an
    empty one, or with ``most`` pages: the crawl's page limit, the first by depth, then URL.
    """
    spark = links.sparkSession
    edges = links.select(U.normalized(F.col("url")).alias("url"), U.normalized(F.col("link")).alias("link")).distinct()
    edges = scratch.written(edges.filter("url is not null and link is not null"), "edges")
    base, level, found = scratch.path(spark, "seen"), 0, 0
    seen = lambda part="": spark.read.schema("url string, depth int").option("recursiveFileLookup", True).parquet(base + part)
    fresh = seeds.select(U.normalized(F.col("url")).alias("url")).distinct()
    while True:
        fresh.select("url", F.lit(level).alias("depth")).write.parquet(f"{base}/level-{level}")
        frontier = seen(f"/level-{level}")
        new = frontier.count()
        found += new
        if not new or (most is not None and found >= most):
            return seen() if most is None else seen().orderBy("depth", "url").limit(most)
        fresh = frontier.join(edges, "url").select(F.col("link").alias("url")).distinct().join(seen(), "url", "left_anti")
        level += 1
