"""Scoring of retrieval against labelled queries: matches, first ranks, recall, hit rate, reciprocal rank, groups and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import urls as U

# How deep a match is looked for, what recall looks at, and the bars.
DEPTH, RECALL_AT, SHOWN = 50, 5, 5
BARS = {"recall_at_5": 0.70, "hit_at_1": 0.50, "mrr": 0.55}
#: Half width of a 95 % interval in standard deviations.
Z = 1.96


def url_match(url: Column, expected_urls: Column) -> Column:
    """Is the path the path of one of the expected URLs?"""
    return F.exists(expected_urls, lambda u: U.path(u) == U.path(url))


def full_match(url: Column, section: Column, page: Column, expected_urls: Column, expected_sections: Column, expected_pages: Column) -> Column:
    """The path must be expected. If sections or pages narrow it, one of them must hold as well: an expected section within
    the chunk's (in any case), or the page within an inclusive range. Empty lists narrow as little as null."""
    has = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    by_section = has(expected_sections) & F.coalesce(F.exists(expected_sections, lambda s: F.contains(F.lower(section), F.lower(s))), F.lit(False))
    by_page = has(expected_pages) & F.coalesce(F.exists(expected_pages, lambda r: page.between(r[0], r[1])), F.lit(False))
    return F.coalesce(url_match(url, expected_urls), F.lit(False)) & ((~has(expected_sections) & ~has(expected_pages)) | by_section | by_page)


def judged(results: DataFrame, golden: DataFrame) -> DataFrame:
    """results(query_id, rank, url, section, page) with matched and url_matched, by golden(query_id, expected_*)."""
    rows = results.filter(F.col("rank") <= DEPTH).join(golden, "query_id")
    return rows.select(
        *(results[c] if c != "query_id" else F.col(c) for c in results.columns),
        full_match(F.col("url"), F.col("section"), F.col("page"), F.col("expected_urls"), F.col("expected_sections"), F.col("expected_pages")).alias("matched"),
        F.coalesce(url_match(F.col("url"), F.col("expected_urls")), F.lit(False)).alias("url_matched"),
    )


def records(results: DataFrame, golden: DataFrame, *kept: str) -> DataFrame:
    """(query_id, corpus, type, kept columns of golden, first_rank, top_urls): first_rank is null without a match; queries without results stay."""
    rows = judged(results, golden)
    top = F.array_sort(F.collect_list(F.when(F.col("rank") <= SHOWN, F.struct("rank", "url"))))
    best = rows.groupBy("query_id").agg(F.min(F.when(F.col("matched"), F.col("rank"))).alias("first_rank"), F.transform(top, lambda x: x["url"]).alias("top_urls"))
    return golden.select("query_id", "corpus", "type", *kept).join(best, "query_id", "left")


def _metrics() -> list[Column]:
    rank = F.col("first_rank")
    share = lambda c: F.coalesce(F.avg(F.when(c, 1.0).otherwise(0.0)), F.lit(0.0))
    return [F.count("query_id").alias("n"), share(rank <= RECALL_AT).alias("recall_at_5"), share(rank == 1).alias("hit_at_1"), F.coalesce(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))), F.lit(0.0)).alias("mrr")]


def overall(evaluated: DataFrame) -> DataFrame:
    """n, recall_at_5, hit_at_1, mrr; zeros for no record."""
    return evaluated.agg(*_metrics())


def by_group(evaluated: DataFrame, corpora: Sequence[str] = ()) -> DataFrame:
    """The metrics over all, by corpus, and by corpus and type, by one pass of grouping sets; level is 0, 1 or 2.

    Named corpora have a row of zeros where they have no record.
    """
    level = (F.lit(2) - F.grouping("corpus") - F.grouping("type")).cast("int").alias("level")
    rows = evaluated.groupingSets([[], ["corpus"], ["corpus", "type"]], "corpus", "type").agg(level, *_metrics()).select("level", "corpus", "type", "n", "recall_at_5", "hit_at_1", "mrr")
    if not corpora:
        return rows
    named = evaluated.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, corpora))).alias("corpus"))
    absent = named.join(evaluated.select("corpus").distinct(), "corpus", "left_anti")
    zeros = [F.lit(0.0).alias(c) for c in ("recall_at_5", "hit_at_1", "mrr")]
    return rows.unionByName(absent.select(F.lit(1).alias("level"), "corpus", F.lit(None).cast("string").alias("type"), F.lit(0).cast("long").alias("n"), *zeros))


def gate(metrics: DataFrame, bars: dict[str, float] | None = None) -> DataFrame:
    """(metric, value, bar, passed) for each bar."""
    bars = BARS if bars is None else bars
    return metrics.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(v).alias("bar")) for k, v in bars.items()])).alias("x")).select("x.*", (F.col("x.value") >= F.col("x.bar")).alias("passed"))


def below(evaluated: DataFrame) -> DataFrame:
    """Records that recall does not count."""
    return evaluated.filter(F.col("first_rank").isNull() | (F.col("first_rank") > RECALL_AT))


def below_recall(evaluated: DataFrame) -> DataFrame:
    """Records that recall does not count, by corpus and rank."""
    return below(evaluated).orderBy("corpus", F.coalesce("first_rank", F.lit(999)), "query_id")


def misses(evaluated: DataFrame) -> DataFrame:
    return evaluated.filter(F.col("first_rank").isNull())


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Low and high end of the Wilson score interval of a share; 0 and 1 for no trial."""
    p, total = successes / n, n.cast("double")
    middle, half = (p + z * z / (2 * total)) / (1 + z * z / total), z * F.sqrt(p * (1 - p) / total + z * z / (4 * total * total)) / (1 + z * z / total)
    return F.when(n == 0, 0.0).otherwise(middle - half), F.when(n == 0, 1.0).otherwise(middle + half)
