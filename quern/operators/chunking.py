"""From pages and documents to chunks: pieces, order keys, ids, corpus order, sections from a table of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern import scratch
from quern.functions import text as T
from quern.functions import urls as U

#: Order keys of one section; more pieces than this would meet the next section's.
SECTION_STEP = 1000
#: Characters of a string that is the last key of an order by which its ranges are chosen.
RANGE_CHARS = 64


def pieces(df: DataFrame, text: str = "text", cap: int = T.CHUNK_CAP, least: int = 0, stripped: bool = True) -> DataFrame:
    """A row for each piece of each text: the other columns, sub (the piece's index before short ones go) and piece.

    ``stripped`` says whether pieces are stripped before their length is compared with ``least``.
    """
    kept = [c for c in df.columns if c != text]
    rows = df.select(*kept, F.posexplode(T.split_long(F.coalesce(text, F.lit("")), cap)).alias("sub", "piece"))
    if stripped:
        rows = rows.withColumn("piece", F.regexp_replace("piece", r"(?U)^\s+|\s+$", ""))
    return rows.filter(F.length("piece") >= least) if least else rows


def order_key(heading: Column, sub: Column) -> Column:
    """heading * 1000 + sub; sub alone where there is no heading (null)."""
    return F.coalesce(heading, F.lit(0)) * SECTION_STEP + sub


def chunks(sections: DataFrame, cap: int = T.CHUNK_CAP, least: int = T.LEAST_CHUNK) -> DataFrame:
    """sections(url, title, section, heading, body) to chunks(id, url, title, section, category, text, order_key)."""
    rows = pieces(sections, "body", cap, least)
    rows = rows.select("url", "title", "section", U.category(F.col("url")).alias("category"), F.col("piece").alias("text"), order_key(F.col("heading"), F.col("sub")).alias("order_key"))
    return rows.select(U.chunk_id(F.col("url"), F.col("section"), F.col("order_key")).alias("id"), "*")


def in_corpus_order(rows: DataFrame, *keys: str) -> DataFrame:
    """Adds pos, from 0, by the keys, without one task that sees all rows.

    Rows are dealt out by ranges of the keys and written with their range and their place in it, so that
    the counts and the result come from the same ranges, whatever the planner makes of them. What is put in
    order over all is a count for each range. Rows with equal keys go in any order, and may be split over ranges
    (not if the last key is a string of more than RANGE_CHARS characters). The sample of the keys by which ranges
    are chosen reaches the driver, so of a string at the end it has RANGE_CHARS characters only.
    """
    spark = rows.sparkSession
    stored = scratch.path(spark, "unordered")
    rows.write.mode("overwrite").parquet(stored)  # ranges are sampled first: what the rows are made from runs once
    tie, bounds = F.monotonically_increasing_id(), list(keys)
    if rows.schema[keys[-1]].dataType.simpleString() == "string":
        bounds[-1:] = ["__cut"]
        tie = F.when(F.coalesce(F.length(keys[-1]), F.lit(0)) <= RANGE_CHARS, tie)
    ranged = spark.read.schema(rows.schema).parquet(stored).withColumns({"__cut": F.substring(F.col(keys[-1]).cast("string"), 1, RANGE_CHARS), "__tie": tie})
    ranged = ranged.repartitionByRange(*bounds, "__tie").sortWithinPartitions(*keys).drop("__cut", "__tie").withColumn("__part", F.spark_partition_id())
    ranged = scratch.written(ranged.withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ordered")
    scratch.drop(spark, stored)
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    upto = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    return ranged.join(F.broadcast(base), "__part").withColumn("pos", F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def titles_at(pages: DataFrame, toc: DataFrame) -> DataFrame:
    """pages(url, page_num, ...) with section: the title of the last toc(url, level, title, page, seq) entry at or before the page.

    A backward as-of join: entries and pages of a document in one order, the last title carried
    forward. A blank latest title, or none, gives ``Page n``; pages without a url or a number have no entries. Of entries on one page the later one (seq) counts.
    """
    entries = toc.select("url", F.col("page").alias("at"), F.lit(0).alias("kind"), "seq", F.trim("title").alias("title"))
    asked = pages.select("url", F.col("page_num").alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("seq"), F.lit(None).cast("string").alias("title")).distinct()
    order = Window.partitionBy("url").orderBy("at", "kind", "seq").rowsBetween(Window.unboundedPreceding, 0)
    carried = entries.unionByName(asked).withColumn("last", F.last("title", ignorenulls=True).over(order)).filter("kind = 1")
    named = carried.select("url", F.col("at").alias("page_num"), F.coalesce(F.nullif("last", F.lit("")), F.concat(F.lit("Page "), F.col("at").cast("string"))).alias("section"))
    plain = F.concat(F.lit("Page "), F.coalesce(F.col("page_num").cast("string"), F.lit("?")))
    return pages.join(named, ["url", "page_num"], "left").withColumn("section", F.coalesce("section", plain))


def page_chunks(pages: DataFrame, toc: DataFrame, cap: int = T.CHUNK_CAP, least: int = T.LEAST_CHUNK) -> DataFrame:
    """pages(url, page_num, text) to (url, section, source_page, sub, text, order_key): short pages go, short pieces of longer ones stay."""
    rows = pages.withColumn("text", T.page_text(F.col("text"))).filter(F.length("text") >= least)
    rows = pieces(titles_at(rows, toc), "text", cap, stripped=False)
    return rows.select("url", "section", F.col("page_num").alias("source_page"), "sub", F.col("piece").alias("text"), order_key(F.col("page_num"), F.col("sub")).alias("order_key"))
