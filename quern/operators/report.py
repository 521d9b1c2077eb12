"""Reports of evaluations: the summary of all records, and for each record an audit of what was returned.

Both are rows of Markdown, made where the records are; only the metrics, one row a
group, are brought together. ``lines`` in the order of (section, a, b) is the report.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import evaluation

# Headings and tables of the report, by section.
VERDICT, PER_CORPUS, PER_TYPE, BELOW, PER_QUERY, MISSES = range(6)
HEADINGS = {
    VERDICT: ("## Verdict", "| Metric | Value | Bar | Pass |", "| --- | --- | --- | --- |"),
    PER_CORPUS: ("## Per corpus", "| corpus | n | recall@5 | hit@1 | MRR |", "| --- | --- | --- | --- | --- |"),
    PER_TYPE: ("## Per query type", "| corpus | type | n | recall@5 | hit@1 | MRR |", "| --- | --- | --- | --- | --- | --- |"),
    BELOW: ("## Queries below recall@5",),
    PER_QUERY: ("## Per-query results", "| corpus | type | rank | query |", "| --- | --- | --- | --- |"),
    MISSES: ("## Misses",),
}
NAMES = {"recall_at_5": "recall@5", "hit_at_1": "hit@1", "mrr": "MRR"}
#: Results of a query below the bar that the report shows.
SHOWN_BELOW = 3
FLAGS = {"full": "[✓✓]", "url": "[✓ ]", "none": "[  ]"}


def _metrics(*more: Column) -> Column:
    return F.concat_ws(" | ", *more, F.col("n").cast("string"), *[F.format_string("%.3f", c) for c in NAMES])


def _rows(df: DataFrame, section: int, line: Column, a: Column | None = None, b: Column | None = None) -> DataFrame:
    none = F.lit("")
    return df.select(F.lit(section).alias("section"), (none if a is None else F.coalesce(a, none)).alias("a"), (none if b is None else F.coalesce(b, none)).alias("b"), line.alias("line"))


def lines(evaluated: DataFrame, corpora: tuple[str, ...] = ()) -> DataFrame:
    """(section, a, b, line) of records(query_id, corpus, type, query, expected_urls, first_rank, top_urls), without headings.

    Corpora that are named stand in the table without records too, with zeros.
    """
    groups = evaluation.by_group(evaluated, corpora)
    gate = evaluation.gate(evaluation.overall(evaluated))  # zeros over nothing
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    order = F.create_map(*[x for i, k in enumerate(NAMES) for x in (F.lit(k), F.lit(str(i)))])
    verdict = F.format_string("| %s | %.3f | ≥ %.2f | %s |", names[F.col("metric")], "value", "bar", T.mark(F.col("value"), F.col("bar")))
    place = F.coalesce(F.format_string("%03d", "first_rank"), F.lit("999"))
    key = F.format_string("%020d", "query_id")
    head = F.format_string("- **[%s/%s]** `%s`", "corpus", "type", "query")
    rank = F.coalesce(F.concat(F.lit("rank "), F.col("first_rank").cast("string")), F.lit(f"not in top {evaluation.DEPTH}"))
    shown = F.transform(F.slice("top_urls", 1, SHOWN_BELOW), lambda u: F.concat(F.lit("\n    - "), u))
    below = F.concat(head, F.lit(" ("), rank, F.lit(")\n  - expected: "), F.get("expected_urls", F.lit(0)), F.lit(f"\n  - top {SHOWN_BELOW} returned:"), F.array_join(F.coalesce(shown, F.array()), ""))
    missed = F.concat(head, F.lit("\n  - expected: "), F.array_join("expected_urls", ", "), F.lit("\n  - top 5 returned: "), F.coalesce(F.nullif(F.array_join("top_urls", ", "), F.lit("")), F.lit("(none)")))
    parts = [
        _rows(gate, VERDICT, verdict, order[F.col("metric")]),
        _rows(groups.filter("level = 1"), PER_CORPUS, F.concat(F.lit("| "), _metrics(F.col("corpus")), F.lit(" |")), F.col("corpus")),
        _rows(groups.filter("level = 2"), PER_TYPE, F.concat(F.lit("| "), _metrics(F.col("corpus"), F.col("type")), F.lit(" |")), F.col("corpus"), F.col("type")),
        _rows(evaluation.below(evaluated), BELOW, below, F.concat("corpus", F.lit(" "), place), key),
        _rows(evaluated, PER_QUERY, F.format_string("| %s | %s | %s | %s |", "corpus", "type", F.coalesce(F.col("first_rank").cast("string"), F.lit("—")), "query"), F.col("corpus"), key),
        _rows(evaluation.misses(evaluated), MISSES, missed, F.lit(""), key),
    ]
    return reduce(DataFrame.unionByName, parts)


def document(found: DataFrame, title: str = "# Retrieval report") -> str:
    """The report as one text, read as a stream of its lines in order; a section without lines says so."""
    out, at = [title], -1
    for r in found.orderBy("section", "a", "b").toLocalIterator():
        for section in range(at + 1, r["section"] + 1):
            out += ["", *HEADINGS[section], *(["None."] if section < r["section"] else [])]
        at = r["section"]
        out.append(r["line"])
    for section in range(at + 1, len(HEADINGS)):
        out += ["", *HEADINGS[section], "None."]
    return "\n".join(out) + "\n"


def flag(matched: Column, url_matched: Column) -> Column:
    """Does the result match in full, by its URL only, or not?"""
    return F.when(matched, FLAGS["full"]).when(url_matched, FLAGS["url"]).otherwise(FLAGS["none"])


def audit(judged: DataFrame, evaluated: DataFrame) -> DataFrame:
    """(query_id, corpus, block): for each record what was expected, and its first results with a shortened text.

    ``judged`` has query_id, rank, url, section, score, text, matched and url_matched; category and page are optional.
    """
    has = lambda c: F.col(c) if c in judged.columns else F.lit(None).cast("string")
    about = F.concat_ws(" · ", F.concat(F.lit("category=`"), has("category"), F.lit("`")), F.concat(F.lit("page "), has("page").cast("string")))
    entry = F.concat(
        F.format_string("%d. %s **score %.3f** — %s  \n    *section:* **%s**", "rank", flag(F.col("matched"), F.col("url_matched")), "score", "url", F.coalesce(F.nullif("section", F.lit("")), F.lit("(none)"))),
        F.when(about != "", F.concat(F.lit("  \n    "), about)).otherwise(""),
        F.lit("\n\n    > "),
        T.shortened(F.coalesce("text", F.lit(""))),
        F.lit("\n"),
    )
    first = judged.filter(F.col("rank") <= evaluation.SHOWN).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("found"))
    listed = lambda name, items: F.when(F.coalesce(F.size(items) > 0, F.lit(False)), F.concat(F.lit(f"\n**{name}:**\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"), F.lit("\n"))).otherwise("")
    passed = F.coalesce(F.col("first_rank") <= evaluation.RECALL_AT, F.lit(False))
    rows = evaluated.join(first, "query_id", "left")
    ranges = F.transform("expected_pages", lambda p: F.concat(p[0].cast("string"), F.lit("–"), p[1].cast("string")))
    head = F.format_string("### %s #%d — `%s` — %s %s\n\n**Query:** `%s`\n", "corpus", "query_id", "type", F.when(passed, "✓").otherwise("✗"), F.coalesce(F.concat(F.lit("rank "), F.col("first_rank").cast("string")), F.lit("not found")), "query")
    returned = F.concat(F.lit(f"\n**Top {evaluation.SHOWN} returned:**\n\n"), F.coalesce(F.array_join(F.transform("found", lambda x: x["entry"]), "\n"), F.lit("")))
    return rows.select("query_id", "corpus", F.concat(head, listed("Expected URL(s)", F.col("expected_urls")), listed("Expected sections", F.col("expected_sections")), listed("Expected pages", ranges), returned, F.lit("\n---\n")).alias("block"))
