"""Human review of results: forms, their parsing, page ranges, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The words that a form may hold, and its headings.
VERDICTS = ("correct", "partial", "wrong")
BLANK = "(blank)"


def routing_words(corpora: list[str]) -> list[str]:
    return ["keep", *(f"redirect-to-{c}" for c in corpora), "both-corpora"]


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _between(text: Column, start: str, end: str | None) -> Column:
    """What follows the first ``start``, up to the next ``end``; empty without a start."""
    after = F.when(F.contains(text, F.lit(start)), F.substring(text, F.instr(text, start) + len(start), F.length(text))).otherwise("")
    if end is None:
        return after
    return F.when(F.instr(after, end) > 1, F.substring(after, F.lit(1), F.instr(after, end) - 1)).otherwise(after)


def _word(text: Column, known: list[str]) -> Column:
    """Stripped, lower-cased; null if blank; flagged if it is not a known word."""
    value = F.lower(_strip(text))
    return F.when(value == "", None).when(value.isin(*known), value).otherwise(F.concat(F.lit("INVALID:"), value))


def verdicts(block: Column) -> Column:
    """map of rN to verdict from ``- rN: verdict`` lines; blank ones are left out, of repeated ones the last counts."""
    lines = F.regexp_extract_all(block, F.lit(r"(?m)^- (r\d+:[ \t]*[^\n]*)"), F.lit(1))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^(r\d+)", 1).alias("k"), _word(F.regexp_extract(x, r"^r\d+:[ \t]*(.*)$", 1), list(VERDICTS)).alias("v")))
    put = lambda m, p: F.when(p["v"].isNull(), m).otherwise(F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.aggregate(pairs, F.expr("cast(map() as map<string, string>)"), put)


def fields(block: Column, name: str) -> Column:
    """Stripped values of all ``- name: value`` lines that have one."""
    return F.filter(F.transform(F.regexp_extract_all(block, F.lit(rf"(?mi)^- {name}:[ \t]*([^\n]*)$"), F.lit(1)), _strip), lambda v: v != "")


def bare_urls(urls: Column) -> Column:
    return F.transform(urls, lambda u: F.regexp_replace(u, r"(?s)#.*$", ""))


def fragments(urls: Column) -> Column:
    """What follows the first # of each URL that has one and something after it, stripped: hints at sections."""
    return F.filter(F.transform(urls, lambda u: _strip(F.regexp_extract(u, r"(?s)#(.*)$", 1))), lambda f: f != "")


def page_ranges(values: Column) -> Column:
    """Inclusive ranges from ``25``, ``25-30`` (or an en dash), ``25,30``, ``[25, 30]`` or ``[[25, 30]]``; anything else is skipped."""
    number = lambda s: F.expr("0") if s is None else s.cast("int")
    single = lambda n: F.array(n, n)

    def ranges(value: Column) -> Column:
        v = _strip(value)
        pairs = F.from_json(v, "array<array<int>>")
        flat = F.from_json(v, "array<int>")
        digits = F.regexp_extract_all(v, F.lit(r"([+-]?\d+)"), F.lit(1))
        return (
            F.when(v.rlike(r"^\[\s*(\[\s*-?\d+\s*,\s*-?\d+\s*\]\s*,?\s*)+\]$"), pairs)
            .when(v.rlike(r"^\[\s*-?\d+(\s*,\s*-?\d+)*\s*\]$"), F.transform(flat, single))
            .when(v.rlike(r"^\d+\s*[\-–]\s*\d+$"), F.array(F.transform(F.regexp_extract_all(v, F.lit(r"(\d+)"), F.lit(1)), number)))
            .when(v.rlike(r"^[\s,]*[+-]?\d+\s*(,\s*([+-]?\d+\s*)?)*$") & F.contains(v, F.lit(",")), F.transform(digits, lambda s: single(number(s))))
            .when(v.rlike(r"^[+-]?\d+$"), F.array(single(number(v))))
            .otherwise(F.expr("cast(array() as array<array<int>>)"))
        )

    return F.flatten(F.transform(values, ranges))


def parse(forms: DataFrame, corpora: list[str], path: str = "path", content: str = "value") -> DataFrame:
    """Records of review forms; files without a ``# Row n review`` heading are left out.

    Headings are found by what they begin with, so damaged ones still parse.
    """
    c = F.col(content)
    results = _between(c, "## Per-result verdicts", "## Overall verdict")
    each = []
    for i, name in enumerate(corpora):
        each += [F.lit(name), verdicts(_between(results, f"**{name}:**", f"**{corpora[i + 1]}:**" if i + 1 < len(corpora) else "## "))]
    one = lambda block, name: F.regexp_extract(block, rf"(?m)^- {name}:[ \t]*([^\n]*)", 1)
    truth = _between(c, "## Human truth", None)
    rows = forms.filter(c.rlike(r"(?m)^# Row \d+ review")).select(
        F.regexp_extract(c, r"(?m)^# Row (\d+) review", 1).cast("int").alias("row_index"),
        F.nullif(F.regexp_extract(c, r"(?m)^\*\*Query:\*\* `(.+?)`", 1), F.lit("")).alias("query"),
        F.nullif(F.regexp_extract(c, r"(?m)^\*\*Labeled corpus:\*\* `(\w+)`", 1), F.lit("")).alias("labeled_corpus"),
        F.col(path).alias("review_file"),
        F.create_map(*each).alias("verdicts"),
        _word(one(_between(c, "## Overall verdict", "## Cross-corpus routing"), "overall"), list(VERDICTS)).alias("overall_verdict"),
        _word(one(_between(c, "## Cross-corpus routing", "## Human truth"), "routing"), routing_words(corpora)).alias("routing"),
        F.struct(
            F.get(fields(truth, "corpus"), F.lit(0)).alias("corpus"),
            bare_urls(fields(truth, "url")).alias("urls"),
            F.concat(fields(truth, "section"), fragments(fields(truth, "url"))).alias("sections"),
            page_ranges(fields(truth, "pages")).alias("pages"),
            F.nullif(F.array_join(fields(truth, "notes"), " "), F.lit("")).alias("notes"),
        ).alias("human_truth"),
    )
    return rows.withColumn("incomplete", is_incomplete(rows))


def is_incomplete(rows: DataFrame) -> Column:
    """Has nobody filled anything in?"""
    t = F.col("human_truth")
    return F.forall(F.map_values("verdicts"), lambda m: F.size(m) == 0) & F.col("overall_verdict").isNull() & F.col("routing").isNull() & t["corpus"].isNull() & t["notes"].isNull() & (F.size(t["urls"]) == 0) & (F.size(t["sections"]) == 0) & (F.size(t["pages"]) == 0)


def summary(records: DataFrame) -> DataFrame:
    """(kind, value, n): files in all, completed and incomplete; and of the completed, counts by verdict and by routing."""
    entry = lambda kind, value, n: F.struct(F.lit(kind).alias("kind"), value.alias("value"), n.cast("long").alias("n"))
    done = ~F.col("incomplete")
    told = [entry("files", F.lit("total"), F.lit(1)), entry("files", F.lit("completed"), done), entry("files", F.lit("incomplete"), ~done)]
    told += [entry(kind, F.coalesce(c, F.lit(BLANK)), F.when(done, 1)) for kind, c in (("overall", "overall_verdict"), ("routing", "routing"))]
    none = records.sparkSession.range(1).select(F.explode(F.array(*[entry("files", F.lit(x), F.lit(0)) for x in ("total", "completed", "incomplete")])).alias("x"))
    rows = records.select(F.explode(F.array(*told)).alias("x")).unionByName(none).select("x.*")
    return rows.filter("n is not null").groupBy("kind", "value").agg(F.sum("n").alias("n"))


#: Results of a corpus that a form has room for.
FORM_RESULTS = 5


def form(row: Column, query: Column, labeled: Column, corpora: list[str], companion: Column) -> Column:
    """A blank form, as ``parse`` reads it: the row's number, its query and label, and a line for each thing to say."""
    blanks = "\n\n".join(f"**{c}:**\n\n" + "\n".join(f"- r{i}: " for i in range(1, FORM_RESULTS + 1)) for c in corpora)
    choice = lambda words: " | ".join(f"`{w}`" for w in words)
    truth = "\n".join(f"- {name}: " for name in ("corpus", "url", "section", "pages", "notes"))
    return F.concat(
        F.lit("# Row "), row.cast("string"), F.lit(" review\n\n> Results: `"), companion, F.lit("`\n\n**Query:** `"), query, F.lit("`\n**Labeled corpus:** `"), labeled,
        F.lit(f"`\n\n---\n\n## Per-result verdicts\n\nOne of {choice(VERDICTS)} each, or blank.\n\n{blanks}\n\n"),
        F.lit(f"## Overall verdict\n\nOne of {choice(VERDICTS)}.\n\n- overall: \n\n## Cross-corpus routing\n\nOne of {choice(routing_words(corpora))}.\n\n- routing: \n\n"),
        F.lit(f"## Human truth\n\nOnly where no result is right; a line may be repeated for more values.\n\n{truth}\n"),
    )


def result_blocks(results: DataFrame) -> DataFrame:
    """(query_id, corpus, blocks): the full results of each query in a corpus, best first, from (query_id, corpus, rank, score, url, title, section, text)."""
    or_none = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("(none)"))
    head = F.format_string("#### r%d — score %.3f\n\n- **url:** %s\n- **title:** %s\n- **section:** %s\n\n**Full text:**\n\n```\n", "rank", "score", F.coalesce("url", F.lit("")), or_none("title"), or_none("section"))
    block = F.concat(head, F.coalesce("text", F.lit("")), F.lit("\n```\n"))
    rows = results.filter(F.col("rank") <= FORM_RESULTS).groupBy("query_id", "corpus").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("found"))
    return rows.select("query_id", "corpus", F.array_join(F.transform("found", lambda x: x["block"]), "\n").alias("blocks"))


def results_document(golden: DataFrame, blocks: DataFrame, corpora: list[str]) -> DataFrame:
    """(query_id, value): the read-only companion of a form: what was expected, and what each corpus returned."""
    by_corpus = blocks.groupBy("query_id").pivot("corpus", corpora).agg(F.first("blocks"))
    listed = lambda items, fence="": F.when(F.coalesce(F.size(items) > 0, F.lit(False)), F.concat(F.lit("\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit(f"  - {fence}"), x, F.lit(fence))), "\n"))).otherwise(" (none)")
    ranges = F.transform("expected_pages", lambda p: F.concat(p[0].cast("string"), F.lit("–"), p[1].cast("string")))
    panels = [F.concat(F.lit(f"## {c} results (top {FORM_RESULTS})\n\n"), F.coalesce(F.col(f"`{c}`"), F.lit("_(no results)_\n")), F.lit("\n---\n\n")) for c in corpora]
    head = F.concat(
        F.format_string("# Row %d results: %s / %s\n\n**Query:** `%s`\n\n- **corpus:** `%s`\n", "query_id", "corpus", F.coalesce("type", F.lit("?")), "query", "corpus"),
        F.lit("- **expected_urls:**"), listed(F.col("expected_urls")), F.lit("\n- **expected_sections:**"), listed(F.col("expected_sections"), "`"), F.lit("\n- **expected_pages:**"), listed(ranges), F.lit("\n\n---\n\n"),
    )
    return golden.join(by_corpus, "query_id", "left").select("query_id", F.concat(head, *panels).alias("value"))
