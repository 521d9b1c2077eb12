"""URL rules by host suffix and path prefix, with DataFrame functions only.

A rule has a host and the beginning of a path; it fits its host and all subdomains.
Each distinct host and path is expanded into host-suffix and path-prefix
expressions (prefixes of those lengths only that rules have, or of all lengths where the
rules have very many), expressions and rules meet by the first hexadecimal digits of their SHA-256, and the full digests are
compared. Of the rules that fit, the longest wins (host and path together; then the
longer host; then block before allow).

Rules are broadcast only if there are BROADCAST_RULES at most; beyond that the join
shuffles by the short prefixes, which are as good as random, so no host can make a
hot one on the side of the rules, and skewed pages are split at run time.

Defined cases: a url that is null or has no ``://`` has an empty host and path, which
no rule fits; where no rule fits, the rule is null and the verdict the default;
repeated rows give equal rows; an empty table gives an empty result; null rule
hosts, paths or actions never fit.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Hexadecimal digits of a digest that are joined on.
PREFIX_DIGITS = 8
#: Rules up to which they are broadcast: a few hundred bytes each.
BROADCAST_RULES = 50_000
#: Distinct lengths of rules' paths up to which paths are expanded to these only; beyond it to every length that they have.
MOST_LENGTHS = 256


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _expressions(host: Column, path: Column, lengths: list[int] | None) -> Column:
    """Every suffix of the host at a dot, with every prefix of the path that is as long as a rule's, or of any length without a list."""
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    if lengths is None:
        prefixes = F.transform(F.sequence(F.lit(0), F.char_length(path)), lambda n: F.substring(path, F.lit(1), n))
    else:
        prefixes = F.filter(F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p))))


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """key, host, path, rule, verdict for every row of ``pages``; ``rules`` has host, path and action."""
    rules = rules.filter("host is not null and path is not null and action is not null").select("host", "path", "action").distinct()
    many = rules.count()
    known = [r[0] for r in rules.select(F.char_length("path")).distinct().limit(MOST_LENGTHS + 1).collect()]
    lengths = sorted(known) if len(known) <= MOST_LENGTHS else None
    digest = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    known = rules.select(F.substring(digest, 1, PREFIX_DIGITS).alias("short"), digest.alias("rule_digest"), F.struct(F.char_length(F.concat("host", "path")).alias("both"), F.char_length("host").alias("host_length"), (F.col("action") == BLOCK).cast("int").alias("block"), F.concat("host", "path").alias("rule"), "action").alias("found"))
    rows = pages.select(key, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not many:
        return rows.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    asked = rows.select("host", "path").distinct()
    asked = asked.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), lengths)).alias("expression"))
    asked = asked.withColumn("digest", F.sha2("expression", 256)).drop("expression").withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    met = asked.join(F.broadcast(known) if many <= BROADCAST_RULES else known, "short").filter("digest = rule_digest")
    best = met.groupBy("host", "path").agg(F.max("found").alias("found"))
    return rows.join(best, ["host", "path"], "left").select(key, "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.action", F.lit(default)).alias("verdict"))
