"""Terms, normalisation, splitting and display of texts, as expressions that stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that are not terms.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "what", "which", "who", "when", "where", "why", "how",
    "and", "or", "but", "if", "then", "else", "of", "in", "on", "at",
    "to", "for", "with", "by", "as", "that", "this", "these", "those",
    "do", "does", "did", "can", "could", "should", "would",
    "i", "you", "he", "she", "it", "we", "they",
    "my", "your", "his", "her", "its", "our", "their",
    "me", "us", "them", "him",
)
# What a term is made of, and sizes in characters.
TERM = "[a-z0-9_]+"
CHUNK_CAP = 1500
LEAST_CHUNK = 40
AUDIT_CHARS = 400
SLUG_CHARS = 60


def terms(text: Column) -> Column:
    """The distinct terms of a text: runs of ASCII letters, digits and underscores, lower-cased, longer than one and no stopword."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOPWORDS)))


def plain_terms(text: str) -> list[str]:
    """``terms`` of one text in the driver."""
    return list(dict.fromkeys(t for t in re.findall(TERM, text.lower()) if len(t) > 1 and t not in STOPWORDS))


def chunk_terms(text: Column, section: Column) -> Column:
    """What a chunk can be matched by: the terms of its text and section, not of its title."""
    return terms(F.concat_ws(" ", text, section))


def collapse(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def page_text(text: Column) -> Column:
    """Page text: spaces and tabs collapse to a space, line breaks with the white space around them to a line feed."""
    spaced = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"(?U)\s*\n\s*", "\n"), r"(?U)^\s+|\s+$", "")


def _stripped(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")


def split_long(text: Column, cap: int = CHUNK_CAP) -> Column:
    """Pieces of at most ``cap`` characters: whole, else paragraphs or else sentences joined by spaces while they fit, else cut hard.

    An empty text has no piece; a text up to the cap is its own piece, as it stands.
    """
    paragraphs = _stripped(F.split(text, r"\n{2,}", -1))
    sentences = _stripped(F.split(text, r"(?<=[.!?])(?U)\s+(?=[A-Z])", -1))
    units = F.when(F.size(paragraphs) > 1, paragraphs).otherwise(sentences)
    empty = F.expr("named_struct('full', cast(array() as array<string>), 'open', '')")

    def put(acc: Column, unit: Column) -> Column:
        fits = F.length(acc["open"]) + 1 + F.length(unit) <= cap
        return (
            F.when(acc["open"] == "", F.struct(acc["full"].alias("full"), unit.alias("open")))
            .when(fits, F.struct(acc["full"].alias("full"), F.concat(acc["open"], F.lit(" "), unit).alias("open")))
            .otherwise(F.struct(F.concat(acc["full"], F.array(acc["open"])).alias("full"), unit.alias("open")))
        )

    packed = F.aggregate(units, empty, put, lambda acc: F.filter(F.concat(acc["full"], F.array(acc["open"])), lambda p: p != ""))
    cut = F.flatten(F.transform(packed, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / cap).cast("int")), lambda i: F.substring(p, i * cap + 1, F.lit(cap)))))
    return F.when(F.length(text) == 0, F.expr("cast(array() as array<string>)")).when(F.length(text) <= cap, F.array(text)).otherwise(cut)


def shortened(text: Column, limit: int = AUDIT_CHARS) -> Column:
    """Collapsed; beyond the limit cut there, back to the last space if there is one, with an ellipsis."""
    flat = collapse(text)
    cut = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, r"(?s)^(.*) .*$", "$1"), F.lit("…")))


def slug(text: Column, most: int = SLUG_CHARS) -> Column:
    """Lower-case ASCII letters and digits with single hyphens between; beyond ``most`` cut there, back to the last hyphen."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.length(plain) <= most, plain).otherwise(F.regexp_replace(F.substring(plain, 1, most), r"^(.*)-.*$", "$1"))


def snippet(text: Column, most: int = 80) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def shown_url(url: Column, prefixes: tuple[str, ...] = ("https://", "http://"), width: int = 55) -> Column:
    """Without the first prefix that fits, cut or padded to ``width``."""
    bare = url
    for p in reversed(prefixes):
        bare = F.when(url.startswith(p), F.substring(url, len(p) + 1, 100_000)).otherwise(bare)
    return F.rpad(F.substring(bare, 1, width), width, " ")


def mark(value: Column, bar: float) -> Column:
    return F.when(value >= bar, "✓").otherwise("✗")
