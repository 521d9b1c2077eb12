"""URLs as expressions: paths, normal forms, categories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beginnings of paths of generated pages that are no content.
MACHINERY = ("/_modules/", "/_sources/", "/genindex", "/py-modindex", "/search.html")
# Category by the first beginning of the path that fits; the order counts.
CATEGORIES = (
    ("/user_guide/", "user_guide"),
    ("/api_reference/", "api_reference"),
    ("/developer_guide/release_notes/", "release_notes"),
    ("/developer_guide/", "developer_guide"),
    ("/getting_started/", "getting_started"),
    ("/assets/", "tutorial"),
    ("/background/", "background"),
)
OTHER = "other"


def path(url: Column) -> Column:
    """The path component, empty if there is none; the host plays no part. Works on relative URLs and never fails."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def host(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def normalized(url: Column) -> Column:
    """Without fragment and trailing slashes, unless nothing would remain."""
    bare = F.regexp_replace(without_fragment(url), "/+$", "")
    return F.when(bare == "", url).otherwise(bare)


def is_content(url: Column, machinery: Sequence[str] = MACHINERY) -> Column:
    out = F.lit(True)
    for prefix in machinery:
        out = out & ~F.startswith(path(url), F.lit(prefix))
    return out


def category(url: Column, rules: Sequence[tuple[str, str]] = CATEGORIES, other: str = OTHER) -> Column:
    found = F.lit(other)
    for prefix, label in reversed(rules):
        found = F.when(F.startswith(path(url), F.lit(prefix)), label).otherwise(found)
    return found


def cache_key(url: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1: a key of the fetch cache."""
    return F.substring(F.sha1(url.cast("binary")), 1, 16)


def chunk_id(url: Column, section: Column, order: Column) -> Column:
    return F.substring(F.sha1(F.concat(url, F.lit("|"), section, F.lit("|"), order.cast("string")).cast("binary")), 1, 16)


def is_html(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return kind.contains("text/html") | kind.contains("application/xhtml")


def route(content_type: Column, url: Column) -> Column:
    """pdf or html by content type or the URL's suffix, pdf first; else null."""
    kind, plain = F.coalesce(content_type, F.lit("")), F.lower(F.coalesce(url, F.lit("")))
    return F.when(kind.contains("application/pdf") | plain.endswith(".pdf"), "pdf").when(kind.contains("text/html") | plain.endswith(".html") | plain.endswith(".htm"), "html")
