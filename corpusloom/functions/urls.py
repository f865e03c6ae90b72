"""Lenient url expressions.

``parse_url`` rejects what a crawler must still look at (spaces, stray
brackets), so the parts come from the generic-syntax pattern of RFC 3986.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: generic url syntax, RFC 3986 appendix B.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(\?[^#]*)?(#.*)?"

# Path endings that are not pages.
SKIPPED_ENDINGS = (".pdf", ".jpg", ".png", ".zip", ".css", ".js")


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 5)


def without_dot_segments(p: Column) -> Column:
    """Resolve "." and ".." of an absolute path."""
    parts = F.split(F.substring(p, 2, 1 << 30), "/")
    start = F.expr("cast(array() as array<string>)")

    def step(stack: Column, seg: Column) -> Column:
        popped = F.when(F.size(stack) > 0, F.slice(stack, 1, F.size(stack) - 1)).otherwise(stack)
        return F.when(seg == "..", popped).when(seg == ".", stack).otherwise(F.array_append(stack, seg))

    closing = F.when(
        F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))
    ).otherwise(start)
    kept = F.concat(F.aggregate(parts, start, step), closing)
    return F.when(p.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(p)


def join(base: Column, ref: Column) -> Column:
    """Resolve a reference found on the page ``base``."""
    root = F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.lit("//"), netloc(base))
    base_path = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    tail = F.concat(query(ref), fragment(ref))
    joined = (
        F.when(ref == "", base)
        .when(scheme(ref) != "", ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"^([^:/?#]+:)", 1), ref))
        .when(ref.startswith("/"), F.concat(root, without_dot_segments(path(ref)), tail))
        .when(ref.startswith("?"), F.concat(root, path(base), tail))
        .when(ref.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), ref))
        .otherwise(F.concat(root, without_dot_segments(F.concat(folder, path(ref))), tail))
    )
    return F.regexp_replace(joined, r"#$", "")


def is_internal(url: Column, domain: Column) -> Column:
    """Same host and port, http(s), and not a file that is no page."""
    p = F.lower(path(url))
    skipped = F.lit(False)
    for ending in SKIPPED_ENDINGS:
        skipped = skipped | p.endswith(ending)
    return (netloc(url) == domain) & scheme(url).isin("http", "https") & ~skipped
