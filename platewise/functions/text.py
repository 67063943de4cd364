"""Text columns: normalisation, parsing, set similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(text: Column) -> Column:
    """Lower case, without tags, parentheses, digits and punctuation; single spaces."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern in (r"<[^>]*>", r"\([^)]*\)", r"[^a-z ]", " +"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(out)


def r_vector(text: Column) -> Column:
    """The quoted items of an R vector such as c("a", "b, c"); unquoted NA becomes null at its place."""
    items = F.regexp_extract_all(text, F.lit(r'("[^"]*"|\bNA\b)'), F.lit(1))
    return F.transform(items, lambda x: F.when(x != "NA", F.regexp_replace(x, '^"|"$', "")))


def canonical_id(text: Column) -> Column:
    """38.0, 38.000 and 3.8e+01 are 38."""
    return F.bround(text.try_cast("double")).cast("long").cast("string")


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """|a and b| / |a or b| of arrays of distinct elements."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)).cast("double")), F.lit(empty))


def ngrams(words: Column, n: int) -> Column:
    """All runs of n words, as strings."""
    last = F.size(words) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
