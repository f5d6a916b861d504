"""Similarity of words by sets of three letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelweave.functions.text import col


def trigrams(text: Column | str) -> Column:
    """The distinct trigrams of each run of letters and digits, with two blanks before and one after it."""
    runs = F.regexp_extract_all(F.lower(col(text)), F.lit(r"([\p{L}\p{N}]+)"), 1)
    own = F.transform(runs, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(own))


def set_similarity(a: Column | str, b: Column | str) -> Column:
    """Shared over all elements of two sets, as a float; 0 if both are empty, null if one is null."""
    a, b = col(a), col(b)
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(a.isNull() | b.isNull(), None).when(every == 0, F.lit(0.0)).otherwise(both / every).cast("float")


def similarity(a: Column | str, b: Column | str) -> Column:
    return set_similarity(trigrams(a), trigrams(b))
