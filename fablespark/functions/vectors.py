"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if a vector is null or has no length."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.try_divide(dot(a, b), F.when(size > 0, size))


def word_counts_vector(text: Column, size: int = 64) -> Column:
    """Counts of the words of a text in ``size`` (up to 256) buckets by the first two digits of the words' MD5; null for a null text."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}_]+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 1, 2), 16, 10).cast("int") % size)
    counts = F.aggregate(buckets, F.array_repeat(F.lit(0), size), lambda s, b: F.transform(s, lambda n, i: F.when(i == b, n + 1).otherwise(n)))
    return F.when(text.isNotNull(), F.transform(counts, lambda n: n.cast("double")))
