"""Similarities of vectors and of maps of factors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null for vectors of different lengths."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), None).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def distance(a: Column, b: Column) -> Column:
    square = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(square))


def factor_similarity(a: Column, b: Column) -> Column:
    """1 less the mean absolute difference over the shared keys; null without any."""
    keys = F.array_intersect(F.map_keys(a), F.map_keys(b))
    total = F.aggregate(keys, F.lit(0.0), lambda s, k: s + F.abs(F.element_at(a, k) - F.element_at(b, k)))
    return F.when(F.size(keys) > 0, 1 - total / F.size(keys))


def pseudo_embedding(text: Column) -> Column:
    """32 numbers from -1 to 1: the bytes of the text's SHA-256."""
    digest = F.sha2(text.cast("binary"), 256)
    return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.conv(F.substr(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1)


def face_score(cosine_: Column) -> Column:
    """A cosine on a scale from 0 to 0.999."""
    return F.greatest(F.lit(0.0), F.least(F.lit(0.999), 0.5 + 0.5 * cosine_))


def face_confidence(score: Column) -> Column:
    """The confidence in a face score: 0.6 and four tenths of it, at most 0.99, three decimals."""
    return F.round(F.round(F.least(F.lit(0.99), 0.6 + score * 0.4), 9), 3)
