"""Scalar functions that the mining operators share, as Spark column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Non-word runs; \\w is Unicode letters, digits and underscore.
NON_WORD = r"[^\p{L}\p{N}_]+"

#: Modulus of string hashes.
HASH_RANGE = 100_000_000


def tokens(text: Column) -> Column:
    """Lower-cased words, split at non-word runs; a separator at an end leaves an empty token there."""
    return F.split(F.lower(text), NON_WORD)


def string_hash(text: Column) -> Column:
    """A hash in [0, HASH_RANGE) that is the same in every process: the first 32 bits of MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % HASH_RANGE


def first_char(text: Column) -> Column:
    return F.substring(text, 1, 1)


def joined_key(*columns: Column) -> Column:
    """Items joined by commas."""
    return F.concat_ws(",", *columns)


def antecedent(key: Column) -> Column:
    """Of a comma-joined key, all but the last item."""
    return F.regexp_replace(key, ",[^,]*$", "")


def consequent(key: Column) -> Column:
    """Of a comma-joined key, the last item."""
    return F.substring_index(key, ",", -1)


def set_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def bit_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two 0/1 vectors of equal length; 0 for two zero vectors."""
    total = lambda v: F.aggregate(v, F.lit(0), lambda s, x: s + x)
    both = total(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), 1).otherwise(0)))
    either = total(F.zip_with(a, b, lambda x, y: F.when((x > 0) | (y > 0), 1).otherwise(0)))
    return F.when(either > 0, both / either).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def mahalanobis(point: Column, centre: Column, deviation: Column) -> Column:
    """Distance in standard deviations of each dimension; a dimension without deviation counts as is."""
    scaled = F.zip_with(F.zip_with(point, centre, lambda x, y: x - y), deviation, lambda d, s: F.when(s > 0, d / s).otherwise(d))
    return F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda t, x: t + x * x))


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """Standard deviation of each dimension from count, sums and sums of squares."""
    return F.zip_with(total, squares, lambda s, q: F.sqrt(F.greatest(q / n - (s / n) * (s / n), F.lit(0.0))))


def masked(values: Column, drop: list[int]) -> Column:
    """An array without the places in drop."""
    return F.filter(values, lambda x, i: ~i.isin(drop)) if drop else values


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounding in which a half goes to the even neighbour."""
    return F.bround(x, digits)


def seconds_of_day(text: Column) -> Column:
    """Seconds since midnight of HH:MM:SS; null for anything else."""
    part = lambda k: F.split_part(text, F.lit(":"), F.lit(k)).try_cast("int")
    return F.when(text.rlike(r"^\d{2}:\d{2}:\d{2}$"), part(1) * 3600 + part(2) * 60 + part(3))
