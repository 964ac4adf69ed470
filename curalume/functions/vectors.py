"""Column functions over feature vectors, perceptual hashes, scores and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity, 0 for a zero vector; norms can be given where they are known."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length == 0, 0.0).otherwise(dot(a, b) / length)


def hamming(a: Column | str, b: Column | str) -> Column:
    """Differing bits of two 16-digit hex hashes; null if either is null or empty."""
    bits = lambda h: F.conv(F.nullif(_c(h), F.lit("")), 16, -10).cast("long")
    return F.bit_count(bits(a).bitwiseXOR(bits(b)))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def standardise(v: Column | str, mean: Column | str, std: Column | str) -> Column:
    """(v - mean) / std by element, with a std of 0 read as 1."""
    return F.zip_with(F.zip_with(_c(v), _c(mean), lambda x, m: x - m), _c(std), lambda x, s: x / F.when(s == 0, 1.0).otherwise(s))


def pct(part: Column | str, total: Column | str) -> Column:
    return F.round(100 * _c(part) / _c(total), 1)


def parse_day(day: Column | str) -> Column:
    """YYYY-MM-DD as the day's start; the session's time zone is UTC."""
    return F.to_timestamp(_c(day), "yyyy-MM-dd")


def abs_seconds(a: Column | str, b: Column | str) -> Column:
    return F.abs(F.unix_micros(_c(a)) - F.unix_micros(_c(b))) / 1e6


def hours_before(now: Column, hours: int) -> Column:
    return now - F.make_dt_interval(F.lit(0), F.lit(hours))


def fmt(ts: Column | str, pattern: str) -> Column:
    return F.date_format(_c(ts), pattern)
