"""Vector arithmetic on array columns, as Catalyst expressions in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-12


def doubles(v: str | Column) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    return v.cast("array<double>")


def _zipped(a, b, fn) -> Column:
    return F.zip_with(doubles(a), doubles(b), fn)


def dot(a, b) -> Column:
    return F.aggregate(_zipped(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v) -> Column:
    """v over its length; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(EPSILON))
    return F.transform(doubles(v), lambda x: x / n)


def empty(size: int) -> Column:
    return F.array_repeat(F.lit(0.0), size)


def merge(a, b) -> Column:
    return _zipped(a, b, lambda x, y: x + y)


def subtract(a, b) -> Column:
    return _zipped(a, b, lambda x, y: x - y)


def diff(a, b) -> Column:
    """What a has over b, nowhere below zero."""
    return _zipped(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))


def intersect(a, b) -> Column:
    """The smaller magnitude where signs agree, else zero."""
    return _zipped(a, b, lambda x, y: F.when(F.signum(x) == F.signum(y), F.signum(x) * F.least(F.abs(x), F.abs(y))).otherwise(0.0))


def leading(v, k: int) -> Column:
    """The first k dimensions, normalised anew (nested representations)."""
    return l2_normalize(F.slice(doubles(v), 1, k))


def project(v, rows: list[list[float]]) -> Column:
    """W v, normalised; W's rows are literals, so W should be small. For large ones use simjoin.project_band."""
    w = F.array(*(F.array(*map(F.lit, map(float, r))) for r in rows))
    return l2_normalize(F.transform(w, lambda r: dot(r, v)))
