"""Array and vector expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clip


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Zeros where the norm is not finite or at most 1e-9."""
    n = norm(a)
    return F.when((n > 1e-9) & (n < float("inf")), F.transform(a, lambda x: x / n)).otherwise(F.transform(a, lambda _: F.lit(0.0)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine mapped to [0, 1]; 0 for vectors that are missing, empty, zero or of different sizes."""
    na, nb = norm(a), norm(b)
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (na > 1e-9) & (nb > 1e-9)
    return F.coalesce(F.when(ok, clip((dot(a, b) / (na * nb) + 1.0) / 2.0)), F.lit(0.0))


def dtw_similarity(a: Column, b: Column, invalid: float = 0.0) -> Column:
    """exp(-2.4*cost/longest) of monotonic alignment; a row-by-row fold over the cost matrix.

    a, b: arrays of vectors. The state is the previous row of costs, whose first cell is the border.
    """
    far = F.lit(float("inf"))
    first = F.concat(F.array(F.lit(0.0)), F.transform(b, lambda _: far))

    def next_row(row: Column, x: Column) -> Column:
        def cell(s: Column, j: Column) -> Column:
            local = 1.0 - cosine_similarity(x, F.get(b, j))
            return F.concat(s, F.array(local + F.least(F.get(row, j + 1), F.get(s, j), F.get(row, j))))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(far), cell)

    cost = F.element_at(F.aggregate(a, first, next_row), -1)
    ok = (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.get(a, F.lit(0))) == F.size(F.get(b, F.lit(0))))
    return F.coalesce(F.when(ok, clip(F.exp(-2.4 * cost / F.greatest(F.size(a), F.size(b))))), F.lit(invalid))


def roll(a: Column, k: int) -> Column:
    """Circular shift to the right."""
    n = F.size(a)
    return F.concat(F.slice(a, n - k + 1, F.lit(k)), F.slice(a, F.lit(1), n - k))


def linspace(start: Column, stop: Column, n: Column) -> Column:
    """n equidistant values from start to stop, both included; start alone for n = 1."""
    step = (stop - start) / F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: start + i * step)


def nearest_at(position: Column, positions: Column) -> Column:
    """Place, from 1, of the nearest position, the first of equals; null without positions."""
    d = F.transform(positions, lambda p: F.abs(p - position))
    return F.nullif(F.array_position(d, F.array_min(d)).cast("int"), F.lit(0))


def around(a: Column, at: Column, radius: int) -> Column:
    """Slice of a within radius of its place `at`, from 1."""
    low = F.greatest(at - radius, F.lit(1))
    return F.slice(a, low, F.greatest(F.least(at + radius, F.size(a)) - low + 1, F.lit(0)))
