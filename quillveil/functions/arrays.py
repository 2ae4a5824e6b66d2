"""Running sums and maxima over arrays, in pieces, so that long arrays cost little more than one pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements a piece: an accumulating array is copied at every step, so it must stay short.
PIECE = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces(values: Column, size: int = PIECE) -> Column:
    """The array cut into arrays of ``size``; an empty one gives one empty piece."""
    last = F.greatest(F.floor((F.size(values) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * size + 1, size))


def scan(values: Column, step: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """step(step(zero, v0), v1) ... for every prefix, of an array of int. ``step`` must be associative."""

    def walk(part: Column) -> Column:
        return F.aggregate(part, F.array(F.lit(zero)), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def joined(parts: Column) -> Column:
        heads = walk(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.zip_with(parts, F.slice(heads, 1, F.size(parts)), lambda p, head: F.transform(F.slice(p, 2, PIECE), lambda x: step(head, x))))

    return let(values, lambda v: let(F.transform(pieces(v), walk), joined))


def running_sum(values: Column) -> Column:
    return scan(values, lambda a, b: a + b)


def running_max(values: Column) -> Column:
    return scan(values, lambda a, b: F.greatest(a, b))
