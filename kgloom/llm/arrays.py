"""Array algorithms in SQL functions: running totals, searches and interval unions whose cost does not grow with the square of the array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doublings of a running total: arrays hold fewer than 2^30 elements.
_STEPS = [1 << k for k in range(30)]
_DOUBLING = f"array({', '.join(map(str, _STEPS))})"
SPANS = "array<struct<s:int,e:int>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The combination of each element (an int) with all before it. Strides double, so n elements cost n log n; 0 must be neutral."""

    def doubled(v: Column) -> Column:
        strides = F.filter(F.expr(_DOUBLING), lambda s: s < F.size(v))
        shifted = lambda acc, s: F.slice(F.concat(F.array_repeat(F.lit(0), s), acc), F.lit(1), F.size(acc))
        return F.aggregate(strides, v, lambda acc, s: F.zip_with(acc, shifted(acc, s), combine))

    return let(values, doubled)


def reached(ordered: Column, value: Column, most: int = _STEPS[-1]) -> Column:
    """How many elements of an ascending array (of at most ``most``) are at most ``value``: a binary search."""
    halving = f"array({', '.join(str(s) for s in reversed(_STEPS) if s <= most)})"
    inside = lambda at, h: (at + h <= F.size(ordered)) & (F.get(ordered, at + h - 1) <= value)
    return F.aggregate(F.expr(halving), F.lit(0), lambda at, h: F.when(inside(at, h), at + h).otherwise(at))


def union(spans: Column) -> Column:
    """Spans (s, e) that touch or overlap merged, in order."""

    def merged(ordered: Column) -> Column:
        return let(running(F.transform(ordered, lambda x: x["e"]), lambda a, b: F.greatest(a, b)), lambda ends: joined(ordered, ends))

    def joined(ordered: Column, ends: Column) -> Column:
        # a union begins where all before have ended, and ends where the next one begins
        begins = F.filter(ordered, lambda x, i: (i == 0) | (F.get(ends, i - 1) < x["s"]))
        stops = F.filter(ends, lambda e, i: (i == F.size(ends) - 1) | (e < F.get(ordered, i + 1)["s"]))
        return F.zip_with(begins, stops, lambda x, e: F.struct(x["s"].alias("s"), e.alias("e")))

    return let(spans, lambda given: F.when(F.size(given) > 1, let(F.array_sort(given), merged)).otherwise(given))


def without(span: Column, cuts: Column) -> Column:
    """What is left of a span when the cuts, merged and in order, that overlap it are taken out."""

    def gaps(given: Column) -> Column:
        starts = F.concat(F.array(span["s"]), F.transform(given, lambda c: c["e"]))
        ends = F.concat(F.transform(given, lambda c: c["s"]), F.array(span["e"]))
        return F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["s"] < x["e"])

    return let(cuts, gaps)


def overlapping(span: Column, ordered: Column, starts: Column, ends: Column) -> Column:
    """The disjoint spans of ``ordered`` (``starts`` and ``ends`` are its own) that share a place with ``span``, by two searches."""
    first, last = reached(ends, span["s"]), reached(starts, span["e"] - 1)
    return F.slice(ordered, first + 1, F.greatest(last - first, F.lit(0)))
