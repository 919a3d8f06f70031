"""Column expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements summed at once for running sums.
GROUP = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running_sums(lengths: Column) -> Column:
    """Sums up to each element, itself included, in steps of GROUP so that the work stays near-linear. lengths isn't empty."""
    groups = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / GROUP).cast("int"))
    sums = F.transform(groups, lambda g: total(F.slice(lengths, g * GROUP + 1, GROUP)))
    before = lambda s: F.transform(s, lambda _, g: total(F.slice(s, F.lit(1), g)))
    place = lambda i: F.floor(i / GROUP).cast("int")
    each = lambda b: F.transform(lengths, lambda _, i: F.get(b, place(i)) + total(F.slice(lengths, place(i) * GROUP + 1, i % GROUP + 1)))
    return let(sums, lambda s: let(before(s), each))
