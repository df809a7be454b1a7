"""Aggregates: name -> builder of a Column from the first argument, the others and DISTINCT."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions.scalar import INTEGRAL

NAMES = {"count", "sum", "avg", "min", "max", "collect", "percentilecont", "percentiledisc", "stdev", "stdevp"}


def _sum(c: Column, kind: T.DataType, distinct: bool) -> Column:
    zero = F.lit(0).cast("long") if isinstance(kind, (*INTEGRAL, T.NullType)) else F.lit(0.0)
    return F.coalesce(F.sum_distinct(c) if distinct else F.sum(c), zero)


def _collect(c: Column, distinct: bool) -> Column:
    return F.array_sort(F.collect_set(c)) if distinct else F.collect_list(c)


def build(name: str, c: Column, kind: T.DataType, rest: list[Column], distinct: bool) -> Column:
    """One aggregate over a compiled argument. Nulls are left out by all of them."""
    if name == "count":
        return F.count_distinct(c) if distinct else F.count(c)
    if name == "sum":
        return _sum(c, kind, distinct)
    if name == "collect":
        return _collect(c, distinct)
    if name in ("percentilecont", "percentiledisc"):
        p = rest[0] if rest else F.lit(0.5)
        exact = F.percentile(c.cast("double"), p)
        if name == "percentilecont":
            return exact
        # the least value that at least a share p of the values doesn't exceed
        ordered = F.array_sort(F.collect_list(c))
        return F.when(F.size(ordered) > 0, F.get(ordered, F.greatest(F.ceil(p * F.size(ordered)).cast("int") - 1, F.lit(0))))
    simple: dict[str, Callable[[Column], Column]] = {"avg": F.avg, "min": F.min, "max": F.max, "stdevp": F.stddev_pop, "stdev": F.stddev_samp}
    out = simple[name](c)
    if distinct and name == "avg":
        out = F.expr("null") if c is None else F.sum_distinct(c) / F.count_distinct(c)
    return F.when(F.count(c) == 1, F.lit(0.0)).otherwise(out) if name == "stdev" else out
