"""Aggregates of the query language; all but collect combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import values as V
from weftgraph.functions.values import DOUBLE, LONG, Val

NAMES = {"count", "collect", "avg", "sum", "min", "max", "stdev", "stdevp", "percentilecont", "percentiledisc"}


def _sum(v: Val, distinct: bool) -> Val:
    """No rows: 0."""
    c = F.sum_distinct(v.col) if distinct else F.sum(v.col)
    if isinstance(v.type, T.DayTimeIntervalType):
        return Val(c, v.type)
    if isinstance(v.type, T.VariantType):
        v = Val(F.try_variant_get(v.col, "$", "double"), DOUBLE)
        c = F.sum(v.col)
    if V.is_null(v.type):
        return Val(F.lit(0).cast("long"), LONG)
    t = LONG if V.is_int(v.type) else DOUBLE
    return Val(F.coalesce(c, F.lit(0)).cast(t), t)


def _stdev(v: Val, distinct: bool, sample: bool) -> Val:
    """Of fewer than two rows (for a sample): 0.0."""
    x = v.col.cast("double")
    return Val(F.coalesce(F.when(F.count(x) > 1, F.stddev_samp(x)) if sample else F.stddev_pop(x), F.lit(0.0)), DOUBLE)


def aggregate(name: str, args: list[Val], distinct: bool, star: bool) -> Val:
    name = name.lower()
    if star:
        return Val(F.count(F.lit(1)), LONG)
    v = args[0]
    if name in ("min", "max") and (V.has_variant(v.type) or isinstance(v.type, T.MapType)):
        # The value itself, chosen by the total order over values of all types.
        return Val((F.min_by if name == "min" else F.max_by)(v.col, V.order_key(v.col, v.type)), v.type)
    if isinstance(v.type, T.VariantType) and distinct:
        v = Val(V.variant_key(v.col), V.STRING)
    if name == "count":
        c: Column = F.count_distinct(_key(v)) if distinct else F.count(v.col)
        return Val(c, LONG)
    if name == "collect":
        return Val(F.array_distinct(F.collect_list(v.col)) if distinct else F.collect_list(v.col), T.ArrayType(v.type))
    if name == "avg":
        t = v.type if isinstance(v.type, T.DayTimeIntervalType) else DOUBLE
        if isinstance(v.type, T.VariantType):
            v = Val(F.try_variant_get(v.col, "$", "double"), DOUBLE)
        if distinct:
            return Val(F.sum_distinct(v.col).cast("double") / F.count_distinct(v.col), t)
        return Val(F.avg(v.col), t)
    if name == "sum":
        return _sum(v, distinct)
    if name in ("min", "max"):
        return Val((F.min if name == "min" else F.max)(v.col), v.type)
    if name in ("stdev", "stdevp"):
        return _stdev(v, distinct, name == "stdev")
    # Percentiles are taken by rank, see operators.percentiles; Spark's own is left to say what is wrong with a fraction.
    return Val(F.call_function("percentile", v.col.cast("double"), args[1].col), DOUBLE)


def _key(v: Val) -> Column:
    return F.to_json(v.col) if isinstance(v.type, T.MapType) else v.col
