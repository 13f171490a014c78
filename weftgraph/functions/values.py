"""Typed values of query expressions: a Column and its Spark type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()
REL = T.StructType([T.StructField("start", STRING), T.StructField("type", STRING), T.StructField("end", STRING)])
PATH = T.StructType([T.StructField("nodes", T.ArrayType(STRING)), T.StructField("relationships", T.ArrayType(REL))])


@dataclass
class Val:
    col: Column
    type: T.DataType


def is_int(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_num(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_null(t: T.DataType) -> bool:
    return isinstance(t, T.NullType)


def is_node(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.names[:3] == ["id", "labels", "properties"]


def null() -> Val:
    return Val(F.lit(None), T.NullType())


def lit(v) -> Val:
    if v is None:
        return null()
    if isinstance(v, bool):
        return Val(F.lit(v), BOOL)
    if isinstance(v, int):
        return Val(F.lit(v).cast("long"), LONG)
    if isinstance(v, float):
        return Val(F.lit(v), DOUBLE)
    if isinstance(v, str):
        return Val(F.lit(v), STRING)
    if isinstance(v, (list, tuple)):
        return array([lit(x) for x in v])
    if isinstance(v, dict):
        return struct([(k, lit(x)) for k, x in v.items()])
    if isinstance(v, bytes):
        return Val(F.lit(v), T.BinaryType())
    import datetime as dt

    if isinstance(v, dt.datetime):
        return Val(F.lit(v), T.TimestampType())
    if isinstance(v, dt.date):
        return Val(F.lit(v), T.DateType())
    raise TypeError(f"no literal for {type(v).__name__}")


def common(types: list[T.DataType]) -> T.DataType | None:
    """One type for all, null for none; None where they have none in common."""
    out: T.DataType = T.NullType()
    for t in types:
        if is_null(t) or t == out:
            continue
        if is_null(out):
            out = t
        elif isinstance(out, T.VariantType) or isinstance(t, T.VariantType):
            out = T.VariantType()
        elif is_num(out) and is_num(t):
            out = LONG if is_int(out) and is_int(t) else DOUBLE
        elif isinstance(out, T.ArrayType) and isinstance(t, T.ArrayType):
            e = common([out.elementType, t.elementType])
            if e is None:
                return None
            out = T.ArrayType(e)
        else:
            return None
    return out


def cast(v: Val, t: T.DataType) -> Column:
    return v.col if v.type == t else v.col.cast(t)


def array(vals: list[Val]) -> Val:
    """A list; of values without a common type, a list of variants."""
    t = common([v.type for v in vals])
    if t is None:
        return Val(F.array(*[v.col.cast(T.VariantType()) for v in vals]), T.ArrayType(T.VariantType()))
    if not vals:
        return Val(F.array().cast(T.ArrayType(T.NullType())), T.ArrayType(T.NullType()))
    return Val(F.array(*[cast(v, t) for v in vals]), T.ArrayType(t))


def struct(items: list[tuple[str, Val]]) -> Val:
    if not items:
        return Val(F.from_json(F.lit("{}"), T.MapType(STRING, STRING)), T.MapType(STRING, STRING))
    items = sorted(items, key=lambda x: x[0])
    return Val(F.struct(*[v.col.alias(k) for k, v in items]), T.StructType([T.StructField(k, v.type) for k, v in items]))


def variant_key(c: Column) -> Column:
    """A text that is equal for equal variants."""
    return F.to_json(c)


def has_variant(t: T.DataType) -> bool:
    return isinstance(t, T.VariantType) or isinstance(t, T.ArrayType) and has_variant(t.elementType)


def order_key(c: Column, t: T.DataType) -> Column:
    """One column that orders values, variants and lists of them by the total order: texts, booleans, numbers, others."""
    if isinstance(t, T.VariantType):
        kind = F.schema_of_variant(c)
        rank = F.when(kind == "STRING", 0).when(kind == "BOOLEAN", 1).when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), 2).otherwise(3)
        key = F.struct(rank.alias("rank"), F.when(rank == 2, F.try_variant_get(c, "$", "double")).alias("number"), F.coalesce(F.try_variant_get(c, "$", "string"), F.to_json(c)).alias("text"))
        return F.when(c.isNotNull() & (kind != "VOID"), key)
    if isinstance(t, T.ArrayType) and has_variant(t):
        return F.transform(c, lambda x: order_key(x, t.elementType))
    return F.to_json(c) if isinstance(t, T.MapType) else c


def sort_keys(v: Val, ascending: bool) -> list[Column]:
    """Order by the total order with nulls largest."""
    c = v.col
    if isinstance(v.type, T.VariantType):
        kind = F.schema_of_variant(c)
        rank = F.when(kind == "STRING", 0).when(kind == "BOOLEAN", 1).when(kind.rlike("INT|DECIMAL|DOUBLE|FLOAT"), 2).otherwise(3)
        parts = [F.when(c.isNotNull() & (kind != "VOID"), rank), F.try_variant_get(c, "$", "double"), F.try_variant_get(c, "$", "string")]
    elif isinstance(v.type, T.MapType):
        parts = [F.to_json(c)]
    else:
        parts = [c]
    return [p.asc_nulls_last() if ascending else p.desc_nulls_first() for p in parts]


def unite(a: Val, b: Val) -> tuple[Column, Column, T.DataType | None]:
    t = common([a.type, b.type])
    return (a.col, b.col, None) if t is None else (cast(a, t), cast(b, t), t)


def equals(a: Val, b: Val) -> Column:
    """Three-valued equality: values of different types differ, NaN differs from itself, nulls inside lists taint."""
    if is_null(a.type) or is_null(b.type):
        return F.lit(None).cast("boolean")
    x, y, t = unite(a, b)
    if t is None:
        if isinstance(a.type, T.VariantType) or isinstance(b.type, T.VariantType):
            return variant_key(a.col.cast(T.VariantType())) == variant_key(b.col.cast(T.VariantType()))
        temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
        if isinstance(a.type, temporal) and isinstance(b.type, temporal):
            return a.col == b.col
        return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))
    if isinstance(t, T.DoubleType):
        return (x == y) & ~F.isnan(x)
    if isinstance(t, T.VariantType):
        return variant_key(x) == variant_key(y)
    if isinstance(t, T.MapType):
        return F.array_sort(F.map_entries(x)) == F.array_sort(F.map_entries(y))
    if isinstance(t, T.ArrayType):
        e = t.elementType
        pairs = F.zip_with(x, y, lambda p, q: equals(Val(p, e), Val(q, e)))
        return F.when(x.isNull() | y.isNull(), F.lit(None)).when(F.size(x) != F.size(y), F.lit(False)).otherwise(F.forall(pairs, lambda p: p))
    if isinstance(t, T.StructType):
        out = F.lit(True)
        for f in t.fields:
            out = out & equals(Val(x[f.name], f.dataType), Val(y[f.name], f.dataType))
        return F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(out)
    return x == y
