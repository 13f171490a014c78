"""Scalar functions of the query language as Column builders.

A function with a null argument is null, but for coalesce; Spark's own functions
do that already, so only those that would not are wrapped.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions import values as V
from weftgraph.functions.values import BOOL, DOUBLE, LONG, STRING, Val


@dataclass
class Function:
    name: str
    build: Callable[..., Val]
    signature: str
    description: str
    low: int
    high: int


REGISTRY: dict[str, Function] = {}


def register(name: str, signature: str, description: str, low: int, high: int | None = None):
    def add(build):
        REGISTRY[name.lower()] = Function(name, build, signature, description, low, low if high is None else high)
        return build

    return add


class FunctionProblem(ValueError):
    """No such function, or wrong arguments."""


def call(name: str, args: list[Val]) -> Val:
    f = REGISTRY.get(name.lower())
    if f is None:
        raise FunctionProblem(f"unknown function {name}")
    if not f.low <= len(args) <= f.high:
        raise FunctionProblem(f"{name} takes {f.low} to {f.high} arguments, not {len(args)}")
    if f.name != "coalesce" and any(V.is_null(a.type) for a in args):
        return V.null()
    return f.build(*args)


def _guard(args: list[Val], out: Column) -> Column:
    """out, or null where an argument is."""
    ok = F.lit(True)
    for a in args:
        ok = ok & a.col.isNotNull()
    return F.when(ok, out)


def _plain(name: str, f: Callable, t: T.DataType, signature: str, description: str, low: int = 1, high: int | None = None):
    register(name, signature, description, low, high)(lambda *a: Val(f(*(x.col for x in a)), t))


_double = lambda c: c.cast("double")
for _n, _f, _d in [
    ("acos", F.acos, "arcosine of a number"), ("asin", F.asin, "arcsine of a number"), ("atan", F.atan, "arctangent of a number"),
    ("cos", F.cos, "cosine of radians"), ("cot", F.cot, "cotangent of radians"), ("degrees", F.degrees, "radians to degrees"),
    ("exp", F.exp, "e raised to a number"), ("log", F.ln, "natural logarithm"), ("log10", F.log10, "common logarithm"),
    ("radians", F.radians, "degrees to radians"), ("sin", F.sin, "sine of radians"), ("tan", F.tan, "tangent of radians"), ("sqrt", F.sqrt, "square root"),
]:
    _plain(_n, lambda c, f=_f: f(_double(c)), DOUBLE, "(NUMBER?) :: FLOAT?", _d)
_plain("ceil", lambda c: F.ceil(_double(c)).cast("double"), DOUBLE, "(NUMBER?) :: FLOAT?", "smallest whole number not below the input")
_plain("floor", lambda c: F.floor(_double(c)).cast("double"), DOUBLE, "(NUMBER?) :: FLOAT?", "largest whole number not above the input")
_plain("atan2", lambda a, b: F.atan2(_double(a), _double(b)), DOUBLE, "(NUMBER?, NUMBER?) :: FLOAT?", "arctangent of a quotient", 2)
_plain("haversin", lambda c: (1 - F.cos(_double(c))) / 2, DOUBLE, "(NUMBER?) :: FLOAT?", "half the versine")
_plain("e", lambda: F.lit(math.e), DOUBLE, "() :: FLOAT?", "the constant e", 0)
_plain("pi", lambda: F.lit(math.pi), DOUBLE, "() :: FLOAT?", "the constant pi", 0)
_plain("rand", F.rand, DOUBLE, "() :: FLOAT?", "random number from 0 up to 1", 0)
_plain("sign", lambda c: F.signum(_double(c)).cast("long"), LONG, "(NUMBER?) :: INTEGER?", "sign of a number")
_plain("timestamp", lambda: F.unix_millis(F.current_timestamp()), LONG, "() :: INTEGER?", "milliseconds since 1970", 0)
_plain("toLower", F.lower, STRING, "(STRING?) :: STRING?", "lower case")
_plain("toUpper", F.upper, STRING, "(STRING?) :: STRING?", "upper case")
_plain("trim", lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), STRING, "(STRING?) :: STRING?", "without surrounding white space")
_plain("lTrim", lambda c: F.regexp_replace(c, r"^\s+", ""), STRING, "(STRING?) :: STRING?", "without leading white space")
_plain("rTrim", lambda c: F.regexp_replace(c, r"\s+$", ""), STRING, "(STRING?) :: STRING?", "without trailing white space")
_plain("left", lambda s, n: F.substring(s, F.lit(1), n.cast("int")), STRING, "(STRING?, INTEGER?) :: STRING?", "first characters", 2)
_plain("right", lambda s, n: F.right(s, n.cast("int")), STRING, "(STRING?, INTEGER?) :: STRING?", "last characters", 2)
_plain("replace", lambda s, a, b: F.replace(s, a, b), STRING, "(STRING?, STRING?, STRING?) :: STRING?", "every occurrence replaced", 3)
_plain("bytes", F.unhex, T.BinaryType(), "(STRING?) :: BYTES?", "bytes of a hexadecimal text")
_plain("text.utf8Decode", lambda c: F.decode(c, "UTF-8"), STRING, "(BYTES) :: STRING", "text of UTF-8 bytes")
_plain("text.utf8Encode", lambda c: F.encode(c, "UTF-8"), T.BinaryType(), "(STRING) :: BYTES", "UTF-8 bytes of a text")
_plain("text.regexReplaceAll", lambda s, p, r: F.regexp_replace(s, p, r), STRING, "(STRING, STRING, STRING) :: STRING", "every match replaced", 3)
_plain("getHost", lambda c: F.lit(None).cast("long"), LONG, "(ANY) :: INTEGER", "host of an id; ids have none here")


@register("abs", "(NUMBER?) :: NUMBER?", "absolute value", 1)
def _abs(a: Val) -> Val:
    return Val(F.abs(a.col), a.type)


@register("coalesce", "(ANY?, ..) :: ANY?", "the first value that is not null", 1, 99)
def _coalesce(*a: Val) -> Val:
    a = tuple(x for x in a if not V.is_null(x.type))
    if not a:
        return V.null()
    t = V.common([x.type for x in a])
    if t is None:
        t = T.VariantType()
    return Val(F.coalesce(*[V.cast(x, t) for x in a]), t)


@register("head", "(LIST) :: ANY?", "first element", 1)
def _head(a: Val) -> Val:
    return Val(F.try_element_at(a.col, F.lit(1)), a.type.elementType)


@register("last", "(LIST) :: ANY?", "last element", 1)
def _last(a: Val) -> Val:
    return Val(F.try_element_at(a.col, F.lit(-1)), a.type.elementType)


@register("tail", "(LIST) :: LIST", "all but the first element", 1)
def _tail(a: Val) -> Val:
    return Val(F.slice(a.col, F.lit(2), F.greatest(F.size(a.col), F.lit(0))), a.type)


@register("size", "(ANY?) :: INTEGER?", "elements of a list or characters of a text", 1)
def _size(a: Val) -> Val:
    c = F.length(a.col) if isinstance(a.type, T.StringType) else F.when(a.col.isNotNull(), F.size(a.col))
    return Val(c.cast("long"), LONG)


@register("reverse", "(ANY?) :: ANY?", "text or list in reverse", 1)
def _reverse(a: Val) -> Val:
    return Val(F.reverse(a.col), a.type)


@register("range", "(INTEGER, INTEGER, INTEGER?) :: LIST", "whole numbers from start to end, both included", 2, 3)
def _range(a: Val, b: Val, s: Val | None = None) -> Val:
    step = F.lit(1).cast("long") if s is None else s.col.cast("long")
    lo, hi = a.col.cast("long"), b.col.cast("long")
    away = ((step > 0) & (lo > hi)) | ((step < 0) & (lo < hi))
    return Val(F.when(away, F.array().cast("array<bigint>")).otherwise(F.sequence(F.when(~away, lo), hi, step)), T.ArrayType(LONG))


@register("round", "(NUMBER?, INTEGER?, STRING?) :: FLOAT?", "nearest number, with a precision and a mode", 1, 3)
def _round(a: Val, p: Val | None = None, m: Val | None = None) -> Val:
    x = a.col.cast("double")
    scale = F.lit(1.0) if p is None else F.pow(F.lit(10.0), p.col)
    y = x * scale
    up = F.signum(y) * F.floor(F.abs(y) + 0.5)
    if m is None:
        return Val((F.floor(y + 0.5) if p is None else up) / scale, DOUBLE)
    half = F.abs(y) - F.floor(F.abs(y)) == 0.5
    modes = {
        "UP": F.signum(y) * F.ceil(F.abs(y)), "DOWN": F.signum(y) * F.floor(F.abs(y)), "CEILING": F.ceil(y), "FLOOR": F.floor(y),
        "HALF_UP": up, "HALF_DOWN": F.when(half, F.signum(y) * F.floor(F.abs(y))).otherwise(up), "HALF_EVEN": F.rint(y),
    }
    out = F.lit(None).cast("double")
    for k, v in modes.items():
        out = F.when(F.upper(m.col) == k, v.cast("double")).otherwise(out)
    return Val(out / scale, DOUBLE)


@register("split", "(STRING?, STRING?) :: LIST", "parts between a delimiter", 2)
def _split(s: Val, d: Val) -> Val:
    return Val(_no_tail(F.split(s.col, F.concat(F.lit("\\Q"), d.col, F.lit("\\E")))), T.ArrayType(STRING))


def _no_tail(parts: Column) -> Column:
    """Without empty parts at the end, unless there is one part alone."""
    last = F.array_max(F.transform(parts, lambda p, i: F.when(p != "", i + 1).otherwise(0)))
    return F.when(F.size(parts) == 1, parts).otherwise(F.slice(parts, F.lit(1), last))


@register("substring", "(STRING?, INTEGER?, INTEGER?) :: STRING?", "from a start counted from 0, with a length", 2, 3)
def _substring(s: Val, a: Val, n: Val | None = None) -> Val:
    return Val(F.substring(s.col, (a.col + 1).cast("int"), F.lit(2**31 - 1) if n is None else n.col.cast("int")), STRING)


@register("toBoolean", "(STRING?) :: BOOLEAN?", "text to truth value; other texts fail", 1)
def _to_boolean(a: Val) -> Val:
    if isinstance(a.type, T.BooleanType):
        return a
    low = F.lower(F.trim(a.col))
    return Val(F.when(low == "true", True).when(low == "false", False).when(a.col.isNotNull(), F.raise_error(F.lit("no truth value")).cast("boolean")), BOOL)


@register("toFloat", "(ANY?) :: FLOAT?", "text or number to a float", 1)
def _to_float(a: Val) -> Val:
    return Val(a.col.try_cast("double") if isinstance(a.type, T.StringType) else a.col.cast("double"), DOUBLE)


@register("toInteger", "(ANY?) :: INTEGER?", "text or number to a whole number", 1)
def _to_integer(a: Val) -> Val:
    if isinstance(a.type, T.StringType):
        hexed = F.conv(F.regexp_replace(a.col, "(?i)^0x", ""), 16, 10).try_cast("long")
        n = F.coalesce(a.col.try_cast("long"), a.col.try_cast("decimal(38,10)").try_cast("long"))
        return Val(F.when(a.col.rlike("(?i)^0x[0-9a-f]+$"), hexed).otherwise(n), LONG)
    return Val(a.col.cast("long"), LONG)


@register("toString", "(ANY?) :: STRING?", "a value as text", 1)
def _to_string(a: Val) -> Val:
    c = F.to_json(a.col) if isinstance(a.type, (T.ArrayType, T.MapType, T.StructType)) else a.col.cast("string")
    return Val(c, STRING)


# Nodes, relationships and paths
@register("id", "(NODE?) :: ANY?", "id of a node", 1)
def _id(a: Val) -> Val:
    return Val(a.col["id"] if V.is_node(a.type) else a.col, STRING)


@register("strId", "(ANY) :: STRING", "an id as text", 1)
def _str_id(a: Val) -> Val:
    return Val(_id(a).col.cast("string"), STRING)


register("parseId", "(STRING) :: ANY", "an id from its text", 1)(_str_id)


@register("labels", "(NODE?) :: LIST", "labels of a node", 1)
def _labels(a: Val) -> Val:
    return Val(a.col["labels"] if V.is_node(a.type) else F.array(a.col["type"]), T.ArrayType(STRING))


@register("type", "(RELATIONSHIP?) :: STRING?", "name of a relationship", 1)
def _type(a: Val) -> Val:
    return Val(a.col["type"], STRING)


@register("keys", "(ANY?) :: LIST", "keys of a map, node or relationship", 1)
def _keys(a: Val) -> Val:
    if isinstance(a.type, T.MapType):
        return Val(F.array_sort(F.map_keys(a.col)), T.ArrayType(STRING))
    if a.type == V.REL:
        return Val(F.array().cast("array<string>"), T.ArrayType(STRING))
    if V.is_node(a.type):
        s, t = a.col["properties"], a.type["properties"].dataType
        return Val(F.filter(F.array(*[F.when(s[k].isNotNull(), F.lit(k)) for k in sorted(t.names)]), lambda k: k.isNotNull()), T.ArrayType(STRING))
    return Val(F.when(a.col.isNotNull(), F.array(*[F.lit(k) for k in sorted(a.type.names)])), T.ArrayType(STRING))


@register("properties", "(ANY?) :: MAP?", "properties of a map, node or relationship", 1)
def _properties(a: Val) -> Val:
    if V.is_node(a.type):
        return Val(a.col["properties"], a.type["properties"].dataType)
    return V.struct([]) if a.type == V.REL else a


@register("nodes", "(PATH?) :: LIST", "nodes of a path", 1)
def _nodes(a: Val) -> Val:
    return Val(a.col["nodes"], T.ArrayType(STRING))


@register("relationships", "(PATH?) :: LIST", "relationships of a path", 1)
def _relationships(a: Val) -> Val:
    return Val(a.col["relationships"], T.ArrayType(V.REL))


@register("length", "(PATH?) :: INTEGER?", "relationships in a path", 1)
def _length(a: Val) -> Val:
    if isinstance(a.type, T.StringType):
        return Val(F.length(a.col).cast("long"), LONG)
    c = a.col["relationships"] if a.type == V.PATH else a.col
    return Val(F.when(c.isNotNull(), F.size(c)).cast("long"), LONG)


# Hashes and ids
@register("hash", "(ANY, ..) :: INTEGER", "a hash of the arguments", 0, 15)
def _hash(*a: Val) -> Val:
    return Val(F.xxhash64(*[x.col for x in a]) if a else F.lit(42).cast("long"), LONG)


@register("idFrom", "(ANY, ..) :: ID", "the id that these values always give", 1, 16)
def _id_from(*a: Val) -> Val:
    return Val(_guard(list(a), F.sha2(F.to_json(F.struct(*[F.struct(F.lit(x.type.simpleString() if not V.is_int(x.type) else "bigint").alias("t"), x.col.alias("v")).alias(f"c{i}") for i, x in enumerate(a)])), 256)), STRING)


@register("locIdFrom", "(INTEGER, ANY, ..) :: ID", "an id within a part of the graph", 2, 16)
def _loc_id_from(at: Val, *a: Val) -> Val:
    return Val(F.concat(at.col.cast("string"), F.lit("/"), _id_from(*a).col), STRING)


def murmur2(data: bytes) -> int:
    """32-bit MurmurHash2 with the seed that log partitioners use, its sign bit cleared."""
    m, mask = 0x5BD1E995, 0xFFFFFFFF
    h = 0x9747B28C ^ len(data)
    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * m & mask
        k = (k ^ (k >> 24)) * m & mask
        h = (h * m & mask) ^ k
    if len(data) > whole:
        h = (h ^ int.from_bytes(data[whole:], "little")) * m & mask
    h = (h ^ (h >> 13)) * m & mask
    return (h ^ (h >> 15)) & 0x7FFFFFFF


@register("kafkaHash", "(STRING or BYTES) :: INTEGER", "the partitioner's hash of a key", 1)
def _kafka_hash(a: Val) -> Val:
    @F.pandas_udf("long")
    def hashed(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else murmur2(bytes(b))).astype("Int64")

    return Val(hashed(a.col.cast("binary")), LONG)


# Text, JSON, maps, lists
@register("convert.stringToBytes", "(STRING, STRING) :: BYTES", "bytes of a text in a character set", 2)
def _to_bytes(s: Val, cs: Val) -> Val:
    return Val(F.call_function("encode", s.col, cs.col), T.BinaryType())


@register("toJson", "(ANY) :: STRING", "a value as JSON", 1)
def _to_json(a: Val) -> Val:
    if isinstance(a.type, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return Val(F.to_json(a.col), STRING)
    return Val(F.to_json(a.col.cast(T.VariantType())), STRING)


@register("parseJson", "(STRING) :: ANY", "the value of a JSON text", 1)
def _parse_json(a: Val) -> Val:
    return Val(F.parse_json(a.col), T.VariantType())


def _as_map(a: Val) -> Val:
    """A map of texts or of one type from a struct."""
    if isinstance(a.type, T.MapType):
        return a
    if V.is_node(a.type):
        a = _properties(a)
    t = V.common([f.dataType for f in a.type.fields]) or STRING
    pairs = [x for f in a.type.fields for x in (F.lit(f.name), a.col[f.name].cast(t))]
    return Val(F.create_map(*pairs), T.MapType(STRING, t))


@register("map.fromPairs", "(LIST) :: MAP", "map from a list of pairs", 1)
def _from_pairs(a: Val) -> Val:
    e = a.type.elementType
    if V.is_null(e):
        return V.struct([])
    if isinstance(e, T.StructType):
        n = e.names
        return Val(F.map_from_arrays(F.transform(a.col, lambda p: p[n[0]]), F.transform(a.col, lambda p: p[n[1]])), T.MapType(STRING, e.fields[1].dataType))
    t = e.elementType
    if isinstance(t, T.VariantType):
        return Val(F.map_from_arrays(F.transform(a.col, lambda p: F.variant_get(p[0], "$", "string")), F.transform(a.col, lambda p: p[1])), T.MapType(STRING, t))
    return Val(F.map_from_arrays(F.transform(a.col, lambda p: p[0]), F.transform(a.col, lambda p: p[1])), T.MapType(STRING, t))


@register("map.sortedProperties", "(MAP) :: LIST", "pairs of a map by key", 1)
def _sorted_properties(a: Val) -> Val:
    m = _as_map(a)
    return Val(F.array_sort(F.map_entries(m.col)), T.ArrayType(T.StructType([T.StructField("key", STRING), T.StructField("value", m.type.valueType)])))


@register("map.removeKey", "(MAP, STRING) :: MAP", "a map without a key", 2)
def _remove_key(a: Val, k: Val) -> Val:
    m = _as_map(a)
    return Val(F.map_filter(m.col, lambda x, _: x != k.col), m.type)


@register("map.merge", "(MAP, MAP) :: MAP", "both maps, the second before the first", 2)
def _merge(a: Val, b: Val) -> Val:
    m, n = _as_map(a), _as_map(b)
    t = V.common([m.type.valueType, n.type.valueType]) or STRING
    cast = lambda v: v.col.cast(T.MapType(STRING, t))
    x, y = cast(m), cast(n)
    return Val(F.map_concat(F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k)), y), T.MapType(STRING, t))


@register("map.dropNullValues", "(MAP) :: MAP", "a map without null values", 1)
def _drop_nulls(a: Val) -> Val:
    m = _as_map(a)
    return Val(F.map_filter(m.col, lambda _, v: v.isNotNull()), m.type)


@register("text.split", "(STRING, STRING, INTEGER?) :: LIST", "parts between matches of a pattern", 2, 3)
def _text_split(s: Val, p: Val, n: Val | None = None) -> Val:
    return Val(_no_tail(F.split(s.col, p.col)) if n is None else F.split(s.col, p.col, n.col.cast("int")), T.ArrayType(STRING))


@register("text.regexFirstMatch", "(STRING, STRING) :: LIST", "groups of the first match", 2)
def _first_match(s: Val, p: Val) -> Val:
    found = F.regexp_extract_all(s.col, F.concat(F.lit("("), p.col, F.lit(")")), F.lit(1))
    groups = F.transform(F.sequence(F.lit(0), F.regexp_count(F.regexp_replace(p.col, r"\\.", ""), F.lit(r"\((?!\?)"))), lambda i: F.call_function("regexp_extract", s.col, p.col, i))
    return Val(F.when(F.size(found) > 0, groups).otherwise(F.array().cast("array<string>")), T.ArrayType(STRING))


@register("text.regexGroups", "(STRING, STRING) :: LIST", "groups of every match", 2)
def _all_matches(s: Val, p: Val) -> Val:
    found = F.regexp_extract_all(s.col, F.concat(F.lit("("), p.col, F.lit(")")), F.lit(1))
    n = F.regexp_count(F.regexp_replace(p.col, r"\\.", ""), F.lit(r"\((?!\?)"))
    return Val(F.transform(found, lambda m: F.transform(F.sequence(F.lit(0), n), lambda i: F.call_function("regexp_extract", m, p.col, i))), T.ArrayType(T.ArrayType(STRING)))


@register("text.urlencode", "(STRING, BOOLEAN?, STRING?) :: STRING", "a text as part of an address", 1, 3)
def _urlencode(s: Val, plus: Val | None = None, extra: Val | None = None) -> Val:
    c = F.replace(F.replace(F.url_encode(s.col), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    spaced = F.replace(c, F.lit("+"), F.lit("%20"))
    return Val(spaced if plus is None else F.when(plus.col, c).otherwise(spaced), STRING)


@register("text.urldecode", "(STRING, BOOLEAN?) :: STRING", "a text from part of an address; null if malformed", 1, 2)
def _urldecode(s: Val, plus: Val | None = None) -> Val:
    kept = F.try_url_decode(F.replace(s.col, F.lit("+"), F.lit("%2B")))
    return Val(F.try_url_decode(s.col) if plus is None else F.when(plus.col, F.try_url_decode(s.col)).otherwise(kept), STRING)


def _order_of(c: Column) -> Column:
    """Rank and value of a variant in the total order: texts, truth values, numbers."""
    truth = F.try_variant_get(c, "$", "boolean")
    kind = F.schema_of_variant(c)
    rank = F.when(kind == "STRING", 0).when(kind == "BOOLEAN", 1).otherwise(2)
    number = F.when(kind == "BOOLEAN", truth.cast("int").cast("double")).when(kind != "STRING", F.try_variant_get(c, "$", "double"))
    return F.struct(rank.alias("rank"), number.alias("number"), F.when(kind == "STRING", F.try_variant_get(c, "$", "string")).alias("text"))


def _extreme(name: str, pick_list: Callable, pick: Callable, null_wins: bool):
    @register(name, "(LIST or ANY, ..) :: ANY", "extreme value by the total order", 1, 15)
    def build(*a: Val) -> Val:
        if len(a) == 1 and isinstance(a[0].type, T.ArrayType):
            if isinstance(a[0].type.elementType, T.VariantType):
                best = pick_list(F.transform(a[0].col, _order_of))
                value = F.when(best["rank"] == 2, best["number"].cast(T.VariantType())).when(best["rank"] == 1, (best["number"] == 1).cast(T.VariantType())).otherwise(best["text"].cast(T.VariantType()))
                return Val(F.when(best.isNotNull(), value), T.VariantType())
            c = pick_list(a[0].col)
            return Val(F.when(F.exists(a[0].col, lambda x: x.isNull()), F.lit(None)).otherwise(c) if null_wins else c, a[0].type.elementType)
        t = V.common([x.type for x in a]) or STRING
        cols = [V.cast(x, t) for x in a]
        return Val(_guard(list(a), cols[0] if len(cols) == 1 else pick(*cols)), t)


_extreme("coll.max", F.array_max, F.greatest, True)
_extreme("coll.min", F.array_min, F.least, False)

_NAMES = [(T.BooleanType, "BOOLEAN"), (T.StringType, "STRING"), (T.BinaryType, "BYTES"), (T.ArrayType, "LIST"), (T.MapType, "MAP"), (T.TimestampNTZType, "LOCALDATETIME"), (T.TimestampType, "DATETIME"), (T.DateType, "DATE"), (T.DayTimeIntervalType, "DURATION"), (T.NullType, "NULL")]


def type_name(t: T.DataType) -> str:
    if V.is_int(t):
        return "INTEGER"
    if V.is_num(t):
        return "FLOAT"
    if V.is_node(t):
        return "NODE"
    if isinstance(t, T.StructType):
        return "RELATIONSHIP" if t == V.REL else "PATH" if t == V.PATH else "MAP"
    return next((n for k, n in _NAMES if isinstance(t, k)), "ANY")


_VARIANT = {"integer": "bigint", "float": "double", "boolean": "boolean", "string": "string"}


@register("meta.type", "(ANY) :: STRING", "name of a value's type", 1)
def _meta_type(a: Val) -> Val:
    if isinstance(a.type, T.VariantType):
        k = F.schema_of_variant(a.col)
        return Val(F.when(k.isin("BIGINT", "INT"), "INTEGER").when(k.rlike("DECIMAL|DOUBLE|FLOAT"), "FLOAT").when(k.startswith("ARRAY"), "LIST").when(k.startswith("OBJECT"), "MAP").when(k == "VOID", "NULL").otherwise(k), STRING)
    return Val(F.lit(type_name(a.type)), STRING)


def _castable(kind: str):
    def value(a: Val, strict: bool) -> Val:
        if isinstance(a.type, T.VariantType):
            if kind in _VARIANT:
                t = {"integer": LONG, "float": DOUBLE, "boolean": BOOL, "string": STRING}[kind]
                out = F.when(_meta_type(a).col == kind.upper(), F.try_variant_get(a.col, "$", _VARIANT[kind]))
            else:
                t, out = a.type, F.when(_meta_type(a).col == kind.upper(), a.col)
        elif type_name(a.type) == kind.upper():
            return a
        else:
            t, out = STRING, F.lit(None).cast("string")
        if strict:
            out = F.when(out.isNull() & a.col.isNotNull(), F.raise_error(F.lit(f"no {kind}")).cast(t)).otherwise(out)
        return Val(out, t)

    register(f"castOrNull.{kind}", f"(ANY) :: {kind.upper()}", f"the value if it is a {kind}, else null", 1)(lambda a: value(a, False))
    register(f"castOrThrow.{kind}", f"(ANY) :: {kind.upper()}", f"the value if it is a {kind}, else an error", 1)(lambda a: value(a, True))


for _k in ("integer", "float", "boolean", "string", "map", "bytes", "node", "relationship", "path", "localdatetime", "datetime", "duration", "list"):
    _castable(_k)


def _generated(kind: str, t: T.DataType, f: Callable[[Column, Column], Column]):
    @register(f"gen.{kind}.from", "(ANY, INTEGER?) :: ANY", f"a {kind} that the input always gives", 1, 2)
    def build(a: Val, n: Val | None = None) -> Val:
        return Val(f(F.xxhash64(a.col), F.lit(8) if n is None else n.col.cast("int")), t)


_generated("string", STRING, lambda h, n: F.substring(F.repeat(F.sha2(h.cast("string"), 256), F.lit(64)), F.lit(1), n))
_generated("integer", LONG, lambda h, n: h)
_generated("float", DOUBLE, lambda h, n: F.pmod(h, F.lit(2**53)) / 2.0**53)
_generated("boolean", BOOL, lambda h, n: F.pmod(h, F.lit(2)) == 1)
_generated("bytes", T.BinaryType(), lambda h, n: F.unhex(F.substring(F.repeat(F.sha2(h.cast("string"), 256), F.lit(64)), F.lit(1), 2 * n)))
_generated("node", STRING, lambda h, n: F.sha2(h.cast("string"), 256))
