"""Temporal functions. Times of day are nanoseconds since midnight; an offset travels as a struct.

Dates compare by value and order like any other value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.scalar import _as_map, register
from weftgraph.functions.values import LONG, STRING, Val

ZONED, LOCAL, DATE, DURATION = T.TimestampType(), T.TimestampNTZType(), T.DateType(), T.DayTimeIntervalType()
OFFSET_TIME = T.StructType([T.StructField("nanos", LONG), T.StructField("offset_seconds", LONG)])


def _options(a: Val) -> dict[str, Column]:
    """Lower-case names of a map's entries; its keys have to be known."""
    if isinstance(a.type, T.StructType):
        return {f.name.lower(): a.col[f.name] for f in a.type.fields}
    m = _as_map(a)
    return {k: F.try_element_at(m.col, F.lit(k)) for k in ("year", "month", "day", "hour", "minute", "second", "millisecond", "timezone", "epochmillis", "epochseconds")}


def _parts(o: dict[str, Column], *names: str, first: int = 0) -> list[Column]:
    return [o.get(n, F.lit(1 if n in ("month", "day") else first)).cast("int") for n in names]


def _fraction(o: dict[str, Column]) -> Column:
    s = o.get("second", F.lit(0)).cast("decimal(16,6)")
    for name, per in (("millisecond", 1000), ("microsecond", 1000000), ("nanosecond", 1000000000)):
        if name in o:
            s = s + (o[name].cast("decimal(16,0)") / F.lit(per)).cast("decimal(16,6)")
    return s.cast("decimal(16,6)")


def _moment(name: str, t: T.DataType, now, from_parts, parse, parse_with):
    @register(name, "() or (MAP) or (STRING, STRING?)", f"a {name} of now, of parts, or of a text with a format", 0, 2)
    def build(a: Val | None = None, f: Val | None = None) -> Val:
        if a is None:
            return Val(now(), t)
        if isinstance(a.type, T.StringType):
            return Val(parse(a.col) if f is None else parse_with(a.col, f.col), t)
        if isinstance(a.type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return Val(a.col.cast(t), t)
        return Val(from_parts(_options(a)), t)


def _zoned(o: dict[str, Column]) -> Column:
    if "epochmillis" in o and "year" not in o:
        return F.timestamp_millis(o["epochmillis"])
    if "epochseconds" in o and "year" not in o:
        return F.timestamp_seconds(o["epochseconds"])
    y, m, d, h, i = _parts(o, "year", "month", "day", "hour", "minute")
    return F.make_timestamp_ltz(y, m, d, h, i, _fraction(o), o["timezone"]) if "timezone" in o else F.make_timestamp_ltz(y, m, d, h, i, _fraction(o))


_moment("datetime", ZONED, F.current_timestamp, _zoned, lambda c: c.cast("timestamp"), lambda c, f: F.to_timestamp_ltz(c, f))
_moment("localdatetime", LOCAL, F.localtimestamp, lambda o: F.make_timestamp_ntz(*_parts(o, "year", "month", "day", "hour", "minute"), _fraction(o)), lambda c: c.cast("timestamp_ntz"), lambda c, f: F.to_timestamp_ntz(c, f))
_moment("date", DATE, F.current_date, lambda o: F.make_date(*_parts(o, "year", "month", "day")), lambda c: c.cast("date"), lambda c, f: F.call_function("to_date", c, f))


def _nanos(h: Column, m: Column, s: Column) -> Column:
    return ((h.cast("long") * 3600 + m.cast("long") * 60) * 10**9 + (s * 10**9).cast("long")).cast("long")


def _parse_nanos(c: Column) -> Column:
    part = lambda i: F.regexp_extract(c, r"^(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d+)?))?", i)
    return _nanos(part(1), part(2), F.when(part(3) == "", "0").otherwise(part(3)).cast("decimal(16,9)"))


def _clock() -> Column:
    t = F.localtimestamp()
    return _nanos(F.hour(t), F.minute(t), F.call_function("date_part", F.lit("SECOND"), t))


@register("localtime", "() or (MAP) or (STRING, STRING?)", "time of day as nanoseconds", 0, 2)
def _localtime(a: Val | None = None, f: Val | None = None) -> Val:
    if a is None:
        return Val(_clock(), LONG)
    if isinstance(a.type, T.StringType):
        if f is not None:
            t = F.to_timestamp_ntz(a.col, f.col)
            return Val(_nanos(F.hour(t), F.minute(t), F.call_function("date_part", F.lit("SECOND"), t)), LONG)
        return Val(_parse_nanos(a.col), LONG)
    o = _options(a)
    return Val(_nanos(*_parts(o, "hour", "minute"), _fraction(o)), LONG)


@register("time", "() or (MAP) or (STRING, STRING?)", "time of day with an offset", 0, 2)
def _time(a: Val | None = None, f: Val | None = None) -> Val:
    nanos = _localtime(*[x for x in (a, f) if x is not None]).col
    if a is not None and isinstance(a.type, T.StringType):
        sign = F.when(F.regexp_extract(a.col, r"([+-])\d{2}:?\d{2}$", 1) == "-", -1).otherwise(1)
        part = lambda i: F.coalesce(F.regexp_extract(a.col, r"[+-](\d{2}):?(\d{2})$", i).try_cast("long"), F.lit(0))
        offset = sign * (part(1) * 3600 + part(2) * 60)
    else:
        offset = F.lit(0)
    return Val(F.struct(nanos.alias("nanos"), offset.cast("long").alias("offset_seconds")), OFFSET_TIME)


@register("duration", "(MAP) or (STRING)", "a span of exact seconds", 1)
def _duration(a: Val) -> Val:
    if isinstance(a.type, T.StringType):
        g = lambda unit, where: F.coalesce(F.regexp_extract(a.col, where % unit, 1).try_cast("decimal(18,9)"), F.lit(0))
        day, hour, minute, second = g("D", r"^-?P[^T]*?(-?[\d.]+)%s"), g("H", r"T.*?(-?[\d.]+)%s"), g("M", r"T.*?(-?[\d.]+)%s"), g("S", r"T.*?(-?[\d.]+)%s")
        total = ((day * 24 + hour) * 60 + minute) * 60 + second
        total = F.when(a.col.startswith("-"), -total).otherwise(total)
    else:
        o = _options(a)
        per = {"days": 86400, "hours": 3600, "minutes": 60, "seconds": 1, "milliseconds": 0.001, "microseconds": 0.000001, "weeks": 604800}
        total = F.lit(0).cast("decimal(18,6)")
        for name, seconds in per.items():
            for k in (name, name[:-1]):
                if k in o:
                    total = total + o[k].cast("decimal(18,6)") * F.lit(seconds).cast("decimal(18,6)")
    return Val(F.make_dt_interval(secs=total.cast("decimal(18,6)")), DURATION)


@register("duration.between", "(DATETIME, DATETIME) :: DURATION", "the second moment less the first", 2)
def _between(a: Val, b: Val) -> Val:
    return Val(b.col - a.col, DURATION)


@register("temporal.format", "(DATETIME, STRING) :: STRING", "a moment by a pattern", 2)
def _format(a: Val, f: Val) -> Val:
    return Val(F.call_function("date_format", a.col, f.col), STRING)


#: Fields of temporal values.
FIELDS = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "quarter": F.quarter, "week": F.weekofyear,
    "dayOfWeek": lambda c: F.weekday(c) + 1, "ordinalDay": F.dayofyear, "epochSeconds": lambda c: F.unix_seconds(c.cast("timestamp")), "epochMillis": lambda c: F.unix_millis(c.cast("timestamp")),
    "millisecond": lambda c: (F.call_function("date_part", F.lit("SECOND"), c) * 1000).cast("long") % 1000,
}


def field(v: Val, name: str) -> Val | None:
    if isinstance(v.type, (T.TimestampType, T.TimestampNTZType, T.DateType)) and name in FIELDS:
        return Val(FIELDS[name](v.col).cast("long"), LONG)
    if isinstance(v.type, T.DayTimeIntervalType):
        seconds = F.call_function("date_part", F.lit("DAY"), v.col) * 86400 + F.call_function("date_part", F.lit("HOUR"), v.col) * 3600 + F.call_function("date_part", F.lit("MINUTE"), v.col) * 60 + F.call_function("date_part", F.lit("SECOND"), v.col)
        per = {"seconds": 1, "minutes": 60, "hours": 3600, "days": 86400}
        if name in per:
            return Val(F.floor(seconds / per[name]).cast("long"), LONG)
        if name == "milliseconds":
            return Val((seconds * 1000).cast("long"), LONG)
    return None
