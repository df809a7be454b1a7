"""Scalar functions: name -> builder of a Column from compiled arguments.

A builder gets the arguments as (Column, DataType) pairs and gives a Column. Null arguments give null, as Spark's
own functions do; the few that differ say so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Typed = tuple[Column, T.DataType]
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
NUMERIC = INTEGRAL + FRACTIONAL
TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)
DURATION = T.StructType([T.StructField("months", T.LongType()), T.StructField("days", T.LongType()), T.StructField("seconds", T.LongType()), T.StructField("nanoseconds", T.LongType())])
DURATION_KEYS = {"years": ("months", 12), "months": ("months", 1), "weeks": ("days", 7), "days": ("days", 1), "hours": ("seconds", 3600), "minutes": ("seconds", 60), "seconds": ("seconds", 1), "milliseconds": ("nanoseconds", 10**6), "nanoseconds": ("nanoseconds", 1)}

REGISTRY: dict[str, Callable[..., Column]] = {}


def register(*names: str):
    """Add a function under names; user functions use it as well."""

    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        for n in names:
            REGISTRY[n.lower()] = f
        return f

    return put


def is_duration(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and {f.name for f in kind.fields} == {"months", "days", "seconds", "nanoseconds"}


def to_string(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, FRACTIONAL):  # 10000000.0 rather than 1.0E7
        plain = F.when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e15) & (F.abs(c) >= 1e7), F.concat(c.cast("decimal(38,6)").cast("string")))
        plain = F.when(plain.isNotNull(), F.regexp_replace(F.regexp_replace(plain, r"0+$", ""), r"\.$", ".0"))
        return F.coalesce(plain, c.cast("string"))
    if is_duration(kind):
        part = lambda name, unit: F.when(c[name] != 0, F.concat(c[name].cast("string"), F.lit(unit))).otherwise(F.lit(""))
        time = part("seconds", "S")
        return F.when(c.isNotNull(), F.concat(F.lit("P"), part("months", "M"), part("days", "D"), F.when(time != "", F.concat(F.lit("T"), time)).otherwise(F.lit(""))))
    if isinstance(kind, TIMES):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return c.cast("string")


def _simple(name: str, f: Callable[..., Column]) -> None:
    REGISTRY[name] = lambda *args: f(*[a[0] for a in args])


for _name, _f in {
    "toupper": F.upper, "upper": F.upper, "tolower": F.lower, "lower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim, "reverse": F.reverse,
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "atan2": F.atan2, "cot": F.cot, "degrees": F.degrees, "radians": F.radians,
    "abs": F.abs, "coalesce": F.coalesce, "rand": lambda: F.rand(), "pi": lambda: F.pi(), "e": lambda: F.e(), "replace": F.replace,
}.items():
    _simple(_name, _f)


@register("sqrt")
def _sqrt(a: Typed) -> Column:
    return F.sqrt(a[0].cast("double"))


@register("exp")
def _exp(a: Typed) -> Column:
    return F.exp(a[0].cast("double"))


@register("log")
def _log(a: Typed) -> Column:
    return F.ln(a[0].cast("double"))


@register("log10")
def _log10(a: Typed) -> Column:
    return F.log10(a[0].cast("double"))


@register("haversin")
def _haversin(a: Typed) -> Column:
    return (F.lit(1.0) - F.cos(a[0])) / 2


@register("sign")
def _sign(a: Typed) -> Column:
    return F.signum(a[0]).cast("long")


@register("ceil")
def _ceil(a: Typed) -> Column:
    return F.ceil(a[0]).cast("long")


@register("floor")
def _floor(a: Typed) -> Column:
    return F.floor(a[0]).cast("long")


@register("round")
def _round(a: Typed, p: Typed | None = None) -> Column:
    return F.round(a[0]).cast("long") if p is None else F.round(a[0].cast("double"), p[0])


@register("left")
def _left(a: Typed, n: Typed) -> Column:
    return F.substring(a[0], F.lit(1), F.greatest(n[0].cast("int"), F.lit(0)))


@register("right")
def _right(a: Typed, n: Typed) -> Column:
    k = F.greatest(n[0].cast("int"), F.lit(0))
    return F.when(k == 0, F.when(a[0].isNotNull(), F.lit(""))).otherwise(F.substring(a[0], F.greatest(F.char_length(a[0]) - k + 1, F.lit(1)), k))


@register("substring")
def _substring(a: Typed, start: Typed, n: Typed | None = None) -> Column:
    return F.substring(a[0], start[0].cast("int") + 1, F.lit(1 << 30) if n is None else n[0].cast("int"))


@register("split")
def _split(a: Typed, by: Typed) -> Column:
    quoted = F.regexp_replace(by[0], r"([\\\[\](){}.*+?^$|])", r"\\$1")
    chars = F.when(a[0] == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(a[0], F.lit("(?s)."), F.lit(0)))
    return F.when(by[0] == "", chars).otherwise(F.split(a[0], quoted, -1))


@register("size", "length", "char_length")
def _size(a: Typed) -> Column:
    if isinstance(a[1], T.StringType):
        return F.char_length(a[0]).cast("long")
    if isinstance(a[1], T.StructType) and [f.name for f in a[1].fields] == ["nodes", "rels"]:
        return F.size(a[0]["rels"]).cast("long")
    return F.size(a[0]).cast("long") if isinstance(a[1], (T.ArrayType, T.MapType)) else F.lit(None).cast("long")


@register("isempty")
def _is_empty(a: Typed) -> Column:
    return _size(a) == 0


@register("head")
def _head(a: Typed) -> Column:
    return F.get(a[0], F.lit(0))


@register("last")
def _last(a: Typed) -> Column:
    return F.try_element_at(a[0], F.lit(-1))


@register("tail")
def _tail(a: Typed) -> Column:
    return F.when(F.size(a[0]) > 1, F.slice(a[0], F.lit(2), F.size(a[0]) - 1)).otherwise(F.when(a[0].isNotNull(), F.slice(a[0], F.lit(1), F.lit(0))))


@register("range")
def _range(a: Typed, b: Typed, step: Typed | None = None) -> Column:
    by = F.lit(1).cast("long") if step is None else step[0].cast("long")
    low, high = a[0].cast("long"), b[0].cast("long")
    ok = ((by > 0) & (low <= high)) | ((by < 0) & (low >= high))
    return F.when(ok, F.sequence(low, high, by)).otherwise(F.when(low.isNotNull() & high.isNotNull(), F.array().cast("array<bigint>")))


@register("tostring")
def _to_string(a: Typed) -> Column:
    return to_string(*a)


@register("tointeger", "tointegerornull", "toint")
def _to_integer(a: Typed) -> Column:
    if isinstance(a[1], T.StringType):
        return F.coalesce(F.expr("null").cast("long"), F.trim(a[0]).try_cast("long"), F.trim(a[0]).try_cast("double").try_cast("long"))
    return a[0].try_cast("long")


@register("tofloat", "tofloatornull")
def _to_float(a: Typed) -> Column:
    return F.trim(a[0]).try_cast("double") if isinstance(a[1], T.StringType) else a[0].try_cast("double")


@register("toboolean", "tobooleanornull")
def _to_boolean(a: Typed) -> Column:
    low = F.lower(F.trim(a[0].cast("string")))
    return F.when(low == "true", F.lit(True)).when(low == "false", F.lit(False))


@register("valuetype")
def _value_type(a: Typed) -> Column:
    kind = a[1]
    name = (
        "INTEGER" if isinstance(kind, INTEGRAL) else "FLOAT" if isinstance(kind, FRACTIONAL) else "STRING" if isinstance(kind, T.StringType) else "BOOLEAN" if isinstance(kind, T.BooleanType)
        else "DATETIME" if isinstance(kind, TIMES) else "LIST" if isinstance(kind, T.ArrayType) else "DURATION" if is_duration(kind) else "NULL" if isinstance(kind, T.NullType) else "MAP"
    )
    return F.when(a[0].isNull(), F.lit("NULL")).otherwise(F.lit(name))


@register("timestamp")
def _timestamp() -> Column:
    return F.unix_millis(F.current_timestamp())


def _instant(*args: Typed) -> Column:
    if not args:
        return F.current_timestamp()
    c, kind = args[0]
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields]
        if "epochMillis" in names:
            return F.timestamp_millis(c["epochMillis"])
        if "epochSeconds" in names:
            return F.timestamp_seconds(c["epochSeconds"])
        if not {"year", "month", "day", "hour", "minute", "second", "millisecond"} & set(names):
            raise ValueError("no known key of a date in the map")
        get = lambda n, d: c[n].cast("int") if n in names else F.lit(d)
        second = get("second", 0) + (c["millisecond"] / 1000 if "millisecond" in names else F.lit(0))
        return F.make_timestamp(get("year", 1970), get("month", 1), get("day", 1), get("hour", 0), get("minute", 0), second.cast("decimal(16,6)"))
    return F.date_trunc("millisecond", F.try_to_timestamp(c)) if isinstance(kind, T.StringType) else c.cast("timestamp")


@register("datetime", "localdatetime")
def _datetime(*args: Typed) -> Column:
    return _instant(*args)


@register("date")
def _date(*args: Typed) -> Column:
    return F.date_trunc("day", _instant(*args))


@register("time", "localtime")
def _time(*args: Typed) -> Column:
    if args and isinstance(args[0][1], T.StringType):
        at = F.try_to_timestamp(F.concat(F.lit("1970-01-01T"), args[0][0]))
        return F.unix_millis(at)
    at = _instant(*args)
    return F.unix_millis(at) - F.unix_millis(F.date_trunc("day", at))


@register("duration")
def _duration(a: Typed) -> Column:
    names = [f.name for f in a[1].fields] if isinstance(a[1], T.StructType) else []
    unknown = set(names) - set(DURATION_KEYS)
    if unknown or not names:
        raise ValueError(f"duration of {unknown or 'no map'}")
    total = {f.name: F.lit(0).cast("long") for f in DURATION.fields}
    for n in names:
        into, times = DURATION_KEYS[n]
        total[into] = total[into] + (a[0][n] * times).cast("long")
    return F.struct(*[v.alias(k) for k, v in total.items()])


def component(c: Column, kind: T.DataType, key: str) -> Column | None:
    """A component of an instant or a duration, else None."""
    if isinstance(kind, TIMES):
        at = c.cast("timestamp")
        parts = {"year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "minute": F.minute, "dayOfWeek": lambda x: F.weekday(x) + 1, "dayOfYear": F.dayofyear, "week": F.weekofyear, "quarter": F.quarter}
        if key in parts:
            return parts[key](c).cast("long")
        if key == "second":
            return F.second(at).cast("long")
        if key == "millisecond":
            return F.unix_millis(at) % 1000
        if key == "epochMillis":
            return F.unix_millis(at)
        if key == "epochSeconds":
            return F.unix_seconds(at)
    if is_duration(kind):
        if key in ("months", "days", "seconds", "nanoseconds"):
            return c[key]
        if key in ("hours", "minutes"):
            return F.expr("0").cast("long") + F.floor(c["seconds"] / (3600 if key == "hours" else 60)).cast("long")
        if key == "minutesOfHour":
            return F.floor(c["seconds"] / 60).cast("long") % 60
        if key == "secondsOfMinute":
            return c["seconds"] % 60
    return None


def shifted(at: Column, by: Column, sign: int) -> Column:
    """An instant plus or minus a duration."""
    month = F.to_timestamp(F.concat(F.date_format(F.add_months(at, (by["months"] * sign).cast("int")), "yyyy-MM-dd"), F.date_format(at, " HH:mm:ss.SSSSSS")))
    return F.timestamp_micros(F.unix_micros(month) + sign * (by["days"] * 86_400_000_000 + by["seconds"] * 1_000_000 + F.floor(by["nanoseconds"] / 1000)))


def between(a: Column, b: Column) -> Column:
    """The duration from b to a, in days and seconds."""
    ms = F.unix_millis(a.cast("timestamp")) - F.unix_millis(b.cast("timestamp"))
    days = F.expr("0").cast("long") + (ms / 86_400_000).cast("long")
    rest = ms - days * 86_400_000
    seconds = (rest / 1000).cast("long")
    return F.struct(F.lit(0).cast("long").alias("months"), days.alias("days"), seconds.alias("seconds"), ((rest - seconds * 1000) * 1_000_000).alias("nanoseconds"))
