"""Temporal values as Spark columns: construction, components, arithmetic, truncation and text.

A date is a DATE, a local date and time a TIMESTAMP_NTZ. What Spark has no type for is a struct, told by
its field names: a time (nanosOfDay, offset), a local time (nanosOfDay), a date and time with a zone
(instant in UTC, offset in seconds, zone) and a duration (months, days, seconds, nanos). Dates with a
time are exact to microseconds, times and durations to nanoseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherTypeError

STRUCTS = {("nanosOfDay", "offset"): "time", ("nanosOfDay",): "localtime", ("instant", "offset", "zone"): "datetime", ("months", "days", "seconds", "nanos"): "duration"}
KINDS = ("date", "time", "localtime", "datetime", "localdatetime", "duration")
#: Seconds of a mean month (of 400 Gregorian years) and of a day, nanoseconds of a second.
MONTH, DAY, NANO = 2_629_746, 86_400, 1_000_000_000


def kind_of(t: T.DataType) -> str | None:
    if isinstance(t, T.DateType):
        return "date"
    if isinstance(t, (T.TimestampNTZType, T.TimestampType)):
        return "localdatetime"
    return STRUCTS.get(tuple(t.names)) if isinstance(t, T.StructType) else None


def lit(n) -> Column:
    return F.lit(n).cast("long")


def let(x: Column, f) -> Column:
    """f of x, where x is evaluated once and stands once in the plan however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def div(a: Column, b) -> Column:
    """Quotient of whole numbers towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else lit(b))


def duration(months=0, days=0, seconds=0, nanos=0) -> Column:
    """A duration whose nanos are below a second, of the sign of the seconds; null if a part is."""
    months, days, seconds, nanos = (x.cast("long") if isinstance(x, Column) else lit(x) for x in (months, days, seconds, nanos))

    def carried(p: Column) -> Column:
        total, rest = p["s"] + div(p["n"], NANO), p["n"] % NANO
        carry = F.when((total > 0) & (rest < 0), -1).when((total < 0) & (rest > 0), 1).otherwise(0)
        fields = F.struct(p["m"].alias("months"), p["d"].alias("days"), (total + carry).cast("long").alias("seconds"), (rest - carry * NANO).cast("long").alias("nanos"))
        return F.when(p["m"].isNotNull() & p["d"].isNotNull() & total.isNotNull(), fields)

    return let(F.struct(months.alias("m"), days.alias("d"), seconds.alias("s"), nanos.alias("n")), carried)


def whole(x: Column) -> Column:
    return F.when(x >= 0, F.floor(x + 1e-9)).otherwise(F.ceil(x - 1e-9))


def duration_of(parts: dict[str, Column]) -> Column:
    """From possibly fractional parts: a fraction of a month is mean days, one of a day seconds."""
    get = lambda *names: sum((parts[n].cast("double") * k for n, k in names if n in parts), F.lit(0.0))
    small = [("hours", 3600 * NANO), ("minutes", 60 * NANO), ("seconds", NANO), ("milliseconds", 1_000_000), ("microseconds", 1000), ("nanoseconds", 1)]
    # a long holds nanoseconds of 292 years: of more, a decimal, whole seconds are split off
    nanos = sum((F.round(parts[n].cast("decimal(28,9)") * k) for n, k in small if n in parts), F.lit(0).cast("decimal(1,0)"))
    given = F.struct(get(("years", 12), ("quarters", 3), ("months", 1)).alias("m"), get(("weeks", 7), ("days", 1)).alias("d"), nanos.alias("n"))
    # a fraction goes down a unit, months first
    long = lambda s, n: F.struct(s.cast("long").alias("s"), n.cast("long").alias("n"))
    split = lambda n: F.when(F.abs(n) < 9 * NANO * NANO, long(lit(0), n)).otherwise(long((n - n % NANO) / NANO, n % NANO))
    months = let(given, lambda p: F.struct(whole(p["m"]).alias("m"), (p["d"] + F.round((p["m"] - whole(p["m"])) * MONTH / DAY, 9)).alias("d"), split(p["n"]).alias("n")))
    return let(months, lambda p: duration(p["m"], whole(p["d"]), p["n"]["s"], p["n"]["n"] + F.round((p["d"] - whole(p["d"])) * DAY * NANO).cast("long")))


def found(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


DESIGNATED = "^(-?)P(?:([-0-9.]+)Y)?(?:([-0-9.]+)M)?(?:([-0-9.]+)W)?(?:([-0-9.]+)D)?(?:T(?:([-0-9.]+)H)?(?:([-0-9.]+)M)?(?:([-0-9.]+)S)?)?$"
ALTERNATE = "^(-?)P([0-9]{4})-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9.]+)$"


def parse_duration(x: Column) -> Column:
    def of(pattern: str, names: tuple[str, ...]) -> Column:
        sign = F.when(F.regexp_extract(x, pattern, 1) == "-", -1.0).otherwise(1.0)
        zero = F.lit("0")
        return duration_of({n: F.coalesce(found(x, pattern, k + 2), zero).cast("decimal(28,9)") * sign.cast("decimal(2,0)") for k, n in enumerate(names)})

    first = of(DESIGNATED, ("years", "months", "weeks", "days", "hours", "minutes", "seconds"))
    second = of(ALTERNATE, ("years", "months", "days", "hours", "minutes", "seconds"))
    return F.when(x.rlike(DESIGNATED), first).when(x.rlike(ALTERNATE), second).when(x.isNotNull(), F.raise_error(F.lit("InvalidArgumentValue: duration text")))


def week_date(year: Column, week: Column, day: Column) -> Column:
    fourth = F.make_date(year, F.lit(1), F.lit(4))
    return F.date_add(F.date_sub(fourth, F.weekday(fourth)), ((week - 1) * 7 + day - 1).cast("int"))


def quarter_date(year: Column, quarter: Column, day: Column) -> Column:
    return F.date_add(F.make_date(year, ((quarter - 1) * 3 + 1).cast("int"), F.lit(1)), (day - 1).cast("int"))


DATES = {
    "calendar": "^([+-]?[0-9]{4,9})-([0-9]{2})-([0-9]{2})$", "basic": "^([0-9]{4})([0-9]{2})([0-9]{2})$", "month": "^([0-9]{4})-([0-9]{2})$", "basic month": "^([0-9]{4})([0-9]{2})$", "year": "^([+-]?[0-9]{4,9})$",
    "week": "^([0-9]{4})-?W([0-9]{2})(?:-?([0-9]))?$", "ordinal": "^([0-9]{4})-?([0-9]{3})$", "quarter": "^([0-9]{4})-?Q([0-9])(?:-?([0-9]{2}))?$",
}


def parse_date(x: Column) -> Column:
    """ISO text: calendar, basic, week, ordinal and quarter dates; other text is an error."""
    out = None
    for name in ("calendar", "month", "week", "ordinal", "quarter", "basic", "basic month", "year"):
        pattern = DATES[name]
        part = lambda k, p=pattern, n=name: F.coalesce(found(x, p, k).cast("int"), F.lit(1)) if p.count("(") - p.count("(?") >= k else F.lit(1)
        year = part(1)
        if name == "week":
            value = week_date(year, part(2), part(3))
        elif name == "ordinal":
            value = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), part(2) - 1)
        elif name == "quarter":
            value = quarter_date(year, part(2), part(3))
        else:
            value = F.make_date(year, part(2), part(3))
        out = F.when(x.rlike(pattern), value) if out is None else out.when(x.rlike(pattern), value)
    return out.when(x.isNotNull(), F.raise_error(F.lit("InvalidArgumentValue: date text")))


CLOCK = "^([0-9]{2})(?::?([0-9]{2}))?(?::?([0-9]{2}))?(?:[.]([0-9]{1,9}))?(Z|[+-][0-9]{2}(?::?[0-9]{2})?)?(?:\\[(.+)\\])?$"


def parse_clock(x: Column) -> tuple[Column, Column, Column]:
    """(nanoseconds of the day, offset or null, zone or null) of ISO text."""
    whole = lambda k: F.coalesce(found(x, CLOCK, k).cast("long"), lit(0))
    nanos = (whole(1) * 3600 + whole(2) * 60 + whole(3)) * NANO + F.coalesce(F.rpad(found(x, CLOCK, 4), 9, "0").cast("long"), lit(0))
    return nanos, parse_offset(found(x, CLOCK, 5)), found(x, CLOCK, 6)


def parse_offset(x: Column) -> Column:
    """Seconds of Z or ±hh[:mm]; null where there is none."""
    pattern = "^([+-])([0-9]{2}):?([0-9]{2})?$"
    size = found(x, pattern, 2).cast("int") * 3600 + F.coalesce(found(x, pattern, 3).cast("int"), F.lit(0)) * 60
    return F.when(x == "Z", 0).when(x.rlike(pattern), F.when(x.startswith("-"), -size).otherwise(size))


def shift(ts: Column, seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds.cast("int"), ts)


def at_nanos(date: Column, nanos: Column) -> Column:
    """The local date and time at so many nanoseconds of the day."""
    return F.timestamp_add("MICROSECOND", (div(nanos, 1000) % 1_000_000).cast("int"), F.timestamp_add("SECOND", div(nanos, NANO).cast("int"), date.cast("timestamp_ntz")))


def zoned(local: Column, offset: Column, zone: Column) -> Column:
    """A date and time with its offset; a named zone gives the offset where none is stated."""
    return let(F.struct(local.alias("l"), offset.cast("int").alias("o"), zone.cast("string").alias("z")), lambda p: zoned_plain(p["l"], p["o"], p["z"]))


def zoned_plain(local: Column, offset: Column, zone: Column) -> Column:
    utc = F.when(zone.isNotNull(), F.convert_timezone(F.coalesce(zone, F.lit("UTC")), F.lit("UTC"), local)).otherwise(local)
    known = F.coalesce(offset, F.timestamp_diff("SECOND", utc, local).cast("int"))
    return F.when(local.isNotNull(), F.struct(shift(local, -known).alias("instant"), known.cast("int").alias("offset"), zone.cast("string").alias("zone")))


def time_of(nanos: Column, offset: Column) -> Column:
    return F.when(nanos.isNotNull(), F.struct(nanos.cast("long").alias("nanosOfDay"), F.coalesce(offset, F.lit(0)).cast("int").alias("offset")))


def localtime_of(nanos: Column) -> Column:
    return F.when(nanos.isNotNull(), F.struct(nanos.cast("long").alias("nanosOfDay")))


def local(x: Column, t: T.DataType) -> Column:
    """The date and time that a clock at the place shows; times are those of 1970-01-01."""
    kind = kind_of(t)
    if kind == "datetime":
        return shift(x["instant"], x["offset"])
    if kind in ("time", "localtime"):
        return at_nanos(F.lit("1970-01-01").cast("date"), x["nanosOfDay"])
    return x.cast("timestamp_ntz")


def nanos_of_day(x: Column, t: T.DataType) -> Column:
    if kind_of(t) in ("time", "localtime"):
        return x["nanosOfDay"]
    here = local(x, t)
    return F.timestamp_diff("MICROSECOND", F.date_trunc("day", here).cast("timestamp_ntz"), here) * 1000


def parse(kind: str, x: Column) -> Column:
    return let(x, lambda v: plain_parse(kind, v))


def plain_parse(kind: str, x: Column) -> Column:
    if kind == "duration":
        return parse_duration(x)
    if kind == "date":
        return parse_date(x)
    if kind in ("time", "localtime"):
        nanos, offset, _ = parse_clock(x)
        bad = x.isNotNull() & ~x.rlike(CLOCK)
        nanos = F.when(bad, F.raise_error(F.lit("InvalidArgumentValue: time text"))).otherwise(nanos)
        return F.when(x.isNotNull(), time_of(nanos, offset) if kind == "time" else localtime_of(nanos))
    day, clock = found(x, "^([^T]+)", 1), F.coalesce(found(x, "T(.+)$", 1), F.lit("00"))
    nanos, offset, zone = parse_clock(clock)
    here = let(nanos, lambda n: at_nanos(parse_date(day), n))
    return here if kind == "localdatetime" else zoned(here, F.when(zone.isNull(), F.coalesce(offset, F.lit(0))).otherwise(offset), zone)


def convert(kind: str, x: Column, t: T.DataType) -> Column:
    """A value of one kind as another; text is parsed."""
    own = kind_of(t)
    if isinstance(t, T.StringType):
        return parse(kind, x)
    if isinstance(t, T.NullType):
        return F.lit(None)
    if own is None or "duration" in (own, kind) and own != kind:
        raise CypherTypeError("InvalidArgumentType", f"{kind} of {t.simpleString()}")
    if own == kind:
        return x.cast("timestamp_ntz") if kind == "localdatetime" else x
    if kind == "date":
        return local(x, t).cast("date")
    if kind == "localdatetime":
        return local(x, t)
    if kind == "datetime":
        return zoned(local(x, t), F.lit(0), F.lit(None).cast("string"))
    offset = x["offset"] if own in ("datetime", "time") else F.lit(0)
    return time_of(nanos_of_day(x, t), offset) if kind == "time" else localtime_of(nanos_of_day(x, t))


DATE_FIELDS = ("year", "month", "day", "week", "dayofweek", "ordinalday", "quarter", "dayofquarter")
CLOCK_FIELDS = {"hour": 3600 * NANO, "minute": 60 * NANO, "second": NANO, "millisecond": 1_000_000, "microsecond": 1000, "nanosecond": 1}


def from_fields(kind: str, fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """From a map: parts of a date and a clock, over the date, time or datetime that it gives as a base."""
    fields = {k.lower(): v for k, v in fields.items()}
    if kind == "duration":
        return duration_of({k if k.endswith("s") else f"{k}s": x for k, (x, _) in fields.items()})
    base = fields.get("date") or fields.get("datetime")
    given = lambda name, default: fields[name][0].cast("int") if name in fields else default
    held = local(*base).cast("date") if base else None
    year = given("year", F.year(held) if base else F.lit(1970))
    if "week" in fields:
        day = week_date(year, given("week", None), given("dayofweek", F.weekday(held) + 1 if base else F.lit(1)))
    elif "ordinalday" in fields:
        day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), given("ordinalday", None) - 1)
    elif "quarter" in fields:
        day = quarter_date(year, given("quarter", None), given("dayofquarter", F.datediff(held, F.date_trunc("quarter", held).cast("date")) + 1 if base else F.lit(1)))
    else:
        day = F.make_date(year, given("month", F.month(held) if base else F.lit(1)), given("day", F.dayofmonth(held) if base else F.lit(1)))
    if kind == "date":
        return day
    clock = fields.get("time") or fields.get("datetime")
    nanos = nanos_of_day(*clock) if clock else lit(0)
    above = 24 * 3600 * NANO
    for name, size in CLOCK_FIELDS.items():
        if name in fields:  # the part between this unit and the one above is replaced
            given = fields[name][0].cast("long") * size
            nanos = let(nanos, lambda n, above=above, size=size, given=given: n - n % above + given + n % size) if clock else nanos + given
        above = size
    zone = fields["timezone"][0] if "timezone" in fields else None
    offset = parse_offset(zone) if zone is not None else clock[0]["offset"] if clock and kind_of(clock[1]) in ("time", "datetime") else F.lit(0)
    if kind == "localtime":
        return localtime_of(nanos)
    if kind == "time":
        return time_of(nanos, offset)
    here = let(nanos, lambda n: at_nanos(day, n))
    if kind == "localdatetime":
        return here
    named = F.lit(None).cast("string") if zone is None else F.when(parse_offset(zone).isNull(), zone)
    return zoned(here, offset, named)


def now(kind: str) -> Column:
    here = F.localtimestamp()
    return F.current_date() if kind == "date" else here if kind == "localdatetime" else convert(kind, here, T.TimestampNTZType())


# --- components ---------------------------------------------------------------------------------------------

OF_DURATION = {
    "years": lambda d: div(d["months"], 12), "quarters": lambda d: div(d["months"], 3), "months": lambda d: d["months"], "weeks": lambda d: div(d["days"], 7), "days": lambda d: d["days"],
    "hours": lambda d: div(d["seconds"], 3600), "minutes": lambda d: div(d["seconds"], 60), "seconds": lambda d: d["seconds"], "milliseconds": lambda d: d["seconds"] * 1000 + div(d["nanos"], 1_000_000),
    "microseconds": lambda d: d["seconds"] * 1_000_000 + div(d["nanos"], 1000), "nanoseconds": lambda d: d["seconds"] * NANO + d["nanos"], "quartersofyear": lambda d: div(d["months"], 3) % 4,
    "monthsofquarter": lambda d: d["months"] % 3, "monthsofyear": lambda d: d["months"] % 12, "daysofweek": lambda d: d["days"] % 7, "minutesofhour": lambda d: div(d["seconds"], 60) % 60,
    "secondsofminute": lambda d: d["seconds"] % 60, "millisecondsofsecond": lambda d: div(d["nanos"], 1_000_000), "microsecondsofsecond": lambda d: div(d["nanos"], 1000), "nanosecondsofsecond": lambda d: d["nanos"],
}
OF_DATE = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "week": F.weekofyear, "dayofyear": F.dayofyear, "ordinalday": F.dayofyear, "dayofweek": lambda x: F.weekday(x) + 1,
    "weekyear": lambda x: F.extract(F.lit("yearofweek"), x), "dayofquarter": lambda x: F.datediff(x.cast("date"), F.date_trunc("quarter", x).cast("date")) + 1,
}
OF_CLOCK = {
    "hour": lambda n: div(n, 3600 * NANO), "minute": lambda n: div(n, 60 * NANO) % 60, "second": lambda n: div(n, NANO) % 60,
    "millisecond": lambda n: div(n, 1_000_000) % 1000, "microsecond": lambda n: div(n, 1000) % 1_000_000, "nanosecond": lambda n: n % NANO,
}


def offset_text(seconds: Column) -> Column:
    size = F.abs(seconds)
    text = F.format_string("%s%02d:%02d", F.when(seconds < 0, "-").otherwise("+"), div(size, 3600), div(size, 60) % 60)
    return F.when(seconds == 0, F.lit("Z")).otherwise(text)


def component(x: Column, t: T.DataType, name: str) -> Column:
    plain_component(x, t, name)  # a part that the kind lacks is an error here and now
    return let(x, lambda v: plain_component(v, t, name))


def plain_component(x: Column, t: T.DataType, name: str) -> Column:
    kind, part = kind_of(t), name.lower()
    if kind == "duration" and part in OF_DURATION:
        return OF_DURATION[part](x).cast("long")
    if kind in ("date", "localdatetime", "datetime") and part in OF_DATE:
        return OF_DATE[part](local(x, t)).cast("long")
    if kind not in ("date", "duration") and part in OF_CLOCK:
        return OF_CLOCK[part](nanos_of_day(x, t)).cast("long")
    if kind in ("time", "datetime") and part in ("offset", "timezone"):
        return F.coalesce(x["zone"], offset_text(x["offset"])) if part == "timezone" and kind == "datetime" else offset_text(x["offset"])
    if kind in ("time", "datetime") and part in ("offsetminutes", "offsetseconds"):
        return (div(x["offset"], 60) if part == "offsetminutes" else x["offset"]).cast("long")
    if kind in ("date", "localdatetime", "datetime") and part in ("epochseconds", "epochmillis"):
        instant = x["instant"] if kind == "datetime" else x.cast("timestamp_ntz")
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        return F.timestamp_diff("SECOND" if part == "epochseconds" else "MILLISECOND", start, instant).cast("long")
    raise CypherTypeError("InvalidArgumentType", f"no component {name} of {kind}")


# --- comparison, arithmetic -----------------------------------------------------------------------------------


def sort_key(x: Column, t: T.DataType) -> Column:
    """A plain column in the order of values of the kind: zoned ones by their instant."""
    kind = kind_of(t)
    if kind == "datetime":
        return x["instant"]
    if kind == "time":
        return x["nanosOfDay"] - x["offset"].cast("long") * NANO
    if kind == "localtime":
        return x["nanosOfDay"]
    if kind == "duration":
        return (x["months"] * MONTH + x["days"] * DAY + x["seconds"]).cast("decimal(28,9)") + x["nanos"].cast("decimal(28,9)") / 1_000_000_000
    return x


def plus(x: Column, t: T.DataType, d: Column, sign: int = 1) -> Column:
    """A value and sign times a duration; months are clamped to the month's last day, clock times wrap at a day."""
    return let(F.struct(x.alias("x"), d.alias("d")), lambda p: plain_plus(p["x"], t, p["d"], sign))


def plain_plus(x: Column, t: T.DataType, d: Column, sign: int) -> Column:
    kind = kind_of(t)
    if kind == "duration":
        return duration(*[x[f] + sign * d[f] for f in ("months", "days", "seconds", "nanos")])
    if kind in ("time", "localtime"):
        nanos = F.pmod(x["nanosOfDay"] + sign * (F.pmod(d["seconds"], lit(DAY)) * NANO + d["nanos"]), lit(DAY * NANO))
        return time_of(nanos, x["offset"]) if kind == "time" else localtime_of(nanos)
    here = local(x, t)
    step = F.make_interval(F.lit(0), (sign * d["months"]).cast("int"), F.lit(0), (sign * d["days"] + sign * div(d["seconds"], DAY)).cast("int"))
    rest = sign * ((d["seconds"] % DAY) * 1_000_000 + div(d["nanos"], 1000))
    after = here + step
    after = F.timestamp_add("MICROSECOND", (rest % 1_000_000).cast("int"), F.timestamp_add("SECOND", div(rest, 1_000_000).cast("int"), after))
    if kind == "date":
        return (here + step).cast("date")
    return after if kind == "localdatetime" else zoned(after, F.when(x["zone"].isNull(), x["offset"]), x["zone"])


def scale(d: Column, factor: Column, t: T.DataType, over: bool = False) -> Column:
    """A duration times or over a number of type t; whole numbers scale its clock part exactly, which a double holds to 2^53 seconds."""
    exact = "decimal(19,0)" if isinstance(t, T.IntegralType) else "double"

    def part(x: Column, kind: str = "double") -> Column:
        return x.cast(kind) / factor.cast(kind) if over else x.cast(kind) * factor.cast(kind)

    return duration_of({"months": part(d["months"]), "days": part(d["days"]), "seconds": part(d["seconds"], exact), "nanoseconds": part(d["nanos"], exact)})


def between(a: Column, ta: T.DataType, b: Column, tb: T.DataType, what: str) -> Column:
    """The duration from a to b: in months, days and seconds, or in one of them alone."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda p: plain_between(p["a"], ta, p["b"], tb, what))


def plain_between(a: Column, ta: T.DataType, b: Column, tb: T.DataType, what: str) -> Column:
    clocks = {kind_of(ta), kind_of(tb)} & {"time", "localtime"}
    if clocks:  # a clock time and a day are compared by their clocks
        seconds = nanos_of_day(b, tb) - nanos_of_day(a, ta)
        return duration(0, 0, 0, seconds if what in ("between", "inseconds") else seconds * 0)
    if kind_of(ta) == kind_of(tb) == "datetime":
        x, y = shift(a["instant"], a["offset"]), shift(b["instant"], a["offset"])
    else:
        x, y = local(a, ta), local(b, tb)
    micros = F.timestamp_diff("MICROSECOND", x, y)
    if what == "inseconds":
        return duration(0, 0, div(micros, 1_000_000), (micros % 1_000_000) * 1000)
    if what == "indays":
        return duration(0, div(micros, DAY * 1_000_000), 0, 0)
    months = F.timestamp_diff("MONTH", x, y)
    if what == "inmonths":
        return duration(months, 0, 0, 0)
    rest = F.timestamp_diff("MICROSECOND", x + F.make_interval(F.lit(0), months.cast("int")), y)
    after = rest % (DAY * 1_000_000)
    return duration(months, div(rest, DAY * 1_000_000), div(after, 1_000_000), (after % 1_000_000) * 1000)


UNITS = {"millennium": 1000, "century": 100, "decade": 10}


def truncate(kind: str, unit: str, x: Column, t: T.DataType, fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    """The start of the unit that holds x, as a value of the kind, with the fields of a map put over it."""
    return let(x, lambda v: plain_truncate(kind, unit, v, t, fields))


def plain_truncate(kind: str, unit: str, x: Column, t: T.DataType, fields: dict[str, tuple[Column, T.DataType]]) -> Column:
    unit = unit.lower()
    here = local(x, t)
    if unit in UNITS:
        out = F.make_date((F.floor(F.year(here) / UNITS[unit]) * UNITS[unit]).cast("int"), F.lit(1), F.lit(1))
    elif unit == "weekyear":
        out = week_date(F.extract(F.lit("yearofweek"), here), F.lit(1), F.lit(1))
    else:
        out = F.date_trunc(unit, here)
    out = out.cast("timestamp_ntz")
    offset = x["offset"] if kind_of(t) in ("time", "datetime") else F.lit(0)
    named = x["zone"] if kind_of(t) == "datetime" else F.lit(None).cast("string")
    ntz = T.TimestampNTZType()
    if fields:
        own = dict(fields)
        if unit == "week" and any(k.lower() == "dayofweek" for k in own):
            own["week"], own["year"] = (F.weekofyear(out), ntz), (F.extract(F.lit("yearofweek"), out), ntz)
        out = from_fields("localdatetime", {"datetime": (out, ntz), **own})
    if kind == "datetime":
        return zoned(out, F.when(named.isNull(), offset), named)
    if kind == "time":
        return time_of(nanos_of_day(out, ntz), offset)
    return convert(kind, out, ntz)


def epoch(name: str, args: list[Column]) -> Column:
    """datetime.fromepoch(seconds, nanos), fromepochmillis, -micros and -nanos."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    nanos = args[1].cast("long") if len(args) > 1 else lit(0)
    per = {"fromepoch": 1, "fromepochseconds": 1, "fromepochmillis": 1000, "fromepochmicros": 1_000_000, "fromepochnanos": NANO}[name]
    seconds, part = div(args[0].cast("long"), per), (args[0].cast("long") % per) * (NANO // per)
    days, rest = div(seconds, DAY), (seconds % DAY) * NANO + part + nanos
    return zoned(let(rest, lambda r: at_nanos(F.date_add(start.cast("date"), days.cast("int")), r)), F.lit(0), F.lit(None).cast("string"))


# --- text ------------------------------------------------------------------------------------------------------


def clock_text(nanos: Column) -> Column:
    part = nanos % NANO
    shown = F.format_string("%02d:%02d", div(nanos, 3600 * NANO), div(nanos, 60 * NANO) % 60)
    seconds = F.format_string(":%02d", div(nanos, NANO) % 60)
    fraction = F.when(part % 1_000_000 == 0, F.format_string(".%03d", div(part, 1_000_000))).when(part % 1000 == 0, F.format_string(".%06d", div(part, 1000))).otherwise(F.format_string(".%09d", part))
    return F.concat(shown, F.when(nanos % (60 * NANO) != 0, seconds).otherwise(""), F.when(part != 0, fraction).otherwise(""))


def date_text(x: Column) -> Column:
    """Year, month and day; a year after 9999 has no sign, as in the reference and strftime, which Spark gives it."""
    return F.ltrim(x.cast("date").cast("string"), F.lit("+"))


def text(x: Column, t: T.DataType) -> Column:
    return let(x, lambda v: plain_text(v, t))


def plain_text(x: Column, t: T.DataType) -> Column:
    kind = kind_of(t)
    if kind == "date":
        return date_text(x)
    if kind == "duration":
        part = lambda n, unit: F.when(n != 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
        m, d, s, n = (x[f] for f in ("months", "days", "seconds", "nanos"))
        fraction = F.when(n != 0, F.concat(F.lit("."), F.rtrim(F.format_string("%09d", F.abs(n)), F.lit("0")))).otherwise("")
        sign = F.when((s % 60 == 0) & (n < 0), "-").otherwise("")
        second = F.when((s % 60 != 0) | (n != 0), F.concat(sign, (s % 60).cast("string"), fraction, F.lit("S"))).otherwise("")
        day = F.concat(part(div(m, 12), "Y"), part(m % 12, "M"), part(d, "D"))
        clock = F.concat(part(div(s, 3600), "H"), part(div(s, 60) % 60, "M"), second)
        body = F.concat(day, let(clock, lambda c: F.when(c != "", F.concat(F.lit("T"), c)).otherwise("")))
        return F.concat(F.lit("P"), let(body, lambda c: F.when(c == "", F.lit("T0S")).otherwise(c)))
    clock = let(nanos_of_day(x, t), clock_text)
    if kind in ("time", "localtime"):
        return F.concat(clock, offset_text(x["offset"])) if kind == "time" else clock
    out = F.concat(date_text(local(x, t)), F.lit("T"), clock)
    if kind == "localdatetime":
        return out
    return F.concat(out, offset_text(x["offset"]), F.coalesce(F.concat(F.lit("["), x["zone"], F.lit("]")), F.lit("")))


CURRENT = {"currentdate": "date", "currenttime": "time", "currentdatetime": "datetime", "currenttimestamp": "epoch"}


def call(name: str, args: list[tuple[Column, T.DataType]], fields: dict[str, tuple[Column, T.DataType]] | None, unit: str | None) -> Column | None:
    """A temporal function by its lower-case name, or None if it is none. fields: of a map argument; unit: truncate's."""
    base, _, more = name.partition(".")
    if name in CURRENT:
        return component(now("datetime"), T.StructType([T.StructField(c, T.TimestampNTZType()) for c in ("instant", "offset", "zone")]), "epochMillis") if CURRENT[name] == "epoch" else now(CURRENT[name])
    if base not in KINDS:
        return None
    if more in ("transaction", "statement", "realtime"):
        return now(base)
    if more == "truncate":
        return truncate(base, unit, *args[0], fields or {})
    if more in ("between", "inmonths", "indays", "inseconds"):
        return between(*args[0], *args[1], more)
    if more.startswith("fromepoch"):
        return epoch(more, [x for x, _ in args])
    if more:
        return None
    if fields is not None:
        return from_fields(base, fields)
    if not args:
        return now(base)
    if base == "date" and len(args) == 3:
        return F.make_date(*[x.cast("int") for x, _ in args])
    if base in ("datetime", "localdatetime") and len(args) == 2:
        return from_fields(base, {"date": args[0], "time": args[1]})
    return convert(base, *args[0])
