"""Scalar functions of the query language as Spark columns. Each takes columns and their data types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CypherSyntaxError, CypherTypeError
from . import temporal

BLANKS = " \t\n\r"
INTEGRAL = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
NUMERIC = (*INTEGRAL, T.DoubleType, T.FloatType, T.DecimalType)


def is_list(t: T.DataType) -> bool:
    return isinstance(t, T.ArrayType)


def to_integer(x: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return F.when(x, F.lit(1)).when(~x, F.lit(0)).cast("long")
    number = F.trim(x).try_cast("double") if isinstance(t, T.StringType) else x.cast("double")
    return F.coalesce(F.trim(x).try_cast("long"), number.try_cast("long")) if isinstance(t, T.StringType) else number.try_cast("long")


def to_string(x: Column, t: T.DataType) -> Column:
    return temporal.text(x, t) if temporal.kind_of(t) else x.cast("string")


def to_boolean(x: Column, t: T.DataType) -> Column:
    if isinstance(t, T.BooleanType):
        return x
    return F.when(F.lower(x) == "true", True).when(F.lower(x) == "false", False)


def substring(s: Column, start: Column, length: Column | None = None) -> Column:
    return F.substring(s, start.cast("int") + 1, length.cast("int") if length is not None else F.lit(2**31 - 1))


def number_range(a: Column, b: Column, step: Column | None = None) -> Column:
    step = F.lit(1) if step is None else step
    a, b, step = a.cast("long"), b.cast("long"), step.cast("long")
    empty = F.array().cast("array<bigint>")
    ok = ((step > 0) & (a <= b)) | ((step < 0) & (a >= b))
    step = F.when(step == 0, F.raise_error(F.lit("NumberOutOfRange: step 0"))).otherwise(step)
    # the bounds of the branch not taken must still be legal
    return F.when(ok, F.sequence(a, F.when(ok, b).otherwise(a), F.when(ok, step).otherwise(F.lit(1)))).when(step.isNotNull(), empty)


def bounds(size: Column, low: Column | None, high: Column | None) -> tuple[Column, Column]:
    def place(x: Column | None, default: Column) -> Column:
        return default if x is None else F.greatest(F.lit(0), F.least(size, F.when(x < 0, size + x).otherwise(x)))

    start, end = place(low, F.lit(0)), place(high, size)
    return start.cast("int"), F.greatest(F.lit(0), end - start).cast("int")


def slice_of(x: Column, t: T.DataType, low: Column | None, high: Column | None) -> Column:
    if is_list(t):
        start, n = bounds(F.size(x), low, high)
        out = F.slice(x, start + 1, n)
    else:
        start, n = bounds(F.char_length(x), low, high)
        out = F.substring(x, start + 1, n)
    known = [y.isNotNull() for y in (low, high) if y is not None]
    return F.when(known[0] & known[-1], out) if known else out


SIMPLE = {
    "coalesce": F.coalesce, "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("long"), "floor": lambda x: F.floor(x).cast("long"), "round": lambda x: F.bround(x).cast("long"),
    "sign": lambda x: F.signum(x).cast("long"), "sqrt": lambda x: F.sqrt(x), "toupper": F.upper, "tolower": F.lower, "trim": lambda x: F.btrim(x, F.lit(BLANKS)),
    "ltrim": lambda x: F.ltrim(x, F.lit(BLANKS)), "rtrim": lambda x: F.rtrim(x, F.lit(BLANKS)), "replace": lambda s, a, b: F.replace(s, a, b), "rand": F.rand,
    "left": F.left, "right": F.right, "substring": substring, "range": number_range, "head": lambda x: F.get(x, F.lit(0)), "last": lambda x: F.get(x, F.size(x) - 1),
    "tail": lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x), F.lit(1))),
}
TYPED = {"tointeger": to_integer, "tostring": to_string, "toboolean": to_boolean}


def call(name: str, args: list[Column], types: list[T.DataType]) -> Column:
    if name in TYPED:
        return TYPED[name](args[0], types[0])
    if name == "tofloat":
        if isinstance(types[0], T.BooleanType):
            raise CypherTypeError("InvalidArgumentType", "toFloat of a boolean")
        return args[0].try_cast("double")
    if name == "size":
        return (F.when(args[0].isNotNull(), F.size(args[0])) if is_list(types[0]) else F.char_length(args[0])).cast("long")
    if name == "reverse":
        return F.reverse(args[0])
    if name == "split":
        return F.when(args[1] == "", F.split(args[0], "")).otherwise(F.split(args[0], F.concat(F.lit("\\Q"), args[1], F.lit("\\E"))))
    if name not in SIMPLE:
        raise CypherSyntaxError("UnknownFunction", name)
    return SIMPLE[name](*args)
