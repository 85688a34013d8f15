"""Scalar helpers as Columns: coercion of JSON values, text, arrays, whole numbers, floating-point neighbours, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veridoc.functions.formats import FLOATS, INTEGERS, SPACE, in_range

INF = float("inf")
# Smallest normal number, distance from 1 to the next, exponent bits and fraction bits of each width.
# Of 128 bits only the widths are known; the other three are 0.
FLOAT_MIN = {16: 2.0**-14, 32: 2.0**-126, 64: 2.0**-1022, 128: 0.0}
FLOAT_EPS = {16: 2.0**-10, 32: 2.0**-23, 64: 2.0**-52, 128: 0.0}
FLOAT_BITS = {16: (5, 10), 32: (8, 23), 64: (11, 52), 128: (15, 112)}
FLOAT_MAX = {16: FLOATS["float16"], 32: FLOATS["float32"], 64: FLOATS["float64"], 128: 0.0}
_SPACE = rf"[{SPACE}\x0B]"
TICKS_SECOND, TICKS_HOUR, TICKS_DAY = 1_000, 3_600_000, 86_400_000


# JSON values (VARIANT Columns). A missing value is SQL NULL.
def _tag(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit(""))


def js_number(v: Column) -> Column:
    """What the value counts as when a number is asked for: null 0, true 1, texts by their digits, "" 0; null for what is none."""
    s = F.regexp_replace(F.try_variant_get(v, "$", "string"), rf"\A{_SPACE}+|{_SPACE}+\z", "")
    digits = F.when(s == "", 0.0).when(s.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), s.try_cast("double"))
    digits = digits.when(s.rlike(r"\A0[xX][0-9a-fA-F]{1,15}\z"), F.conv(F.substring(s, 3, 15), 16, 10).try_cast("double")).when(s.rlike(r"\A[+-]?Infinity\z"), F.when(s.startswith("-"), -INF).otherwise(INF))
    tag = _tag(v)
    out = F.when(F.coalesce(F.is_variant_null(v), F.lit(False)), 0.0).when(tag == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
    return out.when(tag == "STRING", digits).when(tag.rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))


def is_numbish(v: Column) -> Column:
    return js_number(v).isNotNull()


def is_intish(v: Column) -> Column:
    d = js_number(v)
    return F.coalesce((d == F.floor(d)) & (F.abs(d) < INF), F.lit(False))


def is_boolish(v: Column) -> Column:
    """true and false, as values or as texts."""
    return (_tag(v) == "BOOLEAN") | (_tag(v) == "STRING") & F.coalesce(F.try_variant_get(v, "$", "string").isin("true", "false"), F.lit(False))


def boolish(v: Column) -> Column:
    """The value where it is boolish, as it is (a text stays one); null else."""
    return F.when(is_boolish(v), v)


def intish(v: Column) -> Column:
    """The whole number that the value counts as; null else."""
    return F.when(is_intish(v), js_number(v))


def whole_number(x: Column) -> Column:
    """A bigint: a DECIMAL without fraction; null for fractions."""
    return F.when(x % 1 == 0, x.cast("decimal(38,0)"))


def value_of(v: Column, kind: str) -> Column:
    """The value if it is of the JSON type (string, boolean, number, integer, object, array), null else."""
    tests = {"string": _tag(v) == "STRING", "boolean": _tag(v) == "BOOLEAN", "object": _tag(v).startswith("OBJECT"), "array": _tag(v).startswith("ARRAY")}
    number = _tag(v).rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    tests |= {"number": number, "integer": number & F.coalesce(F.try_variant_get(v, "$", "double") % 1 == 0, F.lit(False))}
    return F.when(tests[kind], v)


def is_scalar(v: Column) -> Column:
    return _tag(v).rlike(r"\A(STRING|BOOLEAN|BIGINT|DECIMAL|DOUBLE|FLOAT)")


def equals_deep(a: Column, b: Column) -> Column:
    """Deep equality of two VARIANT Columns, whatever the order of keys; 1, 1.0 and 1e0 are equal. Two missing values are equal."""
    return canonical(a).eqNullSafe(canonical(b))


def canonical(v: Column) -> Column:
    """One text for all writings of a value: keys sorted, numbers without a fraction of zeros and without an exponent of zero."""
    text = F.to_json(v)
    # strings are kept as they are: a number is what follows a colon, comma, bracket or the start outside quotes
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*+")|(?<=[0-9])\.0+(?=[,\]}]|\z)|(?<=[0-9])(?:\.0+)?[eE]\+?0+(?=[,\]}]|\z)', "$1")


# Arrays and maps.
def is_unique(a: Column) -> Column:
    return F.size(F.array_distinct(a)) == F.size(a)


unique_array, map_merge, set_merge = F.array_distinct, F.map_concat, F.array_union


def includes_all(a: Column, values: Column) -> Column:
    return F.size(F.array_except(values, a)) == 0


# Text.
def is_empty(s: Column) -> Column:
    return F.coalesce(s == "", F.lit(False))


def is_blank(s: Column) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(s.rlike(rf"\A{_SPACE}*+\z"), F.lit(True))


# Whole numbers.
def bigint_min(*xs: Column) -> Column:
    return F.least(*xs)


def bigint_max(*xs: Column) -> Column:
    return F.greatest(*xs)


def bigint_min_max(*xs: Column) -> Column:
    return F.array(F.least(*xs), F.greatest(*xs))


def is_valid_int(x: Column, bits: int, signed: bool = True) -> Column:
    """A whole number within the width; 64 bits are limited to what a double holds exactly."""
    name = f"{'' if signed else 'u'}int{bits}"
    if name not in INTEGERS:
        raise ValueError(f"no integers of {bits} bits")
    return in_range(x.cast("double"), name)


# Floating point.
def is_valid_float(x: Column, bits: int) -> Column:
    return in_range(x.cast("double"), f"float{bits}")


def valid_float(x: Column, bits: int, default: float = float("nan")) -> Column:
    """The number; infinity beyond the largest of the width (not at 64 bits), the default for NaN and null."""
    x = x.cast("double")
    out = F.when(x.isNull() | F.isnan(x), default)
    return out.otherwise(x) if bits == 64 else out.when(x < -FLOAT_MAX[bits], -INF).when(x > FLOAT_MAX[bits], INF).otherwise(x)


def _ulp(x: Column, bits: int) -> Column:
    """2 to the power (log2 x - fraction bits - 1): 0 for 0, NaN below."""
    return F.when(x == 0, 0.0).when((x < 0) | F.isnan(x), float("nan")).otherwise(F.pow(F.lit(2.0), F.log2(x) - (FLOAT_BITS[bits][1] + 1)))


def increment(x: Column, bits: int) -> Column:
    """The number plus its relative step; infinity beyond the largest of the width."""
    up = x + _ulp(x, bits)
    return up if bits == 64 else F.when(~F.isnan(up) & (up > FLOAT_MAX[bits]), INF).otherwise(up)


def decrement(x: Column, bits: int) -> Column:
    down = x - _ulp(x, bits)
    return down if bits == 64 else F.when(down < -FLOAT_MAX[bits], -INF).otherwise(down)


# Dates.
def is_leap_year(year: Column) -> Column:
    return (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))


def days_in_month(year: Column, month: Column) -> Column:
    return F.when(month == 2, F.when(is_leap_year(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).when(month.between(1, 12), 31)


def is_date_in_range(year: Column, month: Column, day: Column) -> Column:
    return F.coalesce((day >= 1) & (day <= days_in_month(year, month)), F.lit(False))


def is_time_in_range(hour: Column, minute: Column, second: Column, zone_hour: Column, zone_minute: Column) -> Column:
    """Within a day, or 23:59:60; zones within 23:59."""
    inside = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59) | (hour == 23) & (minute == 59) & (second == 60)
    return F.coalesce(inside & zone_hour.between(0, 23) & zone_minute.between(0, 59), F.lit(False))
