"""What a column's type says before any row is read: the type tests of the scalar library, on Spark's types."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.functions import formats

SCALARS = ("string", "number", "boolean", "integer", "bigint")


def is_scalar_name(name: str) -> bool:
    return name in SCALARS


def is_map(kind: T.DataType) -> bool:
    return isinstance(kind, T.MapType)


def is_object(kind: T.DataType) -> bool:
    """A struct or a map."""
    return isinstance(kind, (T.StructType, T.MapType))


def is_object_of(kind: T.DataType, cls: type[T.DataType]) -> bool:
    """Of that very class, not of one derived from it."""
    return type(kind) is cls


def is_array(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType)


def is_set(kind: T.DataType) -> bool:
    """Spark has no sets."""
    return False


def is_typed_array(kind: T.DataType) -> bool:
    """Binary, or an array of numbers of a fixed width without nulls."""
    fixed = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    return isinstance(kind, T.BinaryType) or isinstance(kind, T.ArrayType) and isinstance(kind.elementType, fixed) and not kind.containsNull


def is_arrayish(kind: T.DataType) -> bool:
    return is_array(kind) or is_typed_array(kind)


def is_bigint(kind: T.DataType) -> bool:
    """A DECIMAL without fraction and with more digits than 64 bits hold."""
    return isinstance(kind, T.DecimalType) and kind.scale == 0 and kind.precision > 18


def is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def is_dateish(value: Column, kind: T.DataType) -> Column:
    """A date, or a text that names one."""
    if is_date(kind):
        return value.isNotNull()
    if not isinstance(kind, T.StringType):
        return F.lit(False)
    return formats.is_date(value) | formats.is_date_time(value)


def object_or(kind: T.DataType, default: T.DataType | None = None) -> T.DataType | None:
    return kind if is_object(kind) else default


def array_or(kind: T.DataType, default: T.DataType | None = None) -> T.DataType | None:
    return kind if is_array(kind) else default


def callable_or(made: Any, fallback: Any = None) -> Callable[..., Any]:
    """What can be called of the two, or a judge that holds of everything."""
    return made if callable(made) else fallback if callable(fallback) else lambda *_: True


def with_callables(known: list[Callable[..., Any]], more: Any) -> list[Callable[..., Any]]:
    """The list with what can be called of one more or several."""
    several: Iterable[Any] = more if isinstance(more, (list, tuple)) else [more]
    return [*known, *(f for f in several if callable(f))]
