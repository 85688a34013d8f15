"""What a schema is judged over: one interface for VARIANT Columns, typed Columns and parsed documents.

A verdict is a truth: a bool where it is known while the schema is compiled, a Column where it depends on the row, and, for parsed
documents alone, Asked where it is true if the JVM says yes to some questions, or None where it hangs on them otherwise. The rules in `veridoc.plans.schema` are written once against this
interface, so that all three ways of judging follow the same rules.

A missing value is SQL NULL (or MISSING), a JSON null is a variant null (or None). Of typed Columns a null field is missing, as it
is when a row is written as JSON; a null within an array or a map is a JSON null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable
from types import LambdaType
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.plans.registry import TYPES, BigInt, SchemaError, is_number, java_pattern

Truth = Any  # bool | Column | Asked | None
#: No value, as opposed to a JSON null.
MISSING = type("Missing", (), {"__repr__": lambda self: "MISSING"})()
RECORD = "struct<keyword:string,expected:string,schema_path:string,data_path:string,value:string>"


def all_of(parts: Iterable[Any]) -> Truth:
    """Conjunction; parts may be functions, which are called one after another until one is false."""
    out: Truth = True
    for p in parts:
        if isinstance(p, LambdaType):
            p = p()
        if p is True:
            continue
        if p is False:
            return False
        out = p if out is True or p is None or out is None else out & p
    return out


def any_of(parts: Iterable[Any]) -> Truth:
    out: Truth = False
    for p in parts:
        p = p() if isinstance(p, LambdaType) else p
        if p is True:
            return True
        if p is False:
            continue
        out = p if out is False or p is None or out is None else out | p
    return out


def negate(t: Truth) -> Truth:
    return t if t is None else not t if isinstance(t, bool) else ~t


def implies(test: Truth, then: Callable[[], Truth]) -> Truth:
    return any_of([negate(test), then])


def choose(test: Truth, yes: Callable[[], Truth], no: Callable[[], Truth]) -> Truth:
    if isinstance(test, bool):
        return yes() if test else no()
    a, b = yes(), no()
    if test is None or isinstance(test, Asked):
        return a if isinstance(a, bool) and a is b else None
    return any_of([all_of([test, a]), all_of([~test, b])])


def exactly_one(parts: list[Truth]) -> Truth:
    sure, rest = sum(p is True for p in parts), [p for p in parts if not isinstance(p, bool)]
    if sure > 1:
        return False
    if not rest:
        return sure == 1
    if any(p is None or isinstance(p, Asked) for p in rest):
        return None
    if isinstance(rest[0], Unbuilt):
        return rest[0]
    return sum((p.cast("int") for p in rest), F.lit(sure)) == 1


def column(t: Truth) -> Column:
    return F.lit(t) if isinstance(t, bool) else t


class Unbuilt:
    """Stands for a Column where a schema is only measured."""

    def _same(self, *_: Any) -> Unbuilt:
        return self

    __and__ = __rand__ = __or__ = __ror__ = __invert__ = __le__ = __lt__ = __ge__ = __gt__ = __eq__ = __add__ = _same
    __hash__ = None


class Asked:
    """True if every one of some questions to the JVM gets a yes; anything but a conjunction of them is None."""

    def __init__(self, *questions: tuple[int, str | None]) -> None:
        self.questions = questions

    def __and__(self, other: Asked) -> Asked:
        return Asked(*dict.fromkeys(self.questions + other.questions))

    def __or__(self, other: Asked) -> None:
        return None

    def __invert__(self) -> None:
        return None


class Found:
    """Records over Columns: single ones, each null where the keyword holds, and arrays of them."""

    def __init__(self) -> None:
        self.single: list[Column] = []
        self.many: list[Column] = []

    def add(self, ok: Truth, record: Callable[[], Column]) -> None:
        if ok is not True:
            self.single.append(record() if ok is False else F.when(~ok, record()))

    def under(self, test: Truth, other: Found) -> None:
        if test is not False:
            guard = (lambda c: c) if test is True else (lambda c: F.when(test, c))
            self.single += [guard(c) for c in other.single]
            self.many += [F.coalesce(guard(c), nothing()) for c in other.many]

    def each(self, made: Column) -> None:
        """An array of arrays of records."""
        self.many.append(F.coalesce(F.flatten(made), nothing()))

    def all(self) -> Column:
        single = [F.filter(F.array(*self.single), lambda e: e.isNotNull())] if self.single else []
        return F.concat(*single, *self.many) if len(single + self.many) > 1 else (single + self.many or [nothing()])[0]


class Told:
    """Records of a parsed document; a record with an open question is left out, as it is judged again."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, ...]] = []

    def add(self, ok: Truth, record: Callable[[], tuple[str, ...]]) -> None:
        if ok is False:
            self.rows.append(record())

    def under(self, test: Truth, other: Told) -> None:
        if test is not False:
            self.rows += other.rows


def nothing() -> Column:
    return F.array().cast(f"array<{RECORD}>")


def escaped(key: Any) -> Any:
    """A key as a part of a JSON pointer."""
    if isinstance(key, str):
        return key.replace("~", "~0").replace("/", "~1")
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


class OverColumns:
    """What VARIANT and typed Columns have in common."""

    found = Found
    missing: Truth

    def record(self, keyword: str, expected: Any, schema_path: str, at: Column) -> Column:
        parts = (F.lit(keyword).alias("keyword"), F.lit(json.dumps(expected, default=str)).alias("expected"), F.lit(schema_path).alias("schema_path"), at.alias("data_path"), self.json().alias("value"))
        return F.struct(*parts)

    @staticmethod
    def below(at: Column, part: Any) -> Column:
        return F.concat(at, F.lit("/" + escaped(part))) if isinstance(part, str) else F.concat(at, F.lit("/"), escaped(part.cast("string")))

    @staticmethod
    def root() -> Column:
        return F.lit("")

    # Of texts.
    def units(self, code_points: bool) -> Column:
        return F.length(self.text()) if code_points else (F.length(F.encode(self.text(), "UTF-16BE")) / 2).cast("int")

    def matches(self, pattern: str) -> Truth:
        return self.text().rlike(java_pattern(pattern))

    def one_of(self, names: Iterable[str]) -> Truth:
        names = list(names)
        return self.text().isin(*names) if names else False

    # Of numbers.
    def whole(self) -> Column:
        return self.double() % 1 == 0

    def multiple(self, step: float) -> Truth:
        return self.double() % F.lit(float(step)) == 0 if step else False

    def is_any(self, names: Iterable[str]) -> Truth:
        return any_of([self.is_(n) for n in names])

    def among(self, properties: dict[str, Any]) -> Iterable[tuple[str, Any]]:
        """Those of the properties that may be there."""
        return properties.items()

    def fits(self, names: Iterable[str]) -> Truth:
        """Missing or of one of the types."""
        return any_of([self.missing, self.is_any(names)])


class Variant(OverColumns):
    """A VARIANT Column, or what lies at a path in one."""

    #: Recursive schemas are unrolled to some depth.
    bounded = False

    def __init__(self, root: Column, path: str = "$") -> None:
        self._root, self._path = root, path
        self.value = root if path == "$" else F.try_variant_get(root, path, "variant")

    @property
    def missing(self) -> Column:
        return self.value.isNull()

    def _as(self, kind: str) -> Column:
        return F.try_variant_get(self._root, self._path, kind)

    def _tag(self) -> Column:
        return F.coalesce(F.schema_of_variant(self.value), F.lit(""))

    def is_(self, name: str) -> Truth:
        if name == "null":
            return F.coalesce(F.is_variant_null(self.value), F.lit(False))
        if name in ("boolean", "string"):
            return self._tag() == name.upper()
        if name == "number":
            return self._tag().rlike(r"\A(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        if name == "integer":
            return self.is_("number") & F.coalesce(self.whole(), F.lit(False))
        if name in ("object", "array", "tuple"):
            # a cast that reads no more than the keys or the kinds of items, where the schema of a variant goes through all below
            return self._as("struct<>" if name == "object" else "array<struct<>>").isNotNull()
        return _never(name)

    def text(self) -> Column:
        return self._as("string")

    def double(self) -> Column:
        return self._as("double")

    def boolean(self) -> Column:
        return self._as("boolean")

    def variant(self) -> Column:
        return self.value

    def beyond(self) -> Column:
        """The verdict where a schema is cut: null, unless nothing is there."""
        return F.when(self.missing, True)

    def json(self) -> Column:
        return F.to_json(self.value)

    def compare(self, op: str, bound: float) -> Truth:
        return _compared(self.double(), op, F.lit(_double(bound)))

    def equal(self, constant: Any) -> Truth:
        if constant is None:
            return self.is_("null")
        if isinstance(constant, BigInt):
            return False
        if isinstance(constant, bool):
            return (self._tag() == "BOOLEAN") & F.coalesce(self.boolean() == constant, F.lit(False))
        if is_number(constant):
            return self.is_("number") & F.coalesce(self.double() == float(constant), F.lit(False))
        if isinstance(constant, str):
            return (self._tag() == "STRING") & F.coalesce(self.text() == constant, F.lit(False))
        if isinstance(constant, list):
            every = [lambda k=k, x=x: self.item(k).equal(x) for k, x in enumerate(constant)]
            return all_of([self.is_("array"), F.coalesce(self.size() == len(constant), F.lit(False)), *every])
        every = [lambda k=k, x=x: self.get(k).equal(x) for k, x in constant.items()]
        return all_of([self.is_("object"), F.coalesce(self.n_keys() == len(constant), F.lit(False)), *every])

    # Of arrays.
    def _items(self) -> Column:
        return self._as("array<variant>")

    def size(self) -> Column:
        return F.size(self._items())

    def item(self, k: int) -> Variant:
        return Variant(F.get(self._items(), F.lit(k)))

    def _after(self, start: int) -> Column:
        a = self._items()
        return F.slice(a, start + 1, F.greatest(F.size(a) - start, F.lit(0))) if start else a

    def all_items(self, judge: Callable[[Any, Any], Truth], start: int = 0) -> Truth:
        truths = F.transform(self._after(start), lambda x, i: column(judge(Variant(x), i + start)))
        return F.forall(truths, lambda t: t)

    def count_items(self, judge: Callable[[Any], Truth], low: int, high: int | None) -> Truth:
        return _counted(F.transform(self._items(), lambda x: column(judge(Variant(x)))), low, high)

    def unique(self, spec: bool) -> Truth:
        a = self._items()
        if not spec:  # objects and arrays are always distinct from each other
            a = F.filter(a, lambda x: ~Variant(x).is_any(["object", "array"]))
        keys = F.transform(a, lambda x: F.when(Variant(x).is_("number"), Variant(x).double().cast("string")).otherwise(F.concat(F.lit("-"), F.to_json(x))))
        return F.size(F.array_distinct(keys)) == F.size(keys)

    def item_records(self, found: Found, at: Column, judge: Callable[[Any, Any, Column], Found], start: int = 0) -> None:
        found.each(F.transform(self._after(start), lambda x, i: judge(Variant(x), i + start, self.below(at, i + start)).all()))

    # Of objects.
    def _map(self) -> Column:
        return self._as("map<string,variant>")

    def n_keys(self) -> Column:
        return F.size(self._map())

    def get(self, key: str) -> Variant:
        """By a path where the key can stand in one, so that nothing is made of the other keys."""
        for quote in "'\"":
            if key and quote not in key:
                return Variant(self._root, f"{self._path}[{quote}{key}{quote}]")
        return Variant(F.try_element_at(self._map(), F.lit(key)))

    def has(self, key: str) -> Truth:
        return self.get(key).value.isNotNull()

    def all_entries(self, judge: Callable[[Any, Any], Truth]) -> Truth:
        return F.forall(F.map_entries(self._map()), lambda e: column(judge(Typed(e["key"], T.StringType()), Variant(e["value"]))))

    def entry_records(self, found: Found, at: Column, judge: Callable[[Any, Any, Column], Found]) -> None:
        found.each(F.transform(F.map_entries(self._map()), lambda e: judge(Typed(e["key"], T.StringType()), Variant(e["value"]), self.below(at, e["key"])).all()))


def _never(name: str) -> bool:
    if name in TYPES:
        return False
    raise SchemaError(f"unknown type {name!r}")


def _compared(value: Column, op: str, bound: Column) -> Column:
    return {">": value > bound, ">=": value >= bound, "<": value < bound, "<=": value <= bound}[op]


def _counted(truths: Column, low: int, high: int | None) -> Column:
    """Whether so many are true; null while that hangs on nulls."""
    sure, may = F.size(F.filter(truths, lambda t: t)), F.size(F.filter(truths, lambda t: F.coalesce(t, F.lit(True))))
    out = F.when(may < low, False).when(sure >= low, True)
    return out if high is None else out & F.when(sure > high, False).when(may <= high, True)


class Measured:
    """A value without Columns: by it a schema is unrolled only to see how wide it gets and whether it is cut."""

    bounded, missing = False, Unbuilt()

    def _truth(self, *_: Any, **__: Any) -> Unbuilt:
        return self.missing

    is_any = fits = text = double = boolean = variant = json = compare = multiple = equal = units = matches = size = n_keys = has = unique = beyond = _truth

    def is_(self, name: str) -> Truth:
        return self.missing if name in TYPES and name not in ("bigint", "map", "set", "regex") else _never(name)

    def one_of(self, names: Iterable[str]) -> Truth:
        return self.missing

    def among(self, properties: dict[str, Any]) -> Iterable[tuple[str, Any]]:
        return properties.items()

    def get(self, key: Any) -> Measured:
        return self

    item = get

    def all_items(self, judge: Callable[[Any, Any], Truth], start: int = 0) -> Truth:
        judge(self, self.missing)
        return self.missing

    def count_items(self, judge: Callable[[Any], Truth], low: int, high: int | None) -> Truth:
        judge(self)
        return self.missing

    def all_entries(self, judge: Callable[[Any, Any], Truth]) -> Truth:
        judge(self, self)
        return self.missing

    # Of records.
    found = property(lambda self: type(self))

    def add(self, ok: Truth, record: Any) -> None:
        pass

    under = each = add

    def item_records(self, found: Any, at: Any, judge: Callable[[Any, Any, Any], Any], start: int = 0) -> None:
        judge(self, self.missing, None)

    def entry_records(self, found: Any, at: Any, judge: Callable[[Any, Any, Any], Any]) -> None:
        judge(self, self, None)

    @staticmethod
    def root() -> None:
        return None

    @staticmethod
    def below(at: Any, part: Any) -> None:
        return None


class Typed(OverColumns):
    """A Column of a known type: what it can't be is known while the schema is compiled, and comparisons reach the scan.

    Numbers are compared as they are: 64-bit integers and decimals exactly. A DECIMAL without fraction and with more digits than
    64 bits hold is a bigint, and no number. Dates, times and binary values count as the texts that JSON has for them.
    """

    bounded = True

    def __init__(self, value: Column, kind: T.DataType, null: bool = False) -> None:
        self.value, self.kind, self._null = value, kind, null

    @property
    def missing(self) -> Truth:
        return False if self._null else self.value.isNull()

    def _here(self) -> Column:
        return self.value.isNotNull()

    def is_(self, name: str) -> Truth:
        if name == "null":
            return self.value.isNull() if self._null else False
        fits = {
            "boolean": isinstance(self.kind, T.BooleanType),
            "string": isinstance(self.kind, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)),
            "number": isinstance(self.kind, T.NumericType) and not self._big(),
            "bigint": self._big(),
            "object": isinstance(self.kind, (T.StructType, T.MapType)),
            "array": isinstance(self.kind, T.ArrayType),
            "tuple": isinstance(self.kind, T.ArrayType),
        }
        if name == "integer":
            if not fits["number"]:
                return False
            return self._here() if isinstance(self.kind, T.IntegralType) else F.coalesce(self.whole(), F.lit(False))
        if name not in fits:
            return _never(name)
        return self._here() if fits[name] else False

    def fits(self, names: Iterable[str]) -> Truth:
        names = list(names)
        sure = [n for n in names if n != "null" and self.is_(n) is not False and (n != "integer" or isinstance(self.kind, T.IntegralType))]
        if not sure:
            return super().fits(names)
        return self._here() if self._null and "null" not in names else True

    def _big(self) -> bool:
        return isinstance(self.kind, T.DecimalType) and self.kind.scale == 0 and self.kind.precision > 18

    def text(self) -> Column:
        if isinstance(self.kind, T.DateType):
            return F.date_format(self.value, "yyyy-MM-dd")
        if isinstance(self.kind, (T.TimestampType, T.TimestampNTZType)):
            return F.date_format(self.value, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX" if isinstance(self.kind, T.TimestampType) else "yyyy-MM-dd'T'HH:mm:ss.SSS")
        if isinstance(self.kind, T.BinaryType):
            return F.base64(self.value)
        return self.value if isinstance(self.kind, T.StringType) else F.lit(None).cast("string")

    def double(self) -> Column:
        return self.value.cast("double") if isinstance(self.kind, T.NumericType) else F.lit(None).cast("double")

    def boolean(self) -> Column:
        return self.value if isinstance(self.kind, T.BooleanType) else F.lit(None).cast("boolean")

    def variant(self) -> Column:
        """As custom formats take it."""
        return F.try_parse_json(self.json())

    def json(self) -> Column:
        if isinstance(self.kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(self.value)
        inner = F.to_json(F.array(self.value))
        return F.when(self.value.isNotNull(), F.substring(inner, 2, F.length(inner) - 2)).otherwise(F.lit("null") if self._null else F.lit(None))

    def whole(self) -> Column:
        return self.value % 1 == 0

    def compare(self, op: str, bound: float) -> Truth:
        whole = isinstance(bound, int) or math.isfinite(bound) and bound.is_integer()
        if self._big():
            literal = F.lit(str(int(bound))).cast("decimal(38,0)")
        elif whole and abs(bound) < 2**63 and isinstance(self.kind, (T.IntegralType, T.DecimalType)):
            literal = F.lit(int(bound))
        else:
            literal = F.lit(_double(bound))
        if isinstance(self.kind, (T.FloatType, T.DoubleType)) and op[0] == ">":  # NaN is the largest number here and obeys no bound
            return _compared(self.value, op, literal) & (self.value <= F.lit(math.inf))
        return _compared(self.value, op, literal)

    def multiple(self, step: float) -> Truth:
        if not step:
            return False
        if self._big():
            return self.value % F.lit(str(int(step))).cast("decimal(38,0)") == 0
        exact = isinstance(self.kind, (T.IntegralType, T.DecimalType)) and float(step).is_integer()
        return (self.value if exact else self.double()) % F.lit(int(step) if exact else float(step)) == 0

    def equal(self, constant: Any) -> Truth:
        if constant is None:
            return self.is_("null")
        if isinstance(constant, BigInt) or self._big():
            return self._here() & (self.value == F.lit(str(int(constant))).cast(self.kind)) if isinstance(constant, BigInt) and self._big() else False
        if isinstance(constant, bool):
            return self._here() & (self.value == constant) if isinstance(self.kind, T.BooleanType) else False
        if is_number(constant):
            literal = F.lit(constant if isinstance(constant, int) and abs(constant) < 2**63 else _double(constant))
            return self._here() & (self.value == literal) if isinstance(self.kind, T.NumericType) else False
        if isinstance(constant, str):
            return self._here() & (self.text() == constant) if self.is_("string") is not False else False
        if isinstance(constant, list):
            every = [lambda k=k, x=x: self.item(k).equal(x) for k, x in enumerate(constant)]
            return all_of([lambda: self.is_("array"), lambda: F.coalesce(self.size() == len(constant), F.lit(False)), *every])
        every = [lambda k=k, x=x: self.get(k).equal(x) for k, x in constant.items()]
        return all_of([lambda: self.is_("object"), lambda: F.coalesce(self.n_keys() == len(constant), F.lit(False)), *every])

    # Of arrays.
    def size(self) -> Column:
        return F.size(self.value)

    def item(self, k: int) -> Typed:
        inner = F.get(self.value, F.lit(k))
        return Typed(inner, self.kind.elementType, True) if isinstance(self.kind, T.ArrayType) else Typed(F.lit(None), T.NullType())

    def _after(self, start: int) -> Column:
        return F.slice(self.value, start + 1, F.greatest(F.size(self.value) - start, F.lit(0))) if start else self.value

    def all_items(self, judge: Callable[[Any, Any], Truth], start: int = 0) -> Truth:
        return F.forall(F.transform(self._after(start), lambda x, i: column(judge(Typed(x, self.kind.elementType, True), i + start))), lambda t: t)

    def count_items(self, judge: Callable[[Any], Truth], low: int, high: int | None) -> Truth:
        return _counted(F.transform(self.value, lambda x: column(judge(Typed(x, self.kind.elementType, True)))), low, high)

    def unique(self, spec: bool) -> Truth:
        if not spec and isinstance(self.kind.elementType, (T.StructType, T.ArrayType, T.MapType)):
            return True
        a = F.transform(self.value, F.to_json) if isinstance(self.kind.elementType, (T.StructType, T.MapType)) else self.value
        return F.size(F.array_distinct(a)) == F.size(a)

    def item_records(self, found: Found, at: Column, judge: Callable[[Any, Any, Column], Found], start: int = 0) -> None:
        found.each(F.transform(self._after(start), lambda x, i: judge(Typed(x, self.kind.elementType, True), i + start, self.below(at, i + start)).all()))

    # Of objects: fields are known while the schema is compiled.
    def _fields(self) -> list[tuple[str, Typed]]:
        return [(f.name, Typed(self.value[f.name], f.dataType)) for f in self.kind.fields]

    def n_keys(self) -> Column:
        if isinstance(self.kind, T.MapType):
            return F.size(self.value)
        return sum((x.value.isNotNull().cast("int") for _, x in self._fields()), F.lit(0))

    def get(self, key: str) -> Typed:
        if isinstance(self.kind, T.MapType):
            return Typed(F.try_element_at(self.value, F.lit(key)), self.kind.valueType, True)
        known = dict(self._fields()) if isinstance(self.kind, T.StructType) else {}
        return known.get(key) or Typed(F.lit(None), T.NullType())

    def has(self, key: str) -> Truth:
        if isinstance(self.kind, T.MapType):
            return F.coalesce(F.map_contains_key(self.value, key), F.lit(False))
        return isinstance(self.kind, T.StructType) and key in self.kind.fieldNames() and self.value[key].isNotNull()

    def all_entries(self, judge: Callable[[Any, Any], Truth]) -> Truth:
        if isinstance(self.kind, T.MapType):
            return F.forall(F.map_entries(self.value), lambda e: column(judge(Typed(e["key"], T.StringType()), Typed(e["value"], self.kind.valueType, True))))
        return all_of([lambda n=n, x=x: implies(x.value.isNotNull(), lambda: judge(Name(n), x)) for n, x in self._fields()])

    def entry_records(self, found: Found, at: Column, judge: Callable[[Any, Any, Column], Found]) -> None:
        if isinstance(self.kind, T.MapType):
            made = lambda e: judge(Typed(e["key"], T.StringType()), Typed(e["value"], self.kind.valueType, True), self.below(at, e["key"])).all()
            found.each(F.transform(F.map_entries(self.value), made))
            return
        for n, x in self._fields():
            found.under(x.value.isNotNull(), judge(Name(n), x, self.below(at, n)))


class Name(Typed):
    """The name of a field."""

    def __init__(self, name: str) -> None:
        super().__init__(F.lit(name), T.StringType())
        self.name = name

    def is_(self, name: str) -> Truth:
        return True if name == "string" else super().is_(name) is not False and False

    @property
    def missing(self) -> Truth:
        return False

    def one_of(self, names: Iterable[str]) -> Truth:
        return self.name in set(names)


class Book:
    """Questions to the JVM about values of parsed documents, and its answers."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.number = {rule: k for k, rule in enumerate(rules)}
        self.asked: dict[tuple[int, str | None], None] = {}
        self.answers: dict[tuple[int, str | None], bool] = {}

    def ask(self, kind: str, rule: str, value: Any) -> Truth:
        question = self.number[kind, rule], None if value is MISSING else json.dumps(value)
        if question in self.answers:
            return self.answers[question]
        self.asked[question] = None
        return Asked(question)


_KINDS = {"boolean": bool, "string": str, "object": dict, "array": list, "tuple": list}


class Plain:
    """A value of a parsed document."""

    bounded, found = True, Told

    def __init__(self, value: Any, book: Book) -> None:
        self.value, self.book = value, book

    @property
    def missing(self) -> bool:
        return self.value is MISSING

    def _of(self, value: Any) -> Plain:
        return Plain(value, self.book)

    def is_(self, name: str) -> bool:
        v = self.value
        if name in _KINDS:
            return isinstance(v, _KINDS[name])
        if name == "null":
            return v is None
        if name == "number":
            return is_number(v)
        if name == "integer":
            return is_number(v) and math.isfinite(self.double()) and self.double().is_integer()
        return _never(name)

    def is_any(self, names: Iterable[str]) -> bool:
        return any([self.is_(n) for n in names])

    def fits(self, names: Iterable[str]) -> bool:
        return self.missing or self.is_any(names)

    def double(self) -> float:
        return _double(self.value)

    def json(self) -> str:
        return json.dumps(self.value, separators=(",", ":"), ensure_ascii=False, sort_keys=True)

    def record(self, keyword: str, expected: Any, schema_path: str, at: str) -> tuple[str, ...]:
        return keyword, json.dumps(expected, default=str), schema_path, at, None if self.missing else self.json()

    @staticmethod
    def below(at: str, part: Any) -> str:
        return f"{at}/{escaped(str(part))}"

    @staticmethod
    def root() -> str:
        return ""

    def units(self, code_points: bool) -> int:
        return len(self.value) if code_points else len(self.value.encode("utf-16-be", "surrogatepass")) // 2

    def matches(self, pattern: str) -> Truth:
        return self.book.ask("pattern", pattern, self.value)

    def one_of(self, names: Iterable[str]) -> bool:
        return self.value in names

    def compare(self, op: str, bound: float) -> bool:
        d = self.double()
        return {">": d > bound, ">=": d >= bound, "<": d < bound, "<=": d <= bound}[op]

    def multiple(self, step: float) -> bool:
        return step != 0 and math.isfinite(self.double()) and math.fmod(self.double(), step) == 0

    def equal(self, constant: Any) -> bool:
        return same(self.value, constant)

    def size(self) -> int:
        return len(self.value)

    n_keys = size

    def item(self, k: int) -> Plain:
        return self._of(self.value[k] if k < len(self.value) else MISSING)

    def all_items(self, judge: Callable[[Any, Any], Truth], start: int = 0) -> Truth:
        return all_of([lambda i=i, x=x: judge(self._of(x), i) for i, x in enumerate(self.value) if i >= start])

    def count_items(self, judge: Callable[[Any], Truth], low: int, high: int | None) -> Truth:
        truths = [judge(self._of(x)) for x in self.value]
        sure, may = sum(t is True for t in truths), sum(t is not False for t in truths)
        if may < low or high is not None and sure > high:
            return False
        return True if sure >= low and (high is None or may <= high) else None

    def unique(self, spec: bool) -> bool:
        keys = [_canonical(x) for x in self.value if spec or not isinstance(x, (dict, list))]
        return len(set(keys)) == len(keys)

    def item_records(self, found: Told, at: str, judge: Callable[[Any, Any, str], Told], start: int = 0) -> None:
        for i, x in enumerate(self.value):
            if i >= start:
                found.rows += judge(self._of(x), i, self.below(at, i)).rows

    def get(self, key: str) -> Plain:
        return self._of(self.value.get(key, MISSING) if isinstance(self.value, dict) else MISSING)

    def has(self, key: str) -> bool:
        return isinstance(self.value, dict) and key in self.value

    def among(self, properties: dict[str, Any]) -> Iterable[tuple[str, Any]]:
        return [(k, properties[k]) for k in self.value if k in properties] if len(self.value) < len(properties) else properties.items()

    def all_entries(self, judge: Callable[[Any, Any], Truth]) -> Truth:
        return all_of([lambda k=k, x=x: judge(self._of(k), self._of(x)) for k, x in self.value.items()])

    def entry_records(self, found: Told, at: str, judge: Callable[[Any, Any, str], Told]) -> None:
        for k, x in sorted(self.value.items()):
            found.rows += judge(self._of(k), self._of(x), self.below(at, k)).rows


def _double(x: Any) -> float:
    try:
        return float(x)
    except OverflowError:
        return math.inf if x > 0 else -math.inf


def same(a: Any, b: Any) -> bool:
    """Deep equality, whatever the order of keys; numbers by value as doubles."""
    if is_number(a) and is_number(b):
        return _double(a) == _double(b)
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def _canonical(v: Any) -> Any:
    if is_number(v):
        return ("number", _double(v))
    if isinstance(v, list):
        return ("array", tuple(map(_canonical, v)))
    if isinstance(v, dict):
        return ("object", frozenset((k, _canonical(x)) for k, x in v.items()))
    return (type(v).__name__, v)
