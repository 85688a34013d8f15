"""Schemas as plans: a JSON Schema document becomes one boolean Column over a VARIANT Column or over typed Columns.

The schema is resolved on the driver and turned into ordinary expressions, so that Catalyst plans validation like any filter. The
rules stand here once, over the values of `veridoc.plans.values`; what a finite expression can't hold (documents that nest deeper
than a recursive schema was unrolled, schemas with very many nodes) is judged by the same rules over parsed documents.

Verdicts are total, as `not`, `oneOf` and `if` negate what stands below them. Only where a recursive reference was cut is the
expression null, if the verdict hangs on what lies beyond.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterable, Iterator
from functools import wraps
from typing import Any, NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.functions import formats
from veridoc.plans.registry import BigInt, Registry, SchemaError, big_bounds, bounds, is_number, limit, numberish
from veridoc.plans.values import MISSING, RECORD, Asked, Book, Measured, Plain, Truth, Typed, Variant, all_of, any_of, choose, column, exactly_one, implies, negate, nothing

#: Keywords that are judged together; an error names the first one that the schema has.
GROUPS = [
    *(("type", "nullable"), ("nullable", "type"), ("const",), ("enum",), ("minimum", "exclusiveMinimum"), ("exclusiveMinimum", "minimum"), ("maximum", "exclusiveMaximum"), ("exclusiveMaximum", "maximum"), ("multipleOf",)),
    *(("minLength",), ("maxLength",), ("pattern",), ("format", "formatMinimum", "formatExclusiveMinimum", "formatMaximum", "formatExclusiveMaximum", "strictFormat")),
    *(("minItems",), ("maxItems",), ("uniqueItems",), ("contains", "minContains", "maxContains"), ("minProperties",), ("maxProperties",), ("required",), ("dependentRequired",), ("anyOf",), ("oneOf",), ("not",)),
]
FORMAT = ("format", "formatMinimum", "formatExclusiveMinimum", "formatMaximum", "formatExclusiveMaximum", "strictFormat")
#: Nodes that a schema may unroll to; beyond them the same rules run over parsed documents.
NODES = 3_000
#: Frames that a parsed document may take: the JVM's parser allows 1,000 levels.
FRAMES = 60_000
#: Marks that a record lies beyond the depth to which a recursive schema was unrolled.
CUT = "$cut"
#: The keywords that each group of rules reads, in the order that the groups are asked; one without any of them is passed over.
READ = {
    "_referred": ("$ref", "$dynamicRef", "$recursiveRef"),
    "_basic": ("required", "type", "nullable", "const", "enum"),
    "_numbers": ("minimum", "exclusiveMinimum", "maximum", "exclusiveMaximum", "multipleOf"),
    "_strings": ("minLength", "maxLength", "pattern"),
    "_format": FORMAT,
    "_arrays": ("minItems", "maxItems", "uniqueItems", "items", "prefixItems", "additionalItems", "contains", "unevaluatedItems"),
    "_objects": ("minProperties", "maxProperties", "required", "properties", "patternProperties", "propertyNames", "additionalProperties", "unevaluatedProperties", "dependentRequired", "dependentSchemas", "dependencies"),
    "_combined": ("allOf", "anyOf", "oneOf", "not", "if"),
}
#: Keywords that would change a verdict and aren't known.
UNKNOWN = ("$data",)


class TooWide(SchemaError):
    """Unrolled, the schema has too many nodes for one expression."""


class Where(NamedTuple):
    """Base URI; targets of the references around; schemas entered for this very value; bases entered on the way."""

    base: str = ""
    trail: tuple[int, ...] = ()
    here: tuple[int, ...] = ()
    scope: tuple[str, ...] = ("",)

    def inside(self) -> Where:
        return Where(self.base, self.trail, (), self.scope)


def _conjunction(rules: Callable[..., Iterable[Any]]) -> Callable[..., Truth]:
    """All that a group of rules yields."""
    return wraps(rules)(lambda self, schema, v, where: all_of(rules(self, schema, v, where)))


class Rules:
    """What the keywords ask of a value. mode "compat" keeps the reference engine's rules, "spec" those of JSON Schema where they differ."""

    def __init__(self, schema: Any, others: dict[str, Any] | None = None, mode: str = "compat", custom: dict[str, Callable[[Column], Column]] | None = None, depth: int = 6) -> None:
        if mode not in ("compat", "spec"):
            raise SchemaError(f"unknown mode {mode!r}")
        self.registry, self.schema, self.spec, self.custom, self.depth = Registry(schema, others), schema, mode == "spec", custom or {}, depth
        self.mode, self.others, self.cut, self.nodes = mode, others, False, 0
        self._shapes: dict[bool, tuple[bool, bool]] = {}
        self._read: dict[int, tuple[dict, tuple[Callable[..., Any], ...]]] = {}
        self._tests: dict[int, tuple[dict, list[Callable[[Any, Where, Where], Truth]]]] = {}
        self._formats: dict[int, tuple[dict, str]] = {}
        self._groups: dict[int, tuple[dict, list[tuple[tuple[str, ...], dict]]]] = {}

    def __getstate__(self) -> dict[str, Any]:
        """Without what is kept by identity, as copies have another one."""
        return self.__dict__ | {"_read": {}, "_tests": {}, "_formats": {}, "_groups": {}}

    def judge(self, v: Any) -> Truth:
        """The verdict. `cut` tells afterwards whether a recursive reference was cut at `depth` levels."""
        self.nodes, self.cut = 0, False
        return self._schema(self.schema, v, Where())

    def records(self, v: Any) -> Any:
        """A record of (keyword, expected, schema path, data path, value) for each keyword that fails; none where the verdict is true.

        What lies below a keyword is told apart by its paths. A failed anyOf or oneOf gives a record of its own and those of its
        branches; not, contains and the keywords that ask for names give one record.
        """
        self.nodes, self.cut = 0, False
        return self._records(self.schema, v, Where(), "#", v.root())

    def shape(self, records: bool = False) -> tuple[bool, bool]:
        """(whether the schema is too wide for an expression, whether it is cut at `depth` levels), without building one."""
        if records not in self._shapes:
            try:
                (self.records if records else self.judge)(Measured())
                self._shapes[records] = False, self.cut
            except TooWide:
                self._shapes[records] = True, False
        return self._shapes[records]

    # References.
    def _entered(self, schema: dict, v: Any, where: Where) -> Where:
        if id(schema) in where.here:
            raise SchemaError("a reference leads back to itself")
        self.nodes += 1
        if not v.bounded and self.nodes > NODES:
            raise TooWide("more than an expression should hold")
        if self.spec and (known := [k for k in UNKNOWN if k in schema]):
            raise SchemaError(f"{known[0]} isn't known")
        if isinstance(schema.get("$id"), str):
            base = urljoin(where.base, schema["$id"]).rstrip("#")
            where = where._replace(base=base, scope=(*where.scope, base))
        return Where(where.base, where.trail, (*where.here, id(schema)), where.scope)

    def _references(self, schema: dict, where: Where) -> Iterator[tuple[str, Any, str]]:
        """(keyword, target, base of what it holds) of each reference."""
        for keyword in READ["_referred"] if self.spec else ("$ref",):
            if keyword not in schema:
                continue
            ref = schema[keyword]
            if not (isinstance(ref, str) and ref.strip()):
                continue
            target, to = self.registry.find(ref, where.base)
            if keyword == "$recursiveRef" and isinstance(target, dict) and target.get("$recursiveAnchor") is True:
                outer = [(self.registry.ids[b], b) for b in where.scope if isinstance(self.registry.ids.get(b), dict) and self.registry.ids[b].get("$recursiveAnchor") is True]
                target, to = outer[0] if outer else (target, to)
            if keyword == "$dynamicRef" and isinstance(target, dict) and isinstance(name := target.get("$dynamicAnchor"), str) and ref.endswith(f"#{name}"):
                outer = [(self.registry.dynamic[b, name], b) for b in where.scope if (b, name) in self.registry.dynamic]
                target, to = outer[0] if outer else (target, to)
            yield keyword, target, to

    def _followed(self, target: Any, to: str, where: Where) -> Where:
        return Where(to, (*where.trail, id(target)), where.here, where.scope if to == where.scope[-1] else (*where.scope, to))

    def _beyond(self, target: Any, v: Any, where: Where) -> bool:
        """Whether a reference goes deeper than the schema is unrolled."""
        deep = not v.bounded and where.trail.count(id(target)) >= self.depth
        self.cut |= deep
        return deep

    # Verdicts.
    def _schema(self, schema: Any, v: Any, where: Where) -> Truth:
        if isinstance(schema, bool):
            return schema
        if not isinstance(schema, dict):
            raise SchemaError("a schema is an object or a boolean")
        where = self._entered(schema, v, where)

        asked = self._asked(schema)
        return asked[0](schema, v, where) if len(asked) == 1 else all_of([lambda f=f: f(schema, v, where) for f in asked])

    def _asked(self, schema: dict) -> tuple[Callable[..., Truth], ...]:
        """The groups of rules that the schema has keywords of."""
        if id(schema) not in self._read:  # kept with the schema, so that no other one can get its id
            types = schema.get("type")
            types = {types} if isinstance(types, str) else set(types or ())
            left = {name for kind, name in (("set", "_arrays"), ("map", "_objects")) if kind in types}
            asked = [getattr(self, name) for name, keywords in READ.items() if name not in left and not schema.keys().isdisjoint(keywords)]
            self._read[id(schema)] = schema, tuple(asked)
        return self._read[id(schema)][1]

    def _referred(self, schema: dict, v: Any, where: Where) -> Truth:
        def follow(target: Any, to: str) -> Truth:
            if self._beyond(target, v, where):
                return v.beyond()
            return self._schema(target, v, self._followed(target, to, where))

        return all_of(follow(t, to) for _, t, to in self._references(schema, where))

    @_conjunction
    def _basic(self, schema: dict, v: Any, where: Where) -> Iterator[Truth]:
        if schema.get("required") is True:
            yield negate(v.missing)
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
            if not names:
                raise SchemaError("type lists nothing")
            names = ["null" if n is None else n for n in dict.fromkeys(names)]
            if schema.get("nullable") is True:
                names.append("null")
            yield v.fits(dict.fromkeys(names))
        elif schema.get("nullable") is False:
            yield negate(v.is_("null"))
        if "const" in schema:
            yield v.equal(schema["const"])
        if isinstance(schema.get("enum"), list) and schema["enum"]:
            yield any_of([v.missing, *(lambda x=x: v.equal(x) for x in schema["enum"])])

    @_conjunction
    def _numbers(self, schema: dict, v: Any, where: Where) -> Iterator[Truth]:
        plain, big = [], []
        for name, exclusive, sign in (("minimum", "exclusiveMinimum", ">"), ("maximum", "exclusiveMaximum", "<")):
            plain += [(sign if strict else sign + "=", bound) for bound, strict in bounds(schema, name, exclusive, self.spec)]
            big += [(sign if strict else sign + "=", bound) for bound, strict in big_bounds(schema, name, exclusive)]
        step = schema.get("multipleOf", MISSING)
        divisor = numberish(step, self.spec) if step is not MISSING else None
        if plain or divisor is not None:
            tests = [*(lambda op=op, b=b: v.compare(op, b) for op, b in plain), *([lambda: v.multiple(divisor)] if divisor is not None else [])]
            yield _where_true(v.is_("number"), v, tests)
        if big or isinstance(step, BigInt):
            tests = [*(lambda op=op, b=b: v.compare(op, b) for op, b in big), *([lambda: v.multiple(int(step))] if isinstance(step, BigInt) else [])]
            yield _where_true(v.is_("bigint"), v, tests)

    @_conjunction
    def _strings(self, schema: dict, v: Any, where: Where) -> Iterator[Truth]:
        low, high, pattern = limit(schema, "minLength", self.spec), limit(schema, "maxLength", self.spec), schema.get("pattern")
        tests: list[Callable[[], Truth]] = []
        if low is not None:
            tests.append(lambda: v.units(self.spec) >= low)
        if high is not None:
            tests.append(lambda: v.units(self.spec) <= high)
        if "pattern" in schema:
            if not isinstance(pattern, str):
                raise SchemaError("pattern is not a string")
            tests.append(lambda: v.matches(pattern))
        if tests:
            text = v.is_("string")
            yield implies(text, lambda: all_of(tests)) if self.spec else all_of([text, *tests])

    def _format(self, schema: dict, v: Any, where: Where) -> Truth:
        name = schema.get("format")
        if not isinstance(name, str):
            return True
        if name not in self.custom and name not in formats.NAMES:
            raise SchemaError(f"unknown format {name!r}")
        if isinstance(v, Plain):
            return v.book.ask("format", self._rule_of(schema), v.value)
        if isinstance(v, Measured):
            return v.missing
        if name in self.custom:
            return F.coalesce(self.custom[name](v.variant()), F.lit(False))
        if name in formats.INTEGERS or name in formats.FLOATS:
            return self._number_format(schema, v, name)
        text = v.is_("string")
        if text is False:
            return True
        s = v.text()
        if name not in formats.DATES:
            return implies(text, lambda: (formats.strings() | formats.REFLECTED)[name](s))
        tests, at = [formats.DATES[name](s)], formats.instant(s, name)
        for key, test in (("formatMinimum", lambda b: at >= b), ("formatExclusiveMinimum", lambda b: at > b), ("formatMaximum", lambda b: at <= b), ("formatExclusiveMaximum", lambda b: at < b)):
            if isinstance(schema.get(key), str):
                tests.append(F.coalesce(test(formats.instant(F.lit(schema[key]), name)), F.lit(False)))
        return implies(text, lambda: all_of(tests))

    def _rule_of(self, schema: dict) -> str:
        if id(schema) not in self._formats:
            self._formats[id(schema)] = schema, _rule(schema)
        return self._formats[id(schema)][1]

    @staticmethod
    def _number_format(schema: dict, v: Any, name: str) -> Truth:
        """Numbers within a format; texts and booleans that stand for numbers too, unless strictFormat is true."""
        number = F.lit(None).cast("double")
        if (is_ := v.is_("number")) is not False:
            number = F.when(is_, v.double())
        if schema.get("strictFormat") is not True:
            if (text := v.is_("string")) is not False:
                s = v.text()
                digits = F.coalesce(s.rlike(r"\A\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"), F.lit(False))
                number = F.coalesce(number, F.when(text & (F.trim(s) == ""), 0.0).when(text & digits, F.trim(s).try_cast("double")))
            if (flag := v.is_("boolean")) is not False:
                number = F.coalesce(number, F.when(flag, v.boolean().cast("double")))
        return any_of([v.missing, v.is_("null"), formats.in_range(number, name)])

    def _tuple(self, schema: dict) -> tuple[list[Any], Any, str, str]:
        """Schemas by position, that of the rest, and the keywords they stand under."""
        items, prefix = schema.get("items"), schema.get("prefixItems")
        if isinstance(prefix, list) and prefix:
            return prefix, items, "prefixItems", "items"
        if isinstance(items, list) and items:
            return items, schema.get("additionalItems"), "items", "additionalItems"
        return [], None if isinstance(items, list) else items, "", "items"

    def _arrays(self, schema: dict, v: Any, where: Where) -> Truth:
        if (is_array := v.is_("array")) is False:
            return True
        inside, tests = where.inside(), list(self._sizes(schema, v, "minItems", "maxItems", v.size))
        if schema.get("uniqueItems") is True:
            tests.append(lambda: v.unique(self.spec))
        prefix, rest, *_ = self._tuple(schema)
        for k, s in enumerate(prefix):
            tests.append(lambda k=k, s=s: any_of([v.size() <= k, lambda: self._schema(s, v.item(k), inside)]))
        if rest is False or isinstance(rest, dict) and rest:
            if rest is False and (not prefix or not self.spec and "prefixItems" in schema):
                tests.append(lambda: v.size() == 0)
            elif rest is False:
                tests.append(lambda: v.size() <= len(prefix))
            else:
                tests.append(lambda: v.all_items(lambda x, i: self._schema(rest, x, inside), len(prefix)))
        contains = schema.get("contains")
        if isinstance(contains, bool):
            tests.append(lambda: v.size() > 0 if contains else False)
        elif isinstance(contains, dict):
            low, high = schema.get("minContains"), schema.get("maxContains")
            tests.append(lambda: v.count_items(lambda x: self._schema(contains, x, inside), int(low) if is_number(low) else 1, int(high) if is_number(high) else None))
        left = schema.get("unevaluatedItems")
        if self.spec and isinstance(left, (dict, bool)) and left is not True:
            tests.append(lambda: v.all_items(lambda x, i: any_of([lambda: self._seen_item(schema, v, x, i, where), lambda: self._schema(left, x, inside)])))
        return implies(is_array, lambda: all_of(tests)) if tests else True

    def _sizes(self, schema: dict, v: Any, low: str, high: str, size: Callable[[], Any]) -> Iterator[Callable[[], Truth]]:
        least, most = limit(schema, low, self.spec), limit(schema, high, self.spec)
        if least is not None and most is not None and most < least:
            raise SchemaError(f"{high} is less than {low}")
        if least is not None:
            yield lambda: size() >= least
        if most is not None:
            yield lambda: size() <= most

    def _objects(self, schema: dict, v: Any, where: Where) -> Truth:
        if (is_object := v.is_("object")) is False:
            return True
        inside, tests = where.inside(), self._object_tests(schema)
        if is_object is True and len(tests) == 1:
            return tests[0](v, where, inside)
        return implies(is_object, lambda: all_of([lambda t=t: t(v, where, inside) for t in tests])) if tests else True

    def _object_tests(self, schema: dict) -> list[Callable[[Any, Where, Where], Truth]]:
        """What the schema asks of an object: functions of the value, the place and the place inside; made once."""
        if id(schema) in self._tests:
            return self._tests[id(schema)][1]
        tests: list[Callable[[Any, Where, Where], Truth]] = []
        if "minProperties" in schema or "maxProperties" in schema:
            tests.append(lambda v, where, inside: all_of(list(self._sizes(schema, v, "minProperties", "maxProperties", v.n_keys))))
        if isinstance(schema.get("required"), list):
            tests += [lambda v, where, inside, k=k: v.has(k) for k in schema["required"]]
        properties, patterns = schema.get("properties") or {}, schema.get("patternProperties") or {}
        if properties:
            tests.append(lambda v, where, inside: self._properties(properties, v, inside))
        names = schema.get("propertyNames")
        if isinstance(names, (dict, bool)) and names is not True:
            tests.append(lambda v, where, inside: v.all_entries(lambda k, x: self._schema(names, k, inside)))
        tests += [lambda v, where, inside, p=p, s=s: v.all_entries(lambda k, x: implies(k.matches(p), lambda: self._schema(s, x, inside))) for p, s in patterns.items()]
        extra, left = schema.get("additionalProperties"), schema.get("unevaluatedProperties")
        if isinstance(extra, (dict, bool)) and extra is not True:
            tests.append(lambda v, where, inside: v.all_entries(lambda k, x: any_of([lambda: self._named(schema, k), lambda: self._schema(extra, x, inside)])))
        if isinstance(left, (dict, bool)) and left is not True:
            if self.spec:
                tests.append(lambda v, where, inside: v.all_entries(lambda k, x: any_of([lambda: self._seen_key(schema, v, k, where), lambda: self._schema(left, x, inside)])))
            elif not isinstance(extra, (dict, bool)):
                tests.append(lambda v, where, inside: any_of([v.n_keys() == 0, lambda: self._schema(left, v, where)]))
        for name in ("dependentRequired", "dependentSchemas", "dependencies"):
            for key, rule in (schema.get(name) or {}).items():
                if isinstance(rule, list):
                    tests.append(lambda v, where, inside, key=key, rule=rule: implies(v.has(key), lambda: all_of([v.has(k) for k in rule])))
                else:
                    tests.append(lambda v, where, inside, key=key, rule=rule: implies(v.has(key), lambda: self._schema(rule, v, where)))
        self._tests[id(schema)] = schema, tests
        return tests

    def _properties(self, properties: dict[str, Any], v: Any, inside: Where) -> Truth:
        if not isinstance(v, Plain):
            return all_of([lambda k=k, s=s: implies(v.has(k), lambda: self._schema(s, v.get(k), inside)) for k, s in properties.items()])
        return all_of(self._schema(s, v.get(k), inside) for k, s in v.among(properties) if v.has(k))

    def _named(self, schema: dict, key: Any) -> Truth:
        """Whether properties or patternProperties have the key."""
        return any_of([key.one_of(schema.get("properties") or {}), *(lambda p=p: key.matches(p) for p in schema.get("patternProperties") or {})])

    @_conjunction
    def _combined(self, schema: dict, v: Any, where: Where) -> Iterator[Any]:
        below = lambda s: self._schema(s, v, where)
        if isinstance(schema.get("allOf"), list) and schema["allOf"]:
            yield any_of([v.missing, lambda: all_of([lambda s=s: below(s) for s in schema["allOf"]])])
        if isinstance(schema.get("anyOf"), list) and schema["anyOf"]:
            yield any_of([v.missing, *(lambda s=s: below(s) for s in schema["anyOf"])])
        if isinstance(schema.get("oneOf"), list) and schema["oneOf"]:
            yield exactly_one([below(s) for s in schema["oneOf"]])
        negated = schema.get("not")
        if isinstance(negated, bool):
            yield not negated
        elif isinstance(negated, dict):
            yield any_of([v.missing, lambda: negate(below(negated))])
        if isinstance(schema.get("if"), (dict, bool)) and ("then" in schema or "else" in schema):
            yield choose(below(schema["if"]), lambda: below(schema.get("then", True)), lambda: below(schema.get("else", True)))

    # What keywords have judged, for the unevaluated ones.
    def _seen(self, schema: Any, v: Any, where: Where, own: Callable[[dict, Where], Iterable[Any]]) -> Truth:
        """Whether `own` holds in the schema or in one that it applies to the same value, as far as that one holds."""
        if not isinstance(schema, dict):
            return False
        where = self._entered(schema, v, where)
        again = lambda s, at=where: self._seen(s, v, at, own)
        holds = lambda s: self._schema(s, v, where)
        parts = [*own(schema, where)]
        parts += [lambda t=t, to=to: again(t, self._followed(t, to, where)) for _, t, to in self._references(schema, where)]
        parts += [lambda s=s: again(s) for s in schema.get("allOf") or ()]
        parts += [lambda s=s: all_of([lambda: holds(s), lambda: again(s)]) for name in ("anyOf", "oneOf") for s in schema.get(name) or ()]
        parts += [lambda k=k, s=s: all_of([v.has(k), lambda: again(s)]) for name in ("dependentSchemas", "dependencies") for k, s in (schema.get(name) or {}).items() if isinstance(s, dict)]
        if isinstance(test := schema.get("if"), (dict, bool)):
            parts.append(lambda: all_of([lambda: holds(test), lambda: any_of([lambda: again(test), lambda: again(schema.get("then"))])]))
            parts.append(lambda: all_of([lambda: negate(holds(test)), lambda: again(schema.get("else"))]))
        return any_of(parts)

    def _seen_key(self, schema: dict, v: Any, key: Any, where: Where) -> Truth:
        def own(s: dict, at: Where) -> Iterator[Any]:
            whole = ("additionalProperties",) if s is schema else ("additionalProperties", "unevaluatedProperties")
            if any(isinstance(s.get(k), (dict, bool)) for k in whole):
                yield True
            yield lambda: self._named(s, key)

        return self._seen(schema, v, where._replace(here=where.here[:-1]), own)

    def _seen_item(self, schema: dict, v: Any, item: Any, index: Any, where: Where) -> Truth:
        def own(s: dict, at: Where) -> Iterator[Any]:
            prefix, rest, *_ = self._tuple(s)
            if isinstance(rest, (dict, bool)) or s is not schema and isinstance(s.get("unevaluatedItems"), (dict, bool)):
                yield True
            if prefix:
                yield index < len(prefix)
            if isinstance(contains := s.get("contains"), (dict, bool)):
                yield lambda: self._schema(contains, item, at.inside())

        return self._seen(schema, v, where._replace(here=where.here[:-1]), own)

    # Records.
    def _records(self, schema: Any, v: Any, where: Where, path: str, at: Any) -> Any:
        found = v.found()
        if not isinstance(schema, dict):
            found.add(self._schema(schema, v, where), lambda: v.record("" if path == "#" else path.rsplit("/", 1)[1], schema, path, at))
            return found
        where = self._entered(schema, v, where)
        again = lambda s, key, x=v, to=at, i=where: self._records(s, x, i, f"{path}/{key}", to)
        for keyword, target, to in self._references(schema, where):
            if self._beyond(target, v, where):
                found.add(v.missing, lambda: v.record(CUT, None, path, at))
            else:
                found.under(True, self._records(target, v, self._followed(target, to, where), f"{path}/{keyword}", at))
        if schema.get("required") is True:
            found.add(negate(v.missing), lambda: v.record("required", True, f"{path}/required", at))
        for group, part in self._grouped(schema):
            ok = self._schema(part, v, where)
            found.add(ok, lambda group=group: v.record(group[0], schema[group[0]], f"{path}/{group[0]}", at))
            if group[0] in ("anyOf", "oneOf") and ok is not True and isinstance(schema[group[0]], list):
                for k, s in enumerate(schema[group[0]]):
                    found.under(negate(ok), again(s, f"{group[0]}/{k}"))
        if (is_array := v.is_("array")) is not False:
            found.under(is_array, self._array_records(schema, v, where, path, at))
        if (is_object := v.is_("object")) is not False:
            found.under(is_object, self._object_records(schema, v, where, path, at))
        for k, s in enumerate(schema.get("allOf") or ()):
            found.under(negate(v.missing), again(s, f"allOf/{k}"))
        if isinstance(schema.get("if"), (dict, bool)) and ("then" in schema or "else" in schema):
            test = self._schema(schema["if"], v, where)
            for key, side in (("then", test), ("else", negate(test))):
                if side is not False:
                    found.under(side, again(schema.get(key, True), key))
        return found

    def _grouped(self, schema: dict) -> list[tuple[tuple[str, ...], dict]]:
        """The keywords of the schema that are judged together, each time the same objects."""
        if id(schema) not in self._groups:
            named, parts = set(), []
            for group in GROUPS:
                if group[0] not in schema or group[0] in named:
                    continue
                named.update(group)
                part = {k: schema[k] for k in group if k in schema}
                if part.get("required") is True:
                    continue
                if group == ("dependentRequired",) and isinstance(schema.get("dependencies"), dict):
                    part["dependencies"] = {k: r for k, r in schema["dependencies"].items() if isinstance(r, list)}
                parts.append((group, part))
            self._groups[id(schema)] = schema, parts
        return self._groups[id(schema)][1]

    def _array_records(self, schema: dict, v: Any, where: Where, path: str, at: Any) -> Any:
        found, inside = v.found(), where.inside()
        types = schema.get("type")
        if "set" in ({types} if isinstance(types, str) else set(types or ())):
            return found
        prefix, rest, before, after = self._tuple(schema)
        for k, s in enumerate(prefix):
            is_there = negate(v.size() <= k)
            if is_there is not False:
                found.under(is_there, self._records(s, v.item(k), inside, f"{path}/{before}/{k}", v.below(at, str(k))))
        if rest is False and (not prefix or not self.spec and "prefixItems" in schema):
            found.add(v.size() == 0, lambda: v.record(after, False, f"{path}/{after}", at))
        elif rest is False or isinstance(rest, dict) and rest:
            v.item_records(found, at, lambda x, i, to: self._records(rest, x, inside, f"{path}/{after}", to), len(prefix))
        left = schema.get("unevaluatedItems")
        if self.spec and isinstance(left, (dict, bool)) and left is not True:

            def one(x: Any, i: Any, to: Any) -> Any:
                out, seen = v.found(), self._seen_item(schema, v, x, i, where)
                out.under(negate(seen), self._records(left, x, inside, f"{path}/unevaluatedItems", to))
                return out

            v.item_records(found, at, one)
        return found

    def _object_records(self, schema: dict, v: Any, where: Where, path: str, at: Any) -> Any:
        found, inside = v.found(), where.inside()
        types = schema.get("type")
        if "map" in ({types} if isinstance(types, str) else set(types or ())):
            return found

        def entries(keyword: str, rule: Any, applies: Callable[[Any], Truth], names: bool = False) -> None:
            def one(k: Any, x: Any, to: Any) -> Any:
                out, test = v.found(), applies(k)
                if test is not False:
                    out.under(test, self._records(rule, k if names else x, inside, f"{path}/{keyword}", to))
                return out

            v.entry_records(found, at, one)

        for key, s in v.among(schema.get("properties") or {}):
            if (has := v.has(key)) is not False:
                found.under(has, self._records(s, v.get(key), inside, f"{path}/properties/{_part(key)}", v.below(at, key)))
        if isinstance(names := schema.get("propertyNames"), (dict, bool)) and names is not True:
            entries("propertyNames", names, lambda k: True, names=True)
        for pattern, s in (schema.get("patternProperties") or {}).items():
            entries(f"patternProperties/{_part(pattern)}", s, lambda k, p=pattern: k.matches(p))
        extra, left = schema.get("additionalProperties"), schema.get("unevaluatedProperties")
        if isinstance(extra, (dict, bool)) and extra is not True:
            entries("additionalProperties", extra, lambda k: negate(self._named(schema, k)))
        if isinstance(left, (dict, bool)) and left is not True:
            if self.spec:
                entries("unevaluatedProperties", left, lambda k: negate(self._seen_key(schema, v, k, where)))
            elif not isinstance(extra, (dict, bool)):
                found.under(v.n_keys() > 0, self._records(left, v, where, f"{path}/unevaluatedProperties", at))
        for name in ("dependentSchemas", "dependencies"):
            for key, rule in (schema.get(name) or {}).items():
                has = v.has(key)
                if isinstance(rule, list):
                    if name == "dependencies" and "dependentRequired" not in schema:
                        found.add(implies(has, lambda rule=rule: all_of([v.has(k) for k in rule])), lambda key=key, rule=rule: v.record("dependencies", rule, f"{path}/dependencies/{_part(key)}", at))
                elif has is not False:
                    found.under(has, self._records(rule, v, where, f"{path}/{name}/{_part(key)}", at))
        return found

    # Questions that parsed documents have for the JVM.
    def rules(self) -> list[tuple[str, str]]:
        """Every pattern and format in the schemas."""
        out: dict[tuple[str, str], None] = {}

        def walk(node: Any) -> None:
            if isinstance(node, dict):
                if isinstance(node.get("pattern"), str):
                    out["pattern", node["pattern"]] = None
                if isinstance(node.get("format"), str) and (node["format"] in self.custom or node["format"] in formats.NAMES):
                    out["format", _rule(node)] = None
                if isinstance(node.get("patternProperties"), dict):
                    out.update({("pattern", p): None for p in node["patternProperties"]})
                for x in node.values():
                    walk(x)
            elif isinstance(node, list):
                for x in node:
                    walk(x)

        walk([self.schema, *(self.others or {}).values()])
        return list(out)

    def answer(self, rule: tuple[str, str], text: Column) -> Column:
        """What the JVM says of a value, given as JSON."""
        v = Variant(F.try_parse_json(text))
        return F.coalesce(v.matches(rule[1]) if rule[0] == "pattern" else column(self._format(json.loads(rule[1]), v, Where())), F.lit(False))


def _rule(schema: dict) -> str:
    return json.dumps({k: schema[k] for k in FORMAT if k in schema}, sort_keys=True, default=str)


def _part(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def _where_true(fits: Truth, v: Any, tests: list[Callable[[], Truth]]) -> Truth:
    """The tests where the value is of their kind. Of a typed Column the only other case is that it is missing."""
    if isinstance(v, Typed) and fits is not False:
        return all_of([any_of([v.value.isNull(), t]) for t in tests])
    return implies(fits, lambda: all_of(tests))


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice")
    return out


def _refuse(name: str) -> None:
    raise ValueError(name)


#: Made once, as a decoder costs more than a short document.
_DECODE = json.JSONDecoder(object_pairs_hook=_unique, parse_constant=_refuse).decode


def parse(text: str | None) -> Any:
    """A JSON document; MISSING for null, malformed text and texts that name a key twice."""
    try:
        return MISSING if text is None else _DECODE(text)
    except ValueError:
        return MISSING


def _deep() -> None:
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)


def ask_session(rules: Rules, questions: list[tuple[tuple[str, str], str | None]]) -> list[bool]:
    """Answers to questions on patterns and formats by the running session, in one small query."""
    spark = SparkSession.active()
    return list(spark.range(1).select(*(rules.answer(rule, F.lit(value).cast("string")).alias(f"a{k}") for k, (rule, value) in enumerate(questions))).first())


def judge_document(rules: Rules, document: Any) -> bool:
    """The verdict on a parsed document on the driver."""
    _deep()
    listed = rules.rules()
    book = Book(listed)
    if not isinstance(verdict := rules.judge(Plain(document, book)), bool):
        asked = list(book.asked)
        book.answers = dict(zip(asked, ask_session(rules, [(listed[k], value) for k, value in asked]), strict=True))
        verdict = rules.judge(Plain(document, book))
    return verdict


class Validator:
    """A compiled schema for Columns of JSON text, of VARIANT values or of typed values.

    A null text is a missing document. A text that isn't JSON, or that names a key of an object twice, is no document at all: it is
    invalid under every schema, with one record of the keyword `parse`.

    Judged by one expression, in which a text is parsed once. Only rows whose verdict hangs on what lies deeper than a recursive
    schema was unrolled, and all rows of a schema too wide to unroll, are judged as parsed documents, in Arrow batches; patterns and
    formats are left to the JVM there too, so that the way that a row takes can't change its verdict.
    """

    def __init__(self, schema: Any, others: dict[str, Any] | None = None, mode: str = "compat", custom: dict[str, Callable[[Column], Column]] | None = None, depth: int = 6) -> None:
        self.rules = Rules(schema, others, mode, custom, depth)

    @staticmethod
    def parse(text: Column) -> Column:
        """The text as a variant; null where it isn't JSON."""
        return F.try_parse_json(text)

    # Parsed documents.
    def _asking(self, text: Column, records: bool) -> Column:
        """(verdict, records as JSON, rules asked, values asked, joined): what can be told without the JVM, and what has to be asked.

        joined: the verdict is true if all answers are.
        """
        rules = self._lean()
        listed = rules.rules()
        known: dict[str, tuple] = {}

        @F.pandas_udf("verdict boolean, found string, rule array<int>, value array<string>, joined boolean")
        def asking(texts: pd.Series) -> pd.DataFrame:
            _deep()
            return pd.DataFrame([_told_once(known, rules, listed, t, records) for t in texts], columns=["verdict", "found", "rule", "value", "joined"]).astype({"verdict": object, "joined": object})

        return asking(text)

    def _answered(self, text: Column, asked: Column, answers: Column, records: bool) -> Column:
        rules = self._lean()
        listed = rules.rules()

        @F.pandas_udf("verdict boolean, found string")
        def answered(texts: pd.Series, numbers: pd.Series, values: pd.Series, given: pd.Series) -> pd.DataFrame:
            _deep()
            out = []
            for t, n, x, a in zip(texts, numbers, values, given, strict=True):
                book = Book(listed)
                if t is not None:
                    book.answers = dict(zip(zip(n, x, strict=True), [bool(y) for y in a], strict=True))
                out.append(_told(rules, book, t, records)[:2])
            return pd.DataFrame(out, columns=["verdict", "found"]).astype({"verdict": object})

        return answered(text, asked["rule"], asked["value"], answers)

    def _lean(self) -> Rules:
        """The rules without what can't leave the driver."""
        r = self.rules
        return Rules(r.schema, r.others, r.mode, dict.fromkeys(r.custom, str), r.depth)

    def _parsed(self, text: Column, records: bool) -> Column:
        """(verdict, records as JSON) of documents; null texts give nothing."""
        first, listed = self._asking(text, records), self.rules.rules()
        if not listed:
            return first

        def answer(q: Column) -> Column:
            out = None
            for k, rule in enumerate(listed):
                said = self.rules.answer(rule, q["value"])
                out = F.when(q["rule"] == k, said) if out is None else out.when(q["rule"] == k, said)
            return out

        answers = F.transform(F.arrays_zip(first["rule"], first["value"]), answer)
        open_, joined = F.size(first["rule"]) > 0, first["joined"]
        second = self._answered(F.when(open_ & ~joined, text), first, answers, records)
        told = lambda verdict, found: F.struct(verdict.alias("verdict"), found.alias("found"))
        return F.when(open_ & joined, told(F.forall(answers, lambda a: a), first["found"])).when(open_, told(second["verdict"], second["found"])).otherwise(told(first["verdict"], first["found"]))

    # Verdicts and records over a VARIANT value, with the text that it was made of.
    def _variant_verdict(self, v: Column) -> Column:
        return column(self.rules.judge(Variant(v)))

    def _verdict(self, v: Column, text: Column, once: bool) -> Column:
        """once: v is an expression, to be made once. Each row goes one way only: the shallow ones by the expression."""
        wide, cut = self.rules.shape()
        once = F.get(F.transform(F.array(v), self._variant_verdict), F.lit(0)) if once and not wide else None if wide else self._variant_verdict(v)
        if not (wide or cut):
            return once
        missing, deep = judge_document(self.rules, MISSING), F.lit(True) if wide else self._may_be_deep(text)
        told = self._parsed(F.when(v.isNotNull() & deep, text), False)["verdict"]
        out = F.when(v.isNull(), missing)
        return out.otherwise(told) if wide else out.when(deep, told).otherwise(once)

    def _may_be_deep(self, text: Column) -> Column:
        """Whether a document may nest deeper than the schema is unrolled: none nests deeper than it has brackets."""
        return F.length(text) - F.length(F.translate(text, "{[", "")) >= self.rules.depth

    def valid(self, text: Column) -> Column:
        """The verdict on each text."""
        v = self.parse(text)
        if not any(self.rules.shape()):
            judged = F.transform(F.array(v), lambda x: (text.isNull() | x.isNotNull()) & self._variant_verdict(x))
            return F.get(judged, F.lit(0))
        return (text.isNull() | v.isNotNull()) & self._verdict(v, text, once=True)

    def valid_variant(self, v: Column) -> Column:
        """The verdict on each VARIANT value."""
        return self._verdict(v, F.to_json(v), once=False)

    def valid_typed(self, value: Column, kind: T.DataType) -> Column:
        """The verdict on each value of a typed Column: a plain predicate."""
        return column(self.rules.judge(Typed(value, kind)))

    def _missing_records(self) -> Column:
        return F.from_json(F.lit(_told(self.rules, Book(self.rules.rules()), None, True, missing=True)[1]), f"array<{RECORD}>")

    def _found(self, v: Column, text: Column) -> Column:
        wide, cut = self.rules.shape(records=True)
        if wide:
            deep, found = v.isNotNull(), F.when(v.isNull(), self._missing_records()).otherwise(nothing())
        else:
            found = self.rules.records(Variant(v)).all()
            if not cut:
                return found
            deep = F.exists(found, lambda e: e["keyword"] == CUT)
        may = v.isNotNull() & (F.lit(True) if wide else self._may_be_deep(text))
        told = self._parsed(F.when(may, text), True)["found"]
        return F.when(deep, F.from_json(told, f"array<{RECORD}>")).otherwise(found)

    def errors(self, text: Column) -> Column:
        """What is wrong with each document: an array of records, to be kept beside it or exploded.

        A record is (keyword, expected, schema_path, data_path, value); expected and value are JSON, the paths JSON pointers. value is
        null where the document is missing.
        """
        return self._errors(self.parse(text), text)

    def _errors(self, v: Column, text: Column) -> Column:
        lost = F.array(F.struct(F.lit("parse").alias("keyword"), F.lit('"JSON"').alias("expected"), F.lit("#").alias("schema_path"), F.lit("").alias("data_path"), F.to_json(F.array(text)).substr(F.lit(2), F.length(F.to_json(F.array(text))) - 2).alias("value")))
        return F.when(text.isNotNull() & v.isNull(), lost).otherwise(self._found(v, text))

    def errors_variant(self, v: Column) -> Column:
        return self._found(v, F.to_json(v))

    def errors_typed(self, value: Column, kind: T.DataType) -> Column:
        return self.rules.records(Typed(value, kind)).all()

    # Tables. A document is a column of JSON text, of VARIANT values or of typed values; an object of SQL expressions by key; or, when
    # nothing is named, the whole row.
    def _judged(self, df: DataFrame, name: str | dict[str, str] | None, into: str) -> DataFrame:
        """df with the verdict; a text is parsed in a projection of its own."""
        if isinstance(name, str) and isinstance(df.schema[name].dataType, T.StringType):
            parsed, held = self._held(df, name)
            ok = (F.col(name).isNull() | F.col(held).isNotNull()) & self._verdict(F.col(held), F.col(name), once=False)
            return parsed.select(*(F.col(f"`{c}`") for c in df.columns if c != into), ok.alias(into))
        return df.withColumn(into, self._predicate(df, name))

    def _held(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        """df with the parsed text in a projection of its own, and the name of that column."""
        held = "veridoc_parsed"
        while held in df.columns:
            held += "_"
        return df.withColumn(held, self.parse(F.col(name))), held

    @staticmethod
    def _row(df: DataFrame, name: dict[str, str] | None) -> _Row:
        if name is None:
            return _Row(df.schema.fields, [F.col(f"`{c}`") for c in df.columns])
        made = [F.expr(e) for e in name.values()]
        return _Row(df.select(*(e.alias(k) for k, e in zip(name, made, strict=True))).schema.fields, made)

    def _predicate(self, df: DataFrame, name: str | dict[str, str] | None) -> Column:
        if not isinstance(name, str):
            return column(self.rules.judge(self._row(df, name)))
        kind = df.schema[name].dataType
        if isinstance(kind, T.StringType):
            return self.valid(F.col(name))
        return self.valid_variant(F.col(name)) if isinstance(kind, T.VariantType) else self.valid_typed(F.col(name), kind)

    def mark(self, df: DataFrame, name: str | dict[str, str] | None = None, into: str = "valid") -> DataFrame:
        """df, a table or a stream, with the verdict on each row."""
        return self._judged(df, name, into)

    def filter(self, df: DataFrame, name: str | dict[str, str] | None = None) -> DataFrame:
        """The valid rows. Over typed values the predicate reaches the scan."""
        return df.where(self._predicate(df, name))

    def split(self, df: DataFrame, name: str | dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(valid rows, rows for quarantine)."""
        ok = self._predicate(df, name)
        return df.where(ok), df.where(~ok)

    def report(self, df: DataFrame, name: str | dict[str, str] | None = None, *by: str) -> DataFrame:
        """Rows and valid rows of each group."""
        judged = self._judged(df, name, "veridoc_valid").select(*by, "veridoc_valid")
        return judged.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("veridoc_valid").alias("n_valid"))

    def with_errors(self, df: DataFrame, name: str | dict[str, str] | None = None, into: str = "errors", timed: bool = False) -> DataFrame:
        """df with the records of each row; `timed` adds the time of the query (of the batch, on a stream) to each record."""
        columns = None
        if not isinstance(name, str):
            found = self.rules.records(self._row(df, name)).all()
        elif isinstance(kind := df.schema[name].dataType, T.StringType):
            columns = [c for c in df.columns if c != into]
            df, held = self._held(df, name)
            found = self._errors(F.col(held), F.col(name))
        else:
            found = self.errors_variant(F.col(name)) if isinstance(kind, T.VariantType) else self.errors_typed(F.col(name), kind)
        if timed:
            names = ("keyword", "expected", "schema_path", "data_path", "value")
            found = F.transform(found, lambda e: F.struct(*(e[n].alias(n) for n in names), F.current_timestamp().alias("time")))
        # Held for non-deterministic, so that the filter on their number, which inline brings along, isn't worked out again from the text
        # for all rows before these records are made, and below any exchange at that.
        found = F.when(F.spark_partition_id() >= 0, found).otherwise(nothing())
        return df.withColumn(into, found) if columns is None else df.select(*(F.col(f"`{c}`") for c in columns), found.alias(into))


class _Row(Typed):
    """Columns as an object, without a struct being made of them."""

    def __init__(self, fields: list[T.StructField], columns: list[Column]) -> None:
        super().__init__(F.lit(True), T.StructType(fields))
        self._columns = dict(zip((f.name for f in fields), columns, strict=True))

    @property
    def missing(self) -> Truth:
        return False

    def is_(self, name: str) -> Truth:
        return name == "object" or super().is_(name)

    def _fields(self) -> list[tuple[str, Typed]]:
        return [(f.name, Typed(self._columns[f.name], f.dataType)) for f in self.kind.fields]

    def has(self, key: str) -> Truth:
        return key in self._columns and self._columns[key].isNotNull()

    def json(self) -> Column:
        return F.to_json(F.struct(*(c.alias(n) for n, c in self._columns.items())))


#: Texts of at most so many characters are looked up among as many that were judged before: documents often repeat.
KNOWN = 4_096


def _told_once(known: dict[str, tuple], rules: Rules, listed: list[tuple[str, str]], text: str | None, records: bool) -> tuple:
    if text is None or len(text) > KNOWN:
        return _told(rules, Book(listed), text, records)
    if (out := known.get(text)) is None:
        out = _told(rules, Book(listed), text, records)
        if len(known) >= KNOWN:
            known.clear()
        known[text] = out
    return out


def _told(rules: Rules, book: Book, text: str | None, records: bool, missing: bool = False) -> tuple[bool | None, str | None, list[int], list[str | None], bool]:
    """(verdict, records as JSON, rules asked, values asked, whether the verdict is true if all answers are)."""
    if text is None and not missing:
        return None, None, [], [], False
    v = Plain(parse(text), book)
    verdict, found = rules.judge(v), None
    if isinstance(verdict, Asked) and not records:
        return None, None, [q[0] for q in verdict.questions], [q[1] for q in verdict.questions], True
    sure = verdict if isinstance(verdict, bool) else None
    if records and verdict is not True:
        rows = rules.records(v).rows
        found = json.dumps([dict(zip(("keyword", "expected", "schema_path", "data_path", "value"), r, strict=True)) for r in rows])
    elif records:
        found = "[]"
    asked = list(book.asked) if sure is None or records else []
    return sure, found, [q[0] for q in asked], [q[1] for q in asked], False
