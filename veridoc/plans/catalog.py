"""Registered queries of the function library: many functions a query, each with its formula as SQL."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import calc, formats, punycode, scalars
from veridoc.functions.calc import VEC2, VEC2I, VEC3, Vector

#: (name, Column, SQL).
Row = tuple[str, Any, str]
PI, BITS, LIMITS = math.pi, scalars.FLOAT_BITS, scalars.FLOAT_MAX[16] + scalars.FLOAT_EPS[16] + scalars.FLOAT_MIN[16]


class Nothing:
    """Takes the place of Columns, and of what makes them, where only the SQL is asked for: no session need run then."""

    def _same(self, *_: Any, **__: Any) -> Nothing:
        return self

    __call__ = __getattr__ = __getitem__ = __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __rmul__ = __truediv__ = __floordiv__ = __mod__ = __eq__ = __and__ = __or__ = __invert__ = __neg__ = _same
    __hash__ = None


class Libraries:
    """The libraries that rows use: the real ones, or nothing."""

    def __init__(self, real: bool) -> None:
        self.real = real
        self.f, self.calc, self.scalars, self.formats, self.punycode = (x if real else Nothing() for x in (F, calc, scalars, formats, punycode))

    def of(self, kind: Vector) -> Any:
        return kind if self.real else Nothing()


def _near(on: Libraries, rows: list[Row]) -> list[Row]:
    """Rounded to nine digits: the libraries' sines and the like differ in the last bit."""
    return [(name, on.f.round(c, 9), f"round({sql}, 9)") for name, c, sql in rows]


def _scalars(on: Libraries) -> list[Row]:
    F, calc, VEC2 = on.f, on.calc, on.calc.VEC2
    F64 = calc.F64
    q, d, t, n = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber").cast("double")
    r, rs = (q - 25) / 5, "((l_quantity - 25) / 5)"
    wrap = f"CASE WHEN {rs} < {-PI!r} THEN {rs} + {2 * PI!r} WHEN {rs} > {PI!r} THEN {rs} - {2 * PI!r} ELSE {rs} END"

    def low(x: str) -> str:
        return f"CASE WHEN {x} < 0 THEN {4 / PI!r} * {x} + {4 / PI**2!r} * {x} * {x} ELSE {4 / PI!r} * {x} - {4 / PI**2!r} * {x} * {x} END"

    def turned(x: str) -> str:
        return f"(CASE WHEN {x} < {-PI!r} THEN {x} + {2 * PI!r} WHEN {x} > {PI!r} THEN {x} - {2 * PI!r} ELSE {x} END)"

    def mid(x: str) -> str:
        return f"(0.225 * (({low(x)}) * abs({low(x)}) - ({low(x)})) + ({low(x)}))"

    cosine = f"({rs} + {PI / 2!r})"
    fib = [0.0, 1.0]
    while len(fib) < 60:
        fib.append(fib[-1] + fib[-2])
    exact = [
        ("dot", F64.dot(q, d, t, n), "l_quantity * l_tax + l_discount * l_linenumber"),
        ("mag", F64.mag(q, n), "sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber)"),
        ("root", F64.sqrt(q), "sqrt(l_quantity)"),
        ("fib", F64.fib(q), f"([{', '.join(map(repr, fib))}])[l_quantity::int]"),
        ("fib2", F64.fib2(n), f"([{', '.join(map(repr, fib))}])[l_linenumber + 1]"),
        ("map", F64.map(q, F.lit(0.0), F.lit(50.0), n, n + 2, fixed=True), "l_linenumber + (l_quantity - 0) / 50 * 2.0"),
        ("clampu", F64.clampu(q, F.lit(10.0), F.lit(20.0)), "greatest(10.0, least(l_quantity, 20.0))"),
        ("rounded", calc.rounded(q / 4), "floor(l_quantity / 4 + 0.5)"),
        ("least", calc.smallest(q, n), "least(l_quantity, l_linenumber::double)"),
        ("largest", calc.largest(q, n), "greatest(l_quantity, l_linenumber::double)"),
        ("whole_up", F.ceil(d * 100).cast("double"), "ceil(l_discount * 100)"),
        ("whole_down", F.floor(d * 100).cast("double"), "floor(l_discount * 100)"),
        ("size", F.abs(q - 25), "abs(l_quantity - 25)"),
        ("pi_ex", F.lit(calc.PI_I32) + n, "31415 + l_linenumber::double"),
    ]
    close = [
        ("radians", F64.to_radian(q), f"l_quantity * {PI!r} / 180"),
        ("degrees", F64.to_degrees(q), f"l_quantity * 180 / {PI!r}"),
        ("wrapped", F64.wrap_radians(r), wrap),
        ("sin_lp", F64.sin_lp(r), low(turned(rs))),
        ("cos_lp", F64.cos_lp(r), low(turned(cosine))),
        ("sin_mp", F64.sin_mp(r), mid(turned(rs))),
        ("sin_mp_ex", F64.sin_mp_ex(r), mid(rs)),
        ("cos_mp", F64.cos_mp(r), mid(turned(cosine))),
        ("theta", F64.theta(q, n), "atan2(l_linenumber, l_quantity)"),
        ("angle", F64.angle(n, q), "atan2(l_quantity, l_linenumber)"),
        ("phi", F64.phi(d, q), "asin(l_discount / l_quantity)"),
        ("sine", F.sin(q), "sin(l_quantity)"),
        ("cosine", F.cos(q), "cos(l_quantity)"),
        ("power", F.pow(q, d), "pow(l_quantity, l_discount)"),
        ("lerp_vec", VEC2.lerp(d, VEC2.new(q, n), VEC2.new(n, q))["x"], "(l_quantity + l_discount) * (l_linenumber - l_quantity)"),
    ]
    return exact + _near(on, close)


def _int32(on: Libraries) -> list[Row]:
    F, calc, I32 = on.f, on.calc, on.calc.I32
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    big, bs = q * 1_000_003 * n, "(l_quantity * 1000003 * l_linenumber)"
    wrap = "(((trunc({0})::hugeint + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648)".format
    b32 = wrap(bs)
    return [
        ("wrapped", calc.i32(big * 100), f"{wrap(f'{bs} * 100')}::int"),
        ("dot", I32.dot(q, n, n, q), "(2 * l_quantity * l_linenumber)::int"),
        ("root", I32.sqrt(q), "floor(sqrt(l_quantity))::int"),
        ("root_ex", I32.sqrt_ex(q), "floor(10000 * sqrt(l_quantity))::int"),
        ("hypot_ex", I32.hypot_ex(q, n), "floor(10000 * sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber))::int"),
        ("map", I32.map(q, F.lit(0), F.lit(50), F.lit(0), F.lit(200)), "floor((l_quantity * 200) / 50 + 0.5)::int"),
        ("lerp", I32.lerp(n, F.lit(2), q), "((l_quantity - 2) * (l_linenumber + 2))::int"),
        ("clamp", I32.clamp(q, F.lit(30), F.lit(10)), "greatest(10, least(l_quantity::int, 30))"),
        ("clampu", I32.clampu(q, F.lit(10), F.lit(30)), "greatest(10, least(l_quantity::int, 30))"),
        ("byte_b", I32.clampu_u8b(q * 9 - 20), "CASE WHEN l_quantity * 9 - 20 < 0 THEN 0 WHEN l_quantity * 9 - 20 > 255 THEN -1 ELSE l_quantity * 9 - 20 END::int"),
        ("inside", I32.in_range(q, F.lit(30), F.lit(10)), "l_quantity BETWEEN 10 AND 30"),
        ("meets", I32.intersects_range(q, q + 5, n * 6, F.lit(0)), "l_linenumber * 6 >= l_quantity AND l_quantity + 5 >= 0"),
        ("rects", I32.intersects_rect(q, n, F.lit(3), F.lit(1), F.lit(10), F.lit(2), F.lit(9), F.lit(3)), "l_quantity <= 19 AND l_quantity + 3 >= 10 AND l_linenumber <= 5 AND l_linenumber + 1 >= 2"),
        ("radians_ex", I32.to_radian_ex(q), "floor(l_quantity * 31415 / 180)::int"),
        ("degrees_ex", I32.to_degrees_ex(q), "floor(10000 * l_quantity * 180 / 31415)::int"),
        ("turned", I32.wrap_radians(q * 1500), "CASE WHEN l_quantity * 1500 > 31415 THEN l_quantity * 1500 - 62830 ELSE l_quantity * 1500 END::int"),
        ("sine_ex", I32.sin_lp_ex(q), "(12732 * l_quantity - 4052 * l_quantity * l_quantity)::int"),
        ("sine", I32.sin_lp(q), "(12732 * l_quantity - 4052 * l_quantity * l_quantity)::int"),
        ("least", F.least(calc.i32(big), n), f"least({b32}, l_linenumber)::int"),
        ("greatest", F.greatest(calc.i32(big), n), f"greatest({b32}, l_linenumber)::int"),
        ("norm", I32.norm(q, F.lit(0), n), "trunc(l_quantity / l_linenumber)::int"),
    ]


def _vector(on: Libraries, vector: Vector, names: tuple[list[str], list[str]], sql: tuple[list[str], list[str]]) -> list[Row]:
    """Every operation that a kind of vector has, field by field."""
    F, calc, kind, fields = on.f, on.calc, on.of(vector), vector.fields
    a, b = (kind.new(*(F.expr(x) for x in parts)) for parts in names)
    whole = vector.kind == "int"
    cut = (lambda x: f"trunc({x})::int") if whole else (lambda x: x)
    sa, sb = (dict(zip(fields, parts, strict=True)) for parts in sql)
    rows: list[Row] = []

    def each(name: str, made: Any, formula: Callable[[str, str], str]) -> None:
        rows.extend((f"{name}_{f}", made[f], cut(formula(sa[f], sb[f]))) for f in fields)

    by = 4
    each("add", kind.add(a, b), lambda x, y: f"({x} + {y})")
    each("adds", kind.adds(a, by), lambda x, y: f"({x} + 4)")
    each("sub", kind.sub(a, b), lambda x, y: f"({x} - {y})")
    each("subs", kind.subs(a, by), lambda x, y: f"({x} - 4)")
    each("mul", kind.mul(a, b), lambda x, y: f"({x} * {y})")
    each("muls", kind.muls(a, by), lambda x, y: f"({x} * 4)")
    each("neg", kind.neg(a), lambda x, y: f"(-{x})")
    each("div", kind.div(a, kind.adds(kind.mul(b, b), 1)), lambda x, y: f"({x} / ({y} * {y} + 1.0::double))")
    each("divs", kind.divs(a, by), lambda x, y: f"({x} / 4.0::double)")
    zero = "0" if whole else "0.0::double"
    dot = " + ".join([zero, *(f"{sa[f]} * {sb[f]}" for f in fields)])
    mag2 = " + ".join([zero, *(f"{sa[f]} * {sa[f]}" for f in fields)])
    rows += [("dot", kind.dot(a, b), cut(f"({dot})")), ("mag2", kind.mag2(a), cut(f"({mag2})"))]
    rows += _near(on, [("mag", kind.mag(a), f"sqrt({mag2})")])
    if not whole:
        each("addms", kind.addms(a, b, 2.0), lambda x, y: f"({x} + {y} * 2)")
        each("ceil", kind.ceil(kind.muls(a, 9)), lambda x, y: f"ceil({x} * 9)")
        each("floor", kind.floor(kind.muls(a, 9)), lambda x, y: f"floor({x} * 9)")
        each("round", kind.round(kind.muls(a, 9)), lambda x, y: f"floor({x} * 9 + 0.5)")
        each("min", kind.min(a, b), lambda x, y: f"least({x}, {y})")
        each("max", kind.max(a, b), lambda x, y: f"greatest({x}, {y})")
        each("inv", kind.inv(kind.adds(kind.mul(a, a), 1)), lambda x, y: f"(1.0::double / ({x} * {x} + 1))")
        each("lerp", kind.lerp(F.lit(0.25), a, b, fixed=True), lambda x, y: f"({x} + 0.25::double * ({y} - {x}))")
        gap = " + ".join([zero, *(f"({sb[f]} - {sa[f]}) * ({sb[f]} - {sa[f]})" for f in fields)])
        rows += [("dist2", kind.dist2(a, b), f"({gap})"), ("same", kind.equals(a, kind.adds(a, 1e-8)), "true"), ("strict", kind.eqstrict(a, b), " AND ".join(f"{sa[f]} = {sb[f]}" for f in fields))]
        unit = kind.unit(a)
        rows += _near(on, [("dist", kind.dist(a, b), f"sqrt({gap})"), *((f"unit_{f}", unit[f], f"{sa[f]} / sqrt({mag2})") for f in fields)])
    if vector is VEC3:
        return rows
    x, y, u, w = sa["x"], sa["y"], sb["x"], sb["y"]
    cross = calc.cross2i(a, b) if whole else calc.cross2(a, b)
    rows += [("cross", cross, cut(f"({x} * {w} - {y} * {u})" if not whole else f"({x} * {w} - {u} * {y})"))]
    rows += [(f"{name}_{f}", made[f], cut(s)) for name, made, parts in (("rot", kind.rot90(a), (f"(-{y})", x)), ("rotn", kind.rotn90(a), (y, f"(-{x})"))) for f, s in zip("xy", parts, strict=True)]
    rows += [("side", kind.cross3(a, b, kind.new(F.lit(1), F.lit(2))), f"(({u} - {x}) * (2 - {y}) - ({w} - {y}) * (1 - {x}))" + ("::double" if whole else ""))]
    if whole:
        rows += [("theta_ex", kind.theta_ex(a), f"trunc(10000 * atan2({y}, {x}))::int"), *_near(on, [("phi_ex", kind.phi_ex(a), f"10000 * asin({y} / sqrt({mag2}))")])]
        rows += [(f"norm_{f}", kind.norm(a)[f], f"trunc({sa[f]} / trunc(sqrt({mag2})))::int") for f in "xy"]
        return rows
    turn, spun = calc.rotate(a, F.lit(0.5)), calc.about(a, b, F.lit(0.5))
    c, s = f"{math.cos(0.5)!r}", f"{math.sin(0.5)!r}"
    near = [("theta", kind.theta(a), f"atan2({y}, {x})"), ("phi", kind.phi(a), f"asin({y} / sqrt({mag2}))")]
    near += [("rotate_x", turn["x"], f"{x} * {c} - {y} * {s}"), ("rotate_y", turn["y"], f"{x} * {s} + {y} * {c}")]
    near += [("about_x", spun["x"], f"{u} + ({x} - {u}) * {c} - ({y} - {w}) * {s}"), ("about_y", spun["y"], f"{w} + ({x} - {u}) * {s} + ({y} - {w}) * {c}")]
    return rows + _near(on, near)


def _parts(count: int, by: str = "") -> tuple[tuple[list[str], list[str]], tuple[list[str], list[str]]]:
    spark = [f"cast(embedding[{k}] as double){by}" for k in range(2 * count)]
    sql = [f"(embedding[{k + 1}]::double{by})" for k in range(2 * count)]
    return (spark[:count], spark[count:]), (sql[:count], sql[count:])


def _whole_parts() -> tuple[tuple[list[str], list[str]], tuple[list[str], list[str]]]:
    (a, b), _ = _parts(2, " * 1000 + 700")
    sql = [f"trunc(embedding[{k + 1}]::double * 1000 + 700)" for k in range(4)]
    return (a, b), (sql[:2], sql[2:])


def _values(on: Libraries) -> list[Row]:
    """Values of events and what is made of them."""
    F, scalars = on.f, on.scalars
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    k, ks = scalars.js_number(v), "(props->>'$.k')::double"
    year, month, day = F.year("ts"), F.month("ts"), F.dayofmonth("ts")
    word = F.concat(F.col("event_type"), F.when(F.col("event_id") % 3 == 0, " ").otherwise(""))
    kind = lambda name: scalars.value_of(v, name).isNotNull()
    parsed = lambda text: F.try_parse_json(F.concat(F.lit(text), F.col("props"), F.lit("}")))
    decimal = scalars.whole_number(F.col("event_id").cast("decimal(38,0)"))
    step = lambda bits: f"pow(2.0::double, log2({ks}) - {BITS[bits][1] + 1})"
    return [
        ("is_text", kind("string"), "false"),
        ("is_flag", kind("boolean"), "false"),
        ("is_number", kind("number"), "true"),
        ("is_integer", kind("integer"), f"{ks} = floor({ks})"),
        ("is_object", scalars.value_of(F.try_parse_json("props"), "object").isNotNull(), "true"),
        ("is_array", scalars.value_of(F.try_parse_json("props"), "array").isNotNull(), "false"),
        ("is_scalar", scalars.is_scalar(v), "true"),
        ("boolish", scalars.boolish(v).isNotNull(), "false"),
        ("intish", scalars.intish(v), f"CASE WHEN {ks} = floor({ks}) THEN {ks} END"),
        ("numbish", scalars.is_numbish(v), "true"),
        ("deep_equal", scalars.equals_deep(parsed('{"a":'), parsed('{ "a" : ')), "true"),
        ("blank", scalars.is_blank(F.regexp_replace(word, "[a-z_]", "")), "true"),
        ("empty", scalars.is_empty(F.regexp_replace(word, "[a-z_]", "")), "event_id % 3 <> 0"),
        ("unique", F.array_join(scalars.unique_array(F.array("event_type", F.lit("x"), "event_type")), ","), "event_type || ',x'"),
        ("all_in", scalars.includes_all(F.array("event_type", F.lit("x")), F.array(F.lit("x"))), "true"),
        ("merged", F.size(scalars.map_merge(F.create_map(F.lit("a"), k), F.create_map(F.lit("b"), k))), "2::int"),
        ("union", F.size(scalars.set_merge(F.array(k), F.array(F.lit(-1.0), k))), "2::int"),
        ("big_least", scalars.bigint_min(decimal, F.lit(7).cast("decimal(38,0)")).cast("long"), "least(event_id, 7)"),
        ("big_most", scalars.bigint_max(decimal, F.lit(7).cast("decimal(38,0)")).cast("long"), "greatest(event_id, 7)"),
        ("big_both", F.array_join(scalars.bigint_min_max(decimal, F.lit(7).cast("decimal(38,0)")).cast("array<string>"), " "), "least(event_id, 7) || ' ' || greatest(event_id, 7)"),
        *((f"int{b}", scalars.is_valid_int(k * 300, b), f"{ks} * 300 = floor({ks} * 300) AND {ks} * 300 BETWEEN {-(1 << b - 1)} AND {(1 << b - 1) - 1}") for b in (8, 16, 32)),
        *((f"uint{b}", scalars.is_valid_int(k * 300, b, signed=False), f"{ks} * 300 = floor({ks} * 300) AND {ks} * 300 BETWEEN 0 AND {(1 << b) - 1}") for b in (8, 16, 32)),
        ("float16", scalars.is_valid_float(k * 1000, 16), f"abs({ks} * 1000) <= 65504"),
        ("float32", scalars.is_valid_float(k, 32), "true"),
        ("float64", scalars.is_valid_float(k, 64), "true"),
        ("as_float16", scalars.valid_float(k * 1000, 16), f"CASE WHEN {ks} * 1000 > 65504 THEN 'inf'::double ELSE {ks} * 1000 END"),
        ("as_float32", scalars.valid_float(k, 32), ks),
        ("as_float64", scalars.valid_float(k, 64), ks),
        *(x for b in (16, 32, 64) for x in _near(on, [(f"up{b}", scalars.increment(k + 1, b), f"({ks} + 1) + {step(b).replace(ks, f'({ks} + 1)')}"), (f"down{b}", scalars.decrement(k + 1, b), f"({ks} + 1) - {step(b).replace(ks, f'({ks} + 1)')}")])),
        ("days", scalars.days_in_month(year, month).cast("long"), "day(last_day(ts))"),
        ("date_there", scalars.is_date_in_range(year, month, day + 3), "day(ts) + 3 <= day(last_day(ts))"),
        ("time_there", scalars.is_time_in_range(F.hour("ts") + 2, F.minute("ts"), F.second("ts"), F.lit(1), F.lit(0)), "hour(ts) + 2 <= 23"),
        ("ticks", F.lit(scalars.TICKS_DAY // scalars.TICKS_HOUR * scalars.TICKS_SECOND).cast("long") + F.col("event_id"), "24000 + event_id"),
        ("limits", F.lit(LIMITS) + k, f"{LIMITS!r} + {ks}"),
    ]


#: A date or time made of an event's number, and the instant that it names.
def _instants(on: Libraries) -> list[Row]:
    F, formats = on.f, on.formats
    k = "event_id % 28 + 1"
    day, time = F.expr(f"concat('2024-02-', lpad({k}, 2, '0'))"), F.expr("concat(lpad(event_id % 24, 2, '0'), ':30:00+01:00')")
    seconds = lambda c, kind: F.unix_timestamp(formats.instant(c, kind))
    base = 1706745600  # the first of February 2024
    return [
        ("date", seconds(day, "date"), f"{base} + (event_id % 28) * 86400"),
        ("time", seconds(time, "time"), "(event_id % 24) * 3600 + 1800 - 3600"),
        ("moment", seconds(F.concat(day, F.lit("T"), time), "date-time"), f"{base} + (event_id % 28) * 86400 + (event_id % 24) * 3600 + 1800 - 3600"),
        ("wrong", seconds(F.lit("2024-02-30"), "date").isNull(), "true"),
    ]


def _urls(on: Libraries) -> list[Row]:
    F, formats = on.f, on.formats
    host = F.expr("concat(if(o_orderkey % 3 = 0, '10.0.0.', '8.8.4.'), 1 + o_orderkey % 200)")
    return [
        ("full_url", formats.is_url_full(F.concat(F.lit("http://u:p@x"), F.col("o_orderkey").cast("string"), F.expr("if(o_orderkey % 2 = 0, '.org:8080/a?b', '..org')"))), "o_orderkey % 2 = 0"),
        ("public_host", formats.is_url_full(F.concat(F.lit("ftp://"), host)), "o_orderkey % 3 <> 0"),
        ("no_scheme", formats.is_url_full(F.col("o_orderpriority")), "false"),
    ]


def _codes(on: Libraries) -> list[Row]:
    """Punycode of host names, mail addresses and labels, and texts as code points."""
    F, punycode = on.f, on.punycode
    key, number = F.col("o_orderkey").cast("string"), "o_orderkey::varchar"
    host = F.concat(F.lit("bücher.x"), key, F.lit(".example"))
    mail = F.concat(key, F.lit("@münchen.de"))
    points = punycode.code_points(F.concat(F.lit("ü\U0001f600"), F.col("o_orderstatus")))
    return [
        ("ascii", punycode.to_ascii(host), f"'xn--bcher-kva.x' || {number} || '.example'"),
        ("again", punycode.to_unicode(punycode.to_ascii(host)), f"'bücher.x' || {number} || '.example'"),
        ("mail", punycode.to_ascii(mail), f"{number} || '@xn--mnchen-3ya.de'"),
        ("label", punycode.encode(F.lit("mañana")), "'maana-pta'"),
        ("decoded", punycode.decode(F.lit("maana-pta")), "'mañana'"),
        ("illegal", punycode.decode(F.concat(key, F.lit("ü"))).isNull(), "true"),
        ("points", F.array_join(points.cast("array<string>"), " "), "'252 128512 ' || ascii(o_orderstatus)"),
        ("text", punycode.from_code_points(points), "'ü\U0001f600' || o_orderstatus"),
    ]


LINE = "l_orderkey, l_linenumber, l_partkey"
#: Name: (table, its key, functions).
GROUPS: dict[str, tuple[str, str, Callable[[Libraries], list[Row]]]] = {
    "lib_f64": ("lineitem", LINE, _scalars),
    "lib_i32": ("lineitem", LINE, _int32),
    "lib_vec2": ("embeddings", "vec_id", lambda on: _vector(on, VEC2, *_parts(2))),
    "lib_vec3": ("embeddings", "vec_id", lambda on: _vector(on, VEC3, *_parts(3))),
    "lib_vec2i": ("embeddings", "vec_id", lambda on: _vector(on, VEC2I, *_whole_parts())),
    "lib_values": ("events", "event_id", _values),
    "lib_instants": ("events", "event_id", _instants),
    "lib_urls": ("orders", "o_orderkey", _urls),
    "punycode_hosts": ("orders", "o_orderkey", _codes),
}


def _run(table: str, key: str, rows: Callable[[Libraries], list[Row]]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.select(*(k.strip() for k in key.split(",")), *(c.alias(name) for name, c, _ in rows(Libraries(True))))

    return query


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _run(*group) for name, group in GROUPS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: f"SELECT {key}, {', '.join(f'{sql} AS "{n}"' for n, _, sql in rows(Libraries(False)))} FROM {table}" for name, (table, key, rows) in GROUPS.items()}
