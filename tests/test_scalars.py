"""Scalar helpers, punycode, drafts and the engine's registry."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from veridoc.functions import punycode, scalars
from veridoc.plans import drafts
from veridoc.plans.engine import Engine
from veridoc.plans.registry import Registry, SchemaError, pointer, pointer_parts

L = F.lit


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


def test_coercion_of_json_values(spark):
    docs = ["null", "true", '"12"', '""', '" 0x1F "', '"x"', "5.0", "5.5", "[5]", "{}", '"Infinity"']
    df = spark.createDataFrame([(k, d) for k, d in enumerate(docs)], "k int, d string").withColumn("v", F.try_parse_json("d"))
    rows = df.orderBy("k").select(scalars.js_number(F.col("v")), scalars.is_intish(F.col("v")), scalars.is_boolish(F.col("v")), scalars.is_scalar(F.col("v"))).collect()
    assert [r[0] for r in rows] == [0, 1, 12, 0, 31, None, 5, 5.5, None, None, math.inf]
    assert [r[1] for r in rows] == [True, True, True, True, True, False, True, False, False, False, False]
    assert [r[2] for r in rows] == [False, True, *[False] * 9]
    assert [r[3] for r in rows] == [False, True, True, True, True, True, True, True, False, False, True]


def test_deep_equality(spark):
    pairs = [('{"a": 1, "b": [1.0, "1.0"]}', '{"b": [1, "1.0"], "a": 1e0}', True), ('"1.0"', '"1"', False), ("[1, 2]", "[2, 1]", False), ("1", "true", False), ("null", None, False), (None, None, True), ('["a.0", 1.50]', '["a.0", 1.5]', True)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string, want boolean")
    assert [r for r in df.orderBy("k").select("a", "want", scalars.equals_deep(F.try_parse_json("a"), F.try_parse_json("b")).alias("got")).collect() if r.want != r.got] == []


def test_text_arrays_and_whole_numbers(spark):
    got = one(spark, scalars.is_blank(L(" \t")), scalars.is_blank(L(None).cast("string")), scalars.is_blank(L("a")), scalars.is_empty(L("")), scalars.is_unique(F.array(L(1), L(1))), scalars.includes_all(F.array(L(1), L(2)), F.array(L(2))), scalars.bigint_min_max(L(3), L(1)), scalars.is_valid_int(L(255), 8), scalars.is_valid_int(L(255), 8, signed=False), scalars.is_valid_int(L(2**53), 64))
    assert got == (True, True, False, True, False, True, [1, 3], False, True, False)


def test_floating_point_neighbours(spark):
    got = one(spark, scalars.increment(L(1.0), 16), scalars.decrement(L(1.0), 32), scalars.increment(L(0.0), 64), scalars.increment(L(-1.0), 64), scalars.increment(L(65504.0), 16), scalars.valid_float(L(1e39), 32), scalars.valid_float(L(math.nan), 16, 0.0), scalars.is_valid_float(L(65505.0), 16))
    assert got[:3] == (1 + 2**-11, 1 - 2**-24, 0.0)
    assert math.isnan(got[3])
    assert got[4:] == (math.inf, math.inf, 0.0, False)


def test_dates(spark):
    assert one(spark, scalars.is_leap_year(L(1900)), scalars.is_date_in_range(L(2024), L(2), L(29)), scalars.is_date_in_range(L(2024), L(13), L(1)), scalars.is_time_in_range(L(23), L(59), L(60), L(0), L(0)), scalars.is_time_in_range(L(1), L(2), L(60), L(0), L(0))) == (False, True, False, True, False)


PUNY = [("bücher", "bcher-kva"), ("abc", "abc-"), ("他们为什么不说中文", "ihqwcrb4cv8a8dqg056pqjye"), ("", "")]


def test_punycode(spark):
    df = spark.createDataFrame(PUNY, "plain string, coded string")
    rows = df.select("plain", "coded", punycode.encode(F.col("plain")).alias("e"), punycode.decode(F.col("coded")).alias("d"), punycode.from_code_points(punycode.code_points(F.col("plain"))).alias("again")).collect()
    assert [(r.e, r.d, r.again) for r in rows] == [(c, p, p) for p, c in PUNY]
    hosts = spark.createDataFrame([("mañana.com", "xn--maana-pta.com"), ("jöe@bücher。de", "jöe@xn--bcher-kva.de"), (None, None), ("a.b", "a.b")], "u string, a string")
    rows = hosts.select("u", "a", punycode.to_ascii(F.col("u")).alias("to_a"), punycode.to_unicode(F.col("a")).alias("to_u")).collect()
    assert [r.to_a for r in rows] == [r.a for r in rows]
    assert [r.to_u for r in rows] == [r.u and r.u.replace("。", ".") for r in rows]
    assert one(spark, punycode.decode(L("ü")), F.size(punycode.code_points(L("a\U0001f600\n")))) == (None, 3)


def test_drafts_judge_schemas(spark):
    engine = Engine()
    assert engine.validate_schema({"type": 5})
    for version in (6, 7):
        engine.add_meta_schema(drafts.by_version(version)[1])
    assert engine.validate_schema({"type": "string", "properties": {"a": {"minLength": 1}}, "items": [{}, True]})
    assert not engine.validate_schema({"properties": {"a": {"minLength": -1}}})
    assert not engine.validate_schema({"$schema": drafts.IDS[7] + "#", "if": 5})
    assert engine.validate_schema({"if": 5})
    assert not engine.validate_schema({"$schema": "http://x.example/none"})
    assert all(engine.validate_schema(drafts.by_version(v)[1][0]) for v in (6, 7))
    assert all(Engine().add_draft(v).validate_schema(d) for v in (2019, 2020) for d in drafts.by_version(v)[1])
    assert drafts.by_name("draft-07") == drafts.by_id(drafts.IDS[7].upper()) == drafts.by_version(7)
    for call in (lambda: drafts.by_version(5), lambda: drafts.by_name("x"), lambda: drafts.by_id("x")):
        with pytest.raises(SchemaError):
            call()


def test_engine_registers_schemas_and_formats(spark):
    engine = Engine(schemas=[{"$id": "http://x.example/a#", "$defs": {"p": {"minimum": 1}}}]).add_format("even", lambda c: F.try_variant_get(c, "$", "long") % 2 == 0)
    engine.add_schema([{"type": "string"}, True], "list")
    assert engine.get_schema("http://x.example/a") and engine.get_schema("list[0]") == {"type": "string"} and engine.get_schema("none") is None
    v = engine.compile({"$ref": "http://x.example/a#/$defs/p", "format": "even"})
    df = spark.createDataFrame([("2",), ("1",), ("0",)], "d string")
    assert [r[0] for r in df.select(v.valid(F.col("d"))).collect()] == [True, False, False]
    for call in (lambda: engine.add_schema({}), lambda: engine.add_schema({"$id": "http://x.example/a"}), lambda: engine.add_format("n", 5)):
        with pytest.raises(SchemaError):
            call()


def test_engine_of_options(spark):
    from veridoc.plans.engine import ValidationOptions, ValidatorOptions

    options = ValidatorOptions(formats={"even": lambda c: F.try_variant_get(c, "$", "long") % 2 == 0}, schemas=({"$id": "http://x.example/a", "minimum": 1},), validation=ValidationOptions(skip_errors=False))
    df = spark.createDataFrame([("2",), ("3",), ("0",)], "d string")
    rows = Engine.of(options).mark(df, {"$ref": "http://x.example/a", "format": "even"}, "d").collect()
    assert [(r.valid, [e.keyword for e in r.errors]) for r in rows] == [(True, []), (False, ["format"]), (False, ["minimum"])]
    timed = Engine.of(options).compile({"minimum": 1}).with_errors(df, "d", timed=True).where("d = '0'").first()
    assert timed.errors[0].time is not None
    with pytest.raises(NotImplementedError):
        Engine().compile_async({})


def test_pointers_and_references():
    assert pointer("a/b", "~1", 0) == "/a~1b/~01/0" and pointer_parts("/a~1b/~01/0") == ["a/b", "~1", "0"]
    inner = {"$id": "sub/", "$defs": {"x": {"$id": "x.json", "type": "integer"}}}
    r = Registry({"$id": "http://h.example/root", "$defs": {"inner": inner}})
    assert r.find("#/$defs/inner/$defs/x", "http://h.example/root") == (inner["$defs"]["x"], "http://h.example/sub/")
    assert r.find("sub/x.json", "http://h.example/root")[0] == inner["$defs"]["x"]
