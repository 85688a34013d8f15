"""The schema compiler: verdicts by keyword, totality, formats, and the registered queries against DuckDB."""

from __future__ import annotations

import json

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from veridoc.functions import formats
from veridoc.plans import queries as registered
from veridoc.plans.schema import Rules, SchemaError, Validator, _told, judge_document
from veridoc.plans.values import MISSING, Book, Variant
from veridoc.streaming.validate import mark

SF = "/root/testdata/sf0.001"

#: schema, then documents that are valid and documents that aren't; None stands for a missing document.
VERDICTS = [
    (True, [1, "a", None], []),
    (False, [], [1, None]),
    ({"type": "integer"}, [5, 5.0, None], [5.5, "5", True]),
    ({"type": ["string", "null"]}, ["a"], [1]),
    ({"type": "string", "nullable": True}, ["a"], [1]),
    ({"required": True}, [1, "a"], [None]),
    ({"const": {"a": [1, 2]}}, [{"a": [1, 2.0]}], [{"a": [2, 1]}, {"a": [1, 2], "b": 1}, None]),
    ({"enum": [1, "x", {"y": None}]}, [1.0, "x", {"y": None}, None], [2, {"y": 0}]),
    ({"exclusiveMaximum": 5, "maximum": 1}, [4, "a"], [5]),
    ({"multipleOf": 0.5}, [1.5, "a"], [1.3]),
    ({"minLength": 2}, ["ab", "😀"], ["a", 5, None]),
    ({"maxLength": 0}, ["ab"], []),
    ({"pattern": "^a$"}, ["a"], ["a\n", "ba"]),
    ({"uniqueItems": True}, [[1, 2], [{"a": 1}, {"a": 1}], "x"], [[1, 1.0]]),
    ({"items": False}, [[], 5], [[1]]),
    ({"prefixItems": [{"type": "string"}], "items": {"type": "integer"}}, [["a", 1], []], [["a", "b"], [1]]),
    ({"contains": {"minimum": 3}, "maxContains": 1}, [[1, 3]], [[1], [3, 4], []]),
    ({"required": ["a"], "additionalProperties": {"type": "integer"}, "properties": {"a": {}}}, [{"a": "x", "b": 1}], [{"b": 1}, {"a": 1, "b": "x"}]),
    ({"patternProperties": {"^n": {"type": "integer"}}}, [{"n1": 1, "m": "x"}], [{"n1": "x"}]),
    ({"propertyNames": {"maxLength": 2}}, [{"ab": 1}, 5], [{"abc": 1}]),
    ({"propertyNames": {"type": "map"}, "type": ["object", "set"]}, [{}], [{"a": 1}, [1]]),
    ({"dependencies": {"a": ["b"]}}, [{"b": 1}, {"a": 1, "b": 1}], [{"a": 1}]),
    ({"oneOf": [{"type": "integer"}, {"minimum": 2}]}, [1, 2.5], [3, 1.5]),
    ({"not": {"type": "integer"}}, ["a", None], [1]),
    ({"if": {"type": "integer"}, "then": {"minimum": 0}, "else": {"minLength": 1}}, [1, "a"], [-1, ""]),
    ({"$ref": "#/definitions/n", "definitions": {"n": {"properties": {"next": {"$ref": "#/definitions/n"}, "v": {"type": "integer"}}}}}, [{"v": 1, "next": {"v": 2}}], [{"next": {"next": {"v": "x"}}}]),
    ({"format": "uint8"}, [255, "12", ""], [256, 1.5, {}]),
    ({"format": "ipv6"}, ["::1", "1:2:3:4:5:6:7:8", "::ffff:1.2.3.4", 7], ["1::2::3", "12345::", "1:2"]),
    ({"format": "date"}, ["2024-02-29", "2023-02-28z"], ["2023-02-29", "2023-13-01", "x"]),
    ({"format": "time", "formatMaximum": "12:00:00Z"}, ["11:59:59Z"], ["12:00:01Z", "24:00:00Z"]),
    ({"format": "date-time"}, ["2024-01-01T10:00:00Z", "2024-01-01 23:59:60Z"], ["2024-01-01T10:00:60Z", "2024-01-01"]),
    ({"format": "json-pointer"}, ["/a/~0b", ""], ["a", "/~2"]),
    ({"format": "email"}, ["a@b.c"], ["a@", "@b"]),
    ({"format": "regex"}, ["a(b|c)*", "", 5], ["a(b", "[a"]),
    ({"format": "idn-hostname"}, ["a.example", "\u5b9f\u4f8b.example"], ["example", "-a.example", "a..b.c"]),
    ({"format": "country2"}, ["NL", "nlx", "XK"], ["XX", ""]),
    ({"format": "iban"}, ["NL91ABNA0417164300$"], ["NL91ABNA0417164300", "x"]),
    ({"items": {"format": "regex"}}, [["a"]], [["("]]),
]


@pytest.mark.parametrize("schema,good,bad", VERDICTS, ids=lambda x: json.dumps(x)[:60] if isinstance(x, (dict, bool)) else "")
def test_verdicts(spark, schema, good, bad):
    rows = [(k, None if d is None else json.dumps(d), k < len(good)) for k, d in enumerate([*good, *bad])]
    df = spark.createDataFrame(rows, "k int, doc string, expected boolean")
    out = df.select("doc", "expected", Validator(schema).valid(F.col("doc")).alias("valid")).collect()
    assert [(r.doc, r.valid) for r in out] == [(r.doc, r.expected) for r in out]
    errors = df.select("doc", "expected", F.size(Validator(schema).errors(F.col("doc"))).alias("n")).collect()
    assert [(r.doc, r.n == 0) for r in errors] == [(r.doc, r.expected) for r in errors]


def test_errors_name_keyword_and_path(spark):
    v = Validator({"required": ["a", "z"], "properties": {"a": {"$ref": "#/$defs/n"}, "b": {"maxLength": 1}}, "$defs": {"n": {"type": "integer", "minimum": 3}}})
    df = spark.createDataFrame([('{"a": 1.5, "b": "xy"}',)], "doc string")
    found = df.select(F.inline(v.errors(F.col("doc")))).collect()
    assert sorted((r.keyword, r.expected, r.schema_path, r.value) for r in found) == [
        ("maxLength", "1", "#/properties/b/maxLength", '"xy"'),
        ("minimum", "3", "#/properties/a/$ref/minimum", "1.5"),
        ("required", '["a", "z"]', "#/required", '{"a":1.5,"b":"xy"}'),
        ("type", '"integer"', "#/properties/a/$ref/type", "1.5"),
    ]


def test_spec_mode_passes_other_types(spark):
    df = spark.createDataFrame([("5",), ('"a"',)], "doc string")
    v = Validator({"minLength": 2}, mode="spec")
    assert [r[0] for r in df.select(v.valid(F.col("doc"))).collect()] == [True, False]


@pytest.mark.parametrize("schema", [{"type": "nothing"}, {"type": []}, {"format": "nothing"}, {"$ref": "#/nowhere"}, {"minItems": 3, "maxItems": 1}, 5])
def test_schemas_that_do_not_compile(spark, schema):
    with pytest.raises(SchemaError):
        Rules(schema).judge(Variant(F.lit(None).cast("variant")))


def test_remote_reference_and_custom_format(spark):
    v = Validator({"properties": {"a": {"$ref": "http://x.example/s#/$defs/p"}, "b": {"format": "even"}}}, others={"http://x.example/s": {"$defs": {"p": {"minimum": 1}}}}, custom={"even": lambda c: F.try_variant_get(c, "$", "long") % 2 == 0})
    df = spark.createDataFrame([('{"a": 1, "b": 2}',), ('{"a": 0}',), ('{"b": 3}',)], "doc string")
    assert [r[0] for r in df.select(v.valid(F.col("doc"))).collect()] == [True, False, False]


def test_every_format_is_total(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 20_000,)], "s string")
    row = df.select(*(F.count_if(p(F.col("s")).isNull()).alias(n) for n, p in (formats.strings() | formats.DATES).items())).first()
    assert not any(row)


def test_formats_through_java_are_total_and_can_be_reported(spark):
    df = spark.createDataFrame([(None,), ("",), ("x" * 20_000,), ("(",)], "s string")
    rows = df.select(*(p(F.col("s")).alias(n) for n, p in formats.REFLECTED.items())).collect()
    assert None not in {x for r in rows for x in r}
    docs = spark.createDataFrame([('"a*"',), ('"("',)], "doc string")
    assert [tuple(r) for r in Validator({"format": "regex"}).report(docs, "doc").collect()] == [(2, 1)]


def test_stream(spark, tmp_path):
    spark.createDataFrame([('{"k": 1}',), ('{"k": 99}',)], "props string").write.parquet(str(tmp_path / "in"))
    stream = mark(spark.readStream.schema("props string").parquet(str(tmp_path / "in")), "props", Validator(registered.EVENT))
    stream.writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.valid for r in spark.table("verdicts").collect()) == [False, True]


@pytest.mark.parametrize("name", sorted(registered.oracle_sql()))
def test_registered_query_matches_sql(spark, name):
    got = registered.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for table in ("events", "orders", "lineitem", "part", "embeddings", "pages", "supplier"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(registered.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    by = [c for c in columns if got[c].dtype.kind != "f"]
    a, b = (x[columns].sort_values(by, ignore_index=True) for x in (got, want))
    for c in columns:
        assert np.allclose(a[c], b[c], rtol=1e-12, atol=1e-12, equal_nan=True) if a[c].dtype.kind == "f" else a[c].tolist() == b[c].tolist()


def test_every_query_of_the_engine_has_sql():
    assert registered.queries().keys() == registered.oracle_sql().keys()


@pytest.mark.parametrize("schema,good,bad", VERDICTS, ids=lambda x: json.dumps(x)[:60] if isinstance(x, (dict, bool)) else "")
def test_parsed_documents_are_judged_alike(spark, schema, good, bad):
    assert [judge_document(Rules(schema), MISSING if d is None else d) for d in [*good, *bad]] == [True] * len(good) + [False] * len(bad)


TREE = {"$ref": "#/$defs/n", "$defs": {"n": {"properties": {"v": {"type": "integer"}, "kids": {"items": {"$ref": "#/$defs/n"}}, "next": {"$ref": "#/$defs/n"}}}}}


def test_documents_deeper_than_the_schema_is_unrolled(spark):
    def nest(leaf, n):
        for _ in range(n):
            leaf = {"kids": [leaf]}
        return json.dumps(leaf)

    docs = [(nest({"v": x}, n), x == 1) for n in (0, 2, 40, 300) for x in (1, "x")] + [(None, True), ("{" * 9, False)]
    df = spark.createDataFrame(docs, "doc string, expected boolean")
    v = Validator(TREE)
    out = df.select("expected", v.valid(F.col("doc")).alias("valid"), F.size(v.errors(F.col("doc"))).alias("n")).collect()
    assert [(r.valid, r.n == 0) for r in out] == [(r.expected, r.expected) for r in out]


@pytest.mark.parametrize(
    "schema,good,bad",
    [
        ({"properties": {"a": True}, "allOf": [{"properties": {"b": True}}], "unevaluatedProperties": False}, [{"a": 1, "b": 2}, {}, 5], [{"c": 1}]),
        ({"anyOf": [{"required": ["x"], "properties": {"x": True}}, {"properties": {"y": {"type": "integer"}}}], "unevaluatedProperties": {"type": "string"}}, [{"x": 1, "z": "s"}, {"y": 1}], [{"x": 1, "y": []}, {"z": 1}]),
        ({"prefixItems": [{"type": "integer"}], "contains": {"type": "string"}, "unevaluatedItems": False}, [[1, "a"], [1, "a", "b"]], [[1, "a", None]]),
        ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"m": True}}, "unevaluatedProperties": False}, [{"k": 1, "m": 2}, {}], [{"k": 2}, {"m": 1}]),
    ],
)
def test_unevaluated_parts_in_spec_mode(spark, schema, good, bad):
    df = spark.createDataFrame([(json.dumps(d),) for d in [*good, *bad]], "doc string")
    assert [r[0] for r in df.select(Validator(schema, mode="spec").valid(F.col("doc"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_keyword_values_that_stand_for_numbers(spark):
    df = spark.createDataFrame([("-1",), ("0",), ("7",)], "doc string")
    verdicts = lambda s, **o: [r[0] for r in df.select(Validator(s, **o).valid(F.col("doc"))).collect()]
    assert verdicts({"minimum": None}) == [False, True, True]
    assert verdicts({"maximum": "5"}) == [True, True, False]
    assert verdicts({"maximum": 9, "exclusiveMaximum": False}) == [True, False, False]
    assert verdicts({"minimum": None, "maximum": "5"}, mode="spec") == [True, True, True]


def test_errors_below_all_of_and_conditions(spark):
    v = Validator({"allOf": [{"minimum": 3}, {"type": "integer"}], "if": {"maximum": 0}, "then": {"multipleOf": 2}})
    df = spark.createDataFrame([("-1",), ("4",), (None,)], "doc string")
    found = df.select(F.inline(v.errors(F.col("doc")))).collect()
    assert sorted(r.schema_path for r in found) == ["#/allOf/0/minimum", "#/then/multipleOf"]


RULES = [
    {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "string"], "minimum": 2, "pattern": "^x"}, "b": {"items": {"maximum": 3}, "minItems": 1}}, "patternProperties": {"^p": {"format": "date"}}, "additionalProperties": {"enum": [1, "y"]}},
    {"anyOf": [{"required": ["a"]}, {"properties": {"b": {"contains": {"const": 2}}}, "required": ["b"]}], "oneOf": [{"minProperties": 2}, {"maxProperties": 1}], "not": {"required": ["z"]}},
    {"if": {"required": ["a"]}, "then": {"dependentRequired": {"a": ["b"]}, "propertyNames": {"maxLength": 2}}, "else": {"dependentSchemas": {"b": {"properties": {"b": {"uniqueItems": True}}}}}},
    {"properties": {"b": {"prefixItems": [{"type": "integer"}, {"type": "string"}], "items": {"multipleOf": 2}}, "n": {"$ref": "#"}}, "unevaluatedProperties": {"type": ["integer", "array", "object"]}},
]
DOCUMENTS = [
    *({}, {"a": 1}, {"a": "xy", "b": []}, {"a": 5, "b": [1, 4]}, {"b": [1, "s", 3]}, {"b": [2, "s", 4], "z": 1}, {"p1": "2024-01-01", "a": "q"}, {"p1": "no", "a": 3, "other": 7}),
    *({"n": {"n": {"n": {"b": ["x"]}}}, "a": 2}, {"b": [1, 1]}, {"abc": 1, "a": 9}, [1], "text", 5, None, {"b": {"a": 1}}),
]


@pytest.mark.parametrize("mode", ["compat", "spec"])
@pytest.mark.parametrize("rules", range(len(RULES)))
def test_all_ways_of_judging_agree(spark, rules, mode):
    """Verdicts and records of one schema as an expression, and with so many more nodes that it is judged over parsed documents."""
    schema = RULES[rules]
    wide = schema | {"$defs": {"all": {f"k{k}": {"type": "null"} for k in range(3100)}}, "allOf": [{"properties": {"none": {"properties": {f"k{k}": {"type": "null"} for k in range(3100)}}}}]}
    texts = [json.dumps(d) for d in DOCUMENTS] + ["{bad", '{"a": 1, "a": 2}', ""]
    df = spark.createDataFrame(list(enumerate(texts)) + [(99, None)], "k int, doc string")
    narrow, broad = Validator(schema, mode=mode), Validator(wide, mode=mode)
    assert broad.rules.shape()[0] and not narrow.rules.shape()[0]
    told = lambda v: sorted((r.k, r.ok, sorted(map(tuple, r.found), key=str)) for r in df.select("k", v.valid(F.col("doc")).alias("ok"), v.errors(F.col("doc")).alias("found")).collect())
    a, b = told(narrow), told(broad)
    assert a == b
    assert all(ok == (not found) for _, ok, found in a)
    assert [r[1] for r in a[len(DOCUMENTS) : -1]] == [False] * 3
    good, bad = narrow.split(df, "doc")
    assert good.count() == sum(ok for _, ok, _ in a) and bad.count() == sum(not ok for _, ok, _ in a)
    marked = {r.k: r.valid for r in narrow.mark(df, "doc").collect()}
    assert marked == {k: ok for k, ok, _ in a}


def test_typed_columns_are_judged_as_their_json(spark):
    rows = [(k, None if k % 4 == 0 else k / 2, "xyz"[: k % 4], [k, None][: k % 3], {"a": k % 3, "bb": None}, (k, "s")) for k in range(24)]
    df = spark.createDataFrame(rows, "n long, d double, s string, l array<int>, m map<string,int>, o struct<i:int,t:string>")
    rules = [
        {"properties": {"d": {"type": "integer"}, "n": {"minimum": 3, "exclusiveMaximum": 20}}},
        {"properties": {"l": {"items": {"type": "integer"}, "maxItems": 1}}},
        {"required": ["d"], "properties": {"s": {"minLength": 1, "pattern": "^xy?$"}}},
        {"properties": {"m": {"additionalProperties": {"type": ["integer", "null"], "maximum": 1}, "propertyNames": {"maxLength": 2}}}},
        {"properties": {"o": {"properties": {"i": {"multipleOf": 3}}, "additionalProperties": False}}},
        {"additionalProperties": {"type": ["number", "string", "array", "object"]}, "minProperties": 6},
        {"properties": {"o": {"const": {"t": "s", "i": 4}}, "l": {"enum": [[], [1, None]]}}},
    ]
    for schema in rules:
        v = Validator(schema)
        text = df.withColumn("text", F.to_json(F.struct(*df.columns)))
        a = [r[0] for r in v.mark(df, None).select("valid").collect()]
        assert a == [r[0] for r in v.mark(text, "text").select("valid").collect()]
        assert a == [r[0] == 0 for r in v.with_errors(df, None).select(F.size("errors")).collect()]
        assert v.filter(df).count() == sum(a)
    assert Validator({"properties": {"n": {"type": "number"}}}).mark(df, None)._jdf.queryExecution().optimizedPlan().toString().count("isnull") == 0


def test_plans_parse_once_and_reach_the_scan(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    events = spark.read.parquet(f"{SF}/events.parquet")
    v = Validator(registered.EVENT)
    for df in (v.mark(events, "props"), v.report(events, "props", "event_type"), v.filter(events, "props")):
        assert plan(df).count("parseJson(") <= 2  # once in the plan, and once more in the scan's list of filters
    assert "GreaterThanOrEqual(l_quantity,10.0)" in plan(registered.queries()["typed_filter"](spark, SF))


def test_references_that_lead_back_to_themselves_do_not_compile():
    for schema in ({"$ref": "#"}, {"allOf": [{"$ref": "#/$defs/a"}], "$defs": {"a": {"anyOf": [{"$ref": "#"}]}}}):
        with pytest.raises(SchemaError):
            Rules(schema).shape()


def test_meta_schemas_judge_schemas(spark):
    from veridoc.plans.engine import Engine

    for version, name in ((6, "http://json-schema.org/draft-06/schema#"), (7, "http://json-schema.org/draft-07/schema#"), (2019, "https://json-schema.org/draft/2019-09/schema"), (2020, "https://json-schema.org/draft/2020-12/schema")):
        engine = Engine().add_draft(version)
        good = {"$schema": name, "type": "object", "properties": {"a": {"minimum": 1, "pattern": "a+"}}, "required": ["a"]}
        assert engine.validate_schema(good)
        for bad in ({"type": "nothing"}, {"properties": {"a": {"minimum": "1"}}}, {"pattern": "("} if version < 2019 else {"pattern": 5}, {"not": {"allOf": []}}):
            assert not engine.validate_schema({"$schema": name, **bad})
    assert not Engine().add_draft(6).validate_schema({"enum": []}) and not Engine().add_draft(6).validate_schema({"enum": [1, 1]})


def test_quarantine_of_a_stream(spark, tmp_path):
    from veridoc.streaming.validate import quarantine

    spark.createDataFrame([('{"k": 1}',), ('{"k": 99}',), ("{bad",)], "props string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("props string").parquet(str(tmp_path / "in"))
    quarantine(stream, "props", Validator(registered.EVENT), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "point")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    assert sorted(r.errors[0].keyword for r in spark.read.parquet(str(tmp_path / "bad")).collect()) == ["maximum", "parse"]


#: Schemas whose verdict hangs on patterns and formats in other ways than that all must hold, with the verdict on a text at the end of a list.
QUESTIONS = [
    ({"pattern": "^a", "format": "ipv4"}, lambda t: False),
    ({"pattern": "[05]$"}, lambda t: t[-1] in "05"),
    ({"not": {"pattern": "[05]$"}}, lambda t: t[-1] not in "05"),
    ({"anyOf": [{"pattern": "0$"}, {"pattern": "5$"}]}, lambda t: t[-1] in "05"),
    ({"oneOf": [{"pattern": "[05]$"}, {"pattern": "[56]$"}]}, lambda t: t[-1] in "06"),
    ({"if": {"pattern": "5$"}, "then": {"minLength": 2}, "else": {"format": "numeric", "pattern": "^1"}}, lambda t: len(t) > 1 if t[-1] == "5" else t[0] == "1"),
]


@pytest.mark.parametrize("asked", range(len(QUESTIONS)))
def test_open_questions_below_the_unrolled_depth(spark, asked):
    rule, expected = QUESTIONS[asked]
    df = spark.createDataFrame([(k % 30, n, '{"next":' * n + f'{{"v":"{k % 30}"}}' + "}" * n) for k in range(60) for n in (0, 4, 5, 6, 9)] + [(-1, 0, None), (-2, 0, "{")], "k int, n int, doc string")
    rows = Validator({"properties": {"v": rule, "next": {"$ref": "#"}}}).mark(df, "doc").collect()
    assert len(rows) == 302 and all(r.valid == (r.k == -1 if r.k < 0 else expected(str(r.k))) for r in rows)


def test_conjunctions_of_questions_need_no_second_pass():
    rules = Rules({"properties": {"v": {"pattern": "a", "format": "numeric"}, "next": {"$ref": "#"}}})
    listed = rules.rules()
    told = _told(rules, Book(listed), '{"next":{"v":"5"}}', False)
    assert told == (None, None, [0, 1], ['"5"', '"5"'], True) and listed[0] == ("pattern", "a")
    rules = Rules({"not": {"pattern": "a"}})
    assert _told(rules, Book(rules.rules()), '"5"', False) == (None, None, [0], ['"5"'], False)


@pytest.mark.parametrize("name", ["deep_custom_format", "deep_pattern", "kw_ref_recursive", "wide_schema"])
def test_documents_are_judged_on_all_cores(spark, name):
    """The tables are one file each, of one part."""
    assert registered.queries()[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_a_schema_is_read_once_for_all_documents():
    """What a schema asks is found once, not for each value."""

    class Counting(dict):
        n = 0

        def get(self, *a):
            Counting.n += 1
            return super().get(*a)

    rules, told = Rules(Counting(properties={"v": {"type": "integer"}, "next": {"$ref": "#"}}, additionalProperties=False)), []
    for n in (13, 13):
        Counting.n = 0
        assert judge_document(rules, json.loads('{"next":' * n + '{"v":1}' + "}" * n))
        told.append(Counting.n)
    assert told[1] <= 14 * 4, told


def test_records_are_made_once(spark):
    """inline brings a filter on the number of records along; it must not be worked out from the text again, nor below an exchange."""
    plan = registered.queries()["error_records_nested"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson(") == 1 and registered.queries()["error_records_nested"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    for name in ("error_records", "corrupt_json_records"):
        assert registered.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().count("parseJson(") == 1


def test_objects_and_arrays_are_told_apart_from_all_else(spark):
    texts = ["{}", '{"a":{"b":[1]}}', "[]", '[1,"a",null,{"a":2},[1]]', "1", '"{}"', "null", "true", "1.5", '{"struct":null}', "[[]]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = Validator({"type": "object"}).mark(df, "t", "o").select("t", "o", Validator({"type": "array"}).valid(F.col("t")).alias("a")).collect()
    assert all((r.o, r.a) == (r.t[0] == "{", r.t[0] == "[") for r in rows)
