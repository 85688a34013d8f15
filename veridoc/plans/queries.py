"""Registered queries of the schema engine: a keyword each, over whole tables, with the relational predicate as SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import scalars
from veridoc.functions.calc import F64, I32, VEC2, VEC2I, VEC3, cross2, cross3, i32
from veridoc.plans import catalog
from veridoc.plans.drafts import by_version
from veridoc.plans.registry import BigInt
from veridoc.plans.schema import Validator


class Case(NamedTuple):
    table: str
    key: str
    #: SQL expressions by key make an object of columns; a text is an expression for JSON text, or for a typed value.
    document: dict[str, str] | str
    schema: Any
    sql: str
    options: dict[str, Any] = {}
    typed: bool = False


#: Documents made of rows, as Spark SQL.
ORDER = {"key": "o_orderkey", "status": "o_orderstatus", "price": "o_totalprice", "day": "date_format(o_orderdate, 'yyyy-MM-dd')", "priority": "o_orderpriority", "late": "if(o_orderkey % 3 = 0, true, null)"}
LINE = {"quantity": "l_quantity", "discount": "l_discount", "flag": "l_returnflag", "number": "l_linenumber"}
PART = {"name": "p_name", "brand": "p_brand", "size": "p_size", "type": "p_type"}
VEC = "transform(embedding, x -> cast(x as double))"
SOME = f"filter({VEC}, x -> x > 0.2)"
V_SQL = "list_transform(embedding, lambda x: x::double)"
S_SQL = f"list_filter({V_SQL}, lambda x: x > 0.2)"


def as_text(document: dict[str, str] | str) -> str:
    """The same document as JSON text."""
    if isinstance(document, str):
        return f"to_json({document})"
    return f"to_json(named_struct({', '.join(f"'{k}', {e}" for k, e in document.items())}))"


def _order(schema: Any, sql: str) -> Case:
    return Case("orders", "o_orderkey", ORDER, schema, sql)


def _line(schema: Any, sql: str) -> Case:
    return Case("lineitem", "l_orderkey, l_linenumber, l_partkey", LINE, {"properties": schema}, sql)


def _part(schema: Any, sql: str) -> Case:
    return Case("part", "p_partkey", PART, schema, sql)


def _vec(schema: Any, sql: str, document: str = VEC) -> Case:
    return Case("embeddings", "vec_id", document, schema, sql, typed=True)


def _event(schema: Any, sql: str) -> Case:
    return Case("events", "event_id", "props", schema, sql)


POSITIVE = {"type": "number", "exclusiveMinimum": 0}
LATE = "o_orderkey % 3 = 0"
K = "(props->>'$.k')::double"
CASES: dict[str, Case] = {
    "kw_type_object": _event({"type": "object"}, "json_type(props) = 'OBJECT'"),
    "kw_type_integer": _event({"properties": {"k": {"type": "integer"}}}, f"{K} = floor({K})"),
    "kw_type_union": _line({"quantity": {"type": ["string", "integer"]}}, "l_quantity = floor(l_quantity)"),
    "kw_nullable": _order({"properties": {"late": {"type": "string", "nullable": True}}}, f"NOT ({LATE})"),
    "kw_const": _order({"properties": {"status": {"const": "F"}}}, "o_orderstatus = 'F'"),
    "kw_enum": _order({"properties": {"priority": {"enum": ["1-URGENT", "2-HIGH", None, 5]}}}, "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "kw_minimum": _line({"quantity": {"minimum": 25}}, "l_quantity >= 25"),
    "kw_maximum": _line({"quantity": {"maximum": 25}}, "l_quantity <= 25"),
    "kw_exclusive": _line({"quantity": {"exclusiveMinimum": 10, "minimum": 30, "exclusiveMaximum": 20}}, "l_quantity > 10 AND l_quantity < 20"),
    "kw_multiple_of": _line({"quantity": {"multipleOf": 3}}, "l_quantity % 3 = 0"),
    "kw_min_length": _part({"properties": {"name": {"minLength": 10}}}, "length(p_name) >= 10"),
    "kw_max_length": _part({"properties": {"name": {"maxLength": 10}}}, "length(p_name) <= 10"),
    "kw_length_not_string": _part({"properties": {"size": {"minLength": 1}}}, "false"),
    "kw_pattern": _part({"properties": {"brand": {"pattern": "^Brand#1[0-9]$"}}}, "regexp_matches(p_brand, '^Brand#1[0-9]$')"),
    "kw_required": _order({"required": ["key", "late"]}, LATE),
    "kw_properties": _order({"properties": {"price": {"maximum": 100000}, "status": {"enum": ["O", "P"]}}}, "o_totalprice <= 100000 AND o_orderstatus IN ('O', 'P')"),
    "kw_pattern_properties": _order({"patternProperties": {"^p": {"type": "string"}}}, "false"),
    "kw_additional_false": _order({"properties": dict.fromkeys(("key", "status", "price", "day", "priority"), True), "additionalProperties": False}, f"NOT ({LATE})"),
    "kw_additional_schema": _order({"properties": {"key": True, "price": True}, "patternProperties": {"^l": True}, "additionalProperties": {"type": "string", "minLength": 1}}, "length(o_orderstatus) >= 1"),
    "kw_property_names": _order({"propertyNames": {"pattern": "^[a-km-z]"}}, f"NOT ({LATE})"),
    "kw_min_max_properties": _order({"minProperties": 6, "maxProperties": 9}, LATE),
    "kw_dependent_required": _order({"dependentRequired": {"late": ["key", "missing"]}}, f"NOT ({LATE})"),
    "kw_dependent_schemas": _order({"dependentSchemas": {"late": {"properties": {"status": {"const": "F"}}}}}, f"NOT ({LATE}) OR o_orderstatus = 'F'"),
    "kw_dependencies": _order({"dependencies": {"late": {"properties": {"price": {"minimum": 50000}}}, "key": ["price"]}}, f"NOT ({LATE}) OR o_totalprice >= 50000"),
    "kw_items": _vec({"items": {"type": "number", "minimum": -0.35}}, f"len(list_filter({V_SQL}, lambda x: x < -0.35)) = 0"),
    "kw_tuple": _vec({"items": [POSITIVE, POSITIVE], "additionalItems": {"maximum": 0.35}}, f"({V_SQL})[1] > 0 AND ({V_SQL})[2] > 0 AND len(list_filter(({V_SQL})[3:], lambda x: x > 0.35)) = 0"),
    "kw_prefix_items": _vec({"prefixItems": [POSITIVE, {"maximum": 0.1}]}, f"({V_SQL})[1] > 0 AND ({V_SQL})[2] <= 0.1"),
    "kw_contains": _vec({"contains": {"exclusiveMinimum": 0.3}}, f"len(list_filter({V_SQL}, lambda x: x > 0.3)) >= 1"),
    "kw_min_max_contains": _vec({"contains": {"exclusiveMinimum": 0.25}, "minContains": 1, "maxContains": 2}, f"len(list_filter({V_SQL}, lambda x: x > 0.25)) BETWEEN 1 AND 2"),
    "kw_min_max_items": _vec({"minItems": 2, "maxItems": 4}, f"len({S_SQL}) BETWEEN 2 AND 4", SOME),
    "kw_unique_items": Case("lineitem", "l_orderkey, l_linenumber, l_partkey", "array(l_quantity, cast(l_linenumber as double), l_tax * 100)", {"uniqueItems": True}, "len(list_distinct([l_quantity, l_linenumber::double, l_tax * 100])) = 3", typed=True),
    "kw_all_of": _order({"allOf": [{"properties": {"price": {"minimum": 1000}}}, {"properties": {"status": {"const": "O"}}}]}, "o_totalprice >= 1000 AND o_orderstatus = 'O'"),
    "kw_any_of": _order({"anyOf": [{"properties": {"price": {"minimum": 300000}}}, {"properties": {"status": {"const": "O"}}}]}, "o_totalprice >= 300000 OR o_orderstatus = 'O'"),
    "kw_one_of": _order({"oneOf": [{"properties": {"price": {"minimum": 100000}}}, {"properties": {"status": {"const": "O"}}}]}, "(o_totalprice >= 100000) <> (o_orderstatus = 'O')"),
    "kw_not": _order({"not": {"properties": {"status": {"const": "O"}}}}, "o_orderstatus <> 'O'"),
    "kw_if_then_else": _order({"if": {"required": ["late"]}, "then": {"properties": {"price": {"minimum": 90000}}}, "else": {"properties": {"status": {"const": "F"}}}}, f"CASE WHEN {LATE} THEN o_totalprice >= 90000 ELSE o_orderstatus = 'F' END"),
    "kw_ref_local": _order({"properties": {"price": {"$ref": "#/definitions/big"}}, "definitions": {"big": {"minimum": 200000}}}, "o_totalprice >= 200000"),
    "kw_ref_chain": _order({"properties": {"price": {"$ref": "#/$defs/a"}}, "$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"maximum": 200000}}}, "o_totalprice <= 200000"),
    "kw_ref_anchor": _order({"properties": {"status": {"$ref": "#st"}}, "$defs": {"x": {"$anchor": "st", "enum": ["P"]}}}, "o_orderstatus = 'P'"),
    "fmt_date": _order({"properties": {"day": {"format": "date"}}}, "true"),
    "fmt_date_bounds": _order({"properties": {"day": {"format": "date", "formatMinimum": "1995-06-01", "formatExclusiveMaximum": "1997-01-01"}}}, "o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1997-01-01'"),
    "fmt_alpha": _part({"properties": {"name": {"format": "alpha"}}}, "regexp_full_match(p_name, '[a-zA-Z]+')"),
    "fmt_uppercase": _part({"properties": {"type": {"format": "uppercase"}}}, "p_type = upper(p_type)"),
    "fmt_int8": _order({"properties": {"price": {"format": "int8"}, "key": {"format": "uint8"}}}, "o_orderkey BETWEEN 0 AND 255 AND o_totalprice = floor(o_totalprice) AND o_totalprice BETWEEN -128 AND 127"),
    "fmt_uint16": _order({"properties": {"key": {"format": "uint16"}}}, "o_orderkey BETWEEN 0 AND 65535"),
}
TABLE_FORMATS = {"url": r"(?i)[(http(s)?):/(www\.)?\w\-/=#%&.]{2,}\.[a-z]{2,}[\w\-/=#%&.?]*", "uri": r"(?i)[a-z][a-z0-9+-.]*:(?:/?/)?[^\s]*", "uri-reference": r"(?i)(?:(?:[a-z][a-z0-9+-.]*:)?/?/)?(?:[^\\\s#][^\s#]*)?(?:#[^\\\s]*)?"}
for _name, _pattern in TABLE_FORMATS.items():
    CASES[f"fmt_{_name.replace('-', '_')}"] = Case("pages", "page_id", {"u": "url"}, {"properties": {"u": {"format": _name}}}, f"regexp_full_match(url, '{_pattern.replace(chr(39), chr(39) * 2)}')")


#: Texts made of an order's key, and which of them obey the format.
FORMATS: dict[str, tuple[str, str]] = {
    "alphanumeric": ("concat('a', k, if(k % 4 = 0, '_', ''))", "k % 4 <> 0"),
    "numeric": ("concat(if(k % 5 = 0, '-', ''), k)", "k % 5 <> 0"),
    "hexadecimal": ("concat(hex(k), if(k % 3 = 0, 'g', ''))", "k % 3 <> 0"),
    "color": ("concat('#', lpad(hex(k), 3 + k % 4, '0'))", "k % 4 IN (0, 3)"),
    "lowercase": ("if(k % 2 = 0, 'abc', 'aBc')", "k % 2 = 0"),
    "identifier": ("concat(if(k % 2 = 0, '_', '9'), k)", "k % 2 = 0"),
    "html-identifier": ("concat(if(k % 2 = 0, 'a:', ':'), k)", "k % 2 = 0"),
    "css-identifier": ("concat(if(k % 2 = 0, '-a', '-'), k)", "k % 2 = 0"),
    "uuid": ("concat(lpad(hex(k), 8, '0'), '-0000-4000-8000-', lpad(k, 11 + k % 2, '0'))", "k % 2 = 1"),
    "guid": ("concat('{', lpad(hex(k), 8, '0'), '-0000-4000-8000-', lpad(k, 11 + k % 2, '0'))", "k % 2 = 1"),
    "mac": ("concat_ws(':', '00', '1a', '2B', if(k % 3 = 0, 'zz', '33'), '44', lpad(hex(k % 256), 2, '0'))", "k % 3 <> 0"),
    "ipv4": ("concat_ws('.', k % 300, k % 7, '1', '2')", "k % 300 <= 255"),
    "ipv6": ("concat('::', lower(hex(k % 3 * 65535)))", "k % 3 <> 2"),
    "hostname": ("concat('h', k, if(k % 2 = 0, '-', ''), '.org')", "k % 2 = 1"),
    "idn-hostname": ("concat('b\u00fccher', k, if(k % 2 = 0, '.example', ''))", "k % 2 = 0"),
    "email": ("concat('u', k, if(k % 3 = 0, '', '@'), 'x.org')", "k % 3 <> 0"),
    "email--full": ("concat('u', k, '@x', if(k % 3 = 0, '', '.org'))", "k % 3 <> 0"),
    "idn-email": ("concat('\u00fc', k, '@x', if(k % 3 = 0, '', '.org'))", "k % 3 <> 0"),
    "uri--full": ("concat('http://x.org/', k, if(k % 2 = 0, ' ', '?q=1#f'))", "k % 2 = 1"),
    "uri-reference--full": ("concat('/a/', k, if(k % 2 = 0, '|', '?q=1'))", "k % 2 = 1"),
    "uri-template": ("concat('/a/{', if(k % 2 = 0, 'x', 'x y'), '}/', k)", "k % 2 = 0"),
    "iri": ("concat(if(k % 2 = 0, 'http:', ''), '//x.org/\u00fc', k)", "k % 2 = 0"),
    "iri-reference": ("concat('/\u00fc', k, if(k % 2 = 0, ' ', ''))", "k % 2 = 1"),
    "json-pointer": ("concat(if(k % 3 = 0, '', '/'), 'a', k)", "k % 3 <> 0"),
    "json-pointer-uri-fragment": ("concat('#/a', k, if(k % 3 = 0, '~', '~0'))", "k % 3 <> 0"),
    "relative-json-pointer": ("concat(k, if(k % 2 = 0, '#', 'x'))", "k % 2 = 0"),
    "isbn10": ("concat('ISBN ', lpad(k, 9 + k % 2, '0'))", "k % 2 = 1"),
    "isbn13": ("concat('ISBN-13: ', 977 + k % 3, lpad(k, 10, '0'))", "k % 3 <> 0"),
    "base64": ("concat(base64(cast(cast(k as string) as binary)), if(k % 3 = 0, 'x', ''))", "k % 3 <> 0"),
    "byte": ("concat(lpad(k, 8, '0'), if(k % 3 = 0, '?', ''))", "k % 3 <> 0"),
    "country2": ("concat(if(k % 2 = 0, 'nl', 'q0'), k)", "k % 2 = 0"),
    "iban": ("concat('NL91ABNA', lpad(k, 10, '0'), if(k % 2 = 0, '$', ''))", "k % 2 = 0"),
    "regex": ("concat('a', if(k % 2 = 0, '(b', '(b)'), k)", "k % 2 = 1"),
    "date-time": ("concat('2024-02-', lpad(20 + k % 12, 2, '0'), 't23:59:60Z')", "20 + k % 12 <= 29"),
    "time": ("concat(lpad(k % 30, 2, '0'), ':00:00+01:00')", "k % 30 <= 23"),
    "int16": ("k % 3 * 32767", "k % 3 <> 2"),
    "int32": ("k % 3 * 2147483647", "k % 3 <> 2"),
    "uint32": ("(k % 3 - 1) * 4294967295", "k % 3 <> 0"),
    "int64": ("k % 3 * 9007199254740991", "k % 3 <> 2"),
    "uint64": ("cast((k % 3 - 1) * 12 as string)", "k % 3 <> 0"),
    "float16": ("(k % 3) * 65504.0D", "k % 3 <> 2"),
    "float32": ("(k % 3) * 3.0e38D", "k % 3 <> 2"),
    "float": ("concat(k, if(k % 2 = 0, '.5e1', 'f'))", "k % 2 = 0"),
    "float64": ("if(k % 2 = 0, cast(k as string), 'none')", "k % 2 = 0"),
    "double": ("if(k % 2 = 0, '-1.5', '--1')", "k % 2 = 0"),
}
for _name, (_text, _sql) in FORMATS.items():
    _made = re.sub(r"\bk\b", "o_orderkey", _text)
    CASES[f"fmt_{_name.replace('--', '_').replace('-', '_')}"] = Case("orders", "o_orderkey", {"t": _made}, {"properties": {"t": {"format": _name}}}, re.sub(r"\bk\b", "o_orderkey", _sql))

#: A list nested by the order's key, up to 13 objects deep, so that some go beyond what a schema is unrolled to.
NESTED = """concat(repeat('{"next":', o_orderkey % 14), '{"v":', if(o_orderkey % 3 = 0, '"x"', '1'), '}', repeat('}', o_orderkey % 14))"""
NODE = {"properties": {"v": {"type": "integer"}, "next": {"$ref": "#"}}, "additionalProperties": False}
CASES |= {
    "kw_required_bool": Case("orders", "o_orderkey", "if(o_orderkey % 3 = 0, null, '1')", {"required": True}, "o_orderkey % 3 <> 0"),
    "kw_boolean_schema": _order({"properties": {"late": False}}, f"NOT ({LATE})"),
    "kw_enum_deep": Case("orders", "o_orderkey", {"a": "array(o_orderkey % 4, 1)", "b": "o_orderstatus"}, {"enum": [{"b": "O", "a": [1, 1]}, {"a": [2.0, 1], "b": "F"}]}, "o_orderkey % 4 = 1 AND o_orderstatus = 'O' OR o_orderkey % 4 = 2 AND o_orderstatus = 'F'"),
    "kw_ref_remote": Case("orders", "o_orderkey", ORDER, {"properties": {"price": {"$ref": "http://x.example/money#/$defs/price"}}}, "o_totalprice <= 100000", {"others": {"http://x.example/money": {"$defs": {"price": {"maximum": 100000}}}}}),
    "kw_ref_recursive": Case("orders", "o_orderkey", NESTED, NODE, "o_orderkey % 3 <> 0"),
    "kw_unevaluated_properties": Case("orders", "o_orderkey", ORDER, {"allOf": [{"properties": dict.fromkeys(("key", "price", "day", "priority"), True)}], "anyOf": [{"properties": {"status": {"const": "F"}}}, True], "unevaluatedProperties": {"type": "boolean"}}, "o_orderstatus = 'F'", {"mode": "spec"}),
    "kw_unevaluated_items": _vec({"prefixItems": [True], "contains": {"exclusiveMinimum": 0.3}, "unevaluatedItems": False}, f"len(list_filter({S_SQL}, lambda x: x > 0.3)) >= 1 AND len(list_filter(({S_SQL})[2:], lambda x: x <= 0.3)) = 0", SOME)._replace(options={"mode": "spec"}),
    "kw_dynamic_ref": Case("orders", "o_orderkey", ORDER, {"$id": "http://x.example/strict", "$dynamicAnchor": "node", "$ref": "http://x.example/open", "properties": {"price": {"maximum": 200000}}}, "o_totalprice <= 200000 AND o_orderstatus <> 'P'", {"mode": "spec", "others": {"http://x.example/open": {"$id": "http://x.example/open", "$dynamicAnchor": "node", "properties": {"status": {"not": {"const": "P"}}}}}}),
    "kw_strict_format": Case("orders", "o_orderkey", {"t": "if(o_orderkey % 2 = 0, cast(o_orderkey as string), null)", "n": "o_orderkey % 200"}, {"properties": {"t": {"format": "int32", "strictFormat": True}, "n": {"format": "int8", "strictFormat": True}}}, "o_orderkey % 2 = 1 AND o_orderkey % 200 <= 127"),
    "kw_exact_long": Case("orders", "o_orderkey", {"n": "o_orderkey % 5 + 9007199254740990"}, {"properties": {"n": {"type": "integer", "minimum": 9007199254740993}}}, "o_orderkey % 5 >= 3"),
    "kw_bigint": Case("orders", "o_orderkey", {"n": "cast(o_orderkey as decimal(38,0)) * 100000000000000000000"}, {"properties": {"n": {"type": "bigint", "minimum": BigInt(3 * 10**20), "exclusiveMaximum": BigInt(5 * 10**23), "multipleOf": BigInt(2 * 10**20), "maximum": 1}}}, "o_orderkey >= 3 AND o_orderkey < 5000 AND o_orderkey % 2 = 0"),
    "kw_id": Case("orders", "o_orderkey", ORDER, {"$id": "http://x.example/a/root", "properties": {"price": {"$ref": "item#/$defs/p"}}, "$defs": {"i": {"$id": "item", "$defs": {"p": {"maximum": 150000}}}}}, "o_totalprice <= 150000"),
    "deep_custom_format": Case("orders", "o_orderkey", """concat(repeat('{"next":', o_orderkey % 14), '{"v":', o_orderkey, '}', repeat('}', o_orderkey % 14))""", {"properties": {"v": {"format": "even"}, "next": {"$ref": "#"}}, "additionalProperties": False}, "o_orderkey % 2 = 0", {"custom": {"even": lambda v: F.try_variant_get(v, "$", "long") % 2 == 0}}),
    "deep_pattern": Case("orders", "o_orderkey", """concat(repeat('{"next":', o_orderkey % 14), '{"v":"', o_orderkey, '"}', repeat('}', o_orderkey % 14))""", {"properties": {"v": {"pattern": "[05]$", "format": "numeric"}, "next": {"$ref": "#"}}}, "o_orderkey % 5 = 0"),
    "wide_schema": Case("part", "p_partkey", f"to_json(named_struct({', '.join(f"'{k}', {e}" for k, e in PART.items())}))", {"properties": {"name": {"minLength": 8}, "brand": {"pattern": "[1-3]$"}, "size": {"format": "int8"}, **{f"p{k}": {"type": "integer"} for k in range(4000)}}}, "length(p_name) >= 8 AND regexp_matches(p_brand, '[1-3]$')"),
}

#: Schemas that rows make, good and bad ones by turns, judged against the published meta-schemas.
MADE = """element_at(array('{"type":"integer","minimum":1}', '{"type":"nothing"}', '{"enum":[]}', '{"enum":[1,1]}', '{"items":{"minLength":-1}}', 'true', '{"properties":{"a":{"required":["x","x"]}}}', '{"allOf":[]}', '{"if":{"type":5}}'), cast(s_suppkey % 9 as int) + 1)"""
#: Which of them each draft rejects.
REJECTED = {6: (1, 2, 3, 4, 6, 7), 7: (1, 2, 3, 4, 6, 7, 8), 2019: (1, 4, 6, 7, 8), 2020: (1, 4, 6, 7, 8)}
for _draft, _bad in REJECTED.items():
    _root, *_parts = by_version(_draft)[1]
    CASES[f"meta_draft_{_draft}"] = Case("supplier", "s_suppkey", MADE, _root, f"s_suppkey % 9 NOT IN ({', '.join(map(str, _bad))})", {"mode": "spec", "others": {p["$id"]: p for p in _parts}})


def spread(df: DataFrame) -> DataFrame:
    """A table's rows dealt over all cores, where its files make fewer parts: judging whole documents takes far longer than moving them."""
    parts = 3 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts)


def _run(case: Case) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{case.table}.parquet")
        keys, judge = [k.strip() for k in case.key.split(",")], Validator(case.schema, **case.options)
        if isinstance(case.document, dict):
            return judge.mark(df, case.document).select(*keys, "valid")
        if any(judge.rules.shape()) and not case.typed:
            df = spread(df)
        return judge.mark(df.select(*keys, F.expr(case.document).alias("document")), "document").select(*keys, "valid")

    return query


# The same rules over JSON text.
CASES |= {f"text_{name[3:]}": case._replace(document=as_text(case.document), typed=False) for name, case in CASES.items() if name.startswith("kw_") and (case.typed or isinstance(case.document, dict)) and name not in ("kw_bigint", "kw_exact_long")}


EVENT = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 49}}}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and valid events of each type: parse, validate and count in one pass."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Validator(EVENT).report(events, "props", "event_type")


def f64_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d, t = (F.col(c) for c in ("l_quantity", "l_discount", "l_tax"))
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F64.cross(q, d, t, q).alias("cross"), F64.mag2(q, t).alias("mag2"), F64.norm(q, F.lit(1.0), F.lit(50.0)).alias("norm"), F64.clamp(q, F.lit(30.0), F.lit(10.0)).alias("clamp"), F64.in_range(q, F.lit(5.0), F.lit(9.0)).alias("inside"))


def vec_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = VEC2.new(e(0), e(1)), VEC2.new(e(2), e(3))
    c, d = VEC3.new(e(0), e(1), e(2)), VEC3.new(e(3), e(4), e(5))
    return vectors.select("vec_id", VEC2.dot(a, b).alias("dot2"), cross2(a, b).alias("cross2"), VEC3.dot(c, d).alias("dot3"), cross3(c, d)["z"].alias("cross_z"), VEC2.add(a, b)["x"].alias("sum_x"))


#: Events of which some texts are cut off and some name a key twice.
CORRUPT = """case when event_id % 5 = 0 then left(props, length(props) - 1) when event_id % 7 = 0 then concat('{"k":1,', substring(props, 2)) else props end"""


def _corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", F.expr(CORRUPT).alias("props"))


def corrupt_json_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where corrupt texts go: the quarantine, whatever the schema asks."""
    good, bad = Validator({"properties": {"k": {"minimum": 0}}}).split(_corrupt(spark, sf_dir), "props")
    return good.select("event_id", F.lit(True).alias("valid")).union(bad.select("event_id", F.lit(False)))


def corrupt_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the records of corrupt texts say."""
    told = Validator({"type": "object"}).with_errors(_corrupt(spark, sf_dir), "props")
    return told.select("event_id", F.inline("errors")).select("event_id", "keyword", "schema_path", "data_path")


def corrupt_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Validator(True).report(_corrupt(spark, sf_dir), "props", "event_type")


#: A document with an object, a list and a map for records below all keywords.
NESTED_ORDER = """to_json(named_struct('price', o_totalprice, 'codes', array(o_orderkey % 4, o_orderkey % 3, 7), 'tags', map('a', o_orderstatus, concat('b', o_orderkey % 2), 'x')))"""
DEEP_RULES = {
    "properties": {"codes": {"items": {"maximum": 2}}, "price": {"anyOf": [{"minimum": 300000}, {"multipleOf": 2}]}, "tags": {"additionalProperties": {"enum": ["O", "x"]}, "propertyNames": {"pattern": "^(a|b0)$"}}},
    "not": {"required": ["none"]},
}


def error_records_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records below items, anyOf, additionalProperties and propertyNames, with the places in the documents."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus")).select("o_orderkey", F.expr(NESTED_ORDER).alias("document"))
    told = Validator(DEEP_RULES).with_errors(orders, "document")
    return told.select("o_orderkey", F.inline("errors")).select("o_orderkey", "keyword", "schema_path", "data_path")


def typed_error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over typed columns."""
    told = Validator({"properties": {"quantity": {"maximum": 45}, "flag": {"enum": ["A", "N"]}}}).with_errors(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), LINE)
    return told.select("l_orderkey", "l_linenumber", "l_partkey", F.inline("errors")).select("l_orderkey", "l_linenumber", "l_partkey", "keyword", "data_path", "value")


SOUND_LINE = {"required": ["l_quantity"], "properties": {"l_quantity": {"minimum": 10, "exclusiveMaximum": 40}, "l_returnflag": {"const": "N"}}}


def typed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows as documents: the valid ones; the comparisons reach the scan."""
    return Validator(SOUND_LINE).filter(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def typed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Validator(SOUND_LINE).report(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), None, "l_returnflag")


def quarantine_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the quarantine: those that the flagship schema rejects."""
    return Validator(EVENT).split(spark.read.parquet(f"{sf_dir}/events.parquet"), "props")[1].select("event_id", "event_type")


def error_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each keyword that an event fails."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Validator(EVENT).with_errors(events, "props").select("event_id", F.inline("errors"))


def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each keyword fails, over all events."""
    return error_records(spark, sf_dir).groupBy("schema_path").agg(F.count("*").alias("n"))


def f64_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges and rectangles that meet, the greatest common divisor, halves rounded up, division by zero."""
    q, d, n = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_linenumber")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", F64.intersects_range(q, q + 5, n * 6, F.lit(0)).alias("meets"), F64.intersects_rect(q, n, F.lit(3), F.lit(1), F.lit(10), F.lit(2), F.lit(9), F.lit(3)).alias("rects"), F64.gcd(q, n * 6).alias("gcd"), F64.lerp(q, n, n + 2).alias("lerp"), F64.lerp(q, n, n + 2, fixed=True).alias("lerp_fixed"), F64.sin_lp_ex(d - 5).alias("sine"))


def i32_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic that wraps at 32 bits."""
    k, q = F.col("l_partkey") * 100_003, F.col("l_quantity")
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n = F.col("l_linenumber")
    return line.select("l_orderkey", "l_linenumber", "l_partkey", I32.mag2(k, q).alias("mag2"), I32.cross(k, q, k + 1, n).alias("cross"), I32.hypot(q, n).alias("hypot"), I32.norm(q, n, F.lit(4)).alias("norm"), I32.clampu_u8a(q * 9).alias("byte"), I32.fib(q).alias("fib"))


def vec_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda k: F.col("embedding")[k].cast("double")
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = VEC2.new(e(0), e(1)), VEC2.new(e(2), e(3))
    i = VEC2I.new(e(4) * 1000, e(5) * 1000)
    return vectors.select("vec_id", VEC2.cross3(a, b, VEC2.zero).alias("side"), VEC2.dist(a, b).alias("dist"), VEC2.rot90(a)["x"].alias("turned"), VEC2.min(a, b)["y"].alias("least"), VEC2.div(a, VEC2.sub(b, b))["x"].alias("by_zero"), VEC2I.mag2(i).alias("mag2i"), VEC2I.divs(i, 7)["x"].alias("seventh"), i32(e(0) * 1e10).alias("wrapped"))


def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as numbers, floating-point neighbours, leap years."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    v = F.try_variant_get(F.try_parse_json("props"), "$.k", "variant")
    k = scalars.js_number(v)
    return events.select("event_id", k.alias("k"), scalars.is_intish(v).alias("whole"), scalars.is_valid_int(k, 8).alias("int8"), scalars.is_leap_year(F.year("ts")).alias("leap"), scalars.is_unique(F.array(k, F.lit(1.0))).alias("distinct_one"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (corrupt_json_split, corrupt_json_records, corrupt_json_report, error_records_nested, typed_error_records, typed_filter, typed_report)
    return {f.__name__: f for f in made} | {"quality_by_group": flagship, "quarantine_split": quarantine_split, "error_records": error_records, "error_report": error_report, "f64_scalars": f64_scalars, "f64_ranges": f64_ranges, "i32_scalars": i32_scalars, "vec_products": vec_products, "vec_operations": vec_operations, "scalar_helpers": scalar_helpers} | {name: _run(case) for name, case in CASES.items()} | catalog.queries()


def oracle_sql() -> dict[str, str]:
    good = f"{K} = floor({K}) AND {K} BETWEEN 0 AND 49"
    e = [f"embedding[{k + 1}]::double" for k in range(6)]
    tests = (("type", '"integer"', f"{K} <> floor({K})"), ("minimum", "0", f"{K} < 0"), ("maximum", "49", f"{K} > 49"))
    failed = (f"SELECT event_id, '{key}' AS keyword, '{expected}' AS expected, '#/properties/k/{key}' AS schema_path, '/k' AS data_path, props->>'$.k' AS value FROM events WHERE {test}" for key, expected, test in tests)
    missing = "SELECT event_id, 'required', '[\"k\"]', '#/required', '', props FROM events WHERE json_extract(props, '$.k') IS NULL"
    records = " UNION ALL ".join((*failed, missing))
    wrap = "((({0}) + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648".format
    part = f"({wrap('l_partkey::hugeint * 100003')})::double"
    pi = 3.141592653589793
    r = "(l_discount * 100 - 5)"
    fibonacci = [0, 1]
    while len(fibonacci) < 50:
        fibonacci.append((fibonacci[-1] + fibonacci[-2] + 2**31) % 2**32 - 2**31)
    line = "SELECT l_orderkey, l_linenumber, l_partkey,"
    corrupt = "event_id % 5 = 0 OR event_id % 7 = 0"
    codes = " UNION ALL ".join(f"SELECT o_orderkey, 'maximum', '#/properties/codes/items/maximum', '/codes/{k}' FROM orders WHERE {test}" for k, test in enumerate(("o_orderkey % 4 > 2", "false", "true")))
    dear = "o_totalprice >= 300000 OR o_totalprice % 2 = 0"
    nested = f"""SELECT o_orderkey, 'anyOf' AS keyword, '#/properties/price/anyOf' AS schema_path, '/price' AS data_path FROM orders WHERE NOT ({dear})
        UNION ALL SELECT o_orderkey, 'minimum', '#/properties/price/anyOf/0/minimum', '/price' FROM orders WHERE NOT ({dear})
        UNION ALL SELECT o_orderkey, 'multipleOf', '#/properties/price/anyOf/1/multipleOf', '/price' FROM orders WHERE NOT ({dear})
        UNION ALL {codes}
        UNION ALL SELECT o_orderkey, 'enum', '#/properties/tags/additionalProperties/enum', '/tags/a' FROM orders WHERE o_orderstatus <> 'O'
        UNION ALL SELECT o_orderkey, 'pattern', '#/properties/tags/propertyNames/pattern', '/tags/b1' FROM orders WHERE o_orderkey % 2 = 1"""
    sound = "l_quantity >= 10 AND l_quantity < 40 AND l_returnflag = 'N'"
    return {
        "corrupt_json_split": f"SELECT event_id, NOT ({corrupt}) AND {K} >= 0 AS valid FROM events",
        "corrupt_json_records": f"SELECT event_id, 'parse' AS keyword, '#' AS schema_path, '' AS data_path FROM events WHERE {corrupt}",
        "corrupt_json_report": f"SELECT event_type, count(*) AS n, count(*) FILTER (NOT ({corrupt})) AS n_valid FROM events GROUP BY event_type",
        "error_records_nested": nested,
        "typed_error_records": "SELECT l_orderkey, l_linenumber, l_partkey, 'maximum' AS keyword, '/quantity' AS data_path, l_quantity::varchar AS value FROM lineitem WHERE l_quantity > 45 UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'enum', '/flag', '\"' || l_returnflag || '\"' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')",
        "typed_filter": f"SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE {sound}",
        "typed_report": f"SELECT l_returnflag, count(*) AS n, count(*) FILTER ({sound}) AS n_valid FROM lineitem GROUP BY l_returnflag",
        "error_records": records,
        "error_report": f"SELECT schema_path, count(*) AS n FROM ({records}) GROUP BY schema_path",
        "f64_ranges": f"{line} l_linenumber * 6 >= l_quantity AND l_quantity + 5 >= 0 AS meets, l_quantity <= 19 AND l_quantity + 3 >= 10 AND l_linenumber <= 5 AND l_linenumber + 1 >= 2 AS rects, gcd(l_quantity::bigint, l_linenumber::bigint * 6)::double AS gcd, 2 * (l_quantity + l_linenumber) AS lerp, l_linenumber + l_quantity * 2 AS lerp_fixed, CASE WHEN {r} < 0 THEN {4 / pi!r} * {r} + {4 / pi**2!r} * {r} * {r} ELSE {4 / pi!r} * {r} - {4 / pi**2!r} * {r} * {r} END AS sine FROM lineitem",
        "i32_scalars": f"{line} ({wrap(f'{part} * {part} + l_quantity * l_quantity')})::int AS mag2, ({wrap(f'{part} * l_linenumber - (' + wrap('l_partkey::hugeint * 100003 + 1') + ')::double * l_quantity')})::int AS \"cross\", floor(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber))::int AS hypot, CASE WHEN l_linenumber = 4 THEN 0 ELSE trunc((l_quantity - l_linenumber) / (4.0 - l_linenumber)) END::int AS norm, least(l_quantity * 9, 255)::int AS byte, ([{', '.join(map(str, fibonacci))}])[l_quantity::int]::int AS fib FROM lineitem",
        "vec_operations": f"SELECT vec_id, ({e[2]} - {e[0]}) * (0 - {e[1]}) - ({e[3]} - {e[1]}) * (0 - {e[0]}) AS side, sqrt(0.0::double + ({e[2]} - {e[0]}) * ({e[2]} - {e[0]}) + ({e[3]} - {e[1]}) * ({e[3]} - {e[1]})) AS dist, -{e[1]} AS turned, least({e[1]}, {e[3]}) AS least, CASE WHEN {e[0]} > 0 THEN 'inf'::double WHEN {e[0]} < 0 THEN '-inf'::double ELSE 'nan'::double END AS by_zero, (trunc({e[4]} * 1000)::bigint * trunc({e[4]} * 1000)::bigint + trunc({e[5]} * 1000)::bigint * trunc({e[5]} * 1000)::bigint)::int AS mag2i, trunc(trunc({e[4]} * 1000) / 7)::int AS seventh, ({wrap(f'trunc({e[0]} * 1e10)::hugeint')})::int AS wrapped FROM embeddings",
        "scalar_helpers": f"SELECT event_id, {K} AS k, coalesce({K} = floor({K}), false) AS whole, coalesce({K} = floor({K}) AND {K} BETWEEN -128 AND 127, false) AS int8, year(ts) % 4 = 0 AND (year(ts) % 100 <> 0 OR year(ts) % 400 = 0) AS leap, {K} IS DISTINCT FROM 1 AS distinct_one FROM events",
        "quality_by_group": f"SELECT event_type, count(*) AS n, count(*) FILTER ({good}) AS n_valid FROM events GROUP BY event_type",
        "quarantine_split": f"SELECT event_id, event_type FROM events WHERE NOT coalesce({good}, false)",
        "f64_scalars": "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * l_quantity - l_tax * l_discount AS \"cross\", l_quantity * l_quantity + l_tax * l_tax AS mag2, (l_quantity - 1) / 49 AS norm, greatest(10.0, least(l_quantity, 30.0)) AS clamp, l_quantity BETWEEN 5 AND 9 AS inside FROM lineitem",
        "vec_products": f"SELECT vec_id, 0.0::double + {e[0]} * {e[2]} + {e[1]} * {e[3]} AS dot2, {e[0]} * {e[3]} - {e[1]} * {e[2]} AS cross2, 0.0::double + {e[0]} * {e[3]} + {e[1]} * {e[4]} + {e[2]} * {e[5]} AS dot3, {e[0]} * {e[4]} - {e[1]} * {e[3]} AS cross_z, {e[0]} + {e[2]} AS sum_x FROM embeddings",
    } | {name: f"SELECT {case.key}, coalesce({case.sql}, true) AS valid FROM {case.table}" for name, case in CASES.items()} | catalog.oracle_sql()
