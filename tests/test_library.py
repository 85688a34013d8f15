"""Pointers, results and type tests."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veridoc.functions import calc, kinds
from veridoc.plans.pointers import JsonPointerOptions, TraverseOptions, create_pointer, decode_path, encode_path
from veridoc.plans.registry import SchemaError
from veridoc.plans.results import ValidationResult


def test_pointers():
    p = create_pointer("item?q=1#/a/b", "http://x.example/root")
    assert p == ("http://x.example/item#/a/b", "q=1", "http://x.example/item#", "/a/b")
    assert create_pointer("#here", "http://x.example/root").id == "#here"
    assert create_pointer("#here", "http://x.example/root", JsonPointerOptions(anchors_global=False)).id == "http://x.example/root#here"
    assert create_pointer(None, "http://x.example/root#").fragment is None
    assert create_pointer("#9", "http://x.example/r", TraverseOptions().pointers).id == "http://x.example/r#"
    for bad in ((None, None), ("a", None), (" ", "")):
        with pytest.raises(SchemaError):
            create_pointer(*bad)
    keys = ["a b", "c/d", "e~f", "ü"]
    assert encode_path("#", *keys) == "#/a%20b/c~1d/e~0f/%C3%BC" and decode_path(encode_path("#", *keys)) == keys


def test_results(spark):
    r = ValidationResult().add_valid().add_valid(False).add_result(ValidationResult().add_match(False))
    assert r == (True, 2) and not r.is_valid() and ValidationResult().is_valid()
    df = spark.createDataFrame([(1,), (5,)], "n int")
    both = ValidationResult().add_match(F.col("n") > 2).add_valid(F.col("n") < 3)
    assert [(x.r.match, x.r.errors, x.ok) for x in df.select(both.column().alias("r"), both.is_valid().alias("ok")).collect()] == [(True, 1, False), (True, 1, False)]


def test_kinds(spark):
    fixed, loose = T.ArrayType(T.FloatType(), False), T.ArrayType(T.FloatType(), True)
    assert kinds.is_typed_array(fixed) and not kinds.is_typed_array(loose) and kinds.is_arrayish(loose)
    assert kinds.is_map(T.MapType(T.StringType(), T.LongType())) and kinds.is_object(T.StructType()) and not kinds.is_set(loose)
    assert kinds.is_bigint(T.DecimalType(38, 0)) and not kinds.is_bigint(T.DecimalType(10, 0)) and kinds.is_object_of(loose, T.ArrayType)
    assert kinds.object_or(loose) is None and kinds.array_or(loose) is loose and kinds.is_scalar_name("bigint") and not kinds.is_scalar_name("object")
    assert kinds.callable_or(None)(5) is True and kinds.with_callables([len], [None, abs]) == [len, abs]
    df = spark.createDataFrame([("2024-01-01",), ("x",)], "s string")
    assert [x[0] for x in df.select(kinds.is_dateish(F.col("s"), T.StringType())).collect()] == [True, False]
    with pytest.raises(NotImplementedError):
        calc.F64.cos_hp(F.lit(1.0))
