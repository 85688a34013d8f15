"""Scalar and vector math against plain Python."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from veridoc.functions import calc
from veridoc.functions.calc import F64, I32, VEC2, VEC2I, VEC3


def one(spark, *columns):
    return tuple(spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(columns))).first())


L = F.lit


def same(got, want):
    for g, w in zip(got, want, strict=True):
        if isinstance(w, float) and math.isnan(w):
            assert math.isnan(g)
        elif isinstance(w, float) and math.isfinite(w):
            assert g == pytest.approx(w, rel=1e-12, abs=1e-12)
        else:
            assert g == w


def test_division_by_zero_is_ieee(spark):
    got = one(spark, calc.divide(L(1), L(0)), calc.divide(L(-1), L(0)), calc.divide(L(0), L(0)), F64.norm(L(3.0), L(1.0), L(1.0)), calc.smallest(L(1.0), L(math.nan)), calc.largest(L(1.0), L(math.nan)))
    same(got, (math.inf, -math.inf, math.nan, math.inf, math.nan, math.nan))


def test_f64(spark):
    r = -2.0
    s = 4 / math.pi * r + 4 / math.pi**2 * r * r
    got = one(spark, F64.gcd(L(1024), L(768)), F64.fib(L(1)), F64.fib(L(10)), F64.fib(L(0)), F64.fib2(L(10)), F64.lerp(L(0.5), L(2.0), L(4.0)), F64.lerp(L(0.5), L(2.0), L(4.0), fixed=True), F64.sin_lp(L(r)), F64.sin_mp(L(r)), F64.wrap_radians(L(4.0)), F64.to_radian(L(180.0)), F64.clamp(L(5), L(9), L(7)))
    same(got, (256.0, 0.0, 34.0, None, 55.0, 5.0, 3.0, s, 0.225 * (s * abs(s) - s) + s, 4.0 - 2 * math.pi, math.pi, 7))


def test_isqrt_is_close(spark):
    rows = spark.createDataFrame([(4.0,), (0.01,), (None,)], "n double").select(F64.isqrt(F.col("n")).alias("r")).collect()
    assert rows[0].r == pytest.approx(0.5, rel=2e-3)
    assert rows[1].r == pytest.approx(10, rel=2e-3)
    assert rows[2].r is None


def test_i32_wraps(spark):
    big = 2**31 - 1
    got = one(spark, calc.i32(L(2.0**31)), calc.i32(L(-3.7)), calc.i32(L(math.nan)), calc.i32(L(2.0**63 + 2**40 + 2**12)), I32.mag2(L(-(2**31)), L(-(2**31))), I32.mag2(L(65536), L(1)), I32.hypot(L(3), L(4)), I32.hypot_ex(L(1), L(1)), I32.norm(L(5), L(1), L(1)), I32.norm(L(9), L(1), L(3)), I32.map(L(5), L(0), L(10), L(0), L(3)), I32.clampu_u8b(L(300)), I32.clampu_u8a(L(300)), I32.in_range(L(5), L(9), L(1)), I32.wrap_radians(L(40000)), I32.to_radian_ex(L(90)), I32.fib(L(50)), I32.dot(L(big), L(2), L(2), L(0)))
    a, b = 0, 1
    for _ in range(49):
        a, b = b, a + b
    fib = (a + 2**31) % 2**32 - 2**31
    assert got == (-(2**31), -3, 0, 4096, 0, 1, 5, 14142, 0, 4, 2, -1, 255, True, 40000 - 62830, 15707, fib, -2)


def test_vectors(spark):
    a, b = VEC2.new(L(3), L(4)), VEC2.new(L(0), L(2))
    got = one(spark, VEC2.unit(a), VEC2.div(a, b), VEC2.inv(b), VEC2.addms(a, b, 2.0), VEC2.rot90(a), VEC2.equals(a, VEC2.adds(a, 1e-7)), VEC2.eqstrict(a, VEC2.adds(a, 1e-7)), VEC2.dist(a, b), VEC2.cross3(a, b, VEC2.zero), VEC2.lerp(L(0.5), a, b), VEC2.round(VEC2.new(L(-3.5), L(2.5))), calc.about(a, a, L(1.0)))
    assert [tuple(x) if isinstance(x, tuple) else x for x in got] == [(0.6, 0.8), (math.inf, 2.0), (math.inf, 0.5), (3.0, 8.0), (-4.0, 3.0), True, False, math.sqrt(13), 6.0, (-10.5, -9.0), (-3.0, 3.0), (3.0, 4.0)]
    i = VEC2I.new(L(7.9), L(-8))
    c = VEC3.new(L(1), L(2), L(3))
    got = one(spark, VEC2I.divs(i, 2), VEC2I.norm(i), VEC2I.mag2(VEC2I.new(L(65536), L(0))), VEC2I.theta_ex(i), VEC3.neg(c), calc.cross2i(i, VEC2I.new(L(1), L(1))))
    assert [tuple(x) if isinstance(x, tuple) else x for x in got] == [(3, -4), (0, 0), 0, int(10000 * math.atan2(-8, 7)), (-1.0, -2.0, -3.0), 15]
