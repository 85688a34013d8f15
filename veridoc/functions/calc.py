"""Floating-point, 32-bit and vector math on Columns. Vectors are structs of x, y (and z).

Division never fails: by zero it gives infinity or NaN, as IEEE 754 has it. lerp and map keep the formula (high - low) * (norm + low)
unless `fixed` is asked for. All of it is built-in functions, but for isqrt, whose bit trick needs an Arrow UDF.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Fixed-point scale of the 32-bit angles, and the angles themselves.
SCALE = 10_000
PI_I32, PI41_I32, PI42_I32 = (int(SCALE * x) for x in (math.pi, 4 / math.pi, 4 / math.pi**2))
PI2_I32, PI1H_I32 = 2 * PI_I32, PI_I32 // 2
PI41, PI42, SQRT5 = 4 / math.pi, 4 / math.pi**2, math.sqrt(5)
INF = float("inf")


def rounded(x: Column) -> Column:
    """Halves go toward plus infinity."""
    return F.floor(x + 0.5).cast("double")


def i32(x: Column) -> Column:
    """Wrap a number in double precision to 32 bits with a sign; fractions are cut off, what isn't finite is 0.

    x stands in the expression once, so that nested calls don't multiply.
    """
    low = F.nanvl(F.try_mod(x.cast("double"), F.lit(2.0**32)), F.lit(0.0)).cast("long")
    return F.shiftright(F.shiftleft(low, 32), 32).cast("int")


def divide(a: Column, b: Column) -> Column:
    """a / b in double precision; by zero: infinity, or NaN for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def smallest(*xs: Column) -> Column:
    """NaN if any is NaN."""
    bad = F.lit(False)
    for x in xs:
        bad = bad | F.isnan(x)
    return F.when(bad, float("nan")).otherwise(F.least(*xs))


def largest(*xs: Column) -> Column:
    """NaN if any is NaN, as Spark holds NaN for the greatest."""
    return F.greatest(*xs)


@F.pandas_udf(DoubleType())
def _isqrt(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for n in batches:
        x = n.to_numpy(dtype=np.float64, na_value=np.nan)
        guess = (np.int32(0x5F375A86) - (x.astype(np.float32).view(np.int32) >> 1)).view(np.float32).astype(np.float64)
        yield pd.Series(guess * (1.5 - 0.5 * x * guess * guess)).where(n.notna())


def _fibonacci(n: Column, kind: str, add) -> Column:
    """The number before the n-th, counted from 1; null below 1 and for fractions."""
    zero, one = F.lit(0).cast(kind), F.lit(1).cast(kind)
    pair = F.aggregate(F.sequence(F.lit(1), n.cast("int")), F.struct(one.alias("a"), zero.alias("b")), lambda s, _: F.struct(s["b"].alias("a"), add(s["a"], s["b"]).alias("b")))
    return F.when((n >= 1) & (n == F.floor(n)), pair["a"])


class F64:
    """Scalars in double precision."""

    cross = staticmethod(lambda ax, ay, bx, by: ax * by - bx * ay)
    dot = staticmethod(lambda ax, ay, bx, by: ax * bx + ay * by)
    mag2 = staticmethod(lambda dx, dy: dx * dx + dy * dy)
    mag = staticmethod(lambda dx, dy: F.sqrt(dx * dx + dy * dy))
    sqrt = staticmethod(F.sqrt)
    isqrt = staticmethod(lambda n: _isqrt(n.cast("double")))
    norm = staticmethod(lambda value, low, high: divide(value - low, high - low))
    clampu = staticmethod(lambda value, low, high: F.greatest(low, F.least(value, high)))
    clamp = staticmethod(lambda value, low, high: F.greatest(F.least(low, high), F.least(value, F.greatest(low, high))))
    in_range = staticmethod(lambda value, low, high: (value >= F.least(low, high)) & (value <= F.greatest(low, high)))
    intersects_range = staticmethod(lambda a, b, c, d: (F.greatest(a, b) >= F.least(c, d)) & (F.least(a, b) <= F.greatest(c, d)))
    to_radian = staticmethod(lambda degrees: degrees * math.pi / 180)
    to_degrees = staticmethod(lambda radians: radians * 180 / math.pi)
    wrap_radians = staticmethod(lambda r: F.when(r < -math.pi, r + 2 * math.pi).when(r > math.pi, r - 2 * math.pi).otherwise(r))
    theta = staticmethod(lambda x, y: F.atan2(y, x))
    angle = theta
    phi = staticmethod(lambda y, length: F.asin(divide(y, length)))
    sin_lp_ex = staticmethod(lambda r: F.when(r < 0, PI41 * r + PI42 * r * r).otherwise(PI41 * r - PI42 * r * r))
    sin_lp = staticmethod(lambda r: F64.sin_lp_ex(F64.wrap_radians(r)))
    cos_lp = staticmethod(lambda r: F64.sin_lp(r + math.pi / 2))
    sin_mp = staticmethod(lambda r: F64.sin_mp_ex(F64.wrap_radians(r)))
    cos_mp = staticmethod(lambda r: F64.sin_mp(r + math.pi / 2))
    random = staticmethod(F.rand)

    @staticmethod
    def cos_hp(r: Column) -> Column:
        """Declared, and not to be had: there is no formula for it."""
        raise NotImplementedError("cos_hp has no formula")

    @staticmethod
    def sin_mp_ex(r: Column) -> Column:
        s = F64.sin_lp_ex(r)
        return 0.225 * (s * F.abs(s) - s) + s

    @staticmethod
    def gcd(a: Column, b: Column) -> Column:
        """Euclid's algorithm on doubles; a pair of doubles needs at most some 1,500 steps, whole numbers below 2^53 at most 78."""
        start = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))
        step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), F.coalesce(F.try_mod(s["a"], s["b"]), F.lit(0.0)).alias("b")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, step)["a"]

    @staticmethod
    def fib(n: Column) -> Column:
        return _fibonacci(n, "double", lambda a, b: a + b)

    @staticmethod
    def fib2(n: Column) -> Column:
        """The n-th number by the closed form."""
        return rounded((F.pow(F.lit((1 + SQRT5) / 2), n) - F.pow(F.lit((1 - SQRT5) / 2), n)) * (1 / SQRT5))

    @staticmethod
    def lerp(norm: Column, low: Column, high: Column, fixed: bool = False) -> Column:
        return low + norm * (high - low) if fixed else (high - low) * (norm + low)

    @staticmethod
    def map(value: Column, low: Column, high: Column, to_low: Column, to_high: Column, fixed: bool = False) -> Column:
        return F64.lerp(F64.norm(value, low, high), to_low, to_high, fixed)

    @staticmethod
    def intersects_rect(ax, ay, aw, ah, bx, by, bw, bh) -> Column:
        return F64.intersects_range(ax, ax + aw, bx, bx + bw) & F64.intersects_range(ay, ay + ah, by, by + bh)


def _wrapped(x: Column) -> Column:
    """Wrapped, and in double precision again for what is calculated with it."""
    return i32(x).cast("double")


class I32:
    """Scalars wrapped to 32 bits; every argument is wrapped first."""

    mag2 = staticmethod(lambda dx, dy: i32(_wrapped(dx) * _wrapped(dx) + _wrapped(dy) * _wrapped(dy)))
    dot = staticmethod(lambda ax, ay, bx, by: i32(_wrapped(ax) * _wrapped(bx) + _wrapped(ay) * _wrapped(by)))
    cross = staticmethod(lambda ax, ay, bx, by: i32(_wrapped(ax) * _wrapped(by) - _wrapped(bx) * _wrapped(ay)))
    sqrt = staticmethod(lambda n: i32(F.sqrt(_wrapped(n))))
    sqrt_ex = staticmethod(lambda n: i32(SCALE * F.sqrt(_wrapped(n))))
    hypot = staticmethod(lambda dx, dy: I32.sqrt(I32.mag2(dx, dy)))
    hypot_ex = staticmethod(lambda dx, dy: I32.sqrt_ex(I32.mag2(dx, dy)))
    fib = staticmethod(lambda n: _fibonacci(i32(n), "int", lambda a, b: i32(a.cast("double") + b)))
    norm = staticmethod(lambda value, low, high: i32(divide(_wrapped(value) - _wrapped(low), _wrapped(high) - _wrapped(low))))
    map = staticmethod(lambda value, low, high, to_low, to_high: i32(rounded(divide((value - low) * (to_high - to_low), high - low) + to_low)))
    clamp = staticmethod(lambda value, low, high: F64.clamp(i32(value), i32(low), i32(high)))
    clampu = staticmethod(lambda value, low, high: F64.clampu(i32(value), i32(low), i32(high)))
    clampu_u8a = staticmethod(lambda value: F64.clampu(i32(value), F.lit(0), F.lit(255)))
    in_range = staticmethod(lambda value, low, high: F64.in_range(i32(value), i32(low), i32(high)))
    intersects_range = staticmethod(lambda a, b, c, d: F64.intersects_range(i32(a), i32(b), i32(c), i32(d)))
    intersects_rect = staticmethod(lambda *sides: F64.intersects_rect(*(_wrapped(s) for s in sides)))
    to_radian_ex = staticmethod(lambda degrees: i32(divide(_wrapped(degrees) * PI_I32, F.lit(180))))
    to_degrees_ex = staticmethod(lambda radians: i32(divide(SCALE * _wrapped(radians) * 180, F.lit(PI_I32))))
    sin_lp = staticmethod(lambda r: I32.sin_lp_ex(I32.wrap_radians(r)))
    random = staticmethod(F.rand)

    @staticmethod
    def clampu_u8b(value: Column) -> Column:
        """What is over 255 becomes -1, which is 255 in a byte without sign."""
        value = i32(value)
        return F.when(value < 0, 0).when(value > 255, -1).otherwise(value)

    @staticmethod
    def lerp(norm: Column, low: Column, high: Column, fixed: bool = False) -> Column:
        return i32(F64.lerp(_wrapped(norm), _wrapped(low), _wrapped(high), fixed))

    @staticmethod
    def wrap_radians(r: Column) -> Column:
        r = i32(r)
        return F.when(r > PI_I32, r - PI2_I32).when(r < -PI_I32, r + PI2_I32).otherwise(r)

    @staticmethod
    def sin_lp_ex(r: Column) -> Column:
        r = _wrapped(r)
        return i32(F.when(r < 0, PI41_I32 * r + PI42_I32 * r * r).otherwise(PI41_I32 * r - PI42_I32 * r * r))


class Vector:
    """Operations field by field on structs of the given fields; nothing changes in place."""

    def __init__(self, fields: str, cast: str = "double") -> None:
        self.fields, self.kind = fields, cast

    def new(self, *parts: Column) -> Column:
        return F.struct(*((i32(p) if self.kind == "int" else p.cast("double")).alias(f) for p, f in zip(parts, self.fields, strict=True)))

    @property
    def zero(self) -> Column:
        return self.new(*(F.lit(0) for _ in self.fields))

    def _part(self, v: Column, field: str) -> Column:
        return _wrapped(v[field]) if self.kind == "int" else v[field]

    def _each(self, fn, *vs: Column) -> Column:
        return self.new(*(fn(*(self._part(v, f) for v in vs)) for f in self.fields))

    def add(self, a: Column, b: Column) -> Column:
        return self._each(lambda x, y: x + y, a, b)

    def adds(self, v: Column, by: Column | float) -> Column:
        return self._each(lambda x: x + by, v)

    def addms(self, a: Column, b: Column, by: Column | float = 1.0) -> Column:
        return self._each(lambda x, y: x + y * by, a, b)

    def sub(self, a: Column, b: Column) -> Column:
        return self._each(lambda x, y: x - y, a, b)

    def subs(self, v: Column, by: Column | float) -> Column:
        return self._each(lambda x: x - by, v)

    def mul(self, a: Column, b: Column) -> Column:
        return self._each(lambda x, y: x * y, a, b)

    def scale(self, v: Column, by: Column | float) -> Column:
        return self._each(lambda x: x * by, v)

    muls = scale

    def div(self, a: Column, b: Column) -> Column:
        return self._each(divide, a, b)

    def divs(self, v: Column, by: Column | float) -> Column:
        return self._each(lambda x: divide(x, by if isinstance(by, Column) else F.lit(by)), v)

    def inv(self, v: Column) -> Column:
        return self._each(lambda x: divide(F.lit(1.0), x), v)

    def neg(self, v: Column) -> Column:
        return self._each(lambda x: -x, v)

    def ceil(self, v: Column) -> Column:
        return self._each(F.ceil, v)

    def floor(self, v: Column) -> Column:
        return self._each(F.floor, v)

    def round(self, v: Column) -> Column:
        return self._each(rounded, v)

    def min(self, a: Column, b: Column) -> Column:
        return self._each(smallest, a, b)

    def max(self, a: Column, b: Column) -> Column:
        return self._each(largest, a, b)

    def lerp(self, norm: Column, a: Column, b: Column, fixed: bool = False) -> Column:
        return self._each(lambda x, y: x + norm * (y - x) if fixed else (x + norm) * (y - x), a, b)

    def _every(self, fn, a: Column, b: Column) -> Column:
        out = F.lit(True)
        for f in self.fields:
            out = out & fn(self._part(a, f), self._part(b, f))
        return out

    def eqstrict(self, a: Column, b: Column) -> Column:
        return self._every(lambda x, y: (x == y) & ~F.isnan(x), a, b)

    def equals(self, a: Column, b: Column) -> Column:
        """Equal to a millionth of the larger part, or of 1."""
        return self._every(lambda x, y: F.abs(x - y) <= 1e-6 * F.greatest(F.lit(1.0), F.abs(x), F.abs(y)), a, b)

    def dot(self, a: Column, b: Column) -> Column:
        out = F.lit(0 if self.kind == "int" else 0.0)
        for f in self.fields:
            out = out + self._part(a, f) * self._part(b, f)
        return i32(out) if self.kind == "int" else out

    def mag2(self, v: Column) -> Column:
        return self.dot(v, v)

    def mag(self, v: Column) -> Column:
        return F.sqrt(self.mag2(v))

    def unit(self, v: Column) -> Column:
        return self.divs(v, self.mag(v))

    def norm(self, v: Column) -> Column:
        """Divided by the magnitude, cut to a whole number."""
        return self.divs(v, i32(self.mag(v)))

    def dist2(self, a: Column, b: Column) -> Column:
        return self.mag2(self.sub(b, a))

    def dist(self, a: Column, b: Column) -> Column:
        return F.sqrt(self.dist2(a, b))

    # Two dimensions only.
    def theta(self, v: Column) -> Column:
        return F.atan2(v["y"], v["x"])

    def phi(self, v: Column) -> Column:
        return F.asin(divide(v["y"], self.mag(v)))

    def theta_ex(self, v: Column) -> Column:
        return i32(SCALE * self.theta(v))

    def phi_ex(self, v: Column) -> Column:
        return SCALE * self.phi(v)

    def rot90(self, v: Column) -> Column:
        return self.new(-v["y"], v["x"])

    def rotn90(self, v: Column) -> Column:
        return self.new(v["y"], -v["x"])

    def cross3(self, a: Column, b: Column, c: Column) -> Column:
        """On which side of the line through a and b the point c lies; not wrapped."""
        x, y = (lambda v: self._part(v, "x")), (lambda v: self._part(v, "y"))
        return (x(b) - x(a)) * (y(c) - y(a)) - (y(b) - y(a)) * (x(c) - x(a))


VEC2, VEC3, VEC2I = Vector("xy"), Vector("xyz"), Vector("xy", "int")


def cross2i(a: Column, b: Column) -> Column:
    return I32.cross(a["x"], a["y"], b["x"], b["y"])


def cross2(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def cross3(a: Column, b: Column) -> Column:
    return VEC3.new(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def rotate(v: Column, radians: Column) -> Column:
    return VEC2.new(v["x"] * F.cos(radians) - v["y"] * F.sin(radians), v["x"] * F.sin(radians) + v["y"] * F.cos(radians))


def about(v: Column, pivot: Column, radians: Column) -> Column:
    """Turned around a pivot."""
    return VEC2.add(pivot, rotate(VEC2.sub(v, pivot), radians))
