"""Scalar functions and the registries of named functions over values and rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vec

#: Fixed value: tolerance of scalar comparisons.
EPSILON = 1e-8


def clamp(v: Column, low, high) -> Column:
    return F.greatest(vec.num(low), F.least(vec.num(high), v))


def clamp_inside(v: Column, low: float, high: float) -> Column:
    """Clamped to the band narrowed by ten tolerances on each side."""
    return clamp(v, low + 10 * EPSILON, high - 10 * EPSILON)


def round_signed(v: Column, digits: int) -> Column:
    """v to so many digits; what is rounded to zero keeps its sign, as by IEEE division, so that arrays are equal as texts too. Not finite or too large values stay."""
    power = 10.0**digits
    near = F.round(v * power, 0) / power
    return F.when(F.abs(v) < 1e300, F.when(near == 0, F.signum(v) * 0.0).otherwise(near)).otherwise(v)


def lerp(t, a, b) -> Column:
    return vec.num(a) + (vec.num(b) - vec.num(a)) * t


def lerp_xi(v: Column, low, high) -> Column:
    """Where v lies between low and high; v itself if they enclose nothing."""
    low, high = vec.num(low), vec.num(high)
    return F.when(low >= high, v).otherwise((v - low) / F.when(low < high, high - low))


def is_zero(v: Column) -> Column:
    return F.abs(v) < EPSILON


def closest_power(v: Column) -> Column:
    """Exponent of the power of ten nearest to |v|, from the middle between two upwards; null for 0."""
    a = F.when(v != 0, F.abs(v))
    low = F.floor(F.log10(a))
    return F.when(a >= 5.5 * F.pow(F.lit(10.0), low), low + 1).otherwise(low)


def wrap_angle(v: Column) -> Column:
    """An angle from -pi to pi; both ends stay."""
    return F.when(v.between(-math.pi, math.pi), v).otherwise(F.pmod(v + math.pi, F.lit(2 * math.pi)) - math.pi)


def half_circle(v: Column) -> Column:
    return clamp(v, -math.pi / 2, math.pi / 2)


def mean_of(a: Column) -> Column:
    n = F.size(a)
    return F.when(n == 0, 0.0).otherwise(F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.when(n != 0, n))


def magnitude_of(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


#: Unit interval to unit interval.
UNIT_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "linear": lambda x: x,
    "inverse": lambda x: 1 - x,
    "one": lambda x: F.lit(1.0),
    "zero": lambda x: F.lit(0.0),
    "sin": lambda x: F.sin(x * math.pi / 2),
    "cos": lambda x: 1 - F.cos(x * math.pi / 2),
    "smooth": lambda x: (1 - F.cos(x * math.pi)) / 2,
}
#: A row's values to one value.
VALUE_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "average": mean_of,
    "magnitude": magnitude_of,
    **{f"column{k + 1}": (lambda a, k=k: F.element_at(a, k + 1)) for k in range(5)},
}
#: A row's values to a vector.
VECTOR_FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "zero": lambda a: vec.vec(0, 0, 0),
    "xyz": lambda a: vec.vec(*(F.coalesce(F.get(a, k), F.lit(0.0)) for k in range(3))),
    "uniform": lambda a: vec.vec(*[magnitude_of(a)] * 3),
    "x_magnitude": lambda a: vec.vec(magnitude_of(a), 1, 1),
    "y_magnitude": lambda a: vec.vec(1, magnitude_of(a), 1),
    "z_magnitude": lambda a: vec.vec(1, 1, magnitude_of(a)),
    "by_width": lambda a: F.when(F.size(a) == 0, vec.vec(1, 1, 1)).when(F.size(a) == 1, vec.vec(*[F.get(a, 0)] * 3)).when(F.size(a) == 2, vec.vec(F.get(a, 0), F.get(a, 1), 0)).otherwise(vec.vec(*(F.get(a, k) for k in range(3)))),
}


def spectrum(v: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear lookup in (position, value) stops, clamped at both ends."""
    stops = sorted(stops)
    out = F.when(v <= stops[0][0], float(stops[0][1]))
    for (a, p), (b, q) in zip(stops, stops[1:]):
        if b > a:
            out = out.when(v <= b, p + (v - a) * ((q - p) / (b - a)))
    return out.otherwise(float(stops[-1][1]))
