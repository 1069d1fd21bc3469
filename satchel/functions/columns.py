"""Column expressions: set distances in one row, genotype distances, intervals, connectives and keyed draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def _nearest(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: l2(x, y))))


def hausdorff(kind: str, a: Column, b: Column) -> Column:
    """Of array<array<double>> columns: maxmin and meanmin are directed from a to b."""
    if kind == "maxmin":
        return F.array_max(_nearest(a, b))
    if kind == "minmin":
        return F.array_min(_nearest(a, b))
    if kind == "meanmin":
        return total(_nearest(a, b)) / F.size(a)
    return total(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: l2(x, y))))) / (F.size(a) * F.size(b))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, v: s + v)


def bag_mean(bag: Column) -> Column:
    """Mean instance of array<array<double>>."""
    first = F.transform(bag[0], lambda _: F.lit(0.0))
    return F.transform(F.aggregate(bag, first, lambda s, x: F.zip_with(s, x, lambda p, q: p + q)), lambda v: v / F.size(bag))


# Intervals of numbers


def nearest_of(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def scaled(x: Column, low: float, high: float) -> Column:
    return (x - F.lit(low)) / F.lit(high - low)


def unscaled(x: Column, low: float, high: float) -> Column:
    return F.lit(low) + x * F.lit(high - low)


def contains(x: Column, low, high, closure: str = "closed-closed") -> Column:
    left, right = closure.split("-")
    return (x >= low if left == "closed" else x > low) & (x <= high if right == "closed" else x < high)


# Fuzzy connectives: (m, s, f, l) of two columns in [0, 1]


def connectives(kind: str, x: Column, y: Column, alpha: float = 0.5) -> dict[str, Column]:
    """The averaging, union-like, intersection-like and compensating function of a family."""
    a = F.lit(float(alpha))
    zero = F.lit(0.0)

    def mean(p: Column, q: Column) -> Column:
        if kind == "algebraic":
            return F.pow(p, 1 - a) * F.pow(q, a)
        if kind == "logical":
            return (1 - a) * p + a * q
        none = (p == 0) | (q == 0)
        ok = F.when(none, 1.0).otherwise(p), F.when(none, 1.0).otherwise(q)
        if kind == "einstein":
            return F.when(none, zero).otherwise(2 / (1 + F.pow((2 - ok[0]) / ok[0], 1 - a) * F.pow((2 - ok[1]) / ok[1], a)))
        return F.when(none, zero).otherwise(ok[0] * ok[1] / (ok[1] * (1 - a) + ok[0] * a))  # the weighted harmonic mean

    if kind == "algebraic":
        union, cut = x + y - x * y, x * y
    elif kind == "einstein":
        union, cut = (x + y) / (1 + x * y), (x * y) / (1 + (1 - x) * (1 - y))
    elif kind == "hamacher":
        one, none = (x == 1) & (y == 1), (x == 0) & (y == 0)
        union = F.when(one, 1.0).otherwise((x + y - 2 * x * y) / F.when(one, 1.0).otherwise(1 - x * y))
        cut = F.when(none, 0.0).otherwise((x * y) / F.when(none, 1.0).otherwise(x + y - x * y))
    else:
        union, cut = F.greatest(x, y), F.least(x, y)
    both = F.pow(cut, 1 - a) * F.pow(union, a) if kind == "logical" else mean(cut, union)
    return {"m": mean(x, y), "s": union, "f": cut, "l": both}


# Draws: uniform numbers in [0, 1) keyed by values, so that results don't depend on partitions


def draw(seed: int, *keys) -> Column:
    cols = [F.lit(k) if isinstance(k, (int, str)) else k for k in keys]
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11) / F.lit(float(1 << 53))


def draw_array(seed: int, length: Column, *keys) -> Column:
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: draw(seed, *keys, i))


def choose(u: Column, low, high) -> Column:
    """A whole number in [low, high) from a uniform draw."""
    low, high = (F.lit(v) if isinstance(v, int) else v for v in (low, high))
    return (low + F.floor(u * (high - low))).cast("int")


def coin(u: Column, p: float = 0.5) -> Column:
    return u <= p


def gaussian(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * v)


def power_law(u: Column, low: float, high: float, exponent: float) -> Column:
    if exponent == -1:
        return F.lit(low) * F.pow(F.lit(high / low), u)
    e = exponent + 1
    return F.pow((F.lit(high**e) - F.lit(low**e)) * u + F.lit(low**e), F.lit(1 / e))
