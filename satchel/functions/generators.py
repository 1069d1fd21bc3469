"""Named generators of uniform numbers as Column expressions, with skip-ahead: draw n of a stream is computed where it is needed.

A multiplicative congruential state after n steps is seed * factor^n modulo the modulus; the factor's powers of 2^k are
constants, and those of the bits of n are multiplied.  So a stream needs no state, no order and no partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The two factors and moduli of L'Ecuyer's combined generator, and the scale of its published form
FACTORS = (40014, 40692)
MODULI = (2147483563, 2147483399)
SCALE = 4.656613e-10
BITS = 62


def state(seed: Column, n: Column, factor: int, modulus: int) -> Column:
    """seed after n steps of a multiplicative generator whose modulus is below 2^31."""
    jumps = F.lit([pow(factor, 1 << k, modulus) for k in range(BITS)])

    def step(s: Column, k: Column) -> Column:
        on = F.getbit(n.cast("long"), k) == 1
        return F.when(on, s * F.get(jumps, k) % modulus).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), seed.cast("long") % modulus, step)


def ranecu(n: Column, seed1: Column | int, seed2: Column | int) -> Column:
    """Draw n (from 1) of the stream that starts from two seeds; in (0, 1)."""
    a, b = (F.lit(s) if isinstance(s, int) else s for s in (seed1, seed2))
    z = state(a, n, FACTORS[0], MODULI[0]) - state(b, n, FACTORS[1], MODULI[1])
    return F.when(z < 1, z + (MODULI[0] - 1)).otherwise(z) * F.lit(SCALE)


def whole(u: Column, low: int, high: int) -> Column:
    """A whole number in [low, high) from a draw."""
    return (F.lit(low) + F.floor(u * (high - low))).cast("long")


GENERATORS = {"ranecu": ranecu}


def streams(spark: SparkSession, n: int, seed1: int = 12345, seed2: int = 67890, apart: int = 1 << 40) -> DataFrame:
    """(stream, seed1, seed2): seeds of n streams that begin ``apart`` draws from each other, a table instead of one state."""
    at = F.col("id") * apart
    return spark.range(n).select(F.col("id").alias("stream"), *(state(F.lit(s), at, f, m).alias(name) for s, f, m, name in zip((seed1, seed2), FACTORS, MODULI, ("seed1", "seed2"), strict=True)))
