"""Rounding of doubles by their exact value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**27 + 1, which parts a double into halves whose products with a power of ten are exact.
SPLIT = 134_217_729.0


def half_even(x: Column, digits: int) -> Column:
    """``x`` to so many digits (eight at most): nearest by the number's exact binary value, ties to even.

    2.675 lies below its decimal reading, so two digits make 2.67 of it, where SQL's rounding of the
    decimal makes 2.68. The product with the power of ten is taken with its rounding error, which decides
    where the product itself says half. Values from 2**52 / 10**digits on are as they are.
    """
    scale = float(10**digits)
    high = x * SPLIT - (x * SPLIT - x)
    product = x * scale
    error = (high * scale - product) + (x - high) * scale
    floor = F.floor(product).cast("double")
    over = (product - floor - 0.5) + error
    up = (over > 0) | ((over == 0) & (F.pmod(floor, F.lit(2.0)) == 1))
    return F.when(F.abs(product) < 2.0**52, (floor + F.when(up, 1.0).otherwise(0.0)) / scale).otherwise(x)
