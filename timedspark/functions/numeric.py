"""Rounding by the exact binary value of a double, spread that does not depend on the order of its values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Splits a double into two halves whose products with small integers are exact.
SPLITTER = 134_217_729.0


def round_exact(value: Column, digits: int) -> Column:
    """Nearest number with `digits` decimals; only true halves go to the even neighbour.

    Spark rounds the shortest decimal form, where 0.575 looks like a half
    although the double lies below it. Here twice the scaled value is compared
    with its exact product: an apparent half moves with the sign of the
    product's rounding error.
    """
    x = value.cast("double")
    scale = 2.0 * 10 ** digits
    doubled = x * scale
    carried = x * SPLITTER
    high = carried - (carried - x)
    error = (high * scale - doubled) + (x - high) * scale
    below = F.floor(doubled / 2)
    half = (doubled == F.floor(doubled)) & (F.pmod(doubled, F.lit(2.0)) == 1)
    step = (F.when(~half, F.floor(doubled / 2 + 0.5) - below)
            .when(error < 0, 0).when(error > 0, 1).otherwise(F.pmod(below, F.lit(2))))
    return (below + step) / 10 ** digits


def spread(values: Column) -> Column:
    """Population variance of a sorted array without nulls; 0.0 for fewer than two values.

    `var_pop` adds values in the order in which they come, so equal variances may differ in the last bit from run to run
    and from group to group. Distances to the smallest value in sorted order give the same for the same values, and of
    whole numbers exactly the same for equal variances (while n times the sum of squares stays below 2^53).
    """
    zero = F.lit(0.0)
    start = F.struct(zero.alias("n"), F.lit(None).cast("double").alias("low"), zero.alias("total"), zero.alias("squares"))

    def add(sums: Column, value: Column) -> Column:
        low = F.coalesce(sums["low"], value)
        return F.struct((sums["n"] + 1).alias("n"), low.alias("low"), (sums["total"] + (value - low)).alias("total"),
                        (sums["squares"] + (value - low) * (value - low)).alias("squares"))

    def variance(sums: Column) -> Column:
        return F.when(sums["n"] < 2, zero).otherwise((sums["n"] * sums["squares"] - sums["total"] * sums["total"]) / (sums["n"] * sums["n"]))

    return F.aggregate(values, start, add, variance)
