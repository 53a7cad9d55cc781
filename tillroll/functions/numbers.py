"""Rounding, safe division and binning."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def half_up(value, digits: int) -> Column:
    """Round halves away from zero on the decimal value."""
    return F.round(value, digits)


def half_even(value, digits: int) -> Column:
    """Round halves to the even neighbour on the decimal value."""
    return F.bround(value, digits)


def as_printed(value: Column, digits: int) -> Column:
    """The double that C and Python print with so many digits (up to 2): its binary value, halves to even.

    The engine's own formats round the shortest decimal instead, halves up: 0.25 and 0.15 would be 0.3 and 0.2.
    A fraction is cut into whole 2**-53, and what is left over only breaks a tie.
    """
    unit, half = 10**digits, 1 << 52
    size = F.abs(value)
    fraction = (size - F.floor(size)) * float(2 * half)
    left = (fraction - F.floor(fraction)) * float(unit)
    scaled = F.floor(fraction) * unit + F.floor(left)
    rest = scaled.bitwiseAND(F.lit(2 * half - 1))
    down = F.floor(size) * unit + F.shiftright(scaled, 53)
    above = (rest > half) | ((rest == half) & ((left != F.floor(left)) | (down % 2 == 1)))
    rounded = (down + above.cast("long")) / F.lit(float(unit))
    # Doubles from 2**52 on have no fraction.
    return F.when(size < float(half), F.when(value < 0, -rounded).otherwise(rounded)).otherwise(value)


def safe_ratio(numerator, denominator) -> Column:
    """Null instead of an error when the denominator is zero."""
    return F.try_divide(numerator, denominator)


def finite_or_zero(value: Column) -> Column:
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(usable, value).otherwise(F.lit(0.0))


def right_closed_band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval `(edge[i], edge[i + 1]]` that holds the value, else null.

    The last label is open upwards, so there are as many labels as edges.
    """
    uppers = [*edges[1:], None]
    branches = [
        (value > low if high is None else (value > low) & (value <= high), label)
        for low, high, label in zip(edges, uppers, labels)
    ]
    first, *rest = branches
    return reduce(lambda acc, b: acc.when(b[0], b[1]), rest, F.when(*first))


def marker_size(value: Column) -> Column:
    """Strictly positive plotting size."""
    return F.abs(value) + 1
