"""Decimal rounding and formatting of doubles by their exact value."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Doubles from 2^52 on are integers.
_INTEGERS = 4503599627370496.0


def half_even(x: Column, digits: int) -> Column:
    """Nearest decimal of the exact binary value, real ties to even.

    `round` and `format_string` work on the shortest decimal text instead and
    so move 0.15625 to 0.1563 and 2.675 to 2.68. Where the scaled value looks
    like a tie, its rounding error (from an exact split of x at float width)
    tells which side x is on.
    """
    scale = 10.0**digits
    scaled = x * scale
    high = x.cast("float").cast("double")
    error = (high * scale - scaled) + (x - high) * scale
    whole = F.rint(scaled)
    nearest = F.when(
        (F.abs(scaled - whole) == 0.5) & (error != 0), scaled + F.signum(error) * 0.5
    ).otherwise(whole)
    return F.when(F.abs(x) >= _INTEGERS / scale, x).otherwise(nearest / scale)


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", half_even(x, digits))
