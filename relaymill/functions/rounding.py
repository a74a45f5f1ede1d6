"""Rounding to two decimals on the exact binary value, ties to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HALF_BITS = 30
_FRACTION_BITS = 2 * _HALF_BITS
_LOW_MASK = 2**_HALF_BITS - 1
_TIE = 2 ** (_FRACTION_BITS - 1)
# From here on neighbouring doubles are further apart than 0.01, so the nearest
# two-decimal number reads back as the double itself.
_ALREADY_ROUND = float(2**46)


def round_cents(x: Column) -> Column:
    """``x`` (DOUBLE) rounded to two decimals the way a correctly rounding runtime does.

    Spark's ``round`` and ``bround`` work on the shortest decimal text of a double, which
    turns many near-ties the wrong way. Here the fraction is taken as a 60-bit integer
    (exact for every double whose hundredths matter), multiplied by 100 in two 30-bit
    halves so that it stays within BIGINT, and the remainder is compared with one half.
    Only integer arithmetic on built-ins, so it stays inside whole-stage codegen.
    """
    # No branch around the arithmetic: common subexpressions are then computed once.
    in_range = F.abs(x) < _ALREADY_ROUND
    a = F.when(in_range, F.abs(x)).otherwise(F.lit(0.0))
    whole = F.floor(a)
    bits = ((a - whole) * F.lit(float(2**_FRACTION_BITS))).cast("bigint")
    low = bits.bitwiseAND(F.lit(_LOW_MASK)) * 100
    high = F.shiftright(bits, _HALF_BITS) * 100 + F.shiftright(low, _HALF_BITS)
    cents = F.shiftright(high, _HALF_BITS)
    rest = F.shiftleft(
        high.bitwiseAND(F.lit(_LOW_MASK)), _HALF_BITS
    ) + low.bitwiseAND(F.lit(_LOW_MASK))
    # above one half, or at one half with an odd number of cents
    up = rest + cents.bitwiseAND(F.lit(1)) > _TIE
    magnitude = (whole * 100 + cents + up.cast("bigint")).cast("double") / F.lit(100.0)
    return _signed(x, magnitude, in_range)


def _signed(x: Column, magnitude: Column, in_range: Column) -> Column:
    """Sign put back; outside the range the magnitude is 0 and ``x`` passes unchanged."""
    sign = F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return sign * magnitude + F.when(in_range, F.lit(0.0)).otherwise(x)
