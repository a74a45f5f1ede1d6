"""One order for several columns: the bits of their places taken in turn.

Rows near each other in that order are near in every column, so files of a stretch of it hold
few values of each, and a filter on any one of the columns skips most files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


def boundaries(rows: DataFrame, bits: dict[str, int]) -> dict[str, list[int]]:
    """Per column the values that cut its rows into about 2**bits equal parts.

    One pass, and one row of at most 2**bits numbers per column, whatever the size of the
    input. Columns of equal values give fewer parts.
    """
    asked = [
        F.percentile_approx(
            F.col(c).cast("bigint"), F.array(*[F.lit(i / (1 << n)) for i in range(1, 1 << n)]), ACCURACY
        ).alias(c)
        for c, n in bits.items()
    ]
    found = rows.agg(*asked).first()
    return {c: sorted(set(found[c] or ())) for c in bits}


def part_of(value: Column, bounds: list[int]) -> Column:
    """How many bounds are at or below the value, found by halving; 0 for NULL."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= bounds[middle], between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(bounds))


def interleaved(places: list[tuple[Column, int]]) -> Column:
    """BIGINT of the bits of all places, the highest of each first.

    ``places`` are numbers below 2**bits. Where columns have different numbers of bits,
    their highest stand side by side.
    """
    most = max(bits for _, bits in places)
    taken = [
        F.shiftright(place, bits - 1 - level).bitwiseAND(F.lit(1)).cast("bigint")
        for level in range(most)
        for place, bits in places
        if level < bits
    ]
    return reduce(lambda all_, bit: F.shiftleft(all_, 1).bitwiseOR(bit), taken)
