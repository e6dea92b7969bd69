"""Binary signatures as arrays of longs: distances, scores and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_hex(x: Column, words: int = 4) -> Column:
    """A hex text as an array of longs (signed form)."""
    return F.array(*[F.conv(F.substring(x, 1 + 16 * i, 16), 16, -10).cast("long") for i in range(words)])


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def sign_bits(vector: Column, start: int, count: int, against: int = 0) -> Column:
    """A long with bit i set if component start + i exceeds component start + i + against (or zero, if against is 0)."""

    def with_bit(bits: Column, i: Column) -> Column:
        right = F.element_at(vector, (F.lit(start + against) + i) % 64 + 1) if against else F.lit(0.0)
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        return F.when(F.element_at(vector, F.lit(start + 1) + i) > right, bits.bitwiseOR(bit)).otherwise(bits)

    return F.aggregate(F.sequence(F.lit(0), F.lit(count - 1)), F.lit(0).cast("long"), with_bit)


def combined(art: Column, full: Column, bonus: Column) -> Column:
    return art + 0.5 * full - bonus


def confidence(best: Column, rival: Column, missing_margin: float = 60.0) -> Column:
    """Logistic confidence of a best score and its margin over the best of another key, damped for poor scores."""
    margin = F.coalesce(rival - best, F.lit(missing_margin))
    damp = F.when(best > 145, F.greatest(F.lit(0.0), 1 - (best - 145) / 60)).otherwise(F.lit(1.0))
    return F.least(F.lit(0.995), damp / (1 + F.exp(-(margin - 12) / 8)))


def similarity(d: Column, reach: float = 110.0) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - d / reach))
