"""Prices: finish-aware choice, parsing and currency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rate of last resort when no quote is known (fixed value).
FALLBACK_RATE = 5.40


def number(x: Column) -> Column:
    """A price text as a double; blank and unreadable texts are null."""
    return F.nullif(F.trim(x.cast("string")), F.lit("")).try_cast("double")


def priced(finish: Column, plain: Column, foil: Column, etched: Column) -> Column:
    """The finish's own price, else the plain one, else the foil one."""
    return F.coalesce(number(F.when(finish == "foil", foil).when(finish == "etched", etched)), number(plain), number(foil))


def export_price(finish: Column, plain: Column, foil: Column, etched: Column) -> Column:
    """The finish's own price, else the plain one; exports never fall back to the foil price."""
    return F.coalesce(number(F.when(finish == "foil", foil).when(finish == "etched", etched)), number(plain))
