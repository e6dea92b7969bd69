"""Scores of frames and codes, from given measurements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import area, box


def sharpness_score(x: Column, low: float = 1.0, high: float = 3.0) -> Column:
    """Sharpness on a logarithmic scale, 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log10(F.greatest(x, F.lit(1e-6))) - low) / (high - low)))


def frontalness(q: Column) -> Column:
    """How much of its bounding box a quad fills: 1 when seen from the front and upright."""
    left, top, right, bottom = box(q)
    size = (right - left) * (bottom - top)
    return F.when(size > 0, area(q) / size).otherwise(0.0)


def quality_score(sharpness: Column, glare: Column, q: Column) -> Column:
    """Sharp, free of glare and seen from the front."""
    return 0.5 * sharpness_score(sharpness) + 0.2 * (1 - F.least(F.lit(1.0), glare)) + 0.3 * frontalness(q)


def near_codes(a: Column, b: Column) -> Column:
    """Set codes that differ by a leading p, or name the reprint list."""
    return (a == b) | (a == F.concat(F.lit("p"), b)) | (b == F.concat(F.lit("p"), a)) | (a == "plst") | (b == "plst")
