"""Speaker-score scales and their canonical form."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from verdikt.functions.text import col

# The canonical scale, and tournaments scored on another one.
CANONICAL = (25.0, 30.0)
DEFAULT_SCALE = (25.0, 30.0)
SCALE_PATTERNS = [(r"(?i)^NYPDL", 23.0, 30.0), (r"(?i)^YFL 1$", 0.0, 100.0)]


def scale_for(tournament: Column | str) -> Column:
    lo, hi = F.lit(DEFAULT_SCALE[0]), F.lit(DEFAULT_SCALE[1])
    for pattern, low, high in reversed(SCALE_PATTERNS):
        hit = F.coalesce(col(tournament).rlike(pattern), F.lit(False))
        lo, hi = F.when(hit, low).otherwise(lo), F.when(hit, high).otherwise(hi)
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def to_canonical(raw, lo, hi) -> Column:
    raw, lo, hi = col(raw), col(lo), col(hi)
    width = CANONICAL[1] - CANONICAL[0]
    return F.when(hi - lo <= 0, raw).otherwise(CANONICAL[0] + (raw - lo) * width / (hi - lo))


def classify_raw(raw, lo, hi) -> Column:
    """Why a raw score cannot be used, null when it can."""
    raw, lo, hi = col(raw), col(lo), col(hi)
    span = hi - lo
    return (F.when((raw == 0) & (lo > 0), "sentinel")
            .when((raw < lo - span) | (raw > hi + span * 0.1), "out-of-range"))
