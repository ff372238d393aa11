"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cuts of a score into critical, high, medium; below them it is low.
INGEST_CUTS = (0.75, 0.50, 0.25)
DETECTION_CUTS = (0.75, 0.55, 0.35)
PERCENT_CUTS = (80, 60, 40)
LEVELS = ("critical", "high", "medium", "low")


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half up, also below zero."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def risk_bucket(score: Column, cuts: tuple[float, ...] = DETECTION_CUTS) -> Column:
    bands = reduce(lambda c, pair: c.when(score >= pair[0], pair[1]), list(zip(cuts, LEVELS, strict=False))[1:], F.when(score >= cuts[0], LEVELS[0]))
    return bands.otherwise(LEVELS[-1])


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within bounds; null and non-finite values count as the lower bound."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.least(F.greatest(x, F.lit(low)), F.lit(high))).otherwise(F.lit(low))


def ratio(a: Column, b: Column, none: float | None = 0.0) -> Column:
    """a / b in double precision, `none` where b is 0 or null."""
    return F.when(b.cast("double") != 0, a.cast("double") / b.cast("double")).otherwise(F.lit(none).cast("double"))


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def any_flags(pairs: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(on, name) for name, on in pairs.items()]))


def document_id(key: Column) -> Column:
    return F.regexp_replace(key, "[^a-zA-Z0-9]", "_")


def alert_id(key: Column) -> Column:
    """ALT- and eight hex digits of a rolling 32-bit hash (h * 31 + code) of the key."""
    wrap = lambda h: ((h + F.lit(2147483648)) % F.lit(4294967296) + F.lit(4294967296)) % F.lit(4294967296) - F.lit(2147483648)
    codes = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    hashed = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c))
    return F.concat(F.lit("ALT-"), F.lpad(F.lower(F.hex(F.abs(hashed))), 8, "0"))
