"""Column helpers that many operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: The 99 % quantile (two-sided) of the standard normal distribution.
Z99 = 2.5758293035489004


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str, empty: float | None = 0.0) -> Column:
    """a / b as double; `empty` where b is 0 or null."""
    out = F.try_divide(col(a).cast("double"), col(b).cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def percent(a: Column | str, b: Column | str, empty: float | None = 0.0) -> Column:
    return ratio(a, b, empty) * 100.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return 2 * radius * F.asin(F.sqrt(a))


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Minutes as double, for timestamps with or without a zone."""
    return F.timestamp_diff("MICROSECOND", col(start), col(end)) / 6e7


def right_closed_bin(x: Column | str, start: float, size: float) -> Column:
    """Number of the bin (start, start + size], the first one closed on both sides."""
    return F.greatest(F.ceil((col(x) - start) / size) - 1, F.lit(0)).cast("int")


def ladder(x: Column, *steps: tuple[float, float]) -> Column:
    """Piecewise linear through (x, y) points, level beyond both ends; null stays null."""
    (x0, y0), *rest = steps
    out = F.when(x <= x0, F.lit(y0))
    for x1, y1 in rest:
        out = out.when(x <= x1, y0 + (x - x0) * ((y1 - y0) / (x1 - x0)))
        x0, y0 = x1, y1
    return out.when(x.isNotNull(), F.lit(y0))


def wilson(successes: Column, n: Column, z: float = Z99) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval of a share."""
    n = n.cast("double")
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def week_from_tuesday(day: Column | str) -> Column:
    """The Tuesday that a week ending on Monday begins with."""
    return F.date_sub(col(day), (F.dayofweek(col(day)) + 4) % 7)


def sorted_list(c: Column | str, separator: str = ";") -> Column:
    """Distinct values as text, sorted and joined."""
    return F.array_join(F.array_sort(F.collect_set(col(c).cast("string"))), separator)
