"""Scores of a worker's records as column expressions: piecewise ladders, shapes of a measurement's bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitlens.functions.columns import ladder, ratio

#: Fixed values: (per cent, score) between which each score is linear.
FILLED = ((0, 0.0), (20, 0.1), (40, 0.5), (60, 1.0), (80, 0.5), (100, 0.0))
UNWELL_YES = ((0, 0.0), (10, 0.1), (12, 0.2), (15, 0.5), (20, 0.8), (40, 1.0))
ALL_NO = ((0, 0.0), (10, 0.1), (20, 0.3), (30, 0.6), (40, 0.8), (50, 1.0))
#: The score for each number of shape tests that hold, from none to six.
BY_TESTS = (1.0, 0.9, 0.8, 0.75, 0.67, 0.5, 0.0)


def is_filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def filled_pct(c: str) -> Column:
    """Share of answers that are there, in per cent (an aggregate)."""
    return 100.0 * ratio(F.count_if(is_filled(c)), F.count("*"), None)


def yes_pct(c: str, yes: tuple[str, ...] = ("yes",)) -> Column:
    """Share of the answers that are yes, in per cent; null without answers (an aggregate)."""
    return 100.0 * ratio(F.count_if(F.lower(c).isin(*yes)), F.count_if(is_filled(c)), None)


def completion_anomaly(pct: Column) -> Column:
    return ladder(pct, *FILLED)


def unwell_completion_anomaly(pct: Column) -> Column:
    return F.when((pct <= 0) | (pct >= 85), 0.0).when(pct <= 50, 2.0 * (pct / 50)).otherwise((85 - pct) / 35)


def ladder_points(x: str, steps: tuple[tuple[float, float], ...]) -> str:
    """The same ladder as SQL text."""
    (x0, y0), *rest = steps
    out = f"CASE WHEN {x} <= {x0} THEN {y0}"
    for x1, y1 in rest:
        out += f" WHEN {x} <= {x1} THEN {y0} + ({x} - {x0}) * ({y1 - y0}) / ({x1 - x0})"
        x0, y0 = x1, y1
    return out + f" WHEN {x} IS NOT NULL THEN {y0} END"


def half_open_bins(c: str, start: float = 9.5, size: float = 1.0, n: int = 12) -> Column:
    """Counts of n bins [start + i * size, start + (i + 1) * size) as an array (an aggregate)."""
    return F.array(*(F.count_if((F.col(c) >= start + i * size) & (F.col(c) < start + (i + 1) * size)) for i in range(n)))


def _steps(bins: Column, at: Column) -> Column:
    """Differences between the bins at successive places."""
    return F.zip_with(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.slice(at, 1, F.greatest(F.size(at) - 1, F.lit(0))), lambda b, a: F.get(bins, b) - F.get(bins, a))


def _places() -> Column:
    return F.sequence(F.lit(0), F.lit(11))


def shape_tests(bins: Column, learnt: bool = False) -> dict[str, Column]:
    """The six tests of twelve bins: enough bins, rising to the peak, falling from it, no gap, no plateau, no overweight peak.

    As features to learn from, one step down is enough but needed, a plateau is that of the authenticity score, and the peak
    holds 42 % at most.
    """
    n, top = F.aggregate(bins, F.lit(0).cast("bigint"), lambda a, x: a + x), F.array_max(bins)
    peak = F.array_position(bins, top) - 1
    used = F.filter(_places(), lambda i: F.get(bins, i) > 0)
    up, down = _steps(bins, F.filter(used, lambda i: i <= peak)), _steps(bins, F.filter(used, lambda i: i >= peak))
    large = F.filter(_places(), lambda i: F.get(bins, i) >= n * 0.02)
    eligible = lambda i: (F.get(bins, i) >= n * 0.02) & (F.get(bins, i) >= top * 0.20)
    three = lambda i: (F.get(bins, i), F.get(bins, i + 1), F.get(bins, i + 2))
    level = lambda i: eligible(i) & eligible(i + 1) & eligible(i + 2) & (F.greatest(*three(i)) - F.least(*three(i)) <= top * 0.03)
    return {
        "five_bins": F.size(used) >= 5,
        "rising": F.exists(up, lambda s: s > 0) & ~F.exists(up, lambda s: s < -0.02 * n) & F.exists(F.slice(bins, F.lit(1), peak.cast("int")), lambda b: b >= top * 0.25),
        "falling": (F.size(F.filter(down, lambda s: s < 0)) >= 1) & ~F.exists(down, lambda s: s > 0.02 * n) if learnt else (F.size(down) < 2) | ((F.size(F.filter(down, lambda s: s < 0)) >= 2) & ~F.exists(down, lambda s: s > 0.02 * n)),
        "no_gap": (F.size(large) <= 1) | ~F.exists(F.slice(bins, F.get(large, F.lit(0)) + 1, F.element_at(large, -1) - F.get(large, F.lit(0)) + 1), lambda b: b == 0),
        "no_plateau": longest_plateau(bins, n) < 3 if learnt else ~F.exists(F.sequence(F.lit(0), F.lit(9)), level),
        "spread_peak": top <= (0.42 if learnt else 0.60) * n,
    }


def tests_passed(bins: Column) -> Column:
    return sum((t.cast("int") for t in shape_tests(bins).values()), F.lit(0))


def shape_score(bins: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BY_TESTS)), tests_passed(bins) + 1)


def slope_over(bins: Column, at: Column) -> Column:
    """Least-squares slope of the bins' counts over their places; null with fewer than two."""
    total = lambda f: F.aggregate(at, F.lit(0.0), lambda a, i: a + f(i))
    k = F.size(at).cast("double")
    sx, sy = total(lambda i: i.cast("double")), total(lambda i: F.get(bins, i).cast("double"))
    sxx, sxy = total(lambda i: (i * i).cast("double")), total(lambda i: (i * F.get(bins, i)).cast("double"))
    return F.when(F.size(at) >= 2, (k * sxy - sx * sy) / (k * sxx - sx * sx))


def longest_plateau(bins: Column, n: Column) -> Column:
    """The longest run of neighbouring bins of half the peak or more whose counts are within 4 % of all; 1 at least."""
    top = F.array_max(bins)
    spans = F.flatten(F.transform(_places(), lambda i: F.transform(F.sequence(F.lit(1), 12 - i), lambda m: F.slice(bins, i + 1, m))))
    level = lambda s: (F.array_min(s) >= top * 0.5) & (F.array_max(s) - F.array_min(s) <= n * 0.04)
    return F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(F.filter(spans, level), F.size)), F.lit(1)))


def band(x: Column, *bands: tuple[float, float, float]) -> Column:
    """The points of the first closed band (low, high, points) that holds x, or 0."""
    out = F.lit(None)
    for low, high, points in reversed(bands):
        out = F.when((x >= low) & (x <= high), F.lit(points)).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def authenticity(bins: Column) -> dict[str, Column]:
    """Parts of the score of up to eleven points of at least eighty measurements in twelve bins."""
    n, top = F.aggregate(bins, F.lit(0).cast("bigint"), lambda a, x: a + x), F.array_max(bins)
    peak = F.array_position(bins, top) - 1
    used = F.filter(_places(), lambda i: F.get(bins, i) > 0)
    k = F.size(used)
    to, frm = F.filter(used, lambda i: i <= peak), F.filter(used, lambda i: i >= peak)
    up, down = (F.when((k >= 3) & (F.size(x) >= 2), slope_over(bins, x) / top) for x in (to, frm))
    smooth = lambda slope, steps, bad: F.when(slope.isNotNull() & ~F.exists(steps, bad), 1.0).otherwise(0.0)
    run = longest_plateau(bins, n)
    return {
        "bins_points": F.when(k >= 5, 2.0).when(k >= 3, 1.0).otherwise(0.0),
        "peak_points": band(100.0 * top / n, (30, 60, 2.0), (20, 30, 1.0), (60, 80, 1.0)),
        "up_points": band(up, (0.05, 0.3, 2.0), (0.02, 0.05, 1.0), (0.3, 0.5, 1.0)),
        "down_points": band(-down, (0.05, 0.3, 2.0), (0.02, 0.05, 1.0), (0.3, 0.5, 1.0)),
        "rising_points": smooth(up, _steps(bins, to), lambda s: s < -0.02 * n),
        "falling_points": smooth(down, _steps(bins, frm), lambda s: s > 0.02 * n),
        "plateau_points": F.when(run == 1, 1.0).when(run == 2, 0.5).otherwise(0.0),
    }
