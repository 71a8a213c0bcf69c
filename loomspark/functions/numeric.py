"""Statistics, vectors and engineering formulas as columns."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def fixed(c: Column, digits: int = 6) -> Column:
    """Rounded through a decimal, as other engines do."""
    return c.cast(f"decimal(30,{digits})").cast("double")


def wilson(correct: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within [0, 1]; (0, 0) of nothing."""
    n = total.cast("double")
    p = F.try_divide(correct.cast("double"), n)
    scale = 1 + F.try_divide(F.lit(z * z), n)
    centre = (p + F.try_divide(F.lit(z * z / 2), n)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / scale
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(total > 0, low).otherwise(0.0), F.when(total > 0, high).otherwise(0.0)


def separated(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """A10: the intervals have no point in common."""
    return (a[1] < b[0]) | (b[1] < a[0])


def accuracy(correct: Column, total: Column) -> Column:
    """0 of nothing."""
    return F.coalesce(F.try_divide(correct, total), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """F8: accumulated in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(v: Column) -> Column:
    """unit length; zero stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.when(norm > 0, norm).otherwise(1.0))


def within(x: Column, want: Column, share: float = 0.02) -> Column:
    return F.abs(x - want) <= F.abs(want) * share


class Formula(NamedTuple):
    """X4"""

    params: tuple[str, ...]
    unit: str
    fn: Callable[..., Column]


def remaining_life(t_current: Column, t_min: Column, rate: Column) -> Column:
    """infinite if nothing is lost."""
    return F.when(rate > 0, F.try_divide(t_current - t_min, rate)).otherwise(F.lit(float("inf")))


FORMULAS: dict[str, Formula] = {
    "remaining_life": Formula(("t_current", "t_min", "rate"), "years", remaining_life),
    "corrosion_rate": Formula(("t_previous", "t_current", "years"), "mm/yr", lambda a, b, y: F.try_divide(a - b, y)),
    "next_interval": Formula(("life",), "years", lambda life: F.least(life / 2, F.lit(10.0))),
    "required_thickness": Formula(
        ("p", "r", "s", "e"), "mm", lambda p, r, s, e: F.when(s * e - 0.6 * p > 0, F.try_divide(p * r, s * e - 0.6 * p))
    ),
    "corrosion_allowance_used": Formula(("t_nominal", "t_current"), "mm", lambda a, b: a - b),
}


def interval_years(start: Column, end: Column) -> Column:
    """F21"""
    return (F.datediff(end, start) / 365.25).cast("decimal(18,2)").cast("double")


def next_due(day: Column, life: Column) -> Column:
    """the month that lies half of the life, 10 years at most, ahead."""
    return F.date_format(F.date_add(day, (365.25 * F.least(life / 2, F.lit(10.0))).cast("int")), "yyyy-MM")


def psi(barg: Column) -> Column:
    """F48"""
    return barg * 14.5038


def share_pct(part: Column, total: Column) -> Column:
    """percent, four digits"""
    return fixed(F.try_divide(part * 100, total), 4)


def memory_bar(gb: Column, budget: Column) -> Column:
    """percent of the budget, 100 at most"""
    return F.least(F.lit(100.0), F.try_divide(100 * gb, budget))


def score_bar(score: Column, top: Column) -> Column:
    """percent of the largest score, 1 at least"""
    return F.greatest(F.lit(1.0), F.try_divide(100 * score, top))


#: Multiples of a power of ten that an axis may step by.
STEPS = [1.0, 2.0, 2.5, 5.0, 10.0, 20.0, 25.0, 50.0, 100.0]


def nice_ticks(low: Column, high: Column, count: int = 4) -> Column:
    """array of round values from low to high, half a step over at either end."""
    raw = (high - low) / count
    unit = F.when(raw >= 1, F.pow(F.lit(10.0), F.length(F.floor(raw).cast("long").cast("string")) - 1)).otherwise(F.lit(0.001))
    steps = F.array(*map(F.lit, STEPS))
    step = F.coalesce(F.get(F.filter(F.transform(steps, lambda m: m * unit), lambda x: x >= raw), F.lit(0)), 100 * unit)
    # whole steps, towards zero
    first = F.signum(low) * F.floor(F.abs(low) / step)
    numbers = F.sequence(F.lit(0).cast("long"), F.ceil((high - first * step) / step + 1).cast("long"))
    ticks = F.filter(F.transform(numbers, lambda i: F.round((first + i) * step, 6)), lambda x: (x >= low - step / 2) & (x <= high + step / 2))
    return F.when(high <= low, F.array(low)).when(F.size(ticks) > 0, ticks).otherwise(F.array(low, high))
