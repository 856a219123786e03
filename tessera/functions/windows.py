"""Column helpers for rolling windows over panels and own series.

A rolling value is NULL unless every row of its frame is there (strict); quotients by zero are NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ANNUAL = 252.0


def series(keys: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    return Window.partitionBy(keys).orderBy(order)


def trailing(n: int, keys: str | list[str] = "ticker", order: str = "date") -> WindowSpec:
    return series(keys, order).rowsBetween(-(n - 1), 0)


def roll(agg, x: Column | str, n: int, keys="ticker", least: int | None = None) -> Column:
    """agg over the frame of the last n rows; NULL unless `least` (default n) of them hold a value.

    For short series (one a market).  Panels take functions.sliding, where a row costs the same whatever n is.
    """
    w = trailing(n, keys)
    return F.when(F.count(x).over(w) >= (least or n), agg(x).over(w))


def last_values(x: Column, n: int, keys="ticker") -> Column:
    """The last n values as an array, the newest first, NULL where there is none: n shifts, no frame."""
    return F.array(x, *(F.lag(x, k).over(series(keys)) for k in range(1, n)))


def lag(x: Column | str, n: int, keys="ticker") -> Column:
    return F.lag(x, n).over(series(keys))


def ratio(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)


def change(x: Column | str, n: int, keys="ticker") -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return ratio(x, lag(x, n, keys)) - 1


def clip(x: Column, low: float, high: float) -> Column:
    """NULL stays NULL (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def zscore(x: Column | str, bound: float | None = 3.0, keys="date") -> Column:
    """Cross-sectional z-score (sample deviation, 0 counts as missing), clipped."""
    x = F.col(x) if isinstance(x, str) else x
    w = Window.partitionBy(keys)
    sd = F.stddev_samp(x).over(w)
    z = ratio(x - F.avg(x).over(w), sd)
    return z if bound is None else clip(z, -bound, bound)


def average_rank(x: Column | str, keys: list[str] | str) -> Column:
    """Rank from 1 with ties at their mean; NULL for NULL.  Spark sorts NULL first, so they are ranked apart."""
    x = F.col(x) if isinstance(x, str) else x
    keys = [keys] if isinstance(keys, str) else keys
    parts = [*map(F.col, keys), x.isNull()]
    first = F.rank().over(Window.partitionBy(*parts).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*parts, x))
    return F.when(x.isNotNull(), first + (ties - 1) / 2.0)


def percentile_rank(x: Column | str, keys: list[str] | str = "date") -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return average_rank(x, keys) / F.count(x).over(Window.partitionBy(keys))


def out(x: Column, digits: int = 6) -> Column:
    """Rounded for output; never a negative zero."""
    return F.round(x, digits) + F.lit(0.0)
