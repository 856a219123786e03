"""Joins, set algebra and date arithmetic."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ranges


def asof(left: DataFrame, right: DataFrame, on: str, values: list[str], by: list[str] | None = None, unit: str = "month") -> DataFrame:
    """To each row of `left` the latest row of `right` of the same `by` at or before it.

    Ranges of time (`unit`) are filled apart and carry their last value on, so that neither a long series nor a hot key is
    one task; no range join.
    """
    return ranges.asof(left, right, on, values, by or [], unit)


def pair_complete(a: DataFrame, b: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rows where both sides have a value."""
    return a.where(F.col(x).isNotNull()).join(b.where(F.col(y).isNotNull()), keys)


def next_rows(members: DataFrame, daily: DataFrame, h: int) -> DataFrame:
    """Rows of the h calendar rows after each rebalance row, by the derived period (an equi-join).

    `members`: period, ticker; `daily`: ticker, i, r; period p covers i = p*h + 1 .. (p+1)*h.
    """
    return daily.where("i >= 1").withColumn("period", F.expr(f"(i - 1) div {h}")).join(members, ["period", "ticker"])


def weekdays_between(a: Column, b: Column) -> Column:
    """Mondays to Fridays in [a, b), closed form; negative if b is earlier."""

    def before(d: Column) -> Column:  # weekdays before d, counted from a Monday
        n = F.datediff(d, F.lit("1900-01-01").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))

    return (before(b) - before(a)).cast("long")


def lookback_start(asof_date: Column, rows: int) -> Column:
    """J7."""
    return F.date_sub(asof_date, int(1.6 * rows))


def to_tall(wide: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """J8, NULLs dropped as in a tall store."""
    return wide.unpivot(keys, columns, name, value).where(F.col(value).isNotNull())


def to_wide(tall: DataFrame, keys: list[str], name: str, value: str, columns: list[str]) -> DataFrame:
    """J8 back; the columns are named, so that no pass over the data looks for them."""
    return tall.groupBy(*keys).pivot(name, columns).agg(F.first(value))


def group_function(df: DataFrame, group: str, part: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, combine: list[Column]) -> DataFrame:
    """A user's function over the rows of each `part` of a `group`, its results (columns `schema`) combined by aggregates.

    A group goes to one task part by part, never whole; `part` names a column that splits large groups.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf).assign(**{group: pdf[group].iloc[0]})

    kind = df.schema[group].dataType.simpleString()
    return df.groupBy(group, part).applyInPandas(run, f"{schema}, {group} {kind}").groupBy(group).agg(*combine)
