"""The same helpers as SQL text for the comparison queries."""

from __future__ import annotations

SERIES = "PARTITION BY ticker ORDER BY date"


def frame(n: int) -> str:
    return f"({SERIES} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {least or n} THEN {agg}({x}) OVER {frame(n)} END"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({SERIES})"


def change(x: str, n: int) -> str:
    return f"({x} / nullif({lag(x, n)}, 0) - 1)"


def clip(x: str, low: float, high: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({low}, least({high}, ({x}))) END"


def zscore(x: str, bound: float | None = 3.0) -> str:
    z = f"(({x}) - avg({x}) OVER (PARTITION BY date)) / nullif(stddev_samp({x}) OVER (PARTITION BY date), 0)"
    return z if bound is None else clip(z, -bound, bound)


def out(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def average_rank(x: str, keys: str = "date") -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN rank() OVER (PARTITION BY {keys}, {x} IS NULL ORDER BY {x})"
        f" + (count(*) OVER (PARTITION BY {keys}, {x} IS NULL, {x}) - 1) / 2.0 END"
    )


#: Weekly bars, calendar and dense panel from the trade lines; steps are appended with ", name AS (...)".
BARS = """
WITH lines AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
    l_extendedprice / l_quantity AS p, * FROM lineitem
), bars AS (
  SELECT ticker, date,
    first(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS open,
    max(p) AS high, min(p) AS low,
    last(p ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS close,
    CAST((2 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) + sum(CAST(l_quantity AS BIGINT))) // (2 * sum(CAST(l_quantity AS BIGINT))) AS DOUBLE) / 100 AS px,
    CAST(sum(l_quantity) AS BIGINT) AS volume
  FROM lines GROUP BY ticker, date
), own AS (SELECT *, px / nullif(lag(px) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r,
    row_number() OVER (PARTITION BY ticker ORDER BY date) AS n FROM bars)
"""
PANEL = (
    BARS
    + """
, cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM bars)),
grid AS (
  SELECT t.ticker, c.date, c.i, b.open, b.high, b.low, b.close, b.px, b.volume
  FROM (SELECT DISTINCT ticker FROM bars) t CROSS JOIN cal c LEFT JOIN bars b ON b.ticker = t.ticker AND b.date = c.date
), filled AS (
  SELECT *, last_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS pf FROM grid
), panel AS (SELECT *, pf / nullif(lag(pf) OVER (PARTITION BY ticker ORDER BY date), 0) - 1 AS r FROM filled)
"""
)
#: The panel with prices filled forward and no volume where there was no trade.
FILLED = PANEL.replace("panel AS (SELECT *,", "panel AS (SELECT * REPLACE (pf AS px, coalesce(volume, 0) AS volume),")
#: The benchmark: VWAP of all lines a week.
MARKET = """
, market AS (SELECT date, m, m / nullif(lag(m) OVER (ORDER BY date), 0) - 1 AS rm FROM (
  SELECT date, CAST((2 * sum(CAST(round(l_extendedprice * 100) AS BIGINT)) + sum(CAST(l_quantity AS BIGINT))) // (2 * sum(CAST(l_quantity AS BIGINT))) AS DOUBLE) / 100 AS m FROM lines GROUP BY date))
"""
#: Macro series: weekly mean order value per priority.
MACRO = """
, macro AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('week', o_orderdate) AS DATE) AS date,
    CAST(round(avg(o_totalprice)) AS BIGINT) / 1.0 AS value FROM orders GROUP BY ALL)
"""
#: Dimensions of a ticker.
DIMENSIONS = """
, dims AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, r_name AS sector,
    ['equity', 'fixed_income', 'commodity', 'alternative', 'leveraged'][s_nationkey % 5 + 1] AS asset_class
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
