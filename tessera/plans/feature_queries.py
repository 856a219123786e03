"""Queries F1-F15 and X1-X8 with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql as S
from tessera.functions.windows import change, out, zscore
from tessera.operators import features as O
from tessera.sources import tables as T

from .base import Book

book = Book()
OWN = S.BARS + ", long AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS total FROM own) WHERE total >= 252)"


def _own(columns: dict):
    return lambda spark, d: O.long_enough(T.own_series(spark, d)).select("ticker", "date", *(out(c).alias(n) for n, c in columns().items()))


def _added(fn, *names: str):
    """The columns that an operator adds to own series."""
    return lambda spark, d: fn(O.long_enough(T.own_series(spark, d))).select("ticker", "date", *(out(F.col(n)).alias(n) for n in names))


def _sql(columns: dict[str, str]) -> str:
    return OWN + "SELECT ticker, date, " + ", ".join(f"{S.out(e)} AS {n}" for n, e in columns.items()) + " FROM long"


def vol(n: int) -> str:
    return f"({S.roll('stddev_samp', 'r', n)}) * sqrt(252)"


SMA = lambda n: f"({S.roll('avg', 'px', n)})"
book.add("f1_returns", _own(O.returns), _sql({f"ret_{k}": S.change("px", k) for k in O.HORIZONS}))
book.add("f2_volatility", _added(lambda own: O.volatility(own, 21, 63), "vol_21", "vol_63"), _sql({"vol_21": vol(21), "vol_63": vol(63)}))
book.add("f3_volatility_ratio", _added(O.volatility_ratio, "ratio"), _sql({"ratio": f"({vol(21)}) / nullif({vol(63)}, 0)"}))


def ema(x: str, alpha: str) -> str:
    """y0 = x0, then alpha x + (1 - alpha) y, as a scaled running sum."""
    return f"pow(1 - {alpha}, n - 1) * sum(CASE WHEN n = 1 THEN {x} ELSE {alpha} * {x} END * pow(1 - {alpha}, 1 - n)) OVER (PARTITION BY ticker ORDER BY n)"


def wilder(x: str) -> str:
    return f"""CASE WHEN n >= 14 THEN pow(13 / 14.0, n - 14) * sum(CASE WHEN n <= 14 THEN {x} / 14.0 ELSE {x} / 14.0 * pow(13 / 14.0, 14 - n) END)
      OVER (PARTITION BY ticker ORDER BY n) END"""


def _recursive(columns):
    return lambda spark, d: O.recursive_features(O.long_enough(T.own_series(spark, d))).select("ticker", "date", *(out(F.col(c), 4).alias(c) for c in columns))


book.add(
    "f4_rsi",
    _recursive(["rsi"]),
    OWN
    + f""", moves AS (SELECT *, greatest(coalesce(px - lag(px) OVER (PARTITION BY ticker ORDER BY n), 0), 0) AS up,
      greatest(coalesce(lag(px) OVER (PARTITION BY ticker ORDER BY n) - px, 0), 0) AS down FROM long),
    smooth AS (SELECT *, {wilder("up")} AS g, {wilder("down")} AS l FROM moves)
    SELECT ticker, date, {S.out("CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END", 4)} AS rsi FROM smooth""",
)
book.add(
    "f5_macd",
    _recursive(["macd", "macd_signal", "macd_hist"]),
    OWN
    + f""", lined AS (SELECT *, {ema("px", "2 / 13.0")} - {ema("px", "2 / 27.0")} AS macd FROM long),
    signalled AS (SELECT *, {ema("macd", "0.2")} AS s FROM lined)
    SELECT ticker, date, {S.out("macd", 4)} AS macd, {S.out("s", 4)} AS macd_signal, {S.out("macd - s", 4)} AS macd_hist FROM signalled""",
)
SD20 = f"({S.roll('stddev_samp', 'px', 20)})"
book.add("f6_bollinger", _added(O.bollinger, "place"), _sql({"place": f"(px - ({SMA(20)} - 2 * {SD20})) / nullif(4 * {SD20}, 0)"}))
book.add(
    "f7_atr",
    _added(O.with_atr, "atr"),
    OWN
    + f""", ranged AS (SELECT *, greatest(high - low, abs(high - {S.lag("close", 1)}), abs(low - {S.lag("close", 1)})) AS tr FROM long)
    SELECT ticker, date, {S.out(S.roll("avg", "tr", 14))} AS atr FROM ranged""",
)
book.add("f8_volume_ratio", _added(O.volume_ratio, "ratio"), _sql({"ratio": f"volume / nullif({S.roll('avg', 'volume', 21)}, 0)"}))
book.add("f9_drawdown", _added(O.drawdown, "drawdown"), _sql({"drawdown": f"px / nullif({S.roll('max', 'px', 252)}, 0) - 1"}))
book.add("f10_sma_cross", _added(O.sma_cross, "sma_cross"), _sql({"sma_cross": f"{SMA(50)} / nullif({SMA(200)}, 0) - 1"}))
book.add("f11_momentum_12_1", _own(lambda: {"momentum": O.momentum_12_1()}), _sql({"momentum": f"{S.change('px', 252)} - {S.change('px', 21)}"}))
book.add(
    "f12_latest",
    lambda spark, d: O.latest(_added(lambda own: O.volatility(own.withColumn("ret_21", change("px", 21)), 21), "ret_21", "vol_21")(spark, d)),
    f"WITH f AS ({_sql({'ret_21': S.change('px', 21), 'vol_21': vol(21)})}) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1",
)
FILL = "last_value({0} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)"
MEAN = "CASE WHEN count({0}) OVER (ORDER BY date ROWS {1} PRECEDING) = {1} + 1 THEN avg({0}) OVER (ORDER BY date ROWS {1} PRECEDING) END"
NAMES = ["spread", "vix", "spread_21", "vix_5", "vix_sma", "vix_ratio", "claims_4"]


def _macro(spark, d):
    f = O.macro_features(T.macro(spark, d), "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return f.select("date", *(out(F.col(c)).alias(c) for c in NAMES))


book.add(
    "f13_macro",
    _macro,
    "WITH x AS (SELECT 1)"
    + S.MACRO
    + f""", wide AS (SELECT a.date, a.value - b.value AS spread, coalesce(v.value, CASE WHEN NOT EXISTS (SELECT 1 FROM macro WHERE series_id = '3-MEDIUM') THEN s.value END) AS vix, c.value AS claims
      FROM macro a LEFT JOIN macro b ON a.date = b.date AND b.series_id = '2-HIGH' LEFT JOIN macro v ON a.date = v.date AND v.series_id = '3-MEDIUM'
      LEFT JOIN macro s ON a.date = s.date AND s.series_id = '4-NOT SPECIFIED' LEFT JOIN macro c ON a.date = c.date AND c.series_id = '5-LOW' WHERE a.series_id = '1-URGENT'),
    f AS (SELECT date, spread, vix, spread - lag(spread, 21) OVER (ORDER BY date) AS spread_21, vix - lag(vix, 5) OVER (ORDER BY date) AS vix_5,
      {MEAN.format("vix", 20)} AS vix_sma, vix / nullif({MEAN.format("vix", 20)}, 0) AS vix_ratio, {MEAN.format("claims", 3)} AS claims_4 FROM wide)
    SELECT date, {", ".join(f"{S.out(FILL.format(c))} AS {c}" for c in NAMES)} FROM f""",
)
book.add("f14_trend_strength", _added(O.trend_strength, "strength"), _sql({"strength": f"CAST(CASE WHEN px > {SMA(50)} THEN 1 ELSE 0 END + CASE WHEN px > {SMA(200)} THEN 1 ELSE 0 END - 1 AS DOUBLE)"}))
SPEED = lambda n: f"{S.change('px', n)} / nullif(({S.roll('stddev_samp', 'r', n)}) * sqrt({n}), 0)"
book.add(
    "f15_trend_following",
    lambda spark, d: O.trend_following(T.own_series(spark, d)).select("ticker", "date", out(F.col("trend")).alias("trend")),
    S.BARS
    + f""", long AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker) AS total FROM own) WHERE total >= 210),
    days AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM own)),
    t AS (SELECT ticker, date, {S.clip(f"0.4 * {SPEED(50)} + 0.6 * {SPEED(200)}", -3, 3)} AS trend FROM long)
    SELECT ticker, date, {S.out("trend")} AS trend FROM t JOIN days USING (date) WHERE i > 210""",
)


# ---- cross-section -------------------------------------------------------------------------


def _panel(fn):
    return lambda spark, d: fn(T.panel(spark, d).withColumn("x", change("pf", 21)))


X = S.PANEL + f", scored AS (SELECT *, {S.change('pf', 21)} AS x FROM panel)"
book.add("x1_zscore", _panel(lambda p: p.select("ticker", "date", out(zscore("x")).alias("z"))), X + f"SELECT ticker, date, {S.out(S.zscore('x'))} AS z FROM scored")
book.add(
    "x2_legacy_zscore",
    _panel(lambda p: p.select("ticker", "date", out(O.legacy_zscore(F.col("x"))).alias("z"))),
    X
    + f"""SELECT ticker, date, {S.out("CASE WHEN count(x) OVER w < 3 OR coalesce(stddev_samp(x) OVER w, 0) = 0 THEN 0.0 ELSE (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END")} AS z
    FROM scored WINDOW w AS (PARTITION BY date)""",
)
book.add(
    "x3_percentile_rank",
    _panel(lambda p: O.ranged_percentile_rank(p, "x").select("ticker", "date", out(F.col("pct")).alias("pct"))),
    X + f"SELECT ticker, date, {S.out(f'({S.average_rank("x")}) / nullif(count(x) OVER (PARTITION BY date), 0)')} AS pct FROM scored",
)
book.add(
    "x4_quintile",
    _panel(lambda p: O.quintile(p, "x").select("ticker", "date", F.col("quintile").cast("long").alias("quintile"))),
    X
    + """, edges AS (SELECT date, quantile_cont(x, [0.2, 0.4, 0.6, 0.8]) AS e FROM scored GROUP BY date)
    SELECT ticker, date, CASE WHEN x IS NOT NULL THEN CAST(1 + (x > e[1])::INT + (x > e[2])::INT + (x > e[3])::INT + (x > e[4])::INT AS BIGINT) END AS quintile
    FROM scored JOIN edges USING (date)""",
)
book.add(
    "x5_benchmark_correlation",
    lambda spark, d: O.benchmark_correlation(T.own_series(spark, d), T.market(spark, d)).select("ticker", "date", out(F.col("corr")).alias("corr")),
    S.BARS
    + S.MARKET
    + f""", paired AS (SELECT own.*, rm, CASE WHEN r IS NOT NULL AND rm IS NOT NULL THEN 1 END AS pair FROM own LEFT JOIN market USING (date))
    SELECT ticker, date, {S.out(f"CASE WHEN count(pair) OVER {S.frame(63)} = 63 THEN corr(r, rm) OVER {S.frame(63)} END")} AS corr FROM paired""",
)
Z = X + f", z AS (SELECT ticker, date, {S.out(S.zscore('x'))} AS z FROM scored)"
_z = lambda p: p.select("ticker", "date", out(zscore("x")).alias("z"))
book.add(
    "x6_actions",
    _panel(lambda p: O.actions(_z(p), "z").withColumn("rank", F.col("rank").cast("long"))),
    Z
    + """SELECT ticker, date, z, row_number() OVER (PARTITION BY date ORDER BY z DESC NULLS LAST, ticker) AS rank,
    CASE WHEN z > 0.5 THEN 'STRONG BUY' WHEN z > 0.1 THEN 'BUY' WHEN z > -0.1 THEN 'HOLD' WHEN z > -0.5 THEN 'REDUCE' ELSE 'SELL' END AS action FROM z""",
)
book.add(
    "x7_top_bottom",
    _panel(lambda p: O.top_bottom(_z(p), "z").select("ticker", "date", "z", F.col("best").cast("long").alias("best"), F.col("worst").cast("long").alias("worst"))),
    Z
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY z DESC, ticker) AS best, row_number() OVER (PARTITION BY date ORDER BY z, ticker) AS worst FROM z WHERE z IS NOT NULL)
    SELECT * FROM ranked WHERE best <= 5 OR worst <= 5""",
)
book.add(
    "x8_recent_performance",
    lambda spark, d: O.recent_performance(T.own_series(spark, d)).select("ticker", out(F.col("ret")).alias("ret")),
    S.BARS
    + f""", days AS (SELECT DISTINCT date FROM own ORDER BY date DESC LIMIT 30)
    SELECT ticker, {S.out("arg_max(px, date) / nullif(arg_min(px, date), 0) - 1")} AS ret FROM own WHERE date IN (SELECT date FROM days) GROUP BY ticker""",
)
