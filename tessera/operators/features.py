"""Own-series features (F1-F15) and cross-sectional operators.

Inputs are bars (ticker, date, open, high, low, close, px, volume, r, n).  Shifts are columns that share one
partitioning by ticker; rolling figures are taken in one pass over the same sorted rows (functions.sliding).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranges
from tessera.functions.scans import affine_scan
from tessera.functions.sliding import avg, corr, high, sd, sliding
from tessera.functions.windows import ANNUAL, change, clip, lag, percentile_rank, ratio, roll, series, zscore
from tessera.sources.tables import stored

HORIZONS = (1, 5, 21, 63, 126, 252)
LEAST_ROWS = 252


def long_enough(own: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Tickers with at least `least` rows."""
    return own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("ticker"))).where(F.col("_n") >= least).drop("_n")


def returns() -> dict[str, Column]:
    """F1."""
    return {f"ret_{k}": change("px", k) for k in HORIZONS}


def volatility(own: DataFrame, *looks: int) -> DataFrame:
    """vol_n, the annualised sample deviation of n returns."""
    found = sliding(own, {f"vol_{n}": sd("r", n) for n in looks})
    return found.withColumns({f"vol_{n}": F.col(f"vol_{n}") * F.sqrt(F.lit(ANNUAL)) for n in looks})


def volatility_ratio(own: DataFrame) -> DataFrame:
    """F3."""
    return volatility(own, 21, 63).withColumn("ratio", ratio(F.col("vol_21"), F.col("vol_63")))


def recursive_features(own: DataFrame, chunk: int = 2048) -> DataFrame:
    """F4 + F5: ticker, date, rsi, macd, macd_signal, macd_hist.

    Wilder's averages begin with the mean of 14 moves, the exponential ones with the first price; both are scans over
    chunks of a ticker (functions.scans).
    """
    w = series()
    n = F.row_number().over(w)
    rows = own.select("ticker", "date", F.col("px").cast("double").alias("px"), n.alias("n"), F.coalesce(F.col("px") - F.lag("px").over(w), F.lit(0.0)).alias("step"))
    up, down = F.greatest(F.col("step"), F.lit(0.0)), F.greatest(-F.col("step"), F.lit(0.0))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    wilder = lambda x: F.when(F.col("n") > 14, x / 14).when(F.col("n") == 14, F.sum(x).over(upto) / 14)
    ema = lambda x, a: F.when(F.col("n") == 1, x).otherwise(a * x)
    p = F.col("px")
    begun = rows.withColumns({"_up": wilder(up), "_down": wilder(down), "_fast": ema(p, 2 / 13), "_slow": ema(p, 2 / 27)})
    terms = {"gain": ("_up", 13 / 14), "loss": ("_down", 13 / 14), "fast": ("_fast", 11 / 13), "slow": ("_slow", 25 / 27)}
    first = affine_scan(begun, terms, order="n", chunk=chunk).withColumn("macd", F.col("fast") - F.col("slow"))
    second = affine_scan(first.withColumn("_m", ema(F.col("macd"), 0.2)), {"macd_signal": ("_m", 0.8)}, order="n", chunk=chunk)
    gain, loss = F.col("gain"), F.col("loss")
    rsi = F.when(F.col("n") >= 14, F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, F.lit(100.0)))
    return second.select("ticker", "date", rsi.alias("rsi"), "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist"))


def bands(p: Column, m: Column, s: Column) -> Column:
    """Place of p between the bands of 2 deviations around the mean."""
    return ratio(p - (m - 2 * s), 4 * s)


def bollinger(own: DataFrame) -> DataFrame:
    """`place` between the bands of 20 rows and 2 deviations."""
    found = sliding(own, {"_m": avg("px", 20), "_s": sd("px", 20)})
    return found.withColumn("place", bands(F.col("px"), F.col("_m"), F.col("_s"))).drop("_m", "_s")


def true_range() -> Column:
    before = lag("close", 1)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def with_atr(own: DataFrame) -> DataFrame:
    """simple mean of 14 true ranges; the first row's range is high - low."""
    return sliding(own.withColumn("tr", true_range()), {"atr": avg("tr", 14)})


def volume_ratio(own: DataFrame) -> DataFrame:
    """F8: `ratio`.  Volumes are whole numbers: their sum over 21 rows is exact, so that the mean is rounded once and ties of the output fall as they should."""
    return own.withColumn("ratio", ratio(F.col("volume").cast("double"), roll(F.avg, "volume", 21)))


def drawdown(own: DataFrame) -> DataFrame:
    """`drawdown`."""
    return sliding(own, {"_h": high("px", 252)}).withColumn("drawdown", ratio(F.col("px"), F.col("_h")) - 1).drop("_h")


def sma_cross(own: DataFrame) -> DataFrame:
    """`sma_cross`."""
    found = sliding(own, {"_short": avg("px", 50), "_long": avg("px", 200)})
    return found.withColumn("sma_cross", ratio(F.col("_short"), F.col("_long")) - 1).drop("_short", "_long")


def momentum_12_1() -> Column:
    """a difference of returns."""
    return change("px", 252) - change("px", 21)


def latest(features: DataFrame) -> DataFrame:
    """the newest row of each ticker."""
    rest = [c for c in features.columns if c != "ticker"]
    return features.groupBy("ticker").agg(F.max_by(F.struct(*rest), "date").alias("s")).select("ticker", "s.*")


def macro_features(macro: DataFrame, base: str, second: str, vix: str, vix_spare: str, claims: str) -> DataFrame:
    """on the dates of the first series; differences first, then filled forward.  A few short series."""

    def one(series_id: str, name: str) -> DataFrame:
        return macro.where(F.col("series_id") == series_id).select("date", F.col("value").alias(name))

    fear = one(vix, "vix")
    fear = one(vix_spare, "vix") if fear.isEmpty() else fear
    wide = one(base, "base")
    for other in (one(second, "second"), fear, one(claims, "claims")):
        wide = wide.join(other, "date", "left")  # one row a date
    w = Window.orderBy("date")
    mean = lambda c, n: F.when(F.count(c).over(w.rowsBetween(1 - n, 0)) == n, F.avg(c).over(w.rowsBetween(1 - n, 0)))
    wide = wide.withColumn("spread", F.col("base") - F.col("second"))
    wide = wide.select(
        "date", "spread", "vix", (F.col("spread") - F.lag("spread", 21).over(w)).alias("spread_21"), (F.col("vix") - F.lag("vix", 5).over(w)).alias("vix_5"),
        mean("vix", 21).alias("vix_sma"), ratio(F.col("vix"), mean("vix", 21)).alias("vix_ratio"), mean("claims", 4).alias("claims_4"),
    )
    fill = w.rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("date", *(F.last(c, ignorenulls=True).over(fill).alias(c) for c in wide.columns if c != "date"))


def trend_strength(own: DataFrame) -> DataFrame:
    """`strength`, -1, 0 or 1; a missing average compares as not above."""
    found = sliding(own, {"_50": avg("px", 50), "_200": avg("px", 200)})
    above = lambda n: F.when(F.col("px") > F.col(f"_{n}"), 1).otherwise(0)
    return found.withColumn("strength", (above(50) + above(200) - 1).cast("double")).drop("_50", "_200")


def trend_following(own: DataFrame) -> DataFrame:
    """fast and slow risk-adjusted trend for tickers of 210 rows; the first 210 calendar rows are dropped."""
    moved = long_enough(own, 210).withColumns({f"_c{n}": change("px", n) for n in (50, 200)})
    found = sliding(moved, {f"_s{n}": sd("r", n) for n in (50, 200)})
    speed = lambda n: ratio(F.col(f"_c{n}"), F.col(f"_s{n}") * F.sqrt(F.lit(float(n))))
    scored = found.withColumn("trend", clip(0.4 * speed(50) + 0.6 * speed(200), -3, 3))
    late = own.select("date").distinct().withColumn("_i", F.row_number().over(Window.orderBy("date"))).where("_i > 210").drop("_i")
    return scored.join(late, "date", "left_semi").select("ticker", "date", "trend")


# ---- cross-section -------------------------------------------------------------------------


def legacy_zscore(x: Column) -> Column:
    """Zero for everyone, missing names too, if fewer than three values or no deviation."""
    w = Window.partitionBy("date")
    sd = F.stddev_samp(x).over(w)
    z = (x - F.avg(x).over(w)) / F.when(sd != 0, sd)
    return F.when((F.count(x).over(w) < 3) | sd.isNull() | (sd == 0), F.lit(0.0)).otherwise(z)


def ranged_percentile_rank(df: DataFrame, x: str, name: str = "pct") -> DataFrame:
    """Percentile rank of x on its date, ties at their mean; a date of any size runs in several tasks."""
    found = ranges.ranked(df, x, ["date"], stored, "_rank", "_held")
    return found.withColumn(name, F.col("_rank") / F.col("_held")).drop("_rank", "_held")


def quintile(df: DataFrame, x: str) -> DataFrame:
    """Label 1-5 by linearly interpolated edges, right-closed; edges come from sorted ranges of the date's values."""
    edges = ranges.quantiles(df, x, ["date"], (0.2, 0.4, 0.6, 0.8), stored).withColumnRenamed("edges", "_e")  # a row a date
    label = sum((F.when(F.col(x) > F.col("_e")[k], 1).otherwise(0) for k in range(4)), F.lit(1))
    return df.join(edges, "date", "left").withColumn("quintile", F.when(F.col(x).isNotNull(), label)).drop("_e")


def benchmark_correlation(own: DataFrame, market: DataFrame, n: int = 63) -> DataFrame:
    """Correlation of returns over n rows; the benchmark is one short series and is sent to all."""
    return sliding(own.join(market, "date", "left"), {"corr": corr("r", "rm", n)})


def actions(df: DataFrame, score: str) -> DataFrame:
    """Rank by descending score and an action label."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.col(score).desc_nulls_last(), "ticker"))
    s = F.col(score)
    label = F.when(s > 0.5, "STRONG BUY").when(s > 0.1, "BUY").when(s > -0.1, "HOLD").when(s > -0.5, "REDUCE").otherwise("SELL")
    return df.withColumn("rank", rank).withColumn("action", label)


def top_bottom(df: DataFrame, score: str, k: int = 5) -> DataFrame:
    """The k best and k worst names of each date; names without a score take no part."""
    scored = df.where(F.col(score).isNotNull())
    w = Window.partitionBy("date")
    best = F.row_number().over(w.orderBy(F.col(score).desc(), "ticker"))
    worst = F.row_number().over(w.orderBy(F.col(score), "ticker"))
    return scored.withColumn("best", best).withColumn("worst", worst).where((F.col("best") <= k) | (F.col("worst") <= k))


def recent_performance(own: DataFrame, n: int = 30) -> DataFrame:
    """Return of each ticker over the last n calendar rows."""
    days = own.select("date").distinct().orderBy(F.desc("date")).limit(n)
    near = own.join(days, "date", "left_semi")
    return near.groupBy("ticker").agg((ratio(F.max_by("px", "date"), F.min_by("px", "date")) - 1).alias("ret"))


__all__ = ["percentile_rank", "zscore", "series"]
