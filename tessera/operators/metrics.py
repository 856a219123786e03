"""Performance metrics (M1-M18) and walk-forward evaluation (W1-W8), set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranges
from tessera.functions.sliding import avg, sd, sliding
from tessera.functions.windows import ANNUAL, ratio

YEAR = ANNUAL


def running(key: str | list[str] = "strategy_id"):
    return Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)


def equity(daily: DataFrame, key: str | list[str] = "strategy_id", unit: str | None = None) -> DataFrame:
    """M1: equity = running product of 1 + ret; a missing ret is 0, and after a total loss all is 0.

    `unit` cuts long series into ranges of time that are dealt to tasks apart, each continued from the ranges before.
    """
    if unit:
        return ranges.running(daily, {"equity": ("product", 1 + F.coalesce("ret", F.lit(0.0)))}, [key] if isinstance(key, str) else key, "date", unit)
    return daily.withColumn("equity", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(running(key)))


def sharpe(r: Column, least: int = 20) -> Column:
    """M2, as an aggregate."""
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= least) & (sd > 0), F.avg(r) / sd * F.sqrt(F.lit(YEAR)))


def drawdowns(eq: DataFrame, key: str | list[str] = "strategy_id", unit: str | None = None) -> DataFrame:
    """M4: `eq` with dd, the equity against its peak so far; `unit` as in `equity`."""
    if unit:
        peaks = ranges.running(eq, {"_peak": ("max", F.col("equity"))}, [key] if isinstance(key, str) else key, "date", unit)
        return peaks.withColumn("dd", ratio(F.col("equity"), F.col("_peak")) - 1).drop("_peak")
    return eq.withColumn("dd", ratio(F.col("equity"), F.max("equity").over(running(key))) - 1)


def summary(daily: DataFrame, key: str | list[str] = "strategy_id", unit: str | None = None) -> DataFrame:
    """M1-M5: cagr, sharpe, sortino, max_drawdown, hit_rate, vol by strategy; `unit` as in `equity`."""
    eq = drawdowns(equity(daily, key, unit), key, unit)
    r = F.col("ret")
    down = F.stddev_samp(F.when(r < 0, r))
    return eq.groupBy(*([key] if isinstance(key, str) else key)).agg(
        F.when(F.max_by("equity", "date") >= 0, F.pow(F.max_by("equity", "date"), YEAR / F.count(F.lit(1))) - 1).alias("cagr"), F.round(sharpe(r), 2).alias("sharpe"),
        F.when(down > 0, F.avg(r) * YEAR / (down * F.sqrt(F.lit(YEAR)))).alias("sortino"), F.min("dd").alias("max_drawdown"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"), (F.stddev_samp(r) * F.sqrt(F.lit(YEAR))).alias("vol"),
    )


def benchmark_cagr(daily: DataFrame, bench: DataFrame, key: str = "strategy_id") -> DataFrame:
    """M5: key, benchmark_cagr of the benchmark (date, rm) over the days of each strategy; a missing return is 0."""
    both = daily.select(key, "date").join(bench.select("date", "rm"), "date", "left")
    grown = F.product(1 + F.coalesce("rm", F.lit(0.0)))
    return both.groupBy(key).agg((F.pow(grown, YEAR / F.count(F.lit(1))) - 1).alias("benchmark_cagr"))


def ledger_metrics(values: DataFrame, key: str = "strategy_id", rf: float = 0.04, trades: DataFrame | None = None) -> DataFrame:
    """M6 over (key, date, value): start and end value, total return, CAGR on days / 365.25, Sharpe, Sortino and Calmar against rf.

    Sortino takes the whole deviation where no return is negative; a ratio without a denominator is 0; Calmar is
    absolute.  `trades` (key, cost) adds their number and total cost.
    """
    w = Window.partitionBy(key).orderBy("date")
    rows = values.withColumn("r", ratio(F.col("value"), F.lag("value").over(w)) - 1).withColumn("dd", ratio(F.col("value"), F.max("value").over(running(key))) - 1)
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    total = ratio(F.max_by("value", "date"), F.min_by("value", "date"))
    agg = rows.groupBy(key).agg(
        (total - 1).alias("total_return"), F.when(years > 0, F.pow(total, 1 / years) - 1).alias("cagr"), (F.stddev_samp("r") * F.sqrt(F.lit(YEAR))).alias("vol"),
        (F.stddev_samp(F.when(F.col("r") < 0, F.col("r"))) * F.sqrt(F.lit(YEAR))).alias("down"), F.min("dd").alias("max_drawdown"),
        F.count(F.when(F.col("r") < 0, 1)).alias("falls"), F.min_by("value", "date").alias("start_value"), F.max_by("value", "date").alias("end_value"),
    )
    over = F.col("cagr") - rf
    safe = lambda a, b: F.coalesce(F.when(b > 0, a / b), F.lit(0.0))
    down = F.when(F.col("falls") > 0, F.col("down")).otherwise(F.col("vol"))
    out = agg.select(
        key, "start_value", "end_value", "total_return", "cagr", safe(over, F.col("vol")).alias("sharpe"), safe(over, down).alias("sortino"),
        safe(F.abs("cagr"), F.abs("max_drawdown")).alias("calmar"), "max_drawdown",
    )
    if trades is None:
        return out
    sums = trades.groupBy(key).agg(F.count(F.lit(1)).alias("trades"), F.sum("cost").alias("costs"))
    none = {"trades": F.coalesce("trades", F.lit(0)), "costs": F.coalesce(F.col("costs").cast("double"), F.lit(0.0))}
    return out.join(sums, key, "left").withColumns(none)


def period_returns(values: DataFrame, unit: str = "month", key: str = "strategy_id") -> DataFrame:
    """M7/M8: last value of each period and its change; empty months in between hold the value before (no return)."""
    last = values.groupBy(key, F.trunc("date", unit).alias("period")).agg(F.max_by("value", "date").alias("value"))
    span = last.groupBy(key).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    grid = span.select(key, F.explode(F.expr(f"sequence(a, b, interval 1 {unit})")).alias("period"))
    full = grid.join(last, [key, "period"], "left")
    before = F.lag("value").over(Window.partitionBy(key).orderBy("period"))
    return full.withColumn("ret", ratio(F.col("value"), before) - 1)


def win_loss(months: DataFrame, key: str = "strategy_id") -> DataFrame:
    """M7: the profit factor is the mean gain over the mean loss, absolute; NULL without a loss."""
    r = F.col("ret")
    gain, loss = F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r < 0, r)))
    return months.where(r.isNotNull()).groupBy(key).agg(
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.when(loss > 0, F.coalesce(gain, F.lit(0.0)) / loss).alias("profit_factor"),
        F.avg(F.when(r > 0, r)).alias("avg_win"), F.avg(F.when(r < 0, r)).alias("avg_loss"), F.max(r).alias("best"), F.min(r).alias("worst"),
    )


def against_benchmark(metrics: DataFrame, bench: DataFrame, columns: list[str]) -> DataFrame:
    """M9: strategy - benchmark (one row, sent to all)."""
    b = bench.select(*(F.col(c).alias(f"b_{c}") for c in columns))
    return metrics.crossJoin(F.broadcast(b)).select(*metrics.columns, *((F.col(c) - F.col(f"b_{c}")).alias(f"{c}_diff") for c in columns))


def yearly(daily: DataFrame, key: str = "strategy_id", least: int = 40) -> DataFrame:
    """M10."""
    r = F.col("ret")
    sd = F.stddev_samp(r)
    y = daily.where(r.isNotNull()).groupBy(key, F.year("date").alias("year")).agg(
        F.count(r).alias("n"), (F.product(1 + r) - 1).alias("ret"), (sd * F.sqrt(F.lit(YEAR))).alias("vol"), F.when(sd > 0, F.avg(r) / sd * F.sqrt(F.lit(YEAR))).alias("sharpe")
    )
    return y.where(F.col("n") >= least)


def daily_snapshot(values: DataFrame, bench: DataFrame, key: str = "strategy_id", rf: float = 0.04) -> DataFrame:
    """As of the time of writing, so peak and rolling figures end at the row before; benchmark (date, m, rm) beside it.

    The first row has no return (0) and no peak (drawdown 0).
    """
    w = Window.partitionBy(key).orderBy("date")
    rows = values.withColumn("r", F.coalesce(ratio(F.col("value"), F.lag("value").over(w)) - 1, F.lit(0.0)))
    rolled = sliding(rows, {"_m90": avg("r", 90, 20), "_s90": sd("r", 90, 20), "_s21": sd("r", 21, 5)}, key)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.lag(c).over(w)
    # population deviations of the n rows before, fewer at the start
    held = lambda n: F.least(F.lit(n), F.row_number().over(w) - 1)
    pop = lambda c, n: before(c) * F.sqrt((held(n) - 1) / F.greatest(held(n), F.lit(1)))
    sd90 = pop("_s90", 90)
    first = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row a day of the benchmark
    b = bench.select("date", F.col("rm").alias("bench_daily"), (F.col("m") / F.first("m").over(first) - 1).alias("bench_cumulative"))
    return rolled.select(
        key, "date", F.col("r").alias("daily"), (ratio(F.col("value"), F.first("value").over(running(key))) - 1).alias("cumulative"),
        F.coalesce(ratio(F.col("value"), F.max("value").over(past)) - 1, F.lit(0.0)).alias("drawdown"),
        F.when(sd90 > 0, (before("_m90") * YEAR - rf) / (sd90 * F.sqrt(F.lit(YEAR)))).alias("sharpe_90"),
        (pop("_s21", 21) * F.sqrt(F.lit(YEAR))).alias("vol_21"),
    ).join(b, "date", "left")


def monthly_summary(values: DataFrame, bench: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Start, end, return, summed benchmark returns and alpha by month."""
    both = values.join(bench, "date", "left")
    m = both.groupBy(key, F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.min_by("value", "date").alias("start"), F.max_by("value", "date").alias("end"), F.coalesce(F.sum("rm"), F.lit(0.0)).alias("bench")
    )
    return m.withColumn("ret", ratio(F.col("end"), F.col("start")) - 1).withColumn("alpha", F.col("ret") - F.col("bench"))


def ytd(values: DataFrame, year: int, key: str = "strategy_id", rf: float = 0.04) -> DataFrame:
    """Population deviation; the year's first return is that on the last value before; drawdown against the highest of the year."""
    w = Window.partitionBy(key).orderBy("date")
    rows = values.withColumn("r", F.coalesce(ratio(F.col("value"), F.lag("value").over(w)) - 1, F.lit(0.0))).where(F.year("date") == year)
    vol = F.stddev_pop("r") * F.sqrt(F.lit(YEAR))
    return rows.groupBy(key).agg(
        (ratio(F.max_by("value", "date"), F.min_by("value", "date")) - 1).alias("ret"), F.when(vol > 0, (F.avg("r") * YEAR - rf) / vol).alias("sharpe"), vol.alias("vol"),
        (F.min("value") / F.max("value") - 1).alias("drawdown"), F.count(F.lit(1)).alias("days"),
    )


#: Fixed look-backs in days; ytd and inception are 0 and -1.
PERIODS = [("1W", 7), ("1M", 30), ("3M", 91), ("6M", 182), ("1Y", 365), ("YTD", 0), ("ALL", -1)]


def multi_period(values: DataFrame, bench: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Returns over PERIODS for strategy and benchmark (date, m), and the winner."""
    end = values.agg(F.max("date")).first()[0]  # one date

    def over(df: DataFrame, x: str, name: str, *keys: str) -> DataFrame:
        """One conditional aggregate a period instead of a copy of the rows."""
        figures = []
        for period, days in PERIODS:
            last = F.lit(end).cast("date")
            start = F.date_sub(last, days) if days > 0 else F.trunc(last, "year") if days == 0 else F.lit("1900-01-01").cast("date")
            at = F.when(F.col("date") >= start, F.col("date"))
            figures.append(F.struct(F.lit(period).alias("period"), (ratio(F.max_by(x, at), F.min_by(x, at)) - 1).alias(name), F.count(at).alias("n")))
        each = df.groupBy(*keys).agg(F.array(*figures).alias("f")).select(*keys, F.explode("f").alias("f"))
        return each.where("f.n > 0").select(*keys, "f.period", f"f.{name}")

    own, b = over(values, "value", "ret", key), over(bench, "m", "bench")
    return own.join(b, "period").withColumn("winner", F.when(F.col("ret") > F.col("bench"), "portfolio").otherwise("benchmark"))


def rebased(values: DataFrame, bench: DataFrame, key: str = "strategy_id") -> DataFrame:
    """Both curves from 100 on the union of dates, filled forward."""
    keys = values.select(key).distinct()
    dates = values.select("date").unionByName(bench.select("date")).distinct()
    full = keys.crossJoin(F.broadcast(dates)).join(values, [key, "date"], "left").join(F.broadcast(bench), "date", "left")
    run, whole = running(key), Window.partitionBy(key).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = lambda c: F.last(c, ignorenulls=True).over(run) / F.first(c, ignorenulls=True).over(whole) * 100
    return full.select(key, "date", one("value").alias("curve"), one("m").alias("bench_curve"))


def rolling_alpha(daily: DataFrame, bench: DataFrame, n: int = 20, key: str = "strategy_id") -> DataFrame:
    """Mean difference of returns over n rows x 252 x 100."""
    both = daily.join(bench, "date").withColumn("d", F.col("ret") - F.col("rm"))
    w = Window.partitionBy(key).orderBy("date").rowsBetween(-(n - 1), 0)
    return both.withColumn("alpha", F.when(F.count("d").over(w) == n, F.avg("d").over(w) * 25200))


def holding_frequency(holdings: DataFrame, top: int = 10) -> DataFrame:
    """M17 over (date, tickers array)."""
    total = holdings.agg(F.count(F.lit(1)).alias("total"))
    held = holdings.select(F.explode("tickers").alias("ticker")).groupBy("ticker").agg(F.count(F.lit(1)).alias("times"))
    return held.crossJoin(F.broadcast(total)).select("ticker", "times", (F.col("times") / F.col("total")).alias("share")).orderBy(F.desc("times"), "ticker").limit(top)


def macro_latest(macro: DataFrame, last: int = 252) -> DataFrame:
    """Newest value of each series, change over 5 rows, and distance from the peak of its last 252 rows."""
    w = Window.partitionBy("series_id").orderBy(F.desc("date"))
    rows = macro.withColumn("k", F.row_number().over(w)).where(F.col("k") <= last)
    one = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    return rows.groupBy("series_id").agg(one(1).alias("latest"), (one(1) - one(6)).alias("change_5"), (one(1) / F.max("value") - 1).alias("drawdown"), F.count(F.lit(1)).alias("rows"))


# ---- walk-forward --------------------------------------------------------------------------


def rebalance_calendar(dates: DataFrame, every: int, warmup: int) -> DataFrame:
    """I, date, period of each row after the warm-up; a period begins on a rebalance row."""
    last = dates.agg(F.max("i").alias("last"))
    rows = dates.crossJoin(F.broadcast(last)).where((F.col("i") >= warmup) & (F.col("i") <= F.col("last")))
    return rows.select("date", "i", F.expr(f"(i - {warmup}) div {every}").alias("period"), (((F.col("i") - warmup) % every == 0) & (F.col("i") < F.col("last"))).alias("rebalance"))


def drifted_returns(targets: DataFrame, returns: DataFrame, every: int | Column, warmup: int) -> tuple[DataFrame, DataFrame]:
    """(config, period, i, date, v, gross, held_gross, held_net) by day and the weights at the end of each period (config, period, ticker, weight).

    Within a period a name is worth w0 prod(1 + r), the book 1 + sum w0 (prod(1 + r) - 1): no day loop.
    targets: config, period, ticker, weight; returns: ticker, i, date, r (and config, every where cadences
    differ); missing returns are 0.
    """
    step = F.lit(every) if isinstance(every, int) else every
    rows = returns.where(F.col("i") > warmup).withColumn("r", F.coalesce("r", F.lit(0.0))).withColumn("period", F.call_function("div", F.col("i") - warmup - 1, step))
    held = targets.join(rows, [c for c in ("config", "period", "ticker") if c in rows.columns])
    name = Window.partitionBy("config", "period", "ticker").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    grown = held.withColumn("value", F.col("weight") * F.product(1 + F.col("r")).over(name))
    book = grown.groupBy("config", "period", "i", "date").agg((1 + F.sum(F.col("value") - F.col("weight"))).alias("v"), F.sum(F.abs("value")).alias("g"), F.sum("value").alias("n"))
    before = F.coalesce(F.lag("v").over(Window.partitionBy("config", "period").orderBy("i")), F.lit(1.0))
    daily = book.select("config", "period", "i", "date", "v", (ratio(F.col("v"), before) - 1).alias("gross"), ratio(F.col("g"), F.col("v")).alias("held_gross"), ratio(F.col("n"), F.col("v")).alias("held_net"))
    last = grown.groupBy("config", "period", "ticker").agg(F.max_by("value", "i").alias("value"))
    final = book.groupBy("config", "period").agg(F.max_by("v", "i").alias("v"))
    return daily, last.join(final, ["config", "period"]).select("config", "period", "ticker", ratio(F.col("value"), F.col("v")).alias("weight"))


def traded(targets: DataFrame, ends: DataFrame) -> DataFrame:
    """Config, period, traded - sum |new - drifted old|, the first book from nothing; an equi-join on period - 1."""
    old = ends.select("config", (F.col("period") + 1).alias("period"), "ticker", F.col("weight").alias("old"))
    both = targets.join(old, ["config", "period", "ticker"], "full_outer").join(targets.select("config", "period").distinct(), ["config", "period"], "left_semi")
    return both.groupBy("config", "period").agg(F.sum(F.abs(F.coalesce("weight", F.lit(0.0)) - F.coalesce("old", F.lit(0.0)))).alias("traded"))


def net_returns(daily: DataFrame, trades: DataFrame, bps: float | Column) -> DataFrame:
    """Costs come off the first day of a period."""
    first = F.row_number().over(Window.partitionBy("config", "period").orderBy("i")) == 1
    cost = F.when(first, F.col("traded") * bps / 10000.0).otherwise(F.lit(0.0))
    return daily.join(trades, ["config", "period"]).withColumn("ret", F.col("gross") - cost)


def turnover_summary(daily: DataFrame, trades: DataFrame) -> DataFrame:
    """Turnover a year, mean gross and net exposure by day, after drift."""
    book = daily.groupBy("config").agg((F.count(F.lit(1)) / YEAR).alias("years"), F.avg("held_gross").alias("gross"), F.avg("held_net").alias("net"))
    t = trades.groupBy("config").agg(F.sum("traded").alias("traded"))
    return t.join(book, "config").select("config", (F.col("traded") / F.col("years") / 2).alias("turnover"), "gross", "net")


def cost_sensitivity(daily: DataFrame, trades: DataFrame, levels=(0.0, 5.0, 15.0)) -> DataFrame:
    """Config, bps, cagr, sharpe, max_drawdown, total and turnover at every cost level, without a second run."""
    costs = daily.sparkSession.createDataFrame([(float(b),) for b in levels], "bps double")
    spread = daily.crossJoin(F.broadcast(costs))
    first = F.row_number().over(Window.partitionBy("config", "bps", "period").orderBy("i")) == 1
    net = spread.join(trades, ["config", "period"]).withColumn("ret", F.col("gross") - F.when(first, F.col("traded") * F.col("bps") / 10000.0).otherwise(F.lit(0.0)))
    total = net.groupBy("config", "bps").agg((F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("total"))
    figures = summary(net, ["config", "bps"]).select("config", "bps", "cagr", "sharpe", "max_drawdown").join(total, ["config", "bps"])
    years = daily.groupBy("config").agg((F.count(F.lit(1)) / YEAR).alias("years"))
    turnover = trades.groupBy("config").agg(F.sum("traded").alias("traded")).join(years, "config").select("config", (F.col("traded") / F.col("years") / 2).alias("turnover"))
    return figures.join(turnover, "config")


def blends(a: DataFrame, b: DataFrame, allocations=(1.0, 0.0, 0.7, 0.6, 0.5)) -> DataFrame:
    """Share of the first engine, cagr, sharpe, max_drawdown and vol of mixes of two return series (date, ret), and their correlation.

    Shares 1 and 0 are the engines alone.
    """
    both = a.select("date", F.col("ret").alias("x")).join(b.select("date", F.col("ret").alias("y")), "date").where("x is not null and y is not null")
    mixes = a.sparkSession.createDataFrame([(float(w),) for w in allocations], "share double")
    mixed = both.crossJoin(mixes).withColumn("r", F.col("share") * F.col("x") + (1 - F.col("share")) * F.col("y"))
    figures = summary(mixed.select("share", "date", F.col("r").alias("ret")), "share").select("share", "cagr", "sharpe", "max_drawdown", "vol")
    return figures.join(mixed.groupBy("share").agg(F.round(F.corr("x", "y"), 2).alias("corr")), "share")
