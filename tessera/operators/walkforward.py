"""Targets of the live path at every rebalance date (W2), for several configurations at once.

Signals -> information coefficients -> adapted weights -> composite -> eligibility -> regime
exposure -> P2-P5.  Targets don't depend on the path of the book, so all dates are built together;
the only folds are the weights (rebalance dates of a configuration) and the regime (days).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import league, portfolio, regime

Config = tuple[str, int, float]  #: name, rows between rebalances, net exposure in a crisis


def configurations(spark: SparkSession, configs: list[Config]) -> DataFrame:
    return spark.createDataFrame(configs, "config string, every int, crisis_net double")


def rebalances(calendar: DataFrame, configs: DataFrame, warmup: int) -> DataFrame:
    """config, crisis_net, date, i, period of every rebalance row; `calendar` (date, i) and `configs` are short."""
    last = calendar.agg(F.max("i").alias("last"))
    rows = calendar.crossJoin(last).crossJoin(configs).where((F.col("i") >= warmup) & (F.col("i") < F.col("last")) & ((F.col("i") - warmup) % F.col("every") == 0))
    return rows.select("config", "crisis_net", "date", "i", F.expr(f"(i - {warmup}) div every").alias("period"))


def on_rebalance(configs: list[Config], warmup: int, backs: tuple[int, ...] = (0,)) -> Column:
    """Whether the row i + b is a rebalance of any configuration, for one of `backs`."""
    at = lambda i: (i >= warmup) & reduce(lambda a, b: a | b, ((i - warmup) % every == 0 for every in sorted({c[1] for c in configs})))
    return reduce(lambda a, b: a | b, (at(F.col("i") + b) for b in backs))


def live_targets(signals: DataFrame, names: list[str], names_of_date: DataFrame, path: DataFrame, calendar: DataFrame, configs: list[Config], warmup: int = 300,
                 longs: int = 40, shorts: int = 20, least: int = 10, **caps: float) -> DataFrame:
    """Config, period, date, ticker, weight.

    signals: ticker, date, i, ahead_21, ahead_63 and the columns `names`, on the rebalance rows and those 21 and 63 before; names_of_date: ticker, date, eligible, vol, sector,
    asset_class; path: date, regime; calendar: date, i.
    """
    spark = signals.sparkSession
    cal = rebalances(calendar, configurations(spark, configs), warmup)
    on = on_rebalance(configs, warmup)
    ics = league.blended_ics(signals, names, least=least, on=on, days=calendar)
    weights = league.adapt_weights(cal.select(F.col("config").alias("strategy_id"), "date").join(ics, "date"), names).withColumnRenamed("strategy_id", "config")
    scores = league.ensemble(signals.where(on), names, weights, keys=["config", "date"])
    ladder = regime.exposures(path.select("date", "regime")).select("date", "regime", "gross", "net")
    stance = cal.join(ladder, "date").select("config", "date", "period", "gross", F.when(F.col("regime") == regime.CRISIS, F.col("crisis_net")).otherwise(F.col("net")).alias("net"))
    scored = scores.withColumnRenamed("composite", "score").join(names_of_date.where("eligible"), ["date", "ticker"]).join(stance, ["config", "date"])
    targets = portfolio.build_targets(scored, F.col("gross"), F.col("net"), longs, shorts, keys=["config", "date"], **caps)
    return targets.select("config", "period", "date", "ticker", "weight")
