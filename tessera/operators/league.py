"""Information coefficients, weight adaptation (C1-C5) and the signal league.

Work is done on tall rows (signal, date, ticker), unpivoted only on the dates that count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sections import both_ends, rank_correlations
from tessera.functions.windows import ratio, series
from tessera.sources.tables import stored


def tall(df: DataFrame, signals: list[str], keep: list[str]) -> DataFrame:
    return df.unpivot(["ticker", "date", "i", *keep], signals, "signal", "score")


def rank_correlation(pairs: DataFrame, x: str, y: str, least: int, keys: tuple[str, ...] = ("signal", "date")) -> DataFrame:
    """keys, i, n, ic: Spearman over rows where both values are there; ranks are taken on those rows."""
    columns = [*keys, "i"]
    found = rank_correlations(pairs.withColumnsRenamed({k: f"_{n}" for n, k in enumerate(columns)}), [x], y, [f"_{n}" for n in range(len(columns))], least)
    return found.select(*(F.col(f"_{n}").alias(k) for n, k in enumerate(columns)), "n", "ic")


def with_ahead(panel: DataFrame, backs: tuple[int, ...] = (21, 63)) -> DataFrame:
    """ahead_b: the return over the next b rows, for each of `backs` that isn't there; taken while the rows of a ticker are together."""
    new = {f"ahead_{b}": ratio(F.lead("pf", b).over(series()), F.col("pf")) - 1 for b in backs if f"ahead_{b}" not in panel.columns}
    return panel.withColumns(new) if new else panel


def trailing_ics(
    signals: DataFrame, names: list[str], backs: tuple[int, ...] = (21,), least: int = 10, on: Column | None = None, days: DataFrame | None = None
) -> DataFrame:
    """Signal, date, i, back, ic of the signal `back` rows ago against the return since; 0 where it can't be told.

    `signals` has a row of every name on every date, with pf or `with_ahead`: a score stays on its own date and meets the return ahead of it
    there, so that nothing is shifted after the scores of a date are taken.  `on` tells the dates that count, by date and i; `days` is
    the calendar (date, i), if at hand.
    """
    days = signals.select("date", "i").distinct() if days is None else days.select("date", "i")
    days = days if on is None else days.where(on)
    looks = signals.sparkSession.createDataFrame([(b,) for b in backs], "back int")
    pairs = days.crossJoin(looks).where("i >= back + 1").select("date", F.col("i").alias("_i"), "back", (F.col("i") - F.col("back")).alias("i"))
    scores = with_ahead(signals, backs).select("i", *names, *(f"ahead_{b}" for b in backs))
    ret = F.coalesce(*(F.when(F.col("back") == b, F.col(f"ahead_{b}")) for b in backs))
    past = scores.join(F.broadcast(pairs), "i").select("date", F.col("_i").alias("i"), "back", *names, ret.alias("_ret"))  # a row a date and look-back
    ic = rank_correlations(past, names, "_ret", ["date", "i", "back"], least)
    every = signals.sparkSession.createDataFrame([(s, b) for s in names for b in backs], "signal string, back int")
    safe = F.when(F.col("ic").isNotNull() & ~F.isnan("ic"), F.col("ic")).otherwise(F.lit(0.0))
    return days.crossJoin(every).join(ic.drop("i"), ["signal", "date", "back"], "left").select("signal", "date", "i", "back", safe.alias("ic"))


def blended_ics(signals: DataFrame, names: list[str], short: int = 21, long: int = 63, least: int = 10, on: Column | None = None, days: DataFrame | None = None) -> DataFrame:
    """0.70 of the short and 0.30 of the long IC."""
    one = lambda b: F.max(F.when(F.col("back") == b, F.col("ic")))
    return trailing_ics(signals, names, (short, long), least, on, days).groupBy("signal", "date", "i").agg((0.70 * one(short) + 0.30 * one(long)).alias("ic"))


def adapt_weights(ics: DataFrame, names: list[str], alpha: float = 2 / 11, floor: float = 0.05, ceiling: float = 0.40) -> DataFrame:
    """strategy_id, date, signal, weight - a fold over dates, one strategy at a time (rows: dates x signals)."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="signal", values="ic").sort_index().reindex(columns=names).fillna(0.0)
        w = np.full(len(names), 1 / len(names))
        rows = []
        for ic in wide.to_numpy():
            w = np.clip(alpha * (1 / len(names) + 0.5 * np.maximum(ic, 0)) + (1 - alpha) * w, floor, ceiling)
            w = w / w.sum()
            rows.append(w)
        out = pd.DataFrame(rows, index=wide.index, columns=names).rename_axis("date").reset_index().melt("date", var_name="signal", value_name="weight")
        return out.assign(strategy_id=pdf["strategy_id"].iloc[0])

    return ics.groupBy("strategy_id").applyInPandas(fold, "strategy_id string, date date, signal string, weight double")


def latest_weights(weights: DataFrame, names: list[str]) -> DataFrame:
    """C4: the newest weights of a strategy, renormalised; equal ones unless all signals are there."""
    newest = weights.join(weights.groupBy("strategy_id").agg(F.max("date").alias("date")), ["strategy_id", "date"], "left_semi")
    held = newest.where(F.col("signal").isin(names)).groupBy("strategy_id").agg(F.map_from_entries(F.collect_list(F.struct("signal", "weight"))).alias("w"))
    total = F.aggregate(F.map_values("w"), F.lit(0.0), lambda a, x: a + x)
    each = held.select("strategy_id", "w", total.alias("total"), F.explode(F.array(*map(F.lit, names))).alias("signal"))
    whole = (F.size("w") == len(names)) & (F.col("total") > 0)
    return each.select("strategy_id", "signal", F.when(whole, F.element_at("w", F.col("signal")) / F.col("total")).otherwise(F.lit(1 / len(names))).alias("weight"))


def ensemble(signals: DataFrame, names: list[str], weights: DataFrame, least: int = 3, keys: list[str] | None = None) -> DataFrame:
    """Keys (date), ticker, composite, rank under weights (keys, signal, weight)."""
    keys = keys or ["date"]
    held = weights.where(F.col("signal").isin(names)).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("signal", "weight"))).alias("_w"))
    rows = signals.select("ticker", "date", *names).join(F.broadcast(held), "date")  # a row a date and configuration
    one = [(F.col(n), F.element_at("_w", F.lit(n))) for n in names]
    known = [s.isNotNull() & w.isNotNull() for s, w in one]
    add = lambda values: sum(values, F.lit(0.0))
    live = sum((k.cast("int") for k in known), F.lit(0))
    total, score = add(F.when(k, w).otherwise(0.0) for k, (_, w) in zip(known, one)), add(F.when(k, w * s).otherwise(0.0) for k, (s, w) in zip(known, one))
    rows = rows.select(*keys, "ticker", live.alias("live"), score.alias("s"), total.alias("w")).where((F.col("live") >= least) & (F.col("w") > 0))
    # ranked by what is reported, so that equal reports tie by name
    rows = rows.select(*keys, "ticker", (F.round(F.col("s") / F.col("w"), 6) + F.lit(0.0)).alias("composite"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("composite"), "ticker")))


# ---- league --------------------------------------------------------------------------------


def with_forward(signals: DataFrame, h: int) -> DataFrame:
    """fwd: the return over the next h rows; kept where rows that count have been picked after it was taken."""
    return signals if "fwd" in signals.columns else signals.withColumn("fwd", ratio(F.lead("pf", h).over(series()), F.col("pf")) - 1)


def ic_series(signals: DataFrame, names: list[str], h: int = 21, start: int = 260, least: int = 50) -> DataFrame:
    """Signal, date, i, n, ic on rows start, start + h, ... before the last h."""
    on = with_forward(signals, h).where((F.col("i") >= start) & ((F.col("i") - start) % h == 0))
    return rank_correlations(on, names, "fwd", ["date", "i"], least).where(F.col("ic").isNotNull() & ~F.isnan("ic"))


def t_stat(ic: Column | str, least: int = 8) -> Column:
    """A20, as an aggregate."""
    n, sd = F.count(ic), F.stddev_samp(ic)
    return F.when((n >= least) & (sd > 0), F.avg(ic) / (sd / F.sqrt(n))).otherwise(F.lit(0.0))


def quintile_members(signals: DataFrame, names: list[str], rebal: int = 5, start: int = 260, least: int = 50, smallest: int = 10) -> DataFrame:
    """signal, period, ticker, leg (1 top, -1 bottom), q."""
    rows = both_ends(signals.where((F.col("i") >= start) & ((F.col("i") - start) % rebal == 0)), names, "i", "ticker", 0.2, smallest, least)
    return rows.select("signal", F.expr(f"(i - {start}) div {rebal}").alias("period"), "ticker", "leg", "q")


def quintile_spread(members: DataFrame, daily: DataFrame, rebal: int = 5, start: int = 260) -> DataFrame:
    """Signal, period, spread - the sum over the next `rebal` rows of mean(top) - mean(bottom); an equi-join on the period."""
    later = daily.where((F.col("i") > start) & F.col("r").isNotNull()).select("ticker", "i", "r", F.expr(f"(i - {start} - 1) div {rebal}").alias("period"))
    rows = members.join(later, ["period", "ticker"]).groupBy("signal", "period", "i").agg(
        (F.avg(F.when(F.col("leg") == 1, F.col("r"))) - F.avg(F.when(F.col("leg") == -1, F.col("r")))).alias("d")
    )
    return rows.groupBy("signal", "period").agg(F.sum("d").alias("spread"))


def churn(members: DataFrame) -> DataFrame:
    """Signal, period, churn - mean over both legs of 1 - overlap / size against the period used before; the first is 1."""
    used = members.select("signal", "period").distinct().withColumn("before", F.lag("period").over(Window.partitionBy("signal").orderBy("period")))
    # a name is in a leg once a period, so the one before it in its series tells whether it was held
    held = F.lag("period").over(Window.partitionBy("signal", "ticker", "leg").orderBy("period"))
    now = members.select("signal", "period", "ticker", "leg", held.alias("held")).join(used, ["signal", "period"])
    legs = now.groupBy("signal", "period", "leg").agg((1 - F.count(F.when(F.col("held") == F.col("before"), 1)) / F.count(F.lit(1))).alias("c"))
    return legs.groupBy("signal", "period").agg(F.avg("c").alias("churn"))


def spread_quality(spreads: DataFrame, churned: DataFrame, rebal: int = 5) -> DataFrame:
    """Sharpe before and after costs of 5 and 15 bps (population deviation), annual return, turnover."""
    both = spreads.join(churned, ["signal", "period"])
    year = 252.0 / rebal

    def sharpe(bps: int) -> Column:
        net = F.col("spread") - 2 * F.col("churn") * (bps / 10000.0)
        sd = F.stddev_pop(net)
        return F.when(sd > 0, F.avg(net) / sd * F.sqrt(F.lit(year))).otherwise(F.lit(0.0))

    return both.groupBy("signal").agg(
        F.round(sharpe(0), 2).alias("sharpe_gross"), F.round(sharpe(5), 2).alias("sharpe_5"), F.round(sharpe(15), 2).alias("sharpe_15"),
        F.round(F.avg("spread") * year, 4).alias("annual"), F.round(F.avg("churn") * 2 * year, 1).alias("turnover"),
    )


def incumbent_correlation(signals: DataFrame, incumbent: DataFrame, names: list[str], every: int = 21, start: int = 300, least: int = 50) -> DataFrame:
    """Signal, corr with the incumbent (ticker, date, incumbent), mean over dates."""
    on = tall(signals.where((F.col("i") >= start) & ((F.col("i") - start) % every == 0)), names, []).join(incumbent, ["ticker", "date"])
    daily = on.where(F.col("score").isNotNull() & F.col("incumbent").isNotNull()).groupBy("signal", "date").agg(F.count(F.lit(1)).alias("n"), F.corr("score", "incumbent").alias("c"))
    return daily.where(F.col("n") >= least).groupBy("signal").agg(F.avg(F.when(~F.isnan("c"), F.col("c"))).alias("corr"))


def split_t_stats(ics: DataFrame, rows: int, least: int = 8) -> DataFrame:
    """T-statistics before and from row int(0.6 n)."""
    cut = int(0.6 * rows)
    parts = {"t_is": F.col("i") < cut, "t_oos": F.col("i") >= cut}
    return ics.groupBy("signal").agg(*(t_stat(F.when(c, F.col("ic")), least).alias(n) for n, c in parts.items()))


def verdict(t_is: str = "t_is", t_oos: str = "t_oos", sharpe: str = "sharpe_15", corr: str = "corr") -> Column:
    """PROMOTE on three tests, WATCH on two, else KILL."""
    strong = (F.abs(t_is) >= 3) & (F.abs(t_oos) >= 2.5) & (F.signum(t_is) == F.signum(t_oos))
    score = sum((F.when(c, 1).otherwise(0) for c in (strong, F.col(sharpe) >= 0.5, F.abs(corr) < 0.5)), F.lit(0))
    return F.when(score == 3, "PROMOTE").when(score == 2, "WATCH").otherwise("KILL")


def league_table(signals: DataFrame, daily: DataFrame, incumbent: DataFrame, names: list[str], rows: int, h: int, start: int, least: int, smallest: int) -> DataFrame:
    """All tests of all signals, best out-of-sample first."""
    members = stored(quintile_members(signals, names, 5, start, least, smallest))  # three tests read them
    quality = spread_quality(quintile_spread(members, daily, 5, start), churn(members))
    tests = split_t_stats(ic_series(signals, names, h, start, least), rows)
    every = signals.sparkSession.createDataFrame([(n,) for n in names], "signal string")  # a signal that can't be tested keeps its row
    joined = every.join(tests, "signal", "left").join(quality, "signal", "left").join(incumbent_correlation(signals, incumbent, names, 21, start, least), "signal", "left")
    return joined.withColumn("verdict", verdict()).orderBy(F.desc("t_oos"), "signal")
