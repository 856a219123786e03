"""Market regime: votes, the regime machine and what depends on it.

The machine is one pure fold (`step`), shared by the batch form here and the streaming form.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import ANNUAL, ratio, roll, trailing

ACTIVE, CAUTIOUS, CRISIS = "ACTIVE", "CAUTIOUS", "CRISIS"
#: Fixed values of the exposure ladder: regime, gross, net.
LADDER = [(ACTIVE, 1.0, 0.8), (CAUTIOUS, 0.6, 0.3), (CRISIS, 0.5, 0.0)]
#: Fixed vote weights of the eight-signal detector and its regimes from mild to severe.
EIGHT = {"vix": 0.25, "sma": 0.20, "vix_trend": 0.10, "breadth": 0.10, "drawdown": 0.10, "credit": 0.10, "spike": 0.10, "curve": 0.05}
SEVERITY = ("EUPHORIA", "CALM", "CAUTION", "STRESS", "CRISIS")


def sma(x: str, n: int, key: str = "market") -> Column:
    return roll(F.avg, F.col(x), n, key)


def trend_vote(n: int = 200, band: float = 0.02, key: str = "market") -> Column:
    """1, 0, -1; NULL when not available."""
    gap = ratio(F.col("m"), sma("m", n, key)) - 1
    return F.when(gap > band, 1).when(gap < -band, -1).when(gap.isNotNull(), 0)


def vol_vote(key: str = "market") -> Column:
    """R2."""
    v, rel = F.col("vix"), ratio(F.col("vix"), sma("vix", 21, key))
    return F.when(rel.isNull(), F.lit(None)).when((v >= 28) | (rel >= 1.15), -1).when((v <= 20) & (rel <= 1.05), 1).otherwise(0)


def credit_vote(key: str = "market") -> Column:
    """R3."""
    o = F.col("oas")
    step = o - F.lag("oas", 10).over(Window.partitionBy(key).orderBy("date"))
    return F.when(step.isNull(), F.lit(None)).when((o >= 5.5) | (step >= 0.75), -1).when((o <= 3.5) & (step <= 0), 1).otherwise(0)


def proxy_votes(key: str = "market", n: int = 200) -> dict[str, Column]:
    """From the price alone; credit is not available."""
    vol = roll(F.stddev_samp, F.col("rm"), 21, key) * F.sqrt(F.lit(ANNUAL))
    return {"trend": trend_vote(n, 0.02, key), "vol": F.when(vol < 0.15, 1).when(vol > 0.25, -1).when(vol.isNotNull(), 0), "credit": F.lit(None).cast("int")}


def step(state: tuple[str, int, int], votes: Iterable[int | None]) -> tuple[str, int, int, float]:
    """One day of the machine: (regime, bullish, bearish) and three votes -> the next state and its confidence."""
    regime, bull, bear = state
    trend, vol, credit = votes
    live = [v for v in (trend, vol, credit) if v is not None]
    on, off = live.count(1), live.count(-1)
    bull, bear = (bull + 1 if on >= 2 else 0), (bear + 1 if off >= 2 else 0)
    if len(live) >= 2:
        if trend == vol == 1 or (bull >= 2 and bear < 2):
            regime = ACTIVE
        elif bear >= 2:
            regime = CRISIS
        elif (off >= 2 and regime == ACTIVE) or (on >= 2 and regime == CRISIS):
            regime = CAUTIOUS
    return regime, bull, bear, round(max(on, off) / len(live), 3) if live else 0.0


def regime_path(votes: DataFrame, start: str = CAUTIOUS) -> DataFrame:
    """R5 over market, date, trend, vol, credit: a fold by market."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        state, rows = (start, 0, 0), []
        for day in pdf[["trend", "vol", "credit"]].itertuples(index=False):
            *state, confidence = step(tuple(state), [None if v is None or v != v else int(v) for v in day])
            rows.append((*state, confidence))
        out = pd.DataFrame(rows, columns=["regime", "bullish", "bearish", "confidence"], index=pdf.index)
        return pd.concat([pdf[["market", "date"]], out], axis=1)

    return votes.select("market", "date", "trend", "vol", "credit").groupBy("market").applyInPandas(
        fold, "market string, date date, regime string, bullish int, bearish int, confidence double"
    )


def transitions(path: DataFrame) -> DataFrame:
    """R6."""
    before = F.lag("regime").over(Window.partitionBy("market").orderBy("date"))
    return path.withColumn("before", before).where(F.col("before") != F.col("regime")).select("market", "date", "before", "regime")


def exposures(path: DataFrame, ladder: list[tuple[str, float, float]] | None = None) -> DataFrame:
    """Gross and net of each row's regime; unknown ones count as CAUTIOUS."""
    rows = path.sparkSession.createDataFrame(ladder or LADDER, "regime string, gross double, net double")
    known = path.join(F.broadcast(rows), "regime", "left")  # a handful of rows
    spare = dict((r, (g, n)) for r, g, n in ladder or LADDER)[CAUTIOUS]
    return known.withColumn("gross", F.coalesce("gross", F.lit(spare[0]))).withColumn("net", F.coalesce("net", F.lit(spare[1])))


def buffered_switch(prices: DataFrame, n: int = 200, band: float = 0.02, confirm: int = 3) -> DataFrame:
    """Market, date, side, mode.  Rows inside the band neither count nor reset."""
    gap = ratio(F.col("m"), sma("m", n)) - 1
    side = F.when(gap.isNull() | (gap > band), "ABOVE").when(gap < -band, "BELOW").otherwise("BUFFER")
    sided = prices.withColumn("side", side)
    w = Window.partitionBy("market").orderBy("date")
    firm = sided.where("side <> 'BUFFER'").withColumn("fresh", (F.lag("side").over(w) != F.col("side")).cast("int"))
    firm = firm.withColumn("island", F.sum(F.coalesce("fresh", F.lit(1))).over(w))
    firm = firm.withColumn("k", F.row_number().over(Window.partitionBy("market", "island").orderBy("date")))
    events = firm.where(F.col("k") == confirm).select("market", "date", F.when(F.col("side") == "ABOVE", ACTIVE).otherwise("SAFETY").alias("event"))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    joined = sided.join(events, ["market", "date"], "left")
    return joined.select("market", "date", "side", F.coalesce(F.last("event", ignorenulls=True).over(run), F.lit(ACTIVE)).alias("mode"))


def simple_regime(prices: DataFrame, spike: bool = False, n: int = 200) -> DataFrame:
    """CALM, TRANSITION or CRISIS; `spike` adds CRISIS on a jump of VIX over 40 % in 5 rows."""
    vix, mean = F.coalesce("vix", F.lit(20.0)), sma("m", n)
    label = F.when(mean.isNull(), "CALM").when((F.col("m") > mean) & (vix < 25), "CALM").when((F.col("m") < mean) & (vix > 35), "CRISIS").otherwise("TRANSITION")
    if spike:
        jump = ratio(vix, F.lag(vix, 5).over(Window.partitionBy("market").orderBy("date"))) - 1
        label = F.when(jump > 0.40, "CRISIS").otherwise(label)
    return prices.withColumn("label", label)


def eight_votes(prices: DataFrame, n: int = 200, short: int = 50, year: int = 252) -> DataFrame:
    """Market, date, label from the weighted vote of eight signals (m, vix, oas, curve, breadth); ties to the milder, overrides last.

    A vote is the place of a regime in SEVERITY; a signal that can't be told doesn't vote.
    """
    w = Window.partitionBy("market").orderBy("date")
    m, vix, long = F.col("m"), F.col("vix"), sma("m", n)
    euphoria, calm, caution, stress, crisis = range(5)
    mean, jump = sma("vix", 21), ratio(vix, F.lag("vix", 5).over(w)) - 1
    fall, five = ratio(m, roll(F.max, m, year, "market")) - 1, ratio(m, F.lag("m", 5).over(w)) - 1

    def steps(x: Column, *cuts: tuple[float, int], last: int) -> Column:
        """The vote of the first cut that x is below."""
        out = F.when(x.isNull(), F.lit(None).cast("int"))
        for cut, vote in cuts:
            out = out.when(x < cut, vote)
        return out.otherwise(last)

    grades = {
        "vix": steps(vix, (13, euphoria), (18, calm), (25, caution), (35, stress), last=crisis),
        "sma": F.when(long.isNull() | m.isNull(), F.lit(None).cast("int")).when((m > long) & (sma("m", short) > long), F.when(m > long * 1.10, euphoria).otherwise(calm)).when(m > long * 0.95, caution).otherwise(stress),
        "vix_trend": F.when(mean.isNull() | vix.isNull(), F.lit(None).cast("int")).when(vix < mean * 0.85, calm).when(vix > mean * 1.30, stress).when(vix > mean, caution).otherwise(calm),
        "breadth": steps(-F.col("breadth"), (-0.8 + 1e-12, calm), (-0.5 + 1e-12, caution), last=stress),
        "drawdown": steps(-fall, (0.05, calm), (0.10, caution), (0.20, stress), last=crisis),
        "credit": steps(F.col("oas"), (3.5, calm), (5.0, caution), (7.0, stress), last=crisis),
        "spike": F.when(jump.isNull(), F.lit(None).cast("int")).when(jump > 0.50, crisis).when(jump > 0.30, stress).otherwise(calm),
        "curve": F.when(F.col("curve").isNull(), F.lit(None).cast("int")).when(F.col("curve") > 1.0, calm).when(F.col("curve") > 0, caution).otherwise(stress),
    }
    graded = prices.select("market", "date", vix.alias("level"), five.alias("five"), *(g.alias(k) for k, g in grades.items()))
    weigh = [F.round(sum((F.when(F.col(k) == v, w_).otherwise(0.0) for k, w_ in EIGHT.items()), F.lit(0.0)), 6) for v in range(5)]
    graded = graded.withColumn("mass", F.array(*weigh))
    winner = F.array_position("mass", F.array_max("mass")).cast("int") - 1
    floor = F.when((F.col("five") < -0.10) | (F.col("level") > 40), crisis).when(F.col("five") < -0.05, stress).otherwise(euphoria)
    return graded.select("market", "date", F.element_at(F.array(*map(F.lit, SEVERITY)), F.greatest(winner, floor) + 1).alias("label"))


def confirmed(labels: DataFrame) -> DataFrame:
    """To CRISIS at once, to worse after 5 days since the last change, to better after 10."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        held, since, rows = None, None, []
        for date, label in zip(pdf["date"], pdf["label"], strict=True):
            if held is None:
                held, since = label, date
            elif label != held:
                worse = SEVERITY.index(label) > SEVERITY.index(held)
                if label == CRISIS or (date - since).days >= (5 if worse else 10):
                    held, since = label, date
            rows.append(held)
        return pdf[["market", "date"]].assign(held=rows)

    return labels.groupBy("market").applyInPandas(fold, "market string, date date, held string")


def detector_health(rows: DataFrame, last: int = 8, worst: int = 3) -> DataFrame:
    """Wrong calls among the last eight records and the boost that follows; rows: market, date, label, ret."""
    calm, stress = F.col("label").isin("EUPHORIA", "CALM"), F.col("label").isin("STRESS", "CRISIS")
    wrong = F.when((calm & (F.col("ret") < -0.03)) | (stress & (F.col("ret") > 0.03)), 1).otherwise(0)
    counted = rows.withColumn("wrong", F.sum(wrong).over(trailing(last, "market")))
    return counted.withColumn("boost", F.when(F.col("wrong") >= worst, 0.15).otherwise(0.0))


def occupancy(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Share of days and Sharpe ratio by regime (and `keys`); rows: regime, ret."""
    total = F.sum(F.count(F.lit(1))).over(Window.partitionBy(*keys))
    sd = F.stddev_samp("ret")
    return rows.groupBy(*keys, "regime").agg(
        (F.count(F.lit(1)) / total).alias("share"), F.when((F.count("ret") >= 20) & (sd > 0), F.avg("ret") / sd * F.sqrt(F.lit(ANNUAL))).alias("sharpe")
    )


def walk_occupancy(net: DataFrame, path: DataFrame, calendar: DataFrame) -> DataFrame:
    """R13 of a walk-forward, by configuration: what is decided at the close of row i goes with the return of row i + 1.

    net: config, i, ret (W4); path: date, regime; calendar: date, i.
    """
    decided = path.join(calendar.select("date", "i"), "date").select("regime", (F.col("i") + 1).alias("i"))
    return occupancy(net.join(decided, "i"), ("config",))
