"""Production signals (S1-S13), research candidates (A1-A17) and their registry.

Panel signals read the dense panel (ticker, date, i, px, pf, volume, open, high, low, close, r)
and, for the market-relative ones, rm.  A candidate is a function panel -> panel plus a raw
column named like it; all candidates share one pass over the ticker partitioning, and one
pass of z-scores by date follows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.sections import percentile_ranks
from tessera.functions.sliding import Roll, avg, beta, high, residual, sd, skew, sliding, total, user
from tessera.functions.windows import ANNUAL, change, clip, lag, last_values, ratio, series, zscore
from tessera.operators.features import bands, legacy_zscore

SIGNALS = ("xs_momentum", "mean_reversion", "trend_follow", "vol_adj_momentum", "low_vol")
YEAR = ANNUAL


class Looks(NamedTuple):
    """Look-backs of the production signals in rows."""

    week: int = 5
    band: int = 20
    skip: int = 21
    short: int = 50
    quarter: int = 63
    half: int = 126
    long: int = 200


def production_signals(
    panel: DataFrame, history: int = 252, on: Column | None = None, keep: tuple[str, ...] = (), looks: Looks = Looks(), rolls: dict[str, Roll] | None = None
) -> DataFrame:
    """Ticker, date, the columns `keep`, the five signals and the figures `rolls`, on the rows `on` (default all); names with less than
    `history` prices are set NULL after scoring.

    On a panel with gaps a shifted price or an average over a gap is NULL, and the gap is no history.
    """
    p, k, rolls = F.col("_p"), looks, rolls or {}
    on = F.lit(True) if on is None else on
    needed = sorted({c for r in rolls.values() for c in (r.x, r.y) if c and c not in rolls} - {"ticker", "date", *keep})
    moved = panel.select(
        "ticker", "date", *keep, *needed, on.alias("_on"), F.col("px").alias("_p"), F.col("r").alias("_r"),
        (ratio(lag("px", k.skip), lag("px", k.skip + k.half)) - 1).alias("mom"), change("px", k.week).alias("r5"), change("px", k.quarter).alias("_q"),
        (F.count("px").over(series().rowsBetween(Window.unboundedPreceding, 0)) >= history).alias("enough"),
    )
    figures = {
        "_band": avg("_p", k.band), "_width": sd("_p", k.band), "_short": avg("_p", k.short), "_long": avg("_p", k.long),
        "_sd_quarter": sd("_r", k.quarter), "_sd_half": sd("_r", k.half),
    }
    rolled = sliding(moved, figures | rolls).where("_on")
    raw = rolled.select(
        "ticker", "date", *keep, *rolls, "mom", "r5", "enough", ratio(p - F.col("_band"), F.col("_width")).alias("dev"),
        (0.6 * (ratio(p, F.col("_short")) - 1) + 0.4 * (ratio(F.col("_short"), F.col("_long")) - 1)).alias("trend"),
        ratio(F.col("_q"), F.col("_sd_quarter") * F.sqrt(F.lit(YEAR))).alias("vam"), (-F.col("_sd_half") * F.sqrt(F.lit(YEAR))).alias("calm"),
    )
    scores = {
        "xs_momentum": zscore("mom"),
        "mean_reversion": clip(-(0.5 * zscore("r5") + 0.5 * zscore("dev")), -3, 3),
        "trend_follow": zscore("trend"),
        "vol_adj_momentum": zscore("vam"),
        "low_vol": zscore("calm"),
    }
    scored = raw.select("ticker", "date", *keep, *rolls, "enough", *(c.alias(n) for n, c in scores.items()))
    return scored.select("ticker", "date", *keep, *rolls, *(F.when(F.col("enough"), F.col(n)).alias(n) for n in SIGNALS))


def combine(signals: DataFrame, weights: dict[str, float], least: int = 3) -> DataFrame:
    """Weighted mean over the signals that are there; NULL below `least` of them."""
    live = reduce(lambda a, b: a + b, (F.col(s).isNotNull().cast("int") for s in weights))
    total = reduce(lambda a, b: a + b, (F.when(F.col(s).isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for s, w in weights.items()))
    score = reduce(lambda a, b: a + b, (F.coalesce(F.col(s), F.lit(0.0)) * w for s, w in weights.items()))
    return signals.withColumn("composite", F.when((live >= least) & (total > 0), score / total))


def legacy_momentum(panel: DataFrame, drop: int = 136) -> DataFrame:
    """S8."""
    raw = panel.withColumn("raw", change("pf", 126) - change("pf", 21))
    return raw.withColumn("score", legacy_zscore(F.col("raw"))).where(F.col("i") >= drop)


def legacy_mean_reversion(panel: DataFrame, rsi: DataFrame, fear: DataFrame, drop: int = 252, high: float = 35.0) -> DataFrame:
    """S9.  `rsi`: ticker, date, rsi; `fear`: date, value (as-of joined by the caller)."""
    p = F.col("px")
    rolled = sliding(panel, {"_m": avg("px", 20), "_s": sd("px", 20), "_h": Roll("max", "px", 252)})
    base = rolled.withColumn("bb", bands(p, F.col("_m"), F.col("_s"))).withColumn("dd", ratio(p, F.col("_h")) - 1).drop("_m", "_s", "_h").join(rsi, ["ticker", "date"], "left").join(fear, "date", "left")
    r = F.col("rsi")
    by_rsi = F.when(r.isNull(), None).when(r < 30, (30 - r) / 30).when(r > 70, -(r - 70) / 30).otherwise(F.lit(0.0))
    raw = (by_rsi + clip(0.5 - F.col("bb"), -1, 1) + clip(-2 * F.col("dd"), 0, 1.5)) / 3
    base = base.withColumn("raw", F.when((F.col("value") > high) & (raw > 0), F.lit(0.0)).otherwise(raw))
    return base.withColumn("score", legacy_zscore(F.col("raw"))).where(F.col("i") >= drop)


def tsmom(panel: DataFrame, looks: tuple[int, int, int] = (63, 126, 252)) -> DataFrame:
    """Mean sign of three returns; NULL unless the rows of the longest are all there (253 by default)."""
    n = max(looks) + 1
    panel = panel.withColumn("_held", F.count("px").over(series().rowsBetween(Window.unboundedPreceding, 0)))
    whole = F.col("_held") - F.coalesce(lag("_held", n), F.lit(0)) == n
    one, two, three = (F.signum(change("px", k)) for k in looks)
    mean = (one + two + three) / 3
    return panel.withColumn("tsmom", F.when(whole, mean)).drop("_held")


def blended_momentum() -> Column:
    """Own series; skips 21 rows, lags 62, 125 and 251 rows further back."""
    p = lambda k: lag("px", k)
    return 0.40 * (ratio(p(21), p(83)) - 1) + 0.35 * (ratio(p(21), p(146)) - 1) + 0.25 * (ratio(p(21), p(272)) - 1)


def crisis_momentum(longer: bool = False) -> Column:
    """0.6 one month + 0.4 three months; the longer form 0.5 / 0.3 / 0.2 with six months."""
    r = lambda k: change("px", k)
    return 0.5 * r(20) + 0.3 * r(62) + 0.2 * r(125) if longer else 0.6 * r(20) + 0.4 * r(62)


RANKED = ("half", "quarter", "sum", "week", "vol")


def composite_alpha(panel: DataFrame, short: int = 50, long: int = 200) -> DataFrame:
    """0.35 momentum + 0.25 trend + 0.25 sentiment + 0.15 macro, from [0, 1] to [-1, 1].

    Momentum is a mean of the percentile ranks of the half-year, the quarter and the sum with the month; trend
    adds three flags of the averages (0.5 for a name with fewer than `long` prices); sentiment is half the
    rank of the week around 0.5; macro is 1 - the rank of 20-day volatility (0.5 while there is none).
    """
    p, near, far = F.col("_p"), F.col("_near"), F.col("_far")
    moved = panel.select(
        "ticker", "date", F.col("px").alias("_p"), F.col("r").alias("_r"), change("px", 126).alias("half"), change("px", 63).alias("quarter"),
        (change("px", 21) + change("px", 63) + change("px", 126)).alias("sum"), change("px", 5).alias("week"),
        (F.count("px").over(Window.partitionBy("ticker")) >= long).alias("_whole"),
    )
    rolled = sliding(moved, {"_near": avg("_p", short), "_far": avg("_p", long), "vol": sd("_r", 20)})
    flag = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    flags = 0.3 * flag(p > near) + 0.4 * flag(p > far) + 0.3 * flag(near > far)
    raw = rolled.withColumn("trend", F.when(F.col("_whole"), flags).otherwise(F.lit(0.5)))
    ranked = percentile_ranks(raw.select("ticker", "date", "trend", *RANKED), list(RANKED))
    momentum = 0.35 * F.col("half") + 0.35 * F.col("quarter") + 0.30 * F.col("sum")
    sentiment = 0.5 + (F.col("week") - 0.5) * 0.5
    total = 0.35 * momentum + 0.25 * F.col("trend") + 0.25 * sentiment + 0.15 * F.coalesce(1 - F.col("vol"), F.lit(0.5))
    return ranked.withColumn("alpha", (total - 0.5) * 2)


# ---- candidates ----------------------------------------------------------------------------

class Candidate(NamedTuple):
    """A raw signal; higher is more attractive.

    before: columns over the rows of a name (shifts); rolls: sliding figures of the panel and of those; column: the
    signal from all of them.  Equal names in `before` or `rolls` mean the same and are taken once for all candidates.
    """

    column: Callable[[], Column]
    rolls: dict[str, Roll] = {}
    before: dict[str, Callable[[], Column]] = {}


CANDIDATES: dict[str, Candidate] = {}


def candidate(name: str, column: Callable[[], Column], rolls: dict[str, Roll] | None = None, **before: Callable[[], Column]) -> None:
    """Register a raw signal."""
    CANDIDATES[name] = Candidate(column, rolls or {}, before)


def top_mean(values: Column, k: int) -> Column:
    """Mean of the k largest of an array; NULL if a value is missing."""
    best = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.when(~F.exists(values, lambda v: v.isNull()), F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / k)


def _col(name: str) -> Callable[[], Column]:
    return lambda: F.col(name)


candidate("rev_5d", _col("_rev5"), _rev5=lambda: -change("pf", 5))
candidate("rev_21d", _col("_rev21"), _rev21=lambda: -change("pf", 21))
candidate("mom_12_1", _col("_m12"), _m12=lambda: ratio(lag("px", 21), lag("px", 252)) - 1)
candidate("mom_3m", _col("_c63"), _c63=lambda: change("pf", 63))
candidate("hi_52wk", lambda: ratio(F.col("px"), F.col("_high")), {"_high": high("px", 252)})
# Deviation of what a rolling beta leaves
candidate("idio_vol", lambda: -F.col("_idio") * F.sqrt(F.lit(YEAR)), {"_left": residual("r", "rm", 126), "_idio": sd("_left", 126)})
# Minus the mean of the five largest of 21 returns
candidate("anti_lottery", lambda: -F.col("_best"), _best=lambda: top_mean(last_values(F.col("r"), 21), 5))
candidate("anti_skew", lambda: -F.col("_skew") * ((63 * 62) ** 0.5 / 61), {"_skew": skew("r", 63)})
candidate("anti_beta", lambda: -F.col("_beta"), {"_beta": beta("r", "rm", 252)})
# A10: log of mean price impact; zeros are missing
candidate("amihud", lambda: F.ln(F.when(F.col("_impact21") > 0, F.col("_impact21"))), {"_impact21": avg("_impact", 21)}, _impact=lambda: ratio(F.abs("r"), F.col("px") * F.col("volume")))
candidate("low_attention", lambda: -ratio(F.col("_v21"), F.col("_v126")), {"_v21": avg("volume", 21), "_v126": avg("volume", 126)})
# Share of up days in the direction of the quarter
candidate(
    "smooth_momentum", lambda: F.when(F.col("_c63") > 0, F.col("_up63")).otherwise(1 - F.col("_up63")), {"_up63": avg("_up", 63)},
    _c63=lambda: change("pf", 63), _up=lambda: F.when(F.col("r") > 0, 1.0).otherwise(0.0),
)
candidate("overnight_fade", lambda: -F.col("_gap21"), {"_gap21": total("_gap", 21)}, _gap=lambda: clip(ratio(F.col("open"), lag("close", 1)) - 1, -0.2, 0.2))
candidate("intraday", _col("_within21"), {"_within21": total("_within", 21)}, _within=lambda: clip(ratio(F.col("close"), F.col("open")) - 1, -0.2, 0.2))
candidate("range_strength", _col("_place10"), {"_place10": avg("_place", 10)}, _place=lambda: clip(ratio(F.col("close") - F.col("low"), F.col("high") - F.col("low")), 0, 1))
candidate("downside_vol", lambda: -F.col("_fall126") * F.sqrt(F.lit(YEAR)), {"_fall126": sd("_fall", 126)}, _fall=lambda: F.coalesce(F.when(F.col("r") < 0, F.col("r")), F.lit(0.0)))
candidate(
    "calm_momentum", lambda: ratio(F.col("_half"), F.when(F.col("_sd63").isNotNull(), F.greatest(F.col("_sd63") * F.sqrt(F.lit(YEAR)), F.lit(0.10)))), {"_sd63": sd("r", 63)},
    _half=lambda: ratio(lag("px", 21), lag("px", 147)) - 1,
)


def candidates(panel: DataFrame, names: list[str] | None = None, on: Column | None = None, keep: tuple[str, ...] = ("i", "pf")) -> DataFrame:
    """Ticker, date, the columns `keep` and the z-score of each candidate, on the rows `on` (default all).

    `panel` carries rm.  One pass of shifts, one of sliding figures; z-scores are taken on the rows that count.
    """
    chosen = {n: CANDIDATES[n] for n in names or CANDIDATES}
    before = {k: column for c in chosen.values() for k, column in c.before.items()}
    rolls = {k: r for c in chosen.values() for k, r in c.rolls.items()}
    rows = panel.withColumn("_on", F.lit(True) if on is None else on).select("*", *(column().alias(k) for k, column in before.items()))
    inputs = {c for r in rolls.values() for c in (r.x, r.y) if c and c not in rolls}
    rows = rows.select("ticker", "date", "_on", *{*keep, *before, *inputs, "px", "r"} - {"ticker", "date"})
    rows = (sliding(rows, rolls) if rolls else rows).where("_on")
    raw = rows.select("ticker", "date", *keep, *(c.column().alias(n) for n, c in chosen.items()))
    return raw.select("ticker", "date", *keep, *(zscore(n).alias(n) for n in chosen))


def user_rolling(panel: DataFrame, x: str, n: int, fn: Callable[[np.ndarray], np.ndarray], name: str, split: int | None = None) -> DataFrame:
    """Any Python function of the last n values; NULL unless all n are there.

    fn gets an array [rows, n], a row a window with the newest value last, and returns a value a row.  Windows are views of
    the streamed series; with `split` a long series is cut for several tasks.
    """
    return sliding(panel, {name: user(x, n, fn)}, split=split)
