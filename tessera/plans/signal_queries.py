"""Queries S1-S13, A1-A18 and U1 with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql as S
from tessera.functions.windows import out
from tessera.operators import features as FE
from tessera.operators import signals as O
from tessera.sources import tables as T

from .base import Book
from .feature_queries import wilder

book = Book()
AVG = lambda n, x="px": f"({S.roll('avg', x, n)})"
SD = lambda n, x="r": f"({S.roll('stddev_samp', x, n)})"
NULLIF = lambda a, b: f"({a}) / nullif({b}, 0)"
#: Weights of the five production signals; a fixed equal start.
WEIGHTS = dict.fromkeys(O.SIGNALS, 0.2)



def raw_sql(base: str, k: O.Looks = O.Looks(), history: int = 252) -> str:
    """The five signals over a panel, filled or not."""
    return (
        base
        + f""", raw AS (SELECT ticker, date, i, pf, {NULLIF(S.lag("px", k.skip), S.lag("px", k.skip + k.half))} - 1 AS mom, {S.change("px", k.week)} AS r5,
      {NULLIF(f"px - {AVG(k.band)}", SD(k.band, "px"))} AS dev, 0.6 * ({NULLIF("px", AVG(k.short))} - 1) + 0.4 * ({NULLIF(AVG(k.short), AVG(k.long))} - 1) AS trend,
      {NULLIF(S.change("px", k.quarter), f"{SD(k.quarter)} * sqrt(252)")} AS vam, -{SD(k.half)} * sqrt(252) AS calm,
      count(px) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) >= {history} AS enough FROM panel),
    scored AS (SELECT ticker, date, i, pf, enough, {S.zscore("mom")} AS xs_momentum, {S.clip(f"-(0.5 * ({S.zscore('r5')}) + 0.5 * ({S.zscore('dev')}))", -3, 3)} AS mean_reversion,
      {S.zscore("trend")} AS trend_follow, {S.zscore("vam")} AS vol_adj_momentum, {S.zscore("calm")} AS low_vol FROM raw),
    signals AS (SELECT ticker, date, i, pf, {", ".join(f"CASE WHEN enough THEN {s} END AS {s}" for s in O.SIGNALS)} FROM scored)"""
    )


RAW = raw_sql(S.FILLED)
LIVE = " + ".join(f"({s} IS NOT NULL)::INT" for s in O.SIGNALS)
COMPOSITE = f"CASE WHEN {LIVE} >= 3 THEN ({' + '.join(f'0.2 * coalesce({s}, 0)' for s in O.SIGNALS)}) / (0.2 * ({LIVE})) END"


def _one(name: str):
    return lambda spark, d: O.production_signals(T.filled_panel(spark, d)).select("ticker", "date", out(F.col(name)).alias(name))


for k, s in enumerate(O.SIGNALS, 1):
    book.add(f"s{k}_{s}", _one(s), RAW + f"SELECT ticker, date, {S.out(s)} AS {s} FROM signals")
book.add(
    "s6_history_mask",
    lambda spark, d: O.production_signals(T.filled_panel(spark, d)).groupBy("date").agg(*(F.count(s).alias(s) for s in O.SIGNALS)),
    RAW + f"SELECT date, {', '.join(f'count({s}) AS {s}' for s in O.SIGNALS)} FROM signals GROUP BY date",
)
book.add(
    "s7_composite",
    lambda spark, d: O.combine(O.production_signals(T.filled_panel(spark, d)), WEIGHTS).select("ticker", "date", out(F.col("composite")).alias("composite")),
    RAW + f"SELECT ticker, date, {S.out(COMPOSITE)} AS composite FROM signals",
)
#: Over the unfilled panel, where about a fifth of the cells are gaps: look-backs short enough for whole windows.
GAP_LOOKS, GAP_HISTORY = O.Looks(week=1, band=4, skip=2, short=3, quarter=4, half=5, long=6), 60
book.add(
    "s7_gaps",
    lambda spark, d: O.combine(O.production_signals(T.panel(spark, d), GAP_HISTORY, looks=GAP_LOOKS), WEIGHTS).select("ticker", "date", *(out(F.col(c)).alias(c) for c in (*O.SIGNALS, "composite"))),
    raw_sql(S.PANEL, GAP_LOOKS, GAP_HISTORY) + f"SELECT ticker, date, {', '.join(f'{S.out(c)} AS {c}' for c in O.SIGNALS)}, {S.out(COMPOSITE)} AS composite FROM signals",
)
LEGACY = "CASE WHEN count(raw) OVER w < 3 OR coalesce(stddev_samp(raw) OVER w, 0) = 0 THEN 0.0 ELSE (raw - avg(raw) OVER w) / nullif(stddev_samp(raw) OVER w, 0) END"
book.add(
    "s8_legacy_momentum",
    lambda spark, d: O.legacy_momentum(T.filled_panel(spark, d)).select("ticker", "date", out(F.col("score")).alias("score")),
    S.FILLED + f", x AS (SELECT *, {S.change('pf', 126)} - {S.change('pf', 21)} AS raw FROM panel) SELECT ticker, date, {S.out(LEGACY)} AS score FROM x WHERE i >= 136 WINDOW w AS (PARTITION BY date)",
)


def _mean_reversion(spark, d):
    own, panel = T.own_series(spark, d), T.filled_panel(spark, d)
    fear = T.macro(spark, d).where("series_id = '3-MEDIUM'").select("date", (F.col("value") / 10000).alias("value"))
    dates = panel.select("date").distinct()
    from tessera.operators.joins import asof

    return O.legacy_mean_reversion(panel, FE.recursive_features(own).select("ticker", "date", "rsi"), asof(dates, fear, "date", ["value"])).select("ticker", "date", out(F.col("score"), 4).alias("score"))


book.add(
    "s9_legacy_mean_reversion",
    _mean_reversion,
    S.FILLED
    + S.MACRO
    + f""", moves AS (SELECT *, greatest(coalesce(px - lag(px) OVER (PARTITION BY ticker ORDER BY n), 0), 0) AS up, greatest(coalesce(lag(px) OVER (PARTITION BY ticker ORDER BY n) - px, 0), 0) AS down FROM own),
    smooth AS (SELECT *, {wilder("up")} AS g, {wilder("down")} AS l FROM moves),
    rsi AS (SELECT ticker, date, CASE WHEN l = 0 AND g > 0 THEN 100 WHEN l > 0 THEN 100 - 100 / (1 + g / l) END AS rsi FROM smooth),
    fear AS (SELECT c.date, m.value / 10000 AS value FROM cal c ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = '3-MEDIUM') m ON c.date >= m.date),
    b AS (SELECT ticker, date, i, {NULLIF(f"px - ({AVG(20)} - 2 * {SD(20, 'px')})", f"4 * {SD(20, 'px')}")} AS bb, {NULLIF("px", f"({S.roll('max', 'px', 252)})")} - 1 AS dd FROM panel),
    p AS (SELECT b.*, value, (CASE WHEN rsi IS NULL THEN NULL WHEN rsi < 30 THEN (30 - rsi) / 30 WHEN rsi > 70 THEN -(rsi - 70) / 30 ELSE 0 END + {S.clip("0.5 - bb", -1, 1)} + {S.clip("-2 * dd", 0, 1.5)}) / 3 AS part
      FROM b LEFT JOIN rsi USING (ticker, date) LEFT JOIN fear USING (date)),
    x AS (SELECT *, CASE WHEN value > 35 AND part > 0 THEN 0.0 ELSE part END AS raw FROM p)
    SELECT ticker, date, {S.out(LEGACY, 4)} AS score FROM x WHERE i >= 252 WINDOW w AS (PARTITION BY date)""",
)
book.add(
    "s10_tsmom",
    lambda spark, d: O.tsmom(T.filled_panel(spark, d)).select("ticker", "date", out(F.col("tsmom")).alias("tsmom")),
    S.FILLED + f"SELECT ticker, date, {S.out(f'CASE WHEN count(px) OVER {S.frame(253)} = 253 THEN (sign({S.change("px", 63)}) + sign({S.change("px", 126)}) + sign({S.change("px", 252)})) / 3.0 END')} AS tsmom FROM panel",
)
book.add(
    "s10_gaps",
    lambda spark, d: O.tsmom(T.panel(spark, d), (2, 4, 6)).select("ticker", "date", out(F.col("tsmom")).alias("tsmom")),
    S.PANEL + f"SELECT ticker, date, {S.out(f'CASE WHEN count(px) OVER {S.frame(7)} = 7 THEN (sign({S.change("px", 2)}) + sign({S.change("px", 4)}) + sign({S.change("px", 6)})) / 3.0 END')} AS tsmom FROM panel",
)
book.add(
    "s11_blended_momentum",
    lambda spark, d: T.own_series(spark, d).select("ticker", "date", out(O.blended_momentum()).alias("score")),
    S.BARS + "SELECT ticker, date, " + S.out(" + ".join(f"{w} * ({NULLIF(S.lag('px', 21), S.lag('px', k))} - 1)" for w, k in ((0.4, 83), (0.35, 146), (0.25, 272)))) + " AS score FROM own",
)
book.add(
    "s12_crisis_momentum",
    lambda spark, d: T.own_series(spark, d).select("ticker", "date", out(O.crisis_momentum()).alias("short"), out(O.crisis_momentum(True)).alias("longer")),
    S.BARS
    + f"SELECT ticker, date, {S.out(f'0.6 * {S.change("px", 20)} + 0.4 * {S.change("px", 62)}')} AS short, {S.out(f'0.5 * {S.change("px", 20)} + 0.3 * {S.change("px", 62)} + 0.2 * {S.change("px", 125)}')} AS longer FROM own",
)
PCT = lambda x: f"({S.average_rank(x)}) / nullif(count({x}) OVER (PARTITION BY date), 0)"
book.add(
    "s13_composite_alpha",
    lambda spark, d: O.composite_alpha(T.filled_panel(spark, d)).select("ticker", "date", out(F.col("alpha")).alias("alpha")),
    S.FILLED
    + f""", x AS (SELECT ticker, date, {S.change("px", 126)} AS half, {S.change("px", 63)} AS quarter, {S.change("px", 21)} + {S.change("px", 63)} + {S.change("px", 126)} AS total, {S.change("px", 5)} AS week, {SD(20)} AS vol,
      CASE WHEN count(px) OVER (PARTITION BY ticker) >= 200 THEN 0.3::DOUBLE * coalesce((px > {AVG(50)})::INT, 0) + 0.4 * coalesce((px > {AVG(200)})::INT, 0) + 0.3 * coalesce(({AVG(50)} > {AVG(200)})::INT, 0) ELSE 0.5 END AS trend FROM panel)
    SELECT ticker, date, {S.out(f"(0.35 * (0.35 * {PCT('half')} + 0.35 * {PCT('quarter')} + 0.30 * {PCT('total')}) + 0.25 * trend + 0.25 * (0.5 + ({PCT('week')} - 0.5) * 0.5) + 0.15 * coalesce(1 - {PCT('vol')}, 0.5) - 0.5) * 2")} AS alpha FROM x""",
)

# ---- candidates ----------------------------------------------------------------------------

PAIR = "CASE WHEN r IS NOT NULL AND rm IS NOT NULL THEN 1 END"
DAY = (
    S.FILLED
    + S.MARKET
    + f""", joined AS (SELECT panel.*, rm FROM panel LEFT JOIN market USING (date)),
    day0 AS (SELECT *, {S.clip(f"{NULLIF('open', S.lag('close', 1))} - 1", -0.2, 0.2)} AS gap, {S.clip("close / nullif(open, 0) - 1", -0.2, 0.2)} AS within,
      {S.clip("(close - low) / nullif(high - low, 0)", 0, 1)} AS place, abs(r) / nullif(px * volume, 0) AS impact, {PAIR} AS pair,
      CASE WHEN r < 0 THEN r ELSE 0 END AS fall FROM joined),
    day AS (SELECT *, r - CASE WHEN count(pair) OVER {S.frame(126)} = 126 THEN covar_samp(r, rm) OVER {S.frame(126)} / nullif(var_samp(rm) OVER {S.frame(126)}, 0) END * rm AS resid FROM day0)"""
)
A_SQL = {
    "rev_5d": f"-{S.change('pf', 5)}",
    "rev_21d": f"-{S.change('pf', 21)}",
    "mom_12_1": f"{NULLIF(S.lag('px', 21), S.lag('px', 252))} - 1",
    "mom_3m": S.change("pf", 63),
    "hi_52wk": NULLIF("px", f"({S.roll('max', 'px', 252)})"),
    "idio_vol": f"-{SD(126, 'resid')} * sqrt(252)",
    "anti_lottery": f"CASE WHEN count(r) OVER {S.frame(21)} = 21 THEN -list_sum(list_reverse_sort(list(r) OVER {S.frame(21)})[1:5]) / 5 END",
    "anti_skew": f"-({S.roll('skewness', 'r', 63)})",
    "anti_beta": f"CASE WHEN count(pair) OVER {S.frame(252)} = 252 THEN -covar_samp(r, rm) OVER {S.frame(252)} / nullif(var_samp(rm) OVER {S.frame(252)}, 0) END",
    "amihud": f"CASE WHEN ({S.roll('avg', 'impact', 21)}) > 0 THEN ln({S.roll('avg', 'impact', 21)}) END",
    "low_attention": f"-{NULLIF(AVG(21, 'volume'), AVG(126, 'volume'))}",
    "smooth_momentum": f"""CASE WHEN count(*) OVER {S.frame(63)} = 63 THEN CASE WHEN {S.change("pf", 63)} > 0 THEN avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) OVER {S.frame(63)}
      ELSE 1 - avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) OVER {S.frame(63)} END END""",
    "overnight_fade": f"-({S.roll('sum', 'gap', 21)})",
    "intraday": S.roll("sum", "within", 21),
    "range_strength": S.roll("avg", "place", 10),
    "downside_vol": f"-{SD(126, 'fall')} * sqrt(252)",
    "calm_momentum": f"({NULLIF(S.lag('px', 21), S.lag('px', 147))} - 1) / CASE WHEN {SD(63)} IS NOT NULL THEN greatest({SD(63)} * sqrt(252), 0.10) END",
}


def candidate_panel(spark, d):
    return T.filled_panel(spark, d).join(T.market(spark, d), "date", "left")


def _candidate(name):
    return lambda spark, d: O.candidates(candidate_panel(spark, d), [name]).select("ticker", "date", out(F.col(name)).alias(name))


for k, (name, raw) in enumerate(A_SQL.items(), 1):
    book.add(f"a{k}_{name}", _candidate(name), DAY + f", x AS (SELECT ticker, date, {raw} AS raw FROM day) SELECT ticker, date, {S.out(S.zscore('raw'))} AS {name} FROM x")
book.add(
    "a18_registry",
    lambda spark, d: O.candidates(candidate_panel(spark, d)).groupBy("date").agg(*(F.count(n).alias(n) for n in A_SQL)),
    DAY + f", x AS (SELECT ticker, date, {', '.join(f'{e} AS {n}' for n, e in A_SQL.items())} FROM day), z AS (SELECT date, {', '.join(f'{S.zscore(n)} AS {n}' for n in A_SQL)} FROM x)"
    + f" SELECT date, {', '.join(f'count({n}) AS {n}' for n in A_SQL)} FROM z GROUP BY date",
)
book.add(
    "a18_gaps",
    lambda spark, d: O.candidates(T.panel(spark, d).join(T.market(spark, d), "date", "left")).select("ticker", "date", *(out(F.col(n)).alias(n) for n in A_SQL)),
    DAY.replace(S.FILLED, S.PANEL) + f", x AS (SELECT ticker, date, {', '.join(f'{e} AS {n}' for n, e in A_SQL.items())} FROM day) SELECT ticker, date, {', '.join(f'{S.out(S.zscore(n))} AS {n}' for n in A_SQL)} FROM x",
)
book.add(
    "u1_user_rolling",
    # cut every 100 rows, so that a series of 357 weeks runs in four pieces
    lambda spark, d: O.user_rolling(T.filled_panel(spark, d), "r", 10, lambda w: w.max(axis=1) - w.min(axis=1), "spread", split=100).select("ticker", "date", out(F.col("spread")).alias("spread")),
    S.FILLED + f"SELECT ticker, date, {S.out(f'({S.roll("max", "r", 10)}) - ({S.roll("min", "r", 10)})')} AS spread FROM panel",
)
