"""Queries M1-M18 and W1-W8 with their SQL; a ticker's filled weekly series stands for a strategy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql as S
from tessera.functions.sliding import sd, sliding
from tessera.functions.windows import ANNUAL, change, out, zscore
from tessera.operators import league as L
from tessera.operators import metrics as O
from tessera.operators import portfolio as PF
from tessera.operators import regime as RG
from tessera.operators import signals as SG
from tessera.operators import walkforward as WK
from tessera.sources import tables as T
from tessera.sources.tables import stored

from .base import Book
from .league_queries import IC21, IC63
from .portfolio_queries import CAPPED, GROSS, LEGS, SCORED
from .regime_queries import roll as MROLL
from .signal_queries import RAW

book = Book()


def daily(s, d):
    return T.filled_panel(s, d).where("r is not null").select(F.col("ticker").alias("strategy_id"), "date", "i", F.col("r").alias("ret"))


def values(s, d):
    return T.filled_panel(s, d).where("px is not null").select(F.col("ticker").alias("strategy_id"), "date", F.col("px").alias("value"))


B = S.FILLED + S.MARKET + """, daily AS (SELECT ticker AS strategy_id, date, i, r AS ret FROM panel WHERE r IS NOT NULL),
    vals AS (SELECT ticker AS strategy_id, date, px AS value FROM panel WHERE px IS NOT NULL)"""
RUN = "(PARTITION BY strategy_id ORDER BY date ROWS UNBOUNDED PRECEDING)"
W = "(PARTITION BY strategy_id ORDER BY date)"
EQ = B + f", eq AS (SELECT *, product(1 + ret) OVER {RUN} AS equity FROM daily), dds AS (SELECT *, equity / max(equity) OVER {RUN} - 1 AS dd FROM eq)"
SHARPE = lambda r: f"CASE WHEN count({r}) >= 20 AND stddev_samp({r}) > 0 THEN avg({r}) / stddev_samp({r}) * sqrt(252) END"


def pick(df, *columns, digits=6, keys=("strategy_id",)):
    return df.select(*keys, *(out(F.col(c), digits).alias(c) for c in columns))


def cols(**named) -> str:
    return ", ".join(f"{S.out(e)} AS {n}" for n, e in named.items())


book.add("m1_equity", lambda s, d: pick(O.equity(daily(s, d), unit="year").withColumn("log_equity", F.ln("equity")), "log_equity", keys=("strategy_id", "date")), EQ + f"SELECT strategy_id, date, {cols(log_equity='ln(equity)')} FROM eq")
for name, columns, e in (
    ("m1_cagr", ["cagr"], {"cagr": "CASE WHEN arg_max(equity, date) >= 0 THEN pow(arg_max(equity, date), 252.0 / count(*)) - 1 END"}),
    ("m2_sharpe", ["sharpe"], {"sharpe": f"round({SHARPE('ret')}, 2)"}),
    ("m3_sortino", ["sortino"], {"sortino": "CASE WHEN stddev_samp(ret) FILTER (ret < 0) > 0 THEN avg(ret) * 252 / (stddev_samp(ret) FILTER (ret < 0) * sqrt(252)) END"}),
    ("m4_max_drawdown", ["max_drawdown"], {"max_drawdown": "min(dd)"}),
):
    book.add(name, lambda s, d, c=columns, u="year" if name == "m4_max_drawdown" else None: pick(O.summary(daily(s, d), unit=u), *c), EQ + f"SELECT strategy_id, {cols(**e)} FROM dds GROUP BY 1")
book.add(
    "m5_hit_rate_vol",
    lambda s, d: pick(O.summary(rows := daily(s, d)).join(O.benchmark_cagr(rows, T.market(s, d)), "strategy_id"), "hit_rate", "vol", "benchmark_cagr"),
    EQ + f"""SELECT strategy_id, {cols(hit_rate="avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END)", vol="stddev_samp(ret) * sqrt(252)", benchmark_cagr="pow(product(1 + coalesce(rm, 0)), 252.0 / count(*)) - 1")}
    FROM dds LEFT JOIN market USING (date) GROUP BY 1""",
)
LEDGER = ["start_value", "end_value", "total_return", "cagr", "sharpe", "sortino", "calmar", "max_drawdown", "costs"]
LED = B + f""", lr AS (SELECT *, value / nullif(lag(value) OVER {W}, 0) - 1 AS r, value / max(value) OVER {RUN} - 1 AS dd FROM vals),
    la AS (SELECT strategy_id, arg_max(value, date) / arg_min(value, date) AS total, (max(date) - min(date)) / 365.25::DOUBLE AS years, stddev_samp(r) * sqrt(252) AS vol, stddev_samp(r) FILTER (r < 0) * sqrt(252) AS down, min(dd) AS dd, count(*) FILTER (r < 0) AS falls,
      arg_min(value, date) AS start_value, arg_max(value, date) AS end_value FROM lr GROUP BY 1),
    tl AS (SELECT CAST(l_suppkey AS VARCHAR) AS strategy_id, count(*) AS trades, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0 * 0.0005 AS costs FROM lineitem GROUP BY 1),
    ledger AS (SELECT strategy_id, start_value, end_value, total - 1 AS total_return, c AS cagr, CASE WHEN vol > 0 THEN (c - 0.04) / vol ELSE 0.0 END AS sharpe,
      CASE WHEN d > 0 THEN (c - 0.04) / d ELSE 0.0 END AS sortino, CASE WHEN dd <> 0 THEN abs(c / dd) ELSE 0.0 END AS calmar, dd AS max_drawdown, coalesce(trades, 0) AS trades, coalesce(costs, 0.0)::DOUBLE AS costs
      FROM (SELECT *, pow(total, 1 / years) - 1 AS c, CASE WHEN falls > 0 THEN down ELSE vol END AS d FROM la) LEFT JOIN tl USING (strategy_id))"""


def trades(s, d):
    """A trade line costs 5 bps of what it moves; sums are taken in cents."""
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    lines = T.table(s, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("strategy_id"), "l_extendedprice")
    return lines.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("lines"), (cents / 100.0 * 0.0005).alias("cost"))


def _ledger(s, d):
    found = O.ledger_metrics(values(s, d), trades=trades(s, d))
    # the trades come summed by strategy, so that cents add up exactly
    return found.drop("trades").join(trades(s, d).select("strategy_id", F.col("lines").alias("trades")), "strategy_id", "left")


book.add(
    "m6_ledger",
    lambda s, d: pick(_ledger(s, d), *LEDGER, keys=("strategy_id", "trades")),
    LED + f"SELECT strategy_id, trades, {cols(**{c: c for c in LEDGER})} FROM ledger",
)
PERIOD = lambda u: B + f""", lastv AS (SELECT strategy_id, CAST(date_trunc('{u}', date) AS DATE) AS period, arg_max(value, date) AS value FROM vals GROUP BY ALL),
    gridp AS (SELECT strategy_id, CAST(unnest(generate_series(min(period)::TIMESTAMP, max(period)::TIMESTAMP, INTERVAL 1 {u})) AS DATE) AS period FROM lastv GROUP BY 1),
    pers AS (SELECT g.*, value, value / nullif(lag(value) OVER (PARTITION BY g.strategy_id ORDER BY g.period), 0) - 1 AS ret FROM gridp g LEFT JOIN lastv l ON l.strategy_id = g.strategy_id AND l.period = g.period)"""  # noqa: E731
WL = ["win_rate", "profit_factor", "avg_win", "avg_loss", "best", "worst"]
book.add(
    "m7_monthly",
    lambda s, d: pick(O.win_loss(O.period_returns(values(s, d))), *WL),
    PERIOD("month") + f"""SELECT strategy_id, {cols(win_rate="avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0 END)", profit_factor="abs(coalesce(avg(ret) FILTER (ret > 0), 0) / avg(ret) FILTER (ret < 0))",
    avg_win="avg(ret) FILTER (ret > 0)", avg_loss="avg(ret) FILTER (ret < 0)", best="max(ret)", worst="min(ret)")} FROM pers WHERE ret IS NOT NULL GROUP BY 1""",
)
book.add("m8_best_year", lambda s, d: pick(O.win_loss(O.period_returns(values(s, d), "year")), "best", "worst"), PERIOD("year") + f"SELECT strategy_id, {cols(best='max(ret)', worst='min(ret)')} FROM pers WHERE ret IS NOT NULL GROUP BY 1")


def _bench(s, d):
    m = T.market(s, d)
    return O.ledger_metrics(m.select(F.lit("MKT").alias("strategy_id"), "date", F.col("m").alias("value")))


book.add(
    "m9_benchmark",
    lambda s, d: pick(O.against_benchmark(O.ledger_metrics(values(s, d)), _bench(s, d), ["cagr", "max_drawdown"]), "cagr_diff", "max_drawdown_diff"),
    LED + f""", mv AS (SELECT date, m AS value, m / max(m) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM market),
    mb AS (SELECT pow(arg_max(value, date) / arg_min(value, date), 1 / ((max(date) - min(date)) / 365.25::DOUBLE)) - 1 AS c, min(dd) AS d FROM mv)
    SELECT strategy_id, {cols(cagr_diff="cagr - c", max_drawdown_diff="max_drawdown - d")} FROM ledger, mb""",
)
book.add(
    "m10_yearly",
    lambda s, d: pick(O.yearly(daily(s, d)), "ret", "vol", "sharpe", keys=("strategy_id", "year", "n")),
    B + f"""SELECT strategy_id, CAST(year(date) AS INT) AS year, count(ret) AS n, {cols(ret="product(1 + ret) - 1", vol="stddev_samp(ret) * sqrt(252)", sharpe="CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) END")}
    FROM daily GROUP BY 1, 2 HAVING count(ret) >= 40""",
)
F90, F21 = (f"(PARTITION BY strategy_id ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in (90, 21))
SNAP = ["daily", "cumulative", "drawdown", "sharpe_90", "vol_21", "bench_daily", "bench_cumulative"]
book.add(
    "m11_snapshot",
    lambda s, d: pick(O.daily_snapshot(values(s, d), T.market(s, d)), *SNAP, keys=("strategy_id", "date")),
    B + f""", sr AS (SELECT *, coalesce(value / nullif(lag(value) OVER {W}, 0) - 1, 0) AS r FROM vals), mb AS (SELECT date, rm, m / first_value(m) OVER (ORDER BY date) - 1 AS mc FROM market),
    sx AS (SELECT strategy_id, date, r, value / first_value(value) OVER {RUN} - 1 AS cum, coalesce(value / max(value) OVER (PARTITION BY strategy_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS dd,
      CASE WHEN count(r) OVER {F90} >= 20 AND stddev_pop(r) OVER {F90} > 0 THEN (avg(r) OVER {F90} * 252 - 0.04) / (stddev_pop(r) OVER {F90} * sqrt(252)) END AS s90, CASE WHEN count(r) OVER {F21} >= 5 THEN stddev_pop(r) OVER {F21} * sqrt(252) END AS v21 FROM sr)
    SELECT strategy_id, sx.date, {cols(daily="r", cumulative="cum", drawdown="dd", sharpe_90="s90", vol_21="v21", bench_daily="rm", bench_cumulative="mc")} FROM sx LEFT JOIN mb ON mb.date = sx.date""",
)
book.add(
    "m12_monthly_summary",
    lambda s, d: pick(O.monthly_summary(values(s, d), T.market(s, d).select("date", "rm")), "start", "end", "ret", "bench", "alpha", keys=("strategy_id", "month")),
    B + f""", ms AS (SELECT strategy_id, strftime(v.date, '%Y-%m') AS month, arg_min(value, v.date) AS a, arg_max(value, v.date) AS b, coalesce(sum(rm), 0) AS bench FROM vals v LEFT JOIN market m ON m.date = v.date GROUP BY 1, 2)
    SELECT strategy_id, month, {S.out("a")} AS start, {S.out("b")} AS "end", {cols(ret="b / a - 1", bench="bench", alpha="b / a - 1 - bench")} FROM ms""",
)
book.add(
    "m13_ytd",
    lambda s, d: pick(O.ytd(values(s, d), 2001), "ret", "sharpe", "vol", "drawdown", keys=("strategy_id", "days")),
    B + f""", y AS (SELECT * FROM (SELECT *, coalesce(value / nullif(lag(value) OVER {W}, 0) - 1, 0) AS r FROM vals) WHERE year(date) = 2001)
    SELECT strategy_id, count(*) AS days, {cols(ret="arg_max(value, date) / arg_min(value, date) - 1", sharpe="CASE WHEN stddev_pop(r) > 0 THEN (avg(r) * 252 - 0.04) / (stddev_pop(r) * sqrt(252)) END", vol="stddev_pop(r) * sqrt(252)", drawdown="min(value) / max(value) - 1")} FROM y GROUP BY 1""",
)
book.add(
    "m14_multi_period",
    lambda s, d: pick(O.multi_period(values(s, d), T.market(s, d)), "ret", "bench", keys=("strategy_id", "period", "winner")),
    B + f""", lim AS (SELECT period, CASE WHEN days > 0 THEN e - days WHEN days = 0 THEN CAST(date_trunc('year', e) AS DATE) ELSE DATE '1900-01-01' END AS start FROM (VALUES {", ".join(f"('{p}', {n})" for p, n in O.PERIODS)}) p(period, days), (SELECT max(date) AS e FROM vals)),
    a AS (SELECT strategy_id, period, arg_max(value, date) / arg_min(value, date) - 1 AS ret FROM vals JOIN lim ON date >= start GROUP BY ALL),
    b AS (SELECT period, arg_max(m, date) / arg_min(m, date) - 1 AS bench FROM market JOIN lim ON date >= start GROUP BY ALL)
    SELECT strategy_id, period, CASE WHEN ret > bench THEN 'portfolio' ELSE 'benchmark' END AS winner, {cols(ret="ret", bench="bench")} FROM a JOIN b USING (period)""",
)
book.add(
    "m15_rebased",
    lambda s, d: pick(O.rebased(values(s, d), T.market(s, d).select("date", "m")), "curve", "bench_curve", keys=("strategy_id", "date")),
    B + f""", fl AS (SELECT k.strategy_id, x.date, value, m FROM (SELECT DISTINCT strategy_id FROM vals) k CROSS JOIN (SELECT date FROM vals UNION SELECT date FROM market) x LEFT JOIN vals v ON v.strategy_id = k.strategy_id AND v.date = x.date LEFT JOIN market mk ON mk.date = x.date)
    SELECT strategy_id, date, {cols(curve=f"last_value(value IGNORE NULLS) OVER {RUN} / first_value(value IGNORE NULLS) OVER (PARTITION BY strategy_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100",
    bench_curve=f"last_value(m IGNORE NULLS) OVER {RUN} / first_value(m IGNORE NULLS) OVER (PARTITION BY strategy_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) * 100")} FROM fl""",
)
A20 = "(PARTITION BY strategy_id ORDER BY date ROWS 19 PRECEDING)"
book.add(
    "m16_rolling_alpha",
    lambda s, d: pick(O.rolling_alpha(daily(s, d), T.market(s, d)), "alpha", digits=4, keys=("strategy_id", "date")),
    B + f", ra AS (SELECT strategy_id, date, ret - rm AS d FROM daily JOIN market USING (date)) SELECT strategy_id, date, {S.out(f'CASE WHEN count(d) OVER {A20} = 20 THEN avg(d) OVER {A20} * 25200 END', 4)} AS alpha FROM ra",
)
Q3 = S.FILLED + f", z0 AS (SELECT ticker, date, i, {S.change('pf', 21)} AS x FROM panel), zz AS (SELECT ticker, date, i, {S.out(S.zscore('x'))} AS z FROM z0)"
book.add(
    "m17_holding_frequency",
    lambda s, d: pick(O.holding_frequency(T.filled_panel(s, d).select("ticker", "date", out(zscore(change("pf", 21))).alias("z")).where("z > 1").groupBy("date").agg(F.collect_list("ticker").alias("tickers"))), "share", keys=("ticker", "times")),
    Q3 + f"SELECT ticker, count(*) AS times, {S.out('count(*)::DOUBLE / (SELECT count(DISTINCT date) FROM zz WHERE z > 1)')} AS share FROM zz WHERE z > 1 GROUP BY 1 ORDER BY times DESC, ticker LIMIT 10",
)
book.add(
    "m18_macro_latest",
    lambda s, d: pick(O.macro_latest(T.macro(s, d)), "latest", "change_5", "drawdown", keys=("series_id", "rows")),
    "WITH x AS (SELECT 1)" + S.MACRO + f""", rk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) AS k FROM macro) WHERE k <= 252)
    SELECT series_id, count(*) AS rows, {cols(latest="max(value) FILTER (k = 1)", change_5="max(value) FILTER (k = 1) - max(value) FILTER (k = 6)", drawdown="max(value) FILTER (k = 1) / max(value) - 1")} FROM rk GROUP BY 1""",
)

# ---- walk-forward of the live path, from row 160 on; averages and history shortened to the weekly panel ----

K, WARM = 10, 160
LIVE = [("live", K, 0.0)]
#: Fixed experiments: cadence and net exposure in a crisis.
GRID = [("rebalance 5, crisis net -0.1", 5, -0.1), ("rebalance 10", 10, -0.1), ("rebalance 15", 15, -0.1), ("rebalance 5, crisis net 0", 5, 0.0), ("rebalance 10, crisis net 0", 10, 0.0)]
MEDIAN, HISTORY, LONGS, SHORTS = 60_000, 60, 20, 10


def _returns(panel, t):
    """Daily rows of the names that the targets hold, stored: the walk reads them several times, and the panel once."""
    return stored(panel.select("ticker", "i", "date", "r").join(t.select("ticker").distinct(), "ticker", "left_semi"))


def _regimes(s, d, cal):
    """Regimes from row WARM on: votes of the price alone, as the walk-forward has no other series."""
    market = T.market(s, d).withColumn("market", F.lit("MKT"))
    votes = market.select("market", "date", *(c.alias(n) for n, c in RG.proxy_votes(n=50).items()))
    return RG.regime_path(votes.join(cal.where(F.col("i") >= WARM).select("date"), "date"))


def targets(s, d, configs=LIVE, panel=None):
    """W2 over the weekly panel.  Signals are scored on the dates that a rebalance reads: its own and those of its information coefficients."""
    panel = panel or stored(T.filled_panel(s, d))
    on, ahead = WK.on_rebalance(configs, WARM), ("ahead_21", "ahead_63")
    signals = SG.production_signals(L.with_ahead(panel), HISTORY, WK.on_rebalance(configs, WARM, (0, 21, 63)), ("i", *ahead), rolls={"vol": sd("r", 63)})
    signals = stored(signals)
    able = PF.eligibility(panel, T.dimensions(s, d), 5, 0, MEDIAN, (), ("leveraged",), on).select("ticker", "date", "eligible", "sector", "asset_class")
    able = able.join(signals.where(on).select("ticker", "date", (F.col("vol") * F.sqrt(F.lit(ANNUAL))).alias("vol")), ["ticker", "date"])
    cal = T.weeks(s, d)
    return WK.live_targets(signals, list(SG.SIGNALS), able, _regimes(s, d, cal), cal, configs, WARM, LONGS, SHORTS, long_cap=0.30)


def _walk(s, d, configs=LIVE, panel=None):
    """Targets, daily rows and costs of several configurations in one walk; the last two, a row a day or period, are stored."""
    panel = panel or stored(T.filled_panel(s, d))
    t = stored(targets(s, d, configs, panel).drop("date"))
    rows = _returns(panel, t).crossJoin(F.broadcast(WK.configurations(s, configs).drop("crisis_net")))  # a row a configuration
    daily, ends = O.drifted_returns(t, rows, F.col("every"), WARM)
    return t, stored(daily), stored(O.traded(t, ends))


def _cfg(configs) -> str:
    return ", ".join(f"('{n}', {k}, {c}::DOUBLE)" for n, k, c in configs)


PER = "PARTITION BY config, date"
BOOK = (LEGS[len(SCORED) :] + CAPPED[len(LEGS) :]).replace("PARTITION BY date", PER).replace(f"{GROSS}::DOUBLE AS g", "CASE WHEN leg = 1 THEN greatest(least((gross + net) / 2, 0.98), 0) ELSE greatest((gross - net) / 2, 0) END AS g").replace("tg AS (SELECT date,", "tg AS (SELECT config, period, date,").replace("FROM legs))", "FROM legs) WHERE g > 0)")
WALKED = f""",
    rr AS (SELECT config, ticker, i, date, coalesce(r, 0) AS r, (i - {{warm}} - 1) // every AS period FROM panel, cfg WHERE i > {{warm}}),
    gv AS (SELECT t.config, t.period, t.ticker, rr.i, rr.date, weight, weight * product(1 + r) OVER (PARTITION BY t.config, t.period, t.ticker ORDER BY rr.i ROWS UNBOUNDED PRECEDING) AS value FROM tg t JOIN rr ON rr.config = t.config AND rr.ticker = t.ticker AND rr.period = t.period),
    bk AS (SELECT config, period, i, date, 1 + sum(value - weight) AS v, sum(abs(value)) AS g, sum(value) AS n FROM gv GROUP BY ALL),
    dl AS (SELECT *, v / coalesce(lag(v) OVER (PARTITION BY config, period ORDER BY i), 1) - 1 AS gross FROM bk),
    en AS (SELECT config, period, ticker, x / v AS weight FROM (SELECT config, period, ticker, arg_max(value, i) AS x FROM gv GROUP BY ALL) JOIN (SELECT config, period, arg_max(v, i) AS v FROM bk GROUP BY ALL) USING (config, period)),
    tr AS (SELECT config, period, sum(abs(coalesce(w, 0) - coalesce(o, 0))) AS traded FROM (SELECT config, period, ticker, weight AS w FROM tg) a FULL OUTER JOIN (SELECT config, period + 1 AS period, ticker, weight AS o FROM en) b USING (config, period, ticker)
      WHERE (config, period) IN (SELECT DISTINCT config, period FROM tg) GROUP BY 1, 2),
    nt AS (SELECT dl.*, traded, row_number() OVER (PARTITION BY config, period ORDER BY i) = 1 AS first FROM dl JOIN tr USING (config, period))"""


def live(configs) -> str:
    return (
        (RAW.replace(">= 252 AS enough", f">= {HISTORY} AS enough") + IC21 + IC63).replace("\nWITH lines", "\nWITH RECURSIVE lines") + S.MARKET + S.DIMENSIONS
        + f""", blend AS (SELECT signal, a.date, a.i, 0.70 * a.ic + 0.30 * b.ic AS ic FROM ic21 a JOIN ic63 b USING (signal, date)),
    cfg AS (SELECT * FROM (VALUES {_cfg(configs)}) c(config, every, crisis_net)),
    reb AS MATERIALIZED (SELECT config, every, crisis_net, date, i, (i - {WARM}) // every AS period FROM cal, cfg WHERE i >= {WARM} AND (i - {WARM}) % every = 0 AND i < (SELECT max(i) FROM cal)),
    byday AS MATERIALIZED (SELECT config, period, r.date, [{", ".join(f"max(ic) FILTER (signal = '{n}')" for n in SG.SIGNALS)}] AS ics FROM reb r JOIN blend b ON b.date = r.date GROUP BY ALL),
    fold AS (SELECT config, -1::BIGINT AS period, CAST(NULL AS DATE) AS date, [0.2::DOUBLE, 0.2, 0.2, 0.2, 0.2] AS w FROM cfg
      UNION ALL SELECT config, period, date, list_transform(x, lambda v: v / list_sum(x)) FROM (
        SELECT b.config, b.period, b.date, list_transform(f.w, lambda v, k: greatest(0.05::DOUBLE, least(0.40::DOUBLE, 2 / 11.0::DOUBLE * (0.2 + 0.5 * greatest(b.ics[k], 0)) + 9 / 11.0::DOUBLE * v))) AS x FROM fold f JOIN byday b ON b.config = f.config AND b.period = f.period + 1) b),
    weights AS (SELECT config, period, date, unnest({list(SG.SIGNALS)}) AS signal, unnest(w) AS weight FROM fold WHERE period >= 0),
    mv AS (SELECT date, {MROLL("avg", "m", 50).replace("PARTITION BY market ", "")} AS mean, m, {MROLL("stddev_samp", "rm", 21).replace("PARTITION BY market ", "")} * sqrt(252) AS vol FROM market),
    days AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS k, CASE WHEN m / mean - 1 > 0.02 THEN 1 WHEN m / mean - 1 < -0.02 THEN -1 WHEN mean IS NOT NULL THEN 0 END AS trend,
      CASE WHEN vol < 0.15 THEN 1 WHEN vol > 0.25 THEN -1 WHEN vol IS NOT NULL THEN 0 END AS volv FROM mv JOIN cal USING (date) WHERE i >= {WARM}),
    path AS (SELECT 0::BIGINT AS k, CAST(NULL AS DATE) AS date, 'CAUTIOUS' AS regime, 0 AS bu, 0 AS be
      UNION ALL SELECT k, date, CASE WHEN live < 2 THEN regime WHEN trend = 1 AND volv = 1 THEN 'ACTIVE' WHEN b2 >= 2 AND e2 < 2 THEN 'ACTIVE' WHEN e2 >= 2 THEN 'CRISIS'
          WHEN n_off >= 2 AND regime = 'ACTIVE' THEN 'CAUTIOUS' WHEN n_on >= 2 AND regime = 'CRISIS' THEN 'CAUTIOUS' ELSE regime END, b2, e2
        FROM (SELECT *, CASE WHEN n_on >= 2 THEN bu + 1 ELSE 0 END AS b2, CASE WHEN n_off >= 2 THEN be + 1 ELSE 0 END AS e2 FROM (SELECT d.*, p.regime, p.bu, p.be, (trend IS NOT NULL)::INT + (volv IS NOT NULL)::INT AS live,
          coalesce((trend = 1)::INT, 0) + coalesce((volv = 1)::INT, 0) AS n_on, coalesce((trend = -1)::INT, 0) + coalesce((volv = -1)::INT, 0) AS n_off FROM path p JOIN days d ON d.k = p.k + 1))),
    tallw AS (UNPIVOT (SELECT ticker, date, {", ".join(SG.SIGNALS)} FROM signals) ON {", ".join(SG.SIGNALS)} INTO NAME signal VALUE score),
    comp AS (SELECT config, t.date, ticker, {S.out("sum(weight * t.score) / sum(weight)")} AS score FROM tallw t JOIN weights w ON t.date = w.date AND t.signal = w.signal GROUP BY ALL HAVING count(*) >= 3),
    able AS (SELECT p.ticker, p.date, px, {S.roll("stddev_samp", "r", 63)} * sqrt(252) AS vol, quantile_cont(px * volume, 0.5) OVER (PARTITION BY p.ticker ORDER BY date ROWS 20 PRECEDING) AS dollars, sector, asset_class FROM panel p LEFT JOIN dims USING (ticker)),
    base AS MATERIALIZED (SELECT c.config, r.period, c.date, c.ticker, c.score, a.vol, sector, asset_class, CASE regime WHEN 'ACTIVE' THEN 1.0 WHEN 'CAUTIOUS' THEN 0.6 ELSE 0.5 END::DOUBLE AS gross,
      CASE regime WHEN 'ACTIVE' THEN 0.8 WHEN 'CAUTIOUS' THEN 0.3 ELSE crisis_net END::DOUBLE AS net FROM comp c JOIN able a ON a.ticker = c.ticker AND a.date = c.date JOIN reb r ON r.config = c.config AND r.date = c.date JOIN path ON path.date = c.date
      WHERE px >= 5 AND dollars >= {MEDIAN} AND asset_class <> 'leveraged')""" + BOOK + WALKED.format(warm=WARM)
    )


WF = live(LIVE)
book.add(
    "w1_calendar",
    lambda s, d: O.rebalance_calendar(T.weeks(s, d), K, WARM).select("date", F.col("period").cast("long").alias("period"), "rebalance"),
    S.PANEL + f"SELECT date, (i - {WARM}) // {K} AS period, (i - {WARM}) % {K} = 0 AND i < (SELECT max(i) FROM cal) AS rebalance FROM cal WHERE i >= {WARM}",
)
book.add("w2_targets", lambda s, d: pick(targets(s, d), "weight", keys=("config", "date", "ticker")), WF + f"SELECT config, date, ticker, {cols(weight='weight')} FROM tg")
book.add("w3_drift", lambda s, d: pick(_walk(s, d)[1], "gross", keys=("date",)), WF + f"SELECT date, {cols(gross='gross')} FROM dl")


def _net(s, d, bps=5.0, configs=LIVE, panel=None):
    _, rows, trades = _walk(s, d, configs, panel)
    return O.net_returns(rows, trades, bps)


def _grid(s, d):
    """All configurations in one walk; cagr, Sharpe ratio, largest drawdown and turnover of each."""
    _, rows, trades = _walk(s, d, GRID)
    net = O.net_returns(rows, trades, 5.0)
    return O.summary(net, "config").join(O.turnover_summary(rows, trades), "config")


NET = "gross - CASE WHEN first THEN traded * 5 / 10000.0 ELSE 0 END"
CEQ = "(PARTITION BY config ORDER BY date ROWS UNBOUNDED PRECEDING)"
book.add(
    "a28_experiment_grid",
    lambda s, d: pick(_grid(s, d), "cagr", "sharpe", "max_drawdown", "turnover", keys=("config",)),
    live(GRID) + f""", ge AS (SELECT config, date, {NET} AS ret FROM nt), gq AS (SELECT *, product(1 + ret) OVER {CEQ} AS equity FROM ge), gd AS (SELECT *, equity / nullif(max(equity) OVER {CEQ}, 0) - 1 AS dd FROM gq)
    SELECT config, {cols(cagr="CASE WHEN arg_max(equity, date) >= 0 THEN pow(arg_max(equity, date), 252.0 / count(*)) - 1 END", sharpe=f"round({SHARPE('ret')}, 2)", max_drawdown="min(dd)", turnover="any_value(tv) / (count(*) / 252.0) / 2")}
    FROM gd JOIN (SELECT config, sum(traded) AS tv FROM tr GROUP BY 1) USING (config) GROUP BY config""",
)


def _walk_regimes(s, d):
    cal = T.weeks(s, d)
    return RG.walk_occupancy(_net(s, d), _regimes(s, d, cal), cal)


book.add(
    "r13_walk",
    lambda s, d: pick(_walk_regimes(s, d), "share", "sharpe", digits=4, keys=("config", "regime")),
    WF + f""", rd AS (SELECT config, regime, {NET} AS ret FROM nt JOIN cal ON cal.i = nt.i - 1 JOIN path ON path.date = cal.date)
    SELECT config, regime, {S.out("count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY config)", 4)} AS share, {S.out("CASE WHEN count(ret) >= 20 AND stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(252) END", 4)} AS sharpe FROM rd GROUP BY config, regime""",
)
book.add("w4_costs", lambda s, d: pick(_net(s, d), "ret", "traded", keys=("date",)), WF + f"SELECT date, {cols(ret=NET, traded='traded')} FROM nt")
book.add(
    "w5_turnover",
    lambda s, d: pick(O.turnover_summary(*_walk(s, d)[1:]), "turnover", "gross", "net", keys=("config",)),
    WF + f"""SELECT config, {cols(turnover="any_value(tv) / (count(*) / 252.0) / 2", gross="avg(g / v)", net="avg(n / v)")} FROM dl JOIN (SELECT config, sum(traded) AS tv FROM tr GROUP BY 1) USING (config) GROUP BY config""",
)
book.add(
    "w6_cost_sensitivity",
    lambda s, d: pick(O.cost_sensitivity(*_walk(s, d)[1:]), "cagr", "sharpe", "max_drawdown", "turnover", "total", keys=("bps",)),
    WF + f""", lq AS (SELECT *, product(1 + ret) OVER (PARTITION BY bps ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM (SELECT bps, date, ret FROM (SELECT nt.date, bps, gross - CASE WHEN first THEN traded * bps / 10000.0 ELSE 0 END AS ret FROM nt, (VALUES (0.0::DOUBLE), (5.0), (15.0)) b(bps)))),
    ld AS (SELECT *, equity / nullif(max(equity) OVER (PARTITION BY bps ORDER BY date ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd FROM lq)
    SELECT bps, {cols(cagr="CASE WHEN arg_max(equity, date) >= 0 THEN pow(arg_max(equity, date), 252.0 / count(*)) - 1 END", sharpe=f"round({SHARPE('ret')}, 2)", max_drawdown="min(dd)", turnover="any_value(tv) / (count(*) / 252.0) / 2", total="product(1 + ret) - 1")}
    FROM ld, (SELECT sum(traded) AS tv FROM tr) GROUP BY 1""",
)
SLEEVE, SLEEVE_VOL = 260, 2.0  # weekly moves are large: the default of 0.08 leaves dust only


def sleeve(s, d, panel=None):
    """The trend sleeve (S10, P7) through the same walk."""
    panel = panel or stored(T.filled_panel(s, d))
    p = sliding(SG.tsmom(panel), {"vol": sd("r", 63)}).withColumn("vol", F.col("vol") * F.sqrt(F.lit(ANNUAL)))
    on = p.where(f"i >= {SLEEVE} and (i - {SLEEVE}) % {K} = 0").select("ticker", "date", "i", F.col("tsmom").alias("score"), "vol")
    t = PF.sleeve_targets(on.join(T.dimensions(s, d), "ticker"), SLEEVE_VOL).select(F.lit("sleeve").alias("config"), F.expr(f"(i - {SLEEVE}) div {K}").alias("period"), "ticker", "weight")
    t = stored(t)
    rows, ends = O.drifted_returns(t, _returns(panel, t), K, SLEEVE)
    return O.net_returns(stored(rows), stored(O.traded(t, ends)), 5.0)


SL = (
    S.FILLED + S.DIMENSIONS
    + f""", cfg AS (SELECT 'sleeve' AS config, {K} AS every), sg AS (SELECT ticker, date, i, {S.roll("stddev_samp", "r", 63)} * sqrt(252) AS vol,
      CASE WHEN count(px) OVER {S.frame(253)} = 253 THEN (sign({S.change("px", 63)}) + sign({S.change("px", 126)}) + sign({S.change("px", 252)})) / 3.0 END AS score FROM panel),
    s0 AS (SELECT sg.*, asset_class, CASE WHEN vol IS NOT NULL THEN greatest(vol, 0.04) END AS v FROM sg JOIN dims USING (ticker) WHERE i >= {SLEEVE} AND (i - {SLEEVE}) % {K} = 0 AND score <> 0),
    s1 AS (SELECT *, greatest(-0.12, least(0.12, score * {SLEEVE_VOL} / (coalesce(v, median(v) OVER (PARTITION BY date), 0.15) * sqrt(count(*) OVER (PARTITION BY date))))) AS weight FROM s0),
    s2 AS (SELECT * REPLACE (weight * least(1.0, 0.35 / sum(abs(weight)) OVER (PARTITION BY date, asset_class)) AS weight) FROM s1),
    s3 AS (SELECT * REPLACE (weight * least(1.0, 1.0 / sum(abs(weight)) OVER (PARTITION BY date)) AS weight) FROM s2),
    tg AS (SELECT 'sleeve' AS config, (i - {SLEEVE}) // {K} AS period, ticker, weight FROM s3 WHERE abs(weight) >= 0.005)""" + WALKED.format(warm=SLEEVE)
)
book.add("w7_sleeve", lambda s, d: pick(sleeve(s, d), "ret", keys=("date",)), SL + f"SELECT date, {cols(ret=NET)} FROM nt")
book.add(
    "w8_blends",
    lambda s, d: pick(O.blends(_net(s, d, panel=(p := stored(T.filled_panel(s, d)))), sleeve(s, d, p)), "cagr", "sharpe", "max_drawdown", "vol", "corr", keys=("share",)),
    f"""WITH one AS ({WF} SELECT date, {NET} AS x FROM nt), two AS ({SL} SELECT date, {NET} AS y FROM nt),
    bl AS (SELECT date, share, x, y, share * x + (1 - share) * y AS r FROM one JOIN two USING (date), (VALUES (1.0::DOUBLE), (0.0), (0.7), (0.6), (0.5)) s(share)),
    bq AS (SELECT *, product(1 + r) OVER (PARTITION BY share ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM bl),
    bd AS (SELECT *, equity / nullif(max(equity) OVER (PARTITION BY share ORDER BY date ROWS UNBOUNDED PRECEDING), 0) - 1 AS dd FROM bq)
    SELECT share, {cols(cagr="CASE WHEN arg_max(equity, date) >= 0 THEN pow(arg_max(equity, date), 252.0 / count(*)) - 1 END", sharpe=f"round({SHARPE('r')}, 2)", max_drawdown="min(dd)", vol="stddev_samp(r) * sqrt(252)", corr="round(corr(x, y), 2)")} FROM bd GROUP BY 1""",
)
