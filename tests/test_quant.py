"""Examples, invariants and small oracles of the quant operators."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.windows import zscore
from tessera.operators import features, ingest, joins, league, metrics, portfolio, regime, risk, signals
from tessera.sources import tables


@pytest.fixture(scope="module")
def market(spark):
    """Random walks: 30 names and a short one on 300 business days, with gaps."""
    rng = np.random.default_rng(11)
    days = pd.bdate_range("2023-01-02", periods=300)
    rows = []
    for n in range(30):
        p = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(days))))
        for k, (d, x) in enumerate(zip(days, p, strict=True)):
            if not (n == 29 and k < 240) and rng.random() > 0.01:
                rows.append((f"T{n:02d}", d.date(), float(x), float(x) * 1.01, float(x) * 0.99, float(x), round(float(x), 2), 1000))
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, px double, volume long").cache()


def filled(market):
    return tables.dense(market).withColumn("px", F.col("pf"))


def test_no_look_ahead(market):
    cut = dt.date(2024, 1, 5)
    whole = signals.production_signals(filled(market), 100).where(F.col("date") <= F.lit(cut)).toPandas()
    early = signals.production_signals(filled(market.where(F.col("date") <= F.lit(cut))), 100).toPandas()
    a, b = (x.sort_values(["ticker", "date"]).reset_index(drop=True) for x in (whole, early))
    pd.testing.assert_frame_equal(a, b)


def test_signals_over_gaps_match_pandas(market):
    """Shifts and averages see the gaps, returns see filled prices, gaps are no history."""
    got = signals.production_signals(tables.dense(market), 200).toPandas()
    bars = market.toPandas()
    p = bars.pivot(index="date", columns="ticker", values="px").sort_index()
    r = p.ffill().pct_change(fill_method=None)
    mean = lambda n: p.rolling(n).mean()
    z = lambda x: x.sub(x.mean(axis=1), axis=0).div(x.std(axis=1).where(lambda s: s != 0), axis=0)
    want = {
        "xs_momentum": z(p.shift(21) / p.shift(147) - 1),
        "mean_reversion": -(0.5 * z(p / p.shift(5) - 1).clip(-3, 3) + 0.5 * z((p - mean(20)) / p.rolling(20).std()).clip(-3, 3)),
        "trend_follow": z(0.6 * (p / mean(50) - 1) + 0.4 * (mean(50) / mean(200) - 1)),
        "vol_adj_momentum": z((p / p.shift(63) - 1) / (r.rolling(63).std() * 252**0.5)),
        "low_vol": z(-r.rolling(126).std() * 252**0.5),
    }
    enough = p.notna().cumsum() >= 200
    for name, x in want.items():
        x, y = x.clip(-3, 3).where(enough), got.pivot(index="date", columns="ticker", values=name).sort_index()
        assert x.notna().sum().sum() > 50 and p.isna().sum().sum() > 50
        pd.testing.assert_frame_equal(y.astype(float), x, check_names=False, check_dtype=False, atol=1e-6, rtol=0)


def test_history_mask_clip_and_least_signals(market):
    s = signals.combine(signals.production_signals(filled(market), 252), dict.fromkeys(signals.SIGNALS, 0.2)).toPandas()
    assert s[s.ticker == "T29"][list(signals.SIGNALS)].isna().all().all()
    assert s[list(signals.SIGNALS)].abs().max().max() <= 3
    assert (s[s.composite.notna()][list(signals.SIGNALS)].notna().sum(axis=1) >= 3).all()


def test_recursions_match_pandas(market):
    own = market.withColumn("n", F.lit(0)).select("ticker", "date", "px")
    got = features.recursive_features(own).where("ticker = 'T00'").toPandas().sort_values("date")
    p = own.where("ticker = 'T00'").toPandas().sort_values("date").px.reset_index(drop=True)
    gain = p.diff().fillna(0).clip(lower=0)
    avg, want = gain[:14].mean(), []
    for x in gain[14:]:
        avg = (avg * 13 + x) / 14
        want.append(avg)
    loss = (-p.diff().fillna(0)).clip(lower=0)
    low = loss[:14].mean()
    for x in loss[14:]:
        low = (low * 13 + x) / 14
    assert abs(got.rsi.iloc[-1] - (100 - 100 / (1 + want[-1] / low))) < 1e-9 and got.rsi.iloc[:13].isna().all()


def test_rank_correlation_handles_ties(spark):
    rows = [("s", dt.date(2024, 1, 1), 0, f"t{i}", float(i // 2), float(i % 5)) for i in range(12)]
    df = spark.createDataFrame(rows, "signal string, date date, i int, ticker string, score double, fwd double")
    got = league.rank_correlation(df, "score", "fwd", 5).first().ic
    pdf = pd.DataFrame(rows)
    assert abs(got - pdf[4].rank().corr(pdf[5].rank())) < 1e-12


def test_weights_stay_in_bounds_and_sum_to_one(spark):
    rng = random.Random(1)
    rows = [("x", dt.date(2024, 1, 1) + dt.timedelta(d), s, rng.uniform(-1, 1)) for d in range(60) for s in signals.SIGNALS]
    ics = spark.createDataFrame(rows, "strategy_id string, date date, signal string, ic double")
    w = league.adapt_weights(ics, list(signals.SIGNALS)).toPandas()
    assert np.allclose(w.groupby("date").weight.sum(), 1) and w.weight.min() > 0.03 and w.weight.max() < 0.6


VOTES = [
    (("CRISIS", 0, 0), [(1, 0, 1), (1, 0, 1)], ["CAUTIOUS", "ACTIVE"]),
    (("ACTIVE", 0, 0), [(-1, -1, -1), (-1, -1, -1)], ["CAUTIOUS", "CRISIS"]),
    (("CRISIS", 0, 0), [(1, 1, -1)], ["ACTIVE"]),
    (("ACTIVE", 0, 0), [(None, None, -1), (0, None, -1)], ["ACTIVE", "ACTIVE"]),
]


@pytest.mark.parametrize("state, votes, want", VOTES)
def test_regime_sequences(state, votes, want):
    got = []
    for v in votes:
        *state, _ = regime.step(tuple(state), v)
        got.append(state[0])
    assert got == want


def test_inverse_vol_matches_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    vols = [None, 0.01, *rng.uniform(0.1, 0.6, 22).round(3)]
    rows = [("d", f"t{i}", 1, v, 0.9, 1.0) for i, v in enumerate(vols)]
    df = spark.createDataFrame([(r[0], r[1], r[2], None if r[3] is None else float(r[3]), r[4]) for r in rows], "date string, ticker string, leg int, vol double, leg_gross double")
    got = {r.ticker: r.weight for r in portfolio.inverse_vol(df).collect()}
    known = sorted(v for v in vols if v is not None)
    v = np.array([np.median(known) if x is None else max(x, 0.05) for x in vols])
    w = 1 / v / (1 / v).sum() * 0.9
    for _ in range(4):
        high = w > 0.05
        if not high.any():
            break
        extra, w = (w[high] - 0.05).sum(), np.where(high, 0.05, w)
        room = w < 0.05
        w[room] += extra * w[room] / w[room].sum()
    w = np.minimum(w, 0.05)
    w[w < 0.004] = 0
    w *= min(0.9 / w.sum(), 0.05 / w.max())
    assert np.allclose([got.get(f"t{i}", 0.0) for i in range(len(vols))], w)


def test_caps_and_exposure(spark, market):
    rows = [("d", f"T{i:02d}", float(100 - i), 0.2 + i / 100, f"S{i % 8}", "equity") for i in range(80)]
    scored = spark.createDataFrame(rows, "date string, ticker string, score double, vol double, sector string, asset_class string")
    t = portfolio.build_targets(scored, 1.0, 0.3).toPandas()
    assert t.weight.abs().max() <= 0.05 + 1e-9 and t[t.weight > 0].weight.sum() <= 0.65 + 1e-9
    assert t[t.weight > 0].groupby("sector").weight.sum().max() <= 0.20 + 1e-9 and (t.weight.abs() >= 0.004).all()


def test_orders_on_a_hand_book(spark):
    pv = 100_000.0
    pos = [("AAPL", 100.0, 200.0), ("MSFT", 50.0, 420.0), ("XOM", -40.0, 110.0), ("NVDA", 30.0, 140.0), ("JPM", pv * 0.0415 / 210, 210.0)]
    target = {"MSFT": 0.05, "XOM": -0.06, "NVDA": -0.03, "GOOG": 0.04, "TSLA": -0.0234, "JPM": 0.042}
    price = {"AAPL": 200.0, "MSFT": 420.0, "XOM": 110.0, "NVDA": 140.0, "GOOG": 180.0, "TSLA": 50.0, "JPM": 210.0}
    positions = spark.createDataFrame([("p", t, q, q * x, x) for t, q, x in pos], "portfolio_id string, ticker string, qty double, market_value double, current_price double")
    targets = spark.createDataFrame([("p", t, w) for t, w in target.items()], "portfolio_id string, ticker string, weight double")
    prices = spark.createDataFrame(list(price.items()), "ticker string, price double")
    values = spark.createDataFrame([("p", pv)], "portfolio_id string, value double")
    got = {(r.ticker, r.priority): r for r in risk.rebalance_orders(targets, positions, prices, values).collect()}
    assert got["AAPL", 0].side == "sell" and got["AAPL", 0].quantity == 100
    assert got["MSFT", 1].side == "sell" and got["NVDA", 0].quantity == 30 and got["NVDA", 2].quantity == 21
    assert got["TSLA", 2].quantity == 46 and got["XOM", 2].quantity == 14 and ("GOOG", 3) in got
    assert not any(t == "JPM" for t, _ in got)
    many = spark.createDataFrame([("p", f"N{i}", 0.012) for i in range(80)], "portfolio_id string, ticker string, weight double")
    more = spark.createDataFrame([(f"N{i}", 50.0) for i in range(80)] + list(price.items()), "ticker string, price double")
    capped = risk.rebalance_orders(many, positions, more, values).toPandas()
    assert len(capped) == 60 and (capped.priority == 0).sum() == 5


def test_drift_matches_a_day_loop(spark):
    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.02, (5, 31))
    rows = [(f"t{n}", i, dt.date(2024, 1, 1) + dt.timedelta(i), float(r[n, i])) for n in range(5) for i in range(31)]
    returns = spark.createDataFrame(rows, "ticker string, i int, date date, r double")
    w0 = rng.uniform(-0.3, 0.4, (3, 5))
    targets = spark.createDataFrame([("c", p, f"t{n}", float(w0[p, n])) for p in range(3) for n in range(5)], "config string, period int, ticker string, weight double")
    daily, ends = metrics.drifted_returns(targets, returns, 10, 0)
    got = daily.toPandas().sort_values("i").gross.to_numpy()
    want, w = [], None
    for i in range(1, 31):
        w = w0[(i - 1) // 10].copy() if (i - 1) % 10 == 0 else w
        g = (w * r[:, i]).sum()
        want.append(g)
        w = w * (1 + r[:, i]) / (1 + g)
    assert np.allclose(got, want)
    assert np.allclose(ends.where("period = 2").toPandas().sort_values("ticker").weight, w)


def test_costs_never_help(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    daily = spark.createDataFrame([("c", i // 10, i, d, 0.001 * (i % 3)) for i, d in enumerate(days)], "config string, period int, i int, date date, gross double")
    trades = spark.createDataFrame([("c", p, 1.0) for p in range(4)], "config string, period int, traded double")
    t = metrics.cost_sensitivity(daily, trades).toPandas().sort_values("bps").total.to_list()
    assert t[0] > t[1] > t[2]


def test_weekdays_match_numpy(spark):
    rng = np.random.default_rng(0)
    pairs = [(dt.date(2020, 1, 1) + dt.timedelta(int(a)), dt.date(2020, 1, 1) + dt.timedelta(int(b))) for a, b in rng.integers(0, 900, (100, 2))]
    df = spark.createDataFrame(pairs, "a date, b date").select("a", "b", joins.weekdays_between(F.col("a"), F.col("b")).alias("n"))
    assert all(r.n == np.busday_count(r.a, r.b) or r.b < r.a for r in df.collect())


def test_clean_bars_and_empty_tables(spark, market):
    raw = spark.createDataFrame([("2024-01-02", "10", None, "x"), ("2024-01-03", "-1", "5", "7"), (None, "3", None, None)], "Date string, Close string, `Adj Close` string, Volume string")
    rows = ingest.clean_bars(raw, "A").orderBy("date").collect()
    assert len(rows) == 2 and rows[1].adj_close == 10.0 and rows[1].volume == 0 and rows[1].open is None
    empty = market.limit(0)
    assert tables.dense(empty).count() == 0 and signals.production_signals(filled(empty)).count() == 0
    assert empty.withColumn("z", zscore("px")).count() == 0


def test_batch_and_stream_agree(spark):
    from tessera.streaming import jobs

    rng = random.Random(2)
    rows = [(m, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), i, *(rng.choice([None, -1, 0, 1]) for _ in range(3))) for i in range(60) for m in ("A", "B")]
    votes = spark.createDataFrame(rows, "market string, ts timestamp, event_id long, trend int, vol int, credit int")
    streamed = jobs.finished(jobs.regime_stream(jobs.replay(votes))).toPandas()
    for m, g in streamed.groupby("market"):
        state, want = (regime.CAUTIOUS, 0, 0), []
        for r in sorted(x for x in rows if x[0] == m):
            *state, c = regime.step(tuple(state), r[3:])
            want.append((*state, c))
        g = g.sort_values("event_id")
        assert list(zip(g.regime, g.bullish, g.bearish, g.confidence, strict=True)) == want


def test_registry_pairs_queries_with_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert len(queries) > 150 and set(sql) <= set(queries) and len(sql) > 150


def test_group_function_holds_one_name_of_a_sector(spark):
    from tessera.plans import ingest_queries

    d = "/root/testdata/sf0.001"
    found = ingest_queries._group_user(spark, d)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    group = next(line for line in plan.splitlines() if "FlatMapGroupsInPandas" in line)
    assert "ticker" in group.split("]")[0]
    own = tables.own_series(spark, d).join(tables.dimensions(spark, d), "ticker").groupBy("sector")
    want = {r.sector: (r.mean, r.n) for r in own.agg(F.avg("px").alias("mean"), F.count(F.lit(1)).alias("n")).collect()}
    rows = {r.sector: (r.mean, r.n) for r in found.collect()}
    assert rows.keys() == want.keys() and all(rows[k][1] == want[k][1] and abs(rows[k][0] - want[k][0]) < 1e-5 for k in want)


# ---- plain loops, written from the steps of the published rules ------------------------------


def test_total_loss_stays_zero(spark):
    from tessera.operators import metrics as M

    daily = spark.createDataFrame([("a", dt.date(2024, 1, k + 1), r) for k, r in enumerate([0.1, -1.0, 0.2])], "strategy_id string, date date, ret double")
    assert [round(r.equity, 9) for r in M.equity(daily).orderBy("date").collect()] == [1.1, 0.0, 0.0]
    row = M.summary(daily).first()
    assert row.cagr == -1.0 and row.max_drawdown == -1.0


def test_rolling_sums_equal_frames(spark):
    import numpy as np
    import pandas as pd

    from tessera.functions.windows import roll

    rng = np.random.default_rng(4)
    x = pd.Series(rng.normal(1000, 50, 300))
    x[100:130], x[200] = 777.0, None
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(k), None if v != v else float(v)) for k, v in enumerate(x)], "ticker string, date date, x double")
    got = df.select("date", roll(F.avg, "x", 20).alias("a"), roll(F.stddev_samp, "x", 20).alias("s"), roll(F.sum, F.col("x"), 20, least=10).alias("t")).orderBy("date").toPandas()
    for name, want in (("a", x.rolling(20).mean()), ("t", x.rolling(20, min_periods=10).sum())):
        assert np.allclose(got[name].astype(float), want, rtol=1e-12, equal_nan=True)
    sd = x.rolling(20).apply(lambda w: np.std(w, ddof=1), raw=True)
    assert np.allclose(got["s"].astype(float), sd, rtol=1e-9, atol=1e-9, equal_nan=True) and (got["s"][119:129].dropna() == 0).all()


def test_eight_votes_follow_the_rules(spark):
    import numpy as np

    from tessera.operators.regime import EIGHT, SEVERITY, eight_votes

    rng = np.random.default_rng(8)
    n, long, short, year = 120, 20, 5, 30
    m = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    vix, oas, curve, breadth = np.abs(rng.normal(22, 10, n)), rng.normal(4.5, 2, n), rng.normal(0.5, 1, n), rng.random(n)
    vix[:3], oas[7] = np.nan, np.nan
    none = lambda v: None if v != v else float(v)
    rows = [("MKT", dt.date(2020, 1, 1) + dt.timedelta(k), float(m[k]), none(vix[k]), none(oas[k]), float(curve[k]), float(breadth[k])) for k in range(n)]
    df = spark.createDataFrame(rows, "market string, date date, m double, vix double, oas double, curve double, breadth double")
    got = [r.label for r in eight_votes(df, long, short, year).orderBy("date").collect()]
    for k in range(n):
        votes = {}
        v = vix[k]
        if v == v:
            votes["vix"] = 0 if v < 13 else 1 if v < 18 else 2 if v < 25 else 3 if v < 35 else 4
            window = vix[max(0, k - 20) : k + 1]
            if k >= 20 and not np.isnan(window).any():
                a = window.mean()
                votes["vix_trend"] = 1 if v < a * 0.85 else 3 if v > a * 1.30 else 2 if v > a else 1
            if k >= 5 and vix[k - 5] == vix[k - 5]:
                jump = v / vix[k - 5] - 1
                votes["spike"] = 4 if jump > 0.5 else 3 if jump > 0.3 else 1
        if k >= long - 1:
            slow, fast = m[k - long + 1 : k + 1].mean(), m[k - short + 1 : k + 1].mean()
            votes["sma"] = (0 if m[k] > slow * 1.10 else 1) if m[k] > slow and fast > slow else 2 if m[k] > slow * 0.95 else 3
        votes["breadth"] = 1 if breadth[k] >= 0.8 else 2 if breadth[k] >= 0.5 else 3
        if k >= year - 1:
            fall = m[k] / m[k - year + 1 : k + 1].max() - 1
            votes["drawdown"] = 1 if fall > -0.05 else 2 if fall > -0.10 else 3 if fall > -0.20 else 4
        if oas[k] == oas[k]:
            votes["credit"] = 1 if oas[k] < 3.5 else 2 if oas[k] < 5 else 3 if oas[k] < 7 else 4
        votes["curve"] = 1 if curve[k] > 1 else 2 if curve[k] > 0 else 3
        mass = [round(sum(EIGHT[s] for s, g in votes.items() if g == grade), 6) for grade in range(5)]
        winner = mass.index(max(mass))
        if k >= 5:
            week = m[k] / m[k - 5] - 1
            winner = max(winner, 3) if week < -0.05 else winner
            winner = 4 if week < -0.10 else winner
        assert got[k] == SEVERITY[4 if v == v and v > 40 else winner], k


def test_tilt_filter_and_leverage_follow_the_rules(spark):
    from tessera.operators import portfolio as P

    day = dt.date(2024, 1, 1)
    scores = {"a": 0.9, "b": 0.2, "c": 0.1, "d": 0.01}
    df = spark.createDataFrame([(day, t, s) for t, s in scores.items()], "date date, ticker string, score double")
    live = {t: s for t, s in scores.items() if s > 0.05}
    w = {t: min(s / sum(live.values()) * 0.3, 0.10) for t, s in live.items()}
    w = {t: x / sum(w.values()) * 0.3 for t, x in w.items()}
    assert {r.ticker: round(r.weight, 9) for r in P.alpha_tilt(df).collect()} == {t: round(x, 9) for t, x in w.items()}

    book = [("a", 0.5, "equity"), ("b", 0.4, "fixed_income"), ("c", -0.1, "equity")]
    df = spark.createDataFrame([(day, *b) for b in book], "date date, ticker string, weight double, asset_class string")
    for above, label, up, bond, cash in ((True, "CALM", 1.15, 0.85, 0.10), (False, "CRISIS", 0.80, 1.20, 0.30), (True, "CRISIS", 1, 1, 0.30)):
        moved = {"a": 0.5 * up, "b": 0.4 * bond, "c": -0.1}
        total = moved["a"] + moved["b"]
        want = {t: x * (1 - cash) / total if x > 0 and total > 1 - cash else x for t, x in moved.items()}
        trend = spark.createDataFrame([(day, above, label)], "date date, above boolean, label string")
        assert {r.ticker: round(r.weight, 9) for r in P.trend_filter(df, trend).collect()} == {t: round(x, 9) for t, x in want.items()}

    book = {"a": (0.6, 3.0), "b": (0.5, 1.0), "c": (0.3, 3.0), "d": (0.004, 1.0)}
    df = spark.createDataFrame([(day, t, *x) for t, x in book.items()], "date date, ticker string, weight double, lev double")
    w = {t: min(x, 0.35) for t, (x, _) in book.items() if x > 0.005}
    used = sum(book[t][1] * x for t, x in w.items())
    w = {t: x * 1.5 / used if used > 1.5 and book[t][1] > 1 else x for t, x in w.items()}
    w = {t: x / max(1.0, sum(w.values())) for t, x in w.items()}
    assert {r.ticker: round(r.weight, 9) for r in P.leverage_budget(df, 1.5).collect()} == {t: round(x, 9) for t, x in w.items()}


def test_walk_equals_the_day_loop(spark):
    import numpy as np

    from tessera.operators import metrics as M

    rng = np.random.default_rng(2)
    n, warm, every, names = 30, 5, 4, ["a", "b", "c"]
    r = rng.normal(0, 0.1, (n, 3))
    r[9, 0], r[12, 1] = -1.0, np.nan
    plan = {p: rng.normal(0, 0.4, 3) for p in range((n - 1 - warm - 1) // every + 1)}
    returns = spark.createDataFrame([(t, i, dt.date(2024, 1, 1) + dt.timedelta(i), None if r[i, k] != r[i, k] else float(r[i, k])) for i in range(n) for k, t in enumerate(names)], "ticker string, i int, date date, r double")
    targets = spark.createDataFrame([("x", p, t, float(w[k])) for p, w in plan.items() for k, t in enumerate(names)], "config string, period int, ticker string, weight double")
    daily, ends = M.drifted_returns(targets, returns, every, warm)
    trades = M.traded(targets, ends)
    got = {row.i: row for row in M.net_returns(daily, trades, 5.0).collect()}
    held, total, gross, net = np.zeros(3), 0.0, [], []
    for i in range(warm, n - 1):
        cost = 0.0
        if (i - warm) % every == 0:
            new = plan[(i - warm) // every]
            cost, held = np.abs(new - held).sum() * 5 / 1e4, new
            total += cost * 1e4 / 5
        move = np.nan_to_num(r[i + 1])
        g = (held * move).sum()
        held = held * (1 + move) / (1 + g)
        gross.append(np.abs(held).sum())
        net.append(held.sum())
        assert abs(got[i + 1].ret - (g - cost)) < 1e-9
    row = M.turnover_summary(daily, trades).first()
    years = len(gross) / 252
    assert np.allclose([row.turnover, row.gross, row.net], [total / years / 2, np.mean(gross), np.mean(net)])


def test_long_short_sector_limit(spark):
    from tessera.operators import portfolio as P

    day = dt.date(2024, 1, 1)
    rows = [(day, f"t{k:02d}", 20.0, 1.0 - k / 100, 0.0, "s0" if k < 6 else f"s{k % 3}") for k in range(30)]
    df = spark.createDataFrame(rows, "date date, ticker string, px double, mom double, alpha double, sector string")
    free = {r.ticker for r in P.long_short_engine(df, 5, 5).where("weight > 0").collect()}
    held = [r.sector for r in P.long_short_engine(df, 5, 5, most=2).where("weight > 0").collect()]
    assert free == {"t00", "t01", "t02", "t03", "t04"} and len(held) == 5 and max(held.count(s) for s in set(held)) == 2
