"""Risk and metric rules against plain pandas."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tessera.operators import features
from tessera.operators import metrics as M
from tessera.operators import portfolio as P
from tessera.operators import regime
from tessera.operators import risk as R

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(days=7 * k) for k in range(200)]


@pytest.fixture(scope="module")
def world(spark):
    """Returns with gaps, and books of one to eight names."""
    rng = np.random.default_rng(6)
    names = [f"n{k}" for k in range(12)]
    common = rng.normal(0, 0.02, len(DAYS))
    wide = pd.DataFrame({n: 0.5 * common + rng.normal(0, 0.02, len(DAYS)) for n in names}, index=DAYS)
    wide = wide.mask(rng.random(wide.shape) < 0.15)
    wide["n11"] = 0.0  # never moves
    books = {b: dict(zip(rng.choice(names[:11], size, replace=False), rng.normal(0, 0.1, size))) for b, size in enumerate([1, 2, 3, 4, 5, 6, 7, 8])}
    books[8] = {"n11": 0.3, "n1": 0.2}
    books[9] = {"n1": 0.3, "n2": 0.005}
    rows = [(t, d, None if np.isnan(v) else float(v)) for t in wide for d, v in wide[t].items()]
    returns = spark.createDataFrame(rows, "ticker string, date date, r double").repartition(4)
    targets = spark.createDataFrame([(b, t, float(w), f"s{t[-1]}") for b, held in books.items() for t, w in held.items()], "book int, ticker string, weight double, sector string")
    return wide, books, returns, targets


@pytest.mark.parametrize("n", [63, 5])
def test_value_at_risk_and_correlation_take_complete_rows(world, n):
    wide, books, returns, targets = world
    var = {r.book: r.var95 for r in R.value_at_risk(targets, returns, ["book"], n).collect()}
    alike = {r.book: r for r in R.average_correlation(targets, returns, ["book"], n).collect()}
    for b, held in books.items():
        held = {t: w for t, w in held.items() if abs(w) > 0.01}
        if len(held) < 2:
            assert b not in var and b not in alike
            continue
        rows = wide[list(held)].dropna().tail(n)
        w = np.array(list(held.values()))
        if rows.empty:
            assert b not in var
        elif len(rows) == 1:
            assert var[b] is None and alike[b].correlation is None
        else:
            assert var[b] == pytest.approx(np.sqrt(w @ rows.cov().values @ w) * 1.645, rel=1e-9)
            c = rows.corr().values[np.triu_indices(len(held), 1)].mean()
            assert (alike[b].correlation is None and np.isnan(c)) or alike[b].correlation == pytest.approx(c, rel=1e-9)
            assert alike[b].names == len(held) and alike[b].warn == (c > 0.70)


def test_book_figures_do_not_depend_on_tiles(world, monkeypatch):
    """Books and names in many tiles; a wide row of names times days is never shuffled."""
    _, books, returns, targets = world
    figures = lambda: (
        {r.book: r.var95 for r in R.value_at_risk(targets, returns, ["book"]).collect()},
        {r.book: (r.correlation, r.names, r.warn) for r in R.average_correlation(targets, returns, ["book"]).collect()},
    )
    whole = figures()
    monkeypatch.setattr(R, "TILE_ROWS", 5)
    monkeypatch.setattr(R, "TILE_NAMES", 4)
    cut = figures()
    assert set(cut[0]) == set(whole[0]) and len(whole[0]) > 5
    for b in whole[0]:
        assert cut[1][b][1:] == whole[1][b][1:]
        for one, two in ((cut[0][b], whole[0][b]), (cut[1][b][0], whole[1][b][0])):
            assert one is two is None or one == pytest.approx(two, rel=1e-9)


def test_failed_gate_needs_no_halts(spark, world):
    _, books, returns, targets = world
    gate = spark.createDataFrame([(False, "few names")], "ok boolean, errors string")
    weights, verdicts = R.validate(targets, returns.where("1 = 0"), ["book"], gate, None)
    assert weights.count() == 0 and {r.book for r in verdicts.collect()} == set(books)


def test_validation_gates_halts_and_warns(spark, world):
    _, books, returns, targets = world
    halts = spark.createDataFrame([(2, True, "daily_loss,max_drawdown"), (3, False, "")], "book int, halt boolean, tripped string")
    gate = lambda ok, why: spark.createDataFrame([(ok, why)], "ok boolean, errors string")
    weights, verdicts = R.validate(targets, returns, ["book"], gate(True, ""), halts)
    said = {r.book: r for r in verdicts.collect()}
    assert set(said) == set(books) and not said[2].approved and said[2].rejections == "circuit breaker: daily_loss,max_drawdown"
    assert all(said[b].approved and said[b].rejections == "" for b in said if b != 2)
    left = {r.book for r in weights.select("book").distinct().collect()}
    assert 2 not in left and left <= set(books)
    for r in weights.collect():
        assert abs(r.weight) <= R.POSITION_CAP + 1e-12
    for b, held in books.items():
        active = [w for w in held.values() if abs(w) > 0.01]
        assert ("few positions" in said[b].warnings) == (len(active) < 3) and ("position cap" in said[b].warnings) == any(abs(w) > 0.05 for w in held.values())
    weights, verdicts = R.validate(targets, returns, ["book"], gate(False, "stale prices"), halts)
    assert weights.count() == 0 and {(r.approved, r.rejections, r.warnings) for r in verdicts.collect()} == {(False, "stale prices", "")}


def test_ledger_and_monthly_figures(spark):
    rng = np.random.default_rng(1)
    paths = {"up": 100 * np.cumprod(1 + np.abs(rng.normal(0.01, 0.01, 150))), "down": 100 * np.cumprod(1 + rng.normal(-0.01, 0.03, 150)), "mixed": 100 * np.cumprod(1 + rng.normal(0.004, 0.03, 150)), "flat": np.full(150, 7.0)}
    values = spark.createDataFrame([(k, d, float(v)) for k, p in paths.items() for d, v in zip(DAYS, p)], "strategy_id string, date date, value double")
    trades = spark.createDataFrame([("up", 1.5), ("up", 2.0), ("mixed", 4.0)], "strategy_id string, cost double")
    got = {r.strategy_id: r for r in M.ledger_metrics(values, trades=trades).collect()}
    months = {r.strategy_id: r for r in M.win_loss(M.period_returns(values)).collect()}
    for k, p in paths.items():
        s = pd.Series(p, index=pd.to_datetime(DAYS[:150]))
        r = s.pct_change().dropna()
        ann = (s.iloc[-1] / s.iloc[0]) ** (365.25 / (s.index[-1] - s.index[0]).days) - 1
        vol, falls = r.std() * np.sqrt(252), r[r < 0]
        low = falls.std() * np.sqrt(252) if len(falls) else vol
        dd = (s / s.cummax() - 1).min()
        want = [s.iloc[0], s.iloc[-1], s.iloc[-1] / s.iloc[0] - 1, ann, (ann - 0.04) / vol if vol > 0 else 0, (ann - 0.04) / low if low > 0 else 0, abs(ann / dd) if dd else 0, dd]
        g = got[k]
        assert [g.start_value, g.end_value, g.total_return, g.cagr, g.sharpe, g.sortino, g.calmar, g.max_drawdown] == pytest.approx(want, rel=1e-9, abs=1e-12)
        assert (g.trades, g.costs) == {"up": (2, 3.5), "mixed": (1, 4.0)}.get(k, (0, 0.0))
        m = s.resample("ME").last().pct_change().dropna()
        win, loss = m[m > 0].mean() if (m > 0).any() else 0, m[m < 0].mean() if (m < 0).any() else 0
        assert months[k].win_rate == pytest.approx((m > 0).mean())
        assert months[k].profit_factor == (pytest.approx(abs(win / loss)) if loss else None)


def test_benchmark_beside_a_strategy(spark):
    daily = spark.createDataFrame([("a", d, 0.01) for d in DAYS[:50]], "strategy_id string, date date, ret double")
    bench = spark.createDataFrame([(d, None if k == 0 else 0.002 * k) for k, d in enumerate(DAYS)], "date date, rm double")
    want = np.prod([1 + 0.002 * k for k in range(50)]) ** (252 / 50) - 1
    assert M.benchmark_cagr(daily, bench).first().benchmark_cagr == pytest.approx(want)


def test_score_weights_keep_cash(spark):
    rng = np.random.default_rng(9)
    rows = [(f"d{d}", f"t{k}", float(v)) for d, scale in enumerate((1.0, 5.0)) for k, v in enumerate(rng.normal(0.5, scale, 14))]
    got = {(r.date, r.ticker): r.weight for r in P.score_weights(spark.createDataFrame(rows, "date string, ticker string, score double")).collect()}
    for d in ("d0", "d1"):
        s = pd.Series({t: v for x, t, v in rows if x == d}).sort_values(ascending=False)
        s = s[s > 0].head(10)
        w = (s / s.sum() * 0.95).clip(upper=0.15)
        w = w / w.sum() * 0.95 if w.sum() > 0.95 else w
        assert {t: got[d, t] for t in w.index} == pytest.approx(w.to_dict()) and sum(1 for x, _ in got if x == d) == len(w)


def test_blends_and_costs_have_the_whole_table(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0.001, 0.01, 120), rng.normal(0.0005, 0.01, 120)
    frame = lambda v: spark.createDataFrame([(d, float(x)) for d, x in zip(DAYS, v)], "date date, ret double")
    got = {r.share: r for r in M.blends(frame(a), frame(b)).collect()}
    assert set(got) == {1.0, 0.7, 0.6, 0.5, 0.0}
    for share, r in got.items():
        x = pd.Series(share * a + (1 - share) * b)
        curve = (1 + x).cumprod()
        assert r.cagr == pytest.approx(curve.iloc[-1] ** (252 / 120) - 1) and r.max_drawdown == pytest.approx((curve / curve.cummax() - 1).min())
        assert r.sharpe == pytest.approx(round(x.mean() / x.std() * np.sqrt(252), 2)) and r.corr == pytest.approx(round(np.corrcoef(a, b)[0, 1], 2))


def test_regimes_of_a_walk_pair_with_the_next_return(spark):
    rng = np.random.default_rng(12)
    days, rets = pd.date_range("2020-01-01", periods=90), rng.normal(0, 0.01, (2, 90))
    stance = ["ACTIVE" if i < 40 else "CRISIS" if i < 60 else "CAUTIOUS" for i in range(90)]
    calendar = spark.createDataFrame([(d.date(), i) for i, d in enumerate(days)], "date date, i int")
    path = spark.createDataFrame([(d.date(), stance[i]) for i, d in enumerate(days)], "date date, regime string")
    net = spark.createDataFrame([(c, i, float(rets[k, i])) for k, c in enumerate("xy") for i in range(1, 90)], "config string, i int, ret double")
    got = {(r.config, r.regime): (r.share, r.sharpe) for r in regime.walk_occupancy(net, path, calendar).collect()}
    for k, c in enumerate("xy"):
        frame = pd.DataFrame({"ret": rets[k, 1:], "regime": stance[:-1]})  # the loop: decide at i, earn at i + 1
        for name, g in frame.groupby("regime"):
            share, sharpe = got[c, name]
            assert abs(share - len(g) / 89) < 1e-12 and abs(sharpe - g.ret.mean() / g.ret.std() * 252**0.5) < 1e-9


def test_volume_ratio_is_rounded_once(spark):
    """A mean of whole numbers is their exact sum over 21, to the last bit."""
    rng = np.random.default_rng(8)
    volume = rng.integers(1, 51, 400).tolist()
    days = [dt.date(2000, 1, 3) + dt.timedelta(days=7 * k) for k in range(400)]
    own = spark.createDataFrame([("a", d, v) for d, v in zip(days, volume)], "ticker string, date date, volume long")
    got = [r.ratio for r in features.volume_ratio(own).orderBy("date").collect()]
    assert got == [None] * 20 + [volume[k] / (sum(volume[k - 20 : k + 1]) / 21) for k in range(20, 400)]
