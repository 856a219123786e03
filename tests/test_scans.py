"""Recursions over chunks against the plain fold."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions.scans import affine_scan
from tessera.operators.features import recursive_features


def test_scan_equals_fold(spark):
    rng = np.random.default_rng(3)
    series = {k: rng.normal(1, 5, n) for k, n in {"a": 1, "b": 6, "c": 7, "d": 8, "e": 400, "f": 49}.items()}
    rows = [(k, t, None if k == "e" and t % 13 == 4 else float(v)) for k, s in series.items() for t, v in enumerate(s)]
    df = spark.createDataFrame(rows, "ticker string, date int, b double").repartition(3)
    decays = {"slow": 0.999, "ema": 11 / 13, "half": 0.5, "fast": 1e-4, "tiny": 1e-20, "none": 0.0}
    for chunk in (7, 64, 2048):
        got = {(r.ticker, r.date): r for r in affine_scan(df, {n: ("b", d) for n, d in decays.items()}, chunk=chunk).collect()}
        assert len(got) == len(rows)
        for n, d in decays.items():
            for k in series:
                y = 0.0
                for t in range(len(series[k])):
                    b = next(v for x, i, v in rows if (x, i) == (k, t)) if k != "e" else (None if t % 13 == 4 else float(series[k][t]))
                    y = d * y + (b or 0.0)
                    assert got[k, t][n] == pytest.approx(y, rel=1e-9, abs=1e-9), (n, k, t, chunk)


def fold(p: pd.Series):
    """RSI, MACD and its signal the plain way."""
    step = p.diff().fillna(0.0)
    sides = []
    for x in (step.clip(lower=0), (-step).clip(lower=0)):
        seeded = x.copy()
        seeded.iloc[:13] = np.nan
        if len(x) > 13:
            seeded.iloc[13] = x.iloc[:14].mean()
        sides.append(seeded.ewm(alpha=1 / 14, adjust=False).mean())
    with np.errstate(all="ignore"):
        rsi = 100 - 100 / (1 + sides[0] / sides[1])
    macd = p.ewm(span=12, adjust=False).mean() - p.ewm(span=26, adjust=False).mean()
    return rsi, macd, macd.ewm(span=9, adjust=False).mean()


@pytest.mark.parametrize("chunk", [7, 2048])
def test_rsi_and_macd_equal_the_fold(spark, chunk):
    rng = np.random.default_rng(8)
    paths = {"w": 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 300))), "up": np.arange(1.0, 40), "flat": np.full(30, 5.0), "short": np.array([3.0, 4.0])}
    df = spark.createDataFrame([(k, t, float(v)) for k, p in paths.items() for t, v in enumerate(p)], "ticker string, date int, px double")
    got = recursive_features(df, chunk).toPandas()
    for k, p in paths.items():
        g = got[got.ticker == k].sort_values("date")
        rsi, macd, signal = fold(pd.Series(p))
        assert np.allclose(g.rsi.to_numpy(dtype=float), rsi, rtol=1e-9, equal_nan=True)
        assert np.allclose(g.macd, macd, rtol=1e-9, atol=1e-9) and np.allclose(g.macd_signal, signal, rtol=1e-9, atol=1e-9) and np.allclose(g.macd_hist, macd - signal, atol=1e-9)


def test_a_long_ticker_runs_in_several_tasks(spark):
    long = spark.range(1_000_000).selectExpr("'x' AS ticker", "id AS date", "CAST(id % 1000 AS DOUBLE) AS b")
    merge = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merge)
    spark.conf.set(merge, "false")  # the rows of the test are few bytes
    try:
        out = affine_scan(long, {"y": ("b", 25 / 27)})
        parts = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set(merge, before)
    assert len(parts) > 1 and max(r["count"] for r in parts) < 600_000
    y = 0.0
    for t in range(997_000, 1_000_000):
        y = 25 / 27 * y + t % 1000
    assert out.where("date = 999999").first().y == pytest.approx(y, rel=1e-12)
