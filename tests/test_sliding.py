"""Sliding figures against frames, on series that differences of running sums get wrong."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import sliding as W

N = 21


@pytest.fixture(scope="module")
def prices(spark):
    rng = np.random.default_rng(2)
    rows = []
    series = {
        "outlier": rng.normal(0, 0.01, 300), "nan": rng.normal(0, 0.01, 300), "fall": np.geomspace(1e5, 2, 150).tolist() + (2 + rng.normal(0, 1e-3, 200)).tolist(),
        "flat": [5.0] * 90, "gaps": rng.normal(3, 1, 200), "short": [1.0, 2.0], "big": 1e9 + rng.normal(0, 1, 400), "infinite": rng.normal(0, 1, 120),
    }
    for name, values in series.items():
        for k, v in enumerate(values):
            v = {("outlier", 3): 1e8, ("nan", 40): math.nan, ("infinite", 30): math.inf}.get((name, k), float(v))
            gone = name == "gaps" and rng.random() < 0.3
            rows.append((name, k, None if gone else v, None if name == "gaps" and k % 11 == 0 else float(rng.normal(0, 0.02) + (v if abs(v) < 10 else 0)), k))
    return spark.createDataFrame(rows, "ticker string, date int, x double, y double, tag int").repartition(3).cache()


ROLLS = {
    "m": W.avg("x", N), "s": W.sd("x", N), "t": W.total("x", 5), "some": W.sd("x", N, 10), "k": W.skew("x", 30), "hi": W.high("x", N), "lo": W.low("x", N),
    "b": W.beta("x", "y", N), "c": W.corr("x", "y", 40), "res": W.residual("x", "y", 10), "sres": W.sd("res", 7), "one": W.avg("x", 1),
}


def frames(df):
    def w(n):
        return Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - n, 0)

    pair = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)
    px, py = F.when(pair == 1, F.col("x")), F.when(pair == 1, F.col("y"))
    full = lambda c, n, agg, least=None: F.when(F.count(c).over(w(n)) >= (least or n), agg.over(w(n)))
    slope = lambda n: full(pair, n, F.covar_samp(px, py)) / F.when(F.var_samp(py).over(w(n)) != 0, F.var_samp(py).over(w(n)))
    df = df.withColumns({
        "m": full("x", N, F.avg("x")), "s": full("x", N, F.stddev_samp("x")), "t": full("x", 5, F.sum("x")), "some": full("x", N, F.stddev_samp("x"), 10),
        "k": full("x", 30, F.skewness("x")), "hi": full("x", N, F.max("x")), "lo": full("x", N, F.min("x")), "b": slope(N),
        "c": full(pair, 40, F.covar_samp(px, py)) / F.nullif(F.stddev_samp(px).over(w(40)) * F.stddev_samp(py).over(w(40)), F.lit(0.0)), "res": F.col("x") - slope(10) * F.col("y"), "one": F.col("x"),
    })
    return df.withColumn("sres", full("res", 7, F.stddev_samp("res")))


@pytest.mark.parametrize(("split", "rows"), [(None, 65_536), (None, 64), (50, 65_536), (7, 30)])
def test_equal_to_frames(spark, prices, split, rows):
    got = {(r.ticker, r.date): r for r in W.sliding(prices, ROLLS, split=split, rows=rows).collect()}
    want = frames(prices).collect()
    assert len(got) == len(want)
    for r in want:
        g = got[r.ticker, r.date]
        assert g.tag == r.tag
        for name in ROLLS:
            a, b = g[name], r[name]
            if r.ticker == "flat" and name in ("k", "c"):
                assert a is None  # no deviation, no value
                continue
            assert (a is None) == (b is None), (r.ticker, r.date, name, a, b)
            if a is not None and not (math.isnan(a) and math.isnan(b)):
                # frames themselves lose digits where 1e8 stands beside 0.01
                loose = 1e-4 if r.ticker == "big" else 1e-6 if r.ticker == "outlier" and r.date < 60 else 1e-9
                if r.ticker == "infinite" and name in ("s", "some", "k", "b", "c", "res", "sres", "m", "t"):
                    assert math.isfinite(a) == math.isfinite(b)
                    continue
                assert a == pytest.approx(b, rel=loose, abs=loose), (r.ticker, r.date, name)


def test_nothing_is_left_of_an_outlier(spark, prices):
    got = {(r.ticker, r.date): r.s for r in W.sliding(prices, {"s": W.sd("x", N)}).collect()}
    assert all(0.004 < got["outlier", k] < 0.02 for k in range(24, 300)) and all(0.004 < got["nan", k] < 0.02 for k in range(61, 300))
    assert all(1e-4 < got["fall", k] < 2e-3 for k in range(175, 350)) and set(got["flat", k] for k in range(20, 90)) == {0.0}


def test_one_shuffle_and_split_tasks(spark):
    long = spark.range(200_000).selectExpr("'a' AS ticker", "id AS date", "sin(id) AS x")
    cut = W.sliding(long, {"m": W.avg("x", 252)}, split=10_000)
    assert cut.groupBy(F.spark_partition_id()).count().count() > 1
    assert W.sliding(long, {"m": W.avg("x", 252)}).join(cut.withColumnRenamed("m", "z"), ["ticker", "date"]).where("abs(m - z) > 1e-12 or (m is null) <> (z is null)").count() == 0
    plan = W.sliding(long.repartition("ticker"), {"m": W.avg("x", 5)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and "MapInArrow" in plan


def test_user_function_over_pieces(spark, prices):
    """A numpy function that no SQL aggregate has, over whole and cut series."""
    spread = lambda w: np.median(np.abs(w - np.median(w, axis=1, keepdims=True)), axis=1)
    got = {}
    for split in (None, 13):
        got[split] = {(r.ticker, r.date): r.mad for r in W.sliding(prices, {"mad": W.user("x", 9, spread)}, split=split, rows=40).collect()}
    assert got[None].keys() == got[13].keys() and str(sorted(got[None].items())) == str(sorted(got[13].items()))
    rows = sorted((r.date, r.x) for r in prices.where("ticker = 'gaps'").collect())
    for k, (date, _) in enumerate(rows):
        window = [v for _, v in rows[max(0, k - 8) : k + 1]]
        want = None if len(window) < 9 or None in window else float(np.median(np.abs(np.array(window) - np.median(window))))
        assert got[None]["gaps", date] == want
