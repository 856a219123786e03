"""Ranges of a large key against windows over the whole key."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import ranges
from tessera.functions.windows import average_rank
from tessera.operators.features import quintile
from tessera.operators.joins import asof
from tessera.sources.tables import stored

DAY = dt.date(2020, 1, 1)


def days(n):
    return DAY + dt.timedelta(days=int(n))


@pytest.mark.parametrize("unit", ["month", "year", "week"])
def test_running_figures(spark, unit):
    rng = np.random.default_rng(4)
    rows = [(k, days(t), None if rng.random() < 0.1 else float(v)) for k in ("a", "b", None) for t, v in zip(rng.choice(900, 200, replace=False), rng.normal(0, 0.02, 200))]
    df = spark.createDataFrame(rows, "key string, date date, x double").repartition(3)
    kinds = {"p": ("product", 1 + F.coalesce("x", F.lit(0.0))), "s": ("sum", F.col("x")), "hi": ("max", F.col("x")), "lo": ("min", F.col("x"))}
    w = Window.partitionBy("key").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    want = {(r.key, r.date): r for r in df.select("key", "date", F.product(1 + F.coalesce("x", F.lit(0.0))).over(w).alias("p"), F.sum("x").over(w).alias("s"), F.max("x").over(w).alias("hi"), F.min("x").over(w).alias("lo")).collect()}
    got = ranges.running(df, kinds, ["key"], "date", unit).collect()
    assert len(got) == len(rows)
    for r in got:
        for n in kinds:
            w = want[r.key, r.date][n]
            assert r[n] == (None if w is None else pytest.approx(w, rel=1e-12)), (r.key, r.date, n)


@pytest.mark.parametrize("by", [["k"], []])
def test_asof_equals_merge_asof(spark, by):
    rng = np.random.default_rng(7)
    left = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 400), "date": rng.integers(0, 1500, 400), "m": np.arange(400)})
    right = pd.DataFrame({"k": rng.choice(["a", "b"], 60), "date": rng.choice(1500, 60, replace=False), "value": rng.normal(size=60)})
    if not by:
        left, right = left.drop(columns="k"), right.drop(columns="k")
    want = pd.merge_asof(left.sort_values("date"), right.sort_values("date"), on="date", by=by or None)
    to = lambda p: spark.createDataFrame(p.assign(date=[days(t) for t in p["date"]])).repartition(3)
    got = asof(to(left), to(right), "date", ["value"], by).toPandas()
    a = got.sort_values("m").value.to_numpy(dtype=float)
    assert np.allclose(a, want.sort_values("m").value.to_numpy(dtype=float), equal_nan=True) and len(got) == 400


def test_asof_nulls(spark):
    left = spark.createDataFrame([("a", DAY, 1), (None, DAY, 2), ("a", None, 3), ("z", DAY, 4)], "k string, date date, m int")
    right = spark.createDataFrame([("a", days(-400), 5.0), (None, days(-1), 6.0), ("a", None, 7.0), ("a", days(-40), None)], "k string, date date, value double")
    got = {r.m: r.value for r in asof(left, right, "date", ["value"], ["k"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None}  # the latest row of `a` has no value
    right = right.where("value is not null")
    assert {r.m: r.value for r in asof(left, right, "date", ["value"], ["k"]).collect()} == {1: 5.0, 2: None, 3: None, 4: None}


def test_ranks_of_a_large_date(spark):
    """One date of 400,000 names with ties, nulls and one value that a third of them share, beside small dates."""
    big = spark.range(400_000).selectExpr("'d1' AS date", "id AS name", "CASE WHEN id % 3 = 0 THEN 7.0D WHEN id % 50 = 1 THEN NULL ELSE CAST(hash(id) % 90000 AS DOUBLE) / 7 END AS x")
    small = spark.createDataFrame([("d2", 1, 3.0), ("d2", 2, 3.0), ("d2", 3, -1.0), ("d3", 4, None), ("d4", 5, float("nan")), ("d4", 6, 1.0)], "date string, name long, x double")
    df = big.unionByName(small)
    got = ranges.ranked(df, "x", ["date"], stored)
    want = df.select("date", "name", average_rank("x", ["date"]).alias("w"), F.when(F.col("x").isNotNull(), F.count("x").over(Window.partitionBy("date"))).alias("n"))
    assert got.join(want, ["date", "name"]).where("not (rank <=> w) or not (held <=> n)").count() == 0 and got.count() == df.count()


def test_quintiles_equal_interpolated_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{d}", k, None if v > 2 else round(float(v), 1)) for d, n in enumerate((1, 4, 5, 333)) for k, v in enumerate(rng.normal(size=n))]
    got = quintile(spark.createDataFrame(rows, "date string, name int, x double"), "x").toPandas()
    for d, g in got.groupby("date"):
        x = g.x.dropna()
        edges = np.quantile(x, [0.2, 0.4, 0.6, 0.8]) if len(x) else []
        for r in g.itertuples():
            assert (np.isnan(r.x) and (r.quintile is None or np.isnan(r.quintile))) or r.quintile == 1 + sum(r.x > e for e in edges)
