"""Keyed streaming state: lifetimes and restarts."""

from __future__ import annotations

import datetime as dt
import time

import numpy as np

from tessera.operators.regime import CAUTIOUS, step
from tessera.sources.tables import shared_folder
from tessera.streaming import jobs as ST

T0 = dt.datetime(2022, 1, 1)
VOTES = "market string, ts timestamp, event_id long, trend int, vol int, credit int"


def votes(first, n, markets=("m1", "m2")):
    rng = np.random.default_rng(first + 1)
    return [(m, T0 + dt.timedelta(hours=first + k), first + k, *(None if v == 2 else int(v) for v in rng.integers(-1, 3, 3))) for k in range(n) for m in markets]


def folded(rows):
    held, out = {}, {}
    for m, ts, i, *v in sorted(rows, key=lambda r: (r[1], r[2])):
        *state, confidence = step(tuple(held.get(m, (CAUTIOUS, 0, 0))), v)
        held[m] = state
        out[m, i] = (*state, confidence)
    return out


def add(spark, rows, source):
    spark.createDataFrame(rows, VOTES).coalesce(1).write.mode("append").parquet(source)


def result(spark, source, path, **more):
    stream = spark.readStream.schema(VOTES).option("maxFilesPerTrigger", 1).parquet(source)
    return {(r.market, r.event_id): (r.regime, r.bullish, r.bearish, r.confidence) for r in ST.finished(ST.regime_stream(stream, **more), path=path).collect()}


def test_restart_goes_on_from_the_checkpoint(spark):
    source, path = shared_folder(spark), shared_folder(spark)
    one, two = votes(0, 15), votes(15, 15)
    add(spark, one, source)
    assert result(spark, source, path) == folded(one)
    add(spark, two, source)
    assert result(spark, source, path) == folded(one + two)


def test_a_dead_key_begins_anew(spark):
    source, path = shared_folder(spark), shared_folder(spark)
    # votes that lead to CRISIS: two bearish days in a row
    bad = [("m1", T0 + dt.timedelta(hours=k), k, -1, -1, -1) for k in range(3)]
    add(spark, bad, source)
    assert result(spark, source, path, lifetime_ms=1500)["m1", 2][0] == "CRISIS"
    time.sleep(3)
    add(spark, [("m1", T0 + dt.timedelta(hours=9), 9, 0, 0, 0)], source)
    assert result(spark, source, path, lifetime_ms=1500)["m1", 9][:3] == (CAUTIOUS, 0, 0)


def test_corrections_follow_their_dates(spark):
    rows = [(f"k{k % 3}", T0 + dt.timedelta(days=k), (T0 + dt.timedelta(days=k)).date(), k, float(k)) for k in range(90)]
    schema = "key string, ts timestamp, date date, event_id long, value double"
    source = shared_folder(spark)
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    late = [(k, ts, d, i + 1000, v + 0.5) for k, ts, d, i, v in rows[40:45]]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = {(r.key, r.date): r.value for r in ST.corrected_bars(stream, ["key", "date"], ["ts", "event_id"]).collect()}
    assert got == {(k, d): v for k, _, d, _, v in rows} | {(k, d): v for k, _, d, _, v in late}


def test_peaks_go_on_over_batches_and_missing_values(spark):
    source = shared_folder(spark)
    schema = "ts timestamp, event_id long, key string, value double"
    values = [None, 2.0, None, 1.0, 3.0, None, 2.5]
    for at in (slice(0, 1), slice(1, 4), slice(4, 7)):
        rows = [(T0 + dt.timedelta(hours=k), k, "k", values[k]) for k in range(7)[at]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    got = {r.event_id: (r.peak, r.drawdown) for r in ST.finished(ST.drawdown_stream(stream)).collect()}
    assert got == {0: (None, None), 1: (2.0, 0.0), 2: (2.0, None), 3: (2.0, -0.5), 4: (3.0, 0.0), 5: (3.0, None), 6: (3.0, 2.5 / 3 - 1)}
