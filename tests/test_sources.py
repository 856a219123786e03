"""Partitioned upserts and the intake of CSV and JSON lines."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from tessera.operators import ingest
from tessera.sources import tables as T
from tessera.sources.intake import read_csv, read_json
from tessera.sources.store import Store

DAY = dt.date(2021, 1, 5)
SCHEMA = "ticker string, date date, px double"


def rows(spark, *items):
    return spark.createDataFrame([(t, None if d is None else DAY + dt.timedelta(days=d), p) for t, d, p in items], SCHEMA)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{path}/rows") for f in names if f.endswith(".parquet")}


def local(store):
    return store.path.removeprefix("file:")


def test_upsert_touches_only_its_months(spark):
    first = rows(spark, *((t, d, 1.0) for t in "ab" for d in range(0, 150, 10)), ("c", None, 9.0))
    store = Store.new(first, ["ticker", "date"])
    assert store.read().count() == 0
    assert len(store.upsert(first, 0)) == 6  # five months, and the rows without a date
    before = files(local(store))
    touched = store.upsert(rows(spark, ("a", 40, 2.0), ("a", 40, 3.0), ("z", 45, 5.0)), 1, order=["px"])
    assert touched == ["2021-02"]
    after = files(local(store))
    kept = {f for f in before if "_part=2021-02" not in f}
    assert kept == {f for f in after if "_part=2021-02" not in f} and all(before[f] == after[f] for f in kept)
    got = {(r.ticker, r.date): r.px for r in store.read().collect()}
    assert len(got) == 32 and got["a", DAY + dt.timedelta(days=40)] == 3.0 and got["z", DAY + dt.timedelta(days=45)] == 5.0 and got["c", None] == 9.0


def test_a_repeated_batch_changes_nothing(spark):
    store = Store.new(rows(spark), ["ticker", "date"])
    store.upsert(rows(spark, ("a", 0, 1.0)), 7)
    store.upsert(rows(spark, ("a", 0, 2.0)), 8)
    before = files(local(store))
    assert store.upsert(rows(spark, ("a", 0, 1.0)), 7) == [] and files(local(store)) == before
    assert [tuple(r) for r in store.read().collect()] == [("a", DAY, 2.0)]
    # an id without a ledger entry is applied again with the same result
    store.upsert(rows(spark, ("a", 0, 2.0)), 9)
    assert [tuple(r) for r in store.read().collect()] == [("a", DAY, 2.0)]
    assert store.upsert(rows(spark), 10) == [] and store.read().count() == 1


def test_csv_sides_add_up(spark, tmp_path):
    lines = ["a,2021-01-05,1.5,10", "b,2021-01-06,n/a,10", "c,2021-01-07,2.5", "d,2021-01-08,3.5,10,extra", ",2021-01-09,4.5,10", "e,,5.5,10", '"q,uoted",2021-01-10,6.5,', "f,2021-13-40,1.0,1"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    good, bad = read_csv(spark, str(tmp_path / "in.csv"), "ticker string, date date, close double, volume bigint", ["ticker", "close"])
    assert sorted(r.ticker for r in good.collect()) == ["a", "e", "q,uoted"]
    said = {r.line: r.reason for r in bad.collect()}
    assert len(said) == 5 and said[lines[1]] == said[lines[2]] == said[lines[3]] == said[lines[7]] == "malformed" and "missing: ticker" in said.values()
    assert good.count() + bad.count() == len(lines)


def test_json_lines(spark, tmp_path):
    (tmp_path / "in.json").write_text('{"ticker": "a", "close": 1.5}\n{"ticker": "b", "close": "x"}\n{"ticker": "c"\n{"close": 2.0}\n{"ticker": "d", "close": 2.0, "more": 1}\n')
    good, bad = read_json(spark, str(tmp_path), "ticker string, close double", ["ticker"])
    assert sorted(r.ticker for r in good.collect()) == ["a", "d"] and sorted(r.reason for r in bad.collect()) == ["malformed", "malformed", "missing: ticker"]
    assert all(r.file.endswith("in.json") for r in bad.collect())


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_text("")
    good, bad = read_csv(spark, str(tmp_path / "none.csv"), "a string")
    assert good.count() == 0 and bad.count() == 0


def test_details_nest_and_keep_own_columns(spark):
    df = spark.createDataFrame([(1, "a", None, "mine"), (2, None, 4, "mine"), (None, 'q"uote', 5, None)], "k int, name string, weight int, _d string")
    rows = ingest.encode_detail(df, ["k", F.array(F.struct("name", "weight")).alias("used"), F.create_map(F.lit("by"), F.struct("name")).alias("votes")])
    assert rows.first().detail == '{"k":1,"used":[{"name":"a","weight":null}],"votes":{"by":{"name":"a"}}}'
    back = ingest.decode_detail(rows, "k int, used array<struct<name: string, weight: int>>, votes map<string, struct<name: string>>, missing string")
    assert back.columns == ["k", "name", "weight", "_d", "detail", "detail_k", "used", "votes", "missing"]
    for r in back.collect():
        assert r.detail_k == r.k and r.used[0] == (r["name"], r.weight) and r.votes["by"]["name"] == r["name"] and r.missing is None
    assert {r._d for r in back.collect()} == {"mine", None}
    broken = ingest.decode_detail(spark.createDataFrame([("no json",), (None,)], "detail string"), "k int")
    assert [tuple(r) for r in broken.collect()] == [("no json", None), (None, None)]


def test_upsert_keeps_own_columns(spark):
    old = spark.createDataFrame([("a", 1, 10, 0), ("b", 1, 20, 0)], "ticker string, side int, place int, _s int")
    new = spark.createDataFrame([("b", 2, 30, 7), ("c", 2, 40, 7)], "ticker string, side int, place int, _s int")
    got = ingest.upsert(old, new, ["ticker"])
    assert got.columns == old.columns and sorted(tuple(r) for r in got.collect()) == [("a", 1, 10, 0), ("b", 2, 30, 7), ("c", 2, 40, 7)]


def test_bounded_grid_equals_the_whole_one_within_its_dates(spark):
    """Names that come and go, gaps, a missing price, a name of one day, an empty table."""
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    rows = [("a", day(k), 10.0 + k) for k in range(12) if k not in (5, 8)] + [("b", day(3), None), ("b", day(5), 7.0), ("b", day(8), 8.0), ("c", day(11), 1.0)]
    bars = spark.createDataFrame(rows, "ticker string, date date, px double")
    columns = ["ticker", "date", "i", "px", "pf", "r"]
    whole, bounded = ({(r.ticker, r.i): tuple(r) for r in T.dense(bars, b).select(columns).collect()} for b in (False, True))
    lives = {"a": (0, 11), "b": (3, 8), "c": (11, 11)}
    assert len(whole) == 3 * 12 and set(bounded) == {(t, i) for t, (first, last) in lives.items() for i in range(first, last + 1)}
    assert all(whole[k] == v for k, v in bounded.items())
    assert T.dense(bars.limit(0), True).count() == 0
