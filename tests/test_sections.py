"""Ranks inside cross-sections by numpy, against window functions; plans that don't hold a sort a column."""

from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.sections import both_ends, percentile_ranks, rank_correlations
from tessera.functions.windows import average_rank, percentile_rank, series
from tessera.operators import league, portfolio, signals, walkforward
from tessera.sources import tables

NAN = float("nan")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted((tuple("nan" if v != v else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=repr)


def scores(spark, n=80):
    rng = random.Random(4)
    value = lambda: rng.choice([None, NAN, 0.0, -0.0, 1.0, 2.0, rng.random(), rng.random()])
    rows = [(f"T{k}", dt.date(2024, 1, 1 + d), d, value(), value(), rng.choice([None, rng.random(), 0.5])) for d in range(3) for k in range(n)]
    rows += [("T0", dt.date(2024, 1, 9), 8, None, None, None), ("T1", dt.date(2024, 1, 9), 8, 1.0, None, 0.1)]
    return spark.createDataFrame(rows, "ticker string, date date, i int, a double, b double, y double")


def bars(spark, names=6, weeks=230):
    rng = random.Random(1)
    rows = [(f"T{k}", dt.date(2020, 1, 6) + dt.timedelta(weeks=i), 10.0 + rng.random(), 5) for k in range(names) for i in range(weeks) if rng.random() < 0.8]
    return spark.createDataFrame(rows, "ticker string, date date, px double, volume long")


def test_percentile_ranks_equal_windows(spark):
    df = scores(spark)
    want = df.select("ticker", "date", "i", percentile_rank("a").alias("a"), percentile_rank("b").alias("b"), "y")
    assert rows_of(percentile_ranks(df, ["a", "b"])) == rows_of(want)
    assert percentile_ranks(df.limit(0), ["a", "b"]).count() == 0


def test_composite_alpha_sorts_a_date_once(spark):
    """every ranked column had sorts of its own in the stage of the dates."""
    text = plan(signals.composite_alpha(tables.dense(bars(spark))))
    assert "ArrowEval" not in text and "FlatMapGroupsInArrow" in text
    assert not re.search(r"Window .*\], \[date#\d+[\],]", text)  # no window over the rows of a date


def test_panel_is_filled_without_a_join_of_the_grid(spark):
    """F7 and all queries on the panel: as the join of all tickers and dates gives it, NULL keys and prices included."""
    known = bars(spark).unionByName(spark.createDataFrame([(None, dt.date(2020, 1, 6), 1.0, 1), ("T0", None, 2.0, 2), ("T9", dt.date(2020, 2, 3), None, 3), ("T9", dt.date(2020, 3, 2), 0.0, 4)], bars(spark).schema))
    days = tables.calendar(known)
    grid = known.select("ticker").distinct().crossJoin(days).join(known, ["ticker", "date"], "left")
    want = grid.withColumn("pf", F.last("px", ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("pf").over(series())
    want = want.withColumn("r", F.col("pf") / F.when(before != 0, before) - 1)
    got = tables.dense(known)
    assert got.columns == want.columns and rows_of(got) == rows_of(want)
    assert "SortMergeJoin" not in plan(got) and rows_of(tables.dense(known, days=days)) == rows_of(want)


def test_members_equal_windows(spark):
    """Both ends of a date from one order, without sorts of all signals' rows."""
    df, keys = scores(spark), Window.partitionBy("signal", "i")
    tall = df.unpivot(["ticker", "i"], ["a", "b"], "signal", "score").where(F.col("score").isNotNull())
    tall = tall.withColumn("n", F.count(F.lit(1)).over(keys)).where("n >= 5").withColumn("q", F.greatest(F.floor(F.col("n") * 0.2), F.lit(2)))
    top = tall.withColumn("k", F.row_number().over(keys.orderBy(F.desc("score"), "ticker"))).withColumn("leg", F.lit(1))
    low = tall.withColumn("k", F.row_number().over(keys.orderBy("score", F.desc("ticker")))).withColumn("leg", F.lit(-1))
    want = top.unionByName(low).where("k <= q").select("i", "signal", "ticker", "leg", "q")
    assert rows_of(both_ends(df, ["a", "b"], "i", "ticker", 0.2, 2, 5)) == rows_of(want)
    assert "Window" not in plan(league.quintile_members(df, ["a", "b"], 1, 0, 5, 2))


def test_rank_correlations_equal_windows(spark):
    """a date's ranks of all signals from one sort of its rows."""
    df, keys = scores(spark), ["signal", "i"]
    tall = df.unpivot(["ticker", "i", "y"], ["a", "b"], "signal", "score").where("score is not null and y is not null")
    ranked = tall.select(*keys, average_rank("score", keys).alias("rx"), average_rank("y", keys).alias("ry"))
    want = ranked.groupBy("i", "signal").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("ic")).where("n >= 5")
    assert rows_of(rank_correlations(df, ["a", "b"], "y", ["i"], 5)) == rows_of(want)


def test_trailing_ics_shift_no_scores(spark):
    """A score meets the return ahead of it on its own date; dates that aren't asked for aren't ranked."""
    panel = tables.dense(bars(spark, 12, 60)).withColumn("a", F.when(F.col("i") % 7 != 3, F.col("pf") * 3 - F.col("i"))).withColumn("b", F.sin("pf"))
    past = [F.lag(c, 5).over(series()).alias(c) for c in ("a", "b")]
    before = F.lag("pf", 5).over(series())
    rows = panel.select("ticker", "date", "i", (F.col("pf") / before - 1).alias("ret"), *past).where("i >= 6")
    tall = rows.unpivot(["ticker", "date", "i", "ret"], ["a", "b"], "signal", "score").where("score is not null and ret is not null")
    keys = ["signal", "date"]
    ranked = tall.select(*keys, "i", average_rank("score", keys).alias("rx"), average_rank("ret", keys).alias("ry"))
    ic = ranked.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.corr("rx", "ry")).alias("c"))
    grid = panel.select("date", "i").distinct().crossJoin(spark.createDataFrame([("a",), ("b",)], "signal string"))
    want = grid.join(ic, keys, "left").select("signal", "date", "i", F.lit(5).alias("back"), F.coalesce(F.when(~F.isnan("c"), F.col("c")), F.lit(0.0)).alias("ic"))
    got = league.trailing_ics(panel, ["a", "b"], (5,), 3)
    assert rows_of(got) == rows_of(want) and len(rows_of(want)) > 100
    some = F.col("i") % 10 == 0
    assert rows_of(league.trailing_ics(panel, ["a", "b"], (5,), 3, some)) == rows_of(want.where(some))
    on = walkforward.on_rebalance([("x", 5, 0.0), ("y", 10, 0.0)], 20, (0, 3))
    assert [r.i for r in spark.range(36).select(F.col("id").alias("i")).where(on).orderBy("i").collect()] == [17, 20, 22, 25, 27, 30, 32, 35]


def test_legs_take_one_sort(spark):
    """F25 and the walks: the lowest names are found in the order of the highest."""
    rows = [(dt.date(2024, 1, 1), f"T{k:02d}", float(k // 3), "fixed_income" if k % 4 == 0 else "equity") for k in range(40)]
    df = spark.createDataFrame(rows, "date date, ticker string, score double, asset_class string")
    legs = {(r.ticker, r.leg) for r in portfolio.select_legs(df, 5, 3).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[1]))
    low = [r[1] for r in reversed(order[-6:]) if r[3] == "equity"][:3]
    assert legs == {(r[1], 1) for r in order[:5]} | {(t, -1) for t in low}
    assert plan(portfolio.select_legs(df, 5, 3)).count("Sort [") <= 2


def test_spread_quality_reads_the_trades_once(spark, monkeypatch):
    """the panel was made for the spreads and again for the churn."""
    from tessera.plans import league_queries as Q

    made = []
    panel = Q.candidate_panel
    monkeypatch.setattr(Q, "candidate_panel", lambda *a: made.append(1) or panel(*a))
    Q._quality(spark, "/root/testdata/sf0.001")
    assert len(made) == 1


def test_walk_reads_only_names_it_holds(spark):
    """Daily rows are those of the names in the targets."""
    from tessera.plans import metric_queries as Q

    panel = tables.dense(bars(spark))
    held = Q._returns(panel, spark.createDataFrame([("T1",), ("T1",), ("T4",)], "ticker string"))
    assert held.count() == 2 * 230 and {r.ticker for r in held.select("ticker").distinct().collect()} == {"T1", "T4"}


def test_plain_batches_are_few(spark):
    """a batch opens every state store, so a replay without folds of one key has eight times the rows in a batch."""
    from tessera.streaming import jobs

    assert jobs.PLAIN_ROWS == 8 * jobs.SLICE_ROWS
    rows = spark.range(90).select(F.timestamp_seconds(F.col("id") + 1_700_000_000).alias("ts"), F.col("id").alias("event_id"))
    stream = jobs.replay(rows.unionByName(rows), rows=80)
    assert jobs.finished(jobs.distinct_bars(stream, ["event_id"])).count() == 90
