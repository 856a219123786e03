"""Readers and adapters: bars, calendar panel, benchmark, macro series and dimensions from the given tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.windows import change, ratio, series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).  Only a local session may do without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tessera-"))
    return f"{sc.getCheckpointDir()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: several users, one computation."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vwap() -> Column:
    """Volume-weighted price in whole cents, from integers only: the same on every partitioning."""
    cents, units = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")), F.sum(F.col("l_quantity").cast("long"))
    return F.call_function("div", 2 * cents + units, 2 * units) / 100.0


def bars(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """ticker, date, open, high, low, close, px (VWAP in whole cents), volume: one pre-aggregated shuffle."""
    lines = table(spark, sf_dir, "lineitem")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    p = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        lines.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), F.date_trunc(unit, "l_shipdate").cast("date").alias("date"))
        .agg(
            F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"),
            vwap().alias("px"),
            F.sum("l_quantity").cast("long").alias("volume"),
        )
    )


def own_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with r (return on the row before) and n (row number in the ticker)."""
    return bars(spark, sf_dir).withColumn("r", change("px", 1)).withColumn("n", F.row_number().over(series()))


def calendar(df: DataFrame) -> DataFrame:
    """The shared calendar: distinct dates with a 0-based index.  Dates are few; one task orders them."""
    return df.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)


def dense(df: DataFrame, bounded: bool = False, days: DataFrame | None = None) -> DataFrame:
    """All tickers on all dates (D15), with the filled price pf and r on it.

    `bounded`: a ticker has the dates of the shared calendar from its first row to its last, so that names which live
    for a short time don't fill the years before and after; i still counts the shared calendar.  Within its dates
    every column equals that of the whole grid.  Where names are listed for all the time both are the same.

    A row of `df` stands for the dates up to the next row of its ticker, so that the rows of a ticker are shuffled and sorted once
    and the grid is neither made nor joined.  `days`: the calendar, where the caller has a shorter way to it.
    """
    days = calendar(df) if days is None else days
    dates = F.broadcast(days)  # a row a calendar day: bounded by the years covered
    own = [c for c in df.columns if c not in ("ticker", "date")]
    known = F.col("ticker").isNotNull() & F.col("date").isNotNull()  # a NULL key has its place in the grid, but no values
    at = F.broadcast(days.select(F.col("date").alias("_d"), F.col("i").alias("_i")))
    rows = df.join(at, F.col("date").eqNullSafe(F.col("_d"))).select("ticker", "_i", *(F.when(known, F.col(c)).alias(c) for c in own))
    w = Window.partitionBy("ticker").orderBy("_i")
    runs = rows.withColumn("_pf", F.last("px", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumns({"_before": F.lag("_pf").over(w), "_last": F.lag("_i").over(w), "_next": F.lead("_i").over(w)})
    if bounded:
        first, end = F.col("_i"), F.col("_i")
    else:
        runs = runs.crossJoin(F.broadcast(days.agg(F.max("i").alias("_end"))))
        first, end = F.when(F.col("_last").isNull(), F.lit(0)).otherwise(F.col("_i")), F.col("_end")
    stop = F.greatest(F.coalesce(F.col("_next") - 1, end), F.col("_i"))
    full = runs.select("*", F.explode(F.sequence(first, stop)).alias("i")).join(dates, "i")
    here, since = F.col("i") == F.col("_i"), F.col("i") >= F.col("_i")
    before = F.when(here, F.col("_before")).when(since, F.col("_pf"))
    full = full.select("ticker", "date", "i", *(F.when(here, F.col(c)).alias(c) for c in own), F.when(since, F.col("_pf")).alias("pf"), before.alias("_before"))
    return full.withColumn("r", ratio(F.col("pf"), F.col("_before")) - 1).drop("_before")


def weeks(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """The calendar of `bars`, straight from the trade lines."""
    return calendar(table(spark, sf_dir, "lineitem").select(F.date_trunc(unit, "l_shipdate").cast("date").alias("date")))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense(bars(spark, sf_dir), days=weeks(spark, sf_dir))


def filled_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with prices filled forward and no volume where there was no trade."""
    return panel(spark, sf_dir).withColumn("px", F.col("pf")).withColumn("volume", F.coalesce("volume", F.lit(0)))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark: date, m, rm."""
    lines = table(spark, sf_dir, "lineitem")
    px = lines.groupBy(F.date_trunc("week", "l_shipdate").cast("date").alias("date")).agg(
        vwap().alias("m")
    )
    return px.withColumn("rm", ratio(F.col("m"), F.lag("m").over(Window.orderBy("date"))) - 1)  # one short series


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, date, value."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("week", "o_orderdate").cast("date").alias("date"))
        .agg((F.round(F.avg("o_totalprice")).cast("long") / 1.0).alias("value"))
    )


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, sector, asset_class."""
    classes = F.array(*map(F.lit, ("equity", "fixed_income", "commodity", "alternative", "leveraged")))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(
        F.col("s_suppkey").cast("string").alias("ticker"), F.col("r_name").alias("sector"),
        F.element_at(classes, (F.col("s_nationkey") % 5 + 1).cast("int")).alias("asset_class"),
    )
