"""Cleaning, upserts, data quality and universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.windows import lag, ratio

FIELDS = ("open", "high", "low", "close", "adj_close", "volume")


def clean_bars(raw: DataFrame, ticker: str | None = None) -> DataFrame:
    """Headers by meaning, not case; rows without a positive close go; adj_close falls back to close, volume to 0."""
    found: dict[str, str] = {}
    for c in raw.columns:
        low = c.lower().replace(" ", "_")
        found["adj_close" if "adj" in low else low] = c
    get = lambda n, kind: F.expr(f"try_cast(`{found[n]}` as {kind})") if n in found else F.lit(None).cast(kind)
    name = F.lit(ticker) if ticker else get("ticker", "string")
    rows = raw.select(name.alias("ticker"), get("date", "date").alias("date"), *(get(f, "bigint" if f == "volume" else "double").alias(f) for f in FIELDS))
    rows = rows.where((F.col("close") > 0) & ~F.isnan("close"))
    return rows.withColumn("adj_close", F.coalesce("adj_close", "close")).withColumn("volume", F.coalesce("volume", F.lit(0)))


def unused(name: str, df: DataFrame) -> str:
    """`name` with as many underscores behind it as make it no column of `df`."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str | None = None) -> DataFrame:
    """Last write wins by key; within one side the larger `version` (or any of equal rows)."""
    side, place = unused("side", old), unused("place", old)
    both = old.withColumn(side, F.lit(0)).unionByName(new.withColumn(side, F.lit(1)))
    order = [F.desc(side), *([F.desc(version)] if version else [])]
    return both.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) == 1).drop(side, place)


def incremental_plan(bars: DataFrame, universe: DataFrame, overlap: int = 7) -> DataFrame:
    """Ticker, start (NULL: full backfill) - known names are read again from the newest date of all less the overlap."""
    newest = bars.groupBy("ticker").agg(F.max("date").alias("newest"))
    start = newest.agg(F.date_sub(F.max("newest"), overlap).alias("from"))
    planned = universe.join(newest, "ticker", "left").crossJoin(start)  # one row
    return planned.select("ticker", F.when(F.col("newest").isNotNull(), F.col("from")).alias("start"))


def read_range(df: DataFrame, key: str, value: str, start: str, end: str) -> DataFrame:
    """One series in a date range, in order; the filter reaches the scan."""
    return df.where((F.col(key) == value) & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))).orderBy("date")


def summary(bars: DataFrame) -> DataFrame:
    """D7."""
    return bars.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("rows"))


def totals(bars: DataFrame) -> DataFrame:
    """D8."""
    return bars.agg(F.count(F.lit(1)).alias("rows"), F.max("date").alias("latest"))


def coverage(bars: DataFrame, min_tickers: int = 400, min_years: float = 6.0) -> DataFrame:
    """D9."""
    c = bars.agg(F.countDistinct("ticker").alias("tickers"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"), F.count(F.lit(1)).alias("rows"))
    return c.withColumn("ok", (F.col("tickers") >= min_tickers) & (F.col("years") >= min_years))


def completeness(bars: DataFrame, expected: DataFrame, least: int = 252) -> DataFrame:
    """Issue rows (check, severity, ticker)."""
    absent = expected.join(bars.select("ticker").distinct(), "ticker", "left_anti").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy()))
    a = absent.select(F.lit("missing").alias("check"), F.when(F.col("n") > 2, "error").otherwise("warning").alias("severity"), "ticker")
    short = bars.groupBy("ticker").count().where(F.col("count") < least).select(F.lit("short").alias("check"), F.lit("warning").alias("severity"), "ticker")
    return a.unionByName(short)


def freshness(bars: DataFrame, asof: str, max_days: int = 5, most: int = 5) -> DataFrame:
    """D11."""
    stale = bars.groupBy("ticker").agg(F.max("date").alias("last")).where(F.datediff(F.lit(asof).cast("date"), "last") > max_days)
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return stale.select(F.lit("stale").alias("check"), F.when(n > most, "error").otherwise("warning").alias("severity"), "ticker")


def outliers(bars: DataFrame, limit: float = 0.20) -> DataFrame:
    """Count, worst move and its date by ticker."""
    moved = bars.withColumn("_r", ratio(F.col("px"), lag("px", 1)) - 1).where(F.abs("_r") > limit)
    return moved.groupBy("ticker").agg(F.count(F.lit(1)).alias("moves"), F.max_by("_r", F.struct(F.abs("_r"), "date")).alias("worst"), F.max_by("date", F.struct(F.abs("_r"), "date")).alias("worst_date"))


def low_volume(bars: DataFrame, limit: float = 500_000, n: int = 21) -> DataFrame:
    """D13."""
    recent = bars.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("_k") <= n)
    return recent.groupBy("ticker").agg(F.avg("volume").alias("mean")).where(F.col("mean") < limit)


def quality_report(*checks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All issues, and one row that tells whether none is an error."""
    rows = checks[0]
    for c in checks[1:]:
        rows = rows.unionByName(c)
    return rows, rows.agg(F.coalesce(F.bool_and(F.col("severity") != "error"), F.lit(True)).alias("passed"), F.count(F.lit(1)).alias("issues"))


def wide(panel: DataFrame, tickers: list[str], rows: int, value: str = "px") -> DataFrame:
    """A small export - the last `rows` calendar rows of named tickers."""
    last = panel.select("date").distinct().orderBy(F.desc("date")).limit(rows)
    return panel.where(F.col("ticker").isin(tickers)).join(last, "date", "left_semi").groupBy("date").pivot("ticker", tickers).agg(F.first(value))


def normalized_symbol(x: Column) -> Column:
    """NULL where it is no symbol."""
    s = F.replace(F.upper(F.trim(x)), F.lit("."), F.lit("-"))
    return F.when(s.rlike("^[A-Z-]{1,10}$"), s)


def merged_constituents(lists: list[DataFrame], excluded: DataFrame, old: DataFrame, least: int = 100) -> DataFrame:
    """Earlier lists win; fewer than `least` rows keep the old universe."""
    rows = lists[0].withColumn("_p", F.lit(0))
    for p, extra in enumerate(lists[1:], 1):
        rows = rows.unionByName(extra.withColumn("_p", F.lit(p)))
    best = rows.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy("_p"))).where("_k = 1").drop("_k", "_p")
    fresh = best.join(excluded.select("ticker").distinct(), "ticker", "left_anti")
    enough = fresh.agg((F.count(F.lit(1)) >= least).alias("enough"))
    a = fresh.crossJoin(enough).where("enough").drop("enough")
    return a.unionByName(old.crossJoin(enough).where("not enough").drop("enough"))


def constituents_scd(old: DataFrame, fetched: DataFrame, at: str) -> DataFrame:
    """Who was fetched is active; first_seen stays, last_seen moves; names and sectors are cut to 200 and 80."""
    now = F.lit(at).cast("timestamp")
    f = fetched.select("ticker", F.substring("name", 1, 200).alias("_n"), F.substring("sector", 1, 80).alias("_s"), F.lit(True).alias("_f"))
    j = old.join(f, "ticker", "full_outer")
    return j.select(
        "ticker", F.coalesce("_n", "name").alias("name"), F.coalesce("_s", "sector").alias("sector"), F.coalesce("_f", F.lit(False)).alias("active"),
        F.coalesce("first_seen", now).alias("first_seen"), F.when(F.col("_f"), now).otherwise(F.col("last_seen")).alias("last_seen"),
    )


def full_universe(etfs: DataFrame, stocks: DataFrame) -> DataFrame:
    """Distinct names with their place, ETFs first."""
    both = etfs.select("ticker", F.lit(0).alias("place")).unionByName(stocks.select("ticker", F.lit(1).alias("place")))
    return both.groupBy("ticker").agg(F.min("place").alias("place"))


def with_dimensions(rows: DataFrame, dims: DataFrame) -> DataFrame:
    """D21."""
    known = rows.join(dims, "ticker", "left")
    return known.withColumn("sector", F.coalesce("sector", F.lit("Unknown"))).withColumn("asset_class", F.coalesce("asset_class", F.lit("equity")))


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """Idempotent by partition - only the partitions in `df` are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def encode_detail(df: DataFrame, columns: list[str | Column], name: str = "detail") -> DataFrame:
    """The columns (structs, maps, arrays of structs too) as one JSON object; nulls are written."""
    return df.withColumn(name, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def decode_detail(df: DataFrame, schema: str, name: str = "detail") -> DataFrame:
    """The fields of `schema` as columns; one whose name `df` has already becomes `name`_field.  Text that is no JSON gives nulls."""
    taken = {c.lower() for c in df.columns}
    found = F.from_json(F.col(f"`{name}`"), schema)
    rows = df.select(F.struct("*").alias("row"), found.alias("found"))
    fields = rows.schema["found"].dataType.fieldNames()
    return rows.select("row.*", *(F.col(f"found.`{f}`").alias(unused(f"{name}_{f}", df) if f.lower() in taken else f) for f in fields))


def current_price(bid: Column, ask: Column, position_price: Column, close: Column) -> Column:
    """Mid, or the one side there is, then the position's price, then the last close."""
    b, a = F.coalesce(bid, F.lit(0.0)), F.coalesce(ask, F.lit(0.0))
    quote = F.when((b > 0) & (a > 0), (b + a) / 2).otherwise(F.greatest(b, a))
    return F.coalesce(F.when(quote > 0, quote), F.when(position_price > 0, position_price), close)
