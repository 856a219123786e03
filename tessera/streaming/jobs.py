"""Structured Streaming forms (T1-T5) over a source of (ts, key, value) events.

Every query runs with trigger(availableNow) into a table of the shared checkpoint folder and
is read back, so that the same code serves a bounded replay and a running stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators.regime import CAUTIOUS, step
from tessera.sources.store import Store
from tessera.sources.tables import shared_folder


#: Rows of a slice of a replay at most, about: a batch of one key is held by one task.
SLICE_ROWS = 1_000_000
#: The same where no key is held by one task: a batch opens and commits every state store, so that few large ones cost less.
PLAIN_ROWS = 8_000_000


def replay(events: DataFrame, slices: int = 3, rows: int = SLICE_ROWS) -> DataFrame:
    """`events` written slice by slice in order of ts (null first) and read as a stream, one slice a batch.

    The number of slices grows with the table, so that no file and no batch does.  Batches follow
    the times of the files, so slices are published one after another, each from its own partition.
    """
    spark, path = events.sparkSession, shared_folder(events.sparkSession)
    at = F.unix_micros("ts").cast("double")
    slices = max(slices, -(-events.count() // rows))
    cuts = events.select(at.alias("t")).approxQuantile("t", [k / slices for k in range(1, slices)], 0.01 / slices)
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < at)) if cuts else F.lit(0)
    staged = f"{path}-staged"
    events.withColumn("slice", F.coalesce(place, F.lit(0))).repartition("slice").write.partitionBy("slice").parquet(staged)
    whole = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in events.schema)}, slice int").parquet(staged)
    for k in range(len(cuts) + 1):
        whole.where(F.col("slice") == k).drop("slice").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


#: Settings of a run.  State with a lifetime asks for a batch without data after every batch, so that a bounded run would
#: never end; and state lives in RocksDB on the executors' disks, not in their heaps.
SETTINGS = {
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def finished(stream: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run to the end of the source; the sink is Parquet (append) or the last state of each batch (update).

    A `path` that a run has used before goes on from its checkpoint.
    """
    spark = stream.sparkSession
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        return _run(stream, mode, path or shared_folder(spark))
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _run(stream: DataFrame, mode: str, path: str) -> DataFrame:
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", f"{path}-state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(path)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(path)).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.schema(schema).parquet(path)


def distinct_bars(stream: DataFrame, keys: list[str], late: str = "7 days") -> DataFrame:
    """Exact repeats within the overlap are dropped; corrections: see corrected_bars."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def corrected_bars(stream: DataFrame, keys: list[str], order: list[str], date: str = "date", unit: str = "month") -> DataFrame:
    """Corrections - the newest row of `keys` in a batch replaces the one before.

    A batch reads and rewrites the partitions of time that its rows fall into (sources.store); a batch that is repeated
    after a failure changes nothing.
    """
    store = Store.new(stream.sparkSession.createDataFrame([], stream.schema), keys, date, unit)

    def merge(batch: DataFrame, n: int) -> None:
        store.upsert(batch, n, order)

    stream.writeStream.option("checkpointLocation", f"{store.path}-state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return store.read()


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(["ts", "event_id"])


#: A key that has not been seen for so long (processing time) is forgotten.
LIFETIME_MS = 400 * 24 * 3600 * 1000


class Keyed(StatefulProcessor):
    """One value of state a key, with a lifetime: the store forgets it that long after its last batch, without a timer.

    A subclass says what the state holds (`held`, `start`) and how the rows of a key, in order, go on from it (`fold`).
    """

    held: str
    start: tuple

    def __init__(self, lifetime_ms: int):
        self.lifetime_ms = lifetime_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", self.held, self.lifetime_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows)
        held = self.state.get() if self.state.exists() else None
        held, out = self.fold(key[0], frame, self.start if held is None else tuple(held))
        self.state.update(held)
        yield out

    def fold(self, key: str, rows: pd.DataFrame, held: tuple) -> tuple[tuple, pd.DataFrame]:
        raise NotImplementedError


class Regimes(Keyed):
    held, start = "regime string, bullish int, bearish int", (CAUTIOUS, 0, 0)

    def fold(self, key: str, rows: pd.DataFrame, held: tuple) -> tuple[tuple, pd.DataFrame]:
        out = []
        for r in rows.itertuples(index=False):
            *held, confidence = step(tuple(held), [None if v is None or v != v else int(v) for v in (r.trend, r.vol, r.credit)])
            out.append((key, r.ts, r.event_id, *held, confidence))
        return tuple(held), pd.DataFrame(out, columns=["market", "ts", "event_id", "regime", "bullish", "bearish", "confidence"])


class Peaks(Keyed):
    held, start = "peak double", (float("-inf"),)

    def fold(self, key: str, rows: pd.DataFrame, held: tuple) -> tuple[tuple, pd.DataFrame]:
        peak = rows["value"].cummax().ffill().fillna(held[0]).clip(lower=held[0])
        known = peak.where(peak > float("-inf"))  # no value yet, no peak
        out = pd.DataFrame({"key": key, "ts": rows["ts"], "event_id": rows["event_id"], "value": rows["value"], "peak": known, "drawdown": rows["value"] / known - 1})
        return (float(peak.iloc[-1]),), out


def regime_stream(votes: DataFrame, lifetime_ms: int = LIFETIME_MS) -> DataFrame:
    """The regime machine with its counters as state, keyed by market; votes: market, ts, event_id, trend, vol, credit.

    A market that was not seen for `lifetime_ms` begins again as CAUTIOUS.  Needs the RocksDB state store (see SETTINGS).
    """
    out = "market string, ts timestamp, event_id long, regime string, bullish int, bearish int, confidence double"
    return votes.groupBy("market").transformWithStateInPandas(Regimes(lifetime_ms), out, "append", "ProcessingTime")


def stop_stream(prices: DataFrame, positions: DataFrame, limit: float = -0.08) -> DataFrame:
    """Each price against the static positions (key, entry_price)."""
    joined = prices.join(positions, "key")
    return joined.withColumn("pnl", F.when(F.col("entry_price") > 0, F.col("value") / F.col("entry_price") - 1)).where(F.col("pnl") <= limit)


def drawdown_stream(values: DataFrame, lifetime_ms: int = LIFETIME_MS) -> DataFrame:
    """T4: running peak by key as state; key, ts, event_id, value, peak, drawdown.  Lifetimes as in `regime_stream`."""
    out = "key string, ts timestamp, event_id long, value double, peak double, drawdown double"
    return values.groupBy("key").transformWithStateInPandas(Peaks(lifetime_ms), out, "append", "ProcessingTime")


def daily_bars_stream(ticks: DataFrame, late: str = "1 hour") -> DataFrame:
    """T5: daily bars from ticks."""
    day = F.window("ts", "1 day")
    at = F.struct("ts", "event_id")
    return ticks.withWatermark("ts", late).groupBy(day.alias("w"), "key").agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("ticks")
    ).select(F.col("w.start").cast("date").alias("date"), "key", "open", "high", "low", "close", "ticks")
