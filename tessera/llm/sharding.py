"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless global numbers (bucket of a hash of the row, then rank in the bucket), the
permutation maps number -> place in [0, N), and place gives shard = place mod n and
slot = place div n.  Both are computable from the number alone, shard sizes differ by one
at most, and slots are gapless in every shard.

Equal rows are one unit with a range of numbers, so that a row repeated any number of times
is one row of its bucket; numbers are dealt to hashes, and texts are moved once, to join
them.  The only driver-side data are the counts of BUCKETS hash buckets, a fixed bound.

Defined results: a null text has size 1 and crc32 0 (as the empty text); null doc_ids and
repeated doc_ids are rows like any other; equal rows each get a place of their own; an empty
table gives an empty result; texts of any length are carried along; so are all other columns,
but `shard` and `slot` replace columns of those names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import PART, repeated, row_hashes, small, stored, table

BUCKETS = 4096
ROUNDS = 6
MASK = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A multiply-and-shift hash of 64-bit words; wraps on overflow by design."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def permute(number: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Bijection of [0, n): a balanced Feistel network over the next even power of two, walked until inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in np.random.default_rng(seed).integers(1, 2**63, ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & low
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & low)
        return (left << shift) | right

    place = once(number.astype(np.uint64))
    while (outside := place >= np.uint64(n)).any():
        place[outside] = once(place[outside])
    return place.astype(np.int64)


def numbered(keys: DataFrame, shards: int, seed: int) -> DataFrame:
    """`keys` (h1, h2, rows and more) once for each of their rows, with at (0 to rows - 1), shard int and slot long."""
    before = F.sum("rows").over(Window.partitionBy("bucket").orderBy("h1", "h2").rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")
    units = stored(keys.withColumn("bucket", F.pmod("h1", F.lit(BUCKETS)).cast("int")).withColumn("first", before))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in units.groupBy("bucket").agg(F.sum("rows")).collect():  # BUCKETS rows at most
        counts[r[0]] = r[1]
    total, offsets = int(counts.sum()), np.cumsum(counts) - counts

    @F.pandas_udf("long")
    def place(bucket: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series(permute(offsets[bucket.to_numpy()] + rank.to_numpy(), total, seed))

    placed = repeated(units, "rows", "at", ["h1", "h2"]).withColumn("place", place("bucket", F.col("first") + F.col("at")))
    return placed.withColumn("shard", (F.col("place") % shards).cast("int")).withColumn("slot", F.expr(f"place div {shards}")).drop("bucket", "first", "place")


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 11, part: int = PART) -> DataFrame:
    """`docs` plus shard int and slot long.  Rows with more than `part` equal ones meet their places in parts."""
    keyed = docs.select(*row_hashes(docs), F.struct("*").alias("row"))
    units = stored(keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("rows")))
    places = numbered(units, shards, seed)
    one = keyed.groupBy("h1", "h2").agg(F.any_value("row").alias("row"))
    columns = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    out = one.join(places.where(F.col("rows") <= part), ["h1", "h2"]).select(*columns, "shard", "slot")
    hot = units.where(F.col("rows") > part)
    if hot.isEmpty():
        return out
    rows = keyed.join(small(hot), ["h1", "h2"]).groupBy("h1", "h2").agg(F.any_value("row").alias("row"), F.max("rows").alias("rows"))
    rows = rows.select("h1", "h2", "row", F.explode(F.expr(f"sequence(0L, (rows - 1) div {part})")).alias("part"))
    parts = places.where(F.col("rows") > part).withColumn("part", F.expr(f"at div {part}"))
    return out.unionByName(rows.join(parts, ["h1", "h2", "part"]).select(*columns, "shard", "slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    # nothing of the text is needed beyond its size and checksum, so the numbers are given to those
    units = docs.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("rows"))
    placed = numbered(units.select(*row_hashes(units.drop("rows")), "*"), 8, 11)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
