"""Helpers that several corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of every contract: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAPS = r"[\x20\x09-\x0D]+"
#: Label rows with this remainder of crc32(doc_id) mod 5 are held out of every fit.
HELD_OUT = 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Only a local session may do without it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="tessera-"))
    return sc.getCheckpointDir()


#: Lets a finished query drop its shuffle files at once instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, free: bool = False) -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors.

    `free`: the shuffle files of this write go with its end.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    before = spark.conf.get(CLEANUP, "false")
    try:
        if free:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a counted table may be broadcast; beyond it the same join is a shuffle.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df` (stored) with a broadcast hint if its row count allows it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_hashes(docs: DataFrame) -> list[Column]:
    """h1, h2: 128 bits over all columns of a row, equal for rows that are equal.

    A hash skips nulls, so that each column is hashed with whether it is null; nested columns as JSON with their nulls.
    """
    parts = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        nested = f.dataType.typeName() in ("map", "struct", "array")
        parts.append((c.isNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}) if nested else c))
    flat = [x for pair in parts for x in pair]
    back = [x for pair in reversed(parts) for x in pair]
    return [F.xxhash64(*flat).alias("h1"), F.xxhash64(F.lit(1), *back).alias("h2")]


#: A row that is repeated more often is cut into parts of so many copies, which are dealt to tasks anew.
PART = 4096


def repeated(df: DataFrame, count: str, name: str, keys: list[str], part: int = PART) -> DataFrame:
    """Every row of `df` (stored, or cheap to make twice) `count` times, numbered from 0 in `name` (long).

    No array holds more than `part` copies and no task makes more than its parts, however often a row is repeated.
    """
    n = F.col(count).cast("long")
    upto = lambda low, high: F.explode(F.sequence(low, high))
    few = df.where((n > 0) & (n <= part)).select("*", upto(F.lit(0).cast("long"), n - 1).alias(name))
    parts = df.where(n > part).select("*", upto(F.lit(0).cast("long"), F.floor((n - 1) / part)).alias("_part")).repartition(*keys, "_part")
    many = parts.select("*", upto(F.col("_part") * part, F.least(n, (F.col("_part") + 1) * part) - 1).alias(name)).drop("_part")
    return few.unionByName(many)


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{GAPS}|{GAPS}$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAPS))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def training_labels(labels: DataFrame, label: str, most: int) -> DataFrame:
    """At most `most` labelled ids outside the held-out fold, chosen by a hash of the id: doc_id, y (0/1)."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    return (
        rows.where(fold_of(F.col("doc_id")) != HELD_OUT)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
