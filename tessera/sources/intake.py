"""CSV and JSON lines under a declared schema; what does not fit goes to a quarantine table with its line and reason.

Nothing is inferred and nothing fails: a malformed line, a value of another type, a missing or surplus field and a NULL in a
required column reject the line.  Both sides come from one parse, which is stored, so that they add up to all lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import stored

CORRUPT = "_line"


def _sides(parsed: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    gone = F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in required)) if required else F.lit("")
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed").when(gone != "", F.concat(F.lit("missing: "), gone))
    names = [c for c in parsed.columns if c not in (CORRUPT, "_file")]
    judged = stored(parsed.withColumn("_reason", reason))
    line = F.coalesce(CORRUPT, F.to_json(F.struct(*names)))
    return judged.where("_reason is null").select(*names), judged.where("_reason is not null").select(F.col("_file").alias("file"), line.alias("line"), F.col("_reason").alias("reason"))


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine: file, line, reason) of CSV files.  An empty field is NULL."""
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "columnPruning": "false", "header": "false"} | options
    parsed = spark.read.options(**settings).schema(f"{schema}, {CORRUPT} string").csv(path).withColumn("_file", F.input_file_name())
    return _sides(parsed, required or [])


def read_json(spark: SparkSession, path: str, schema: str, required: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine: file, line, reason) of files of JSON lines."""
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT} | options
    parsed = spark.read.options(**settings).schema(f"{schema}, {CORRUPT} string").json(path).withColumn("_file", F.input_file_name())
    return _sides(parsed, required or [])
