"""A keyed table in partitions of time: an upsert reads and rewrites the partitions that its rows fall into, no others.

A batch is written once: its id goes to a ledger after its partitions have been replaced, and an id that is in the ledger
changes nothing.  A run that ends in between can be repeated, because the last write of a key wins whenever
it is applied again.  New contents are staged in the shared folder before a partition is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ingest import upsert
from tessera.sources.tables import shared_folder, stored

#: Name of the partition column.
PART = "_part"
FORMATS = {"month": "yyyy-MM", "year": "yyyy", "day": "yyyy-MM-dd"}


@dataclass
class Store:
    """`keys` identify a row; `date` names the column that decides its partition, which a correction of a row keeps."""

    spark: SparkSession
    path: str
    schema: str
    keys: list[str]
    date: str = "date"
    unit: str = "month"

    @staticmethod
    def new(df: DataFrame, keys: list[str], date: str = "date", unit: str = "month") -> Store:
        """An empty store for rows like those of `df`, in the shared folder."""
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return Store(df.sparkSession, shared_folder(df.sparkSession), schema, keys, date, unit)

    def _all(self) -> DataFrame:
        return self.spark.read.schema(f"{self.schema}, {PART} string").parquet(f"{self.path}/rows")

    def _is(self, folder: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self) -> DataFrame:
        """All rows."""
        if not self._is("rows"):
            return self.spark.createDataFrame([], self.schema)
        return self._all().drop(PART)

    def upsert(self, rows: DataFrame, batch: int, order: list[str] | None = None) -> list[str]:
        """Put `rows` in; within them the largest `order` of a key wins.  Returns the partitions that were rewritten."""
        if self._is(f"ledger/{batch}"):
            return []
        new = rows.withColumn(PART, F.coalesce(F.date_format(F.col(self.date), FORMATS[self.unit]), F.lit("none")))
        if order:
            new = new.groupBy(*self.keys, PART).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_row")).select("_row.*", PART)
        new = stored(new)
        # partitions, not rows: at most one a calendar unit
        parts = sorted(r[0] for r in new.select(PART).distinct().collect())
        if parts:
            merged = new
            if self._is("rows"):
                merged = upsert(self._all().where(F.col(PART).isin(parts)), new, [*self.keys, PART])
            staged = stored(merged.repartition(PART))
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.path}/rows")
        self.spark.createDataFrame([(batch, len(parts))], "batch long, parts int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/{batch}")
        return parts
