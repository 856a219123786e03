"""Mixing sources to target weights: pivotal dependent rounding in a reduction tree.

Every source has a target in words.  A document of the source is due target / source_size
copies; the whole part is certain and the fraction is rounded dependently: two open
documents exchange word mass, in a random direction with unchanged expectation, until one
of them is at 0 or 1.  Each group of documents ends with one open document at most, groups
are merged FAN at a time, and the last open document of a source is rounded alone - so the
words taken from a source miss its target by less than one document.

Texts are never shuffled by the tree: it moves units.  A unit is the rows that are equal in
every column; of its rows `extra` take one copy more than `copies`, so a unit of any number of
rows is rounded by less than one row, like any other.

Defined results: a null text has size 0; a null source is a source of its own, last in
order; null doc_ids and doc_ids with several texts are rows like any other; documents without
words take nothing; texts of any length count whole; ties are ordered by a hash of the row, so
that reruns agree; an empty table gives an empty result; other columns are carried along,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import repeated, row_hashes, small, stored, table, word_count

#: Weights by rank of the source in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
GROUP = 4096
FAN = 16


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source: source, sid, source_size, n, target.  `sizes`: source, source_size, n - one row a source.

    share of all words, split by weight; what exceeds cap x size is reshared among the others.
    The fixed point is min(cap x size, level x weight); each round of resharing is one aggregate.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int"))
    # ranked by ranges: a count of each range, not the sources, passes through the driver
    ranges = stored(sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, at = {}, 0
    for part, n in sorted(tuple(r) for r in ranges.groupBy("part").count().collect()):
        before[part], at = at, at + n
    offset = F.coalesce(*(F.when(F.col("part") == k, v) for k, v in before.items()), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    ranked = stored(ranges.withColumn("sid", (place - 1 + offset).cast("int")).drop("part").withColumn("w", w))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = F.col("w") * level >= F.col("source_size") * cap
        got = ranked.agg(
            F.sum(F.when(full, F.col("source_size") * cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))
        ).first()
        if not got[1]:
            break
        new = max(level, (share * total - got[0]) / got[1])
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.withColumn("target", F.least(F.col("source_size") * cap, F.col("w") * level)).drop("w")


def _pivot(sizes: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> int:
    """Round `p` in place, keeping sum(sizes * p); the index still open, or -1."""
    held = -1
    draws = rng.random(len(p))
    for j in range(len(p)):
        if p[j] <= 1e-12 or p[j] >= 1 - 1e-12:
            p[j] = round(p[j])
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, sizes[held], sizes[j]
        up, down = min((1 - p[i]) * a, p[j] * b), min(p[i] * a, (1 - p[j]) * b)
        move = up if draws[j] * (up + down) < down else -down
        p[i], p[j] = p[i] + move / a, p[j] - move / b
        held = -1
        for k in (i, j):
            if 1e-12 < p[k] < 1 - 1e-12:
                held = k
            else:
                p[k] = round(p[k])
    return held


def pivotal_mix(units: DataFrame, seed: int = 5, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """sid, h1, h2, extra of `units` (sid, h1, h2, size, n, due): `due` extra rows each, rounded in a reduction tree.

    n: units of the source; they are dealt to groups of about `group`, merged `fan` at a time.
    """
    columns = ["sid", "h1", "h2", "size", "bucket", "whole", "p", "open"]
    schema = "sid int, h1 long, h2 long, size double, bucket int, whole long, p double, open boolean"

    def rounder(level: int, last: bool):
        def fn(pdf: pd.DataFrame) -> pd.DataFrame:
            # large documents first: what stays open at the end is then small
            pdf = pdf.sort_values(["size", "h1", "h2"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, level, int(pdf["sid"].iloc[0]), int(pdf["bucket"].iloc[0])])
            p = pdf["p"].to_numpy(dtype=float).copy()
            held = _pivot(pdf["size"].to_numpy(dtype=float), p, rng)
            if held >= 0 and last:
                p[held] = float(rng.random() < p[held])
            pdf["p"], pdf["open"] = p, (np.arange(len(p)) == held) & (not last)
            return pdf[columns]

        return fn

    groups = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / group)))).cast("int")
    rows = units.select(
        "sid", "h1", "h2", F.col("size").cast("double").alias("size"), F.pmod(F.col("h1"), groups).cast("int").alias("bucket"),
        F.floor("due").cast("long").alias("whole"), (F.col("due") - F.floor("due")).alias("p"), F.lit(True).alias("open"),
    )
    most = units.agg(F.max(groups)).first()[0] or 1
    done, level = [], 0
    while True:
        last = most <= 1
        out = stored(rows.groupBy("sid", "bucket").applyInPandas(rounder(level, last), schema))
        done.append(out.where(~F.col("open")))
        if last:
            break
        rows, most, level = out.where("open").withColumn("bucket", F.expr(f"bucket div {fan}")), -(-most // fan), level + 1
    rounded = done[0]
    for d in done[1:]:
        rounded = rounded.unionByName(d)
    return rounded.select("sid", "h1", "h2", (F.col("whole") + F.round("p").cast("long")).alias("extra"))


def mix_sources(docs: DataFrame, seed: int = 5, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """Units of `docs`: h1, h2, doc_id, source, size, rows, source_size, target, copies of each row, extra.

    `extra` of the `rows` equal rows of a unit take one copy more than `copies`.
    """
    narrow = docs.select(*row_hashes(docs), F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"))
    units = stored(narrow.groupBy("h1", "h2", "doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")))
    sources = source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n")))
    known = units.join(small(sources.withColumnRenamed("source", "of")), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    due = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(CAP))).otherwise(F.lit(0.0))
    known = known.withColumn("copies", F.floor(due).cast("long")).withColumn("due", F.col("rows") * (due - F.floor(due)))
    rounded = pivotal_mix(known, seed, group, fan)
    return known.drop("due", "n").join(rounded, ["sid", "h1", "h2"]).drop("sid")


def mixed_documents(docs: DataFrame, seed: int = 5, group: int = GROUP, fan: int = FAN) -> DataFrame:
    """`docs` with every row repeated as often as the mix takes it."""
    units = mix_sources(docs, seed, group, fan).select("h1", "h2", "rows", "copies", "extra").where("copies + extra > 0")
    packed = docs.select(*row_hashes(docs), F.struct("*").alias("row")).join(units, ["h1", "h2"])
    # a row alone takes all its copies; of equal rows each takes `copies`, and one of them stands for the extra ones
    single = packed.select("row", (F.col("copies") + F.when(F.col("rows") == 1, F.col("extra")).otherwise(0)).alias("k")).where("k > 0")
    single = single.select("row", F.explode(F.expr("sequence(1, k)")))  # CAP + 1 copies at most
    more = packed.where("rows > 1 and extra > 0").groupBy("h1", "h2").agg(F.any_value("row").alias("row"), F.max("extra").alias("k"))
    more = repeated(stored(more), "k", "at", ["h1", "h2"])
    return single.select("row").unionByName(more.select("row")).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mix_sources(table(spark, sf_dir, "documents"))
    rows = repeated(stored(units), "rows", "k", ["h1", "h2"])
    copies = F.col("copies") + (F.col("k") < F.col("extra")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"))
