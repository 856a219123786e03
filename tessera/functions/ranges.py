"""Running figures, as-of values and ranks where one key is too large for one task.

Rows of a key are cut into ranges (of time, or of the ranked value).  A range is worked on alone; what comes
before it is one row a range, carried over the ranges of a key in a second, small pass, and joined back on
(key, range).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How a running figure grows, and how it meets what came before.
KINDS = {
    "product": (F.product, lambda a, b: a * b),
    "sum": (F.sum, lambda a, b: a + b),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def running(df: DataFrame, figures: dict[str, tuple[str, Column]], keys: list[str], order: str, unit: str = "year") -> DataFrame:
    """`df` and for each name -> (kind, x) the figure of x over all rows of the key up to this one.

    NULLs are skipped; NULL until there is a value.  Equal orders are rows in an order that is not told.
    """
    inputs = {f"_x{k}": x for k, (_, x) in enumerate(figures.values())}
    rows = df.withColumns({"_range": F.date_trunc(unit, order), **inputs})
    kinds = {name: (f"_x{k}", *KINDS[kind]) for k, (name, (kind, _)) in enumerate(figures.items())}
    inside = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_range").agg(*(agg(x).alias(x) for x, agg, _ in kinds.values()))
    carried = ends.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)), F.col("_range").alias("_r"), *(agg(x).over(before).alias(f"_c{x}") for x, agg, _ in kinds.values()))
    grown = rows.withColumns({f"_g{x}": agg(x).over(inside) for x, agg, _ in kinds.values()})
    same = F.col("_range").eqNullSafe(F.col("_r"))
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{n}"))
    joined = grown.join(carried, same, "left")
    met = {name: F.coalesce(merge(F.col(f"_g{x}"), F.col(f"_c{x}")), F.col(f"_g{x}"), F.col(f"_c{x}")) for name, (x, _, merge) in kinds.items()}
    return joined.select(*df.columns, *(c.alias(name) for name, c in met.items()))


def asof(left: DataFrame, right: DataFrame, on: str, values: list[str], by: list[str], unit: str = "month") -> DataFrame:
    """`left` with `values` of the latest row of `right` of the same `by` at or before it; NULL where there is none.

    Within a range of time the two sides are united and the last value is filled on; a range without one takes
    the last value of the ranges before.  A NULL key or time meets nothing.
    """
    held = F.struct(*values)
    own = [c for c in left.columns if c not in (on, *by)]
    known = right.where(F.col(on).isNotNull()).dropna(subset=by) if by else right.where(F.col(on).isNotNull())
    span = F.date_trunc(unit, F.col(on)).alias("_range")
    a = left.select(*by, on, span, F.struct(F.lit(1).alias("_one"), *own).alias("_l"), F.lit(None).alias("_v"), F.lit(1).alias("_s"))
    b = known.select(*by, on, span, F.lit(None).alias("_l"), held.alias("_v"), F.lit(0).alias("_s"))
    rows = a.unionByName(b)
    inside = Window.partitionBy(*by, "_range").orderBy(on, "_s").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(inside)).where("_s = 1")
    # one row a range: the ranges of both sides, with the last value of the ranges before
    ends = rows.groupBy(*by, "_range").agg(F.max_by("_v", F.when(F.col("_s") == 0, F.col(on))).alias("_e"))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_e", F.last("_e", ignorenulls=True).over(before))
    joined = filled.join(carried, [*by, "_range"], "left").withColumn("_v", F.coalesce("_v", "_e"))
    return joined.select(*by, on, *(F.col(f"_l.{c}").alias(c) for c in own), *(F.col(f"_v.{c}").alias(c) for c in values))


def _ordered(df: DataFrame, x: str, keys: list[str], stored) -> DataFrame:
    """keys, x (each different value once), _n rows of it, _upto rows up to and with it, _held rows of the keys with a value.

    Values are counted first, so that a common one is one row, and sorted by ranges; a range counts on from those before.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, x).agg(F.count(F.lit(1)).alias("_n"))
    order = [*map(F.col, keys), F.col(x)]
    parts = stored(counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*keys)
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_here"))
    before = F.coalesce(F.sum("_here").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_part", before.alias("_before"), F.sum("_here").over(w).alias("_held"))
    inside = Window.partitionBy(*keys, "_part").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    upto = parts.withColumn("_upto", F.sum("_n").over(inside)).join(sums, [*keys, "_part"])
    return upto.select(*keys, x, "_n", (F.col("_before") + F.col("_upto")).alias("_upto"), "_held")


def ranked(df: DataFrame, x: str, keys: list[str], stored, name: str = "rank", total: str = "held") -> DataFrame:
    """`df` with the average rank of x within `keys` (ties at their mean, NULL for NULL) and the number of values there.

    `stored` cuts the plan at the sorted ranges, whose bounds are samples.  Keys are not NULL.
    """
    ranks = _ordered(df, x, keys, stored).select(*keys, x, (F.col("_upto") - (F.col("_n") - 1) / 2.0).alias(name), F.col("_held").alias(total))
    return df.join(ranks, [*keys, x], "left").select(*df.columns, name, total)


def quantiles(df: DataFrame, x: str, keys: list[str], qs: tuple[float, ...], stored) -> DataFrame:
    """keys, edges: linearly interpolated quantiles of x; each value looks up which of the wanted places it covers."""
    rows = _ordered(df, x, keys, stored)
    places = [F.lit(q) * (F.col("_held") - 1) for q in qs]
    covers = lambda p: (p >= F.col("_upto") - F.col("_n")) & (p < F.col("_upto"))
    at = [f(p) for p in places for f in (F.floor, F.ceil)]
    hits = rows.where(_any(covers(p) for p in at)).groupBy(*keys).agg(F.max("_held").alias("_held"), *(F.max(F.when(covers(p), F.col(x))).alias(f"_v{k}") for k, p in enumerate(at)))
    edges = [F.col(f"_v{2 * k}") + (F.col(f"_v{2 * k + 1}") - F.col(f"_v{2 * k}")) * (p - F.floor(p)) for k, p in enumerate(places)]
    return hits.select(*keys, F.array(*edges).alias("edges"))


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out
