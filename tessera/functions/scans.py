"""Linear recursions of series as an associative scan over chunks.

y(t) = decay y(t-1) + b(t) is a composition of affine maps, and maps compose in any grouping: a chunk of rows is
solved from zero, its last value is one row of a series of chunks with the decay decay ** chunk, which is
solved alike, and what comes in from before is added to each row of the chunk.  Each level has a
chunk-th of the rows; all of it is window sums and equi-joins, dealt to tasks by (key, chunk).
"""

from __future__ import annotations

from math import ceil, log10

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Decays below this need only a few rows: the powers of the rest are below the smallest double.
TINY = 1e-15
#: Largest power of ten that a scaled term may reach.
POWER = 150


def affine_scan(df: DataFrame, terms: dict[str, tuple[str, float]], keys: str | list[str] = "ticker", order: str = "date", chunk: int = 2048) -> DataFrame:
    """`df` and a column y for each y -> (b, decay) of `terms`: y(t) = decay y(t-1) + b(t), from 0; a NULL b is 0.

    0 <= decay < 1.  Equal orders of a key are rows in an order that is not told.
    """
    keys = [keys] if isinstance(keys, str) else keys
    placed = df.withColumn("_i0", F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long") - 1)
    return _scan(placed, terms, keys, chunk, 0).drop("_i0")


def _scan(rows: DataFrame, terms: dict[str, tuple[str, float]], keys: list[str], chunk: int, level: int) -> DataFrame:
    i = f"_i{level}"
    tiny = {y: t for y, t in terms.items() if t[1] < TINY}
    rest = {y: t for y, t in terms.items() if y not in tiny}
    if tiny:
        w = Window.partitionBy(*keys).orderBy(i)
        term = lambda b, d, m: F.coalesce(F.lag(b, m).over(w) if m else F.col(b), F.lit(0.0)) * d**m
        rows = rows.withColumns({y: sum((term(b, d, m) for m in range(1, ceil(308 / -log10(d)) if d else 1)), term(b, d, 0)) for y, (b, d) in tiny.items()})
    if not rest:
        return rows
    size = max(2, min(chunk, 1 + int(POWER / -log10(min(d for _, d in rest.values())))))
    c, k = f"_c{level}", F.expr(f"{i} % {size}")
    cut = rows.withColumn(c, F.expr(f"{i} div {size}")).repartition(*keys, c)
    w = Window.partitionBy(*keys, c).orderBy(i).rowsBetween(Window.unboundedPreceding, 0)
    local = {f"_l{level}_{y}": F.pow(F.lit(d), k) * F.sum(F.coalesce(F.col(b), F.lit(0.0)) * F.pow(F.lit(d), -k)).over(w) for y, (b, d) in rest.items()}
    cut = cut.withColumns(local)
    # all chunks but the last are whole
    ends = cut.where(k == size - 1).select(*keys, F.col(c).alias(f"_i{level + 1}"), *local)
    above = _scan(ends, {y: (f"_l{level}_{y}", d**size) for y, (_, d) in rest.items()}, keys, chunk, level + 1)
    before = above.select(*keys, (F.col(f"_i{level + 1}") + 1).alias(c), *(F.col(y).alias(f"_u{level}_{y}") for y in rest))
    found = cut.join(before, [*keys, c], "left")
    solved = {y: F.col(f"_l{level}_{y}") + F.pow(F.lit(d), k + 1) * F.coalesce(F.col(f"_u{level}_{y}"), F.lit(0.0)) for y, (_, d) in rest.items()}
    return found.withColumns(solved).drop(c, *local, *(f"_u{level}_{y}" for y in rest))
