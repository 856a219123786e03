"""Ranks inside cross-sections: the rows of a key (a date) come to a task as Arrow columns, and numpy sorts them there.

Window functions sort whole rows once for every ranked column, and a stage holds all those sorts at once; here a task sorts its rows
once, by the key, and holds the columns of one key at a time.  A key too large for that goes to functions.ranges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from tessera.functions.sliding import values


def average_ranks(x: np.ndarray) -> np.ndarray:
    """From 1, ties at their mean; NaN is the largest value and equal to itself."""
    _, place, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2.0)[place]


def percentile_ranks(df: DataFrame, names: list[str], key: str = "date") -> DataFrame:
    """`df` with the percentile rank within `key` in place of each column of `names`; NULL for NULL."""

    def fn(table: pa.Table) -> pa.Table:
        for name in names:
            x, there = values(table.column(name))
            rank = np.zeros(len(x))
            rank[there] = average_ranks(x[there]) / max(there.sum(), 1)
            table = table.set_column(table.column_names.index(name), name, pa.array(rank, pa.float64(), mask=~there))
        return table

    rows = df.withColumns({n: F.col(n).cast("double") for n in names})
    return rows.groupBy(key).applyInArrow(fn, rows.schema)


def rank_correlations(df: DataFrame, names: list[str], y: str, keys: list[str], least: int) -> DataFrame:
    """keys, signal, n, ic: Spearman of each of `names` with y over the rows of the keys where both are there; none below `least` rows, NULL
    where all values are equal."""

    def fn(key: tuple, table: pa.Table) -> pa.Table:
        b, there = values(table.column(y))
        found, whole = [], None
        for name in names:
            a, ok = values(table.column(name))
            ok = ok & there
            n = int(ok.sum())
            if n < max(least, 1):
                continue
            ra = average_ranks(a[ok]) - (n + 1) / 2.0
            if n < len(b):
                rb = average_ranks(b[ok]) - (n + 1) / 2.0
            else:
                rb = whole = average_ranks(b) - (n + 1) / 2.0 if whole is None else whole
            spread = (ra @ ra) * (rb @ rb)
            found.append((name, n, float(ra @ rb) / float(np.sqrt(spread)) if spread > 0 else None))
        columns = [pa.array([k.as_py()] * len(found), k.type) for k in key]
        columns += [pa.array(v, t) for v, t in zip(zip(*found) if found else ((), (), ()), (pa.string(), pa.int64(), pa.float64()))]
        return pa.table(columns, names=[*keys, "signal", "n", "ic"])

    rows = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in (y, *names))).where(F.col(y).isNotNull())
    schema = StructType([rows.schema[k] for k in keys]).add("signal", "string").add("n", "long").add("ic", DoubleType())
    return rows.groupBy(*keys).applyInArrow(fn, schema)


def both_ends(df: DataFrame, names: list[str], key: str, item: str, share: float, smallest: int, least: int) -> DataFrame:
    """key, signal, item, leg (1 top, -1 bottom), q: the q = max(floor(share n), smallest) largest and smallest of the n values of each of `names`
    within `key`, where n is `least` or more.  Ties go by item, upwards among the largest; the other end is the same order reversed."""

    def fn(table: pa.Table) -> pa.Table:
        items = table.column(item).combine_chunks()
        by_item = np.empty(len(items), dtype=np.int64)
        by_item[pc.sort_indices(items).to_numpy()] = np.arange(len(items))
        taken, signals, legs, sizes = [], [], [], []
        for k, name in enumerate(names):
            x, there = values(table.column(name))
            rows = np.flatnonzero(there)
            n = len(rows)
            if n < max(least, 1):
                continue
            q = max(int(np.floor(n * share)), smallest)
            order = rows[np.lexsort((-by_item[rows], x[rows]))]
            for leg, picked in ((1, order[max(n - q, 0) :]), (-1, order[:q])):
                taken.append(picked)
                signals.append(np.full(len(picked), k, dtype=np.int32))
                legs.append(np.full(len(picked), leg, dtype=np.int32))
                sizes.append(np.full(len(picked), q, dtype=np.int64))
        flat = lambda v, t: np.concatenate(v) if v else np.empty(0, dtype=t)
        at = pa.array(flat(taken, np.int64))
        signal = pa.DictionaryArray.from_arrays(pa.array(flat(signals, np.int32)), pa.array(names)).cast(pa.string())
        columns = [table.column(key).combine_chunks().take(at), signal, items.take(at), pa.array(flat(legs, np.int32)), pa.array(flat(sizes, np.int64))]
        return pa.table(columns, names=[key, "signal", item, "leg", "q"])

    rows = df.select(key, item, *(F.col(n).cast("double").alias(n) for n in names))
    schema = StructType([rows.schema[key]]).add("signal", "string").add(rows.schema[item]).add("leg", "integer").add("q", "long")
    return rows.groupBy(key).applyInArrow(fn, schema)
