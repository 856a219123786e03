"""Sliding moments and extremes of series: a row costs the same whatever the look-back, and nothing is subtracted.

A look-back of n rows is cut into blocks of n rows.  The last n rows up to a row are the end of one
block and the beginning of the next, so that a window is a suffix and a prefix merged: counts, means and central moments
(M2, M3, Cxy) of both by Chan's formulas, extremes by the larger one.  A value that has left the window has
left the result, be it an outlier, a NaN or an infinity.  Prefixes and suffixes of all blocks grow in step,
one numpy operation for all blocks at once.

Series are streamed: rows come sorted by key and date, in Arrow batches, and only the rows that later windows still
reach back to are carried along, so that a series of any length needs bounded memory.  `split` cuts long series into pieces
with those rows repeated in front, which are dealt to tasks as if they were series of their own.

Results are strict: NULL unless `least` (default n) of the n rows hold a value.  NaN counts as a value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

#: Rows that are worked on at a time.
ROWS = 65_536


class Roll(NamedTuple):
    """A figure of the last n values of x (of the pairs x, y).  x may be an earlier figure of the same call."""

    kind: str
    x: str
    n: int
    least: int | None = None
    y: str | None = None
    fn: Callable[[np.ndarray], np.ndarray] | None = None


def _maker(kind: str):
    def make(x: str, n: int, least: int | None = None) -> Roll:
        return Roll(kind, x, n, least)

    return make


avg, total, sd, skew, high, low = map(_maker, ("avg", "sum", "sd", "skew", "max", "min"))


def beta(x: str, y: str, n: int) -> Roll:
    return Roll("beta", x, n, None, y)


def corr(x: str, y: str, n: int) -> Roll:
    return Roll("corr", x, n, None, y)


def residual(x: str, y: str, n: int) -> Roll:
    """x less its sliding beta times y."""
    return Roll("residual", x, n, None, y)


def user(x: str, n: int, fn: Callable[[np.ndarray], np.ndarray]) -> Roll:
    """Any function of the last n values: it gets [rows, n] and returns a value a row; only windows with all n values are asked."""
    return Roll("user", x, n, None, None, fn)


Values = tuple[np.ndarray, np.ndarray]  # values, which of them are there


def _grow(x: list[np.ndarray], ok: np.ndarray, fresh: np.ndarray, third: bool) -> np.ndarray:
    """Fields of the prefixes of all blocks at once: [step, field, block].  x and ok: [step, block]; fresh: a series begins here.

    Fields: count, mean, M2, M3 of x, then mean, M2 of y and Cxy.
    """
    steps, blocks = ok.shape
    pair = len(x) > 1
    out = np.zeros((steps, 7 if pair else 4, blocks))
    state = np.zeros((out.shape[1], blocks))
    for j in range(steps):
        if fresh[j].any():
            state[:, fresh[j]] = 0.0
        there = ok[j]
        n, mean, m2 = state[0], state[1], state[2]
        n += there
        size = np.maximum(n, 1.0)
        d = np.where(there, x[0][j] - mean, 0.0)
        step = d / size
        if third:
            state[3] += d * step * step * (n - 1) * (n - 2) - 3 * step * m2
        mean += step
        m2 += d * np.where(there, x[0][j] - mean, 0.0)
        if pair:
            e = np.where(there, x[1][j] - state[4], 0.0)
            state[4] += e / size
            after = np.where(there, x[1][j] - state[4], 0.0)
            state[5] += e * after
            state[6] += d * after
        out[j] = state
    return out


def _extreme(x: np.ndarray, fresh: np.ndarray, pick) -> np.ndarray:
    out = np.empty_like(x)
    state = x[0]
    for j in range(len(x)):
        state = np.where(fresh[j], x[j], pick(state, x[j]))
        out[j] = state
    return out


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Chan's formulas over fields of two stretches, [field, row]."""
    out = np.empty_like(a)
    na, nb = a[0], b[0]
    n = np.maximum(na + nb, 1.0)
    d = np.where((na > 0) & (nb > 0), b[1] - a[1], 0.0)
    both = na * nb / n
    out[0] = na + nb
    out[1] = np.where(na > 0, a[1] + d * nb / n, b[1])
    out[2] = a[2] + b[2] + d * d * both
    out[3] = a[3] + b[3] + d**3 * both * (na - nb) / n + 3 * d * (na * b[2] - nb * a[2]) / n
    if len(a) > 4:
        e = np.where((na > 0) & (nb > 0), b[4] - a[4], 0.0)
        out[4] = np.where(na > 0, a[4] + e * nb / n, b[4])
        out[5] = a[5] + b[5] + e * e * both
        out[6] = a[6] + b[6] + d * e * both
    return out


def _window(x: list[np.ndarray], ok: np.ndarray, at: np.ndarray, n: int, kind: str) -> np.ndarray:
    """Fields of the last n rows of each row, [field, row]; `at`: place of a row in its series from 0."""
    rows = len(ok)
    blocks = -(-rows // n)
    shape = lambda v, fill: np.ascontiguousarray(np.concatenate([v, np.full(blocks * n - rows, fill, v.dtype)]).reshape(blocks, n).T)
    xs, there = [shape(v, 0.0) for v in x], shape(ok, False)
    first = at == 0
    begins, ends = shape(first, True), shape(np.concatenate([first[1:], [True]]), True)
    flat = lambda out: np.moveaxis(out, 0, -1).reshape(*out.shape[1:-1], -1)[..., :rows]
    if kind in ("max", "min"):  # NaN is the largest value; a missing one is none
        pick = np.maximum if kind == "max" else np.fmin
        key = np.where(there, xs[0], -np.inf if kind == "max" else np.inf)
        count = lambda ok, fresh: _grow([np.zeros(ok.shape)], ok, fresh, False)[:, 0]
        before = np.stack([_extreme(key, begins, pick), count(there, begins)], axis=1)
        after = np.stack([_extreme(key[::-1], ends[::-1], pick), count(there[::-1], ends[::-1])], axis=1)[::-1]
        merge = lambda a, b: np.stack([pick(a[0], b[0]), a[1] + b[1]])
    else:
        third = kind == "skew"
        before = _grow(xs, there, begins, third)
        after = _grow([v[::-1] for v in xs], there[::-1], ends[::-1], third)[::-1]
        merge = _merge
    prefix, suffix = flat(before), flat(after)
    place = np.arange(rows)
    start = np.maximum(place - np.minimum(at, n - 1), 0)
    crosses = start // n != place // n
    out = prefix.copy()
    out[:, crosses] = merge(suffix[:, start[crosses]], prefix[:, crosses])
    return out


def _figure(roll: Roll, fields: np.ndarray, x: Values, y: Values | None) -> Values:
    """Values of a figure, and where it is there."""
    if roll.kind in ("max", "min"):
        return fields[0], fields[1] >= (roll.least or roll.n)
    n, mean, m2, m3 = fields[:4]
    full = n >= (roll.least or roll.n)
    with np.errstate(all="ignore"):
        if roll.kind == "avg":
            return mean, full
        if roll.kind == "sum":
            return mean * n, full
        if roll.kind == "sd":
            return np.sqrt(m2 / (n - 1)), full & (n > 1)
        if roll.kind == "skew":
            return np.sqrt(n) * m3 / m2**1.5, full & (m2 != 0)
        if roll.kind == "corr":
            return fields[6] / np.sqrt(m2 * fields[5]), full & (m2 * fields[5] != 0)
        slope = fields[6] / fields[5]
        there = full & (fields[5] != 0)
        if roll.kind == "beta":
            return slope, there
        return x[0] - slope * y[0], there & x[1] & y[1]


def _asked(roll: Roll, x: Values, at: np.ndarray) -> Values:
    """A user's function over all whole windows; the windows are views of the values."""
    out, n = np.zeros(len(at)), roll.n
    whole = np.zeros(len(at), dtype=bool)
    if len(at) >= n:
        view = np.lib.stride_tricks.sliding_window_view
        whole[n - 1 :] = view(x[1], n).all(axis=1) & (at[n - 1 :] >= n - 1)
        if whole.any():
            out[whole] = roll.fn(view(x[0], n)[whole[n - 1 :]])
    return out, whole


def _reach(rolls: dict[str, Roll]) -> int:
    """Rows before a row that its figures depend on."""
    reach: dict[str, int] = {}
    for name, r in rolls.items():
        reach[name] = r.n - 1 + max(reach.get(r.x, 0), reach.get(r.y or "", 0))
    return max(reach.values(), default=0)


@np.errstate(all="ignore")
def figures(columns: dict[str, Values], at: np.ndarray, rolls: dict[str, Roll]) -> dict[str, Values]:
    """All figures of sorted rows; figures of the same values and look-back share their moments."""
    known, shared = dict(columns), {}
    for name, r in rolls.items():
        x, y = known[r.x], known[r.y] if r.y else None
        if r.kind == "user":
            known[name] = _asked(r, x, at)
            continue
        kind = r.kind if r.kind in ("max", "min", "skew") else "moments"
        key = (r.x, r.y, r.n, kind)
        if key not in shared:
            ok = x[1] & y[1] if y else x[1]
            shared[key] = _window([v[0] for v in (x, y) if v], ok, at, r.n, kind)
        known[name] = _figure(r, shared[key], x, y)
    return {name: known[name] for name in rolls}


def values(column: pa.ChunkedArray) -> Values:
    there = pc.is_valid(column).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else pc.is_valid(column).to_numpy()
    filled = pc.fill_null(pc.cast(column, pa.float64()), 0.0)
    return filled.to_numpy(), there


def _streamed(rolls: dict[str, Roll], inputs: list[str], rows: int):
    reach = _reach(rolls)

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: tuple[dict[str, Values], np.ndarray] | None = None
        held: list[pa.RecordBatch] = []

        def work() -> Iterator[pa.RecordBatch]:
            nonlocal tail
            table = pa.Table.from_batches(held)
            columns, at = {c: values(table.column(c)) for c in inputs}, table.column("_at").to_numpy().astype(np.int64)
            size = len(at)
            if tail is not None:
                columns = {c: tuple(np.concatenate([t, v]) for t, v in zip(tail[0][c], columns[c])) for c in inputs}
                at = np.concatenate([tail[1], at])
            found = figures(columns, at, rolls)
            keep = max(len(at) - reach, 0) if reach else len(at)
            tail = ({c: (v[keep:], ok[keep:]) for c, (v, ok) in columns.items()}, at[keep:])
            out = table
            for name, (v, ok) in found.items():
                out = out.append_column(name, pa.array(v[-size:], pa.float64(), mask=~ok[-size:]))
            if "_copy" in out.column_names:
                out = out.filter(pc.invert(out.column("_copy"))).drop_columns(["_copy"])
            yield from out.drop_columns(["_at"]).combine_chunks().to_batches()

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from work()
                held = []
        if held:
            yield from work()

    return fn


def sliding(df: DataFrame, rolls: dict[str, Roll], keys: str | list[str] = "ticker", order: str = "date", split: int | None = None, rows: int = ROWS) -> DataFrame:
    """`df` and a double column for each of `rolls`.

    One sort by keys and order; partitioned by the keys (already or by one shuffle).  With `split`, pieces of so many rows and
    the rows they reach back to are dealt to tasks by (keys, piece), for series too long for one task.
    """
    keys = [keys] if isinstance(keys, str) else keys
    placed = df.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    inputs = sorted({c for r in rolls.values() for c in (r.x, r.y) if c and c not in rolls})
    schema = StructType(list(df.schema.fields))
    for name in rolls:
        schema = schema.add(name, DoubleType())
    if split is None:
        return placed.sortWithinPartitions(*keys, order).mapInArrow(_streamed(rolls, inputs, rows), schema)
    reach = _reach(rolls)
    piece = F.floor(F.col("_at") / split)
    # a row belongs to its piece, and in front of every later piece that reaches back to it
    last = F.floor((F.col("_at") + reach) / split)
    cut = placed.withColumn("_piece", F.explode(F.sequence(piece, last))).withColumn("_copy", F.col("_piece") != piece)
    first = F.greatest(F.col("_piece") * split - reach, F.lit(0))
    cut = cut.withColumn("_at", (F.col("_at") - first).cast("int")).repartition(*keys, "_piece")
    return cut.sortWithinPartitions(*keys, "_piece", "_at").drop("_piece").mapInArrow(_streamed(rolls, inputs, rows), schema)
