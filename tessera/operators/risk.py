"""Risk limits and monitoring (K1-K14), orders."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from tessera.functions.windows import lag, ratio
from tessera.sources.tables import stored

POSITION_CAP, DUST, MOST_POSITIONS, SECTOR_CAP = 0.05, 0.004, 80, 0.25
MAX_ORDERS = 60
#: Days in a word of bits.
WORD = 63
#: Rows of books and names in a tile, about.
TILE_ROWS, TILE_NAMES = 1_000_000, 100_000


def _over(*keys: str):
    return Window.partitionBy(*keys)


def panel_gate(bars: DataFrame, asof: str, max_age: int = 5, least: int = 20, most_moves: int = 6, move: float = 0.25) -> DataFrame:
    """K1: one row - age in days, names on the last date, large moves, ok."""
    moved = bars.withColumn("_r", ratio(F.col("px"), lag("px", 1)) - 1)
    last = moved.groupBy("date").agg(F.count("px").alias("names"), F.count(F.when(F.abs("_r") > move, 1)).alias("moves")).orderBy(F.desc("date")).limit(1)
    age = F.datediff(F.lit(asof).cast("date"), "date")
    return last.select(age.alias("age"), "names", "moves", ((age <= max_age) & (F.col("names") >= least) & (F.col("moves") <= most_moves)).alias("ok"))


def gate_errors(max_age: int = 5, least: int = 20, most_moves: int = 6) -> Column:
    """K1: what a gate (age, names, moves) fails for, joined by ';'."""
    return F.concat_ws(";", F.when(F.col("age") > max_age, "stale prices"), F.when(F.col("names") < least, "few names"), F.when(F.col("moves") > most_moves, "large moves"))


def book_sanity(targets: DataFrame, keys: list[str]) -> DataFrame:
    """K2."""
    s = targets.groupBy(*keys).agg(F.count(F.when(F.abs("weight") > 0.01, 1)).alias("positions"), F.sum(F.abs("weight")).alias("gross"))
    warn = F.array_compact(F.array(F.when(F.col("positions") < 3, "few positions"), F.when(F.col("gross") > 1.5, "gross exposure")))
    return s.withColumn("warnings", F.concat_ws(";", warn))


def position_limits(targets: DataFrame, keys: list[str]) -> DataFrame:
    """K3: cap, drop dust, keep the largest 80, scale sectors over 25 % on the long side."""
    w = F.col("weight")
    s = targets.withColumn("weight", F.greatest(F.lit(-POSITION_CAP), F.least(F.lit(POSITION_CAP), w))).where(F.abs(w) >= DUST)
    s = s.withColumn("_k", F.row_number().over(_over(*keys).orderBy(F.desc(F.abs(w)), "ticker"))).where(F.col("_k") <= MOST_POSITIONS)
    long = F.sum(F.when(w > 0, w).otherwise(0.0)).over(_over(*keys, "sector"))
    s = s.withColumn("_s", long)
    return s.withColumn("weight", F.when((w > 0) & (F.col("_s") > SECTOR_CAP), w * SECTOR_CAP / F.col("_s")).otherwise(w)).drop("_k", "_s")


def cash_reserve(targets: DataFrame, keys: list[str], limit: float = 1.03, to: float = 0.98) -> DataFrame:
    """K4."""
    w = F.col("weight")
    s = targets.withColumn("_l", F.sum(F.when(w > 0, w).otherwise(0.0)).over(_over(*keys)))
    return s.withColumn("weight", F.when((w > 0) & (F.col("_l") > limit), w * to / F.col("_l")).otherwise(w)).drop("_l")


def active(targets: DataFrame, keys: list[str], least_weight: float = 0.01) -> DataFrame:
    """Names of more than `least_weight` of the books that have two of them or more, with _size."""
    held = targets.where(F.abs("weight") > least_weight).select(*keys, "ticker", "weight")
    return held.withColumn("_size", F.count(F.lit(1)).over(_over(*keys))).where("_size >= 2")


def words_of(series: DataFrame, x: str) -> tuple[DataFrame, DataFrame]:
    """(words, calendar) of a panel's column x.

    calendar: date, day - the dates with a value, the newest is day 0.  words: ticker, word, bits, values - WORD days of
    a name, a bit where it has a value, and those values in the order of their bits.
    """
    there = series.where(F.col(x).isNotNull()).select("ticker", "date", F.col(x).cast("double").alias("_x"))
    calendar = there.select("date").distinct().withColumn("day", F.row_number().over(Window.orderBy(F.desc("date"))) - 1)  # a row a date
    days = there.join(F.broadcast(calendar), "date").withColumn("_b", F.col("day") % WORD)
    words = days.groupBy("ticker", F.expr(f"day div {WORD}").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _b)")).alias("bits"), F.array_sort(F.collect_list(F.struct("_b", "_x"))).getField("_x").alias("values")
    )
    return words, calendar


def complete_words(held: DataFrame, words: DataFrame, keys: list[str], n: int = 63) -> DataFrame:
    """keys, word, bits: the last n days on which every name of a book has a value; `held` as from `active`.

    A book's bits are its names' bits and-ed, so that books meet words, not days, and a name goes to its books as one row.
    Words are taken from the newest until n bits are found.
    """
    names = words.groupBy("ticker").agg(F.collect_list(F.struct("word", "bits")).alias("_w"))
    met = held.join(names, "ticker").repartition(*keys).select(*keys, "_size", F.explode("_w").alias("_w"))
    found = met.groupBy(*keys, F.col("_w.word").alias("word")).agg(F.bit_and("_w.bits").alias("bits"), F.count(F.lit(1)).alias("_n"), F.max("_size").alias("_size"))
    newer = F.sum(F.bit_count("bits")).over(_over(*keys).orderBy("word").rowsBetween(Window.unboundedPreceding, -1))
    # a name without the word has none of its days
    found = found.where("_n = _size and bits <> 0").withColumn("_left", n - F.coalesce(newer, F.lit(0))).where("_left > 0")
    newest = F.expr(f"slice(filter(sequence(0, {WORD - 1}), b -> getbit(bits, b) = 1), 1, cast(_left as int))")
    kept = F.when(F.bit_count("bits") <= F.col("_left"), F.col("bits")).otherwise(F.aggregate(newest, F.lit(0).cast("long"), lambda bits, b: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))))
    return found.select(*keys, "word", kept.alias("bits"))


def _tile(keys: list[str], figures: list[str]):
    """A tile's part of the sums: rows (keys, ticker, weight, word, bits) and the words of its names."""

    def unpack(bits: np.ndarray) -> np.ndarray:
        return (bits[:, None] >> np.arange(WORD)) & 1 == 1

    def fn(rows: pa.Table, names: pa.Table) -> pa.Table:
        known, width = pd.Index(names["ticker"].to_pandas().unique()), int(pc.max(rows["word"]).as_py() or 0) + 1 if rows.num_rows else 1
        number = lambda t: known.get_indexer(t["ticker"].to_pandas()) * width + t["word"].to_numpy()
        has = names.filter(pc.less(names["word"], width))
        at = number(has)
        order = np.argsort(at, kind="stable")
        # values by place; the last row is a name without the word
        there = np.append(has["bits"].to_numpy(), 0)
        value = np.zeros((len(there), WORD))
        value[unpack(there)] = pc.list_flatten(has["values"]).to_numpy()
        at = at[order]

        book = rows.select(keys).to_pandas().groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        name, word = known.get_indexer(rows["ticker"].to_pandas()), rows["word"].to_numpy()
        place = np.lexsort((word, name, book))
        book, name, word = book[place], name[place], word[place]
        weight, bits = rows["weight"].to_numpy()[place], rows["bits"].to_numpy()[place]
        if len(at):
            found = np.minimum(np.searchsorted(at, name * width + word), len(at) - 1)
            found = np.where((name >= 0) & (at[found] == name * width + word), order[found], len(order))
        else:
            found = np.zeros(len(book), np.int64)
        cuts = [0, *(c for c in np.flatnonzero(np.diff(book)) + 1), len(book)]
        out, begin = {c: [] for c in ("row", "bits", "names", "still", *figures)}, 0
        for end in cuts[1:]:  # whole books, some thousands of rows at a time
            if end - begin < 8192 and end < len(book):
                continue
            part = slice(begin, end)
            mask = unpack(bits[part] & there[found[part]])
            x = np.where(mask, value[found[part]], 0.0)
            sums, still = {}, np.zeros(end - begin, np.int64)
            if "ret" in figures:
                sums["ret"] = x * weight[part, None]
            if "z" in figures:
                starts = np.flatnonzero(np.r_[True, (np.diff(book[part]) != 0) | (np.diff(name[part]) != 0)])
                each = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, end - begin]))
                n = np.add.reduceat(mask.sum(axis=1), starts)
                d = np.where(mask, x - (np.add.reduceat(x.sum(axis=1), starts) / np.maximum(n, 1))[each, None], 0.0)
                sd = np.sqrt(np.add.reduceat((d * d).sum(axis=1), starts) / np.maximum(n - 1, 1))
                low = np.minimum.reduceat(np.where(mask, x, np.inf).min(axis=1), starts)
                high = np.maximum.reduceat(np.where(mask, x, -np.inf).max(axis=1), starts)
                rests = (n < 2) | (low >= high) | (sd == 0)
                sums["z"] = d / np.where(rests, 1.0, sd)[each, None]
                still = rests[each].astype(np.int64)
            by = np.lexsort((word[part], book[part]))
            starts = np.flatnonzero(np.r_[True, (np.diff(book[part][by]) != 0) | (np.diff(word[part][by]) != 0)])
            asked = unpack(bits[part][by][starts])
            some = np.logical_or.reduceat(mask[by], starts, axis=0)
            out["row"].append(place[part][by][starts])
            out["bits"].append(asked.sum(axis=1))
            out["names"].append(np.diff(np.r_[starts, end - begin]))
            out["still"].append(np.add.reduceat(still[by], starts))
            for f, v in sums.items():
                total = np.add.reduceat(v[by], starts, axis=0)
                out[f].append(pa.array(total[asked], mask=~some[asked]))
            begin = end
        first = np.concatenate([*out["row"], np.zeros(0, np.int64)])
        ends = pa.array(np.r_[0, np.cumsum(np.concatenate([*out["bits"], np.zeros(0, np.int64)]))].astype(np.int32))
        made = rows.select([*keys, "word"]).take(pa.array(first))
        for c in ("names", "still"):
            made = made.append_column(c, pa.array(np.concatenate([*out[c], np.zeros(0, np.int64)])))
        for f in figures:
            made = made.append_column(f, pa.ListArray.from_arrays(ends, pa.concat_arrays([*out[f], pa.array([], pa.float64())])))
        return made

    return fn


def daily_sums(rows: DataFrame, words: DataFrame, keys: list[str], figures: list[str]) -> DataFrame:
    """keys, word, k, names, still and for each of `figures` its sum over a book's names on the k-th of its days of a word.

    rows: keys, ticker, weight, word, bits (the days asked for); words: from `words_of`, stored.  `ret` sums weight times value, `z` the values standardised over the name's days;
    `still` counts names that don't move.  NULL where no name has a value.

    Names times days are never rows: books and names are dealt to tiles of about TILE_ROWS rows and TILE_NAMES names, a tile
    gets the words of its names once, and books leave it with one row a word.
    """
    rows = stored(rows)
    across = -(-words.agg(F.count_distinct("ticker")).first()[0] // TILE_NAMES) or 1  # one number
    down = -(-rows.count() // (TILE_ROWS * across)) or 1  # one number
    tile = ["_p", "_q"]
    dealt = rows.withColumns({"_p": F.pmod(F.xxhash64(*keys), F.lit(down)), "_q": F.pmod(F.xxhash64("ticker"), F.lit(across))})
    named = dealt.select(*tile, "ticker", "word").distinct().join(words, ["ticker", "word"])
    named = named.select(*(F.col(c).alias(c) for c in ("_p", "_q", "ticker", "word", "bits", "values")))  # names of its own for the cogroup
    schema = StructType([rows.schema[c] for c in (*keys, "word")]).add("names", "long").add("still", "long")
    for f in figures:
        schema = schema.add(f, ArrayType(DoubleType()))
    work = _tile(keys, figures)
    parts = dealt.groupBy(*tile).cogroup(named.groupBy(*tile)).applyInArrow(work, schema).repartition(*keys)
    each = parts.select(*keys, "word", "names", "still", F.posexplode(F.arrays_zip(*figures)).alias("k", "_s"))
    return each.groupBy(*keys, "word", "k").agg(F.sum("names").alias("names"), F.sum("still").alias("still"), *(F.sum(f"_s.{f}").alias(f) for f in figures))


def recent_sums(targets: DataFrame, returns: DataFrame, keys: list[str], figures: list[str], n: int, least_weight: float) -> DataFrame:
    """`daily_sums` of the returns over each book's last n complete rows."""
    held = stored(active(targets, keys, least_weight))
    words = stored(words_of(returns, "r")[0])
    days = complete_words(held, words, keys, n)
    return daily_sums(held.drop("_size").join(days, keys), words, keys, figures)


def _var(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys).agg((F.sqrt(F.var_samp("ret")) * 1.645).alias("var95"))


def _alike(sums: DataFrame, keys: list[str], limit: float) -> DataFrame:
    m = F.max("names")
    mean = F.when(F.max("still") == 0, (F.var_samp("z") - m) / (m * (m - 1)))
    return sums.groupBy(*keys).agg(mean.alias("correlation"), m.alias("names")).withColumn("warn", F.coalesce(F.col("correlation") > limit, F.lit(False)))


def value_at_risk(targets: DataFrame, returns: DataFrame, keys: list[str], n: int = 63, least_weight: float = 0.01) -> DataFrame:
    """K5: keys, var95 over the last n complete rows of a book's names; w'Sw is the variance of the book's daily return, so no matrix is made."""
    return _var(recent_sums(targets, returns, keys, ["ret"], n, least_weight), keys)


def scale_to_var(targets: DataFrame, var: DataFrame, keys: list[str], limit: float = 0.02) -> DataFrame:
    """K5, second half: books over the limit are scaled down."""
    joined = targets.join(var, keys, "left")
    return joined.withColumn("weight", F.col("weight") * F.coalesce(F.when(F.col("var95") > limit, limit / F.col("var95")), F.lit(1.0))).drop("var95")


def average_correlation(targets: DataFrame, returns: DataFrame, keys: list[str], n: int = 63, least_weight: float = 0.01, limit: float = 0.70) -> DataFrame:
    """K6: keys, correlation, names, warn - the mean pairwise correlation of a book's names over its last n complete rows.

    (var(sum z) - m) / (m (m - 1)), linear in the names; NULL where a name does not move or fewer than two rows are complete.
    """
    return _alike(recent_sums(targets, returns, keys, ["z"], n, least_weight), keys, limit)


def stop_breaches(positions: DataFrame, limit: float = -0.08) -> DataFrame:
    """K7: a missing result or entry price is no breach."""
    pnl = F.when(F.col("entry_price") > 0, ratio(F.col("current_price"), F.col("entry_price")) - 1) * F.signum("qty")
    return positions.withColumn("pnl", F.coalesce(pnl, F.lit(0.0))).where(F.col("pnl") <= limit)


def breakers(values: DataFrame, fear: DataFrame, key: str = "portfolio_id") -> DataFrame:
    """K8-K12 for every day: values (key, date, value) and fear (date, vix; already as-of joined)."""
    w = Window.partitionBy(key).orderBy("date")
    v = F.col("value")
    rows = values.join(fear, "date", "left").withColumn("_k", F.row_number().over(w))
    five = F.when(F.col("_k") >= 6, F.lag("value", 5).over(w)).when(F.col("_k") == 5, F.first("value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.select(
        key, "date", "value", (ratio(v, F.lag("value", 1).over(w)) - 1).alias("daily"), (ratio(v, five) - 1).alias("weekly"),
        (ratio(v, F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1).alias("drawdown"), "vix",
    )
    tests = {"daily_loss": F.col("daily") <= -0.03, "weekly_loss": F.col("weekly") <= -0.05, "max_drawdown": F.col("drawdown") <= -0.15, "vix_level": F.col("vix") >= 35}
    on = {n: F.coalesce(c, F.lit(False)) for n, c in tests.items()}
    names = F.concat_ws(",", *(F.when(c, F.lit(n)) for n, c in on.items()))
    factor = F.least(*(F.when(on[n], f).otherwise(1.0) for n, f in (("daily_loss", 1.0), ("weekly_loss", 0.5), ("max_drawdown", 0.5), ("vix_level", 0.5))))
    return rows.select("*", (on["daily_loss"] | on["max_drawdown"]).alias("halt"), (on["weekly_loss"] | on["vix_level"]).alias("reduce"), factor.alias("factor"), names.alias("tripped"))


def validate(targets: DataFrame, returns: DataFrame, keys: list[str], gate: DataFrame, halts: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(weights, verdicts) of the whole validation.

    gate: one row with ok and errors (K1); halts: keys, halt, tripped (unread if the gate fails).  A gate that fails rejects every book and stops there; then sanity warns,
    limits, reserve and VaR change the weights and warn, and a breaker's halt rejects the book.  Rejected books are empty.
    verdicts: keys, approved, rejections, warnings (joined by ';').
    """
    w = F.col("weight")
    passed = gate.first()  # one row
    if not passed.ok:
        rejected = targets.select(*keys).distinct().select(*keys, F.lit(False).alias("approved"), F.lit(passed.errors).alias("rejections"), F.lit("").alias("warnings"))
        return targets.limit(0), rejected
    targets = stored(targets)
    sane = book_sanity(targets, keys).select(*keys, "warnings")
    capped = targets.groupBy(*keys).agg(F.max((F.abs(w) > POSITION_CAP).cast("int")).alias("_cap"), F.count(F.when(F.abs(w) >= DUST, 1)).alias("_many"))
    whole = _over(*keys, "sector")
    clipped = targets.withColumn("weight", F.greatest(F.lit(-POSITION_CAP), F.least(F.lit(POSITION_CAP), w))).where(F.abs(w) >= DUST)
    clipped = clipped.withColumn("_k", F.row_number().over(_over(*keys).orderBy(F.desc(F.abs(w)), "ticker"))).where(F.col("_k") <= MOST_POSITIONS)
    sectors = clipped.withColumn("_s", F.sum(F.when(w > 0, w).otherwise(0.0)).over(whole)).groupBy(*keys).agg(F.max((F.col("_s") > SECTOR_CAP).cast("int")).alias("_sector"))
    limited = stored(position_limits(targets, keys))
    long = limited.groupBy(*keys).agg(F.sum(F.when(w > 0, w).otherwise(0.0)).alias("_long"))
    reserved = cash_reserve(limited, keys)
    sums = recent_sums(reserved, returns, keys, ["ret", "z"], 63, 0.01)
    risk = stored(_var(sums, keys).join(_alike(sums, keys, 0.70), keys))
    var, alike = risk.select(*keys, "var95"), risk.select(*keys, F.col("warn").alias("_alike"))
    scaled = scale_to_var(reserved, var, keys)
    books = sane
    for part in (capped, sectors, long, var, alike, halts.select(*keys, "halt", "tripped")):
        books = books.join(part, keys, "left")
    stopped = F.coalesce("halt", F.lit(False))
    said = F.concat_ws(
        ";", F.when(F.col("warnings") != "", F.col("warnings")), F.when(F.col("_cap") == 1, "position cap"), F.when(F.col("_many") > MOST_POSITIONS, "too many positions"),
        F.when(F.col("_sector") == 1, "sector exposure"), F.when(F.col("_long") > 1.03, "cash reserve"), F.when(F.col("var95") > 0.02, "value at risk"), F.when(F.col("_alike"), "correlation"),
    )
    reasons = F.when(stopped, F.concat(F.lit("circuit breaker: "), F.col("tripped"))).otherwise("")
    verdicts = books.select(*keys, (~stopped).alias("approved"), reasons.alias("rejections"), said.alias("warnings"))
    return scaled.join(verdicts.where("approved").select(*keys), keys, "left_semi"), verdicts


def health_warnings() -> Column:
    """K14 over columns sharpe, drawdown and cumulative."""
    s, d, c = F.col("sharpe"), F.col("drawdown"), F.col("cumulative")
    return F.array_compact(F.array(
        F.when(s < 0, "negative sharpe").when(s < 0.3, "low sharpe"), F.when(d < -0.15, "deep drawdown").when(d < -0.10, "drawdown"), F.when(c < -0.05, "losing"),
    ))


# ---- orders --------------------------------------------------------------------------------


def rebalance_orders(targets: DataFrame, positions: DataFrame, prices: DataFrame, values: DataFrame, fractional: tuple | None = None, most: int = MAX_ORDERS) -> DataFrame:
    """portfolio_id, ticker, side, quantity, estimated_value, priority, reason.

    targets (portfolio_id, ticker, weight), positions (portfolio_id, ticker, qty, market_value,
    current_price), prices (ticker, price), values (portfolio_id, value).  Closes have priority
    0, reductions 1, shorts 2, buys 3.  Short or non-fractionable orders are whole shares,
    rounded toward zero; `fractional` lists the names that may be split (None: all).
    """
    key = ["portfolio_id", "ticker"]
    both = targets.join(positions, key, "full_outer").join(values, "portfolio_id").join(prices, "ticker", "left")
    qty, tw, pv = F.coalesce("qty", F.lit(0.0)), F.coalesce("weight", F.lit(0.0)), F.col("value")
    price = F.coalesce("price", F.when(qty != 0, F.col("current_price")))
    x = both.select(*key, qty.alias("q"), tw.alias("w"), pv.alias("pv"), price.alias("p"), F.coalesce("market_value", F.lit(0.0)).alias("mv"))
    splits = F.lit(True) if fractional is None else F.col("ticker").isin(*fractional)
    want = F.col("w") * F.col("pv") / F.col("p")
    whole = (F.col("w") < 0) | ~splits
    x = x.where(F.col("p") > 0).withColumn("goal", F.when(F.abs("w") < DUST, F.lit(0.0)).when(whole, F.floor(F.abs(want)) * F.signum(want)).otherwise(want))
    x = x.withColumn("delta", F.col("goal") - F.col("q")).withColumn("cw", F.col("mv") / F.col("pv")).withColumn("whole", whole)
    held, aimed = F.col("q") != 0, F.col("goal") != 0
    closing = held & ~aimed
    crossing = held & aimed & (F.signum("q") != F.signum("goal"))
    step = F.when(F.col("whole"), F.floor(F.abs("delta")) * F.signum("delta")).otherwise(F.col("delta"))
    drift = F.abs(F.col("w") - F.col("cw")) >= F.greatest(F.lit(0.0035), 0.20 * F.abs("w"))
    least = F.abs("step") >= F.when(F.col("whole"), F.lit(1.0)).otherwise(F.lit(1e-3))
    grows = F.abs("goal") > F.abs("q")
    x = x.withColumn("step", step)
    opening = F.when(F.col("goal") > 0, 3).otherwise(2)

    def order(signed: Column, priority: Column | int, reason: str) -> Column:
        p = priority if isinstance(priority, Column) else F.lit(priority)
        return F.struct(signed.alias("signed"), p.cast("int").alias("priority"), F.lit(reason).alias("reason"))

    close = order(-F.col("q"), 0, "close")
    rows = (
        F.when(closing, F.array(close))
        .when(crossing, F.array(close, order(F.col("goal"), opening, "open")))
        .when(~held & aimed, F.array(order(F.col("goal"), opening, "open")))
        .when(held & aimed & drift & least, F.array(F.when(grows, order(F.col("step"), opening, "increase")).otherwise(order(F.col("step"), 1, "reduce"))))
    )
    orders = x.withColumn("o", F.explode(rows)).select(
        *key, F.when(F.col("o.signed") > 0, "buy").otherwise("sell").alias("side"), F.abs("o.signed").alias("quantity"),
        (F.abs("o.signed") * F.col("p")).alias("estimated_value"), "o.priority", "o.reason",
    )
    w = _over("portfolio_id")
    ranked = orders.withColumn("_urgent", F.count(F.when(F.col("priority") <= 1, 1)).over(w))
    ranked = ranked.withColumn("_k", F.row_number().over(w.orderBy("priority", F.desc(F.round("estimated_value", 6)), "ticker")))
    return ranked.where((F.col("priority") <= 1) | (F.col("_k") <= F.greatest(F.lit(most), F.col("_urgent")))).drop("_urgent", "_k")


def turnover(old: DataFrame, new: DataFrame) -> DataFrame:
    """One-sided, by portfolio; inputs portfolio_id, ticker, weight."""
    both = old.select("portfolio_id", "ticker", F.col("weight").alias("a")).join(new.select("portfolio_id", "ticker", F.col("weight").alias("b")), ["portfolio_id", "ticker"], "full_outer")
    return both.groupBy("portfolio_id").agg((F.sum(F.abs(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))) / 2).alias("turnover"))


def phase_totals(orders: DataFrame) -> DataFrame:
    """O8."""
    phase = F.when(F.col("priority") <= 1, "close").otherwise("open")
    return orders.groupBy("portfolio_id", phase.alias("phase")).agg(F.count(F.lit(1)).alias("orders"), F.sum("estimated_value").alias("value"))


def fill_summary(fills: DataFrame) -> DataFrame:
    """O9."""
    return fills.groupBy("status").agg(F.count(F.lit(1)).alias("orders"))
