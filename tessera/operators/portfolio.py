"""Portfolio construction (P1-P19).  Rows are (portfolio keys, ticker, weight); KEYS default to the date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessera.functions.windows import ANNUAL, last_values

MAX_POSITION, DUST, VOL_FLOOR = 0.05, 0.004, 0.05
DATE = ["date"]


def _over(*keys: str) -> WindowSpec:
    return Window.partitionBy(*keys)


def median(values: Column) -> Column:
    """Of the values of an array that are there."""
    held = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(held)
    return F.when(n > 0, (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2)


def eligibility(panel: DataFrame, dims: DataFrame, min_price: float = 5.0, min_rows: int = 252, min_dollars: float = 1e7, exempt: tuple = (), gated: tuple = (), on: Column | None = None) -> DataFrame:
    """`panel` with eligible, on the rows `on` (default all).

    The median dollar volume of 21 rows is taken from shifts of the rows that count, without a frame.
    """
    history = F.count("px").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    on = F.lit(True) if on is None else on
    rows = panel.withColumns({"_n": history, "_d": last_values(F.col("px") * F.col("volume"), 21), "_on": on}).where("_on").drop("_on")
    known = rows.withColumn("_d", median(F.col("_d"))).join(dims, "ticker", "left")
    liquid = (F.col("_d") >= min_dollars) | F.col("asset_class").isin(*exempt)
    ok = (F.col("px") >= min_price) & (F.col("_n") >= min_rows) & liquid & ~F.col("asset_class").isin(*gated)
    return known.withColumn("eligible", F.coalesce(ok, F.lit(False))).drop("_n", "_d")


def select_legs(scored: DataFrame, longs: int = 40, shorts: int = 20, no_short: tuple = ("fixed_income", "alternative"), keys: list[str] = DATE) -> DataFrame:
    """Leg (1 long, -1 short).  The short pool is the bottom 2 x shorts; names that may not be sold leave it, then the lowest `shorts` count."""
    s = scored.where(F.col("score").isNotNull())
    w = _over(*keys)
    # the order from below is that from above reversed: one sort, and only both ends go on
    s = s.withColumn("_top", F.row_number().over(w.orderBy(F.desc("score"), "ticker"))).withColumn("_low", F.count(F.lit(1)).over(w) + 1 - F.col("_top"))
    s = s.where((F.col("_top") <= longs) | (F.col("_low") <= 2 * shorts))
    pool = (F.col("_low") <= 2 * shorts) & ~F.coalesce(F.col("asset_class").isin(*no_short), F.lit(False))
    s = s.withColumn("_k", F.sum(pool.cast("int")).over(w.orderBy("score", F.desc("ticker")).rowsBetween(Window.unboundedPreceding, 0)))
    leg = F.when(F.col("_top") <= longs, 1).when(pool & (F.col("_k") <= shorts), -1)
    return s.withColumn("leg", leg).where(F.col("leg").isNotNull()).drop("_top", "_low", "_k")


def leg_gross(gross: Column, net: Column, cash: float = 0.02) -> Column:
    """P5: of column leg."""
    long = F.least((gross + net) / 2, F.lit(1 - cash))
    return F.when(F.col("leg") == 1, F.greatest(long, F.lit(0.0))).otherwise(F.greatest((gross - net) / 2, F.lit(0.0)))


def inverse_vol(legs: DataFrame, cap: float = MAX_POSITION, keys: list[str] = DATE) -> DataFrame:
    """Weight (positive) of every name of a leg; needs vol and leg_gross.

    Cap and redistribute is four rounds of window sums over the leg: what exceeds the cap
    goes to the names below it in proportion.  Then dust goes and the leg is scaled back.
    """
    w = _over(*keys, "leg")
    spare = F.coalesce(F.expr("percentile(vol, 0.5)").over(w), F.lit(0.20))
    out = legs.where(F.col("leg_gross") > 0).withColumn("_inv", 1 / F.coalesce(F.greatest(F.col("vol"), F.when(F.col("vol").isNotNull(), F.lit(VOL_FLOOR))), spare))
    out = out.withColumn("weight", F.col("_inv") / F.sum("_inv").over(w) * F.col("leg_gross"))
    x = F.col("weight")
    for _ in range(4):
        out = out.withColumn("_excess", F.sum(F.greatest(x - cap, F.lit(0.0))).over(w)).withColumn("_room", F.sum(F.when(x < cap, x)).over(w))
        out = out.withColumn("weight", F.when(x > cap, F.lit(cap)).when((x < cap) & (F.col("_excess") > 0), x + F.col("_excess") * x / F.col("_room")).otherwise(x))
    out = out.withColumn("weight", F.least(x, F.lit(cap))).where(x >= DUST)
    scale = F.least(F.col("leg_gross") / F.sum(x).over(w), F.lit(cap) / F.max(x).over(w))
    return out.withColumn("weight", x * scale).drop("_inv", "_excess", "_room")


def sector_cap(weights: DataFrame, long_cap: float = 0.20, short_cap: float = 0.10, keys: list[str] = DATE) -> DataFrame:
    """Scale sectors of a leg that exceed their cap; drop dust."""
    held = weights.withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    total = F.sum(F.abs("weight")).over(_over(*keys, "leg", "sector"))
    cap = F.when(F.col("leg") == 1, F.lit(long_cap)).otherwise(F.lit(short_cap))
    return held.withColumn("weight", F.col("weight") * F.least(F.lit(1.0), cap / total)).where(F.abs("weight") >= DUST)


def build_targets(scored: DataFrame, gross: float | Column, net: float | Column, longs: int = 40, shorts: int = 20, keys: list[str] = DATE, **caps) -> DataFrame:
    """Keys, ticker, leg, sector and the signed weight; `scored` has score, vol, sector, asset_class."""
    legs = select_legs(scored, longs, shorts, keys=keys).withColumn("leg_gross", leg_gross(*(x if isinstance(x, Column) else F.lit(x) for x in (gross, net))))
    return sector_cap(inverse_vol(legs, keys=keys), keys=keys, **caps).withColumn("weight", F.col("weight") * F.col("leg"))


def book_summary(targets: DataFrame, capital: float = 1e5, cash: float = 0.02, keys: list[str] = DATE) -> DataFrame:
    """P6."""
    w = F.col("weight")
    return targets.groupBy(*keys).agg(
        F.sum(F.abs(w)).alias("gross"), F.sum(w).alias("net"), F.count(F.when(w > 0, 1)).alias("n_long"), F.count(F.when(w < 0, 1)).alias("n_short"),
        (1 - F.sum(F.when(w > 0, w).otherwise(0.0))).alias("cash"), (F.sum(F.abs(w)) * capital).alias("dollars"),
    )


def sleeve_targets(scored: DataFrame, target_vol: float = 0.08, floor: float = 0.04, asset_cap: float = 0.12, class_cap: float = 0.35, gross_cap: float = 1.0, dust: float = 0.005) -> DataFrame:
    """Score x target / (max(vol, floor) sqrt(n)); missing vols take the median of the floored ones, or 0.15."""
    live = scored.where(F.col("score").isNotNull() & (F.col("score") != 0))
    w = _over("date")
    floored = live.withColumn("v", F.when(F.col("vol").isNotNull(), F.greatest("vol", F.lit(floor))))
    floored = floored.withColumn("v", F.coalesce("v", F.expr("percentile(v, 0.5)").over(w), F.lit(0.15)))
    raw = F.col("score") * target_vol / (F.col("v") * F.sqrt(F.count(F.lit(1)).over(w).cast("double")))
    x = floored.withColumn("weight", raw).withColumn("weight", F.greatest(F.lit(-asset_cap), F.least(F.lit(asset_cap), F.col("weight"))))
    x = x.withColumn("weight", F.col("weight") * F.least(F.lit(1.0), class_cap / F.sum(F.abs("weight")).over(_over("date", "asset_class"))))
    x = x.withColumn("weight", F.col("weight") * F.least(F.lit(1.0), gross_cap / F.sum(F.abs("weight")).over(w)))
    return x.where(F.abs("weight") >= dust)


def risk_parity(panel: DataFrame, groups: DataFrame, core: float = 0.7, tilt: float = 0.05, bond_floor: float = 0.02, n: int = 63) -> DataFrame:
    """Weights by ticker at the last date.  Group returns are means over complete rows, of which n are needed; inverse volatility
    across groups; a tilt from bonds to equity where both are there; equal inside."""
    rows = panel.where(F.col("r").isNotNull()).join(groups, "ticker")
    width = groups.join(panel.select("ticker").distinct(), "ticker").groupBy("grp").agg(F.count(F.lit(1)).alias("width"))
    daily = rows.groupBy("grp", "date").agg(F.avg("r").alias("r"), F.count(F.lit(1)).alias("n")).join(width, "grp").where("n = width")
    last = daily.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("date")))).where(F.col("k") <= n)
    vol = last.groupBy("grp", "width").agg((F.stddev_samp("r") * F.sqrt(F.lit(ANNUAL))).alias("vol"), F.count(F.lit(1)).alias("n")).where(F.expr(f"vol > 0 and n >= {n}"))
    share = vol.withColumn("w", 1 / F.col("vol") / F.sum(1 / F.col("vol")).over(Window.partitionBy()) * core)
    every = Window.partitionBy()  # a row a group
    both = F.max(F.col("grp") == "fixed_income").over(every) & F.max(F.col("grp") == "equity").over(every)
    moved = F.when(~both, F.col("w")).when(F.col("grp") == "fixed_income", F.greatest(F.col("w") - tilt, F.lit(bond_floor))).when(F.col("grp") == "equity", F.col("w") + tilt).otherwise(F.col("w"))
    return share.withColumn("w", moved).select("grp", (F.col("w") / F.col("width")).alias("weight")).join(groups, "grp").select("ticker", "grp", "weight")


def alpha_tilt(scores: DataFrame, satellite: float = 0.3, least: float = 0.05, most: float = 0.10) -> DataFrame:
    """Scores over `least`, normalised to the satellite share, clipped at `most`, normalised again."""
    w = _over("date")
    s = scores.where(F.col("score") > least).withColumn("weight", F.col("score") / F.sum("score").over(w) * satellite)
    s = s.withColumn("weight", F.least("weight", F.lit(most)))
    return s.withColumn("weight", F.col("weight") / F.sum("weight").over(w) * satellite)


def combine(core: DataFrame, satellite: DataFrame, cap: float = 0.10, cash: float = 0.02) -> DataFrame:
    """P10: sums by name, capped, scaled down to 1 - cash."""
    both = core.select("date", "ticker", "weight").unionByName(satellite.select("date", "ticker", "weight")).groupBy("date", "ticker").agg(F.sum("weight").alias("weight"))
    both = both.withColumn("weight", F.least("weight", F.lit(cap)))
    return both.withColumn("weight", F.col("weight") * F.least(F.lit(1.0), (1 - cash) / F.sum("weight").over(_over("date"))))


def dynamic_kelly(weights: DataFrame, k: float = 0.5) -> DataFrame:
    """Needs weight and score."""
    s = F.col("score")
    factor = F.when(s > 0, k + (1 - k) * F.least(F.abs(s), F.lit(2.0)) / 2 * 0.5).otherwise(F.lit(k * 0.5))
    return weights.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight") * factor).otherwise(F.lit(0.0)))


#: Fixed cash shares by regime; others count as TRANSITION.
CASH = {"CALM": 0.10, "TRANSITION": 0.20, "CRISIS": 0.30}


def trend_filter(weights: DataFrame, trend: DataFrame) -> DataFrame:
    """Class multipliers by the benchmark against its average (date, above, label); scaled down where more than 1 - cash is invested."""
    known = weights.join(trend, "date")
    up = F.col("above") & (F.col("label") == "CALM")
    equity, bond = F.col("asset_class") == "equity", F.col("asset_class") == "fixed_income"
    factor = F.when(up & equity, 1.15).when(up & bond, 0.85).when(~F.col("above") & equity, 0.80).when(~F.col("above") & bond, 1.20).otherwise(1.0)
    w = _over("date")
    moved = known.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight") * factor).otherwise(F.col("weight")))
    cash = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in CASH.items() for x in kv)), F.col("label")), F.lit(CASH["TRANSITION"]))
    invested = F.sum(F.when(F.col("weight") > 0, F.col("weight"))).over(w)
    over = (F.col("weight") > 0) & (invested > 1 - cash)
    return moved.withColumn("weight", F.when(over, F.col("weight") * (1 - cash) / invested).otherwise(F.col("weight")))


def score_weights(scores: DataFrame, top: int = 10, cap: float = 0.15, cash: float = 0.05) -> DataFrame:
    """1 - cash over the best positive scores in proportion, capped; renormalised only if they sum to more than that."""
    w = _over("date")
    s = scores.where(F.col("score") > 0).withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "ticker"))).where(F.col("_k") <= top)
    s = s.withColumn("weight", F.least(F.col("score") / F.sum("score").over(w) * (1 - cash), F.lit(cap)))
    return s.withColumn("weight", F.col("weight") * (1 - cash) / F.greatest(F.lit(1 - cash), F.sum("weight").over(w))).drop("_k")


def top_n_by_group(scores: DataFrame, n: int = 15, most: int = 3, group: str = "sector") -> DataFrame:
    """Walking down the ranking with at most `most` names a group = rank within group, then rank overall."""
    order = [F.desc("score"), F.col("ticker")]
    s = scores.where(F.col("score").isNotNull()).withColumn("_g", F.row_number().over(_over("date", group).orderBy(*order))).where(F.col("_g") <= most)
    return s.withColumn("rank", F.row_number().over(_over("date").orderBy(*order))).where(F.col("rank") <= n).drop("_g")


def substitute(picks: DataFrame, mapping: DataFrame, k: int = 5) -> DataFrame:
    """The first k picks become their mapped names; equal weights."""
    known = picks.join(mapping, "ticker", "left")  # a small fixed map
    name = F.when((F.col("rank") <= k) & F.col("mapped").isNotNull(), F.col("mapped")).otherwise(F.col("ticker"))
    return known.withColumn("held", name).withColumn("weight", 1.0 / F.count(F.lit(1)).over(_over("date")))


def crisis_allocation(scores: DataFrame, top: int = 4, cap: float = 0.35, rest: float = 0.02, parking: str = "BIL") -> DataFrame:
    """Date, ticker, weight; what is left goes to the parking name."""
    w = _over("date")
    s = scores.where(F.col("score").isNotNull()).withColumn("_k", F.row_number().over(w.orderBy(F.desc("score"), "ticker"))).where(F.col("_k") <= top)
    s = s.withColumn("_x", F.greatest("score", F.lit(0.001)))
    s = s.select("date", "ticker", F.least(F.col("_x") / F.sum("_x").over(w), F.lit(cap)).alias("weight"))
    left = s.groupBy("date").agg((1 - F.sum("weight")).alias("weight")).where(F.col("weight") > rest)
    return s.unionByName(left.select("date", F.lit(parking).alias("ticker"), "weight"))


def long_short_engine(scored: DataFrame, longs: int = 15, shorts: int = 10, long_w: float = 0.024, short_w: float = 0.018, least: int = 25, min_price: float = 10.0, most: int | None = None) -> DataFrame:
    """Momentum + 0.03 alpha, fixed weights at both ends; needs mom, alpha, px.  `most`: names a sector (column sector) at either end."""
    s = scored.where((F.col("px") >= min_price) & F.col("mom").isNotNull()).withColumn("score", F.col("mom") + 0.03 * F.coalesce("alpha", F.lit(0.0)))
    w = _over("date")
    s = s.withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_n") >= least)
    down, up = [F.desc("score"), F.col("ticker")], [F.col("score"), F.desc("ticker")]
    s = s.withColumn("_in_top", F.lit(True)).withColumn("_in_low", F.lit(True))
    if most is not None:  # walking along the ranking with at most `most` a sector = rank within the sector, then rank overall
        group = _over("date", "sector")
        s = s.withColumn("_in_top", F.row_number().over(group.orderBy(*down)) <= most).withColumn("_in_low", F.row_number().over(group.orderBy(*up)) <= most)
    s = s.withColumn("_top", F.when(F.col("_in_top"), F.sum(F.col("_in_top").cast("int")).over(w.orderBy(*down).rowsBetween(Window.unboundedPreceding, 0))))
    s = s.withColumn("_low", F.when(F.col("_in_low"), F.sum(F.col("_in_low").cast("int")).over(w.orderBy(*up).rowsBetween(Window.unboundedPreceding, 0))))
    weight = F.when(F.col("_top") <= longs, long_w).when(F.col("_low") <= shorts, -short_w)
    return s.withColumn("weight", weight).where(F.col("weight").isNotNull()).drop("_n", "_top", "_low", "_in_top", "_in_low")


def leverage_budget(weights: DataFrame, budget: float = 2.5, cap: float = 0.35) -> DataFrame:
    """Needs weight and lev; dust goes and names are capped, then levered names are scaled to the budget and the total to one at most."""
    w = _over("date")
    weights = weights.where(F.col("weight") > 0.005).withColumn("weight", F.least("weight", F.lit(cap)))
    used = F.sum(F.abs("lev") * F.col("weight")).over(w)
    s = weights.withColumn("_used", used)
    s = s.withColumn("weight", F.when((F.col("_used") > budget) & (F.abs("lev") > 1), F.col("weight") * budget / F.col("_used")).otherwise(F.col("weight")))
    return s.withColumn("weight", F.col("weight") / F.greatest(F.lit(1.0), F.sum("weight").over(w))).drop("_used")


def equity_floor(weights: DataFrame, floor: float = 0.30) -> DataFrame:
    """Scale equity up to the floor where it falls short."""
    equity = F.sum(F.when(F.col("asset_class") == "equity", F.col("weight")).otherwise(0.0)).over(_over("date"))
    s = weights.withColumn("_e", equity)
    short = (F.col("asset_class") == "equity") & (F.col("_e") > 0) & (F.col("_e") < floor)
    return s.withColumn("weight", F.when(short, F.col("weight") * floor / F.col("_e")).otherwise(F.col("weight"))).drop("_e")

