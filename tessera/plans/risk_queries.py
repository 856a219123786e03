"""Queries K1-K14 and O1-O9 with their SQL."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import sql as S
from tessera.functions.windows import ANNUAL, change, out
from tessera.operators import risk as O
from tessera.operators.joins import asof
from tessera.sources import tables as T

from .base import Book

book = Book()

# Books: a customer's open order lines; weights are value shares, short where the line was returned.
POS = S.BARS + """, last AS (SELECT ticker, arg_max(px, date) AS price FROM bars GROUP BY ticker),
    trades AS (SELECT o_custkey AS portfolio_id, ticker, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, l_quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O'),
    positions AS (SELECT portfolio_id, t.ticker, sum(q)::DOUBLE AS qty, sum(cents) / 100.0 / sum(l_quantity) AS entry_price, any_value(price) AS current_price, sum(q)::DOUBLE * any_value(price) AS market_value
      FROM trades t JOIN last USING (ticker) GROUP BY portfolio_id, t.ticker HAVING sum(q) <> 0),
    vals AS (SELECT portfolio_id, sum(abs(market_value)) AS value FROM positions GROUP BY 1),
    books AS (SELECT portfolio_id, ticker, market_value / value AS weight FROM positions JOIN vals USING (portfolio_id))"""
RETURNS = POS.replace(S.BARS, S.FILLED)


def positions(spark, d, bars=None):
    last = (bars or T.bars(spark, d)).groupBy("ticker").agg(F.max_by("px", "date").alias("current_price"))
    o = T.table(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_custkey").alias("portfolio_id"))
    lines = T.table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").cast("string").alias("ticker"), "l_quantity", "l_extendedprice", "l_returnflag")
    q = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    held = lines.join(o, lines.l_orderkey == o.o_orderkey).groupBy("portfolio_id", "ticker").agg(
        F.sum(q).alias("qty"), (F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / 100.0 / F.sum("l_quantity")).alias("entry_price")
    )
    return held.where("qty <> 0").join(last, "ticker").withColumn("market_value", F.col("qty") * F.col("current_price"))


def values(pos):
    return pos.groupBy("portfolio_id").agg(F.sum(F.abs("market_value")).alias("value"))


def weighted(pos):
    value = F.sum(F.abs("market_value")).over(Window.partitionBy("portfolio_id"))
    return pos.select("portfolio_id", "ticker", (F.col("market_value") / value).alias("weight"))


def books(spark, d):
    return weighted(positions(spark, d))


def sectored(spark, d):
    return books(spark, d).join(T.dimensions(spark, d), "ticker", "left")


P = ["portfolio_id"]
SHOW = lambda df: df.select("portfolio_id", "ticker", out(F.col("weight")).alias("weight"))
W6 = S.out("weight") + " AS weight"
book.add(
    "k1_panel_gate",
    lambda s, d: O.panel_gate(T.bars(s, d), "2001-11-05"),
    S.BARS + """, g AS (SELECT date, count(px) AS names, count(*) FILTER (abs(r) > 0.25) AS moves FROM own GROUP BY date ORDER BY date DESC LIMIT 1)
    SELECT CAST(DATE '2001-11-05' - date AS INT) AS age, names, moves, DATE '2001-11-05' - date <= 5 AND names >= 20 AND moves <= 6 AS ok FROM g""",
)
book.add(
    "k2_book_sanity",
    lambda s, d: O.book_sanity(books(s, d), P).withColumn("gross", out(F.col("gross"))),
    POS + f"""SELECT portfolio_id, count(*) FILTER (abs(weight) > 0.01) AS positions, {S.out("sum(abs(weight))")} AS gross,
    concat_ws(';', CASE WHEN count(*) FILTER (abs(weight) > 0.01) < 3 THEN 'few positions' END, CASE WHEN sum(abs(weight)) > 1.5 THEN 'gross exposure' END) AS warnings FROM books GROUP BY 1""",
)
LIMITED = POS + S.DIMENSIONS + """, k1 AS (SELECT portfolio_id, b.ticker, sector, greatest(-0.05, least(0.05, weight)) AS weight FROM books b LEFT JOIN dims USING (ticker)),
    k2 AS (SELECT * FROM k1 WHERE abs(weight) >= 0.004 QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY abs(weight) DESC, ticker) <= 80),
    k3 AS (SELECT *, sum(greatest(weight, 0)) OVER (PARTITION BY portfolio_id, sector) AS s FROM k2),
    limited AS (SELECT portfolio_id, ticker, CASE WHEN weight > 0 AND s > 0.25 THEN weight * 0.25 / s ELSE weight END AS weight FROM k3)"""
RESERVED = ", reserved AS (SELECT portfolio_id, ticker, CASE WHEN weight > 0 AND l > {0} THEN weight * 0.98 / l ELSE weight END AS weight FROM (SELECT *, sum(greatest(weight, 0)) OVER (PARTITION BY portfolio_id) AS l FROM {1}))"
book.add("k3_position_limits", lambda s, d: SHOW(O.position_limits(sectored(s, d), P)), LIMITED + f"SELECT portfolio_id, ticker, {W6} FROM limited")
_double = lambda df: df.withColumn("weight", F.col("weight") * 2)
book.add(
    "k4_cash_reserve",
    lambda s, d: SHOW(O.cash_reserve(_double(books(s, d)), P)),
    POS + ", doubled AS (SELECT portfolio_id, ticker, weight * 2 AS weight FROM books)" + RESERVED.format(1.03, "doubled") + f"SELECT portfolio_id, ticker, {W6} FROM reserved",
)
#: Returns of weeks that follow each other; a missing week has none, nor the week after it.
GAPPED = POS.replace(S.BARS, S.PANEL) + f""", wk AS (SELECT ticker, date, {S.change("px", 1)} AS r FROM panel)"""
WEEKS = ", wk AS (SELECT ticker, date, r FROM panel)"
RECENT = """, held AS (SELECT portfolio_id, ticker, weight, count(*) OVER (PARTITION BY portfolio_id) AS size FROM {0} WHERE abs(weight) > 0.01),
    whole AS (SELECT portfolio_id, date FROM held h JOIN wk USING (ticker) WHERE r IS NOT NULL AND size >= 2 GROUP BY portfolio_id, date, size HAVING count(*) = size
      QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) <= 63),
    recent AS (SELECT h.portfolio_id, h.ticker, weight, date, r FROM held h JOIN whole w USING (portfolio_id) JOIN wk USING (ticker, date) WHERE size >= 2)"""
VAR = RECENT + ", vr AS (SELECT portfolio_id, stddev_samp(x) * 1.645 AS var95 FROM (SELECT portfolio_id, date, sum(weight * r) AS x FROM recent GROUP BY 1, 2) GROUP BY 1)"
CORR = """, still AS (SELECT portfolio_id, count(*) AS names, min(sd) AS least FROM (SELECT portfolio_id, ticker, stddev_samp(r) AS sd FROM recent GROUP BY 1, 2) GROUP BY 1),
    pairs AS (SELECT portfolio_id, corr(a.r, b.r) AS c FROM recent a JOIN recent b USING (portfolio_id, date) WHERE a.ticker < b.ticker GROUP BY portfolio_id, a.ticker, b.ticker),
    alike AS (SELECT portfolio_id, names, CASE WHEN least > 0 THEN mean END AS correlation, coalesce(CASE WHEN least > 0 THEN mean END > 0.70, false) AS warn
      FROM still LEFT JOIN (SELECT portfolio_id, avg(CASE WHEN isfinite(c) THEN c END) AS mean FROM pairs GROUP BY 1) USING (portfolio_id))"""


def _weekly(s, d):
    return T.panel(s, d).withColumn("r", change("px", 1)).select("ticker", "date", "r")


for name, base, rows in (("", RETURNS + WEEKS, T.filled_panel), ("_gaps", GAPPED, _weekly)):
    book.add(
        "k5_value_at_risk" if not name else "k5_gaps",
        lambda s, d, rows=rows: O.value_at_risk(books(s, d), rows(s, d), P).select("portfolio_id", out(F.col("var95")).alias("var95")),
        base + VAR.format("books") + f"SELECT portfolio_id, {S.out('var95')} AS var95 FROM vr",
    )
    book.add(
        "k6_average_correlation" if not name else "k6_gaps",
        lambda s, d, rows=rows: O.average_correlation(books(s, d), rows(s, d), P).withColumn("correlation", out(F.col("correlation"))),
        base + RECENT.format("books") + CORR + f"SELECT portfolio_id, {S.out('correlation')} AS correlation, names, warn FROM alike",
    )
book.add(
    "k7_stop_breaches",
    lambda s, d: O.stop_breaches(positions(s, d)).select("portfolio_id", "ticker", out(F.col("pnl")).alias("pnl")),
    POS + f"SELECT portfolio_id, ticker, {S.out('(current_price / entry_price - 1) * sign(qty)')} AS pnl FROM positions WHERE entry_price > 0 AND (current_price / entry_price - 1) * sign(qty) <= -0.08",
)


def _breakers(s, d):
    v = T.filled_panel(s, d).where("px is not null").select(F.col("ticker").alias("portfolio_id"), "date", F.col("px").alias("value"))
    fear = asof(v.select("date").distinct(), T.macro(s, d).where("series_id = '3-MEDIUM'").select("date", (F.col("value") / 10000).alias("vix")), "date", ["vix"])
    return O.breakers(v, fear)


BREAK = S.FILLED + S.MACRO + """, v AS (SELECT p.ticker AS portfolio_id, p.date, px AS value, row_number() OVER (PARTITION BY ticker ORDER BY p.date) AS k FROM panel p WHERE px IS NOT NULL),
    fr AS (SELECT c.date, m.value / 10000 AS vix FROM (SELECT DISTINCT date FROM v) c ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = '3-MEDIUM') m ON c.date >= m.date),
    b AS (SELECT portfolio_id, v.date, value, value / nullif(lag(value) OVER w, 0) - 1 AS daily, value / nullif(CASE WHEN k >= 6 THEN lag(value, 5) OVER w WHEN k = 5 THEN first_value(value) OVER w END, 0) - 1 AS weekly,
      value / nullif(max(value) OVER (PARTITION BY portfolio_id ORDER BY v.date ROWS UNBOUNDED PRECEDING), 0) - 1 AS drawdown, vix FROM v LEFT JOIN fr ON fr.date = v.date WINDOW w AS (PARTITION BY portfolio_id ORDER BY v.date)),
    t AS (SELECT *, coalesce(daily <= -0.03, false) AS a, coalesce(weekly <= -0.05, false) AS b, coalesce(drawdown <= -0.15, false) AS c, coalesce(vix >= 35, false) AS e FROM b)"""
for name, column in (("k8_daily_breaker", "daily"), ("k9_weekly_breaker", "weekly"), ("k10_drawdown_breaker", "drawdown"), ("k11_vix_breaker", "vix")):
    test = {"daily": "daily <= -0.03", "weekly": "weekly <= -0.05", "drawdown": "drawdown <= -0.15", "vix": "vix >= 35"}[column]
    book.add(
        name,
        lambda s, d, c=column, t=test: _breakers(s, d).where(t).select("portfolio_id", "date", out(F.col(c)).alias(c)),
        BREAK + f"SELECT portfolio_id, date, {S.out(column)} AS {column} FROM t WHERE {test}",
    )
book.add(
    "k12_breakers",
    lambda s, d: _breakers(s, d).select("portfolio_id", "date", "halt", "reduce", "factor", "tripped"),
    BREAK + """SELECT portfolio_id, date, a OR c AS halt, b OR e AS reduce, CASE WHEN b OR c OR e THEN 0.5::DOUBLE ELSE 1.0 END AS factor,
    concat_ws(',', CASE WHEN a THEN 'daily_loss' END, CASE WHEN b THEN 'weekly_loss' END, CASE WHEN c THEN 'max_drawdown' END, CASE WHEN e THEN 'vix_level' END) AS tripped FROM t""",
)
#: Weeks of its own history that a book's breakers look at.
HISTORY = 63


def _halts(s, d, pos, panel):
    """Each book's breakers on the last day, over its long value of the last HISTORY weeks: one word of days."""
    words, calendar = O.words_of(panel, "px")
    calendar = T.stored(calendar.where(F.col("day") < HISTORY))
    days = calendar.agg(F.lit(0).alias("word"), F.bit_or(F.expr("shiftleft(1L, day)")).alias("bits"))  # one row
    rows = pos.select("portfolio_id", "ticker", F.abs("qty").cast("double").alias("weight")).crossJoin(F.broadcast(days))
    worth = O.daily_sums(rows, T.stored(words.where("word = 0")), P, ["ret"])
    v = worth.join(F.broadcast(calendar), worth.k == calendar.day).select("portfolio_id", "date", F.col("ret").alias("value"))
    fear = asof(calendar.select("date"), T.macro(s, d).where("series_id = '3-MEDIUM'").select("date", (F.col("value") / 10000).alias("vix")), "date", ["vix"])
    return O.breakers(v, F.broadcast(fear)).groupBy("portfolio_id").agg(F.max_by(F.struct("halt", "tripped"), "date").alias("b")).select("portfolio_id", "b.*")  # fear: a row a week


def _validated(s, d, late=0, moves=10**6):
    """As of `late` days after the last week.  The weekly panel moves more than a daily one, so the gate's limit of moves is a parameter."""
    bars = T.stored(T.bars(s, d).select("ticker", "date", "px"))
    last = bars.agg(F.max("date")).first()[0] or date.min  # one value
    gate = T.stored(O.panel_gate(bars, str(last + timedelta(days=late)), most_moves=moves).select("ok", O.gate_errors(most_moves=moves).alias("errors")))
    pos, panel, halts = T.stored(positions(s, d, bars)), T.dense(bars).select("ticker", "date", F.col("pf").alias("px"), "r"), None
    if gate.first().ok:  # one row; a gate that fails ends the validation before returns and halts are read
        panel = T.stored(panel)
        halts = _halts(s, d, pos, panel)
    return O.validate(weighted(pos).join(T.dimensions(s, d), "ticker", "left"), panel, P, gate, halts)


HALTS = S.MACRO + f""", hv AS (SELECT portfolio_id, date, sum(abs(qty) * px) AS value FROM positions JOIN (SELECT ticker, date, px FROM panel WHERE i > (SELECT max(i) FROM panel) - {HISTORY}) USING (ticker) GROUP BY 1, 2),
    hk AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY date) AS k FROM hv),
    hb AS (SELECT portfolio_id, h.date, value / nullif(lag(value) OVER w, 0) - 1 AS daily, value / nullif(CASE WHEN k >= 6 THEN lag(value, 5) OVER w WHEN k = 5 THEN first_value(value) OVER w END, 0) - 1 AS weekly,
      value / nullif(max(value) OVER (PARTITION BY portfolio_id ORDER BY h.date ROWS UNBOUNDED PRECEDING), 0) - 1 AS drawdown, level AS vix FROM hk h
      ASOF LEFT JOIN (SELECT date, value / 10000 AS level FROM macro WHERE series_id = '3-MEDIUM') f ON h.date >= f.date WINDOW w AS (PARTITION BY portfolio_id ORDER BY h.date)),
    halts AS (SELECT portfolio_id, coalesce(daily <= -0.03, false) OR coalesce(drawdown <= -0.15, false) AS halt,
      concat_ws(',', CASE WHEN daily <= -0.03 THEN 'daily_loss' END, CASE WHEN weekly <= -0.05 THEN 'weekly_loss' END, CASE WHEN drawdown <= -0.15 THEN 'max_drawdown' END, CASE WHEN vix >= 35 THEN 'vix_level' END) AS tripped
      FROM hb QUALIFY row_number() OVER (PARTITION BY portfolio_id ORDER BY date DESC) = 1)"""
CHECKED = (
    LIMITED.replace(S.BARS, S.FILLED) + RESERVED.format(1.03, "limited") + WEEKS + VAR.format("reserved") + CORR + HALTS
    + """, said AS (SELECT portfolio_id, concat_ws(';', CASE WHEN count(*) FILTER (abs(weight) > 0.01) < 3 THEN 'few positions' END, CASE WHEN sum(abs(weight)) > 1.5 THEN 'gross exposure' END,
        CASE WHEN max(abs(weight)) > 0.05 THEN 'position cap' END, CASE WHEN count(*) FILTER (abs(weight) >= 0.004) > 80 THEN 'too many positions' END) AS a FROM books GROUP BY 1),
    spread AS (SELECT portfolio_id, bool_or(s > 0.25) AS over FROM k3 GROUP BY 1), lng AS (SELECT portfolio_id, sum(greatest(weight, 0)) AS l FROM limited GROUP BY 1),
    verdicts AS (SELECT portfolio_id, NOT coalesce(halt, false) AS approved, CASE WHEN halt THEN 'circuit breaker: ' || tripped ELSE '' END AS rejections,
      concat_ws(';', nullif(a, ''), CASE WHEN over THEN 'sector exposure' END, CASE WHEN l > 1.03 THEN 'cash reserve' END, CASE WHEN var95 > 0.02 THEN 'value at risk' END, CASE WHEN warn THEN 'correlation' END) AS warnings
      FROM said LEFT JOIN spread USING (portfolio_id) LEFT JOIN lng USING (portfolio_id) LEFT JOIN vr USING (portfolio_id) LEFT JOIN alike USING (portfolio_id) LEFT JOIN halts USING (portfolio_id))"""
)
book.add(
    "k13_validated",
    lambda s, d: SHOW(_validated(s, d)[0]),
    CHECKED + f"SELECT portfolio_id, ticker, {S.out('weight * CASE WHEN var95 > 0.02 THEN 0.02 / var95 ELSE 1.0 END')} AS weight FROM reserved LEFT JOIN vr USING (portfolio_id) JOIN verdicts USING (portfolio_id) WHERE approved",
)
book.add("k13_verdicts", lambda s, d: _validated(s, d)[1], CHECKED + "SELECT * FROM verdicts")
book.add(
    "k13_gate_fails",
    # four weeks later the same prices are stale: every book is rejected before its limits are looked at
    lambda s, d: _validated(s, d, 28)[1],
    POS + "SELECT DISTINCT portfolio_id, false AS approved, 'stale prices' AS rejections, '' AS warnings FROM books",
)


def _health(s, d):
    own = T.own_series(s, d)
    m = own.groupBy("ticker").agg((F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(ANNUAL)) - 5).alias("sharpe"), (F.min("px") / F.max("px") - 0.9).alias("drawdown"), (F.max_by("px", "date") / F.min_by("px", "date") - 1).alias("cumulative"))
    return m.select("ticker", F.concat_ws(",", O.health_warnings()).alias("warnings"))


book.add(
    "k14_health",
    _health,
    S.BARS + """, m AS (SELECT ticker, avg(r) / stddev_samp(r) * sqrt(252) - 5 AS s, min(px) / max(px) - 0.9 AS d, arg_max(px, date) / arg_min(px, date) - 1 AS c FROM own GROUP BY ticker)
    SELECT ticker, concat_ws(',', CASE WHEN s < 0 THEN 'negative sharpe' WHEN s < 0.3 THEN 'low sharpe' END, CASE WHEN d < -0.15 THEN 'deep drawdown' WHEN d < -0.10 THEN 'drawdown' END, CASE WHEN c < -0.05 THEN 'losing' END) AS warnings FROM m""",
)

# ---- orders: every book is moved to equal long weights in the names of its first orders -------


def _orders(s, d, most=O.MAX_ORDERS):
    pos = positions(s, d)
    n = F.col("ticker").cast("int")
    side = F.when((n + F.col("portfolio_id")) % 4 == 0, -0.03).when((n + F.col("portfolio_id")) % 4 == 1, 0.05).when((n + F.col("portfolio_id")) % 4 == 2, 0.0)
    targets = pos.select("portfolio_id", (n + 1).cast("string").alias("ticker")).unionByName(pos.select("portfolio_id", "ticker")).distinct()
    targets = targets.withColumn("weight", side).where("weight is not null")
    prices = T.bars(s, d).groupBy("ticker").agg(F.max_by("px", "date").alias("price"))
    return O.rebalance_orders(targets, pos.select("portfolio_id", "ticker", "qty", "market_value", "current_price"), prices, values(pos), None, most)


ORD = POS + """, tg AS (SELECT * FROM (SELECT portfolio_id, ticker, CASE (CAST(ticker AS INT) + portfolio_id) % 4 WHEN 0 THEN -0.03 WHEN 1 THEN 0.05 WHEN 2 THEN 0.0 END::DOUBLE AS weight FROM (
      SELECT portfolio_id, CAST(CAST(ticker AS INT) + 1 AS VARCHAR) AS ticker FROM positions UNION SELECT portfolio_id, ticker FROM positions)) WHERE weight IS NOT NULL),
    o0 AS (SELECT coalesce(t.portfolio_id, p.portfolio_id) AS portfolio_id, coalesce(t.ticker, p.ticker) AS ticker, coalesce(qty, 0) AS q, coalesce(weight, 0) AS w, coalesce(market_value, 0) AS mv, current_price
      FROM tg t FULL OUTER JOIN positions p ON t.portfolio_id = p.portfolio_id AND t.ticker = p.ticker),
    o1 AS (SELECT o.*, value AS pv, coalesce(price, CASE WHEN q <> 0 THEN current_price END) AS p FROM o0 o JOIN vals USING (portfolio_id) LEFT JOIN last ON last.ticker = o.ticker),
    o2 AS (SELECT *, CASE WHEN abs(w) < 0.004 THEN 0 WHEN w < 0 THEN floor(abs(w * pv / p)) * -1 ELSE w * pv / p END AS goal FROM o1 WHERE p > 0),
    o3 AS (SELECT *, CASE WHEN w < 0 THEN floor(abs(goal - q)) * sign(goal - q) ELSE goal - q END AS step FROM o2),
    o4 AS (
      SELECT portfolio_id, ticker, -q AS signed, 0 AS priority, 'close' AS reason, p FROM o3 WHERE q <> 0 AND (goal = 0 OR sign(q) <> sign(goal))
      UNION ALL SELECT portfolio_id, ticker, goal, CASE WHEN goal > 0 THEN 3 ELSE 2 END, 'open', p FROM o3 WHERE goal <> 0 AND (q = 0 OR sign(q) <> sign(goal))
      UNION ALL SELECT portfolio_id, ticker, step, CASE WHEN abs(goal) <= abs(q) THEN 1 WHEN goal > 0 THEN 3 ELSE 2 END, CASE WHEN abs(goal) > abs(q) THEN 'increase' ELSE 'reduce' END, p FROM o3
        WHERE q <> 0 AND goal <> 0 AND sign(q) = sign(goal) AND abs(w - mv / pv) >= greatest(0.0035, 0.20 * abs(w)) AND abs(step) >= CASE WHEN w < 0 THEN 1 ELSE 0.001 END),
    o5 AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY priority, round(abs(signed) * p, 6) DESC, ticker) AS k, count(*) FILTER (priority <= 1) OVER (PARTITION BY portfolio_id) AS urgent FROM o4),
    ords AS (SELECT portfolio_id, ticker, CASE WHEN signed > 0 THEN 'buy' ELSE 'sell' END AS side, abs(signed) AS quantity, abs(signed) * p AS estimated_value, priority, reason FROM o5 WHERE priority <= 1 OR k <= greatest({0}, urgent))"""
ROW = ["portfolio_id", "ticker", "side", "priority", "reason"]
_show = lambda df: df.select(*ROW, out(F.col("quantity"), 4).alias("quantity"), out(F.col("estimated_value")).alias("estimated_value"))
SEL = f"SELECT {', '.join(ROW)}, {S.out('quantity', 4)} AS quantity, {S.out('estimated_value')} AS estimated_value FROM ords"
book.add("o1_rebalance_diff", lambda s, d: _show(_orders(s, d, 10**6)), ORD.replace("{0}", "1000000") + SEL)
book.add("o2_whole_shares", lambda s, d: _show(_orders(s, d, 10**6)).where("side = 'sell' and reason = 'open'"), ORD.replace("{0}", "1000000") + SEL + " WHERE side = 'sell' AND reason = 'open'")
for name, reasons in (("o3_side_crossing", ("close", "open")), ("o4_drift_gate", ("increase", "reduce")), ("o5_priorities", ("close", "open", "increase", "reduce"))):
    book.add(
        name,
        lambda s, d, r=reasons: _orders(s, d, 10**6).where(F.col("reason").isin(*r)).groupBy("portfolio_id", "priority", "reason").agg(F.count(F.lit(1)).alias("n")),
        ORD.replace("{0}", "1000000") + f"SELECT portfolio_id, priority, reason, count(*) AS n FROM ords WHERE reason IN {reasons} GROUP BY ALL",
    )
book.add("o6_order_cap", lambda s, d: _show(_orders(s, d, 6)), ORD.replace("{0}", "6") + SEL)
book.add(
    "o7_turnover",
    lambda s, d: O.turnover(books(s, d), O.position_limits(sectored(s, d), P)).select("portfolio_id", out(F.col("turnover")).alias("turnover")),
    LIMITED + f"SELECT portfolio_id, {S.out('sum(abs(coalesce(a.weight, 0) - coalesce(b.weight, 0))) / 2')} AS turnover FROM books a FULL OUTER JOIN limited b USING (portfolio_id, ticker) GROUP BY 1",
)
book.add(
    "o8_phase_totals",
    lambda s, d: O.phase_totals(_orders(s, d)).withColumn("value", out(F.col("value"))),
    ORD.replace("{0}", "60") + f"SELECT portfolio_id, CASE WHEN priority <= 1 THEN 'close' ELSE 'open' END AS phase, count(*) AS orders, {S.out('sum(estimated_value)')} AS value FROM ords GROUP BY ALL",
)
book.add("o9_fill_summary", lambda s, d: O.fill_summary(T.table(s, d, "orders").withColumnRenamed("o_orderstatus", "status")), "SELECT o_orderstatus AS status, count(*) AS orders FROM orders GROUP BY 1")
