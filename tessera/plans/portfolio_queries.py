"""Queries P1-P19 with their SQL.  Scores are composites on every 21st row of the weekly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql as S
from tessera.functions.sliding import sd
from tessera.functions.windows import ANNUAL, out
from tessera.operators import portfolio as O
from tessera.operators import signals as SG
from tessera.operators.regime import sma
from tessera.sources import tables as T

from .base import Book
from .signal_queries import COMPOSITE, RAW, SD, WEIGHTS

book = Book()


def scored(spark, d):
    """date, ticker, score (rounded), vol, px, sector, asset_class on rebalance rows."""
    signals = SG.production_signals(T.filled_panel(spark, d), on=F.expr("i % 21 = 0"), keep=("i", "px"), rolls={"vol": sd("r", 63)})
    score = SG.combine(signals, WEIGHTS).select("ticker", "date", "i", "px", (F.col("vol") * F.sqrt(F.lit(ANNUAL))).alias("vol"), out(F.col("composite")).alias("score"))
    return score.join(T.dimensions(spark, d), "ticker", "left")


SCORED = RAW + S.DIMENSIONS + f""", vols AS (SELECT ticker, date, i, px, {SD(63)} * sqrt(252) AS vol FROM panel),
    base AS MATERIALIZED (SELECT s.ticker, s.date, v.i, v.px, {S.out(COMPOSITE)} AS score, vol, sector, asset_class FROM signals s JOIN vols v ON s.ticker = v.ticker AND s.date = v.date
      LEFT JOIN dims ON dims.ticker = s.ticker WHERE v.i % 21 = 0)"""  # fmt: skip
SHOW = lambda df, *more: df.select("date", "ticker", *more, out(F.col("weight")).alias("weight"))
W6 = S.out("weight") + " AS weight"

book.add(
    "p1_eligibility",
    lambda s, d: O.eligibility(T.filled_panel(s, d), T.dimensions(s, d), 5, 200, 60000, ("fixed_income",), ("leveraged",)).groupBy("date").agg(F.count(F.when(F.col("eligible"), 1)).alias("n")),
    S.FILLED + S.DIMENSIONS
    + f""", x AS (SELECT p.*, asset_class, count(px) OVER (PARTITION BY p.ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS n,
      quantile_cont(px * volume, 0.5) OVER (PARTITION BY p.ticker ORDER BY date ROWS 20 PRECEDING) AS dollars FROM panel p LEFT JOIN dims USING (ticker))
    SELECT date, count(*) FILTER (px >= 5 AND n >= 200 AND (dollars >= 60000 OR asset_class = 'fixed_income') AND asset_class <> 'leveraged') AS n FROM x GROUP BY date""",
)
L, SH = 20, 10
LEGS = SCORED + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS top, row_number() OVER (PARTITION BY date ORDER BY score, ticker DESC) AS low FROM base WHERE score IS NOT NULL),
    pooled AS (SELECT *, low <= {2 * SH} AND asset_class NOT IN ('fixed_income', 'alternative') AS pool FROM ranked),
    legs AS (SELECT * FROM (SELECT *, CASE WHEN top <= {L} THEN 1 WHEN pool AND sum(pool::INT) OVER (PARTITION BY date ORDER BY low ROWS UNBOUNDED PRECEDING) <= {SH} THEN -1 END AS leg FROM pooled) WHERE leg IS NOT NULL)"""
book.add("p2_legs", lambda s, d: O.select_legs(scored(s, d), L, SH).select("date", "ticker", "leg"), LEGS + "SELECT date, ticker, leg FROM legs")
GROSS = "CASE WHEN leg = 1 THEN greatest(least((1.0 + 0.8) / 2, 0.98), 0) ELSE greatest((1.0 - 0.8) / 2, 0) END"
KW = "PARTITION BY date, leg"


def _rounds(source: str) -> str:
    text = f""", w0 AS (SELECT *, inv / sum(inv) OVER ({KW}) * g AS weight FROM (SELECT *, {GROSS}::DOUBLE AS g, 1 / coalesce(CASE WHEN vol IS NOT NULL THEN greatest(vol, 0.05) END, median(vol) OVER ({KW}), 0.20) AS inv FROM {source}))"""
    for k in range(4):
        text += f""", e{k} AS (SELECT *, sum(greatest(weight - 0.05, 0)) OVER ({KW}) AS excess, sum(CASE WHEN weight < 0.05 THEN weight END) OVER ({KW}) AS room FROM w{k}),
        w{k + 1} AS (SELECT * EXCLUDE (excess, room) REPLACE (CASE WHEN weight > 0.05 THEN 0.05 WHEN weight < 0.05 AND excess > 0 THEN weight + excess * weight / room ELSE weight END AS weight) FROM e{k})"""
    return text + f""", iv AS (SELECT * REPLACE (weight * least(g / sum(weight) OVER ({KW}), 0.05 / max(weight) OVER ({KW})) AS weight) FROM (SELECT * REPLACE (least(weight, 0.05) AS weight) FROM w4) WHERE weight >= 0.004)"""


IV = LEGS + _rounds("legs")
_legs = lambda s, d: O.select_legs(scored(s, d), L, SH).withColumn("leg_gross", O.leg_gross(F.lit(1.0), F.lit(0.8)))
book.add("p3_inverse_vol", lambda s, d: SHOW(O.inverse_vol(_legs(s, d)), "leg"), IV + f"SELECT date, ticker, leg, {W6} FROM iv")
CAPPED = IV + """, tg AS (SELECT date, ticker, leg, sector, weight * leg AS weight FROM (SELECT * REPLACE (weight * least(1.0, CASE WHEN leg = 1 THEN 0.30 ELSE 0.10 END / sum(abs(weight)) OVER (PARTITION BY date, leg, coalesce(sector, 'Unknown'))) AS weight) FROM iv) WHERE abs(weight) >= 0.004)"""
targets = lambda s, d: O.build_targets(scored(s, d), 1.0, 0.8, L, SH, long_cap=0.30)
book.add("p4_sector_cap", lambda s, d: SHOW(targets(s, d), "leg"), CAPPED + f"SELECT date, ticker, leg, {W6} FROM tg")
book.add("p5_leg_gross", lambda s, d: _legs(s, d).select("date", "leg", out(F.col("leg_gross")).alias("leg_gross")).distinct(), LEGS + f"SELECT DISTINCT date, leg, {S.out(f'({GROSS})::DOUBLE')} AS leg_gross FROM legs")
SUMS = ("gross", "net", "cash", "dollars")
book.add(
    "p6_book_summary",
    lambda s, d: O.book_summary(targets(s, d)).select("date", "n_long", "n_short", *(out(F.col(c), 4).alias(c) for c in SUMS)),
    CAPPED + f"""SELECT date, {S.out("sum(abs(weight))", 4)} AS gross, {S.out("sum(weight)", 4)} AS net, count(*) FILTER (weight > 0) AS n_long, count(*) FILTER (weight < 0) AS n_short,
    {S.out("1 - sum(greatest(weight, 0))", 4)} AS cash, {S.out("sum(abs(weight)) * 100000", 4)} AS dollars FROM tg GROUP BY date""",
)
book.add(
    "p7_sleeve",
    lambda s, d: SHOW(O.sleeve_targets(scored(s, d), 2.0)),
    SCORED
    + f""", v0 AS (SELECT *, CASE WHEN vol IS NOT NULL THEN greatest(vol, 0.04) END AS v FROM base WHERE score <> 0),
    v1 AS (SELECT *, greatest(-0.12, least(0.12, score * 2.0 / (coalesce(v, median(v) OVER (PARTITION BY date), 0.15) * sqrt(count(*) OVER (PARTITION BY date))))) AS weight FROM v0),
    v2 AS (SELECT * REPLACE (weight * least(1.0, 0.35 / sum(abs(weight)) OVER (PARTITION BY date, asset_class)) AS weight) FROM v1),
    v3 AS (SELECT * REPLACE (weight * least(1.0, 1.0 / sum(abs(weight)) OVER (PARTITION BY date)) AS weight) FROM v2)
    SELECT date, ticker, {W6} FROM v3 WHERE abs(weight) >= 0.005""",
)
book.add(
    "p8_risk_parity",
    lambda s, d: O.risk_parity(T.panel(s, d), T.dimensions(s, d).select("ticker", F.col("asset_class").alias("grp"))).select("ticker", "grp", out(F.col("weight")).alias("weight")),
    S.PANEL + S.DIMENSIONS
    + f""", rows AS (SELECT asset_class AS grp, date, r FROM panel JOIN dims USING (ticker) WHERE r IS NOT NULL),
    width AS (SELECT asset_class AS grp, count(*) AS width FROM dims WHERE ticker IN (SELECT ticker FROM panel) GROUP BY 1),
    daily AS (SELECT grp, date, avg(r) AS r, any_value(width) AS width FROM rows JOIN width USING (grp) GROUP BY grp, date HAVING count(*) = any_value(width)),
    vol AS (SELECT grp, width, stddev_samp(r) * sqrt(252) AS vol FROM (SELECT * FROM daily QUALIFY row_number() OVER (PARTITION BY grp ORDER BY date DESC) <= 63) GROUP BY ALL HAVING stddev_samp(r) > 0 AND count(*) >= 63),
    share AS (SELECT *, 1 / vol / sum(1 / vol) OVER () * 0.7 AS w, bool_or(grp = 'equity') OVER () AND bool_or(grp = 'fixed_income') OVER () AS tilts FROM vol)
    SELECT ticker, grp, {S.out("CASE WHEN tilts AND grp = 'fixed_income' THEN greatest(w - 0.05, 0.02) WHEN tilts AND grp = 'equity' THEN w + 0.05 ELSE w END / width")} AS weight FROM share JOIN dims ON asset_class = grp""",
)
TILT = SCORED + """, n1 AS (SELECT *, least(score / sum(score) OVER (PARTITION BY date) * 0.3, 0.10) AS w FROM base WHERE score > 0.05),
    tilt AS (SELECT date, ticker, asset_class, score, w / sum(w) OVER (PARTITION BY date) * 0.3 AS weight FROM n1)"""
tilt = lambda s, d: O.alpha_tilt(scored(s, d))
book.add("p9_alpha_tilt", lambda s, d: SHOW(tilt(s, d)), TILT + f"SELECT date, ticker, {W6} FROM tilt")
TOPS = """, tops AS (SELECT * FROM base WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 10),
    tops2 AS (SELECT *, least(score / sum(score) OVER (PARTITION BY date) * 0.95, 0.15) AS w FROM tops),
    sw AS (SELECT date, ticker, score, asset_class, w * 0.95 / greatest(0.95, sum(w) OVER (PARTITION BY date)) AS weight FROM tops2)"""
tops = lambda s, d: O.score_weights(scored(s, d))
book.add(
    "p10_combined",
    lambda s, d: SHOW(O.combine(tops(s, d), tilt(s, d))),
    TILT + TOPS + f""", summed AS (SELECT date, ticker, least(sum(weight), 0.10) AS w FROM (SELECT date, ticker, weight FROM sw UNION ALL SELECT date, ticker, weight FROM tilt) GROUP BY ALL)
    SELECT date, ticker, {S.out("w * least(1.0, 0.98 / sum(w) OVER (PARTITION BY date))")} AS weight FROM summed""",
)
book.add(
    "p11_dynamic_kelly",
    lambda s, d: SHOW(O.dynamic_kelly(tops(s, d))),
    SCORED + TOPS + f"SELECT date, ticker, {S.out('CASE WHEN weight > 0 THEN weight * CASE WHEN score > 0 THEN 0.5 + 0.5 * least(abs(score), 2) / 2 * 0.5 ELSE 0.25 END ELSE 0.0 END')} AS weight FROM sw",
)


def _trend(s, d):
    m = T.market(s, d).withColumn("market", F.lit("MKT")).withColumn("a", sma("m", 50))
    return m.select("date", F.coalesce(F.col("m") > F.col("a"), F.lit(True)).alias("above"), F.when(F.coalesce(F.abs("rm"), F.lit(0.0)) < 0.05, "CALM").otherwise("TRANSITION").alias("label"))


book.add(
    "p12_trend_filter",
    lambda s, d: SHOW(O.trend_filter(tops(s, d), _trend(s, d))),
    SCORED + S.MARKET + TOPS
    + f""", tr AS (SELECT date, coalesce(m > CASE WHEN count(m) OVER (ORDER BY date ROWS 49 PRECEDING) = 50 THEN avg(m) OVER (ORDER BY date ROWS 49 PRECEDING) END, true) AS above, coalesce(abs(rm), 0) < 0.05 AS calm FROM market),
    mv AS (SELECT sw.*, calm, weight * CASE WHEN above AND calm AND asset_class = 'equity' THEN 1.15 WHEN above AND calm AND asset_class = 'fixed_income' THEN 0.85
      WHEN NOT above AND asset_class = 'equity' THEN 0.80 WHEN NOT above AND asset_class = 'fixed_income' THEN 1.20 ELSE 1.0 END AS n FROM sw JOIN tr USING (date)),
    iv2 AS (SELECT *, sum(CASE WHEN n > 0 THEN n END) OVER (PARTITION BY date) AS invested, CASE WHEN calm THEN 0.90 ELSE 0.80 END AS most FROM mv)
    SELECT date, ticker, {S.out("CASE WHEN n > 0 AND invested > most THEN n * most / invested ELSE n END")} AS weight FROM iv2""",
)
book.add("p13_score_weights", lambda s, d: SHOW(tops(s, d)), SCORED + TOPS + f"SELECT date, ticker, {W6} FROM sw")
PICKS = SCORED + """, g AS (SELECT * FROM base WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY score DESC, ticker) <= 3),
    picks AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) AS rank FROM g) WHERE rank <= 12)"""
picks = lambda s, d: O.top_n_by_group(scored(s, d), 12, 3)
book.add("p14_top_n_by_group", lambda s, d: picks(s, d).select("date", "ticker", "sector", F.col("rank").cast("long").alias("rank")), PICKS + "SELECT date, ticker, sector, rank FROM picks")


def _mapping(s, d):
    return T.dimensions(s, d).where("asset_class = 'equity'").select("ticker", F.concat(F.lit("L"), "ticker").alias("mapped"))


book.add(
    "p15_substitution",
    lambda s, d: SHOW(O.substitute(picks(s, d), _mapping(s, d)), "held"),
    PICKS + f"SELECT date, ticker, CASE WHEN rank <= 5 AND asset_class = 'equity' THEN 'L' || ticker ELSE ticker END AS held, {S.out('1.0::DOUBLE / count(*) OVER (PARTITION BY date)')} AS weight FROM picks",
)
book.add(
    "p16_crisis_allocation",
    lambda s, d: SHOW(O.crisis_allocation(scored(s, d), 3, 0.30)),
    SCORED
    + f""", c AS (SELECT *, greatest(score, 0.001) AS x FROM base WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY score DESC, ticker) <= 3),
    cw AS (SELECT date, ticker, least(x / sum(x) OVER (PARTITION BY date), 0.30) AS weight FROM c)
    SELECT date, ticker, {W6} FROM (SELECT * FROM cw UNION ALL SELECT date, 'BIL', 1 - sum(weight) FROM cw GROUP BY date HAVING 1 - sum(weight) > 0.02)""",
)


def _engine(s, d):
    mom = T.filled_panel(s, d).select("ticker", "date", out(SG.blended_momentum()).alias("mom"))
    return scored(s, d).withColumnRenamed("score", "alpha").join(mom, ["ticker", "date"])


ENGINE = SCORED + f""", mom AS (SELECT ticker, date, {S.out(" + ".join(f"{w} * ({S.lag('px', 21)} / nullif({S.lag('px', k)}, 0) - 1)" for w, k in ((0.4, 83), (0.35, 146), (0.25, 272))))} AS mom FROM panel),
    e AS (SELECT b.date, b.ticker, sector, mom + 0.03 * coalesce(score, 0) AS s FROM base b JOIN mom USING (ticker, date) WHERE px >= 10 AND mom IS NOT NULL QUALIFY count(*) OVER (PARTITION BY b.date) >= 25)"""
book.add(
    "p17_long_short",
    lambda s, d: SHOW(O.long_short_engine(_engine(s, d))),
    ENGINE
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY s DESC, ticker) AS top, row_number() OVER (PARTITION BY date ORDER BY s, ticker DESC) AS low FROM e)
    SELECT date, ticker, CASE WHEN top <= 15 THEN 0.024::DOUBLE ELSE -0.018 END AS weight FROM r WHERE top <= 15 OR low <= 10""",
)
book.add(
    "p17_sector_limit",
    lambda s, d: SHOW(O.long_short_engine(_engine(s, d), most=2), "sector"),
    ENGINE
    + """, best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY s DESC, ticker) <= 2),
    worst AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY date, sector ORDER BY s, ticker DESC) <= 2),
    longs AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY date ORDER BY s DESC, ticker) <= 15),
    shorts AS (SELECT * FROM worst QUALIFY row_number() OVER (PARTITION BY date ORDER BY s, ticker DESC) <= 10)
    SELECT date, ticker, sector, 0.024::DOUBLE AS weight FROM longs UNION ALL SELECT date, ticker, sector, -0.018 FROM shorts s WHERE NOT EXISTS (SELECT 1 FROM longs l WHERE l.date = s.date AND l.ticker = s.ticker)""",
)
_lev = lambda df: df.withColumn("lev", F.when(F.col("asset_class") == "leveraged", 3.0).when(F.col("asset_class") == "commodity", 2.0).otherwise(1.0))
book.add(
    "p18_leverage_budget",
    lambda s, d: SHOW(O.leverage_budget(_lev(tops(s, d)), 1.2, 0.12)),
    SCORED + TOPS
    + f""", lv AS (SELECT * REPLACE (least(weight, 0.12) AS weight), CASE asset_class WHEN 'leveraged' THEN 3.0 WHEN 'commodity' THEN 2.0 ELSE 1.0 END::DOUBLE AS lev FROM sw WHERE weight > 0.005),
    u AS (SELECT *, sum(lev * weight) OVER (PARTITION BY date) AS used FROM lv),
    k AS (SELECT *, CASE WHEN used > 1.2 AND lev > 1 THEN weight * 1.2 / used ELSE weight END AS w FROM u)
    SELECT date, ticker, {S.out("w / greatest(1.0, sum(w) OVER (PARTITION BY date))")} AS weight FROM k""",
)
book.add(
    "p19_equity_floor",
    lambda s, d: SHOW(O.equity_floor(tops(s, d))),
    SCORED + TOPS
    + f""", q AS (SELECT *, sum(CASE WHEN asset_class = 'equity' THEN weight ELSE 0 END) OVER (PARTITION BY date) AS e FROM sw)
    SELECT date, ticker, {S.out("CASE WHEN asset_class = 'equity' AND e > 0 AND e < 0.30 THEN weight * 0.30 / e ELSE weight END")} AS weight FROM q""",
)
