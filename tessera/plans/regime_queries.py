"""Queries R1-R13 with their SQL.  Weekly history is short, so the long average has 50 rows here."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql as S
from tessera.functions.windows import out
from tessera.operators import regime as O
from tessera.operators.joins import asof
from tessera.sources import tables as T

from .base import Book

book = Book()
N = 50


def state(spark, d):
    """market, date, m, rm, vix, oas, curve, breadth: macro series as-of joined to the benchmark's dates."""
    base = T.market(spark, d)
    series = T.macro(spark, d)
    roles = {"vix": ("3-MEDIUM", 10000), "oas": ("4-NOT SPECIFIED", 50000), "curve": ("5-LOW", 100000)}
    for name, (sid, scale) in roles.items():
        base = asof(base, series.where(F.col("series_id") == sid).select("date", (F.col("value") / scale).alias(name)), "date", [name])
    panel = T.filled_panel(spark, d)
    up = panel.withColumn("a", O.roll(F.avg, F.col("px"), N)).groupBy("date").agg(F.avg(F.coalesce((F.col("px") > F.col("a")).cast("double"), F.lit(0.0))).alias("breadth"))
    return base.withColumn("curve", F.col("curve") - 2.5).join(up, "date", "left").withColumn("market", F.lit("MKT"))


R = "(PARTITION BY market ORDER BY date ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    f = R.format(n - 1)
    return f"(CASE WHEN count({x}) OVER {f} >= {least or n} THEN {agg}({x}) OVER {f} END)"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER (PARTITION BY market ORDER BY date)"


STATE = (
    S.FILLED + S.MARKET + S.MACRO
    + f""", up AS (SELECT date, avg(coalesce((px > a)::INT::DOUBLE, 0)) AS breadth FROM (SELECT date, px, {S.roll("avg", "px", N)} AS a FROM panel) GROUP BY date),
    state AS (SELECT 'MKT' AS market, k.date, m, rm, v.value / 10000 AS vix, o.value / 50000 AS oas, c.value / 100000 - 2.5 AS curve, breadth FROM market k
      ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = '3-MEDIUM') v ON k.date >= v.date ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = '4-NOT SPECIFIED') o ON k.date >= o.date
      ASOF LEFT JOIN (SELECT * FROM macro WHERE series_id = '5-LOW') c ON k.date >= c.date LEFT JOIN up ON up.date = k.date),
    rel AS (SELECT *, m / nullif({roll("avg", "m", N)}, 0) - 1 AS gap, vix / nullif({roll("avg", "vix", 21)}, 0) AS rv, oas - {lag("oas", 10)} AS d10,
      {roll("stddev_samp", "rm", 21)} * sqrt(252) AS vol, {roll("avg", "m", N)} AS mean, {roll("avg", "m", N // 4)} AS near, {roll("avg", "vix", 21)} AS vmean, vix / nullif({lag("vix", 5)}, 0) - 1 AS jump, m / nullif({lag("m", 5)}, 0) - 1 AS five,
      m / nullif({roll("max", "m", 52)}, 0) - 1 AS fall FROM state),
    votes AS (SELECT *, CASE WHEN gap > 0.02 THEN 1 WHEN gap < -0.02 THEN -1 WHEN gap IS NOT NULL THEN 0 END AS trend,
      CASE WHEN rv IS NULL THEN NULL WHEN vix >= 28 OR rv >= 1.15 THEN -1 WHEN vix <= 20 AND rv <= 1.05 THEN 1 ELSE 0 END AS volv,
      CASE WHEN d10 IS NULL THEN NULL WHEN oas >= 5.5 OR d10 >= 0.75 THEN -1 WHEN oas <= 3.5 AND d10 <= 0 THEN 1 ELSE 0 END AS credit,
      CASE WHEN vol < 0.15 THEN 1 WHEN vol > 0.25 THEN -1 WHEN vol IS NOT NULL THEN 0 END AS proxy FROM rel)"""
)


def votes(spark, d):
    return state(spark, d).select("market", "date", "rm", O.trend_vote(N).alias("trend"), O.vol_vote().alias("vol"), O.credit_vote().alias("credit"))


book.add("r1_trend_vote", lambda s, d: votes(s, d).select("date", "trend"), STATE + "SELECT date, trend FROM votes")
book.add("r2_vol_vote", lambda s, d: votes(s, d).select("date", "vol"), STATE + "SELECT date, volv AS vol FROM votes")
book.add("r3_credit_vote", lambda s, d: votes(s, d).select("date", "credit"), STATE + "SELECT date, credit FROM votes")
book.add(
    "r4_proxy_votes",
    lambda s, d: state(s, d).select("date", *(c.alias(n) for n, c in O.proxy_votes(n=N).items())),
    STATE + "SELECT date, trend, proxy AS vol, CAST(NULL AS INT) AS credit FROM votes",
)
FOLD = (
    STATE.replace("\nWITH lines", "\nWITH RECURSIVE lines")
    + """, days AS MATERIALIZED (SELECT date, trend, volv, credit, row_number() OVER (ORDER BY date) AS k, (trend IS NOT NULL)::INT + (volv IS NOT NULL)::INT + (credit IS NOT NULL)::INT AS live,
      coalesce((trend = 1)::INT, 0) + coalesce((volv = 1)::INT, 0) + coalesce((credit = 1)::INT, 0) AS n_on, coalesce((trend = -1)::INT, 0) + coalesce((volv = -1)::INT, 0) + coalesce((credit = -1)::INT, 0) AS n_off FROM votes),
    path AS (SELECT 0::BIGINT AS k, CAST(NULL AS DATE) AS date, 'CAUTIOUS' AS regime, 0 AS bullish, 0 AS bearish, 0.0::DOUBLE AS confidence
      UNION ALL SELECT k, date, CASE WHEN live < 2 THEN regime WHEN trend = 1 AND volv = 1 THEN 'ACTIVE' WHEN be >= 2 THEN 'CRISIS' WHEN bu >= 2 THEN 'ACTIVE'
          WHEN n_off >= 2 AND regime = 'ACTIVE' THEN 'CAUTIOUS' WHEN n_on >= 2 AND regime = 'CRISIS' THEN 'CAUTIOUS' ELSE regime END, bu, be,
          CASE WHEN live > 0 THEN round(greatest(n_on, n_off) / live::DOUBLE, 3) ELSE 0.0 END
        FROM (SELECT d.*, p.regime, CASE WHEN n_on >= 2 THEN p.bullish + 1 ELSE 0 END AS bu, CASE WHEN n_off >= 2 THEN p.bearish + 1 ELSE 0 END AS be FROM path p JOIN days d ON d.k = p.k + 1)),
    regimes AS (SELECT 'MKT' AS market, date, regime, bullish, bearish, confidence FROM path WHERE k > 0)"""
)
_path = lambda s, d: O.regime_path(votes(s, d))
book.add("r5_regime_machine", _path, FOLD + "SELECT * FROM regimes")
book.add("r6_transitions", lambda s, d: O.transitions(_path(s, d)), FOLD + "SELECT * FROM (SELECT market, date, lag(regime) OVER (ORDER BY date) AS before, regime FROM regimes) WHERE before <> regime")
LADDER = "(VALUES ('ACTIVE', 1.0::DOUBLE, 0.8::DOUBLE), ('CAUTIOUS', 0.6, 0.3), ('CRISIS', 0.5, 0.0)) l(regime, gross, net)"
book.add("r7_exposure", lambda s, d: O.exposures(_path(s, d)).select("date", "regime", "gross", "net"), FOLD + f"SELECT date, r.regime, coalesce(gross, 0.6) AS gross, coalesce(net, 0.3) AS net FROM regimes r LEFT JOIN {LADDER} ON r.regime = l.regime")
book.add(
    "r8_buffered_switch",
    lambda s, d: O.buffered_switch(state(s, d), N),
    STATE
    + """, sided AS (SELECT market, date, CASE WHEN gap IS NULL OR gap > 0.02 THEN 'ABOVE' WHEN gap < -0.02 THEN 'BELOW' ELSE 'BUFFER' END AS side FROM rel),
    firm AS (SELECT *, sum(fresh) OVER (ORDER BY date) AS island FROM (SELECT *, CASE WHEN lag(side) OVER (ORDER BY date) = side THEN 0 ELSE 1 END AS fresh FROM sided WHERE side <> 'BUFFER')),
    ev AS (SELECT date, CASE side WHEN 'ABOVE' THEN 'ACTIVE' ELSE 'SAFETY' END AS event FROM firm QUALIFY row_number() OVER (PARTITION BY island ORDER BY date) = 3)
    SELECT market, s.date, side, coalesce(last_value(event IGNORE NULLS) OVER (ORDER BY s.date ROWS UNBOUNDED PRECEDING), 'ACTIVE') AS mode FROM sided s LEFT JOIN ev ON ev.date = s.date""",
)
SIMPLE = "CASE WHEN mean IS NULL THEN 'CALM' WHEN m > mean AND coalesce(vix, 20) < 25 THEN 'CALM' WHEN m < mean AND coalesce(vix, 20) > 35 THEN 'CRISIS' ELSE 'TRANSITION' END"
book.add(
    "r9_simple_regime",
    lambda s, d: O.simple_regime(x := state(s, d), n=N).select("date", F.col("label").alias("plain")).join(O.simple_regime(x, True, N).select("date", F.col("label").alias("spiked")), "date"),
    STATE + f"SELECT date, {SIMPLE} AS plain, CASE WHEN coalesce(vix, 20) / nullif(lag(coalesce(vix, 20), 5) OVER (ORDER BY date), 0) - 1 > 0.40 THEN 'CRISIS' ELSE {SIMPLE} END AS spiked FROM rel",
)
VOTES = {
    "vix": (0.25, "CASE WHEN vix < 13 THEN 0 WHEN vix < 18 THEN 1 WHEN vix < 25 THEN 2 WHEN vix < 35 THEN 3 WHEN vix IS NOT NULL THEN 4 END"),
    "sma": (0.20, "CASE WHEN mean IS NULL OR m IS NULL THEN NULL WHEN m > mean AND near > mean THEN CASE WHEN m > mean * 1.10 THEN 0 ELSE 1 END WHEN m > mean * 0.95 THEN 2 ELSE 3 END"),
    "vix_trend": (0.10, "CASE WHEN rv IS NULL THEN NULL WHEN vix < vmean * 0.85 THEN 1 WHEN vix > vmean * 1.30 THEN 3 WHEN vix > vmean THEN 2 ELSE 1 END"),
    "breadth": (0.10, "CASE WHEN breadth >= 0.8 THEN 1 WHEN breadth >= 0.5 THEN 2 WHEN breadth IS NOT NULL THEN 3 END"),
    "drawdown": (0.10, "CASE WHEN fall > -0.05 THEN 1 WHEN fall > -0.10 THEN 2 WHEN fall > -0.20 THEN 3 WHEN fall IS NOT NULL THEN 4 END"),
    "credit": (0.10, "CASE WHEN oas < 3.5 THEN 1 WHEN oas < 5 THEN 2 WHEN oas < 7 THEN 3 WHEN oas IS NOT NULL THEN 4 END"),
    "spike": (0.10, "CASE WHEN jump > 0.50 THEN 4 WHEN jump > 0.30 THEN 3 WHEN jump IS NOT NULL THEN 1 END"),
    "curve": (0.05, "CASE WHEN curve > 1 THEN 1 WHEN curve > 0 THEN 2 WHEN curve IS NOT NULL THEN 3 END"),
}
LABELS = "['EUPHORIA', 'CALM', 'CAUTION', 'STRESS', 'CRISIS']"
EIGHT = (
    STATE
    + f""", ballots AS (SELECT market, date, vix, five, v.grade, v.share FROM rel, LATERAL (VALUES {", ".join(f"({e}, {w}::DOUBLE)" for w, e in VOTES.values())}) v(grade, share)),
    mass AS (SELECT market, date, vix, five, g, round(coalesce(sum(share) FILTER (grade = g), 0), 6) AS mass FROM ballots, (VALUES (0), (1), (2), (3), (4)) gs(g) GROUP BY ALL),
    best AS (SELECT * FROM mass QUALIFY row_number() OVER (PARTITION BY date ORDER BY mass DESC, g) = 1),
    labels AS (SELECT market, date, {LABELS}[greatest(g, CASE WHEN five < -0.10 OR vix > 40 THEN 4 WHEN five < -0.05 THEN 3 ELSE 0 END) + 1] AS label FROM best)"""
)
_eight = lambda s, d: O.eight_votes(state(s, d), N, N // 4, 52)
book.add("r10_eight_votes", _eight, EIGHT + "SELECT * FROM labels")
book.add(
    "r11_confirmed",
    lambda s, d: O.confirmed(_eight(s, d)),
    EIGHT.replace("\nWITH lines", "\nWITH RECURSIVE lines")
    + """, seq AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY date) AS k, list_position(['EUPHORIA', 'CALM', 'CAUTION', 'STRESS', 'CRISIS'], label) AS sev FROM labels),
    held AS (SELECT k, date, label AS held, sev, date AS since FROM seq WHERE k = 1
      UNION ALL SELECT s.k, s.date, CASE WHEN go THEN s.label ELSE h.held END, CASE WHEN go THEN s.sev ELSE h.sev END, CASE WHEN go THEN s.date ELSE h.since END
      FROM (SELECT h.*, h.k AS hk, s.sev <> h.sev AND (s.label = 'CRISIS' OR s.date - h.since >= CASE WHEN s.sev > h.sev THEN 5 ELSE 10 END) AS go FROM held h JOIN seq s ON s.k = h.k + 1) h JOIN seq s ON s.k = h.hk + 1)
    SELECT 'MKT' AS market, date, held FROM held""",
)
book.add(
    "r12_detector_health",
    lambda s, d: O.detector_health(_eight(s, d).join(T.market(s, d).select("date", F.col("rm").alias("ret")), "date")).select("date", F.col("wrong").cast("long").alias("wrong"), "boost"),
    EIGHT
    + """, w AS (SELECT date, CAST(sum(CASE WHEN (label IN ('EUPHORIA', 'CALM') AND rm < -0.03) OR (label IN ('STRESS', 'CRISIS') AND rm > 0.03) THEN 1 ELSE 0 END)
      OVER (ORDER BY date ROWS 7 PRECEDING) AS BIGINT) AS wrong FROM labels JOIN market USING (date))
    SELECT date, wrong, CASE WHEN wrong >= 3 THEN 0.15::DOUBLE ELSE 0.0 END AS boost FROM w""",
)
book.add(
    "r13_occupancy",
    lambda s, d: O.occupancy(_path(s, d).join(T.market(s, d).select("date", F.col("rm").alias("ret")), "date")).select("regime", out(F.col("share")).alias("share"), out(F.col("sharpe"), 4).alias("sharpe")),
    FOLD + f"SELECT regime, {S.out('count(*)::DOUBLE / sum(count(*)) OVER ()')} AS share, {S.out('CASE WHEN count(rm) >= 20 AND stddev_samp(rm) > 0 THEN avg(rm) / stddev_samp(rm) * sqrt(252) END', 4)} AS sharpe FROM regimes JOIN market USING (date) GROUP BY regime",
)
