"""Queries C1-C5 and A19-A27 with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import sql as S
from tessera.functions.windows import out
from tessera.operators import league as O
from tessera.operators import signals as SG
from tessera.sources import tables as T

from .base import Book
from .signal_queries import A_SQL, DAY, RAW, candidate_panel

book = Book()
FIVE = list(SG.SIGNALS)


def five(spark, d):
    return SG.production_signals(O.with_ahead(T.filled_panel(spark, d)), keep=("i", "pf", "ahead_21", "ahead_63"))


def _ic_sql(name: str, back: int) -> str:
    past = ", ".join(f"{S.lag(s, back)} AS {s}" for s in FIVE)
    return f""", past{name} AS (SELECT ticker, date, i, {S.change("pf", back)} AS ret, {past} FROM signals),
    tall{name} AS (UNPIVOT (SELECT * FROM past{name} WHERE i >= {back} + 1) ON {", ".join(FIVE)} INTO NAME signal VALUE score),
    ranks{name} AS (SELECT signal, date, {S.average_rank("score", "signal, date")} AS rx, {S.average_rank("ret", "signal, date")} AS ry FROM tall{name} WHERE ret IS NOT NULL),
    ic{name} AS (SELECT g.signal, g.date, g.i, coalesce(CASE WHEN isfinite(c) THEN c END, 0.0) AS ic FROM (SELECT * FROM cal, (SELECT unnest({FIVE}) AS signal)) g
      LEFT JOIN (SELECT signal, date, CASE WHEN count(*) >= 10 THEN corr(rx, ry) END AS c FROM ranks{name} GROUP BY ALL) x ON g.signal = x.signal AND g.date = x.date)"""


IC21, IC63 = _ic_sql("21", 21), _ic_sql("63", 63)
BLEND = RAW + IC21 + IC63 + ", blend AS (SELECT signal, a.date, a.i, 0.70 * a.ic + 0.30 * b.ic AS ic FROM ic21 a JOIN ic63 b USING (signal, date))"
FOLD = (
    BLEND.replace("\nWITH lines", "\nWITH RECURSIVE lines")
    + f""", byday AS MATERIALIZED (SELECT i, date, [{", ".join(f"max(ic) FILTER (signal = '{s}')" for s in FIVE)}] AS ics FROM blend GROUP BY i, date),
    fold AS (SELECT -1::BIGINT AS i, CAST(NULL AS DATE) AS date, [0.2::DOUBLE, 0.2, 0.2, 0.2, 0.2] AS w
      UNION ALL SELECT b.i, b.date, list_transform(x, lambda v: v / list_sum(x)) FROM (
        SELECT b.i, b.date, list_transform(f.w, lambda v, k: greatest(0.05::DOUBLE, least(0.40::DOUBLE, 2 / 11.0::DOUBLE * (0.2 + 0.5 * greatest(b.ics[k], 0)) + 9 / 11.0::DOUBLE * v))) AS x FROM fold f JOIN byday b ON b.i = f.i + 1) b),
    weights AS (SELECT i, date, unnest({FIVE}) AS signal, unnest(w) AS weight FROM fold WHERE i >= 0)"""
)


def _ics(fn):
    return lambda spark, d: fn(five(spark, d), T.weeks(spark, d)).select("signal", "date", out(F.col("ic")).alias("ic"))


def weights(spark, d, signals=None):
    return O.adapt_weights(O.blended_ics(signals or five(spark, d), FIVE, days=T.weeks(spark, d)).withColumn("strategy_id", F.lit("live")), FIVE)


book.add("c1_trailing_ic", _ics(lambda s, days: O.trailing_ics(s, FIVE, days=days)), RAW + IC21 + f"SELECT signal, date, {S.out('ic')} AS ic FROM ic21")
book.add("c2_blended_ic", _ics(lambda s, days: O.blended_ics(s, FIVE, days=days)), BLEND + f"SELECT signal, date, {S.out('ic')} AS ic FROM blend")
book.add("c3_adapted_weights", lambda spark, d: weights(spark, d).select("date", "signal", out(F.col("weight")).alias("weight")), FOLD + f"SELECT date, signal, {S.out('weight')} AS weight FROM weights")
book.add(
    "c4_latest_weights",
    lambda spark, d: O.latest_weights(weights(spark, d), FIVE).select("signal", out(F.col("weight")).alias("weight")),
    FOLD + f"SELECT signal, {S.out('weight / sum(weight) OVER ()')} AS weight FROM weights WHERE date = (SELECT max(date) FROM weights)",
)
book.add(
    "c5_ensemble",
    lambda spark, d: O.ensemble(s := T.stored(five(spark, d)), FIVE, weights(spark, d, s)).withColumn("rank", F.col("rank").cast("long")),
    FOLD
    + f""", rows AS (UNPIVOT (SELECT ticker, date, {", ".join(FIVE)} FROM signals) ON {", ".join(FIVE)} INTO NAME signal VALUE score),
    scored2 AS (SELECT r.date, ticker, {S.out("sum(weight * score) / sum(weight)")} AS composite FROM rows r JOIN weights w ON r.date = w.date AND r.signal = w.signal GROUP BY r.date, ticker HAVING count(*) >= 3)
    SELECT *, row_number() OVER (PARTITION BY date ORDER BY composite DESC, ticker) AS rank FROM scored2""",
)

# ---- league over all candidates, shortened look-backs for a weekly history -------------------

ALL = list(A_SQL)
H, START, LEAST, SMALLEST = 5, 70, 5, 2
CAND = (
    DAY
    + f""", rawc AS (SELECT ticker, date, i, pf, r, {", ".join(f"{A_SQL[n]} AS {n}" for n in ALL)} FROM day),
    cand AS MATERIALIZED (SELECT ticker, date, i, pf, r, {", ".join(f"{S.out(S.zscore(n))} AS {n}" for n in ALL)} FROM rawc),
    ahead AS (SELECT *, lead(pf, {H}) OVER ({S.SERIES}) / nullif(pf, 0) - 1 AS fwd FROM cand),
    tallf AS (UNPIVOT (SELECT * FROM ahead WHERE i >= {START} AND (i - {START}) % {H} = 0 AND fwd IS NOT NULL) ON {", ".join(ALL)} INTO NAME signal VALUE score),
    ics AS (SELECT signal, date, i, count(*) AS n, corr(rx, ry) AS ic FROM (SELECT signal, date, i, {S.average_rank("score", "signal, date")} AS rx, {S.average_rank("fwd", "signal, date")} AS ry FROM tallf)
      GROUP BY ALL HAVING count(*) >= {LEAST} AND isfinite(corr(rx, ry)))"""
)
TSTAT = "CASE WHEN count({0}) >= 8 AND stddev_samp({0}) > 0 THEN avg({0}) / (stddev_samp({0}) / sqrt(count({0}))) ELSE 0.0 END"
MEMBERS = f""", tallq AS (UNPIVOT (SELECT * FROM cand WHERE i >= {START} AND (i - {START}) % 5 = 0) ON {", ".join(ALL)} INTO NAME signal VALUE score),
    sized AS (SELECT *, count(*) OVER (PARTITION BY signal, date) AS n, row_number() OVER (PARTITION BY signal, date ORDER BY score DESC, ticker) AS top,
      row_number() OVER (PARTITION BY signal, date ORDER BY score, ticker DESC) AS bottom FROM tallq),
    members AS (SELECT signal, (i - {START}) // 5 AS period, ticker, leg, greatest(floor(n * 0.2), {SMALLEST}) AS q FROM sized, (VALUES (1), (-1)) v(leg)
      WHERE n >= {LEAST} AND CASE WHEN leg = 1 THEN top ELSE bottom END <= greatest(floor(n * 0.2), {SMALLEST})),
    spreads AS (SELECT signal, period, sum(d) AS spread FROM (SELECT signal, m.period, c.i, avg(r) FILTER (leg = 1) - avg(r) FILTER (leg = -1) AS d
      FROM members m JOIN cand c ON m.ticker = c.ticker AND c.i > {START} AND (c.i - {START} - 1) // 5 = m.period WHERE r IS NOT NULL GROUP BY ALL) GROUP BY ALL),
    used AS (SELECT *, lag(period) OVER (PARTITION BY signal ORDER BY period) AS before FROM (SELECT DISTINCT signal, period FROM members)),
    churned AS (SELECT signal, period, avg(c) AS churn FROM (SELECT m.signal, m.period, m.leg, 1 - count(o.ticker) / count(*) AS c FROM members m JOIN used u ON m.signal = u.signal AND m.period = u.period
      LEFT JOIN members o ON o.signal = m.signal AND o.period = u.before AND o.ticker = m.ticker AND o.leg = m.leg GROUP BY ALL) GROUP BY ALL)"""
NET = lambda b: f"(spread - 2 * churn * {b / 10000})"
SH = lambda b: f"CASE WHEN stddev_pop({NET(b)}) > 0 THEN avg({NET(b)}) / stddev_pop({NET(b)}) * sqrt(252 / 5.0) ELSE 0.0 END"
QUALITY = f""", quality AS (SELECT signal, round({SH(0)}, 2) AS sharpe_gross, round({SH(5)}, 2) AS sharpe_5, round({SH(15)}, 2) AS sharpe_15,
      round(avg(spread) * 252 / 5.0, 4) AS annual, round(avg(churn) * 2 * 252 / 5.0, 1) AS turnover FROM spreads JOIN churned USING (signal, period) GROUP BY signal)"""
INC = f""", inc AS (SELECT ticker, date, ({" + ".join(f"coalesce({n}, 0)" for n in ALL)}) / {len(ALL)} AS incumbent FROM cand),
    tallc AS (UNPIVOT (SELECT * FROM cand WHERE i >= {START} AND (i - {START}) % 21 = 0) ON {", ".join(ALL)} INTO NAME signal VALUE score),
    corrs AS (SELECT signal, avg(CASE WHEN isfinite(c) THEN c END) AS corr FROM (SELECT signal, t.date, corr(score, incumbent) AS c FROM tallc t JOIN inc USING (ticker, date) GROUP BY signal, t.date HAVING count(*) >= {LEAST}) GROUP BY signal)"""


def every(spark, d, panel=None):
    """All candidates on the dates that any test reads, with the return ahead; stored once for all tests."""
    rows = O.with_forward(panel or candidate_panel(spark, d), H)
    on = (F.col("i") >= START) & (((F.col("i") - START) % H == 0) | ((F.col("i") - START) % 21 == 0))
    c = SG.candidates(rows, ALL, on, ("i", "pf", "fwd"))
    return T.stored(c.select("ticker", "date", "i", "pf", "fwd", *(out(F.col(n)).alias(n) for n in ALL)))


def incumbent(c):
    return c.select("ticker", "date", (sum((F.coalesce(n, F.lit(0.0)) for n in map(F.col, ALL)), F.lit(0.0)) / len(ALL)).alias("incumbent"))


def _ic(spark, d):
    return O.ic_series(every(spark, d), ALL, H, START, LEAST)


def _members(spark, d, panel=None):
    return T.stored(O.quintile_members(every(spark, d, panel), ALL, 5, START, LEAST, SMALLEST))


def _spread(spark, d):
    """Members and their spreads, from one panel."""
    panel = T.stored(candidate_panel(spark, d))
    members = _members(spark, d, panel)
    return members, O.quintile_spread(members, panel, 5, START)


def _quality(spark, d):
    members, spreads = _spread(spark, d)
    return O.spread_quality(spreads, O.churn(members))


book.add("a19_ic_series", lambda s, d: _ic(s, d).select("signal", "date", "n", out(F.col("ic")).alias("ic")), CAND + f"SELECT signal, date, n, {S.out('ic')} AS ic FROM ics")
book.add("a20_t_stat", lambda s, d: _ic(s, d).groupBy("signal").agg(out(O.t_stat("ic")).alias("t")), CAND + f"SELECT signal, {S.out(TSTAT.format('ic'))} AS t FROM ics GROUP BY signal")
book.add(
    "a21_quintile_spread",
    lambda s, d: _spread(s, d)[1].select("signal", F.col("period").cast("long").alias("period"), out(F.col("spread")).alias("spread")),
    CAND + MEMBERS + f"SELECT signal, period, {S.out('spread')} AS spread FROM spreads",
)
book.add(
    "a22_churn",
    lambda s, d: O.churn(_members(s, d)).select("signal", F.col("period").cast("long").alias("period"), out(F.col("churn")).alias("churn"), out(2 * F.col("churn") * 15 / 10000).alias("cost_15")),
    CAND + MEMBERS + f"SELECT signal, period, {S.out('churn')} AS churn, {S.out('2 * churn * 15 / 10000')} AS cost_15 FROM churned",
)
book.add("a23_spread_quality", _quality, CAND + MEMBERS + QUALITY + "SELECT * FROM quality")
book.add(
    "a24_incumbent_correlation",
    lambda s, d: O.incumbent_correlation(c := every(s, d), incumbent(c), ALL, 21, START, LEAST).select("signal", out(F.col("corr")).alias("corr")),
    CAND + INC + f"SELECT signal, {S.out('corr')} AS corr FROM corrs",
)
SPLIT = f", tests AS (SELECT signal, {TSTAT.format('CASE WHEN i < cut THEN ic END')} AS t_is, {TSTAT.format('CASE WHEN i >= cut THEN ic END')} AS t_oos FROM ics, (SELECT floor(0.6 * count(*)) AS cut FROM cal) GROUP BY signal)"


def _rows(spark, d):
    return T.weeks(spark, d).count()


def _league(s, d):
    panel = T.stored(candidate_panel(s, d))
    c = every(s, d, panel)
    return O.league_table(c, panel, incumbent(c), ALL, _rows(s, d), H, START, LEAST, SMALLEST).select(
        "signal", *(out(F.col(x), 4).alias(x) for x in ("t_is", "t_oos", "corr")), "sharpe_gross", "sharpe_5", "sharpe_15", "annual", "turnover", "verdict"
    )


book.add(
    "a25_split",
    lambda s, d: O.split_t_stats(_ic(s, d), _rows(s, d)).select("signal", out(F.col("t_is")).alias("t_is"), out(F.col("t_oos")).alias("t_oos")),
    CAND + SPLIT + f"SELECT signal, {S.out('t_is')} AS t_is, {S.out('t_oos')} AS t_oos FROM tests",
)
VERDICT = """CASE WHEN k = 3 THEN 'PROMOTE' WHEN k = 2 THEN 'WATCH' ELSE 'KILL' END AS verdict"""
LEAGUE = (
    CAND + MEMBERS + QUALITY + INC + SPLIT
    + f""", joined2 AS (SELECT *, (abs(t_is) >= 3 AND abs(t_oos) >= 2.5 AND sign(t_is) = sign(t_oos))::INT + (sharpe_15 >= 0.5)::INT + (abs(corr) < 0.5)::INT AS k
      FROM (SELECT unnest({ALL}) AS signal) e LEFT JOIN tests USING (signal) LEFT JOIN quality USING (signal) LEFT JOIN corrs USING (signal))"""
)
book.add("a26_verdict", lambda s, d: _league(s, d).select("signal", "verdict"), LEAGUE + f"SELECT signal, {VERDICT} FROM joined2")
book.add(
    "a27_league",
    _league,
    LEAGUE + f"SELECT signal, {S.out('t_is', 4)} AS t_is, {S.out('t_oos', 4)} AS t_oos, {S.out('corr', 4)} AS corr, sharpe_gross, sharpe_5, sharpe_15, annual, turnover, {VERDICT} FROM joined2",
)
