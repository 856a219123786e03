"""Queries D1-D24, J1-J8, U2 and T1-T5 with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tessera.functions import sql as S
from tessera.functions.windows import out
from tessera.operators import ingest as O
from tessera.operators import joins as J
from tessera.sources import tables as T
from tessera.sources.intake import read_csv, read_json
from tessera.sources.store import Store
from tessera.streaming import jobs as ST

from .base import Book

book = Book()
bars = T.bars
R6 = S.out


def _raw(s, d):
    return T.table(s, d, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("Ticker"), F.col("l_shipdate").alias("Date"), (F.col("l_extendedprice") - 20000).alias("Close"),
        F.when(F.col("l_returnflag") == "A", F.col("l_extendedprice")).alias("Adj Close"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity")).alias("Volume"),
    )


book.add(
    "d1_clean_bars",
    lambda s, d: O.clean_bars(_raw(s, d)).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), out(F.avg("adj_close"), 4).alias("adj"), F.sum("volume").alias("volume"), F.count("open").alias("opens")),
    f"""SELECT CAST(l_suppkey AS VARCHAR) AS ticker, count(*) AS rows, {R6("avg(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE l_extendedprice - 20000 END)", 4)} AS adj,
    CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS volume, 0::BIGINT AS opens FROM lineitem WHERE l_extendedprice - 20000 > 0 GROUP BY 1""",
)


def _split(s, d):
    b = bars(s, d).select("ticker", "date", "px")
    return b.where("date < '1999-01-01'"), b.where("date >= '1998-06-01'").withColumn("px", F.col("px") + 1)


UP = S.BARS + ", up AS (SELECT ticker, date, CASE WHEN date >= DATE '1998-06-01' THEN px + 1 ELSE px END AS px FROM bars)"
book.add("d2_upsert", lambda s, d: O.upsert(*_split(s, d), ["ticker", "date"]).select("ticker", "date", out(F.col("px")).alias("px")), UP + f"SELECT ticker, date, {R6('px')} AS px FROM up")


def _macro_upsert(s, d):
    m = T.macro(s, d)
    return O.upsert(m, m.where("date >= '1997-01-01'").withColumn("value", -F.col("value")), ["series_id", "date"])


book.add("d3_macro_upsert", _macro_upsert, "WITH x AS (SELECT 1)" + S.MACRO + "SELECT series_id, date, CASE WHEN date >= DATE '1997-01-01' THEN -value ELSE value END AS value FROM macro")
book.add(
    "d4_incremental_plan",
    lambda s, d: O.incremental_plan(bars(s, d).where("cast(ticker as int) % 7 <> 0"), T.dimensions(s, d).select("ticker")),
    S.BARS + "SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN s_suppkey % 7 <> 0 AND CAST(s_suppkey AS VARCHAR) IN (SELECT ticker FROM bars) THEN (SELECT max(date) - 7 FROM bars WHERE CAST(ticker AS INT) % 7 <> 0) END AS start FROM supplier",
)
book.add("d5_price_range", lambda s, d: O.read_range(bars(s, d), "ticker", "3", "1996-01-01", "1998-12-31").select("ticker", "date", out(F.col("px")).alias("px")), S.BARS + f"SELECT ticker, date, {R6('px')} AS px FROM bars WHERE ticker = '3' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
book.add("d6_macro_range", lambda s, d: O.read_range(T.macro(s, d), "series_id", "5-LOW", "1996-01-01", "1998-12-31"), "WITH x AS (SELECT 1)" + S.MACRO + "SELECT * FROM macro WHERE series_id = '5-LOW' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'")
def _stored(rows, late, keys, unit):
    """The rows in a partitioned store, then a correction of some of its partitions, sent twice."""
    store = Store.new(rows, keys, unit=unit)
    store.upsert(rows, 0)
    store.upsert(late, 1)
    store.upsert(rows.limit(0).unionByName(late), 1)  # the ledger knows the batch
    return store.read()


def _bars_stored(s, d):
    old, new = _split(s, d)
    return _stored(old, new, ["ticker", "date"], "month").select("ticker", "date", out(F.col("px")).alias("px"))


def _macro_stored(s, d):
    m = T.macro(s, d)
    return _stored(m, m.where("date >= '1997-01-01'").withColumn("value", -F.col("value")), ["series_id", "date"], "year")


book.add("d2_store", _bars_stored, UP + f"SELECT ticker, date, {R6('px')} AS px FROM up")
book.add("d3_store", _macro_stored, "WITH x AS (SELECT 1)" + S.MACRO + "SELECT series_id, date, CASE WHEN date >= DATE '1997-01-01' THEN -value ELSE value END AS value FROM macro")

BAR_SCHEMA = "ticker string, date date, close double, volume bigint"
#: Lines that are spoilt on their way: a price that is no number, a line cut short, no ticker.
SPOILT = "CASE WHEN (l_orderkey + l_linenumber) % 89 = 0 THEN 1 WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN 2 WHEN (l_orderkey + l_linenumber) % 101 = 0 THEN 3 ELSE 0 END"


def _lines(s, d):
    how = F.col("how")
    rows = T.table(s, d, "lineitem").select(
        F.expr(SPOILT).alias("how"), F.col("l_suppkey").cast("string").alias("ticker"), F.to_date("l_shipdate").cast("string").alias("date"), F.col("l_extendedprice").alias("close"), F.col("l_quantity").cast("bigint").alias("volume")
    )
    return rows.withColumn("ticker", F.when(how != 3, F.col("ticker"))), how


def _taken(good, bad):
    """Both sides, counted: what was taken, by its figures, and what was not, by its reason."""
    taken = O.clean_bars(good).agg(F.lit("taken").alias("side"), F.count(F.lit(1)).alias("rows"), F.sum("volume").alias("volume"), out(F.sum("close"), 2).alias("total"))
    return taken.unionByName(bad.groupBy(F.col("reason").alias("side")).agg(F.count(F.lit(1)).alias("rows"), F.lit(None).cast("bigint").alias("volume"), F.lit(None).cast("double").alias("total")))


def _csv(s, d):
    rows, how = _lines(s, d)
    fields = [F.coalesce("ticker", F.lit("")), F.col("date"), F.when(how == 1, "n/a").otherwise(F.col("close").cast("string")), F.col("volume").cast("string")]
    path = T.shared_folder(s)
    rows.select(F.when(how == 2, F.concat_ws(",", *fields[:2])).otherwise(F.concat_ws(",", *fields)).alias("value")).write.text(path)
    return _taken(*read_csv(s, path, BAR_SCHEMA, ["ticker", "close"]))


def _json(s, d):
    rows, how = _lines(s, d)
    whole = F.to_json(F.struct("ticker", "date", F.when(how == 1, "n/a").otherwise(F.col("close").cast("string")).cast("string").alias("close"), "volume"))
    path = T.shared_folder(s)
    # prices travel as numbers, not as text
    whole = F.regexp_replace(whole, r'"close":"([0-9.E]+)"', r'"close":$1')
    rows.select(F.when(how == 2, F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.text(path)
    return _taken(*read_json(s, path, BAR_SCHEMA, ["ticker", "close"]))


TAKEN = f"""WITH x AS (SELECT *, {SPOILT} AS how FROM lineitem)
    SELECT 'taken' AS side, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS volume, {R6('sum(l_extendedprice)', 2)} AS total FROM x WHERE how = 0
    UNION ALL SELECT CASE WHEN how < 3 THEN 'malformed' ELSE 'missing: ticker' END, count(*), NULL, NULL FROM x WHERE how > 0 GROUP BY 1"""
book.add("d1_csv", _csv, TAKEN)
book.add("d1_json", _json, TAKEN)
book.add("d7_summary", lambda s, d: O.summary(bars(s, d)), S.BARS + 'SELECT ticker, min(date) AS "first", max(date) AS "last", count(*) AS rows FROM bars GROUP BY 1')
book.add("d8_totals", lambda s, d: O.totals(bars(s, d)), S.BARS + "SELECT count(*) AS rows, max(date) AS latest FROM bars")
book.add("d9_coverage", lambda s, d: O.coverage(bars(s, d), 50, 6).withColumn("years", out(F.col("years"))), S.BARS + f"SELECT count(DISTINCT ticker) AS tickers, {R6('(max(date) - min(date)) / 365.25::DOUBLE')} AS years, count(*) AS rows, count(DISTINCT ticker) >= 50 AND (max(date) - min(date)) / 365.25 >= 6 AS ok FROM bars")


def _complete(s, d):
    expected = T.table(s, d, "part").select(F.col("p_partkey").cast("string").alias("ticker"))
    return O.completeness(bars(s, d), expected, 285)


COMPLETE = """SELECT 'missing' AS "check", CASE WHEN count(*) OVER () > 2 THEN 'error' ELSE 'warning' END AS severity, CAST(p_partkey AS VARCHAR) AS ticker FROM part WHERE CAST(p_partkey AS VARCHAR) NOT IN (SELECT ticker FROM bars)
    UNION ALL SELECT 'short', 'warning', ticker FROM bars GROUP BY ticker HAVING count(*) < 285"""
STALE = """SELECT 'stale' AS "check", CASE WHEN count(*) OVER () > 5 THEN 'error' ELSE 'warning' END AS severity, ticker FROM (SELECT ticker FROM bars GROUP BY 1 HAVING DATE '2001-11-08' - max(date) > 12)"""
book.add("d10_completeness", _complete, S.BARS + COMPLETE)
_fresh = lambda s, d: O.freshness(bars(s, d), "2001-11-08", 12)
book.add("d11_freshness", _fresh, S.BARS + STALE)
book.add(
    "d12_outliers",
    lambda s, d: O.outliers(bars(s, d)).withColumn("worst", out(F.col("worst"))),
    S.BARS + f"SELECT ticker, count(*) AS moves, {R6('arg_max(r, row(abs(r), date))')} AS worst, arg_max(date, row(abs(r), date)) AS worst_date FROM own WHERE abs(r) > 0.20 GROUP BY 1",
)
book.add("d13_low_volume", lambda s, d: O.low_volume(bars(s, d), 50).withColumn("mean", out(F.col("mean"))), S.BARS + f"SELECT ticker, {R6('avg(volume)')} AS mean FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 21) GROUP BY 1 HAVING avg(volume) < 50")
book.add("d14_report", lambda s, d: O.quality_report(_complete(s, d), _fresh(s, d))[1], S.BARS + f"SELECT coalesce(bool_and(severity <> 'error'), true) AS passed, count(*) AS issues FROM (SELECT * FROM ({COMPLETE}) UNION ALL ({STALE}))")
book.add("d15_panel", lambda s, d: T.panel(s, d).select("ticker", "date", F.col("i").cast("long").alias("i"), out(F.col("px")).alias("px"), out(F.col("pf")).alias("pf")), S.PANEL + f"SELECT ticker, date, i, {R6('px')} AS px, {R6('pf')} AS pf FROM panel")


def _bounded(s, d):
    """Users as names that come and go: the highest value of a day, on the shared calendar from first to last day."""
    e = T.table(s, d, "events").where("user_id is not null")
    days = e.groupBy(F.col("user_id").cast("string").alias("ticker"), F.to_date("ts").alias("date")).agg(F.max("value").alias("px"))
    return T.dense(days, bounded=True).select("ticker", "date", F.col("i").cast("long").alias("i"), "px", "pf", out(F.col("r")).alias("r"))


book.add(
    "d15_bounded",
    _bounded,
    f"""WITH b AS (SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, max(value) AS px FROM events WHERE user_id IS NOT NULL GROUP BY ALL),
    cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM b)),
    grid AS (SELECT t.ticker, cal.date, cal.i, b.px FROM (SELECT ticker, min(date) AS first, max(date) AS last FROM b GROUP BY 1) t JOIN cal ON cal.date BETWEEN first AND last LEFT JOIN b ON b.ticker = t.ticker AND b.date = cal.date),
    filled AS (SELECT *, last_value(px IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING) AS pf FROM grid)
    SELECT ticker, date, i, px, pf, {R6('pf / nullif(lag(pf) OVER (PARTITION BY ticker ORDER BY date), 0) - 1')} AS r FROM filled""",
)
CLASSES = ["equity", "fixed_income", "commodity", "alternative", "leveraged"]


def _wide(s, d):
    """A column a class: the mean price of all its names; the last 60 rows."""
    means = T.panel(s, d).join(T.dimensions(s, d), "ticker").groupBy(F.col("asset_class").alias("ticker"), "date").agg(F.avg("px").alias("px"))
    return O.wide(means, CLASSES, 60).select("date", *(out(F.col(n)).alias(n) for n in CLASSES))


book.add("d16_wide", _wide, S.PANEL + S.DIMENSIONS + f"SELECT date, {', '.join(f'{R6(f"avg(px) FILTER (asset_class = {chr(39)}{n}{chr(39)})")} AS {n}' for n in CLASSES)} FROM panel JOIN dims USING (ticker) WHERE date IN (SELECT DISTINCT date FROM panel ORDER BY date DESC LIMIT 60) GROUP BY date")
book.add("d17_symbols", lambda s, d: T.table(s, d, "part").select("p_partkey", O.normalized_symbol(F.concat(F.lit(" "), F.regexp_replace("p_name", " .*", ".b "))).alias("symbol")), "SELECT p_partkey, CASE WHEN regexp_full_match(x, '[A-Z-]{1,10}') THEN x END AS symbol FROM (SELECT p_partkey, replace(upper(trim(' ' || regexp_replace(p_name, ' .*', '.b '))), '.', '-') AS x FROM part)")


#: Membership lists over the whole table; they overlap and leave some names out.
LISTS = {"a": "s_nationkey % 3 <> 0", "b": "s_acctbal > 0", "x": "s_nationkey = 7", "old": "s_nationkey < 3", "o": "s_nationkey % 2 = 0", "e": "s_nationkey % 4 = 0", "s": "s_acctbal > 0"}


def _members(s, d, tag):
    return T.table(s, d, "supplier").where(LISTS[tag]).select(F.col("s_suppkey").cast("string").alias("ticker"), F.concat(F.col("s_name"), F.lit(tag)).alias("name"), F.lit(tag).alias("sector"))


def _merged(s, d):
    return O.merged_constituents([_members(s, d, "a"), _members(s, d, "b")], _members(s, d, "x"), _members(s, d, "old"), 10)


MERGED = f"""merged AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, s_name || CASE WHEN {LISTS["a"]} THEN 'a' ELSE 'b' END AS name, CASE WHEN {LISTS["a"]} THEN 'a' ELSE 'b' END AS sector FROM supplier WHERE ({LISTS["a"]} OR {LISTS["b"]}) AND NOT ({LISTS["x"]})),
    fresh AS (SELECT * FROM merged WHERE (SELECT count(*) FROM merged) >= 10 UNION ALL SELECT CAST(s_suppkey AS VARCHAR), s_name || 'old', 'old' FROM supplier WHERE {LISTS["old"]} AND (SELECT count(*) FROM merged) < 10)"""
book.add("d18_constituents", _merged, f"WITH {MERGED} SELECT * FROM fresh")


def _scd(s, d):
    old = _members(s, d, "o").withColumns({"active": F.lit(True), "first_seen": F.lit("2020-01-01").cast("timestamp"), "last_seen": F.lit("2020-06-01").cast("timestamp")})
    return O.constituents_scd(old, _merged(s, d), "2024-01-01").select("ticker", "name", "sector", "active", F.to_date("first_seen").alias("first_seen"), F.to_date("last_seen").alias("last_seen"))


book.add(
    "d19_scd",
    _scd,
    f"""WITH {MERGED}, old AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, s_name || 'o' AS name FROM supplier WHERE {LISTS["o"]})
    SELECT coalesce(o.ticker, f.ticker) AS ticker, coalesce(f.name, o.name) AS name, coalesce(f.sector, 'o') AS sector, f.ticker IS NOT NULL AS active, CASE WHEN o.ticker IS NULL THEN DATE '2024-01-01' ELSE DATE '2020-01-01' END AS first_seen,
    CASE WHEN f.ticker IS NULL THEN DATE '2020-06-01' ELSE DATE '2024-01-01' END AS last_seen FROM old o FULL OUTER JOIN fresh f ON o.ticker = f.ticker""",
)
book.add("d20_universe", lambda s, d: O.full_universe(_members(s, d, "e"), _members(s, d, "s")), f"SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN {LISTS['e']} THEN 0 ELSE 1 END AS place FROM supplier WHERE {LISTS['e']} OR {LISTS['s']}")
book.add(
    "d21_dimensions",
    lambda s, d: O.with_dimensions(bars(s, d).select("ticker").distinct(), T.dimensions(s, d).where("cast(ticker as int) % 3 <> 0")),
    S.BARS + S.DIMENSIONS + "SELECT b.ticker, coalesce(sector, 'Unknown') AS sector, coalesce(asset_class, 'equity') AS asset_class FROM (SELECT DISTINCT ticker FROM bars) b LEFT JOIN (SELECT * FROM dims WHERE CAST(ticker AS INT) % 3 <> 0) x ON x.ticker = b.ticker",
)


def _sink(s, d):
    path = T.shared_folder(s)
    b = bars(s, d).select("ticker", "date", "px").withColumn("year", F.year("date"))
    O.write_partitioned(b, path, "year")
    O.write_partitioned(b.where("year = 1997").withColumn("px", F.lit(1.0)), path, "year")  # replaces one partition
    return s.read.parquet(path).groupBy("year").agg(F.count(F.lit(1)).alias("rows"), out(F.sum("px"), 2).alias("px"))


book.add("d22_sink", _sink, S.BARS + f"SELECT CAST(year(date) AS INT) AS year, count(*) AS rows, {R6('sum(CASE WHEN year(date) = 1997 THEN 1 ELSE px END)', 2)} AS px FROM bars GROUP BY 1")
book.add("d23_json", lambda s, d: O.decode_detail(T.table(s, d, "events").select("event_id", F.col("props").alias("detail")), "k bigint").select("event_id", "k"), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
NESTED = "event_id bigint, used array<struct<name: string, weight: int>>, votes map<string, struct<user: bigint, stamp: string>>, note string"


def _nested(s, d):
    """Events as nested details and back: a list of named weights, votes by name, and a null."""
    e = T.table(s, d, "events")
    used = F.array(F.struct(F.col("event_type").alias("name"), F.lit(2).alias("weight")), F.struct(F.lit("all").alias("name"), F.lit(None).cast("int").alias("weight")))
    votes = F.create_map(F.lit("by"), F.struct(F.col("user_id").alias("user"), F.date_format("ts", "yyyy-MM-dd").alias("stamp")))
    rows = O.encode_detail(e, ["event_id", used.alias("used"), votes.alias("votes"), F.lit(None).cast("string").alias("note")]).select("event_id", "detail")
    back = O.decode_detail(rows, NESTED)
    return back.select(
        "event_id", "detail", F.col("detail_event_id").alias("again"), F.col("used")[0]["name"].alias("first"), F.expr("aggregate(used, 0, (a, u) -> a + coalesce(u.weight, 0))").cast("long").alias("weight"),
        F.col("votes")["by"]["user"].alias("user"), F.col("votes")["by"]["stamp"].alias("stamp"), "note",
    )


book.add(
    "d23_nested",
    _nested,
    """SELECT event_id, '{"event_id":' || coalesce(event_id::VARCHAR, 'null') || ',"used":[{"name":' || coalesce('"' || event_type || '"', 'null') || ',"weight":2},{"name":"all","weight":null}],"votes":{"by":{"user":' || coalesce(user_id::VARCHAR, 'null')
      || ',"stamp":' || coalesce('"' || strftime(ts, '%Y-%m-%d') || '"', 'null') || '}},"note":null}' AS detail, event_id AS again, event_type AS first, 2::BIGINT AS weight, user_id AS user, strftime(ts, '%Y-%m-%d') AS stamp, NULL::VARCHAR AS note FROM events""",
)
book.add(
    "d24_current_price",
    lambda s, d: T.table(s, d, "events").select("event_id", out(O.current_price(F.when(F.col("event_id") % 3 != 0, F.col("value")), F.when(F.col("event_id") % 2 != 0, F.col("value") + 1), F.lit(None).cast("double"), F.lit(7.0))).alias("price")),
    f"SELECT event_id, {R6('CASE WHEN b > 0 AND a > 0 THEN (a + b) / 2 WHEN greatest(a, b) > 0 THEN greatest(a, b) ELSE 7.0 END')} AS price FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value ELSE 0 END AS b, CASE WHEN event_id % 2 <> 0 THEN value + 1 ELSE 0 END AS a FROM events)",
)

# ---- joins and dates -----------------------------------------------------------------------



def _by_series(s, d):
    """The benchmark's dates for every macro series; the series are a handful of names."""
    return T.market(s, d).select("date", "m", "rm").crossJoin(F.broadcast(T.macro(s, d).select("series_id").distinct()))


KEYED = S.BARS + S.MARKET + S.MACRO + ", keyed AS (SELECT * FROM market, (SELECT DISTINCT series_id FROM macro))"
book.add(
    "j1_asof",
    lambda s, d: J.asof(_by_series(s, d).select("series_id", "date", "m"), T.macro(s, d), "date", ["value"], ["series_id"]),
    KEYED + "SELECT k.series_id, k.date, m, value FROM keyed k ASOF LEFT JOIN macro f ON k.series_id = f.series_id AND k.date >= f.date",
)
book.add(
    "j2_pair_complete",
    lambda s, d: J.pair_complete(_by_series(s, d), T.macro(s, d), ["series_id", "date"], "rm", "value").select("series_id", "date", out(F.col("rm")).alias("rm"), "value"),
    KEYED + f"SELECT series_id, date, {R6('rm')} AS rm, value FROM keyed JOIN macro USING (series_id, date) WHERE rm IS NOT NULL",
)
book.add(
    "j3_range_join",
    lambda s, d: J.next_rows(T.panel(s, d).where("i % 10 = 0 and px > 1500").select(F.expr("i div 10").alias("period"), "ticker"), T.panel(s, d).select("ticker", "i", "r"), 10).groupBy("period").agg(F.count("r").alias("n"), out(F.sum("r")).alias("r")),
    S.PANEL + f"SELECT a.i // 10 AS period, count(b.r) AS n, {R6('sum(b.r)')} AS r FROM panel a JOIN panel b ON a.ticker = b.ticker AND b.i BETWEEN a.i + 1 AND a.i + 10 WHERE a.i % 10 = 0 AND a.px > 1500 GROUP BY 1",
)
book.add("j4_semi_anti", lambda s, d: T.dimensions(s, d).select("ticker").join(x := bars(s, d).where("px > 1900").select("ticker").distinct(), "ticker", "left_semi").withColumn("side", F.lit("in")).unionByName(T.dimensions(s, d).select("ticker").join(x, "ticker", "left_anti").withColumn("side", F.lit("out"))), S.BARS + "SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN CAST(s_suppkey AS VARCHAR) IN (SELECT ticker FROM bars WHERE px > 1900) THEN 'in' ELSE 'out' END AS side FROM supplier")


def _sets(s, d):
    a, b = (bars(s, d).where(c).select("ticker").distinct() for c in ("px > 1800", "px < 1000"))
    return a.union(b).distinct().withColumn("op", F.lit("union")).unionByName(a.subtract(b).withColumn("op", F.lit("minus"))).unionByName(a.intersect(b).withColumn("op", F.lit("both")))


book.add("j5_set_algebra", _sets, S.BARS + """, a AS (SELECT DISTINCT ticker FROM bars WHERE px > 1800), b AS (SELECT DISTINCT ticker FROM bars WHERE px < 1000)
    SELECT ticker, 'union' AS op FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT ticker, 'minus' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT ticker, 'both' FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")  # fmt: skip
book.add(
    "j6_weekdays",
    lambda s, d: T.table(s, d, "orders").select("o_orderkey", J.weekdays_between(F.to_date("o_orderdate"), F.lit("1998-08-05").cast("date")).alias("days")).withColumn("full", F.col("days").isNull() | (F.col("days") >= 10)),
    """SELECT o_orderkey, days, days >= 10 AS "full" FROM (SELECT o_orderkey, f(DATE '1998-08-05') - f(CAST(o_orderdate AS DATE)) AS days FROM orders)""".replace("f(DATE '1998-08-05')", "((DATE '1998-08-05' - DATE '1900-01-01') // 7 * 5 + least((DATE '1998-08-05' - DATE '1900-01-01') % 7, 5))").replace("f(CAST(o_orderdate AS DATE))", "((CAST(o_orderdate AS DATE) - DATE '1900-01-01') // 7 * 5 + least((CAST(o_orderdate AS DATE) - DATE '1900-01-01') % 7, 5))"),
)
book.add("j7_lookback", lambda s, d: bars(s, d).where(F.col("date") >= J.lookback_start(F.lit("2001-11-05").cast("date"), 252)).groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")), S.BARS + "SELECT ticker, count(*) AS rows FROM bars WHERE date >= DATE '2001-11-05' - 403 GROUP BY 1")
book.add(
    "j8_reshape",
    lambda s, d: J.to_wide(J.to_tall(bars(s, d).select("ticker", "date", "open", "close", "px"), ["ticker", "date"], ["open", "close", "px"], "field", "value"), ["ticker", "date"], "field", "value", ["open", "close", "px"]).select("ticker", "date", *(out(F.col(c), 8).alias(c) for c in ("open", "close", "px"))),
    S.BARS + f"SELECT ticker, date, {R6('open', 8)} AS open, {R6('close', 8)} AS close, {R6('px', 8)} AS px FROM bars",
)


def _group_user(s, d):
    own = T.own_series(s, d).join(T.dimensions(s, d), "ticker").select("sector", "ticker", "px")
    combine = [out(F.try_divide(F.sum("total"), F.sum("valid"))).alias("mean"), F.sum("n").alias("n")]
    return J.group_function(own, "sector", "ticker", lambda p: pd.DataFrame({"total": [p["px"].sum()], "valid": [p["px"].count()], "n": [len(p)]}), "total double, valid long, n long", combine)


book.add("u2_group_function", _group_user, S.BARS + S.DIMENSIONS + f"SELECT sector, {R6('avg(px)')} AS mean, count(*) AS n FROM own JOIN dims USING (ticker) GROUP BY 1")

# ---- streaming -----------------------------------------------------------------------------


def events(s, d):
    return T.table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("key"), "value")


book.add("t1_deduplicated", lambda s, d: ST.finished(ST.distinct_bars(ST.replay(events(s, d).unionByName(events(s, d)), rows=ST.PLAIN_ROWS), ["event_id"])).groupBy("key").agg(F.count(F.lit(1)).alias("n")), "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")


book.add(
    "t1_corrected",
    lambda s, d: ST.corrected_bars(ST.replay(events(s, d).withColumn("date", F.to_date("ts"))), ["key", "date"], ["ts", "event_id"]).select("key", "date", "event_id", out(F.col("value")).alias("value")),
    f"SELECT event_type AS key, CAST(ts AS DATE) AS date, arg_max(event_id, row(ts, event_id)) AS event_id, {R6('arg_max(value, row(ts, event_id))')} AS value FROM events GROUP BY ALL",
)
T2_SQL = """WITH RECURSIVE e AS MATERIALIZED (SELECT event_type AS market, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k,
      event_id % 3 - 1 AS trend, event_id * 2 % 3 - 1 AS vol, event_id * 5 % 3 - 1 AS credit FROM events),
    v AS MATERIALIZED (SELECT *, (trend = 1)::INT + (vol = 1)::INT + (credit = 1)::INT AS n_on, (trend = -1)::INT + (vol = -1)::INT + (credit = -1)::INT AS n_off FROM e),
    path AS (SELECT market, 0::BIGINT AS k, NULL::BIGINT AS event_id, 'CAUTIOUS' AS regime, 0 AS bullish, 0 AS bearish, 0.0::DOUBLE AS confidence FROM (SELECT DISTINCT market FROM v)
      UNION ALL SELECT market, k, event_id, CASE WHEN (trend = 1 AND vol = 1) OR (bu >= 2 AND be < 2) THEN 'ACTIVE' WHEN be >= 2 THEN 'CRISIS' WHEN n_off >= 2 AND regime = 'ACTIVE' THEN 'CAUTIOUS'
          WHEN n_on >= 2 AND regime = 'CRISIS' THEN 'CAUTIOUS' ELSE regime END, bu, be, round(greatest(n_on, n_off) / 3.0::DOUBLE, 3)
        FROM (SELECT v.*, p.regime, CASE WHEN n_on >= 2 THEN p.bullish + 1 ELSE 0 END AS bu, CASE WHEN n_off >= 2 THEN p.bearish + 1 ELSE 0 END AS be FROM path p JOIN v ON v.market = p.market AND v.k = p.k + 1))
    SELECT market, event_id, regime, bullish, bearish, confidence FROM path WHERE k > 0"""


def _votes(s, d):
    e = events(s, d)
    return e.select(F.col("key").alias("market"), "ts", "event_id", *((F.col("event_id") * k % 3 - 1).cast("int").alias(n) for n, k in (("trend", 1), ("vol", 2), ("credit", 5))))


book.add("t2_regime_stream", lambda s, d: ST.finished(ST.regime_stream(ST.replay(_votes(s, d)))).select("market", "event_id", "regime", "bullish", "bearish", "confidence"), T2_SQL)


def _stops(s, d):
    e = events(s, d)
    entry = e.groupBy("key").agg(F.round(F.avg("value"), 2).alias("entry_price"))
    return ST.finished(ST.stop_stream(ST.replay(e), entry)).select("event_id", "key", out(F.col("pnl")).alias("pnl"))


book.add("t3_stop_stream", _stops, f"SELECT event_id, event_type AS key, {R6('value / entry - 1')} AS pnl FROM events JOIN (SELECT event_type AS k, round(avg(value), 2) AS entry FROM events GROUP BY 1) ON k = event_type WHERE value / entry - 1 <= -0.08")
book.add(
    "t4_drawdown_stream",
    lambda s, d: ST.finished(ST.drawdown_stream(ST.replay(events(s, d)))).select("key", "event_id", "peak", out(F.col("drawdown")).alias("drawdown")),
    f"SELECT event_type AS key, event_id, max(value) OVER w AS peak, {R6('value / max(value) OVER w - 1')} AS drawdown FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
)
book.add("t5_daily_bars", lambda s, d: _bars_stream(s, d), "SELECT CAST(ts AS DATE) AS date, event_type AS key, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS ticks FROM events GROUP BY ALL")


def _bars_stream(s, d):
    rows = ST.finished(ST.daily_bars_stream(ST.replay(events(s, d))), "update")
    return rows.groupBy("date", "key").agg(F.max_by(F.struct("open", "high", "low", "close", "ticks"), "batch").alias("b")).select("date", "key", "b.*")
