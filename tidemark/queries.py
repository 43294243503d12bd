"""One query per operator over the driver's tables, with the same result in DuckDB SQL where SQL can express it.

Doubles are rounded to 6 places on both sides.  The SQL is written apart from the operators: common
table expressions for panel, calendar, returns, pairs and records, and a final SELECT each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import EXECUTIONS, NEWGATE, SIGNALS, WINDOWS, Execution, Flow
from tidemark.functions import numeric as N
from tidemark.functions import text as TX
from tidemark.operators import align, eigen, filters, folds, islands, moments, order
from tidemark.operators import rolling as W
from tidemark.plans import backtest as B
from tidemark.plans import engines, flow, flux5, frame, narrative, newgate, report, search, sections
from tidemark.plans import records as R
from tidemark.sources import ingest, panel, shared, sinks
from tidemark.streaming import quotes as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
U = "universe"

# ---------------------------------------------------------------- SQL blocks
_ROLE = "CASE p_type WHEN 'STANDARD' THEN 'QQQ' WHEN 'LARGE' THEN 'IWM' WHEN 'MEDIUM' THEN 'SPY' WHEN 'SMALL' THEN 'TLT' WHEN 'ECONOMY' THEN 'GLD' WHEN 'PROMO' THEN 'BTC-USD' END"


def _panel_sql(day: str = "CAST(l_shipdate AS DATE)", universe: str = "'core'") -> str:
    return f"panel AS (SELECT {universe} AS universe, {_ROLE} AS symbol, {day} AS d, sum(l_extendedprice) / sum(l_quantity) AS open, sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"


_DAYS = "days AS (SELECT universe, d, row_number() OVER (PARTITION BY universe ORDER BY d) - 1 AS idx FROM (SELECT universe, d FROM panel GROUP BY 1, 2 HAVING count(*) = 6))"
_AL = "al AS MATERIALIZED (SELECT p.universe, p.symbol, p.d, idx, open, close FROM panel p JOIN days USING (universe, d))"
_RET = "ret AS (SELECT *, ln(close / lag(close) OVER s) AS r, close / lag(close) OVER s - 1 AS sr FROM al WINDOW s AS (PARTITION BY universe, symbol ORDER BY idx))"
_DIM = "dim AS (SELECT * FROM (VALUES ('QQQ', 0, NULL, 'stock'), ('IWM', 1, 'risk', 'stock'), ('SPY', 2, 'risk', 'stock'), ('TLT', 3, 'safe', 'bond'), ('GLD', 4, 'safe', 'gold'), ('BTC-USD', 5, 'risk', 'crypto')) AS t(symbol, ord, cluster, cat))"
_PR = """pr AS (SELECT a.universe, a.idx, a.d, CASE WHEN flip THEN b.symbol ELSE a.symbol END AS s1, CASE WHEN flip THEN a.symbol ELSE b.symbol END AS s2,
 CASE WHEN flip THEN b.r ELSE a.r END AS x, CASE WHEN flip THEN a.r ELSE b.r END AS y, CASE WHEN flip THEN b.sr ELSE a.sr END AS sx, CASE WHEN flip THEN a.sr ELSE b.sr END AS sy,
 CASE WHEN flip THEN b.close ELSE a.close END AS px, CASE WHEN flip THEN a.close ELSE b.close END AS py, CASE WHEN c1 IS NULL OR c2 IS NULL THEN 'other' WHEN c1 <> c2 THEN 'cross' ELSE c1 END AS kind, k1, k2
 FROM ret a JOIN ret b ON a.universe = b.universe AND a.idx = b.idx JOIN (SELECT a.symbol AS sa, b.symbol AS sb, a.cluster AS c1, b.cluster AS c2, a.cat AS k1, b.cat AS k2, coalesce(a.cluster = 'safe' AND b.cluster = 'risk', false) AS flip FROM dim a JOIN dim b ON a.ord < b.ord) ON a.symbol = sa AND b.symbol = sb)"""


def _corr_sql(n: int = 30) -> str:
    return f"co AS MATERIALIZED (SELECT * FROM (SELECT *, count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) OVER f AS n, coalesce(covar_pop(x, y) OVER f / nullif(stddev_pop(x) OVER f * stddev_pop(y) OVER f, 0), 0) AS corr FROM pr WINDOW f AS (PARTITION BY universe, s1, s2 ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) WHERE n = {n})"


_REC = """rec AS MATERIALIZED (SELECT universe, idx, d, sum(w * abs(corr)) / sum(w) AS stability, coalesce(avg(abs(corr)) FILTER (WHERE list_contains([k1, k2], 'stock') AND list_contains([k1, k2], 'crypto')), 0) AS stock_crypto,
 coalesce(avg(abs(corr)) FILTER (WHERE k1 <> 'crypto' AND k2 <> 'crypto'), 0) AS traditional, coalesce(avg(greatest(0, -corr)) FILTER (WHERE w > 1), 0) AS safe_negative, max(corr) FILTER (WHERE s1 = 'IWM' AND s2 = 'BTC-USD') AS pair_corr
 FROM (SELECT *, CASE WHEN list_contains([k1, k2], 'stock') AND list_contains([k1, k2], 'bond') THEN 2.0 WHEN list_contains([k1, k2], 'stock') AND list_contains([k1, k2], 'gold') THEN 1.5 ELSE 1.0 END::DOUBLE AS w FROM co WHERE s1 <> 'QQQ' AND s2 <> 'QQQ') GROUP BY 1, 2, 3)"""
_EMA = "ema AS (SELECT idx, stability AS e3, stability AS e10 FROM rec WHERE idx = (SELECT min(idx) FROM rec) UNION ALL SELECT r.idx, 0.5::DOUBLE * r.stability + 0.5::DOUBLE * e.e3, 2::DOUBLE / 11 * r.stability + 9::DOUBLE / 11 * e.e10 FROM ema e JOIN rec r ON r.idx = e.idx + 1)"
_CLASSIC = "cl AS (SELECT *, CASE WHEN pair_corr >= 0.5 THEN 1 WHEN pair_corr <= -0.1 OR score <= 0.3 THEN -1 WHEN score >= 0.65 AND pair_corr >= 0.2 THEN 1 ELSE 0 END AS state FROM (SELECT *, least(1, greatest(0, 0.7 * greatest(0, pair_corr) + 0.3 * safe_negative)) AS score FROM rec))"
_QQQ = "q AS MATERIALIZED (SELECT * FROM ret WHERE symbol = 'QQQ')"
_TRADED = "tr AS (SELECT c.universe, c.idx, c.d, c.state, q.open, q.close FROM cl c JOIN q ON c.idx = q.idx)"
_TO_AL = (_panel_sql(), _DAYS, _AL)
_TO_RET = (*_TO_AL, _RET)
_TO_Q = (*_TO_RET, _QQQ)
_TO_CO = (*_TO_RET, _DIM, _PR, _corr_sql())
_TO_REC = (*_TO_CO, _REC)
_TO_TR = (*_TO_REC, _CLASSIC, _QQQ, _TRADED)


def _with(blocks: tuple[str, ...], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(blocks)} {select}"


def _r(expression: str, alias: str) -> str:
    return f"round({expression}, 6) + 0 AS {alias}"


def _rounds(*names: str) -> str:
    return ", ".join(_r(n, n) for n in names)


def _logs(*names: str) -> str:
    """Prices are compared as logarithms: as plain numbers some lie just on a rounding edge."""
    return ", ".join(_r(f"ln({n})", n) for n in names)


def _log(*names: str) -> list[Column]:
    return [F.ln(n).alias(n) for n in names]


def query(sql: str | None = None):
    """Register a query under its function's name; its doubles are rounded."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(spark, sf_dir)
            out = out.drop(U) if U in out.columns else out
            return out.withColumns({c: F.round(c, 6) + F.lit(0.0) for c, t in out.dtypes if t == "double"})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- inputs
def bars(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    return panel.from_line_items(spark, sf_dir, bucket)


def settled_bars(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    """Bars for an engine that uses them several times: made from the trades once."""
    return shared.settled(bars(spark, sf_dir, bucket), "bars")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base symbol on the shared calendar: ``idx, d, open, close, r, sr``."""
    w = W.series(U)
    d = R.wide_aligned(bars(spark, sf_dir)).select(U, "idx", "d", F.col("o_QQQ").alias("open"), F.col("c_QQQ").alias("close"))
    return d.withColumns({"r": W.log_return("close", w), "sr": W.simple_return("close", w)})


def records(spark: SparkSession, sf_dir: str, bucket: str = "day", window: int = 30) -> DataFrame:
    return frame.records(bars(spark, sf_dir, bucket), window).select(U, "idx", "d", "stability", "stock_crypto", "traditional", "safe_negative", "pair_corr")


def traded(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    """Classic states with the base symbol's prices, which the record's row holds."""
    return engines.classic(frame.records(bars(spark, sf_dir, bucket))).select(U, "idx", "d", "stability", "score", "state", F.col("o_QQQ").alias("open"), F.col("c_QQQ").alias("close"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str, bucket: str = "day") -> DataFrame:
    """Coupling index, Classic regime and its open-to-close backtest."""
    t = B.backtest(traded(spark, sf_dir, bucket), EXECUTIONS["app"])
    return t.select("d", "stability", "score", "state", "executed", "ret_strategy", F.ln("equity").alias("log_equity"), "dd")


# ---------------------------------------------------------------- alignment and joins
@query(_with(_TO_AL, f"SELECT symbol, d, idx, {_logs('open', 'close')} FROM al"))
def j01_align(spark, sf_dir):
    return align.align(bars(spark, sf_dir)).select("symbol", "d", "idx", *_log("open", "close"))


@query(_with((*_TO_AL, "gap AS (SELECT symbol, d, open FROM al WHERE idx % 3 <> 0)"), f"SELECT symbol, d, {_r('ln(coalesce(g.open, a.close))', 'open')} FROM al a LEFT JOIN gap g USING (symbol, d)"))
def j03_opens(spark, sf_dir):
    a = align.align(bars(spark, sf_dir))
    return align.opens_on(a, a.filter("idx % 3 != 0")).select("symbol", "d", *_log("open"))


@query(_with((*_TO_AL, "gap AS (SELECT symbol, d, open FROM al WHERE idx % 3 = 1)"), f"SELECT symbol, d, {_r('ln(coalesce(last_value(o IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), close))', 'open')} FROM (SELECT a.symbol, a.d, a.close, g.open AS o FROM al a LEFT JOIN gap g USING (symbol, d))"))
def j04_opens_filled(spark, sf_dir):
    a = align.align(bars(spark, sf_dir))
    return align.opens_filled(a, a.filter("idx % 3 = 1")).select("symbol", "d", *_log("open"))


@query(_with((*_TO_AL, "live AS (SELECT * FROM al WHERE symbol <> 'GLD' AND idx >= 1000)"), f"SELECT symbol, d, {_r('ln(close * 2)', 'close')} FROM live UNION ALL SELECT a.symbol, a.d, {_r('ln(close)', 'close')} FROM al a LEFT JOIN (SELECT symbol, min(d) AS f FROM live GROUP BY 1) USING (symbol) WHERE f IS NULL OR d < f"))
def j05_history(spark, sf_dir):
    a = align.align(bars(spark, sf_dir))
    live = a.filter("symbol != 'GLD' and idx >= 1000").withColumn("close", F.col("close") * 2)
    return align.with_history(a, live).select("symbol", "d", *_log("close"))


@query(_with((*_TO_Q, "l AS (SELECT d, open AS v FROM q WHERE idx % 2 = 0)", "t AS (SELECT d, close AS v FROM q WHERE idx % 3 = 0)"), f"SELECT d, {_r('ln(coalesce(t.v, l.v))', 'v')} FROM l FULL OUTER JOIN t USING (d)"))
def j06_right_wins(spark, sf_dir):
    q = base(spark, sf_dir)
    return align.right_wins(q.filter("idx % 2 = 0").select("d", F.col("open").alias("v")), q.filter("idx % 3 = 0").select("d", F.col("close").alias("v")), ["d"]).select("d", *_log("v"))


@query(_with((_panel_sql(), "m AS (SELECT max(d) AS last FROM panel)"), f"SELECT symbol, d, {_r('ln(CASE WHEN d = last THEN 100.5 ELSE close END)', 'close')} FROM panel, m UNION ALL SELECT symbol, last + 1, round(ln(100.5), 6) FROM (SELECT DISTINCT symbol FROM panel), m UNION ALL SELECT symbol, last, round(ln(100.5), 6) FROM (SELECT DISTINCT symbol FROM panel), m WHERE symbol NOT IN (SELECT symbol FROM panel, m WHERE d = last)"))
def j07_upsert(spark, sf_dir):
    p = bars(spark, sf_dir)
    last = p.agg(F.max("d").alias("last"))
    quotes = p.select(U, "symbol").distinct().join(F.broadcast(last)).select(U, "symbol", F.explode(F.array("last", F.date_add("last", 1))).alias("d"), F.lit(100.5).alias("price"))
    return align.upsert(p, quotes).select("symbol", "d", *_log("close"))


@query(_with((_panel_sql(),), f"SELECT symbol, d, {_r('ln(close)', 'close')} FROM panel UNION ALL SELECT symbol, DATE '1998-07-05', {_r('ln(arg_max(close, d))', 'close')} FROM panel WHERE d <= DATE '1998-07-05' AND EXISTS (SELECT 1 FROM panel WHERE d = DATE '1998-07-05') GROUP BY symbol HAVING max(d) < DATE '1998-07-05'"))
def j08_day_stub(spark, sf_dir):
    return align.day_stub(bars(spark, sf_dir), F.lit("1998-07-05").cast("date")).select("symbol", "d", *_log("close"))


@query(_with((_panel_sql("CAST(date_trunc('week', l_shipdate) AS DATE)"), "w AS (SELECT d + 3 AS d, symbol FROM panel)", "v AS (SELECT symbol, d, close FROM panel WHERE close > 1600)"), f"SELECT symbol, d, (SELECT {_r('ln(arg_max(close, v.d))', 'x')} FROM v WHERE v.symbol = w.symbol AND v.d <= w.d) AS close FROM w"))
def j09_as_of(spark, sf_dir):
    p = bars(spark, sf_dir, "week")
    return align.as_of(p.select("symbol", F.date_add("d", 3).alias("d")), p.filter("close > 1600"), ["symbol"], "close").select("symbol", "d", *_log("close"))


@query(_with((*_TO_RET, _DIM, _PR), f"SELECT idx, s1, s2, kind, {_rounds('x', 'y')} FROM pr"))
def j10_pairs(spark, sf_dir):
    return R.pairs_of(R.with_returns(R.wide_aligned(bars(spark, sf_dir))), "r").select("idx", "s1", "s2", "kind", "x", "y")


@query(_with((*_TO_AL, "l AS (SELECT d, symbol, CASE WHEN idx % 5 > 0 THEN ln(open) END AS x FROM al WHERE idx % 3 > 0)", "r AS (SELECT d, symbol, ln(close) AS x FROM al WHERE idx % 2 = 0)"), f"SELECT d, symbol AS feature, {_r('coalesce(l.x, r.x)', 'x')} FROM l FULL OUTER JOIN r USING (d, symbol)"))
def j13_preferred(spark, sf_dir):
    """Two vectors of features a day: the first where it has a finite value, else the second."""
    a = align.align(bars(spark, sf_dir)).withColumnRenamed("symbol", "feature")
    left = a.filter("idx % 3 > 0").select("d", "feature", F.when(F.col("idx") % 5 > 0, F.ln("open")).otherwise(F.lit(float("nan"))).alias("x"))
    return report.preferred(left, a.filter("idx % 2 = 0").select("d", "feature", F.ln("close").alias("x")), ("d",))


@query(_with((_panel_sql(), _DIM), "SELECT symbol FROM (SELECT symbol FROM dim UNION ALL SELECT 'TQQQ') WHERE symbol NOT IN (SELECT symbol FROM panel)"))
def p07_missing_symbols(spark, sf_dir):
    wanted = spark.createDataFrame([(s,) for s in ("QQQ", *SIGNALS, "TQQQ")], "symbol string")
    return align.missing_symbols(bars(spark, sf_dir), wanted)


@query(_with(_TO_Q, f"SELECT d, {_logs('close')} FROM q WHERE d BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'"))
def p02_slice(spark, sf_dir):
    return ingest.filtered(base(spark, sf_dir), start=F.lit("1995-01-01").cast("date"), end=F.lit("1995-12-31").cast("date")).select("d", *_log("close"))


@query(_with((*_TO_RET,), f"SELECT symbol, d, {_logs('close')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS n FROM al) WHERE n <= 90"))
def p03_last_rows(spark, sf_dir):
    return ingest.filtered(align.align(bars(spark, sf_dir)), 90, by=("symbol",)).select("symbol", "d", *_log("close"))


@query(_with((_panel_sql(),), "SELECT symbol, greatest(max(d) + 1, DATE '1998-12-01') AS start FROM panel WHERE d < CASE symbol WHEN 'GLD' THEN DATE '1999-07-01' WHEN 'TLT' THEN DATE '1999-01-15' ELSE DATE '1998-06-01' END GROUP BY 1 HAVING greatest(max(d) + 1, DATE '1998-12-01') <= DATE '1999-06-01'"))
def p14_fetch_window(spark, sf_dir):
    """Some symbols end before the cutoff, one between it and today; what ends later is not fetched."""
    ends = F.when(F.col("symbol") == "GLD", "1999-07-01").when(F.col("symbol") == "TLT", "1999-01-15").otherwise("1998-06-01").cast("date")
    return ingest.fetch_window(bars(spark, sf_dir).filter(F.col("d") < ends), F.lit("1998-12-01").cast("date"), F.lit("1999-06-01").cast("date"))


@query("""WITH v AS (SELECT CAST(l_orderkey AS VARCHAR) AS symbol, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS o, CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity END AS c, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * (1 - l_discount) END AS a, l_tax AS p, l_linenumber AS n FROM lineitem),
w AS (SELECT *, coalesce(a, c, p) AS x, row_number() OVER (PARTITION BY symbol, d ORDER BY n DESC) AS k FROM v WHERE coalesce(a, c, p) IS NOT NULL)
SELECT symbol, d, round(o * coalesce(a / nullif(c, 0), 1), 6) + 0 AS open, round(x, 6) + 0 AS close FROM w WHERE k = 1""")
def s03_vendor_bars(spark, sf_dir):
    """Bars of vendor rows: adjusted close, else close, else price; the open follows the adjustment; the last row of a day wins.

    Some orders have a line number twice on a day; of such rows the first of the file wins.
    """
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("symbol"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), F.col("l_extendedprice").alias("open"), F.when(n % 3 != 0, F.col("l_quantity")).alias("close"),
        F.when(n % 2 == 0, F.col("l_quantity") * (1 - F.col("l_discount"))).alias("adjClose"), F.col("l_tax").alias("price"), n.alias("seq"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
    )
    return ingest.vendor_bars(rows, "file", "at").select("symbol", "d", "open", "close")


@query("SELECT s_suppkey, 'S' || s_suppkey || ',' || 'N' || s_nationkey AS tickers, 2 AS n FROM supplier")
def s16_tickers(spark, sf_dir):
    """Symbols of a text: the supplier's name is too long for one, the other two stay, each once."""
    d = ingest.tickers(table(spark, sf_dir, "supplier").withColumn("value", F.concat_ws(", ", "s_name", F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("n"), "s_nationkey"), F.concat(F.lit("S"), "s_suppkey"))))
    return d.select("s_suppkey", F.array_join("tickers", ",").alias("tickers"), F.size("tickers").alias("n"))


@query("""WITH v AS (SELECT p_partkey, upper(concat_ws(' ', p_name, array_to_string(list_transform(range(p_partkey % 40), lambda i: 's' || CAST((p_partkey + i * i) % 29 AS VARCHAR)), ', '), 'toolongsymbol1,brk.b')) AS v FROM part),
t AS (SELECT p_partkey, unnest(string_split_regex(v, '[,\\s]+')) AS s, generate_subscripts(string_split_regex(v, '[,\\s]+'), 1) AS i FROM v),
f AS (SELECT p_partkey, s, min(i) AS i FROM t WHERE regexp_full_match(s, '[A-Z0-9.\\-]{1,10}') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS n FROM f)
SELECT p_partkey, string_agg(s, ',' ORDER BY i) AS tickers, CAST(count(*) AS INT) AS n FROM r WHERE n <= 15 GROUP BY 1""")
def s16_ticker_lists(spark, sf_dir):
    """The symbols of texts with valid, repeated, too long and more than 15 symbols, between commas and blanks."""
    made = F.expr("array_join(transform(filter(sequence(0L, 39L), i -> i < p_partkey % 40), i -> 's' || CAST((p_partkey + i * i) % 29 AS STRING)), ', ')")
    d = ingest.tickers(table(spark, sf_dir, "part").withColumn("value", F.concat_ws(" ", "p_name", made, F.lit("toolongsymbol1,brk.b"))))
    return d.select("p_partkey", F.array_join("tickers", ",").alias("tickers"), F.size("tickers").alias("n"))


# ---------------------------------------------------------------- returns and windows
@query(_with(_TO_RET, f"SELECT symbol, idx, {_r('r', 'r')}, {_r('close / nth_value(close, 2) OVER (PARTITION BY symbol ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)', 'norm')} FROM ret QUALIFY r IS NOT NULL"))
def w01_returns(spark, sf_dir):
    w = W.series("symbol")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = align.align(bars(spark, sf_dir)).withColumns({"r": W.log_return("close", w), "norm": F.col("close") / F.nth_value("close", 2).over(whole)})
    return d.filter("r is not null").select("symbol", "idx", "r", "norm")


@query(_with(_TO_RET, f"SELECT symbol, idx, {_r('sr', 'r1')}, {_r('coalesce(sr, 0)', 'r0')}, {_r('close / lag(close, 10) OVER (PARTITION BY symbol ORDER BY idx) - 1', 'r10')} FROM ret"))
def w03_simple_returns(spark, sf_dir):
    w = W.series("symbol")
    return align.align(bars(spark, sf_dir)).select("symbol", "idx", W.simple_return("close", w).alias("r1"), W.simple_return("close", w, missing=0.0).alias("r0"), W.simple_return("close", w, 10).alias("r10"))


@query(_with(_TO_CO, f"SELECT s1, s2, idx, d, {_rounds('corr')} FROM co"))
def w04_rolling_corr(spark, sf_dir):
    return R.correlations(bars(spark, sf_dir)).select("s1", "s2", "idx", "d", "corr")


def _windows_sql(n: int) -> str:
    return f"SELECT s1, s2, idx, d, {n} AS window, corr FROM (SELECT *, count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) OVER f AS n, coalesce(covar_pop(x, y) OVER f / nullif(stddev_pop(x) OVER f * stddev_pop(y) OVER f, 0), 0) AS corr FROM pr WINDOW f AS (PARTITION BY universe, s1, s2 ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)) WHERE n = {n}"


@query(_with((*_TO_RET, _DIM, _PR), f"SELECT s1, s2, idx, d, CAST(\"window\" AS INT) AS \"window\", {_rounds('corr')} FROM ({' UNION ALL '.join(_windows_sql(n).replace(' AS window', ' AS \"window\"') for n in WINDOWS)})"))
def w04_three_windows(spark, sf_dir):
    """The correlations of 20, 30 and 60 returns, all from one pass."""
    return R.correlations_over(bars(spark, sf_dir)).select("s1", "s2", "idx", "d", "window", "corr")


@query(_with((*_TO_RET, _DIM, _PR), f"SELECT s1, s2, idx, {_rounds('corr')}, {_logs('price_a', 'price_b')} FROM (SELECT s1, s2, idx, px AS price_a, py AS price_b, covar_pop(sx, sy) OVER f / nullif(stddev_pop(sx) OVER f * stddev_pop(sy) OVER f, 0) AS corr FROM pr WINDOW f AS (PARTITION BY s1, s2 ORDER BY idx ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) WHERE idx >= 29"))
def w05_pair_view(spark, sf_dir):
    return R.pair_view(bars(spark, sf_dir)).select("s1", "s2", "idx", "corr", *_log("price_a", "price_b"))


@query(_with((*_TO_REC, _EMA), f"SELECT rec.idx, {_r('e10', 'smoothed')}, {_r('e3 - e10', 'delta')} FROM rec JOIN ema USING (idx)", True))
def w07_smoothed(spark, sf_dir):
    return R.smoothed(records(spark, sf_dir)).select("idx", "smoothed", "delta")


_DAMP = """e AS (SELECT symbol, idx, greatest(r, 0) ** 2 AS u, greatest(-r, 0) ** 2 AS v FROM ret WHERE symbol IN ('QQQ', 'IWM', 'BTC-USD') AND idx = 1
 UNION ALL SELECT ret.symbol, ret.idx, 2::DOUBLE / 61 * greatest(r, 0) ** 2 + 59::DOUBLE / 61 * u, 2::DOUBLE / 61 * greatest(-r, 0) ** 2 + 59::DOUBLE / 61 * v FROM e JOIN ret ON ret.symbol = e.symbol AND ret.idx = e.idx + 1)"""


@query(_with((*_TO_AL, _RET.replace("ret AS (", "ret AS MATERIALIZED ("), _DAMP), f"SELECT idx, {_r('greatest(0.5, 1 / (1 + 0.5 * greatest(0, coalesce(q, 1) - 1.2)))', 'damp')} FROM days LEFT JOIN (SELECT idx, max(least(5, v / (u + 1e-12))) AS q FROM e GROUP BY idx) USING (idx)", True))
def w08_bear_damp(spark, sf_dir):
    return folds.bear_damp(align.align(bars(spark, sf_dir))).select("idx", "damp")


def _over(n: int) -> str:
    return f"OVER (ORDER BY idx ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


@query(_with(_TO_Q, f"SELECT idx, {_r(f'avg(r) {_over(20)}', 'm')}, {_r(f'CASE WHEN idx >= 19 AND count(r) {_over(20)} > 1 THEN stddev_pop(r) {_over(20)} END', 'sd')}, {_r(f'CASE WHEN idx >= 251 THEN (r - avg(r) {_over(252)}) / nullif(stddev_pop(r) {_over(252)}, 0) END', 'z')}, {_r(f'CASE WHEN count(r) {_over(63)} >= 2 THEN (r - avg(r) {_over(63)}) / nullif(stddev_samp(r) {_over(63)}, 0) END', 'zs')} FROM q"))
def w11_zscore(spark, sf_dir):
    spec = {"m": moments.Mean("r", 20), "sd": moments.Deviation("r", 20, first=19), "z": moments.ZScore("r", 252, first=251), "zs": moments.ZScore("r", 63, 1)}
    return moments.with_moments(base(spark, sf_dir), spec).select("idx", *spec)


@query(_with(_TO_Q, f"SELECT idx, {_r('CASE WHEN r IS NOT NULL AND len(h) >= 63 THEN (len(list_filter(h, lambda v: v <= r)) - 1) / (len(h) - 1) END', 'rank')} FROM (SELECT idx, r, list(r) FILTER (WHERE r IS NOT NULL) {_over(252)} AS h FROM q)"))
def w13_percentile_rank(spark, sf_dir):
    return order.with_order(base(spark, sf_dir), {"rank": order.Rank("r")}).select("idx", "rank")


@query(_with((*_TO_Q, "st AS (SELECT idx, close - lag(close) OVER (ORDER BY idx) AS s FROM q)"), f"SELECT idx, {_r(f'CASE WHEN count(s) {_over(14)} = 14 THEN CASE WHEN avg(greatest(-s, 0)) {_over(14)} <= 1e-12 THEN 100 ELSE 100 - 100 / (1 + avg(greatest(s, 0)) {_over(14)} / avg(greatest(-s, 0)) {_over(14)}) END END', 'rsi')} FROM (SELECT * FROM st WHERE s IS NOT NULL) UNION ALL SELECT idx, NULL FROM st WHERE s IS NULL"))
def w14_rsi(spark, sf_dir):
    return W.with_rsi(base(spark, sf_dir), "close", (U,)).select("idx", "rsi")


@query(_with(_TO_Q, f"SELECT idx, {_r(f'CASE WHEN count(r) {_over(63)} >= 20 THEN regr_slope(r, n) {_over(63)} END', 'slope')} FROM (SELECT idx, r, CASE WHEN r IS NOT NULL THEN count(r) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) END::DOUBLE AS n FROM q)"))
def w15_slope(spark, sf_dir):
    return W.with_slope(base(spark, sf_dir), "r", (U,)).select("idx", "slope")


@query(_with(_TO_RET, f"SELECT symbol, idx, {_r('tanh((close / lag(close, 10) OVER s - 1) / nullif(CASE WHEN idx >= 20 THEN stddev_samp(sr) OVER f END, 0) / 2)', 'z')} FROM ret WINDOW s AS (PARTITION BY symbol ORDER BY idx), f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"))
def w18_z_momentum(spark, sf_dir):
    w = W.series("symbol")
    d = align.align(bars(spark, sf_dir)).withColumn("sr", W.simple_return("close", w))
    return d.select("symbol", "idx", W.z_momentum("close", w, "sr").alias("z"))


@query(_with(_TO_Q, f"SELECT idx, {_r('CASE WHEN len(h) >= 5 THEN nullif(1.4826 * list_median(list_transform(h, lambda v: abs(v - list_median(h)))), 0) END', 'sigma')} FROM (SELECT idx, list(r) FILTER (WHERE r IS NOT NULL) {_over(126)} AS h FROM q)"))
def w19_mad(spark, sf_dir):
    return order.with_order(base(spark, sf_dir), {"sigma": order.Robust("r", 126)}).select("idx", "sigma")


_PRED = "p AS (SELECT idx, coalesce(r, 0) AS r, coalesce(lag(CAST(sign(r) AS INT)) OVER (ORDER BY idx), 0) AS pred FROM q)"


@query(_with((*_TO_Q, _PRED), f"SELECT idx, {_r(f'coalesce(sum(CASE WHEN pred * r > 0 THEN 1 ELSE 0 END) {_over(40)} / nullif(sum(abs(pred)) {_over(40)}, 0), 0.5)', 'hit')}, {_r(f'avg(pred * r) {_over(40)} / sqrt(greatest(1e-12, var_pop(r) {_over(40)}))', 'ic')}, {_r(f'avg(pred * r) {_over(63)} / nullif(stddev_samp(pred * r) {_over(63)}, 0)', 'ir')} FROM p QUALIFY count(*) {_over(63)} >= 30"))
def w20_hit_ic_ir(spark, sf_dir):
    w = W.series(U)
    d = base(spark, sf_dir).withColumns({"pred": F.coalesce(F.lag(F.signum("r").cast("int")).over(w), F.lit(0)), "r": F.coalesce("r", F.lit(0.0))})
    return W.with_skill(d, {"": ("pred", "r")}, 40, 63).select("idx", "hit", "ic", "ir").filter("idx >= 29")


_FLOW = """zs AS (SELECT symbol, idx, CASE WHEN idx >= 251 THEN (r - avg(r) OVER f) / nullif(stddev_pop(r) OVER f, 0) END AS z FROM ret WINDOW f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
fl AS (SELECT idx, CASE WHEN count(z) > 0 THEN coalesce(avg(z) FILTER (WHERE symbol IN ('IWM', 'SPY', 'BTC-USD')), 0) - coalesce(avg(z) FILTER (WHERE symbol IN ('TLT', 'GLD')), 0) END AS flow FROM zs WHERE symbol <> 'QQQ' GROUP BY idx),
g1 AS (SELECT idx, flow, CASE WHEN flow IS NOT NULL THEN sum(flow) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) END AS x, coalesce(flow - lag(flow) OVER (ORDER BY idx), 0) AS g FROM fl),
g2 AS (SELECT *, sqrt(avg(greatest(g, 0) ** 2) OVER h) AS d_up, sqrt(avg(greatest(-g, 0) ** 2) OVER h) AS d_down, CASE WHEN x IS NOT NULL THEN count(x) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) END::DOUBLE AS n FROM g1 WINDOW h AS (ORDER BY idx ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
g3 AS (SELECT *, CASE WHEN count(x) OVER h >= 20 THEN regr_slope(x, n) OVER h END AS mu FROM g2 WINDOW h AS (ORDER BY idx ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
g4 AS (SELECT *, greatest(coalesce(mu, 0), 0) - d_up * greatest(g, 0) - (greatest(coalesce(-mu, 0), 0) - d_down * greatest(-g, 0)) AS j FROM g3)"""


@query(_with((*_TO_RET, _FLOW), f"SELECT idx, {_rounds('flow', 'x', 'g', 'd_up', 'd_down', 'j')} FROM g4"))
def r21_flow_columns(spark, sf_dir):
    return newgate.flow_columns(bars(spark, sf_dir)).select("idx", "flow", "x", "g", "d_up", "d_down", "j")


@query(_with(_TO_CO, f"SELECT idx, {_r('sqrt(2 * sum(dc ** 2) / 25)', 'frob')} FROM (SELECT idx, corr - lag(corr) OVER (PARTITION BY s1, s2 ORDER BY idx) AS dc FROM co WHERE s1 <> 'QQQ' AND s2 <> 'QQQ') GROUP BY idx"))
def w27_frobenius(spark, sf_dir):
    return eigen.frobenius_change(R.correlations(bars(spark, sf_dir), 30, SIGNALS), 5).select("idx", "frob")


_LATCH = "la AS (SELECT idx, d, close, coalesce(last_value(CASE WHEN r >= 0.08 THEN 1 WHEN r <= -0.05 THEN -1 END IGNORE NULLS) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM q)"


def latched(spark, sf_dir):
    w = W.series(U)
    return base(spark, sf_dir).withColumn("state", islands.latch("r", 0.08, -0.05, w))


@query(_with((*_TO_Q, _LATCH), "SELECT idx, state, coalesce(lag(state, 1) OVER (ORDER BY idx), 0) AS executed FROM la"))
def w31_latch(spark, sf_dir):
    return latched(spark, sf_dir).select("idx", "state", islands.executed("state", W.series(U)).alias("executed"))


_SEG = "ch AS (SELECT *, CASE WHEN state = lag(state) OVER (ORDER BY idx) THEN 0 ELSE 1 END AS c FROM la), sg AS (SELECT *, sum(c) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS segment FROM ch)"


@query(_with((*_TO_Q, _LATCH, _SEG), "SELECT CAST(segment AS BIGINT) AS segment, any_value(state) AS state, min(d) AS start_d, max(d) AS end_d, count(*) AS n FROM sg GROUP BY segment"))
def w32_segments(spark, sf_dir):
    return islands.segments(latched(spark, sf_dir), "state")


@query(_with((*_TO_Q, _LATCH, _SEG, "runs AS (SELECT segment, any_value(state) AS state, min(d) AS d, arg_min(close, idx) AS p0, arg_max(close, idx) AS p1, max(d) AS d1 FROM sg GROUP BY segment)", "nx AS (SELECT segment, state, d, p0, lag(state) OVER o AS prev_state, coalesce(lead(d) OVER o, d1) AS end_d, coalesce(lead(p0) OVER o, p1) AS pe FROM runs WINDOW o AS (ORDER BY segment))"),
             f"SELECT state, d, prev_state, end_d, {_r('ln(p0)', 'price_start')}, {_r('ln(pe)', 'price_end')}, {_r('(pe / p0 - 1) * 100', 'return_pct')}, CASE WHEN state > 0 THEN pe > p0 WHEN state < 0 THEN pe < p0 ELSE pe >= p0 END AS hit, CAST(row_number() OVER (ORDER BY segment DESC) AS INT) AS rank FROM nx WHERE prev_state IS NOT NULL ORDER BY segment DESC LIMIT 10"))
def w33_transitions(spark, sf_dir):
    return islands.transitions(latched(spark, sf_dir), "state", "close").drop("price_delta").withColumns({c: F.ln(c) for c in ("price_start", "price_end")})


@query(_with((*_TO_Q, "h AS (SELECT idx, coalesce(r > 0, false) AS ok FROM q)", "i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) AS island FROM h)"), "SELECT idx, CAST(sum(CAST(ok AS INT)) OVER (PARTITION BY island ORDER BY idx ROWS UNBOUNDED PRECEDING) AS INT) AS streak FROM i"))
def w30_streak(spark, sf_dir):
    return islands.with_streak(base(spark, sf_dir), F.col("r") > 0, "streak").select("idx", "streak")


_PIVOT = 'pv AS (SELECT idx, CASE WHEN close > greatest(lag(close, 2) OVER o, lag(close) OVER o, lead(close) OVER o, lead(close, 2) OVER o) THEN 1 WHEN close < least(lag(close, 2) OVER o, lag(close) OVER o, lead(close) OVER o, lead(close, 2) OVER o) THEN -1 END AS "pivot", count(*) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM q WINDOW o AS (ORDER BY idx))'


@query(_with((*_TO_Q, _PIVOT), 'SELECT idx, "pivot", CAST(idx - lag(idx) OVER (PARTITION BY "pivot" ORDER BY idx) AS INT) AS gap FROM pv WHERE "pivot" IS NOT NULL AND n = 5'))
def w35_pivots(spark, sf_dir):
    return folds.pivots(base(spark, sf_dir), "close").select("idx", "pivot", "gap")


@query(_with((*_TO_Q, _PIVOT, 'g AS (SELECT idx - lag(idx) OVER (PARTITION BY "pivot" ORDER BY idx) AS gap FROM pv WHERE "pivot" IS NOT NULL AND n = 5)'), "SELECT CAST(2 * least(greatest(list_sort(list(gap))[len(list(gap)) // 2 + 1], 5), 30) AS BIGINT) AS cycle, count(gap) AS n_gaps FROM g WHERE gap IS NOT NULL"))
def b15_cycle(spark, sf_dir):
    return folds.cycle(folds.pivots(base(spark, sf_dir), "close"))


@query(_with(_TO_Q, f"SELECT idx, {_r('ln(first_value(close) OVER w) + sum(ln(1 + CASE WHEN sr IS NULL THEN 0 ELSE least(greatest(3 * sr, -0.99), 5) END)) OVER w', 'log_levered')} FROM q WINDOW w AS (ORDER BY idx ROWS UNBOUNDED PRECEDING)"))
def w38_levered(spark, sf_dir):
    return folds.synthetic_levered(align.align(bars(spark, sf_dir))).select("idx", "log_levered")


@query(_with(_TO_Q, f"SELECT idx, {_r('ln(lead(open) OVER (ORDER BY idx))', 'next_open')}, {_r('ln(lead(close) OVER (ORDER BY idx))', 'next_close')} FROM q"))
def w39_next_prices(spark, sf_dir):
    return W.with_next(base(spark, sf_dir), "open", "close").select("idx", *_log("next_open", "next_close"))


# ---------------------------------------------------------------- records, engines, backtests
@query(_with(_TO_REC, f"SELECT idx, d, {_rounds('stability', 'stock_crypto', 'traditional', 'safe_negative', 'pair_corr')} FROM rec"))
def a08_records(spark, sf_dir):
    return records(spark, sf_dir)


@query(_with(_TO_CO, f"SELECT idx, {_r('sum(CASE WHEN kind = $$cross$$ THEN 2 ELSE 1 END * abs(corr)) / sum(CASE WHEN kind = $$cross$$ THEN 2 ELSE 1 END)', 'stability')} FROM co WHERE s1 <> 'QQQ' AND s2 <> 'QQQ' GROUP BY idx"))
def a09_stability_by_cluster(spark, sf_dir):
    return R.stability_by_cluster(R.correlations(bars(spark, sf_dir), 30, SIGNALS)).select("idx", "stability")


@query(_with(_TO_REC, f"SELECT {_r('avg(stability) FILTER (WHERE n <= 180)', 'average180')}, {_r('avg(stability - s) FILTER (WHERE n <= 10)', 'slope10')}, {_r('quantile_cont(stability, 0.3)', 'q30')}, {_r('quantile_cont(stability, 0.7)', 'q70')} FROM (SELECT *, row_number() OVER (ORDER BY idx DESC) AS n, lag(stability) OVER (ORDER BY idx) AS s FROM rec)"))
def a11_summary(spark, sf_dir):
    """Mean of the last 180 records, mean of the last 10 steps, quantiles."""
    return R.summary(records(spark, sf_dir))


@query(_with((*_TO_REC, _CLASSIC), f"SELECT idx, d, {_rounds('score')}, state FROM cl"))
def r01_classic(spark, sf_dir):
    return engines.classic(records(spark, sf_dir)).select("idx", "d", "score", "state")


@query(_with((_panel_sql("CAST(date_trunc('week', l_shipdate) AS DATE)", "l_returnflag"), _DAYS, _AL, _RET, _DIM, _PR, _corr_sql(20), _REC, _CLASSIC), f"SELECT universe AS flag, idx, {_rounds('stability', 'score')}, state FROM cl"))
def r01_classic_by_universe(spark, sf_dir):
    """Several universes at once, one per return flag, on weekly bars: they never share a task's window."""
    p = panel.from_line_items(spark, sf_dir, "week", "l_returnflag")
    return engines.classic(R.daily(R.correlations(p, 20, SIGNALS))).select(F.col(U).alias("flag"), "idx", "stability", "score", "state")


_FIT = """th AS (SELECT quantile_cont(pair_corr, 0.3) AS c0, quantile_cont(pair_corr, 0.7) AS c1, quantile_cont(score, 0.3) AS s0, quantile_cont(score, 0.7) AS s1 FROM cl),
cf AS (SELECT universe, idx, d, CASE WHEN pair_corr >= c1 THEN 1 WHEN pair_corr <= c0 OR score <= s0 THEN -1 WHEN score >= s1 AND pair_corr >= (c0 + c1) / 2 THEN 1 ELSE 0 END AS state FROM cl, th)"""


def fitted_rows(spark, sf_dir):
    rec = frame.records(settled_bars(spark, sf_dir))
    return engines.classic_fitted(rec)


def fitted_states(spark, sf_dir):
    return fitted_rows(spark, sf_dir).select(U, "idx", "d", "state")


@query(_with((*_TO_REC, _CLASSIC, _FIT), "SELECT idx, d, state FROM cf"))
def r01_classic_fitted(spark, sf_dir):
    """Thresholds at quantiles of the history, so that all three states occur."""
    return fitted_states(spark, sf_dir)


_BY_FLAG = (_panel_sql("CAST(date_trunc('week', l_shipdate) AS DATE)", "l_returnflag"), _DAYS, _AL, _RET, _DIM, _PR, _corr_sql(20))
_FIT_BY = "th AS (SELECT universe, quantile_cont(pair_corr, 0.3) AS c0, quantile_cont(pair_corr, 0.7) AS c1, quantile_cont(score, 0.3) AS s0, quantile_cont(score, 0.7) AS s1 FROM cl GROUP BY 1)"


@query(_with((*_BY_FLAG, _REC, _CLASSIC, _FIT_BY), f"SELECT universe AS flag, {_r('c1', 'pair_on')}, {_r('c0', 'pair_off')}, {_r('s1', 'score_on')}, {_r('s0', 'score_off')}, {_r('(c0 + c1) / 2', 'pair_min')} FROM th"))
def a12_thresholds(spark, sf_dir):
    """The fitted thresholds of three universes, one per return flag: a row each."""
    return engines.fit(frame.records(panel.from_line_items(spark, sf_dir, "week", "l_returnflag"), 20)).withColumn("flag", F.col(U))


@query(_with((*_BY_FLAG, _REC, _CLASSIC, _FIT_BY), f"SELECT universe AS flag, idx, {_rounds('score')}, CASE WHEN pair_corr >= c1 THEN 1 WHEN pair_corr <= c0 OR score <= s0 THEN -1 WHEN score >= s1 AND pair_corr >= (c0 + c1) / 2 THEN 1 ELSE 0 END AS state FROM cl JOIN th USING (universe)"))
def r01_fitted_by_universe(spark, sf_dir):
    """Three universes, each with its own thresholds."""
    rec = shared.settled(frame.records(panel.from_line_items(spark, sf_dir, "week", "l_returnflag"), 20), "records")
    return engines.classic_fitted(rec).select(F.col(U).alias("flag"), "idx", "score", "state")


_FLUX_BY = """zm AS (SELECT universe, symbol, idx, coalesce(tanh((close / lag(close, 10) OVER s - 1) / nullif(CASE WHEN idx >= 20 THEN stddev_samp(sr) OVER f END, 0) / 2), 0) AS z FROM ret WINDOW s AS (PARTITION BY universe, symbol ORDER BY idx), f AS (PARTITION BY universe, symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fj AS (SELECT universe, idx, tanh(sum(w * (a - b)) / sum(w) / 0.25) AS j FROM (SELECT co.universe, co.idx, abs(corr) ** 1.5 AS w, a.z AS a, b.z AS b FROM co JOIN zm a ON a.universe = co.universe AND a.symbol = s1 AND a.idx = co.idx JOIN zm b ON b.universe = co.universe AND b.symbol = s2 AND b.idx = co.idx WHERE kind = 'cross') GROUP BY 1, 2)"""


@query(_with((*_BY_FLAG, _FLUX_BY), f"SELECT universe AS flag, count(*) AS n, {_r('greatest(0.10, quantile_cont(j, 0.715))', 'on')}, {_r('least(-0.08, quantile_cont(j, 0.244))', 'off')} FROM fj GROUP BY 1".replace("AS on", 'AS "on"')))
def r12_thresholds(spark, sf_dir):
    """Thresholds of the flux of three universes at the quantiles of their own histories."""
    p = panel.from_line_items(spark, sf_dir, "week", "l_returnflag")
    cols = flow.pair_flux(R.correlations(p, 20, SIGNALS), flow.momenta(p)).select(U, F.tanh(F.col("flux_raw") / 0.25).alias("j"), F.lit(None).cast("double").alias("score"))
    cols = shared.settled(cols, "flux")
    return flow.fit(cols).join(cols.groupBy(U).agg(F.count("*").alias("n")), U).select(F.col(U).alias("flag"), "n", "on", "off")


_FLUX = """zm AS (SELECT symbol, idx, coalesce(tanh((close / lag(close, 10) OVER s - 1) / nullif(CASE WHEN idx >= 20 THEN stddev_samp(sr) OVER f END, 0) / 2), 0) AS z FROM ret WINDOW s AS (PARTITION BY symbol ORDER BY idx), f AS (PARTITION BY symbol ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
fx AS (SELECT co.idx, co.d, kind, corr, abs(corr) ** 1.5 AS w, a.z AS a, b.z AS b, corr - lag(corr) OVER (PARTITION BY s1, s2 ORDER BY co.idx) AS dc FROM co JOIN zm a ON a.symbol = s1 AND a.idx = co.idx JOIN zm b ON b.symbol = s2 AND b.idx = co.idx WHERE s1 <> 'QQQ' AND s2 <> 'QQQ')"""


@query(_with((*_TO_CO, _FLUX), f"""SELECT idx, {_r("sum(w * (a - b)) FILTER (WHERE kind = 'cross') / sum(w) FILTER (WHERE kind = 'cross')", 'flux_raw')}, {_r("sum(w * abs(a - b)) FILTER (WHERE kind = 'cross') / sum(w) FILTER (WHERE kind = 'cross')", 'intensity')},
 {_r("tanh(sum(w * CASE kind WHEN 'cross' THEN a - b WHEN 'risk' THEN (a + b) / 2 ELSE -(a + b) / 2 END) / sum(w) / 0.25)", 'apdf')}, {_r("sum(w * CAST(CASE kind WHEN 'cross' THEN a > b WHEN 'risk' THEN a > 0 AND b > 0 ELSE a <= 0 AND b <= 0 END AS INT)) / sum(w)", 'pcon')},
 {_r("tanh(coalesce(sum(w * dc * sign(a + b)) FILTER (WHERE kind = 'risk' AND dc IS NOT NULL) / sum(w) FILTER (WHERE kind = 'risk' AND dc IS NOT NULL), 0) / 0.25)", 'rb')} FROM fx GROUP BY idx"""))
def r04_pair_flux(spark, sf_dir):
    p = bars(spark, sf_dir)
    return flow.pair_flux(R.correlations(p, 30, SIGNALS), flow.momenta(p)).drop("d")


_EXPOSE = "CASE WHEN executed > 0 THEN 3.0 WHEN executed < 0 THEN 0.0 ELSE {neutral} END"


def _test_sql(ret: str, delay: int, neutral: float, states: str = "tr") -> tuple[str, ...]:
    return (
        f"ex AS (SELECT *, coalesce(lag(state, {delay}) OVER (ORDER BY idx), 0) AS executed, coalesce({ret}, 0) AS ret FROM {states})",
        f"st AS (SELECT *, greatest(-0.99, ret * {_EXPOSE.format(neutral=neutral)}) AS ret_strategy FROM ex)",
        "eq AS (SELECT *, exp(sum(ln(1 + ret_strategy)) OVER w) AS equity, exp(sum(ln(1 + greatest(ret, -0.99))) OVER w) AS bench FROM st WINDOW w AS (ORDER BY idx ROWS UNBOUNDED PRECEDING))",
        "bt AS (SELECT *, equity / max(equity) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM eq)",
    )


_BT = f"SELECT idx, state, executed, {_rounds('ret', 'ret_strategy', 'dd')}, {_r('ln(equity)', 'log_equity')}, {_r('ln(bench)', 'log_bench')} FROM bt"
_OPEN_CLOSE, _OPEN_OPEN, _CLOSE = "close / open - 1", "lead(open) OVER (ORDER BY idx) / open - 1", "close / lag(close) OVER (ORDER BY idx) - 1"
_FITTED_TR = (*_TO_REC, _CLASSIC, _FIT, _QQQ, "tr AS (SELECT c.idx, c.d, c.state, q.open, q.close FROM cf c JOIN q ON c.idx = q.idx)")


def fitted_traded(spark, sf_dir):
    return fitted_rows(spark, sf_dir).select(U, "idx", "d", "state", F.col("o_QQQ").alias("open"), F.col("c_QQQ").alias("close"))


def _bt(tested: DataFrame) -> DataFrame:
    return tested.select("idx", "state", "executed", "ret", "ret_strategy", "dd", F.ln("equity").alias("log_equity"), F.ln("equity_bench").alias("log_bench"))


@query(_with((*_TO_TR, *_test_sql(_OPEN_CLOSE, 1, 0.33 * 3)), _BT))
def b01_open_close(spark, sf_dir):
    return _bt(B.backtest(traded(spark, sf_dir), EXECUTIONS["app"]))


@query(_with((*_FITTED_TR, *_test_sql(_OPEN_CLOSE, 1, 0.33 * 3)), _BT))
def b01_open_close_fitted(spark, sf_dir):
    return _bt(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["app"]))


@query(_with((*_FITTED_TR, *_test_sql(_OPEN_OPEN, 1, 0.33 * 3)), _BT))
def b02_open_open(spark, sf_dir):
    return _bt(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["compare"]))


@query(_with((*_FITTED_TR, *_test_sql(_OPEN_CLOSE, 1, 1.0)), _BT))
def b03_neutral_unlevered(spark, sf_dir):
    return _bt(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["ffl_runner"]))


@query(_with((*_FITTED_TR, *_test_sql(_CLOSE, 2, 0.33)), _BT))
def b05_close_delay2(spark, sf_dir):
    return _bt(B.backtest(fitted_traded(spark, sf_dir), Execution("close_close", 2, neutral_leverage=1.0)))


@query(_with((*_FITTED_TR, *_test_sql(_OPEN_OPEN, 1, 0.33)), _BT))
def b06_tomorrow_open(spark, sf_dir):
    return _bt(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["tomorrow_open"]))


@query(_with((*_FITTED_TR, *_test_sql(_CLOSE, 1, 1.0)), _BT))
def b07_flux5_equity(spark, sf_dir):
    return _bt(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["flux5"]))


@query(_with((*_FITTED_TR, "md AS (SELECT * FROM (VALUES ('open_close'), ('open_open'), ('close_close')) AS t(mode))",
              "ex AS (SELECT mode, idx, state, coalesce(lag(state) OVER w, 0) AS executed, coalesce(CASE mode WHEN 'open_close' THEN close / open - 1 WHEN 'open_open' THEN lead(open) OVER w / open - 1 ELSE close / lag(close) OVER w - 1 END, 0) AS ret FROM tr, md WINDOW w AS (PARTITION BY mode ORDER BY idx))"),
             f"SELECT mode, idx, executed, {_r('sum(ln(1 + greatest(-0.99, ret * CASE WHEN executed > 0 THEN 3.0 WHEN executed < 0 THEN 0.0 ELSE 0.4 END))) OVER (PARTITION BY mode ORDER BY idx ROWS UNBOUNDED PRECEDING)', 'log_equity')} FROM ex"))
def b08_modes(spark, sf_dir):
    """Three execution modes of one signal."""
    signal = fitted_traded(spark, sf_dir)
    out = None
    for mode in ("open_close", "open_open", "close_close"):
        t = B.backtest(signal, Execution(mode, neutral_weight=0.4, neutral_leverage=1.0)).select(F.lit(mode).alias("mode"), "idx", "executed", F.ln("equity").alias("log_equity"))
        out = t if out is None else out.unionByName(t)
    return out


@query(_with((*_FITTED_TR, *_test_sql(_OPEN_CLOSE, 1, 0.33 * 3), "c AS (SELECT *, CASE WHEN state <> lag(state) OVER (ORDER BY idx) THEN 1 WHEN lag(state) OVER (ORDER BY idx) IS NULL THEN NULL ELSE 0 END AS ch FROM bt)"),
             f"SELECT count(*) AS n, {_r('ln(arg_max(equity, idx))', 'log_equity')}, {_r('ln(arg_max(bench, idx))', 'log_bench')}, {_r('exp(ln(arg_max(equity, idx)) * 252 / count(*)) - 1', 'cagr')}, {_r('min(dd)', 'max_drawdown')}, {_r('avg(CASE WHEN executed <> 0 THEN CASE WHEN executed * ret > 0 THEN 1.0 ELSE 0.0 END END)', 'hit_rate')}, {_r('avg(CASE WHEN executed > 0 THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END)', 'on_hit_rate')}, {_r('avg(CAST(state = 1 AS INT))', 'share_on')}, {_r('avg(CAST(state = 0 AS INT))', 'share_neutral')}, {_r('avg(CAST(state = -1 AS INT))', 'share_off')}, {_r('sum(ch) * 252 / count(*)', 'churn')}, CAST(sum(ch) AS BIGINT) AS transitions FROM c"))
def a13_statistics(spark, sf_dir):
    return B.statistics(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["app"]))


@query(_with((*_FITTED_TR, *_test_sql(_OPEN_CLOSE, 1, 0.33 * 3), "f AS (SELECT idx, state, CASE WHEN count(ret) OVER w = 5 THEN exp(sum(ln(1 + ret)) OVER w) - 1 END AS r5 FROM bt WINDOW w AS (ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING))"), f"SELECT idx, {_r('r5', 'ret_5')}, CASE WHEN state <> 0 THEN state * r5 > 0 END AS hit_5 FROM f"))
def a17_forward(spark, sf_dir):
    return B.forward(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["app"])).select("idx", "ret_5", "hit_5")


@query(_with((*_TO_Q, "y AS (SELECT CAST(year(d) AS INT) AS year, arg_max(close, d) AS last FROM q GROUP BY 1)"), f"SELECT year, {_r('last / coalesce(lag(last) OVER (ORDER BY year), 1) - 1', 'ret')} FROM y"))
def a20_yearly(spark, sf_dir):
    return B.yearly(base(spark, sf_dir), equity="close")


_FUSE = """tw AS (SELECT f.idx, f.state AS sf, la.state AS sl, coalesce(q.sr, 0) AS r, coalesce(lag(f.state) OVER (ORDER BY f.idx), 0) AS pf, coalesce(lag(la.state) OVER (ORDER BY f.idx), 0) AS pl, rec.stability AS mm FROM cf f JOIN la ON f.idx = la.idx JOIN q ON f.idx = q.idx JOIN rec ON rec.idx = f.idx),
sk AS (SELECT *, 0.5 * (coalesce(sum(CASE WHEN pf * r > 0 THEN 1 ELSE 0 END) OVER w / nullif(sum(abs(pf)) OVER w, 0), 0.5) - 0.5) + 0.5 * avg(pf * r) OVER w / sqrt(greatest(1e-12, var_pop(r) OVER w)) AS kf,
 0.5 * (coalesce(sum(CASE WHEN pl * r > 0 THEN 1 ELSE 0 END) OVER w / nullif(sum(abs(pl)) OVER w, 0), 0.5) - 0.5) + 0.5 * avg(pl * r) OVER w / sqrt(greatest(1e-12, var_pop(r) OVER w)) AS kl FROM tw WINDOW w AS (ORDER BY idx ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)),
wt AS (SELECT *, greatest(0.1, 1 / (1 + exp(4 * (kl - kf)))) AS a, greatest(0.1, 1 / (1 + exp(4 * (kf - kl)))) AS b FROM sk),
fu AS (SELECT *, a / (a + b) AS w_c, b / (a + b) AS w_f, (a * sf + b * sl) / (a + b) AS fused FROM wt)"""


@query(_with((*_FITTED_TR[:-1], _LATCH, _FUSE), f"SELECT idx, {_rounds('w_c', 'w_f', 'fused')}, CASE WHEN mm >= 0.2 THEN -1 WHEN mm >= 0.18 AND fused > 0 THEN 0 WHEN fused >= 0.2 THEN 1 WHEN fused <= -0.2 THEN -1 ELSE 0 END AS state FROM fu"))
def r18_fusion(spark, sf_dir):
    """The fusion of two engines that SQL can express; the stability stands for the absorption ratio."""
    two = fitted_states(spark, sf_dir).withColumnRenamed("state", "state_c")
    two = two.join(latched(spark, sf_dir).select(U, "idx", F.col("state").alias("state_f"), F.col("sr").alias("ret")), [U, "idx"])
    two = two.join(records(spark, sf_dir).select(U, "idx", F.col("stability").alias("mm")), [U, "idx"])
    return engines.fusion(two, mm_fragile=0.18, mm_off=0.20).select("idx", "w_c", "w_f", "fused", "state")


@query()
def r02_enhanced(spark, sf_dir):
    return engines.enhanced(frame.daily(settled_bars(spark, sf_dir))).select("idx", "d", "blend", "guard", "state", "fragile")


def _flow(variant: str):
    def run(spark, sf_dir):
        out = flow.flow(settled_bars(spark, sf_dir), 30, Flow(variant))
        return out.select("idx", "d", "j", "diffusion", "guard", "score", "state", "executed", "fragile")

    return run


for _v in ("classic", "exp", "stab"):
    _f = _flow(_v)
    _f.__name__ = f"r03_flow_{_v}"
    query()(_f)


@query()
def r18_fll_fusion(spark, sf_dir):
    """Classic and the stability-aware flow engine, mixed."""
    f = flow.flow(settled_bars(spark, sf_dir)).select(U, "idx", "d", F.col("state").alias("state_f"), "ret", "mm", "pair_corr", "safe_negative")
    two = engines.classic(f).withColumnRenamed("state", "state_c").drop("score")
    return engines.fusion(two).select("idx", "d", "w_c", "w_f", "state", "executed", "score")


@query()
def r19_newgate(spark, sf_dir):
    return newgate.newgate(settled_bars(spark, sf_dir)).select("idx", "d", "position", "w_trend", "ta_state", "flow_state", "ew_hits", "dr_hits", "cr_hits", "cr_held", "state", "executed")


@query()
def r29_newgate_diagnostics(spark, sf_dir):
    p = NEWGATE["base"]
    done = newgate.newgate(settled_bars(spark, sf_dir), p)
    return newgate.diagnostics(done, p).join(newgate.concordance(done), U)


@query()
def r30_flux5(spark, sf_dir):
    return flux5.flux5(flux5.inputs(settled_bars(spark, sf_dir))).select("idx", "d", "flux_score", "kappa", "state", "executed")


@query()
def n01_absorption(spark, sf_dir):
    return R.absorption(R.correlations(bars(spark, sf_dir), 30, SIGNALS)).select("idx", "mm", eigen.first_component("upper").alias("pc1"))


@query()
def b11_grid(spark, sf_dir):
    """864 candidates of ClassicFlux5."""
    rows = shared.settled(flux5.inputs(settled_bars(spark, sf_dir, "week"), 20), "flux5")
    return search.search_flux5(rows, search.grid(**search.FLUX5_GRID))


@query()
def b12_flow_search(spark, sf_dir):
    """Eight candidates of the exp variant on a train and a test part; the best is chosen by the train part's objective."""
    parts = search.in_parts(settled_bars(spark, sf_dir, "week"), {"train": ("1992-01-01", "1996-12-31"), "test": ("1997-01-01", "1999-12-31")})
    cols = shared.settled(flow.columns(parts, 20), "flow")
    return search.objective_exp(search.search_flow(cols, search.grid(**search.EXP_GRID), Flow("exp"), Execution("close_close", neutral_weight=1.0, neutral_leverage=1.0)))


_PROB = "pb AS (SELECT idx, 1 / (1 + exp(-r * 20)) AS p, lead(close, 5) OVER (ORDER BY idx) / close - 1 AS future FROM q WHERE r IS NOT NULL)"


@query(_with((*_TO_Q, _PROB), f"SELECT idx, {_rounds('p', 'future')}, CASE WHEN future IS NOT NULL THEN (p >= 0.5 AND future > 0) OR (p < 0.5 AND future <= 0) END AS \"right\" FROM pb"))
def b16_probability(spark, sf_dir):
    d = base(spark, sf_dir).filter("r is not null").withColumn("p", N.sigmoid("r", 20))
    return report.probability_backtest(d).select("idx", "p", "future", "right")


# ---------------------------------------------------------------- report
_LASTQ = """sq AS (SELECT symbol, d, close AS price, lag(close) OVER s AS pc, avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS m50, avg(close) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS m200, max(close) OVER y AS hi, min(close) OVER y AS lo, row_number() OVER (PARTITION BY symbol ORDER BY d DESC) AS n FROM panel WINDOW s AS (PARTITION BY symbol ORDER BY d), y AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)), lq AS (SELECT * FROM sq WHERE n = 1)"""


@query(_with((_panel_sql(), _LASTQ), f"SELECT {_r('sum(CAST(price > pc AS INT)) / greatest(1, sum(CAST(price < pc AS INT)))', 'adr')}, {_r('avg(CAST(price > m50 AS INT))', 'pct50')}, {_r('avg(CAST(price > m200 AS INT))', 'pct200')}, {_r('sum(CAST(price >= 0.995 * hi AS INT)) / greatest(1, sum(CAST(price <= 1.005 * lo AS INT)))', 'nh_nl')} FROM lq"))
def a21_breadth(spark, sf_dir):
    return report.breadth(report.panel_quotes(bars(spark, sf_dir)))


@query(_with((_panel_sql(), "lr AS (SELECT d, ln(close / lag(close) OVER (ORDER BY d)) AS r, row_number() OVER (ORDER BY d DESC) AS n FROM panel WHERE symbol = 'QQQ')"), f"SELECT 20 AS n, {_r('stddev_samp(r) * sqrt(252)', 'rv')} FROM lr WHERE n <= 20 UNION ALL SELECT 60, {_r('stddev_samp(r) * sqrt(252)', 'rv')} FROM lr WHERE n <= 60"))
def a24_volatility(spark, sf_dir):
    p = bars(spark, sf_dir)
    return report.realized_volatility(p, "QQQ", 20).select(F.lit(20).alias("n"), "rv").unionByName(report.realized_volatility(p, "QQQ", 60).select(F.lit(60).alias("n"), "rv"))


@query("SELECT round(arg_max(l_quantity, k) - arg_max(l_tax, k), 6) + 0 AS spr_10y_3m, round(arg_max(l_quantity, k) - arg_max(l_discount, k), 6) + 0 AS spr_10y_2y, round(arg_max(l_extendedprice, k) + arg_max(l_tax, k) - 2 * arg_max(l_quantity, k), 6) + 0 AS curvature FROM (SELECT *, l_orderkey * 100 + l_linenumber AS k FROM lineitem)")
def a25_curve(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("d"), F.col("l_tax").alias("month3"), F.col("l_discount").alias("year2"), F.col("l_quantity").alias("year10"), F.col("l_extendedprice").alias("year30"))
    return report.curve(li)


_NB = "nb AS (SELECT feature, avg(x) FILTER (WHERE up = 1) AS mu_up, var_pop(x) FILTER (WHERE up = 1) + 1e-6 AS var_up, avg(x) FILTER (WHERE up = 0) AS mu_dn, var_pop(x) FILTER (WHERE up = 0) + 1e-6 AS var_dn, avg(up) AS prior_up FROM tn GROUP BY feature)"
_TN = "sx AS (SELECT symbol, idx, sr, lead(close, 5) OVER (PARTITION BY symbol ORDER BY idx) > close AS up FROM ret WHERE idx > 0), tn AS (SELECT symbol AS feature, idx, sr AS x, CAST(up AS INT) AS up FROM sx WHERE up IS NOT NULL)"


def labelled(spark, sf_dir) -> DataFrame:
    """``feature, idx, x, up``: each symbol's return as a feature and whether its price rose in five rows."""
    w = W.series("symbol")
    d = align.align(bars(spark, sf_dir)).withColumns({"x": W.simple_return("close", w), "up": (F.lead("close", 5).over(w) > F.col("close")).cast("int")})
    return d.filter("x is not null and up is not null").select(F.col("symbol").alias("feature"), "idx", "x", "up")


@query(_with((*_TO_RET, _TN, _NB), f"SELECT feature, {_rounds('mu_up', 'var_up', 'mu_dn', 'var_dn', 'prior_up')} FROM nb"))
def a27_fit_bayes(spark, sf_dir):
    return report.fit_bayes(labelled(spark, sf_dir))


_LLR = "sc AS (SELECT tn.idx, tn.feature, tn.x, prior_up, -0.5 * (ln(2 * pi() * greatest(var_up, 1e-3)) + (x - mu_up) ** 2 / greatest(var_up, 1e-3)) + 0.5 * (ln(2 * pi() * greatest(var_dn, 1e-3)) + (x - mu_dn) ** 2 / greatest(var_dn, 1e-3)) AS llr FROM tn JOIN nb USING (feature))"


@query(_with((*_TO_RET, _TN, _NB, _LLR, "po AS (SELECT idx, sum(llr) + ln(max(prior_up) / (1 - max(prior_up))) AS l FROM sc GROUP BY idx)"), f"SELECT idx, {_r('1 / (1 + exp(-l))', 'p_raw')}, {_r('1 / (1 + exp(-(0.2427 * ln(p / (1 - p)) + 0.3089)))', 'p_up')} FROM (SELECT *, least(greatest(1 / (1 + exp(-l)), 1e-5), 1 - 1e-5) AS p FROM po)"))
def m01_posterior(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return report.posterior(report.drivers(rows.select("idx", "feature", "x"), report.fit_bayes(rows)), 0.2427, 0.3089, ("idx",))


@query(_with((*_TO_RET, _TN, _NB, _LLR), f"SELECT feature, {_rounds('x', 'llr')}, CAST(row_number() OVER (ORDER BY abs(llr) DESC, feature) AS INT) AS rank FROM sc WHERE idx = 1000 QUALIFY rank <= 5"))
def m01_top_drivers(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return report.top_drivers(report.drivers(rows.filter("idx = 1000").select("feature", "x"), report.fit_bayes(rows)))


@query(_with((*_TO_RET, _TN, _NB, _LLR), f"SELECT idx, feature, {_rounds('x', 'llr')}, CAST(row_number() OVER (PARTITION BY idx ORDER BY abs(llr) DESC, feature) AS INT) AS rank FROM sc QUALIFY rank <= 5"))
def m01_top_drivers_by_day(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return report.top_drivers(report.drivers(rows.select("idx", "feature", "x"), report.fit_bayes(rows)), by=("idx",))


@query("SELECT p_brand AS sector, round(p_size / 100.0, 6) + 0 AS change, CAST(row_number() OVER (ORDER BY p_size DESC, p_brand) AS INT) AS rank FROM (SELECT p_brand, max(p_size) AS p_size FROM part GROUP BY 1)")
def m07_sectors(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("sector")).agg(F.max("p_size").alias("s"))
    # As text percentages above 5, which the operator scales.
    return report.sectors(rows.select("sector", F.concat(F.lit("+"), F.greatest("s", F.lit(6)).cast("string"), F.lit("%")).alias("change")))


@query("SELECT event_id, user_id, value, CASE WHEN value > 50 THEN 'Risk-On' WHEN value < 10 THEN 'Risk-Off' ELSE 'Neutral' END AS label, CASE WHEN (hour(ts) * 60 + minute(ts) + 1140) % 1440 < 570 THEN 'pre' WHEN (hour(ts) * 60 + minute(ts) + 1140) % 1440 >= 960 THEN 'post' ELSE 'regular' END AS part FROM events")
def q09_labels(spark, sf_dir):
    """Labels of states, and the trading session of a time: all events are in January, five hours behind UTC."""
    s = F.when(F.col("value") > 50, 1).when(F.col("value") < 10, -1).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value", N.label_state(s).alias("label"), N.session_of("ts").alias("part"))


@query(_with((*_FITTED_TR, *_test_sql(_CLOSE, 1, 1.0)), "SELECT strftime(d, '%Y-%m-%d') AS date, state AS regime, executed, printf('%.8f', ret) AS ret_bench, printf('%.8f', ret_strategy) AS ret_strategy FROM bt"))
def k04_csv(spark, sf_dir):
    t = sinks.backtest_csv(B.backtest(fitted_traded(spark, sf_dir), EXECUTIONS["golden"]))
    return t.select("date", "regime", "executed", "ret_bench", "ret_strategy")  # prices and equities as text lie on rounding edges: k04_equities


@query(_with((*_TO_CO, "l AS (SELECT max(idx) AS i FROM co)"), f"SELECT s1, s2, {_rounds('corr')}, CASE WHEN corr < 0.3 THEN 'red' WHEN corr < 0.4 THEN 'yellow' ELSE 'green' END AS band FROM co, l WHERE idx = i"))
def v02_heatmap(spark, sf_dir):
    return sections.heatmap(R.correlations(bars(spark, sf_dir)))


@query(_with((*_TO_REC, _CLASSIC), "SELECT 0 AS section, CAST(-1 AS BIGINT) AS number, '[score table]' AS line UNION ALL SELECT 0, CAST(row_number() OVER (ORDER BY d) AS BIGINT) AS number, concat_ws(chr(9), strftime(d, '%m/%d'), printf('%.4f', stability), CASE WHEN state > 0 THEN 'Risk-On' WHEN state < 0 THEN 'Risk-Off' ELSE 'Neutral' END) AS line FROM cl"))
def q17_report_lines(spark, sf_dir):
    c = engines.classic(records(spark, sf_dir))
    lines = c.select(F.row_number().over(W.series(U, order="d")).cast("long").alias("number"), TX.tsv(TX.month_day("d"), TX.fixed("stability"), TX.state_text("state")).alias("line"))
    return sinks.report_lines(score_table=lines)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) + 0 AS total FROM events GROUP BY 1, 2")
def t01_event_windows(spark, sf_dir):
    return stream.event_windows(table(spark, sf_dir, "events")).drop("users")


@query("SELECT user_id, event_id, coalesce(last_value(CASE WHEN value >= 60 THEN 1 WHEN value <= 10 THEN -1 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS state FROM events")
def t02_latch_by_user(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", islands.latch("value", 60, 10, w).alias("state"))


# ---------------------------------------------------------------- guards, filters, texts
@query(_with((_panel_sql(),), f"SELECT symbol, d, {_r('close / first_value(close) OVER (PARTITION BY symbol ORDER BY d)', 'norm')} FROM panel"))
def p15_normalized(spark, sf_dir):
    return filters.normalized(bars(spark, sf_dir)).select("symbol", "d", "norm")


@query(_with((*_TO_Q, "b AS (SELECT quantile_cont(r, 0.05) AS lo, quantile_cont(r, 0.95) AS hi, quantile_cont(r, 0.25) AS a, quantile_cont(r, 0.5) AS m, quantile_cont(r, 0.75) AS z FROM q)"), f"SELECT idx, {_r('CASE WHEN r IS NOT NULL THEN least(greatest(r, lo), hi) END', 'r')}, {_r('(r - m) / (z - a)', 'scaled')} FROM q, b"))
def p17_winsorized(spark, sf_dir):
    q = base(spark, sf_dir).select(U, "idx", "r", F.col("r").alias("scaled"))
    return filters.quartile_scaled(filters.winsorized(q, "r", 0.05), "scaled").select("idx", "r", "scaled")


@query(_with((*_TO_Q, "v AS (SELECT row_number() OVER (ORDER BY idx DESC) AS n, r FROM q WHERE idx % 2 = 0)"), f"SELECT idx, {_r('v.r', 'r')} FROM (SELECT idx, row_number() OVER (ORDER BY idx DESC) AS n FROM q) d LEFT JOIN v USING (n)"))
def p10_right_aligned(spark, sf_dir):
    q = base(spark, sf_dir)
    return filters.right_aligned(q.select(U, "idx"), q.filter("idx % 2 = 0").select(U, "idx", "r"), "r").select("idx", "r")


@query(_with((_panel_sql(),), "SELECT min(d) AS first_d, max(d) AS last_d, min(d) <= DATE '1996-01-01' AND max(d) >= DATE '2001-01-01' AS covers, date_diff('day', max(d), DATE '2001-01-01') > 3 AS stale FROM panel"))
def p20_coverage(spark, sf_dir):
    return filters.coverage(bars(spark, sf_dir), F.lit("1996-01-01").cast("date"), F.lit("2001-01-01").cast("date"))


@query(_with((*_TO_Q, _LATCH), "SELECT d, state FROM la WHERE (SELECT count(*) FROM la WHERE state IS NULL) = 0"))
def p09_complete_lookup(spark, sf_dir):
    la = latched(spark, sf_dir)
    return filters.complete_lookup(la.select(U, "d"), filters.first_states(la)).select("d", "state")


_DI = "e AS (SELECT idx, greatest(s, 0) AS u, greatest(-s, 0) AS v, abs(s) AS m FROM sp WHERE idx = 1 UNION ALL SELECT sp.idx, 2::DOUBLE / 15 * greatest(s, 0) + 13::DOUBLE / 15 * u, 2::DOUBLE / 15 * greatest(-s, 0) + 13::DOUBLE / 15 * v, 2::DOUBLE / 15 * abs(s) + 13::DOUBLE / 15 * m FROM e JOIN sp ON sp.idx = e.idx + 1)"


@query(_with((*_TO_Q, "sp AS MATERIALIZED (SELECT idx, close - lag(close) OVER (ORDER BY idx) AS s FROM q)", _DI), f"SELECT idx, {_r('100 * u / m', 'di_plus')}, {_r('100 * v / m', 'di_minus')} FROM e UNION ALL SELECT 0, NULL, NULL", True))
def r32_directional_index(spark, sf_dir):
    return filters.directional_index(base(spark, sf_dir)).select("idx", "di_plus", "di_minus")


@query(_with((*_TO_Q, _LATCH, _SEG, "runs AS (SELECT segment, any_value(state) AS state, min(d) AS d, arg_min(close, idx) AS p0, arg_max(close, idx) AS p1 FROM sg GROUP BY segment)", "nx AS (SELECT segment, state, d, p0, lag(state) OVER o AS ps, coalesce(lead(p0) OVER o, p1) AS pe FROM runs WINDOW o AS (ORDER BY segment))"),
             "SELECT row_number() OVER (ORDER BY segment DESC) AS number, concat_ws(chr(9), strftime(d, '%m/%d'), CASE WHEN ps > 0 THEN 'Risk-On' WHEN ps < 0 THEN 'Risk-Off' ELSE 'Neutral' END || ' > ' || CASE WHEN state > 0 THEN 'Risk-On' WHEN state < 0 THEN 'Risk-Off' ELSE 'Neutral' END, printf('%.2f%%', (pe / p0 - 1) * 100), CASE WHEN CASE WHEN state > 0 THEN pe > p0 WHEN state < 0 THEN pe < p0 ELSE pe >= p0 END THEN 'hit' ELSE 'miss' END) AS line FROM nx WHERE ps IS NOT NULL ORDER BY segment DESC LIMIT 10"))
def q10_transition_lines(spark, sf_dir):
    return narrative.transition_lines(islands.transitions(latched(spark, sf_dir), "state", "close"))
