"""The text report: each section is a DataFrame ``number, line`` made from tables; ``sinks.report_lines`` puts them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BASE, SIGNALS, pairs
from tidemark.functions.text import fixed, percent, signed, signed_percent, state_text, tsv
from tidemark.operators.islands import with_segment
from tidemark.operators.rolling import series, simple_return

U = "universe"
# Columns of the unified score table, as (title, column, form).
SCORES = (
    ("Corr", "pair_corr", "n"), ("Safe-NEG", "safe_negative", "n"), ("Guard", "guard", "n"), ("Absorption", "mm", "n"), ("J_norm", "j", "n"), ("FINT", "intensity", "n"), ("FAR", "far", "n"), ("RB_Flux", "rb", "n"), ("dCorr-Z", "frob_z", "n"),
    ("Diff", "diffusion", "n"), ("mmD", "mm_trend", "n"), ("APDF", "apdf", "n"), ("PCON", "pcon", "%"), ("v_PC1", "v_pc1", "n"), ("kappa", "kappa", "%"), ("Combo(Z)", "combo", "+%"), ("Breadth", "breadth", "%2"),
)


def _day(c: str = "d") -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def _numbered(rows: DataFrame, line: Column, head: str, order: str = "d") -> DataFrame:
    """A titled table: the head as number 0, then a line a row in order.  A report is one universe's and bounded by its calendar."""
    body = rows.select(F.row_number().over(Window.partitionBy(U).orderBy(order)).cast("long").alias("number"), line.alias("line"))
    return rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("number"), F.lit(head).alias("line")).unionByName(body)


def methodology(spark) -> DataFrame:
    """What the numbers mean."""
    lines = [
        f"- Stability = sum of w(i,j) |corr(i,j)| over the sum of w(i,j), of {', '.join(SIGNALS)}; stock-bond pairs weigh 2, stock-gold pairs 1.5.",
        "- Sub-indices: stock-crypto and traditional pairs by mean |corr|; Safe-NEG by mean max(0, -corr) of stocks with bonds and gold.",
        "- Classic score = 0.70 max(0, corr(IWM, BTC)) + 0.30 Safe-NEG.",
        "- Enhanced adds momentum, breadth and an absorption guard; the flow engine adds flux, its stability variant the slope of the stability.",
        "- Risk-On holds the levered asset, Neutral a third of it, Risk-Off cash; a signal is traded on the next row.",
    ]
    return spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "number long, line string")


def stability(records: DataFrame) -> DataFrame:
    """Every record with its smoothed value and delta."""
    return _numbered(records, tsv(_day(), fixed("stability"), fixed("smoothed"), signed("delta", 4)), "\t".join(("date", "Stability", "Smoothed", "Delta(3-10)")))


def sub_indices(records: DataFrame) -> DataFrame:
    return _numbered(records, tsv(_day(), fixed("stock_crypto"), fixed("traditional"), fixed("safe_negative")), "\t".join(("date", "stock-crypto(+)", "traditional(+)", "Safe-NEG(-)")))


def scores(states: DataFrame) -> DataFrame:
    """The unified table of 22 columns; what an engine does not have is N/A."""
    forms = {"n": fixed, "%": lambda c: percent(c, 0), "+%": signed_percent, "%2": percent}
    cell = lambda c, form: forms[form](c) if c in states.columns else F.lit("N/A")
    weak = "fragile" if "fragile" in states.columns else None
    line = tsv(_day(), state_text("state", weak), "state", "executed", fixed("score"), *(cell(c, form) for _, c, form in SCORES))
    return _numbered(states, line, "\t".join(("date", "label", "State", "Exec", "Score", *(t for t, _, _ in SCORES))))


def transition_text(states: DataFrame, mode: str = "classic") -> Column:
    """A line about a state's first row with the columns of the engine ``mode``."""
    extra = {
        "enhanced": (("Guard", fixed, "guard"), ("Absorption", fixed, "mm"), ("Combo", signed_percent, "combo")),
        "flow": (("J_norm", fixed, "j"), ("FINT", fixed, "intensity"), ("FAR", fixed, "far"), ("Guard", fixed, "guard"), ("Absorption", fixed, "mm"), ("Combo", signed_percent, "combo"), ("Breadth", percent, "breadth")),
        "fusion": (("wC", lambda c: percent(c, 0), "w_c"), ("wF", lambda c: percent(c, 0), "w_f"), ("Absorption", fixed, "mm")),
        "newgate": (("wTA", lambda c: percent(c, 0), "w_trend"), ("wFlow", lambda c: percent(c, 0), "w_flow"), ("Absorption", fixed, "mm")),
    }.get(mode, ())
    shown = (("Score", fixed, "score"), ("Corr", fixed, "pair_corr"), ("Safe-NEG", fixed, "safe_negative"), *extra)
    value = lambda form, c: form(c) if c in states.columns else F.lit("N/A")
    weak = "fragile" if "fragile" in states.columns else None
    return F.concat(F.lit("- "), _day(), F.lit(" "), state_text("state", weak), F.lit(" ("), F.concat_ws(", ", *(F.concat(F.lit(f"{t}="), value(form, c)) for t, form, c in shown)), F.lit(")"))


def timeline(states: DataFrame, mode: str = "classic") -> DataFrame:
    """``number, line``: the first row of every run of one state."""
    w = series(U)
    first = with_segment(states, "state").withColumn("__first", F.coalesce(F.col("segment") != F.lag("segment").over(w), F.lit(True))).filter("__first")
    return first.select(F.col("segment").cast("long").alias("number"), transition_text(first, mode).alias("line"))


def backtest_summary(stats: DataFrame) -> DataFrame:
    """Lines from one row of ``backtest.statistics`` joined with ``first_d, last_d``."""
    pct = lambda c: percent(c, 1)
    gain = lambda c: percent(F.exp(c) - 1, 1)
    lines = F.array(
        F.concat(F.lit("- Period: "), _day("first_d"), F.lit(" to "), _day("last_d"), F.lit(" ("), F.col("n").cast("string"), F.lit(" rows)")),
        F.concat(F.lit("- Strategy "), gain("log_equity"), F.lit(", benchmark "), gain("log_bench")), F.concat(F.lit("- CAGR "), pct("cagr")), F.concat(F.lit("- Largest drawdown "), pct("max_drawdown")),
        F.concat(F.lit("- Hit rate "), pct("hit_rate")), F.concat(F.lit("- On "), pct("share_on"), F.lit(", Off "), pct("share_off"), F.lit(", Neutral "), pct("share_neutral")),
    )
    return stats.select(F.posexplode(lines).alias("n", "line")).select(F.col("n").cast("long").alias("number"), "line")


def backtest_days(tested: DataFrame) -> DataFrame:
    """Every row of a backtest: returns, opens and equities with 8 decimals."""
    eight = lambda c, missing="0.00000000": fixed(c, 8, missing) if c in tested.columns else F.lit(missing)
    line = tsv(_day(), "state", "executed", eight("ret"), eight("ret_strategy"), eight("open"), eight("levered_open"), eight("equity", "1.00000000"), eight("equity_bench", "1.00000000"), eight("equity_levered", "1.00000000"))
    return _numbered(tested, line, "\t".join(("date", "Regime", "Executed", "ret_bench", "ret_strategy", f"{BASE} open", "TQQQ open", "eq_strategy", "eq_benchmark", "eq_tqqq")))


def price_lines(wide: DataFrame, primary: str = "IWM") -> DataFrame:
    """Closes and daily returns of the signal's stock and the base."""
    w = series(U)
    d = wide.withColumns({"__p": simple_return(f"c_{primary}", w), "__b": simple_return(f"c_{BASE}", w)})
    return _numbered(d, tsv(_day(), fixed(f"c_{primary}", 2), signed_percent("__p"), fixed(f"c_{BASE}", 2), signed_percent("__b")), "\t".join(("date", f"{primary} close", f"{primary} day", f"{BASE} close", f"{BASE} day")))


def heatmap(corr: DataFrame, day: Column | None = None) -> DataFrame:
    """``s1, s2, corr, band`` of one day, the last where ``day`` is none or unknown: red below 0.3, yellow below 0.4, else green."""
    there = F.max(F.when(F.col("d") == day, F.col("idx"))) if day is not None else F.lit(None).cast("int")
    at = corr.groupBy(U).agg(F.coalesce(there, F.max("idx")).alias("idx"))
    last = corr.join(at, [U, "idx"], "left_semi")
    return last.select(U, "s1", "s2", "corr", band("corr").alias("band"))


def band(c: str) -> Column:
    return F.when(F.col(c) < 0.3, "red").when(F.col(c) < 0.4, "yellow").otherwise("green")


def heatmap_lines(last: DataFrame, symbols: tuple[str, ...] = SIGNALS) -> DataFrame:
    """The square matrix of ``heatmap``, a line a symbol."""
    value = lambda a, b: F.lit("1.000") if a == b else fixed(F.max(F.when(F.col("s1").isin(a, b) & F.col("s2").isin(a, b), F.col("corr"))), 3)
    lines = [F.struct(F.lit(i + 1).cast("long").alias("number"), F.concat_ws("\t", F.lit(a), *(value(a, b) for b in symbols)).alias("line")) for i, a in enumerate(symbols)]
    head = F.struct(F.lit(0).cast("long").alias("number"), F.lit("\t".join(("asset", *symbols))).alias("line"))
    return last.agg(F.array(head, *lines).alias("x")).select(F.inline("x"))


def pair_lines(view: DataFrame, a: str, b: str) -> DataFrame:
    """Prices and the rolling correlation of one pair of ``records.pair_view``."""
    first, second = next(p for p in pairs() if set(p) == {a, b})
    d = view.filter(F.col("s1").isin(first, second) & F.col("s2").isin(first, second))
    return _numbered(d, tsv(_day(), fixed("price_a", 2), fixed("price_b", 2), fixed("corr")), "\t".join(("date", "price A", "price B", "correlation")), "idx")
