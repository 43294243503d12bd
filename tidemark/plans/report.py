"""The probability report: market features, a Gaussian naive Bayes posterior with its drivers, and texts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import YEAR
from tidemark.functions.numeric import finite, gaussian_log_density, platt, ratio, sigmoid
from tidemark.functions.text import printf
from tidemark.operators.rolling import frame, log_return, series

U = "universe"
# Features in model order with the bounds of those that have some.
FEATURES = ("ADR", "Pct>MA50", "Pct>MA200", "NH/NL", "RV20", "RV60", "SPR_10Y_3M", "SPR_10Y_2Y", "CURVATURE")
BOUNDS = {"ADR": (0.05, 5.0), "NH/NL": (0.05, 8.0), "Pct>MA50": (0.0, 1.0), "Pct>MA200": (0.0, 1.0)}


def breadth(quotes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``adr, pct50, pct200, nh_nl`` of ``quotes(price, prev_close, change, change_pct, ma50, ma200, year_high, year_low)``.

    The move is the percentage if any quote has one, else the change, else price less previous close.
    """
    has = lambda c: F.max(F.col(c).isNotNull())
    kinds = [F.col("change_pct"), F.col("change"), F.col("price") - F.col("prev_close")]
    up, down = ([F.sum(F.when(t(k), 1).otherwise(0)) for k in kinds] for t in (lambda k: k > 0, lambda k: k < 0))
    pick = lambda xs: F.when(has("change_pct"), xs[0]).when(has("change"), xs[1]).otherwise(xs[2])
    share = lambda c: F.avg((F.col("price") > F.col(c)).cast("double"))
    high, low = F.sum(F.when(F.col("price") >= 0.995 * F.col("year_high"), 1).otherwise(0)), F.sum(F.when(F.col("price") <= 1.005 * F.col("year_low"), 1).otherwise(0))
    return quotes.groupBy(*by).agg((pick(up) / F.greatest(F.lit(1), pick(down))).alias("adr"), share("ma50").alias("pct50"), share("ma200").alias("pct200"), (high / F.greatest(F.lit(1), low)).alias("nh_nl"))


def panel_quotes(panel: DataFrame) -> DataFrame:
    """The last row of every symbol as a quote: move, 50- and 200-row means, 252-row high and low."""
    w = series(U, "symbol", order="d")
    over = lambda f, n: f("close").over(frame(w, n))
    d = panel.select(U, "symbol", "d", F.col("close").alias("price"), F.lag("close").over(w).alias("prev_close"), over(F.avg, 50).alias("ma50"), over(F.avg, 200).alias("ma200"), over(F.max, 252).alias("year_high"), over(F.min, 252).alias("year_low"))
    last = d.withColumn("__n", F.row_number().over(series(U, "symbol", order="d").orderBy(F.desc("d")))).filter("__n = 1").drop("__n")
    return last.withColumns({"change": F.lit(None).cast("double"), "change_pct": F.lit(None).cast("double")})


def realized_volatility(panel: DataFrame, symbol: str, n: int, population: bool = False) -> DataFrame:
    """``universe, rv``: yearly deviation of the last ``n`` log returns; needs half of them."""
    w = series(U, "symbol", order="d")
    d = panel.filter(F.col("symbol") == symbol).withColumn("r", log_return("close", w))
    d = d.withColumn("__n", F.row_number().over(w.orderBy(F.desc("d")))).filter(F.col("__n") <= n)
    sd = F.stddev_pop("r") if population else F.stddev_samp("r")
    return d.groupBy(U).agg(F.when(F.count("r") >= max(2, n // 2), sd * YEAR**0.5).alias("rv"))


def curve(rows: DataFrame) -> DataFrame:
    """Spreads and curvature of the newest of ``rows(d, month3, year2, year10, year30)``."""
    last = rows.agg(F.max_by(F.struct("month3", "year2", "year10", "year30"), "d").alias("c")).select("c.*")
    return last.select((F.col("year10") - F.col("month3")).alias("spr_10y_3m"), (F.col("year10") - F.col("year2")).alias("spr_10y_2y"), (F.col("year30") + F.col("month3") - 2 * F.col("year10")).alias("curvature"))


def clamped(features: DataFrame) -> DataFrame:
    """``features(feature, x)`` within each feature's bounds; a missing value stays missing."""
    low = reduce(lambda c, kv: c.when(F.col("feature") == kv[0], kv[1][0]), BOUNDS.items(), F.when(F.lit(False), 0.0))
    high = reduce(lambda c, kv: c.when(F.col("feature") == kv[0], kv[1][1]), BOUNDS.items(), F.when(F.lit(False), 0.0))
    x = F.col("x")
    return features.withColumn("x", F.when(x.isNull() | F.isnan(x), None).when(low.isNull(), x).otherwise(F.least(F.greatest(x, low), high)))


def preferred(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One value a feature (and ``by``): of ``left`` where it has a finite one, else of ``right``, else none."""
    keys = [*by, "feature"]
    return left.join(right.withColumnRenamed("x", "__x"), keys, "full_outer").select(*keys, F.coalesce(finite("x"), finite("__x")).alias("x"))


def fit_bayes(rows: DataFrame, eps: float = 1e-6) -> DataFrame:
    """``feature, mu_up, var_up, mu_dn, var_dn, prior_up`` from ``rows(feature, x, up)``: population moments."""
    of = lambda f, up: f(F.when(F.col("up") == up, F.col("x")))
    return rows.groupBy("feature").agg(
        of(F.avg, 1).alias("mu_up"), (of(F.var_pop, 1) + eps).alias("var_up"), of(F.avg, 0).alias("mu_dn"), (of(F.var_pop, 0) + eps).alias("var_dn"), F.avg(F.col("up").cast("double")).alias("prior_up"),
    )


def fit_platt(scored: DataFrame, steps: int = 200, rate: float = 0.1, bins: int = 100_000) -> tuple[float, float]:
    """(A, B) by gradient descent from (1, 0) on ``scored(p, y)``.

    One aggregation counts rows and outcomes of each score, rounded to a part of ``bins``; the descent over
    those bounded counts is one small task, so one row reaches the driver.
    """
    p = F.least(F.greatest("p", F.lit(1e-5)), F.lit(1 - 1e-5))
    counts = scored.select(F.round(p * bins).alias("bin"), p.alias("p"), "y").groupBy("bin").agg(F.avg("p").alias("p"), F.count("*").alias("n"), F.sum("y").alias("y"))

    def descend(pdf: pd.DataFrame) -> pd.DataFrame:
        z, n, y = np.log(pdf["p"] / (1 - pdf["p"])).to_numpy(), pdf["n"].to_numpy(), pdf["y"].to_numpy()
        a, b = 1.0, 0.0
        for _ in range(steps):
            away = n / (1 + np.exp(-np.clip(a * z + b, -60, 60))) - y
            a, b = a - rate * (away * z).sum() / n.sum(), b - rate * away.sum() / n.sum()
        return pd.DataFrame({"a": [a], "b": [b]})

    fitted = counts.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(descend, "a double, b double").first()
    return (fitted["a"], fitted["b"]) if fitted else (1.0, 0.0)


def drivers(features: DataFrame, model: DataFrame, floor: float = 1e-3) -> DataFrame:
    """``features(feature, x)`` with ``llr``; 0 for a missing value, variances not below ``floor``."""
    v = lambda c: F.greatest(F.col(c), F.lit(floor))
    llr = gaussian_log_density("x", "mu_up", v("var_up")) - gaussian_log_density("x", "mu_dn", v("var_dn"))
    return features.join(model, "feature").withColumn("llr", F.coalesce(llr, F.lit(0.0)))


def posterior(scored: DataFrame, a: float = 1.0, b: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """``p_raw`` and the calibrated ``p_up`` from all drivers."""
    prior = F.least(F.greatest(F.max("prior_up"), F.lit(1e-6)), F.lit(1 - 1e-6))
    d = scored.groupBy(*by).agg((F.sum("llr") + F.ln(prior / (1 - prior))).alias("logit")).withColumn("p_raw", sigmoid("logit"))
    return d.withColumn("p_up", platt("p_raw", F.lit(a), F.lit(b))).drop("logit")


def top_drivers(scored: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` features with the largest effect of each record, whose keys are ``by``; ties by name."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.abs("llr")), "feature")  # nine rows a record
    return scored.select(*by, "feature", "x", "llr", F.row_number().over(w).alias("rank")).filter(F.col("rank") <= k)


def interval(p: Column, mean_effect: Column) -> tuple[Column, Column]:
    """Bounds around ``p``: narrower the larger the drivers' mean effect."""
    width = F.least(F.greatest(0.16 - 0.08 * F.least(F.lit(1.0), mean_effect), F.lit(0.04)), F.lit(0.22))
    return F.greatest(p - width / 2, F.lit(0.0)), F.least(p + width / 2, F.lit(1.0))


def headline(p: Column) -> Column:
    return F.when(p >= 0.65, "Strong upside bias").when(p >= 0.55, "Mild upside bias").when(p > 0.45, "Balanced").otherwise("Downside bias")


def divergences(days: DataFrame) -> DataFrame:
    """``days(p_up, rv20, adr, spr_10y_3m)`` with ``rules``: what speaks against the probability, in a fixed order."""
    p, here = F.col("p_up"), lambda c: F.coalesce(c, F.lit(False))
    rules = (
        (here((p >= 0.60) & (F.col("rv20") > 0.35)), "upside with high short-term volatility"), (here((p <= 0.40) & (F.col("adr") > 1.8)), "downside with broad participation"),
        (here((F.col("spr_10y_3m") < 0) & (p >= 0.55)), "upside against an inverted curve"),
    )
    found = F.filter(F.array(*(F.when(when, text) for when, text in rules)), lambda r: r.isNotNull())
    return days.withColumn("rules", found)


def summary_lines(days: DataFrame, top: DataFrame, features: DataFrame, by: str = "idx") -> DataFrame:
    """``number, line`` of each day's text: headline, the three strongest drivers, macro cues, breadth."""
    named = top.filter("rank <= 3").groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature", "llr"))), lambda x: printf("%s(%+.3f)", x["feature"], x["llr"])), ", ").alias("drivers"))
    at = lambda f: F.max(F.when(F.col("feature") == f, F.col("x")))
    x = features.groupBy(by).agg(*(at(f).alias(f) for f in FEATURES))
    shown = lambda form, f, scale=1: F.when(F.col(f"`{f}`").isNotNull(), printf(form, F.col(f"`{f}`") * scale))
    cues = F.concat_ws(", ", shown("10Y-2Y=%+.2f", "SPR_10Y_2Y"), shown("10Y-3M=%+.2f", "SPR_10Y_3M"), shown("Curve=%+.2f", "CURVATURE"), shown("RV20=%.3f", "RV20"))
    parts = F.concat_ws(", ", shown("ADR=%.2f", "ADR"), shown("%%>MA50=%.2f%%", "Pct>MA50", 100), shown("%%>MA200=%.2f%%", "Pct>MA200", 100), shown("NH/NL=%.2f", "NH/NL"))
    known = lambda c, missing: F.when(c == "", missing).otherwise(c)
    d = days.join(named, by, "left").join(x, by, "left")
    lines = F.array(
        printf("- Conclusion: %s, P(up)=%.1f%%", headline(F.col("p_up")), F.col("p_up") * 100), F.concat(F.lit("- Drivers: "), F.coalesce("drivers", F.lit("none"))),
        F.concat(F.lit("- Macro: "), known(cues, "no macro cues")), F.concat(F.lit("- Breadth: "), known(parts, "unknown")),
    )
    return d.select(by, F.posexplode(lines).alias("number", "line"))


def driver_notes(top: DataFrame, days: DataFrame, by: str = "idx") -> DataFrame:
    """``rank, note``: a sentence for each driver with a value, by its kind, and one (rank 99) where probability and breadth disagree."""
    f, x, llr = F.col("feature"), F.col("x"), F.col("llr")
    high = BOUNDS["NH/NL"][1]
    note = (
        F.when((f == "NH/NL") & (x >= high), printf(f"NH/NL=%.2f is at or above the model's bound {high}: an overheated market, LLR %+.3f", x, llr))
        .when((f == "NH/NL") & (llr < 0), printf("NH/NL=%.2f: new highs fade against new lows, LLR %+.3f", x, llr)).when(f == "NH/NL", printf("NH/NL=%.2f: new highs stay strong, LLR %+.3f", x, llr))
        .when(f.isin("RV20", "RV60") & (llr < 0), printf("%s=%.3f: volatility rose, LLR %+.3f", f, x, llr)).when(f.isin("RV20", "RV60"), printf("%s=%.3f: volatility is calm, LLR %+.3f", f, x, llr))
        .when(f == "ADR", printf("ADR=%.2f: participation, LLR %+.3f", x, llr)).when(f.startswith("Pct>MA"), printf("%s=%.1f%%: share above its mean, LLR %+.3f", f, x * 100, llr)).otherwise(printf("%s=%.3f: LLR %+.3f", f, x, llr))
    )
    each = top.filter("x is not null").select(by, "rank", note.alias("note"))
    p, adr = F.col("p_up"), F.col("adr")
    odd = F.when((p < 0.4) & (adr > 1.5), printf("P(up)=%.1f%% is low though ADR=%.2f is above 1.5: participation lives", p * 100, adr)).when((p > 0.6) & (adr < 1.0), printf("P(up)=%.1f%% is high though ADR=%.2f is below 1: a narrow rise", p * 100, adr))
    return each.unionByName(days.select(by, F.lit(99).alias("rank"), odd.alias("note")).filter("note is not null"))


def features_of(breadth_row: DataFrame, rv: DataFrame, curve_row: DataFrame, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``feature, x`` in model order from breadth, both volatilities (``rv20, rv60``) and the curve: one row each a universe."""
    d = breadth_row.join(rv, list(by), "full_outer").join(curve_row, list(by), "full_outer")
    columns = ("adr", "pct50", "pct200", "nh_nl", "rv20", "rv60", "spr_10y_3m", "spr_10y_2y", "curvature")
    entries = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(f).alias("feature"), F.col(c).cast("double").alias("x")) for i, (f, c) in enumerate(zip(FEATURES, columns))))
    return d.select(*by, F.inline(entries))


def report_of(features: DataFrame, model: DataFrame, a: float = 1.0, b: float = 0.0, k: int = 5, by: tuple[str, ...] = (U,)) -> tuple[DataFrame, DataFrame]:
    """(``p_raw, p_up`` and bounds of each universe, its ``k`` strongest drivers); without a model the probability is one half."""
    filled = clamped(features).withColumn("x", F.coalesce("x", F.lit(0.0)))
    scored = drivers(filled, model)
    first = posterior(scored, a, b, by)
    effect = scored.groupBy(*by).agg(F.avg(F.abs("llr")).alias("__effect"))
    known = features.select(*by).distinct().join(first, list(by), "left").join(effect, list(by), "left").fillna({"p_raw": 0.5, "p_up": 0.5, "__effect": 0.0})
    low, high = interval(F.col("p_up"), F.col("__effect"))
    return known.select(*by, "p_raw", "p_up", low.alias("low"), high.alias("high")), top_drivers(scored, k, by)


def sectors(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``sector, change`` sorted best first by ``rank`` within each snapshot ``by``; text percentages parsed, large ones scaled.

    A snapshot has a row a sector, so its order is a small one; many snapshots are ordered apart.
    """
    x = F.regexp_replace("change", r"[%+\s]", "").try_cast("double")
    d = rows.select(*by, "sector", F.when(F.abs(x) > 5, x / 100).otherwise(x).alias("change")).filter("change is not null")
    keys = by or (F.lit(0),)
    return d.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("change"), "sector")))


def calendar(events: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` events of ``date, event, actual, forecast, impact``, each under any of its known names; ``-`` where missing."""
    names = {"date": ("date", "publishedDate"), "event": ("event", "name", "title"), "actual": ("actual",), "forecast": ("forecast", "consensus"), "impact": ("impact", "importance")}
    pick = lambda found, missing: F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in found), F.lit(missing))
    columns = {out: pick([c for c in aliases if c in events.columns], "" if out == "date" else "-") for out, aliases in names.items()}
    return events.select(*(c.alias(out) for out, c in columns.items())).orderBy("date", "event").limit(k)


def curve_rows(raw: DataFrame) -> DataFrame:
    """``d, month3, year2, year10, year30`` from a table that has them under any of their known names, in capitals or not."""
    names = {"d": ("d", "date"), "month3": ("3m", "month3", "threemonth", "m3"), "year2": ("2y", "year2", "y2", "2year"), "year10": ("10y", "year10", "y10", "10year"), "year30": ("30y", "year30", "y30", "30year")}
    have = {c.lower(): c for c in raw.columns}
    pick = lambda aliases: next((F.col(f"`{have[a]}`") for a in aliases if a in have), F.lit(None))
    return raw.select(pick(names["d"]).alias("d"), *(pick(names[c]).cast("double").alias(c) for c in list(names)[1:])).dropna()


def probability_backtest(predicted: DataFrame, horizon: int = 5, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``predicted(idx, d, close, p)`` with the realised return of ``horizon`` rows and whether the side was right."""
    w = series(*by)
    d = predicted.withColumn("future", ratio(F.lead("close", horizon).over(w), "close") - 1)
    return d.withColumn("right", F.when(F.col("future").isNotNull(), ((F.col("p") >= 0.5) & (F.col("future") > 0)) | ((F.col("p") < 0.5) & (F.col("future") <= 0))))


def model_rows(spark: SparkSession, model: dict) -> DataFrame:
    """The stored model (arrays in feature order) as one row a feature."""
    rows = list(zip(FEATURES, model["mu_up"], model["var_up"], model["mu_dn"], model["var_dn"], [model["prior_up"]] * len(FEATURES)))
    return spark.createDataFrame(rows, "feature string, mu_up double, var_up double, mu_dn double, var_dn double, prior_up double")


def accuracy(tested: DataFrame, by: tuple[str, ...] = (U,)) -> DataFrame:
    """``n, accuracy, up_share`` of ``probability_backtest``: rows with a known future only."""
    known = F.col("right").isNotNull()
    return tested.groupBy(*by).agg(F.count(F.when(known, 1)).alias("n"), F.avg(F.col("right").cast("double")).alias("accuracy"), F.avg(F.when(known, (F.col("future") > 0).cast("double"))).alias("up_share"))
