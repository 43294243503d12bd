"""Formatters: numbers, dates and table lines as strings."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import C, col, label_state

#: Splits a double into two parts of 26 bits, whose products with small integers are exact.
SPLIT = 2.0**27 + 1


def decimals(c: C, digits: int, sign: bool = False) -> Column:
    """A number with ``digits`` decimals (8 at most), rounded by its exact value, ties to even, as ``printf`` does; NULL stays NULL.

    ``format_string`` rounds the shortest decimal that names the double instead: 0.2485, a little below it, would be 0.249.
    """
    x, scale = col(c).cast("double"), 10**digits
    a = F.abs(x)
    scaled = a * float(scale)
    high = a * SPLIT - (a * SPLIT - a)
    lost = (high * float(scale) - scaled) + (a - high) * float(scale)  # scaled + lost is a * scale exactly
    whole = F.floor(scaled)
    over = scaled - whole.cast("double") - 0.5
    n = whole + ((over > -lost) | ((over == -lost) & (whole % 2 == 1))).cast("long")
    minus = F.when(x.cast("string").startswith("-"), "-").otherwise("+" if sign else "")
    rest = n % scale
    text = F.concat(minus, ((n - rest) / scale).cast("long").cast("string"), *((F.lit("."), F.lpad(rest.cast("string"), digits, "0")) if digits else ()))
    return F.when(scaled < 2.0**53, text).when(x.isNotNull(), F.format_string(f"%{'+' * sign}.{digits}f", x))


def printf(form: str, *columns: C) -> Column:
    """``format_string`` whose ``%.2f`` and ``%+.2f`` are ``decimals``."""
    specs = [x for x in re.findall(r"%(?:(\+?)\.(\d+)f|([sd%]))", form) if x[2] != "%"]
    cells = [col(c) if kind else decimals(c, int(digits), bool(sign)) for (sign, digits, kind), c in zip(specs, columns, strict=True)]
    return F.format_string(re.sub(r"%\+?\.\d+f", "%s", form), *cells)


def fixed(c: C, digits: int = 4, missing: str = "N/A") -> Column:
    return F.coalesce(decimals(c, digits), F.lit(missing))


def or_missing(text: Column, c: C, missing: str = "N/A") -> Column:
    return F.when(col(c).isNull(), missing).otherwise(text)


def signed(c: C, digits: int = 2) -> Column:
    return or_missing(decimals(c, digits, True), c)


def percent(c: C, digits: int = 2) -> Column:
    return percent_points(col(c) * 100, digits)


def percent_points(c: C, digits: int = 2) -> Column:
    """``percent`` of a number that is in percent already."""
    return or_missing(F.concat(decimals(c, digits), F.lit("%")), c)


def signed_percent(c: C, digits: int = 2) -> Column:
    return or_missing(F.concat(decimals(col(c) * 100, digits, True), F.lit("%")), c)


def month_day(d: C) -> Column:
    return F.date_format(col(d), "MM/dd")


def state_text(state: C, fragile: C | None = None) -> Column:
    text = label_state(state)
    return text if fragile is None else F.concat(text, F.when(F.coalesce(col(fragile), F.lit(False)), " (fragile)").otherwise(""))


def tsv(*columns: C) -> Column:
    return F.concat_ws("\t", *(F.coalesce(col(c).cast("string"), F.lit("N/A")) for c in columns))


def markdown_row(*columns: C) -> Column:
    cells = F.concat_ws(" | ", *(F.coalesce(col(c).cast("string"), F.lit("N/A")) for c in columns))
    return F.concat(F.lit("| "), cells, F.lit(" |"))
