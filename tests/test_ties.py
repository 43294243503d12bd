"""Rows that an order leaves equal."""

import pandas as pd

from tidemark import queries


def test_vendor_rows_of_one_number_take_the_first_of_the_file(spark, tmp_path):
    """The second file is larger, so Spark reads it first; a missing value never wins."""
    d = pd.Timestamp("1998-01-01")
    row = lambda key, n, o, q: (key, d, float(o), float(q), 0.0, 0.05, n)
    names = ["l_orderkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_linenumber"]
    files = [[row(1, 5, 10, 1), row(1, 5, 20, 2), row(2, 1, 30, 3), row(3, 3, 31, 4)], [row(1, 5, 40, 5), row(2, 1, 50, 6), row(2, 2, 60, 7), row(3, 3, 70, 8)] + [row(9 + k, 1, k, 9) for k in range(5000)]]
    (tmp_path / "lineitem.parquet").mkdir()
    for k, rows in enumerate(files):
        pd.DataFrame(rows, columns=names).to_parquet(tmp_path / "lineitem.parquet" / f"{k}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
    got = queries.QUERIES["s03_vendor_bars"](spark, str(tmp_path)).filter("symbol in ('1', '2', '3')").orderBy("symbol").collect()
    assert [(r["symbol"], r["open"], r["close"]) for r in got] == [("1", 10.0, 1.0), ("2", 60.0, 7.0), ("3", 31.0, 0.05)]
