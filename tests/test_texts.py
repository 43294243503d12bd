"""Numbers in texts are rounded by their exact value, as Python and the queries' SQL do."""

import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import report_queries  # noqa: F401  (registers its queries)
from tidemark.functions import text as TX

from test_oracle import SF, plain, queries


def test_decimals_round_by_the_exact_value(spark):
    rng = random.Random(3)
    known = [0.2485, 0.125, 0.375, 0.0625, -0.0625, 2.5, 0.5, -0.001, 0.0, -0.0, 1e-9, 999.995, 1.005, 0.9995, 123456789.125, 1e15]
    known += [i / 10_000 for i in range(0, 30_000, 5)] + [rng.uniform(-9, 9) for _ in range(3000)] + [rng.randrange(-4000, 4000) / 2 ** rng.randrange(12) for _ in range(3000)]
    d = spark.createDataFrame([(x,) for x in known], "x double")
    forms = {(n, s): TX.decimals("x", n, s).alias(f"c{n}{s}") for n in (0, 1, 2, 3, 4, 8) for s in (False, True)}
    for r in d.select("x", *forms.values()).collect():
        for n, s in forms:
            assert r[f"c{n}{s}"] == f"{r['x']:{'+' * s}.{n}f}", (r["x"], n, s)


def test_texts_of_numbers(spark):
    d = spark.createDataFrame([(0.2485, "a"), (None, "b")], "x double, s string")
    got = d.select(TX.fixed("x", 3), TX.signed("x", 3), TX.percent("x", 1), TX.signed_percent("x", 1), TX.percent_points("x"), TX.printf("%s %d%% %+.3f of %.1f%%", "s", F.lit(7), F.coalesce("x", F.lit(1.0)), F.lit(0.25))).collect()
    assert tuple(got[0]) == ("0.248", "+0.248", "24.9%", "+24.9%", "0.25%", "a 7% +0.248 of 0.2%")
    assert tuple(got[1]) == ("N/A",) * 5 + ("b 7% +1.000 of 0.2%",)


@pytest.mark.parametrize("key", ["q10_scored_lines", "q10_transition_lines"])
def test_lines_equal_sql_where_a_score_is_next_to_a_tie(spark, key):
    """On tables of scale 0.1, where three of the ten scores are 0.2485."""
    sf = SF.replace("0.001", "0.1")
    if not Path(sf).exists():
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    assert plain(queries.QUERIES[key](spark, sf).toPandas()) == plain(con.execute(queries.ORACLE_SQL[key]).fetchdf())
