"""The quote source: retries, chunks, must-have symbols, rounds over a restart."""

import sys
import textwrap
import time

import pytest
from pyspark.sql import functions as F

from tidemark.sources.quote_stream import QuoteSource, asked

SYMBOLS = [f"S{k}" for k in range(12)]


def vendor(calls, bad=(), flaky=0, empty=False):
    """Raises for a question with a bad symbol among several, and for the first ``flaky`` questions."""

    def fetch(symbols):
        calls.append(list(symbols))
        if len(calls) <= flaky or (set(symbols) & set(bad) and len(symbols) > 1):
            raise OSError("vendor")
        return [] if empty else [{"symbol": s, "price": 10.0 + int(s[1:]), "previousClose": 9.0} for s in symbols]

    return fetch


def test_a_whole_list_is_one_question():
    calls = []
    assert set(asked(SYMBOLS, ["S3"], vendor(calls), pause=0)) == set(SYMBOLS) and calls == [SYMBOLS]
    calls = []
    assert set(asked(SYMBOLS, [], vendor(calls, flaky=1), pause=0)) == set(SYMBOLS) and calls == [SYMBOLS, SYMBOLS]


def test_chunks_and_single_symbols():
    """A bad symbol spoils the list and its chunk; if it must be had it is asked alone; the chunk's other symbols stay away."""
    calls = []
    got = asked(SYMBOLS, ["S7", "S0", "S6", "other"], vendor(calls, bad=["S7"]), pause=0)
    assert set(got) == set(SYMBOLS) - {"S5", "S8", "S9"}
    assert calls == [SYMBOLS] * 2 + [SYMBOLS[:5]] + [SYMBOLS[5:10]] * 2 + [SYMBOLS[10:]] + [["S7"], ["S6"]]
    calls = []
    assert asked(["S1", "S2"], ["S1"], vendor(calls, empty=True), pause=0) == {} and calls == [["S1", "S2"]] * 3 + [["S1"]]


def test_prices():
    rows = [{"symbol": "A", "price": 0, "previousClose": 4}, {"symbol": "B", "price": None}, {"symbol": "C", "price": "5", "previousClose": -1}, "odd", {"symbol": "D", "price": 2, "previousClose": None}]
    assert {s: r["price"] for s, r in asked(["A", "B", "C", "D", "E"], [], lambda _: rows, pause=0).items()} == {"A": 4.0, "D": 2.0}
    assert asked([], [], lambda _: rows) == {}


@pytest.fixture
def module(spark, tmp_path):
    """A vendor that fails for one symbol in company, importable on the driver and in tasks."""
    file = tmp_path / "made_vendor.py"
    file.write_text(textwrap.dedent("""
        def fetch(symbols):
            if "S7" in symbols and len(symbols) > 1:
                raise OSError("vendor")
            return [{"symbol": s, "price": 10.0 + int(s[1:]), "timestamp": 1700000000} for s in symbols]
    """))
    spark.sparkContext.addPyFile(str(file))
    sys.path.insert(0, str(tmp_path))
    yield "made_vendor:fetch"
    sys.path.remove(str(tmp_path))


def test_every_round_once_over_a_restart(spark, module, tmp_path):
    spark.dataSource.register(QuoteSource)
    options = dict(symbols=",".join(SYMBOLS), must_have="S7,S6", fetch=module, interval="1", block="8", pause="0")
    for _ in range(2):
        q = spark.readStream.format("live_quotes").options(**options).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="2 seconds").start()
        for _ in range(60):
            if sum(x["numInputRows"] for x in q.recentProgress) >= 18:
                break
            assert q.exception() is None
            time.sleep(0.5)
        q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.groupBy("round", "symbol").count().filter("count > 1").count() == 0 and out.select("round").distinct().count() >= 4
    whole = out.groupBy("round").agg(F.sort_array(F.collect_list("symbol")).alias("s")).collect()
    # S7 spoils its block of eight and its chunk of S5, S6, S7; the other block is whole.
    assert all(set(r.s) == set(SYMBOLS) - {"S5"} for r in whole)
    assert {r.price for r in out.filter("symbol = 'S7'").collect()} == {17.0}
