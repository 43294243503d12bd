"""Searches: candidates together equal each alone; the budget by count, by time and by rounds."""

import time

import pytest
from pyspark.sql import functions as F

from tidemark.config import EXECUTIONS, Execution, Flow
from tidemark.plans import flow, search
from tidemark.sources import shared
from test_units import panel

U = "universe"
PARTS = {"s1": ("2020-01-01", "2020-03-31"), "s2": ("2020-04-01", "2020-06-30"), "s3": ("2020-07-01", "2020-09-30")}


@pytest.fixture(scope="module")
def days(spark):
    return shared.settled(flow.columns(search.in_parts(panel(spark, 270, seed=4), PARTS), 10), "flow")


def rows_of(df):
    return sorted(tuple(r.asDict().items()) for r in df.collect())


@pytest.mark.parametrize("variant", ["exp", "stab"])
def test_candidates_together_equal_each_alone(spark, days, variant):
    p, e = Flow(variant), Execution("close_close")
    drawn = search.drawn_exp(2) if variant == "exp" else search.drawn_stab(2, 30)
    drawn.append(drawn[0] | {"candidate": 2})  # differs in nothing that is read
    together = search.search_flow(days, drawn, p, e)
    assert together.filter("candidate = 2").count() == 3
    for c in drawn:
        got = rows_of(together.filter(F.col("candidate") == c["candidate"]))
        assert got == rows_of(search.search_flow(days, [c], p, e))


def mean(stats):
    return search.objective_blended(stats).groupBy("candidate").agg(F.avg("objective").alias("objective"))


def test_rounds_find_the_best_of_the_full_search(spark, days):
    drawn = search.drawn_stab(8, 30)
    run = lambda block, part: search.search_flow(days.filter(search.part_of() == part), block, Flow("stab"), EXECUTIONS["compare_runner"])
    full = {r.candidate: r.objective for r in mean(search.search_flow(days, drawn, Flow("stab"), EXECUTIONS["compare_runner"])).collect()}
    whole = search.budgeted(spark, run, mean, drawn, list(PARTS), keep=1.0, block=5).collect()
    assert {r.candidate: r.objective for r in whole} == pytest.approx(full) and all(r.rounds == 3 for r in whole)
    halved = search.budgeted(spark, run, mean, drawn, list(PARTS), keep=0.5, block=5).orderBy("place").collect()
    assert [sum(r.rounds >= n for r in halved) for n in (1, 2, 3)] == [8, 4, 2]
    assert halved[0].objective == pytest.approx(max(full[r.candidate] for r in halved if r.rounds == 3))


def points(spark, slow=()):
    """Objectives ``candidate * weight`` of a part; the slow candidates keep their task for a minute."""

    def run(block, part):
        weight = {"a": 1.0, "b": -0.25, "c": 0.0}[part]

        def wait(batches):
            for b in batches:
                if set(b["candidate"]) & set(slow):
                    time.sleep(60)
                yield b

        rows = spark.createDataFrame([(c["candidate"], c["candidate"] * weight) for c in block], "candidate long, objective double")
        return rows.mapInPandas(wait, rows.schema)

    return run


def average(stats):
    return stats.groupBy("candidate").agg(F.avg("objective").alias("objective"))


def test_poorer_halves_drop_out_and_the_count_holds(spark):
    drawn = [{"candidate": i} for i in range(9)]
    got = search.budgeted(spark, points(spark), average, drawn, ["a", "b", "c"], count=8, block=3).orderBy("place").collect()
    assert [(r.candidate, r.rounds) for r in got] == [(7, 3), (6, 3), (5, 2), (4, 2), (3, 1), (2, 1), (1, 1), (0, 1)]
    assert got[0].objective == pytest.approx(7 * 0.25)


def test_ties_and_nothing_to_try(spark):
    same = search.budgeted(spark, points(spark), average, [{"candidate": i} for i in range(4)], ["c", "c"]).orderBy("place").collect()
    assert [r.candidate for r in same] == [0, 1, 2, 3] and [r.rounds for r in same] == [2, 2, 1, 1]
    assert search.budgeted(spark, points(spark), average, [], ["a"]).count() == 0


def test_blocks_beyond_the_time_are_cancelled(spark):
    began = time.monotonic()
    got = search.budgeted(spark, points(spark, slow={2, 3}), average, [{"candidate": i} for i in range(4)], ["a", "b"], seconds=12, block=2, at_once=2).orderBy("place").collect()
    assert time.monotonic() - began < 40
    assert [(r.candidate, r.rounds, r.objective) for r in got] == [(1, 1, 1.0), (0, 1, 0.0), (2, 0, None), (3, 0, None)]
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_a_failing_block_is_not_hidden(spark):
    with pytest.raises(Exception, match="no part"):
        search.budgeted(spark, lambda block, part: spark.range(1).select(F.raise_error(F.lit("no part")).cast("long").alias("candidate")), average, [{"candidate": 0}], ["a"], seconds=60).count()
