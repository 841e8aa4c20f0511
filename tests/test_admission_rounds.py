"""What the admission's rounds hold, and its slices of time."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tests.test_admission import chains, replay
from tillwise.operators import admission
from tillwise.plans.running import assign_range_chunks, chunked_running_sum, spanning_keys
from tillwise.sources import Tables

AS_OF = dt.date(2001, 8, 1)


@pytest.fixture
def stored(monkeypatch):
    """Rows of every table that the admission writes: (name, rows, undecided)."""
    seen, plain = [], admission._store

    def spy(df, root, name, by=None):
        out = plain(df, root, name, by)
        if name.startswith("rnd="):
            seen.append((name, out.count(), out.filter("state = 'U'").count()))
        return out

    monkeypatch.setattr(admission, "_store", spy)
    return seen


def test_a_round_holds_the_open_lines_only(spark, stored, monkeypatch):
    """What a round has decided is in no later round, so all rounds together
    write a few times the lines, however many rounds there are."""
    monkeypatch.setattr(admission, "REPLAY_LINES", 100)
    decided = admission.bill_fixture_batch(Tables.from_dir(spark, "/root/testdata/sf0.001"), AS_OF).count()
    assert decided == 1500 and len(stored) > 3
    for (_, _, left), (_, rows, _) in zip(stored, stored[1:]):
        assert rows == left
    assert sum(rows for _, rows, _ in stored) < 5 * stored[0][1]


@pytest.mark.parametrize("few", [400_000, 100])
def test_slices_of_time_give_the_decisions_of_one_run(spark, stored, monkeypatch, few):
    from tests.oracle_compare import duck
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(admission, "SLICE_LINES", 1000)
    monkeypatch.setattr(admission, "REPLAY_LINES", few)
    expected = replay(duck(sf))
    got = {r.order_id: (r.decision, r.reason)
           for r in admission.bill_fixture_batch(Tables.from_dir(spark, sf), AS_OF).collect()}
    assert got == expected
    assert sum(left == 0 for _, _, left in stored) > 3   # slices that were closed


def test_rounds_leave_no_table_behind(spark, tmp_path, monkeypatch):
    roots = []
    monkeypatch.setattr(admission, "scratch_path", lambda _, name: roots.append(str(tmp_path / name)) or roots[-1])
    got = chains(spark, 2, 4)
    assert [got[o].decision for o in range(8)] == ["accepted", "rejected"] * 4
    assert roots and not any((tmp_path / r).exists() for r in roots)


def test_spanning_keys_are_all_that_need_offsets(spark):
    rows = spark.range(20_000).selectExpr("if(id % 10 = 0, id % 700 + 2, 1) as k", "id as seq", "id % 13 - 6 as v")
    order = [F.col("seq")]
    tagged = assign_range_chunks(rows, "k", order, partitions=8)
    spans = spanning_keys(tagged, "k")
    several = {r.k for r in tagged.groupBy("k").agg(F.countDistinct("_rchunk").alias("n")).filter("n > 1").collect()}
    assert several and several <= {r.k for r in spans.collect()} and spans.count() <= 8
    got = chunked_running_sum(tagged, "k", F.col("_rchunk"), order, {"run": F.col("v")}, spanning=spans)
    want = rows.withColumn("run", F.sum("v").over(Window.partitionBy("k").orderBy("seq")))
    assert got.select("k", "seq", "run").exceptAll(want.select("k", "seq", "run")).count() == 0
    assert got.count() == 20_000
