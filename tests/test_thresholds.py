"""Two-threshold rules: the staircase lookup against every rule for every row."""

import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillwise.operators import billing
from tillwise.plans.thresholds import best_of, staircases, with_best

SMALL = st.integers(-3, 6)


def _plain(rules, x, y):
    held = [v for a, b, v in rules if None not in (a, b, v, x, y) and x >= a and y >= b]
    return max(held) if held else None


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(SMALL, SMALL, SMALL), min_size=1, max_size=40),
       st.lists(st.tuples(SMALL, SMALL), min_size=1, max_size=20))
def test_tree_equals_trying_every_rule(rules, rows):
    tree = staircases(*(np.array(c, dtype=np.int64) for c in zip(*rules)))
    got = best_of(tree, *(np.array(c, dtype=np.int64) for c in zip(*rows)))
    assert [None if v < 0 else int(v) + tree["low"] for v in got] == [_plain(rules, x, y) for x, y in rows]


@pytest.mark.parametrize("bound", [10, 70, 1000])
def test_column_equals_trying_every_rule(spark, bound):
    rng = np.random.default_rng(3)
    rules = [tuple(int(v) for v in rng.integers(0, 60, 3)) for _ in range(200)] + [(None, 1, 99), (1, None, 99), (0, 0, None)]
    rows = [(i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(-2, 62, (300, 2)))] + [(900, None, 5), (901, 5, None)]
    df = spark.createDataFrame(rows, "id long, x long, y long")
    r = spark.createDataFrame(rules, "a long, b long, value long")
    out = with_best(df, F.col("x"), F.col("y"), r, bound, "best")
    assert out.columns == ["id", "x", "y", "best"]
    assert {o.id: o.best for o in out.collect()} == {i: _plain(rules, x, y) for i, x, y in rows}


def test_no_rules_give_null(spark):
    df = spark.createDataFrame([(1, 2, 3)], "id long, x long, y long")
    r = spark.createDataFrame([], "a long, b long, value long")
    assert with_best(df, F.col("x"), F.col("y"), r, 10, "best").first().best is None


def test_many_rules_make_no_rows(spark, tables_small):
    """100,000 rules, none of them dominated: one row an order and no join of orders with rules."""
    n = 100_000
    rules = spark.range(n).select(
        F.lit(1).alias("rule_id"), F.lit("r").alias("rule_name"), (F.col("id") % 1000).cast("int").alias("min_qty"),
        (F.col("id") * 5).cast("decimal(12,2)").alias("min_amount"),
        (F.col("id") / n * 90).cast("decimal(5,2)").alias("discount_pct"), F.lit(True).alias("is_active"),
        F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    from tillwise.sources import Tables
    t = Tables.from_frames(spark, tables_small.root, discount_rules=rules)
    out = billing.discount_for_order(t, dt.date(2001, 8, 1), max_rules=n)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {r.order_id: (r.units, r.subtotal, r.discount_pct) for r in out.collect()}
    assert len(got) == out.count() == tables_small.sales_orders.count()
    local = [(r.min_qty, r.min_amount, r.discount_pct) for r in rules.collect()]
    qty = np.array([r[0] for r in local])
    amount = np.array([float(r[1]) for r in local])
    pct = np.array([float(r[2]) for r in local])
    for units, subtotal, found in list(got.values())[::10]:
        held = pct[(qty <= units) & (amount <= float(subtotal))]
        assert float(found) == (held.max() if len(held) else 0.0)
