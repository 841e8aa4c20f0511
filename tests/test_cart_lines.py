"""Cart positions: one shuffle for small orders, chunks for large ones."""

import pytest

from tillwise.sources import Tables, derived

ITEMS = "order_id long, product_id long, line_no int, qty_sold int"


@pytest.mark.parametrize("piece", [2, 1000])
def test_positions_of_small_and_large_orders(spark, monkeypatch, piece):
    """Numbered whole, or by chunks where an order has more than ``piece`` lines."""
    monkeypatch.setattr(derived, "CART_PIECE", piece)
    rows = [(1, 5000, 1, 2), (1, 3, 1, 1), (1, 9, 2, 4), (1, 3, 3, 1), (2, 7, 4, 1), (2, 8, 2, 1), (None, 1, 1, 1)]
    t = Tables.from_frames(spark, order_items=spark.createDataFrame(rows, ITEMS))
    got = sorted((r.order_id, r.pos, r.product_id, r.qty, r.first_line) for r in derived.cart_lines(t).collect())
    assert got == [(1, 0, 3, 2, 1), (1, 1, 5000, 2, 1), (1, 2, 9, 4, 2), (2, 0, 8, 1, 2), (2, 1, 7, 1, 4)]


def test_lines_of_small_orders_are_shuffled_once(spark):
    t = Tables.from_frames(spark, order_items=spark.createDataFrame([(1, 2, 1, 1)], ITEMS))
    plan = derived.cart_lines(t)._jdf.queryExecution().optimizedPlan()
    numbered = plan.children().apply(0)   # the small orders' half of the union
    text = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(
        spark._jsparkSession, numbered).queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1, text
