"""Change-feed, registration and join-helper semantics on inline rows."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillwise.operators import changes
from tillwise.plans.broadcast import BroadcastBoundExceeded, bounded_broadcast
from tillwise.plans.lookup import lookup_join
from tillwise.sources import Tables

PRODUCT_SCHEMA = ("product_id long, barcode string, name string, price decimal(12,2), stock_qty int, "
                  "reorder_level int, expiry_date date, warning_label string, category_id long, "
                  "is_active boolean")
CHANGE_SCHEMA = ("product_id long, version int, changed_at timestamp_ntz, name string, price decimal(12,2), "
                 "reorder_level int, expiry_date date, warning_label string, category_id long, "
                 "barcode string, is_active boolean")
USER_SCHEMA = "user_id long, username string, role string, full_name string, phone_no string, is_active boolean"
TS = dt.datetime(2001, 8, 1, 9)


def test_change_feed_keeps_unset_fields_and_inserts_with_defaults(spark):
    prod = spark.createDataFrame(
        [(1, "b1", "milk", Decimal("2.00"), 5, 3, None, "cold", 1, True),
         (2, "b2", "tea", Decimal("4.00"), 9, 10, None, None, 1, True)], PRODUCT_SCHEMA)
    feed = spark.createDataFrame([
        (1, 1, TS, None, Decimal("2.50"), None, None, None, None, None, None),
        (1, 2, TS + dt.timedelta(hours=1), None, None, None, None, None, None, None, False),
        (1, 3, TS + dt.timedelta(hours=2), "whole milk", None, None, None, None, None, None, None),
        (9, 1, TS, "new", Decimal("1.00"), None, None, None, 1, None, None),
    ], CHANGE_SCHEMA)
    t = Tables.from_frames(spark, product=prod)
    got = {r.product_id: r for r in changes.apply_product_changes(t, feed).collect()}
    p1 = got[1]
    assert (p1.name, p1.price, p1.is_active, p1.reorder_level, p1.warning_label, p1.stock_qty) == \
        ("whole milk", Decimal("2.50"), False, 3, "cold", 5)
    assert p1.change == "update" and p1.updated_at == TS + dt.timedelta(hours=2)
    assert got[2].change == "none" and got[2].price == Decimal("4.00")
    new = got[9]
    assert (new.change, new.stock_qty, new.reorder_level, new.is_active) == ("insert", 0, 10, True)


def test_registration_order_and_case_insensitive_usernames(spark):
    users = spark.createDataFrame([(1, "Ann", "customer", "Ann A", None, True)], USER_SCHEMA)
    t = Tables.from_frames(spark, app_user=users)
    req = spark.createDataFrame([
        (1, " ann ", "Ann B", None),          # taken by an existing user (case/space-insensitive)
        (2, "bob", "Bob", "12345"),           # bad phone: refused, does not claim 'bob'
        (3, "BOB", "Bob", "9876543210"),      # first valid 'bob' -> accepted
        (4, "bob", "Bob 2", None),            # taken by request 3
        (5, "", "Nobody", None),              # missing input
    ], "request_id long, username string, full_name string, phone_no string")
    got = {r.request_id: (r.status, r.reason) for r in changes.register_customers(t, req).collect()}
    assert got == {1: ("rejected", "username_taken"), 2: ("rejected", "bad_phone"),
                   3: ("accepted", None), 4: ("rejected", "username_taken"),
                   5: ("rejected", "missing_input")}


def test_bounded_broadcast_refuses_past_the_bound(spark):
    df = spark.range(10)
    assert bounded_broadcast(df, 10).count() == 10
    with pytest.raises(BroadcastBoundExceeded):
        bounded_broadcast(df, 9)


@pytest.mark.parametrize("bound", [1_000, 1])
def test_lookup_join_same_rows_with_and_without_broadcast(spark, bound):
    fact = spark.range(100).select(F.col("id").alias("order_id"), (F.col("id") % 3 - 3).alias("cashier_id"))
    dim = spark.range(-5, 50).select(F.col("id").alias("user_id"),
                                     F.concat(F.lit("u"), F.col("id").cast("string")).alias("name"))
    out = lookup_join(fact, "cashier_id", dim, "user_id", ["name"], max_rows=bound)
    rows = {(r.order_id, r.name) for r in out.collect()}
    assert len(rows) == 100 and (4, "u-2") in rows


def test_discount_rules_past_the_bound_use_sliced_passes(spark, tables_small):
    from tillwise.operators import billing
    as_of = dt.date(2001, 8, 1)
    one = {r.order_id: r.discount_pct for r in billing.discount_for_order(tables_small, as_of).collect()}
    sliced = {r.order_id: r.discount_pct
              for r in billing.discount_for_order(tables_small, as_of, max_rules=1).collect()}
    assert one == sliced and len(one) == 1500
    assert {Decimal("0.00"), Decimal("5.00"), Decimal("10.00"), Decimal("15.00")} >= set(one.values())


def test_scale_conf_sizes_partitions_in_core_waves():
    from tillwise.session import scale_conf
    c = scale_conf(100 * 10**12, 8000)
    n = int(c["spark.sql.shuffle.partitions"])
    assert n % 8000 == 0 and 150_000 <= n <= 250_000
    assert int(scale_conf(1, 8)["spark.sql.shuffle.partitions"]) == 8


def test_orphan_check_counts_rows_not_keys(spark):
    from tillwise.operators.quality import _orphans
    child = spark.createDataFrame([(1,), (2,), (2,), (3,), (None,)], "k long")
    parent = spark.createDataFrame([(1,)], "id long")
    row = _orphans("DQ-6", "x", child, "k", parent, "id").first()
    assert row.violations == 3   # two rows with key 2, one with key 3; NULL is not an orphan
    none = _orphans("DQ-6", "x", child.filter("k = 1"), "k", parent, "id").first()
    assert none.violations == 0


def test_grouped_orphan_checks_share_one_parent_pass(spark):
    from tillwise.operators.quality import _orphans_by_parent
    parent = spark.createDataFrame([(1,), (2,)], "id long")
    a = spark.createDataFrame([(1,), (3,), (3,)], "k long")
    b = spark.createDataFrame([(2,), (None,)], "k long")
    rows = {r.check_name: r.violations
            for r in _orphans_by_parent("DQ-6", [("a", a, "k"), ("b", b, "k")], parent, "id").collect()}
    assert rows == {"a": 2, "b": 0}


def test_added_products_keep_their_stock_and_get_ledger_rows_and_warnings(spark):
    from tillwise.operators import ledger
    prod = spark.createDataFrame([(1, "b1", "milk", Decimal("2.00"), 5, 3, None, "cold", 1, True)], PRODUCT_SCHEMA)
    new, soon = (1, TS, "n"), dt.date(2001, 8, 20)
    feed = spark.createDataFrame([
        (1, 1, TS, None, None, None, None, None, None, None, None, 77),          # known: its stock stays
        (9, *new, Decimal("1.00"), None, soon, None, 1, None, None, 40),
        (9, 2, TS + dt.timedelta(hours=1), "m", None, None, None, None, None, None, None, 99),  # an update sets no stock
        (10, *new, Decimal("1.00"), None, dt.date(2001, 9, 1), None, 1, None, None, None),
        (11, *new, Decimal("1.00"), None, None, None, 1, None, None, 3),
    ], CHANGE_SCHEMA + ", stock_qty int")
    t = Tables.from_frames(spark, product=prod)
    got = {r.product_id: (r.change, r.stock_qty, r.name) for r in changes.apply_product_changes(t, feed).collect()}
    assert got == {1: ("update", 5, "milk"), 9: ("insert", 40, "m"), 10: ("insert", 0, "n"), 11: ("insert", 3, "n")}
    rows = ledger.created_ledger(t, feed)
    assert rows.columns == ledger.LEDGER_COLS
    assert sorted((r.product_id, r.change_qty, r.reason, r.notes, r.kind, r.log_time) for r in rows.collect()) == [
        (i, q, "restock", "Initial stock on product creation", 0, TS) for i, q in ((9, 40), (10, 0), (11, 3))]
    warned = [(r.product_id, r.message, r.created_at) for r in ledger.created_expiry_warnings(t, feed).collect()]
    assert warned == [(9, 'Expiry warning: "n" expires on 2001-08-20 (19 days)', TS)]
    # a feed without stock: 0, and the ledger says so
    plain = feed.drop("stock_qty")
    assert {r.change_qty for r in ledger.created_ledger(t, plain).collect()} == {0}
