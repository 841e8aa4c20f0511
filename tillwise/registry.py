"""Registered queries: each key binds an operator to its fixture parameters.

The parameters (``AS_OF`` and friends) are the fixture values documented in
FIXTURES.md; operators themselves take them as explicit arguments.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise import oracle as O
from tillwise.operators import admission, billing, carry, catalog, changes, ledger, quality, sales
from tillwise.plans.lineage import cut_lineage, deal_out, drop_tables
from tillwise.session import checkpoint_root, remove_path, scratch_path
from tillwise.sources import derived as D
from tillwise.sources import sinks
from tillwise.sources.tables import Tables
from tillwise.streaming import reports as ST

# --- fixed values: fixture parameters ---------------------------------------
AS_OF = dt.date(2001, 8, 1)
DAY_AS_OF = dt.date(2001, 7, 31)
#: Orders from this time on are the second batch of the carried checkout.
SECOND_BATCH = dt.datetime(1998, 7, 1)

def _first_customer(t: Tables) -> int:
    """The customer whose orders the point query lists."""
    return t.sales_orders.agg(F.min("customer_id")).first()[0]


def _first_product(t: Tables) -> int:
    return t.product_base.agg(F.min("product_id")).first()[0]


def _last_order(t: Tables) -> int:
    """The newest order number that has lines."""
    return t.order_items.agg(F.max("order_id")).first()[0]


def _nested_receipts(t: Tables) -> DataFrame:
    # the nested lines as text, which every engine compares alike
    fields = ["line_no", "product_id", "product_name", "qty_sold", "unit_price", "line_total"]
    text = F.transform("lines", lambda x: F.concat_ws("|", *[x[f].cast("string") for f in fields]))
    return (sales.nested_receipts(t).withColumn("n_lines", F.size("lines").cast("bigint"))
            .withColumn("lines", F.array_join(text, ";")))


def _stored_carried(t: Tables) -> str:
    """The store that belongs to the present version of the tables' files:
    what it has published already is not decided again."""
    return _carried_store(t, os.path.join(checkpoint_root(t.spark), "tillwise", "carried",
                                          f"{t.version(admission.BATCH_TABLES)}-{AS_OF}"))


def _carried_store(t: Tables, base: str) -> str:
    """The tables' orders, decided in two batches along their time, at ``base``."""
    if len(sinks.published_versions(t.spark, base)) == 2:
        return base
    heads, scratch, tables = D.cart_headers(t), scratch_path(t.spark, "carried-lines"), []
    try:
        lines = deal_out(D.cart_lines(t), os.path.join(scratch, "all"), ["order_id"], tables)
        restocks = cut_lineage(billing.accepted_restocks(t, AS_OF))
        for batch, late in enumerate([False, True]):
            def part(df: DataFrame, time: str) -> DataFrame:
                from_then = F.coalesce(F.col(time) >= F.lit(SECOND_BATCH).cast("timestamp_ntz"), F.lit(False))
                return df.filter(from_then == F.lit(late))
            orders = part(heads, "order_date")
            own = deal_out(lines.join(orders.select("order_id"), "order_id", "left_semi"),
                           os.path.join(scratch, str(batch)), ["order_id"], tables)
            carry.commit_batch(t, base, batch, own, orders, D.opening_stock(t), part(restocks, "request_ts"))
    finally:
        drop_tables(t.spark, tables)
        remove_path(t.spark, scratch)
    return base


def _alert_reads(t: Tables) -> DataFrame:
    # the read events come from the same alerts: compute the alerts once
    alerts = cut_lineage(ledger.all_alerts(t, AS_OF))
    return ledger.apply_alert_reads(t, AS_OF, ledger.manager_reads(t, AS_OF, alerts), alerts)


QUERIES = {
    # J-2 / A-5: the flagship star join
    "revenue_by_category": (lambda t: sales.revenue_by_category(t), O.revenue_by_category),
    # 2.1 / 2.2 catalog, search, users
    "list_categories": (catalog.list_categories, O.list_categories),
    "product_catalog": (lambda t: catalog.product_catalog(t, AS_OF), O.product_catalog),
    "products_by_category": (lambda t: catalog.product_catalog(t, AS_OF, category=3),
                             O.products_by_category),
    "search_products": (lambda t: catalog.product_catalog(t, AS_OF, search="RED"), O.search_products),
    "search_products_barcode": (lambda t: catalog.product_catalog(t, AS_OF, search="0001"),
                                O.search_products_barcode),
    "sellable_products": (lambda t: catalog.sellable_products(t, AS_OF), O.sellable_products),
    "low_stock_products": (lambda t: catalog.low_stock_products(t, AS_OF), O.low_stock_products),
    "expiring_products": (lambda t: catalog.expiring_products(t, AS_OF), O.expiring_products),
    "expiry_alerts": (lambda t: catalog.expiry_alerts(t, AS_OF, n=10), O.expiry_alerts),
    "expiry_alerts_all": (lambda t: catalog.expiry_alerts(t, AS_OF), O.expiry_alerts_all),
    "product_by_id": (lambda t: catalog.product_by_id(t, t.order_items), O.product_by_id),
    "stock_status": (catalog.stock_status, O.stock_status),
    "expiry_status": (lambda t: catalog.expiry_status(t, AS_OF), O.expiry_status),
    "list_users": (lambda t: catalog.users_by_role(t), O.list_users),
    "users_by_role": (lambda t: catalog.users_by_role(t, "customer"), O.users_by_role),
    "search_customers": (lambda t: catalog.search_customers(t, "00001"), O.search_customers),
    "scalar_functions": (lambda t: catalog.scalar_functions(t, AS_OF), O.scalar_functions),
    # 2.4 / 2.6 sales aggregates and top-k
    "category_report": (lambda t: sales.category_report(t, dt.date(2000, 1, 1), dt.date(2000, 12, 31)),
                        O.category_report),
    "category_revenue_month": (lambda t: sales.category_revenue_month(t, AS_OF), O.category_revenue_month),
    "product_sales_summary": (sales.product_sales_summary, O.product_sales_summary),
    "highest_ticket_items": (sales.highest_ticket_items, O.highest_ticket_items),
    "top_ticket_items": (lambda t: sales.top_ticket_items(t, 5), O.top_ticket_items),
    "top_products_ranked": (lambda t: sales.top_products_ranked(t, 5), O.top_products_ranked),
    "daily_summary": (lambda t: sales.daily_summary(t, DAY_AS_OF), O.daily_summary),
    "monthly_sales": (lambda t: sales.monthly_sales(t, AS_OF), O.monthly_sales),
    "monthly_sales_scaled": (lambda t: sales.monthly_sales_scaled(t, AS_OF), O.monthly_sales_scaled),
    "customer_summary": (sales.customer_summary, O.customer_summary),
    "customer_history": (sales.customer_history, O.customer_history),
    "orders_list": (lambda t: sales.orders_list(t, n=100), O.orders_list),
    "customer_orders": (lambda t: sales.orders_list(t, customer_id=_first_customer(t)), O.customer_orders),
    "recent_orders": (lambda t: sales.recent_orders(t, 5), O.recent_orders),
    "receipts": (lambda t: sales.receipts(t), O.receipts),
    "receipts_nested": (_nested_receipts, O.receipts_nested),
    # point reads by key
    "product_point": (lambda t: catalog.product_by_id(t, _first_product(t)), O.product_point),
    "receipt_point": (lambda t: sales.receipts(t, _last_order(t)), O.receipt_point),
    "clearance_candidates": (lambda t: sales.clearance_candidates(t, AS_OF), O.clearance_candidates),
    # 2.9 billing
    # JSON carts are stored input in practice: write the derived ones once
    "parse_carts": (lambda t: billing.parse_carts(cut_lineage(D.cart_json(t))), O.parse_carts),
    "price_carts": (lambda t: billing.price_carts(t, D.cart_demand(t), D.cart_headers(t)), O.price_carts),
    "validate_carts": (lambda t: billing.validate_carts(t, D.cart_demand(t), D.cart_headers(t), AS_OF),
                       O.validate_carts),
    "discount_for_order": (lambda t: billing.discount_for_order(t, AS_OF), O.discount_for_order),
    "apply_restocks": (lambda t: billing.apply_restocks(t, D.restock_requests(t, AS_OF)), O.apply_restocks),
    # ledger, windows, alerts
    "stock_ledger": (lambda t: ledger.stock_ledger(t, AS_OF), O.stock_ledger),
    "running_stock": (lambda t: ledger.running_stock(t, AS_OF), O.running_stock),
    "low_stock_alerts": (lambda t: ledger.low_stock_alerts(t, AS_OF), O.low_stock_alerts),
    "expiry_warnings": (lambda t: ledger.expiry_warnings(t, AS_OF), O.expiry_warnings),
    "all_alerts": (lambda t: ledger.all_alerts(t, AS_OF), O.all_alerts),
    "alert_severity": (lambda t: ledger.alert_severity(t, AS_OF), O.alert_severity),
    "alerts_feed": (lambda t: ledger.alerts_feed(t, AS_OF, 50), O.alerts_feed),
    "unread_alerts": (lambda t: ledger.unread_alerts(t, AS_OF, 20), O.unread_alerts),
    "apply_alert_reads": (lambda t: _alert_reads(t), O.apply_alert_reads),
    "stock_log_feed": (lambda t: ledger.stock_log_feed(t, AS_OF, n=100), O.stock_log_feed),
    "stock_log_product": (lambda t: ledger.stock_log_feed(t, AS_OF, product_id=_first_product(t), n=100),
                          O.stock_log_product),
    "ledger_reconcile": (lambda t: ledger.ledger_reconcile(t, AS_OF), O.ledger_reconcile),
    "blocked_lines": (lambda t: ledger.blocked_lines(t, AS_OF), O.blocked_lines),
    # change feeds, insert-if-absent, data quality
    "apply_product_changes": (lambda t: changes.apply_product_changes(t, D.product_changes(t, AS_OF)),
                              O.apply_product_changes),
    "created_ledger": (lambda t: ledger.created_ledger(t, D.product_changes(t, AS_OF)), O.created_ledger),
    "created_expiry_warnings": (lambda t: ledger.created_expiry_warnings(t, D.product_changes(t, AS_OF)),
                                O.created_expiry_warnings),
    "register_customers": (lambda t: changes.register_customers(t, D.registration_requests(t)),
                           O.register_customers),
    "insert_ignore": (changes.insert_categories, O.insert_ignore),
    "data_quality": (lambda t: quality.data_quality(t, AS_OF), O.data_quality),
    # B-3 / B-4: the checkout of the whole batch and its outputs (oracle: one order at a time)
    "bill_batch": (lambda t: admission.bill_fixture_batch(t, AS_OF).drop("decided_round"), O.bill_batch),
    "admitted_ledger": (lambda t: admission.bill_batch_outputs(t, AS_OF)["ledger"], O.stock_ledger),
    "admitted_orders": (lambda t: admission.admitted_orders(t, AS_OF), O.admitted_orders),
    "admitted_items": (lambda t: admission.admitted_items(t, AS_OF), O.admitted_items),
    "rejected_carts": (lambda t: admission.rejected_carts(t, AS_OF), O.rejected_carts),
    "product_stock": (lambda t: admission.product_stock(t, AS_OF), O.product_stock),
    # B-3 in two batches, the second against the stock that the first left
    "bill_batches_carried": (lambda t: carry.all_decisions(t.spark, _carried_store(
        t, scratch_path(t.spark, "carried"))).drop("decided_round", "batch"), O.bill_batch),
    "carried_stock": (lambda t: carry.stock_on_hand(t.spark, _stored_carried(t)), O.carried_stock),
    # 2.11 streaming re-aims (stream result == batch result)
    "stream_daily_sales": (ST.stream_daily_sales, O.stream_daily_sales),
    "stream_daily_rows": (ST.stream_daily_rows, O.stream_daily_rows),
    "stream_daily_counts": (ST.stream_daily_counts, O.stream_daily_counts),
    "stream_low_stock": (lambda t: ST.stream_low_stock(t, AS_OF), O.stream_low_stock),
    "stream_category_revenue": (ST.stream_category_revenue, O.stream_category_revenue),
    "stream_event_purchases": (ST.stream_event_purchases, O.stream_event_purchases),
}


def run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return QUERIES[name][0](Tables.from_dir(spark, sf_dir))


def oracle() -> dict[str, str]:
    return {name: o() for name, (_, o) in QUERIES.items() if o is not None}
