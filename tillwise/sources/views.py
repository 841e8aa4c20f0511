"""Register the retail tables and report views for SQL users.

Each view is the DataFrame operator itself, so ``spark.sql`` over a view
gets the same plan (and pushdown) as the Python call.
"""

from __future__ import annotations

import datetime as dt

from tillwise.operators import billing, catalog, ledger, sales
from tillwise.sources.tables import Tables


def register_views(t: Tables, as_of: dt.date, day: dt.date | None = None) -> list[str]:
    views = {
        "category": t.category,
        "product": t.product,
        "app_user": t.app_user,
        "order_items": t.order_items,
        "sales_orders": t.sales_orders,
        "discount_rules": t.discount_rules,
        "vw_cashier_products": catalog.sellable_products(t, as_of),
        "vw_product_sales_summary": sales.product_sales_summary(t),
        "vw_expiry_alerts": catalog.expiry_alerts(t, as_of),
        "vw_daily_summary": sales.daily_summary(t, day or as_of),
        "vw_highest_ticket_items": sales.highest_ticket_items(t),
        "vw_customer_history": sales.customer_history(t),
        "stock_log": ledger.stock_ledger(t, as_of),
        "notification": ledger.all_alerts(t, as_of),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)


def register_functions(t: Tables, as_of: dt.date) -> list[str]:
    """Temporary SQL functions over the registered tables:
    ``category_report(from_day, to_day)``, a table of units and revenue per
    category, and ``best_discount(qty, amount)``, the largest rate in percent
    of the rules that hold on ``as_of``, 0 if none does."""
    spark = t.spark
    for name in ("category", "product", "order_items", "sales_orders"):
        getattr(t, name).createOrReplaceTempView(name)
    billing.applicable_rules(t, as_of).createOrReplaceTempView("applicable_rules")
    spark.sql("""
CREATE OR REPLACE TEMPORARY FUNCTION category_report(from_day DATE, to_day DATE)
RETURNS TABLE (category_name STRING, units_sold BIGINT, revenue DECIMAL(22,2))
RETURN
  SELECT c.category_name, CAST(sum(s.units) AS BIGINT), CAST(sum(s.revenue) AS DECIMAL(22,2))
  FROM (SELECT i.product_id, sum(i.qty_sold) AS units, sum(i.line_total) AS revenue
        FROM order_items i JOIN sales_orders o ON i.order_id = o.order_id
        WHERE o.status = 'completed' AND o.order_date >= from_day AND o.order_date < date_add(to_day, 1)
        GROUP BY i.product_id) s
  JOIN product p ON s.product_id = p.product_id JOIN category c ON p.category_id = c.category_id
  GROUP BY c.category_name""")
    spark.sql("""
CREATE OR REPLACE TEMPORARY FUNCTION best_discount(qty BIGINT, amount DECIMAL(12,2))
RETURNS DECIMAL(5,2)
RETURN (SELECT coalesce(max(discount_pct), 0) FROM applicable_rules WHERE qty >= min_qty AND amount >= min_amount)""")
    return ["category_report", "best_discount"]
