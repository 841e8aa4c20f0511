"""Signed stock ledger, running stock, alerts and reconciliation.

The ledger is one stream per product fed by three writers (initial stock,
restocks, sales).  Its order within a product is
``(log_time, kind, reference_id, line_no, change_qty)`` with kind 0 =
initial, 1 = restock, 2 = sale.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions import scalar as S
from tillwise.operators import admission, billing, changes
from tillwise.plans.broadcast import met_by_shuffle
from tillwise.plans.lineage import cut_lineage
from tillwise.plans.lookup import lookup_join
from tillwise.plans.running import assign_range_chunks, chunked_running_sum, hot_keys, mark_cold
from tillwise.sources import derived as D
from tillwise.sources.tables import Tables, ntz

LEDGER_ORDER = ["log_time", "kind", "reference_id", "line_no", "change_qty"]
LEDGER_COLS = ["product_id", "change_qty", "reason", "reference_id", "performed_by",
               "log_time", "notes", "kind", "line_no"]


def _ledger_rows(df, change, reason, ref, by, ts, notes, kind, line) -> DataFrame:
    return df.select(
        F.col("product_id"), change.cast("int").alias("change_qty"), F.lit(reason).alias("reason"),
        ref.cast("bigint").alias("reference_id"), by.cast("bigint").alias("performed_by"),
        ts.alias("log_time"), notes.cast("string").alias("notes"),
        F.lit(kind).cast("int").alias("kind"), line.cast("int").alias("line_no"))


def stock_ledger(t: Tables, as_of: dt.date, sales: DataFrame | None = None) -> DataFrame:
    """Initial stock + accepted restocks + sales as one signed ledger.
    ``sales`` defaults to the lines that the checkout admitted
    (:func:`admission.fixture_sales`): only those ever took stock."""
    null = F.lit(None)
    init = _ledger_rows(D.opening_stock(t), F.col("opening_qty"), "restock", null, null,
                        ntz(D.LEDGER_START), F.lit("Initial stock on product creation"), 0, F.lit(0))
    rs = billing.accepted_restocks(t, as_of)
    restock = _ledger_rows(rs, F.col("qty"), "restock", null, F.col("performed_by"),
                           F.col("request_ts"), F.col("notes"), 1, F.lit(0))
    if sales is None:
        sales = admission.fixture_sales(t, as_of)
    sale = _ledger_rows(sales, -F.col("qty_sold"), "sale", F.col("order_id"), F.col("cashier_id"),
                        F.col("order_date"), null, 2, F.col("line_no"))
    return init.unionByName(restock).unionByName(sale)


def running_stock(t: Tables, as_of: dt.date, ledger: DataFrame | None = None) -> DataFrame:
    """Stock after every ledger row, per product in ledger order.  One
    shuffle brings a product's rows together; those of a hot product are cut
    into range chunks of its ledger order, so they are spread over many tasks,
    and written once as a checkpoint that both branches of their sum read."""
    memo = t.__dict__.setdefault("_running_stock", {})
    if ledger is None and as_of in memo:
        return memo[as_of]
    led = (ledger if ledger is not None else stock_ledger(t, as_of)).filter(F.col("product_id").isNotNull())
    # of the registered ledger, the cart lines and the restock requests tell which products are hot
    keys = led if ledger is not None else admission.fixture_batch(t, as_of)[1].select("product_id").unionByName(
        D.restock_requests(t, as_of).select("product_id"))
    hot = hot_keys(keys.select("product_id"), "product_id")
    order = [F.col(c).asc_nulls_first() for c in LEDGER_ORDER]
    change = {"stock_after": F.col("change_qty").cast("bigint")}
    out = chunked_running_sum(mark_cold(led, "product_id", hot), "product_id", F.col("_rchunk"), order, change, whole=True)
    if not hot.isEmpty():
        tagged = assign_range_chunks(led.join(F.broadcast(hot), "product_id", "left_semi"), "product_id", order)
        out = out.unionByName(chunked_running_sum(tagged, "product_id", F.col("_rchunk"), order, change))
    out = out.drop("_rchunk")
    if ledger is None:
        memo[as_of] = out
    return out


def low_stock_alerts(t: Tables, as_of: dt.date, running: DataFrame | None = None) -> DataFrame:
    """An alert whenever an update takes stock from above the reorder level
    to at or below it (the product insert itself never alerts)."""
    r = running if running is not None else running_stock(t, as_of)
    p = t.product_base.select("product_id", "name", "reorder_level")
    before = F.col("stock_after") - F.col("change_qty")
    # only rows that cross some product's level have to meet their own
    span = p.agg(F.min("reorder_level").alias("_least"), F.max("reorder_level").alias("_most"))
    near = r.filter(F.col("kind") > 0).crossJoin(F.broadcast(span)).filter(
        (F.col("stock_after") <= F.col("_most")) & (before > F.col("_least")))
    hit = (near.join(met_by_shuffle(p), "product_id")
           .filter((F.col("stock_after") <= F.col("reorder_level")) & (before > F.col("reorder_level"))))
    msg = F.concat(F.lit('Low stock alert: "'), F.col("name"), F.lit('" has only '),
                   F.col("stock_after").cast("string"), F.lit(" units left. Reorder level: "),
                   F.col("reorder_level").cast("string"))
    return hit.select(F.lit("low_stock").alias("type"), msg.alias("message"), "product_id",
                      "reference_id", "line_no", F.col("log_time").alias("created_at"))


def expiry_warnings(t: Tables, as_of: dt.date) -> DataFrame:
    """Warnings for products created on ``as_of`` that expire within 30 days."""
    return _expiry_rows(t.product_base, S.days_until(F.col("expiry_date"), as_of), ntz(as_of))


def _expiry_rows(products: DataFrame, days: Column, created_at: Column) -> DataFrame:
    p = products.filter(F.col("expiry_date").isNotNull()).filter(days.between(0, 30))
    msg = F.concat(F.lit('Expiry warning: "'), F.col("name"), F.lit('" expires on '),
                   F.col("expiry_date").cast("string"), F.lit(" ("), days.cast("string"), F.lit(" days)"))
    return p.select(F.lit("expiry_warning").alias("type"), msg.alias("message"), "product_id",
                    F.lit(None).cast("bigint").alias("reference_id"), F.lit(0).alias("line_no"),
                    created_at.alias("created_at"))


def created_ledger(t: Tables, feed: DataFrame) -> DataFrame:
    """Initial ledger rows of the products that a change feed adds."""
    null = F.lit(None)
    return _ledger_rows(changes.created_products(t, feed), F.col("stock_qty"), "restock", null, null,
                        F.col("changed_at"), F.lit("Initial stock on product creation"), 0, F.lit(0))


def created_expiry_warnings(t: Tables, feed: DataFrame) -> DataFrame:
    """Warnings for the products that a change feed adds within 30 days of their expiry."""
    made = changes.created_products(t, feed)
    return _expiry_rows(made, F.datediff("expiry_date", F.to_date("changed_at")), F.col("changed_at"))


def all_alerts(t: Tables, as_of: dt.date, running: DataFrame | None = None) -> DataFrame:
    """Both alert writers in one table, with read flag and severity."""
    a = low_stock_alerts(t, as_of, running).unionByName(expiry_warnings(t, as_of))
    is_read = ((F.col("product_id") + F.coalesce(F.col("reference_id"), F.lit(0))) % 2 == 0)
    return a.select("type", "message", "product_id", "reference_id", "line_no", "created_at",
                    is_read.alias("is_read"), S.alert_severity(F.col("type")).alias("severity"))


def alert_severity(t: Tables, as_of: dt.date) -> DataFrame:
    """Display severity of every alert (warn / danger / info)."""
    return all_alerts(t, as_of).select("type", "product_id", "reference_id", "line_no", "created_at",
                                       "severity")


def _alert_order():
    return [F.col("created_at").desc(), F.col("type"), F.col("product_id"),
            F.col("reference_id").asc_nulls_first(), F.col("line_no"), F.col("message")]


def alerts_feed(t: Tables, as_of: dt.date, n: int = 50) -> DataFrame:
    """Newest ``n`` alerts with the product name (alerts kept if the
    product is gone).  The names join only the ``n`` rows kept."""
    names = t.product_base.select("product_id", F.col("name").alias("product_name"))
    top = all_alerts(t, as_of).orderBy(*_alert_order()).limit(n)
    return top.join(met_by_shuffle(names), "product_id", "left").orderBy(*_alert_order())


def unread_alerts(t: Tables, as_of: dt.date, n: int = 20) -> DataFrame:
    return all_alerts(t, as_of).filter(~F.col("is_read")).orderBy(*_alert_order()).limit(n)


def apply_alert_reads(t: Tables, as_of: dt.date, reads: DataFrame,
                      alerts: DataFrame | None = None) -> DataFrame:
    """Mark alerts read from a batch of read events keyed like the alert.
    ``alerts`` defaults to :func:`all_alerts`."""
    keys = ["type", "product_id", "reference_id", "line_no", "created_at"]
    r = (reads.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).dropDuplicates()
         .withColumn("_read", F.lit(True)))
    a = alerts if alerts is not None else all_alerts(t, as_of)
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    j = a.join(met_by_shuffle(r), cond, "left")
    return j.select(*[c for c in a.columns if c != "is_read"],
                    (F.col("is_read") | F.coalesce(F.col("_read"), F.lit(False))).alias("is_read"))


def manager_reads(t: Tables, as_of: dt.date, alerts: DataFrame | None = None) -> DataFrame:
    """Read events derived from the alerts: a manager opened every alert of
    products with id % 3 = 0."""
    a = alerts if alerts is not None else all_alerts(t, as_of)
    return a.filter(F.col("product_id") % 3 == 0).select(
        "type", "product_id", "reference_id", "line_no", "created_at")


def stock_log_feed(t: Tables, as_of: dt.date, product_id=None, n: int = 100) -> DataFrame:
    """Newest ``n`` ledger rows with product and performer names.  The ``n``
    rows are taken first and named after: every ledger row has its product
    (checked by DQ-6), so the names never change the row set."""
    led = stock_ledger(t, as_of)
    if product_id is not None:
        led = led.filter(F.col("product_id") == F.lit(product_id))
    order = [F.col("log_time").desc(), "product_id", "kind", F.col("reference_id").asc_nulls_first(),
             "line_no", "change_qty"]
    top = cut_lineage(led.select(*LEDGER_COLS).orderBy(*order).limit(n))
    names = t.product_base.select("product_id", F.col("name").alias("product_name"))
    users = t.app_user.select(F.col("user_id").alias("performed_by"),
                              F.col("full_name").alias("performed_by_name"))
    named = top.join(met_by_shuffle(names), "product_id", "left").select(*LEDGER_COLS, "product_name")
    return lookup_join(named, "performed_by", users, "performed_by", ["performed_by_name"],
                       how="left", probe=top).orderBy(*order)


def ledger_reconcile(t: Tables, as_of: dt.date, counted: DataFrame | None = None) -> DataFrame:
    """Sum of the ledger per product against the counted stock (``product_id,
    stock_qty``), by default :func:`derived.shelf_counts`: the stock after the
    batch with a few miscounts."""
    led = stock_ledger(t, as_of).groupBy("product_id").agg(F.sum("change_qty").alias("ledger_qty"))
    p = counted if counted is not None else D.shelf_counts(admission.product_stock(t, as_of))
    j = led.join(p, "product_id", "full")
    return j.select("product_id", F.coalesce("ledger_qty", F.lit(0)).cast("bigint").alias("ledger_qty"),
                    F.col("stock_qty"),
                    (F.coalesce("stock_qty", F.lit(0)) - F.coalesce("ledger_qty", F.lit(0))).cast("bigint")
                    .alias("drift"),
                    (F.coalesce("stock_qty", F.lit(0)) == F.coalesce("ledger_qty", F.lit(0))).alias("matches"))


def recorded_sales(t: Tables) -> DataFrame:
    """Every recorded order line as an attempted sale."""
    heads = t.sales_orders.select("order_id", "cashier_id", "order_date")
    return t.order_items.select("order_id", "product_id", "line_no", "qty_sold").join(heads, "order_id")


def blocked_lines(t: Tables, as_of: dt.date) -> DataFrame:
    """Recorded sale lines the insert guard would have blocked: product
    expired on the sale day, or stock before the sale below the quantity.
    Recorded lines are attempts; admitted ones never fail the guard."""
    attempts = stock_ledger(t, as_of, recorded_sales(t))
    r = running_stock(t, as_of, attempts).filter(F.col("kind") == 2)
    p = t.product_base.select("product_id", "expiry_date")
    j = r.join(p, "product_id", "left")
    before = F.col("stock_after") - F.col("change_qty")
    reason = (F.when(F.col("expiry_date") < F.to_date("log_time"), "expired")
               .when(before < -F.col("change_qty"), "short_stock"))
    return (j.withColumn("reason", reason).filter(F.col("reason").isNotNull())
            .select(F.col("reference_id").alias("order_id"), "product_id", "line_no",
                    (-F.col("change_qty")).alias("qty_sold"), before.alias("stock_before"), "reason"))
