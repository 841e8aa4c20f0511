"""Streaming reports.

ST-1 daily sales: tumbling one-day windows with a one-day watermark on the
order time; distinct customers come from a first stage keyed by
(day, customer), because exact distinct counts are not available on streams.
Rows behind the watermark and rows without a time are in no day; both are
counted.  ST-2 low-stock alerts: keyed state per product; an alert stands
whenever stock crosses down to the reorder level, and a late row corrects the
alerts after it.
ST-3 category revenue: a stream-static join of order lines with completed
orders and the product dimension, aggregated by category in update mode.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.functions.scalar import instant_day, sum_money, wall_clock_instant
from tillwise.operators import ledger as L
from tillwise.plans.broadcast import met_by_shuffle
from tillwise.session import scratch_path
from tillwise.sources.tables import Tables
from tillwise.streaming.feed import batch_sink, latest_per_key, run_as_feed

SUM_MONEY = T.DecimalType(22, 2)
WATERMARK = "1 day"


# -- ST-1 ----------------------------------------------------------------------
def daily_sales_stream(orders: DataFrame) -> DataFrame:
    """Per (day, customer): completed orders and their money columns.  The
    rows that come in are observed, under ``daily``."""
    o = (orders.filter(F.col("status") == "completed")
         .observe("daily", F.count(F.lit(1)).alias("rows_in"),
                  F.count_if(F.col("order_date").isNull()).alias("without_time"))
         .withColumn("_ts", wall_clock_instant(F.col("order_date")))
         .withWatermark("_ts", WATERMARK))
    return (o.groupBy(F.window("_ts", "1 day").alias("w"), "customer_id")
            .agg(F.count(F.lit(1)).alias("orders"), sum_money(F.col("total_bill")).alias("revenue"),
                 sum_money(F.col("tax_amount")).alias("tax"), sum_money(F.col("discount")).alias("discount"))
            .select(instant_day(F.col("w.start")).alias("day"), "customer_id", "orders", "revenue",
                    "tax", "discount"))


def _daily_stages(t: Tables, arrival: str = "order_date") -> tuple[DataFrame, list]:
    """(rows per day and customer, what the micro-batches observed)."""
    spark = t.spark
    columns = ["order_id", "customer_id", "order_date", "total_bill", "tax_amount", "discount", "status"]
    src = t.sales_orders.select(*dict.fromkeys([*columns, arrival]))
    sink = scratch_path(spark, "daily-sink")
    seen = run_as_feed(spark, src, arrival,
                       lambda s: daily_sales_stream(s).writeStream.outputMode("update")
                       .foreachBatch(batch_sink(sink)), "daily")
    return latest_per_key(spark.read.parquet(sink), ["day", "customer_id"],
                          ["orders", "revenue", "tax", "discount"]), seen


def stream_daily_sales(t: Tables, arrival: str = "order_date") -> DataFrame:
    return _daily_stages(t, arrival)[0].groupBy("day").agg(
        F.sum("orders").cast("bigint").alias("orders_today"),
        sum_money(F.col("revenue")).alias("revenue_today"),
        sum_money(F.col("tax")).alias("tax_today"),
        sum_money(F.col("discount")).alias("discount_today"),
        F.count(F.lit(1)).alias("unique_customers_today"))


def stream_daily_counts(t: Tables, arrival: str = "order_date") -> DataFrame:
    """What became of the completed orders that came in: counted in a day,
    late (behind the watermark, so in no day), or without a time."""
    per_customer, seen = _daily_stages(t, arrival)
    came = {k: sum(r[k] or 0 for r in seen) for k in ("rows_in", "without_time")}
    return per_customer.agg(F.coalesce(F.sum("orders"), F.lit(0)).cast("bigint").alias("counted")).select(
        F.lit(came["rows_in"]).cast("bigint").alias("rows_in"), "counted",
        (F.lit(came["rows_in"] - came["without_time"]) - F.col("counted")).cast("bigint").alias("late"),
        F.lit(came["without_time"]).cast("bigint").alias("without_time"))


CLOSING = "interval 3 days"   # after the last order: beyond the watermark's day and the day it closes


def daily_rows_stream(orders: DataFrame) -> DataFrame:
    """The day rows themselves, in one query: orders are summed per (day,
    customer), and those sums per day, each in its turn once the watermark has
    passed the day.  A day comes out once, whole and final."""
    o = (orders.filter(F.col("status") == "completed")
         .withColumn("_ts", wall_clock_instant(F.col("order_date"))).withWatermark("_ts", WATERMARK))
    per_customer = o.groupBy(F.window("_ts", "1 day").alias("w"), "customer_id").agg(
        F.count(F.lit(1)).alias("orders"), *[sum_money(F.col(c)).alias(c) for c in ("total_bill", "tax_amount", "discount")])
    per_day = per_customer.groupBy(F.window(F.window_time("w"), "1 day").alias("d")).agg(
        F.sum("orders").cast("bigint").alias("orders_today"), sum_money(F.col("total_bill")).alias("revenue_today"),
        sum_money(F.col("tax_amount")).alias("tax_today"), sum_money(F.col("discount")).alias("discount_today"),
        F.count("customer_id").cast("bigint").alias("unique_customers_today"))
    return per_day.select(instant_day(F.col("d.start")).alias("day"), *per_day.columns[1:])


def stream_daily_rows(t: Tables, arrival: str = "order_date") -> DataFrame:
    """ST-1 as the stream emits it.  A last row, dated after all others, closes
    the feed: it lets the watermark pass the last day, and its own day stays open."""
    spark, sink = t.spark, scratch_path(t.spark, "daily-rows-sink")
    columns = ["order_id", "customer_id", "order_date", "total_bill", "tax_amount", "discount", "status"]
    src = t.sales_orders.select(*dict.fromkeys([*columns, arrival]))
    times = dict.fromkeys(["order_date", arrival])
    last = src.agg(*[(F.max(c) + F.expr(CLOSING)).alias(c) for c in times], F.lit("completed").alias("status"))
    feed = src.unionByName(last.filter(F.col("order_date").isNotNull()), allowMissingColumns=True)
    run_as_feed(spark, feed, arrival, lambda s: daily_rows_stream(s).writeStream.outputMode("append")
                .foreachBatch(batch_sink(sink)), "daily-rows")
    return spark.read.parquet(sink).drop("batch_id")


# -- ST-2 ----------------------------------------------------------------------
# --- fixed values: the value that sorts null times first -------------------------
NO_TIME = -(1 << 62)
EPOCH = "TIMESTAMP_NTZ '1970-01-01'"
ALERT_ROW = ("product_id bigint, micros bigint, kind int, no_ref boolean, reference_id bigint, line_no int, "
             "stock_after bigint, reorder_level int")
SHELF = 64               # products whose state is one entry
MARK = -1                # ``kind`` of the row that says: this product was worked over


def _ledger_events(rows: DataFrame) -> DataFrame:
    """Ledger rows with an order of plain numbers (nulls first)."""
    micros = F.coalesce(F.expr(f"timestampdiff(MICROSECOND, {EPOCH}, log_time)"), F.lit(NO_TIME))
    return rows.select("product_id", micros.alias("micros"), F.col("kind").cast("int").alias("kind"),
                       F.col("reference_id").isNull().alias("no_ref"),
                       F.coalesce(F.col("reference_id"), F.lit(0)).cast("bigint").alias("reference_id"),
                       F.col("line_no").cast("int").alias("line_no"),
                       F.col("change_qty").cast("bigint").alias("change_qty"), "reorder_level")


def packing():
    """(pack, unpack) of ledger rows as the bytes of a state, as local functions
    that travel to the executors by value.  Equal bytes of a column's numbers
    lie together, most of which are zeros or repeat: the store has the state of
    all products in memory, of which this takes a fifth or less."""
    import zlib

    import numpy as np

    def pack(rows: np.ndarray) -> bytes:
        planes = np.ascontiguousarray(rows.T, dtype="<i8").view("u1").reshape(7, -1, 8).transpose(0, 2, 1)
        return zlib.compress(planes.tobytes(), 1)

    def unpack(state: bytes) -> np.ndarray:
        planes = np.frombuffer(zlib.decompress(state), dtype="u1").reshape(7, 8, -1).transpose(0, 2, 1)
        return np.ascontiguousarray(planes).view("<i8").reshape(7, -1).T

    return pack, unpack


def stock_state():
    """The stateful part of the low-stock stream: a function of the new rows
    of ``SHELF`` neighbouring products and their state, which is their ledger
    rows so far, packed in order of product and ledger (:func:`packing`).
    The stock of the products that have new rows is run over all their rows,
    so a late row corrects the alerts after it; their crossings come out anew,
    after a mark.  Only state of the micro-batch's products and their
    neighbours is touched; a task holds one such state at a time."""
    import numpy as np
    import pandas as pd

    columns = [c.split()[0] for c in ALERT_ROW.split(", ")]
    pack, unpack = packing()

    def advance(key, frames, state):
        fresh = [np.column_stack([f["product_id"], f["micros"], f["kind"], ~f["no_ref"].to_numpy(dtype=bool),
                                  f["reference_id"], f["line_no"], f["change_qty"], f["reorder_level"]]).astype("<i8")
                 for f in frames]
        fresh = np.concatenate(fresh)
        rows = np.concatenate([unpack(state.get[0]), fresh[:, :7]]) if state.exists else fresh[:, :7]
        rows = rows[np.lexsort(rows.T[::-1])]
        state.update((pack(rows),))
        products, at = np.unique(fresh[:, 0], return_index=True)
        rows = rows[np.isin(rows[:, 0], products)]
        which = np.searchsorted(products, rows[:, 0])
        total = np.cumsum(rows[:, 6])
        begin = np.searchsorted(which, np.arange(len(products)))
        after = total - (total[begin] - rows[begin, 6])[which]
        level = fresh[at, 7][which]
        hit = (rows[:, 2] > 0) & (after <= level) & (after - rows[:, 6] > level)
        found = rows[hit]
        alerts = np.column_stack([found[:, :3], 1 - found[:, 3], found[:, 4:6], after[hit], level[hit]])
        marks = np.zeros((len(products), 8), dtype=np.int64)
        marks[:, 0], marks[:, 2], marks[:, 3] = products, MARK, 1
        out = pd.DataFrame(np.concatenate([marks, alerts]), columns=columns)
        yield out.assign(no_ref=out["no_ref"] == 1)

    return advance


def low_stock_stream(levels: DataFrame, rows: DataFrame) -> DataFrame:
    """Crossings (and marks) of a stream of ledger rows; ``levels`` is the
    static ``product_id, reorder_level``."""
    shelf = F.floor(F.col("product_id") / SHELF).cast("bigint")
    return _ledger_events(rows.join(met_by_shuffle(levels), "product_id")).withColumn("shelf", shelf).groupBy(
        "shelf").applyInPandasWithState(
        stock_state(), ALERT_ROW, "rows binary", "update", "NoTimeout")


def standing_alerts(sink: DataFrame) -> DataFrame:
    """Alerts of the micro-batch that worked last over their product."""
    last = sink.filter(F.col("kind") == MARK).groupBy("product_id").agg(F.max("batch_id").alias("batch_id"))
    return sink.filter(F.col("kind") != MARK).join(met_by_shuffle(last), ["product_id", "batch_id"]).select(
        "product_id", "kind", F.when(F.col("micros") != NO_TIME, F.expr(f"timestampadd(MICROSECOND, micros, {EPOCH})"))
        .alias("log_time"), F.when(~F.col("no_ref"), F.col("reference_id")).alias("reference_id"), "line_no",
        "stock_after", "reorder_level")


def stream_low_stock(t: Tables, as_of: dt.date, ledger: DataFrame | None = None, arrival: str = "log_time") -> DataFrame:
    """Low-stock alerts of a ledger stream (by default the stored ledger,
    arriving in order of time); equal to the batch alerts in any order of
    arrival."""
    spark = t.spark
    led = ledger if ledger is not None else L.stock_ledger(t, as_of)
    levels = t.product_base.select("product_id", "reorder_level")
    sink = scratch_path(spark, "lowstock-sink")
    run_as_feed(spark, led.select("product_id", *dict.fromkeys([*L.LEDGER_ORDER, arrival])), arrival,
                lambda s: low_stock_stream(levels, s).writeStream.outputMode("update")
                .foreachBatch(batch_sink(sink)), "lowstock")
    names = t.product_base.select("product_id", "name")
    a = standing_alerts(spark.read.parquet(sink)).join(met_by_shuffle(names), "product_id")
    msg = F.concat(F.lit('Low stock alert: "'), F.col("name"), F.lit('" has only '),
                   F.col("stock_after").cast("string"), F.lit(" units left. Reorder level: "),
                   F.col("reorder_level").cast("string"))
    return a.select(F.lit("low_stock").alias("type"), msg.alias("message"), "product_id",
                    "reference_id", "line_no", F.col("log_time").alias("created_at"))


# -- ST-3 ----------------------------------------------------------------------
def category_revenue_stream(t: Tables, lines: DataFrame) -> DataFrame:
    completed = t.orders_in_status("completed").select("order_id")
    dim = t.product_typed.select("product_id", "category_name")
    return (lines.join(completed, "order_id", "left_semi").join(dim, "product_id")
            .groupBy("category_name")
            .agg(F.sum("qty_sold").alias("units"), sum_money(F.col("line_total")).alias("revenue")))


def stream_category_revenue(t: Tables) -> DataFrame:
    spark = t.spark
    heads = t.sales_orders.select("order_id", "order_date")
    src = t.order_items.select("order_id", "product_id", "qty_sold", "line_total").join(heads, "order_id")
    sink = scratch_path(t.spark, "category-sink")
    run_as_feed(spark, src, "order_date",
                lambda s: category_revenue_stream(t, s).writeStream.outputMode("update")
                .foreachBatch(batch_sink(sink)), "category")
    last = latest_per_key(spark.read.parquet(sink), ["category_name"], ["units", "revenue"])
    return last.select("category_name", F.col("units").cast("bigint").alias("units"),
                       F.col("revenue").cast(SUM_MONEY).alias("revenue"))


# -- ST-1 over the event log -------------------------------------------------------
# --- fixed values: weekly replay slices of the event log ------------------------
EVENT_BOUNDS = [dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 15), dt.datetime(2024, 1, 22)]


def purchase_events_stream(events: DataFrame) -> DataFrame:
    """Per (day, user): purchase events and their value in cents precision;
    one-day tumbling windows on the event time with a one-day watermark."""
    e = (events.filter(F.col("event_type") == "purchase")
         .withColumn("_ts", wall_clock_instant(F.col("ts")))
         .withWatermark("_ts", WATERMARK))
    return (e.groupBy(F.window("_ts", "1 day").alias("w"), "user_id")
            .agg(F.count(F.lit(1)).alias("purchases"),
                 F.sum(F.col("value").cast("decimal(12,2)")).alias("revenue"))
            .select(instant_day(F.col("w.start")).alias("day"), "user_id", "purchases", "revenue"))


def stream_event_purchases(t: Tables) -> DataFrame:
    spark = t.spark
    src = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    sink = scratch_path(t.spark, "purchases-sink")
    run_as_feed(spark, src, "ts",
                lambda s: purchase_events_stream(s).writeStream.outputMode("update")
                .foreachBatch(batch_sink(sink)), "purchases", bounds=EVENT_BOUNDS)
    per_user = latest_per_key(spark.read.parquet(sink), ["day", "user_id"], ["purchases", "revenue"])
    return per_user.groupBy("day").agg(
        F.sum("purchases").cast("bigint").alias("purchases"),
        F.sum("revenue").cast(SUM_MONEY).alias("revenue"),
        F.count(F.lit(1)).alias("unique_buyers"))
