"""B-3 from batch to batch: the stock that one batch leaves is what the next finds.

A store has one published version per batch: the batch's decisions, the lines
it admitted, and the state that it leaves, which is the stock on hand at its
close (the time of its last order) and the accepted restocks dated after that.
The next batch is decided against that state alone; no earlier order is read
again.  A batch whose write fails is not published, so a retry decides it
against the same state, and a batch that is published is left as it is.

Batches cut along the order time give the decisions that one run over all of
them gives.  An order older than the close of the batch before is late: it is
decided with its own batch, against what is left by then, because no admitted
sale is taken back; orders without a time come first in their batch.  A
product that is new to the store brings its opening stock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.operators import admission
from tillwise.sources import sinks
from tillwise.sources.tables import Tables

DECISIONS, SALES, STOCK, PENDING, CLOSE = "decisions", "sales", "stock", "pending", "close"


def _state(spark: SparkSession, base: str, opening: DataFrame, restocks: DataFrame):
    """(stock, restocks still to come, close) that the next batch finds."""
    opening = opening.select("product_id", F.col("opening_qty").cast("bigint").alias("opening_qty"))
    restocks = restocks.select("product_id", F.col("qty").cast("bigint").alias("qty"), "request_ts")
    if not sinks.published_versions(spark, base):
        return opening, restocks, None
    stock, pending, close = (sinks.read_published(spark, base, n) for n in (STOCK, PENDING, CLOSE))
    fresh = opening.join(stock.select("product_id"), "product_id", "left_anti")
    return stock.unionByName(fresh), pending.unionByName(restocks), close.first()["closed_at"]


def commit_batch(t: Tables, base: str, batch: int, lines: DataFrame, headers: DataFrame, opening: DataFrame,
                 restocks: DataFrame) -> None:
    """Decide batch number ``batch`` (from 0, without gaps) and publish it.

    ``lines`` (materialised) and ``headers`` are the batch's orders,
    ``restocks`` the accepted restocks that came in with it, each given once;
    of ``opening`` only products new to the store count."""
    spark = t.spark
    versions = sinks.published_versions(spark, base)
    if batch in versions:
        return
    if batch != len(versions):
        raise ValueError(f"batch {batch} does not follow the {len(versions)} published at {base}")
    stock, due, before = _state(spark, base, opening, restocks)
    decisions = admission.bill_batch(t, lines, headers, stock, due)
    accepted = decisions.filter(F.col("decision") == "accepted").select("order_id")
    sales = lines.join(accepted, "order_id", "left_semi")
    last = headers.agg(F.max("order_date").alias("closed_at")).first()["closed_at"]
    closed = max((x for x in (before, last) if x is not None), default=None)
    close = spark.createDataFrame([(closed,)], "closed_at timestamp_ntz")
    in_time = F.coalesce(F.col("request_ts") <= F.lit(closed).cast("timestamp_ntz"), F.lit(False))
    moved = (stock.unionByName(due.filter(in_time).select("product_id", F.col("qty").alias("opening_qty")))
             .unionByName(sales.select("product_id", (-F.col("qty")).cast("bigint").alias("opening_qty"))))
    sinks.publish({DECISIONS: decisions, SALES: sales,
                   STOCK: moved.groupBy("product_id").agg(F.sum("opening_qty").alias("opening_qty")),
                   PENDING: due.filter(~in_time), CLOSE: close}, base, batch)


def all_decisions(spark: SparkSession, base: str) -> DataFrame:
    """The decisions of every published batch, with its number."""
    parts = [sinks.read_published(spark, base, DECISIONS, v).withColumn("batch", F.lit(v))
             for v in sinks.published_versions(spark, base)]
    if not parts:
        raise LookupError(f"nothing is published at {base}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stock_on_hand(spark: SparkSession, base: str) -> DataFrame:
    """``product_id, stock_qty`` after the last batch and every restock that came in with it."""
    due = sinks.read_published(spark, base, PENDING).select("product_id", F.col("qty").alias("opening_qty"))
    return (sinks.read_published(spark, base, STOCK).unionByName(due)
            .groupBy("product_id").agg(F.sum("opening_qty").alias("stock_qty")))
