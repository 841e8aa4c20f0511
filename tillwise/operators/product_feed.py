"""A product change feed as one commit: snapshot, ledger rows and warnings.

Adding a product also writes its initial stock to the ledger and may warn of
its expiry.  The three outputs are computed from the same feed and published
under one version, so a reader sees all of them or none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.operators import changes, ledger
from tillwise.sources import sinks
from tillwise.sources.tables import Tables

PRODUCT, LEDGER, ALERTS = "product", "stock_log", "notification"


def feed_outputs(t: Tables, feed: DataFrame) -> dict[str, DataFrame]:
    """The new product table, and the ledger rows and expiry warnings of the
    products that the feed adds."""
    return {PRODUCT: changes.apply_product_changes(t, feed),
            LEDGER: ledger.created_ledger(t, feed),
            ALERTS: ledger.created_expiry_warnings(t, feed)}


def commit_feed(t: Tables, feed: DataFrame, base: str, version: int) -> None:
    """Publish the outputs of ``feed`` as ``version`` of the store at ``base``.
    ``t`` holds the products that the feed changes (see :func:`committed_tables`)."""
    sinks.publish(feed_outputs(t, feed), base, version)


def committed_tables(spark: SparkSession, base: str, version: int | None = None, **frames: DataFrame) -> Tables:
    """Tables whose products are those of a published version (the newest by
    default); ``frames`` are the other tables."""
    p = sinks.read_published(spark, base, PRODUCT, version).drop("updated_at", "change")
    return Tables.from_frames(spark, product=p, **frames)


def committed_rows(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Ledger rows or warnings of all published versions, with their version."""
    versions = sinks.published_versions(spark, base)
    if not versions:
        raise LookupError(f"nothing is published at {base}")
    parts = [sinks.read_published(spark, base, name, v).withColumn("version", F.lit(v)) for v in versions]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
