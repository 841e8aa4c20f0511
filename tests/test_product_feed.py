"""A product feed is published whole or not at all, version after version."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.test_changes import CHANGE_SCHEMA, PRODUCT_SCHEMA, TS
from tillwise.operators import changes, ledger, product_feed
from tillwise.session import scratch_path
from tillwise.sources import Tables, sinks

NONE5 = (None,) * 5


def _first(spark):
    prod = spark.createDataFrame([(1, "b1", "milk", Decimal("2.00"), 5, 3, None, "cold", 1, True),
                                  (2, "b2", "tea", Decimal("3.00"), None, 3, None, None, 1, True)], PRODUCT_SCHEMA)
    return Tables.from_frames(spark, product=prod)


def _feed(spark, *rows):
    return spark.createDataFrame(list(rows), CHANGE_SCHEMA + ", stock_qty int")


def _added(pid, name, expiry, stock, ts=TS, version=1):
    return (pid, version, ts, name, Decimal("1.00"), None, expiry, None, 1, None, None, stock)


def test_two_feeds_after_one_another(spark):
    base = scratch_path(spark, "feed")
    with pytest.raises(LookupError):
        sinks.read_published(spark, base, product_feed.PRODUCT)
    feed = _feed(spark, _added(9, "jam", dt.date(2001, 8, 20), 40), (1, 1, TS, "Milk", *NONE5, None, None, 77))
    product_feed.commit_feed(_first(spark), feed, base, 1)
    t = product_feed.committed_tables(spark, base)
    later = TS + dt.timedelta(days=1)
    again = _feed(spark, _added(9, "jam two", None, 99, later, 2), _added(10, "egg", None, 6, later))
    product_feed.commit_feed(t, again, base, 2)
    assert sinks.published_versions(spark, base) == [1, 2]
    got = {r.product_id: (r.name, r.stock_qty) for r in product_feed.committed_tables(spark, base).product.collect()}
    # a product of the first feed is a known one in the second: its stock stays, no second ledger row
    assert got == {1: ("Milk", 5), 2: ("tea", None), 9: ("jam two", 40), 10: ("egg", 6)}
    rows = product_feed.committed_rows(spark, base, product_feed.LEDGER)
    assert sorted((r.version, r.product_id, r.change_qty) for r in rows.collect()) == [(1, 9, 40), (2, 10, 6)]
    warned = product_feed.committed_rows(spark, base, product_feed.ALERTS).collect()
    assert [(r.version, r.product_id) for r in warned] == [(1, 9)]
    old = sinks.read_published(spark, base, product_feed.PRODUCT, 1)
    assert {r.product_id for r in old.collect()} == {1, 2, 9}
    with pytest.raises(ValueError):
        product_feed.commit_feed(t, again, base, 2)


def test_a_failed_commit_shows_nothing(spark):
    base = scratch_path(spark, "feed")
    t = _first(spark)
    feed = _feed(spark, _added(9, "jam", None, 4))
    product_feed.commit_feed(t, feed, base, 1)
    after = product_feed.committed_tables(spark, base)
    outputs = product_feed.feed_outputs(after, _feed(spark, _added(10, "egg", None, 6)))
    broken = dict(outputs)
    broken[product_feed.ALERTS] = outputs[product_feed.ALERTS].withColumn(
        "message", F.raise_error(F.lit("no space")).cast("string")).unionByName(
        spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name)
                                for f in outputs[product_feed.ALERTS].schema][:1],
                              F.raise_error(F.lit("no space")).cast("string").alias("message")),
        allowMissingColumns=True)
    with pytest.raises(Exception, match="no space"):
        sinks.publish(broken, base, 2)
    # two of the three outputs are written, none is seen
    assert sinks.published_versions(spark, base) == [1]
    assert {r.product_id for r in product_feed.committed_tables(spark, base).product.collect()} == {1, 2, 9}
    assert product_feed.committed_rows(spark, base, product_feed.LEDGER).count() == 1
    sinks.publish(outputs, base, 2)
    assert {r.product_id for r in product_feed.committed_tables(spark, base).product.collect()} == {1, 2, 9, 10}
    assert product_feed.committed_rows(spark, base, product_feed.LEDGER).count() == 2


def test_known_product_without_stock_is_an_update(spark):
    feed = _feed(spark, (2, 1, TS, "Tea", *NONE5, None, None, 8))
    t = _first(spark)
    got = {r.product_id: (r.change, r.stock_qty) for r in changes.apply_product_changes(t, feed).collect()}
    assert got == {1: ("none", 5), 2: ("update", None)}
    assert ledger.created_ledger(t, feed).count() == 0
