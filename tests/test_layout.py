"""Bucketed layout: the order-key join runs without an exchange."""

from tillwise.operators import sales
from tillwise.session import scratch_path
from tillwise.sources.layout import tables_from_layout, write_layout

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_order_key_join_has_no_exchange(spark, tables_small):
    names = write_layout(tables_small, scratch_path(spark, "layout"), buckets=8)
    t = tables_from_layout(spark, SF, names)
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = t.order_items.select("order_id", "qty_sold")
        joined = items.join(t.sales_orders.select("order_id", "status"), "order_id")
        plan = _plan(joined)
        assert "SortMergeJoin" in plan and "Exchange" not in plan, plan
        # and the reports give the same answer on either layout
        a = sorted(sales.revenue_by_category(t).collect())
        b = sorted(sales.revenue_by_category(tables_small).collect())
        assert a == b
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_point_reads_scan_one_bucket(spark, tables_small):
    from tillwise.operators import catalog
    names = write_layout(tables_small, scratch_path(spark, "layout"), buckets=8, prefix="pt_")
    t = tables_from_layout(spark, SF, names)
    # buckets are pruned either way; only a bucketed scan says so in its plan
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        product = t.product_base.filter("product_id = 42")
        assert "SelectedBucketsCount: 1 out of 8" in _plan(product), _plan(product)
        assert product.count() == 1
        receipt = sales.receipts(t, 3)
        # the order and its lines; customers and products are joined by the few keys of the order
        assert _plan(receipt).count("SelectedBucketsCount: 1 out of 8") >= 2, _plan(receipt)
        assert sorted(receipt.collect()) == sorted(sales.receipts(tables_small, 3).collect())
        assert catalog.product_by_id(t, 42).collect() == catalog.product_by_id(tables_small, 42).collect()
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
