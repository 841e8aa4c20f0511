"""Storage layout for co-located joins.

At scale the largest shuffle is lineitem joined with orders on the order
key (almost every sales report does it).  Writing both tables bucketed and
sorted on that key, with the same bucket count, lets Spark join them bucket
by bucket with no exchange; customer and part are bucketed on their keys for
the dimension joins.  Tables are external (their files live at a path of
the caller's choosing, e.g. below the shared warehouse folder).
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from tillwise.sources.tables import Tables

# table -> bucketing key
BUCKET_KEYS = {
    "lineitem": "l_orderkey",
    "orders": "o_orderkey",
    "customer": "c_custkey",
    "part": "p_partkey",
}


def write_layout(t: Tables, root: str, buckets: int, prefix: str = "tw_") -> dict[str, str]:
    """Write the bucketed copies; returns table name per source table."""
    names = {}
    for table, key in BUCKET_KEYS.items():
        name = f"{prefix}{table}"
        # dealt by the bucket key first: one file per bucket, not one per task and bucket
        (t.raw(table).repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
         .option("path", os.path.join(root, table)).saveAsTable(name))
        names[table] = name
    return names


def tables_from_layout(spark: SparkSession, sf_dir: str, names: dict[str, str]) -> Tables:
    """A bundle that reads the bucketed tables where present and the plain
    Parquet files otherwise."""
    t = Tables.from_dir(spark, sf_dir)
    t._raw_overrides = {table: spark.table(name) for table, name in names.items()}
    return t
