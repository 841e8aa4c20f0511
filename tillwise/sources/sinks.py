"""Sinks: append-only fact writers and versioned snapshots.

Ledger rows, order lines and alerts are appended, partitioned by month so
later reports prune by date.  Mutable tables (products after a change feed)
are written as a new snapshot folder per version; readers pick a version,
so a failed write never leaves a half-updated table behind.  Outputs that
belong together are published under one version: each is written to the
version's folder, and a marker that readers look for is made last.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_facts(df: DataFrame, path: str, time_col: str, sort_by: str | None = None,
                 batch_id: int | str | None = None) -> None:
    """Append rows partitioned by ``yyyy-MM`` of ``time_col``.

    Rows are range-partitioned by (month, ``sort_by``), so a large month is
    written by several tasks with tight Parquet statistics each, and small
    months share one.  With ``batch_id`` the rows go to that batch's own
    folder, replacing what an earlier attempt left there; without it they are
    appended, and a repeated call repeats them."""
    out = df.withColumn("month", F.date_format(F.col(time_col), "yyyy-MM"))
    order = ["month"] + ([sort_by] if sort_by else [])
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = out.repartitionByRange(n, *order).sortWithinPartitions(*order)
    if batch_id is not None:
        path = os.path.join(path, f"batch_id={batch_id}")
    out.write.mode("append" if batch_id is None else "overwrite").partitionBy("month").parquet(path)


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    path = os.path.join(base, f"version={version}")
    df.write.mode("overwrite").parquet(path)
    return path


def read_snapshot(spark, base: str, version: int) -> DataFrame:
    return spark.read.parquet(os.path.join(base, f"version={version}"))


def _markers(spark: SparkSession, base: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(base, "_published"))
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def published_versions(spark: SparkSession, base: str) -> list[int]:
    """The published versions at ``base``, oldest first."""
    folder, fs = _markers(spark, base)
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder))


def publish(outputs: dict[str, DataFrame], base: str, version: int) -> None:
    """Write all ``outputs`` and then publish them together as ``version``.

    A run that fails on the way leaves no marker: readers go on with the
    version before, and a retry replaces what was written.  A version is
    published once; a store has one writer at a time."""
    spark = next(iter(outputs.values())).sparkSession
    folder, fs = _markers(spark, base)
    marker = spark._jvm.org.apache.hadoop.fs.Path(folder, str(version))
    if fs.exists(marker):
        raise ValueError(f"version {version} is published already at {base}")
    for name, df in outputs.items():
        write_snapshot(df, os.path.join(base, name), version)
    fs.mkdirs(folder)
    fs.createNewFile(marker)


def read_published(spark: SparkSession, base: str, name: str, version: int | None = None) -> DataFrame:
    """Output ``name`` of a published version (the newest by default)."""
    versions = published_versions(spark, base)
    if not versions or (version is not None and version not in versions):
        raise LookupError(f"version {version or 'any'} is not published at {base}")
    return read_snapshot(spark, os.path.join(base, name), versions[-1] if version is None else version)
