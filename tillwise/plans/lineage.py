"""Lineage cuts for iterative jobs.

Reliable checkpoints are written under ``spark.checkpoint.dir`` (a shared
folder on a cluster), so an iteration survives the loss of the executors
that computed earlier rounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tillwise.session import checkpoint_root, scratch_path


def cut_lineage(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def write_out(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the scratch folder.  Unlike a checkpoint, which
    hands on the planner's size estimates, the table is planned by its real
    size: an iteration that joins its own results would otherwise multiply
    the estimates in every step, until they are numbers of millions of digits."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def deal_out(df: DataFrame, path: str, keys: list[str], tables: list[str], by: str | None = None) -> DataFrame:
    """``df`` as a table at ``path`` that lies dealt by ``keys``, so that
    what follows by these moves no row.  Its name joins ``tables``, which the
    caller drops (:func:`drop_tables`); the files stay until they are removed."""
    spark, name = df.sparkSession, f"tillwise_{uuid.uuid4().hex}"
    writer = df.write if by is None else df.write.partitionBy(by)
    tables.append(name)
    (writer.mode("overwrite").option("compression", "zstd").option("path", path)
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).saveAsTable(name))
    return spark.table(name)


def drop_tables(spark: SparkSession, tables: list[str]) -> None:
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
