"""Running sums per key that stay parallel when one key is hot.

A plain ``sum().over(partitionBy(key).orderBy(seq))`` sends every row of a
key to one task.  Here the key's sequence is cut into chunks (contiguous in
the ordering, e.g. one calendar day) and the rows are shuffled once by
(key, chunk):

* each (key, chunk) runs its own window (its running sum within the chunk),
* chunk totals are aggregated per (key, chunk) and turned into offsets,
* a window over at most one row per chunk turns totals into offsets, which
  a join on (key, chunk) adds back.  The window output is already sorted by
  (key, chunk), so a sort-merge join needs no further sort.

A key holding a third of all rows is spread over all of its chunks.  With
:func:`assign_range_chunks` the chunks come from range partitioning of the
full ordering, so even a single hot key-day is split evenly.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.plans.broadcast import met_by_shuffle
from tillwise.plans.lineage import cut_lineage

#: Rows sampled per shuffle partition to find the hot keys.
HOT_SAMPLE = 1000


def chunked_running_sum(df: DataFrame, key: str | Sequence[str], chunk: Column,
                        order: Sequence[Column], values: dict[str, Column],
                        inclusive: bool = True, materialize: bool = False,
                        prepartitioned: bool = False, spanning: DataFrame | None = None,
                        whole: bool = False) -> DataFrame:
    """Add one running-sum column per ``values`` entry.

    ``chunk`` must be non-decreasing along ``order`` within a key (it is the
    leading part of the ordering).  ``inclusive`` includes the current row;
    otherwise the sum covers strictly earlier rows.  The input feeds two
    branches (rows and chunk totals); ``materialize`` writes it once as a
    reliable checkpoint first, for inputs that are expensive to recompute.
    ``prepartitioned``: the input is already hash partitioned by (key,
    chunk) (e.g. a checkpoint written that way), so no explicit repartition
    is requested and the planner reuses that layout.  ``spanning``: the few
    keys (:func:`spanning_keys`) that may lie in more than one chunk; only
    theirs are totalled, and the offsets are broadcast.  ``whole``: no key
    lies in more than one chunk, so there are no offsets.
    """
    keys = [key] if isinstance(key, str) else list(key)
    # where keys are whole the chunk keeps its own name, by which the rows then lie
    at, d = (chunk, df) if whole else (F.col("_chunk"), df.withColumn("_chunk", chunk))
    for name, v in values.items():
        d = d.withColumn(f"_v_{name}", v)
    if materialize:
        d = cut_lineage(d)
    # the totals combine before their shuffle, so they are taken before the rows are moved
    totalled = d if spanning is None else d.join(F.broadcast(spanning), keys, "left_semi")
    if not prepartitioned and not whole:
        d = d.repartition(*keys, "_chunk")
    upto = 0 if inclusive else -1
    inner = Window.partitionBy(*keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    within = d.select("*", *[F.coalesce(F.sum(f"_v_{n}").over(inner), F.lit(0)).alias(f"_w_{n}")
                             for n in values])
    if whole:
        return within.select(*df.columns, *[F.col(f"_w_{n}").alias(n) for n in values])
    totals = totalled.groupBy(*keys, "_chunk").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_chunk", *[
        F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    if spanning is None:
        out = within.join(met_by_shuffle(offsets), [*keys, "_chunk"])
    else:
        out = within.join(F.broadcast(offsets), [*keys, "_chunk"], "left")
    for n in values:
        out = out.withColumn(n, F.coalesce(F.col(f"_o_{n}"), F.lit(0)) + F.col(f"_w_{n}"))
    drop = ["_chunk"] + [f"_{p}_{n}" for p in "vwo" for n in values]
    return out.drop(*drop)


def assign_range_chunks(df: DataFrame, key: str | Sequence[str], order: Sequence[Column],
                        name: str = "_rchunk", partitions: int | None = None,
                        write: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """Tag rows with chunk ids that are contiguous along (key, order).

    ``repartitionByRange`` samples the sort keys and cuts the total order
    into ranges of similar size, so a key holding a third of all rows is
    split across many ranges; the range's partition index is the chunk id.
    The result is checkpointed, which fixes the ids: both branches of a
    running sum (and every round of an iteration) see the same chunks.
    Removing rows later never breaks contiguity.  ``write`` may store the
    rows elsewhere, e.g. as a table that the caller removes.
    """
    keys = [key] if isinstance(key, str) else list(key)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = (df.repartitionByRange(n, *[F.col(k).asc() for k in keys], *order)
              .withColumn(name, F.spark_partition_id()))
    return write(tagged)


def hot_keys(keys: DataFrame, key: str) -> DataFrame:
    """The keys of ``keys`` (one row per row to come) that hold more than half
    a shuffle partition's share of the rows, as a bounded sample has them: at
    most about twice as many as there are partitions.  It only decides how
    rows are dealt, never a result."""
    n, rows = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), keys.count()
    fraction = min(1.0, HOT_SAMPLE * n / max(rows, 1))
    counted = keys.filter(F.col(key).isNotNull()).sample(fraction, seed=17).groupBy(key).count()
    return cut_lineage(counted.filter(F.col("count") > fraction * rows / (2 * n)).select(key))


def mark_cold(df: DataFrame, key: str, hot: DataFrame, name: str = "_rchunk") -> DataFrame:
    """The rows of keys that are not ``hot``, each key in the one chunk -1.
    The number comes out of a join, so that it stays a column to deal by."""
    marked = df.join(F.broadcast(hot.withColumn("_hot", F.lit(0))), key, "left")
    return marked.filter(F.col("_hot").isNull()).withColumn(name, F.coalesce("_hot", F.lit(-1))).drop("_hot")


def spanning_keys(tagged: DataFrame, key: str, chunk: str = "_rchunk") -> DataFrame:
    """The keys that may lie in several chunks of :func:`assign_range_chunks`:
    such a key ends one chunk and begins another.  At most one per chunk."""
    edges = tagged.groupBy(chunk).agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    return edges.select(F.col("_lo").alias(key)).intersect(edges.select(F.col("_hi").alias(key)))
