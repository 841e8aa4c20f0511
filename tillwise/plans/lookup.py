"""Lookup joins against a dimension through a few, possibly hot, keys.

Joining orders to the user table on ``cashier_id`` (a handful of staff
accounts) as a shuffle join would hash all orders into a handful of
partitions and shuffle the whole user table.  Instead the distinct keys the
fact uses are collected with a partial aggregate, the matching dimension
rows are broadcast after a size check, and the fact is joined in place.
When the used keys exceed the bound the join is left to the planner (AQE
splits skewed partitions of a sort-merge join).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.plans.broadcast import BroadcastBoundExceeded, bounded_broadcast

MAX_LOOKUP_ROWS = 200_000


def lookup_join(fact: DataFrame, fact_key: str, dim: DataFrame, dim_key: str,
                cols: Sequence[str], how: str = "inner", max_rows: int = MAX_LOOKUP_ROWS,
                probe: DataFrame | None = None) -> DataFrame:
    """``fact`` joined with ``dim[cols]`` on fact_key = dim_key; the result
    carries ``cols`` (renamed by the caller beforehand if needed).  ``probe``
    (default ``fact``) supplies the used keys; a cheaper frame whose keys are
    a superset of the fact's (e.g. the scan before other joins) may be given."""
    src = probe if probe is not None else fact
    used = src.select(F.col(fact_key).alias(dim_key)).filter(F.col(dim_key).isNotNull()).distinct()
    sub = dim.select(dim_key, *cols).join(used, dim_key, "left_semi")
    try:
        side = bounded_broadcast(sub, max_rows)
    except BroadcastBoundExceeded:
        side = dim.select(dim_key, *cols)
    side = side.withColumnRenamed(dim_key, fact_key) if dim_key != fact_key else side
    return fact.join(side, fact_key, how)
