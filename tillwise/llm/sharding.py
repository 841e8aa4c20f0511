"""Sharding through fixed virtual slots.

Records are hashed by key into a fixed number of slots; the bytes per slot
are aggregated; a small versioned table maps slots to shards.  Rebalancing
edits that table only: a slot keeps its shard while the shard has room and
else moves to the emptiest one, so near-equal sizes cost few moves.  The law
is ``bytes``: shard sizes are near equal.

Everything runs on DataFrame functions.  A slot map has exactly ``n_slots``
rows, which bounds its broadcast and the one-row fold that edits it.

Defined results for odd input: a null text has size 1 and checksum 0; rows
with a null key hash like any other key; repeated rows are separate records
of one slot and each gets its own place; an empty table gives an empty
result.  Rows of one key share a slot unless the slot is hot: rows of a slot
that holds several times the mean are hashed again with their row number, so a
key (or null) with a third of all rows is spread over all slots, and neither a
shard nor a numbering task is left with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

N_SLOTS = 4096
SLACK = 0.001
#: A slot with so many times the mean bytes or rows is hot.
HOT = 4


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def slot_loads(records: DataFrame, slot: str = "vslot", size: str = "size") -> DataFrame:
    """Bytes and rows of each slot that holds rows (combined before the shuffle)."""
    return records.groupBy(slot).agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows"))


def spread_hot(records: DataFrame, loads: DataFrame, n_slots: int = N_SLOTS, hot: float = HOT) -> DataFrame:
    """``records`` with the rows of hot slots dealt to all slots by their row
    number ``row``, which must be stored with them, so that every reading of
    them gives the same slots."""
    limits = loads.agg(*[(F.sum(c) * F.lit(hot / n_slots)).alias(f"most_{c}") for c in ("bytes", "rows")])
    # bounded: one row per virtual slot, and one row of limits
    over = loads.join(F.broadcast(limits), (F.col("bytes") > F.col("most_bytes")) | (F.col("rows") > F.col("most_rows")))
    marked = records.join(F.broadcast(over.select("vslot", F.lit(True).alias("_hot"))), "vslot", "left")
    return marked.select(*[
        F.when(F.col("_hot"), F.pmod(F.xxhash64("vslot", "row"), F.lit(n_slots)).cast("int"))
        .otherwise(F.col("vslot")).alias("vslot") if c == "vslot" else F.col(c) for c in records.columns])


def first_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 0: slots dealt to shards in turn."""
    return spark.range(n_slots).select(
        F.col("id").cast("int").alias("vslot"), (F.col("id") % n_shards).cast("int").alias("shard"),
        F.lit(0).alias("version"))


def rebalance(slot_map: DataFrame, loads: DataFrame, n_shards: int, slack: float = SLACK) -> DataFrame:
    """The next version of ``slot_map`` for ``n_shards`` shards.

    Slots are taken from the largest to the smallest.  Each stays where it is
    if its shard exists and stays within ``(1 + slack)`` of the mean, else it
    goes to the shard with the fewest bytes so far.
    """
    known = slot_map.join(loads.select("vslot", "bytes"), "vslot", "left").select(
        F.coalesce("bytes", F.lit(0)).cast("bigint").alias("bytes"), "vslot", "shard", "version")
    one = known.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("bytes", "vslot", "shard")), asc=False).alias("slots"),
        F.max("version").alias("version"), F.sum("bytes").alias("total"))
    limit = F.ceil(F.col("total") * F.lit((1 + slack) / n_shards))
    one = one.select("*", limit.alias("most"))

    def step(acc: Column, s: Column) -> Column:
        here = s["shard"] + 1
        stays = (here <= n_shards) & (F.get(acc["loads"], s["shard"]) + s["bytes"] <= acc["most"])
        target = F.when(stays, here).otherwise(F.array_position(acc["loads"], F.array_min(acc["loads"])))
        return _placed(acc, s, target)

    def _placed(acc: Column, s: Column, target: Column) -> Column:
        return F.element_at(F.transform(F.array(target.cast("int")), lambda t: F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i + 1 == t, x + s["bytes"]).otherwise(x)).alias("loads"),
            F.concat(acc["out"], F.array(F.struct(s["vslot"].alias("vslot"), (t - 1).alias("shard"))))
            .alias("out"), acc["most"].alias("most"))), 1)

    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), n_shards).alias("loads"),
                     F.array().cast("array<struct<vslot:int,shard:int>>").alias("out"), F.col("most").alias("most"))
    folded = one.select("version", F.aggregate("slots", start, step, lambda acc: acc["out"]).alias("out"))
    return folded.select(F.explode("out").alias("s"), (F.col("version") + 1).alias("version")).select(
        "s.vslot", "s.shard", "version")


def save_map(slot_map: DataFrame, path: str) -> None:
    """Add the map's version to the map table at ``path`` (replayable)."""
    slot_map.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the stored map, the newest by default."""
    table = spark.read.schema("vslot int, shard int, version int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.filter(F.col("version") == version)


def assign(records: DataFrame, slot_map: DataFrame, loads: DataFrame) -> DataFrame:
    """``records`` with ``shard`` and ``slot``, the row's place in its shard.

    Places are gapless from 0: a slot's rows come after those of the shard's
    smaller slots, so only one slot's rows are ever numbered in one task.
    """
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = slot_map.join(loads.select("vslot", "rows"), "vslot", "left").select(
        "vslot", "shard", F.coalesce(F.sum(F.coalesce("rows", F.lit(0))).over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32")
    numbered = records.select("*", (F.row_number().over(within) - 1).alias("_n"))
    # bounded: one row per virtual slot
    return numbered.join(F.broadcast(places), "vslot").select(
        *records.columns, "shard", (F.col("_first") + F.col("_n")).cast("bigint").alias("slot"))


def records_of(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Key, size, checksum, slot and row number of every document; texts stay
    behind.  Store the result before use: row numbers follow the partitions."""
    text = F.col("text").cast("binary")
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("bigint").alias("text_crc32"),
        slot_of(F.col("doc_id"), n_slots).alias("vslot"), F.monotonically_increasing_id().alias("row"))
