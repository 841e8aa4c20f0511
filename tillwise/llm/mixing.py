"""Mixing sources to target weights with a splitting tree.

Each source's documents are hashed into a fixed number of blocks.  A source's
target gives its block quota: whole passes over all blocks plus a permuted
selection for the rest.  A multivariate-hypergeometric splitting tree then
divides the exact quotas among the output shards: the root holds the quotas,
every inner node draws how many blocks of each source go to its left half,
the leaves hold exact counts per source.  Shards take disjoint ranges of each
source's permuted blocks, and rows are shuffled inside their shard only.

All tables beside the documents are bounded: one row per source, or at most
``n_blocks`` rows per source.  Draws are seeded by source, block and node, so
reruns agree.

Defined results for odd input: a null text has no words; a null source is a
source of its own, last in order; rows with a null or repeated id fall into
the id's block; a source without words has target 0; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.plans.lineage import cut_lineage

N_BLOCKS = 4096
#: Words of an output shard; there are at least LEAST_SHARDS shards.
SHARD_WORDS, LEAST_SHARDS = 1 << 24, 16
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_PASSES = 2
SEED = 20
#: Rows of the block table that may be broadcast: about 64 MB (measured: 180 bytes a row).
BROADCAST_ROWS = 350_000


def block_of(key: Column, n_blocks: int = N_BLOCKS, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n_blocks)).cast("int")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = TOTAL_SHARE,
            most: int = MOST_PASSES) -> DataFrame:
    """``source, source_size`` with ``target``: ``share`` of all sizes by
    weight, no target above ``most`` times its size; the excess goes to the
    others by weight (the water level of the open sources).  One row per
    source."""
    ranked = sources.select("*", (F.row_number().over(
        Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("_rank"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    size = F.col("source_size").cast("double")
    w = ranked.select("*", weight.alias("_w"), (most * size).alias("_cap"))
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    earlier, later = (by_room.rowsBetween(Window.unboundedPreceding, -1),
                      by_room.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum(size).over(everything) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) \
        / F.sum("_w").over(later)
    w = w.select("*", level.alias("_level"))
    # the first open source in order of room gives the level of all open ones
    settled = F.first(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level")), ignorenulls=True).over(
        by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    w = w.select("*", settled.alias("_settled"))
    return w.select("source", "source_size", F.least(F.col("_cap"), F.coalesce(F.col("_settled") * F.col("_w"),
                                                                               F.col("_cap"))).alias("target"))


def _permuted(source, blocks: np.ndarray, seed: int) -> np.ndarray:
    """A seeded order of the blocks, the same whatever order they come in."""
    name = -1 if source is None else int.from_bytes(str(source).encode()[:64], "little")
    keys = np.random.default_rng([seed, abs(name), name < 0]).random(int(blocks.max()) + 1)
    return np.lexsort((blocks, keys[blocks]))


def select_blocks(words: np.ndarray, target: float, most: int = MOST_PASSES) -> np.ndarray:
    """Copies of each block (in its permuted order): whole passes, then blocks
    from the front while they fit, then any later ones that still fit; at last
    one block is added or exchanged if that ends nearer to the target."""
    total = int(words.sum())
    copies = np.zeros(len(words), dtype=np.int64)
    if total == 0:
        return copies
    whole = int(np.floor(target / total + 1e-9))
    copies += whole
    room = target - whole * total
    for i, size in enumerate(words):
        if 0 < size <= room:
            copies[i] += 1
            room -= size
    # nearest end: one more block, or one drawn block given up for another
    drawn, left = np.flatnonzero(copies > whole), np.flatnonzero((copies == whole) & (words > 0))
    if whole < most and len(left):
        given = np.concatenate([[0], words[drawn]])
        by_size = np.argsort(given, kind="stable")
        wanted = words[left] - room
        at = np.clip(np.searchsorted(given[by_size], wanted), 1, max(1, len(given) - 1))
        best = (abs(room), -1, -1)
        for side in (at - 1, np.minimum(at, len(given) - 1)):
            gap = np.abs(wanted - given[by_size][side])
            i = int(np.argmin(gap))
            best = min(best, (float(gap[i]), int(left[i]), int(by_size[side][i])))
        if best[1] >= 0:
            copies[best[1]] += 1
            if best[2] > 0:
                copies[drawn[best[2] - 1]] -= 1
    return copies


def _draw(seed: int):
    def draw(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        """Copies and permuted places of one source's blocks (at most n_blocks rows)."""
        blocks = blocks.iloc[_permuted(key[0] if pd.notna(key[0]) else None, blocks["block"].to_numpy(), seed)]
        copies = select_blocks(blocks["words"].to_numpy(), float(blocks["target"].iloc[0]))
        return blocks.assign(copies=copies)
    return draw


def split_quotas(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Counts per (shard, source): the splitting tree from root to leaves.

    Every shard gets an equal number of blocks (at most one apart); each
    node's draw is seeded by its shard range."""
    out = np.zeros((n_shards, len(quotas)), dtype=np.int64)
    total = int(quotas.sum())
    capacity = np.full(n_shards, total // n_shards, dtype=np.int64)
    capacity[: total % n_shards] += 1
    todo = [(0, n_shards, quotas.astype(np.int64))]
    while todo:
        lo, hi, held = todo.pop()
        if hi - lo == 1:
            out[lo] = held
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(held, int(capacity[lo:mid].sum()), method="marginals")
        todo += [(lo, mid, left), (mid, hi, held - left)]
    return out


def _tree(shard_words: int, seed: int):
    def tree(sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", na_position="last", ignore_index=True)
        n_shards = max(LEAST_SHARDS, int(np.ceil(sources["taken"].sum() / shard_words)))
        counts = split_quotas(sources["quota"].to_numpy(), n_shards, seed)
        ends = counts.cumsum(axis=0)
        return pd.DataFrame({"source": sources["source"], "ends": [ends[:, i].tolist() for i in range(len(sources))]})
    return tree


def _deal(seed: int):
    def deal(key: tuple, blocks: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """Shard lists of one source's blocks: disjoint ranges of its permuted draws."""
        name = key[0] if pd.notna(key[0]) else None
        blocks = blocks.iloc[_permuted(name, blocks["block"].to_numpy(), seed)]
        copies = blocks["copies"].to_numpy()
        drawn = np.repeat(np.arange(len(blocks)), copies)
        nth = np.arange(len(drawn)) - np.repeat(np.cumsum(copies) - copies, copies)
        drawn = drawn[np.lexsort((drawn, nth))]  # the first pass over all blocks, then the second
        cuts = np.asarray(ends["ends"].iloc[0] if len(ends) else [0], dtype=np.int64)
        shard = np.searchsorted(cuts, np.arange(len(drawn)), side="right")
        lists: list[list[int]] = [[] for _ in range(len(blocks))]
        for b, s in zip(drawn.tolist(), shard.tolist()):
            lists[b].append(s)
        return blocks.assign(shards=lists)[["source", "block", "source_size", "target", "copies", "shards"]]
    return deal


def block_plan(rows: DataFrame, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """``source, block, source_size, target, copies, shards`` of every block,
    from rows of ``source, block, size``."""
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words"))
    sources = targets(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    b, s = blocks.alias("b"), sources.alias("s")
    known = b.join(s, F.col("b.source").eqNullSafe(F.col("s.source"))).select(
        "b.source", "block", "words", "source_size", "target")
    drawn = known.groupBy("source").applyInPandas(
        _draw(seed), "source string, block int, words bigint, source_size bigint, target double, copies bigint")
    drawn = cut_lineage(drawn)
    quotas = drawn.groupBy("source").agg(F.sum("copies").alias("quota"),
                                         F.sum(F.col("copies") * F.col("words")).alias("taken"))
    ends = quotas.groupBy().applyInPandas(_tree(shard_words, seed), "source string, ends array<bigint>")
    return drawn.groupBy("source").cogroup(ends.groupBy("source")).applyInPandas(
        _deal(seed), "source string, block int, source_size bigint, target double, copies bigint, shards array<bigint>")


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join on (source, block), nulls equal; the plan is broadcast if its
    counted rows are within the bound, and is shuffled with the rows beyond it."""
    plan = cut_lineage(plan.withColumnsRenamed({"source": "_psource", "block": "_pblock"}))
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    return rows.join(plan, (F.col("_block") == F.col("_pblock")) & F.col("_source").eqNullSafe(F.col("_psource")))


def mix(docs: DataFrame, size: Column, source_col: str = "source", key_col: str = "doc_id",
        shard_words: int = SHARD_WORDS, n_blocks: int = N_BLOCKS, seed: int = SEED) -> DataFrame:
    """Every row of ``docs`` as struct ``row``, with ``size, source_size,
    target, copies`` and ``shards``, the output shard of each copy (empty: the
    row is not drawn)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), size.alias("size"),
                       F.col(f"`{source_col}`").cast("string").alias("_source"),
                       block_of(F.col(f"`{key_col}`"), n_blocks, seed).alias("_block"))
    sizes = cut_lineage(rows.groupBy("_source", "_block").agg(F.sum("size").alias("size")))
    plan = block_plan(sizes.select(F.col("_source").alias("source"), F.col("_block").alias("block"), "size"),
                      shard_words, seed)
    return _with_plan(rows, plan).select("row", "size", "source_size", "target", "copies", "shards")


def draws(mixed: DataFrame) -> DataFrame:
    """One row per drawn copy: the columns of the documents, unordered."""
    return mixed.select("row", F.explode("shards").alias("_shard")).select("row.*")


def shuffled_shards(mixed: DataFrame, key_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The mixture dealt by shard and shuffled inside each shard: one row per
    drawn copy, the documents' columns as struct ``row`` with ``copy`` and
    ``shard``.  A shard's order is that of a seeded hash; its rows come in
    pieces, each a range of that order, so a shard is written by several tasks."""
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece_bits = max(0, (-(-n // LEAST_SHARDS) - 1).bit_length())
    place = F.xxhash64(f"row.{key_col}", "copy", F.lit(seed + 1))
    rows = mixed.select("row", F.posexplode("shards").alias("copy", "shard")).withColumn("_place", place)
    piece = F.shiftright("_place", 64 - piece_bits) if piece_bits else F.lit(0)
    rows = rows.withColumn("_piece", piece)
    return rows.repartition("shard", "_piece").sortWithinPartitions("shard", "_place").drop("_place", "_piece")
