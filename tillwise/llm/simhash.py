"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are compared only where two of six bit ranges agree (radius 4
leaves two of any six untouched, so no link is lost).  Inside such a bucket
the fingerprints are stored vertically: bit plane ``b`` of a block holds bit
``b`` of 64 fingerprints in one machine word.  A fingerprint is compared with
a whole block at once: each plane adds its differences to 64 distances held
in carry-save counters, and a block is abandoned once all its distances
exceed the radius.  A bucket gives spanning edges, not pairs; buckets beyond
``MAX_BUCKET`` are compared as pairs of chunks in tasks of their own, with
nothing left out.  Components come from alternating star contractions, whose
rounds are cut with reliable checkpoints.

Equal fingerprints are one node, so groups of exact copies cost nothing.

Defined results for odd input: a null or blank text has no shingles and
fingerprint zero, which links like any other; a text under ``width`` words
is one shingle; rows with a null id take part and never give a component its
id unless it has no other (then the id is null); repeated rows link to each
other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.plans.lineage import cut_lineage

WIDTH = 4
RADIUS = 4
SEED = 42
#: Bit ranges beyond the radius that must agree: more ranges, smaller buckets.
AGREEING = 2
#: Fingerprints of a bucket compared in one task; larger buckets go in chunks.
MAX_BUCKET = 1 << 15
_SLICE = 1 << 19
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# --- fingerprints -------------------------------------------------------------

def fingerprint(text: str | None, width: int = WIDTH, seed: int = SEED) -> int:
    """The majority bits of the shingles' XXH64 (ASCII letters lower-cased)."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: len(words) - width + 1].tolist(), end[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last)), dtype=np.uint64, count=len(first))
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 255 * 256):  # 255 rows fit a byte's count
        bits = np.unpackbits(h[at:at + 255 * 256].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * counts > len(h), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``fp`` (the fingerprint as bigint)."""
    carried = [f for f in docs.schema.fields if f.name not in (text_col, "fp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(text_col)),
                             dtype=np.uint64, count=batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in carried], pa.array(fp)],
                                             names=[*[f.name for f in carried], "fp"])

    names = [f.name for f in carried]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in carried], "fp bigint"])
    return docs.select(*[F.col(f"`{n}`") for n in names], text_col).mapInArrow(run, schema)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- comparison inside buckets ---------------------------------------------------

def bucket_keys(fp: Column, radius: int = RADIUS, agreeing: int = AGREEING) -> Column:
    """Array of bucket keys: the table's number above the bits of its ranges."""
    n = radius + agreeing
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    widest = max(b - a for a, b in zip(cuts, cuts[1:])) * agreeing
    keys = []
    for table, chosen in enumerate(combinations(range(n), agreeing)):
        key = F.lit(table).cast("bigint")
        for r in chosen:
            width = cuts[r + 1] - cuts[r]
            key = F.shiftleft(key, width).bitwiseOR(
                F.shiftrightunsigned(fp, cuts[r]).bitwiseAND(F.lit((1 << width) - 1).cast("bigint")))
        keys.append(F.lit(table).cast("bigint") * F.lit(1 << widest).cast("bigint") + key.bitwiseAND(
            F.lit((1 << widest) - 1).cast("bigint")))
    return F.array(*keys)


def _near_lanes(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray, radius: int):
    """(row, block, mask) of every row and block of its bucket that holds a
    later row within the radius; ``mask`` marks those lanes."""
    lane = np.arange(len(fps)) - np.repeat(starts, sizes)
    n_blocks = (sizes + 63) // 64
    first_block = np.cumsum(n_blocks) - n_blocks
    block = np.repeat(first_block, sizes) + lane // 64
    new = np.flatnonzero(np.diff(block, prepend=-1))
    bit = (lane % 64).astype(np.uint64)
    planes = np.empty((64, len(new)), dtype=np.uint64)
    for b in range(64):
        planes[b] = np.bitwise_or.reduceat(((fps >> np.uint64(b)) & np.uint64(1)) << bit, new)
    in_last = np.bincount(block).astype(np.uint64)  # lanes in use
    unused = np.where(in_last == 64, np.uint64(0), _ALL << (in_last % np.uint64(64)))
    own = (_ALL >> (np.uint64(63) - bit))  # the row itself and earlier lanes
    todo = np.repeat(first_block + n_blocks, sizes) - block  # own block and later ones
    ends = np.cumsum(todo)
    depth = max(1, int(radius).bit_length())
    bias = (1 << depth) - 1 - radius
    found = []
    at = 0
    while at < len(fps):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _SLICE, side="right")))
        row = np.repeat(np.arange(at, upto), todo[at:upto])
        nth = np.arange(len(row)) - np.repeat(np.cumsum(todo[at:upto]) - todo[at:upto], todo[at:upto])
        blk = block[row] + nth
        dead = unused[blk] | np.where(nth == 0, own[row], np.uint64(0))
        count = [np.full(len(row), _ALL if bias >> k & 1 else 0, dtype=np.uint64) for k in range(depth)]
        value = fps[row]
        for b in range(64):
            carry = planes[b][blk] ^ (np.uint64(0) - ((value >> np.uint64(b)) & np.uint64(1)))
            for k in range(depth):  # carry-save: out of the top means beyond the radius
                count[k], carry = count[k] ^ carry, count[k] & carry
            dead |= carry
            if b % 8 == 7:
                live = dead != _ALL
                if 4 * np.count_nonzero(live) < 3 * len(live):  # abandon blocks
                    row, blk, dead, value = row[live], blk[live], dead[live], value[live]
                    count = [c[live] for c in count]
                    if not len(row):
                        break
        live = dead != _ALL
        found.append((row[live], blk[live], ~dead[live]))
        at = upto
    rows, blocks, masks = (np.concatenate(x) for x in zip(*found))
    return rows, blocks - np.repeat(first_block, sizes)[rows], masks


def spanning_edges(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[list[int], list[int]]:
    """Star edges that connect, bucket by bucket, all fingerprints joined by
    links within the bucket.  Rows are sorted by key; ``fps`` is uint64."""
    starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1 if len(keys) else 0)) if len(keys) else np.array([], int)
    sizes = np.diff(np.append(starts, len(keys)))
    several = np.repeat(sizes > 1, sizes)
    fps, sizes = fps[several], sizes[sizes > 1]
    if not len(fps):
        return [], []
    starts = np.cumsum(sizes) - sizes
    rows, blocks, masks = _near_lanes(fps, starts, sizes, radius)
    bucket = np.searchsorted(starts, rows, side="right") - 1
    order = np.lexsort((rows, bucket))
    near: dict[int, dict[int, int]] = {}
    for g, r, b, m in zip(bucket[order].tolist(), rows[order].tolist(), blocks[order].tolist(), masks[order].tolist()):
        of = near.setdefault(g, {})
        of[r] = of.get(r, 0) | m << 64 * b
    left, right = [], []
    for g, of in near.items():
        start = int(starts[g])
        groups: list[int] = []  # lanes joined so far, as bit sets
        for r, lanes in of.items():
            lanes |= 1 << (r - start)
            apart = []
            for other in groups:
                if other & lanes:
                    lanes |= other
                else:
                    apart.append(other)
            groups = [*apart, lanes]
        for lanes in groups:
            root = -1
            raw = np.frombuffer(lanes.to_bytes((lanes.bit_length() + 7) // 8, "little"), dtype=np.uint8)
            members = fps[start + np.flatnonzero(np.unpackbits(raw, bitorder="little"))].view(np.int64)
            root = int(members.min())
            others = members[members != root].tolist()
            left += [root] * len(others)
            right += others
    return left, right


def _compare(radius: int, most: int | None):
    """Partition function over (key, fp) sorted by key -> (a, b, overflow).

    ``overflow`` rows are (key, fp) of buckets with more than ``most`` rows."""
    def out(a, b, overflow: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), overflow))],
            names=["a", "b", "overflow"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.array([], np.int64), np.array([], np.int64), None
        for batch in batches:
            k = np.concatenate([keys, batch.column("key").to_numpy()])
            f = np.concatenate([fps, batch.column("fp").to_numpy()])
            if over is not None:
                n = int(np.searchsorted(k, over, side="right"))
                if n:
                    yield out(k[:n], f[:n], True)
                k, f = k[n:], f[n:]
                over = over if not len(k) else None
            done = int(np.searchsorted(k, k[-1], side="left")) if len(k) else 0
            if done >= _SLICE // 4 or len(k) - done > (most or len(k)):
                yield from pieces(k[:done], f[:done])
                k, f = k[done:], f[done:]
                if most is not None and len(k) > most:
                    over = int(k[0])
                    yield out(k, f, True)
                    k, f = k[:0], f[:0]
            keys, fps = k, f
        yield from pieces(keys, fps)

    def pieces(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if most is not None and len(k):
            at = np.flatnonzero(np.diff(k, prepend=k[0] - 1))
            size = np.diff(np.append(at, len(k)))
            large = np.repeat(size > most, size)
            if large.any():
                yield out(k[large], f[large], True)
                k, f = k[~large], f[~large]
        if len(k):
            a, b = spanning_edges(k, f.view(np.uint64), radius)
            if a:
                yield out(np.array(a), np.array(b), False)

    return run


def links(distinct: DataFrame, radius: int = RADIUS, agreeing: int = AGREEING, most: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) whose components are those of all links within the radius."""
    schema = "a bigint, b bigint, overflow boolean"
    keyed = distinct.select("fp", F.explode(bucket_keys(F.col("fp"), radius, agreeing)).alias("key"))
    first = cut_lineage(keyed.select("key", "fp").repartition("key").sortWithinPartitions("key")
                        .mapInArrow(_compare(radius, most), schema))
    edges, large = first.filter("not overflow").select("a", "b"), first.filter("overflow").select(
        F.col("a").alias("key"), F.col("b").alias("fp"))
    if large.isEmpty():
        return edges
    # all chunks of a large bucket against each other, a pair of chunks a task
    chunks = large.groupBy("key").agg(F.ceil(F.count(F.lit(1)) * 2 / F.lit(most)).alias("n"))
    dealt = large.join(chunks, "key").withColumn("c", F.pmod(F.xxhash64("fp"), "n")).select(
        "key", "fp", "c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("d"))
    pairs = dealt.select(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("key"), "fp")
    more = pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(radius, None), schema)
    return edges.unionByName(cut_lineage(more.select("a", "b")))


# --- components -------------------------------------------------------------------

def spread(df: DataFrame, col: str) -> DataFrame:
    """Deal rows by another hash, so that a join on ``col`` has a plain
    exchange on this side too and hot keys can be split at run time."""
    return df.repartition(F.xxhash64(F.lit(7), F.col(col)))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges``, root the smallest node."""
    def checked(e: DataFrame):
        e = cut_lineage(e.distinct())
        return e, tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    now, mark = checked(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = spread(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "u")
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large)
        low = spread(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        down = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = down.unionByName(low.select("u", F.col("m").alias("v")))
        now, last = checked(small)
        if last == mark:
            break
        mark = last
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def grouped(rows: DataFrame, radius: int = RADIUS, agreeing: int = AGREEING) -> DataFrame:
    """``rows`` (``doc_id, fp, ...``; materialised) with ``component_id``, the
    smallest id reachable over links, and ``root``, the group's own key."""
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("_first")))
    member = cut_lineage(components(links(distinct, radius, agreeing)))
    near = spread(member, "node").join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "_first")
    near = cut_lineage(near)
    named = spread(near.groupBy("root").agg(F.min("_first").alias("_named")), "root")
    near = near.join(named, "root").select(F.col("fp").alias("_fp"), "root", "_named")
    table = distinct.join(near, F.col("fp") == F.col("_fp"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"),
        # a group whose ids are all null has none
        F.when(F.col("root").isNull(), F.col("_first")).otherwise(F.col("_named")).alias("component_id"))
    return rows.join(spread(table, "_fp"), F.col("fp") == F.col("_fp")).select(*rows.columns, "root", "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, root, component_id`` of every row."""
    rows = cut_lineage(fingerprints(docs.select("doc_id", "text"), width))
    return grouped(rows, radius)


def keep_one(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group: that with the smallest id.

    Repeated rows are one document; only their copies are dropped here too.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = [F.xxhash64("doc_id", "text").alias("_k1"), F.coalesce("doc_id", F.lit(-1)).alias("_k2")]
    rows = cut_lineage(fingerprints(docs.select("doc_id", "text", *key), width))
    best = grouped(rows, radius).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "_k2", "_k1")).alias("b"))
    keep = best.select(F.col("b._k1").alias("_k1"), F.col("b._k2").alias("_k2")).distinct()
    kept = docs.select(F.struct(*columns).alias("_row"), *key).join(keep, ["_k1", "_k2"], "left_semi")
    return kept.dropDuplicates(["_k1", "_k2"]).select("_row.*")
