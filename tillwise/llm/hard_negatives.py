"""Hard negatives by an inverted multi-index.

Index: rows lie in blocks of bounded size.  In each block the two halves of
the vectors have a codebook each; a row's pair of codes is its cell, and
every code keeps the radius of its members.  For an anchor a half score is
at most (anchor half) . (code) + |anchor half| * radius, so the sum over the
two halves bounds every row of a cell.  A multi-sequence heap visits the
cells by falling bound; a search ends once the bound of the next cell lies
below everything that could still enter its result, so results are exact.

Two searches run over the stored index: the best rows of the anchor's own
label (positives), then per positive the best rows of other labels whose
score lies in the window ``LOW`` to ``HIGH`` percent of the positive's.  A
block's index comes to a task first and the anchors stream past it; only
anchors are copied from block to block, never rows.

Scores are inner products of the vectors' components times ``SCALE``, rounded
down, in whole numbers.

Defined results for odd input: rows with a null id, label or vector, or with
null or non-finite components take no part, nor do rows whose squared length
(in scaled components) reaches 2**55, beyond which scores outgrow 64 bits;
vectors meet vectors of their own dimension only (empty ones score 0); rows
with the anchor's id are not its partners; repeated anchor rows are one
anchor; other repeated rows count each; ties go to the smaller id; anchors
without partners have no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.plans.lineage import cut_lineage

# --- fixed values: the contract's numbers --------------------------------------
SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
LARGEST = float(1 << 55)
#: Bytes of packed vectors in a block; there are at least LEAST_BLOCKS blocks.
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 12
#: A half's codebook: about one code per sqrt(rows / CELL_ROWS), fitted on FIT_ROWS rows of its block.
CELL_ROWS, MOST_CODES, FIT_ROWS, FIT_ROUNDS = 64, 64, 4096, 5
#: Rows scored between two looks at the stopping rule.
_STEP = 512
_INDEX = {"d": "int", "block": "int", "ids": "binary", "labels": "binary", "item": "int", "raw": "binary",
          "cells": "binary", "codes": "binary", "radii": "binary"}


# -- rows and blocks ---------------------------------------------------------------
def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with scaled whole components in the fewest bytes that hold them."""
    for batch in batches:
        vectors = batch.column("vector")
        sizes = np.diff(vectors.offsets.to_numpy())
        owner = np.repeat(np.arange(len(sizes)), sizes)
        with np.errstate(over="ignore"):
            flat = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False))
            square = np.bincount(owner, weights=flat * flat, minlength=len(sizes))
        largest = np.zeros(len(sizes))
        np.maximum.at(largest, owner, np.abs(flat))
        ends = np.cumsum(sizes)
        keep = np.flatnonzero(square < LARGEST)
        item = np.where(largest < 1 << 15, 2, np.where(largest < 1 << 31, 4, 8))[keep]
        raw = [flat[ends[i] - sizes[i]:ends[i]].astype(f"<i{n}").tobytes() for i, n in zip(keep.tolist(), item.tolist())]
        rows = pa.array(keep)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(rows), batch.column("label").take(rows), pa.array(sizes[keep].astype(np.int32)),
             pa.array(item.astype(np.int32)), pa.array(raw, pa.binary())], names=["vec_id", "label", "d", "item", "raw"])


def scaled_rows(table: DataFrame, vector_col: str = "embedding") -> DataFrame:
    vector = F.col(vector_col)
    return table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(vector)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        vector.cast("array<double>").alias("vector")).mapInArrow(
        _scaled, "vec_id bigint, label bigint, d int, item int, raw binary")


def _codebook(half: np.ndarray, k: int) -> np.ndarray:
    """``k`` codes of the half vectors, by Lloyd's rounds on a spread sample."""
    sample = half[np.linspace(0, len(half) - 1, min(len(half), FIT_ROWS)).astype(np.int64)]
    codes = sample[np.linspace(0, len(sample) - 1, k).astype(np.int64)].copy()
    for _ in range(FIT_ROUNDS):
        near = _nearest(sample, codes)
        count = np.bincount(near, minlength=k)
        for j in range(half.shape[1]):
            total = np.bincount(near, weights=sample[:, j], minlength=k)
            codes[:, j] = np.where(count > 0, total / np.maximum(count, 1), codes[:, j])
    return codes


def _nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.argmin((codes * codes).sum(axis=1) - 2 * (x @ codes.T), axis=1)


class Block:
    """The index of one block: rows sorted by (cell, label, id)."""

    def __init__(self, ids, labels, x, cells, codes, radii):
        self.ids, self.labels, self.x = ids, labels, x
        self.cut = x.shape[1] // 2
        self.codes, self.radii = codes, radii          # of the two halves
        self.k = len(radii[0])
        self.begin = np.searchsorted(cells, np.arange(self.k * self.k + 1))
        self.names, place = np.unique(labels, return_inverse=True)
        self.key = cells * max(1, len(self.names)) + place
        squares = (x.astype(np.float64) ** 2).sum(axis=1)
        self.longest = float(np.sqrt(squares.max(initial=0)))
        self.short = x.astype(np.float64)

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> "Block":
        order = np.lexsort((ids, labels))
        ids, labels, x = ids[order], labels[order], x[order]
        k = int(np.clip(np.sqrt(len(ids) / CELL_ROWS), 1, MOST_CODES))
        cut, near, codes, radii = x.shape[1] // 2, [], [], []
        for half in (x[:, :cut].astype(np.float64), x[:, cut:].astype(np.float64)):
            book = _codebook(half, k)
            code = _nearest(half, book)
            away = np.sqrt(((half - book[code]) ** 2).sum(axis=1))
            radius = np.zeros(k)
            np.maximum.at(radius, code, away)
            near.append(code)
            codes.append(book)
            radii.append(radius)
        cells = near[0] * k + near[1]
        order = np.argsort(cells, kind="stable")
        return cls(ids[order], labels[order], x[order], cells[order], codes, radii)

    def packed(self, item: int) -> dict:
        cells = self.key // max(1, len(self.names))
        return {"ids": self.ids.astype("<i8").tobytes(), "labels": self.labels.astype("<i8").tobytes(), "item": item,
                "raw": self.x.astype(f"<i{item}").tobytes(), "cells": cells.astype("<i4").tobytes(),
                "codes": np.concatenate([c.ravel() for c in self.codes]).astype("<f8").tobytes(),
                "radii": np.concatenate(self.radii).astype("<f8").tobytes()}

    @classmethod
    def unpacked(cls, row: dict) -> "Block":
        d, ids = row["d"], np.frombuffer(row["ids"], "<i8")
        radii = np.frombuffer(row["radii"], "<f8").reshape(2, -1)
        k, cut = radii.shape[1], d // 2
        codes = np.frombuffer(row["codes"], "<f8")
        return cls(ids, np.frombuffer(row["labels"], "<i8"),
                   np.frombuffer(row["raw"], f"<i{row['item']}").reshape(len(ids), d),
                   np.frombuffer(row["cells"], "<i4").astype(np.int64),
                   [codes[:k * cut].reshape(k, cut), codes[k * cut:].reshape(k, d - cut)], list(radii))

    # -- the search --------------------------------------------------------------
    def visit(self, anchor: np.ndarray) -> Iterator[tuple[list[int], float]]:
        """Occupied cells by falling bound, some at a time, each time with the
        bound of all cells not given yet."""
        halves = (anchor[:self.cut].astype(np.float64), anchor[self.cut:].astype(np.float64))
        upper = []
        for half, codes, radius in zip(halves, self.codes, self.radii):
            length = np.sqrt((half * half).sum())
            # rounding of the bound, far below one unit of the whole scores it is held against
            slack = 1e-9 * (length * (np.sqrt((codes * codes).sum(axis=1)) + radius) + 1)
            upper.append(codes @ half + length * radius + slack)
        order = [np.argsort(-u, kind="stable") for u in upper]
        (first, second), (by_first, by_second) = ([u[o].tolist() for u, o in zip(upper, order)],
                                                  [o.tolist() for o in order])
        begin, k = self.begin, self.k
        heap, cells, rows = [(-(first[0] + second[0]), 0, 0)], [], 0
        while heap:
            _, i, j = heapq.heappop(heap)
            if j + 1 < k:
                heapq.heappush(heap, (-(first[i] + second[j + 1]), i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (-(first[i + 1] + second[0]), i + 1, 0))
            cell = by_first[i] * k + by_second[j]
            n = begin[cell + 1] - begin[cell]
            if n:
                cells.append(cell)
                rows += n
            if rows >= _STEP or not heap:
                yield cells, -heap[0][0] if heap else -np.inf
                cells, rows = [], 0

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products in whole numbers: in double precision where no sum
        can leave its 53 bits, else in 64-bit arithmetic."""
        long = anchor.astype(np.float64)
        if self.longest * np.sqrt((long * long).sum()) < 1 << 53:
            return (self.short[rows] @ long).astype(np.int64)
        return self.x[rows].astype(np.int64) @ anchor.astype(np.int64)

    def _ranges(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))

    def positives(self, anchor: np.ndarray, anchor_id: int, label: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``n`` best rows of ``label``."""
        at = int(np.searchsorted(self.names, label))
        if at == len(self.names) or self.names[at] != label:
            return self.ids[:0], self.ids[:0]
        ids, scores = self.ids[:0], self.ids[:0]
        for cells, bound in self.visit(anchor):
            own = np.asarray(cells, dtype=np.int64) * len(self.names) + at
            rows = self._ranges(np.searchsorted(self.key, own, "left"), np.searchsorted(self.key, own, "right"))
            rows = rows[self.ids[rows] != anchor_id]
            ids, scores = _best(np.append(ids, self.ids[rows]), np.append(scores, self.scores(rows, anchor)), n)
            if len(scores) == n and bound < scores[-1]:  # an equal score could come with a smaller id
                break
        return ids, scores

    def negatives(self, anchor: np.ndarray, anchor_id: int, label: int, positive_scores: list[int],
                  n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window, ids and scores of its ``n`` best rows of other labels."""
        none = self.ids[:0]
        windows = [(LOW * p, HIGH * p) for p in positive_scores]
        found = [(none, none)] * len(windows)
        for cells, bound in self.visit(anchor):
            own = np.asarray(cells, dtype=np.int64)
            rows = self._ranges(self.begin[own], self.begin[own + 1])
            rows = rows[(self.labels[rows] != label) & (self.ids[rows] != anchor_id)]
            scores, ids = self.scores(rows, anchor), self.ids[rows]
            certified = True
            for w, (low, high) in enumerate(windows):
                inside = (100 * scores >= low) & (100 * scores <= high)
                if inside.any():
                    found[w] = _best(np.append(found[w][0], ids[inside]), np.append(found[w][1], scores[inside]), n)
                best = found[w][1]
                certified &= bound * 100 < low or high < low or (len(best) == n and bound < best[-1])
            if certified:
                break
        return found


def _best(ids: np.ndarray, scores: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    top = np.lexsort((ids, -scores))[:n]
    return ids[top], scores[top]


# -- the index as a table ------------------------------------------------------------
def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, held = None, []

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            item = max(r["item"] for r in held)
            x = np.zeros((len(held), now[0]), dtype=f"<i{item}")
            for i, r in enumerate(held):
                x[i] = np.frombuffer(r["raw"], f"<i{r['item']}")
            block = Block.build(np.array([r["vec_id"] for r in held], np.int64),
                                np.array([r["label"] for r in held], np.int64), x)
            yield pa.RecordBatch.from_pylist([{"d": now[0], "block": now[1]} | block.packed(item)], schema=_schema())
            held.clear()

    for batch in batches:
        for row in batch.to_pylist():
            key = row["d"], row["block"]
            if key != now:
                yield from close()
                now = key
            held.append(row)
    yield from close()


def _schema() -> pa.Schema:
    return pa.schema([(c, pa.int32() if t == "int" else pa.binary()) for c, t in _INDEX.items()])


def build_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """One row per block of :func:`scaled_rows`, materialised, and the number
    of blocks that a dimension's rows are dealt to."""
    size = rows.agg(F.sum(F.length("raw") + F.lit(16))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64("vec_id", "label", "raw"), F.lit(blocks)).cast("int")
    index = rows.withColumn("block", block).repartition("d", "block").sortWithinPartitions(
        "d", "block", "vec_id", "raw").mapInArrow(_build, ", ".join(f"{c} {t}" for c, t in _INDEX.items()))
    return cut_lineage(index), blocks


def _stream(search, schema: pa.Schema):
    """A task's blocks, each followed by the anchors that ask it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = key = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["ids"] is not None:
                    block, key = Block.unpacked(row), (row["d"], row["block"])
                elif key == (row["d"], row["block"]):
                    out += search(block, np.frombuffer(row["raw"], f"<i{row['item']}"), row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
    return run


def _ask(index: DataFrame, blocks: int, anchors: DataFrame, search, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """``search(block, anchor, row)`` for every anchor and every block of its
    dimension; an anchor is copied once per block, a block never."""
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("ask", F.lit(1))
    both = index.withColumn("ask", F.lit(0)).unionByName(asked, allowMissingColumns=True)
    names = {pa.int64(): "bigint"}
    return both.repartition("d", "block").sortWithinPartitions("d", "block", "ask").drop("ask").mapInArrow(
        _stream(search, pa.schema(fields)), ", ".join(f"{c} {names[t]}" for c, t in fields))


def _find_positives(n: int):
    def search(block: Block, anchor: np.ndarray, row: dict) -> list[dict]:
        ids, scores = block.positives(anchor, row["anchor_id"], row["label"], n)
        return [{"anchor": row["anchor"], "positive_id": i, "positive_score": s}
                for i, s in zip(ids.tolist(), scores.tolist())]
    return search


def _find_negatives(n: int):
    def search(block: Block, anchor: np.ndarray, row: dict) -> list[dict]:
        found = block.negatives(anchor, row["anchor_id"], row["label"], row["windows"], n)
        return [{"anchor": row["anchor"], "positive_score": p, "negative_id": i, "negative_score": s}
                for p, (ids, scores) in zip(row["windows"], found) for i, s in zip(ids.tolist(), scores.tolist())]
    return search


def mine(table: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
         vector_col: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score`` of every row for which ``is_anchor`` (a condition on
    ``vec_id``) holds."""
    whole = pa.int64()
    rows = cut_lineage(scaled_rows(table, vector_col))
    index, blocks = build_index(rows)
    anchors = cut_lineage(rows.filter(is_anchor).dropDuplicates(["vec_id", "label", "raw"]).select(
        F.monotonically_increasing_id().alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "d",
        "item", "raw"))
    near = _ask(index, blocks, anchors, _find_positives(positives),
                [("anchor", whole), ("positive_id", whole), ("positive_score", whole)])
    best = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), "positive_id")
    # the rank keeps repeated positive rows apart
    own = cut_lineage(near.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= positives))
    windows = own.groupBy("anchor").agg(F.collect_set("positive_score").alias("windows"))
    hard = _ask(index, blocks, anchors.join(windows, "anchor"), _find_negatives(negatives),
                [("anchor", whole), ("positive_score", whole), ("negative_id", whole), ("negative_score", whole)])
    ranked = Window.partitionBy("anchor", "positive_score").orderBy(F.col("negative_score").desc(), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= negatives)
    return own.join(hard, ["anchor", "positive_score"]).join(anchors.select("anchor", "anchor_id"), "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
