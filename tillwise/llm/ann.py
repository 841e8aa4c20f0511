"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Index: vectors are centred on the mean of all vectors, rotated by a seeded
random rotation and kept as one sign bit per dimension, with two correction
scalars (the length of the centred vector and the alignment of its unit
vector with its code).  Search: inner products are estimated from the bits;
the best estimates are scored exactly, and every vector whose estimate plus
error bound reaches the k-th exact score is scored on the original vectors
too.  The bound is ``epsilon`` standard deviations of the estimate's error,
so a neighbour is missed with a chance of about 3e-5 each at the default.

Queries and rows meet in blocks of bounded size, (row block, query block) a
task; each task returns its ``k`` best per query, and a window with a partial
limit merges them.  There are no buckets to overflow: every row is searched.

Defined results for odd input: vectors that are null, empty, zero or hold
null or non-finite components take no part, nor do rows without an id;
vectors meet vectors of their own dimension only; rows with a query's id are
never its neighbours; repeated query rows are one query; repeated candidate
rows are candidates each; ties go to the smaller id; a query without
candidates has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.plans.lineage import cut_lineage

K = 20
EPSILON = 4.0
SEED = 5
#: Rows of a row block and of a query block; at least LEAST_BLOCKS row blocks.
BLOCK_ROWS, BLOCK_QUERIES, LEAST_BLOCKS = 1 << 16, 1 << 13, 16
_CHUNK = 1 << 21


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random rotation of ``d`` dimensions (the same everywhere)."""
    q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Packed sign bits, lengths and alignments of the rows of ``x``."""
    rest = x - centre
    length = np.sqrt((rest * rest).sum(axis=1))
    unit = rest / np.where(length > 0, length, 1.0)[:, None] @ turn
    bits = unit > 0
    aligned = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(bits, axis=1), length, np.where(length > 0, aligned, 1.0)


def estimates(queries: np.ndarray, codes: np.ndarray, length: np.ndarray, aligned: np.ndarray, centre: np.ndarray,
              turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x rows) and their error bounds."""
    left, right = _factors(queries, codes, length, aligned, centre, turn, epsilon)
    return left[:, :-1] @ right[:-1], left[:, -1:] * right[-1:]


def _factors(queries: np.ndarray, codes: np.ndarray, length: np.ndarray, aligned: np.ndarray, centre: np.ndarray,
             turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product is estimate plus bound: the scaled signs, a
    row of ones for the centre's share, and last the rows' error factors."""
    d = queries.shape[1]
    signs = np.unpackbits(codes, axis=1, count=d).astype(np.float32).T * np.float32(2) - np.float32(1)
    signs *= (length / (aligned * np.sqrt(d))).astype(np.float32)
    spread = length * np.sqrt(np.maximum(0.0, 1 - aligned ** 2)) / aligned / np.sqrt(max(d - 1, 1))
    # the last term covers rounding of the single-precision estimate
    error = epsilon * spread + 1e-5 * (length + np.sqrt((centre * centre).sum()))
    norm = np.sqrt((queries * queries).sum(axis=1))
    left = np.column_stack([queries @ turn, queries @ centre, norm]).astype(np.float32)
    return left, np.vstack([signs, np.ones(len(length)), error]).astype(np.float32)


def exact(x: np.ndarray, xi: np.ndarray, q: np.ndarray, qi: np.ndarray) -> np.ndarray:
    """Inner products of row pairs in double precision, summed from the first
    dimension on (so equal vectors have equal scores)."""
    out = np.zeros(len(xi))
    for j in range(x.shape[1]):
        out += x[xi, j] * q[qi, j]
    return out


def _products(x: np.ndarray, xi: np.ndarray, q: np.ndarray, qi: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The same up to rounding, faster: whole rows at a time, in the
    precision of ``x`` and ``q``."""
    return np.concatenate([np.einsum("ij,ij->i", x[xi[i:i + step]], q[qi[i:i + step]])
                           for i in range(0, max(1, len(xi)), step)])


def _same_ids(ids: np.ndarray, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query row, row) of all rows with a query's id."""
    order = np.argsort(ids, kind="stable")
    a, b = (np.searchsorted(ids[order], q_ids, side=s) for s in ("left", "right"))
    query = np.repeat(np.arange(len(q_ids)), b - a)
    nth = np.arange(len(query)) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
    return query, order[a[query] + nth]


def search_block(ids: np.ndarray, x: np.ndarray, codes, length, aligned, q_ids: np.ndarray, q: np.ndarray,
                 centre: np.ndarray, turn: np.ndarray, k: int = K, epsilon: float = EPSILON):
    """The ``k`` best (query row, row, score) of every query in this block.

    One product of the scaled codes gives each row's upper bound.  The rows of
    the largest bounds are scored on the original vectors, and then all rows
    whose bound reaches the ``k``-th of those scores.  What may be among the
    best is scored once more in a fixed order of summation."""
    found = []
    left, right = _factors(q, codes, length, aligned, centre, turn, epsilon)
    own_q, own_x = _same_ids(ids, q_ids)
    sample = 5 * k
    # candidates are told apart in single precision first; this is what that may be off
    rounding = 2e-7 * x.shape[1] * np.sqrt((x * x).sum(axis=1).max(initial=0) * (q * q).sum(axis=1))
    x_short, q_short = x.astype(np.float32), q.astype(np.float32)
    for at in range(0, len(q), step := max(1, _CHUNK // max(1, len(ids)))):
        part, short, slack = q[at:at + step], q_short[at:at + step], rounding[at:at + step]
        bound = left[at:at + step] @ right
        mine = (own_q >= at) & (own_q < at + step)
        bound[own_q[mine] - at, own_x[mine]] = -np.inf
        least = np.full(len(part), -np.inf)
        if len(ids) > sample:
            best = np.argpartition(bound, -sample, axis=1)[:, -sample:]
            rows = np.repeat(np.arange(len(part)), sample)
            scores = np.where(np.isfinite(bound[rows, best.ravel()]), _products(x_short, best.ravel(), short, rows), -np.inf)
            least = np.partition(scores.reshape(-1, sample), -k, axis=1)[:, -k] - slack
        qi, xi = np.nonzero(bound >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
        there = np.isfinite(bound[qi, xi])
        qi, xi = qi[there], xi[there]
        keep = _products(x_short, xi, short, qi) >= (least - slack)[qi]
        qi, xi = qi[keep], xi[keep]
        scores = exact(x, xi, part, qi)
        order = np.lexsort((ids[xi], -scores, qi))
        qi, xi, scores = qi[order], xi[order], scores[order]
        first = np.searchsorted(qi, np.arange(len(part)))
        top = np.arange(len(qi)) - first[qi] < k
        found.append((qi[top] + at, xi[top], scores[top]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _matrix(raw, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[int, np.ndarray] = {}
    counts: dict[int, int] = {}
    for batch in batches:
        for v in batch.column("vector"):
            x = v.values.to_numpy()
            totals[len(x)] = totals.get(len(x), 0.0) + x
            counts[len(x)] = counts.get(len(x), 0) + 1
    if counts:
        dims = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(dims, pa.int32()), pa.array([counts[d] for d in dims], pa.int64()),
             pa.array([totals[d].tolist() for d in dims], pa.list_(pa.float64()))], names=["d", "n", "total"])


def centres(vectors: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Rows and mean vector of each dimension (one short row each)."""
    parts = vectors.select("vector").mapInArrow(_sums, "d int, n bigint, total array<double>")
    sums = parts.select("d", F.posexplode("total").alias("at", "x")).groupBy("d", "at").agg(F.sum("x").alias("x"))
    lists = sums.groupBy("d").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("total"))
    counts = parts.groupBy("d").agg(F.sum("n").alias("n"))
    return {r.d: (r.n, np.array([t.x for t in r.total]) / r.n)
            for r in lists.join(counts, "d").select("d", "n", "total").collect()}


def _encoder(means: dict[int, tuple[int, np.ndarray]], seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column("vector")
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            begin = np.cumsum(sizes) - sizes
            for d in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == d)
                x = flat[(begin[rows][:, None] + np.arange(d)).ravel()].reshape(-1, d)
                turn = turns.setdefault(d, rotation(d, seed))
                codes, length, aligned = encode(x, means[d][1], turn)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32)),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(aligned),
                     pa.array([v.tobytes() for v in x], pa.binary())],
                    names=["vec_id", "d", "code", "length", "aligned", "raw"])
    return run


def index(table: DataFrame, vector_col: str = "embedding", seed: int = SEED):
    """The stored codes of every usable row, and the centres they refer to."""
    vectors = table.filter(F.col("vec_id").isNotNull() & usable(F.col(vector_col))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    means = centres(vectors)
    coded = vectors.mapInArrow(_encoder(means, seed), "vec_id bigint, d int, code binary, length double, "
                                                      "aligned double, raw binary")
    return cut_lineage(coded), means


def _searcher(means: dict[int, tuple[int, np.ndarray]], k: int, epsilon: float, seed: int):
    def run(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "query": [], "vec_id": [], "score": []}
        if len(rows) and len(queries):
            d = int(key[0])
            ids, q_ids = rows["vec_id"].to_numpy(), queries["vec_id"].to_numpy()
            codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
            qi, xi, scores = search_block(
                ids, _matrix(rows["raw"], d), codes, rows["length"].to_numpy(), rows["aligned"].to_numpy(), q_ids,
                _matrix(queries["raw"], d), means[d][1], rotation(d, seed), k, epsilon)
            out = {"query_id": q_ids[qi], "query": queries["query"].to_numpy()[qi], "vec_id": ids[xi], "score": scores}
        return pd.DataFrame(out)
    return run


def search(table: DataFrame, is_query: Column, k: int = K, epsilon: float = EPSILON, vector_col: str = "embedding",
           seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` nearest rows;
    ``is_query`` is a condition on ``vec_id``."""
    coded, means = index(table, vector_col, seed)
    n = sum(c for c, _ in means.values())
    queries = cut_lineage(coded.filter(is_query).select(
        "vec_id", "d", "raw", F.xxhash64("vec_id", "raw").alias("query")).dropDuplicates(["vec_id", "raw"]))
    row_blocks = max(LEAST_BLOCKS, -(-n // BLOCK_ROWS))
    query_blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    rows = coded.withColumn("block", F.pmod(F.xxhash64("vec_id", "raw"), F.lit(row_blocks))).withColumn(
        "q_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>")))
    asked = queries.withColumn("q_block", F.pmod(F.col("query"), F.lit(query_blocks))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)).cast("array<bigint>")))
    keys = ["d", "block", "q_block"]
    best = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(
        _searcher(means, k, epsilon, seed), "query_id bigint, query bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
