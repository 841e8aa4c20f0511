import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_MID
from tests.llm.conftest import ODD
from tillwise.llm import mixing, queries
from tillwise.llm.words import word_count


def fill(sizes):
    """Targets by repeated resharing, in the order of the sources."""
    weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
    total, capped = 1.5 * sum(sizes), set()
    while True:
        room = total - sum(2 * sizes[i] for i in capped)
        w = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        goals = [2 * s if i in capped else room * weights[i] / w for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in capped and goals[i] > 2 * s}
        if not over:
            return goals
        capped |= over


def test_targets_match_repeated_resharing(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 17):
        sizes = rng.integers(1, 10_000, n).tolist()
        names = sorted(f"s{i}" for i in range(n - 1)) + [None]
        got = mixing.targets(spark.createDataFrame(list(zip(names, sizes)), "source string, source_size bigint"))
        by = {r.source: r.target for r in got.collect()}
        assert np.allclose([by[x] for x in names], fill(sizes))


def test_splitting_tree_is_exact_and_seeded():
    quotas = np.array([1000, 3, 0, 517])
    out = mixing.split_quotas(quotas, 7, 1)
    assert (out.sum(axis=0) == quotas).all() and np.ptp(out.sum(axis=1)) <= 1 and (out >= 0).all()
    assert (out == mixing.split_quotas(quotas, 7, 1)).all() and not (out == mixing.split_quotas(quotas, 7, 2)).all()


def test_query_targets_and_reruns(spark):
    rows = queries.op2_mixing(spark, SF_MID).collect()
    again = queries.op2_mixing(spark, SF_MID).collect()
    assert sorted(rows) == sorted(again)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = {}
    for r in rows:
        assert r.size == len(docs[r.doc_id].text.encode().split()) and r.taken <= 2 * r.size
        by.setdefault(docs[r.doc_id].source, []).append(r)
    goals = fill([sum(r.size for r in by[s]) for s in sorted(by)])
    for s, goal in zip(sorted(by), goals):
        assert abs(by[s][0].target - goal) < 1e-6 and by[s][0].source_size == sum(r.size for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - goal) <= 0.01 * goal


def test_shards_hold_each_draw_once(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    mixed = mixing.mix(docs, word_count(F.col("text")), shard_words=20_000).cache()
    drawn = mixed.select(F.sum(F.size("shards")), F.sum("copies")).first()
    assert drawn[0] == drawn[1] > 0
    dealt = mixing.shuffled_shards(mixed)
    assert dealt.columns == ["row", "copy", "shard"] and dealt.count() == drawn[0]
    per = dealt.groupBy("shard").count().collect()
    assert len(per) > mixing.LEAST_SHARDS
    assert mixing.draws(mixed).columns == docs.columns and mixing.draws(mixed).count() == drawn[0]


def test_shards_come_from_the_tree(spark):
    """On the given tables as they are: 16 shards of equally many blocks, the
    blocks of each source as the tree deals them, whole blocks together."""
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = docs.select(F.col("source"), mixing.block_of(F.col("doc_id")).alias("block"), word_count(F.col("text")).alias("size"))
    plan = mixing.block_plan(rows).collect()
    held = {}
    for r in plan:
        assert len(r.shards) == r.copies
        for s in r.shards:
            held.setdefault(r.source, np.zeros(16, dtype=int))[s] += 1
    names = sorted(held)
    quotas = np.array([held[s].sum() for s in names])
    assert (np.array([held[s] for s in names]).T == mixing.split_quotas(quotas, 16, mixing.SEED)).all()
    assert np.ptp(sum(held.values())) <= 1
    by_block = {(r.source, r.block): r.shards for r in plan}
    blocks = {r.doc_id: (r.source, r.block) for r in docs.select(
        "doc_id", "source", mixing.block_of(F.col("doc_id")).alias("block")).collect()}
    got = queries.op2_mixing(spark, SF_MID).collect()
    assert {r.doc_id: r.shards for r in got} == {d: by_block[b] for d, b in blocks.items()}
    order = [(r.shard, r.row.doc_id) for r in mixing.shuffled_shards(mixing.mix(docs, word_count(F.col("text")))).collect()]
    first = [d for s, d in order if s == order[0][0]]
    assert len(first) > 20 and first != sorted(first) and sorted(first) == sorted(
        d for d, b in blocks.items() for s in by_block[b] if s == order[0][0])


def test_odd_rows(spark, docs_of):
    docs = docs_of([(i, t, None) for i, t in enumerate(ODD)] + [(None, "a b", "z"), (None, "a b", "z"), (3, None, "q")])
    docs = docs.selectExpr("*", "1 as size", "2 as row", "3 as copies", "4 as block")
    out = mixing.mix(docs, word_count(F.col("text"))).collect()
    assert len(out) == docs.count()
    by = {r.row.source: r for r in out}
    assert by["q"].target == 0 and by["q"].source_size == 0 and by["z"].source_size == 4
    assert mixing.draws(mixing.mix(docs, word_count(F.col("text")))).columns == docs.columns
    assert mixing.mix(docs.limit(0), word_count(F.col("text"))).count() == 0
