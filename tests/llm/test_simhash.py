import re

import numpy as np
import xxhash

from tests.conftest import SF_MID
from tests.llm.conftest import ODD
from tillwise.llm import queries, simhash


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(fps, radius=4):
    """Smallest row number of each row's component, by all pairs."""
    fps, parent = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1:]) <= radius).tolist():
            a, b = find(i), find(i + 1 + j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def near(rng, n_centres, most):
    out = []
    for c in rng.integers(0, 1 << 63, n_centres, dtype=np.uint64).tolist():
        for _ in range(int(rng.integers(1, most))):
            for b in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                c ^= 1 << b
            out.append(c)
    return np.unique(np.array(out, dtype=np.uint64))


def test_fingerprints():
    for text in [*ODD, "A b c", "a b c d", "a b c d e f", "a b c d " * 100, "é\x00 x y z w"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text), text


def test_query_equals_brute_force(spark):
    rows = sorted(queries.op7_simhash_near_dedup(spark, SF_MID).collect())
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    assert [r.fingerprint for r in rows] == [f"{f:016x}" for f in fps]
    assert [r.component_id for r in rows] == [docs[i][0] for i in groups(fps)]


def test_links_by_every_path(spark):
    fps = near(np.random.default_rng(3), 30, 60)
    want = groups(fps)
    frame = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp bigint")
    place = {int(f): i for i, f in enumerate(fps.view(np.int64))}
    for most in (simhash.MAX_BUCKET, 16):  # 16: nearly all buckets go through the chunked way
        rows = simhash.components(simhash.links(frame, most=most)).collect()
        root = {place[r.node]: place[r.root] for r in rows}
        got = [root.get(i, i) for i in range(len(fps))]
        first = {}
        assert [first.setdefault(g, i) for i, g in enumerate(got)] == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and {got[100 + i] for i in range(30)} == {100}


def test_odd_rows_and_keep_one(spark, docs_of):
    texts = [(i, t, "s") for i, t in enumerate(ODD)] + [(None, "one", "s"), (None, "lonely text", "s"), (3, "one", "s")]
    docs = docs_of(texts).selectExpr("*", "1 as fp", "2 as root", "3 as component_id", "4 as _k1")
    out = simhash.near_duplicates(docs)
    by = {(r.doc_id, r.fp): r.component_id for r in out.collect()}
    assert out.count() == len(texts)
    assert by[0, 0] == by[1, 0] == by[2, 0] == 0 and by[4, simhash_signed("one")] == 3
    assert by[None, simhash_signed("one")] == 3 and by[None, simhash_signed("lonely text")] is None
    kept = simhash.keep_one(docs.drop("_k1"))
    assert kept.columns == docs.drop("_k1").columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [
        (False, 0), (False, 3), (False, 5), (False, 6), (False, 7), (True, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs_of([])).count() == 0


def simhash_signed(text):
    return int(np.array([plain_fingerprint(text)], dtype=np.uint64).view(np.int64)[0])
