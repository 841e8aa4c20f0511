import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tillwise.llm import lm_score, queries


def tokens(text):
    return (text or "").encode().lower().split() + [b" end"]


class Exact:
    """The model with exact counts."""
    def __init__(self, training):
        docs = [tokens(t) for t in training]
        self.c = Counter(w for d in docs for w in d)
        self.pairs = Counter(p for d in docs for p in zip([b" start"] + d, d))
        self.n, self.v = sum(self.c.values()), len(self.c)
        self.first = self.c[b" end"]

    def base(self, text):
        return sum(math.log10((self.c[w] + 1) / (self.n + self.v + 1)) for w in tokens(text))

    def score(self, text, weight=lm_score.PAIR_WEIGHT):
        total, d = 0.0, tokens(text)
        for h, w in zip([b" start"] + d, d):
            n = self.first if h == b" start" else self.c[h]
            p = (self.c[w] + 1) / (self.n + self.v + 1)
            total += math.log10((1 - weight) * p + weight * self.pairs[h, w] / n if n else p)
        return total


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def check(rows, docs):
    model = Exact([t for i, t in docs if not is_held(i)])
    for r, (i, t) in zip(rows, docs, strict=True):
        d = tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            is_held(i), len(d), sum(model.c[w] > 0 for w in d), model.n)
        assert abs(r.base_score - model.base(t)) < 1e-6 * max(1, len(d))
        # counts are kept to a factor of two, and rarely a probe is wrong
        assert abs(r.score - model.score(t)) < 0.2 * len(d) + 4, (r.score, model.score(t))
    return model


def test_query_against_exact_counts(spark):
    rows = sorted(queries.op6_lm_scoring(spark, SF_SMALL).collect(), key=lambda r: r.doc_id)
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect())
    check(rows, docs)
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_several_passes_give_the_same_scores(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    one = lm_score.score(docs, lm_score.held_out(F.col("doc_id")))
    more = lm_score.score(docs, lm_score.held_out(F.col("doc_id")), filter_bytes=20_000)
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (one, more))
    assert a == b


def test_filter_never_misses_and_seldom_errs():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    counts = rng.integers(1, 1000, len(h))
    levels = lm_score.levels_of(counts)
    assert (1 << (levels - 1) <= counts).all() and (counts < 1 << levels).all()
    part = lm_score.segment_of(h, 4)
    f = lm_score.Filter.of(4, 0, [lm_score.build_bits(h[part == s], levels[part == s]) for s in range(4)])
    found = f.levels(h)
    assert (found >= levels).all() and (found == levels).mean() > 0.95
    absent = f.levels(rng.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    assert (absent == 0).mean() > 0.95


def test_odd_rows(spark, docs_of):
    texts = [(i, t, "s") for i, t in enumerate(ODD * 3)] + [(None, "one", "s"), (7, "one", "s"), (7, "one", "s")]
    docs = docs_of(texts).selectExpr("*", "1 as key", "2 as score")
    rows = lm_score.score(docs.select("doc_id", "text"), lm_score.held_out(F.col("doc_id"))).collect()
    assert len(rows) == len(texts)
    model = Exact([t for i, t, _ in texts if not is_held(i)])
    want = sorted((is_held(i), len(tokens(t)), round(model.base(t), 6)) for i, t, _ in texts)
    assert sorted((r.held_out, r.n_tokens, round(r.base_score, 6)) for r in rows) == want
    assert all(math.isfinite(r.score) for r in rows)
    assert lm_score.score(docs_of([]).select("doc_id", "text"), F.lit(False)).count() == 0
    none = lm_score.score(docs_of(["a b"]).select("doc_id", "text"), F.lit(True)).first()
    assert (none.train_tokens, none.n_known, none.base_score) == (0, 0, 0.0)


def test_hot_words_are_one_entry_a_packet(spark):
    """What a segment gets does not grow with the documents that share a word."""
    def most(n):
        docs = spark.range(n, numPartitions=2).select(
            F.col("id").alias("key"), F.lit(True).alias("train"), F.lit("the cat and the dog").alias("text"))
        packets = docs.mapInArrow(lm_score._packets(16), lm_score._PACKET)
        blobs = [c for c, kind in packets.dtypes if kind == "binary"]
        size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in blobs), F.lit(0))
        return packets.filter("seg >= 0").groupBy("seg").agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0]
    assert most(20_000) <= most(200) + 2 * 4 * 16


def test_counts_of_many_packets(spark):
    """Exact counts reach every packet, whatever the number of packets and segments."""
    docs = [(i, " ".join(f"w{(i * k) % 37} the" for k in range(i % 9))) for i in range(400)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    rows = sorted(lm_score.score(frame, lm_score.held_out(F.col("doc_id"))).collect(), key=lambda r: r.doc_id)
    check(rows, docs)
