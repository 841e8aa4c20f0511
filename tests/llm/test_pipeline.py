import numpy as np
import pytest

import corpus_pipeline
from tests.conftest import SF_MID
from tests.llm.conftest import ODD
from tests.llm.test_mixing import fill
from tests.llm.test_packing import plain
from tests.llm.test_simhash import groups, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, kept[-1], SF_MID).write.parquet(path)
        kept.append(spark.read.parquet(path))
    return kept


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "mixing", "packing"]
    assert all(sorted(x.columns) == sorted(stages[0].columns) for x in stages[1:4])


def test_rules_keep_clean_documents(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    for r in stages[0].collect():
        long = len(r.text.encode().split()) >= 50
        if labels.get(r.doc_id) == 1 and long:
            assert r.doc_id in kept
        if labels.get(r.doc_id) == 0:
            assert r.doc_id not in kept


def test_one_document_of_each_group(stages):
    docs = sorted((r.doc_id, r.text) for r in stages[1].collect())
    first = groups([plain_fingerprint(t) for _, t in docs])
    assert sorted(r.doc_id for r in stages[2].collect()) == [docs[i][0] for i in sorted(set(first))]


def test_mixture_meets_targets(stages):
    size = lambda r: len(r.text.encode().split())
    have, drawn = {}, {}
    for r in stages[2].collect():
        have[r.source] = have.get(r.source, 0) + size(r)
    for r in stages[3].collect():
        drawn[r.source] = drawn.get(r.source, 0) + size(r)
    for s, goal in zip(sorted(have), fill([have[s] for s in sorted(have)])):
        assert abs(drawn[s] - goal) <= 0.02 * goal


def test_packed_ids_are_the_texts(stages):
    want = sorted(tuple(plain(r.text)) for r in stages[3].collect())
    assert sum(map(len, want)) == sum(r.length for r in stages[4].collect())
    once = {}
    for r in stages[3].collect():
        once[r.doc_id] = once.get(r.doc_id, 0) + 1
    parts = {}
    for p in stages[4].collect():
        parts.setdefault(p.doc_id, []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    for doc, times in once.items():
        if times == 1:
            assert [i for _, ids in sorted(parts[doc]) for i in ids] == plain(texts[doc])
    assert set(parts) == set(once)


def test_odd_documents_through_all_stages(spark, docs_of, tmp_path):
    docs = docs_of([*ODD, "the house and the garden of it " * 3 + " ".join(f"the k{i} of r{i}" for i in range(40))])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {len(ODD)}
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
