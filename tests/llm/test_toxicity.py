import math
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from tillwise.llm import queries
from tillwise.llm import toxicity as X

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op13_toxicity(spark, SF).toPandas()


def test_held_out_documents(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").toPandas()
    assert sorted(scored["doc_id"]) == sorted(docs["doc_id"])
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in scored["doc_id"]])
    assert (scored["held_out"] == held).all() and scored["score"].between(0, 1).all()
    assert (scored["predicted"] == (scored["score"] >= 0.7)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    told = scored[held].merge(labels, on="doc_id")
    toxic, caught = told["toxic"] == 1, told["predicted"] == 1
    # a tenth of the given labels has no trace in the text
    assert (toxic & caught).sum() / toxic.sum() > 0.85
    assert (~toxic & caught).sum() / (~toxic).sum() < 0.01
    assert (scored[scored["predicted"] == 1]["n_offending"] > 0).mean() > 0.95


def test_labels_of_held_out_rows_teach_nothing(spark, scored, monkeypatch):
    whole = queries._read

    def lies(spark, sf_dir, table):
        frame = whole(spark, sf_dir, table)
        if table != "labels":
            return frame
        return frame.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic"))
                                .otherwise(F.col("toxic")))
    monkeypatch.setattr(queries, "_read", lies)
    again = queries.op13_toxicity(spark, SF).toPandas()
    assert again.sort_values("doc_id")["score"].tolist() == scored.sort_values("doc_id")["score"].tolist()


def plain_sentences(text):
    """Sets of different words per sentence, in plain Python."""
    out, now, at = [], [], 0
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text or ""):
        if now and "\n" in text[at:m.start()]:
            out.append(now)
            now = []
        now.append(m.group())
        at = m.end()
        if re.search(r"[.!?][\"'()\[\]{},;:]{0,3}$", m.group()):
            out.append(now)
            now = []
    return out + [now] if now else out


def test_sentences_and_noisy_or_in_plain_python():
    texts = ["You are an idiot. He said so!\nfine here\n\nlast one?  ", "one one ONE, (one) two", "a. a. a. b.",
             None, "", " \n", "“Ärger!” sagte er (leise.) und ging", "...\n!? x"]
    found = X.Sentences(pa.array(texts))
    want = [(d, s) for d, t in enumerate(texts) for s in plain_sentences(t)]
    assert found.doc.tolist() == [d for d, _ in want]
    rng = np.random.default_rng(2)
    weights, bias = rng.standard_normal(1 << X.BITS).astype(np.float32), -1.0

    def word_weight(word):
        return float(weights[X.Sentences(pa.array([word])).features].sum())

    p = found.chances(weights, bias)
    keys = []
    for (d, words), chance in zip(want, p):
        bare = {w.strip(string.punctuation) or w[0] for w in (w.lower() if w.isascii() else w for w in words)}
        z = bias + sum(word_weight(w) for w in bare)
        assert math.isclose(chance, 1 / (1 + math.exp(-z)), rel_tol=1e-6), words
        keys.append((d, frozenset(bare)))
    score = found.noisy_or(p)
    for d in range(len(texts)):
        own = {k: c for k, c in zip(keys, p) if k[0] == d}
        assert math.isclose(score[d], 1 - math.prod(1 - c for c in own.values()), abs_tol=1e-9)


def test_odd_documents_and_spans(spark, docs_of):
    texts = [*ODD, "Nice day. You äre a zork. Bye.", "zork"] + [f"plain words number {i} go here." for i in range(60)] \
        + [f"so it goes {i}. what a zork, he said {i}. ende {i}." for i in range(40)]
    docs = docs_of(texts).selectExpr("*", "0.5 as score", "1 as toxic", "2 as draw", "3 as sentences")
    labels = spark.createDataFrame([(len(ODD) + 2 + i, int(i >= 60)) for i in range(100)]
                                   + [(5, None), (None, 1), (10 ** 9, 1), (len(ODD) + 2 + 70, 0)], "doc_id bigint, toxic int")
    model = X.fit(docs, labels)
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    assert len(got) == len(texts)
    assert all(got[i].score == 0.0 for i in (0, 1, 2))
    assert all(got[len(ODD) + 2 + i].score < 0.3 for i in range(60))
    assert all(got[len(ODD) + 2 + i].score > 0.7 for i in range(60, 100))
    spans = got[len(ODD)].sentences
    assert [texts[len(ODD)][s.start:s.start + s.length] for s in spans] == ["You äre a zork."]
    assert X.score(docs.limit(0), model).count() == 0


def test_no_labels_no_toxic_label(spark, docs_of):
    docs = docs_of(["a b c.", "d e f.", None])
    for rows in ([], [(0, 0), (1, 0)]):
        model = X.fit(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int"))
        assert all(r.score < 1e-9 for r in X.score(docs, model).collect())
    X.score(docs, X.fit(docs, spark.createDataFrame([(0, 1), (1, 1)], "doc_id bigint, toxic int"))).collect()
    assert X.fit(docs.limit(0), spark.createDataFrame([(0, 1)], "doc_id bigint, toxic int"))[1] == -40.0
