import random

import numpy as np
import pytest

from tests.conftest import SF_SMALL
from tests.llm.conftest import ODD
from tillwise.llm import queries, token_counts


def greedy(word, begin, more):
    at = n = 0
    while at < len(word):
        pieces = more if at else begin
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


@pytest.mark.parametrize("few", [0, 20, token_counts.FEW])
def test_automaton_equals_greedy_matching(monkeypatch, few):
    """With arrays alone, with a change of walk on the way, and one by one."""
    monkeypatch.setattr(token_counts, "FEW", few)
    rng = random.Random(5)
    word = lambda top: bytes(rng.choices(b"abc", k=rng.randint(1, top)))
    for _ in range(200):
        begin, more = {word(5) for _ in range(8)}, {word(5) for _ in range(10)}
        words = [word(14) for _ in range(60)]
        end = np.cumsum([len(w) for w in words])
        got = token_counts.Automaton.of(begin, more).counts(
            np.frombuffer(b"".join(words), np.uint8), end - np.array([len(w) for w in words]), end)
        assert got.tolist() == [greedy(w, begin, more) for w in words]


def test_query_equals_greedy_matching(spark):
    begin, more = map(set, token_counts.byte_pieces())
    rows = {r.doc_id: r for r in queries.op8_token_counts(spark, SF_SMALL).collect()}
    for doc in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        words = doc.text.encode().split()
        assert rows[doc.doc_id].n_words == len(words)
        assert rows[doc.doc_id].n_pieces == sum(greedy(w, begin, more) for w in words)


def test_a_very_long_word(docs_of):
    """Two million bytes without a blank, beside short words."""
    rng = random.Random(9)
    text = "one " + "".join(rng.choices("abc", k=2_000_000)) + " two"
    begin, more = {b"one", b"two", b"a", b"b", b"c", b"ab"}, {b"a", b"b", b"c", b"abc", b"bca", b"cc"}
    row = token_counts.count_pieces(docs_of([(1, text, "s")]), begin, more).first()
    word = text.split()[1].encode()
    at, n = (2 if word[:2] in begin else 1), 1
    while at < len(word):
        at += 3 if word[at:at + 3] in more else 2 if word[at:at + 2] in more else 1
        n += 1
    assert (row.n_words, row.n_pieces) == (3, n + 2)


def test_odd_rows(docs_of):
    docs = docs_of([*[(None, t, "s") for t in ODD], (1, "ab zz", "s")]).selectExpr("*", "1 as n_words")
    rows = token_counts.count_pieces(docs, {b"a", b"one"}, {b"b", b"x"}).collect()
    assert sorted(r.n_words for r in rows) == sorted([*(len((t or "").encode().split()) for t in ODD), 2])
    assert next(r.n_pieces for r in rows if r.doc_id == 1) == 3  # a + b, and an unknown word
    assert token_counts.count_pieces(docs.limit(0), {b"a"}, {b"b"}).count() == 0
