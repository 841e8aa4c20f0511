"""Toxicity by multiple-instance learning.

Only whole documents are labelled.  A document is a bag of sentences; a
sentence's chance of being toxic is a logistic function of its words, and a
document is toxic if any of its sentences is (noisy-or):
``P(document) = 1 - prod(1 - p(sentence))``.  The weights are trained on the
labels of documents through that product, so they learn which sentences
carry a label, and scoring points at them.

A word counts by itself and by its first and last four and six bytes (case
and outer punctuation aside), so that inflected and compounded forms share
weights; a word counts once per sentence, and a sentence of the same words
once per document.  Sentences end at ``. ! ?`` before a blank and at line ends.

Sentences of labelled documents are cut and hashed where the documents lie;
the fit itself sees a bounded sample, at most ``FIT_DOCS`` documents and
``FIT_FEATURES`` word features, drawn by a hash of the text (a document of
more than a twentieth of them is left to the others): one task trains on them
and returns ``2 ** BITS`` weights.  Scoring reads every whole text.

Defined results for odd input: null, empty and blank texts have no sentence
and score 0; without a toxic document in the sample every score is 0; labels
that are null, or of documents that are not there, teach nothing; a document
with several labels is toxic if any says so; labels without an id teach
nothing; repeated documents are scored each; an empty table gives an empty
result.  Scripts without blanks between words are read as few long words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import segment as S
from tillwise.plans.lineage import cut_lineage

#: Bound of the sample that the weights are fitted on.
FIT_DOCS, FIT_FEATURES = 12_000, 8_000_000
#: Only features whose log odds ratio between toxic and other documents of the
#: sample reaches this, and this many of its standard errors, get a weight.
LEAST_ODDS, LEAST_ERRORS = 1.1, 3.0
BITS = 20
#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20
ROUNDS, RATE, SHRINK = 150, 0.2, 1e-3
#: Sentences of at least this chance are reported.
OFFENDING = 0.5
# --- fixed values: marks -----------------------------------------------------------
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_ENDING = np.zeros(256, dtype=bool)
_ENDING[[0x21, 0x2E, 0x3F]] = True
#: Byte counts of the parts of a word that are features beside the whole.
PARTS = (4, 6)
_SENTENCE = "array<struct<p: double, start: int, length: int>>"


# -- sentences and features ----------------------------------------------------------
class Sentences:
    """Sentences of a run of texts: ``doc`` (the text of each), byte bounds
    and whether it is its text's ``first`` of the same words; of each
    sentence's different words, ``of_word`` (the sentence) and features."""

    def __init__(self, texts: pa.Array, bits: int = BITS):
        words = S.split(texts, lower=True)
        data, start, end, doc = words.data, words.start, words.end, words.doc
        n = len(start)
        lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
        closes = np.zeros(n, dtype=bool)
        if n:
            # quotes and brackets may stand behind the mark
            last = end - 1
            for _ in range(3):
                back = (last > start) & _PUNCTUATION[data[last]] & ~_ENDING[data[last]]
                last = last - back
            closes = _ENDING[data[last]]
            closes[:-1] |= (lines[start[1:]] > lines[end[:-1]]) | (doc[1:] != doc[:-1])
            closes[-1] = True
        self.words, self.data = words, data
        ends = np.flatnonzero(closes)
        firsts = np.concatenate([[0], ends[:-1] + 1]) if n else ends
        self.start, self.end, self.doc = start[firsts], end[ends], doc[firsts]
        of_word = np.cumsum(closes) - closes
        start, end = start.copy(), end.copy()
        for _ in range(4 if n else 0):  # outer punctuation; a word of marks alone keeps one
            end -= (end - start > 1) & _PUNCTUATION[data[end - 1]]
            start += (end - start > 1) & _PUNCTUATION[data[start]]
        hashed = self._hashes(start, end)
        _, own = np.unique(S.mix(hashed ^ S.mix(of_word.astype(np.uint64))), return_index=True)
        own.sort()
        self.of_word = of_word[own]
        self.first = np.zeros(len(self.doc), dtype=bool)
        if n:
            same = np.add.reduceat(S.mix(hashed[own]), np.searchsorted(self.of_word, np.arange(len(self.doc))))
            self.first[np.unique(S.mix(same ^ S.mix(self.doc.astype(np.uint64))), return_index=True)[1]] = True
        self.features = self._features(start[own], end[own], hashed[own], bits)

    def _hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return S.hashes(S.Words(self.data, start, end, self.words.doc, self.words.n_docs))

    def _features(self, start: np.ndarray, end: np.ndarray, whole: np.ndarray, bits: int) -> np.ndarray:
        """A row of feature numbers per word."""
        hashed = [whole]
        for size in PARTS:
            hashed += [self._hashes(start, np.minimum(end, start + size)), self._hashes(np.maximum(start, end - size), end)]
        out = np.empty((len(start), len(hashed)), dtype=np.int32)
        for j, h in enumerate(hashed):
            kind = S.mix(np.array([j + 1], dtype=np.uint64))[0]
            out[:, j] = (S.mix(h ^ kind) >> np.uint64(64 - bits)).astype(np.int32)
        return out

    def chances(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Each sentence's chance of being toxic."""
        word = weights[self.features].sum(axis=1, dtype=np.float64)
        return _chance(bias + np.bincount(self.of_word, weights=word, minlength=len(self.doc)))

    def noisy_or(self, chances: np.ndarray) -> np.ndarray:
        rest = np.bincount(self.doc, weights=np.where(self.first, np.log1p(-chances), 0.0), minlength=self.words.n_docs)
        return -np.expm1(rest)


def _chance(z: np.ndarray) -> np.ndarray:
    return np.clip(1 / (1 + np.exp(-np.clip(z, -40, 40))), 0, 1 - 1e-9)


# -- the fit -------------------------------------------------------------------------
def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: feature numbers of its words, and words per sentence."""
    S.steady_memory()
    for batch in batches:
        texts = batch.column("text")
        for a, b in S.slices(texts, SLICE_BYTES):
            found = Sentences(texts.slice(a, b - a))
            kept = found.first[found.of_word]
            features, of_word = found.features[kept].astype("<i4"), found.of_word[kept]
            size = np.bincount(of_word, minlength=len(found.doc))[found.first].astype("<i4")
            words = np.searchsorted(found.doc[of_word], np.arange(b - a + 1))
            firsts = np.searchsorted(found.doc[found.first], np.arange(b - a + 1))
            width = features.shape[1]
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").slice(a, b - a), batch.column("draw").slice(a, b - a),
                 pa.array([features[i:j].tobytes() for i, j in zip(words[:-1], words[1:])], pa.binary()),
                 pa.array([size[i:j].tobytes() for i, j in zip(firsts[:-1], firsts[1:])], pa.binary()),
                 pa.array((words[1:] - words[:-1]) * width)],
                names=["toxic", "draw", "features", "sizes", "n"])


def _telling(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> np.ndarray:
    """Features whose odds differ between the ``n_a`` documents of which ``a``
    have them, and the ``n_b`` of which ``b`` do."""
    counts = np.stack([a, n_a - a, b, n_b - b]) + 0.5
    odds = np.abs(np.log(counts[0] / counts[1]) - np.log(counts[2] / counts[3]))
    return (a + b > 0) & (odds >= LEAST_ODDS) & (odds >= LEAST_ERRORS * np.sqrt((1 / counts).sum(axis=0)))


def train(documents: list[tuple[int, np.ndarray, np.ndarray]], size: int = 1 << BITS) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, features, words per sentence) of each
    document, by full-batch Adam on the log-likelihood of the noisy-or."""
    weights = np.zeros(size, dtype=np.float32)
    documents = [d for d in documents if len(d[2])]
    y = np.array([d[0] for d in documents], dtype=bool)
    if not y.any():
        return weights, -40.0
    width = sum(len(d[1]) for d in documents) // sum(int(d[2].sum()) for d in documents)
    features = np.concatenate([d[1] for d in documents])
    doc_of = np.repeat(np.arange(len(documents), dtype=np.int32), [len(d[1]) for d in documents])
    sentences = np.array([len(d[2]) for d in documents])
    # features that say little go; the others are numbered anew
    present = np.unique(features.astype(np.int64) * len(documents) + doc_of)
    del doc_of
    with_label = np.bincount(present // len(documents), weights=y[present % len(documents)], minlength=size)
    without = np.bincount(present // len(documents), minlength=size) - with_label
    known = np.flatnonzero(_telling(with_label, without, int(y.sum()), int((~y).sum())))
    place = np.full(size, -1, dtype=np.int32)
    place[known] = np.arange(len(known))
    own = place[features]
    kept = np.flatnonzero(own >= 0)
    word_sentence = np.repeat(np.arange(int(sentences.sum()), dtype=np.int32), np.concatenate([d[2] for d in documents]))
    own, sentence_of = own[kept], word_sentence[kept // width]
    bag = np.repeat(np.arange(len(documents)), sentences)
    rate = y.mean() if not y.all() else 0.99
    bias = float(np.log(rate / sentences.mean()))
    w = np.zeros(len(known) + 1)
    w[-1] = bias
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, ROUNDS + 1):
        z = w[-1] + np.bincount(sentence_of, weights=w[own], minlength=len(bag))
        p = _chance(z)
        total = np.maximum(np.bincount(bag, weights=-np.log1p(-p), minlength=len(documents)), 1e-12)
        share = np.where(y, -1 / np.expm1(np.minimum(total, 500)), 1.0)   # d loss / d total
        slope = share[bag] * p / len(documents)
        step = np.append(np.bincount(own, weights=slope[sentence_of], minlength=len(known)), slope.sum())
        step[:-1] += SHRINK / len(documents) * w[:-1]
        first = 0.9 * first + 0.1 * step
        second = 0.99 * second + 0.01 * step * step
        w -= RATE * (first / (1 - 0.9 ** t)) / (np.sqrt(second / (1 - 0.99 ** t)) + 1e-8)
    weights[known] = w[:-1]
    return weights, float(w[-1])


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    S.steady_memory()
    rows, room = [], FIT_FEATURES
    for batch in batches:  # in the order of the draw
        for row in batch.select(["toxic", "features", "sizes", "n"]).to_pylist():
            room -= row["n"]
            if room >= 0 or not rows:
                rows.append((row["toxic"], np.frombuffer(row["features"], "<i4"), np.frombuffer(row["sizes"], "<i4")))
        if room < 0:
            break
    for _ in batches:
        pass
    weights, bias = train(rows)
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([bias])],
                                     names=["weights", "bias"])


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> tuple[np.ndarray, float]:
    """Weights and bias learned from ``docs`` (``doc_id, text``) and the
    ``labels`` (``doc_id, toxic``) given.  The sample is the documents of the
    smallest draws; a share of the draws' range is cut off first, so that
    little more than the sample is moved."""
    told = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic"))
    labelled = docs.select("doc_id", "text").join(told, "doc_id")
    draw = F.xxhash64("text", "doc_id", F.lit(20240611))
    n = told.count()
    share = min(1.0, 1.2 * fit_docs / max(n, 1))
    drawn = labelled.select("text", "toxic", draw.alias("draw"))
    if share < 1:
        drawn = drawn.filter(F.col("draw") < F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))))
    bags = cut_lineage(drawn.mapInArrow(_bags, "toxic int, draw bigint, features binary, sizes binary, n bigint"))
    sample = bags.filter(F.col("n") <= FIT_FEATURES // 20).orderBy("draw", "n").limit(fit_docs)
    row = sample.coalesce(1).sortWithinPartitions("draw", "n").mapInArrow(
        _trainer, "weights binary, bias double").first()
    if row is None:
        return np.zeros(1 << BITS, dtype=np.float32), -40.0
    return np.frombuffer(row.weights, "<f4"), row.bias


# -- scoring --------------------------------------------------------------------------
def _scored(weights: np.ndarray, bias: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.steady_memory()
        for batch in batches:
            texts = batch.column("text")
            for a, b in S.slices(texts, SLICE_BYTES):
                found = Sentences(texts.slice(a, b - a))
                chances = found.chances(weights, bias)
                bad = np.flatnonzero(chances >= OFFENDING)
                # byte bounds to code points: bytes that start one, counted from the text's start
                points = np.concatenate([[0], np.cumsum((found.data & 0xC0) != 0x80)])
                sizes = np.zeros(b - a + 1, dtype=np.int64)
                sizes[1:] = np.cumsum(pc.fill_null(pc.binary_length(texts.slice(a, b - a)), 0).to_numpy(zero_copy_only=False))
                doc = found.doc[bad]
                begin = points[found.start[bad]] - points[sizes[doc]]
                length = points[found.end[bad]] - points[found.start[bad]]
                spans = [[] for _ in range(b - a)]
                for d, p, s, n in zip(doc.tolist(), chances[bad].tolist(), begin.tolist(), length.tolist()):
                    spans[d].append({"p": p, "start": s, "length": n})
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(found.noisy_or(chances)),
                     pa.array(spans, pa.list_(pa.struct([("p", pa.float64()), ("start", pa.int32()), ("length", pa.int32())])))],
                    names=["doc_id", "score", "sentences"])
    return run


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``doc_id, score, sentences`` of every document: the noisy-or of its
    sentences, and the sentences that are toxic by themselves (chance, first
    code point, length in code points)."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(
        _scored(*model, to_arrow_type(kind)), f"doc_id {kind.simpleString()}, score double, sentences {_SENTENCE}")
