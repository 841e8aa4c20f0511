"""Packing documents into token sequences along a space-filling curve.

Each document's token set is a hashed vector, projected with random signs to
three dimensions; the cell it falls in has a place on a Hilbert curve.
Documents are range-sorted by that place, so neighbours on the curve, which
have similar vectors, share sequences.  Along the curve documents are cut
wherever a sequence of ``SEQUENCE`` tokens is full; what is left at the end
of a range is cut into sequences whose lengths are powers of two, so nothing
is padded.

Defined results for odd input: a null or blank text is the closing id alone;
rows with null or repeated ids are documents of their own (equal rows are
spread over the ranges by a salt); an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import segment
from tillwise.plans.lineage import cut_lineage

SEQUENCE = 4096
VOCABULARY = "word_bpe_49k.json"
END_ID = 2
DIMENSIONS = 3
BITS = 16
SEED = 11
#: Entries of a worker's table of word parts (about 35 bytes each); a full one is emptied.
CACHE = 600_000
#: Bytes of text handled at once.
SLICE_BYTES = 2 << 20
# --- fixed values: ASCII marks that the vocabulary's rule keeps in one run; letters and the bytes of others ---
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


class Encoder:
    """Token ids by the public tokenizer, through a table of word parts.

    The tokenizer drops blanks and never joins characters across them, so a
    text's ids are those of its words.  A word of letters and then marks is
    two parts, unless the letters, composed and lower-cased as the tokenizer
    does it, are no longer letters throughout (a dotted capital I ends in a
    combining mark, which runs on into the marks): such a word is one part,
    as all others are.  Parts are found by their hashes, many at a time; only
    new ones are spelled out and encoded.
    """

    def __init__(self, vocabulary: str):
        import json
        import os

        import public_tokenizers
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        path = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.size = max(self.tokenizer.get_vocab_size(), 1 + max(vocab.values()))
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.ends_word = np.zeros(self.size, dtype=bool)
        self.ends_word[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        """Known parts: sorted hashes and the row of each; by row, where its
        ids begin and how many there are (-1: letters that must not be parted
        from their marks)."""
        self.keys, self.row = np.array([], dtype=np.uint64), np.array([], dtype=np.int64)
        self.begin, self.count = np.array([], dtype=np.int64), np.array([], dtype=np.int64)
        self.pool = np.array([], dtype=self.dtype)

    def _alone(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [got.ids for got in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return (np.array([i for x in ids for i in x], dtype=self.dtype),
                np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))

    def _together(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``n`` words of letters, encoded as one text and cut after
        the ids that end a word."""
        if not n:
            return self.pool[:0], self.count[:0]
        ids = np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == n else self._alone(text.split(" "))

    def _look_up(self, part: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray,
                 letters: bool) -> np.ndarray:
        """Rows of the parts ``data[start:end]``, whose hashes are ``part``."""
        distinct, first, which = np.unique(part, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        new = np.flatnonzero(~known)
        if len(new):
            a, b = start[first[new]], end[first[new]]
            if letters:
                high = np.concatenate([[0], np.cumsum(data >= 0x80)])
                ascii_only = np.flatnonzero(high[b] == high[a])
                other = np.flatnonzero(high[b] > high[a])
                words = _joined(data, a[other], b[other]).split(" ") if len(other) else []
                fine = np.fromiter(map(_letters_throughout, words), dtype=bool, count=len(words))
                texts = [" ".join(w for w, ok in zip(words, fine) if ok)] if fine.any() else []
                texts += [_joined(data, a[ascii_only], b[ascii_only])] if len(ascii_only) else []
                ids, size = self._together(" ".join(texts), int(fine.sum()) + len(ascii_only))
                count = np.full(len(new), -1, dtype=np.int64)
                order = np.concatenate([other[fine], ascii_only])
                count[order] = size
                begin = np.zeros(len(new), dtype=np.int64)
                begin[order] = np.cumsum(size) - size
            else:
                ids, count = self._alone(_joined(data, a, b).split(" "))
                begin = np.cumsum(count) - count
            rows = len(self.begin) + np.arange(len(new))
            self.begin = np.append(self.begin, begin + len(self.pool))
            self.count, self.pool = np.append(self.count, count), np.append(self.pool, ids)
            self.keys, self.row = np.insert(self.keys, at[new], distinct[new]), np.insert(self.row, at[new], rows)
        return self.row[np.searchsorted(self.keys, distinct)][which]

    def encode(self, words: segment.Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each word has."""
        if len(self.keys) > CACHE:
            self._clear()
        data, start, end = words.data, words.start, words.end
        plain = segment.lowered(data)
        last = np.maximum.accumulate(np.where(_MARK[data], -1, np.arange(len(data)))) if len(data) else data
        cut = np.maximum(last[end - 1] + 1, start)
        others = np.concatenate([[0], np.cumsum(~_LETTER[data])])
        letters = np.flatnonzero((cut > start) & (others[cut] == others[start]))
        head = self._look_up(_part_hashes(words, plain, start[letters], cut[letters], 1), plain,
                             start[letters], cut[letters], True)
        split = self.count[head] >= 0
        letters, head = letters[split], head[split]
        whole = np.ones(len(start), dtype=bool)
        whole[letters] = False
        whole = np.flatnonzero(whole)
        # first the head or the whole word, then what may follow a head
        tail = letters[end[letters] > cut[letters]]
        a, b = np.concatenate([start[whole], cut[tail]]), np.concatenate([end[whole], end[tail]])
        rest = self._look_up(_part_hashes(words, data, a, b, 2), data, a, b, False)
        begin, count = np.zeros((2, len(start), 2), dtype=np.int64)
        for which, column, rows in ((letters, 0, head), (whole, 0, rest[:len(whole)]), (tail, 1, rest[len(whole):])):
            begin[which, column], count[which, column] = self.begin[rows], self.count[rows]
        size = count.ravel()
        before = np.cumsum(size) - size
        return self.pool[np.repeat(begin.ravel() - before, size) + np.arange(int(size.sum()))], count.sum(axis=1)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """The parts with a blank between each two."""
    size = end - start + 1
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))
    out = data[np.minimum(at, len(data) - 1)]
    out[ends - 1] = 0x20
    return out[:-1].tobytes().decode()


def _letters_throughout(word: str) -> bool:
    """Whether the tokenizer keeps the word in one run of letters."""
    return word.isascii() or word.isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()


def _part_hashes(words: segment.Words, data: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
    return segment.mix(segment.hashes(segment.Words(data, start, end, words.doc, words.n_docs)) ^ np.uint64(kind))


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder, kept between tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encode_texts(texts: pa.Array, enc: Encoder, end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after another, each closed by ``end_id``, and how
    many each text has."""
    words = segment.split(texts)
    flat, size = enc.encode(words)
    per_doc = words.per_doc(size).astype(np.int64)
    if end_id is None:
        return flat, per_doc
    per_doc += 1
    ends = np.cumsum(per_doc)
    out = np.full(int(per_doc.sum()), end_id, dtype=enc.dtype)
    own = np.ones(len(out), dtype=bool)
    own[ends - 1] = False
    out[own] = flat
    return out, per_doc


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each cell (rows of integer coordinates) on the Hilbert curve.

    From the top bit down, the remaining low bits are reflected or exchanged
    as the curve's turns demand; the Gray code of the result, with its bits
    interleaved over the dimensions, is the place.
    """
    x = [c.astype(np.int64) for c in cells.T]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            turned = (x[i] >> b & 1).astype(bool)
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis ^ flip) >> b & 1
    return key


def projector(size: int, seed: int = SEED, dimensions: int = DIMENSIONS) -> np.ndarray:
    return np.random.default_rng(seed).choice(np.array([-1, 1], dtype=np.int32), size=(size, dimensions))


def cells_of(flat: np.ndarray, sizes: np.ndarray, signs: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Grid cells of documents (``sizes`` of the ids each): the unit vector of
    a document's token set under random signs is about normal; its
    distribution function fills the grid."""
    small = len(sizes) <= 1 << 16 and len(signs) <= 1 << 16
    kind, shift = (np.uint32, 16) if small else (np.uint64, 32)
    pairs = np.repeat(np.arange(len(sizes), dtype=kind) << kind(shift), sizes) | flat
    pairs.sort()
    distinct = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
    doc = (distinct >> kind(shift)).astype(np.int64)
    count = np.bincount(doc, minlength=len(sizes))
    total = np.zeros((len(sizes), signs.shape[1]))
    full = count > 0
    if full.any():
        total[full] = np.add.reduceat(signs[distinct & kind((1 << shift) - 1)], (np.cumsum(count) - count)[full])
    place = total / np.sqrt(np.maximum(count, 1))[:, None]
    return np.minimum(((1 << bits) / (1 + np.exp(-1.702 * place))).astype(np.int64), (1 << bits) - 1)


def _binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``flat`` cut at ``bounds``."""
    cut = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1,
                                           [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)])
    return cut.cast(pa.binary())


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """``doc_id, ids`` (little-endian integers of ``item`` bytes), ``curve``
    (place on the curve) and ``salt``, materialised."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment.steady_memory()
        enc = encoder(vocabulary)
        signs = projector(enc.size, seed)
        for batch in batches:
            texts = batch.column("text")
            for a, b in segment.slices(texts, SLICE_BYTES):
                flat, sizes = encode_texts(texts.slice(a, b - a), enc)
                item = enc.dtype.itemsize
                bounds = np.concatenate([[0], np.cumsum(sizes) * item])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), _binaries(flat, bounds),
                     pa.array(hilbert_key(cells_of(flat, sizes, signs))),
                     pa.array(np.full(b - a, item, dtype=np.int32))],
                    names=["doc_id", "ids", "curve", "item"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, curve bigint, item int")
    return cut_lineage(rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())))


def _cut(pending: list, upto: int) -> list:
    """Take ``upto`` tokens off the front of ``pending`` (id, start, ids, total)."""
    taken = []
    while upto:
        doc, start, ids, total = pending[0]
        part = ids[:upto]
        taken.append((doc, start, part, total))
        upto -= len(part)
        if len(part) == len(ids):
            pending.pop(0)
        else:
            pending[0] = (doc, start + len(part), ids[len(part):], total)
    return taken


def _packer(sequence: int, id_type: pa.DataType):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition = TaskContext.get().partitionId()
        pending, held, done, rows = [], 0, 0, []

        def sequence_of(length: int) -> None:
            nonlocal done
            at = 0
            for doc, start, ids, total in _cut(pending, length):
                rows.append((doc, start, len(ids), ids.astype("<u4").tobytes(), total, partition << 40 | done, at))
                at += len(ids)
            done += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows))
            rows.clear()
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for doc, raw, item in zip(batch.column("doc_id").to_pylist(), batch.column("ids"),
                                      batch.column("item").to_pylist()):
                ids = np.frombuffer(raw.as_buffer(), dtype=f"<u{item}")
                for at in range(0, len(ids), sequence):  # keeps the front cut short
                    part = ids[at:at + sequence]
                    pending.append((doc, at, part, len(ids)))
                    held += len(part)
                    while held >= sequence:
                        sequence_of(sequence)
                        held -= sequence
                if len(rows) >= 2000:
                    yield flush()
        for bit in range(sequence.bit_length() - 1, -1, -1):  # the rest, without padding
            if held >> bit & 1:
                sequence_of(1 << bit)
        if rows:
            yield flush()

    return pack


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, seed: int = SEED,
         n_ranges: int | None = None) -> DataFrame:
    """Pieces of ``docs`` (``doc_id, text``): ``doc_id, start, length, ids``
    (little-endian unsigned 32-bit), ``doc_tokens, sequence_id, offset``.

    A document longer than a sequence may give several pieces; pieces of one
    document that meet inside a sequence are rows of their own.
    """
    rows = encoded(docs, vocabulary, seed)
    n = n_ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    field = docs.schema["doc_id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type
    return rows.repartitionByRange(n, "curve", "doc_id", "salt").sortWithinPartitions("curve", "doc_id", "salt") \
        .select("doc_id", "ids", "item").mapInArrow(
        _packer(sequence, to_arrow_type(field)),
        f"doc_id {field.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, "
        "sequence_id bigint, offset bigint")
