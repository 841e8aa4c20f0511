"""Language-model scores from a log-frequency Bloom filter.

Word and word-pair counts of the training documents are quantised to the
power of two below them; an n-gram of level ``j`` is entered ``j`` times, once
per level.  A score probes the filter level by level until one is missing,
and smooths the counts found: a share ``PAIR_WEIGHT`` of the relative pair
frequency, the rest the add-one word probability; after a word that was never
seen, the word probability alone.

The filter is cut into segments by hash.  Every segment is counted and built
in a task of its own from packed arrays of n-grams, never rows: a packet of
documents sends each n-gram once, with its count in the packet, so a token
that stands in every document is one entry a packet.  The exact counts go
back to the packets, which hold the documents' own counts and give the base
scores; no vocabulary is sent around.  Segments are broadcast while they fit
``FILTER_BYTES``; a larger filter is probed in several passes of that size,
with the same result.

Words are known by 64-bit hashes (two differ with all but 2**-58).

Defined results for odd input: a null or blank text is its end token; a null
id counts as the empty text when documents are held out; repeated rows count
as often as they come and get the same score; an empty table gives an empty
result; without training documents all words are unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.llm import segment as S
from tillwise.plans.lineage import cut_lineage

PAIR_WEIGHT = 0.2
HASHES = 5
BITS_PER_ENTRY = 8
#: Most filter bytes broadcast at once.
FILTER_BYTES = 128 << 20
#: Text bytes for each filter segment, and the least number of segments.
SEGMENT_TEXT = 16 << 20
LEAST_SEGMENTS = 16
#: Tokens (and documents) gathered before their n-grams are counted and sent.
PACKET_TOKENS = 1_500_000
#: Text bytes hashed at once (the hash needs about 30 times as much memory).
SLICE_BYTES = 1 << 20
PACKET_DOCS = 1 << 16

_END, _START = np.uint64(0x5DEECE66D1CE4E5B), np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_LEVEL, _PROBE = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    text = F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")
    return F.crc32(text) % parts == part


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of the texts, each closed by an end; the text's number;
    the hash of the pair with the token before (a start for the first)."""
    w = S.split(texts, lower=True)
    size = w.per_doc().astype(np.int64) + 1
    token = np.full(int(size.sum()), _END, dtype=np.uint64)
    token[np.arange(len(w.doc)) + w.doc] = S.hashes(w)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.cumsum(size) - size] = _START
    return token, np.repeat(np.arange(len(size)), size), S.mix(before * _PAIR + token)


def segment_of(h: np.ndarray, n: int) -> np.ndarray:
    """Segment of each hash; increasing with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2(count))."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """Mean of the counts of a level (level 0: none)."""
    top = np.ldexp(1.0, levels.astype(np.int64))
    return np.where(levels > 0, (top / 2 + top - 1) / 2, 0.0)


def _place(h: np.ndarray, level, probe: int, size) -> np.ndarray:
    salt = np.uint64((_LEVEL * level + _PROBE * probe) % (1 << 64))
    return (S.mix(h + salt) % size).astype(np.int64)


def build_bits(h: np.ndarray, levels: np.ndarray) -> bytes:
    """Bloom bits of one segment: each n-gram entered once per level."""
    size = max(64, (int(levels.sum()) * BITS_PER_ENTRY + 63) // 64 * 64)
    hit = np.zeros(size, dtype=np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        h, levels = h[levels >= level], levels[levels >= level]
        for probe in range(HASHES):
            hit[_place(h, level, probe, np.uint64(size))] = 1
    return np.packbits(hit, bitorder="little").tobytes()


@dataclass
class Filter:
    """Segments ``first`` up to ``last`` (of ``n``) of the filter."""
    n: int
    first: int
    last: int
    bits: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, n: int, first: int, parts: list[bytes]) -> Filter:
        size = np.array([8 * len(p) for p in parts], dtype=np.uint64)
        begin = (np.cumsum(size) - size).astype(np.int64)
        return cls(n, first, first + len(parts), np.frombuffer(b"".join(parts), dtype=np.uint8), begin, size)

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Level of each n-gram by repeated membership probes (0: not found,
        or not in these segments)."""
        distinct, which = np.unique(h, return_inverse=True)
        part = segment_of(distinct, self.n) - self.first
        found = np.zeros(len(distinct), dtype=np.uint8)
        left = np.flatnonzero((part >= 0) & (part < self.last - self.first))
        level = 0
        while len(left):
            level += 1
            for probe in range(HASHES):
                at = part[left]
                place = self.begin[at] + _place(distinct[left], level, probe, self.size[at])
                left = left[(self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)]
            found[left] = level
        return found[which]


# --- counting ----------------------------------------------------------------------

#: A segment's n-grams of a packet, or (segment below 0) the packet's documents by word.
_PACKET = ("seg bigint, packet bigint, words binary, word_times binary, pairs binary, pair_times binary, n_docs binary, "
           "doc binary, times binary, info binary")


def _bytes(x: np.ndarray, dtype: str) -> bytes:
    return np.ascontiguousarray(x, dtype=dtype).tobytes()


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, after a byte that tells how many."""
    width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
    return bytes([width]) + _bytes(x, f"<u{width}")


def _wide(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


def _packets(n_segments: int):
    """Partition function over (key, train, text): packets of counted n-grams,
    one row per packet and segment, and one per packet with its documents."""
    def packed(number: int, token, doc, pair, key, train) -> pa.RecordBatch:
        order = np.argsort(token, kind="stable")  # a token's documents stay in order
        t, d = token[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])]))
        times = np.diff(np.append(new, len(t)))
        t, d = t[new], d[new]
        word = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        n_docs = np.diff(np.append(word, len(t)))
        two, two_times = np.unique(pair[train[doc]], return_counts=True)
        word_cut = np.searchsorted(segment_of(t[word], n_segments), np.arange(n_segments + 1))
        pair_cut = np.searchsorted(segment_of(two, n_segments), np.arange(n_segments + 1))
        word_times = np.add.reduceat(times * train[d], word)
        info = np.zeros(len(key), dtype=[("key", "<i8"), ("n", "<i8")])
        info["key"], info["n"] = key, np.bincount(doc, minlength=len(key))
        rows = [(-1 - number, number, None, None, None, None, _small(n_docs), _small(d), _small(times), info.tobytes())]
        for s in range(n_segments):
            a, b = word_cut[s], word_cut[s + 1]
            p, q = pair_cut[s], pair_cut[s + 1]
            if a == b and p == q:
                continue
            rows.append((s, number, _bytes(t[word[a:b]], "<u8"), _small(word_times[a:b]), _bytes(two[p:q], "<u8"),
                         _small(two_times[p:q]), None, None, None, None))
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                          names=[c.split()[0] for c in _PACKET.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        S.steady_memory()
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        n_tokens = n_docs = 0

        def flush() -> pa.RecordBatch:
            token, doc, pair, key, train = (np.concatenate(x) for x in zip(*held))
            held.clear()
            return packed(number, token, doc, pair, key, train)

        for batch in batches:
            texts, keys = batch.column("text"), batch.column("key").to_numpy()
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for a, b in S.slices(texts, SLICE_BYTES):
                for a, b in ((x, min(x + PACKET_DOCS // 2, b)) for x in range(a, b, PACKET_DOCS // 2)):
                    token, doc, pair = token_stream(texts.slice(a, b - a))
                    held.append((token, doc + n_docs, pair, keys[a:b], train[a:b]))
                    n_tokens, n_docs = n_tokens + len(token), n_docs + b - a
                    if n_tokens >= PACKET_TOKENS or n_docs >= PACKET_DOCS:
                        yield flush()
                        n_tokens, n_docs, number = 0, 0, number + 1
        if held:
            yield flush()

    return run


#: kind 0: counts of a packet's words in one segment; 1: a segment's filter; 2: a packet's documents.
_REPLY = ("kind int, packet bigint, seg bigint, body binary, n_docs binary, doc binary, times binary, info binary, "
          "n_tokens bigint, n_words bigint, n_train bigint")


def _count_segment(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Exact counts of one segment's n-grams: its filter bits, and for each
    packet the counts of its words; a packet's documents go through as they are."""
    S.steady_memory()
    out = []
    if key[0] < 0:
        out = [(2, r.packet, r.seg, None, r.n_docs, r.doc, r.times, r.info, None, None, None) for r in rows.itertuples()]
    else:
        words, which = np.unique(np.frombuffer(b"".join(rows["words"]), "<u8"), return_inverse=True)
        word_times = np.concatenate([_wide(x) for x in rows["word_times"]])
        counts = np.bincount(which, weights=word_times, minlength=len(words)).astype(np.int64)
        at = 0
        for packet, raw in zip(rows["packet"], rows["words"]):
            upto = at + len(raw) // 8
            out.append((0, packet, key[0], _small(counts[which[at:upto]]), *[None] * 7))
            at = upto
        pairs, pair_of = np.unique(np.frombuffer(b"".join(rows["pairs"]), "<u8"), return_inverse=True)
        pair_times = np.concatenate([_wide(x) for x in rows["pair_times"]])
        pair_counts = np.bincount(pair_of, weights=pair_times, minlength=len(pairs))
        seen = counts > 0
        bits = build_bits(np.concatenate([words[seen], pairs]),
                          np.concatenate([levels_of(counts[seen]), levels_of(pair_counts)]))
        ends = int(counts[words == _END].sum())
        out.append((1, None, key[0], bits, None, None, None, None, int(counts.sum()), int(seen.sum()), ends))
    return pd.DataFrame(out, columns=[c.split()[0] for c in _REPLY.split(", ")]).astype(
        {"packet": "Int64", "n_tokens": "Int64", "n_words": "Int64", "n_train": "Int64"})


def _combine(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of log10(count + 1) and the known tokens of one packet's documents."""
    S.steady_memory()
    own = rows[rows["kind"] == 2].iloc[0]
    replies = rows[rows["kind"] == 0].sort_values("seg")  # a packet's words are in the order of the segments
    counts = np.concatenate([_wide(x) for x in replies["body"]])
    info = np.frombuffer(own["info"], dtype=[("key", "<i8"), ("n", "<i8")])
    n_docs, doc, times = _wide(own["n_docs"]), _wide(own["doc"]), _wide(own["times"])
    log = np.repeat(np.log10(counts + 1.0), n_docs) * times
    known = np.repeat(counts > 0, n_docs) * times
    return pd.DataFrame({
        "key": info["key"], "n_tokens": info["n"],
        "n_known": np.bincount(doc, known, minlength=len(info)).astype(np.int64),
        "log_counts": np.bincount(doc, log, minlength=len(info))})


_CARRIED = ("key", "doc_id", "held_out")


# --- scoring -----------------------------------------------------------------------

def _log_probabilities(words: np.ndarray, pairs: np.ndarray, firsts: np.ndarray, n: int, v: int, n_train: int,
                       weight: float) -> np.ndarray:
    """log10 P of each token from the levels of the words and pairs;
    ``firsts`` marks each text's first token."""
    single = count_of(words)
    p = (single + 1) / (n + v + 1)
    before = np.empty_like(single)
    before[1:] = single[:-1]
    before[firsts] = n_train
    both = np.minimum(count_of(pairs), before)
    share = np.where(before > 0, weight, 0.0)
    return np.log10((1 - share) * p + share * both / np.maximum(before, 1.0))


def _probe(filter_, stats: tuple[int, int, int], weight: float, last: bool):
    """Partition function of one pass: adds the levels found in its segments,
    and at the last pass turns them into scores."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        S.steady_memory()
        f = filter_.value
        for batch in batches:
            texts = batch.column("text")
            earlier = batch.column("levels") if "levels" in batch.schema.names else None
            for a, b in S.slices(texts, SLICE_BYTES):
                token, doc, pair = token_stream(texts.slice(a, b - a))
                found = np.concatenate([f.levels(token), f.levels(pair)])
                firsts = np.flatnonzero(np.diff(doc, prepend=-1))
                sizes = np.diff(np.append(firsts, len(doc)))
                if earlier is not None:
                    held = [np.frombuffer(x.as_buffer(), np.uint8) for x in earlier.slice(a, b - a)]
                    found = np.maximum(found, np.concatenate([x[:len(x) // 2] for x in held]
                                                             + [x[len(x) // 2:] for x in held]))
                words, pairs = found[:len(token)], found[len(token):]
                part = batch.slice(a, b - a)
                carried, names = [part.column(c) for c in _CARRIED], [*_CARRIED]
                if last:
                    logs = _log_probabilities(words, pairs, firsts, *stats, weight)
                    score = np.add.reduceat(logs, firsts)
                    yield pa.RecordBatch.from_arrays([*carried, pa.array(sizes), pa.array(score)],
                                                     names=[*names, "n_tokens", "score"])
                else:
                    cuts = zip(firsts.tolist(), (firsts + sizes).tolist())
                    levels = [words[i:j].tobytes() + pairs[i:j].tobytes() for i, j in cuts]
                    yield pa.RecordBatch.from_arrays([*carried, texts.slice(a, b - a), pa.array(levels, pa.binary())],
                                                     names=[*names, "text", "levels"])
    return run


def score(docs: DataFrame, held: Column, weight: float = PAIR_WEIGHT,
          filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` of every row of ``docs`` (``doc_id, text``); rows that ``held``
    marks are not learned from."""
    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", held.alias("held_out"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_segments = max(LEAST_SEGMENTS, -(-size // SEGMENT_TEXT))
    packets = rows.select("key", (~F.col("held_out")).alias("train"), "text").mapInArrow(
        _packets(n_segments), _PACKET)
    told = cut_lineage(packets.groupBy("seg").applyInPandas(_count_segment, _REPLY))
    built = told.filter("kind = 1")
    stats = tuple(built.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n_tokens", "n_words", "n_train")]).first())
    base = told.filter("kind <> 1").select("kind", "packet", "seg", "body", "n_docs", "doc", "times", "info").groupBy(
        "packet").applyInPandas(
        _combine, "key bigint, n_tokens bigint, n_known bigint, log_counts double")
    # passes: runs of segments within the bound
    sizes = dict(built.select("seg", F.octet_length("body")).collect())
    passes, room = [[0, 0]], filter_bytes
    for s in range(n_segments):
        if sizes.get(s, 0) > room and passes[-1][1] > passes[-1][0]:
            passes.append([s, s])
            room = filter_bytes
        passes[-1][1] = s + 1
        room -= sizes.get(s, 0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    state = rows
    for first, upto in passes:
        parts = {r[0]: bytes(r[1]) for r in built.filter(F.col("seg").between(first, upto - 1))
                 .select("seg", "body").toLocalIterator()}
        sent = docs.sparkSession.sparkContext.broadcast(
            Filter.of(n_segments, first, [parts.get(s, bytes(8)) for s in range(first, upto)]))
        last = upto == n_segments
        out = "n_tokens bigint, score double" if last else "text string, levels binary"
        state = state.mapInArrow(_probe(sent, stats, weight, last),
                                 f"key bigint, doc_id {kind}, held_out boolean, {out}")
        if not last:
            state = cut_lineage(state)
    # equal rows have equal sums: one is enough
    sums = base.groupBy("key", "n_tokens").agg(F.first("n_known").alias("n_known"),
                                               F.first("log_counts").alias("log_counts"))
    return state.join(sums.repartition(F.xxhash64("n_tokens", "key")), ["key", "n_tokens"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(stats[0]).cast("bigint").alias("train_tokens"),
        (F.col("log_counts") - F.col("n_tokens") * F.log10(F.lit(float(stats[0] + stats[1] + 1)))).alias("base_score"),
        "score")
