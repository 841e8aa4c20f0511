"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with two roots: pieces that begin a word and pieces
that continue one.  Each node has a failure link, the node to go on from when
no child fits, and the number of pieces popped on the way.  A word's piece
count is then found in one pass over its bytes; no piece is ever built.  All
distinct words of a batch walk the automaton together, one byte a step, until
few are left; those long ones (text without blanks, encoded data) go on one by
one, so a word of many megabytes costs a table lookup a byte.

Defined results for odd input: a null or blank text has no words and no
pieces; a word that the vocabulary cannot spell counts as one unknown piece;
repeated rows are counted each; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm import segment

VOCABULARY = "byte_bpe_50k.json"
BEGIN, CONTINUE = 0, 1
#: So few words left are walked one by one: a step of arrays costs more.
FEW = 64


def byte_pieces(vocabulary: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """Word-piece vocabulary out of a public byte-level one: tokens with a
    leading blank begin words, the others continue them; single bytes do both."""
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        tokens = json.load(f)["model"]["vocab"]
    # the format's printable stand-ins: visible characters for themselves, the rest from U+0100 on
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in set(visible)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    spelled = [bytes(byte_of[c] for c in t) for t in tokens if all(c in byte_of for c in t)]
    single = [bytes([b]) for b in range(256)]
    return ([t[1:] for t in spelled if t.startswith(b" ") and len(t) > 1] + single,
            [t for t in spelled if not t.startswith(b" ")] + single)


@dataclass
class Automaton:
    """Transitions in a hash table (open addressing), failure links (-1: none)
    and popped-piece counts."""
    keys: np.ndarray
    values: np.ndarray
    fail: np.ndarray
    pops: np.ndarray

    @classmethod
    def of(cls, begin: Iterable[bytes], more: Iterable[bytes]) -> Automaton:
        children: list[dict[int, int]] = [{}, {}]
        is_piece = [False, False]
        for root, pieces in ((BEGIN, begin), (CONTINUE, more)):
            for piece in pieces:
                node = root
                for b in piece:
                    nxt = children[node].get(b)
                    if nxt is None:
                        nxt = children[node][b] = len(children)
                        children.append({})
                        is_piece.append(False)
                    node = nxt
                if piece:
                    is_piece[node] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        level = [BEGIN, CONTINUE]
        while level:  # breadth first: links of shorter nodes are known
            below = []
            for node in level:
                for b, child in children[node].items():
                    below.append(child)
                    if is_piece[child]:
                        fail[child], pops[child] = CONTINUE, 1
                        continue
                    at, popped = fail[node], pops[node]
                    while at >= 0 and b not in children[at]:
                        popped, at = popped + pops[at], fail[at]
                    if at >= 0:
                        fail[child], pops[child] = children[at][b], popped
            level = below
        n = sum(map(len, children))
        size = 1 << max(4, (2 * n).bit_length())
        keys, values = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32)
        for node, of in enumerate(children):
            for b, child in of.items():
                key = node * 256 + b
                at = cls._slot(key, size)
                while keys[at] >= 0:
                    at = (at + 1) % size
                keys[at], values[at] = key, child
        return cls(keys, values, np.array(fail, dtype=np.int32), np.array(pops, dtype=np.int64))

    @staticmethod
    def _slot(key, size: int):
        return (key * 0x9E3779B1 >> 7) & size - 1

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children by byte, -1 where there is none."""
        key = node.astype(np.int64) * 256 + byte
        at = self._slot(key, len(self.keys))
        out = np.full(len(key), -1, dtype=np.int32)
        todo = np.arange(len(key))
        while len(todo):
            held = self.keys[at[todo]]
            found = held == key[todo]
            out[todo[found]] = self.values[at[todo[found]]]
            todo = todo[~found & (held >= 0)]
            at[todo] = (at[todo] + 1) & len(self.keys) - 1
        return out

    @cached_property
    def _plain(self) -> tuple[dict[int, int], list[int], list[int]]:
        """Transitions, links and pops for the walk of single words."""
        held = self.keys >= 0
        return dict(zip(self.keys[held].tolist(), self.values[held].tolist())), self.fail.tolist(), self.pops.tolist()

    def _walk(self, word: bytes, node: int, pieces: int) -> tuple[int, int]:
        """(node, pieces) after the bytes of ``word``; node -1: it cannot be spelled."""
        children, fail, pops = self._plain
        for b in word:
            while (child := children.get(node * 256 + b)) is None:
                if fail[node] < 0:
                    return -1, pieces
                pieces, node = pieces + pops[node], fail[node]
            node = child
        return node, pieces

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Pieces of each word ``data[start:end]``."""
        n = len(start)
        node, pieces, known = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        order = np.argsort(start - end, kind="stable")  # longest first: the live words are a prefix
        size = (end - start)[order]
        live = n
        for p in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size[:live], -p, side="left"))
            if live <= FEW:
                for w in order[:live][known[order[:live]]].tolist():
                    rest = data[start[w] + p:end[w]].tobytes()
                    node[w], pieces[w] = self._walk(rest, int(node[w]), int(pieces[w]))
                    known[w] = node[w] >= 0
                break
            todo = order[:live][known[order[:live]]]
            byte = data[start[todo] + p]
            while len(todo):
                child = self.step(node[todo], byte)
                hit = child >= 0
                node[todo[hit]] = child[hit]
                todo, byte = todo[~hit], byte[~hit]
                back = self.fail[node[todo]]
                known[todo[back < 0]] = False
                todo, byte, back = todo[back >= 0], byte[back >= 0], back[back >= 0]
                pieces[todo] += self.pops[node[todo]]
                node[todo] = back
        todo = np.flatnonzero(known & (node != CONTINUE) & (end > start))
        while len(todo):  # pop what the last node still holds
            back = self.fail[node[todo]]
            known[todo[back < 0]] = False
            todo, back = todo[back >= 0], back[back >= 0]
            pieces[todo] += self.pops[node[todo]]
            node[todo] = back
            todo = todo[back != CONTINUE]
        return np.where(known, pieces, 1)


def count_pieces(docs: DataFrame, begin: Iterable[bytes], more: Iterable[bytes]) -> DataFrame:
    """``doc_id, n_words, n_pieces`` of every row of ``docs`` (``doc_id, text``).

    The automaton is broadcast; its size is that of the vocabulary."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton.of(begin, more))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value
        for batch in batches:
            texts = batch.column("text")
            for a, b in segment.slices(texts):
                w = segment.split(texts.slice(a, b - a))
                _, first, which = np.unique(segment.hashes(w), return_index=True, return_inverse=True)
                pieces = automaton.counts(w.data, w.start[first], w.end[first])[which]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(w.per_doc().astype(np.int64)),
                     pa.array(w.per_doc(pieces).astype(np.int64))], names=["doc_id", "n_words", "n_pieces"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, n_pieces bigint")
