"""Word bounds and word hashes of Arrow text batches, computed with numpy.

The Python side of the text operators works on whole batches: the bytes of a
string column are classified once, word starts and ends come from the blank
mask, and 64-bit word hashes from prefix sums of a polynomial over random
byte values.  Two different words collide with a chance of about 2**-58.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# --- fixed values: the ASCII blanks ----------------------------------------------
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of text handled at once; a longer single text is handled alone.
SLICE_BYTES = 4 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


_steady = False


def steady_memory() -> None:
    """Let this worker give large arrays back as soon as they are freed: by
    default the C library and Arrow keep them for later, which adds up in
    workers that live through many stages."""
    global _steady
    if _steady:
        return
    _steady = True
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        m_mmap_threshold = -3
        ctypes.CDLL("libc.so.6").mallopt(m_mmap_threshold, 1 << 20)


@dataclass
class Words:
    """Words of a run of texts: ``data[start:end]`` each, ``doc`` the text's
    number in the run, ``n_docs`` texts in all."""
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    n_docs: int

    def per_doc(self, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.doc, weights=values, minlength=self.n_docs)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``most`` bytes together (one text at least)."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    ends = np.cumsum(size.astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto
        at = upto


def split(texts: pa.Array, lower: bool = False) -> Words:
    """Words of the texts (null: none), in order."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]:at[-1]] if data is not None else np.array([], np.uint8)
    at = at - at[0]
    if lower:
        raw = _LOWER[raw]
    inside = ~_BLANK[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[at] = True
    before = np.ones(len(raw), dtype=bool)
    before[1:] = ~inside[:-1]
    after = np.ones(len(raw), dtype=bool)
    after[:-1] = ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    return Words(raw, start, end, np.searchsorted(at, start, side="right") - 1, len(texts))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[data]


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    got = _powers.get(name)
    if got is None or len(got) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        got = np.full(size, base, dtype=np.uint64)
        got[0] = 1
        got = _powers[name] = np.multiply.accumulate(got)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(words: Words) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    n = len(words.data)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[words.data] * _power("up", _BASE, max(n, 1))[:n], out=sums[1:])
    back = _power("down", np.uint64(pow(int(_BASE), -1, 1 << 64)), max(n, 1))
    return mix((sums[words.end] - sums[words.start]) * back[words.start])
