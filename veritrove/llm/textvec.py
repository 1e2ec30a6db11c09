"""Texts as byte arrays: words, their 64-bit hashes and n-word shingles, in numpy.

Everything works on slices of bounded size, so a worker's memory follows the
slice (or the longest single text), not the Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES, SLICE_TEXTS = 1 << 19, 1024

# what Arrow frees goes back to the system, not to a pool that each worker keeps
pa.set_memory_pool(pa.system_memory_pool())

_M = np.uint64(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (xor-shift and multiply) on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**i and M**-i for i < n, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE_BYTES + 4096)
        inverse = np.uint64(pow(int(_M), -1, 2**64))
        for k, m in (("up", _M), ("down", inverse)):
            p = np.full(n, m, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


@dataclass
class Slice:
    """Some consecutive texts of a batch."""

    lo: int  # index of the first text in the batch
    data: np.ndarray  # uint8, all bytes
    offsets: np.ndarray  # int64, len(texts) + 1, into data

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(texts: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of at most so many bytes (or one text) and SLICE_TEXTS texts. Nulls count as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    for at in range(0, len(texts), SLICE_TEXTS):
        part = texts.slice(at, SLICE_TEXTS).cast(pa.large_string()).fill_null("")
        off = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
        buf = part.buffers()[2]
        data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(part):
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
            yield Slice(at + lo, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lo = hi


@dataclass
class Words:
    start: np.ndarray  # byte of each word's start
    end: np.ndarray  # one past its last byte
    first: np.ndarray  # per text: index of its first word; len(texts) + 1
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(s: Slice, lower: bool = True, is_word: np.ndarray | None = None) -> Words:
    """Maximal runs of bytes that is_word holds for (default: no ASCII white space), none across texts."""
    data = _LOWER[s.data] if lower else s.data
    inside = is_word[data] if is_word is not None else ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[s.offsets] = True
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = False
        before[1:] = inside[:-1] & ~cut[1:-1]
        after[:-1] = inside[1:] & ~cut[1:-1]
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, s.offsets), data)


def hashes(w: Words) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    up, down = _power(len(w.data) + 1)
    total = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(_BYTE[w.data] * up[: len(w.data)], out=total[1:])
    return mix((total[w.end] - total[w.start]) * down[w.start] + (w.end - w.start).astype(np.uint64))


def hash_of(word: str) -> int:
    """The same hash of one word, as a signed 64-bit number."""
    s = next(slices(pa.array([word])))
    return int(hashes(Words(np.array([0]), np.array([len(s.data)]), np.array([0, 1]), s.data))[0].astype(np.int64))


def shingles(w: Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text, and their text's index, in order.

    A text of fewer words has its whole sequence as one; one without words has none."""
    count = w.counts
    full = np.maximum(count - n + 1, 0)
    text = np.repeat(np.arange(len(count)), full)
    base = np.zeros(len(full) + 1, np.int64)
    np.cumsum(full, out=base[1:])
    at = np.arange(base[-1]) - base[text] + w.first[text] if len(text) else np.zeros(0, np.int64)
    out = np.full(len(at), np.uint64(n))
    odd = np.uint64(0x2545F4914F6CDD1D)
    for k in range(n):
        out = out * odd + h[at + k]
    out = mix(out)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.empty(len(short), np.uint64)
        for i, t in enumerate(short):
            v = int(count[t])
            for x in h[w.first[t] : w.first[t + 1]].tolist():
                v = (v * int(odd) + x) % 2**64
            extra[i] = v
        text = np.concatenate([text, short])
        out = np.concatenate([out, mix(extra)])
        order = np.argsort(text, kind="stable")
        text, out = text[order], out[order]
    return out, text


def distinct(values: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order; text must be ascending."""
    if not len(values):
        return values, text
    v = values.copy()
    cut = np.flatnonzero(text[1:] != text[:-1]) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(v)]):
        v[a:b].sort()
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (text[1:] != text[:-1])
    return v[new], text[new]
