"""Words of whole batches of texts at once: lowered runs of letters, digits and characters beyond ASCII."""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .pieces import flat_bytes

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
#: Bytes worked on at a time.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        out = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, inverse))
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = SLICE
    while size < n + 1:
        size *= 2
    return powers(size)


def substring_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each raw[start:end]; equal strings have equal hashes wherever they stand."""
    up, down = _powers(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[raw] * up[:len(raw)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Cut(NamedTuple):
    raw: np.ndarray      # bytes of the slice, lowered
    starts: np.ndarray   # of its words
    ends: np.ndarray
    docs: np.ndarray     # the text of each word, numbered in the batch


def cut(texts: pa.Array, *, lower: bool = True, size: int = SLICE) -> Iterator[Cut]:
    """The words of a batch, slice by slice in order; longer texts are cut between words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    raw, off = flat_bytes(pc.utf8_lower(texts) if lower else texts)
    i = 0
    while i < len(raw):
        j = min(len(raw), i + size)
        while j < len(raw) and _WORD[raw[j]]:
            j += 1
        part = raw[i:j]
        word = _WORD[part]
        inner = off[(off > i) & (off < j)] - i
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = np.append(word[:-1] & ~word[1:], word[-1])
        first[inner] |= word[inner]
        last[inner - 1] |= word[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        yield Cut(part, starts, ends, np.searchsorted(off, starts + i, side="right") - 1)
        i = j


def coded(c: Cut) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word, equal for equal words, and the place in the slice of one word of each number."""
    bounds = np.concatenate([[0], np.stack([c.starts, c.ends], axis=1).ravel(), [len(c.raw)]]).astype(np.int64)
    bounds = bounds[np.append(True, np.diff(bounds) > 0)]
    runs = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(c.raw))])
    code = runs.dictionary_encode().indices.to_numpy()[np.searchsorted(bounds, c.starts)]
    place = np.full(int(code.max(initial=-1)) + 1, -1)
    place[code] = np.arange(len(code))
    number = np.cumsum(place >= 0) - 1  # runs between words have numbers too
    return number[code], place[place >= 0]


def hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in a row, and where each text's begin (with the end)."""
    parts, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for c in cut(texts):
        parts.append(substring_hashes(c.raw, c.starts, c.ends))
        docs.append(c.docs)
    counts = np.bincount(np.concatenate(docs), minlength=len(texts))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(counts)])


def by_size(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of text."""
    n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(n + 64) // size
    at = np.flatnonzero(np.diff(group, prepend=-1)).tolist() + [len(n)]
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield batch.slice(a, b - a)
