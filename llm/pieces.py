"""Exact batch encoding with a `tokenizers` vocabulary that drops white space (word-end BPE).

The encoder splits text at white space and between letters and marks before it merges, so the ids of
a text are the ids of its pieces, one after the other. A batch of texts is cut into pieces in one pass
over its bytes, equal pieces are found by Arrow's dictionary encoding, and only pieces not seen before go
through the tokenizer. A cut is made only where it cannot change the ids:

* before and after an ASCII space, tab, line feed or carriage return (they are dropped, nothing composes
  with them),
* between two ASCII bytes of different kind (letter, digit, mark; the apostrophe is not cut off), and
  between digits: both sides are separate words for the pre-tokenizer, and ASCII next to ASCII never
  composes.

ASCII capitals are lowered before pieces are compared if an ASCII byte follows (else a combining mark
might compose with one case and not with the other). A text that holds the string of a special token
goes through the tokenizer whole. New pieces that are one normal word already (most are) go through
the vocabulary's own merge model in one call, without normalising and pattern matching them again.
"""
from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Pieces remembered by one Python worker, about 150 bytes each. Others are encoded again when they return.
REMEMBERED = 400_000
#: Bytes of text cut into pieces at a time.
SLICE = 1 << 20

_CLASS = np.full(256, 3, np.uint8)          # other ASCII: marks
_CLASS[48:58] = 4                           # digits
_CLASS[[9, 10, 13, 32]] = 0                 # white space that is cut
_CLASS[65:91] = _CLASS[97:123] = 1          # letters
_CLASS[128:] = 2                            # bytes of longer characters and the apostrophe: no cut beside
_CLASS[39] = 2
#: _CUT[a, b]: a piece begins at a byte of class b that follows one of class a.
_CUT = np.zeros((5, 5), bool)
_CUT[0, 1:] = _CUT[:, 0] = True
_CUT[0, 0] = False
_CUT[1, 3:] = _CUT[3:, 1] = _CUT[3, 4] = _CUT[4, 3:] = True


def text_array(texts: pa.Array) -> pa.Array:
    """Null texts become empty ones; the offsets are 64 bit, so a batch may hold any amount of text."""
    return pa.compute.fill_null(texts.cast(pa.large_string()), "")


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in a row (a view), and where each text begins (one more entry for the end)."""
    texts = text_array(texts)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i] + 1, ... of all i in a row, lengths[i] of each."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)


class Encoder:
    """Ids of texts, exactly as `Tokenizer.encode(text, add_special_tokens=False)` gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs as many tasks as there are cores
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)
        self.merges.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.last[[i for w, i in vocab.items() if w.endswith("</w>")]] = True
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.seen: dict[bytes, int] = {}
        self.start, self.length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.filled = np.zeros(4096, np.uint32), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _plain(word: str) -> bool:
        """One word for the pre-tokenizer, and as the normaliser would leave it."""
        if word.isascii():
            return word.isalpha() and word == word.lower() or not (word.isalnum() or "'" in word or any(c.isalnum() or c <= " " or c == "\x7f" for c in word))
        return word.isalpha() and max(word) < "\u0250" and word == word.lower() and unicodedata.is_normalized("NFC", word)

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and the number of ids of each."""
        texts = [w.decode() for w in words]
        plain = np.fromiter(map(self._plain, texts), bool, len(texts))
        n = np.zeros(len(texts), np.int64)
        some = [t for t, p in zip(texts, plain, strict=True) if p]
        flat = np.asarray(self.merges.encode_batch_fast([" ".join(some)])[0].ids if some else [], np.uint32)
        n[plain] = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        rest = self._encode([t for t, p in zip(texts, plain, strict=True) if not p])
        n[~plain] = [len(x) for x in rest]
        ids = np.empty(int(n.sum()), np.uint32)
        own = np.repeat(plain, n)
        ids[own] = flat
        ids[~own] = [i for x in rest for i in x]
        return ids, n

    def _slots(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word lie: starts and lengths in the returned pool."""
        at = np.fromiter((self.seen.get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        start, length = self.start[at], self.length[at]
        pool = self.pool
        if len(new):
            flat, n = self._new([words[i] for i in new])
            begin = self.filled + np.cumsum(n) - n
            while len(self.pool) < self.filled + len(flat):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            self.pool[self.filled:self.filled + len(flat)] = flat
            pool, start[new], length[new] = self.pool, begin, n
            keep = max(0, min(len(new), REMEMBERED - len(self.seen)))
            while len(self.start) < len(self.seen) + keep:
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            base = len(self.seen)
            self.start[base:base + keep], self.length[base:base + keep] = begin[:keep], n[:keep]
            self.seen.update((words[i], base + k) for k, i in enumerate(new[:keep]))
            self.filled += int(n[:keep].sum())
        return pool, start, length

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32), and the number of ids of each text.

        Memory beyond the texts and ids is bounded: about `SLICE` bytes are worked on at a time, and a longer
        text is cut at white space.
        """
        raw, off = flat_bytes(texts)
        cuts = off
        if len(raw) > SLICE:
            inner = np.arange(SLICE, len(raw), SLICE)
            blank = [self._blank(raw, int(i)) for i in inner]
            cuts = np.union1d(off, np.asarray(blank, np.int64))
        ids, counts, i = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while i < len(cuts) - 1:
            j = max(i + 1, int(np.searchsorted(cuts, cuts[i] + SLICE, side="right")) - 1)
            own, n = self._slice(raw[cuts[i]:cuts[j]], cuts[i:j + 1] - cuts[i])
            ids.append(own)
            counts.append(n)
            i = j
        flat, n = np.concatenate(ids), np.concatenate(counts)
        before = np.concatenate([[0], np.cumsum(n)])
        counts = np.diff(before[np.searchsorted(cuts, off)]) if len(cuts) != len(off) else n
        return self._mend(raw, off, flat, counts) if self._special_in(raw) else (flat, counts)

    @staticmethod
    def _blank(raw: np.ndarray, at: int) -> int:
        """The first white space from here, or the end."""
        while at < len(raw):
            hit = np.flatnonzero(_CLASS[raw[at:at + 4096]] == 0)
            if len(hit):
                return at + int(hit[0])
            at += 4096
        return len(raw)

    def _slice(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        kind = _CLASS[raw]
        cut = np.empty(len(raw), bool)
        cut[0] = True
        cut[1:] = _CUT[kind[:-1], kind[1:]]
        cut[off[:-1][off[:-1] < len(raw)]] = True
        ascii_next = np.ones(len(raw), bool)
        ascii_next[:-1] = raw[1:] < 128
        low = raw + np.uint8(32) * ((raw >= 65) & (raw <= 90) & ascii_next)
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(raw)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts),
                                       [None, pa.py_buffer(bounds), pa.py_buffer(low)]).dictionary_encode()
        code = pieces.indices.to_numpy()
        pool, start, length = self._slots(pieces.dictionary.to_pylist())
        keep = kind[starts] != 0
        n = length[code] * keep
        ids = pool[ragged(start[code][keep], n[keep])]
        before = np.concatenate([[0], np.cumsum(n)])
        return ids, np.diff(before[np.searchsorted(starts, off)])

    def _special_in(self, raw: np.ndarray) -> bool:
        data = raw.tobytes() if self.special else b""
        return any(s in data for s in self.special)

    def _mend(self, raw, off, ids, counts):
        parts, at = [], 0
        for i, n in enumerate(counts.tolist()):
            own = raw[off[i]:off[i + 1]].tobytes()
            part = ids[at:at + n]
            if any(s in own for s in self.special):
                part = np.asarray(self._encode([own.decode()])[0], np.uint32)
            parts.append(part)
            at += n
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each vocabulary and Python worker."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine; executors ask for it themselves."""
    import public_tokenizers

    return public_tokenizers.path(name)
