"""Vectorised word kernels for Arrow batches.

A batch's texts are joined with a line feed (a separator in every word
definition used here) and handled as one byte array, in blocks of whole texts
of about ``BLOCK`` bytes, so memory is bounded by the block or by the longest
single text.  Word and shingle hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK = 1 << 20
U64 = np.uint64
# The finaliser constants of the public-domain 64-bit murmur mix.
MIX_1, MIX_2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_S33 = U64(33)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: ``[^\x20\x09-\x0D]+``
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower case
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S33)
    x = x * MIX_1
    x ^= x >> _S33
    x *= MIX_2
    x ^= x >> _S33
    return x


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit multipliers, the same in every process."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


_powers = odd_constants(1, 11)[0] ** np.arange(256, dtype=U64)
_POSITION = odd_constants(64, 12)


def _power_table(n: int) -> np.ndarray:
    global _powers
    while len(_powers) < n:
        with np.errstate(over="ignore"):
            step = _powers[-1] * _powers[1]
            _powers = np.concatenate([_powers, _powers * step])
    return _powers


@dataclass
class Words:
    """Words of one block of texts; ``first[i]:first[i + 1]`` are those of text ``i``."""

    lo: int
    hi: int
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray
    raw: np.ndarray
    base: np.ndarray

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


def as_bytes(texts) -> list[bytes]:
    """Texts of an Arrow or Python column as UTF-8; null is empty."""
    values = texts.to_pylist() if hasattr(texts, "to_pylist") else texts
    return [t if isinstance(t, bytes) else b"" if t is None else t.encode("utf-8", "surrogatepass") for t in values]


def blocks(texts: list[bytes], size: int = BLOCK) -> Iterator[tuple[int, int]]:
    lo, total = 0, 0
    for i, t in enumerate(texts):
        if i > lo and total + len(t) > size:
            yield lo, i
            lo, total = i, 0
        total += len(t)
    if texts:
        yield lo, len(texts)


def words(texts: list[bytes], inside: np.ndarray, lower: bool = True, hashed: bool = True) -> Iterator[Words]:
    """Cut texts into words of the byte class ``inside``, block by block."""
    for lo, hi in blocks(texts):
        part = texts[lo:hi]
        raw = np.frombuffer(b"\n".join(part) + b"\n", dtype=np.uint8)
        size = np.fromiter((len(t) + 1 for t in part), dtype=np.int64, count=len(part))
        base = np.concatenate([[0], np.cumsum(size)])
        low = LOWER[raw] if lower else raw
        is_word = inside[low]
        change = np.flatnonzero(np.diff(is_word, prepend=False))
        starts, ends = change[0::2], change[1::2]
        doc = np.searchsorted(base, starts, side="right") - 1
        first = np.searchsorted(doc, np.arange(len(part) + 1))
        if hashed and len(starts):
            length = ends - starts
            at = np.cumsum(length) - length
            kept = low[is_word]
            place = np.arange(len(kept)) - np.repeat(at, length)
            with np.errstate(over="ignore"):
                h = np.add.reduceat((kept.astype(U64) + U64(1)) * _power_table(int(length.max()) + 1)[place], at)
                h = mix(h + length.astype(U64))
        else:
            h = np.zeros(len(starts), dtype=U64)
        yield Words(lo, hi, starts, ends, doc, first, h, raw, base)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; the caller keeps runs within one text."""
    if len(hashes) < n:
        return hashes[:0]
    with np.errstate(over="ignore"):
        out = hashes[: len(hashes) - n + 1] * _POSITION[0]
        for k in range(1, n):
            out = out + hashes[k : len(hashes) - n + 1 + k] * _POSITION[k]
        return mix(out)


def whole(hashes: np.ndarray) -> np.ndarray:
    """One hash for the whole sequence of words."""
    with np.errstate(over="ignore"):
        place = mix(np.arange(1, len(hashes) + 1, dtype=U64)) | U64(1)
        return mix(np.atleast_1d((hashes * place).sum(dtype=U64) + U64(len(hashes))))


def shingle_sets(texts: list[bytes], n: int, inside: np.ndarray = SPACED) -> Iterator[np.ndarray]:
    """The sorted distinct ``n``-word shingle hashes of each text.

    A text with fewer than ``n`` words has its whole sequence as one shingle;
    one without words has an empty set.
    """
    for w in words(texts, inside):
        all_grams = grams(w.hashes, n)
        for i in range(w.hi - w.lo):
            s = w.of(i)
            count = s.stop - s.start
            if count >= n:
                yield np.unique(all_grams[s.start : s.stop - n + 1])
            elif count:
                yield whole(w.hashes[s])
            else:
                yield w.hashes[:0]
