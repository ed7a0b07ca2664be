"""Vectorised hashing of words, word shingles and byte windows over many texts at once.

All hashes are 64-bit. A prefix sum of ``table[byte] * base**i`` (modulo 2**64) gives the hash of any
byte range in one subtraction and one product, so no loop runs over words or positions.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 3
_INV = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


BYTES = _table(0x5851F42D4C957F2D)
#: ASCII letters hash alike in either case.
FOLDED = BYTES.copy()
FOLDED[65:91] = FOLDED[97:123]


def _pow(name: str, base: int, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 20)
        out = np.empty(size, U)
        out[0] = 1
        filled, step = 1, base
        while filled < size:
            take = min(filled, size - filled)
            out[filled : filled + take] = out[:take] * U(step)
            filled += take
            step = step * step & _MASK
        if size > 1 << 24:  # a single very long text: not kept
            return out
        _powers[name] = have = out
    return have


def prefix(buf: np.ndarray, table: np.ndarray = BYTES) -> np.ndarray:
    """Prefix sums, from 0, that :func:`ranges` reads."""
    out = np.empty(len(buf) + 1, U)
    out[0] = 0
    np.cumsum(table[buf] * _pow("base", _BASE, len(buf))[: len(buf)], out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; the same bytes at another place hash alike."""
    return mix((sums[ends] - sums[starts]) * _pow("inv", _INV, len(sums))[starts])


#: Fixed by the operators' contracts: words are runs of anything but space and U+0009..U+000D.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and any byte of a non-ASCII character.
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts; none crosses a text's end."""
    w = inside[buf]
    full = offs[1:] > offs[:-1]
    before = np.empty_like(w)
    after = np.empty_like(w)
    if len(w):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = w[:-1], w[1:]
        before[offs[:-1][full]] = False
        after[offs[1:][full] - 1] = False
    return np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1


def text_words(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray = NOT_SPACE, table: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the place of each text's first word (with the total at the end)."""
    starts, ends = word_spans(buf, offs, inside)
    return ranges(prefix(buf, table), starts, ends), np.searchsorted(starts, offs)


_STEP = U(0xD6E8FEB86659FD93)


def shingles(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each text, sorted inside the text, and each text's first place.

    A text of fewer than ``k`` words has one shingle, the whole sequence; one without words has none.
    """
    counts = np.diff(at)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out_at = np.zeros(len(at), np.int64)
    np.cumsum(n, out=out_at[1:])
    if out_at[-1] == 0:
        return np.zeros(0, U), out_at
    own = np.repeat(np.arange(len(n)), n)
    first = at[:-1][own] + (np.arange(out_at[-1]) - out_at[:-1][own])
    size = np.minimum(counts[own], k)
    h = words[first]
    top = len(words) - 1
    for j in range(1, k):
        more = h * _STEP + words[np.minimum(first + j, top)]
        h = more if counts.min() >= k else np.where(size > j, more, h)
    h = mix(h + size.astype(U) * U(0xA0761D6478BD642F))
    for d in np.flatnonzero(n > 1):
        h[out_at[d] : out_at[d + 1]].sort()
    keep = np.empty(len(h), bool)
    keep[0] = True
    keep[1:] = h[1:] != h[:-1]
    keep[out_at[:-1][n > 0]] = True
    seen = np.zeros(len(h) + 1, np.int64)
    np.cumsum(keep, out=seen[1:])
    return h[keep], seen[out_at]
