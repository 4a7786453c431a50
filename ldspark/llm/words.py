"""Words of a text as 64-bit hashes, made for whole texts at once."""

from __future__ import annotations

import numpy as np

#: Bytes that go through numpy at once; a longer text is cut at a byte outside of words.
PART = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _powers(p: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.full(n, p, np.uint64)]).cumprod(dtype=np.uint64)


_UP: np.ndarray | None = None
_DOWN: np.ndarray | None = None


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def _part(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words in at most 2 PART bytes: with prefix sums of b[i] p**i modulo 2**64, a word's
    sum times p**-start does not depend on where it stands."""
    global _UP, _DOWN
    if _UP is None:
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        _UP, _DOWN = _powers(_P, 2 * PART), _powers(inverse, 2 * PART)
    inside = np.concatenate([[False], _IN_WORD[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _UP[: len(raw)], out=sums[1:], dtype=np.uint64)
    return mix((sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word: runs of ASCII letters and digits and of any other non-ASCII character, in
    lower case. Empty for null or empty text."""
    raw = np.frombuffer((text or "").lower().encode("utf-8"), np.uint8)
    if len(raw) <= PART:
        return _part(raw)
    out, at = [], 0
    while at < len(raw):
        end = min(at + PART, len(raw))
        if end < len(raw):  # a cut outside of words, or after PART more bytes of one word
            gap = np.flatnonzero(~_IN_WORD[raw[end : end + PART]])
            end += int(gap[0]) if len(gap) else min(PART, len(raw) - end)
        out.append(_part(raw[at:end]))
        at = end
    return np.concatenate(out)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words; fewer words are one shingle, none no shingle."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ words[k : k + n]) * _P
        h ^= h >> np.uint64(32)
    return mix(h)
