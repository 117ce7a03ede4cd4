"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
_of_byte = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            with np.errstate(over="ignore"):
                factors = np.full(max(n, 1 << 21), base, np.uint64)
                factors[0] = 1
                _powers[k] = np.cumprod(factors)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each word (a run of characters that are no ASCII white space, A-Z lower-cased), and
    the number of words before each text's first, and in all."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2, np.zeros(len(texts) + 1, np.int64))
    gap = _space[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_of_byte[_lower[data]] * power[: len(data)], out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * inverse[start])
    text_at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])])
    return hashes, start, end, np.searchsorted(start, text_at)


def shingles(texts: list[str | None], k: int):
    """For each text its distinct shingles of ``k`` words, ascending, and the bytes of each one's words, which white space
    does not change; a text with fewer words has its whole sequence as its one shingle, one without words none."""
    h, start, end, first = words(texts)
    n, long = len(h) - k + 1, np.concatenate([[0], np.cumsum(end - start)])
    if n > 0:
        whole = np.zeros(n, np.uint64)
        for j in range(k):
            whole = mix(whole * np.uint64(0xD6E8FEB86659FD93) + h[j : j + n] + np.uint64(j + 1))
        span = long[k:] - long[:n]
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            found, at = np.unique(whole[a : b - k + 1].view(np.int64), return_index=True)
            yield found, span[a : b - k + 1][at]
        elif b > a:
            one = np.uint64(b - a)
            for j in range(a, b):
                one = mix(np.array([one * np.uint64(3) + h[j]], np.uint64))[0]
            yield np.array([one], np.uint64).view(np.int64), np.array([long[b] - long[a]])
        else:
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)


def fingerprint(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes."""
    h = found.view(np.uint64)
    a, b = mix(h + np.uint64(1)).sum(dtype=np.uint64), mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


np.seterr(over="ignore")
