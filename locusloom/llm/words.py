"""Hashed word shingles of many texts at once, by array arithmetic on their bytes.

A word's hash is a polynomial in its bytes (each byte stands for a random 64-bit number) modulo 2^64,
read off one running sum over a run of texts, then mixed. A shingle's hash chains the hashes of its
words. Two different shingles of the same pair of texts share a hash with a chance below 1e-10 even
for sets of 20,000 shingles each, so sizes and intersections of hashed sets are those of the sets.
"""

from __future__ import annotations

import numpy as np

from locusloom.llm.common import chunks

_RNG = np.random.default_rng(20250711)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]  # words are compared in lower case, A to Z only
_BASE = int(_RNG.integers(2**40, 2**62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are worked on together, or one text.
CHUNK_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(1, dtype=np.uint64)
        while len(have) < n:
            step = np.uint64(pow(base, len(have), 2**64))
            have = np.concatenate([have, have * step])
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word in order, and the number of words up to the end of each text."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _power(_INVERSE, len(data))[start] + (end - start).astype(np.uint64))
    text_end = np.cumsum(lengths + 1)
    return hashes, np.searchsorted(start, text_end)


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    hashes, ends = _words(texts)
    grams = hashes.copy()
    for k in range(1, width):
        grams[:-k] = mix(grams[:-k] * np.uint64(0x9E3779B97F4A7C15) + hashes[k:]) if k < len(grams) else grams[:-k]
    out, start = [], 0
    for end in ends:
        n = end - start
        if n == 0:
            out.append(np.empty(0, dtype=np.uint64))
        elif n < width:  # too short: the whole sequence is the one shingle
            whole = np.uint64(n)
            for w in hashes[start:end]:
                whole = mix(np.array([whole * np.uint64(0xD6E8FEB86659FD93) + w]))[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            own = np.sort(grams[start:end - width + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        start = end
    return out


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text; null and wordless texts have none."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for a, b in chunks([len(x) for x in data], CHUNK_BYTES):
            out += _sets(data[a:b], width)
    return out
