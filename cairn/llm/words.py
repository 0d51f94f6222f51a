"""Hashes of the words of many texts at once, in numpy."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_RNG = np.random.Generator(np.random.PCG64(20240229))
#: A 64-bit number for each byte, and for each place in a shingle.
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text[start:end], by running sums of a polynomial."""
    if len(_powers[0]) <= len(text):
        for k, m in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(text) + (1 << 16), m)]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[text] * _powers[0][: len(text)], dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * _powers[1][starts] + (ends - starts).astype(np.uint64))


def word_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by line feeds; starts and ends of their words there, and how many words come before each text and after the last."""
    joined = np.frombuffer(b"\n".join(texts), np.uint8)
    white = np.ones(len(joined) + 2, bool)
    white[1:-1] = (joined == 32) | (joined - np.uint8(9) < 5)
    edges = np.nonzero(white[1:] != white[:-1])[0]
    starts, ends = edges[0::2], edges[1::2]
    at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return joined, starts, ends, np.searchsorted(starts, at)


def shingle_hashes(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """The hashes of each text's runs of `size` words, repeats included, A-Z in lower case; of all its words if it has fewer; of none if it has none."""
    joined, starts, ends, upto = word_spans([t.lower() for t in texts])
    h = spans_hash(joined, starts, ends)
    n = len(h)
    runs = np.zeros(n, np.uint64)
    for k in range(size):
        runs[: max(0, n - k)] += h[k:] * _PLACE[k]
    runs = mix(runs)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(runs[a : b - size + 1])
        else:
            out.append(mix((h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)[None] + _PLACE[b - a]) if b > a else h[:0])
    return out
