"""Sets of word shingles as 64-bit tokens, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed at once (a longer text goes alone); arrays take about 50 times as much.
CHUNK = 1 << 18
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
_PLACES = mix(np.arange(1, WIDTH + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, _U), np.full(max(n, CHUNK) - 1, b, _U)))) for b in (_U(_BASE), _U(pow(_BASE, -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


def _sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    a = np.frombuffer(b"\n".join(texts).translate(_LOWER), np.uint8)
    edge = np.diff(np.concatenate(([True], _SPACE[a], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(a) + 1)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(_BYTES[a] * up[: len(a)], dtype=_U)))
    h = mix((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(_U))
    borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, borders)
    n = max(0, len(h) - WIDTH + 1)
    joined = np.zeros(n, _U)
    for k in range(WIDTH):
        joined += h[k : k + n] * _PLACES[k]
    joined = mix(joined)
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= WIDTH:
            got = np.sort(joined[lo : hi - WIDTH + 1])
            yield got[np.concatenate(([True], got[1:] != got[:-1]))]
        elif hi > lo:
            yield mix((h[lo:hi] * _PLACES[: hi - lo]).sum(dtype=_U, keepdims=True) + _U(int(hi - lo)))
        else:
            yield np.empty(0, _U)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text the sorted distinct tokens of its WIDTH-word shingles (A-Z lower-cased, words
    parted by ASCII white space); of fewer words, one token for the whole sequence; without
    words or text, none."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > CHUNK:
            yield from _sets(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield from _sets(held)


def fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    one = mix(tokens)
    two = mix(one ^ _U(0x2545F4914F6CDD1D))
    return int(one.sum(dtype=_U).astype(np.int64)), int(np.bitwise_xor.reduce(two, initial=_U(0)).astype(np.int64))
