"""Word and shingle hashes of whole batches of texts with array operations instead of a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64)
_IS_WORD = np.array([chr(b).isalnum() or b == 95 if b < 128 else True for b in range(256)])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64, at least ``n`` of each."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _POWERS:
        if len(_POWERS) > 1:
            _POWERS.clear()
        with np.errstate(over="ignore"):
            _POWERS[size] = tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_P, _INVERSE))
    return _POWERS[size]


def spans(sizes: list[int], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to at most ``most`` (a larger item is a range of its own), so long texts don't meet in one array."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * _MIX[0]
        h = (h ^ (h >> np.uint64(27))) * _MIX[1]
        return h ^ (h >> np.uint64(31))


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index, first byte and start within the joined batch of every word (runs of letters, digits and non-ASCII bytes)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    edges = np.diff(np.concatenate([[False], _IS_WORD[data], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    power, inverse = powers(len(data))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)], dtype=np.uint64)])
        h = mix((sums[end] - sums[start]) * inverse[start])
    return h, np.searchsorted(begins, start, side="right") - 1, data[start], start


def shingles(texts: list[str], width: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; a shorter text is one shingle, one without words an empty array."""
    h, doc, _, _ = words([t.encode() for t in texts])
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for i in range(width):
            acc = acc * _P + h[i : len(acc) + i]
        acc = mix(acc)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= width:
                out.append(np.unique(acc[a : b - width + 1]))
            elif b > a:
                out.append(mix(np.array([np.bitwise_xor.reduce(h[a:b] * np.arange(3, 2 * (b - a) + 3, 2, dtype=np.uint64))], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def simhash(hashes: np.ndarray) -> int:
    """64-bit SimHash as a signed number; 0 without shingles."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits((bits * 2 > len(hashes)).astype(np.uint8)).view(np.int64)[0])
