"""Words, shingles and MinHash signatures of a text, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = int(_rng.integers(0, 2**62)) * 4 + 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PIECE, _BLOCK = 1 << 20, 1 << 16
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(size: int) -> None:
    global _powers, _inverse
    if len(_powers) < size:
        size = max(size, 1 << 16)

        def powers(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)
        _powers, _inverse = powers(_BASE), powers(pow(_BASE, -1, 2**64))


def prefix_sums(symbols: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums from which span_hashes has the hash of any span of the symbols; each has its value."""
    _grow(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, np.uint64)
    for at in range(0, len(symbols), _BLOCK):
        block = values[symbols[at:at + _BLOCK]]
        block *= _powers[at:at + len(block)]
        np.cumsum(block, out=sums[at + 1:at + 1 + len(block)])
        sums[at + 1:at + 1 + len(block)] += sums[at]
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One hash per span of the values, the same wherever the span stands."""
    return mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of every `width` bytes in a row."""
    sums = prefix_sums(data, _BYTE)
    return mix((sums[width:] - sums[:-width]) * _inverse[:len(data) - width + 1])


def _piece_words(data: np.ndarray) -> np.ndarray:
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


def words(text: str | None) -> np.ndarray:
    """One hash per word: runs of anything but ASCII white space, A-Z lower-cased."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    if len(data) <= _PIECE:
        return _piece_words(np.frombuffer(data, np.uint8))
    whole = np.frombuffer(data, np.uint8)
    spaces = np.flatnonzero(_SPACE[whole])
    out, at = [], 0
    while at < len(whole):  # pieces end at white space, so no word is cut
        nearest = np.searchsorted(spaces, min(at + _PIECE, len(whole)))
        to = int(spaces[nearest]) + 1 if nearest < len(spaces) else len(whole)
        out.append(_piece_words(whole[at:to]))
        at = to
    return np.concatenate(out)


def shingles(word_hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n words in a row; fewer words count as one sequence."""
    count = len(word_hashes)
    if not count:
        return np.empty(0, np.uint64)
    width = min(n, count)
    total = np.full(count - width + 1, np.uint64(width))
    for i in range(width):
        total = mix(total + word_hashes[i:count - width + 1 + i])
    return np.unique(total)


def minhash(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Smallest of the items under each of len(factors) multiplicative hashes."""
    short = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        part = np.multiply.outer(factors, short[at:at + 1024]).min(axis=1)
        np.minimum(out, part, out=out)
    return out


def odd_factors(count: int, seed: int = 1) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**32, count, dtype=np.uint32) | np.uint32(1)
