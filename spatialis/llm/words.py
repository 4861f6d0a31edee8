"""Words of texts and their hashes, for operators that work on word sequences."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

_hashes: dict[bytes, int] = {}
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str | None, lower: bool) -> list[bytes]:
    """The runs of characters other than space and U+0009 to U+000D; A-Z lower-cased if asked."""
    own = (text or "").encode("utf-8", "surrogatepass")
    return (own.lower() if lower else own).split()


def hash_words(lists: list[list[bytes]]) -> np.ndarray:
    """64-bit hashes of the words of all lists, one after another. A bounded number is remembered."""
    if len(_hashes) > 200_000:
        _hashes.clear()
    for w in set(chain.from_iterable(lists)).difference(_hashes):
        _hashes[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_hashes.__getitem__, chain.from_iterable(lists)), np.uint64, sum(map(len, lists)))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of each pair (a, b)."""
    x = a * _M1
    x += b
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    x *= _M1
    x ^= x >> np.uint64(32)
    return x


def shifted(a: np.ndarray, n: int) -> np.ndarray:
    """a, n places on; the places at the end are 0."""
    out = np.zeros_like(a)
    out[: max(0, len(a) - n)] = a[n:]
    return out


def window_hashes(h: np.ndarray, sizes: list[int]) -> dict[int, np.ndarray]:
    """For each size, the hash of that many words from each place on; places whose window runs over the
    end are for the caller to leave out. Windows are put together from windows of powers of two."""
    powers = {1: h}
    n = 1
    while 2 * n <= max(sizes):
        powers[2 * n] = mix(powers[n], shifted(powers[n], n))
        n *= 2
    out = {}
    for size in sizes:
        parts = [p for p in sorted(powers, reverse=True) if size & p]
        own, at = powers[parts[0]], parts[0]
        for p in parts[1:]:
            own, at = mix(own, shifted(powers[p], at)), at + p
        out[size] = own
    return out
