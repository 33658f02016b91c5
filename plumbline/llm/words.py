"""Words of whole texts as 64-bit numbers, inside Python workers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Hashed words that a worker keeps; beyond it the dictionary is emptied, which changes speed only.
CACHED_WORDS = 250_000
_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return found


_HASHES = _Hashes()


def forget() -> None:
    """Empty the cache of this worker and return what Arrow has freed."""
    _HASHES.clear()
    pa.default_memory_pool().release_unused()


def split_words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` with A-Z lowered, as UTF-8; bytes methods touch ASCII only, as asked for."""
    return text.encode().lower().split() if text else []


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _ONE
        x = (x ^ (x >> np.uint64(27))) * _TWO
        return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, in order; of the whole sequence if it is shorter; none for no words."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - size + 1)
    total = np.full(n, min(size, len(hashes)), dtype=np.uint64)
    for k in range(min(size, len(hashes))):
        total = mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return total
