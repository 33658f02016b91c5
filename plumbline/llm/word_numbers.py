"""Words of whole columns of texts as 64-bit numbers, a few passes over their bytes instead of a call for each word.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered. A word's number is the sum of a random number for each of its bytes
and their places, scrambled; words over ``_LONGEST`` bytes are hashed by themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm.words import mixed

#: Bytes of the texts that are hashed together, and one text more at most.
_PIECE = 1 << 19
_LONGEST = 64
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_NUMBERS = np.random.default_rng(20_240_802).integers(0, 2**64, (_LONGEST, 256), dtype=np.uint64)
_NUMBERS[:, ord("A") : ord("Z") + 1] = _NUMBERS[:, ord("a") : ord("z") + 1]
_NUMBERS = _NUMBERS.ravel()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of texts, one after another, and where each begins and the last ends; null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, dtype=np.uint8)[ends[0] : ends[-1]] if held is not None and ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    return data, ends - ends[0]


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and length of every word of texts as ``text_bytes`` gives them; no word goes over the end of a text."""
    solid = ~_SPACE[data]
    firsts, lasts = solid.copy(), solid.copy()
    firsts[1:] &= ~solid[:-1]
    lasts[:-1] &= ~solid[1:]
    whole = ends[1:] > ends[:-1]
    heads, tails = ends[:-1][whole], ends[1:][whole] - 1
    firsts[heads], lasts[tails] = solid[heads], solid[tails]
    firsts, lasts = np.flatnonzero(firsts), np.flatnonzero(lasts)
    return firsts, lasts - firsts + 1


def _numbers(data: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    if not len(firsts):
        return np.zeros(0, dtype=np.uint64)
    heads = lengths.cumsum() - lengths
    place = np.arange(heads[-1] + lengths[-1]) - np.repeat(heads, lengths)
    place = np.minimum(place, _LONGEST - 1) << 8 | data[~_SPACE[data]]
    found = mixed(np.add.reduceat(_NUMBERS[place], heads))
    for i in np.flatnonzero(lengths > _LONGEST):
        word = data[firsts[i] : firsts[i] + lengths[i]].tobytes().lower()
        found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return found


def hash_words(words: list[bytes]) -> np.ndarray:
    """Numbers of words without white space."""
    data = np.frombuffer(b" ".join(words), dtype=np.uint8)
    return _numbers(data, *word_places(data, np.array([0, len(data)])))


def pieces(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch with the bytes of their texts, ``_PIECE`` bytes and one text more at most."""
    data, ends = text_bytes(batch.column(column))
    first = 0
    while first < len(batch):
        last = min(max(first + 1, int(np.searchsorted(ends, ends[first] + _PIECE))), len(batch))
        yield batch.slice(first, last - first), data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last


def hashed(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of a batch, the numbers of all words of their texts and how many words each text has."""
    for piece, data, ends in pieces(batch, column):
        firsts, lengths = word_places(data, ends)
        yield piece, _numbers(data, firsts, lengths), np.diff(np.searchsorted(firsts, ends))
