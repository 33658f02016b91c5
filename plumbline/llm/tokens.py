"""Token ids of whole texts, with a bounded cache of encoded words inside each Python worker.

Both tokenizers cut a text before they merge bytes, and neither cut can reach over a single space or line break that
follows a visible character. So a text is encoded word by word, and words seen before come from a dictionary. Columns of
texts are split and their distinct words found by Arrow; each of those is looked up once, letters apart from the
punctuation behind them. The ids equal those of the whole text; the tests hold the two against each other.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from plumbline.llm import words

#: Encoded words of the young half of a worker's cache. When it is full it becomes the old half, and what was not met
#: again since it grew old is forgotten; this changes speed only.
CACHED_WORDS = 250_000
#: Bytes of texts whose words are looked up together; a longer text stands alone.
GROUP_BYTES = 4_000_000

_SPACES = re.compile(r"\s\s")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Letters that ``_Words`` takes as they are, all of those below U+0130.
_PLAIN_LETTERS = r"\A[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}]+\z"


def _byte_letters() -> dict[int, str]:
    """Latin-1 character to the letter that byte-level vocabularies write for that byte: itself if visible, else the next free one."""
    shown = {b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


class _Words(dict):
    """Word to ids as little-endian unsigned 32-bit bytes; ``lead`` stands before each word when it is encoded."""

    def __init__(self, tokenizer, lead: str):
        super().__init__()
        self.tokenizer, self.merge, self.lead = tokenizer, tokenizer.model.tokenize, lead
        normalizer = tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("Aa") == "aa"
        self.keeps_space = normalizer is None
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _letters(self, word: str) -> list[int] | None:
        """Ids of a word of plain letters, which is one piece to the tokenizer; None for any other word."""
        if not word.isalpha() or max(word) >= "\u0130":
            return None
        piece = word.lower() if self.lowers else word
        if self.keeps_space:
            piece = self.lead + piece
        return [t.id for t in self.merge(piece.encode().decode("latin-1").translate(_LETTERS))]

    def _encoded(self, word: str) -> bytes:
        if (ids := self._letters(word)) is not None:
            return array("I", ids).tobytes()
        stem = word.rstrip(_MARKS)
        if len(stem) < len(word) and stem and (ids := self._letters(stem)) is not None:
            return array("I", ids).tobytes() + self._marked(word[len(stem) :])
        return array("I", self.tokenizer.encode(self.lead + word, add_special_tokens=False).ids).tobytes()

    def _marked(self, marks: str) -> bytes:
        """Ids of punctuation behind letters, which both tokenizers cut off as one piece."""
        found = self.marks.get(marks)
        if found is None:
            if len(self.marks) >= 10_000:
                self.marks.clear()
            self.marks[marks] = found = array("I", self.tokenizer.encode(marks, add_special_tokens=False).ids).tobytes()
        return found

    def all(self, words: pa.Array) -> list[bytes]:
        """Ids of distinct words; letters are looked up once, whatever punctuation follows and whether they are capitals."""
        stems = pc.utf8_rtrim(words, _MARKS)
        letters = pc.match_substring_regex(stems, _PLAIN_LETTERS)
        stems = pc.if_else(letters, stems, None)
        coded = (pc.utf8_lower(stems) if self.lowers else stems).dictionary_encode()
        found = [b"" if stem is None else self[stem] for stem in coded.dictionary.to_numpy(zero_copy_only=False)]
        rows = zip(
            words.to_numpy(zero_copy_only=False),
            coded.indices.fill_null(-1).to_numpy().tolist(),
            pc.fill_null(pc.utf8_length(stems), 0).to_numpy().tolist(),
        )
        return [
            self[word] if code < 0 else found[code] if size == len(word) else found[code] + self._marked(word[size:])
            for word, code, size in rows
        ]

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._encoded(word)
        if len(self) >= CACHED_WORDS:
            self.old = self.copy()
            self.clear()
        self[word] = found
        return found


class _LaterWords(_Words):
    """Words after a space; those that begin with a line break stand for themselves, and what follows it has no space."""

    def __init__(self, tokenizer, first: _Words):
        super().__init__(tokenizer, " ")
        self.first, self.newline = first, first._encoded("\n")

    def _encoded(self, word: str) -> bytes:
        if word[:1] == "\n":
            return self.newline + (self.first._encoded(word[1:]) if len(word) > 1 else b"")
        return super()._encoded(word)


class Encoder:
    """One tokenizer file of the ``tokenizers`` library.

    Strings of special tokens in a text become those tokens, as the library has it; with ``special_as_text`` they are
    ordinary text.
    """

    def __init__(self, name: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        tokenizer.encode_special_tokens = special_as_text
        added = tokenizer.get_added_tokens_decoder().values()
        self.special = [] if special_as_text else [token.content for token in added]
        self.first = _Words(tokenizer, "")
        self.later = _LaterWords(tokenizer, self.first)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as bytes; a null text has none."""
        if not text:
            return b""
        if any(token in text for token in self.special):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if not self._plain(text):
            return b"".join(map(self.first.__getitem__, _CUT.split(text)))
        words = text.replace("\n", " \n").split(" ")
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))

    @staticmethod
    def _plain(text: str) -> bool:
        """Whether single spaces and line breaks cut the whole text into words."""
        return not (text[0].isspace() or text[-1].isspace() or _SPACES.search(text))

    def encode_all(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``encode`` of every text with ``end_id`` behind it, in groups of neighbours: first row, ends of rows, ids."""
        sizes = np.asarray(pc.fill_null(pc.cast(pc.binary_length(texts), pa.int64()), 0))
        upto, begin = np.cumsum(sizes), 0
        while begin < len(texts):
            stop = int(np.searchsorted(upto, upto[begin] - sizes[begin] + GROUP_BYTES, side="right"))
            stop = max(begin + 1, stop)
            yield begin, *self._group(texts.slice(begin, stop - begin), end_id)
            begin = stop

    def _group(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        rows = (text.as_py() for text in texts)
        plain = [bool(t) and not any(token in t for token in self.special) and self._plain(t) for t in rows]
        split = pc.split_pattern(pc.replace_substring(pc.if_else(pa.array(plain), texts, ""), "\n", " \n"), " ")
        words, begins = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = words.dictionary_encode()
        ids = self.later.all(coded.dictionary)
        # The first word of a row has no space before it; a row that is not cut here is one word.
        firsts = self.first.all(words.take(pa.array(begins[:-1])))
        own = [word if cut else self.encode(text.as_py()) for word, cut, text in zip(firsts, plain, texts)]
        places = coded.indices.to_numpy().copy()
        del split, words, coded
        places[begins[:-1]] = len(ids) + np.arange(len(own))
        places = np.insert(places, begins[1:], len(ids) + len(own))
        ids += [*own, np.array([end_id], dtype="<u4").tobytes()]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = pa.array(np.frombuffer(b"".join(ids), dtype="<u4"))
        table = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), table)
        ends = np.cumsum(np.add.reduceat(lengths[places], begins[:-1] + np.arange(len(own))))
        return ends, table.take(pa.array(places)).flatten().to_numpy()


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of this worker for a vocabulary file; read once per worker."""
    if name not in _ENCODERS:
        words.forget()  # a reused worker may still hold what the operator before it kept
        _ENCODERS.clear()
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())
