"""Token ids and counts with public tokenizers, cached by pieces of text that encode independently.

Both tokenizers cut a text before any space that stands between two characters other than white space, a
byte-level vocabulary also between a letter and a mark or line end after it, so pieces cut there encode on
their own.  Cuts are found on the bytes of a whole batch; Arrow numbers its different pieces, so Python looks
at each of these once a batch, and puts their codes together again.  Each Python worker keeps the codes of the
pieces it has met, in two generations bounded by bytes: when the younger is full it becomes the older, and
pieces met again move up.  Unseen pieces that are a Latin word are a word of a byte-level vocabulary and go to
its model directly; others are encoded in long strings, kept apart by a special token.  White space beside a
space stays inside a piece; texts that hold a special string are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa

from eventstrand.llm.common import kept_by_worker

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"
# Bytes of pieces and codes in a generation, with what Python adds to each.
GENERATION_BYTES, _ENTRY_BYTES = 112 << 20, 200
# Texts handed to an encoder at once are cut when their bytes reach this.
BATCH_BYTES = 2 << 20
_PIECES_AT_ONCE, _KEPT_MARKS = 2_000, 10_000

# Letters of which every version of Unicode says that they are such, and ASCII's marks but for the apostrophe, which
# begins contractions.  The pre-tokenizer cuts between the two and beside a line's end.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ASCII_MARKS = """!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"""
_MARKS = re.escape(_ASCII_MARKS)
_PLAIN = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)((?:\n[{_LETTERS}]+[{_MARKS}]*)*)")
_LINE = re.compile(f"([{_LETTERS}]+)([{_MARKS}]*)")
_WORD = re.compile(f" ?[{_LETTERS}]+")
_NEXT_LINE = re.compile(f"([{_MARKS}]*)\n([{_LETTERS}]+)")
# By byte: ASCII's letters, and what may follow a letter as a piece of its own.
_IS_LETTER, _IS_MARK = (
    np.isin(np.arange(256), [ord(c) for c in chars])
    for chars in ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", _ASCII_MARKS + "\n")
)


def byte_characters() -> dict[int, str]:
    """Byte-level vocabularies write a byte as a character: itself if printable, else the next one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}

# Unicode's White_Space characters.
_SPACES = (
    *"\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B))
)


def _beside_space(text: str) -> bool:
    """Does white space, or an end of the text, stand beside a space?"""
    return text[0] == " " or text[-1] == " " or any(
        c in text and (f" {c}" in text or f"{c} " in text) for c in _SPACES
    )


_CLASS = "".join(map(re.escape, (" ", *_SPACES)))
_SAFE = re.compile(f"(?<=[^{_CLASS}]) (?=[^{_CLASS}])")


def pieces(text: str) -> list[str]:
    """A text cut at the spaces between characters other than white space, where tokens end in any case."""
    return _SAFE.split(text) if _beside_space(text) else text.split(" ")


def _marks_after_letters(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 of ASCII's marks and line ends right after one of ``_LETTERS``."""
    at = np.flatnonzero(_IS_MARK[data])
    before, lead = data[at - 1], data[at - 2]  # a lead byte of two says that ``before`` is the second
    latin = (lead == 0xC3) & (before != 0x97) & (before != 0xB7) | (lead > 0xC3) & (lead < 0xC9)
    return at[_IS_LETTER[before] | latin | (lead == 0xC9) & (before < 0x90)]


def by_bytes(column: pa.Array, limit: int = BATCH_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes; a longer text is a slice of its own."""
    start, size = 0, 0
    for i in range(len(column)):
        here = len(column[i].as_buffer()) if column[i].is_valid else 0
        if i > start and size + here > limit:
            yield column.slice(start, i - start)
            start, size = i, 0
        size += here
    if start < len(column):
        yield column.slice(start)


class ByteWords:
    """Ids of Latin words, straight from the model of a byte-level BPE without the steps around it."""

    def __init__(self, tokenizer):
        model = tokenizer.model
        plain = tokenizer.normalizer is None and type(tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        plain = plain and type(model).__name__ == "BPE" and not (model.end_of_word_suffix or model.continuing_subword_prefix)
        self.model = model if plain else None
        self.characters = byte_characters()
        self.kept: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pre-tokenizer."""
        written = word.encode().decode("latin-1").translate(self.characters)
        return [t.id for t in self.model.tokenize(written)]

    def marks(self, marks: str) -> list[int]:
        ids = self.kept.get(marks)
        if ids is None:
            ids = self.word(marks)
            if len(self.kept) < _KEPT_MARKS and len(marks) < 9:
                self.kept[marks] = ids
        return ids

    def ids(self, piece: str) -> list[int] | None:
        """Ids of a piece with its space; None if it is not words with marks after them."""
        found = _PLAIN.fullmatch(piece) if self.model is not None else None
        if found is None:
            return None
        word, marks, lines = found.groups()
        ids = self.word(" " + word)
        if marks:
            ids = ids + self.marks(marks)
        for line in lines.split("\n")[1:]:
            word, marks = _LINE.fullmatch(line).groups()
            ids = ids + self.marks("\n") + self.word(word) + (self.marks(marks) if marks else [])
        return ids


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The codes of pieces: ``code`` turns a piece's ids into what is kept of them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.special = [t.content for t in added.values()]
        self.largest_id = max(self.tokenizer.get_vocab(with_added_tokens=True).values())
        self.apart_id, self.apart = next((i, t.content) for i, t in added.items())
        self.words = ByteWords(self.tokenizer)
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}
        self.held = 0

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _codes(self, texts: Sequence[str]) -> list:
        """Codes of pieces without special strings."""
        codes = []
        for at in range(0, len(texts), _PIECES_AT_ONCE):
            ids = self.ids(self.apart.join(texts[at : at + _PIECES_AT_ONCE]))
            ends = np.append(np.flatnonzero(ids == self.apart_id), len(ids)).tolist()
            start = 0
            for end in ends:
                codes.append(self.code(ids[start:end]))
                start = end + 1
        return codes

    def _cut(self, plain: list[str], odd: list[list[str]]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of plain texts, which are cut at every space, then of those cut at spaces already.

        Also the number of the first piece of every text, and of all.
        """
        units = pa.array(plain + [unit for text in odd for unit in text], pa.large_string())
        _, starts, data = units.buffers()
        starts = np.frombuffer(starts, np.int64, len(units) + 1)
        size = int(starts[-1])
        array = np.frombuffer(data, np.uint8, size)
        here = np.zeros(size + 1, bool)
        here[: starts[len(plain)]] = array[: starts[len(plain)]] == 0x20
        if self.words.model is not None:
            here[_marks_after_letters(array)] = True
        here[starts] = True
        places = np.flatnonzero(here)
        found = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places.astype(np.int64)), data)
        firsts = np.cumsum([0, *(len(text) for text in odd)]) + len(plain)
        return found, np.searchsorted(places, starts[np.concatenate([np.arange(len(plain)), firsts])])

    def encode(self, texts: Sequence[str | None]) -> list:
        """The code of every text; null is empty.  All are held at once, see :func:`by_bytes`."""
        found: list = [None] * len(texts)
        plain, odd = [], []
        for i, text in enumerate(texts):
            if not text or any(s in text for s in self.special):
                found[i] = self.code(self.ids(text or ""))
            elif _beside_space(text):
                head, *tail = _SAFE.split(text)
                odd.append((i, [head, *(" " + piece for piece in tail)]))
            else:
                plain.append((i, text))
        if plain or odd:
            cut, bounds = self._cut([text for _, text in plain], [units for _, units in odd])
            numbered = cut.dictionary_encode()
            codes = self._learn(numbered.dictionary.to_numpy(zero_copy_only=False).tolist())
            for (i, _), code in zip(plain + odd, self.gathered(codes, numbered.indices, bounds), strict=True):
                found[i] = code
        return found

    def _remember(self, piece: str, code) -> None:
        self.young[piece] = code
        self.held += _ENTRY_BYTES + len(piece) + (len(code) if isinstance(code, bytes) else 0)

    def _plain(self, piece: str):
        """Code of a Latin word, or of one that begins a line and the marks before that; None for other pieces."""
        words = self.words
        if words.model is None:
            return None
        if _WORD.fullmatch(piece):
            return self.word_code(words.word(piece))
        if found := _NEXT_LINE.fullmatch(piece):
            marks, word = found.groups()
            ids = words.marks(marks) if marks else []
            return self.word_code(ids + words.marks("\n") + words.word(word))
        return None

    def _learn(self, pieces: list[str]) -> list:
        """The codes of different pieces, all brought into the young generation."""
        if self.held > GENERATION_BYTES:
            self.old, self.young, self.held = self.young, {}, 0
        codes = list(map(self.young.get, pieces))
        others = []
        for i in [i for i, code in enumerate(codes) if code is None]:
            code = self.old.get(pieces[i])
            if code is None:
                code = self._plain(pieces[i])
            if code is None:
                others.append(i)
            else:
                self._remember(pieces[i], code)
                codes[i] = code
        for i, code in zip(others, self._codes([pieces[i] for i in others]), strict=True):
            self._remember(pieces[i], code)
            codes[i] = code
        return codes


class IdPieces(Pieces):
    """Codes are the ids as little-endian 32-bit bytes."""

    code = staticmethod(np.ndarray.tobytes)

    @staticmethod
    def word_code(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    @staticmethod
    def gathered(codes: list[bytes], places: pa.Array, bounds: np.ndarray) -> list[bytes]:
        """The codes at ``places``, joined between neighbouring ``bounds``."""
        _, offsets, data = pa.array(codes, pa.large_binary()).take(places).buffers()
        ends = np.frombuffer(offsets, np.int64, len(places) + 1)[bounds].tolist()
        data = memoryview(data)
        return [data[start:end].tobytes() for start, end in pairwise(ends)]


class CountPieces(Pieces):
    """Codes are numbers of tokens."""

    code = word_code = staticmethod(len)

    @staticmethod
    def gathered(codes: list[int], places: pa.Array, bounds: np.ndarray) -> list[int]:
        sums = np.append(0, np.cumsum(np.array(codes, np.int64)[places.to_numpy()]))
        return np.diff(sums[bounds]).tolist()


def _worker(kind: type, path: str):
    """One encoder per Python worker and vocabulary."""
    return kept_by_worker((kind, path), lambda: kind(path))


def encoder(path: str) -> IdPieces:
    return _worker(IdPieces, path)


def counter(path: str) -> CountPieces:
    return _worker(CountPieces, path)
