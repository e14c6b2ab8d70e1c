"""Encoders over vocabulary files of the ``tokenizers`` library, with a word cache.

Both vocabularies split a text by a fixed pattern before they merge bytes, so
the ids of a text are the ids of its pieces in order.  Pieces repeat, so each
Python worker keeps the ids of those it has met.  The cache is bounded and
only saves time: a piece's ids do not depend on it.

A text of plain characters (ASCII, white space included, and precomposed
Latin-1 letters) is split by the vocabulary's own pattern and each piece goes
to the library's BPE model.  Any other text is cut into chunks where the
splitter always cuts: plain chunks go the same way, others through the whole
tokenizer.  So does a text that holds the string of an added token
(``<|endoftext|>``): as the library reads it by default, it is that token.

* ``byte`` (byte-level BPE): always cuts before a space that stands between
  other characters than white space; tokens hold a space only at their start.
* ``word`` (BPE with word ends): cuts at spaces and newlines, which it drops.

Long texts are encoded a stretch at a time, cut at such places.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from tokenizers import Tokenizer

END_ID = 0
CACHE_LIMIT = 600_000

_LOWER = "a-zß-öø-ÿ"
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
STRETCH = 1_000_000   # characters split at a time


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins of byte-level vocabularies: printable bytes stay, the others follow 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(other)}}


_STAND_IN = {chr(b): c for b, c in _byte_letters().items()}
_SPACE = _STAND_IN[" "]
_STAND_IN = str.maketrans(_STAND_IN)


class _Cache(dict):
    """chunk -> ids as little-endian uint32 bytes; two generations, so frequent chunks outlive rare ones."""

    def __init__(self, miss):
        super().__init__()
        self._miss, self._old = miss, {}

    def __missing__(self, chunk):
        ids = self._old.get(chunk)
        if ids is None:
            ids = self._miss(chunk)
        self[chunk] = ids
        if len(self) >= CACHE_LIMIT:
            self._old = dict(self)
            self.clear()
        return ids


class Encoder:
    def __init__(self, path: str, kind: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        self.model = self.tokenizer.model
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=-1) + 1
        self.ids = [i.to_bytes(4, "little") for i in range(size)]
        self.chunks = _Cache(self._byte_chunk if kind == "byte" else self._word_chunk)
        self.pieces = _Cache(self._piece)
        self.split = self._byte_split if kind == "byte" else self._word_split
        self.foreign, self.words = (self._byte_text, self._byte_words) if kind == "byte" else (self._word_text, self._word_words)
        self.kind = kind

    def _whole(self, text: str) -> bytes:
        return b"".join([self.ids[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalnum():   # nothing but a space in front has a stand-in of its own
            byte = _SPACE + piece[1:] if piece[0] == " " else piece if piece[0].isalnum() else piece.translate(_STAND_IN)
        else:
            byte = piece.encode().decode("latin-1").translate(_STAND_IN)
        ids = self.ids
        return b"".join([ids[t.id] for t in self.model.tokenize(byte)])

    # byte-level
    _byte_plain = re.compile(rf"[ -~{_LETTER}]*\Z").match
    _byte_pieces = re.compile(rf"{_ENDINGS}| ?[{_LETTER}]+| ?[0-9]+| ?[^ 0-9{_LETTER}]+| +").findall
    _byte_cut = re.compile(r"(?= \S)").split
    _byte_odd = re.compile(r" (?:\s|\Z)").search
    _byte_text = re.compile(rf"[^\t\n\r -~{_LETTER}]").search
    _byte_words = re.compile(rf"{_ENDINGS}| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+").findall

    def _byte_chunk(self, chunk: str) -> bytes:
        word = chunk[1:] if chunk[:1] == " " else chunk
        if word.isalpha() and self._byte_plain(word):
            return self._piece(chunk)
        # a chunk holds a space only in front, so no run of spaces is split here
        if " " not in chunk[1:] and chunk != " " and self._byte_plain(chunk):
            return b"".join(map(self.pieces.__getitem__, self._byte_pieces(chunk)))
        return self._whole(chunk)

    def _byte_split(self, text: str) -> list[str]:
        if "\0" in text or self._byte_odd(text):
            return self._byte_cut(text)
        return text.replace(" ", "\0 ").split("\0")

    # words
    _word_plain = re.compile(rf"[!-~{_LOWER}]*\Z").match
    _word_pieces = re.compile(rf"{_ENDINGS}|[{_LOWER}]+|[0-9]|[^0-9{_LOWER}]+").findall
    _word_text = re.compile(rf"[^\t\n\r -~{_LETTER}]").search
    _word_words = re.compile(rf"{_ENDINGS}|[{_LOWER}]+|[0-9]|[^\s0-9{_LOWER}]+").findall

    def _word_chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if low.isalpha() and self._word_plain(low) and len(low) == len(chunk):
            return self._piece(low)
        if self._word_plain(low) and len(low) == len(chunk):
            return b"".join(map(self.pieces.__getitem__, self._word_pieces(low)))
        return self._whole(chunk)

    def _word_split(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    _cut = re.compile(r"(?<=\S)(?= \S)").search

    def _stretches(self, text: str) -> Iterator[str]:
        """The text in parts of about STRETCH characters, cut where both splitters cut."""
        lo = 0
        while len(text) - lo > STRETCH and (m := self._cut(text, lo + STRETCH)):
            yield text[lo:m.start()]
            lo = m.start()
        yield text[lo:]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian uint32 bytes."""
        if len(text) > STRETCH and not self.added(text):
            return b"".join(map(self._encode, self._stretches(text)))
        return self._encode(text)

    def _encode(self, text: str) -> bytes:
        if self.added(text):
            return self._whole(text)
        if not self.foreign(text):
            return b"".join(map(self.pieces.__getitem__, self.words(text if self.kind == "byte" else text.lower())))
        return b"".join(map(self.chunks.__getitem__, self.split(text)))


_LOADED: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, kind: str) -> Encoder:
    """The worker's encoder for a vocabulary file; loaded once per Python worker."""
    if (path, kind) not in _LOADED:
        _LOADED[(path, kind)] = Encoder(path, kind)
    return _LOADED[(path, kind)]
