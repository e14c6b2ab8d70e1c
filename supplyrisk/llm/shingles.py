"""Vectorised word and shingle hashing of text chunks (numpy, inside tasks).

A chunk is a list of UTF-8 texts joined by a separator byte.  Word hashes
come from one running sum over the chunk: ``sum(table[byte] * B^i)``
between a word's ends, times ``B^-start``, all modulo 2^64, then mixed.
``table`` folds case and marks separators, so no text is rewritten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15          # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEPS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                   0x589965CC75374CC3], dtype=np.uint64)   # fixed odd factors, one per word of a shingle
_SHORT = np.uint64(0x1D8E4E27C47D124F)

_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers.append(np.cumprod(steps, dtype=np.uint64))
    return _powers


def byte_table(separators: bytes, fold: bool = True) -> np.ndarray:
    """Random 64-bit value per byte, upper case ASCII as lower case, 0 for separators."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)
    if fold:
        table[65:91] = table[97:123]
    table[list(separators)] = 0
    return table


ASCII_SPACE = bytes([32, *range(9, 14)])
#: For normalised words: every ASCII byte but letters and digits separates.
NOT_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())


def word_hashes(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, index of its text)."""
    sep = bytes([int(np.flatnonzero(table == 0)[-1])])
    joined = sep + sep.join(texts) + sep
    buf = np.frombuffer(joined, np.uint8)
    values = table[buf]
    inside = values != 0
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(buf))
    values *= power[:len(buf)]
    total = np.cumsum(values, dtype=np.uint64)
    hashes = mix((total[ends - 1] - total[starts - 1]) * inverse[starts])
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text_starts = np.concatenate([[1], 1 + np.cumsum(sizes)])
    return hashes, np.searchsorted(text_starts, starts, side="right") - 1


def word_counts(owner: np.ndarray, n_texts: int) -> np.ndarray:
    return np.bincount(owner, minlength=n_texts)


def shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, text index, first word) of every shingle; a shorter text is one shingle of all its words."""
    n = len(hashes)
    counts = word_counts(owner, n_texts)
    m = max(n - width + 1, 0)
    value = np.zeros(m, dtype=np.uint64)
    for k in range(width):
        value += hashes[k:k + m] * _STEPS[k]
    whole = owner[:m] == owner[width - 1:width - 1 + m]
    at = np.flatnonzero(whole)
    value, who = mix(value[at]), owner[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)])[short]
        extra = counts[short].astype(np.uint64) * _SHORT
        for k in range(width - 1):
            has = counts[short] > k
            extra[has] += hashes[first[has] + k] * _STEPS[k]
        value = np.concatenate([value, mix(extra)])
        who, at = np.concatenate([who, short]), np.concatenate([at, first])
    return value, who, at


def chunks(texts: list[bytes], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Index ranges of about ``limit`` bytes; a longer text is a chunk by itself."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def utf8(column) -> list[bytes]:
    """Texts of an Arrow string column as bytes, null as empty."""
    import pyarrow as pa
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]
