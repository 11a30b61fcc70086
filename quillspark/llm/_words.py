"""Vectorised words, word hashes and word windows of whole texts, in numpy.

Texts are handled as UTF-8 bytes in blocks of bounded size, so memory follows the block (or the
longest single text), never the table.  A word is a maximal run of bytes other than space and
09-0D, which is the contract's ``[^\\x20\\x09-\\x0D]+``: those six bytes never occur inside a
multi-byte character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Multipliers of the two polynomial hashes (odd, so invertible modulo 2**64).
_R_BYTE, _R_WORD = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, b, U64)
            row[0] = 1
            out.append(np.cumprod(row, dtype=U64))
        _tables[base] = have = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; works on a copy."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Words:
    """The words of a list of texts: byte places, 64-bit hashes and each text's range of words."""

    def __init__(self, texts: list[bytes], lower: bool = False, space: np.ndarray = _SPACE):
        joined = b" ".join(texts)
        if lower:
            joined = joined.lower()  # of bytes: A-Z alone
        self.raw = joined
        self.buf = buf = np.frombuffer(joined, np.uint8)
        gap = np.ones(len(buf) + 2, bool)
        gap[1:-1] = space[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        at = np.concatenate(([0], np.cumsum(sizes)))
        #: The words of text i are first[i] .. first[i + 1] - 1.
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        p, inv = powers(_R_BYTE, len(self.buf) + 1)
        total = np.empty(len(self.buf) + 1, U64)
        total[0] = 0
        np.cumsum(_BYTE[self.buf] * p[: len(self.buf)], out=total[1:])
        h = (total[self.end] - total[self.start]) * inv[self.start]
        return mix(h + (self.end - self.start).astype(U64))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each ``size`` consecutive word hashes, at the place of the first one."""
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    p, inv = powers(_R_WORD, len(h) + 1)
    total = np.empty(len(h) + 1, U64)
    total[0] = 0
    np.cumsum(h * p[: len(h)], out=total[1:])
    return mix((total[size:] - total[:n]) * inv[:n])


def starts_inside(first: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices where a window of ``size`` words lies in one text, and the text of each."""
    own = np.maximum(count - size + 1, 0)
    doc = np.repeat(np.arange(len(count)), own)
    skip = np.repeat(np.concatenate(([0], np.cumsum(own)[:-1])) if len(own) else own, own)
    return np.arange(len(doc)) - skip + first[:-1][doc], doc


def blocks(texts: list[bytes | None], most_bytes: int = 1 << 20, most_rows: int = 60_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most so many bytes (or one row) each."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if i > begin and (size + n > most_bytes or i - begin >= most_rows):
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """A string column as a list of bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def varied_ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, .. size[0] of them, then those from begin[1], and so on."""
    total = int(size.sum())
    if not total:
        return np.empty(0, np.int64)
    skip = np.concatenate(([0], np.cumsum(size)[:-1]))
    return np.arange(total) - np.repeat(skip, size) + np.repeat(begin, size)
