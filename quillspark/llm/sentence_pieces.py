"""SentencePiece encoding by batched numpy Viterbi, and decoding.

A text is normalised as its model says: the model's own rules, or where it has none its spaces become
U+2581 with one more in front.  It falls into units, each a run of U+2581
and what follows up to the next.  No piece reaches over a unit's start, so units are segmented on
their own, and each distinct one once by a worker.  Unseen units of equal length advance together:
at every end place the hashes of all substrings that end there are probed in the sorted piece
keys, and the vectorised maximum over them is stored with its backpointer.  In a unit of more than
``LONG`` characters all places are probed at once, a stretch at a time, before the maxima are taken.

The segmentation has the largest sum of the pieces' stored scores, added in 32-bit floats; between
equal sums the longest last piece wins.  A character that is no piece is written as its UTF-8 bytes'
pieces.  For a unigram model with byte pieces these are the ids of its own library, but for
segmentations with equal sums, as ``dd d`` and ``d dd``: the library adds scores from the text's start, and how
that rounds decides there.  Texts are got back
exactly where the model normalises nothing; else what they were normalised to.  A file that was trained by merges
has merge ranks as scores; its own merge loop segments otherwise, so the ids are **not** that file's
own encoding, though they decode to the same text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm._words import blocks, mix, powers, varied_ranges
from quillspark.llm.bpe import IdCache

U64 = np.uint64
_R = 0xC2B2AE3D27D4EB4F
SPACE = 0x2581
#: What an unknown character's score lies below the least score of a piece.
UNKNOWN_PENALTY = 10.0
#: Units of more characters are segmented alone.
LONG, _STRETCH = 400, 20_000


def _prefix_hashes(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, inv = powers(_R, len(cp) + 1)
    return np.concatenate((np.zeros(1, U64), np.cumsum((cp.astype(U64) + U64(0x1F351)) * p[: len(cp)]))), inv


#: Texts that tell what a model's normaliser does: folds forms, drops or maps white space and controls, puts no space in front.
PROBES = ["x", "ab  cd ", " ab", "   ", "a\tb\n", "a\u3000b\u00a0", "ﬁne １２ ｱ", "e\u0301 Å ½ ①", "ÀÉß İ", "a\x00\x07b", "\u200b\ufeffa", "▁a▁"]


def _spaced(text: str) -> str:
    return ("▁" + text.replace(" ", "▁")) if text else ""


class Pieces:
    """The pieces of a model file, as sorted keys with scores and ids."""

    def __init__(self, path: str, most: int = 1_300_000):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = SentencePieceProcessor(model_proto=f.read())
        n = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(n)]
        byte = [i for i in range(n) if model.is_byte(i)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if len(byte) != 256 or any("▁" in text[i].lstrip("▁") for i in plain):
            raise ValueError("a model with byte pieces, whose pieces have U+2581 in front only, is needed")
        #: The model's own normaliser, or None where it only turns spaces into U+2581 with one more in front.
        self.normalize = model.normalize if any(model.normalize(t) != _spaced(t) for t in PROBES) else None
        self.led = model.normalize("x").startswith("▁")
        self.byte = np.array(byte, np.uint32)
        joined = np.frombuffer("".join(text[i] for i in plain).encode("utf-32-le"), np.uint32)
        stop = np.cumsum([len(text[i]) for i in plain])
        start = np.concatenate(([0], stop[:-1]))
        total, inv = _prefix_hashes(joined)
        keys = (total[stop] - total[start]) * inv[start]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, np.uint32)[order]
        self.scores = np.array([model.get_score(i) for i in plain], np.float32)[order]
        self.unknown = self.scores.min() - np.float32(UNKNOWN_PENALTY)
        self.longest = int((stop - start).max())
        place = {i: k for k, i in enumerate(byte)}
        raw = [bytes([place[i]]) if i in place else text[i].replace("▁", " ").encode() for i in range(n)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.fromiter(map(len, raw), np.int64, n)
        self.raw_at = np.cumsum(self.raw_size) - self.raw_size
        self.cache = IdCache(most, 16_000_000)

    def _best(self, start: np.ndarray, n: int, total: np.ndarray, inv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(unit, first place, key index or -1) of the best pieces of units of ``n`` characters."""
        m = len(start)
        best = np.full((m, n + 1), -np.inf, np.float32)
        best[:, 0] = 0
        back, piece = np.zeros((m, n + 1), np.int16), np.full((m, n + 1), -1, np.int32)
        rows = np.arange(m)
        for j in range(1, n + 1):
            size = np.arange(min(j, self.longest), 0, -1)  # longest first: it wins between equals
            a = start[:, None] + (j - size)[None, :]
            h = (total[start + j][:, None] - total[a]) * inv[a]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            score = np.where(hit, self.scores[at], np.float32(-np.inf))
            score[:, -1] = np.where(hit[:, -1], score[:, -1], self.unknown)
            score += best[:, j - size]
            k = score.argmax(1)
            best[:, j], back[:, j] = score[rows, k], size[k]
            piece[:, j] = np.where(hit[rows, k], at[rows, k], -1)
        units, places, pieces = [], [], []
        left, end = rows, np.full(m, n)
        while len(left):
            size = back[left, end]
            units.append(left)
            places.append(end - size)
            pieces.append(piece[left, end])
            end = end - size
            go = end > 0
            left, end = left[go], end[go]
        return np.concatenate(units), np.concatenate(places), np.concatenate(pieces)

    def _best_long(self, start: int, n: int, total: np.ndarray, inv: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first place, key index or -1) of the best pieces of one unit of ``n`` characters."""
        best, back, piece = [np.float32(0)] + [None] * n, [0] * (n + 1), [-1] * (n + 1)
        sizes = np.arange(self.longest, 0, -1)
        for low in range(1, n + 1, _STRETCH):
            j = np.arange(low, min(n + 1, low + _STRETCH))
            a = np.maximum(j[:, None] - sizes, 0) + start
            h = (total[start + j][:, None] - total[a]) * inv[a]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            row, col = np.nonzero((self.keys[at] == h) & (sizes <= j[:, None]))
            keys = at[row, col]
            upto = np.searchsorted(row, np.arange(len(j) + 1)).tolist()
            size, key, score = sizes[col].tolist(), keys.tolist(), self.scores[keys]
            for r, end in enumerate(j.tolist()):
                top, far, found = None, 1, -1
                for x in range(upto[r], upto[r + 1]):  # longest first: it wins between equals
                    s = best[end - size[x]] + score[x]
                    if top is None or s > top:
                        top, far, found = s, size[x], key[x]
                if found < 0 or size[upto[r + 1] - 1] > 1:  # the character alone is no piece
                    s = best[end - 1] + self.unknown
                    if top is None or s > top:
                        top, far, found = s, 1, -1
                best[end], back[end], piece[end] = top, far, found
        places, pieces, end = [], [], n
        while end:
            pieces.append(piece[end])
            end -= back[end]
            places.append(end)
        return np.array(places), np.array(pieces)

    def segment(self, cp: np.ndarray, total: np.ndarray, inv: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of units cp[start:stop]."""
        length = stop - start
        unit, place, piece = [], [], []
        for k in np.flatnonzero(length > LONG):
            p, found = self._best_long(int(start[k]), int(length[k]), total, inv)
            unit.append(np.full(len(p), k))
            place.append(p)
            piece.append(found)
        for n in np.unique(length[length <= LONG]):
            mine = np.flatnonzero(length == n)
            for part in np.array_split(mine, max(1, len(mine) * (int(n) + 1) // 200_000)):
                u, p, k = self._best(start[part], int(n), total, inv)
                unit.append(part[u])
                place.append(p)
                piece.append(k)
        unit, place, piece = np.concatenate(unit), np.concatenate(place), np.concatenate(piece)
        order = np.lexsort((place, unit))
        unit, place, piece = unit[order], place[order], piece[order]
        ids = np.where(piece >= 0, self.ids[piece], 0).astype(np.uint32)
        odd = np.flatnonzero(piece < 0)
        if not len(odd):
            return np.bincount(unit, minlength=len(start)), ids
        chars = [chr(c).encode() for c in cp[start[unit[odd]] + place[odd]].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(c) for c in chars]
        out = np.repeat(ids, times)
        at = np.cumsum(times) - times
        out[varied_ranges(at[odd], times[odd])] = self.byte[np.frombuffer(b"".join(chars), np.uint8)]
        return np.bincount(unit, times, len(start)).astype(np.int64), out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's ids."""
        texts = list(map(self.normalize or _spaced, texts))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = "".join(texts)
        if not joined:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        begin = np.cumsum(sizes) - sizes
        blank = cp == SPACE
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[begin[sizes > 0]] = True
        start = np.flatnonzero(first)
        stop = np.concatenate((start[1:], [len(cp)]))
        total, inv = _prefix_hashes(cp)
        h = mix((total[stop] - total[start]) * inv[start] + (stop - start).astype(U64))
        entry = self.cache.entries(h, lambda at: self.segment(cp, total, inv, start[at], stop[at]))
        size = self.cache.size[entry]
        ids = self.cache.ids[varied_ranges(self.cache.at[entry], size)]
        upto = np.concatenate(([0], np.cumsum(size)))
        return ids, np.diff(upto[np.searchsorted(start, np.concatenate((begin, [len(cp)])))])

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of ids; the space in front is taken off."""
        size = self.raw_size[ids]
        flat = self.raw[varied_ranges(self.raw_at[ids], size)].tobytes()
        upto = np.concatenate(([0], np.cumsum(size)))
        at = upto[np.concatenate(([0], np.cumsum(count)))]
        skip = 1 if self.led else 0
        return [flat[a + skip : b] if b > a else b"" for a, b in zip(at.tolist(), at[1:].tolist())]


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in blocks(texts, 1 << 20, 5000):
                ids, n = model.encode(texts[i:j])
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids = part.column(1)
                n = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = ids.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([b.decode("utf-8", "replace") for b in model.decode(flat, n)], pa.string())], names=["doc_id", "text"])

    return run


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids of every text of ``docs`` (doc_id, text).

    Null and empty texts have no ids.  Rows are encoded one by one: repeats and null ids stay; an
    empty table gives an empty result; other columns are ignored.  U+2581 in a text is taken for a
    space.  For models trained by merges the ids are not the file's own encoding (see above).
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(model), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of every row of ``encoded`` (doc_id, ids).  Bytes that are no UTF-8 become U+FFFD.

    Null and empty lists give an empty text; repeats stay; an empty table gives an empty result.
    """
    return encoded.select("doc_id", "ids").mapInArrow(_decode(model), "doc_id long, text string")


def _round_trip(path: str):
    names = ["doc_id", "n_tokens", "ids_crc32", "n_byte_pieces", "decoded_sha256", "round_trip"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        byte = np.zeros(len(model.raw_size), bool)
        byte[model.byte] = True
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in blocks(texts, 1 << 20, 5000):
                ids, n = model.encode(texts[i:j])
                at = np.concatenate(([0], np.cumsum(n))).tolist()
                wide, odd = ids.astype("<u4"), np.concatenate(([0], np.cumsum(byte[ids])))
                rows = []
                for k, out in enumerate(model.decode(ids, n)):
                    a, b = at[k], at[k + 1]
                    rows.append((keys[i + k], b - a, zlib.crc32(wide[a:b].tobytes()), int(odd[b] - odd[a]), hashlib.sha256(out).hexdigest(), out == texts[i + k].replace("▁", " ").encode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return run


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Digests of each text's ids and of what they decode to, without sending ids to the JVM.

    Nulls, repeats and empty tables as in ``encode_pieces``; the ids of a model trained by merges are
    those of the largest sum of scores, not the file's own.
    """
    schema = "doc_id long, n_tokens long, ids_crc32 long, n_byte_pieces long, decoded_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_round_trip(model), schema)
