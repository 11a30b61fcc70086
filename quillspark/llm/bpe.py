"""Byte-level BPE ids of whole texts, with each distinct pre-token encoded once by a worker.

The pre-token rule of byte-level BPE files (letters, numbers, other signs, each with a leading
blank; white space; English contractions) splits a text into pieces that are encoded on their
own.  The split is done for a block of texts at once in numpy; pieces are looked up by a 64-bit
hash in the worker's cache, and only unseen ones are merged: by ``tiktoken``'s merge loop where
the file's merges are in the order of its ids (which makes both the same), else by ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import unicodedata
from itertools import chain

import numpy as np
import regex

from quillspark.llm._cluster import held
from quillspark.llm._words import mix, powers, varied_ranges

U64 = np.uint64
_R = 0xC2B2AE3D27D4EB4F
SPACE, LETTER, NUMBER, OTHER, BREAK = range(5)
_classes: np.ndarray | None = None


def _probed(tokenizer, c: int) -> int:
    """The class that the tokenizer's own splitter gives to a code point."""
    alone = lambda x: len(tokenizer.pre_tokenizer.pre_tokenize_str(x + chr(c) + x)) == 1
    return LETTER if alone("a") else NUMBER if alone("1") else OTHER if alone("!") else SPACE


def classes(tokenizer) -> np.ndarray:
    """The class of every code point.

    Where two Unicode versions at hand disagree, the tokenizer, which has its own, is asked.
    """
    global _classes
    if _classes is None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        code = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[code[m.start() : m.end()]] = kind
        other = {"L": LETTER, "N": NUMBER}
        sign = np.fromiter((other.get(unicodedata.category(c)[0], OTHER) for c in every), np.uint8, len(every))
        for c in code[(sign != table[code]) & (table[code] != SPACE)].tolist():
            table[c] = _probed(tokenizer, c)
        _classes = table
    return _classes


def pretokens(cp: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens; BREAK places start one of their own."""
    run = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    stop = np.concatenate((run[1:], [len(cls)]))
    kind = cls[run]
    before = np.concatenate(([BREAK], kind[:-1]))
    after = np.concatenate((kind[1:], [BREAK]))
    blank_end = (kind == SPACE) & (cp[stop - 1] == 32) & (after != BREAK)
    led = np.concatenate(([False], blank_end[:-1]))  # takes the blank before it
    size = stop - run
    start = np.zeros(len(cls) + 1, bool)
    text = (kind != SPACE) & (kind != BREAK)
    start[run[kind == BREAK]] = True
    start[run[text] - led[text]] = True
    start[run[(kind == SPACE) & ~(blank_end & (size == 1))]] = True
    start[(stop - 1)[(kind == SPACE) & ~blank_end & (after != BREAK) & (size > 1)]] = True
    quote = np.flatnonzero((kind == OTHER) & (size == 1) & (cp[run] == 39) & ~led & (after == LETTER))
    if len(quote):
        a = stop[quote]  # the first letter
        letters = size[quote + 1]
        c = cp[a]
        d = np.where(letters > 1, cp[np.minimum(a + 1, len(cp) - 1)], 0)
        taken = np.where(np.isin(c, [115, 116, 109, 100]), 1, 0)
        taken = np.where(((c == 114) | (c == 118)) & (d == 101) | (c == 108) & (d == 108), 2, taken)
        start[a[taken > 0]] = False
        more = (taken > 0) & (letters > taken)
        start[(a + taken)[more]] = True
    return np.flatnonzero(start[:-1])


def _merger(path: str):
    """A function from a pre-token's bytes to ids, or None if ids don't follow the merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    if any(x >= y for x, y in zip(ids, ids[1:])) or model.get("ignore_merges"):
        return None
    import tiktoken

    # byte-level files write the printable Latin-1 bytes as themselves and the others from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte for c in t) and not (t.startswith("<|") and t.endswith("|>"))}
    return tiktoken.Encoding("file", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class IdCache:
    """Ids by the hash of what they encode.  Emptied when it holds ``most`` entries or ``most_ids`` ids."""

    def __init__(self, most: int = 400_000, most_ids: int = 4_000_000):
        self.most, self.most_ids = most, most_ids
        self.clear()

    def clear(self) -> None:
        self.slots = np.zeros(1 << max(16, (3 * self.most).bit_length()), U64)
        self.entry = np.zeros(len(self.slots), np.int32)
        self.at, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.ids = np.empty(1 << 16, np.uint32)
        self.known = self.used = 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1: open addressing with linear probing."""
        mask = U64(len(self.slots) - 1)
        slot = (h & mask).astype(np.int64)
        key = self.slots[slot]
        out = np.where(key == h, self.entry[slot], -1)
        left = np.flatnonzero((key != h) & (key != 0))
        slot = slot[left]
        while len(left):
            slot = slot + 1 & int(mask)
            key = self.slots[slot]
            same = key == h[left]
            out[left[same]] = self.entry[slot[same]]
            go = ~same & (key != 0)
            left, slot = left[go], slot[go]
        return out

    def insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        mask = len(self.slots) - 1
        slot = (h & U64(mask)).astype(np.int64)
        while len(h):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = h[free]
            mine = self.slots[slot] == h
            self.entry[slot[mine]] = entry[mine]
            h, entry, slot = h[~mine], entry[~mine], slot[~mine] + 1 & mask

    def add(self, hashes: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """New entries, numbered on from ``known``; ``flat`` has their ids one after another."""
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(len(self.ids), len(flat)), np.uint32)])
        self.ids[self.used : self.used + len(flat)] = flat
        upto = self.known + len(hashes)
        if upto > len(self.at):
            more = max(len(self.at), upto)
            self.at, self.size = (np.concatenate([x[: self.known], np.empty(more, np.int64)]) for x in (self.at, self.size))
        self.at[self.known : upto], self.size[self.known : upto] = self.used + np.cumsum(size) - size, size
        self.used += len(flat)
        self.insert(hashes, np.arange(self.known, upto, dtype=np.int32))
        self.known = upto

    def entries(self, h: np.ndarray, learn) -> np.ndarray:
        """The entry of each hash; ``learn(places)`` gives (sizes, ids) of those first seen there."""
        if self.known > self.most or self.used > self.most_ids:
            self.clear()
        place = self.find(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            unseen, first, at = np.unique(h[new], return_index=True, return_inverse=True)
            place[new] = self.known + at
            self.add(unseen, *learn(new[first]))
        return place


class Encoder:
    """Ids of texts by one vocabulary file."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # added tokens are cut out of a text before it is split, the longest of those that begin first
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens that take blanks, or stand as whole words or in normalised text only, are not supported")
        self.added = {t.content: i for i, t in added.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        self.merge = _merger(path)
        self.cache = IdCache(most)

    def merged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.merge:
            got = [self.merge(x.encode()) for x in pieces]
        else:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return size, np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of each text's ids, as the library gives them without added ends."""
        if self.cut is None or not any(map(self.cut.search, texts)):
            return self.plain(texts)
        parts = [[t[a:b] for a, b in zip((0, *(m.end() for m in found)), (*(m.start() for m in found), len(t)))] for t in texts for found in [list(self.cut.finditer(t))]]
        marks = [[self.added[m[0]] for m in self.cut.finditer(t)] for t in texts]
        ids, size = self.plain(list(chain.from_iterable(parts)))
        between = np.split(ids, np.cumsum(size)[:-1])
        out, at, sizes = [], 0, []
        for own in marks:
            row = [between[at]]
            for i, mark in enumerate(own, 1):
                row += [np.array([mark], np.uint32), between[at + i]]
            at += len(own) + 1
            sizes.append(sum(map(len, row)))
            out += row
        return np.concatenate(out), np.array(sizes, np.int64)

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` of texts without added tokens."""
        joined = "\n".join(texts)
        if not joined:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = classes(self.tokenizer)[cp]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cls[ends[:-1]] = BREAK
        start = pretokens(cp, cls)
        stop = np.concatenate((start[1:], [len(cp)]))
        real = cls[start] != BREAK
        start, stop = start[real], stop[real]
        p, inv = powers(_R, len(cp) + 1)
        total = np.concatenate((np.zeros(1, U64), np.cumsum((cp.astype(U64) + U64(0x1F351)) * p[: len(cp)])))
        h = mix((total[stop] - total[start]) * inv[start] + (stop - start).astype(U64))
        place = self.cache.entries(h, lambda at: self.merged([joined[a:b] for a, b in zip(start[at].tolist(), stop[at].tolist())]))
        size = self.cache.size[place]
        ids = self.cache.ids[varied_ranges(self.cache.at[place], size)]
        upto = np.concatenate(([0], np.cumsum(size)))
        by_text = upto[np.searchsorted(start, ends)]
        return ids, np.diff(np.concatenate(([0], by_text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file; it goes when tasks of another operator need the memory."""
    held["bpe"] = _encoders.clear
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
