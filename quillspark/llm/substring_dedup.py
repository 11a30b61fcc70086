"""Removal of long passages that an earlier document has, found by fixed-block anchors.

With windows of ``size`` words and blocks of ``size // 2`` words, every window of a document holds
one whole non-overlapping block of it.  So a repeat of ``size`` words shows as a rolling window of
``size // 2`` words that equals a block of the other document.

1. Anchors: every rolling block-sized window of every text is sent to the range of its hash, as
   packed rows; those at multiples of the block size are the index.  Windows that equal an indexed
   block of another row are hits (about two in ``size // 2`` of the repeated words).  Where a task
   sees a window in two rows and one of them has it as a block, all its places are hits already, and
   two entries go to the range instead of one for each place.
2. Extension: hits return to their texts and are extended to the full windows that hold them.
   Those windows meet in the range of their 64-bit hash, which gives the smallest doc_id of each
   window.  The union of a text's windows with a smaller doc_id elsewhere is the set of its maximal
   repeats.  The other text is not at hand, so a window's equality is that of its hash.  Of a window
   that a task sees in several documents, only the smallest doc_id's entries go to the range.
3. The covered words are removed.

So a passage that a third of all rows share costs a range a few entries from each task.  Both uses
of the texts join on the same key, so Spark shuffles the texts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm import _ranges
from quillspark.llm._cluster import range_bits, tasks, text_bytes, release
from quillspark.llm._words import Words, blocks, starts_inside, utf8, varied_ranges, windows

U64 = np.uint64


#: Windows that a block of texts has this often are remembered by the task, up to so many.
_OFTEN, _MOST_REMEMBERED = 8, 1_000_000
#: Bytes of places in a partition up to which a join may hold them in memory as a whole.
_HELD = 64 << 20
_SENT = "part int, wide boolean, packed binary, k long, doc long, places array<int>"
_PLACES = "k long, doc long, places array<int>"
_NAMES = ["part", "wide", "packed", "k", "doc", "places"]


def _rows(key: np.ndarray, bits: int, own: list[np.ndarray], doc: np.ndarray, start: np.ndarray, values: np.ndarray, kind: str) -> pa.RecordBatch:
    """Packed rows by range; places in a text are sent as gaps of 16 bits where they fit."""
    order, ranges = _ranges.split(key, bits)
    doc, start, values = doc[order], start[order], values[order].astype(kind)
    rows, wide = [], []
    for _, x in ranges:
        d, gap = doc[x], start[x].copy()
        same = d[1:] == d[:-1]
        gap[1:][same] -= start[x][:-1][same]
        wide.append(bool(gap.max() > 65535))
        rows.append(_ranges.pack(own, d, [values[x], gap.astype("<u4" if wide[-1] else "<u2")]))
    none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in ranges], pa.int32()), pa.array(wide, pa.bool_()), pa.array(rows, pa.binary()), *none], names=_NAMES)


def _answered(key: np.ndarray, ids: np.ndarray, doc: np.ndarray, start: np.ndarray, bits: int) -> pa.RecordBatch:
    """Places that need no range's answer; they travel with the others, by the range of their text's key."""
    t = _lists(key, ids, doc, start)
    part = (t.column("k").to_numpy().view(U64) >> U64(64 - bits)).astype(np.int32)
    cols = [pa.array(part), pa.nulls(len(part), pa.bool_()), pa.nulls(len(part), pa.binary()), *(t.column(c).combine_chunks() for c in ("k", "doc", "places"))]
    return pa.RecordBatch.from_arrays(cols, names=_NAMES)


def _read(table: pa.Table, owners: list[str], kind: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Owner columns, owner, value and place of each item."""
    got = []
    wide = table.column("wide").to_numpy().astype(bool)
    packed = table.column("packed")
    for w in (False, True):
        got.append(_ranges.unpack(packed if w == wide.all() and w == wide.any() else packed.filter(pa.array(wide == w)), owners, [kind, "<u4" if w else "<u2"]))
        if w == wide.all() and w == wide.any():
            got = [got[-1]]
            break
    base = np.cumsum([0, *(len(g[0][0]) for g in got)])
    own = [np.concatenate(x) for x in zip(*(g[0] for g in got))]
    owner = np.concatenate([g[1] + n for g, n in zip(got, base.tolist())])
    values = np.concatenate([g[2][0] for g in got])
    gap = np.concatenate([g[2][1].astype(np.int32) for g in got])
    total = np.cumsum(gap, dtype=np.int64)
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, int)
    first = total[begin] - gap[begin]
    return own, owner, values, (total - np.repeat(first, np.diff(np.concatenate((begin, [len(owner)]))))).astype(np.int32)


def _lists(key: np.ndarray, ids: np.ndarray, owner: np.ndarray, place: np.ndarray) -> pa.Table:
    """(k, doc, places) for each owner."""
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    begin = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.empty(0, int)
    offsets = np.concatenate((begin, [len(owner)])).astype(np.int32)
    return pa.table({"k": pa.array(key[owner[begin]].view(np.int64)), "doc": pa.array(ids[owner[begin]].astype(np.int64)), "places": pa.ListArray.from_arrays(pa.array(offsets), pa.array(place.astype(np.int32)))})


def _with_answered(table: pa.Table, more) -> pa.Table:
    """The rows of ``table`` that were answered before, and those that ``more`` makes of the packed ones."""
    packed = table.column("packed").is_valid()
    done = table.filter(pc.invert(packed)).select(["k", "doc", "places"])
    asked = table.filter(packed)
    return pa.concat_tables([done, more(asked).cast(done.schema)]) if asked.num_rows else done


def _runs(order_key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs in a sorted array, and each item's run."""
    new = np.concatenate(([True], order_key[1:] != order_key[:-1]))
    return np.flatnonzero(new), np.cumsum(new) - 1


def _found(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``h`` in the sorted array ``known``, and whether they are there."""
    if not len(known):
        return np.zeros(len(h), int), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return at, known[at] == h


def _hits_here(h: np.ndarray, k: np.ndarray, place: np.ndarray, block: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which entries are hits by what the task has seen, which of them go to the range all the same, and
    the windows to remember.

    A window is a hit in all its rows if two rows have it, one of them as a block.  The range needs
    one such block and an entry of another row to find that out too.
    """
    _, hit = _found(known, h)
    send = np.zeros(len(h), bool)
    order = np.argsort(h, kind="stable")
    s = h[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:].copy()
    order = order[twice & ~hit[order]]
    if not len(order):
        return hit, send, known[:0]
    s, key, aligned = h[order], k[order], place[order] % block == 0
    begin, run_of = _runs(s)
    low, high = np.minimum.reduceat(key, begin), np.maximum.reduceat(key, begin)
    ok = (low != high) & np.logical_or.reduceat(aligned, begin)
    hit[order[ok[run_of]]] = True
    # of each such window the first block, and the first entry of a row other than the block's
    one = np.flatnonzero(aligned & ok[run_of])
    _, first = np.unique(run_of[one], return_index=True)
    one = one[first]
    block_key = np.zeros(len(begin), U64)
    block_key[run_of[one]] = key[one]
    other = np.flatnonzero((key != block_key[run_of]) & ok[run_of])
    _, first = np.unique(run_of[other], return_index=True)
    send[order[one]] = send[order[other[first]]] = True
    size = np.diff(np.concatenate((begin, [len(s)])))
    return hit, send, s[begin[ok & (size >= _OFTEN)]]


def _probe(block: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known = np.empty(0, U64)
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            texts = [t or b"" for t in utf8(batch.column(1))]
            for i, j in blocks(texts, 2 << 20):
                words = Words(texts[i:j])
                at, doc = starts_inside(words.first, words.count, block)
                if not len(at):
                    continue
                h = windows(words.hashes(), block)[at]
                place = (at - words.first[:-1][doc]).astype(np.int32)
                key = keys[i:j]
                hit, send, often = _hits_here(h, key[doc], place, block, known)
                if hit.any():
                    yield _answered(key, np.zeros(j - i, np.int64), doc[hit], place[hit], bits)
                known = np.union1d(known, often) if len(known) < _MOST_REMEMBERED else often
                ask = ~hit | send
                if ask.any():
                    h, doc, place = h[ask], doc[ask], place[ask]
                    yield _rows(h, bits, [key], doc, place, _ranges.below(h, bits, 32), "<u4")

    return run


def _anchors(block: int):
    def shared(table: pa.Table) -> pa.Table:
        (key,), owner, h, place = _read(table, ["<u8"], "<u4")
        none = np.zeros(len(key), np.int64)
        index = np.unique(h[place % block == 0])
        if not len(index):
            return _lists(key, none, owner[:0], place[:0])
        _, hit = _found(index, h)
        owner, h, place = owner[hit], h[hit], place[hit]
        order = np.argsort(h, kind="stable")
        owner, h, place = owner[order], h[order], place[order]
        begin, run_of = _runs(h)
        k = key[owner]
        keep = (np.minimum.reduceat(k, begin) != np.maximum.reduceat(k, begin))[run_of]
        return _lists(key, none, owner[keep], place[keep])

    return lambda table: _with_answered(table, shared)


def _later_here(h: np.ndarray, ids: np.ndarray, known: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which entries have a smaller doc_id by what the task has seen (``known`` windows and their ``least``
    doc_ids), and the windows to remember with theirs."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    begin, run_of = _runs(s)
    low = np.minimum.reduceat(ids[order], begin)
    at, there = _found(known, s[begin])
    if there.any():
        low[there] = np.minimum(low[there], least[at[there]])
    later = np.empty(len(h), bool)
    later[order] = ids[order] > low[run_of]
    often = (np.diff(np.concatenate((begin, [len(s)]))) >= _OFTEN) | there
    return later, s[begin[often]], low[often]


def _extend(size: int, block: int, bits: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        known, least = np.empty(0, U64), np.empty(0, np.int64)
        for batch in batches:
            c = {n: batch.column(n) for n in names}
            valid = c["doc_id"].is_valid().to_numpy(zero_copy_only=False)
            ids = c["doc_id"].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = c["k"].to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            texts = [t or b"" for t in utf8(c["text"])]
            hits = c["places"]
            for i, j in blocks(texts, 2 << 20):
                words = Words(texts[i:j])
                mine = hits.slice(i, j - i)
                place = mine.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(j - i), mine.value_lengths().to_numpy(zero_copy_only=False))
                low = np.maximum(place - (size - block), 0)
                high = np.minimum(place, words.count[doc] - size)
                ok = (high >= low) & valid[i:j][doc]
                low, high, first = low[ok], high[ok], words.first[:-1][doc[ok]]
                mark = np.zeros(len(words.start) + 1, np.int32)
                np.add.at(mark, low + first, 1)
                np.add.at(mark, high + first + 1, -1)
                at = np.flatnonzero(np.cumsum(mark) > 0)
                if not len(at):
                    continue
                h = windows(words.hashes(), size)[at]
                doc = np.searchsorted(words.first, at, "right") - 1
                place, own = (at - words.first[doc]).astype(np.int32), ids[i:j]
                later, often, low = _later_here(h, own[doc], known, least)
                if later.any():
                    yield _answered(keys[i:j], own, doc[later], place[later], bits)
                if len(known) < _MOST_REMEMBERED:
                    at, there = _found(often, known)
                    often, low = np.concatenate((known[~there], often)), np.concatenate((least[~there], low))
                order = np.argsort(often)
                known, least = often[order], low[order]
                if not later.all():
                    h, doc, place = h[~later], doc[~later], place[~later]
                    yield _rows(h, bits, [own.astype("<i8"), keys[i:j]], doc, place, h, "<u8")

    return run


def _later(table: pa.Table) -> pa.Table:
    def smaller(table: pa.Table) -> pa.Table:
        (ids, key), owner, h, place = _read(table, ["<i8", "<u8"], "<u8")
        order = np.argsort(h)
        owner, h, place = owner[order], h[order], place[order]
        begin, run_of = _runs(h)
        d = ids[owner]
        keep = d > np.minimum.reduceat(d, begin)[run_of]
        return _lists(key, ids, owner[keep], place[keep])

    return _with_answered(table, smaller)


def _remove(size: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            texts = utf8(batch.column("text"))
            lists = batch.column("places")
            have = lists.is_valid().to_numpy(zero_copy_only=False)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
            n_words, n_removed, kept = [], [], []
            for i, t in enumerate(texts):
                words = t.split() if t else []
                gone = 0
                if have[i]:
                    cover = np.zeros(len(words), bool)
                    places = np.unique(flat[offsets[i] : offsets[i + 1]])
                    cover[varied_ranges(places, np.full(len(places), size))] = True
                    gone = int(cover.sum())
                    words = [words[x] for x in np.flatnonzero(~cover)]
                n_words.append(len(words) + gone)
                n_removed.append(gone)
                kept.append(b" ".join(words))
            more = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more], names=[*names, "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, size: int = 50, carry: list[str] | None = None) -> DataFrame:
    """doc_id, [carried columns,] n_words, n_removed, kept of every row of ``docs`` (doc_id, text).

    A word is removed if a window of ``size`` words over it also starts in a row with a smaller
    doc_id.  ``kept`` is the other words with one space between.  Null and empty texts give 0
    words and an empty ``kept``.  Texts shorter than ``size`` words lose nothing.  Rows that
    repeat a doc_id take nothing from each other.  A null doc_id neither gives nor loses.  An empty
    table gives an empty result.  Columns that aren't carried are ignored; carried ones must not be
    named n_words, n_removed, kept, k, found or places, or have a dot (put others into a struct).  Words are compared by
    64-bit hashes of their windows.  Memory: a hash range or a batch of texts for each task.
    """
    clash = {"n_words", "n_removed", "kept", "k", "places", "found"} & set(carry or [])
    if clash:
        raise ValueError(f"columns that can't be carried by these names: {sorted(clash)}")
    spark, block, held = docs.sparkSession, size // 2, text_bytes(docs)
    bits = range_bits(held // 6)  # a word and its space are six bytes or so
    own = ["doc_id", "text", *(c for c in carry or [] if c not in ("doc_id", "text"))]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *own[1:], F.xxhash64(F.col("doc_id").cast("long"), "text").alias("k"))
    hits = keyed.select("k", "text").mapInArrow(_probe(block, bits), _SENT).groupBy("part").applyInArrow(_anchors(block), _PLACES)
    # places take less room than their texts, so this bounds what a join holds of them
    small = lambda df: df.hint("shuffle_hash") if held / max(1, tasks(spark)) < _HELD else df
    gathered = lambda df: df.groupBy("k").agg(F.collect_set(F.struct("doc", "places")).alias("found"))
    of = lambda ok: F.flatten(F.transform(F.filter("found", ok), lambda x: x["places"])).alias("places")
    found = keyed.join(small(gathered(hits)), "k").select("doc_id", "k", "text", of(lambda x: F.lit(True)))
    windows_ = found.mapInArrow(_extend(size, block, bits, ["doc_id", "k", "text", "places"]), _SENT)
    later = windows_.groupBy("part").applyInArrow(_later, _PLACES)
    names = [n for n in own if n != "text"] if "text" not in (carry or []) else own
    kinds = T.StructType([*keyed.select(*names).schema, *T._parse_datatype_string("n_words long, n_removed long, kept string")])
    # k is a hash: the doc_id is compared too
    marked = keyed.join(small(gathered(later)), "k", "left").select(*own, of(lambda x: x["doc"] == F.col("doc_id")))
    return marked.mapInArrow(_remove(size, names), kinds)
