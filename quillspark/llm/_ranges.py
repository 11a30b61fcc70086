"""Packed exchange: (key, items) columns sent through Spark's shuffle as binary rows by hash range.

One row per block of texts and hash range replaces one row per word window, so the JVM moves a
few large values, and numpy does the grouping.  A packed row is

    items, owners (2 x int32) | owner columns ... | owner of each item (uint16) | item columns ...

Owners are texts; at most 60,000 of them are in a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HEAD = np.dtype("<i4")
_WIDTH = {"b5": 5}


def pack(owner_columns: list[np.ndarray], owner: np.ndarray, item_columns: list[np.ndarray]) -> bytes:
    """Keeps only owners with an item.  ``owner`` must be ascending."""
    new = np.empty(len(owner), bool)
    new[:1] = True
    new[1:] = owner[1:] != owner[:-1]
    used = owner[new]
    local = (np.cumsum(new) - 1).astype("<u2")
    head = np.array([len(owner), len(used)], HEAD).tobytes()
    return b"".join([head, *(np.ascontiguousarray(c[used]).tobytes() for c in owner_columns), local.tobytes(), *(c.tobytes() for c in item_columns)])


def values(column: pa.Array | pa.ChunkedArray) -> Iterator[memoryview]:
    """The values of a binary column without nulls, as views of Arrow's own memory."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(part):
            kind = "<i8" if pa.types.is_large_binary(part.type) else "<i4"
            at = np.frombuffer(part.buffers()[1], kind, len(part) + 1, part.offset * np.dtype(kind).itemsize).tolist()
            whole = memoryview(part.buffers()[2]) if part.buffers()[2] is not None else memoryview(b"")
            yield from (whole[a:b] for a, b in zip(at, at[1:]))


def unpack(column: pa.Array | pa.ChunkedArray, owner_types: list[str], item_types: list[str]) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Owner columns, each item's owner (an index into them), item columns; of all rows together.

    The item type ``b5`` is an unsigned 40-bit number.  Each value is copied once, to its place.
    """
    rows = list(values(column))
    sizes = [np.frombuffer(row, HEAD, 2).tolist() for row in rows]
    n_items, n_owners = (sum(s[i] for s in sizes) for i in (0, 1))
    owners = [np.empty(n_owners, t) for t in owner_types]
    local = np.empty(n_items, np.int32)
    items = [np.zeros((n_items, 8), np.uint8) if t in _WIDTH else np.empty(n_items, t) for t in item_types]
    i = j = 0
    for row, (n, m) in zip(rows, sizes):
        at = 8
        for out, t in zip(owners, owner_types):
            out[j : j + m] = np.frombuffer(row, t, m, at)
            at += m * out.itemsize
        local[i : i + n] = np.frombuffer(row, "<u2", n, at)
        local[i : i + n] += j
        at += 2 * n
        for out, t in zip(items, item_types):
            wide = _WIDTH.get(t)
            if wide:
                out[i : i + n, :wide] = np.frombuffer(row, np.uint8, n * wide, at).reshape(n, wide)
            else:
                out[i : i + n] = np.frombuffer(row, t, n, at)
            at += n * (wide or out.itemsize)
        i, j = i + n, j + m
    return owners, local, [x.view("<u8").ravel() if t in _WIDTH else x for x, t in zip(items, item_types)]


def forty(x: np.ndarray) -> np.ndarray:
    """The low 40 bits of each number as 5 bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def below(key: np.ndarray, bits: int, width: int) -> np.ndarray:
    """The ``width`` bits after the top ``bits`` of the key, or all that are left."""
    return key >> np.uint64(max(0, 64 - bits - width)) & np.uint64((1 << min(width, 64 - bits)) - 1)


def split(key: np.ndarray, bits: int) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """A stable order by the top ``bits`` of the key, and (range, its slice of that order) of those that have items."""
    top = (key >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
    order = np.argsort(top, kind="stable")
    return order, runs(top[order])


def runs(top: np.ndarray) -> list[tuple[int, slice]]:
    """(value, slice) of each run of a sorted array."""
    if not len(top):
        return []
    begin = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    return [(k, slice(a, b)) for k, a, b in zip(top[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(top)])]
