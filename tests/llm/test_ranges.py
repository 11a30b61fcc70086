"""The packed exchange: what goes in comes out, over many rows and owners, at any number of ranges."""

import numpy as np
import pyarrow as pa

from quillspark.llm import _ranges
from quillspark.llm._cluster import RANGE_ITEMS, range_bits


def test_round_trip_of_many_owners():
    r = np.random.default_rng(1)
    rows, want = [], []
    for _ in range(5):
        ids = r.integers(0, 1 << 62, 30_000)
        owner = np.sort(r.integers(0, 30_000, 50_000))
        value = r.integers(0, 1 << 40, 50_000).astype(np.uint64)
        rows.append(_ranges.pack([ids.astype("<i8")], owner, [_ranges.forty(value), (value % 65536).astype("<u2")]))
        want += list(zip(ids[owner].tolist(), value.tolist()))
    column = pa.chunked_array([pa.array(rows[:2], pa.binary()), pa.array([b"x", *rows[2:]], pa.binary()).slice(1)])
    (ids,), owner, (value, low) = _ranges.unpack(column, ["<i8"], ["b5", "<u2"])
    assert list(zip(ids[owner].tolist(), value.tolist())) == want and (value % 65536 == low).all()


def test_ranges_and_what_is_below_them():
    key = np.random.default_rng(2).integers(0, 1 << 64, 20_000, dtype=np.uint64)
    for bits in (1, 6, 16, 20, 30):
        order, ranges = _ranges.split(key, bits)
        for k, x in ranges:
            assert (key[order[x]] >> np.uint64(64 - bits) == k).all()
        assert sum(x.stop - x.start for _, x in ranges) == len(key)
        rest = _ranges.below(key, bits, 40)
        assert [int(k) >> max(0, 24 - bits) & (1 << min(40, 64 - bits)) - 1 for k in key[:500]] == rest[:500].tolist()
    assert _ranges.split(key[:0], 6)[1] == [] and _ranges.unpack(pa.array([], pa.binary()), ["<i8"], ["b5"])[1].tolist() == []


def test_ranges_follow_the_items():
    assert [range_bits(n * RANGE_ITEMS) for n in (0, 1, 64, 1 << 20, 1 << 26)] == [6, 6, 7, 21, 27]
