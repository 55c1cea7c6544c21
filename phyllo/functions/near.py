"""Pairs of 64-bit values that differ in few bits, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Comparisons at a time; it bounds the memory and changes nothing in the result.
SLICE = 1 << 15


def parts_within(radius: int) -> list[tuple[int, int, int]]:
    """Shift, width and allowed bits of disjoint parts of 64 bits: two values within the radius keep to at least one part's.

    If each part had one bit more than it allows, these would sum to radius + 1.
    No part allows more than two bits.
    """
    if radius < 2:
        raise ValueError("three parts at least allow two bits together")
    n = max(3, -(-(radius + 1) // 3))
    cuts = [64 * k // n for k in range(n + 1)]
    base, more = divmod(radius - n + 1, n)
    return [(cuts[k], cuts[k + 1] - cuts[k], base + (k >= n - more)) for k in range(n)]


def flips(width: int, most: int) -> Iterator[int]:
    """All values of ``width`` bits of which at most ``most`` are set."""
    for n in range(most + 1):
        for bits in combinations(range(width), n):
            yield sum(1 << b for b in bits)


def _by_part(values: np.ndarray, shift: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``values`` by a part, and the parts in that order."""
    at = max(1, len(values).bit_length())
    part = (values >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    packed = np.sort(part << np.uint64(at) | np.arange(len(values), dtype=np.uint64))
    return (packed & np.uint64((1 << at) - 1)).astype(np.int64), (packed >> np.uint64(at)).astype(np.int64)


def close_values(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in ``left`` and ``right`` (unsigned) of values within the radius, and their distance, each pair once.

    For one part after the other ``right`` goes into a table with a row for each
    value of the part; what finds no room there is kept as sorted runs. ``left``
    looks up its own part with every allowed set of flipped bits. A pair counts
    at the first part that it keeps to.
    """
    parts = parts_within(radius)
    if not (len(left) and len(right)):
        return
    for k, (shift, width, most) in enumerate(parts):
        order, keys = _by_part(right, shift, width)
        counts = np.bincount(keys, minlength=1 << width)
        starts = np.cumsum(counts) - counts
        mean = len(right) / (1 << width)
        room = max(2, int(np.ceil(mean + 1.4 * mean**0.5)))
        values = right[order]
        place = np.arange(len(keys)) - starts[keys]
        fits = place < room
        table = np.zeros((1 << width, room), np.uint64)
        table[keys[fits], place[fits]] = values[fits]
        full = counts > room
        del keys, place, fits
        lefts, own = _by_part(left, shift, width)
        seek = left[lefts]

        def first_part(differ: np.ndarray) -> np.ndarray:
            keep = np.ones(len(differ), bool)
            for s, w, m in parts[:k]:
                keep &= np.bitwise_count((differ >> np.uint64(s)) & np.uint64((1 << w) - 1)) > m
            return keep

        block = max(1, SLICE // room)
        rows, bits = np.empty((block, room), np.uint64), np.empty((block, room), np.uint8)
        for lo in range(0, len(own), block):
            some, sought = own[lo : lo + block], seek[lo : lo + block]
            differ, far = rows[: len(some)], bits[: len(some)]
            for flip in flips(width, most):
                key = some ^ flip
                np.take(table, key, axis=0, out=differ, mode="clip")
                np.bitwise_xor(differ, sought[:, None], out=differ)
                np.bitwise_count(differ, out=far)
                found = np.flatnonzero(far <= radius)
                if len(found):
                    at, slot = found // room, found % room
                    keep = (slot < counts[key[at]]) & first_part(differ[at, slot])  # the rest of a row is empty
                    at, slot = at[keep], slot[keep]
                    yield lefts[lo + at], order[starts[key[at]] + slot], far[at, slot].copy()
                over = np.flatnonzero(full[key])
                if not len(over):
                    continue
                begin, sizes = starts[key[over]] + room, counts[key[over]] - room
                ends = np.cumsum(sizes)
                for first in range(0, int(ends[-1]), SLICE):
                    n = np.arange(first, min(first + SLICE, int(ends[-1])))
                    run = np.searchsorted(ends, n, "right")
                    at = n + (begin + sizes - ends)[run]
                    others = values[at] ^ sought[over[run]]
                    found = np.flatnonzero(np.bitwise_count(others) <= radius)
                    found = found[first_part(others[found])]
                    if len(found):
                        yield lefts[lo + over[run[found]]], order[at[found]], np.bitwise_count(others[found])


def close_lists(radius: int, kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares what stands in one partition: ids ``id`` of ``kind`` with ``values``, some to be ``sought`` by the others.

    Gives ``a``, one of the others, ``b``, one of those sought, and the distance
    ``d`` of two of their values; once for each two values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[bool, list[tuple[pa.Array, np.ndarray, np.ndarray]]] = {False: [], True: []}
        for batch in batches:
            flags = batch.column("sought")
            for side in sides:
                rows = batch.filter(flags if side else pc.invert(flags))
                lists = rows.column("values")
                # Arrow's batches are reused; these are copies.
                sides[side].append((pa.concat_arrays([rows.column("id")]), lists.value_lengths().to_numpy().copy(), lists.flatten().to_numpy().copy()))
        if not sides[False]:  # no batch at all
            return
        ids, owner, values = {}, {}, {}
        for side, told in sides.items():
            ids[side] = pa.chunked_array([t[0] for t in told], kind).combine_chunks()
            sizes = np.concatenate([t[1] for t in told])
            owner[side] = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            values[side] = np.concatenate([t[2] for t in told]).view(np.uint64)
            told.clear()
        for left, right, d in close_values(values[False], values[True], radius):
            a, b = ids[False].take(pa.array(owner[False][left])), ids[True].take(pa.array(owner[True][right]))
            other = pc.not_equal(a, b)
            yield pa.record_batch([a.filter(other), b.filter(other), pa.array(d.astype(np.int32)).filter(other)], names=["a", "b", "d"])

    return run
