"""Which of many texts contain one of many byte strings, vectorised over the bytes of a batch of texts.

Every item is looked for by one window of 8, 4, 2 or 1 of its bytes, the widest that fits, at
the place where it is rarest among the items.  Windows of the texts that are such an anchor are
compared with the whole items behind it.  Matches are exact, whatever the bytes are.
"""

from __future__ import annotations

from collections.abc import Buffer, Iterator
from typing import NamedTuple

import numpy as np

WIDTHS = (8, 4, 2, 1)
#: Windows that are looked at together, pairs of window and item that are.
STEP, PAIRS = 1 << 20, 1 << 18
_COUNT_BITS = 22
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Anchors(NamedTuple):
    """Items with anchors of one width: distinct keys in order, and behind each its items as places in ``data``."""

    width: int
    keys: np.ndarray
    first: np.ndarray  # of the items behind each key, and their number at the end
    start: np.ndarray
    size: np.ndarray
    before: np.ndarray  # bytes of the item before its anchor
    data: bytes


def _buckets(values: np.ndarray, bits: int) -> np.ndarray:
    return (values.astype(np.uint64, copy=False) * _ODD) >> np.uint64(64 - bits)


def _every(data: bytes, width: int, begin: int, stop: int) -> np.ndarray:
    """The windows that start at ``begin`` to ``stop``, in order."""
    out = np.empty(stop - begin, np.uint64)
    for k in range(min(width, stop - begin)):
        out[k::width] = np.frombuffer(data, f"<u{width}", len(out[k::width]), begin + k)
    return out


def _rarest(data: bytes, bounds: np.ndarray, width: int) -> np.ndarray:
    """Start of the window of each item that is rarest among the windows of all; every item has one."""
    counts = np.zeros(1 << _COUNT_BITS, np.uint32)
    best = np.full(len(bounds) - 1, np.iinfo(np.uint64).max)
    for last in (False, True):
        for begin in range(0, bounds[-1] - width + 1, STEP):
            stop = min(begin + STEP, bounds[-1] - width + 1)
            bucket = _buckets(_every(data, width, begin, stop), _COUNT_BITS)
            low, high = np.searchsorted(bounds, [begin, stop - 1], "right") - 1  # items of the first and the last window
            starts = np.maximum(bounds[low : high + 1], begin)
            ends = np.repeat(bounds[low + 1 : high + 2], np.diff(starts, append=stop))
            inside = np.arange(begin, stop) + width <= ends
            if last:
                score = np.where(inside, (counts[bucket].astype(np.uint64) << np.uint64(32)) | np.arange(begin, stop, dtype=np.uint64), np.iinfo(np.uint64).max)
                best[low : high + 1] = np.minimum(best[low : high + 1], np.minimum.reduceat(score, starts - begin))
            else:
                counts += np.bincount(bucket[inside].view(np.int64), minlength=len(counts)).astype(np.uint32)
    return (best & np.uint64(0xFFFFFFFF)).astype(np.int64)


def anchors(items: list[bytes]) -> list[Anchors]:
    """The anchors of distinct items of at least one byte, under 4 GB together."""
    out = []
    for width, longer in zip(WIDTHS, (np.inf, *WIDTHS), strict=False):
        some = [i for i in items if width <= len(i) < longer]
        if not some:
            continue
        data, size = b"".join(some), np.fromiter(map(len, some), np.int64, len(some))
        bounds = np.concatenate([[0], np.cumsum(size)])
        at = _rarest(data, bounds, width)
        flat = np.frombuffer(data, np.uint8)
        key = np.zeros(len(some), np.uint64)
        for k in range(width):
            key |= flat[at + k].astype(np.uint64) << np.uint64(8 * k)
        order = np.lexsort((size, key))
        keys, first = np.unique(key[order], return_index=True)
        small = lambda x: x.astype(np.uint32)
        out.append(Anchors(width, keys, small(np.append(first, len(some))), small(bounds[:-1][order]), small(size[order]), small((at - bounds[:-1])[order]), data))
    return out


def _met(a: Anchors, table: np.ndarray, bits: int, data: memoryview, low: int, high: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of windows that are anchors, with the index of their key."""
    for begin in range(low, high - a.width + 1, STEP):
        stop = min(begin + STEP, high - a.width + 1)
        for k in range(min(a.width, stop - begin)):
            values = np.frombuffer(data, f"<u{a.width}", -(-(stop - begin - k) // a.width), begin + k)
            at = np.flatnonzero(table[_buckets(values, bits)])
            values = values[at].astype(np.uint64)
            key = np.minimum(np.searchsorted(a.keys, values), len(a.keys) - 1)
            same = a.keys[key] == values
            yield begin + k + at[same] * a.width, key[same]


def _compare(a: Anchors, data: memoryview, bounds: np.ndarray, found: np.ndarray, place: np.ndarray, key: np.ndarray) -> None:
    """Marks the texts in which one of the items behind the keys stands at its place."""
    row = np.searchsorted(bounds, place, "right") - 1
    many = (a.first[key + 1] - a.first[key]).astype(np.int64)
    ends = np.cumsum(many)
    done = 0
    while done < len(place):
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")))
        here = done + np.flatnonzero(~found[row[done:to]])
        done = to
        hit = np.repeat(here, many[here])
        item = np.arange(len(hit)) - np.repeat(np.cumsum(many[here]) - many[here], many[here]) + a.first[key[hit]]
        start, size = place[hit] - a.before[item].astype(np.int64), a.size[item].astype(np.int64)
        fits = (start >= bounds[row[hit]]) & (start + size <= bounds[row[hit] + 1])
        for r, s, n, i in zip(row[hit[fits]].tolist(), start[fits].tolist(), size[fits].tolist(), a.start[item[fits]].tolist(), strict=True):
            if not found[r] and data[s : s + n] == a.data[i : i + n]:
                found[r] = True


class Finder:
    """Looks for the items of ``anchors`` in batches of texts."""

    def __init__(self, parts: list[Anchors]):
        self.parts = []
        for a in parts:
            bits = min(max(int(16 * len(a.keys)).bit_length(), 8), 24)
            table = np.zeros(1 << bits, bool)
            table[_buckets(a.keys, bits)] = True
            self.parts.append((a, table, bits))

    def __call__(self, data: Buffer, bounds: np.ndarray) -> np.ndarray:
        """For each text, ``data`` between two ``bounds``, whether it contains one of the items."""
        data = memoryview(data).cast("B")  # Arrow's are signed bytes, which never equal those of ``bytes`` from 128 on
        found = np.zeros(len(bounds) - 1, bool)
        if len(found):
            for a, table, bits in self.parts:
                for place, key in _met(a, table, bits, data, int(bounds[0]), int(bounds[-1])):
                    _compare(a, data, bounds, found, place, key)
        return found
