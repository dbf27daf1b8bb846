"""Byte-pair merging: of one piece in n log n steps, and of many short pieces at once."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np

STEP = 1 << 21
SHORT = 48


def merge_table(pairs: list[tuple[int, int, int]]) -> dict[int, int]:
    """(left, right, merged) in order of rank, as one number a pair: rank first, then the merged id."""
    return {left * STEP + right: rank * STEP + merged for rank, (left, right, merged) in enumerate(pairs)}


def merge_pairs(ids: list[int], merges: dict[int, int]) -> list[int]:
    """Join neighbours, lowest rank first and then leftmost, until none can be joined."""
    if len(ids) > SHORT:
        return _merge_long(ids, merges)
    ids = list(ids)
    while len(ids) > 1:
        best, at = None, 0
        for i, left in enumerate(ids[:-1]):
            found = merges.get(left * STEP + ids[i + 1])
            if found is not None and (best is None or found < best):
                best, at = found, i
        if best is None:
            break
        ids[at : at + 2] = [best % STEP]
    return ids


def _merge_long(ids: list[int], merges: dict[int, int]) -> list[int]:
    """The same with a heap over a linked list."""
    ids, n = list(ids), len(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(found, i) for i in range(n - 1) if (found := merges.get(ids[i] * STEP + ids[i + 1])) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        j = after[i]
        # stale entries: the symbol is gone, or a neighbour has changed
        if ids[i] < 0 or j >= n or merges.get(ids[i] * STEP + ids[j]) != rank:
            continue
        ids[i], ids[j] = rank % STEP, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (found := merges.get(ids[i] * STEP + ids[k])) is not None:
                heappush(heap, (found, i))
        h = before[i]
        if h >= 0 and (found := merges.get(ids[h] * STEP + ids[i])) is not None:
            heappush(heap, (found, h))
    return [x for x in ids if x >= 0]


class BatchMerger:
    """Merges many pieces side by side, as rows of one array."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, merges: dict[int, int]):
        self.merges = merges
        self.pairs = np.array(sorted(merges), np.int64)
        self.ranks = np.array([merges[p] for p in self.pairs.tolist()], np.int64)
        # (left, right) pairs fall into cells; most cells hold one pair, so one comparison finds it
        self.bits = max(4, int(2 * len(self.pairs)).bit_length() + 1)
        cell = self._cell(self.pairs)
        order = np.argsort(cell, kind="stable")
        self.pairs, self.ranks, cell = self.pairs[order], self.ranks[order], cell[order]
        self.first = np.searchsorted(cell, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.depth = int(np.diff(self.first).max()) if len(cell) else 0
        self.pairs = np.concatenate([self.pairs, np.full(self.depth + 1, -1)])
        self.ranks = np.concatenate([self.ranks, np.full(self.depth + 1, self.NONE)])

    def _cell(self, pairs: np.ndarray) -> np.ndarray:
        spread = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and merged id of each pair as one number; ``NONE`` for no merge. Negative ids stand for no symbol."""
        pairs = left.astype(np.int64) * STEP + right
        out = np.full(pairs.shape, self.NONE)
        at = self.first[self._cell(pairs)]
        for i in range(self.depth):
            hit = self.pairs[at + i] == pairs
            out[hit] = self.ranks[at + i][hit]
        out[right < 0] = self.NONE
        return out

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and lengths of the pieces after merging, in the order given."""
        starts = np.cumsum(lengths) - lengths
        counts = np.array(lengths, np.int64)
        out = np.array(symbols, np.int32)
        keep = np.ones(len(out), bool)
        short = (lengths > 1) & (lengths <= SHORT)
        for low in (2, 9, 17):
            high = {2: 8, 9: 16, 17: SHORT}[low]
            rows = np.flatnonzero(short & (lengths >= low) & (lengths <= high))
            if len(rows):
                self._block(out, keep, starts[rows], counts, rows, min(high, int(lengths[rows].max())))
        for row in np.flatnonzero(lengths > SHORT).tolist():
            a, b = int(starts[row]), int(starts[row] + lengths[row])
            ids = merge_pairs(out[a:b].tolist(), self.merges)
            out[a : a + len(ids)] = ids
            keep[a + len(ids) : b] = False
            counts[row] = len(ids)
        return out[keep], counts

    def _block(self, out, keep, starts, counts, rows, width) -> None:
        at = starts[:, None] + np.arange(width)
        inside = np.arange(width) < counts[rows][:, None]
        table = np.where(inside, out[np.minimum(at, len(out) - 1)], -1)
        size = counts[rows].copy()
        ranks = np.full((len(rows), width), self.NONE)
        ranks[:, :-1] = self.rank(table[:, :-1], table[:, 1:])
        live = np.arange(len(rows))
        columns = np.arange(width)
        now, cost = table, ranks
        while len(live):
            spot = cost.argmin(axis=1)
            lines = np.arange(len(live))
            best = cost[lines, spot]
            open_ = best != self.NONE
            if not open_.all():
                table[live[~open_]] = now[~open_]
                live, now, cost, spot, best = live[open_], now[open_], cost[open_], spot[open_], best[open_]
                lines = np.arange(len(live))
                if not len(live):
                    break
            now[lines, spot] = best % STEP
            # close the gap behind the merged pair
            take = np.minimum(columns + (columns > spot[:, None]), width - 1)
            now = np.take_along_axis(now, take, 1)
            now[:, -1] = -1
            take = np.minimum(columns + (columns >= spot[:, None]), width - 1)
            cost = np.take_along_axis(cost, take, 1)
            cost[:, -1] = self.NONE
            after = np.minimum(spot + 1, width - 1)
            cost[lines, spot] = np.where(spot + 1 < width, self.rank(now[lines, spot], now[lines, after]), self.NONE)
            left = spot > 0
            cost[lines[left], spot[left] - 1] = self.rank(now[lines[left], spot[left] - 1], now[lines[left], spot[left]])
            size[live] -= 1
        held = np.arange(width) < size[:, None]
        place = (starts[:, None] + np.arange(width))[held]
        keep[at[inside]] = False
        keep[place] = True
        out[place] = table[held]
        counts[rows] = size
