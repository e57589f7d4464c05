"""A grid over boxes for work inside a task: each box meets only boxes of the cells it covers.

Cells have a size for each power of two, and a box lies in the cells of its own size, four at most but for rounding. So
boxes of very different sizes share one grid, and looking one up costs a few cells for each size in use.
"""

from __future__ import annotations

import math

import numpy as np

MOST_CELLS = 64
_WIDE = 1 << 31


def _sizes(boxes: np.ndarray) -> np.ndarray:
    """Power of two of the cell size of each box (x, y, w, h)."""
    side = np.maximum(boxes[:, 2], boxes[:, 3])
    return np.ceil(np.log2(np.maximum(side, 1e-9))).astype(np.int64)


def _covered(boxes: np.ndarray, power: np.ndarray | int) -> tuple[np.ndarray, ...]:
    """First and last cell of each box along both axes, for cells of the given sizes."""
    size = np.exp2(np.asarray(power, float))
    low, high = boxes[:, :2], boxes[:, :2] + boxes[:, 2:]
    first = np.floor(low / np.expand_dims(size, -1)).clip(-_WIDE / 4, _WIDE / 4).astype(np.int64)
    last = np.floor(high / np.expand_dims(size, -1)).clip(-_WIDE / 4, _WIDE / 4).astype(np.int64)
    return first[:, 0], last[:, 0], first[:, 1], last[:, 1]


def _cells(x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All cells of all boxes: which box, which cell."""
    high = y1 - y0 + 1
    count = (x1 - x0 + 1) * high
    box = np.repeat(np.arange(len(count)), count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return box, (x0[box] + at // high[box]) * _WIDE + y0[box] + at % high[box]


def _solid(boxes: np.ndarray) -> np.ndarray:
    """Boxes that can overlap another one at all."""
    return np.flatnonzero(np.isfinite(boxes).all(axis=1) & (boxes[:, 2] > 0) & (boxes[:, 3] > 0))


def close_pairs(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), in order, among which are all boxes of ``left`` and ``right`` that overlap."""
    own, other = _solid(left), _solid(right)
    power, found = _sizes(right[other]), [np.zeros(0, np.int64)]
    for p in np.unique(power):
        some = other[power == p]
        box, cell = _cells(*_covered(right[some], p))
        order = np.argsort(cell, kind="stable")
        box, cell = some[box[order]], cell[order]
        x0, x1, y0, y1 = _covered(left[own], p)
        few = (x1 - x0 + 1.0) * (y1 - y0 + 1.0) <= max(MOST_CELLS, len(some))
        asks, asked = _cells(x0[few], x1[few], y0[few], y1[few])
        begin, end = np.searchsorted(cell, asked, "left"), np.searchsorted(cell, asked, "right")
        count = end - begin
        at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        found.append(np.repeat(own[few][asks], count) * len(right) + box[np.repeat(begin, count) + at])
        # A box over more cells than there are boxes of this size meets them all.
        found.append((own[~few][:, None] * len(right) + some[None, :]).ravel())
    both = np.unique(np.concatenate(found))
    return both // max(len(right), 1), both % max(len(right), 1)


def _span(low: float, length: float, size: float) -> range:
    """Cells along one axis, as ``_covered`` gives them."""
    most = _WIDE // 4
    return range(max(-most, min(most, math.floor(low / size))), max(-most, min(most, math.floor((low + length) / size))) + 1)


class Grid:
    """Numbered boxes that come, go and are looked up one at a time."""

    def __init__(self, boxes: np.ndarray):
        """Boxes numbered from 0."""
        self.held: dict[int, dict[int, set[int]]] = {}
        own = _solid(boxes)
        power = _sizes(boxes[own])
        for p in np.unique(power):
            some = own[power == p]
            box, cell = _cells(*_covered(boxes[some], p))
            cells = self.held.setdefault(int(p), {})
            for b, c in zip(some[box].tolist(), cell.tolist(), strict=True):
                cells.setdefault(c, set()).add(b)

    def _places(self, box: list[float]) -> tuple[int, list[int]] | None:
        x, y, w, h = box
        if not (w > 0 and h > 0 and all(map(math.isfinite, box))):
            return None
        power = int(_sizes(np.array([box]))[0])
        size = 2.0 ** power
        return power, [i * _WIDE + j for i in _span(x, w, size) for j in _span(y, h, size)]

    def add(self, number: int, box: list[float]) -> None:
        if place := self._places(box):
            cells = self.held.setdefault(place[0], {})
            for c in place[1]:
                cells.setdefault(c, set()).add(number)

    def remove(self, number: int, box: list[float]) -> None:
        if place := self._places(box):
            for c in place[1]:
                self.held[place[0]][c].discard(number)

    def close(self, box: list[float]) -> list[int]:
        """Numbers, rising, among which are all boxes that overlap this one."""
        x, y, w, h = box
        found: set[int] = set()
        if w > 0 and h > 0 and all(map(math.isfinite, box)):
            for power, cells in self.held.items():
                size = 2.0 ** power
                across, down = _span(x, w, size), _span(y, h, size)
                if len(across) * len(down) <= max(MOST_CELLS, len(cells)):
                    for i in across:
                        for j in down:
                            if (c := i * _WIDE + j) in cells:
                                found |= cells[c]
                else:
                    found.update(*cells.values())
        return sorted(found)
