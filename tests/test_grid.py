"""The grid finds all overlapping boxes, whatever their sizes."""

import time

import numpy as np

from panelflow.operators.greedy import _kernels
from panelflow.operators.grid import Grid, close_pairs


def overlaps(a, b):
    return (min(a[0] + a[2], b[0] + b[2]) > max(a[0], b[0])) and (min(a[1] + a[3], b[1] + b[3]) > max(a[1], b[1])) and min(a[2], a[3], b[2], b[3]) > 0


def boxes(draw, n):
    out = np.concatenate((draw.uniform(-200, 900, (n, 2)), np.exp(draw.uniform(-3, 7, (n, 2)))), axis=1)
    out[::17, 2] = 0
    out[::19, 3] = -5
    out[3], out[5] = [np.nan, 0, 1, 1], [0, 0, np.inf, 4]
    out[7], out[8] = [64, 64, 64, 64], [128, 128, 64, 64]  # they touch
    return out


def test_pairs_and_lookups_find_every_overlap():
    draw = np.random.default_rng(3)
    left, right = boxes(draw, 150), boxes(draw, 170)
    i, j = close_pairs(left, right)
    assert sorted(zip(i, j, strict=True)) == list(zip(i, j, strict=True)) and len(i) < 0.7 * left.shape[0] * right.shape[0]
    finite = [k for k in range(len(left)) if np.isfinite(left[k]).all()]
    want = {(a, b) for a in finite for b in range(len(right)) if np.isfinite(right[b]).all() and overlaps(left[a], right[b])}
    assert want <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(want) > 300
    grid = Grid(right)
    gone = [k for k in range(0, 170, 3)]
    for k in gone:
        grid.remove(k, right[k].tolist())
    grid.add(1000, [0.0, 0.0, 50.0, 50.0])
    for a in finite:
        close = grid.close(left[a].tolist())
        assert {b for x, b in want if x == a and b % 3} <= set(close) and not set(close) & set(gone) and close == sorted(close)
    assert 1000 in grid.close([10.0, 10.0, 1.0, 1.0]) and grid.close([0.0, 0.0, 0.0, 5.0]) == []


def test_work_on_separate_boxes_is_near_linear():
    import pandas as pd
    play, test = _kernels(True, 0.5, None)
    spent = []
    for side in (60, 120):
        at = np.arange(side * side)
        frame = pd.DataFrame({"x": at % side * 30.0, "y": at // side * 30.0, "w": 25.0, "h": 25.0, "m": False, "n": at, "pos": None, "opened": None})
        start = time.perf_counter()
        slots = play(frame)
        left = test(frame.assign(x=frame["x"] + 1), slots)
        spent.append(time.perf_counter() - start)
        assert len(slots) == side * side and left.empty
    assert spent[1] < 10 * spent[0]  # 16 times and more for rows times slots
