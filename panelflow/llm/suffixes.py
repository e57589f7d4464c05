"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

Induction runs bucket by bucket: all suffixes of one first symbol are read at once, so a pass is a few array
operations per symbol instead of one step per suffix. Suffix order is exact at least for the first ``depth`` symbols.
"""

from __future__ import annotations

import numpy as np


def is_smaller(t: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one after them; the end of the text is smaller than any symbol."""
    n = len(t)
    if not n:
        return np.zeros(0, bool)
    change = np.full(n, n - 1, np.int64)
    differ = np.flatnonzero(t[:-1] != t[1:])
    change[differ] = differ
    change = np.minimum.accumulate(change[::-1])[::-1]
    return (change < n - 1) & (t[change] < t[np.minimum(change + 1, n - 1)])


def _send(lists: np.ndarray, ends: np.ndarray, suffixes: np.ndarray, symbols: np.ndarray) -> None:
    """Append suffixes, in order, to the lists of their symbols."""
    if not len(suffixes):
        return
    order = np.argsort(symbols, kind="stable")
    symbols = symbols[order]
    first = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
    count = np.diff(np.concatenate((first, [len(symbols)])))
    present = symbols[first]
    lists[np.repeat(ends[present] - first, count) + np.arange(len(symbols))] = suffixes[order]
    ends[present] += count


def _induce(t: np.ndarray, small: np.ndarray, sigma: int, lms: np.ndarray) -> np.ndarray:
    """Suffix array from the leftmost-smaller suffixes in (bucket) order."""
    large_begin = np.concatenate(([0], np.cumsum(np.bincount(t[~small], minlength=sigma))))
    small_begin = np.concatenate(([0], np.cumsum(np.bincount(t[small], minlength=sigma))))
    large, large_end = np.zeros(large_begin[-1], np.int32), large_begin[:-1].copy()
    down, down_end = np.zeros(small_begin[-1], np.int32), small_begin[:-1].copy()  # smaller suffixes, greatest first
    by_symbol = lms[np.argsort(t[lms], kind="stable")]
    lms_begin = np.searchsorted(t[by_symbol], np.arange(sigma + 1))

    def before(suffixes: np.ndarray, kind: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        p = suffixes - 1
        p = p[p >= 0]
        p = p[kind[p]]
        return p, t[p]

    is_large = ~small
    last = len(t) - 1
    large[large_end[t[last]]] = last  # the suffix before the end of the text
    large_end[t[last]] += 1
    for c in range(sigma):
        a = large_begin[c]
        if a == large_begin[c + 1] and lms_begin[c] == lms_begin[c + 1]:
            continue
        held = []
        while a < large_end[c]:  # runs of the symbol lead back into its own bucket
            b = large_end[c]
            p, s = before(large[a:b], is_large)
            own = s == c
            stay = p[own]
            large[b:b + len(stay)] = stay
            large_end[c] = b + len(stay)
            held.append((p[~own], s[~own]))
            a = b
        held.append(before(by_symbol[lms_begin[c]:lms_begin[c + 1]], is_large))
        _send(large, large_end, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
    for c in range(sigma - 1, -1, -1):
        a = small_begin[c]
        if a == small_begin[c + 1] and large_begin[c] == large_begin[c + 1]:
            continue
        held = []
        while a < down_end[c]:
            b = down_end[c]
            p, s = before(down[a:b], small)
            own = s == c
            stay = p[own]
            down[b:b + len(stay)] = stay
            down_end[c] = b + len(stay)
            held.append((p[~own], s[~own]))
            a = b
        held.append(before(large[large_begin[c]:large_begin[c + 1]][::-1], small))
        _send(down, down_end, np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
    out = np.empty(len(t), np.int32)
    n_large, n_small = np.diff(large_begin), np.diff(small_begin)
    begin = np.cumsum(n_large + n_small) - n_large - n_small
    out[np.repeat(begin - large_begin[:-1], n_large) + np.arange(len(large))] = large
    back = np.repeat(begin + n_large + n_small - 1 + small_begin[:-1], n_small) - np.arange(len(down))
    out[back] = down
    return out


def _words(t: np.ndarray) -> np.ndarray:
    """The eight symbols from each place on as one number, first symbol lowest; zeros after the end."""
    w = np.concatenate((t, np.zeros(8, t.dtype))).astype(np.uint64)
    for k, bits in ((1, 8), (2, 16), (4, 32)):
        w = w[:-k] | (w[k:] << np.uint64(bits))
    return w[:len(t)]


def _names(t: np.ndarray, lms: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Name of every leftmost-smaller substring, in text order: equal substrings share a name, names keep the order."""
    length = np.empty(len(t) + 1, np.int32)  # up to and with the next leftmost-smaller symbol
    length[lms] = np.diff(np.concatenate((lms, [len(t) - 1]))) + 1
    a, b = order[:-1], order[1:]
    same = (length[a] == length[b]) & (b != lms[-1]) & (a != lms[-1])
    if t.dtype == np.uint8:
        w, step = _words(t), 8
    else:
        w, step = t, 1
    live, at = np.flatnonzero(same), 0
    while len(live):
        rest = length[a[live]] - at
        equal = w[a[live] + at] == w[b[live] + at]
        if step == 8:
            part = rest < 8
            mask = (np.uint64(1) << (np.minimum(rest, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            equal = np.where(part, ((w[a[live] + at] ^ w[b[live] + at]) & mask) == 0, equal)
        same[live[~equal]] = False
        at += step
        live = live[equal & (rest > step)]
    name = np.concatenate(([0], np.cumsum(~same)))
    out = np.empty(len(t), np.int32)
    out[order] = name
    return out[lms], int(name[-1]) + 1


def _by_doubling(r: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a string of many different symbols by doubling ranks, for ``depth`` symbols at least."""
    rank, h, n = r.astype(np.int64), 1, len(r)
    order = np.argsort(rank)
    while h < depth:
        key = rank * (n + 1)
        key[:n - h] += rank[h:] + 1
        order = np.argsort(key)
        ranked = key[order]
        fresh = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        h *= 2
    return order


def suffix_array(t: np.ndarray, sigma: int = 256, depth: int | None = None) -> np.ndarray:
    """Starts of all suffixes of ``t`` (symbols 0 to sigma-1) in order, exact for ``depth`` symbols (None: wholly).

    Leftmost-smaller substrings are sorted by inducing once, named, and the string of names is sorted in turn:
    by the same method while a symbol has many suffixes, else by doubling. The whole array is induced from that order.
    """
    n = len(t)
    depth = n if depth is None else depth
    if n < 2:
        return np.arange(n, dtype=np.int32)
    small = is_smaller(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + np.int32(1)
    if len(lms) > 1:
        leftmost = np.zeros(n, bool)
        leftmost[lms] = True
        order = _induce(t, small, sigma, lms)
        order = order[leftmost[order]]
        names, kinds = _names(t, lms, order)
        if kinds < len(lms):
            # A name reaches at least two symbols on, so half as many names cover the same depth.
            reach = depth // 2 + 2
            sorted_ = (suffix_array(names, kinds, reach) if len(names) >= 512 * kinds
                       else _by_doubling(names, min(reach, len(names))))
            order = lms[sorted_]
        lms = order
    return _induce(t, small, sigma, lms)


def common_prefixes(t: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For suffixes in order, how many bytes each shares with the one before it, ``width`` at most.

    Worked out in text order (permuted), where one side of every comparison is read straight through. Places need
    ``width`` bytes after them.
    """
    before = np.full(len(t) + 1, -1, np.int64)
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before[:-1] >= 0)
    prior, w = before[at], _words(t)
    shared, live = np.zeros(len(at), np.int64), np.arange(len(at))
    for k in range(0, width, 8):
        x = w[at[live] + k] ^ w[prior[live] + k]
        equal = x == 0
        low = x[~equal]
        shared[live[~equal]] = k + np.bitwise_count((low & (~low + np.uint64(1))) - np.uint64(1)) // 8
        live = live[equal]
        shared[live] = k + 8
    permuted = np.zeros(len(t), np.int64)
    permuted[at] = np.minimum(shared, width)
    return permuted[order]
