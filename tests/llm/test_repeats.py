import random

import numpy as np
import pytest

from panelflow.llm.repeats import clean_repeats, remove_repeats
from panelflow.llm.suffixes import common_prefixes, suffix_array


def brute(rows, width=50):
    data = [(10**9 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    least = {}
    for i, b in data:
        for k in range(len(b) - width + 1):
            w = b[k:k + width]
            least[w] = min(i, least.get(w, i))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if least[b[k:k + width]] < i:
                gone[k:k + width] = b"\1" * width
        out.append((None if i == 10**9 else i, bytes(x for x, g in zip(b, gone, strict=True) if not g), bytes(gone)))
    return out


def spans_of(gone):
    edges = [k for k in range(len(gone) + 1) if (gone[k - 1] if k else 0) != (gone[k] if k < len(gone) else 0)]
    return list(zip(edges[::2], edges[1::2], strict=True))


def passages(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(n)) for n in (12, 20, 60, 9)]
    rows = []
    for i in range(40):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(3)]
        for s in rng.sample(shared, 2):
            cut = rng.randint(0, 10)
            parts.insert(rng.randint(0, 3), s[cut:])
        rows.append((rng.randint(1, 1000), " ".join(parts)))
    return rows


def check(make, rows):
    got = sorted((str(r["id"]), r["kept"], [tuple(s) for s in r["spans"]], r["n_bytes"]) for r in remove_repeats(make(rows)).collect())
    want = sorted((str(i), kept, spans_of(gone), len(gone)) for i, kept, gone in brute(rows))
    assert [(i, bytes(k), s, n) for i, k, s, n in got] == want


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(make, seed):
    check(make, passages(seed))


def test_odd_rows(make, odd_rows):
    check(make, odd_rows + [(12, "a" * 300), (0, "b" + "a" * 49), (13, "xyz" * 40), (14, "q" + "xyz" * 40)])


def test_no_rows_and_no_repeats(make):
    assert remove_repeats(make([])).collect() == []
    assert [bytes(r["kept"]) for r in remove_repeats(make([(1, "short")])).collect()] == [b"short"]


def test_clean_keeps_columns_and_whole_characters(make):
    shared = "ä" * 40
    rows = [(1, shared, "de", "p"), (2, "x" + shared + "yö", "de", "q"), (3, shared, None, None)]
    got = {r["id"]: r for r in clean_repeats(make(rows)).collect()}
    assert got[1]["original_text"] == shared and got[2]["original_text"] == "xyö" and got[3]["original_text"] == ""
    assert got[2]["project_id"] == "q" and got[2]["key"] == "k"


def test_suffix_arrays_of_small_alphabets():
    rng = np.random.default_rng(3)
    for trial in range(300):
        t = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(0, 120))).astype(np.uint8)
        if trial % 3 == 0:
            t = np.tile(t[:max(1, len(t) // 6)], 7)
        raw = t.tobytes()
        assert suffix_array(t).tolist() == sorted(range(len(t)), key=lambda k: raw[k:])


def test_induced_recursion_and_prefixes():
    t = np.random.default_rng(4).integers(0, 2, 60_000).astype(np.uint8)
    raw, order = t.tobytes(), suffix_array(t, depth=51)
    heads = [raw[k:k + 50] for k in order.tolist()]
    assert heads == sorted(heads)
    order = order[order <= len(t) - 50]
    got = common_prefixes(t, order, 50)
    for k in range(1, len(order), 97):
        a, b = raw[order[k - 1]:], raw[order[k]:]
        n = next((x for x in range(50) if a[x] != b[x]), 50)
        assert got[k] == n
