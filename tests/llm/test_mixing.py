import hashlib
import re

from panelflow.llm.mixing import mix_sources


def brute(rows):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), hashlib.md5(str("" if i is None else i).encode()).hexdigest())
            for i, t, _, s in rows]
    sources = sorted({d[1] for d in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(d[2] for d in docs if d[1] == s) for s in sources}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    while open_:  # reshare until none is above its cap
        rest = sum(size.values()) - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        target.update({s: 3.0 * size[s] for s in over})
        open_ -= over
    queue, run = [], dict.fromkeys(sources, 0)
    for d in sorted(docs, key=lambda d: (d[3], d[2])):
        run[d[1]] += d[2]
        for turn in range(3):
            if d[2] and target[d[1]]:
                queue.append(((turn * size[d[1]] + run[d[1]]) / target[d[1]], sources.index(d[1]), d[3], d[0], d[2]))
    taken, held = {}, 0
    for *_, i, n in sorted(queue, key=lambda q: q[:3]):
        held += n
        if held > sum(size.values()):
            break
        taken[i] = taken.get(i, 0) + n
    return {d[0]: (d[2], size[d[1]], round(target[d[1]], 6), taken.get(d[0], 0)) for d in docs}


def check(make, rows):
    got = mix_sources(make(rows)).collect()
    assert len(got) == len(rows)
    assert {r["id"]: (r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got} == brute(rows)
    return got


def test_sources_of_uneven_size(make):
    rows = [(i, "w " * (i % 17 + 1), None, "abcd"[min(i % 10, 3)] if i % 11 else None) for i in range(300)]
    check(make, rows)


def test_caps_are_reshared(make):
    check(make, [(i, "w " * 10, None, "a" if i < 2 else "b" if i < 10 else "c") for i in range(60)])


def test_odd_rows_and_copies(make, odd_rows):
    rows = make(odd_rows)
    got = mix_sources(rows).collect()
    assert len(got) == len(odd_rows)
    assert all(r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"] for r in got)
    kept = mix_sources(rows, keep=True)
    assert kept.columns == rows.columns
    assert kept.count() == sum(r["taken"] // r["size"] for r in got if r["size"])


def test_empty(make):
    assert mix_sources(make([])).collect() == []
    got = mix_sources(make([(1, None, None, "a"), (2, "", None, None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2
