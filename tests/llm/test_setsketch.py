import random
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
from sample_texts import prose
from test_near import similar

from panelflow.llm.setsketch import band_keys, estimate, merged, registers, set_sketch, similar_segments
from panelflow.llm.shingles import shingle_hashes


def shingles(text):
    import re
    text = re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_hashed_shingles_are_the_distinct_shingles():
    texts = ["a b c d e f a b c d e", "A  b\tc\nd e", "one", "", "  ", "x" * 5000 + " y", "a b c d e f", "é ü " * 40]
    raw = [t.encode() for t in texts]
    hashes, n = shingle_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 5)
    assert n.tolist() == [len(shingles(t)) for t in texts]
    sets = [set(x.tolist()) for x in np.split(hashes, np.cumsum(n)[:-1])]
    for i, s in enumerate(sets):
        for j, t in enumerate(sets):
            assert len(s & t) == len(shingles(texts[i]) & shingles(texts[j]))


def test_registers_merge_and_estimate_the_index():
    draw = np.random.default_rng(1)
    for common, left, right in ((900, 50, 50), (850, 150, 0), (500, 300, 200), (0, 400, 400)):
        pool = draw.integers(0, 1 << 63, common + left + right, np.uint64)
        x, y = np.sort(pool[:common + left]), np.sort(np.concatenate((pool[:common], pool[common + left:])))
        a, b, both = (registers(s, np.array([0]), 384)[0] for s in (x, y, np.unique(pool)))
        assert (merged(a, b) == both).all()
        counts = [np.array([f(a, b).sum()]) for f in (np.equal, np.greater, np.less)]
        index, doubt = estimate(*counts, np.array([float(len(x))]), np.array([float(len(y))]))
        assert abs(index[0] - common / (common + left + right)) < 0.1 and (doubt[0] > 18) == (common < 850)
    assert band_keys(np.stack([a, b, a]), 48, 8)[0].tolist() == band_keys(np.stack([a]), 48, 8)[0].tolist()


def test_screen_gives_the_same_for_tiles_and_single_pairs():
    draw = np.random.default_rng(2)
    sketch = set_sketch()
    rows = draw.integers(40, 60, (6, sketch.compared), np.uint8)
    rows[1], rows[2] = rows[0], np.where(draw.random(sketch.compared) < 0.1, 7, rows[0])
    n = np.array([100, 100, 98, 100, 50, 100])
    tile = sketch.screen(rows[:, None], n[:, None], rows[None], n[None])
    assert tile[0, 1] > 0.99 and tile[0, 2] > 0.8 and tile[0, 3] == -np.inf and tile[0, 4] == -np.inf
    for i in range(6):
        assert np.array_equal(tile[i], sketch.screen(rows[[i] * 6], n[[i] * 6], rows, n))


def brute(rows, least=Fraction(85, 100)):
    """Classes by brute force; texts without words link with nothing."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and common >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return [(i, len(s), ids.get(find(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def edited(count, bases, seed=3):
    draw, rows = random.Random(seed), []
    for base in range(bases):
        words = prose(20 + base, 300).split()
        for edits in range(count):
            other = list(words)
            for k in draw.sample(range(300), edits % 13):
                other[k] = f"x{draw.randrange(10**6)}"
            rows.append(" ".join(other))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["long", "string"])
def test_classes_against_brute_force(spark, kind):
    texts = [None, "", " \n ", "one two", "One  two", "one two three", "w " * 3000, *edited(26, 5)]
    rows = [(k + 1, t) for k, t in enumerate(texts)] + [(None, texts[9]), (None, None), (9, texts[8]), (9, texts[12])]
    if kind == "string":
        rows = [(None if i is None else f"seg-{i:04d}", t) for i, t in rows]
    df = spark.createDataFrame([(*r, 7, "d", "k") for r in rows], f"id {kind}, original_text string, node int, digest string, key string")
    got = similar_segments(df)
    assert got.columns == ["id", "n_shingles", "component_id"] and got.schema["component_id"].dataType == df.schema["id"].dataType
    order = lambda found: sorted(found, key=str)
    want = brute(rows)
    assert order(tuple(r) for r in got.collect()) == order(want)
    assert len({c for _, n, c in want if n}) < len(rows) - 40


def test_small_tiles_change_nothing(spark, monkeypatch):
    from panelflow.llm import similar as engine
    monkeypatch.setattr(engine, "PAIRS", 7)
    monkeypatch.setattr(engine.similar_classes, "__defaults__", (3,))
    rows = [(k, t) for k, t in enumerate(edited(26, 3, seed=5))]
    got = similar_segments(spark.createDataFrame(rows, "id int, original_text string"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute(rows))


def test_no_rows(make):
    assert similar_segments(make([])).collect() == []


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no driver tables")
def test_query_against_brute_force(spark):
    from panelflow.llm.queries import QUERIES
    got = QUERIES["op13_similar"](spark, "/root/testdata/sf0.01").collect()
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert {(r["doc_id"], r["n_shingles"]) for r in got} == {(i, len(shingles(t))) for i, t in docs}
    want = similar([d for d in docs if shingles(d[1])], Fraction(85, 100))[0] | {i for i, t in docs if not shingles(t)}
    assert {r["doc_id"] for r in got if r["kept"]} == want and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
