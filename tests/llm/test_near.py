import random
import re
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from sample_texts import prose

from panelflow.llm.dissimilar import keep_dissimilar
from panelflow.llm.near import components, fingerprints, keep_first, links, near_duplicates


def simhash(text):
    text = re.sub("[A-Z]", lambda m: m.group(0).lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        ones = [n + (h >> b & 1) for b, n in enumerate(ones)]
    return sum(1 << b for b, n in enumerate(ones) if 2 * n > len(shingles))


def classes(prints, radius=2):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    found = sorted(root)
    for i, p in enumerate(found):
        for q in found[:i]:
            if (p ^ q).bit_count() <= radius:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in found}


def test_odd_rows_against_brute_force(make, odd_rows):
    got = near_duplicates(make(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    want = [(r[0], simhash(r[1])) for r in odd_rows]
    assert sorted((str(r["id"]), r["fingerprint"] % 2**64) for r in got) == sorted((str(i), p) for i, p in want)
    root = classes([p for _, p in want])
    least = {}
    for i, p in want:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    for r in got:
        assert r["component_id"] == least.get(root[r["fingerprint"] % 2**64])


def test_links_join_chains_and_dense_groups_for_any_parts_and_tiles(spark):
    base = 0x0123456789ABCDEF
    prints = [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)] + [0, 3, 15, 63, 2**63, 2**64 - 1, 1 << 40]
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    want = classes(prints)
    for parts, tile in ((4, 4096), (8, 4096), (16, 5), (4, 3)):
        got = {r["node"] % 2**64: r["root"] % 2**64 for r in components(links(df, tile=tile, parts=parts)).collect()}
        groups = {}
        for p in prints:
            groups.setdefault(got.get(p, p), set()).add(p)
        expected = {}
        for p, r in want.items():
            expected.setdefault(r, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values())), (parts, tile)


def test_keep_first_keeps_one_of_each_class_and_rows_without_id(make, odd_rows):
    got = keep_first(make(odd_rows)).select("id", "original_text", "key").collect()
    ids = [r["id"] for r in got]
    assert sorted(i for i in ids if i is not None) == [1, 2, 4, 6, 9, 10, 11] and ids.count(None) == 2
    assert all(r["key"] == "k" for r in got)


def test_no_rows(make):
    assert near_duplicates(make([])).collect() == []
    assert fingerprints(make([])).collect() == []
    assert keep_first(make([])).collect() == []


def similar(rows, least=Fraction(4, 5)):
    """Ids that stay: the smallest of every class joined by a Jaccard index over five-word shingles."""
    sets = {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group(0).lower(), text or ""))
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    holders, root, pairs = {}, {i: i for i in sets}, 0
    for i, s in sets.items():
        for g in s or {None}:
            holders.setdefault(g, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, s in sets.items():
        for j in {j for g in s or {None} for j in holders[g] if j < i}:
            common = len(s & sets[j])
            if s == sets[j] or common >= least * (len(s) + len(sets[j]) - common):
                pairs += s != sets[j]
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i for i in sets if find(i) == i}, pairs


def test_similar_texts_against_brute_force_jaccard(make):
    draw = random.Random(3)
    rows = [(1, None), (2, " "), (3, "one two"), (4, "One  two"), (5, "one two three")]
    for base in range(6):
        words = prose(20 + base, 300).split()
        for edits in [0, *range(1, 14)] * 2:
            other = list(words)
            for k in draw.sample(range(300), edits):
                other[k] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(other)))
    draw.shuffle(rows)
    want, pairs = similar(rows)
    assert pairs > 100 and len(want) > 6
    got = keep_dissimilar(make(rows + [(None, rows[0][1]), rows[1]])).select("id", "key").collect()
    ids = [r["id"] for r in got]
    assert ids.count(None) == 1 and all(r["key"] == "k" for r in got)
    assert sorted(i for i in ids if i is not None) == sorted(want)
    assert keep_dissimilar(make([])).collect() == []


def test_one_id_with_several_texts_loses_no_text(spark):
    a, b = prose(7, 200), prose(8, 200)
    near = a + " end"
    rows = [("1", a, 1), ("5", near, 2), ("5", b, 3), ("5", b, 3), ("7", None, 4), ("8", " ", 5), (None, a, 6)]
    df = spark.createDataFrame(rows, "id string, original_text string, place int")
    got = sorted((r["id"] or "", r["original_text"], r["place"]) for r in keep_dissimilar(df).collect())
    assert got == sorted([("1", a, 1), ("5", b, 3), ("7", None, 4), ("", a, 6)])


@pytest.mark.parametrize(("cell", "tile"), [(1024, 4096), (4, 4096), (1, 5), (40, 7)])
def test_fingerprints_alone_find_the_similar_pairs(spark, cell, tile):
    from panelflow.llm.dissimilar import near_members, simhash_sketch
    from panelflow.llm.similar import distinct_nodes, placed, sketched
    from panelflow.session import cut
    draw, rows = random.Random(11), []
    for base, size in enumerate([9, 9, 12, 18, 40, 90, 300, 300, 300]):
        words = prose(50 + base, size).split()
        for edits in [0, 1, 1, 2, 2, size // 40, size // 50]:
            other = list(words)
            for k in draw.sample(range(size), edits):
                other[k] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(other[:size - draw.randrange(2)])))
    sketch = simhash_sketch()
    assert sketch.width == 64 and sketch.keys is None  # nothing but the SimHash fingerprint
    df = spark.createDataFrame(rows, "id long, original_text string")
    nodes = cut(distinct_nodes(cut(sketched(placed(df, "id", "original_text"), 5, sketch))))
    met = cut(near_members(nodes, cell=cell, tile=tile))
    first = {r["node"]: r["first"] for r in nodes.collect()}
    edges = met.groupBy("key").agg(F.min("node").alias("dst")).join(met, "key").select(F.col("node").alias("src"), "dst")
    root = {r["node"]: r["root"] for r in components(edges).collect()}
    near = {first[n]: root.get(n, n) for n in first}
    pairs = [(i, j) for i in near for j in near if i < j and len(similar([rows[i], rows[j]])[0]) == 1]
    assert len(pairs) > 40 and all(near[i] == near[j] for i, j in pairs)
    assert len(set(near.values())) >= 9
    got = keep_dissimilar(df, cell=cell).select("id").collect()
    assert {r["id"] for r in got} == similar(rows)[0]


def test_near_labels_of_a_large_cell_are_the_components():
    from panelflow.llm.dissimilar import near_labels
    draw = np.random.default_rng(4)
    prints = draw.integers(0, 1 << 63, (700, 4), np.uint64)
    prints[100:400] = prints[100]  # near copies, chained beyond the reach of one head
    for k in range(101, 400):
        prints[k, k % 4] = prints[k - 1, k % 4] ^ np.uint64(1 << int(draw.integers(60)))
        prints[k, [w for w in range(4) if w != k % 4]] = prints[k - 1, [w for w in range(4) if w != k % 4]]
    n = np.where(np.arange(700) < 650, 300, 100)
    prints[650:] = prints[100:150]  # equal bits, but of another size
    differ = np.bitwise_count(prints[:, None] ^ prints[None]).sum(-1, dtype=int)
    near = (differ <= 73) & (n[:, None] == n)
    want = np.arange(700)
    while True:
        new = np.where(near, want, 700).min(1)
        if (new == want).all():
            break
        want = new
    order = draw.permutation(700)
    label = near_labels(prints[order], n[order], Fraction(4, 5))
    assert ((label[:, None] == label) == (want[order][:, None] == want[order])).all()
    assert len(set(want)) < 450


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no driver tables")
def test_stage_of_the_pipeline_against_brute_force_jaccard(spark):
    import corpus_pipeline
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, pairs = similar([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert pairs >= 12
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()]
    assert sorted(got) == sorted(want)
