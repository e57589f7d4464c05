import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelflow.llm import neighbours
from panelflow.llm.neighbours import Piece, asked_scores, fewer_rows, merged_rows, nearest, nearest_cells, offsets, reach, spread_sample

SCHEMA = "vec_id long, embedding array<float>, label int, key string, ids long"


def brute(rows, every=50, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = np.array(sorted(ok))
    x = np.stack([ok[i] / np.linalg.norm(ok[i]) for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        s = x @ x[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        best = np.lexsort((ids, -np.round(s, 12)))[:min(k, len(ids) - 1)]
        out[int(q)] = [(int(ids[b]), s[b]) for b in best]
    return out


def find(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "k", 3) for i, v in rows], SCHEMA)
    got = {}
    for r in nearest(df, F.col("vec_id") % 50 == 0, id="vec_id", **kw).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    return [(i, [float(x) for x in rng.normal(size=16).astype(np.float32)]) for i in range(2000)]


def test_recall_and_exact_search(spark, rows):
    want = brute(rows)
    got = find(spark, rows)
    hit = sum(len({a for a, _ in got[q]} & {a for a, _ in w}) for q, w in want.items())
    assert hit / (5 * len(want)) >= 0.9
    whole = find(spark, rows, share=1.0)
    assert {q: [a for a, _ in v] for q, v in whole.items()} == {q: [a for a, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(whole[q], want[q], strict=True))


def test_a_vector_that_a_third_of_rows_share(spark, rows):
    hot = [(i, [1.0] * 16 if i % 3 == 0 else v) for i, v in rows[:900]]
    want, got = brute(hot), find(spark, hot, share=1.0)
    assert {q: [a for a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in want.items()}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []),
            (50, [0.0, 1e-30]), (51, [1e30, 1e30]), (None, [1.0, 1.0]), (52, [1.0, 2.0, 3.0])]
    got = find(spark, rows + [(0, [1.0, 0.0])])
    assert [a for a, _ in got[0]] == [1, 51, 50] and [a for a, _ in got[50]] == [51, 0, 1] and set(got) == {0, 50}
    assert find(spark, []) == {} and find(spark, [(0, None)]) == {} and find(spark, [(0, [1.0])]) == {}


def test_cells_come_by_rising_distance():
    rng = np.random.default_rng(1)
    a, b, count = rng.random(9), rng.random(7), rng.integers(0, 3, (9, 7))
    got = nearest_cells(a, b, count, 10**9)
    want = sorted(((a[i] + b[j], i, j) for i in range(9) for j in range(7) if count[i, j]))
    assert got == [(i, j) for _, i, j in want]
    some = nearest_cells(a, b, count, 12)
    assert sum(count[c] for c in some[:-1]) < 12 <= sum(count[c] for c in some)


def test_each_length_is_searched_among_its_own(spark, rows):
    short = [(10_000 + i, v[:8]) for i, v in rows[:300]]
    got = find(spark, rows[:400] + short, share=1.0)
    want = brute(rows[:400]) | brute(short)
    assert {q: [a for a, _ in v] for q, v in got.items()} == {q: [a for a, _ in v] for q, v in want.items()}
    assert {0, 350, 10_000, 10_250} <= set(got)


def test_only_asked_cells_are_scored():
    rng = np.random.default_rng(2)
    q, x, cell = rng.normal(size=(6, 4)), rng.normal(size=(50, 4)), np.sort(rng.integers(0, 9, 50))
    asked = rng.random((6, 9)) < 0.2
    asked[0] = False
    asked[1, 3] = True
    got = asked_scores(q, x, cell, asked)
    assert np.array_equal(got > -np.inf, asked[:, cell]) and np.allclose(got[got > -np.inf], (q @ x.T)[asked[:, cell]])
    assert asked_scores(q, x[:0], cell[:0], asked).shape == (6, 0)


def test_the_sample_is_sorted_from_few_rows(spark):
    many = spark.range(0, 40_000, 1, 8).select((F.col("id") * 7).alias("key"), F.array(F.col("id").cast("float")).alias("v"))
    few = spread_sample(many, 40_000, 500)
    want = many.orderBy(F.xxhash64("key"), "key").limit(500).select("v")
    assert [r["v"] for r in few.collect()] == [r["v"] for r in want.collect()]
    below = few._jdf.queryExecution().optimizedPlan().toString().partition("Filter")[2]
    assert "xxhash64" in below
    one_id = many.withColumn("key", F.lit(3).cast("long"))
    assert len({r["v"][0] for r in spread_sample(one_id, 40_000, 500).collect()}) == 500
    assert spread_sample(many.limit(30), 30, 500).count() == 30


def test_several_pieces_change_nothing(spark, rows, monkeypatch):
    twice = rows[:700] + [(5000 + i, v) for i, v in rows[:40]] + rows[:60]
    want = find(spark, twice)
    monkeypatch.setattr(neighbours, "PIECE_ROWS", 50)
    assert find(spark, twice) == want
    whole = find(spark, twice, share=1.0)
    assert {q: [a for a, _ in v] for q, v in whole.items()} == {q: [a for a, _ in v] for q, v in brute(twice).items()}


def test_a_query_id_with_several_vectors_is_one_query(spark):
    got = find(spark, [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (50, [1.0, 0.0])])
    assert [a for a, _ in got[50]] == [0, 1] + [0] and got[0][0][0] == 1


def test_reach_is_where_the_traversal_ends():
    rng = np.random.default_rng(4)
    for wanted in (1, 7, 60, 10**6):
        a, b, count = rng.normal(size=9), rng.normal(size=7), rng.integers(0, 3, (9, 7))
        cells = nearest_cells(a, b, count, wanted)
        limit = reach(a, b, count, min(wanted, int(count.sum())))
        assert {(i, j) for i in range(9) for j in range(7) if count[i, j] and a[i] + b[j] <= limit} == set(cells)


def test_a_piece_finds_what_brute_force_finds():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 10)).astype(np.float32)
    x[1000:1900] = x[7] * (1 + rng.random((900, 1)) * 1e-4)  # closer than short products tell apart
    books = [rng.normal(size=(4, 5)), rng.normal(size=(4, 5))]
    cell = np.sort(rng.integers(0, 16, len(x)))
    ids = rng.permutation(len(x)).astype(np.int64)

    def listed(a, width):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, width, dtype=np.int32)), pa.array(a.ravel()))

    piece = Piece([listed(x[:1700], 10), listed(x[1700:], 10)], [listed(ids, 1)], [cell], books)
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    q = np.concatenate([unit[:40], rng.normal(size=(30, 10))])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    sums = offsets(q[:, :5], books[0])[:, cell // 4] + offsets(q[:, 5:], books[1])[:, cell % 4]
    limit = np.append(np.median(sums, axis=1)[:-1], -99)
    query, entry, score = piece.best(q, limit, 6)
    assert set(query) == set(range(69))
    for r in range(69):
        scores = np.clip((q[r] * neighbours._unit(x.astype(float))).sum(1), -1, 1)
        scores[sums[r] > limit[r]] = -np.inf
        want = np.lexsort((ids, -scores))[:6]
        assert entry[query == r].tolist() == want.tolist() and np.array_equal(score[query == r], scores[want])


def test_rows_of_equal_vectors_are_merged():
    rng = np.random.default_rng(8)
    rows = [(int(i), (float(c), 0.0 if i % 2 else -0.0), int(c) // 2) for i, c in zip(rng.integers(0, 40, 600), rng.integers(0, 12, 600), strict=True)]  # two vectors a hash
    want = {}
    for i, v, _ in rows:
        want.setdefault(v, set()).add(i)
    want = {v: sorted(ids)[:3] for v, ids in want.items()}

    def batches(rows, size):
        for a in range(0, len(rows), size):
            id, v, h = zip(*rows[a:a + size], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(id, pa.int64()), pa.array(v, pa.list_(pa.float32())), pa.array(h, pa.int64())], ["id", "v", "h"])

    for size in (1, 7, 600):
        few = [r for b in fewer_rows(batches(rows, size), 3) for r in zip(*(b.column(c).to_pylist() for c in ("id", "v", "h")), strict=True)]
        assert size < 600 or len(few) < 600
        few = sorted((h, tuple(v), i) for i, v, h in few)
        found = [(tuple(v), ids) for b in merged_rows(batches([(i, v, h) for h, v, i in few], size), 3) for v, ids in zip(b.column("v").to_pylist(), b.column("ids").to_pylist(), strict=True)]
        assert len(found) == len(want) and dict(found) == want
