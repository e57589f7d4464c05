import numpy as np
import pytest
from pyspark.sql import functions as F

from panelflow.llm.negatives import Block, best_in_windows, mine_negatives, summaries

SCHEMA = "vec_id long, embedding array<float>, label int, key string, v long, id string"


def brute(rows):
    """rows: (id, vector, label), ids unique."""
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], c) for i, v, c in rows
          if i is not None and v is not None and c is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v, c in ok:
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, w, d in ok if j != i and len(w) == len(v))
        for s, p, d in [x for x in scored if x[2] == c][:5]:
            fits = [x for x in scored if x[2] != c and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(i, p, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, c, "k", 3, "x") for i, v, c in rows], SCHEMA)
    got = mine_negatives(df, F.col("vec_id") % 100 == 0, id="vec_id", **kw)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 12))
    found = [(i, [float(x) for x in (centres[i * 7 % 4] * 0.4 + rng.normal(size=12)).astype(np.float32)], int(i * 7 % 4) if i % 11 else 2) for i in range(800)]
    found += [(900 + k, found[k][1], k % 4) for k in range(40)]  # ties
    found += [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan")] * 12, 1), (1003, [float("inf")] * 12, 2), (1004, [1.0] * 12, None),
              (None, [1.0] * 12, 1), (1100, [1.0, 2.0], 1), (1101, [1.0, 1.0], 1), (1102, [0.5, 0.5], 2), (1103, [0.4, 0.9], 3), (1200, [], 1), (1201, [], 1),
              (1202, [], 2), (1300, [0.0] * 12, 1)]
    return found


def test_against_brute_force(spark, rows):
    want = brute(rows)
    assert len(want) > 300 and {1100, 1200} <= {w[0] for w in want}
    assert mined(spark, rows) == want


def test_small_blocks_change_nothing(spark, rows):
    assert mined(spark, rows, row_block=70, anchor_block=3) == brute(rows)


def test_repeated_rows_and_huge_components(spark):
    base = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2)]
    assert mined(spark, base + base) == brute(base)
    huge = [(0, [3e38, 3e38], 1), (1, [3e38, 3e38], 1), (2, [3e38, -1e38], 2), (3, [1e38, 0.0], 3)]
    assert all(-2**63 < r[4] < 2**63 for r in mined(spark, huge))


def test_no_rows(spark):
    assert mined(spark, []) == []


def test_summaries_bound_inner_products_and_prune():
    rng = np.random.default_rng(7)
    x = (rng.normal(size=(400, 24)) * 100 + rng.normal(size=(400, 1)) * 300).astype(np.int64)
    product = x @ x.T
    for segments in (1, 4, 16):
        mean, spread = summaries(x.astype(float), segments)
        middle, reach = mean @ mean.T, spread @ spread.T
        assert (np.abs(product - middle) <= reach + 1e-6 * np.abs(product) + 1).all()
    block, asked = Block(x), Block(x[:1])
    scored = []
    exact = block.scores
    block.scores = lambda other, one, rows: scored.append(len(rows)) or exact(other, one, rows)
    (found, score), = best_in_windows(block, asked, 0, np.arange(400), np.arange(400), [(-2**62, 2**62)], 5)
    assert score.tolist() == sorted(product[0].tolist(), reverse=True)[:5] and scored[0] < 100


def test_whole_number_scores_beyond_doubles():
    a, b = (1 << 27) + 1, 1 << 27
    x = np.array([[a, 3], [b, 5]])
    assert Block(x).scores(Block(x[:1]), 0, np.array([0, 1])).tolist() == [a * a + 9, a * b + 15]
