
import numpy as np
import pytest
from sample_texts import prose

from panelflow.llm.quality import FEATURES, _features, fit_ranking, keep_good, rank_quality


def junk(k):
    words = prose(k, 40).split()
    return (" | ".join(words), " ".join(w + "###" for w in words), " ".join(w.upper() + "!!" for w in words),
            " ".join(w for w in words[:5] for _ in range(9)))[k % 4]


@pytest.fixture(scope="module")
def labelled(make, spark):
    rows = [(k, junk(k) if k % 5 == 0 else prose(k, 30 + k % 50), "en", "a") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(300)], "id long, quality int, toxic int")
    return rows, labels


def test_unlabelled_rows_are_ranked(make, labelled):
    rows, labels = labelled
    got = {r["id"]: r for r in rank_quality(make(rows), labels).collect()}
    assert len(got) == 400
    right = [got[k]["predicted"] == int(k % 5 != 0) for k in range(300, 400)]
    assert np.mean(right) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_odd_rows_and_labels(make, spark, labelled, odd_rows):
    rows, labels = labelled
    extra = spark.createDataFrame([(None, 1, 0), (3, None, 0), (0, 1, 0), (0, 0, 1)], labels.schema)
    df = make(rows + odd_rows)
    got = rank_quality(df, labels.unionByName(extra)).collect()
    assert len(got) == len(rows) + len(odd_rows) and all(r["score"] is not None for r in got)
    kept = keep_good(df, labels)
    assert kept.columns == df.columns and kept.filter("key = 'k'").count() == sum(r["predicted"] for r in rank_quality(df, labels).collect())


def test_without_labels_or_rows(make, labelled):
    rows, labels = labelled
    assert rank_quality(make([]), labels).collect() == []
    got = rank_quality(make(rows[:9]), labels.limit(0)).collect()
    assert len({r["score"] for r in got}) == 1
    got = rank_quality(make(rows[:9]), labels.filter("quality = 1")).collect()
    assert {r["predicted"] for r in got} == {1}


def test_weights_follow_preferences():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 3))
    better = x @ [2.0, -1.0, 0.0] > -1
    model = fit_ranking(x, better)
    s = np.clip((x - model["mean"]) / model["scale"], -20, 20) @ model["w"]
    assert ((s >= model["cut"]) == better).mean() > 0.95


def test_features_of_texts_do_not_mix():
    texts = [t.encode() for t in ("ab ab", "AB!! | %%", "", "x")]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    whole = _features(np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert whole.shape == (4, len(FEATURES))
    for k, t in enumerate(texts):
        alone = _features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.allclose(alone[0], whole[k])
    assert not whole[2, :9].any()
