import numpy as np
import pytest
from sample_texts import prose

from panelflow.llm.toxicity import Units, fit, kernel, rate_toxicity

INSULTS = ["zorgwix", "pluffnak", "grimbolt"]


def with_insult(k, insult):
    words = prose(k, 50).split()
    words.insert(k % 40, insult)
    return " ".join(words[:25]) + ". " + " ".join(words[25:])


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, with_insult(k, INSULTS[k % 3]) if k % 4 == 0 else prose(k, 50), "en", "a") for k in range(400)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(300)], "id long, quality int, toxic int")
    return rows, labels


@pytest.fixture(scope="module")
def rated(make, labelled, odd_rows):
    rows, labels = labelled
    disguised = ["z o r g w i x", "z.o.r.g.w.i.x", "z0rgw1x", "Zorrgwix,", "plufffnak", "PLUFF-NAK!", "grimxbolt", "gri*mbolt"]
    clean = ["grim bolt was ten", "z o", "prose of a kind", "pl uf n"]
    more = [(1000 + k, prose(k, 9) + " " + t + " " + prose(k + 50, 9)) for k, t in enumerate(disguised)]
    fine = [(2000 + k, t) for k, t in enumerate(clean)]
    odd = [(None if i is None else 3000 + i, *r) for i, *r in odd_rows]
    return rate_toxicity(make(rows + more + fine + odd), labels, text="original_text").collect(), len(rows + more + fine + odd)


def test_held_out_and_disguised_insults(rated):
    got, n = rated
    assert len(got) == n
    by = {r["id"]: r["predicted"] for r in got}
    assert np.mean([by[k] == int(k % 4 == 0) for k in range(300, 400)]) == 1
    assert [by[1000 + k] for k in range(8)] == [1] * 8
    assert [by[2000 + k] for k in range(4)] == [0] * 4
    assert not any(p for i, p in by.items() if i is not None and i >= 3000)


def test_without_evidence_or_rows(make, labelled, spark):
    rows, labels = labelled
    assert rate_toxicity(make([]), labels, text="original_text").collect() == []
    got = rate_toxicity(make(rows[:8]), labels.limit(0), text="original_text").collect()
    assert {r["predicted"] for r in got} == {0}
    nulls = spark.createDataFrame([(None, 1, 1), (1, 1, None)], labels.schema)
    assert {r["predicted"] for r in rate_toxicity(make(rows[:8]), nulls, text="original_text").collect()} == {0}


def test_kernel_is_the_sum_over_common_subsequences():
    raw = b"idiot idxiot unlike"
    units = Units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    letters, at = units.pick(np.arange(3))
    from panelflow.llm.toxicity import _profiles
    profiles = _profiles(letters, at)
    k = kernel(letters, at, profiles)
    assert np.allclose(k, k.T, atol=1e-5) and (np.diag(k) > 1 - 1e-6).all()
    assert k[0, 1] > 0.2 > k[0, 2]
    assert np.allclose(k, (profiles @ profiles.T) ** 2, atol=1e-5)


def test_machine_separates_its_examples():
    model = fit(INSULTS, prose(1, 300).split())
    raw = " ".join(INSULTS + prose(9, 100).split()).encode()
    margin = model.margins(Units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    assert (margin[:3] > 0.5).all() and (margin[3:] < 0.5).all()
