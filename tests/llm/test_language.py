import random

import numpy as np
import pytest

from panelflow.llm.language import Field, Words, label_languages

SOUNDS = {"en": ["the", "ing", "wh", "st", "er", "on"], "fr": ["eau", "é", "oi", "qu", "aux", "le"], "ja": ["の", "は", "か", "な", "た", "ん"]}


def text(language, seed, words=40):
    rng = random.Random(f"{language}{seed}")
    return " ".join("".join(rng.choices(SOUNDS[language], k=rng.randint(1, 3))) for _ in range(words)) + "."


@pytest.fixture(scope="module")
def rows():
    return [(k, text("en" if k % 3 == 0 else "fr" if k % 3 == 1 else "ja", k), ["en", "fr", "ja"][k % 3], "a") for k in range(240)]


def test_held_out_texts_and_switches(make, rows, odd_rows):
    from pyspark.sql import functions as F
    mixed = [(900, text("en", 1) + " " + text("fr", 2, 15), None, "a"), (901, text("ja", 5, 30) + "\n" + text("en", 7, 8), None, None)]
    odd = [(None if i is None else 1000 + i, t, None, p) for i, t, _, p in odd_rows]
    df = make(rows + mixed + odd)
    got = {r["id"]: r for r in label_languages(df, F.col("id") < 150, rows_per_language=40).collect() if r["id"] is not None}
    assert np.mean([got[k]["language"] == ["en", "fr", "ja"][k % 3] for k in range(150, 240)]) == 1
    assert got[900]["language"] == "en" and {r["language"] for r in got[900]["runs"]} == {"en", "fr"}
    spans = [(r["language"], r["words"]) for r in got[900]["runs"]]
    assert spans[0][0] == "en" and abs(spans[0][1] - 40) <= 2
    assert [got[901]["language"], sum(r["words"] for r in got[901]["runs"])] == ["ja", 38]
    for i in (1004, 1005, 1008, 1009):
        assert (got[i]["language"], got[i]["score"], got[i]["runs"]) == ("und", 0.0, [])
    assert label_languages(df, F.col("id") < 150, rows_per_language=9).count() == len(rows + mixed + odd)


def test_no_rows_and_nothing_to_learn(make, rows):
    from pyspark.sql import functions as F
    assert label_languages(make([])).collect() == []
    got = label_languages(make(rows[:4]), F.lit(False)).collect()
    assert {(r["language"], r["score"]) for r in got} == {("und", 0.0)}
    one = label_languages(make([(1, "ab cd", "en"), (2, "xyz", None)])).collect()
    assert {(r["language"], round(r["score"], 6)) for r in one} == {("en", 1.0)}


def test_marginals_against_all_paths():
    rng = np.random.default_rng(2)
    field = Field(["a", "b", "c"], np.zeros(0, np.uint64), np.zeros(0, np.int64))
    field.moves = rng.normal(size=(3, 3))
    emission, chain = rng.normal(size=(7, 3)), np.array([0, 4, 5, 7])
    got, expected = field.marginals(emission, chain)
    pairs = np.zeros((3, 3))
    for a, b in zip(chain[:-1], chain[1:], strict=True):
        total, want = 0.0, np.zeros((b - a, 3))
        moves = np.zeros((3, 3))
        for path in np.ndindex(*[3] * (b - a)):
            w = np.exp(sum(emission[a + t, y] for t, y in enumerate(path)) + sum(field.moves[x, y] for x, y in zip(path, path[1:], strict=False)))
            total += w
            for t, y in enumerate(path):
                want[t, y] += w
            for x, y in zip(path, path[1:], strict=False):
                moves[x, y] += w
        assert np.allclose(got[a:b], want / total)
        pairs += moves / total
    assert np.allclose(expected, pairs)


def test_words_and_chains():
    raw = "Le «chat» dort… 12 — ok! Oui. ???".encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    found = [words.bytes[a:b].tobytes().decode() for a, b in zip(words.at[:-1], words.at[1:], strict=True)]
    assert found == ["le", "chat", "dort", "ok", "oui"] and words.chain.tolist() == [0, 4, 5]
    assert words.number.tolist() == [0, 1, 2, 5, 6]
