import numpy as np
from sample_texts import prose

from panelflow.llm.fingerprint import add, edited_fingerprints, likeness, multiset_fingerprints, take, vectors, with_next


def vector(text):
    raw = text.encode()
    return vectors(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))


def test_order_insertion_and_deletion():
    a, b, c = prose(1, 20), prose(2, 30), prose(3, 1)
    assert (vector(f"{a}\n{b}\n{c}") == vector(f"{c}\n\n{a}\r\n{b}")).all()
    assert (add(vector(f"{a}\n{b}"), vector(c)) == vector(f"{a}\n{c}\n{b}")).all()
    assert (take(vector(f"{a}\n{b}\n{b}"), vector(b)) == vector(f"{b}\n{a}")).all()
    assert not (vector(f"{a}\n{b}\n{b}") == vector(f"{a}\n{b}")).all()
    assert not (vector("ab") == vector("ba")).all() and not vector("").any()


def test_likeness_follows_shared_pairs():
    base = prose(7, 400).split()
    for share in (0.0, 0.25, 0.5, 0.75, 1.0):
        n = int(400 * share)
        other = base[:n] + prose(8, 400).split()[n:]
        got = float(likeness(vector(" ".join(base)), vector(" ".join(other)))[0])
        assert abs(got - share) < 0.2
    assert likeness(vector(""), vector(""))[0] == 1 and likeness(vector(""), vector("a b"))[0] == 0


def test_edited_texts_against_brute_force(make, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    got = {}
    for r in edited_fingerprints(make(rows)).collect():
        got.setdefault(r["id"], []).append(r)
    ordered = sorted(rows, key=lambda r: r[0])
    for k, (i, t, *_) in enumerate(ordered):
        t, after = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        want = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        found = [r for r in got[i] if r["edited_text"] == want]
        assert found and all(r["n_chars"] == len(t) for r in found)
        assert bytes(found[0]["fingerprint"]) == vector(t).astype("<u2").tobytes()
        assert bytes(found[0]["edited_fingerprint"]) == vector(want).astype("<u2").tobytes()
        assert abs(found[0]["near_next"] - likeness(vector(t), vector(after))[0]) < 1e-9
    assert sum(map(len, got.values())) == len(rows)


def test_next_rows_over_many_ranges(spark):
    df = spark.createDataFrame([(i * 7 % 1009, str(i * 7 % 1009)) for i in range(1009)], "id long, t string")
    for parts in (1, 2, 50):
        got = {r["id"]: r["next_t"] for r in with_next(df, "id", ["t"], parts).collect()}
        assert got == {i: str((i + 1) % 1009) for i in range(1009)}


def test_null_ids_and_no_rows(make):
    got = edited_fingerprints(make([(None, "abcd"), (None, "wxyz"), (1, "12345")])).collect()
    assert len(got) == 3 and {r["edited_text"][-2:] for r in got} <= {"ab", "wx", "12"}
    assert edited_fingerprints(make([])).collect() == [] and multiset_fingerprints(make([])).collect() == []
    assert edited_fingerprints(make([(5, "abcde")])).first()["edited_text"] == "abcab"


def test_lanes_of_very_long_texts_do_not_wrap():
    whole, half = vector("word " * 50_000), vector("word " * 25_000)
    assert abs(likeness(whole, half)[0] - 0.8) < 1e-3
    line = "word " * 25_000
    assert (add(half, half) == vector(f"{line}\n{line}")).all() and (take(add(half, whole), whole) == half).all()
    assert abs(likeness(add(half, half), half)[0] - 0.8) < 1e-3


def test_ids_of_the_library_are_texts(spark):
    rows = [(f"seg-{i:06d}", prose(i % 17, 12)) for i in range(0, 3000, 7)] + [("seg", "short"), ("seg-9é", "last"), (None, "none")]
    df = spark.createDataFrame(rows, "id string, original_text string")
    ordered = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode()))
    for parts in (1, 40):
        got = {r["id"]: r["next_original_text"] for r in with_next(df, "id", ["original_text"], parts).collect()}
        assert got == {i: ordered[(k + 1) % len(ordered)][1] for k, (i, _) in enumerate(ordered)}
    assert edited_fingerprints(df).count() == len(rows)
