import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from panelflow.llm.packing import combinations, nnls, pack_segments, plan_sequences

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(make, rows, window=64, grain=8):
    pieces = pack_segments(make(rows), PATH, window=window, grain=grain).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((str(r[0]), tuple([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2])) for r in rows)
    by_sequence, ids = {}, {}
    for p in pieces:
        values = np.frombuffer(bytes(p["token_ids"]), "<u4")
        assert len(values) == p["length"] > 0
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        ids.setdefault((str(p["id"]), p["doc_tokens"]), []).append((p["start"], tuple(values.tolist())))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    got = []
    for (i, n), parts in ids.items():
        copies = sum(start == 0 for start, _ in parts)
        text, at = [], 0
        for start, values in sorted(set(parts)):
            assert start == at
            text += values
            at += len(values)
        assert at == n and len(parts) == copies * len(set(parts))
        got += [(i, tuple(text))] * copies
    assert sorted(got) == want


def test_odd_rows(make, odd_rows):
    # Texts of one id and length are told apart by their ids only where they are equal.
    check(make, [r for r in odd_rows if r[0] is not None])


def test_null_ids_and_no_rows(make):
    check(make, [(None, "Hello, World! <|endoftext|> it's 12"), (1, "<|ENDOFTEXT|> Don't. Stop…, ok?")])
    assert pack_segments(make([]), PATH).collect() == []


def test_plan_uses_every_piece_and_wastes_little():
    rng = np.random.default_rng(1)
    counts = np.zeros(128, int)
    # Short bodies outnumber long ones, as in texts; a surplus of long bodies would have nothing to fill up with.
    counts[1:64] = rng.poisson(3000 * 0.96 ** np.arange(63))
    counts[65:] = rng.integers(0, 3000, 63)
    plan = plan_sequences(counts)
    used, tokens = np.zeros(128, int), 0
    for need, n in plan:
        filled = sum(m * (q * 64 if q < 64 else q - 64) for q, m in need.items())
        assert 0 < filled <= 4096
        tokens += n * filled
        for q, m in need.items():
            used[q] += n * m
    assert (used == counts).all()
    assert tokens / (4096 * sum(n for _, n in plan)) > 0.99


@pytest.mark.parametrize("counts", [{}, {32: 5}, {63: 4, 127: 1}, {47: 1000}])
def test_plan_of_narrow_histograms(counts):
    full = np.zeros(128, int)
    for q, n in counts.items():
        full[q] = n
    used = np.zeros(128, int)
    for need, n in plan_sequences(full):
        for q, m in need.items():
            used[q] += n * m
    assert (used == full).all()


def test_non_negative_least_squares():
    a = np.array([[1.0, 0, 1], [0, 1, 1], [1, 1, 0]])
    x = nnls(a, np.array([3.0, 4.0, 1.0]))
    assert (x >= 0).all() and np.allclose(a @ x, [3, 4, 1])
    assert np.allclose(nnls(np.eye(2), np.array([-1.0, 2.0])), [0, 2])
    assert all(sum(c) == 8 and len(c) <= 3 for c in combinations(8, 3))
