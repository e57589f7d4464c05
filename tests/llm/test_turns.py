import hashlib
import itertools
import random
import re
import zlib

import pytest

from panelflow.llm.turns import ASSISTANT, NOTHING, damage, faults, lightest, repair_conversations

SPACE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def every_repair(rows, found):
    """All edit sequences of few rows with up to three inserted turns, by enumeration: (cost, audit, lines)."""
    def steps(i, inserts):
        if i == len(rows):
            yield 0, "", []
        else:
            role, text = rows[i]
            late = 5 if found[i] == "t" else 0
            for cost, audit, lines in steps(i + 1, inserts):
                yield cost + 2, "D" + audit, lines
                if found[i] not in ("b", "d"):
                    yield cost + late, "K" + audit, [(role, text), *lines]
                    for name in ("user", "assistant"):
                        yield cost + 1 + late, "R" + audit, [(name, text), *lines]
        if inserts:
            for cost, audit, lines in steps(i, inserts - 1):
                for name in ("user", "assistant"):
                    yield cost + 5, "I" + audit, [(name, ""), *lines]
    return [(c, a, l) for c, a, l in steps(0, 2) if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in l))]


def brute_faults(rows):
    seen, out = set(), []
    for r in rows:
        shown = r[1].strip(SPACE)
        out.append("b" if not shown else "d" if r in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add(r)
    return out


def stepwise(rows, found):
    """The same by a plain table over rows and states, for longer conversations."""
    def relax(table):
        for q in (0, 1, 3, 2, 0, 1, 3, 2):
            if q in table:
                c, a = table[q]
                then = 3 if q == 2 else 2
                table[then] = min(table.get(then, (10**9, "")), (c + 5, a + "I"))
        return table
    table = relax({0: (0, "")})
    for (role, _), fault in zip(rows, found, strict=True):
        new = {}
        for q, (c, a) in table.items():
            asked, late = (3 if q == 2 else 2), 5 if fault == "t" else 0
            moves = [(q, c + 2, a + "D")]
            if fault not in ("b", "d"):
                moves.append((asked, c + 1 + late, a + "R"))
                if role[:1] == ("a" if asked == 3 else "u"):
                    moves.append((asked, c + late, a + "K"))
                if role[:1] == "s" and q == 0:
                    moves.append((1, c + late, a + "K"))
            for then, cost, audit in moves:
                new[then] = min(new.get(then, (10**9, "")), (cost, audit))
        table = relax(new)
    return min(table[q] for q in (0, 3) if q in table)


def brute(rows, originals):
    convs = {}
    for c, *r in rows:
        convs.setdefault(c, []).append(tuple(r))
    out = []
    for c in originals:
        mine = sorted(convs.get(c, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in mine if r[0] is not None]
        said = [r[1:] for r in mine]
        found = brute_faults(said)
        cost, audit = stepwise(said, found)
        lines, at, last = [], iter(said), ""
        for letter in audit:
            role, text = next(at) if letter != "I" else ("", "")
            if letter != "D":
                role = role if letter == "K" else "assistant" if last == "u" else "user"
                last = role[:1]
                lines.append(f"{role}:{text}")
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, found.count("b"), found.count("d"), found.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(count, seed=1):
    draw, rows = random.Random(seed), []
    for c in range(count):
        for turn in range(draw.choice([1, 2, 3, 5, 8, 40] if c else [700])):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice(["Hi there.", "Hi there.", "What?", "no end", "", None, " \n", "Ünï. ", f"Turn {draw.randrange(9)}!"])
            rows.append((c if c != 3 else None, None if turn == 0 and c % 4 == 1 else turn * draw.choice([1, 1, 1, 2]), role, text))
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, n int, key string, chunk int"


@pytest.mark.parametrize("chunk_turns,chunk_bytes", [(256, 1 << 22), (3, 1 << 22), (64, 20)])
def test_repairs_against_a_plain_table(spark, chunk_turns, chunk_bytes):
    lost = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows = [*conversations(40), (lost, 1, "user", "All of it is dropped.")]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    got = repair_conversations(damage(df), originals=df, chunk_turns=chunk_turns, chunk_bytes=chunk_bytes)
    want = brute(damaged(rows), {r[0] for r in rows})
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(w[7] == "" for w in want) >= 1 and any("R" in w[7] for w in want) and any("D" in w[7] for w in want)


def test_lightest_against_all_repairs():
    draw = random.Random(4)
    roles, texts = ["user", "assistant", "system", "x"], ["A.", "B.", "c", ""]
    for size in (0, 1, 2, 3, 4):
        for rows in itertools.islice(iter(lambda: [(draw.choice(roles), draw.choice(texts)) for _ in range(size)], None), 40):  # noqa: B023
            found = faults(rows, set())
            assert found == brute_faults(rows)
            cost, audit = min(lightest([r[0][:1] for r in rows], found, NOTHING, {NOTHING, ASSISTANT}).values())
            assert (cost, audit) == min(x[:2] for x in every_repair(rows, found))


def test_odd_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(damage(df), originals=df).collect() == []
    long_text = "word " * 200_000 + "."
    rows = [(1, 1, "user", long_text), (1, 2, "assistant", "ok."), (2, None, None, None), (2, None, None, None)]
    df = spark.createDataFrame([(*r, 1, "k", 2) for r in rows], SCHEMA)
    got = repair_conversations(df).collect()
    shown = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert sorted(map(tuple, got)) == brute(shown, {1, 2})
