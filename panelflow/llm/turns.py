"""Repair of the turn structure of conversations as a lightest derivation, found by Knuth's agenda."""

from __future__ import annotations

import hashlib
import heapq
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.operators.skew import running, sized_broadcast
from panelflow.session import cut

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
CHUNK_TURNS = 256
CHUNK_BYTES = 1 << 22
SPACE = " \t\n\v\f\r"
# What a repaired conversation has so far: nothing, a system turn, a user turn last, an assistant turn last.
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
_ASKS = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_STATS = "turns array<long>, distinct long, blank long, duplicate long, truncated long, illegal long, initials array<string>"


def damage(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults of known kinds, one turn in five: (conversation, turn, role, text).

    The remainder by 20 of the CRC-32 of ``conversation:turn`` drops a turn (0), empties its text (1), removes its full
    stops, exclamation and question marks (2), repeats it (3) or makes it a user's (4). Null fields read as one blank.
    """
    name = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in (conversation, None, turn)])
    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"),
                        F.coalesce(text, F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("fault")).filter("fault <> 0")
    changed = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return rows.select(F.col("conv").alias(conversation), F.col("turn").alias(turn),
                       F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias(role), changed.alias(text),
                       copies.alias("__copy")).drop("__copy")


def faults(rows: list[tuple[str, str]], seen: set) -> list[str]:
    """First fault of every (role, text): b(lank), d(uplicate), t(runcated) or none; ``seen`` grows."""
    out = []
    for row in rows:
        shown = row[1].rstrip(SPACE)
        fault = "" if shown.lstrip(SPACE) else "b"
        fault = fault or ("d" if _digest(row) in seen else "" if shown[-1] in ".!?" else "t")
        seen.add(_digest(row))
        out.append(fault)
    return out


def _digest(row: tuple[str, str]) -> bytes:
    role, text = row[0].encode(), row[1].encode()
    return hashlib.sha256(b"%d:%b%b" % (len(role), role, text)).digest()


def lightest(initials: list[str], found: list[str], entry: int, goals: set[int]) -> dict[int, tuple[int, str]]:
    """The lightest (cost, audit) of turning all rows into a legal stretch that starts in state ``entry``, for each goal state
    that can be reached.

    An item (i, state) says that the first i rows are dealt with and what stands last. Its deductions append one edit:
    the weight (cost, audit) grows by the edit's cost and initial, so no deduction gives less than it takes, and a lesser
    antecedent never gives more. Hence an item popped from the agenda, least weight first, is final.
    """
    final, agenda, left = {}, [(0, "", 0, entry)], set(goals)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    n = len(initials)
    while left and agenda:
        cost, audit, i, state = heapq.heappop(agenda)
        if (i, state) in final:
            continue
        final[i, state] = cost, audit
        if i == n:
            left.discard(state)
        asked = _ASKS[state]
        edits = [(INSERT, "I", i, asked)]
        if i < n:
            edits.append((DELETE, "D", i + 1, state))
            if found[i] not in ("b", "d"):
                late = TRUNCATED if found[i] == "t" else 0
                kept = SYSTEM if initials[i] == "s" and state == NOTHING else asked if initials[i] == _NAMES[asked][0] else None
                if kept is not None:
                    edits.append((KEEP + late, "K", i + 1, kept))
                edits.append((REROLE + late, "R", i + 1, asked))
        for more, letter, j, then in edits:
            weight = (cost + more, audit + letter)
            if (j, then) not in final and ((j, then) not in best or weight < best[j, then]):
                best[j, then] = weight
                heapq.heappush(agenda, (*weight, j, then))
    return {g: final[n, g] for g in sorted(goals) if (n, g) in final}


def repaired(rows: list[tuple[str, str]], audit: str, state: int) -> list[str]:
    """Lines ``role:text`` that the edits make of the rows, from the state before them."""
    out, at = [], iter(rows)
    for letter in audit:
        role, text = next(at) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter != "K":
            role = _NAMES[_ASKS[state]]
        state = _ASKS[state] if letter != "K" or role[:1] != "s" else SYSTEM
        out.append(f"{role}:{text}")
    return out


def _stats(turns: list, initials: list[str], found: list[str]) -> tuple:
    known = [t for t in turns if t is not None]
    return (known[:1] + known[-1:], len(set(known)), found.count("b"), found.count("d"), found.count("t"),
            sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:], strict=False)), initials[:1] + initials[-1:])


def _gaps(turns: list[int], distinct: int) -> int:
    return turns[-1] - turns[0] + 1 - distinct if turns else 0


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list, list[tuple[str, str]], list[str]]]:
    """Place, turns, (role, text) and role initials of every row of a batch of chunks."""
    for k, rows in enumerate(batch.column("rows")):
        rows = [(r["turn"], r["role"], r["text"]) for r in rows.as_py()]
        yield k, [r[0] for r in rows], [r[1:] for r in rows], [r[1][:1] for r in rows]


def _whole(chunks: DataFrame, kind: str) -> DataFrame:
    """Results of conversations of one chunk."""
    def run(batches):
        for batch in batches:
            out = []
            for _, turns, rows, initials in _chunks(batch):
                found = faults(rows, set())
                known, distinct, blank, twice, late, illegal, _ = _stats(turns, initials, found)
                cost, audit = min(lightest(initials, found, NOTHING, {NOTHING, ASSISTANT}).values())
                text = "\n".join(repaired(rows, audit, NOTHING))
                out.append((_gaps(known, distinct), blank, twice, late, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
            columns = list(zip(*out, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *[pa.array(c, pa.int64()) for c in columns[:6]], *[pa.array(c, pa.string()) for c in columns[6:]]],
                                             ["conv", *[f.split()[0] for f in _RESULT.split(", ")]])

    return chunks.select("conv", "rows").mapInArrow(run, f"conv {kind}, {_RESULT}")


def _digests(chunks: DataFrame) -> DataFrame:
    """Distinct turns of each chunk: (key, chunk, digest)."""
    def run(batches):
        for batch in batches:
            out = [[], [], []]
            for k, _, rows, _ in _chunks(batch):
                mine = {_digest(r) for r in rows}
                for name, values in zip(out, ([batch.column("key")[k].as_py()] * len(mine), [batch.column("chunk")[k].as_py()] * len(mine), mine), strict=True):
                    name.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], ["key", "chunk", "digest"])

    return chunks.select("key", "chunk", "rows").mapInArrow(run, "key string, chunk long, digest binary")


def _tables(chunks: DataFrame, kind: str) -> DataFrame:
    """For every chunk of (conv, key, chunk, rows, seen) its counts and the lightest way from each state to each."""
    ways = "array<struct<entry: int, exit: int, cost: long, audit: string>>"

    def run(batches):
        for batch in batches:
            stats, tables = [], []
            for k, turns, rows, initials in _chunks(batch):
                found = faults(rows, set(batch.column("seen")[k].as_py() or ()))
                stats.append(_stats(turns, initials, found))
                tables.append([{"entry": e, "exit": g, "cost": c, "audit": a} for e in ([NOTHING] if batch.column("chunk")[k].as_py() == 0 else STATES)
                               for g, (c, a) in lightest(initials, found, e, set(STATES) if e == NOTHING else {SYSTEM, USER, ASSISTANT} if e == SYSTEM else {USER, ASSISTANT}).items()])
            columns = list(zip(*stats, strict=True)) or [()] * 7
            kinds = [pa.list_(pa.int64()), *[pa.int64()] * 5, pa.list_(pa.string())]
            way = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv", "key", "chunk")), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], pa.array(tables, way)],
                ["conv", "key", "chunk", *[f.split()[0] for f in _STATS.split(", ")], "ways"])

    return chunks.select("conv", "key", "chunk", "rows", "seen").mapInArrow(run, f"conv {kind}, key string, chunk long, {_STATS}, ways {ways}")


class _Chain:
    """Lightest ways through a conversation's chunks, for each state at their end. What all ways share is settled."""

    def __init__(self):
        self.settled, self.live, self.turns, self.last = [], {NOTHING: (0, "", None)}, [], ""
        self.distinct = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, row: dict) -> None:
        if row["turns"]:
            self.distinct += row["distinct"] - (self.turns[-1:] == row["turns"][:1])
            self.turns = (self.turns or row["turns"])[:1] + row["turns"][-1:]
        self.illegal += row["illegal"] + (row["chunk"] > 0 and self.last + row["initials"][0] not in _LEGAL)
        self.last = row["initials"][-1]
        self.blank, self.duplicate, self.truncated = self.blank + row["blank"], self.duplicate + row["duplicate"], self.truncated + row["truncated"]
        after: dict[int, tuple] = {}
        for way in row["ways"]:
            if way["entry"] in self.live:
                cost, audit, past = self.live[way["entry"]]
                now = (cost + way["cost"], audit + way["audit"])
                if way["exit"] not in after or now < after[way["exit"]][:2]:
                    after[way["exit"]] = (*now, (past, (row["chunk"], way["entry"], way["audit"])))
        shared = os.path.commonprefix([w[1] for w in after.values()])
        self.settled.append(shared)
        self.live = {s: (c, a[len(shared):], p) for s, (c, a, p) in after.items()}

    def end(self) -> tuple[tuple, list[tuple[int, int, str]]]:
        cost, audit, past = min((self.live[g] for g in (NOTHING, ASSISTANT) if g in self.live), key=lambda w: w[:2])
        steps = []
        while past:
            past, step = past
            steps.append(step)
        return (_gaps(self.turns, self.distinct), self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.settled) + audit), steps


def _chained(tables: DataFrame, kind: str) -> DataFrame:
    """Chunks in order to a row for each conversation (chunk -1) and the way taken through each of its chunks."""
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def run(batches):
        def told(key, conv, chain):
            result, steps = chain.end()
            out = [(conv, key, -1, None, *result), *[(conv, key, c, e, *[None] * 6, a) for c, e, a in steps]]
            columns = list(zip(*out, strict=True))
            kinds = [conv_kind, pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv", "key", "chunk", "entry", *names])

        key, conv, chain, conv_kind = None, None, None, None
        for batch in batches:
            conv_kind = batch.schema.field("conv").type
            for row in batch.to_pylist():
                if row["key"] != key:
                    if chain:
                        yield told(key, conv, chain)
                    key, conv, chain = row["key"], row["conv"], _Chain()
                chain.add(row)
        if chain:
            yield told(key, conv, chain)

    ordered = tables.repartition("key").sortWithinPartitions("key", "chunk")
    return ordered.mapInArrow(run, f"conv {kind}, key string, chunk long, entry int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def _hashed(chunks: DataFrame) -> DataFrame:
    """SHA-256 of the repaired text of each key, from its chunks (key, chunk, rows, entry, audit) in order: bounded memory."""
    def lines(batches):
        for batch in batches:
            out = []
            for k, _, rows, _ in _chunks(batch):
                made = repaired(rows, batch.column("audit")[k].as_py(), batch.column("entry")[k].as_py())
                out.append("\n".join(made) if made else None)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("chunk"), pa.array(out, pa.string())], ["key", "chunk", "lines"])

    def run(batches):
        key, held, begun = None, None, False
        for batch in batches:
            for name, text in zip(batch.column("key").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                if name != key:
                    if held:
                        yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [held.hexdigest()]})
                    key, held, begun = name, hashlib.sha256(), False
                if text is not None:
                    held.update((b"\n" if begun else b"") + text.encode())
                    begun = True
        if held:
            yield pa.RecordBatch.from_pydict({"key": [key], "repaired_sha256": [held.hexdigest()]})

    made = chunks.select("key", "chunk", "rows", "entry", "audit").mapInArrow(lines, "key string, chunk long, lines string")
    return made.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(run, "key string, repaired_sha256 string")


def repair_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         originals: DataFrame | None = None, chunk_turns: int = CHUNK_TURNS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Faults of every conversation and its cheapest repair: (conversation, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256).

    The library's records have no chat turns; this operator takes any table of them. Turns are taken by turn number,
    null first, then role and text. A turn's first fault counts: blank (white space only), duplicate (role and text stood
    earlier), truncated (its last visible character is none of ``.!?``). illegal counts neighbours whose role initials
    are not su, ua or au; gaps are turn numbers missing between the first and the last.

    A repair keeps (0), reroles to user or assistant (1), deletes (2, a must for blank and duplicate turns) or inserts
    empty turns (5); a truncated turn that stays adds 5. The initials of the edits in order are the audit. Of all repairs
    whose roles read ``(s?(ua)+)?`` the one of least (cost, audit) is found as a lightest derivation: see ``lightest``.

    A conversation of up to ``chunk_turns`` turns and about ``chunk_bytes`` is one derivation. A longer one is cut into such
    chunks, each derived from every state to every state; the chunks' derivations are then chained in order, with the
    same weights, and its text is hashed chunk by chunk. So a conversation that holds a large part of all turns is never
    in one task's memory but for its audit, which is one value of the result.

    ``originals`` names the conversations to report (their column ``conversation``); those without turns get zeros, an empty
    audit and the hash of nothing. A null conversation is one of its own; null roles and texts read as one blank;
    repeated rows are turns of their own; other columns are ignored; no rows give no rows.
    """
    kind = turns.schema[conversation].dataType.simpleString()
    key = F.to_json(F.struct(F.col(conversation).alias("c")))
    rows = turns.select(F.col(conversation).alias("conv"), key.alias("key"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = running(rows, ["key"], order, {"n": F.lit(1).cast("long"), "bytes": (F.octet_length("text") + F.octet_length("role")).cast("long")})
    chunk = F.floor((F.col("n") - 1) / chunk_turns) + F.floor((F.col("bytes") - F.octet_length("text") - F.octet_length("role")) / chunk_bytes)
    chunks = placed.groupBy("key", chunk.alias("chunk")).agg(
        F.first("conv").alias("conv"), F.array_sort(F.collect_list(F.struct("n", "turn", "role", "text"))).alias("rows"))
    chunks = cut(chunks)
    long = cut(chunks.filter("chunk > 0").select("key").distinct())
    few = sized_broadcast(long)
    done = _whole(chunks.join(few, "key", "left_anti"), kind)
    if not long.isEmpty():
        several = cut(chunks.join(few, "key", "left_semi"))
        own = _digests(several)
        first = own.groupBy("key", "digest").agg(F.min("chunk").alias("first"))
        seen = own.join(first, ["key", "digest"]).filter("chunk > first").groupBy("key", "chunk").agg(F.collect_list("digest").alias("seen"))
        chained = cut(_chained(_tables(several.join(seen, ["key", "chunk"], "left"), kind), kind))
        ways = chained.filter("chunk >= 0").select("key", "chunk", "entry", "audit")
        hashed = _hashed(several.join(ways, ["key", "chunk"]))
        done = done.unionByName(chained.filter("chunk < 0").drop("chunk", "entry").join(hashed, "key").drop("key"))
    done = done.withColumnRenamed("conv", conversation)
    if originals is None:
        return done
    named = originals.select(F.col(conversation).alias("conv")).distinct()
    all_of = named.join(done, named["conv"].eqNullSafe(done[conversation]), "left")
    zeros = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return all_of.select(F.col("conv").alias(conversation), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in zeros],
                         F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
