"""Homomorphic multiset fingerprints of texts: sums of wide vectors hashed from paragraphs."""

from __future__ import annotations

import os.path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelflow.llm.buffers import bit_counts, text_slices, words_of

HASH_LANES = 32
LIKENESS_LANES = 128
# 16-bit numbers; a likeness lane takes two, low half first. Hash lanes are added modulo 2**16, likeness lanes modulo 2**32.
LANES = HASH_LANES + 2 * LIKENESS_LANES
PARTS = 256
ROWS_PER_PART = 20_000
MOST_PARTS = 20_000
_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _lanes(seeds: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` 16-bit numbers drawn from each 64-bit seed."""
    k = np.arange(1, lanes // 4 + 1, dtype=np.uint64)
    x = seeds[:, None] + k * _MIX[0]
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mul)
    return (x ^ (x >> np.uint64(31))).view(np.uint16)


class _Paragraphs(NamedTuple):
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def _paragraphs(data: np.ndarray, offsets: np.ndarray) -> _Paragraphs:
    """Non-empty lines of every row."""
    inside = ~_LINE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    begin = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return _Paragraphs(begin, end, np.searchsorted(begin, offsets))


def vectors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One vector of LANES 16-bit numbers per row: the sum over the row's paragraphs (``add``).

    A paragraph's vector has HASH_LANES numbers hashed from all its bytes, and LIKENESS_LANES 32-bit sums of +1 or -1
    over its neighbouring word pairs, whose differences tell how many pairs two texts do not share.
    """
    out = np.zeros((len(offsets) - 1, LANES), np.uint16)
    if not len(data):
        return out
    p = _paragraphs(data, offsets)
    raw, digest = data.tobytes(), xxhash.xxh64_digest
    seeds = np.frombuffer(b"".join([digest(raw[a:b], 1) for a, b in zip(p.begin.tolist(), p.end.tolist(), strict=True)]), ">u8")
    row_of = np.repeat(np.arange(len(out)), np.diff(p.first))
    full = np.flatnonzero(np.diff(p.first))
    if len(full):
        out[full, :HASH_LANES] = np.add.reduceat(_lanes(seeds.astype(np.uint64), HASH_LANES), p.first[:-1][full], axis=0, dtype=np.uint16)
    # Words as hashes of their bytes and places, then pairs of neighbours within a paragraph.
    cuts = np.union1d(offsets, np.concatenate((p.begin, p.end)))
    begin, end, _ = words_of(data, cuts)
    if not len(begin):
        return out
    low = np.arange(len(data)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(data)]))))[np.maximum(np.arange(len(data)) - begin[0], 0)]
    place = (np.clip(low, 0, None).astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX[1]
    mixed = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0] ^ place
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[1]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    word = total[end] - total[begin]
    owner = np.searchsorted(p.begin, begin, "right") - 1
    alone = np.bincount(owner, minlength=len(p.begin))[owner] == 1
    pair = np.flatnonzero(owner[1:] == owner[:-1])
    keys = np.concatenate((word[pair] * np.uint64(3) + word[pair + 1], word[alone]))
    rows = np.concatenate((row_of[owner[pair]], row_of[owner[alone]]))
    order = np.argsort(rows, kind="stable")
    keys, rows = keys[order], rows[order]
    first = np.searchsorted(rows, np.arange(len(out) + 1))
    full = np.flatnonzero(np.diff(first))
    for turn in range(LIKENESS_LANES // 64):
        x = keys + _MIX[:1] * np.uint64(turn + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        signs = 2 * bit_counts(x ^ (x >> np.uint64(31)), first[:-1][full]) - np.diff(first)[full][:, None]
        at = HASH_LANES + 128 * turn
        out[full, at:at + 128] = signs.astype("<u4").view("<u2")
    return out


def _sums(v: np.ndarray) -> np.ndarray:
    """The likeness lanes of vectors as 32-bit numbers."""
    return np.ascontiguousarray(v[:, HASH_LANES:]).view(np.uint32)


def _joined(hashes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    return np.concatenate((hashes.astype(np.uint16), sums.astype(np.uint32).view(np.uint16)), axis=1)


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Vector of two multisets of paragraphs put together; ``take`` undoes it."""
    return _joined(a[:, :HASH_LANES] + b[:, :HASH_LANES], _sums(a) + _sums(b))


def take(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Vector of a multiset after the paragraphs of another were taken out."""
    return _joined(a[:, :HASH_LANES] - b[:, :HASH_LANES], _sums(a) - _sums(b))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of two arrays of vectors, 0 to 1: one less the estimated share of word pairs they do not share.

    The squared length of a difference estimates how many pairs differ. Equal vectors have likeness 1.
    """
    x, y = (_sums(v).view(np.int32).astype(float) for v in (a, b))
    apart, whole = ((x - y) ** 2).sum(1), (x * x).sum(1) + (y * y).sum(1)
    near = np.clip(1 - apart / np.where(whole > 0, whole, 1), 0, 1)
    same = (a == b).all(1)
    return np.where(same, 1.0, np.where(whole > 0, near, 0.0))


def _vector_bytes(v: np.ndarray) -> pa.Array:
    v = np.ascontiguousarray(v.astype("<u2"))
    at = np.arange(len(v) + 1, dtype=np.int32) * (2 * LANES)
    return pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(at), pa.py_buffer(v)])


def _text_vectors(texts: list[str]) -> np.ndarray:
    rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    found = [vectors(data, offsets) for _, data, offsets in text_slices(iter([rows]), "text")]
    return np.concatenate(found) if found else np.zeros((0, LANES), np.uint16)


def multiset_fingerprints(segments: DataFrame, id: str = "id", text: str = "original_text") -> DataFrame:
    """Fingerprint of every segment's text: (id, fingerprint), binary, LANES little-endian 16-bit numbers.

    The fingerprint is the sum over the text's paragraphs (non-empty lines) of vectors hashed from them, modulo 2**16
    per hash lane and 2**32 per likeness lane (two numbers). It does not depend on the order of paragraphs; paragraphs are inserted or deleted by adding or
    subtracting their vectors (``add``, ``take``). A null text is empty and has the zero vector; repeated rows and null
    ids are handled row by row; other columns are ignored; no rows give no rows.
    """
    narrow = segments.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), _vector_bytes(vectors(data, offsets))], ["id", "fingerprint"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, fingerprint binary")


def _range_of(value: Column, bounds: list[float]) -> Column:
    """How many of the sorted bounds are at or below a value, by two short searches; 0 for a null."""
    if not bounds:
        return F.lit(0)
    wide = int(np.ceil(len(bounds) ** 0.5))
    groups = [bounds[k:k + wide] for k in range(0, len(bounds), wide)]

    def below(edges: Column) -> Column:
        return F.coalesce(F.size(F.filter(edges, lambda e: e <= value)), F.lit(0))

    group = below(F.array(*[F.lit(g[0]) for g in groups]))
    inner = below(F.get(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), group - 1))
    return F.when(value.isNull() | (group == 0), 0).otherwise((group - 1) * wide + inner)


def _as_number(rows: DataFrame, id: str) -> Column:
    """A number that rises with the id. Of text, it is the six bytes after the prefix that all ids share."""
    at = F.col(id)
    if rows.schema[id].dataType.simpleString() not in ("string", "binary"):
        return at.cast("double")
    raw = F.encode(at, "utf-8") if rows.schema[id].dataType.simpleString() == "string" else at
    ends = rows.agg(F.min(raw).alias("a"), F.max(raw).alias("b")).first()
    shared = len(os.path.commonprefix([bytes(ends["a"] or b""), bytes(ends["b"] or b"")]))
    return F.conv(F.rpad(F.hex(F.substring(raw, shared + 1, 6)), 12, "0"), 16, 10).cast("double")


def with_next(rows: DataFrame, id: str, columns: list[str], parts: int | None = None) -> DataFrame:
    """Every row with ``next_<column>`` of the row with the next larger id; the last row gets the first one's.

    ids are cut into ranges at approximate quantiles, ``parts`` of them or by default one for every ROWS_PER_PART rows
    (256 at least, MOST_PARTS at most); each row moves once, to its range. The first
    row of a range is sent to the range before it as well, so a range knows what follows it. Rows of one id follow one
    another by the hash of their columns; null ids come first.
    """
    spark = rows.sparkSession
    at = F.col(id)
    parts = parts or min(MOST_PARTS, max(PARTS, rows.count() // ROWS_PER_PART))
    shares = [k / parts for k in range(1, parts)]
    number = _as_number(rows, id)
    bounds = sorted(set(rows.select(number.alias("v")).approxQuantile("v", shares, 1 / (4 * parts)))) if shares else []
    part = _range_of(number, bounds)
    tie = F.xxhash64(*columns)
    firsts = rows.groupBy(part.alias("part")).agg(F.min(F.struct(at.isNotNull(), at.alias("v"), tie)).alias("low")).collect()
    firsts = sorted(firsts, key=lambda r: r["part"])  # at most ``parts`` rows
    before = {r["part"]: firsts[k - 1]["part"] for k, r in enumerate(firsts)}
    if not firsts:
        return rows.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns])
    known = spark.createDataFrame(
        [(r["part"], before[r["part"]], r["low"][1], r["low"][2]) for r in firsts],
        f"k_part int, k_before int, k_id {rows.schema[id].dataType.simpleString()}, k_tie long")
    placed = rows.withColumns({"__part": part, "__tie": tie, "__copy": F.lit(0)})
    copies = placed.join(F.broadcast(known), (F.col("__part") == F.col("k_part")) & F.col("k_id").eqNullSafe(at) & (F.col("k_tie") == F.col("__tie")))
    copies = copies.dropDuplicates(["__part"]).select(*rows.columns, F.col("k_before").alias("__part"), "__tie", F.lit(1).alias("__copy"))
    window = W.partitionBy("__part").orderBy("__copy", F.col(id).asc_nulls_first(), "__tie")
    out = placed.unionByName(copies).select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns])
    return out.filter("__copy = 0").drop("__part", "__tie", "__copy")


def edited_fingerprints(segments: DataFrame, id: str = "id", text: str = "original_text") -> DataFrame:
    """Fingerprints of every segment's text, of an edited text, and how alike they are.

    The edited text has the last floor(n/2) of the n code points replaced by the first as many (or all) of the next
    segment by id (after the last: the first). Returns id, n_chars, edited_text, fingerprint, edited_fingerprint
    (binary vectors), near_edited, near_next (likeness to the edited and to the next text's fingerprint, 0 to 1).

    Ids may be numbers or texts (in the order of their bytes). A null text is empty; segments of one id follow one another in a fixed order; null ids come first; a single
    segment is its own next; other columns are ignored; no rows give no rows.
    """
    rows = segments.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    paired = with_next(rows, "id", ["text"])

    def run(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            texts, nexts = batch.column("text").to_pylist(), batch.column("next_text").to_pylist()
            edited = [a[:len(a) - len(a) // 2] + b[:len(a) // 2] for a, b in zip(texts, nexts, strict=True)]
            own, changed = vectors(data, offsets), _text_vectors(edited)
            # Rows come in order, so most next texts are the batch's own.
            after = np.roll(own, -1, axis=0)
            other = [k for k, b in enumerate(nexts) if k + 1 == len(texts) or b != texts[k + 1]]
            after[other] = _text_vectors([nexts[k] for k in other])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.fromiter(map(len, texts), np.int64, len(texts))), pa.array(edited, pa.string()),
                 _vector_bytes(own), _vector_bytes(changed), pa.array(likeness(own, changed)), pa.array(likeness(own, after))],
                ["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = paired.schema["id"].dataType.simpleString()
    return paired.mapInArrow(run, f"id {kind}, n_chars long, edited_text string, fingerprint binary, "
                                  "edited_fingerprint binary, near_edited double, near_next double")
