"""Removing byte passages that repeat an earlier text, by suffix arrays over shards of candidate passages."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.buffers import text_slices
from panelflow.llm.suffixes import common_prefixes, suffix_array
from panelflow.session import cut, scratch_path

WIDTH = 50
GRAM = 24
PACK_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
SHARD_BYTES = 6 << 20
GAP = 0xFF  # never a byte of UTF-8
NO_ID = np.iinfo(np.int64).max
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    w = data.astype(np.uint64)
    for k, bits in ((1, 8), (2, 16), (4, 32)):
        w = w[:-k] | (w[k:] << np.uint64(bits))
    n = len(data) - gram + 1
    h = w[:n] * _M1
    for at in [*range(8, gram - 7, 8), *([gram - 8] if gram % 8 else [])]:
        h = (h ^ (h >> np.uint64(31))) * _M2
        h += w[at:at + n] * _M3
    return _mixed(h)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    a, span = h, 1
    while 2 * span <= width:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    n = len(h) - width + 1
    return np.minimum(a[:n], a[width - span:width - span + n])


def _runs(data: np.ndarray, offsets: np.ndarray, width: int, gram: int, block: int = 1 << 17) -> tuple[np.ndarray, ...]:
    """All width-byte windows of the rows, as runs of neighbours with the same anchor.

    The anchor of a window is the least hash of its grams, so equal windows have equal anchors wherever they stand.
    Returns anchor, first window's place in the row, number of windows, and row of every run.
    """
    n = len(data) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none
    anchor = np.concatenate([_least(_gram_hashes(data[a:min(a + block, n) + width - 1], gram), width - gram + 1)
                             for a in range(0, n, block)])
    has = np.diff(offsets) >= width
    first, last = offsets[:-1][has], offsets[1:][has] - width + 1  # window starts of a row: first up to last
    inside = np.zeros(n + 1, np.int8)
    inside[first] += 1
    np.subtract.at(inside, last, 1)
    inside = np.cumsum(inside[:n]).astype(bool)
    fresh = np.concatenate(([True], anchor[1:] != anchor[:-1]))
    fresh[first] = True
    begin = np.flatnonzero(fresh & inside)
    row = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.concatenate((begin[1:], [n])), offsets[row + 1] - width + 1)
    return anchor[begin], begin - offsets[row], end - begin, row


def _codes(anchor: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket number and a 32-bit key of every anchor, in one number."""
    h = _mixed(anchor)
    return (((h >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _rows_of(column: pa.ChunkedArray | pa.Array, kind) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in column.to_pylist()]


def _squeezed(values: np.ndarray | bytes) -> bytes:
    """Bytes for the shuffle: their length, then zstd. Passages overlap, so they shrink well."""
    raw = values if isinstance(values, bytes) else values.tobytes()
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _unsqueezed(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    out = []
    for x in column.to_pylist():
        n = int.from_bytes(x[:8], "little")
        out.append(np.frombuffer(pa.decompress(x[8:], n, "zstd", asbytes=True) if n else b"", kind))
    return out


def _find(text: np.ndarray, length: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Smallest id of any passage that holds a window, for every window of every passage in turn."""
    begin = np.concatenate(([0], np.cumsum(length + 1)))
    t = np.full(begin[-1], GAP, np.uint8)
    at = np.arange(len(text)) + np.repeat(np.arange(len(length)), length)
    t[at] = text
    windows = length - width + 1
    first = np.concatenate(([0], np.cumsum(windows)))
    valid = np.repeat(begin[:-1] - first[:-1], windows) + np.arange(first[-1])
    is_start = np.zeros(len(t), bool)
    is_start[valid] = True
    order = suffix_array(t, depth=width + 1)
    order = order[is_start[order]]
    group = np.flatnonzero(common_prefixes(t, order, width) < width)  # the first of each group of equal windows
    owner = np.repeat(np.arange(len(length)), windows)
    number = np.zeros(len(t), np.int64)
    number[valid] = np.arange(len(valid))
    held = number[order]
    low = np.minimum.reduceat(least[owner[held]], group)
    out = np.empty(len(valid), np.int64)
    out[held] = np.repeat(low, np.diff(np.concatenate((group, [len(held)]))))
    return out


def _shard_spans(table: pa.Table, width: int) -> list[np.ndarray]:
    """For each row of a shard (the passages of one pack): row, start, end of what an earlier text holds, end to end."""
    texts, lengths = _unsqueezed(table["texts"], np.uint8), _unsqueezed(table["lengths"], np.int32)
    users = [_unsqueezed(table[c], k) for c, k in (("passage", np.int32), ("owner", np.int64), ("row", np.int32), ("start", np.int32))]
    # The same passage from several packs enters the array once, with the smallest id that has it.
    place: dict[bytes, int] = {}
    kept, maps = [], []
    for text, length in zip(texts, lengths, strict=True):
        raw, at = text.tobytes(), np.concatenate(([0], np.cumsum(length))).tolist()
        found = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            p = raw[a:b]
            k = place.setdefault(p, len(place))
            if k == len(kept):
                kept.append(p)
            found.append(k)
        maps.append(np.array(found, np.int64))
    length = np.fromiter(map(len, kept), np.int64, len(kept))
    passage = [m[p] for m, p in zip(maps, users[0], strict=True)]
    least = np.full(len(kept), NO_ID)
    np.minimum.at(least, np.concatenate(passage), np.concatenate(users[1]))
    low = _find(np.frombuffer(b"".join(kept), np.uint8), length, least, width)
    first = np.concatenate(([0], np.cumsum(length - width + 1)))
    out = []
    for p, owner, row, start in zip(passage, *users[1:], strict=True):
        whole = least[p] < owner  # an earlier text has the whole passage
        spans = [np.stack((row[whole], start[whole], start[whole] + length[p[whole]]))]
        some = np.flatnonzero(~whole)
        n = first[p[some] + 1] - first[p[some]]
        begin = np.concatenate(([0], np.cumsum(n)))
        k = np.arange(begin[-1]) - np.repeat(begin[:-1], n)
        gone = low[np.repeat(first[p[some]], n) + k] < np.repeat(owner[some], n)
        opens = gone & ((k == 0) | ~np.concatenate(([False], gone[:-1])))
        closes = gone & ((k == np.repeat(n, n) - 1) | ~np.concatenate((gone[1:], [False])))
        at = np.repeat(some, n)
        spans.append(np.stack((row[at[opens]], start[at[opens]] + k[opens], start[at[opens]] + k[closes] + width)))
        out.append(np.concatenate(spans, axis=1).astype(np.int32))
    return out


def remove_repeats(segments: DataFrame, id: str = "id", text: str = "original_text", width: int = WIDTH,
                   gram: int = GRAM, keep: list[str] | None = None, whole_characters: bool = False) -> DataFrame:
    """Remove every byte covered by a ``width``-byte string that also starts in a segment with a smaller id.

    Returns one row per segment: id, n_bytes, spans (array of start, end: the maximal removed runs of bytes), kept
    (binary: the remaining UTF-8 bytes). Strings are judged on the whole texts as given, never across segments.

    Texts are written in packs of a few MB. Every window belongs to an anchor, the least hash of its grams; anchors
    that only one text has are ruled out by a count over buckets of 32-bit keys (a chance collision only adds work).
    The passages around the remaining anchors go to shards by anchor, each distinct passage once, so copies do not
    fill a shard. A shard sorts the suffixes of its passages by induced sorting, finds equal windows by permuted common
    prefixes, and returns the spans that a smaller id holds. Nothing is sampled or capped and no pairs are formed.

    ``keep`` names further columns to return; with ``whole_characters`` a character that loses a byte is removed whole.

    ids are integers. A null id counts as larger than any other; rows of the same id (repeated rows, null ids) do not
    remove each other's text. A null text is empty; a text shorter than ``width`` is kept whole; other columns are
    ignored; no rows give no rows.
    """
    spark = segments.sparkSession
    keep = keep or []
    others = [f"keep_{k}" for k in range(len(keep))]  # under names that cannot clash
    source = segments.select(F.col(id).cast("long").alias("id"), F.col(text).cast("binary").alias("text"),
                             *[F.col(c).alias(o) for c, o in zip(keep, others, strict=True)])
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(max(64, total // gram * 2 * 4 // BUCKET_BYTES), 1 << 20))

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for batch, data, offsets in text_slices(batches, "text", PACK_BYTES):
            ids = batch.column("id").fill_null(NO_ID).to_numpy()
            anchor, _, _, row = _runs(data, offsets, width, gram)
            code, owner = _codes(anchor, buckets), ids[row]
            order = np.lexsort((owner, code))
            code, owner = code[order], owner[order]
            fresh = np.concatenate(([True], code[1:] != code[:-1])) if len(code) else np.zeros(0, bool)
            second = np.zeros(len(code), bool)  # an anchor of two texts of the pack is sent twice
            begin = np.flatnonzero(fresh)
            if len(begin):
                end = np.concatenate((begin[1:], [len(code)])) - 1
                second[end] = owner[begin] != owner[end]
            code = code[fresh | second]
            edges = np.searchsorted(code >> np.uint64(32), np.arange(buckets + 1))
            keys = (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            rest = pa.BufferOutputStream()
            with pa.ipc.new_stream(rest, batch.select(others).schema) as writer:
                writer.write_batch(batch.select(others))
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([rest.getvalue().to_pybytes()], pa.binary()), _binary([ids]), _binary([offsets]), pa.array([data.tobytes()], pa.binary()),
                 pa.array([[keys[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]], pa.list_(pa.binary()))],
                ["pack", "rest", "ids", "offsets", "text", "anchors"])
            number += 1

    # Written by pack, so that the two later passes meet their texts without moving them.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"repeat_packs_{uuid.uuid4().hex}", scratch_path(spark, "packs")
    (source.mapInArrow(pack, "pack long, rest binary, ids binary, offsets binary, text binary, anchors array<binary>")
     .write.option("compression", "zstd").option("path", path).bucketBy(parts, "pack").saveAsTable(name))
    packs = spark.table(name)

    def shared(table: pa.Table) -> pa.Table:
        lists = _rows_of(table["keys"], np.uint32)
        keys = np.sort(np.concatenate(lists))
        twice = np.unique(keys[1:][keys[1:] == keys[:-1]])
        own = []
        for k in lists:
            at = np.searchsorted(twice, k)
            k = np.unique(k[(at < len(twice)) & (twice[np.minimum(at, max(len(twice) - 1, 0))] == k)] if len(twice) else k[:0])
            own.append(k)
        out = pa.table({"pack": table["pack"], "bucket": table["bucket"], "keys": _binary(own)})
        return out.filter(pa.array([len(k) > 0 for k in own]))

    anchors = packs.select("pack", F.posexplode("anchors").alias("bucket", "keys")).filter("octet_length(keys) > 0")
    common = cut(anchors.groupBy("bucket").applyInArrow(shared, "pack long, bucket int, keys binary"))
    n_shared = (common.agg(F.sum(F.octet_length("keys"))).first()[0] or 0) // 4
    shards = int(max(1, n_shared * 2 * width // SHARD_BYTES))

    def passages(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = {c: [] for c in ("shard", "pack", "texts", "lengths", "passage", "owner", "row", "start")}
        if left.num_rows and right.num_rows:
            ids, offsets, data = (np.frombuffer(left[c][0].as_py(), k) for c, k in
                                  (("ids", np.int64), ("offsets", np.int64), ("text", np.uint8)))
            anchor, start, windows, row = _runs(data, offsets, width, gram)
            code = _codes(anchor, buckets)
            wanted = np.sort(np.concatenate([
                np.uint64(b) << np.uint64(32) | k.astype(np.uint64)
                for b, k in zip(right["bucket"].to_pylist(), _rows_of(right["keys"], np.uint32), strict=True)]))
            use = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code)
            shard = (_mixed(code[use]) % np.uint64(shards)).astype(np.int64)
            use, raw = use[np.argsort(shard, kind="stable")], data.tobytes()
            shard = np.sort(shard)
            begin = offsets[row[use]] + start[use]
            length = windows[use] + width - 1
            edge = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            for a, b in zip(edge, np.concatenate((edge[1:], [len(shard)])), strict=True):
                place: dict[bytes, int] = {}
                number = [place.setdefault(raw[x:x + n], len(place)) for x, n in zip(begin[a:b].tolist(), length[a:b].tolist(), strict=True)]
                r = row[use[a:b]]
                for c, v in (("shard", int(shard[a])), ("pack", key[0].as_py()), ("texts", _squeezed(b"".join(place))),
                             ("lengths", _squeezed(np.fromiter(map(len, place), np.int32, len(place)))),
                             ("passage", _squeezed(np.array(number, np.int32))), ("owner", _squeezed(ids[r])),
                             ("row", _squeezed(r.astype(np.int32))), ("start", _squeezed(start[use[a:b]].astype(np.int32)))):
                    out[c].append(v)
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=True)})

    def sort_shard(table: pa.Table) -> pa.Table:
        spans = _shard_spans(table, width)
        out = pa.table({"pack": table["pack"], "spans": _binary(spans)})
        return out.filter(pa.array([s.size > 0 for s in spans]))

    by_shard = packs.select("pack", "ids", "offsets", "text").groupBy("pack").cogroup(common.groupBy("pack")).applyInArrow(
        passages, "shard long, pack long, texts binary, lengths binary, passage binary, owner binary, row binary, start binary")
    spans = cut(by_shard.groupBy("shard").applyInArrow(sort_shard, "pack long, spans binary"))

    def apply(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids, offsets, data = (np.frombuffer(left[c][0].as_py(), k) for c, k in
                              (("ids", np.int64), ("offsets", np.int64), ("text", np.uint8)))
        delta = np.zeros(len(data) + 1, np.int32)
        for flat_spans in _rows_of(right["spans"], np.int32):
            row, start, end = flat_spans.reshape(3, -1)
            np.add.at(delta, offsets[row] + start, 1)
            np.subtract.at(delta, offsets[row] + end, 1)
        gone = np.cumsum(delta[:-1]) > 0
        if whole_characters and len(data):
            lead = np.flatnonzero((data & 0xC0) != 0x80)
            lead = np.union1d(lead, [0])
            gone = np.repeat(np.maximum.reduceat(gone, lead), np.diff(np.concatenate((lead, [len(data)]))))
        kept = np.concatenate(([0], np.cumsum(~gone)))[offsets]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        opens = np.flatnonzero(gone & (edge[:-1] | ~np.concatenate(([False], gone[:-1]))))
        closes = np.flatnonzero(gone & (edge[1:] | ~np.concatenate((gone[1:], [False])))) + 1
        at = np.searchsorted(opens, offsets)
        row = np.searchsorted(offsets, opens, "right") - 1
        runs = pa.StructArray.from_arrays([pa.array(opens - offsets[row]), pa.array(closes - offsets[row])], ["start", "end"])
        rest = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(kept.astype(np.int32)), pa.py_buffer(data[~gone].tobytes())])
        more = pa.ipc.open_stream(left["rest"][0].as_py()).read_all()
        return pa.table({**{o: more[o] for o in others}, "id": pa.array(ids, mask=ids == NO_ID), "n_bytes": pa.array(np.diff(offsets)),
                         "spans": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), runs), "kept": rest})

    kinds = [f"{o} {source.schema[o].dataType.simpleString()}" for o in others]
    found = packs.drop("anchors").groupBy("pack").cogroup(spans.groupBy("pack")).applyInArrow(
        apply, ", ".join([*kinds, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"]))
    return found.select("id", "n_bytes", "spans", "kept", *[F.col(o).alias(c) for c, o in zip(keep, others, strict=True)])


def clean_repeats(segments: DataFrame, id: str = "id", text: str = "original_text", **kw) -> DataFrame:
    """The segments with repeated passages taken out of their text, all other columns as they were.

    A segment of which nothing remains stays, with an empty text. Characters are removed whole.
    """
    own = segments.columns
    numbered = segments.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(own)])
    at = f"c{own.index(id)}"
    found = remove_repeats(numbered, at, f"c{own.index(text)}", whole_characters=True,
                           keep=[f"c{k}" for k, c in enumerate(own) if c != text], **kw)
    return found.select(*[(F.col("kept").cast("string") if c == text else F.col(f"c{k}")).alias(c) for k, c in enumerate(own)])
