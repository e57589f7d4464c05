"""Packing tokenised texts into sequences by non-negative least squares over length combinations."""

from __future__ import annotations

import json
import os
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelflow.llm.buffers import LOWER, text_slices, words_of
from panelflow.session import scratch_path

WINDOW = 4096
GRAIN = 64
PARTS = 4
END_ID = 2
CACHED_WORDS = 1_000_000
# A tokenizer that first does this takes a word of lower-case composed letters as one piece, its bytes spelled as characters.
_PIECES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None}
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELLED = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in ",.;:!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as in ``words_of``, with one closing ASCII mark after an ASCII letter or digit on its own.

    The tokenizer never merges a letter or digit with a mark, so the ids stay the same and fewer words differ.
    """
    begin, end, first = words_of(data, offsets)
    if not len(begin):
        return begin, end, first
    split = (end - begin > 1) & _CLOSING[data[end - 1]] & _ALNUM[data[end - 2]]
    at = np.flatnonzero(split)
    place = np.arange(len(begin)) + np.cumsum(split) - split
    out_begin, out_end = (np.empty(len(begin) + len(at), np.int64) for _ in range(2))
    out_begin[place], out_end[place] = begin, end - split
    out_begin[place[at] + 1], out_end[place[at] + 1] = end[at] - 1, end[at]
    return out_begin, out_end, np.concatenate((place, [len(out_begin)]))[first]


class _Numbers(dict):
    """Numbers words in the order they come and lists those that are new."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Words:
    """Token ids of white-space separated words, kept for the life of a Python worker up to CACHED_WORDS words.

    The tokenizer drops white space and never merges across it, so a text's ids are its words' ids end to end.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.model = self.tokenizer.model if all(told.get(k) == v for k, v in _PIECES.items()) else None
        self.clear()

    def clear(self) -> None:
        self.place = _Numbers()
        self.begin, self.count, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.int32)
        self.used = 0

    def _word_ids(self, words: list[bytes]) -> list[list[int]]:
        """Ids of new words. Words of lower-case Latin letters go to the model at once, where that gives the same."""
        texts = [w.decode("utf-8", "replace") for w in words]
        ids: list = [None] * len(texts)
        rest = []
        for k, w in enumerate(texts):
            if self.model is not None and w.isalpha() and (
                    w.isascii() and w.islower() or max(w) < "\u0250" and w == w.lower() and is_normalized("NFC", w)):
                ids[k] = [t.id for t in self.model.tokenize(words[k].decode("latin-1").translate(_SPELLED))]
            else:
                rest.append(k)
        for k, e in zip(rest, self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False), strict=True):
            ids[k] = e.ids
        return ids

    def _add(self, words: list[bytes]) -> None:
        ids = self._word_ids(words)
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(counts.sum()))
        n = len(self.place) - len(words)
        while n + len(words) > len(self.begin):
            self.begin, self.count = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.begin[n:n + len(words)] = self.used + np.cumsum(counts) - counts
        self.count[n:n + len(words)] = counts
        self.ids[self.used:self.used + len(flat)] = flat
        self.used += len(flat)

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end, each row closed by ``end_id``, and the rows' offsets in them."""
        raw = data.tobytes()
        if b"<|" not in raw:  # else the text may spell special tokens, which are case-sensitive
            raw = LOWER[data].tobytes()
        begin, end, first = _units(data, offsets)
        if len(self.place) > CACHED_WORDS:
            self.clear()
        words = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if self.place.new:
            self._add(self.place.new)
            self.place.new = []
        count = self.count[at]
        # Rows become: the ids of their words, then one closing id.
        per_word = np.concatenate(([0], np.cumsum(count)))
        out = per_word[first] + np.arange(len(first))
        ids = np.full(out[-1], end_id, np.int32)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        target = np.repeat(per_word[:-1] + row - self.begin[at], count)
        source = np.arange(per_word[-1]) - np.repeat(per_word[:-1] - self.begin[at], count)
        ids[source + target] = self.ids[source]
        return ids, out


@lru_cache(maxsize=2)
def _words(path: str) -> _Words:
    return _Words(path)


def combinations(units: int, parts: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with at most ``parts`` positive parts, largest first."""
    def fill(rest: int, most: int, left: int):
        if rest == 0:
            yield ()
        elif left:
            for x in range(min(rest, most), 0, -1):
                if x * left >= rest:
                    for more in fill(rest - x, x, left - 1):
                        yield (x, *more)
    return [c for c in fill(units, units - 1, parts)]


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares with non-negative unknowns, by growing the set of active columns."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0))) * len(b)
    for _ in range(6 * len(b)):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= tolerance:
            break
        active[best] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (z <= 0)
            if not low.any():
                break
            step = np.min(x[low] / np.maximum(x[low] - z[low], 1e-300))
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
        x = z
    return x


def plan_sequences(counts: np.ndarray, window: int = WINDOW, grain: int = GRAIN, parts: int = PARTS) -> list[tuple[dict[int, int], int]]:
    """Filled windows as (pieces per bin, repeats), from the number of pieces per bin.

    Bins 1 to units-1 hold pieces of that many grains, bins units+1 to units+grain-1 tails of 1 to grain-1 tokens.
    Exact fillings of the window with at most ``parts`` pieces are repeated as non-negative least squares against the
    histogram says, rounded down and held to the pieces there are; what is left, tails included, is packed greedily,
    longest first. Works on counts only, so its cost does not depend on the number of pieces.
    """
    units = window // grain
    left = counts.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    shapes = combinations(units, parts)
    a = np.zeros((units - 1, len(shapes)))
    for k, shape in enumerate(shapes):
        for q in shape:
            a[q - 1, k] += 1
    if left[1:units].sum():
        x = nnls(a, left[1:units].astype(float))
        for k in np.argsort(-x, kind="stable"):
            need = {q: shapes[k].count(q) for q in set(shapes[k])}
            n = min([int(x[k] + 1e-6), *(int(left[q]) // m for q, m in need.items())])
            if n > 0:
                out.append((dict(sorted(need.items(), reverse=True)), n))
                for q, m in need.items():
                    left[q] -= n * m
    length = {q: q * grain for q in range(1, units)} | {units + s: s for s in range(1, grain)}
    order = sorted(length, key=lambda q: -length[q])
    while any(left[q] for q in order):
        room, need = window, {}
        for q in order:
            m = min(int(left[q]), room // length[q])
            if m:
                need[q] = m
                room -= m * length[q]
        n = min(int(left[q]) // m for q, m in need.items())
        out.append((need, n))
        for q, m in need.items():
            left[q] -= n * m
    return out


def _slots(plan: list[tuple[dict[int, int], int]], bins: int, window: int, grain: int) -> tuple[dict, int]:
    """For each bin: first piece number, sequence base, pieces per sequence and offset of every filling it is in."""
    units = window // grain
    table = {q: [] for q in range(bins)}
    used = dict.fromkeys(range(bins), 0)
    base = 0
    for need, n in plan:
        offset = 0
        for q, m in need.items():
            table[q].append((used[q], base, m, offset))
            used[q] += m * n
            offset += m * (q * grain if q < units else q - units)
        base += n
    return {q: np.array(rows, np.int64).reshape(-1, 4) for q, rows in table.items()}, base


def pack_segments(segments: DataFrame, tokenizer_path: str, id: str = "id", text: str = "original_text",
                  window: int = WINDOW, grain: int = GRAIN, parts: int = PARTS, end_id: int = END_ID) -> DataFrame:
    """Pack the token ids of all texts into sequences of at most ``window`` ids.

    Returns one row per piece: id, start (ids of its text before it), length, token_ids (binary, little-endian 32-bit),
    doc_tokens (of its text, closing id included), sequence_id, offset (in the sequence, without gaps from 0).

    A text is cut into whole windows, a body of whole grains and a tail shorter than a grain. Windows stand alone;
    bodies and tails are placed by ``plan_sequences``: piece number j of a bin has its place by arithmetic, so no
    piece is ever gathered on the driver or in one task. Numbers come from counts per chunk of rows, which are written
    with the tokens; only a histogram of 2 * grain bins reaches the driver.

    A null or empty text is its closing id alone; repeated rows and null ids are packed row by row; other columns are
    ignored; no rows give no pieces.
    """
    spark = segments.sparkSession
    units, bins = window // grain, window // grain + grain
    narrow = segments.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def tokenise(batches):
        from pyspark import TaskContext
        words, chunk = _words(tokenizer_path), TaskContext.get().partitionId() << 32
        for batch, data, offsets in text_slices(batches, "text"):
            ids, at = words.encode(data, offsets, end_id)
            n = np.diff(at)
            body, tail = n % window // grain, n % grain
            nth = []  # of the pieces of the same bin in this chunk; whole windows are counted by their number
            windows = n // window
            nth.append(np.cumsum(windows) - windows)
            for key in (body, tail):
                order = np.argsort(key, kind="stable")
                rank = np.empty(len(key), np.int64)
                rank[order] = np.arange(len(key)) - np.searchsorted(key[order], key[order])
                nth.append(rank)
            blob = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * at), pa.py_buffer(ids.astype("<i4"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.full(len(n), chunk)), pa.array(n), blob.cast(pa.binary()),
                 *[pa.array(x) for x in nth]], ["id", "chunk", "doc_tokens", "ids", "n_window", "n_body", "n_tail"])
            chunk += 1

    path = scratch_path(spark, "tokens")
    narrow.mapInArrow(tokenise, f"id {kind}, chunk long, doc_tokens long, ids binary, n_window long, n_body long, n_tail long") \
        .write.option("compression", "zstd").parquet(path)
    tokens = spark.read.parquet(path)
    bins_of = F.array(
        F.struct(F.lit(0).cast("long").alias("bin"), F.floor(F.col("doc_tokens") / window).alias("n")),
        F.struct(F.floor(F.col("doc_tokens") % window / grain).alias("bin"), F.lit(1).cast("long").alias("n")),
        F.struct((units + F.col("doc_tokens") % grain).alias("bin"), F.lit(1).cast("long").alias("n")))
    held = tokens.select("chunk", F.explode(bins_of).alias("b")).select("chunk", "b.bin", "b.n").filter(
        f"n > 0 and bin <> {units}")
    # The body bin 0 means no body; whole windows, which are counted under 0 too, come as n_window alone.
    held = held.groupBy("chunk", "bin").agg(F.sum("n").alias("n"))
    windows = tokens.groupBy("chunk").agg(F.sum(F.floor(F.col("doc_tokens") / window)).alias("n")).select(
        "chunk", F.lit(0).cast("long").alias("bin"), "n")
    held = held.filter("bin <> 0").unionByName(windows)
    total = np.zeros(bins, np.int64)
    for row in held.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most 2 * grain rows
        total[row["bin"]] = row["n"]
    slots, base = _slots(plan_sequences(np.where(np.arange(bins) > 0, total, 0), window, grain, parts), bins, window, grain)
    earlier = W.partitionBy("bin").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    starts = held.withColumn("start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).groupBy("chunk").agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "start"))).alias("m"))  # at most 2 * grain entries
    starts = starts.select("chunk", F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")),
                                                lambda b: F.coalesce(F.element_at("m", b), F.lit(0))).alias("starts"))

    def place(batches):
        for batch in batches:
            n = batch.column("doc_tokens").to_numpy().astype(np.int64)
            start_of = np.asarray(batch.column("starts").flatten()).reshape(-1, bins)
            nth = [batch.column(c).to_numpy().astype(np.int64) for c in ("n_window", "n_body", "n_tail")]
            full, body, tail = n // window, n % window // grain, n % grain
            rows = np.arange(len(n))
            pieces = full + (body > 0) + (tail > 0)
            row = np.repeat(rows, pieces)
            k = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.minimum(k, full[row]) * window + np.where((k > full[row]), body[row] * grain, 0)
            is_full = k < full[row]
            is_body = ~is_full & (k == full[row]) & (body[row] > 0)
            length = np.where(is_full, window, np.where(is_body, body[row] * grain, tail[row]))
            bin_ = np.where(is_full, 0, np.where(is_body, body[row], units + tail[row]))
            number = start_of[row, bin_] + np.where(is_full, nth[0][row] + k, np.where(is_body, nth[1][row], nth[2][row]))
            sequence, offset = base + number, np.zeros(len(row), np.int64)
            for b in np.unique(bin_[~is_full]):
                at, table = np.flatnonzero(bin_ == b), slots[int(b)]
                entry = table[np.searchsorted(table[:, 0], number[at], "right") - 1]
                j = number[at] - entry[:, 0]
                sequence[at] = entry[:, 1] + j // entry[:, 2]
                offset[at] = entry[:, 3] + j % entry[:, 2] * length[at]
            ids = batch.column("ids")
            buffers, width = ids.buffers(), ids.offset
            at = np.frombuffer(buffers[1], np.int32, len(ids) + 1, 4 * width)
            cuts = np.concatenate((at[row] + 4 * start, at[-1:])).astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(cuts), buffers[2]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(row)), pa.array(start), pa.array(length), blob, pa.array(n[row]),
                 pa.array(sequence), pa.array(offset)],
                ["id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"])

    return tokens.join(starts, "chunk").select("id", "doc_tokens", "ids", "n_window", "n_body", "n_tail", "starts").mapInArrow(
        place, f"id {kind}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long")
