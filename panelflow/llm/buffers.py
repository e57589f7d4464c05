"""Texts of Arrow batches as flat byte buffers, for numpy work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
# The white space that parts words: blank, tab, line feed, vertical tab, form feed, carriage return.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and where each row begins; a null text is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * width) if len(column) else np.zeros(1, kind)
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if len(buffers) > 2 and buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str,
                limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches so that a slice holds at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        data, offsets = flat(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            at = offsets[first:last + 1]
            yield batch.slice(first, last - first), data[at[0]:at[-1]], at - at[0]
            first = last


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every run without white space, and the first word of each row (rows + 1 values)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], word[:-1]))
    after = np.concatenate((word[1:], [False]))
    begin = np.flatnonzero(word & (~before | edge[:-1]))
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(begin, offsets)


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions of ``first``."""
    total = np.concatenate((np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def bit_counts(keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many keys of each run have each of the 64 bits, lowest bit first; ``first`` begins the runs, none empty.

    Eight bits are added at a time, one in each byte of a word, over at most 255 keys, so that no byte overflows.
    """
    length = np.diff(np.concatenate((first, [len(keys)])))
    pieces = -(-length // 255)
    lead = np.cumsum(pieces) - pieces
    begin = np.repeat(first, pieces) + (np.arange(pieces.sum()) - np.repeat(lead, pieces)) * 255
    out = np.empty((len(first), 64), np.int64)
    for bit in range(8):
        held = np.add.reduceat((keys >> np.uint64(bit)) & np.uint64(0x0101010101010101), begin)
        out[:, bit::8] = np.add.reduceat(held.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), lead, axis=0)
    return out
