"""Text quality learned from preferences between pairs of segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.buffers import IS_SPACE, LOWER, per_row, text_slices, words_of
from panelflow.session import cut

CUT = 0.7
PAIRS = 200_000
RIDGE = 1e-3
BUCKET_ROWS = 4096
FEATURES = ["letters", "upper", "digits", "stops", "symbols", "bars", "marks", "blanks", "breaks", "word_length",
            "word_spread", "short_words", "long_words", "symbol_words", "bare_marks", "repeats", "variety", "size"]


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[[ord(c) for c in chars]] = 1
    return table


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = 1
_DIGIT = _class("0123456789")
_STOP = _class(".,;:'\"-()")
_MARK = _class("!?")
_BAR = _class("|/\\_=<>~")
_SYMBOL = 1 - np.clip(_LETTER | _DIGIT | _STOP | _MARK | _BAR | IS_SPACE, 0, 1)
_POSITION = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_BYTE = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a flat buffer."""
    n = np.maximum(np.diff(offsets), 1).astype(float)

    def share(table):
        return per_row(table[data], offsets) / n

    begin, end, first = words_of(data, offsets)
    words = np.maximum(np.diff(first), 1).astype(float)
    length = (end - begin).astype(float)
    symbol = np.concatenate(([0], np.cumsum((_SYMBOL | _BAR)[data])))
    letter = np.concatenate(([0], np.cumsum(_LETTER[data])))
    has_symbol = (symbol[end] - symbol[begin] > 0).astype(float)
    no_letter = (letter[end] - letter[begin] == 0).astype(float)
    mean = per_row(length, first) / words
    spread = np.sqrt(np.maximum(per_row(length * length, first) / words - mean * mean, 0))
    # A word's hash from its bytes and their places, to compare words within a row.
    low = LOWER[data]
    place = np.arange(len(data)) - np.repeat(begin, end - begin)[np.cumsum(~IS_SPACE[data]) - 1] if len(begin) else np.zeros(len(data), int)
    mixed = np.where(IS_SPACE[data], np.uint64(0), _BYTE[low] * _POSITION[np.minimum(place, 63) % 64])
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)))
    key = total[end] - total[begin]
    row = np.repeat(np.arange(len(words)), np.diff(first))
    again = np.zeros(len(key))
    if len(key) > 1:
        again[1:] = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((key, row))
    fresh = np.ones(len(key))
    if len(key) > 1:
        fresh[1:] = (key[order][1:] != key[order][:-1]) | (row[order][1:] != row[order][:-1])
    # Distinct words against what a text of this many words usually has.
    variety = np.log1p(per_row(fresh, first)) - 0.8 * np.log1p(words)
    rates = np.stack([share(t) for t in (_LETTER, _UPPER, _DIGIT, _STOP, _SYMBOL, _BAR, _MARK)]
                     + [share(IS_SPACE.astype(np.int64)), share(_class("\n"))], axis=1)
    rates[:, 1:] = np.sqrt(rates[:, 1:])
    more = np.stack([mean / 5, spread / 5, per_row((length <= 3).astype(float), first) / words,
                     per_row((length > 14).astype(float), first) / words,
                     np.sqrt(per_row(has_symbol, first) / words), np.sqrt(per_row(no_letter, first) / words),
                     np.sqrt(per_row(again, first) / words), variety, np.log1p(words) / 8], axis=1)
    return np.concatenate((rates, np.minimum(more, 8)), axis=1)


def _texts(segments: DataFrame, id: str, text: str) -> DataFrame:
    return segments.select(F.col(id).alias("id"), F.col(text).alias("text"))


def _pairs(x: np.ndarray, better: np.ndarray, rounds: int) -> Iterator[np.ndarray]:
    """Differences of preferred and other rows: in each round every row of the more frequent kind with one of the other kind,
    and never the same pair twice."""
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    few = min(len(good), len(bad))
    at = np.arange(max(len(good), len(bad)))
    for r in range(min(rounds, few)):
        yield x[good[(at + r * (len(good) == few)) % len(good)]] - x[bad[(at + r * (len(good) != few)) % len(bad)]]


def _slopes(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Pairs, gradient and curvature of the logistic loss, summed over pairs."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance of the wrong order
    return np.concatenate(([len(d)], -(d.T @ p), ((d.T * (p * (1 - p))) @ d).ravel()))


def _newton(total: Callable[[np.ndarray], np.ndarray], width: int, ridge: float) -> np.ndarray:
    """Weights that minimise the mean loss; ``total`` gives the sums of ``_slopes`` at given weights."""
    w = np.zeros(width)
    for _ in range(25):
        sums = total(w)
        grad = sums[1:1 + width] / sums[0] + ridge * w
        step = np.linalg.solve(sums[1 + width:].reshape(width, width) / sums[0] + ridge * np.eye(width), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_ranking(features: np.ndarray, better: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE) -> dict:
    """Bradley-Terry strengths that are linear in the features, of rows in memory.

    The chance that a preferred text beats another is the logistic of the difference of their strengths; the weights
    minimise the logistic loss by Newton steps over pairs in which every row takes part, in rounds until there are ``pairs``
    or all. The threshold is the quantile of the strengths that leaves the share of non-preferred texts below it.
    """
    mean, scale = features.mean(0), features.std(0) + 1e-9
    x = np.clip((features - mean) / scale, -20, 20)
    bad = int((~better).sum())
    if not bad or bad == len(better):  # nothing to prefer: all texts alike
        return {"mean": mean, "scale": scale, "w": np.zeros(x.shape[1]), "cut": 1.0 if bad else -1.0}
    d = np.concatenate(list(_pairs(x, better, -(-pairs // max(bad, len(better) - bad)))))
    w = _newton(lambda w: _slopes(d, w), x.shape[1], ridge)
    strength = np.sort(x @ w)
    return {"mean": mean, "scale": scale, "w": w, "cut": float((strength[bad - 1] + strength[min(bad, len(strength) - 1)]) / 2)}


def _measured(rows: DataFrame) -> DataFrame:
    """(id, features as 32-bit floats) of all rows (id, text), written once."""
    def measure(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            f = np.ascontiguousarray(_features(data, offsets).astype(np.float32))
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * f.shape[1]), len(f), [None, pa.py_buffer(f)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed.cast(pa.binary())], ["id", "features"])

    return cut(rows.mapInArrow(measure, f"id {rows.schema['id'].dataType.simpleString()}, features binary"))


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, len(FEATURES))


def _summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], width: int) -> np.ndarray:
    """The sum over all batches of rows of an array of numbers; a task sends one array to the driver."""
    def run(batches):
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total = total + part(batch)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return sum((np.frombuffer(bytes(r["sums"])) for r in rows.mapInArrow(run, "sums binary").collect()), np.zeros(width))


def _nth(values: DataFrame, rank: int, most: int = 10_000) -> float:
    """The value of column s that so many values precede in order, exactly; at most ``most`` values come to the driver."""
    low, high, n = values.agg(F.min("s"), F.max("s"), F.count("*")).first()
    while low < high:
        inside = values.filter(F.col("s").between(low, high))
        if n <= most:
            return sorted(r["s"] for r in inside.collect())[rank]
        bin = F.least(F.floor((F.col("s") - low) / (high - low) * 1024), F.lit(1023))
        bins = inside.groupBy(bin.alias("bin")).agg(F.min("s").alias("low"), F.max("s").alias("high"), F.count("*").alias("n"))
        for r in sorted(bins.collect(), key=lambda r: r["bin"]):
            if rank < r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            rank -= r["n"]
    return low


def _model(measured: DataFrame, labels: DataFrame, id: str, label: str) -> dict:
    """The ranking of ``rank_quality``, from the features of all rows and all labels: ``fit_ranking`` with its rows in
    buckets by their hash, pairs made inside a bucket, and the sums of every Newton step over all of them."""
    width = len(FEATURES)
    taught = (labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).dropna()
              .groupBy("id").agg(F.min("label").alias("label")))
    known = cut(measured.join(taught, "id").select((F.col("label") == 1).alias("better"), F.xxhash64("id", "features").alias("key"), "features"))

    def moments(batch):
        x, better = _unpacked(batch.column("features")).astype(float), batch.column("better").to_numpy(zero_copy_only=False)
        return np.concatenate(([len(x), better.sum()], x.sum(0), (x * x).sum(0)))

    sums = _summed(known, moments, 2 + 2 * width)
    n, good = int(sums[0]), int(sums[1])
    mean = sums[2:2 + width] / max(n, 1)
    scale = np.sqrt(np.maximum(sums[2 + width:] / max(n, 1) - mean * mean, 0)) + 1e-9
    if not good or good == n:  # nothing to prefer: all texts alike
        return {"mean": mean, "scale": scale, "w": np.zeros(width), "cut": 1.0 if n and not good else -1.0}

    def scaled(column):
        return np.clip((_unpacked(column) - mean) / scale, -20, 20)

    bad, rounds = n - good, -(-PAIRS // max(good, n - good))
    buckets = max(1, min(n // BUCKET_ROWS, min(good, bad) // 32))

    def pair(table):
        table = table.sort_by("key").combine_chunks()
        x, better = scaled(table.column("features")), table.column("better").to_numpy()
        return pa.table({"pairs": pa.array([d.astype(np.float32).tobytes() for d in _pairs(x, better, rounds)], pa.binary())})

    paired = cut(known.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInArrow(pair, "pairs binary"))

    def slopes(w):
        return lambda batch: sum(_slopes(np.frombuffer(d, np.float32).reshape(-1, width).astype(float), w)
                                 for d in batch.column("pairs").to_pylist())

    w = _newton(lambda w: _summed(paired, slopes(w), 1 + width + width * width), width, RIDGE)

    def strengths(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scaled(batch.column("features")) @ w)], ["s"])

    strength = cut(known.mapInArrow(strengths, "s double"))
    return {"mean": mean, "scale": scale, "w": w, "cut": (_nth(strength, bad - 1) + _nth(strength, bad)) / 2}


def _scores(features: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray]:
    x = np.clip((features - model["mean"]) / model["scale"], -20, 20)
    strength = x @ model["w"]
    return strength, 1 / (1 + np.exp(-np.clip(strength - model["cut"] + np.log(CUT / (1 - CUT)), -30, 30)))


def rank_quality(segments: DataFrame, labels: DataFrame, id: str = "id", text: str = "original_text",
                 label: str = "quality") -> DataFrame:
    """Quality of every segment's text: (id, strength double, score double, predicted int).

    ``labels`` (id, quality 0/1) gives the preferences: any text labelled 1 is preferred to any labelled 0. The model
    is fitted on all labelled segments, each in at least one pair where both kinds meet, and scores every whole text from its
    bytes alone. score is in 0..1 and reaches 0.7 exactly at the strength quantile that the share of zeros sets;
    predicted is 1 from there on.

    Null and empty texts have all-zero counts and are scored like any text. Rows with a null label or id teach
    nothing; of several labels of one id the smallest holds; without labels of both kinds all texts score alike.
    Repeated rows and null ids are scored row by row; other columns are ignored; no rows give no rows.
    """
    measured = _measured(_texts(segments, id, text))
    model = _model(measured, labels, id, label)

    def score(batches):
        for batch in batches:
            s, p = _scores(_unpacked(batch.column("features")), model)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(s), pa.array(p), pa.array((p >= CUT).astype(np.int32))],
                                             ["id", "strength", "score", "predicted"])

    kind = measured.schema["id"].dataType.simpleString()
    return measured.mapInArrow(score, f"id {kind}, strength double, score double, predicted int")


def keep_good(segments: DataFrame, labels: DataFrame, id: str = "id", text: str = "original_text", label: str = "quality") -> DataFrame:
    """The segments that ``rank_quality`` predicts as 1, with all their columns; no text is shuffled."""
    model = _model(_measured(_texts(segments, id, text)), labels, id, label)

    def sift(batches):
        for batch, data, offsets in text_slices(batches, text):
            yield batch.filter(pa.array(_scores(_features(data, offsets).astype(np.float32), model)[1] >= CUT))

    return segments.mapInArrow(sift, segments.schema)
