"""Hard negatives by segment summaries: bounds on inner products prune candidates before exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.operators.skew import first_rows, sized_broadcast
from panelflow.session import cut

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SEGMENTS = (1, 4, 16)
ROW_BLOCK = 8192
ANCHOR_BLOCK = 512
_NO_LIMIT = (1 << 63) - 1


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of every segment of every row, times the root of the segment's length.

    So for two rows the sum over segments of the means' products, plus or minus the deviations' products, bounds their
    inner product (Cauchy-Schwarz on what is left after the means).
    """
    width = x.shape[1]
    segments = min(segments, width)
    start = np.arange(segments) * width // segments
    root = np.sqrt(np.diff(np.append(start, width)))
    mean = np.add.reduceat(x, start, axis=1) / root
    square = np.add.reduceat(x * x, start, axis=1) - mean * mean
    return mean, np.sqrt(np.maximum(square, 0))


class Block:
    """Integer vectors with summaries from coarse to fine."""

    def __init__(self, whole: np.ndarray):
        self.whole = whole
        self.real = whole.astype(float)
        self.norm = np.sqrt((self.real * self.real).sum(1))
        self.levels = [summaries(self.real, s) for s in SEGMENTS if s <= max(1, whole.shape[1] // 2)]
        self.most = int(np.abs(self.real).max(initial=0))

    def scores(self, other: Block, one: int, rows: np.ndarray) -> np.ndarray:
        """Exact inner products of a row of ``other`` with the given rows."""
        if self.most * other.most * self.whole.shape[1] < 1 << 53:
            return (self.real[rows] @ other.real[one]).astype(np.int64)
        return self.whole[rows] @ other.whole[one]


def best_in_windows(block: Block, anchors: Block, one: int, rows: np.ndarray, ids: np.ndarray,
                    windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of ``rows`` of the block, the first k by (score falling, id) with a score in each window: (rows, scores).

    Level by level, a row stays while its bounds reach into a window and not below k scores that are sure to be in it.
    """
    for (mean, spread), (m, s) in zip(block.levels, anchors.levels, strict=True):
        middle, reach = mean[rows] @ m[one], spread[rows] @ s[one]
        reach = reach + 1e-9 * block.norm[rows] * anchors.norm[one] + 0.5  # rounding
        low, high = middle - reach, middle + reach
        stays = np.zeros(len(rows), bool)
        for least, most in windows:
            fits = (high >= least) & (low <= most)
            sure = low[(low >= least) & (high <= most)]
            if len(sure) >= k:
                fits &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            stays |= fits
        rows = rows[stays]
    score = block.scores(anchors, one, rows)
    out = []
    for least, most in windows:
        at = np.flatnonzero((score >= least) & (score <= most))
        if len(at) > k:
            at = at[score[at] >= np.partition(score[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((ids[rows[at]], -score[at]))][:k]
        out.append((rows[at], score[at]))
    return out


def _cells(rows: DataFrame, anchors: DataFrame, keys: list[str], row_block: int, anchor_block: int) -> DataFrame:
    """Rows and anchors of one key dealt to blocks; every pair of blocks is a cell, whose rows lie together, anchors first."""
    many = rows.groupBy(*keys).agg(F.ceil(F.count("*") / row_block).cast("int").alias("row_blocks"))
    few = anchors.groupBy(*keys).agg(F.ceil(F.count("*") / anchor_block).cast("int").alias("anchor_blocks"))
    sizes = sized_broadcast(cut(many.join(few, keys)))

    def dealt(df: DataFrame, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        placed = df.join(sizes, keys).withColumn(own, F.pmod(F.xxhash64("id", F.lit(7)), F.col(n_own)).cast("int"))
        return placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1))).drop(n_own, n_other)

    asked = dealt(anchors.withColumn("side", F.lit(0)), "ab", "rb", "anchor_blocks", "row_blocks")
    held = dealt(rows.withColumns({"side": F.lit(1), "windows": F.lit(None).cast("array<struct<least: long, most: long>>")}),
                 "rb", "ab", "row_blocks", "anchor_blocks")
    columns = [*dict.fromkeys([*keys, "ab", "rb", "side", "id", "label", "v", "windows"])]
    return asked.select(columns).unionByName(held.select(columns)).repartition(*keys, "ab", "rb").sortWithinPartitions(*keys, "ab", "rb", "side")


def _whole_cells(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """One table for each cell; a cell goes on over the ends of batches."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if table.num_rows:
            changed = np.logical_or.reduce([(c := table.column(b).to_numpy())[1:] != c[:-1] for b in by])
            at = [0, *(np.flatnonzero(changed) + 1).tolist()]
            for a, b in zip(at[:-1], at[1:], strict=True):
                yield table.slice(a, b - a)
            held = table.slice(at[-1])
    if held is not None and held.num_rows:
        yield held


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat if isinstance(flat, pa.Array) else flat.chunk(0)
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def _searched(rows: DataFrame, anchors: DataFrame, keys: list[str], k: int, same: bool, row_block: int, anchor_block: int) -> DataFrame:
    """First k rows for each window of each anchor within each cell: (anchor_id, window, id, score)."""
    by = [*keys, "ab", "rb"]

    def run(batches):
        for table in _whole_cells(batches, by):
            side, ids, label = (table.column(c).to_numpy() for c in ("side", "id", "label"))
            n = int((side == 0).sum())
            if n in (0, len(ids)):
                continue
            vectors = _matrix(table.column("v"))
            asked, block, own, owned = Block(vectors[:n]), Block(vectors[n:]), ids[n:], label[n:]
            windows = table.column("windows").slice(0, n).to_pylist()
            out = [[], [], [], []]
            for one in range(n):
                allowed = np.flatnonzero(((owned == label[one]) == same) & (own != ids[one]))
                if not len(allowed):
                    continue
                limits = [(w["least"], w["most"]) for w in windows[one]]
                for window, (found, score) in enumerate(best_in_windows(block, asked, one, allowed, own, limits, k)):
                    for name, values in zip(out, (np.full(len(found), ids[one]), np.full(len(found), window), own[found], score), strict=True):
                        name.append(values)
            if out[0]:
                a, w, i, s = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(w.astype(np.int32)), pa.array(i), pa.array(s)], ["anchor_id", "window", "id", "score"])

    found = _cells(rows, anchors, keys, row_block, anchor_block).mapInArrow(run, "anchor_id long, window int, id long, score long")
    return first_rows(found, ["anchor_id", "window"], [F.desc("score"), F.col("id")], k)


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, as long. Values are held to a range in which no inner product leaves a long."""
    most = F.floor(F.pow(F.lit(2.0), F.floor((F.lit(62) - F.ceil(F.log2(F.greatest(F.size(vector), F.lit(1)).cast("double")))) / 2))).cast("double")
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(F.floor(x.cast("double") * scale).cast("double"), most), -most)).cast("long"))


def mine_negatives(vectors: DataFrame, is_anchor: Column, id: str = "id", vector: str = "embedding", label: str = "label",
                   scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
                   row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """Hard negatives of anchors: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    The library's records have no vectors; this operator takes any table of integer ids, vectors and labels.
    ``is_anchor`` marks the anchors. A row's score is the inner product of its floor(scale * x) with the anchor's, in
    whole numbers. An anchor's positives are the first ``positives`` other rows of its label, greatest score first, ties
    by smaller id; for each, the first ``negatives`` rows of other labels in that order come back whose score is between
    ``low`` and ``high`` hundredths of the positive's.

    Anchors are searched against all rows in cells of ``anchor_block`` times ``row_block``. In a cell the means and
    deviations of 1, 4 and 16 segments bound each score from below and above; what the bounds of one level leave is bounded
    by the next, and only the rest is scored, so the result is exact. Positives are sought within the label's cells only.

    Null labels, null ids, null vectors and vectors with null or non-finite components take no part; vectors meet those
    of their own length only; an empty vector scores 0. Of rows that repeat an id the one of least (label, vector)
    counts. Components beyond about 2^31 / sqrt(length) after scaling are held there, so that no score leaves a long.
    Fewer candidates give fewer rows; other columns are ignored; no rows give no rows.
    """
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"),
                          F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))
    rows = rows.select("id", "label", whole_numbers(F.col("v"), scale).alias("v"), "anchor").groupBy("id").agg(
        F.min(F.struct("label", "v")).alias("row"), F.max("anchor").alias("anchor"))
    length = F.size("row.v")
    rows = cut(rows.select("id", "row.label", F.when(length > 0, F.col("row.v")).otherwise(F.array(F.lit(0).cast("long"))).alias("v"),
                           length.alias("length"), "anchor"))
    everything = F.array(F.struct(F.lit(-_NO_LIMIT).alias("least"), F.lit(_NO_LIMIT).alias("most")))
    anchors = rows.filter("anchor").drop("anchor")
    rows = rows.drop("anchor")
    best = cut(_searched(rows, anchors.withColumn("windows", everything), ["label", "length"], positives, True, row_block, anchor_block))
    # Whole limits of low and high hundredths; a negative positive has an empty window.
    limit = F.col("score").cast("decimal(20,0)")
    window = F.struct(F.ceil(limit * low / 100).cast("long").alias("least"), F.floor(limit * high / 100).cast("long").alias("most"))
    listed = best.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id", "score", window.alias("w")))).alias("all"))
    asking = anchors.join(listed.withColumnRenamed("anchor_id", "id").select("id", F.col("all.w").alias("windows")), "id")
    found = _searched(rows, asking, ["length"], negatives, False, row_block, anchor_block)
    named = listed.select("anchor_id", F.posexplode("all").alias("window", "p"))
    ranked = found.groupBy("anchor_id", "window").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("down"), "id", "score"))).alias("all"))
    out = ranked.join(named, ["anchor_id", "window"]).select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"),
                                                             F.posexplode("all").alias("at", "one"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.id").alias("negative_id"),
                      "positive_score", F.col("one.score").alias("negative_score"))
