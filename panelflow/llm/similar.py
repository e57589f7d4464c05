"""Classes of similar shingle sets: candidates share a band key, sketches screen them, whole sets confirm them.

Shared by the near-duplicate operators that link texts by the Jaccard index. A text's set is reduced to a row of bytes
(its sketch) whose band keys bring candidates together. No list of all pairs of a band is made: each member of a band is
first compared with one head; what is still apart is compared inside tasks, in tiles, by sketches and then by whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.buffers import text_slices
from panelflow.llm.near import components
from panelflow.llm.shingles import shingle_hashes
from panelflow.operators.skew import sized_broadcast
from panelflow.session import cut

TILE = 512
TILE_SHINGLES = 256  # a node's share of a tile of whole sets
PAIRS = 1 << 14
HOLDERS = 50_000  # rows of 24 bytes that are still broadcast
PART_ROWS = 20_000
PART_EDGES = 200_000


def _counted(df: DataFrame, rows: int) -> tuple[DataFrame, int]:
    """The rows, written, in about as many partitions as they fill, and how many partitions that is."""
    held = cut(df)
    parts = max(1, -(-held.count() // rows))
    return held.coalesce(parts), parts


@dataclass(frozen=True)
class Sketch:
    """How sets become bytes and how bytes are compared.

    make(hashes, first): a row of ``width`` bytes for each set; the sets lie end to end and begin at ``first``.
    keys(rows): the band keys of such rows, one column a band; none where ``similar_classes`` is given the members. screen(x, n, y, m): for rows of the first ``compared``
    bytes (broadcast against each other) and set sizes, how alike they are, and minus infinity where the sets cannot
    be similar enough.
    """

    make: Callable[[np.ndarray, np.ndarray], np.ndarray]
    screen: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]
    width: int
    compared: int
    keys: Callable[[np.ndarray], np.ndarray] | None = None


def place_of(id: str, text: str) -> Column:
    """A name for a row by its id and text, also where the id is null or repeated."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id).cast("string"), F.lit("")), F.lit("\0"), F.coalesce(F.col(text), F.lit("")))))


def placed(segments: DataFrame, id: str, text: str) -> DataFrame:
    """(id, place, text)."""
    return segments.select(F.col(id).alias("id"), place_of(id, text).alias("place"), F.col(text).alias("text"))


def distinct_nodes(found: DataFrame) -> DataFrame:
    """One node for each distinct set with members: (node, digest, n, sketch, place of one holder, first id)."""
    each = found.filter("n > 0").groupBy("digest").agg(
        F.min("id").alias("first"), F.min("place").alias("place"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    return cut(each).withColumn("node", F.monotonically_increasing_id())  # always the same, as the rows are written


def texts_of(wanted: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """One text for each wanted node: (node, text)."""
    holders = sized_broadcast(cut(nodes.join(wanted, "node", "left_semi").select("node", "place")), HOLDERS)
    return rows.select("place", "text").join(holders, "place").dropDuplicates(["place"]).select("node", "text")


def class_of_digest(nodes: DataFrame, roots: DataFrame, *named: Column) -> DataFrame:
    """(digest, what ``named`` aggregates over the class)."""
    joined = cut(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("sketch"))
    each = joined.groupBy("root").agg(*named)
    return joined.select("digest", "root").join(each, "root").drop("root")


def sketched(rows: DataFrame, words: int, sketch: Sketch) -> DataFrame:
    """The rows' other columns with a digest of the text's shingle set, its size n and its sketch (null without words)."""
    others = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            hashes, n = shingle_hashes(data, offsets, words)
            first = np.concatenate(([0], np.cumsum(n)))
            digests = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            full = np.flatnonzero(n)
            made = iter(sketch.make(hashes, first[full]) if len(full) else ())
            sketches = [next(made).tobytes() if k else None for k in n.tolist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in others), pa.array(digests, pa.binary()), pa.array(n), pa.array(sketches, pa.binary())],
                [*(f.name for f in others), "digest", "n", "sketch"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{kept}, digest binary, n long, sketch binary")


def shingle_sets(rows: DataFrame, words: int) -> DataFrame:
    """Distinct shingles of texts: (node, text) to (node, shingles)."""
    def run(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            hashes, n = shingle_hashes(data, offsets, words)
            at = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.ListArray.from_arrays(at, pa.array(hashes.view(np.int64)))], ["node", "shingles"])

    return rows.select("node", "text").mapInArrow(run, "node long, shingles array<long>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def _alike(common: Column, n: Column, m: Column, least: Fraction) -> Column:
    """Whether sets of n and m members with so many in common have at least this Jaccard index, in whole numbers."""
    return (least.numerator + least.denominator) * common >= least.numerator * (n + m)


def _band_rows(nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """A row (key, node) for each band of each node."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                keys = sketch.keys(_matrix(piece.column("sketch"), sketch.width))
                node = np.repeat(piece.column("node").to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sketch").mapInArrow(run, "key long, node long")


def _screened(pairs: DataFrame, features: DataFrame, sketch: Sketch) -> DataFrame:
    """Pairs (node, head) whose sketches allow the wanted index."""
    def run(batches):
        for batch in batches:
            x, y = (_matrix(batch.column(c), sketch.compared) for c in ("x", "y"))
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            score = sketch.screen(x, n, y, m) if len(x) else np.zeros(0)
            yield batch.select(["node", "head"]).filter(pa.array(score > -np.inf))

    x = features.select("node", "n", F.col("sketch").alias("x"))
    y = features.select(F.col("node").alias("head"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(x, "node").join(y, "head").select("node", "head", "n", "m", "x", "y").mapInArrow(run, "node long, head long")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Edges (src, dst) of the pairs whose whole sets have the wanted index."""
    x = sets.select("node", F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("head"), F.col("shingles").alias("y"))
    found = pairs.join(x, "node").join(y, "head").filter(
        _alike(F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y"), least))
    return found.select(F.col("node").alias("src"), F.col("head").alias("dst"))


def _in_cells(rows: DataFrame, weight: Column, tile: int, parts: int) -> DataFrame:
    """Rows of a key dealt to tiles of about that weight, each row once for every cell (a pair of tiles) it belongs to,
    sorted so that the rows of a cell lie together."""
    sizes = rows.groupBy("key").agg(F.ceil(F.sum(weight) / tile).cast("int").alias("tiles"))
    dealt = rows.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).drop("tiles")
    cells = other.withColumns({"l": F.least("tile", "other"), "r": F.greatest("tile", "other")}).drop("other")
    return cells.coalesce(parts).repartition("key", "l", "r").sortWithinPartitions("key", "l", "r")


def _starts(table: pa.Table, names: tuple[str, ...]) -> np.ndarray:
    """Where each cell's rows begin; ``names`` are the columns that name a cell."""
    columns = [table.column(c).to_numpy() for c in names]
    changed = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.concatenate(([0], np.flatnonzero(changed) + 1))


def _whole_cells(batches: Iterator[pa.RecordBatch], names: tuple[str, ...] = ("key", "l", "r")) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells, and where each begins; a cell cut by the end of a batch waits for the next one."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if table.num_rows:
            at = _starts(table, names)
            if at[-1]:
                yield table.slice(0, at[-1]).combine_chunks(), at[:-1]
            held = table.slice(at[-1]).combine_chunks()
    if held is not None and held.num_rows:
        yield held, _starts(held, names)


def _pairs(begin: np.ndarray, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of one cell, at most about ``PAIRS`` at a time."""
    after = np.repeat(np.append(begin[1:], rows), np.diff(np.append(begin, rows)))
    count = after - 1 - np.arange(rows)
    total = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < rows:
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(at, to), count[at:to])
        yield i, i + 1 + np.arange(len(i)) - (total[i] - total[at])
        at = to


def _promising(rows: DataFrame, sketch: Sketch, tile: int, parts: int) -> DataFrame:
    """Of rows (key, node, root, n, sketch), those (key, node) that the screen lets meet another root in their key."""
    def run(batches):
        for table, begin in _whole_cells(batches):
            key, l, r, tiles, node, root, n = (table.column(c).to_numpy() for c in ("key", "l", "r", "tile", "node", "root", "n"))
            sketches = _matrix(table.column("sketch"), sketch.compared)
            hit = np.zeros(len(node), bool)
            for i, j in _pairs(begin, len(node)):
                apart = (root[i] != root[j]) & ((l[i] == r[i]) | (tiles[i] != tiles[j]))
                i, j = i[apart], j[apart]
                alike = sketch.screen(sketches[i], n[i], sketches[j], n[j]) > -np.inf
                hit[i[alike]] = hit[j[alike]] = True
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(node[hit])], ["key", "node"])

    cells = _in_cells(rows, F.lit(1), tile, parts)
    return cells.mapInArrow(run, "key long, node long").coalesce(parts).distinct()


def _linked(rows: DataFrame, least: Fraction, tile: int, parts: int) -> DataFrame:
    """Edges (src, dst) that join what whole sets of one key link: of rows (key, node, root, shingles), in each cell a
    forest between the roots, never a pair more."""
    numerator, denominator = least.numerator, least.denominator

    def run(batches):
        for table, begin in _whole_cells(batches):
            src, dst = [], []
            l, r, tiles, node, root = (table.column(c).to_numpy() for c in ("l", "r", "tile", "node", "root"))
            lists = table.column("shingles").chunk(0)
            first = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy()
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(node)], strict=True):
                at = first[a:b + 1] - first[a]
                n, label, dealt = np.diff(at), root[a:b].copy(), tiles[a:b]
                names, ids = np.unique(values[first[a]:first[b]], return_inverse=True)
                mark = np.zeros(len(names), np.int32)
                for i in range(b - a - 1):
                    m = n[i + 1:]
                    apart = (label[i + 1:] != label[i]) & (denominator * np.minimum(n[i], m) >= numerator * np.maximum(n[i], m))
                    if l[a] != r[a]:
                        apart &= dealt[i + 1:] != dealt[i]
                    if not apart.any():
                        continue
                    own = ids[at[i]:at[i + 1]]
                    mark[own] = 1
                    common = np.add.reduceat(mark[ids[at[i + 1]:]], at[i + 1:-1] - at[i + 1])
                    mark[own] = 0
                    for j in (np.flatnonzero(apart & ((numerator + denominator) * common >= numerator * (n[i] + m))) + i + 1).tolist():
                        if label[j] != label[i]:
                            label[label == label[j]] = label[i]
                            src.append(node[a + i])
                            dst.append(node[a + j])
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return _in_cells(rows, F.size("shingles"), tile, parts).mapInArrow(run, "src long, dst long")


def similar_classes(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], sketch: Sketch, least: Fraction,
                    tile: int = TILE, *, members: DataFrame | None = None) -> DataFrame:
    """Classes of nodes joined by a Jaccard index of ``least`` or more: (node, root), only nodes that are not their root.

    nodes: (node long, n, sketch, ...), one for each distinct set. sets(wanted) gives (node, shingles) for the wanted nodes.
    Two nodes are compared when they share a band key, or a key of ``members`` (key, node) where that is given. First every node of a key meets the key's least node. Keys whose
    nodes are then of one component are done, which settles most of a group of near copies at a row for each member. In the
    others all pairs of different components are compared inside tasks, cell by cell (a pair of tiles of the key's
    nodes): by their sketches, and those that pass by their whole sets. A task hands on a row for each node or a forest of
    links, never the pairs, so rows grow with the nodes of a key and only the comparing with their square.
    """
    members = _band_rows(nodes, sketch) if members is None else members
    ends = members.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head < last")
    shared, _ = _counted(members.join(ends.select("key", "head"), "key"), PART_EDGES)
    wanted = shared.select("node").distinct()
    features, parts = _counted(nodes.join(wanted, "node", "left_semi").select(
        "node", "n", F.substring("sketch", 1, sketch.compared).alias("sketch")), PART_ROWS)
    held = cut(sets(features.select("node"))).coalesce(parts)
    stars, parts = _counted(shared.filter("node <> head").select("node", "head").distinct(), PART_ROWS)
    edges, few = _counted(_confirmed(_screened(stars, features, sketch).coalesce(parts), held, least), PART_EDGES)
    rows = shared.select("key", "node").join(components(edges, few), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows, few = _counted(rows.coalesce(parts), PART_EDGES)
    apart = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
    rows, parts = _counted(rows.join(apart, "key", "left_semi").coalesce(few), PART_ROWS)
    chosen = _promising(rows.join(features, "node").coalesce(parts), sketch, tile, parts)
    rest, parts = _counted(rows.join(chosen, ["key", "node"]).coalesce(parts), PART_ROWS // 10)
    found, few = _counted(edges.unionByName(_linked(rest.join(held, "node").coalesce(parts), least, tile * TILE_SHINGLES, parts)), PART_EDGES)
    return components(found, few)
