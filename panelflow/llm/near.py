"""Near-duplicate texts by SimHash with exact links between fingerprints."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.buffers import IS_SPACE, LOWER, bit_counts, text_slices, words_of
from panelflow.session import cut

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
TILE = 4096


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, repeats included, and how many each row has."""
    space = IS_SPACE[data]
    after_word = np.concatenate(([False], ~space[:-1]))
    keep = ~space | after_word  # one white-space byte after each word
    text = LOWER[np.where(space, np.uint8(0x20), data)[keep]]
    kept = np.concatenate(([0], np.cumsum(keep)))
    begin, end, first = words_of(text, kept[offsets])
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    if not n.sum():
        return np.zeros(0, np.uint64), n
    at = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(n)), n)
    word = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    last = np.minimum(word + words, first[1:][row]) - 1
    raw, digest = text.tobytes(), xxhash.xxh64_digest
    hashes = b"".join([digest(raw[a:b], SEED) for a, b in zip(begin[word].tolist(), end[last].tolist(), strict=True)])
    return np.frombuffer(hashes, ">u8").astype(np.uint64), n


def _simhash(data: np.ndarray, offsets: np.ndarray, words: int) -> np.ndarray:
    """Fingerprint of every row of a flat buffer."""
    hashes, n = _shingles(data, offsets, words)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        ones = bit_counts(hashes, (np.cumsum(n) - n)[full])
        out[full] = np.packbits(2 * ones > n[full][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(segments: DataFrame, id: str = "id", text: str = "original_text",
                 words: int = SHINGLE_WORDS) -> DataFrame:
    """SimHash of every segment's text: (id, fingerprint long).

    A-Z are lower-cased; words are runs without ASCII white space; shingles of ``words`` words, repeats included, are
    joined by one blank and hashed with XXH64. A bit is set when more than half the hashes have it. A text of fewer
    words is one shingle; a null text or one without words gets 0.
    """
    def run(batches):
        for rows, data, offsets in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [rows.column("id"), pa.array(_simhash(data, offsets, words).view(np.int64))], ["id", "fingerprint"])

    narrow = segments.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, fingerprint long"
    return narrow.mapInArrow(run, schema)


def _offsets(parts: int, radius: int) -> list[tuple[int, ...]]:
    """Differences of part counts that ``radius`` changed bits allow, one of each pair of opposites."""
    found = {(): 0}
    for _ in range(parts):
        found = {(*head, d): used + abs(d) for head, used in found.items()
                 for d in range(used - radius, radius - used + 1)}
    zero = (0,) * parts
    return [d for d in found if d >= zero]


def _forest(pairs: tuple[np.ndarray, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node each is joined to, directly or not."""
    a, b = pairs
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, old):
            node = np.flatnonzero(label != np.arange(n))
            return node, label[node]


def _compare(left: np.ndarray, right: np.ndarray, radius: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    hits = [np.zeros((0, 2), np.int64)]
    for i in range(0, len(left), block):
        near = np.bitwise_count(left[i:i + block, None] ^ right[None, :]) <= radius
        found = np.argwhere(near)
        hits.append(found + [i, 0])
    a, b = np.concatenate(hits).T
    return a, b


def links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, parts: int | None = None) -> DataFrame:
    """Links (src, dst) that join all fingerprints within ``radius`` bits: the exact classes, not every pair.

    Distinct fingerprints are cut into tiles of one population count per part of the word. Tiles are compared only
    where the counts can lie within the radius (the sum of their differences is at most the radius), each tile pair by
    exclusive-or and bit counts. A tile pair gives the edges of a spanning forest, so a dense group of g fingerprints
    gives about g rows. With ``parts=None`` the word is counted in 4, 8 or 16 parts, by how many fingerprints there
    are; that moves the cost between comparing and sending tiles and never the result.
    """
    distinct = cut(prints.select("fingerprint").filter("fingerprint is not null").distinct())
    if parts is None:
        n = distinct.count()
        parts = 4 if n < 1 << 23 else 8 if n < 1 << 31 else 16
    bits = 64 // parts
    ones = [F.bit_count(F.shiftrightunsigned("fingerprint", bits * k).bitwiseAND(F.lit((1 << bits) - 1)))
            for k in range(parts)]
    base = 2 * bits + 8  # so that no difference carries into another part's digit of a real cell
    if base ** parts < 1 << 63:
        cell = sum((c.cast("long") * base ** k for k, c in enumerate(ones)), F.lit(0).cast("long"))
        shifts = F.array(*[F.lit(sum(d * base ** k for k, d in enumerate(o))).cast("long") for o in _offsets(parts, radius)])
        moved = F.explode(F.transform(shifts, lambda s: F.col("cell") + s))
    else:
        cell = F.array(*[c.cast("int") for c in ones])
        shifts = F.array(*[F.array(*[F.lit(d) for d in o]) for o in _offsets(parts, radius)])
        moved = F.explode(F.transform(shifts, lambda s: F.zip_with("cell", s, lambda x, y: x + y)))
    placed = distinct.select("fingerprint", cell.alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    packed = (placed.join(sizes, "cell")
              .withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")))
              .groupBy("cell", "tile").agg(F.collect_list("fingerprint").alias("prints")))
    packed = cut(packed)
    left = packed.select(F.col("cell").alias("own"), F.col("tile").alias("l_tile"), F.col("prints").alias("l"), moved.alias("cell"))
    right = packed.select("cell", F.col("tile").alias("r_tile"), F.col("prints").alias("r"))
    pairs = left.join(right, "cell").filter("own <> cell or l_tile <= r_tile").select("l", "r")

    def run(batches):
        for batch in batches:
            src, dst = [], []
            for l, r in zip(batch.column("l"), batch.column("r"), strict=True):
                a, b = (np.asarray(x.values).view(np.uint64) for x in (l, r))
                i, j = _compare(a, b, radius)
                nodes = np.concatenate((a, b))
                names, at = np.unique(nodes, return_inverse=True)
                node, root = _forest((at[i], at[len(a) + j]), len(names))
                src.append(names[node].view(np.int64))
                dst.append(names[root].view(np.int64))
            if src:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], ["src", "dst"])

    return pairs.mapInArrow(run, "src long, dst long").filter("src <> dst")


def components(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Connected components by alternating stars: (node, root), root the smallest node of its component.

    Each round points nodes at their smallest neighbour; a hub's edges are reduced to a minimum per key before they
    meet, so no neighbour list is built. Ends when a round changes nothing. ``parts`` bounds the tasks of a round, for
    edges known to be few.
    """
    def few(df: DataFrame) -> DataFrame:
        return df.coalesce(parts) if parts else df

    def star(e: DataFrame, large: bool) -> DataFrame:
        e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else e
        least = e.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
        joined = e.join(least, "src")
        if large:
            out = joined.filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        else:
            out = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(
                least.select("src", F.col("m").alias("dst")))
        return few(few(out.filter("src <> dst")).distinct())

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    edges = cut(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
                .filter("src <> dst").distinct())
    edges = few(edges)
    before = mark(edges)
    while True:
        edges = few(cut(star(star(edges, True), False)))
        now = mark(edges)
        if now == before:
            return edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        before = now


def near_duplicates(segments: DataFrame, id: str = "id", text: str = "original_text", words: int = SHINGLE_WORDS,
                    radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Every segment with its fingerprint and its class: (id, fingerprint long, component_id).

    component_id is the smallest id among all segments whose fingerprints are joined by links of ``radius`` bits or
    fewer, directly or through others. Texts without words have fingerprint 0 and link like any other. A null id takes
    no part in the minimum (a class of null ids only has a null component_id); repeated rows are kept; other columns
    are ignored; no rows give no rows.
    """
    prints = cut(fingerprints(segments, id, text, words))
    roots = components(links(prints, radius, tile))
    least = prints.groupBy("fingerprint").agg(F.min("id").alias("first"))
    named = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    classes = named.groupBy("root").agg(F.min("first").alias("component_id"))
    lookup = cut(named.join(classes, "root").select("fingerprint", "component_id"))
    return prints.join(lookup, "fingerprint").select("id", "fingerprint", "component_id")


def keep_first(segments: DataFrame, id: str = "id", text: str = "original_text", **kw) -> DataFrame:
    """One segment of each near-duplicate class, that with the smallest id, with all its columns.

    Of rows that repeat an id one stays. Segments without an id stay: no decision can name them.
    """
    found = near_duplicates(segments, id, text, **kw)
    kept = found.filter("id = component_id").select(F.col("id").alias("__kept")).distinct()
    named = segments.join(kept, segments[id] == kept["__kept"]).drop("__kept").dropDuplicates([id])
    return named.unionByName(segments.filter(F.col(id).isNull()))
