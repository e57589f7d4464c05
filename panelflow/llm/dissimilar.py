"""One text of each class of similar texts: wide SimHash fingerprints meet in bands of their bits, are compared by exclusive-or
and bit counts in tiles, and confirmed by the Jaccard index."""

from __future__ import annotations

from fractions import Fraction
from functools import lru_cache
from math import acos, ceil, exp, lgamma, log, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.buffers import bit_counts
from panelflow.llm.near import _forest
from panelflow.llm.similar import (HOLDERS, PART_EDGES, Sketch, _counted, _matrix, _whole_cells, class_of_digest, distinct_nodes,
                                   place_of, placed, shingle_sets, similar_classes, sketched, texts_of)
from panelflow.operators.skew import sized_broadcast
from panelflow.session import cut

WORDS = 5
LEAST = 0.8
MISS = 8e-6
PRINT_WORDS = 8
SHORT_WORDS = 4  # words of a fingerprint that travel to its cells
FEWEST = 64
DEVIATIONS = 6
CELL = 1024
TILE = 4096
DEALT = 256  # nodes whose bands leave a task in one batch
STARS = 32  # heads tried in a cell of more than STARS_FROM rows
STARS_FROM = 512
PAIRS = 1 << 16
SEED = 42
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def wide_simhash(hashes: np.ndarray, first: np.ndarray, words: int = PRINT_WORDS) -> np.ndarray:
    """SimHash of ``words`` times 64 bits of the sets that begin at ``first``, none empty: a bit is set in more than half."""
    n = np.diff(np.concatenate((first, [len(hashes)])))
    out = []
    for k in range(words):
        mixed = (hashes ^ np.uint64(k + 1)) * _MIX[0]
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
        ones = bit_counts(mixed ^ (mixed >> np.uint64(29)), first)
        out.append(np.packbits(2 * ones > n[:, None], axis=1, bitorder="little"))
    return np.concatenate(out, axis=1)


def _chance(least: Fraction, size: int) -> float:
    """The greatest chance that a bit differs between two sets of index ``least`` or more, the larger of ``size`` members."""
    def law(n):
        return np.array([exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * log(2)) for k in range(n + 1)])

    def set_bit(n, shared):  # for each number of ones among the shared members
        at_least = np.append(np.cumsum(law(n - shared)[::-1])[::-1], 0)
        return at_least[np.clip(n // 2 + 1 - np.arange(shared + 1), 0, n - shared + 1)]

    worst = 0.0
    for m in range(ceil(least * size), size + 1):
        shared = ceil(least * (size + m) / (1 + least))
        x, y = set_bit(size, shared), set_bit(m, shared)
        worst = max(worst, float((law(shared) * (x * (1 - y) + y * (1 - x))).sum()))
    return worst


@lru_cache
def bit_chances(least: Fraction) -> tuple[float, float]:
    """The chance that a bit differs at index ``least``, for large sets and, the greatest, for sets of up to ``FEWEST`` members.

    Large sets of index j share at least the cosine 2j / (1 + j); a bit then differs with a chance of arccos(2j / (1 + j)) / pi.
    In small sets ties and parity move it, so it is counted out.
    """
    large = acos(2 * least / (1 + least)) / pi
    return large, max(large, *(_chance(least, size) for size in range(1, FEWEST + 1)))


def most_bits(bits: int, chance: float) -> float:
    """Differing bits that a similar pair exceeds only by more than six standard deviations."""
    return bits * chance + DEVIATIONS * (bits * chance * (1 - chance)) ** 0.5


@lru_cache
def band_count(bits: int, size: int, chance: float, miss: float) -> int:
    """How many bands of ``size`` bits, drawn from ``bits``, a pair must have to share none with a chance of at most ``miss``."""
    differ = np.arange(bits - size + 1)
    fact = np.array([lgamma(k + 1) for k in range(bits + 1)])
    held = np.exp(fact[bits] - fact[differ] - fact[bits - differ] + differ * log(chance) + (bits - differ) * log(1 - chance)) if chance else differ == 0
    equal = np.exp(fact[bits - differ] - fact[bits - differ - size] - fact[bits] + fact[bits - size])
    if size == 0:
        return 1
    rest = max(0.0, 1.0 - float(held.sum()))  # pairs with too few equal bits for any band
    count = 1
    while (held * (1 - np.minimum(equal, 1)) ** count).sum() + rest > miss + 1e-9:
        count += 1
    return count


def band_places(bits: int, size: int, count: int) -> np.ndarray:
    """Bit places of each band: slices of permutations, so that bands share bits only where the fingerprint has too few."""
    if size == 0:
        return np.zeros((1, 0), np.int64)
    draw, each = np.random.default_rng(SEED), bits // size
    slices = [draw.permutation(bits)[:each * size].reshape(each, size) for _ in range(-(-count // each))]
    return np.concatenate(slices)[:count]


def band_keys(prints: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A key for each band of fingerprints (rows of bytes): the band's number, then its bits."""
    ones = np.unpackbits(prints, axis=1, bitorder="little")
    out = np.empty((len(prints), len(places)), np.int64)
    for band, at in enumerate(places):
        out[:, band] = ones[:, at] @ (1 << np.arange(len(at), dtype=np.int64)) + (band << len(at))
    return out


def simhash_sketch(least: float = LEAST) -> Sketch:
    """A wide SimHash. The screen takes exclusive-or and bit counts and refuses pairs with more differing bits than
    ``most_bits`` allows sets of their size."""
    exact, bits = Fraction(str(least)), 64 * PRINT_WORDS
    most, most_small = (most_bits(bits, c) for c in bit_chances(exact))

    def screen(x, n, y, m):
        x, y = (np.ascontiguousarray(z).view(np.uint64) for z in (x, y))
        differ = np.bitwise_count(x ^ y).sum(-1, dtype=np.int32)
        fits = differ <= np.where(np.minimum(n, m) <= FEWEST, most_small, most)
        fits &= exact.denominator * np.minimum(n, m) >= exact.numerator * np.maximum(n, m)
        return np.where(fits, -differ.astype(float), -np.inf)

    return Sketch(make=wide_simhash, screen=screen, width=8 * PRINT_WORDS, compared=8 * PRINT_WORDS)


def near_labels(prints: np.ndarray, n: np.ndarray, least: Fraction) -> np.ndarray:
    """For each fingerprint (rows of words) of a cell the first one it is joined to by pairs whose bits and sizes allow ``least``.

    In large cells some heads are compared with all others first; two members of one head need no comparing any more.
    """
    bits = 64 * prints.shape[1]
    large, small = bit_chances(least)
    most, most_small = most_bits(bits, large), most_bits(bits, small)
    most_half = most_bits(128, small)
    label = np.arange(len(n))
    first, second = np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(prints[:, 1])

    def fits(i, j):
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        differ = np.bitwise_count(prints[i] ^ prints[j]).sum(-1, dtype=np.int32)
        return (differ <= np.where(low <= FEWEST, most_small, most)) & (least.denominator * low >= least.numerator * high)

    def join(left, right, triangle=False):
        nonlocal label
        step, at = max(1, PAIRS // max(1, len(right))), 0
        while at < len(left):
            rows, others = left[at:at + step], right[at:] if triangle else right
            differ = np.bitwise_count(first[rows, None] ^ first[others])
            differ += np.bitwise_count(second[rows, None] ^ second[others])
            i, j = np.nonzero(differ <= most_half)
            if triangle:
                i, j = i[j > i], j[j > i]
            i, j = rows[i], others[j]
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            near = fits(i, j)
            if near.any():
                node, root = _forest((label[i[near]], label[j[near]]), len(n))
                to = np.arange(len(n))
                to[node] = root
                label = to[label]
            at += step

    lone, stars = np.arange(len(n)), []
    if len(n) > STARS_FROM:
        for k in range(STARS):
            if len(lone) < 2:
                break
            head = lone[k * len(lone) // STARS]
            star = lone[fits(head, lone)]  # the head is one of them
            if len(star) > 1:
                label[star] = star[0]
                stars.append(star)
                lone = lone[label[lone] == lone]
                lone = lone[lone != star[0]]
    for k, star in enumerate(stars):
        join(star, np.concatenate([*stars[k + 1:], lone]))
    join(lone, lone, triangle=True)
    return label


def near_members(nodes: DataFrame, least: float = LEAST, miss: float = MISS, cell: int = CELL, tile: int = TILE) -> DataFrame:
    """Rows (key, node) of the distinct sets (node, n, sketch) whose SimHash fingerprints come near another's: nodes of one
    key are joined by such pairs.

    A band is some bits of the fingerprint, so many that a cell (the nodes with the same bits in a band) has about ``cell``
    rows; there are as many bands as leave a pair of index ``least`` without a common cell with a chance of ``miss``. All
    fingerprints of a cell are compared inside a task; cells of more than ``tile`` rows are cut into pairs of tiles.
    """
    exact, bits, short = Fraction(str(least)), 64 * PRINT_WORDS, 8 * SHORT_WORDS
    rows = nodes.count()
    size = max(0, ceil(log2(max(1, rows) / cell)))
    large, small = (band_count(bits, size, c, miss) for c in bit_chances(exact))
    places = band_places(bits, size, small)
    words = [f"p{k}" for k in range(SHORT_WORDS)]

    def deal(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, DEALT):
                piece = batch.slice(at, DEALT)
                prints, n = _matrix(piece.column("sketch"), 8 * PRINT_WORDS), piece.column("n").to_numpy()
                row, band = np.nonzero((n[:, None] <= FEWEST) | (np.arange(len(places)) < large))
                parts = np.ascontiguousarray(prints[:, :short]).view(np.int64)[row]
                columns = [band_keys(prints, places)[row, band], piece.column("node").to_numpy()[row], n[row], *parts.T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["cell", "node", "n", *words])

    def compare(batches):
        for table, begin in _whole_cells(batches, ("cell",)):
            cells, node, n = (table.column(c).to_numpy() for c in ("cell", "node", "n"))
            prints = np.stack([table.column(c).to_numpy() for c in words], axis=1).view(np.uint64)
            keys, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(node)], strict=True):
                label = near_labels(prints[a:b], n[a:b], exact)
                joined = np.flatnonzero(np.bincount(label, minlength=b - a)[label] > 1)
                if len(joined):
                    own = cells[a:a + 1].view(np.uint64) * _MIX[0] ^ node[a:b][label[joined]].view(np.uint64)
                    keys.append((own ^ (own >> np.uint64(29))) * _MIX[1])
                    held.append(node[a:b][joined])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(held))], ["key", "node"])

    dealt = nodes.select("node", "n", "sketch").mapInArrow(deal, ", ".join(f"{c} long" for c in ["cell", "node", "n", *words]))
    if rows > tile:
        large_cells = dealt.groupBy("cell").count().filter(F.col("count") > tile).select(
            "cell", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
        tiled = dealt.join(sized_broadcast(cut(large_cells), HOLDERS), "cell", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
        own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
        met = tiled.withColumns({"own": own, "other": F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))})
        pair = F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other"))
        dealt = met.withColumn("cell", F.when(F.col("tiles") == 1, F.col("cell")).otherwise(pair)).select("cell", "node", "n", *words)
    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(compare, "key long, node long")


def keep_dissimilar(segments: DataFrame, id: str = "id", text: str = "original_text", words: int = WORDS,
                    least: float = LEAST, miss: float = MISS, cell: int = CELL) -> DataFrame:
    """One segment of each class of similar texts, that with the smallest id, with all its columns.

    Two texts are similar when the Jaccard index of their sets of shingles of ``words`` words (A-Z lower-cased, words
    are runs without ASCII white space; fewer words are one shingle) is ``least`` or more; a class is what similar texts
    join, directly or through others. Texts with one set are one class, and so are texts without words.
    Other pairs are found by SimHash fingerprints of 512 bits: texts whose fingerprints agree in all bits of a band are compared
    by exclusive-or and bit counts, and what is near enough by their whole sets. There are so many bands that a pair of
    index ``least`` shares none with a chance of ``miss``, far less above; a band has more bits, and there are more bands,
    the more texts there are (about ``cell`` of them agree in a band). No pair under ``least`` is ever linked.

    Rows of one id with different texts are judged each by its own text; of a class the row with the smallest id stays,
    then that whose id and text have the smaller MD5; of rows alike in both one stays. Segments without an id stay and
    link nothing. Ids may be of any type with an order; very long texts are read whole; no rows give no rows.
    """
    sketch = simhash_sketch(least)
    narrow = placed(segments.filter(F.col(id).isNotNull()), id, text)
    found = cut(sketched(narrow, words, sketch))
    nodes = distinct_nodes(found)
    near, _ = _counted(near_members(nodes, least, miss, cell), PART_EDGES)
    roots = similar_classes(nodes, lambda wanted: shingle_sets(texts_of(wanted, nodes, narrow), words), sketch,
                            Fraction(str(least)), members=near)
    lookup = class_of_digest(nodes, roots, F.min("node").alias("class"))
    named = found.select("digest", "id", "place").join(lookup, "digest", "left").groupBy(F.coalesce("class", F.lit(-1)).alias("class"))
    name = "place"
    while name in segments.columns:
        name += "_"
    stay = named.agg(F.min(F.struct("id", "place")).alias("row")).select(F.col("row.place").alias(name))
    known = segments.filter(F.col(id).isNotNull()).withColumn(name, place_of(id, text))
    kept = known.join(stay, name, "left_semi").dropDuplicates([name]).select(*segments.columns)
    return kept.unionByName(segments.filter(F.col(id).isNull()))
