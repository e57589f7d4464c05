"""Near-duplicate texts by SetSketch registers: banded, estimated jointly by likelihood, confirmed on whole sets."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.similar import Sketch, class_of_digest, distinct_nodes, placed, shingle_sets, similar_classes, sketched, texts_of
from panelflow.session import cut

WORDS = 5
LEAST = 0.85
BANDS = 48
BAND_ROWS = 8
BASE = 1.08
RATE = 20.0
LIMIT = 255
# Half the square of six standard deviations: how much less likely the wanted index may be than the best one.
DOUBT = 18.0
SEED = 42
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def registers(hashes: np.ndarray, first: np.ndarray, count: int, base: float = BASE, rate: float = RATE) -> np.ndarray:
    """SetSketch registers (uint8) of the sets that begin at ``first``, none empty.

    Register i of a set is max over its members of floor(1 - log_base(x)), cut to 0..255, with x exponential of the
    given rate, drawn from the member and i. So it keeps the least x on an exponential scale; the union of two sets has
    the larger of their registers.
    """
    draw = np.random.default_rng(SEED).integers(0, 1 << 32, (2, count), np.uint32)
    small = ((hashes >> np.uint64(32)) ^ hashes).astype(np.uint32)
    out = np.empty((len(first), count), np.uint8)
    drawn = np.empty_like(small)
    for k in range(count):
        np.bitwise_xor(small, draw[0, k], out=drawn)
        np.multiply(drawn, draw[1, k] | np.uint32(1), out=drawn)
        least = np.minimum.reduceat(drawn, first)
        x = -np.log1p(-(least + 0.5) / 2.0 ** 32) / rate
        out[:, k] = np.clip(np.floor(1 - np.log(x) / np.log(base)), 0, LIMIT)
    return out


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(x, y)


def band_keys(rows: np.ndarray, bands: int, size: int) -> np.ndarray:
    """A key for each band of ``size`` registers."""
    out = np.empty((len(rows), bands), np.uint64)
    for band in range(bands):
        key = np.full(len(rows), band + 1, np.uint64)
        for k in range(band * size, band * size + size):
            key = (key ^ rows[:, k]) * _MIX[0]
            key ^= key >> np.uint64(29)
        out[:, band] = key * _MIX[1]
    return out


def _likelihood(j: np.ndarray, u: np.ndarray, equal: np.ndarray, more: np.ndarray, less: np.ndarray, base: float) -> np.ndarray:
    """Logarithm of the likelihood of Jaccard index j; u is the first set's share of the sum of both sizes."""
    def p(x):
        return -np.log1p(-np.maximum(x, 1e-12) * (base - 1) / base) / np.log(base)

    a, b = p(u - (1 - u) * j), p((1 - u) - u * j)
    return more * np.log(a) + less * np.log(b) + equal * np.log(np.maximum(1 - a - b, 1e-12))


def estimate(equal: np.ndarray, more: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray,
             base: float = BASE, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest Jaccard index of sets of n and m members, and how much likelier (logarithm) it is than ``least``.

    equal, more, less: in how many registers the first set's value equals, is above, is below the second's. The index
    is sought by golden section, as the likelihood has one peak.
    """
    u = n / (n + m)
    low, high = np.zeros(len(u)), np.minimum(n, m) / np.maximum(n, m)
    wanted = np.minimum(least, high)
    ratio = (5 ** 0.5 - 1) / 2
    for _ in range(30):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        right = _likelihood(a, u, equal, more, less, base) < _likelihood(b, u, equal, more, less, base)
        low, high = np.where(right, a, low), np.where(right, high, b)
    best = (low + high) / 2
    return best, _likelihood(best, u, equal, more, less, base) - _likelihood(wanted, u, equal, more, less, base)


def set_sketch(least: float = LEAST, bands: int = BANDS, rows: int = BAND_ROWS, base: float = BASE) -> Sketch:
    """Registers as a sketch whose screen refuses pairs that are far likelier under an index below ``least``."""
    count, exact = bands * rows, Fraction(str(least))
    fewest = count * least - 6 * (count * least * (1 - least)) ** 0.5

    def screen(x, n, y, m):
        # A register is equal with a chance of no less than the index, so fewer equal ones are out at once.
        equal = (x == y).sum(-1, dtype=np.int32)
        n, m = np.broadcast_arrays(n, m)
        fits = (equal >= fewest) & (exact.denominator * np.minimum(n, m) >= exact.numerator * np.maximum(n, m))
        at = np.nonzero(fits)
        score = np.full(equal.shape, -np.inf)
        if len(at[0]):
            both = np.broadcast_shapes(x.shape, y.shape)
            more = (np.broadcast_to(x, both)[at] > np.broadcast_to(y, both)[at]).sum(-1)
            best, doubt = estimate(equal[at], more, count - equal[at] - more, n[at].astype(float), m[at].astype(float), base, least)
            score[at] = np.where((best >= least) | (doubt <= DOUBT), best, -np.inf)
        return score

    return Sketch(make=lambda hashes, first: registers(hashes, first, count, base), keys=lambda x: band_keys(x, bands, rows),
                  screen=screen, width=count, compared=count)


def similar_segments(segments: DataFrame, id: str = "id", text: str = "original_text", words: int = WORDS,
                     least: float = LEAST, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """Every segment with the size of its shingle set and its class: (id, n_shingles long, component_id).

    Runs on the library's segments; other tables by column names. A-Z are lower-cased; words are runs without ASCII
    white space; the set holds the distinct shingles of ``words`` words, or the whole sequence of a text with fewer.
    Segments are linked when the Jaccard index of their sets is ``least`` or more; component_id is the smallest id
    that links reach, the segment's own included.

    Each set becomes ``bands`` times ``rows`` SetSketch registers (exponentially spaced, truncated minima of one byte).
    Sets whose registers agree in all ``rows`` places of a band are candidates, screened by the likelihood of their
    index given all registers and both sizes, and confirmed on whole sets. With the defaults a pair of index 0.85 shares no
    band with a chance of 2.4 in ten million, and is refused by the screen with one of about one in a thousand million.
    No pair under ``least`` is ever linked.

    Equal sets are one node, so copies cost one row each. Null texts and texts without words have 0 shingles, link with
    nothing and are their own component. A null id takes no part in the minimum (a class of null ids only has a null
    component_id); repeated rows are kept, also one id with several texts, each with its own text's class; ids may be
    of any type with an order; very long texts are read whole; other columns are ignored; no rows give no rows.
    """
    sketch = set_sketch(least, bands, rows)
    narrow = placed(segments, id, text)
    found = cut(sketched(narrow, words, sketch))
    nodes = distinct_nodes(found)
    roots = similar_classes(nodes, lambda wanted: shingle_sets(texts_of(wanted, nodes, narrow), words), sketch, Fraction(str(least)))
    lookup = class_of_digest(nodes, roots, F.min("first").alias("component_id"))
    out = found.filter("n > 0").select("id", "n", "digest").join(lookup, "digest").select(
        "id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(found.filter("n = 0").select("id", F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))
