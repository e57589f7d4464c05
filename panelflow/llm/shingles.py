"""Hashed sets of word shingles, many texts at once."""

from __future__ import annotations

import numpy as np

from panelflow.llm.buffers import IS_SPACE, LOWER, words_of

WORD_BLOCK = 1 << 16
_DRAW = np.random.default_rng(20_240).integers(0, 1 << 63, 260, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = np.where(np.arange(256) == 0x20, np.uint64(0), _DRAW[:256])  # the blank after a word adds nothing
_POWER, _STEP, _LENGTH = _DRAW[256], _DRAW[257], _DRAW[258]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _word_hashes(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial over random values of its bytes. Blocks bound the memory."""
    out = np.empty(len(begin), np.uint64)
    for a in range(0, len(begin), WORD_BLOCK):
        first, last = begin[a:a + WORD_BLOCK], end[a:a + WORD_BLOCK]
        size = last - first
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(size.max()), _POWER))))
        low = first[0]
        held = np.diff(np.concatenate((first - low, [last[-1] - low])))  # each word with what follows it
        place = np.minimum(np.arange(last[-1] - low) - np.repeat(first - low, held), np.repeat(size, held))
        out[a:a + WORD_BLOCK] = np.add.reduceat(_BYTE[text[low:last[-1]]] * powers[place], first - low) + size.astype(np.uint64) * _LENGTH
    return _mixed(out)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the distinct shingles of all rows, sorted within a row and end to end, and how many each has.

    A-Z are lower-cased; words are runs without ASCII white space; a row of fewer words is one shingle, a row without
    words none. Equal shingles have equal hashes; others differ but for chance of 64 bits.
    """
    space = IS_SPACE[data]
    text = LOWER[np.where(space, np.uint8(0x20), data)]
    begin, end, first = words_of(text, offsets)
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - words + 1, 1), 0)
    if not n.sum():
        return np.zeros(0, np.uint64), n
    hashed = _word_hashes(text, begin, end)
    at = np.concatenate(([0], np.cumsum(n)))
    row = np.repeat(np.arange(len(n)), n)
    word = first[:-1][row] + np.arange(at[-1]) - at[:-1][row]
    after = first[1:][row]
    out = hashed[word]
    for k in range(1, words):
        inside = word + k < after
        out = np.where(inside, _mixed(out * _STEP + hashed[np.minimum(word + k, len(hashed) - 1)]), out)
    sets = [np.unique(x) for x in np.split(out, at[1:-1])]
    return np.concatenate(sets), np.array([len(x) for x in sets], np.int64)
