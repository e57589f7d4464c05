"""Languages of words in code-switched text by a linear-chain conditional random field."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelflow.llm.buffers import IS_SPACE, LOWER, text_slices, words_of
from panelflow.operators.skew import first_rows

ROWS_PER_LANGUAGE = 250
UNKNOWN = "und"
BUCKETS = 1 << 18
GRAMS = (2, 3, 4)
EDGE = 1  # sign before and after a word; n-grams with it are the word's affixes
LEXICON = 200
CHAIN = 256
ROUNDS = 30
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(0x80, 0x100)]] = True
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n\r"]] = True


def _letters(data: np.ndarray) -> np.ndarray:
    """True for bytes of letters: ASCII letters and characters outside ASCII but Latin-1 signs, general and CJK
    punctuation and symbols, and pictographs."""
    kept = _LETTER[data]
    if len(data) and (data >= 0xC2).any():
        after = np.concatenate((data[1:], [0, 0, 0])).astype(np.uint8)
        two = (data == 0xC2) & (after[:len(data)] != 0xAA) & (after[:len(data)] != 0xB5) & (after[:len(data)] != 0xBA)
        three = ((data == 0xE2) & (after[:len(data)] < 0xB0)) | ((data == 0xE3) & (after[:len(data)] == 0x80)) | (
            (data == 0xEF) & (after[:len(data)] >= 0xB8) & (after[:len(data)] <= 0xBC))
        four = (data == 0xF0) & (after[:len(data)] == 0x9F)
        kept = kept.copy()
        for lead, width in ((two, 2), (three, 3), (four, 4)):
            at = np.flatnonzero(lead)
            for k in range(width):
                kept[np.minimum(at + k, len(data) - 1)] = False
    return kept


class Words:
    """Words with letters of a flat buffer: their letters, rows and chains (sentences of at most CHAIN words)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = LOWER[data]
        letter = _letters(low)
        begin, end, first = words_of(data, offsets)
        count = np.concatenate(([0], np.cumsum(letter)))
        size = count[end] - count[begin]
        use = np.flatnonzero(size > 0)
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        stops = np.concatenate(([0], np.cumsum(_ENDS[data])))
        self.row, self.number = row[use], use - first[row[use]]
        self.at = np.concatenate(([0], np.cumsum(size[use])))
        self.bytes = low[letter & ~IS_SPACE[data]] if len(data) else low
        # A sentence ends with a mark or line break anywhere between two words' beginnings.
        if len(use):
            new = np.concatenate(([True], (stops[begin[use[1:]]] > stops[begin[use[:-1]]]) | (self.row[1:] != self.row[:-1])))
            lead = np.flatnonzero(new)
            place = np.arange(len(use)) - np.repeat(lead, np.diff(np.concatenate((lead, [len(use)]))))
            self.chain = np.concatenate((np.flatnonzero(new | (place % CHAIN == 0)), [len(use)]))
        else:
            self.chain = np.zeros(1, np.int64)
        place = (np.arange(len(self.bytes)) - np.repeat(self.at[:-1], np.diff(self.at))).astype(np.uint64)
        mixed = ((self.bytes.astype(np.uint64) + np.uint64(1)) * _MIX[0]) ^ ((place * np.uint64(2) + np.uint64(1)) * _MIX[1])
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)))
        self.key = total[self.at[1:]] - total[self.at[:-1]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys of distinct words, letters of each between EDGE signs, where each begins, and each word's number."""
        key, which, back = np.unique(self.key, return_index=True, return_inverse=True)
        n = self.at[which + 1] - self.at[which]
        at = np.concatenate(([0], np.cumsum(n + 2)))
        out = np.full(at[-1], EDGE, np.uint8)
        inner = np.arange(n.sum()) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
        out[np.repeat(at[:-1] + 1, n) + inner] = self.bytes[np.repeat(self.at[which], n) + inner]
        return key, out, at, back


def _gram_features(letters: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and the words, in word order."""
    word = np.repeat(np.arange(len(at) - 1), np.diff(at))
    buckets, words = [], []
    wide = letters.astype(np.uint64)
    for n in GRAMS:
        k = np.arange(max(len(letters) - n + 1, 0))
        k = k[word[k] == word[k + n - 1]]
        code = np.full(len(k), n, np.uint64)
        for a in range(n):
            code = (code << np.uint64(8)) | wide[k + a]
        buckets.append(((code * _MIX[0]) >> np.uint64(64 - 18)).astype(np.int32))
        words.append(word[k])
    buckets, words = np.concatenate(buckets), np.concatenate(words)
    order = np.argsort(words, kind="stable")
    return buckets[order], words[order]


class Field:
    """Weights of the field: of n-gram buckets, of lexicons, and of moving from one language to another."""

    def __init__(self, languages: list[str], lexicon_keys: np.ndarray, lexicon_of: np.ndarray):
        self.languages = languages
        n = len(languages)
        self.grams = np.zeros((BUCKETS, n), np.float32)
        self.words = np.zeros((n, n), np.float32)  # a word of one language's lexicon, by label
        self.moves = np.zeros((n, n))
        self.lexicon_keys, self.lexicon_of = lexicon_keys, lexicon_of

    def lexicon(self, key: np.ndarray) -> np.ndarray:
        """Language whose lexicon has the word, or -1."""
        if not len(self.lexicon_keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.lexicon_keys, key), len(self.lexicon_keys) - 1)
        return np.where(self.lexicon_keys[at] == key, self.lexicon_of[at], -1)

    def emissions(self, key: np.ndarray, letters: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((len(key), len(self.languages)))
        for some in range(0, len(key), 8192):
            here = at[some:some + 8193]
            bucket, word = _gram_features(letters[here[0]:here[-1]], here - here[0])
            if len(bucket):
                full, first = np.unique(word, return_index=True)
                out[some + full] = np.add.reduceat(self.grams[bucket], first, axis=0)
        own = self.lexicon(key)
        out[own >= 0] += self.words[own[own >= 0]]
        return out

    def marginals(self, emission: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chance of every label of every word, and the expected moves, by forward-backward over all chains at once."""
        n, size = emission.shape
        scores = np.exp(emission - emission.max(1, keepdims=True)) if n else emission
        move = np.exp(self.moves - self.moves.max())
        length = np.diff(chain)
        order = np.argsort(-length, kind="stable")
        begin, length = chain[:-1][order], length[order]
        forward, backward = np.empty_like(scores), np.empty_like(scores)
        steps = int(length[0]) if len(length) else 0
        active = np.searchsorted(-length, -np.arange(steps), "left")  # chains longer than the step
        for t in range(steps):
            at = begin[:active[t]] + t
            f = scores[at] if t == 0 else (forward[at - 1] @ move) * scores[at]
            forward[at] = f / f.sum(1, keepdims=True)
        expected = np.zeros((size, size))
        for t in range(steps - 1, -1, -1):
            at = begin[:active[t]] + t
            b = np.ones((len(at), size))
            more = active[t + 1] if t + 1 < steps else 0
            if more:
                after = scores[at[:more] + 1] * backward[at[:more] + 1]
                pair = forward[at[:more]][:, :, None] * move[None] * after[:, None, :]
                expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                b[:more] = after @ move.T
            backward[at] = b / b.sum(1, keepdims=True)
        p = forward * backward
        return p / np.maximum(p.sum(1, keepdims=True), 1e-300), expected


def fit(texts: list[str], labels: list[str], rounds: int = ROUNDS, rate: float = 0.4, ridge: float = 1e-6) -> Field:
    """Fit the field on whole texts with one label each.

    First the words alone learn their text's language, without moves. Their forward-backward labels, with a mild cost
    of moving, then name the words of switched passages, and the field with its moves is fitted to these labels.
    """
    languages = sorted(set(labels))
    raw = [t.encode() for t in texts]
    words = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64))
    key, letters, at, back = words.distinct()
    truth = np.array([languages.index(x) for x in labels], np.int64)[words.row] if len(labels) else np.zeros(0, np.int64)
    n, size = len(key), len(languages)
    counts = np.zeros((n, size))
    np.add.at(counts, (back, truth), 1)
    # Lexicons: the commonest words that belong to one language in nine of ten cases.
    main = counts.argmax(1) if n else np.zeros(0, np.int64)
    sure = counts.max(1) >= 0.9 * counts.sum(1) if n else np.zeros(0, bool)
    chosen = [np.flatnonzero(sure & (main == k))[np.argsort(-counts[sure & (main == k), k], kind="stable")[:LEXICON]] for k in range(size)]
    chosen = np.sort(np.concatenate(chosen)) if size else np.zeros(0, np.int64)
    field = Field(languages, key[chosen], main[chosen])
    bucket, word = _gram_features(letters, at)
    own = field.lexicon(key)
    squares = [np.full_like(x, 1e-8, dtype=float) for x in (field.grams, field.words, field.moves)]

    def step(weights: np.ndarray, gradient: np.ndarray, square: np.ndarray) -> None:
        square += gradient * gradient
        weights -= (rate * gradient / np.sqrt(square)).astype(weights.dtype)

    def descend(target: np.ndarray, moves: bool) -> None:
        pairs = np.zeros((size, size))
        inner = np.ones(len(target), bool)
        inner[words.chain[:-1]] = False
        follow = np.flatnonzero(inner)
        np.add.at(pairs, (target[follow - 1], target[follow]), 1)
        for _ in range(rounds):
            p, expected = field.marginals(field.emissions(key, letters, at)[back], words.chain)
            p[np.arange(len(target)), target] -= 1
            slope = np.stack([np.bincount(back, p[:, k], minlength=n) for k in range(size)], axis=1) / len(target)
            grams = np.stack([np.bincount(bucket, slope[word, k], minlength=BUCKETS) for k in range(size)], axis=1)
            step(field.grams, grams + ridge * field.grams, squares[0])
            in_lexicon = np.zeros((size, size))
            np.add.at(in_lexicon, own[own >= 0], slope[own >= 0])
            step(field.words, in_lexicon + ridge * field.words, squares[1])
            if moves:
                step(field.moves, (expected - pairs) / len(target) + ridge * field.moves, squares[2])

    if len(truth) and size > 1:
        descend(truth, False)
        field.moves = np.eye(size) * 2.0
        p, _ = field.marginals(field.emissions(key, letters, at)[back], words.chain)
        descend(p.argmax(1), True)
    return field


def label_languages(segments: DataFrame, learn: Column | None = None, id: str = "id", text: str = "original_text",
                    language: str = "source_language", rows_per_language: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """Language of every segment's text and of its words: (id, language, score double, words long, runs).

    A conditional random field labels each word with letters: features are its byte n-grams (with the word's edges,
    so affixes are among them) and the lexicons of frequent words, and moves between languages are learned. It is
    fitted on at most ``rows_per_language`` whole texts of each value of the segments' ``language`` where ``learn``
    holds (all rows by default), those with the smallest hash of their text; a documented bound. Chains are sentences,
    and longer ones are cut every CHAIN words. A text's language is the one with the largest sum of word chances, and
    score is its share of that sum. runs lists (first word, words, language) of neighbouring words of one language,
    words without letters left out.

    Null texts and those without a letter get language ``und``, score 0 and no runs; so does every text when no row
    teaches. Rows with a null language teach nothing; texts of one language only give that language. Repeated rows
    and null ids are labelled row by row; other columns are ignored; no rows give no rows.
    """
    rows = segments.select(F.col(id).alias("id"), F.col(text).alias("text"))
    known = segments.filter(F.lit(True) if learn is None else learn).select(
        F.col(text).alias("text"), F.col(language).alias("language")).dropna()
    # The hash of a text stands for it until the rows are chosen; copies of a text teach once.
    hashed = known.select("language", F.xxhash64("text").alias("h")).distinct()
    picked = first_rows(hashed, ["language"], [F.col("h")], rows_per_language)
    found = known.withColumn("h", F.xxhash64("text")).join(F.broadcast(picked), ["language", "h"]).dropDuplicates(["language", "h"]) \
        .select("language", "text", "h").orderBy("language", "h").collect()  # rows_per_language whole texts a language
    field = fit([r["text"] for r in found], [r["language"] for r in found])
    names = [*field.languages, UNKNOWN]

    def run(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            words = Words(data, offsets)
            n, size = batch.num_rows, len(field.languages)
            total = np.zeros((n, size))
            best, share = np.full(n, size), np.zeros(n)
            label = np.zeros(0, np.int64)
            if len(words.row) and size:
                key, letters, at, back = words.distinct()
                p, _ = field.marginals(field.emissions(key, letters, at)[back], words.chain)
                first = np.flatnonzero(np.concatenate(([True], words.row[1:] != words.row[:-1])))
                total[words.row[first]] = np.add.reduceat(p, first, axis=0)
                seen = words.row[first]
                best[seen], share[seen] = total[seen].argmax(1), total[seen].max(1) / total[seen].sum(1)
                label = p.argmax(1)
            held = words.row[:len(label)]
            opens = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (held[1:] != held[:-1])))) if len(label) else label
            length = np.diff(np.concatenate((opens, [len(label)])))
            runs = pa.StructArray.from_arrays(
                [pa.array(words.number[opens]), pa.array(length), pa.array(names).take(pa.array(label[opens]))],
                ["first_word", "words", "language"])
            at = np.searchsorted(held[opens], np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(names).take(pa.array(best)), pa.array(share),
                 pa.array(np.bincount(held, minlength=n)), pa.ListArray.from_arrays(pa.array(at), runs)],
                ["id", "language", "score", "words", "runs"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, language string, score double, words long, "
                                "runs array<struct<first_word:long,words:long,language:string>>")
