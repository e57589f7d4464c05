"""Toxic texts by a subsequence string kernel, Nyström landmarks and a support vector machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.buffers import IS_SPACE, LOWER, text_slices, words_of

CUT = 0.7
DECAY = 0.6
GAPS = ((1, 1), (1, 2), (2, 1), (1, 3), (3, 1), (2, 2))  # steps between the three letters of a subsequence
POWER = 2
LANDMARKS = 64
ROWS_PER_LABEL = 10_000
EVIDENCE = 2_000
LETTERS = 29  # none, a to z, any other letter, start of a unit
START, OTHER = 28, 27
_LETTER = np.zeros(256, np.int64)
_LETTER[[*range(97, 123)]] = np.arange(1, 27)
_LETTER[0xC3:0xF5] = OTHER  # first byte of a letter outside ASCII; its other bytes add nothing
# Digits and signs written in place of letters.
for _sign, _stands_for in zip("01345@$", "oieasas", strict=True):
    _LETTER[ord(_sign)] = _LETTER[ord(_stands_for)]
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?\n\r"]] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class Units:
    """The letters of a buffer's units: words without marks, and spelled-out runs of single letters.

    Inserted signs fall away here ("i.d.i.o.t", "i d i o t", "1d10t"), inserted letters in the kernel's gaps.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        begin, end, first = words_of(data, offsets)
        low = LOWER[data]
        code = _LETTER[low]
        digit = (low >= 48) & (low <= 57)
        pure = np.concatenate(([0], np.cumsum((code > 0) & ~digit)))
        word_of = np.repeat(np.arange(len(begin)), end - begin)
        inside = np.flatnonzero(~IS_SPACE[data]) if len(data) else np.zeros(0, np.int64)
        code = code[inside]
        code[(pure[end] - pure[begin])[word_of] == 0] = 0  # numbers are not words
        count = np.concatenate(([0], np.cumsum(code > 0)))
        at = np.concatenate(([0], np.cumsum(end - begin)))
        size = count[at[1:]] - count[at[:-1]]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        short = size <= 1
        joined = np.zeros(len(begin), bool)
        if len(begin) > 1:
            joined[1:] = short[1:] & short[:-1] & (row[1:] == row[:-1])
        unit = np.cumsum(~joined) - 1
        kept = code > 0
        lead = np.flatnonzero(~joined)
        self.row, self.word = row[lead], lead
        owner = unit[word_of[kept]]
        self.letters = code[kept].astype(np.int32)
        self.first = np.searchsorted(owner, np.arange(len(lead) + 1))
        place = (np.arange(len(owner)) - self.first[owner]).astype(np.uint64)
        mixed = (self.letters.astype(np.uint64) * _MIX[0]) ^ ((place * np.uint64(2) + np.uint64(1)) * _MIX[1])
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)))
        self.key = total[self.first[1:]] - total[self.first[:-1]]
        self.begin, self.end = begin, end

    def spelled(self, data: np.ndarray, which: np.ndarray) -> list[str]:
        """Some units as they stand in the text, lower-cased."""
        raw, last = data.tobytes(), np.concatenate((self.word[1:], [len(self.begin)]))
        return [raw[self.begin[self.word[u]]:self.end[last[u] - 1]].decode("utf-8", "replace").lower() for u in which.tolist()]

    def pick(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Letters of some units end to end, each after a start sign, and where each begins."""
        n = self.first[which + 1] - self.first[which]
        at = np.concatenate(([0], np.cumsum(n + 1)))
        out = np.full(at[-1], START, np.int32)
        source = np.repeat(self.first[which] - np.concatenate(([0], np.cumsum(n)))[:-1], n) + np.arange(n.sum())
        out[np.repeat(np.arange(len(which)) + 1, n) + np.arange(n.sum())] = self.letters[source]
        return out, at


def subsequences(letters: np.ndarray, at: np.ndarray):
    """(unit, subsequence number, weight) for three letters with gaps; the weight decays with the span."""
    unit = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for a, b in GAPS:
        k = np.arange(len(letters) - a - b)
        k = k[unit[k] == unit[k + a + b]]
        yield unit[k], (letters[k] * LETTERS + letters[k + a]) * LETTERS + letters[k + a + b], DECAY ** (a + b - 2)


def _norms(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Length of each unit's weights, counting every place once: the kernel is divided by it."""
    n, total = np.diff(at), 0
    for a, b in GAPS:
        total = total + np.maximum(n - a - b, 0) * DECAY ** (2 * (a + b - 2))
    return np.sqrt(np.maximum(total, 1e-9))


def _profiles(letters: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Normed weights of all subsequences, one row per unit; for landmarks."""
    out = np.zeros((len(at) - 1, LETTERS ** 3), np.float32)
    for unit, code, weight in subsequences(letters, at):
        np.add.at(out, (unit, code), np.float32(weight))
    return out / _norms(letters, at)[:, None].astype(np.float32)


def kernel(letters: np.ndarray, at: np.ndarray, profiles: np.ndarray) -> np.ndarray:
    """Normed gapped-subsequence kernel between units and landmarks, to the POWERth power."""
    rows, n = np.ascontiguousarray(profiles.T), np.diff(at)
    order = np.argsort(-n, kind="stable")  # longest first: units with a subsequence at a place come first
    out = np.zeros((len(n), len(profiles)), np.float32)
    for some in range(0, len(n), 4096):
        here = order[some:some + 4096]
        begin, size, sums = at[:-1][here], -n[here], out[some:some + len(here)]
        for a, b in GAPS:
            weight = np.float32(DECAY ** (a + b - 2))
            for k in range(max(-size[0] - a - b, 0)):
                x = begin[:np.searchsorted(size, -k - a - b, "left")] + k
                sums[:len(x)] += weight * rows[(letters[x] * LETTERS + letters[x + a]) * LETTERS + letters[x + a + b]]
    placed = np.empty_like(out)
    placed[order] = out
    return (placed.astype(float) / _norms(letters, at)[:, None]) ** POWER


class Model:
    """Weights of the machine over landmarks, the screen that spares unlike units, and the scale of scores."""

    def __init__(self, profiles: np.ndarray, toxic: int, weight: np.ndarray, bias: float):
        self.profiles, self.weight, self.bias = profiles, weight, bias
        self.cut, self.scale, self.masked = 0.0, 2.0, np.inf
        # An upper bound of the kernel to any toxic landmark: units below FLOOR share too little with all of them.
        self.best = profiles[:toxic].max(0) if toxic else np.zeros(LETTERS ** 3, np.float32)

    FLOOR = 0.25

    def margins(self, units: Units) -> np.ndarray:
        """Margin of every unit; the bias alone for units that share too little with every toxic landmark."""
        _, which, back = np.unique(units.key, return_index=True, return_inverse=True)
        out = np.full(len(which), min(self.bias, -1.0))
        letters, at = units.pick(which)
        bound = np.zeros(len(which))
        for unit, code, weight in subsequences(letters, at):
            bound += weight * np.bincount(unit, self.best[code], minlength=len(which))
        close = np.flatnonzero(bound / _norms(letters, at) >= self.FLOOR)
        if len(close):
            out[close] = kernel(*units.pick(which[close]), self.profiles) @ self.weight + self.bias
        return out[back]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Largest margin of any unit of each text."""
        units = Units(data, offsets)
        out = np.full(len(offsets) - 1, min(self.bias, -1.0))
        if len(units.key):
            np.maximum.at(out, units.row, self.margins(units))
        return out

    def score(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (margin - self.cut) + np.log(CUT / (1 - CUT)), -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, c: float = 100.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge, by Newton steps; the two classes weigh the same."""
    x = np.hstack((x, np.ones((len(x), 1))))
    weigh = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)) * c
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w)) * 1e-2
    for _ in range(50):
        active = y * (x @ w) < 1
        h = ridge + (x[active] * weigh[active, None]).T @ x[active]
        new = np.linalg.solve(h, (x[active] * weigh[active, None]).T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w[:-1], float(w[-1])


def disguised(units: list[str], most: int = 4_000) -> list[str]:
    """Units with one foreign letter between two of theirs, as written to slip past a word list."""
    out = [u[:k] + "xqvwjz"[(k + n) % 6] + u[k:] for n, u in enumerate(units) for k in range(2, len(u) - 1)]
    return out[:most]


def fit(toxic: list[str], clean: list[str], landmarks: int = LANDMARKS) -> Model:
    """Fit the machine on units of toxic and of clean sentences; ``disguised`` toxic units count as toxic.

    Three quarters of the landmarks are toxic units, each the one least like those before it; the rest are the clean
    units most like a toxic one. Kernel rows are whitened by the landmarks' own kernel (Nyström), and the machine is
    linear in the result.
    """
    def lay_out(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = "\n".join(units).encode()
        u = Units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        keep = np.flatnonzero(u.first[1:] - u.first[:-1] > 1)
        keep = keep[np.sort(np.unique(u.key[keep], return_index=True)[1])]
        return u.pick(keep)

    def choose(part: tuple[np.ndarray, np.ndarray], rows: np.ndarray) -> np.ndarray:
        letters, at = part
        return np.stack([_profiles(letters[at[r]:at[r + 1]], np.array([0, at[r + 1] - at[r]]))[0] for r in rows])

    good, bad, masked = lay_out(clean), lay_out(toxic), lay_out(disguised(toxic))
    picked, near = [0], None
    while len(picked) < min(len(bad[1]) - 1, 3 * landmarks // 4):
        k = kernel(*bad, choose(bad, [picked[-1]]))[:, 0]
        near = k if near is None else np.maximum(near, k)
        nxt = int(np.argmin(near))
        if near[nxt] > 0.9:
            break
        picked.append(nxt)
    profiles = choose(bad, picked)
    hard = np.argsort(-kernel(*good, profiles).max(1), kind="stable")[:landmarks - len(picked)]
    if len(hard):
        profiles = np.concatenate((profiles, choose(good, hard)))
    own = (profiles.astype(float) @ profiles.T.astype(float)) ** POWER
    value, vector = np.linalg.eigh(own)
    use = value > 1e-6 * value.max()
    white = vector[:, use] / np.sqrt(value[use])
    x = np.concatenate([kernel(*part, profiles) for part in (bad, masked, good)]) @ white
    n = len(good[1]) - 1
    w, bias = _svm(x, np.concatenate((np.ones(len(x) - n), -np.ones(n))))
    model = Model(profiles, len(picked), white @ w, bias)
    if len(masked[1]) > 1:
        model.masked = float(np.quantile(kernel(*masked, profiles) @ model.weight + bias, 0.05))
    return model


def _grams(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the five-letter strings of every unit (start sign included), with the unit of each."""
    letters, at = units.pick(np.arange(len(units.key)))
    unit = np.repeat(np.arange(len(at) - 1), np.diff(at))
    k = np.arange(max(len(letters) - 4, 0))
    k = k[unit[k] == unit[k + 4]]
    code = np.zeros(len(k), np.int64)
    for a in range(5):
        code = code * LETTERS + letters[k + a]
    return code, unit[k]


def rate_toxicity(segments: DataFrame, labels: DataFrame, id: str = "id", text: str = "translated_text",
                  label: str = "toxic", rows_per_label: int = ROWS_PER_LABEL) -> DataFrame:
    """Toxicity of every segment's text: (id, margin double, score double, predicted int).

    ``labels`` (id, toxic 0/1) mark whole segments; at most ``rows_per_label`` segments of each label (smallest hash of
    the id; a documented bound) are cut into distinct sentences, each labelled clean if any clean segment has it. Five-letter
    strings that toxic sentences have far more often than chance and clean ones do not are the evidence; the units
    that hold them are the positive examples, units of clean sentences the negative ones, first common and random ones,
    then those the first machine mistakes most. A text's margin is the largest
    of its units' and the whole text is read. score is in 0..1; 0.7, where predicted becomes 1, lies between the
    labelled segments' margins (or where fewest of them fall on the wrong side), below most disguised units if it can.

    Limits: letters outside ASCII are all one letter, so words in Cyrillic, Greek, kana, Hangul or Han differ only by
    length, give no evidence and are not told apart whatever the labels say. Words under four letters have no
    five-letter string (the sign of a unit's start counts as one) and are never learned.

    Null and empty texts have the lowest margin. Rows with a null label or id teach nothing; of several labels of one
    id the largest holds; without evidence every text has the lowest margin. Repeated rows and null ids are scored row
    by row; other columns are ignored; no rows give no rows.
    """
    taught = labels.select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).dropna().groupBy("id").agg(
        F.max("label").alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    taught = taught.filter("label = 1").orderBy(*order).limit(rows_per_label).unionByName(
        taught.filter("label = 0").orderBy(*order).limit(rows_per_label))
    rows = segments.select(F.col(id).alias("id"), F.col(text).alias("text"))
    sample = rows.join(F.broadcast(taught), "id").select("text", "label")  # at most two times rows_per_label ids are sent

    # Distinct sentences of the sample, so that copies of a text count once.
    def sentences(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            inside = ~_ENDS[data]
            edge = np.zeros(len(data) + 1, bool)
            edge[offsets] = True
            begin = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
            end = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
            raw, row = data.tobytes(), np.searchsorted(offsets, begin, "right") - 1
            label = batch.column("label").to_numpy()[row]
            lines = [raw[a:b].decode("utf-8", "replace") for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array(label)], ["text", "label"])

    lines = sample.mapInArrow(sentences, "text string, label int").groupBy("text").agg(F.min("label").alias("label"))

    def count_grams(batches):
        for batch, data, offsets in text_slices(batches, "text", 8 << 20):
            units = Units(data, offsets)
            code, unit = _grams(units)
            row = units.row[unit] if len(unit) else unit
            pairs = np.unique(row * LETTERS ** 5 + code)  # once per sentence
            code, bad = pairs % LETTERS ** 5, batch.column("label").to_numpy()[pairs // LETTERS ** 5] == 1
            names, at = np.unique(code, return_inverse=True)
            n_bad = np.bincount(at, bad, minlength=len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n_bad), pa.array(np.bincount(at, minlength=len(names)) - n_bad)],
                                             ["gram", "bad", "good"])

    grams = lines.mapInArrow(count_grams, "gram long, bad long, good long").groupBy("gram").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    both = lines.agg(F.sum("label").alias("bad"), F.count("*").alias("all")).first()
    share = min(max((both["bad"] or 0) / max(both["all"], 1), 1e-3), 0.9)
    # By chance, fewer than one string in the whole sample would be this one-sided.
    evidence = grams.filter((F.col("good") <= F.col("bad") * 0.01) & (
        F.col("bad") * float(-np.log(share)) > F.log(F.lit(1e3 * (both["all"] or 1)))))
    found = np.array([r["gram"] for r in evidence.orderBy(F.desc("bad"), "gram").limit(EVIDENCE).collect()], np.int64)
    found.sort()
    lowest = Model(np.zeros((1, LETTERS ** 3), np.float32), 0, np.zeros(1), -1.0)
    lowest.cut = 1.0

    def examples(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            units = Units(data, offsets)
            code, unit = _grams(units)
            shows = np.zeros(len(units.key), bool)
            if len(found) and len(code):
                shows[unit[found[np.minimum(np.searchsorted(found, code), len(found) - 1)] == code]] = True
            bad = batch.column("label").to_numpy()[units.row] == 1
            pick = np.flatnonzero((bad & shows) | (~bad & ~shows))
            _, at, n = np.unique(units.key[pick], return_index=True, return_counts=True)
            pick = pick[at]
            yield pa.RecordBatch.from_arrays([pa.array(units.spelled(data, pick), pa.string()), pa.array(bad[pick].astype(np.int32)), pa.array(n)], ["unit", "bad", "n"])

    model = lowest
    if len(found):
        seen = lines.mapInArrow(examples, "unit string, bad int, n long").groupBy("unit", "bad").agg(F.sum("n").alias("n"))
        bad = [r["unit"] for r in seen.filter("bad = 1").orderBy(F.desc("n"), "unit").limit(2000).collect()]
        usual = [r["unit"] for r in seen.filter("bad = 0").orderBy(F.desc("n"), "unit").limit(3000).collect()]
        other = [r["unit"] for r in seen.filter("bad = 0").orderBy(F.xxhash64("unit"), "unit").limit(9000).collect()]
        if bad and usual:
            first = fit(bad, list(dict.fromkeys(usual + other)))

            def mistakable(batches):
                for batch, data, offsets in text_slices(batches, "text"):
                    units = Units(data, offsets)
                    margin = first.margins(units)
                    pick = np.flatnonzero(margin > first.bias / 2)
                    _, at = np.unique(units.key[pick], return_index=True)
                    pick = pick[at]
                    yield pa.RecordBatch.from_arrays([pa.array(units.spelled(data, pick), pa.string()), pa.array(margin[pick])], ["unit", "margin"])

            # The clean units most like toxic ones, from all clean sentences of the sample, are learned in a second round.
            hard = lines.filter("label = 0").mapInArrow(mistakable, "unit string, margin double").distinct()
            hard = [r["unit"] for r in hard.orderBy(F.desc("margin"), "unit").limit(3000).collect()]
            model = fit(bad, list(dict.fromkeys(hard + usual + other)))
            margin_of = model.texts

            def measure(batches):
                for batch, data, offsets in text_slices(batches, "text"):
                    yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(margin_of(data, offsets))], ["label", "margin"])

            known = sample.mapInArrow(measure, "label int, margin double").toPandas()  # a label and a number per sampled row
            calibrate(model, known["margin"].to_numpy(), known["label"].to_numpy() == 1)

    def score(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            margin = model.texts(data, offsets)
            p = model.score(margin)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(margin), pa.array(p), pa.array((p >= CUT).astype(np.int32))],
                                             ["id", "margin", "score", "predicted"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(score, f"id {kind}, margin double, score double, predicted int")


def calibrate(model: Model, margin: np.ndarray, toxic: np.ndarray) -> None:
    """Put the cut where fewest labelled texts fall on the wrong side, in the middle of the widest such place."""
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], toxic[order].astype(np.int64)
    wrong = np.concatenate(([0], np.cumsum(t))) + np.concatenate((np.cumsum((1 - t)[::-1])[::-1], [0]))
    gap = np.concatenate(([0.0], np.diff(m), [0.0]))  # a cut needs room between two margins
    wrong = np.where(gap > 0, wrong, len(m) + 1)
    if len(m) < 2 or wrong.min() > len(m):
        model.cut = float(m[-1]) + 1 if len(m) else 1.0
        return
    best = np.flatnonzero(wrong == wrong.min())
    k = best[np.argmax(gap[best])]
    # Disguised units should pass too, where labelled texts leave room for it.
    low, high = float(m[k - 1]), float(m[k])
    model.cut = (low + high) / 2 if model.masked >= high else low + 0.8 * max(model.masked - low, 0.2 * float(gap[k]))
    model.scale = float(np.clip(6 / gap[k], 2, 30))
