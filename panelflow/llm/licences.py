"""Licence notices in texts, by Dice's coefficient over word bigrams."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelflow.llm.buffers import LOWER, text_slices

LEAST = 0.8
# --- Fixed values: wording of common notices ---
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."),
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "BSD": "Released under the BSD License.",
    "BSD-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
}
# --- end of fixed values ---
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_LINE = np.zeros(256, bool)
_LINE[[0x0A, 0x0D]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x09, 0x0B, 0x0C, 0x20]] = True
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    """Distinct pairs of neighbouring words (ASCII letters and digits, lower-cased)."""
    words = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", text)]
    return frozenset(zip(words, words[1:], strict=False))


def _word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins and a hash of its lower-cased letters."""
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    end = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
    place = (np.arange(inside.sum()) - np.repeat(np.concatenate(([0], np.cumsum(end - begin)))[:-1], end - begin)).astype(np.uint64)
    mixed = ((LOWER[data[inside]].astype(np.uint64) + np.uint64(1)) * _MIX[0]) ^ ((place * np.uint64(2) + np.uint64(1)) * _MIX[1])
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX[0]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed ^ (mixed >> np.uint64(32)), dtype=np.uint64)))
    at = np.concatenate(([0], np.cumsum(end - begin)))
    return begin, total[at[1:]] - total[at[:-1]]


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first * np.uint64(3)) ^ (second * _MIX[1])


def _passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every line, and of every block of several lines between blank lines."""
    inside = ~_LINE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin = np.flatnonzero(inside & (~np.concatenate(([False], inside[:-1])) | edge[:-1]))
    end = np.flatnonzero(inside & (~np.concatenate((inside[1:], [False])) | edge[1:])) + 1
    if not len(begin):
        return begin, end
    text = np.concatenate(([0], np.cumsum(~(_BLANK | _LINE)[data])))
    full = text[end] > text[begin]
    begin, end = begin[full], end[full]
    if not len(begin):
        return begin, end
    breaks = np.concatenate(([0], np.cumsum(data == 0x0A)))
    row = np.searchsorted(offsets, begin, "right")
    # Lines of one block: same text, one line feed between them.
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (breaks[begin[1:]] - breaks[end[:-1]] > 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(begin)])) - 1
    several = last > first
    return np.concatenate((begin, begin[first[several]])), np.concatenate((end, end[last[several]]))


def scan_licences(segments: DataFrame, id: str = "id", text: str = "original_text", templates: dict[str, str] | None = None,
                  least: float = LEAST) -> DataFrame:
    """Licence notices: one row per passage and its most alike template (id, start, length, passage, licence, dice).

    Passages are the lines of a text and its blocks of several lines between blank lines. Dice's coefficient is twice
    the distinct word bigrams in common over the sum of both counts; ``least`` of it is needed. For a template of m
    bigrams a passage needs between least/(2-least)*m and (2-least)/least*m of them, and at least the former in
    common; whole lines are ruled out by that on hashes, and templates by the passage's size, before sets are compared.
    Ties go to the first licence by name. start and length are in bytes of the UTF-8 text.

    Null and empty texts, and passages under two words, match nothing. Repeated rows give repeated rows; null ids are
    kept; other columns are ignored; no rows give no rows.
    """
    wanted = {name: bigrams(t) for name, t in sorted((templates or TEMPLATES).items())}
    wanted = {name: grams for name, grams in wanted.items() if grams}
    raw = "\n".join((templates or TEMPLATES).values()).encode()
    data = np.frombuffer(raw, np.uint8)
    _, key = _word_keys(data, np.array([0, len(raw)]))
    vocabulary = np.unique(_pair(key[:-1], key[1:]))
    fewest = max(1, int(np.ceil(least / (2 - least) * min(map(len, wanted.values()), default=1) - 1e-9)))
    narrow = segments.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def best(passage: str) -> tuple[str, float] | None:
        grams = bigrams(passage)
        found = None
        for name, own in wanted.items():
            low = least / (2 - least)
            if not low * len(own) - 1e-9 <= len(grams) <= len(own) / low + 1e-9:
                continue
            dice = 2 * len(grams & own) / (len(grams) + len(own))
            if dice >= least and (found is None or dice > found[1]):
                found = (name, dice)
        return found

    def run(batches):
        for batch, data, offsets in text_slices(batches, "text"):
            begin, end = _passages(data, offsets)
            word, key = _word_keys(data, offsets)
            pair = _pair(key[:-1], key[1:]) if len(key) > 1 else key[:0]
            hit = np.zeros(len(word) + 1, np.int64)
            if len(pair) and len(vocabulary):
                hit[1:len(pair) + 1] = np.cumsum(vocabulary[np.minimum(np.searchsorted(vocabulary, pair), len(vocabulary) - 1)] == pair)
                hit[len(pair) + 1:] = hit[len(pair)]
            a, b = np.searchsorted(word, begin), np.searchsorted(word, end)
            hits = hit[np.maximum(b - 1, a)] - hit[a]
            rows, out = [], []
            whole = data.tobytes()
            for k in np.flatnonzero((b - a >= 2) & (hits >= fewest)).tolist():
                passage = whole[begin[k]:end[k]].decode("utf-8", "replace")
                found = best(passage)
                if found:
                    r = int(np.searchsorted(offsets, begin[k], "right")) - 1
                    rows.append(r)
                    out.append((int(begin[k] - offsets[r]), int(end[k] - begin[k]), passage, *found))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())),
                 *[pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()), strict=True)]],
                ["id", "start", "length", "passage", "licence", "dice"])

    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, start long, length long, passage string, licence string, dice double")
