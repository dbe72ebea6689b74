"""Licence scans (operator 7).

Texts and templates, whole licence texts and notices, are normalised to
lower-case words of letters and digits.  A passage is compared with a template by
the Dice coefficient of their word bigram multisets.  A coefficient of t asks of
a passage t/(2-t) times the template's number of bigrams at least: texts with
fewer of its bigrams, and windows of its size with fewer, are never compared
with it.  Passages run from the first to the last of a template's bigrams in a
window of the template's size.

Nulls and empty texts match nothing; long texts are scanned whole; repeated rows
are reported each; of licences with tied passages the longest template's counts,
then the first name; an empty table gives an empty result.  Only the named
columns are read, whatever others are called.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .license_texts import TEXTS
from .text import PUNCTUATION, hashed_words, shingles, text_slices

THRESHOLD = 0.8
#: Each licence's notices and passages of its text.
NOTICES = {
    # fixed values: wordings of licence notices and licence texts
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD": [
        "Released under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
}


def templates() -> dict[str, list[str]]:
    """All notices and texts of each licence."""
    return {name: [*NOTICES.get(name, []), *([TEXTS[name]] if name in TEXTS else [])] for name in (*NOTICES, *sorted(set(TEXTS) - set(NOTICES)))}


@dataclass
class Templates:
    """Bigrams of all templates."""

    names: list[tuple[str, int]]
    grams: list[np.ndarray]
    keys: np.ndarray  # sorted distinct bigrams
    held: np.ndarray  # which template (column) has which bigram (row)
    filter: np.ndarray  # bitmap over the top bits of the keys

    @classmethod
    def build(cls, notices: dict[str, list[str]]) -> Templates:
        names = [(name, k) for name, texts in notices.items() for k in range(len(texts))]
        texts = pa.array([t for texts in notices.values() for t in texts], pa.large_string())
        grams = []
        for _, _, data, offsets in text_slices(texts):
            h, number = shingles(*hashed_words(data, offsets, breaks=PUNCTUATION), 2)
            grams += np.split(h, np.cumsum(number)[:-1])
        keys = np.unique(np.concatenate(grams))
        bitmap = np.zeros(1 << 16, bool)
        bitmap[(keys >> np.uint64(48)).astype(int)] = True
        return cls(names, grams, keys, np.stack([np.isin(keys, g) for g in grams], 1), bitmap)

    def passages(self, grams: np.ndarray) -> list[tuple[float, int, str, int, int, int]]:
        """(coefficient, size, licence, template, begin, end) of all passages at or above the threshold.

        In a window of a template's size lies the passage from the first to the last of the template's bigrams; with m
        of them in the window its coefficient is at most 2m / (m + size), which bounds m from below. Texts with
        fewer of a template's bigrams, so all that are too short, are never compared with it.
        """
        hit = np.flatnonzero(self.filter[(grams >> np.uint64(48)).astype(int)])
        at = np.minimum(np.searchsorted(self.keys, grams[hit]), len(self.keys) - 1)
        same = self.keys[at] == grams[hit]
        hit, at = hit[same], at[same]
        found = []
        for item, template in enumerate(self.grams):
            size = len(template)
            least = THRESHOLD * size / (2 - THRESHOLD)
            own = hit[self.held[at, item]]
            if len(own) < least:
                continue
            # windows that begin at one of the template's bigrams: the first place after the window's end
            close = np.searchsorted(own, own + size)
            start = np.flatnonzero(close - np.arange(len(own)) >= least)
            for begin, end in zip(own[start].tolist(), (own[close[start] - 1] + 1).tolist(), strict=True):
                c = dice(grams[begin:end], template)
                if c >= THRESHOLD:
                    found.append((c, size, self.names[item][0], item, begin, end))
        return found

    def scan(self, grams: np.ndarray) -> dict[str, tuple[float, int, int]]:
        """Best (coefficient, first bigram, bigrams) of each licence in a text's bigrams.

        Of overlapping passages of several licences, as versions of one have, the best alone is kept (of tied ones that
        of the longest template, then by name); each licence then has the best of its passages that are left.
        """
        passages = sorted(self.passages(grams), key=lambda x: (-x[0], -x[1], x[2:]))
        numbers = {name: k for k, name in enumerate(dict.fromkeys(name for name, _ in self.names))}
        owner = np.full(len(grams) if passages else 0, -1, np.int32)
        taken: dict[int, np.ndarray] = {}
        kept: dict[str, tuple[float, int, int]] = {}
        for c, _, name, item, begin, end in passages:
            others, own = owner[begin:end], taken.setdefault(item, np.zeros(len(grams), bool))
            # shifted by some words, a template meets its own passage again: that place is held by the best alone
            if own[begin:end].any() or ((others >= 0) & (others != numbers[name])).any():
                continue
            own[begin:end], owner[begin:end] = True, numbers[name]
            kept.setdefault(name, (c, begin, end - begin))
        return kept


def dice(a: np.ndarray, b: np.ndarray) -> float:
    """Dice coefficient of two multisets."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return 2.0 * float(np.minimum(x, y).sum()) / max(len(a) + len(b), 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, license, dice, first_word, n_bigrams): each document with each licence that a passage of it states."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Templates.build(notices or templates()))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        templates = shared.value
        for batch in batches:
            found = []
            for a, _, data, offsets in text_slices(batch.column(1)):
                grams, number = shingles(*hashed_words(data, offsets, breaks=PUNCTUATION), 2)
                ends = np.cumsum(number)
                near = np.flatnonzero(templates.filter[(grams >> np.uint64(48)).astype(int)])
                for row in np.unique(np.searchsorted(ends, near, side="right")).tolist():
                    for name, (c, first, n) in templates.scan(grams[ends[row] - number[row] : ends[row]]).items():
                        found.append((a + row, name, c, first, n))
            rows, *columns = list(zip(*found, strict=True)) or [()] * 5
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)]], names=["doc_id", "license", "dice", "first_word", "n_bigrams"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, license string, dice double, first_word bigint, n_bigrams bigint")
