"""License notices in texts: winnowed fingerprints pick candidates, banded alignment decides.

Texts and templates are sequences of lower-cased letter and digit runs.  Grams of
three words are winnowed over three positions, so any five words in a row that a
text shares with a template share a fingerprint.  An inverted index from
fingerprint to (template, position) gives each hit a diagonal; hits of one
template on near diagonals are one candidate.  A local alignment in a band around
the candidate's diagonals counts the template's words that are found in order,
through inserted, lost and changed words, and gives the span in the text.  Words
that tell licenses apart (versions, Lesser, NoDerivatives) must agree.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from polyview.llm.common import byte_column, given_id, id_text, slices, small_batches, text_key
from polyview.llm.words import Words, find_words, grams, sliding_min, whole

GRAM = 3
WINNOW = 3
BAND = 8
COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
HASH = 303
U = np.uint64


def _gnu(name: str, version: str) -> tuple[str, ...]:
    """The standard notice of a GNU license, for a program and for a library."""
    return tuple(
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License "
        f"as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version. "
        f"This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details."
        for what in ("program", "library")
    )


def _creative_commons() -> dict[str, tuple[str, ...]]:
    """The six attribution licenses in every version, those before 4.0 also as unported."""
    kinds = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
             "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    named = {}
    for version, reach in (("4.0", " International"), ("3.0", " Unported"), ("2.5", " Generic"), ("2.0", " Generic"), ("1.0", " Generic")):
        for kind, name in kinds.items():
            texts = [f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {name} {version}{reach} License."]
            if version != "4.0":
                texts.append(f"This work is licensed under a Creative Commons {name} {version} License.")
            named[f"CC-{kind}-{version}"] = tuple(texts)
    return named


#: Words that tell one license from another: a notice must have those of its template, and of the names no others.
DECIDING_NAMES = ("lesser", "affero", "noderivatives", "noderivs", "noncommercial", "sharealike", "nd", "nc", "sa")
DECIDING_NUMBERS = ("0", "1", "2", "3", "4", "5")

#: Notices as their licenses word them, in full or in one line.
NOTICES = {
    "Apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        'law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
        "OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "shall be included in all copies or substantial portions of the Software.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
    ),
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This "
        "program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "This work is licensed under the GNU General Public License, version 3.",
        *_gnu("General", "3"),
    ),
    "GPL-2.0": (*_gnu("General", "2"), "This work is licensed under the GNU General Public License, version 2."),
    "LGPL-2.0": (*_gnu("Library General", "2"), "This work is licensed under the GNU Library General Public License, version 2."),
    "LGPL-2.1": (*_gnu("Lesser General", "2.1"), "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    "LGPL-3.0": (*_gnu("Lesser General", "3"), "This work is licensed under the GNU Lesser General Public License, version 3."),
    "AGPL-3.0": (*_gnu("Affero General", "3"), "This work is licensed under the GNU Affero General Public License, version 3."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Released under the BSD 3-Clause License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
        "the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED",
        "Released under the BSD 2-Clause License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "Licensed under the ISC License.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, "
        "sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means.",
    ),
    "CC0-1.0": ("Licensed under CC0 1.0.", "This work is licensed under a Creative Commons CC0 1.0 Universal License."),
    **_creative_commons(),
}


def _plain() -> np.ndarray:
    """Lower-case letters, digits and bytes above ASCII stay; all else is a space."""
    table = np.full(256, 0x20, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80 or c.isalnum():
            table[b] = ord(c.lower()) if b < 0x80 else b
    return table


def plain_words(buf: np.ndarray, offsets: np.ndarray) -> Words:
    return find_words(_plain()[buf], offsets)


def winnowed(hashes: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams of word hashes and which of them are the least of a window; ``ok`` tells the grams that lie in one row.

    A row with fewer grams than a window keeps them all.
    """
    values = grams(hashes, GRAM)
    ranked = np.where(ok, values, U(2**64 - 1))
    pad = np.full(WINNOW - 1, U(2**64 - 1))
    highest = ~sliding_min(~sliding_min(np.concatenate([pad, ranked, pad]), WINNOW), WINNOW)
    return values, ok & (ranked == highest)


def _hashes(texts: tuple[str, ...]) -> list[int]:
    """The hashes of single words."""
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
    return plain_words(np.frombuffer(b"".join(data), np.uint8), offsets).hashes(HASH).tolist()


class Index:
    """Fingerprints of the templates, sorted, with the template and word position of each."""

    def __init__(self, templates: Mapping[str, tuple[str, ...]]):
        self.names = [name for name, texts in templates.items() for _ in texts]
        data = [t.encode() for texts in templates.values() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in data])]).astype(np.int64)
        words = plain_words(np.frombuffer(b"".join(data), np.uint8), offsets)
        hashes = words.hashes(HASH)
        self.words = [hashes[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:])]
        values, picked = winnowed(hashes, whole(words.first, len(hashes), GRAM))
        at = np.flatnonzero(picked)
        order = np.argsort(values[at], kind="stable")
        at = at[order]
        self.keys, self.template = values[at], words.rows()[at]
        self.position = at - words.first[self.template]
        names, numbers = (set(_hashes(w)) for w in (DECIDING_NAMES, DECIDING_NUMBERS))
        self.needed = [(names | numbers) & set(own) for own in self.words]
        self.barred = [names - set(own) for own in self.words]

    def decided(self, template: int, words: np.ndarray) -> bool:
        """Whether the words of a match have the deciding words of its template and no other deciding name."""
        found = set(words.tolist())
        return self.needed[template] <= found and not self.barred[template] & found

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of index into ``values`` and index entry with that fingerprint."""
        low, high = np.searchsorted(self.keys, values, "left"), np.searchsorted(self.keys, values, "right")
        found = np.flatnonzero(high > low)
        counts = (high - low)[found]
        entry = np.repeat(low[found], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return np.repeat(found, counts), entry


def align(template: list[int], text: list[int], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with ``low <= text position - template position <= high``: matched words, start and end in ``text``."""
    worst = (0, 0, -1)  # score, matched words, where the alignment starts in the text (-1: nowhere)
    best, end = worst, 0
    above: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        left = worst
        for j in range(max(0, i + low), min(len(text), i + high + 1)):
            score, matched, start = above.get(j - 1, worst)
            same = word == text[j]
            cell = (score + (MATCH if same else MISMATCH), matched + same, start if start >= 0 else j)
            up = above.get(j, worst)
            for other in ((up[0] + GAP, *up[1:]), (left[0] + GAP, *left[1:])):
                if other[0] > cell[0]:
                    cell = other
            if cell[0] <= 0:
                cell = worst
            elif cell[0] > best[0]:
                best, end = cell, j + 1
            row[j] = left = cell
        above = row
    return best[1], best[2], end


def _candidates(template: np.ndarray, diagonal: np.ndarray, band: int) -> Iterator[tuple[int, int, int]]:
    """Template and range of diagonals of hits whose diagonals follow one another within ``band``."""
    order = np.lexsort((diagonal, template))
    template, diagonal = template[order], diagonal[order]
    new = np.ones(len(order), bool)
    new[1:] = (template[1:] != template[:-1]) | (diagonal[1:] - diagonal[:-1] > band)
    starts = np.flatnonzero(new)
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        yield int(template[a]), int(diagonal[a]), int(diagonal[b - 1])


def _matches(own: list[int], hashes: np.ndarray, begin: int, stop: int, low: int, high: int, coverage: float) -> Iterator[tuple[int, int, int]]:
    """The best alignment between words ``begin`` and ``stop``, and those on either side of it."""
    if stop - begin < coverage * len(own):
        return
    matched, start, end = align(own, hashes[begin:stop].tolist(), low - begin, high - begin)
    if matched >= coverage * len(own):
        yield matched, begin + start, begin + end
        yield from _matches(own, hashes, begin, begin + start, low, high, coverage)
        yield from _matches(own, hashes, begin + end, stop, low, high, coverage)


def find_notices(index: Index, hashes: np.ndarray, template: np.ndarray, diagonal: np.ndarray, coverage: float, band: int):
    """Matches in one text: ``(template, matched, start word, end word)``; of overlapping ones the one with most words."""
    found = []
    for t, low, high in _candidates(template, diagonal, band):
        own = index.words[t]
        # a run of hits on drifting diagonals may hold several notices: each band is tried from its own start
        at = low
        while at <= high:
            last = min(high, at + band) + band
            begin, stop = max(0, at - band), min(len(hashes), last + len(own))
            if index.needed[t] <= set(hashes[begin:stop].tolist()):
                found += [(t, *m) for m in _matches(own, hashes, begin, stop, at - band, last, coverage)]
            at += band + 1
    found = [m for m in found if index.decided(m[0], hashes[m[2]:m[3]])]
    found.sort(key=lambda m: (-m[1], m[2], m[0]))
    taken: list[tuple[int, int, int, int]] = []
    by_block: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for m in found:
        blocks = range(m[2] >> 6, (m[3] >> 6) + 1)
        if all(m[3] <= a or b <= m[2] for k in blocks for a, b in by_block[k]):
            taken.append(m)
            for k in blocks:
                by_block[k].append((m[2], m[3]))
    return sorted(taken, key=lambda m: m[2])


def scan(docs: DataFrame, templates: Mapping[str, tuple[str, ...]] = NOTICES, coverage: float = COVERAGE, band: int = BAND,
         doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, license, notice, coverage, matched_words, start_char, end_char, text_key``: one row per notice found.

    ``notice`` numbers the templates; ``coverage`` is the share of its words found
    in order; the span is in characters of the whole text.  Several notices of one
    text are reported each; of overlapping ones the one with most words (then the
    first).  NULL and empty texts have none.  Rows with equal ids are scanned each;
    other columns are not read; an empty table gives an empty result.  ``templates``
    is a bounded argument and travels with the tasks; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    index = Index(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            buf, offsets = byte_column(batch.column("_text"))
            words = plain_words(buf, offsets)
            hashes = words.hashes(HASH)
            values, picked = winnowed(hashes, whole(words.first, len(hashes), GRAM))
            at = np.flatnonzero(picked)
            which, entry = index.hits(values[at])
            word = at[which]
            row = np.searchsorted(words.first, word, "right") - 1
            diagonal = word - words.first[row] - index.position[entry]
            rows, out = [], []
            for r, begin, stop in _runs(row):
                lo, hi = words.first[r], words.first[r + 1]
                for t, matched, a, b in find_notices(index, hashes[lo:hi], index.template[entry[begin:stop]], diagonal[begin:stop], coverage, band):
                    raw = buf[offsets[r]:words.ends[lo + b - 1]].tobytes()
                    first = int(words.starts[lo + a] - offsets[r])
                    head = len(raw[:first].decode())
                    rows.append(r)
                    out.append((index.names[t], t, matched / len(index.words[t]), matched, head, head + len(raw[first:].decode())))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            which_rows = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(which_rows), batch.column("_key").take(which_rows), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["_id", "_key", "license", "notice", "coverage", "matched_words", "start_char", "end_char"],
            )

    rows = id_text(docs, doc_id, text).withColumn("_key", text_key(F.col("_text")))
    found = rows.mapInArrow(
        run, "_id long, _key long, license string, notice int, coverage double, matched_words long, start_char long, end_char long"
    )
    return found.select(
        given_id().alias("doc_id"), "license", "notice", "coverage", "matched_words", "start_char", "end_char", F.col("_key").alias("text_key")
    )


def _runs(sorted_rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
    starts = np.flatnonzero(np.diff(sorted_rows, prepend=-1))
    for a, b in zip(starts, np.append(starts[1:], len(sorted_rows))):
        yield int(sorted_rows[a]), int(a), int(b)
