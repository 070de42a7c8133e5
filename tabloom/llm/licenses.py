"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are grouped by size: class ``c`` has those of more than ``c / 2`` and at most ``c`` shingles,
``c`` a power of two. A text is cut into blocks of ``c`` shingles and every three neighbouring blocks
are a window, so that a run of up to ``2 c`` shingles lies inside one. A window has ``3 c`` shingles at
most. If it contains four fifths of a template, their Jaccard similarity is at least
``0.8 t / (t + 3 c - 0.8 t)``, over 0.129; one of 128 bands of one minimum then agrees with probability
``1 - (1 - 0.129) ** 128``, over 0.99999997. Shingles that no template has are left out of the windows
first, which can only raise the similarity.

A shingle is a run of five words. A template of fewer words is one shingle, its whole word sequence;
for such templates texts are hashed at that length too, each length with windows of its own.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package

WORDS = 5
CONTAINMENT = 0.8
BANDS = 128
BLOCKS = 3
_WORD = re.compile(r"\w+")
_CACHED = 1 << 18

# fixed values: wording of common license notices, to be found as it stands
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "mit-notice": "Released under the MIT License",
    "mit-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-warranty": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "bsd-conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "all-rights-reserved": "All rights reserved",
    "unauthorized-copying": "Unauthorized copying of this file, via any medium, is strictly prohibited",
}


def _shingle_hashes(ids: np.ndarray, length: int = WORDS) -> np.ndarray:
    """A 64-bit hash for each run of ``length`` words, from the words' own hashes."""
    out = np.zeros(max(0, ids.size - length + 1), np.uint64)
    for k in range(length):
        out = (out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + out.size]) ^ (out >> np.uint64(29))
    return out


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        raw = word.encode()
        value = zlib.crc32(raw) | zlib.crc32(raw, 0x9747B28C) << 32
        if len(self) < _CACHED:  # only memory; the value is the same either way
            self[word] = value
        return value


class Scanner:
    """The templates made ready; small and fixed in size, so each task gets it whole."""

    def __init__(self, templates: dict[str, str]):
        self.hashes = _WordHashes()
        rng = np.random.default_rng(3)
        self.factor = rng.integers(1, 2**63, BANDS, np.uint64) | np.uint64(1)
        self.sets: dict[str, set] = {}
        self.index: dict[int, dict[int, dict[tuple[int, int], list[str]]]] = {}
        known = defaultdict(list)
        for name, text in sorted(templates.items()):
            words = _WORD.findall(text.lower())
            if not words:
                raise ValueError(f"template {name} has no words")
            length = min(WORDS, len(words))
            self.sets[name] = {tuple(words[i : i + length]) for i in range(len(words) - length + 1)}
            hashes = np.unique(_shingle_hashes(self.ids(words), length))
            known[length].append(hashes)
            size = 1 << (len(self.sets[name]) - 1).bit_length()
            bands = self.index.setdefault(length, {}).setdefault(size, {})
            for band, value in enumerate(self.minima(hashes)):
                bands.setdefault((band, int(value)), []).append(name)
        self.known = {length: np.unique(np.concatenate(parts)) for length, parts in known.items()}

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        mixed = (hashes[:, None] ^ (hashes[:, None] >> np.uint64(31))) * self.factor[None, :]
        return (mixed ^ (mixed >> np.uint64(33))).min(axis=0)

    def scan(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """``name, shared, shingles, first word, end word`` of each template's best window, the earliest of equals."""
        words = _WORD.findall(text.lower())
        ids = self.ids(words)
        best: dict[str, tuple[int, int, int, int]] = {}
        for length, known in self.known.items():
            hashes = _shingle_hashes(ids, length)
            near = np.searchsorted(known, hashes)
            hits = np.flatnonzero(known[np.minimum(near, known.size - 1)] == hashes)
            if hits.size:
                self._windows(words, hashes, hits, length, best)
        return sorted((name, *found) for name, found in best.items())

    def _windows(self, words: list[str], hashes: np.ndarray, hits: np.ndarray, length: int, best: dict) -> None:
        """Enter the best windows of shingles of one length into ``best``."""
        for size, bands in self.index[length].items():
            block = hits // size
            for start in np.unique(np.concatenate([block - k for k in range(BLOCKS)])):
                lo, hi = np.searchsorted(block, [start, start + BLOCKS])
                if lo == hi:
                    continue
                window = hits[lo:hi]
                candidates = {n for b, v in enumerate(self.minima(hashes[window])) for n in bands.get((b, int(v)), ())}
                found = {tuple(words[i : i + length]) for i in window} if candidates else set()
                for name in candidates:
                    wanted = self.sets[name]
                    shared = len(wanted & found)
                    if shared >= CONTAINMENT * len(wanted) and (name not in best or shared > best[name][0]):
                        inside = [i for i in window if tuple(words[i : i + length]) in wanted]
                        best[name] = (shared, len(wanted), int(inside[0]), int(inside[-1]) + length)


FIELDS = [("doc_id", pa.int64()), ("license", pa.string()), *[(n, pa.int64()) for n in ("n_shared", "n_shingles", "first_word", "end_word")]]
SCHEMA = "doc_id long, license string, n_shared long, n_shingles long, first_word long, end_word long"


def _scan(batches: Iterator[pa.RecordBatch], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner(templates)
    for batch in batches:
        rows = [(key.as_py(), *m) for key, text in zip(*batch.columns) for m in scanner.scan(text.as_py() or "")]
        columns = list(zip(*rows)) or [[] for _ in FIELDS]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], names=[n for n, _ in FIELDS])


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each template found in a row of ``docs``, with its best window's counts and place.

    Words are runs of letters, digits and underscores, lower-cased. Null texts and those
    shorter than every template match nothing; null ids stay null; repeated rows match one by one; other columns don't matter; an
    empty table gives an empty result. Texts are scanned whole by the task that reads them and
    nothing is shuffled. Templates are a parameter of bounded size and go to every task.
    """
    chosen = TEMPLATES if templates is None else templates
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _scan(it, chosen), SCHEMA)
