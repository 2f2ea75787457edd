"""License scan: winnowed fingerprints of templates pick candidates, banded alignment reports them.

Templates are cut into words without punctuation and case; of their runs of K words, the least
hash in each window of WINDOW runs is kept, with its place, in an inverted index; of templates of
up to SHORT words all runs are kept, as changes that COVERAGE allows may leave only one of them,
and of those of up to TINY words the runs of K - 1 too. Every run of every document is looked up there. Where runs of a template (of a whole license text: a share of
its runs) are found, the template is aligned
with the words around that diagonal, within a band, and reported if enough of its words match
in order. Of overlapping reports the one with most matched words stays.

Defined results: a null text is empty and has no spans; repeated rows give repeated rows; an
empty table gives an empty result; extra columns are ignored. Spans are in code points, end
exclusive, from the first matched word to the end of the last.
"""

from __future__ import annotations

import functools
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import pick, text_chunks
from tessera.llm.words import IN_NAME, located_words, shingles

K, WINDOW = 3, 4
#: Words of a template up to which all its runs are indexed, and up to which a changed word may lie in all its runs of K.
SHORT, TINY = 64, 5
#: Share of the indexed runs of a template of more than SHORT words that a band must hold before it is aligned. Of
#: runs of 3, a fifth of the words changed one by one leaves two fifths.
HELD = 0.1
#: Share of a template's words that must match, in order.
COVERAGE = 0.8
#: (license, template): notices as they stand in files and texts, and the opening grants of common licenses.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-or-later", "either version 2 of the License, or (at your option) any later version"),
    ("GPL-3.0-or-later", "either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Licensed under the BSD License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain"),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without written permission."),
)


@functools.cache
def whole_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of the whole texts beside this module, named by their license. AGPL-3.0 is put together from GPL-3.0's
    text, section 13 apart, so it has the preamble of that."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def name_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(text, dtype=np.uint8)
    hashes, starts, ends, _ = located_words(data, np.array([0, len(data)]), IN_NAME)
    return hashes, starts, ends


def winnow(values: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the least value in each window, the rightmost of equal ones; all values if there are no more than a window's."""
    if len(values) <= window:
        return list(range(len(values)))
    parts = np.lib.stride_tricks.sliding_window_view(values, window)
    return np.unique(np.arange(window - 1, len(values)) - np.argmin(parts[:, ::-1], axis=1)).tolist()


@dataclass
class Index:
    templates: list[tuple[str, np.ndarray]]
    prints: np.ndarray  # sorted, distinct
    places: list[list[tuple[int, int]]]  # by print: (template, place)
    common: np.ndarray  # of the prints' 20 highest bits
    least: list[int]  # by template: its runs that a band must hold

    @classmethod
    def of(cls, templates: Sequence[tuple[str, str]]) -> Index:
        held, least, found = [], [], defaultdict(list)
        for t, (license_, text) in enumerate(templates):
            hashes = name_words(text.encode())[0]
            held.append((license_, hashes))
            least.append(1)
            for k in (K, K - 1) if len(hashes) <= TINY else (K,):
                runs = shingles(hashes, k)
                chosen = range(len(runs)) if len(hashes) <= SHORT else winnow(runs)
                for at in chosen:
                    found[int(runs[at])].append((t, at))
                if len(hashes) > SHORT:
                    least[t] = max(1, int(HELD * len(chosen)))
        prints = np.array(sorted(found), dtype=np.uint64)
        common = np.zeros(1 << 20, dtype=bool)
        common[(prints >> np.uint64(44)).astype(np.int64)] = True
        return cls(held, prints, [found[int(p)] for p in prints], common, least)

    def hits(self, runs: np.ndarray) -> list[tuple[int, int]]:
        """(place of the run, number of the print)."""
        near = np.flatnonzero(self.common[(runs >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.prints, runs[near])
        same = (at < len(self.prints)) & (self.prints[np.minimum(at, len(self.prints) - 1)] == runs[near])
        return list(zip(near[same].tolist(), at[same].tolist(), strict=True))


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Longest common subsequence of a template and a document's words with word - template place from low to high.

    (matched words, first matched word, last matched word). Ties: the shortest span. Cost: template x band.
    """
    # best[d]: (matched, -first) of the alignment that ends on diagonal low + d
    none = (0, 1, -1)
    width = high - low + 1
    row = [none] * (width + 1)
    for i, word in enumerate(template.tolist()):
        fresh = [none] * (width + 1)
        left = none
        for d in range(width):
            j = i + low + d
            top = max(row[d + 1] if d + 1 < width else none, left)
            if 0 <= j < len(words) and int(words[j]) == word:
                was = row[d]
                got = (was[0] + 1, was[1] if was[0] else -j, j)
                top = max(top, got, key=lambda s: (s[0], s[1], -s[2]))
            fresh[d] = left = top
        row = fresh
    matched, first, last = max(row[:width], key=lambda s: (s[0], s[1], -s[2]))
    return matched, -first, last


def align_long(template: np.ndarray, words: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """align() for whole license texts, a row of the band at a time. Cells: matched words, then first and last, reversed."""
    width, mask = high - low + 1, (1 << 24) - 1
    a, b = max(0, low), max(0, low, min(len(words), len(template) + high))
    near, real = np.zeros(len(template) + width - 1, np.uint64), np.zeros(len(template) + width - 1, bool)
    near[a - low : b - low], real[a - low : b - low] = words[a:b], True
    row = np.zeros(width, np.int64)
    for i, word in enumerate(template):
        fresh = np.append(row[1:], 0)
        at = np.flatnonzero((near[i : i + width] == word) & real[i : i + width])
        was, j = row[at], mask - (at + i)
        fresh[at] = np.maximum(fresh[at], (((was >> 48) + 1) << 48) | (np.where(was > 0, (was >> 24) & mask, j) << 24) | j)
        row = np.maximum.accumulate(fresh)
    top = int(row[-1])
    return (top >> 48, mask - (top >> 24 & mask) + low, mask - (top & mask) + low) if top else (0, -1, -1)


def dense(own: set[tuple[int, int]], band: int, least: int) -> list[int]:
    """The diagonals, in order, around which a band of them holds so many runs of the template."""
    d = np.sort(np.array([x for x, _ in own]))
    return np.unique(d[np.searchsorted(d, d + band, "right") - np.searchsorted(d, d - band) >= least]).tolist()


def spans(index: Index, words: np.ndarray, hits: list[tuple[int, int]], coverage: float = COVERAGE) -> list[tuple[int, int, int, int]]:
    """(first word, last word, matched, template), overlaps settled, in order."""
    diagonals = defaultdict(set)
    for place, number in hits:
        for t, at in index.places[number]:
            diagonals[t].add((place - at, at))
    found = []
    for t, own in diagonals.items():
        template = index.templates[t][1]
        band = 3 + len(template) // 10
        ordered = dense(own, band, index.least[t]) if len(own) >= index.least[t] else []
        if not ordered:
            continue
        group = [ordered[0]]
        for d in [*ordered[1:], None]:
            if d is not None and d - group[-1] <= band:
                group.append(d)
                continue
            matched, first, last = (align if len(template) <= SHORT else align_long)(template, words, group[0] - band, group[-1] + band)
            if matched >= coverage * len(template):
                found.append((first, last, matched, t))
            group = [d]
    kept: list[tuple[int, int, int, int]] = []  # in order, none overlaps another
    for s in sorted(found, key=lambda s: (-s[2], -s[2] / len(index.templates[s[3]][1]), s[0], s[3])):
        at = bisect_left(kept, s)
        if (at == 0 or kept[at - 1][1] < s[0]) and (at == len(kept) or s[1] < kept[at][0]):
            kept.insert(at, s)
    return kept


def scan(df: DataFrame, templates: Sequence[tuple[str, str]] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_spans, licenses (in order of name, comma-joined), spans (license:start:end:coverage, comma-joined). templates: notices and whole texts, if not given."""
    templates = list(templates) if templates is not None else [*TEMPLATES, *whole_texts()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(templates)
        for batch in batches:
            for first_row, end_row, data, offsets in text_chunks(batch.column(1)):
                hashes, starts, ends, first = located_words(data, offsets, IN_NAME)
                by_doc = defaultdict(list)
                for k in (K, K - 1):
                    for place, number in index.hits(shingles(hashes, k)):
                        doc = int(np.searchsorted(first, place, side="right")) - 1
                        if place + k <= first[doc + 1]:
                            by_doc[doc].append((place - int(first[doc]), number))
                n, names, shown = [0] * (end_row - first_row), [""] * (end_row - first_row), [""] * (end_row - first_row)
                for doc, hits in by_doc.items():
                    a, b = int(first[doc]), int(first[doc + 1])
                    got = spans(index, hashes[a:b], hits, coverage)
                    begin, cells = int(offsets[doc]), []
                    points = np.cumsum(data[begin : offsets[doc + 1]] & 0xC0 != 0x80) if got else None  # code points up to each byte
                    for s, e, matched, t in got:
                        at, to = int(starts[a + s]) - begin, int(ends[a + e]) - begin
                        cells.append((index.templates[t][0], int(points[at]) - 1, int(points[to - 1]), matched / len(index.templates[t][1])))
                    n[doc] = len(cells)
                    names[doc] = ",".join(sorted({c[0] for c in cells}))
                    shown[doc] = ",".join(f"{c[0]}:{c[1]}:{c[2]}:{c[3]:.3f}" for c in cells)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first_row, end_row - first_row), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(shown, pa.string())],
                    ["doc_id", "n_spans", "licenses", "spans"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return pick(df, doc_id=id_col, text=text_col).mapInArrow(run, f"doc_id {kind}, n_spans long, licenses string, spans string")
