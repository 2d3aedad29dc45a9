"""License notices in texts, retrieved by MinHash bands over overlapping windows.

Texts and templates are five-word shingles. For a template of s shingles a text is cut into windows of s + t shingles,
t = s // 2 (at least 1) apart, so that every occurrence lies whole in some window; a window that holds SIMILARITY of the template's shingles matches.

Such windows are retrieved by bands. Templates of g + 1 to 2g shingles, for every power of two g, share retrieval windows of 4g shingles, g apart, in which each of
their own windows lies whole. A matching window's retrieval window has a Jaccard similarity with the template of at least
SIMILARITY * s / (4g + (1 - SIMILARITY) * s); with bands of one row, as many as :func:`bands_for` gives collide with a probability of at least 1 - MISS for that.
Every window of every text gets its minimum in each band, computed from the halves that smaller windows have in common, and
looks it up among the templates'. For the templates that collide, the share of their shingles is counted exactly, on the words, in their own windows there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from importlib.resources import files
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._batches import slices, texts_of
from .decontamination import words_of

SHINGLE_WORDS = 5
SIMILARITY = 0.8
MISS = 1e-9

#: A licence text is looked for whole and in parts of about this many words, cut between paragraphs.
PART_WORDS = 200

#: Notices of fixed wording.
_NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "LGPL-header": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "All-rights-reserved": "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means",
    "GPL-2.0-header": "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
    "AGPL-header": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
}
#: Names as notices say them: after "under" if that makes a shingle, else after every one of the openings.
_NAMES = {
    "MIT": ("the MIT License",),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License"),
    "BSD": ("the BSD License", "the BSD 2-Clause License", "the BSD 3-Clause License", "a BSD-style license"),
    "ISC": ("the ISC License",),
    "Zlib": ("the zlib License", "the zlib/libpng License"),
    "Unlicense": ("the Unlicense license",),
    "BSL-1.0": ("the Boost Software License",),
    "GPL": ("the GNU General Public License", "the GNU GPL", "the GPL License"),
    "GPL-2.0": ("the GPL v2", "the GPL version 2"),
    "GPL-3.0": ("the GPL v3", "the GPL version 3"),
    "LGPL": ("the GNU Lesser General Public License", "the GNU LGPL", "the GNU Library General Public License"),
    "AGPL": ("the GNU Affero General Public License", "the GNU AGPL", "the AGPL v3"),
    "MPL-2.0": ("the Mozilla Public License",),
    "EPL": ("the Eclipse Public License",),
    "CC-BY": ("CC BY 4.0", "CC BY 3.0", "a Creative Commons Attribution License", "a Creative Commons Attribution 3.0", "a Creative Commons Attribution 4.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike", "the Creative Commons Attribution-ShareAlike"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC 3.0", "a Creative Commons Attribution-NonCommercial"),
    "CC-BY-ND": ("CC BY-ND 4.0", "CC BY-ND 3.0", "a Creative Commons Attribution-NoDerivatives", "a Creative Commons Attribution-NoDerivs"),
    "CC-BY-NC-SA": ("CC BY-NC-SA 4.0", "CC BY-NC-SA 3.0", "a Creative Commons Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND": ("CC BY-NC-ND 4.0", "CC BY-NC-ND 3.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives", "a Creative Commons Attribution-NonCommercial-NoDerivs"),
}
_OPENINGS = ("Licensed under", "Released under", "Distributed under", "Available under", "Published under", "Provided under", "terms of")


def _bodies() -> dict[str, str]:
    """Whole licence texts and, of longer ones, their parts. Apostrophes become blanks, as they part words anyway."""
    out = {}
    for file in sorted(files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        text, name = file.read_text(encoding="utf-8").replace("'", " "), file.name.removesuffix(".txt")
        out[f"{name}-full"] = text
        parts, size = [[]], 0
        for paragraph in text.split("\n\n"):
            n = len(words_of(paragraph))
            if size and size + n > PART_WORDS:
                parts.append([])
                size = 0
            parts[-1].append(paragraph)
            size += n
        if len(parts) > 1:
            cut = ["\n\n".join(p) for p in parts]
            out.update({f"{name}-part-{k}": t for k, t in enumerate(cut, 1) if len(words_of(t)) >= SHINGLE_WORDS})
    return out


def _templates() -> dict[str, str]:
    out = dict(_NOTICES)
    said = {tuple(words_of(t)) for t in out.values()}
    for name, forms in _NAMES.items():
        texts = []
        for form in forms:
            short = len(words_of(form)) + 1 < SHINGLE_WORDS
            texts += [t for opening in (_OPENINGS if short else ("under",)) if len(words_of(t := f"{opening} {form}")) >= SHINGLE_WORDS and tuple(words_of(t)) not in said]
        out.update({f"{name}-notice-{k}": t for k, t in enumerate(texts, 1)})
    return {**out, **_bodies()}


#: Usual notices of well-known licences, and licence texts. Callers may pass their own.
TEMPLATES = _templates()


def level_of(s: int) -> int:
    """The power of two g such that a template of s shingles is retrieved by windows of 4g."""
    return 1 if s <= 2 else 1 << (s - 1).bit_length() - 1


def bands_for(s: int, similarity: float = SIMILARITY, miss: float = MISS) -> int:
    """Bands of one row that a template of s shingles needs."""
    shared = ceil(similarity * s - 1e-9)
    jaccard = shared / (4 * level_of(s) + s - shared)
    return ceil(log(miss) / log(1 - jaccard))


def _twice_permuted(h: np.ndarray, band: int) -> np.ndarray:
    """Twice a band's permutation of 31-bit hashes, which is a product with an odd number: the last bit is free."""
    return h * np.uint32(((2 * band + 1) * 0x9E3779B1 | 1) * 2 % (1 << 32))


class Bands:
    """The templates' minima by level and band, to be looked up by those of texts. A shingle that is a minimum of any template has the last bit of
    its values set, so that a window's minimum tells whether there is anything to look up."""

    BITS = 24
    #: Shingles handled in one go, and the level up to which they are.
    CHUNK, NEAR = 1 << 15, 64

    def __init__(self, templates: list[Template]):
        self.levels = sorted({t.level for t in templates})
        self.bands = max((t.bands for t in templates), default=0)
        self.known = np.zeros(1 << self.BITS, dtype=bool)
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for i, t in enumerate(templates):
            h = _short(t.hashes)
            for band in range(t.bands):
                value = _twice_permuted(h, band)
                at = int(np.argmin(value))
                found.setdefault((t.level, band), []).append((int(value[at]) >> 1, i))
                self.known[int(h[at]) >> (31 - self.BITS)] = True
        self.minima = {k: tuple(np.array(x) for x in zip(*sorted(v))) for k, v in found.items()}

    def search(self, h: np.ndarray) -> np.ndarray:
        """Rows (template, first shingle of a retrieval window) that collide in a band, each once, for the 31-bit hashes of a text's shingles."""
        out = [np.zeros((0, 2), dtype=np.int64)]
        if not len(h) or not self.levels:
            return out[0]
        top = self.levels[-1]
        low = min(top, self.NEAR)
        coarse: list[list[np.ndarray]] = [[] for _ in range(self.bands)]
        for start in range(0, len(h), self.CHUNK):  # small windows stay in the processor's cache
            part = h[start : start + self.CHUNK + 4 * low]
            n = -(-min(self.CHUNK, len(h) - start) // low) * low
            padded = np.full(n + 4 * low + 4, 0xFFFFFFFE, dtype=np.uint32)
            last = self.known[part >> np.uint32(31 - self.BITS)].astype(np.uint32)
            for band in range(self.bands):
                np.bitwise_or(_twice_permuted(part, band), last, out=padded[: len(part)])
                two = np.minimum(padded[:-1], padded[1:])
                coarse[band].append(self._climb(np.minimum(two[:-2], two[2:]), 1, low, band, start, n, out)[: n // low])
        if top > low:
            for band in range(self.bands):
                self._climb(_wider(np.concatenate(coarse[band])), 2 * low, top, band, 0, len(h) + top, out)
        return np.unique(np.concatenate(out), axis=0)

    def _climb(self, least: np.ndarray, g: int, top: int, band: int, start: int, n: int, out: list) -> np.ndarray:
        """Look up the minima of windows of 4g shingles that begin at ``start`` + 0, g, 2g and so on, then those of twice the size, up to g = ``top``, which are returned."""
        while True:
            if (g, band) in self.minima:
                own = least[: -(-n // g)]
                at = np.flatnonzero(own & np.uint32(1))
                if len(at):
                    value, template = self.minima[g, band]
                    lo, hi = np.searchsorted(value, own[at] >> 1, "left"), np.searchsorted(value, own[at] >> 1, "right")
                    many = hi - lo
                    which = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    out.append(np.stack([template[which], start + np.repeat(at, many) * g], axis=1))
            if g == top:
                return least
            least, g = _wider(least), 2 * g


def _wider(least: np.ndarray) -> np.ndarray:
    """Minima of windows twice as large and as far apart."""
    half = least[::2]
    out = half.copy()
    out[:-2] = np.minimum(half[:-2], half[2:])
    return out


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(33)).astype(np.uint32)


def shingles(words: list[bytes]) -> list[tuple[bytes, ...]]:
    """All runs of five words; of a shorter text, all of it."""
    return [tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))] if words else []


@dataclass
class Template:
    name: str
    shingles: frozenset[tuple[bytes, ...]]
    hashes: np.ndarray
    step: int
    size: int
    level: int
    bands: int


def _hash_words(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in words], dtype=np.uint64)


def _hash_shingles(word_hash: np.ndarray) -> np.ndarray:
    """Hashes of the five-word runs of a sequence of word hashes."""
    out = np.zeros(max(0, len(word_hash) - SHINGLE_WORDS + 1), dtype=np.uint64)
    for k in range(SHINGLE_WORDS):
        out = (out ^ word_hash[k : k + len(out)]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return out


def prepare(templates: dict[str, str]) -> list[Template]:
    made = []
    for name, text in templates.items():
        words = words_of(text)
        if len(words) < SHINGLE_WORDS:
            raise ValueError(f"template {name} has fewer than {SHINGLE_WORDS} words")
        own = frozenset(shingles(words))
        h = np.unique(_hash_shingles(_hash_words(words)))
        step = max(1, len(own) // 2)
        made.append(Template(name, own, h, step, len(own) + step, level_of(len(own)), bands_for(len(own))))
    return made


def _matches(words: list[bytes], n: int, found: np.ndarray, templates: list[Template]) -> list[tuple[str, int, float, int]]:
    """(template, matching windows, largest share, first word of the first window with it) for one text of n shingles; ``found``: rows
    (template, first shingle, last shingle) of what was retrieved in it."""
    out = []
    for i in np.unique(found[:, 0]).tolist():
        t = templates[i]
        last = max(0, ceil((n - t.size) / t.step))
        lo = np.clip((found[found[:, 0] == i, 1] - t.size) // t.step, 0, last)
        hi = np.clip(found[found[:, 0] == i, 2] // t.step, 0, last)
        windows = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi)]))
        count, best, first = 0, 0.0, 0
        for start in (windows * t.step).tolist():
            own = {tuple(words[k : k + SHINGLE_WORDS]) for k in range(start, min(start + t.size, n))}
            share = len(own & t.shingles) / len(t.shingles)
            if share >= SIMILARITY:
                count += 1
                if share > best:
                    best, first = share, start
        if count:
            out.append((t.name, count, best, first))
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs`` and template found in it: doc_id, license, n_windows (matching windows), containment (the largest
    share of the template's shingles in one), start_word (of the first such window).

    Words are lower-cased runs of ASCII letters and digits and of characters beyond ASCII. A null or empty text, or one of
    fewer than five words, holds no template. Repeated rows and null ids give their rows each; other columns are ignored;
    an empty table gives no row.
    """
    chosen = TEMPLATES if templates is None else templates

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = prepare(chosen)
        bands, level = Bands(ready), np.array([t.level for t in ready], dtype=np.int64)
        for batch in batches:
            for piece in slices(batch, "t"):
                texts = [words_of(t) for t in texts_of(piece, "t")]
                number: dict[bytes, int] = {}
                flat = np.fromiter((number.setdefault(w, len(number)) for words in texts for w in words), dtype=np.int64)
                word_hash = _hash_words(list(number))[flat] if len(flat) else np.zeros(0, dtype=np.uint64)
                found = bands.search(_short(_hash_shingles(word_hash)))
                ends = np.cumsum([len(words) for words in texts])
                starts = ends - [len(words) for words in texts]
                lo, hi = found[:, 1], found[:, 1] + 4 * level[found[:, 0]] - 1
                out, ids = [], piece.column(0).to_pylist()
                if len(found):  # a retrieval window may reach over several texts
                    first, after = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "right")
                    many = np.maximum(after - first, 0)
                    row = np.repeat(np.arange(len(found)), many)
                    text = np.repeat(first, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    inside = np.stack([found[row, 0], np.maximum(lo[row] - starts[text], 0), hi[row] - starts[text]], axis=1)
                    for i in np.unique(text).tolist():
                        n = len(texts[i]) - SHINGLE_WORDS + 1
                        if n > 0:
                            out += [(ids[i], *m) for m in _matches(texts[i], n, inside[text == i], ready)]
                names, types = ["doc_id", "license", "n_windows", "containment", "start_word"], [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, types)], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    return rows.mapInArrow(scan, "doc_id long, license string, n_windows long, containment double, start_word long")
