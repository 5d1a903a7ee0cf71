"""License notices and whole license texts: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates and texts become bare lower-case words.  If ``e`` of a template's ``m`` words may be missing,
the others form at most ``e + 1`` runs, so some run has at least ``(m - e) / (e + 1)`` words.  Of each
window of so many words of a template, the gram that comes first (rarest first) is selected.  An inverted
index of the selected grams, whose size is bounded by the templates, gives template, place and diagonal of
each hit in a text.  A missing word takes away as many selected grams as it has words at most, so
a match must hold several of them.

Notices (up to ``LONG`` words) have grams of one word, which words added in between do not break; hits
near one diagonal lead to a banded alignment of the whole notice.  Whole texts have grams of two words;
their hits are chained along diagonals, also over interruptions, and the words between
neighbours in a chain are aligned in a band around it.
"""

from __future__ import annotations

import math
import pkgutil
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axonframe.llm.tables import map_batches, text_rows
from axonframe.llm.words import REMEMBERED, mix

#: Opening or notice lines of common licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "MIT": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

#: Further notices, of which some differ by one word, and names.  Names of up to four words need every word.
NOTICES = {
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "AGPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "AGPL-network": (
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users "
        "interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the "
        "Corresponding Source of your version by providing access to the Corresponding Source from a network server at no charge"
    ),
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "CC-BY-NC-SA-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    "CC-BY-4.0-name": "CC BY 4.0",
    "CC-BY-SA-4.0-name": "CC BY-SA 4.0",
    "CC-BY-ND-4.0-name": "CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0-name": "CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0-name": "CC BY-NC-ND 4.0",
    "CC0-1.0-name": "CC0 1.0",
    "LGPL-name": "Lesser General Public License",
    "LGPL-2.0-name": "Library General Public License",
    "AGPL-name": "Affero General Public License",
    "GNU-LGPL-name": "GNU LGPL",
    "GNU-AGPL-name": "GNU AGPL",
    "ISC-name": "ISC License",
    "Unlicense-name": "The Unlicense",
    "BSL-1.0-name": "Boost Software License",
    "EPL-name": "Eclipse Public License",
    "EUPL-name": "European Union Public Licence",
    "OFL-name": "SIL Open Font License",
    "AFL-name": "Academic Free License",
    "MS-PL-name": "Microsoft Public License",
    "Artistic-2.0-name": "Artistic License 2.0",
}

#: Licenses whose whole text is a template, named with "-text" (files in ``licenses``).
WHOLE = (
    "0BSD", "AFL-2.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-SA-4.0", "CC0-1.0",
    "EPL-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0",
    "OFL-1.1", "PSF-2.0", "Unicode-3.0", "Unlicense", "WTFPL", "Zlib",
)

#: Templates of more words are whole texts.
LONG = 40

#: A line that names the license of a file; several identifiers may be joined.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*(\(*[A-Za-z0-9][\w.+-]*\)*(?:[ \t]+(?:AND|OR|WITH|and|or|with)[ \t]+\(*[A-Za-z0-9][\w.+-]*\)*)*)")

#: Words that are common in texts of any kind; an anchor is one of them only if there are too few others.
COMMON = frozenset(
    "a all an and any are as at be by can do following for free from general in is it of on open or other provided public software "
    "source terms that the this to under use version with without work you copy person form following hereby license licensed".split()
)

#: Words by which an alignment may leave its diagonal, to either side.
BAND = 8

#: Words of a gram of whole texts, how often it may occur in a template to be chained, and earlier hits that a hit may follow.
GRAM = 2
FEW = 4
LOOK = 1024

_SCHEMA = "row_id BIGINT, license STRING, coverage DOUBLE, matched BIGINT, start BIGINT, stop BIGINT"


class _Bare(dict):
    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, word: str) -> int:
        bare = "".join(filter(str.isalnum, word.lower()))
        self[word] = slot = len(self.hashes)
        self.hashes.append(xxhash.xxh3_64_intdigest(bare.encode("utf-8", "surrogatepass")) if bare else 0)
        return slot


class Hasher:
    """Hashes of the bare words of a text; 0 where a word has no letters or digits."""

    def __init__(self) -> None:
        self.slots = _Bare()

    def of(self, words: list[str]) -> np.ndarray:
        if len(self.slots) > REMEMBERED:
            self.slots = _Bare()
        at, back = np.unique(np.fromiter(map(self.slots.__getitem__, words), np.int64, len(words)), return_inverse=True)
        return np.array([self.slots.hashes[i] for i in at.tolist()], np.uint64)[back] if len(words) else np.zeros(0, np.uint64)


def all_templates() -> dict[str, str]:
    """The notices and the whole texts."""
    texts = {f"{name}-text": pkgutil.get_data("axonframe.llm", f"licenses/{name}.txt").decode("utf-8") for name in WHOLE}
    return {**TEMPLATES, **NOTICES, **texts}


def needed_words(size: int, coverage: float) -> int:
    return max(1, math.ceil(coverage * size - 1e-9))


def _masks(words: list[int]) -> dict[int, int]:
    """For each word, a bit at each of its places."""
    masks: dict[int, int] = {}
    for i, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def _common(masks: dict[int, int], m: int, words: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence with a template of ``m`` words, and the first place that completes it."""
    # Bit-parallel: the zero bits of v count matched words.
    full = v = (1 << m) - 1
    best, last = 0, -1
    for i, word in enumerate(words):
        mask = masks.get(word)
        if mask is None:
            continue
        some = v & mask
        if some:
            v = ((v + some) | (v - some)) & full
            n = m - v.bit_count()
            if n > best:
                best, last = n, i
    return best, last


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """One number for each run of ``size`` words."""
    out = hashes
    for i in range(1, size):
        out = mix(out[:-1]) + hashes[i:]
    return out


def longest_run(size: int, needed: int) -> int:
    """Words in a row that are left of ``size`` wherever the missing ones are."""
    return -(-needed // (size - needed + 1))


def winnowed(order: np.ndarray, window: int) -> np.ndarray:
    """Places that come first in one of the windows."""
    if len(order) <= window:
        return np.array([order.argmin()]) if len(order) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(order, window)
    return np.unique(np.arange(len(views)) + views.argmin(axis=1))


class Fingerprints:
    """Inverted index from the selected grams of templates, given as hashed words, to template and place."""

    def __init__(self, words: list[np.ndarray], needed: list[int], size: int):
        runs = [longest_run(len(w), k) for w, k in zip(words, needed) if len(w)]
        self.size = max(1, min([size, *runs]))
        own = [grams(w, self.size) for w in words]
        usual = np.array(sorted(Hasher().of(sorted(COMMON)).tolist()), np.uint64)
        every, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *own]), return_counts=True)
        rows, self.required = [], np.ones(len(words), np.int64)
        self.repeats = []
        for i, (w, g) in enumerate(zip(words, own)):
            common = sum(np.isin(w[j : j + len(g)], usual).astype(np.int64) for j in range(self.size))
            often = counts[np.searchsorted(every, g)]
            order = np.empty(len(g), np.int64)
            order[np.lexsort((np.arange(len(g)), often, common))] = np.arange(len(g))
            places = winnowed(order, longest_run(len(w), needed[i]) - self.size + 1) if len(g) else np.zeros(0, np.int64)
            self.required[i] = max(1, len(places) - self.size * (len(w) - needed[i]))
            _, back, same = np.unique(g, return_inverse=True, return_counts=True)
            rows.append((g[places], np.full(len(places), i), places, same[back[places]] if len(g) else places))
        keys, template, place, repeats = (np.concatenate([np.zeros(0, kind), *c]) for kind, c in zip((np.uint64, np.int64, np.int64, np.int64), zip(*rows) if rows else [()] * 4))
        at = np.lexsort((place, template, keys))
        self.template, self.place, self.repeats = template[at], place[at], repeats[at]
        self.keys, self.low, self.many = np.unique(keys[at], return_index=True, return_counts=True)

    def hits(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the text, entry of the index), ascending, of each selected gram in the text."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = grams(hashes, self.size)
        key = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        some = np.flatnonzero(self.keys[key] == found)
        low, size = self.low[key[some]], self.many[key[some]]
        entry = np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)
        return np.repeat(some, size), entry


class Index:
    """Notices with the index of their selected words."""

    def __init__(self, templates: dict[str, str], coverage: float = 0.8):
        hasher = Hasher()
        self.names = sorted(templates)
        self.words = []
        for name in self.names:
            hashes = hasher.of(templates[name].split())
            self.words.append(hashes[hashes != 0])
        self.needed = [needed_words(len(w), coverage) for w in self.words]
        self.masks = [_masks(w.tolist()) for w in self.words]
        self.prints = Fingerprints(self.words, self.needed, 1)
        self.longest = max(map(len, self.words), default=0)

    def hits(self, hashes: np.ndarray) -> list[tuple[int, int]]:
        """(template, place in the text where it would begin), ascending, where enough selected words are near that diagonal."""
        at, entry = self.prints.hits(hashes)
        reach = len(hashes) + self.longest + 4 * BAND
        key = np.sort(self.prints.template[entry] * reach + at - self.prints.place[entry] + self.longest)
        near = np.searchsorted(key, key + 2 * BAND, "right") - np.searchsorted(key, key - 2 * BAND)
        key = np.unique(key[near >= self.prints.required[key // reach]])
        return list(zip((key // reach).tolist(), (key % reach - self.longest).tolist()))

    def found(self, hashes: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Template to (-matched, first, last) of its matches; they may overlap."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        words: list[int] = []
        for template, begin in self.hits(hashes):
            words = words or hashes.tolist()
            size, needed = len(self.words[template]), self.needed[template]
            # An alignment that holds the anchor may have its diagonal up to BAND beside it.
            most, _ = _common(self.masks[template], size, words[max(0, begin - 2 * BAND) : max(0, begin + size + 2 * BAND)])
            if most < needed:
                continue
            best = (0, 0, 0)
            for off in sorted(range(-BAND, BAND + 1), key=abs):
                n, first, last = aligned(self.words[template], hashes, begin + off)
                if n > best[0]:
                    best = (n, first, last)
                if n == most:
                    break
            if best[0] >= needed:
                out.setdefault(template, []).append((-best[0], *best[1:]))
        return out


def aligned(template: np.ndarray, text: np.ndarray, begin: int) -> tuple[int, int, int]:
    """(matched words, first, last place) of the best common subsequence near the diagonal at ``begin``."""
    m, width = len(template), 2 * BAND + 1
    none = (0, begin, begin - 1)

    def better(cell: tuple[int, int, int]) -> tuple[int, int, int]:
        """More words first, then a start close to the diagonal, then an early end."""
        return cell[0], -abs(cell[1] - begin), -cell[2]

    # best[o]: (matched, first, last) with the text place i + begin + o - BAND for template place i.
    best = [none] * (width + 1)
    for i in range(m):
        row = []
        left = none
        for o in range(width):
            at = begin + i + o - BAND
            cell = max(best[o + 1], left, key=better)
            if 0 <= at < len(text) and text[at] == template[i]:
                n, first, _ = best[o]
                cell = max(cell, (n + 1, first if n else at, at), key=better)
            row.append(cell)
            left = cell
        best = [*row, none]
    return max(best, key=better)


def chained(x: np.ndarray, p: np.ndarray, cost: float) -> list[np.ndarray]:
    """Hits at text places ``x`` (ascending) and template places ``p`` in chains that ascend in both, longest first.

    A word by which neighbours leave their diagonal, beyond ``BAND``, costs as much as ``cost`` hits.  Each
    hit is in one chain, and follows one of the ``LOOK`` before it.
    """
    score, before = np.ones(len(x)), np.full(len(x), -1)
    most = 1.0
    for i in range(1, len(x)):
        if score[i - 1] == most and x[i] - x[i - 1] == p[i] - p[i - 1] > 0:  # Nothing better to follow.
            score[i], before[i] = most + 1, i - 1
        else:
            low = max(0, i - LOOK)
            dx, dp = x[i] - x[low:i], p[i] - p[low:i]
            reach = np.where((dx > 0) & (dp > 0), score[low:i] - cost * np.maximum(0, np.abs(dx - dp) - BAND), 0.0)
            j = i - 1 - int(reach[::-1].argmax())
            if reach[j - low] > 0:
                score[i], before[i] = reach[j - low] + 1, j
        most = max(most, score[i])
    chains, used = [], np.zeros(len(x), bool)
    for end in np.argsort(-score, kind="stable").tolist():
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = int(before[end])
        if chain:
            chains.append(np.array(chain[::-1]))
    return sorted(chains, key=len, reverse=True)


def _reach(words: int) -> int:
    """Words of a text next to a hit in which so many of a template are looked for."""
    return words + max(BAND, words // 4)


def _between(template: list[int], text: list[int]) -> int:
    """Words in common, in order, of which those of the text lie in the band behind the left end or before the right end."""
    if template == text or not template or not text:
        return len(template) if template == text else 0
    reach = _reach(len(template))
    near = text if len(text) <= 2 * reach else text[:reach] + text[-reach:]
    return _common(_masks(template), len(template), near)[0]


def sure_hits(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Hits of a chain with at least two neighbours on their diagonal, or all if there are none; others are left to the alignment."""
    turns = np.flatnonzero(np.diff(x - p)) + 1
    sizes = np.diff(np.concatenate([[0], turns, [len(x)]]))
    sure = np.repeat(sizes >= 3, sizes)
    return sure if sure.any() else ~sure


def aligned_chain(template: list[int], text: list[int], x: list[int], p: list[int]) -> tuple[int, int, int]:
    """(matched words, first, last place) of the banded alignment around a chain."""
    head, tail = template[: p[0]][::-1], template[p[-1] + 1 :]
    ahead, first = _common(_masks(head), len(head), text[max(0, x[0] - _reach(len(head))) : x[0]][::-1])
    behind, last = _common(_masks(tail), len(tail), text[x[-1] + 1 : x[-1] + 1 + _reach(len(tail))])
    inner = sum(_between(template[p[i] + 1 : p[i + 1]], text[x[i] + 1 : x[i + 1]]) for i in range(len(x) - 1))
    return len(x) + ahead + inner + behind, x[0] - 1 - first, x[-1] + 1 + last


class Wholes:
    """Whole texts with the index of their selected grams."""

    def __init__(self, templates: dict[str, str], coverage: float):
        hasher = Hasher()
        self.names = sorted(templates)
        words = []
        for name in self.names:
            hashes = hasher.of(templates[name].split())
            words.append(hashes[hashes != 0])
        self.words = [w.tolist() for w in words]
        self.needed = [needed_words(len(w), coverage) for w in words]
        self.prints = Fingerprints(words, self.needed, GRAM)
        # Half of what missing words leave: the other half is room for added ones.
        self.required = np.maximum(1, self.prints.required // 2)
        self.few = self.prints.repeats <= FEW
        self.chainable = np.bincount(self.prints.template[self.few], minlength=len(words))

    def found(self, bare: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """Template to (-matched, first, last) of its matches; they may overlap."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        if len(bare) < self.prints.size or not self.names:
            return out
        at, entry = self.prints.hits(bare)
        held = np.bincount(self.prints.template[np.unique(entry)], minlength=len(self.names))
        possible = np.flatnonzero(held >= self.required).tolist()
        text = bare.tolist() if possible else []
        of, place = self.prints.template[entry], self.prints.place[entry]
        for t in possible:
            # A template that only repeats itself is chained by all of its grams.
            own = (of == t) & self.few[entry] if self.chainable[t] >= self.required[t] else of == t
            x, p, size = at[own], place[own], len(self.words[t])
            least = max(1, min(self.required[t], self.chainable[t] // 20))
            for chain in chained(x, p, len(np.unique(p)) / (4 * size)):
                if len(chain) < least:
                    break
                chain = chain[sure_hits(x[chain], p[chain])]
                n, first, last = aligned_chain(self.words[t], text, x[chain].tolist(), p[chain].tolist())
                if n >= self.needed[t]:
                    out.setdefault(t, []).append((-n, first, last))
        return out


def _told_apart(rows: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """Without those of which another license has more words, or all in all a larger share, in nearly the same span."""
    rows = sorted(rows, key=lambda r: (r[3], r[4]))
    worse = set()
    for i, (name, share, n, first, last) in enumerate(rows):
        for j in range(i + 1, len(rows)):
            other = rows[j]
            if other[3] > last:
                break
            common, either = min(last, other[4]) - other[3] + 1, max(last, other[4]) - first + 1
            if other[0] != name and common >= 0.8 * either and (n, share) != (other[2], other[1]):
                worse.add(i if (n, share) < (other[2], other[1]) else j)
    return [r for i, r in enumerate(rows) if i not in worse]


def tags(text: str) -> list[tuple[str, float, int, int, int]]:
    """A row for each license that an SPDX line names; the span is the whole tag."""
    out = []
    for tag in SPDX.finditer(text) if "SPDX-License-Identifier:" in text else ():
        names = [w.strip("()") for w in tag.group(1).split()]
        out.extend((name, 1.0, len(tag.group().split()), *tag.span()) for name in dict.fromkeys(names) if name.upper() not in ("AND", "OR", "WITH"))
    return out


def matches(text: str, index: Index, hasher: Hasher, wholes: Wholes) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, start, stop) of one text, by start; spans of one license do not overlap."""
    hashes = hasher.of(text.split())
    places = np.flatnonzero(hashes)
    bare = hashes[places]
    out = []
    ranked = [(known.names[t], len(known.words[t]), sorted(set(options))) for known in (index, wholes) for t, options in known.found(bare).items()]
    for name, size, options in ranked:
        taken: list[tuple[int, int]] = []
        for n, first, last in options:
            if all(last < a or first > b for a, b in taken):
                taken.append((first, last))
                out.append((name, -n / size, -n, first, last))
    if not out:
        return []
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    out = [(name, share, n, spans[places[first]][0], spans[places[last]][1]) for name, share, n, first, last in _told_apart(out)]
    return sorted(out, key=lambda r: (r[3], r[0], r[4]))


def _scan(templates, tagged: bool, coverage: float):
    def run(batches):
        short, long = {}, {}
        for name, text in templates.value.items():
            (long if sum(any(map(str.isalnum, w)) for w in text.split()) > LONG else short)[name] = text
        index, wholes, hasher = Index(short, coverage), Wholes(long, coverage), Hasher()

        def rows_of(text):
            return matches(text, index, hasher, wholes) + (tags(text) if tagged else [])

        for batch in batches:
            rows = [(i, *found) for i, text in enumerate(text_rows(batch.column(1))) for found in rows_of(text)]
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], ["row_id", "license", "coverage", "matched", "start", "stop"])

    return run


def license_scan(
    docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """License notices, whole license texts and SPDX lines: row_id, license, coverage (share of the template's words), matched, start, stop.

    One row per notice or text; positions are code points of the text, the stop exclusive.  A text may
    hold several notices, also of one license; those do not overlap.  Whole texts may be interrupted; around a
    chain the alignment may count a few words less than the longest common subsequence (3 % at most in tests).  Where two templates match
    nearly the same stretch, the one with more words in it is reported, then the one with the
    larger share; ties are both reported.  An SPDX line gives a row per identifier.  Null and empty texts have
    none.  Repeated rows and null ids are kept; other columns are ignored; an empty table gives
    no rows.  ``templates`` (name to text) must fit in memory; with given ones, SPDX lines are not looked for.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(all_templates() if templates is None else templates)
    return map_batches(source, _scan(shared, templates is None, coverage), _SCHEMA)
