"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from winnow.llm.common import stored, text_or_empty
from winnow.operators.grouping import for_skewed_join

# How licences are commonly named and granted in headers and licence files.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal license.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 3 of the License, or (at "
        "your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": ("Copyright. All rights reserved.",),
}
LEAST = 0.75
# Sentences that are read together.
RUN = 8
LICENCE_FILES = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense)([.-][^/]*)?$"

# Words of a mention may stand on two lines, with the marks of a comment between them.
_CUE = re.compile(
    r"licen[cs]|copyright|permission\W+is\W+hereby|redistribut|all\W+rights\W+reserved|spdx|public\W+domain|creative\W+commons",
    re.I,
)
# Sentences of single lines, and of paragraphs: lines up to one without a word.
_BREAKS = (re.compile(r"(?<=[.!?;:])\s+|\n"), re.compile(r"(?<=[.!?;:])\s+|\n(?:[^\w\n]*\n)+"))
_TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)?")


def terms_of(text: str) -> list[str]:
    """Words and figures in lower case; 3 and 3.0 are one term."""
    return [t.removesuffix(".0") for t in _TERM.findall(text.lower())]


def passages_of(text: str) -> list[str]:
    """Sentences and lines with a mention of a licence, each alone and together with those right before it."""
    out = []
    for cut in _BREAKS if _CUE.search(text) else ():
        run = []
        for sentence in cut.split(text):
            if _CUE.search(sentence):
                run = [*run[-RUN + 1 :], sentence]
                out += [sentence] if len(run) == 1 else [sentence, " ".join(run)]
            elif sentence.strip():
                run = []
    return out


def near_mentions(text: str, reach: int) -> Iterator[tuple[list[str], list[tuple[int, int]]]]:
    """The terms up to `reach` from a mention, over line and sentence ends, and the first and last term of each mention.

    Mentions with terms in common come together.
    """
    lowered = text.lower()
    starts, terms = array("q"), []
    for term in _TERM.finditer(lowered):
        starts.append(term.start())
        terms.append(term[0].removesuffix(".0"))
    together: list[tuple[int, int]] = []

    def piece() -> tuple[list[str], list[tuple[int, int]]]:
        low = max(0, together[0][0] - reach)
        return terms[low : together[-1][1] + reach + 1], [(a - low, b - low) for a, b in together]

    for cue in _CUE.finditer(lowered):
        first, last = bisect_right(starts, cue.start()) - 1, bisect_left(starts, cue.end()) - 1
        if together and first - reach > together[-1][1] + reach:
            yield piece()
            together = []
        together.append((first, last))
    if together:
        yield piece()


def term_weights(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> dict[str, float]:
    """The inverse document frequency, over all files, of every term of the templates; as many as these have."""
    vocabulary = frozenset(t for texts in templates.values() for text in texts for t in terms_of(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = Counter(), 0
        for batch in batches:
            for text in batch.column("text"):
                found.update(vocabulary.intersection(terms_of(text.as_py())))
                rows += 1
        found[""] = rows
        yield pa.RecordBatch.from_pydict({"term": list(found), "n": list(found.values())})

    counts = files.select(text_or_empty().alias("text")).mapInArrow(count, "term string, n long")
    held = {r["term"]: r["n"] for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    rows = held.pop("", 0)
    return {t: 1.0 + log((1 + rows) / (1 + held.get(t, 0))) for t in sorted(vocabulary)}


class Matcher:
    """Cosine of passages and templates as sparse vectors. Terms that no template has weigh most."""

    def __init__(self, weights: dict[str, float], templates: dict[str, tuple[str, ...]]):
        self.weights = weights
        self.unknown = max(weights.values(), default=1.0)
        self.templates = [(name, self._vector(text)) for name in sorted(templates) for text in templates[name]]
        self.widths: dict[int, list[tuple[str, dict[str, float]]]] = {}
        texts = [text for name in sorted(templates) for text in templates[name]]
        for template, text in zip(self.templates, texts, strict=True):
            for width in widths_for(len(terms_of(text))):
                self.widths.setdefault(width, []).append(template)
        # By how often a term occurs, its weight's factor.
        self.factors = [0.0, *(1 + log(n) for n in range(1, max(self.widths, default=0) + 1))]

    def _vector(self, text: str) -> dict[str, float]:
        raw = {t: (1 + log(n)) * self.weights.get(t, self.unknown) for t, n in Counter(terms_of(text)).items()}
        length = sqrt(sum(v * v for v in raw.values()))
        return {t: v / length for t, v in raw.items()}

    def best(self, text: str) -> tuple[str | None, float]:
        """The licence of the closest template to any passage or window of the text; of equal ones the first by name."""
        found: tuple[float, str | None] = (0.0, None)
        for passage in dict.fromkeys(passages_of(text)):
            vector = self._vector(passage)
            for name, template in self.templates:
                found = _closer(found, sum(v * vector.get(t, 0.0) for t, v in template.items()), name)
        if _CUE.search(text):
            for terms, mentions in near_mentions(text, max(self.widths, default=0)):
                found = self._best_window(terms, mentions, found)
        return found[1], found[0]

    def _best_window(
        self, terms: list[str], mentions: list[tuple[int, int]], found: tuple[float, str | None]
    ) -> tuple[float, str | None]:
        """The closest of what was found and of all windows that hold a part of a mention, for each template of its widths."""
        there = set(terms)
        # No window is closer to a template than the terms in common allow.
        bounds = {
            width: max(sqrt(sum(v * v for t, v in template.items() if t in there)) for _, template in group)
            for width, group in self.widths.items()
        }
        for width in sorted(bounds, key=lambda w: (-bounds[w], w)):
            if bounds[width] < found[0] - 1e-12:
                break
            found = self._slide(terms, mentions, width, found)
        return found

    def _slide(
        self, terms: list[str], mentions: list[tuple[int, int]], width: int, found: tuple[float, str | None]
    ) -> tuple[float, str | None]:
        group, factors = self.widths[width], self.factors
        counts: dict[str, int] = {}
        products, square = [0.0] * len(group), 0.0
        begin = end = 0
        for first, last in mentions:
            for start in range(max(begin, first - width + 1), max(0, min(last, len(terms) - width)) + 1):
                stop = min(start + width, len(terms))
                if start >= end:
                    counts, products, square, begin, end = {}, [0.0] * len(group), 0.0, start, start
                for at, step in [*((i, -1) for i in range(begin, start)), *((i, 1) for i in range(end, stop))]:
                    term = terms[at]
                    n = counts.get(term, 0)
                    counts[term] = n + step
                    weight, old, new = self.weights.get(term, self.unknown), factors[n], factors[n + step]
                    square += weight * weight * (new * new - old * old)
                    for k, (_, template) in enumerate(group):
                        if term in template:
                            products[k] += template[term] * weight * (new - old)
                begin, end = start, stop
                length = sqrt(square)
                for k, (name, _) in enumerate(group):
                    found = _closer(found, products[k] / length, name)
        return found


def widths_for(length: int) -> set[int]:
    """The widths of the windows that are compared with a template of so many terms.

    Its own, a quarter less for grants that are cut short, and a quarter more
    for those with words or marks put in.
    """
    return {length - length // 4, length, length + length // 4 + 1} if length else set()


def _closer(found: tuple[float, str | None], cosine: float, name: str) -> tuple[float, str | None]:
    better = cosine > found[0] + 1e-12 or (found[1] and abs(cosine - found[0]) <= 1e-12 and name < found[1])
    return (cosine, name) if better else found


def scan(files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(id, path, own_license, score, license, inherited_from) of every row of (id, path, text).

    `own_license` is that of the template with the largest cosine to a passage
    or to a window of about its own length around a mention, over line ends,
    anywhere in the text, if it is `least` or more; `score` is that cosine. A file
    without one has the licence of the nearest directory, its own or one
    above it, that holds a licence file (by name) with a licence of its own;
    `inherited_from` is that directory, '' the root. Of several licence files
    in a directory the highest score counts, then the first by path and name.
    A null text is empty; a file without a path inherits nothing. Repeated
    rows are all given; other columns are left out.
    """
    weights = term_weights(files, templates)
    matcher = Matcher(weights, templates)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matcher.best(t.as_py()) for t in batch.column("text")]
            names = pa.array([n for n, _ in found], pa.string())
            scores = pa.array([s for _, s in found], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("path"), names, scores], names=["id", "path", "closest", "score"]
            )

    rows = files.select(F.col("id").cast("bigint").alias("id"), "path", text_or_empty().alias("text"))
    found = rows.mapInArrow(match, "id long, path string, closest string, score double")
    own = F.when(F.col("score") >= least, F.col("closest"))
    found = stored(found.select("id", "path", own.alias("own_license"), "score", _directory("path").alias("dir")), "licences")

    order = F.struct((-F.col("score")).alias("s"), "path", F.col("own_license").alias("l"))
    granted = found.filter(F.col("own_license").isNotNull() & F.col("path").rlike(LICENCE_FILES))
    granted = granted.groupBy("dir").agg(F.min(order)["l"].alias("granted"))
    # Directories, not files, look upwards: one row per directory and level.
    above = found.filter("dir is not null").select("dir").distinct()
    above = above.select(F.col("dir").alias("below"), F.explode(_and_above("dir")).alias("dir"))
    nearest = above.join(granted, "dir").groupBy(F.col("below").alias("dir")).agg(
        F.max(F.struct(F.length("dir").alias("depth"), F.col("dir").alias("from"), "granted")).alias("near")
    )
    inherits = F.col("own_license").isNull() & F.col("near").isNotNull()
    return found.join(for_skewed_join(nearest, "dir"), "dir", "left").select(
        "id",
        "path",
        "own_license",
        "score",
        F.coalesce("own_license", "near.granted").alias("license"),
        F.when(inherits, F.col("near.from")).alias("inherited_from"),
    )


def _directory(path: str) -> Column:
    return F.regexp_replace(F.col(path), "/?[^/]*$", "")


def _and_above(directory: str) -> Column:
    """The directory and all above it, down to the root ''."""
    parts = F.split(F.col(directory), "/")
    levels = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(F.split(F.col(directory), "/"), 1, k), "/")
    )
    return F.array_distinct(F.concat(F.array(F.lit("")), levels))
