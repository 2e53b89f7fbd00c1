"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

Templates are short grants, the standard multi-line headers and the full texts in ``licenses``. Every line of a file
and every window of a template's number of words, across lines and inside long ones, is a possible header: its terms,
weighted by TF-IDF, are compared with the templates, and the best one above ``least`` names the file's licence. A
template is slid over a file only if the terms that the file has of it can reach ``least`` at all (by Cauchy-Schwarz
the cosine is at most the length of the template's vector on these terms), so nothing is missed. An SPDX tag names
its first identifier known here with score 1; tags are read as such, for tags of other licences differ in one word. A file is a licence file if its name says so (``LICENSE``,
``COPYING``, ...) and it has a header, or if its whole text, taken as one vector, reaches ``whole_least``; it
licenses its directory. Files without a licence of their own take that of the nearest directory above them that has
one: each directory lists its ancestors, a few rows as deep as its path, and joins the licensed ones by path.

Document frequencies are those of all lines of the corpus, for the terms of the templates (a fixed list); every other
term weighs as one that occurs once, so a line of other words stays far from every template. The rows that weigh the
lines are made per batch and hold no more than the batch.

Defined results: null and empty texts have no licence of their own but inherit; a null path is the root; files with
equal paths are rows of their own; ties go to the first template in the order of the names, to the earliest line, and
between licence files of one directory to the best score, then the smallest path; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernlake.llm.common import small, stored

#: Short grants by which files name a licence, by SPDX identifier.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.", "Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
_OF_GNU = "as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
_ONLY_GNU = "as published by the Free Software Foundation, version {v} of the License."
_NO_WARRANTY = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {n} for more details."


def _gnu(subject: str, name: str, v: str, dated: str) -> list[str]:
    start = f"This {subject} is free software; you can redistribute it and/or modify it under the terms of the {name} "
    body = [start + _OF_GNU.format(v=v), start + _ONLY_GNU.format(v=v)]
    plain = [f"{name} Version {v}, {dated}", f"This work is licensed under the {name}, version {v}.", f"Licensed under the {name}, version {v}.", f"Released under the {name} v{v}."]
    return [*body, *[x + _NO_WARRANTY.format(n=name) for x in body], *plain]


_GNU = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"
#: Standard headers and titles, and grants by other names.
HEADERS: dict[str, list[str]] = {
    "AGPL-3.0": _gnu("program", _GNU[2], "3", "19 November 2007"),
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Released under the Apache License 2.0.",
    ],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License."],
    "GPL-2.0": _gnu("program", _GNU[0], "2", "June 1991"),
    "GPL-3.0": _gnu("program", _GNU[0], "3", "29 June 2007"),
    "LGPL-2.1": _gnu("library", _GNU[1], "2.1", "February 1999"),
    "LGPL-3.0": _gnu("library", _GNU[1], "3", "29 June 2007"),
    "MIT": ["Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
}
_SPDX = re.compile(r"SPDX-License-Identifier:([^\n]*)", re.IGNORECASE)


def known_templates() -> dict[str, list[str]]:
    """All templates; the full texts lie beside this module and are read on the driver."""
    texts = {p.stem: [p.read_text("utf-8")] for p in (Path(__file__).parent / "licenses").glob("*.txt")}
    return {k: [*TEMPLATES.get(k, []), *[x for x in HEADERS.get(k, []) if x not in TEMPLATES.get(k, [])], *texts.get(k, [])] for k in sorted({*TEMPLATES, *HEADERS, *texts})}


def spdx(line: str, names: list[str]) -> str | None:
    """The first identifier of a tag that is among ``names``; ``-only``, ``-or-later`` and ``+`` are left out."""
    known = {n.lower(): n for n in names}
    for tag in _SPDX.findall(line):
        for word in re.findall(r"[a-z0-9.+-]+", tag.lower()):
            name = re.sub(r"(-only|-or-later|\+)$", "", word)
            if name in known:
                return known[name]
    return None


#: Names of licence files, without regard to case.
LICENSE_NAME = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
LEAST, WHOLE_LEAST = 0.75, 0.9
_TERM = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
_OWN = "row long, path string, name_says boolean, license string, score double, line int, whole_license string, whole_score double"


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


class Templates:
    """Unit TF-IDF vectors of the templates, by term; ``lines`` is the number of lines, ``df`` their terms' counts."""

    def __init__(self, templates: dict[str, list[str]], df: dict[str, int], lines: int):
        self.df, self.lines, self.names = df, max(1, lines), sorted(templates)
        self.unseen = self.idf(0)
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        self.headers: set[int] = set()
        self.vectors: dict[int, tuple[int, dict[str, float]]] = {}
        for k, name in enumerate(self.names):
            for i, text in enumerate(sorted(templates[name])):
                tf = terms(text)
                v = self.weights(tf)
                norm = math.sqrt(sum(x * x for x in v.values()))
                if text in HEADERS.get(name, ()) and text not in TEMPLATES.get(name, ()):
                    self.headers.add(k * 1000 + i)
                self.vectors[k * 1000 + i] = tf.total(), {t: x / norm for t, x in v.items()}
                for term, x in v.items():
                    self.by_term.setdefault(term, []).append((k * 1000 + i, x / norm))

    def idf(self, n: int) -> float:
        return math.log((self.lines + 1) / (n + 1)) + 1

    def weights(self, tf: Counter) -> dict[str, float]:
        return {t: (1 + math.log(n)) * (self.idf(self.df[t]) if t in self.df else self.unseen) for t, n in tf.items()}

    def best(self, tf: Counter, whole: bool = False) -> tuple[str | None, float]:
        """The nearest template's licence and the cosine to it; a whole file is not compared with the headers of source files."""
        shared = [t for t in tf if t in self.by_term]
        if not shared:
            return None, 0.0
        v = self.weights(tf)
        dots: dict[int, float] = {}
        for t in shared:
            for k, x in self.by_term[t]:
                if not (whole and k in self.headers):
                    dots[k] = dots.get(k, 0.0) + v[t] * x
        if not dots:
            return None, 0.0
        k = min(dots, key=lambda k: (-dots[k], k))
        return self.names[k // 1000], dots[k] / math.sqrt(sum(x * x for x in v.values()))

    def best_window(self, tokens: list[str], tf: Counter, least: float) -> tuple[str | None, float, int]:
        """The best window of a template's number of words that reaches ``least``: licence, cosine and first word."""
        reach: dict[int, float] = {}
        for t in tf:
            for k, x in self.by_term.get(t, ()):
                reach[k] = reach.get(k, 0.0) + x * x
        best: tuple[str | None, float, int] = (None, 0.0, 0)
        for k in sorted(k for k, x in reach.items() if x >= least * least - 1e-9):
            score, at = self._slide(tokens, *self.vectors[k])
            if score >= least and (score > best[1] + 1e-9 or (score > best[1] - 1e-9 and best[0] == self.names[k // 1000] and at < best[2])):
                best = self.names[k // 1000], score, at
        return best

    def _slide(self, tokens: list[str], size: int, v: dict[str, float]) -> tuple[float, int]:
        """The highest cosine to ``v`` of ``size`` words in a row and where they start."""
        idf = {t: self.idf(self.df[t]) if t in self.df else self.unseen for t in set(tokens)}
        n: Counter = Counter()
        dot = square = 0.0
        best, at = 0.0, 0
        for i, t in enumerate(tokens):
            for term, step in ((t, 1), (tokens[i - size] if i >= size else None, -1)):
                if term is not None:
                    c = n[term]
                    old, new = (1 + math.log(c)) * idf[term] if c else 0.0, (1 + math.log(c + step)) * idf[term] if c + step else 0.0
                    n[term] = c + step
                    square += new * new - old * old
                    dot += (new - old) * v.get(term, 0.0)
            if i >= min(size, len(tokens)) - 1 and dot > 0 and (c := min(1.0, dot / math.sqrt(square))) > best + 1e-9:
                best, at = c, max(0, i - size + 1)
        return best, at


def line_frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[dict[str, int], int]:
    """In how many lines of all files each term of the vocabulary occurs, and the number of lines."""
    known = frozenset(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found: Counter = Counter()
            for text in b["text"]:
                for line in (text or "").split("\n"):
                    found[""] += 1
                    found.update(known.intersection(_TERM.findall(line.lower())))
            yield pd.DataFrame(list(found.items()), columns=["term", "n"])

    # one row for each term of the templates: its size doesn't depend on the corpus
    got = {r["term"]: int(r["n"]) for r in files.mapInPandas(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return {t: got.get(t, 0) for t in vocabulary}, got.get("", 0)


def own_licenses(files: DataFrame, templates: Templates, least: float) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                best, at, whole, seen, tokens, begins = (None, 0.0), None, Counter(), {}, [], []
                for i, line in enumerate((text or "").split("\n")):
                    words = _TERM.findall(line.lower())
                    begins.append(len(tokens))
                    tokens += words
                    tf = Counter(words)
                    whole.update(tf)
                    key = line if len(line) < 400 else None
                    got = seen[key] if key in seen else templates.best(tf)
                    if key is not None:
                        seen[key] = got
                    if "spdx-" in line.lower() and (tag := spdx(line, templates.names)):
                        got = tag, 1.0
                    if got[1] > best[1] + 1e-12:
                        best, at = got, i
                name, score, first = templates.best_window(tokens, whole, least)
                # a line that names the same licence keeps its place and score
                if score > best[1] + 1e-9 and (best[1] < least or name != best[0]):
                    best, at = (name, score), bisect_right(begins, first) - 1
                rows.append((*best, at, *templates.best(whole, True)))
            own = pd.DataFrame(rows, columns=["license", "score", "line", "whole_license", "whole_score"], index=b.index)
            yield pd.concat([b[["row", "path", "name_says"]], own], axis=1)[[c.split()[0] for c in _OWN.split(", ")]].astype({"line": "Int32"})

    return files.mapInPandas(run, _OWN)


def _directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan_licenses(files: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST, whole_least: float = WHOLE_LEAST) -> DataFrame:
    """One row per file: id, path, license, score, basis (header, file, inherited or none), line (of the header, from 0), from_dir."""
    templates = known_templates() if templates is None else templates
    clean = F.regexp_replace(F.coalesce(path, F.lit("")), r"^/+|/+$", "")
    seen = files.select(F.col(id_col).cast("long").alias("row"), clean.alias("path"), F.col(text_col).alias("text"))
    seen = seen.withColumn("name_says", F.regexp_extract("path", r"[^/]*$", 0).rlike(LICENSE_NAME))
    vocabulary = sorted({t for texts in templates.values() for x in texts for t in terms(x)})
    df, lines = line_frequencies(seen, vocabulary)
    own = stored(own_licenses(seen, Templates(templates, df, lines), least))

    whole = F.col("whole_score") >= whole_least
    header = F.col("score") >= least
    own = own.withColumn("dir", _directory(F.col("path"))).withColumn("grants", whole | (F.col("name_says") & header))
    granted = F.when(whole, F.col("whole_license")).otherwise(F.col("license"))
    score = F.when(whole, F.col("whole_score")).otherwise(F.col("score"))
    # one licence for each directory, combined before the shuffle
    dirs = own.where("grants").groupBy("dir").agg(F.min(F.struct((-score).alias("less"), "path", "row", granted.alias("license"))).alias("g"))
    dirs = stored(dirs.select(F.col("dir").alias("above"), F.col("g.license").alias("dir_license"), (-F.col("g.less")).alias("dir_score")))

    without = own.where(~F.col("grants") & ~header)
    steps = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, 1, k), "/"))
    # directories, not files, climb the tree: a directory of many files asks once
    asked = without.select("dir").distinct().select("dir", F.explode(F.array_distinct(ancestors)).alias("above"))
    nearest = asked.join(small(dirs, dirs.count()), "above").groupBy("dir").agg(F.max(F.struct(F.char_length("above").alias("n"), "above", "dir_license", "dir_score")).alias("up"))
    out = own.join(nearest, "dir", "left")
    basis = F.when(F.col("grants"), "file").when(header, "header").when(F.col("up").isNotNull(), "inherited").otherwise("none")
    pick = lambda f, h, i: F.when(F.col("grants"), f).when(header, h).otherwise(i)
    return out.select(
        F.col("row").alias(id_col),
        "path",
        pick(granted, F.col("license"), F.col("up.dir_license")).alias("license"),
        F.round(F.coalesce(pick(score, F.col("score"), F.col("up.dir_score")), F.lit(0.0)), 9).alias("score"),
        basis.alias("basis"),
        F.when(~F.col("grants") & header, F.col("line")).alias("line"),
        F.when(F.col("grants"), F.col("dir")).when(~header, F.col("up.above")).alias("from_dir"),
    )
