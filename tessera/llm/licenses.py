"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above."""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, lean, split_join



def _gnu(what: str, name: str, version: str, address: str) -> str:
    """The header that the GNU licenses give for source files."""
    return (
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation; "
        f"either version {version} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
        f"without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this {what}{address}"
    )


_SEE, _WRITE = ". If not, see https://www.gnu.org/licenses/.", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_GPL, _LGPL, _AGPL = "General Public License", "Lesser General Public License", "Affero General Public License"
#: Customary notices and headers of public licenses, by SPDX name (BSD, GPL and LGPL if no version is stated).
TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", _gnu("program", _AGPL, "3", _SEE)],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0."],
    "EPL-1.0": ["Licensed under the Eclipse Public License, version 1.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0.", "Eclipse Public License - v 2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GPL": ["This work is licensed under the GNU General Public License.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", _gnu("program", _GPL, "2", _WRITE), _gnu("program", _GPL, "2", _SEE)],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("program", _GPL, "3", _SEE)],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License."],
    "LGPL-2.1": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", _gnu("library", _LGPL, "2.1", _WRITE), _gnu("library", _LGPL, "2.1", _SEE)],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", _gnu("library", _LGPL, "3", _SEE)],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Proprietary": ["Copyright. All rights reserved.", "Unauthorized copying of this file is strictly prohibited."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: What yields to any other license of the same text: no version stated, and then nothing but rights reserved.
YIELDS = {"BSD": 1, "GPL": 1, "LGPL": 1, "Proprietary": 2}
#: Longest text, in characters, that is looked for inside others; longer ones are held against whole texts only.
SHORT = 2500


@cache
def license_texts() -> dict[str, str]:
    """Texts of whole licenses, read by the driver; the BSD text with two clauses is the other's without its third."""
    out = {p.stem: p.read_text("utf-8") for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}
    out["BSD-2-Clause"] = re.sub(r"3\. Neither .*?permission\.\s+", "", out["BSD-3-Clause"], flags=re.S)
    return out


def templates_with_texts(long: bool) -> dict[str, list[str]]:
    """TEMPLATES and the texts that are looked for inside others, or (``long``) all."""
    texts = {k: [t] for k, t in license_texts().items() if long or len(t) <= SHORT}
    return {k: TEMPLATES.get(k, []) + texts.get(k, []) for k in sorted(TEMPLATES.keys() | texts.keys())}


#: Least cosine of a notice line, of a whole license file.
NOTICE, WHOLE = 0.7, 0.6
LICENSE_FILE = re.compile(r"(?i)^(?:un)?(?:licen[cs]e|copying|copyright|notice)(?:[.\-_].*)?$")
#: How many sentences or lines, one after the other, are looked at together.
WINDOWS = (1, 2, 3, 4, 5, 6, 8, 10, 13, 16, 20, 25, 32)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
#: A version as a text states it, and families whose names must be read in a text to be its license.
_STATED = re.compile(r"(?i)(?:\bversions?|\bv\.?|license|licence|l?gpl|epl|mpl|cc0|apache|attribution|sharealike|noncommercial|cc by(?:-[a-z]{2})*)[\s,\-(]{0,3}v?\.?\s?(\d+(?:\.\d+)?)\b|\b(\d)[- ]clause")
_NAMES = frozenset("affero apache bsd cc0 commons eclipse gnu isc lesser library mit mozilla nc noncommercial sa sharealike".split()) - {"library"}
_TERM = re.compile(r"[^\W_]+(?:\.\d+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Templates:
    """Weighted templates; ``key`` terms are such that a text without one can't reach ``least``."""

    def __init__(self, df: dict[str, int], n: int, templates: dict[str, list[str]] = TEMPLATES, least: float = min(NOTICE, WHOLE)):
        self.n, self.df = n, df
        self.ids, self.vectors, self.names = [], [], []
        for name, texts in sorted(templates.items()):
            for t in texts:
                self.ids.append(name)
                counts = Counter(terms(t))
                self.vectors.append(self._unit(counts))
                self.names.append(_NAMES & counts.keys() if len(counts) < 20 or "affero" in counts else frozenset())
        self.index: dict[str, list[tuple[int, float]]] = {}
        for i, v in enumerate(self.vectors):
            for t, w in v.items():
                self.index.setdefault(t, []).append((i, w))
        self.key: set[str] = set()
        left = [1.0] * len(self.vectors)  # squared weight outside key terms
        for t in sorted(self.index, key=lambda t: (-self.idf(t), t)):
            if all(x < least * least for x in left):
                break
            self.key.add(t)
            for i, w in self.index[t]:
                left[i] -= w * w

    def idf(self, term: str) -> float:
        return math.log((1 + self.n) / (1 + self.df.get(term, 0))) + 1

    def _unit(self, counts: Counter) -> dict[str, float]:
        v = {t: (1 + math.log(c)) * self.idf(t) for t, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / norm for t, w in v.items()}

    def best(self, counts: Counter, stated: frozenset[float] = frozenset()) -> tuple[str | None, float]:
        """The template of the greatest cosine, the first by name of equal ones.

        Left out are templates of another version than the ones ``stated``, and notices that name
        a license of which the text has no word.
        """
        if self.key.isdisjoint(counts):
            return None, 0.0
        v = self._unit(counts)
        sums: dict[int, float] = {}
        for t, w in v.items():
            for i, x in self.index.get(t, ()):
                sums[i] = sums.get(i, 0.0) + w * x
        fit = [i for i in sums if (not stated or self.version(i) is None or self.version(i) in stated) and self.names[i] <= counts.keys()]
        if not fit:
            return None, 0.0
        i = min(fit, key=lambda i: (-round(sums[i], 9), i))
        return self.ids[i], sums[i]

    def version(self, i: int) -> float | None:
        m = _NUMBER.search(self.ids[i])
        return float(m[1]) if m else None


_NUMBER = re.compile(r"-(\d+(?:\.\d+)?)(?:-Clause)?$")


def stated(text: str) -> frozenset[float]:
    return frozenset(float(a or b) for a, b in _STATED.findall(text))


def statement(text: str | None, templates: Templates, texts: Templates | None = None, notice: float = NOTICE) -> tuple[str | None, float, str | None, float]:
    """Best notice among all lines, and among windows of sentences and lines, and best template (of ``texts``) of the text as a whole; null for none.

    Windows begin and end with a key term.  What YIELDS is stated only by a text without a notice of another license that reaches ``notice``.
    """
    if not text:
        return None, 0.0, None, 0.0
    whole: Counter = Counter()
    units: list[tuple[str, Counter] | None] = []  # None: without key terms
    lines: list[tuple[str, Counter]] = []
    keyed: list[int] = []
    for line in text.split("\n"):
        t = terms(line)
        if not t:
            continue
        whole.update(t)
        if templates.key.isdisjoint(t):
            units.append((line, Counter(t)))
            continue
        sentences = [x for x in _SENTENCE.split(line) if x]
        if len(sentences) > 1:
            lines.append((line, Counter(t)))
        for x in sentences:
            c = Counter(terms(x))
            if c:
                if not templates.key.isdisjoint(c):
                    keyed.append(len(units))
                units.append((x, c))
    found: list[tuple[str | None, float]] = [(None, 0.0)] * 3

    def judge(said: str, counts: Counter) -> None:
        name, score = templates.best(counts, stated(said))
        k = YIELDS.get(name, 0)
        if name and score > found[k][1] + 1e-9:
            found[k] = (name, score)

    for said, counts in lines:
        judge(said, counts)
    ends = set(keyed)
    for i in keyed:
        counts, said = Counter(), []
        for j in range(i, min(len(units), i + WINDOWS[-1])):
            counts.update(units[j][1])
            said.append(units[j][0])
            if j in ends and j - i + 1 in WINDOWS:
                judge(" ".join(said), counts)
    note = next((x for x in found if x[1] >= notice - 1e-9), max(found, key=lambda x: x[1]))
    texts = texts or templates
    return (*note, *(texts.best(whole, _whole_stated(text)) if not texts.key.isdisjoint(whole) else (None, 0.0)))


def _whole_stated(text: str) -> frozenset[float]:
    """Versions that the beginning of a text states; later ones may be those of other licenses."""
    m = _STATED.search(text[:1000])
    return frozenset([float(m[1] or m[2])]) if m else frozenset()


def document_frequencies(files: DataFrame, text: str, templates: dict[str, list[str]]) -> tuple[dict[str, int], int]:
    """In how many of all whole texts each term of the templates occurs (a bounded list), and the number of texts."""
    vocabulary = {t for texts in templates.values() for x in texts for t in terms(x)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for cell in batch.column(0):
                t = cell.as_py()
                sums[""] += 1
                if t:
                    sums.update(vocabulary.intersection(terms(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], ["t", "n"])

    got = {r.t: r.n for r in files.select(text).mapInArrow(lean(run), "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    return got, got.pop("", 0)


def scan(files: DataFrame, path: str = "path", text: str = "text", keep: list[str] | None = None, templates: dict[str, list[str]] | None = None, notice: float = NOTICE, whole: float = WHOLE) -> DataFrame:
    """The license of every file, stated by itself or inherited.

    Returns the columns in ``keep`` (the path by default), then ``stated string, stated_score
    double`` (the best notice among the file's lines, sentences and windows of several at ``notice`` or
    above, or of the whole text, also against whole licenses, at ``whole`` or above), ``is_license_file boolean``, ``inherited string, inherited_from string``
    (from the nearest directory, its own or above, that holds a license file) and ``license string``
    (stated, else inherited).

    A license file has a name that says so and a stated license, or a text that as a whole reaches
    ``whole``.  If a directory has several, the greatest score, then the first name and path, holds.
    Null and empty texts state nothing; very long ones are read whole.  A null path belongs to no
    directory and inherits nothing.  Of templates with the same cosine the first by name counts.
    Repeated rows are judged alike.  Columns that aren't kept are ignored, whatever their names (a
    kept one that is called as a result must be renamed by the caller); an empty table gives no rows.
    """
    spark: SparkSession = files.sparkSession
    scratch = Scratch(spark, "licenses")
    keep = [path] if keep is None else keep
    inside, every = (templates, templates) if templates is not None else (templates_with_texts(False), templates_with_texts(True))
    df, n = document_frequencies(files, text, every)
    shipped = spark.sparkContext.broadcast(pickle.dumps((Templates(df, n, inside, min(notice, whole)), Templates(df, n, every, whole))))
    frame = files.select(F.col(path).alias("_p"), F.col(text).alias("_t"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kept = [f"{f.name} {f.dataType.simpleString()}" for f in frame.schema[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notices, texts = pickle.loads(shipped.value)
        for batch in batches:
            names, scores, is_file = [], [], []
            for p, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                line, line_score, full, full_score = statement(cell.as_py(), notices, texts, notice)
                named = bool(p and LICENSE_FILE.match(p.rsplit("/", 1)[-1]))
                line, line_score = (line, line_score) if line_score >= notice - 1e-9 else (None, 0.0)
                full, full_score = (full, full_score) if full_score >= whole - 1e-9 else (None, 0.0)
                best = full if full is not None and (line is None or line in YIELDS or (full not in YIELDS and full_score > line_score)) else line
                names.append(best)
                scores.append(round(max(line_score, full_score), 6))
                is_file.append(full is not None or (named and best is not None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(is_file, pa.bool_()), *batch.columns[2:]], ["_p", "s", "c", "f", *batch.schema.names[2:]])

    judged = scratch.table(frame.mapInArrow(lean(run), ", ".join(["_p string, s string, c double, f boolean", *kept])), "judged")
    depth = F.size(F.split("_p", "/")) - 1
    directory = lambda k: F.array_join(F.slice(F.split("_p", "/"), 1, k), "/")
    holders = judged.where("f and _p is not null").select(directory(depth).alias("dir"), F.struct((-F.col("c")).alias("c"), "s", "_p").alias("best")).groupBy("dir").agg(F.min("best").alias("best"))
    holders = holders.select("dir", F.col("best.s").alias("license"))
    # every directory meets its ancestors once, however many files it holds
    here = judged.where("_p is not null").select(directory(depth).alias("at")).distinct()
    parts = F.split("at", "/")
    up = here.select("at", F.explode(F.sequence(F.lit(0), F.when(F.col("at") == "", 0).otherwise(F.size(parts)))).alias("k")).select("at", "k", F.when(F.col("k") == 0, "").otherwise(F.array_join(F.slice(parts, 1, F.col("k")), "/")).alias("dir"))
    nearest = up.join(holders, "dir").groupBy("at").agg(F.max_by(F.struct("license", "dir"), "k").alias("from"))
    # the directories of files are counted, so that what a hot one inherits is brought to its files
    held = judged.withColumn("at", directory(depth))
    known = scratch.table(held.where("at is not null").groupBy("at").agg(F.count("*").alias("n")).join(nearest, "at", "left"), "known")
    out = split_join(held.where("at is not null"), known, "at", "n").drop("n").unionByName(held.where("at is null").withColumn("from", F.lit(None).cast(known.schema["from"].dataType)))
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("s").alias("stated"), F.col("c").alias("stated_score"), F.col("f").alias("is_license_file"), F.col("from.license").alias("inherited"), F.col("from.dir").alias("inherited_from"), F.coalesce("s", F.col("from.license")).alias("license"))
