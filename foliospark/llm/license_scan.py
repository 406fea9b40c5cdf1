"""License scans (op5): passages of a text compared with licence templates by the Dice coefficient of word bigrams.

Passages are the lines, the sentences of a line, the paragraphs (runs of lines without a blank one), the whole text and
all other runs of consecutive sentences, whatever lines they stand on. Both sides are normalised: lower case, punctuation dropped, copyright phrases
dropped, white space unified. A template of b bigrams can reach a score of t only against passages of t/(2-t) b to
(2-t)/t b bigrams, of which at most 2b (1-t)/t are not its own; other templates are not compared. Of runs that overlap,
the best counts.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter, OrderedDict
from importlib.resources import files
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Public licence texts and the short notices that refer to licences.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
        "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
        CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "ISC": [
        "Released under the ISC License.",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
        DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
        TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the
        copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    ],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "MPL-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "Proprietary": ["All rights reserved."],
}
#: The complete texts; they come first, so that a list ends with its own texts.
for _file in sorted(files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
    TEMPLATES[_file.name.removesuffix(".txt")].insert(0, _file.read_text(encoding="utf-8"))

WORD = re.compile(r"[^\W_]+")
#: Where a sentence of a line ends and the next begins.
SENTENCE_END = re.compile(r"(?<=[.;:!?])[\"')\]]*\s+(?=\S)")
WORDS = WORD.findall
#: From the mark to the end of the sentence or line; a bare "copyright" can be prose.
COPYRIGHT = re.compile(r"^[^\w\n]*(?:copyright[ \t]*(?:\(c\)|©|(?=[<\[]?(?:19|20)\d\d))|\(c\)[ \t]*(?:copyright\b|(?=(?:19|20)\d\d))|©)[^\n]*?(?:[.;](?=[ \t]+\S)|$)", re.I | re.M)


class Template(NamedTuple):
    name: str
    grams: frozenset


def bigrams(text: str) -> set[tuple[str, str]]:
    words = WORDS(text.lower())
    return set(zip(words, words[1:], strict=False))


class Scanner:
    """Compares passages with templates in order of size; a passage without any bigram of a template is left at once."""

    def __init__(self, templates: dict[str, list[str]], threshold: float):
        if not 0 < threshold <= 1:
            raise ValueError("0 < threshold <= 1")
        self.threshold = threshold
        self.templates = sorted((Template(name, frozenset(bigrams(COPYRIGHT.sub("", t)))) for name, texts in templates.items() for t in texts), key=lambda t: (len(t.grams), t.name))
        self.sizes = [len(t.grams) for t in self.templates]
        self.known = frozenset().union(*(t.grams for t in self.templates))
        self.owners: dict = {}
        for k, t in enumerate(self.templates):
            for g in t.grams:
                self.owners.setdefault(g, []).append(k)

    def best(self, grams: set) -> tuple[str, float] | None:
        """Licence and score of the best template at or above the threshold; the first by name of equal ones."""
        shared = grams & self.known
        if not shared:
            return None
        n, t = len(grams), self.threshold
        low = bisect.bisect_left(self.sizes, n * t / (2 - t) - 1e-9)
        high = bisect.bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        found = [(-2 * len(shared & x.grams) / (n + len(x.grams)), x.name) for x in self.templates[low:high]]
        score, name = min(found, default=(0.0, ""))
        return (name, -score) if -score >= t - 1e-12 else None

    def kept(self, line: str) -> tuple[int, list[str]]:
        """Start and words of what follows the copyright phrase: the end of the line that matches best, else the next sentence."""
        tokens = [(m.start(), m.group().lower()) for m in WORD.finditer(line)]
        words, grams, found = [w for _, w in tokens], set(), []
        most = max(self.sizes, default=0) * (2 - self.threshold) / self.threshold
        for k in range(len(words) - 2, -1, -1):
            grams.add((words[k], words[k + 1]))
            if len(grams) > most:
                break
            if (words[k], words[k + 1]) in self.known and (hit := self.best(grams)):
                found.append((-hit[1], k))
        past = COPYRIGHT.match(line).end()
        k = min(found)[1] if found else next((k for k, (at, _) in enumerate(tokens) if at >= past), len(tokens))
        return (tokens[k][0] if k < len(tokens) else 0), words[k:]

    def scan(self, text: str) -> list[tuple[str, int, int, str, float]]:
        """(kind, start, end, licence, score) of every line, sentence, paragraph of several lines and text of several lines that matches, and of the best other runs of sentences."""
        out: list[tuple] = []
        spans: list[tuple] = []
        parts: list[tuple] = []
        whole = Passage()
        paragraph = Passage()
        at, several = 0, False

        def enter(kind: str, start: int, end: int, first: int, last: int, grams: set) -> None:
            if grams & self.known and (found := self.best(grams)):
                out.append((kind, start, end, *found))
                spans.append((first, last))

        def close(p: Passage, kind: str) -> None:
            if p.lines > 1:
                enter(kind, p.start, p.end, p.first, p.final, p.grams)

        for line, low in zip(text.split("\n"), text.lower().split("\n"), strict=True):
            end, start = at + len(line), at
            if COPYRIGHT.match(line):
                skip, words = self.kept(line)
                start += skip
            else:
                skip, words = 0, WORDS(low)
            if words:
                grams = set(zip(words, words[1:], strict=False))
                first = len(parts)
                # no passage begins or ends inside a line without a bigram of a template
                cuts = [m.end() for m in SENTENCE_END.finditer(line, skip)] if grams & self.known else []
                if cuts:
                    for a, z in zip([skip, *cuts], [*cuts, len(line)], strict=True):
                        if own := WORDS(line[a:z].lower()):
                            parts.append((at + a, at + len(line[:z].rstrip()), own, set(zip(own, own[1:], strict=False))))
                if len(parts) - first > 1:
                    for k in range(first, len(parts)):
                        enter("sentence", *parts[k][:2], k, k, parts[k][3])
                else:
                    del parts[first:]
                    parts.append((start, end, words, grams))
                enter("line", start, end, first, len(parts) - 1, grams)
                for p in (whole, paragraph):
                    p.add(words, grams, start, end, first, len(parts) - 1)
            elif not line.strip() and paragraph.lines:
                close(paragraph, "paragraph")
                paragraph, several = Passage(), True
            at = end + 1
        if several:  # a text of one paragraph is compared once
            close(paragraph, "paragraph")
        close(whole, "text")
        return out + self.runs(parts, whole.grams, out, spans) if len(parts) > 1 else out

    def runs(self, lines: list[tuple], every: set, out: list[tuple], spans: list[tuple]) -> list[tuple]:
        """The best runs of `lines` (sentences) that don't overlap. A passage of `out` with the same licence, or over half of the words, stands for runs that score no better."""
        t = self.threshold
        counts = Counter(k for g in every & self.known for k in self.owners[g])
        able = {k for k, n in counts.items() if n >= self.sizes[k] * t / (2 - t) - 1e-9}
        if not able:
            return []
        matches: dict[tuple[int, int], tuple[float, str]] = {}
        seen: OrderedDict = OrderedDict()  # bigrams from a line on with the line that completes them first, the nearest last
        for i in range(len(lines) - 1, -1, -1):
            own = list(lines[i][3])
            across = [(lines[i][2][-1], lines[i + 1][2][0])] if i + 1 < len(lines) else []
            for k, g in [(i + 1, g) for g in across] + [(i, g) for g in own]:
                seen[g] = k
                seen.move_to_end(g)
            # a run that begins or ends with a line without bigrams of the template is worse than the one without that line
            for x in {x for g in own + across for x in self.owners.get(g, ()) if x in able}:
                self.ends(i, seen, self.templates[x], matches)
        taken = [(-score, start, end, name, False) for (_, _, _, name, score), (start, end) in zip(out, spans, strict=True)]
        order = sorted(taken + [(score, *run, name, True) for run, (score, name) in matches.items()], key=lambda r: (r[0], r[4], r[2] - r[1], r[1], r[3]))
        sums = [0]
        for x in lines:
            sums.append(sums[-1] + len(x[2]))
        used, covered, found = bytearray(len(lines)), {}, []
        any_licence = bytearray(len(lines))
        for score, start, end, name, new in order:
            mine = covered.setdefault(name, bytearray(len(lines)))
            if new:
                if used.find(1, start, end + 1) >= 0 or mine.find(1, start, end + 1) >= 0:
                    continue
                if 2 * sum(sums[k + 1] - sums[k] for k in range(start, end + 1) if any_licence[k]) >= sums[end + 1] - sums[start]:
                    continue
                found.append(("run", lines[start][0], lines[end][1], name, -score))
                used[start : end + 1] = b"\1" * (end + 1 - start)
            else:
                mine[start : end + 1] = any_licence[start : end + 1] = b"\1" * (end + 1 - start)
        return found

    def ends(self, start: int, seen: OrderedDict, template: Template, matches: dict) -> None:
        """Enters the runs from a line on that match a template, under (first, last line) with the best of their templates."""
        b, t, n, shared, last, fresh = len(template.grams), self.threshold, 0, 0, start, False

        def enter() -> None:
            score = -2 * shared / (n + b)
            if fresh and last > start and -score >= t - 1e-12:
                matches[start, last] = min((score, template.name), matches.get((start, last), (0.0, "")))

        for g, at in reversed(seen.items()):
            if at != last:
                enter()
                last, fresh = at, False
            n += 1
            if g in template.grams:
                shared, fresh = shared + 1, True
            elif n - shared > 2 * b * (1 - t) / t + 1e-9:
                return
        enter()


class Passage:
    """Consecutive lines and their word bigrams, those across line ends included; `first` to `final` are its sentences."""

    def __init__(self):
        self.grams: set = set()
        self.lines, self.first, self.final, self.start, self.end, self.last = 0, 0, 0, 0, 0, None

    def add(self, words: list[str], grams: set, start: int, end: int, first: int, final: int) -> None:
        self.grams |= grams
        if self.last is not None:
            self.grams.add((self.last, words[0]))
        else:
            self.start, self.first = start, first
        self.last, self.end, self.final = words[-1], end, final
        self.lines += 1


def license_spans(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, kind, start, end (code points), license, dice: one row per passage that matches a template.

    Null and empty texts have none. Rows that share a doc_id are scanned each; a null doc_id stays null.
    """
    templates = templates or TEMPLATES

    def run(it):
        scanner = Scanner(templates, threshold)
        for batch in it:
            rows = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in scanner.scan(t or "")]
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names=["doc_id", "kind", "start", "end", "license", "dice"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, kind string, start long, end long, license string, dice double")


def license_scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, n_matches, licenses: one row per document; license is null where nothing matches.

    license and dice are of the best passage (ties: the first licence by name), licenses are all names in order.
    Null and empty texts match nothing. Empty table: empty result. Other columns are ignored.
    """
    templates = templates or TEMPLATES
    types = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.string())]

    def run(it):
        scanner = Scanner(templates, threshold)
        for batch in it:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = scanner.scan(text or "")
                score, name = min(((-f[4], f[3]) for f in found), default=(None, None))
                rows.append((doc, name, None if score is None else -score, len(found), sorted({f[3] for f in found})))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, types, strict=True)], names=["doc_id", "license", "dice", "n_matches", "licenses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, license string, dice double, n_matches long, licenses array<string>")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences that every row of `documents` names or carries."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
