"""Licence statements in texts, by sentence rules.

A text is cut into sentences, at the marks that end them and at blank lines. A normalised sentence
(lower-cased words, single spaces) is mapped to the identifier of a known licence sentence; where a
sentence as a whole is unknown, each of its lines is looked up, since texts often set a licence line
among lines without end marks. The identifiers, in text order and with the unknown sentences
between them, are matched against rules. A rule is an ordered sequence of identifiers that names a
licence; at most ``max_gap`` unknown sentences may lie between two steps. Longer rules are tried
first and a sentence serves one rule, so the text of a licence is not reported again as a mere
reference. Known sentences that serve no rule are counted, not lost.

The sentences and rules are small fixed tables that travel with the tasks; nothing is shuffled.

Defined cases: a null text counts as empty and has no licence. Every row gives one row, repeated
rows too. Whole texts are read, however long. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modelsieve.llm.common import text_of

MAX_GAP = 2

# Sentences of public licences and notices.
SENTENCES: dict[str, str] = {
    "mit-reference": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software."
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "mit-liability": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
        "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
        "OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-reference": "Licensed under the Apache License, Version 2.0.",
    "apache-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License."
    ),
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-disclaimer": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        "on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "apache-limits": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-reference": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-reference": "This work is licensed under the GNU General Public License, version 2.",
    "gpl3-redistribute": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "gpl-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
        "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "bsd-redistribute": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd": "Licensed under CC BY-ND 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
}

# Licence, kind of evidence, and the sentences in order.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", "text", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", "reference", ("mit-reference",)),
    ("MIT", "reference", ("mit-licensed",)),
    ("Apache-2.0", "notice", ("apache-header", "apache-copy", "apache-disclaimer", "apache-limits")),
    ("Apache-2.0", "notice", ("apache-header", "apache-disclaimer")),
    ("Apache-2.0", "reference", ("apache-header",)),
    ("Apache-2.0", "reference", ("apache-reference",)),
    ("GPL-3.0-or-later", "notice", ("gpl3-redistribute", "gpl-hope", "gpl-details", "gpl-received")),
    ("GPL-3.0-or-later", "notice", ("gpl3-redistribute", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", "reference", ("gpl3-redistribute",)),
    ("GPL-3.0-only", "reference", ("gpl3-reference",)),
    ("GPL-2.0-only", "reference", ("gpl2-reference",)),
    ("BSD-3-Clause", "text", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", "text", ("bsd-redistribute", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", "reference", ("cc-by",)),
    ("CC-BY-SA-4.0", "reference", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", "reference", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", "reference", ("cc-by-nd",)),
    ("CC0-1.0", "notice", ("cc0",)),
    ("LicenseRef-all-rights-reserved", "reference", ("reserved",)),
)

#: A sentence ends at a mark before white space, at a colon that ends its line, at a blank line or with the text.
_SENTENCE = re.compile(
    r"(?:[^.!?:\n]|[.!?](?=\S)|:(?![^\S\n]*(?:\n|$))|\n(?![^\S\n]*\n))+[.!?:]*"
)
_WORD = re.compile(r"[^\W_]+")


def normal(sentence: str) -> str:
    return " ".join(_WORD.findall(sentence.lower()))


@dataclass(frozen=True)
class Found:
    licence: str
    kind: str
    start: int
    end: int


class Recogniser:
    """Sentence table and rules, ready to read texts."""

    def __init__(
        self,
        sentences: Mapping[str, str] = SENTENCES,
        rules: Sequence[tuple[str, str, tuple[str, ...]]] = RULES,
        max_gap: int = MAX_GAP,
    ) -> None:
        self.known = {normal(text): name for name, text in sentences.items()}
        self.by_first: dict[str, list[tuple[str, str, tuple[str, ...]]]] = {}
        for rule in sorted(rules, key=lambda r: -len(r[2])):
            self.by_first.setdefault(rule[2][0], []).append(rule)
        # A cheap test: a text without any of the words that known sentences share has none.
        self.words = re.compile("|".join(sorted(_cover(self.known))), re.IGNORECASE)
        self.max_gap = max_gap

    def sentences(self, text: str) -> list[tuple[str | None, int, int]]:
        """Identifier (None if unknown) and span of each sentence or, within unknown ones, line."""
        found: list[tuple[str | None, int, int]] = []
        for m in _SENTENCE.finditer(text):
            name = self.known.get(normal(m.group()))
            if name is not None or "\n" not in m.group():
                found.append((name, *_trimmed(text, *m.span())))
                continue
            at = m.start()
            for line in m.group().split("\n"):
                if line.strip():
                    found.append((self.known.get(normal(line)), *_trimmed(text, at, at + len(line))))
                at += len(line) + 1
        return [f for f in found if f[1] < f[2]]

    def read(self, text: str) -> tuple[list[str], list[Found], int]:
        """Known sentence identifiers, licences found, and known sentences that serve no rule."""
        if not self.words.search(text):
            return [], [], 0
        sequence = self.sentences(text)
        known = [i for i, s in enumerate(sequence) if s[0] is not None]
        used: set[int] = set()
        licences = []
        for i in known:
            if i in used:
                continue
            for licence, kind, names in self.by_first.get(sequence[i][0], ()):
                steps = self._steps(sequence, i, names, used)
                if steps:
                    used.update(steps)
                    licences.append(Found(licence, kind, sequence[steps[0]][1], sequence[steps[-1]][2]))
                    break
        return [sequence[i][0] for i in known], licences, len(known) - len(used)

    def _steps(self, sequence: list, first: int, names: tuple[str, ...], used: set[int]) -> list[int] | None:
        steps, at = [first], first + 1
        for name in names[1:]:
            gap = 0
            while at < len(sequence) and (sequence[at][0] != name or at in used):
                gap += 1
                at += 1
                if gap > self.max_gap:
                    return None
            if at >= len(sequence):
                return None
            steps.append(at)
            at += 1
        return steps


def _trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    while start < end and text[start].isspace():
        start += 1
    while end > start and text[end - 1].isspace():
        end -= 1
    return start, end


def _cover(sentences: Mapping[str, str]) -> set[str]:
    """A few words such that every sentence holds one of them, the most shared first."""
    left = [set(s.split()) for s in sentences]
    chosen: set[str] = set()
    while left:
        counts: dict[str, int] = {}
        for words in left:
            for w in words:
                if len(w) >= 6:
                    counts[w] = counts.get(w, 0) + 1
        best = max(sorted(counts), key=lambda w: counts[w]) if counts else min(left[0], key=lambda w: (-len(w), w))
        chosen.add(best)
        left = [words for words in left if best not in words]
    return chosen


def licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: Mapping[str, str] = SENTENCES,
    rules: Sequence[tuple[str, str, tuple[str, ...]]] = RULES,
    max_gap: int = MAX_GAP,
) -> DataFrame:
    """One row per document: id, ``licences`` (distinct, sorted), ``spans`` (``licence:kind:start:end``
    in text order, comma-joined), ``sentence_ids``, ``n_known``, ``n_unused``."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Recogniser(sentences, rules, max_gap)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.id, batch.body, strict=True):
                names, found, unused = reader.read(text)
                spans = ",".join(f"{f.licence}:{f.kind}:{f.start}:{f.end}" for f in found)
                rows.append((doc, sorted({f.licence for f in found}), spans, names, len(names), unused))
            out = pd.DataFrame(rows, columns=["id", "licences", "spans", "sentence_ids", "n_known", "n_unused"])
            out["id"] = out["id"].astype(batch.id.dtype)
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("body")).mapInPandas(
        scan, f"id {kind}, licences array<string>, spans string, sentence_ids array<string>, n_known bigint, n_unused bigint"
    )
    return found.withColumnRenamed("id", id_col)
