"""Operator 5: license scans by sentences and ordered rules.

A text is cut into lines and sentences, each normalised to lower-case words. What starts
and ends with a line or a sentence and has the words of a known licence sentence becomes
an identifier, whether it is wrapped over lines or not. A sentence ends at punctuation, at
a line without words or at a line break after less than ``WRAPPED`` characters. Identifier
sequences are matched against ordered rules: a rule's sentences must follow one another in
its order with at most ``GAP`` other sentences between two of them. Longer rules are tried
first, and a sentence counts for one match only.

Null and empty texts match nothing. Repeated rows are scanned alike; extra columns are
ignored. One row per document, no shuffle.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm import texts

#: Other sentences allowed between two sentences of a rule.
GAP = 3
#: Characters from which a line without punctuation at its end goes on in the next, when
#: sentences are counted. Known sentences are found over lines of any length.
WRAPPED = 40

# Sentences as licence texts and notices have them.
SENTENCES = {
    "apache2-notice": "Licensed under the Apache License, Version 2.0",
    "apache2-compliance": "you may not use this file except in compliance with the License",
    "apache2-obtain": "You may obtain a copy of the License at",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "mit-notice": "Released under the MIT License",
    "mit-title": "The MIT License",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    "cc-by-nc4-notice": "Licensed under CC BY-NC 4.0",
    "cc-by4-notice": "Licensed under CC BY 4.0",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "all-rights": "All rights reserved",
}
#: Further wordings of a sentence.
VARIANTS = {
    "apache2-notice": [
        "Licensed under the Apache License, Version 2.0 (the \"License\")",
        "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\")",
    ],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "mit-title": ["MIT License", "The MIT License (MIT)", "MIT License (MIT)"],
    "mit-condition": ["The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"],
    "as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-INFRINGEMENT",
    ],
}
#: Licence and the sentences that show it, in order.
RULES = [
    ("Apache-2.0", ("apache2-notice", "apache2-compliance", "apache2-obtain")),
    ("Apache-2.0", ("apache2-notice",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("MIT", ("mit-title", "mit-permission", "mit-condition", "as-is")),
    ("MIT", ("mit-permission", "mit-condition", "as-is")),
    ("MIT", ("mit-title", "mit-condition", "as-is")),
    ("MIT", ("mit-condition", "as-is")),
    ("MIT", ("mit-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-notice",)),
    ("CC-BY-4.0", ("cc-by4-notice",)),
    ("All-Rights-Reserved", ("all-rights",)),
]

_ends = re.compile(r"((?<=[.!?;])\s+|[\r\n]\s*)")
_words = re.compile(r"[a-z0-9]+")


def normalise(sentence: str) -> str:
    return " ".join(_words.findall(sentence.lower()))


def known_sentences(sentences: dict[str, str] = SENTENCES, variants: dict[str, list[str]] = VARIANTS) -> dict[str, str]:
    """Normalised wording to identifier."""
    return {normalise(s): name for name, s in sentences.items()} | {
        normalise(s): name for name in sentences for s in variants.get(name, ())
    }


def beginnings(known: dict[str, str]) -> frozenset[str]:
    """What known sentences begin with, to the end of each word but the last."""
    return frozenset(s[:i] for s in known for i, c in enumerate(s) if c == " ")


def marked(text: str, known: dict[str, str], words: frozenset[str], starts: frozenset[str]) -> list[tuple[int, int, str]]:
    """Known sentences: numbers of the sentences where each begins and ends, identifier."""
    marks, at, open_ = [], 0, []
    # open_: (number, words so far) of what began at an earlier line and may go on, and the
    # mark that each has made; a longer wording takes the place of a shorter one.
    pieces = _ends.split(text)
    for k in range(0, len(pieces), 2):
        s = pieces[k]
        low = s.lower()
        # Known sentences are few: their first word is looked up before more is done.
        first = _words.search(low)
        if first is None:
            # A line without words ends what is open.
            at, open_ = at + bool(open_ or s), []
            continue
        goes_on = open_ or first[0] in words
        own = " ".join(_words.findall(low)) if goes_on else ""
        if first[0] in words:
            open_.append((at, "", None))
        kept = []
        for begin, before, mark in open_:
            so_far = f"{before} {own}" if before else own
            if name := known.get(so_far):
                if mark is None:
                    mark = len(marks)
                    marks.append(None)
                marks[mark] = (begin, at, name)
            if so_far in starts:
                kept.append((begin, so_far, mark))
        open_ = kept
        ends = pieces[k + 1] if k + 1 < len(pieces) else ""
        sentence_ends = s[-1:] in ".!?;" or ends.count("\n") > 1 or ends.count("\r") > 1
        if sentence_ends:
            open_ = []
        if sentence_ends or len(s) < WRAPPED:
            at += 1
    return sorted(marks)


def scan(text: str, known: dict[str, str], words: frozenset[str], rules=None,
         starts: frozenset[str] | None = None) -> tuple[list[str], list[int]]:
    """Licences found and the number of the sentence where each begins."""
    marks = marked(text, known, words, beginnings(known) if starts is None else starts)
    found, used = [], set()
    for licence, names in sorted(rules or RULES, key=lambda r: -len(r[1])):
        for i in range(len(marks)):
            if i in used or marks[i][2] != names[0]:
                continue
            path = [i]
            for name in names[1:]:
                last = marks[path[-1]][1]
                step = next((j for j in range(path[-1] + 1, len(marks))
                             if marks[j][0] - last <= GAP + 1 and marks[j][2] == name and j not in used), None)
                if step is None:
                    break
                path.append(step)
            if len(path) == len(names):
                used.update(path)
                found.append((marks[i][0], licence))
    found.sort()
    return [x for _, x in found], [at for at, _ in found]


def scan_documents(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """Per row: id, licences (distinct, sorted), n_matches, first_sentence (null: none)."""
    known = known_sentences(sentences)
    starts = beginnings(known)
    words = frozenset(s.split(" ", 1)[0] for s in known)
    id_type = df.schema[id_column].dataType.simpleString()

    def make(batch: pa.RecordBatch) -> dict:
        found = [scan(t, known, words, rules, starts) for t in texts.strings(batch, text_column)]
        return {
            id_column: batch.column(id_column),
            "licences": [",".join(sorted(set(x))) for x, _ in found],
            "n_matches": [len(x) for x, _ in found],
            "first_sentence": [at[0] if at else None for _, at in found],
        }

    return texts.map_slices(
        df.select(id_column, text_column), text_column, make,
        f"`{id_column}` {id_type}, licences string, n_matches bigint, first_sentence bigint",
    )


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_documents(texts.documents(spark, sf_dir))
