"""License scans by a positional index of rare words.

A template is the wording of a license notice with key phrases it must not
lack. The index holds, for each template, the words of its key phrases that
have the highest inverse document frequency over all documents, and the
positions at which they stand in it. Of a file the words that are in the index
(its license words of highest frequency rank) are looked up; each place of such
a word votes, for every posting, for the place at which the template would
begin. Where all rare words of one template vote for places within its slack
there is a candidate; there its key phrases must all stand at their places
relative to the first, within the slack, and the words in the template's place
must be those of the template to a least share, weighted by inverse document
frequency. That share is the placement's score. Placements add labels to the
base ones: a base phrase is found wherever its words stand one after the other,
and scores 1.

The lookup loses nothing: whatever passes the key phrases holds all the rare
words, as these are taken from them, and nothing is capped, so a long file with
many license words of one kind loses none of another kind. Document frequencies
are taken over all documents of the table, for the words of templates only,
whose number is that of the templates' words; each template counts as one more
document, so that small tables rank words sensibly.

Defined cases: a null text is the empty text; texts without words have 0 words,
no places, no labels and the score 0; ties of document frequency go by word;
repeated rows get the same result each; an empty table gives an empty result.
Columns of the caller with the names of added ones are replaced. Texts are
taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayline.llm.asciiwords import words
from wayline.llm.common import small_batches, table, whole


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...]


# Phrases of the contract with their labels, and notices of public licenses.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
TEMPLATES = (
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
        ("permission is hereby granted free of charge", "to deal in the software without restriction", "shall be included in all copies or substantial portions of the software"),
    ),
    Template(
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing", "permissions and limitations under the license"),
    ),
    Template(
        "bsd-2-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES""",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice", "other materials provided with the distribution this software is provided by"),
    ),
    Template(
        "bsd-3-clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.""",
        ("redistribution and use in source and binary forms", "redistributions of source code must retain the above copyright notice", "may be used to endorse or promote products derived from this software"),
    ),
    Template(
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
        ("this software for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    Template(
        "gpl-2",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
        ("the terms of the gnu general public license as published by the free software foundation", "version 2 of the license"),
    ),
    Template(
        "gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ("the terms of the gnu general public license as published by the free software foundation", "version 3 of the license"),
    ),
    Template("gpl-2", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template(
        "lgpl-2.1",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        ("the terms of the gnu lesser general public license as published by the free software foundation", "version 2 1 of the license"),
    ),
    Template(
        "agpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
        ("the terms of the gnu affero general public license as published by the free software foundation", "version 3 of the license"),
    ),
    Template(
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
        ("subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    ),
    Template(
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        ("free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ),
    Template(
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
        ("in no event will the authors be held liable", "to alter it and redistribute it freely subject to the following restrictions"),
    ),
    Template(
        "bsl-1",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""",
        ("to any person or organization obtaining a copy of the software", "and to prepare derivative works of the software"),
    ),
    Template("epl-2", "made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike 4 0 international",)),
    Template("cc-by-sa", "licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("creative commons attribution noncommercial 4 0 international",)),
    Template("cc0-1", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication", ("cc0 1 0 universal",)),
)

#: Rare words of a template in the index.
RARE = 8
#: Least share of a template's words, by weight, in its place.
LEAST_SHARE = 0.7


def slack_of(n_words: int) -> int:
    """Words by which places may differ from the template's: names filled in, words left out."""
    return max(2, n_words // 6)


class Vocabulary:
    """Numbers for the words of templates and base phrases."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE):
        self.templates, self.base = tuple(templates), tuple(base)
        lists = [words(x.encode()) for t in templates for x in (t.text, *t.keys)] + [words(p.encode()) for p, _ in base]
        self.word_list = sorted({w for ws in lists for w in ws})
        self.number = {w: i for i, w in enumerate(self.word_list)}

    def numbers(self, ws: list[bytes]) -> np.ndarray:
        """The number of each word, -1 of one that no template has."""
        return np.fromiter(map(self.number.get, ws, repeat(-1)), dtype=np.int32, count=len(ws))


def places(ids: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand one after the other."""
    n = len(ids) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(ids[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[ids[at + k] == phrase[k]]
    return at


class Index:
    """Postings of the rare words of templates, given how many of ``n_docs`` documents hold each word."""

    def __init__(self, vocabulary: Vocabulary, doc_counts: dict[int, int], n_docs: int):
        self.vocabulary = v = vocabulary
        own = [v.numbers(words(t.text.encode())) for t in v.templates]
        held = np.bincount(np.concatenate([np.unique(x) for x in own]), minlength=len(v.word_list))
        self.idf = np.array([math.log((n_docs + len(own) + 1) / (doc_counts.get(i, 0) + n + 0.5)) for i, n in enumerate(held.tolist())])
        self.base = [(v.numbers(words(p.encode())), label) for p, label in v.base]
        self.texts, self.keys, self.counts, self.rare, self.slack = [], [], [], [], []
        postings = []
        for k, t in enumerate(v.templates):
            ids = own[k]
            self.texts.append(ids)
            phrases = [v.numbers(words(p.encode())) for p in t.keys]
            starts = [places(ids, p) for p in phrases]
            if any(len(s) == 0 for s in starts):
                raise ValueError(f"a key phrase of {t.label} does not stand in its text")
            self.keys.append([(p, int(s[0])) for p, s in zip(phrases, starts, strict=True)])
            self.counts.append(np.bincount(ids, minlength=len(v.word_list)))
            self.slack.append(slack_of(len(ids)))
            spots = sorted({q + i for p, q in self.keys[k] for i in range(len(p))})
            rare = sorted({int(ids[q]) for q in spots}, key=lambda i: (-self.idf[i], v.word_list[i]))[:RARE]
            self.rare.append(len(rare))
            postings += [(w, k, q, r) for r, w in enumerate(rare) for q in spots if ids[q] == w]
        postings.sort()
        p = np.array(postings, dtype=np.int64).reshape(-1, 4)
        self.template, self.place, self.bit = p[:, 1], p[:, 2], np.int64(1) << p[:, 3]
        self.first = np.searchsorted(p[:, 0], np.arange(len(v.word_list) + 1))

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """Template, and the least and greatest start for which its rare words agree."""
        at = np.flatnonzero(ids >= 0)
        n = (self.first[1:] - self.first[:-1])[ids[at]]
        at, n = at[n > 0], n[n > 0]
        if not len(at):
            return []
        post = np.repeat(self.first[ids[at]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        template, start, bit = self.template[post], np.repeat(at, n) - self.place[post], self.bit[post]
        order = np.lexsort((start, template))
        template, start, bit = template[order], start[order], bit[order]
        new = np.ones(len(start), dtype=bool)
        new[1:] = (template[1:] != template[:-1]) | (np.diff(start) > 2 * np.array(self.slack)[template[1:]])
        begins = np.flatnonzero(new)
        votes = np.bitwise_or.reduceat(bit, begins)
        ends = np.append(begins[1:], len(start)) - 1
        return [(k, int(start[b]), int(start[e])) for b, e, k, x in zip(begins, ends, template[begins].tolist(), votes.tolist(), strict=True) if x.bit_count() == self.rare[k]]

    def placements(self, ids: np.ndarray) -> list[tuple[str, int, int, float]]:
        """Label, first word, the word after the last, and score, of each verified template."""
        out = []
        found: dict[bytes, np.ndarray] = {}
        for k, low, high in self.candidates(ids):
            slack, text = self.slack[k], self.texts[k]
            begins = []
            for phrase, q in self.keys[k]:
                if (name := phrase.tobytes()) not in found:
                    found[name] = places(ids, phrase)
                b = found[name] - q
                begins.append(b[(b >= low - slack) & (b <= high + slack)])
            done = low - slack - 1
            for b in begins[0].tolist():
                if b <= done or any(not len(o) or np.abs(o - b).min() > slack for o in begins[1:]):
                    continue
                lo, hi = max(0, b - slack), min(len(ids), b + len(text) + slack)
                there = ids[lo:hi]
                there = np.bincount(there[there >= 0], minlength=len(self.idf))
                share = float((np.minimum(there, self.counts[k]) * self.idf).sum() / (self.counts[k] * self.idf).sum())
                if share >= LEAST_SHARE:
                    out.append((self.vocabulary.templates[k].label, max(0, b), min(len(ids), b + len(text)), min(1.0, share)))
                    done = b
        return out

    def scan(self, text: bytes) -> tuple:
        ws = words(text)
        ids = self.vocabulary.numbers(ws)
        hits = [(places(ids, p), p, label) for p, label in self.base]
        starts = np.concatenate([at for at, _, _ in hits])
        base = sorted({label for at, _, label in hits if len(at)})
        more = self.placements(ids)
        labels = sorted({*base, *(m[0] for m in more)})
        score = 1.0 if base else max((m[3] for m in more), default=0.0)
        matches = sorted([(label, int(a), int(a) + len(p), 1.0) for at, p, label in hits for a in at.tolist()] + more, key=lambda m: (m[1], m[2], m[0]))
        return len(ws), len(starts), int(starts.min()) if len(starts) else None, int(starts.max()) if len(starts) else None, ",".join(base), ",".join(labels), score, matches


def document_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> tuple[dict[int, int], int]:
    """How many documents hold each word of the templates, and how many there are."""
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.word_list) + 1, dtype=np.int64)
        for b in batches:
            for t in b[0]:
                total[1 + np.fromiter(filter(lambda i: i is not None, map(vocabulary.number.get, set(words(t.as_py())))), dtype=np.int64)] += 1
            total[0] += len(b)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at - 1), pa.array(total[at])], ["word", "n"])

    each = docs.select(whole(F.col(text)).cast("binary").alias("text")).mapInArrow(counted, "word long, n long")
    rows = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.sum("n").alias("n")).collect()}  # a row a word of the templates
    return rows, rows.pop(-1, 0)


_ADDED = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,end:long,score:double>>"
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _MATCH)


def scan_licenses(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, base: Sequence[tuple[str, str]] = BASE, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The rows (all their columns, or those to keep) with ``n_words, n_base, first_word, last_word, base_labels, labels, score`` and ``matches``, every place in words with its label and score."""
    vocabulary = Vocabulary(templates, base)
    index = Index(vocabulary, *document_counts(docs, vocabulary, text))
    names = [f.split()[0] for f in _ADDED.split(", ")]
    rows = docs.drop(*names) if keep is None else docs.select(*keep)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = list(zip(*(index.scan(t.as_py()) for t in b.column(b.num_columns - 1)), strict=True)) or [[]] * len(_TYPES)
            told = [pa.array([[dict(zip(("label", "start", "end", "score"), m, strict=True)) for m in x] for x in c] if kind is _MATCH else list(c), kind) for c, kind in zip(found, _TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *told], [*b.schema.names[:-1], *names])

    schema = StructType([*rows.schema.fields, *StructType.fromDDL(_ADDED).fields])
    return docs.select(*rows.columns, whole(F.col(text)).cast("binary").alias("_whole")).mapInArrow(scanned, schema)


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs, keep=["doc_id"]).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
