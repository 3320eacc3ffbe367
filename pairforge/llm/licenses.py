"""Licence scan by a positional rare-token index.

Templates are word lists, from base phrases of two words to licence texts of several
paragraphs, with mandatory key phrases. Document frequencies
of all template words are counted over the whole table, and the postings of all
of them (word -> template, position) form the index. A file looks up its licence
words of highest inverse document frequency: of each template whose key words it
has, the rarest few that stand in it. Such a word at place p votes for every
posting (template, q) with a start of p - q; starts with enough votes are
candidates, and a candidate counts only if all its key phrases stand word for
word at their places. Base phrases are templates that are their own key phrase,
looked up by their rarest word and content with its vote, so every place of
theirs is found.

Defined cases: null or empty text has no words, no places and score 0. A row is
returned for each row, also for a null or repeated doc_id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm import kernel as K
from pairforge.llm.common import table


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = field(default=())
    base: bool = False


#: Base phrases, fixed values of the contract.
BASE = tuple(Template(label, phrase, (phrase,), True) for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")))
#: Notices with versions or variants, each with the words that decide.
NOTICES = (
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge", "obtaining a copy")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def _body(label: str, keys: tuple[str, ...], text: str) -> Template:
    """A licence text or header as words, in the order in which they stand."""
    return Template(label, " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())), keys)


#: Whole licence texts and file headers of several paragraphs; names and years are not part of them.
BODIES = (
    _body(
        "mit-notice",
        ("permission is hereby granted free of charge", "obtaining a copy"),
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
        Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
        permit persons to whom the Software is furnished to do so, subject to the following conditions:

        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR
        PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
        OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    _body(
        "bsd-3-clause",
        ("redistribution and use in source and binary forms", "neither the name"),
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution.

        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission.""",
    ),
    _body(
        "bsd-disclaimer",
        ("this software is provided by the copyright holders and contributors", "consequential damages"),
        """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of
        merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental,
        special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business
        interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the
        use of this software, even if advised of the possibility of such damage.""",
    ),
    _body(
        "isc",
        ("permission to use copy modify and or distribute this software for any purpose",),
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
        permission notice appear in all copies.

        The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.""",
    ),
    _body(
        "apache-2.0",
        ("licensed under the apache license version 2 0",),
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

        http://www.apache.org/licenses/LICENSE-2.0

        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    _body(
        "gpl-notice",
        ("you can redistribute it and or modify it under the terms of the gnu general public license",),
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
        either version 3 of the License, or (at your option) any later version.

        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    ),
)


class Index:
    """Postings of each template's rarest words."""

    def __init__(self, templates: Sequence[Template], frequency: dict[str, int], rows: int, rare: int = 4, share: float = 0.5) -> None:
        """rare: words that a file looks up for a template it may hold; share: of their postings in the template, the votes needed."""
        self.templates, self.rare, self.share = templates, rare, share
        self.words = [t.text.split() for t in templates]
        vocabulary = sorted({w for t in self.words for w in t}, key=lambda w: K.hash_word(w.encode()))
        self.vocabulary = [w.encode() for w in vocabulary]
        self.hashes = np.array([K.hash_word(w) for w in self.vocabulary], np.uint64)
        number = {w: i for i, w in enumerate(vocabulary)}
        idf = {w: log((1 + rows) / (1 + frequency.get(w, 0))) for w in vocabulary}
        self.numbers = [np.array([number[w] for w in t]) for t in self.words]
        self.keys = [[(k, self._find(w, k.split())) for k in t.keys] for t, w in zip(templates, self.words, strict=True)]
        self.base = np.array([t.base for t in templates])
        #: Of each template: its words from the highest inverse document frequency down, and those of its key phrases.
        self.by_idf = [np.array([number[w] for w in sorted(set(t), key=lambda w: (-idf[w], w))]) for t in self.words]
        self.needed = [np.array(sorted({number[w] for k, _ in own for w in k.split()}), np.int64) for own in self.keys]
        # a base phrase is looked up by its rarest word wherever that stands, other templates by any of their words
        postings = sorted((x, i, q) for i, t in enumerate(templates) for q, x in enumerate(self.numbers[i].tolist()) if not t.base or x == self.by_idf[i][0])
        self.posted, self.template, self.place = (np.array([p[k] for p in postings]) for k in range(3))
        self.anchors = np.zeros(len(vocabulary), bool)
        self.anchors[[int(w[0]) for w, t in zip(self.by_idf, templates, strict=True) if t.base]] = True
        self.times = np.zeros((len(vocabulary), len(templates)), np.int64)
        np.add.at(self.times, (self.posted, self.template), 1)

    def rarest(self, present: np.ndarray) -> np.ndarray:
        """Which words each file looks up (files by words): of each template whose key words it has, the rarest of those present.

        present: which words of the vocabulary each file has.
        """
        out = np.zeros_like(present)
        for base, words, needed in zip(self.base, self.by_idf, self.needed, strict=True):
            if base:
                continue
            able = np.flatnonzero(present[:, needed].all(axis=1))
            has = present[np.ix_(able, words)]
            out[np.ix_(able, words)] |= has & (np.cumsum(has, axis=1) <= self.rare)
        return out

    @staticmethod
    def _find(words: list[str], key: list[str]) -> int:
        return next(i for i in range(len(words)) if words[i : i + len(key)] == key)

    def numbered(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The vocabulary number of each word, or -1; hits of the hash are compared byte by byte."""
        h = K.word_hash(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == h, at, -1)
        size = np.array([len(w) for w in self.vocabulary])
        hit = np.flatnonzero(out >= 0)
        bad = (ends - starts)[hit] != size[out[hit]]
        index, cut = K.ragged(starts[hit[~bad]], size[out[hit[~bad]]])
        flat = np.frombuffer(b"".join(self.vocabulary), np.uint8)
        own, _ = K.ragged((np.cumsum(size) - size)[out[hit[~bad]]], size[out[hit[~bad]]])
        if len(index):
            bad[np.flatnonzero(~bad)[np.add.reduceat((data[index] != flat[own]).astype(np.int64), cut[:-1]) > 0]] = True
        out[hit[bad]] = -1
        return out


def _words(batch: pa.RecordBatch):
    data, offsets = K.flat(batch.column("text"))
    data = K.LOWER[data]
    return data, *K.spans(data, offsets, K.ALNUM)


def word_frequencies(docs: DataFrame, words: Sequence[str]) -> tuple[int, dict[str, int]]:
    """Rows, and in how many of them each of ``words`` occurs, over the whole table."""
    index = Index([Template("", " ".join(words))], {}, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(index.vocabulary), np.int64), 0
        for whole in batches:
            rows += whole.num_rows
            for batch in K.slices(whole, "text"):
                data, starts, ends, cut = _words(batch)
                number = index.numbered(data, starts, ends)
                hit = np.flatnonzero(number >= 0)
                doc = np.searchsorted(cut, hit, "right") - 1
                seen = np.unique(doc * len(total) + number[hit])
                total += np.bincount(seen % len(total), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in index.vocabulary)]), pa.array(np.append(rows, total))], names=["word", "n"])

    found = dict(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect())
    return found.pop("", 0), found


def _matched(index: Index, number: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, template, start, share of the template's words in place) of the verified candidates; start counts all words.

    A template may begin before its file does or end after it, as long as its key phrases stand inside.
    """
    hit = np.flatnonzero(number >= 0)
    owner, word = np.searchsorted(cut, hit, "right") - 1, number[hit]
    present = np.zeros((len(cut) - 1, len(index.vocabulary)), bool)
    present[owner, word] = True
    looked = index.rarest(present)
    hit = hit[looked[owner, word] | index.anchors[word]]
    lo, hi = np.searchsorted(index.posted, number[hit], "left"), np.searchsorted(index.posted, number[hit], "right")
    posting, _ = K.ragged(lo, hi - lo)
    place = np.repeat(hit, hi - lo)
    template, start = index.template[posting], place - index.place[posting]
    doc = np.searchsorted(cut, place, "right") - 1
    own = looked[doc, number[place]] | index.base[template]  # an anchor votes for base phrases alone
    votes, count = np.unique(np.stack([doc[own], template[own], start[own]]), axis=1, return_counts=True)
    doc, template, start = votes
    most = (looked.astype(np.int64) @ index.times)[doc, template]  # votes of a file that has the template whole
    enough = index.base[template] | (count >= np.maximum(1, np.ceil(index.share * most)))
    doc, template, start = doc[enough], template[enough], start[enough]
    good, share = np.zeros(len(doc), bool), np.zeros(len(doc))
    for t, words in enumerate(index.numbers):
        own = np.flatnonzero(template == t)
        if len(own):
            at = start[own, None] + np.arange(len(words))
            inside = (at >= cut[doc[own], None]) & (at < cut[doc[own] + 1, None])
            same = inside & (number[np.clip(at, 0, len(number) - 1)] == words)
            fine = np.ones(len(own), bool)
            for key, q in index.keys[t]:
                fine &= same[:, q : q + len(key.split())].all(axis=1)
            good[own], share[own] = fine, same.mean(axis=1)
    return doc[good], template[good], start[good], share[good]


def _scanned(index: Index):
    base = index.base
    labels = [t.label for t in index.templates]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole, "text"):
                n = batch.num_rows
                data, starts, ends, cut = _words(batch)
                doc, template, start, share = _matched(index, index.numbered(data, starts, ends), cut) if len(starts) else (np.empty(0, np.int64),) * 4
                own = base[template.astype(np.int64)] if len(doc) else np.zeros(0, bool)
                at = start[own] - cut[doc[own]]
                first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                np.minimum.at(first, doc[own], at)
                np.maximum.at(last, doc[own], at)
                score = np.zeros(n)
                np.maximum.at(score, doc, share)

                by: dict[int, tuple[set, set, list]] = {}
                for d, t, s, b in zip(doc.tolist(), template.tolist(), (start - cut[doc]).tolist(), own.tolist(), strict=True):
                    have = by.setdefault(d, (set(), set(), []))
                    have[1].add(labels[t])
                    if b:
                        have[0].add(labels[t])
                    have[2].append({"label": labels[t], "word": s})
                text = lambda k: pa.array([",".join(sorted(by[i][k])) if i in by else "" for i in range(n)], pa.string())
                none = last < 0
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()), pa.array(np.diff(cut)), pa.array(np.bincount(doc[own], minlength=n).astype(np.int64)),
                        pa.array(first, mask=none), pa.array(last, mask=none), text(0), text(1), pa.array(score),
                        pa.array([by[i][2] if i in by else [] for i in range(n)], pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
                )

    return run


def license_scan(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES + BODIES) -> DataFrame:
    """A row for each document with its word count, base places, labels, score and the places of all verified templates."""
    words = sorted({w for t in templates for w in t.text.split()})
    rows, frequency = word_frequencies(docs, words)
    index = Index(templates, frequency, rows)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:long>>"
    return docs.select("doc_id", "text").mapInArrow(_scanned(index), schema)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("places")
