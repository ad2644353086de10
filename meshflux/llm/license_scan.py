"""License scans: matching statistics of a suffix automaton of licence words, chained into template spans."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshflux.llm.automaton import SuffixAutomaton
from meshflux.llm.common import find_sorted, hash_of, hash_words, text_buffers, whole_text

# Phrases that name a licence, with its label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public licence notices, with their labels.
NOTICES = {
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
    "writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either "
    "express or implied. See the License for the specific language governing permissions and limitations under the License.": "apache",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions "
    "of the Software.": "mit",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the "
    "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
    "PURPOSE. See the GNU General Public License for more details.": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are "
    "met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.": "bsd",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "cc-by",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
    "file, You can obtain one at http://mozilla.org/MPL/2.0/.": "mpl",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
    "above copyright notice and this permission notice appear in all copies.": "isc",
}

#: A match takes part in a chain from so many words; matches of a chain lie at most so many words apart.
LEAST_MATCH, GAP = 5, 20
#: A notice adds its label from this covered share of its words.
LEAST_COVERED = 0.5

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


class Templates:
    """The automaton of phrases and notices, and what the scan needs to know about them."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, str]):
        texts = [*phrases, *notices]
        split = [_WORD.findall(t.encode().lower()) for t in texts]
        vocabulary = sorted({w for words in split for w in words})
        hashes = hash_of([w.decode() for w in vocabulary])
        turn = np.argsort(hashes)
        self.hashes = hashes[turn]
        number = {vocabulary[old]: new for new, old in enumerate(turn.tolist())}
        self.words = [[number[w] for w in words] for words in split]
        self.labels = [*phrases.values(), *notices.values()]
        self.n_phrases = len(phrases)
        self.automaton = SuffixAutomaton(self.words)
        n = len(vocabulary)
        self.pairs = np.zeros((n, n), bool)
        for words in self.words:
            for a, b in zip(words, words[1:], strict=False):
                self.pairs[a, b] = True
        # Phrases that end wherever a state does, by its suffix links.
        own: dict[int, list[int]] = {}
        for k in range(self.n_phrases):
            own.setdefault(self.automaton.find(self.words[k]), []).append(k)
        self.own = own
        self.above: list[list[int]] = [[] for _ in self.automaton.next]
        for state in sorted(range(1, len(self.above)), key=lambda s: self.automaton.length[s]):
            link = self.automaton.link[state]
            self.above[state] = self.above[link] + own.get(link, [])

    def phrases_at(self, state: int, length: int) -> list[int]:
        """Phrases that end where a match of this state and length ends."""
        return self.above[state] + [k for k in self.own.get(state, ()) if len(self.words[k]) <= length]

    def chains(self, matches: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int]]:
        """(notice, start, stop, covered words) of long matches (start, length, state) chained in the order of the notice."""
        open_: dict[int, list[int]] = {}  # notice -> start, stop, place in the notice, covered
        for start, length, state in matches:
            for notice, end in self.automaton.ends[state].items():
                if notice < self.n_phrases or length < min(LEAST_MATCH, len(self.words[notice])):
                    continue
                begin = end - length
                chain = open_.get(notice)
                if chain and begin >= chain[2] and 0 <= start - chain[1] <= GAP:
                    chain[1:] = [start + length, end, chain[3] + length]
                    continue
                if chain:
                    yield notice, chain[0], chain[1], chain[3]
                open_[notice] = [start, start + length, end, length]
        for notice, chain in open_.items():
            yield notice, chain[0], chain[1], chain[3]

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[dict]:
        """What is found in each text of a batch, in order."""
        starts, hashes = hash_words(data, offsets)
        cuts = np.searchsorted(starts, offsets)
        ids = find_sorted(self.hashes, hashes)
        joined = np.zeros(len(ids) + 1, bool)  # whether a word and the next stand together in some template
        if len(ids) > 1:
            known = (ids[1:] >= 0) & (ids[:-1] >= 0)
            joined[1:-1] = known & self.pairs[ids[:-1], ids[1:]]
            inner = cuts[1:-1]
            joined[inner[(inner > 0) & (inner < len(ids))]] = False
        # Runs of joined words: from the word before the first joint to the one after the last.
        edges = np.diff(joined.astype(np.int8))
        begins, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + 1
        found: dict[int, tuple[list, list]] = {}
        for row, a, b in zip((np.searchsorted(cuts, begins, side="right") - 1).tolist(), begins.tolist(), stops.tolist(), strict=True):
            statistics = self.automaton.statistics(ids[a:b].tolist())
            places, matches = found.setdefault(row, ([], []))
            for k, (length, state) in enumerate(statistics):
                at = a + k + 1 - int(cuts[row])
                places += [(at - len(self.words[p]), p) for p in self.phrases_at(state, length)]
                if k + 1 == len(statistics) or statistics[k + 1][0] <= length:
                    matches.append((at - length, length, state))
        for row, n_words in enumerate(np.diff(cuts).tolist()):
            places, matches = found.get(row, ((), ()))
            spans = [
                {"label": self.labels[t], "notice": t - self.n_phrases, "start": a, "stop": b, "coverage": min(1.0, c / len(self.words[t]))}
                for t, a, b, c in self.chains(matches)]
            base = {self.labels[p] for _, p in places}
            yield {
                "n_words": n_words, "n_base": len(places), "first_word": min((a for a, _ in places), default=None),
                "last_word": max((a for a, _ in places), default=None), "base_labels": ",".join(sorted(base)),
                "labels": ",".join(sorted(base | {s["label"] for s in spans if s["coverage"] >= LEAST_COVERED})),
                "score": 1.0 if places else max((s["coverage"] for s in spans), default=0.0), "spans": spans}


_SPANS = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())]))
_FIELDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
    "score": pa.float64(), "spans": _SPANS}


def scan(rows: DataFrame, keys: list[str], phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """Licence phrases and notices in every whole text of ``rows`` (keys..., text).

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond
    ASCII. Matching statistics give, at each word, the longest piece of any
    template that ends there: a phrase ends where its state is that match or a
    suffix of it, and matches of five words or more are chained, in the order of
    a notice, into spans with the covered share of its words. A null text counts
    as empty; a text without words has no labels and score 0; repeated rows are
    each scanned; an empty table gives an empty result. Other columns are
    ignored.

    Columns: keys, n_words, n_base, first_word, last_word, base_labels, labels
    (also of notices covered by half or more), score (the best covered share of
    a template, 1 with any phrase), spans.
    """
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    schema = (
        f"{kinds}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label:string,notice:int,start:long,stop:long,coverage:double>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates(phrases, notices)
        for batch in batches:
            found = list(templates.scan(*text_buffers(batch.column(len(keys)))))
            columns = [pa.array([f[name] for f in found], kind) for name, kind in _FIELDS.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *columns], names=[*keys, *_FIELDS])

    return rows.select(*keys, whole_text().alias("text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scan(docs, ["doc_id"]).drop("spans")
