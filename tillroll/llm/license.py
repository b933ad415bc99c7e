"""Licence notices by a generalised suffix automaton of templates.

The automaton holds every run of words of every template. A text is streamed through it once: at each word it gives the longest run ending
there that stands in any template (matching statistics), over words that templates use; any other word restarts it. Base
phrases are found where the run ends in the whole phrase. Longest runs of at least ``LEAST`` words are then chained per
template, in the order of text and template, with gaps of at most ``GAP`` words; a chain that covers ``COVERED`` of a template is
a span with its label, so notices with changed or missing words are found too.

Defined cases: null counts as empty, with no words and score 0; any length of text is read word by word with a state of constant size per
template; the built-in templates make an automaton of a few thousand entries, others can be given to ``scan``; repeated rows are scanned alike; an empty table gives
no rows; other columns are not read. Of overlapping chains of one template the one with the largest share stays, at ties the later; spans of
different templates may overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillroll.llm.common import LOWER, column, map_arrow, span_hashes, spans_of, utf8

# Base phrases and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Sentences of licence notices and their labels.
TEMPLATES = (
    ("Released under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
     "published by the Free Software Foundation, either version 3 of the License", "gpl-3"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "gpl-2"),
    ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("GNU Affero General Public License, version 3", "agpl-3"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met", "bsd"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "cc-by-sa-4"),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
    ("This work is licensed under CC BY-NC", "cc-by-nc"),
    ("To the extent possible under law, the author has dedicated all copyright to this work to the public domain", "cc0"),
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LEAST, GAP, COVERED = 3, 20, 0.75
#: Chains of shorter notices are kept from 5 words on.
LEAST_WORDS = 5


class Automaton:
    """Suffix automaton of several word sequences; the smallest that accepts all their runs."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last_words: list[set[tuple[int, int]]] = [set()]
        for number, words in enumerate(sequences):
            state = 0
            for place, word in enumerate(words):
                state = self._extend(state, word)
                self.last_words[state].add((number, place))
        # where the runs of a state end in the templates: its own places and those of all states that link to it
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            self.last_words[self.link[state]] |= self.last_words[state]

    def _new(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(dict(following))
        self.link.append(link)
        self.length.append(length)
        self.last_words.append(set())
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of ``word`` from ``state``, made to stand for runs of length(state) + 1 at most."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._new(self.length[state] + 1, self.next[target], self.link[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, state: int, word: int) -> int:
        if word in self.next[state]:  # another sequence has this run already
            return self._split(state, word)
        new = self._new(self.length[state] + 1, {}, 0)
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new


class Scanner:
    """The automaton of phrases and templates, and the scan of one text."""

    def __init__(self, phrases=PHRASES, templates=TEMPLATES):
        split = lambda text: WORD.findall(text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        texts = [(split(t), label) for t, label in (*phrases, *templates)]
        self.words = sorted({w for t, _ in texts for w in t})
        self.sizes = [len(t) for t, _ in texts]
        self.labels = [label for _, label in texts]
        self.n_phrases = len(phrases)
        raw = np.frombuffer("".join(self.words).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in self.words])
        hashes = span_hashes(raw, np.concatenate(([0], ends[:-1])), ends)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        number = {w: i for i, w in enumerate(self.words)}
        self.automaton = Automaton([[number[w] for w in t] for t, _ in texts])
        # phrases that end where a state's runs end: those for which every one of its places ends the phrase
        self.phrase_states: dict[int, list[int]] = {}
        for p in range(self.n_phrases):
            state = 0
            for w in texts[p][0]:
                state = self.automaton.next[state][number[w]]
            for s in range(len(self.automaton.next)):
                up = s
                while up > 0 and up != state:
                    up = self.automaton.link[up]
                if up == state:
                    self.phrase_states.setdefault(s, []).append(p)

    def tokens(self, data: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Number of words, and places and numbers of the words that templates use."""
        inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
        starts, ends = spans_of(inside)
        if not len(starts):
            return 0, starts, starts
        hashes = span_hashes(data, starts, ends)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = np.flatnonzero(self.hashes[at] == hashes)
        return len(starts), known, self.order[at[known]]

    def statistics(self, places: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, length, state) of the longest run that ends at each word that templates use."""
        following, link, length = self.automaton.next, self.automaton.link, self.automaton.length
        state, run, last = 0, 0, -2
        for place, word in zip(places.tolist(), numbers.tolist()):
            if place != last + 1:
                state, run = 0, 0
            while state and word not in following[state]:
                state = link[state]
                run = length[state]
            if word in following[state]:
                state, run = following[state][word], run + 1
            last = place
            yield place, run, state

    def scan(self, data: np.ndarray) -> tuple[int, list[tuple[int, int, str]], list[tuple[int, int, str, float]], float]:
        """Words, base places (start, end, label), covered spans (start, end, label, share), score."""
        n, places, numbers = self.tokens(LOWER[data])
        base: list[tuple[int, int, str]] = []
        runs: list[tuple[int, int, int]] = []  # longest ones: place of the last word, length, state
        if len(places) >= LEAST:
            close = np.flatnonzero(np.diff(places, n=LEAST - 1) == LEAST - 1) if LEAST == 2 else np.flatnonzero(
                places[LEAST - 1:] - places[:1 - LEAST] == LEAST - 1)
            if len(close):  # only where so many words in a row are known
                keep = np.zeros(len(places), bool)
                for k in range(LEAST):
                    keep[close + k] = True
                before = (-2, 0, 0)
                for place, run, state in self.statistics(places[keep], numbers[keep]):
                    if run >= LEAST:
                        for p in self.phrase_states.get(state, ()):
                            if run >= self.sizes[p]:
                                base.append((place - self.sizes[p] + 1, place + 1, self.labels[p]))
                    if before[1] >= LEAST and not (place == before[0] + 1 and run == before[1] + 1):
                        runs.append(before)
                    before = (place, run, state)
                if before[1] >= LEAST:
                    runs.append(before)
        spans, best = self.chains(runs)
        return n, base, spans, 1.0 if base else best

    def chains(self, runs: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, str, float]], float]:
        """Covered spans of each template and the best share of any."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for place, run, state in runs:
            for template, end in self.automaton.last_words[state]:
                if template >= self.n_phrases:
                    by.setdefault(template, []).append((place + 1 - run, end + 1 - run, run))
        spans, best = [], 0.0
        for template, matches in by.items():
            matches.sort()
            found: list[tuple[float, int, int]] = []  # covered words, start, end
            chain: list[tuple[int, int]] = []  # covered, start of each match as the last of its chain
            first = 0
            for i, (at, in_template, run) in enumerate(matches):
                covered, start = run, at
                while matches[first][0] + self.sizes[template] + GAP < at:
                    first += 1
                for j in range(first, i):
                    at_j, in_j, run_j = matches[j]
                    # parts of this match that repeat the one before it don't count twice
                    over = max(0, at_j + run_j - at, in_j + run_j - in_template)
                    if at_j < at and in_j < in_template and over < run and at - at_j - run_j <= GAP and chain[j][0] + run - over > covered:
                        covered, start = chain[j][0] + run - over, chain[j][1]
                chain.append((covered, start))
                share = covered / self.sizes[template]
                best = max(best, min(1.0, share))
                if share >= COVERED and covered >= LEAST_WORDS:
                    found.append((share, start, at + run))
            for share, start, end in sorted(found, reverse=True):  # the best of those that overlap
                if all(end <= s[0] or start >= s[1] for s in spans if s[4] == template):
                    spans.append((start, end, self.labels[template], min(1.0, share), template))
        return [s[:4] for s in sorted(spans)], best


@lru_cache(maxsize=4)
def _scanner(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> Scanner:
    return Scanner(templates=templates)


SPAN = "array<struct<first:long,end:long,label:string,share:double,base:boolean>>"


def _scan(templates: tuple[tuple[str, str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(templates)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64()), ("base", pa.bool_())]))
        for batch in batches:
            body, ends = utf8(batch.column("text"))
            counts, spans, scores = [], [], []
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
                n, base, covered, score = scanner.scan(body[a:b])
                counts.append(n)
                spans.append([{"first": s, "end": e, "label": label, "share": 1.0, "base": True} for s, e, label in base]
                             + [{"first": s, "end": e, "label": label, "share": share, "base": False} for s, e, label, share in covered])
                scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(scores, pa.float64())],
                                             ["id", "n_words", "spans", "score"])

    return run


def scan(docs: DataFrame, identity: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Id, number of words, spans (first word, end, label, share of the template, whether a base phrase) and score of each row.

    ``templates`` are (text, label) pairs, whole licence texts too, in place of the built-in notices; base phrases stay. Every task builds the
    automaton of all of them, of at most two states per word. Templates without a word find nothing.
    """
    fixed = tuple((t, label) for t, label in templates if WORD.search(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))))
    rows = docs.select(column(docs, identity).alias("id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows, _scan(fixed), f"id {kind}, n_words long, spans {SPAN}, score double").withColumnRenamed("id", identity)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["first"])
    named = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), named(base).alias("base_labels"), named(F.col("spans")).alias("labels"), "score")
