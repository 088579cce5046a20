"""Licence scans by template-markup matching.

A template is licence wording with markup: ``<<opt>>`` ... ``<</opt>>`` encloses wording that may be
missing, ``<<var:a-b>>`` stands for any a to b words. Both are compiled into an automaton over words;
a text carries the licence where the automaton accepts, that is where all mandatory wording stands
word for word and in order.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import map_texts

# The base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by",
           "mit license": "mit"}

_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice <<opt>>(including the next paragraph)<</opt>> shall be included in all copies
or substantial portions of the Software."""
_BSD_BODY = """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: <<opt>>1.<</opt>> Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<opt>>2.<</opt>> Redistributions in binary form must reproduce the above copyright notice, this list
of conditions and the following disclaimer in the documentation and/or other materials provided with
the distribution."""

# Public licence wording with markup, by label.
TEMPLATES = {
    "mit-text": _MIT_BODY,
    "mit-notice": """<<opt>>is<</opt>> <<opt>>released<</opt>> <<opt>>licensed<</opt>>
        <<opt>>distributed<</opt>> under the <<opt>>terms of the<</opt>> MIT License""",
    "apache-2.0": """Licensed under the <<opt>>terms of the<</opt>> Apache License, Version 2.0
        <<opt>>(the "License"); you may not use this file except in compliance with the
        License.<</opt>>""",
    "gpl-3.0": """licensed under the <<opt>>terms of the<</opt>> GNU General Public License
        <<opt>>as published by the Free Software Foundation<</opt>> <<opt>>either<</opt>> version 3
        <<opt>>of the License<</opt>> <<opt>>or (at your option) any later version<</opt>>""",
    "gpl-2.0": """licensed under the <<opt>>terms of the<</opt>> GNU General Public License
        <<opt>>as published by the Free Software Foundation<</opt>> <<opt>>either<</opt>> version 2
        <<opt>>of the License<</opt>> <<opt>>or (at your option) any later version<</opt>>""",
    "gpl-notice": """This program is free software; you can redistribute it and/or modify it under
        the terms of the GNU General Public License as published by the Free Software Foundation;
        either version <<var:1-2>> of the License, or (at your option) any later version""",
    "cc-by-nc-4.0": """licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>Creative
        Commons<</opt>> CC BY-NC 4.0""",
    "cc-by-4.0": """licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>Creative
        Commons<</opt>> CC BY 4.0""",
    "cc-by-sa-4.0": """licensed under <<opt>>a<</opt>> <<opt>>the<</opt>> <<opt>>Creative
        Commons<</opt>> CC BY-SA 4.0""",
    "bsd-2-clause": _BSD_BODY + """ THIS SOFTWARE IS PROVIDED BY <<var:1-20>> "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES""",
    "bsd-3-clause": _BSD_BODY + """ <<opt>>3.<</opt>> Neither the name of <<var:1-20>> nor the names of
        its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with
        or without fee is hereby granted, <<opt>>provided that the above copyright notice and this
        permission notice appear in all copies<</opt>>""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone
        is free to copy, modify, publish, use, compile, sell, or distribute this software""",
    "boost-1.0": """Distributed under the Boost Software License, Version 1.0""",
}

# Bytes to words: A-Z lower-cased; controls, punctuation and white space below 0x80 separate words.
_WORDS = bytes(i + 32 if 0x41 <= i <= 0x5A
               else i if 0x30 <= i <= 0x39 or 0x61 <= i <= 0x7A or i >= 0x80 else 0x20
               for i in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Template:
    """Automaton over words. States are numbered; state ``accept`` ends a match.

    ``on[state]`` maps a word to the next states, ``free[state]`` holds next states on any word and
    ``skip[state]`` next states without a word.
    """

    def __init__(self, markup: str):
        self.on: list[dict[bytes, list[int]]] = [{}]
        self.free: list[list[int]] = [[]]
        self.skip: list[list[int]] = [[]]
        mandatory, run, opened, here = [], [], [], 0
        for part in re.split(r"(<<.*?>>)", markup):
            if part == "<<opt>>":
                mandatory.append(run)
                run = []
                opened.append(here)
            elif part == "<</opt>>":
                if not opened:
                    raise ValueError("an optional region ends before it begins")
                self.skip[opened.pop()].append(here)
                run = []
            elif part.startswith("<<var:"):
                least, most = map(int, part[6:-2].split("-"))
                mandatory.append(run)
                run, ways = [], []
                for i in range(most):
                    if i >= least:
                        ways.append(here)
                    new = self._state()
                    self.free[here].append(new)
                    here = new
                for state in ways:
                    self.skip[state].append(here)
            else:
                for word in words_of(part):
                    new = self._state()
                    self.on[here].setdefault(word, []).append(new)
                    here = new
                    if not opened:
                        run.append(word)
        if opened:
            raise ValueError("an optional region does not end")
        mandatory.append(run)
        self.accept = here
        #: The longest run of mandatory words; a text without it cannot match.
        self.anchor = b" " + b" ".join(max(mandatory, key=lambda r: sum(map(len, r)))) + b" "
        self.starts = set()
        for state in self._closed({0}):
            self.starts |= self.on[state].keys()
            if self.free[state]:
                self.starts = None
                break
        if self.accept in self._closed({0}):
            raise ValueError("the template has no mandatory wording")

    def _state(self) -> int:
        for table, empty in ((self.on, {}), (self.free, []), (self.skip, [])):
            table.append(empty)
        return len(self.on) - 1

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for new in self.skip[todo.pop()]:
                if new not in states:
                    states.add(new)
                    todo.append(new)
        return states

    def match(self, words: list[bytes], start: int) -> int | None:
        """End (a word index) of the longest match that starts at ``start``."""
        states, end = self._closed({0}), None
        for i in range(start, len(words)):
            states = self._closed({new for s in states
                                   for new in (*self.on[s].get(words[i], ()), *self.free[s])})
            if not states:
                break
            if self.accept in states:
                end = i + 1
        return end

    def find(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """All matches, leftmost and longest first, not overlapping: (first word, end)."""
        if self.anchor not in joined:
            return []
        found, at = [], 0
        while at < len(words):
            if self.starts is None or words[at] in self.starts:
                end = self.match(words, at)
                if end is not None:
                    found.append((at, end))
                    at = end
                    continue
            at += 1
        return found


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word indices where the phrase stands in ' w0 w1 ... '."""
    wanted, places, at, word, seen = b" " + phrase + b" ", [], 0, 0, 0
    while (at := joined.find(wanted, at)) >= 0:
        word += joined.count(b" ", seen, at)
        seen = at
        places.append(word)
        at += 1
    return places


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        self.templates = {k: Template(v) for k, v in templates.items()}
        self.phrases = {k.encode(): v for k, v in phrases.items()}
        rare = [min(t.anchor.split(), key=lambda w: (-len(w), w)) for t in self.templates.values()]
        last = [k.split()[-1] for k in self.phrases]
        self.hints = sorted({w for w in rare + last})

    def scan(self, text: str | None) -> tuple:
        """(n_words, base places, base labels, template spans)"""
        normal = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
        words = normal.split()
        if not any(h in normal for h in self.hints):
            return len(words), [], [], []
        joined = b" " + b" ".join(words) + b" "
        places, labels = [], set()
        for phrase, label in self.phrases.items():
            if got := phrase_places(joined, phrase):
                places += got
                labels.add(label)
        spans = [(label, start, end) for label, t in self.templates.items()
                 for start, end in t.find(words, joined)]
        return len(words), sorted(places), sorted(labels), spans


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text",
         templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Licences of every whole text.

    Returns id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label,
    first word, end). Words are counted from 0 over ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the
    text with A-Z lower-cased. ``score`` is 1 if all mandatory wording of a template stands in the
    text, 0.5 if only a base phrase does, else 0. A null or empty text has no words and labels ''.
    Rows are judged alone, so repeated rows, null ids and ties need no rule; other columns are
    ignored; an empty table gives an empty one.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases

    def make():
        scanner = Scanner(templates, phrases)

        def run(columns):
            out = []
            for text in columns[1]:
                n, places, base, spans = scanner.scan(text)
                out.append((n, len(places), places[0] if places else None,
                            places[-1] if places else None, ",".join(base),
                            ",".join(sorted({*base, *(s[0] for s in spans)})),
                            1.0 if spans else 0.5 if places else 0.0,
                            [{"label": a, "first": b, "end": c} for a, b, c in spans]))
            return out
        return run

    return map_texts(docs, [id_column, text],
                     "n_words long, n_base long, first_word long, last_word long, "
                     "base_labels string, labels string, score double, "
                     "spans array<struct<label: string, first: long, end: long>>", make)
