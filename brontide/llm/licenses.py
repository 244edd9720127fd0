"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of the text; a run of up to `span` lines that follow each
other, of which lines without words don't count; a run of words twice as long as
the template, wherever its lines end; or all lines between two blank ones, of any
number, so a paragraph or a comment is one block whatever stands between the
template's words.  A block matches a template if it contains at least a share
`least` of the template's tokens.

The join is exact and driven by filters, in this order:

* tokens are ordered globally by how many documents have them, rarest first;
* prefix filter: a block that holds ceil(least * n) of a template's n tokens
  holds at least one of the rarest n - ceil(least * n) + 1 of them, so only
  lines with such a token, and texts, are looked at, through an index from those
  tokens;
* length filter: a block with fewer distinct tokens than ceil(least * n) can't;
* positional filter: the tokens seen when a prefix token is met, and those still
  to come after its position in the template, must be able to reach the bound.

The templates are a parameter and small, so their index is part of the task;
the frequencies are of the templates' own tokens only, counted over all
documents with a partial aggregate.  There is no shuffle of texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brontide.llm.common import Plain, appended, small_batches, with_columns

#: Phrases and the labels they stand for.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Opening or characteristic sentences of public licenses, in their usual wording.
TEMPLATES = {
    "agpl": "GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by": "Licensed under the Creative Commons Attribution License",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl": "GNU Lesser General Public License as published by the Free Software Foundation",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
LEAST = 0.9
SPAN = 3

#: Every byte that no word has, as a space: all but digits, lower-case letters and bytes of other alphabets.
_APART = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_APART_IN_LINE = bytes(0x0A if c == 0x0A else _APART[c] for c in range(256))


def tokens(text: str) -> list[bytes]:
    """The words [0-9a-z] and beyond ASCII, A-Z lowered, as bytes."""
    return text.encode("utf-8", "surrogatepass").lower().translate(_APART).split()


@dataclass
class Template:
    label: str
    order: list[bytes]  # distinct tokens, rarest first
    need: int
    window: int  # words of the blocks that don't heed lines

    @property
    def prefix(self) -> list[bytes]:
        return self.order[: len(self.order) - self.need + 1]


class Matcher:
    """The prefix index of a set of templates."""

    def __init__(self, templates: dict[str, str], frequency: dict[bytes, int], least: float, span: int):
        self.span = max(1, span)
        self.templates = []
        for label, text in sorted(templates.items()):
            order = sorted(set(words := tokens(text)), key=lambda w: (frequency.get(w, 0), w))
            if order:
                self.templates.append(Template(label, order, max(1, math.ceil(least * len(order) - 1e-9)), 2 * len(words)))
        self.places = [{w: i for i, w in enumerate(t.order)} for t in self.templates]
        self.index: dict[bytes, list[int]] = {}
        for i, t in enumerate(self.templates):
            for w in t.prefix:
                self.index.setdefault(w, []).append(i)

    def best(self, lines: list[bytes], blank: list[bool] | None = None) -> dict[str, float]:
        """For each template that some block contains enough of, the largest share contained.

        lines: lowered, words apart.  blank: which of them are blank in the text;
        others without words (rules, comment marks) part no block.
        """
        part, parts = 0, []
        for i, line in enumerate(lines):
            part += bool(blank and blank[i])
            if line.strip():
                parts.append(part)
        lines = [line for line in lines if line.strip()]
        keys = self.index.keys()
        hit: dict[int, set[int]] = {}
        sets: dict[int, set[bytes]] = {}
        for i, line in enumerate(lines):
            found = keys & (words := set(line.split()))
            if found:
                sets[i] = words
                for w in found:
                    for t in self.index[w]:
                        hit.setdefault(t, set()).add(i)
        out: dict[str, float] = {}
        if not hit:
            return out
        words = [w for line in lines for w in line.split()]
        present = set(words)
        whole: dict[int, set[bytes]] = {}
        wanted = {parts[i] for at in hit.values() for i in at}
        for i, line in enumerate(lines):
            if parts[i] in wanted:
                whole.setdefault(parts[i], set()).update(line.split())
        for t, at in hit.items():
            share = self._share_of_words(t, words, present)
            for k in {parts[i] for i in at}:
                share = max(share, self._share_of(t, whole[k]))
            for start in sorted({max(0, i - k) for i in at for k in range(self.span)}):
                share = max(share, self._share(t, lines, sets, start))
            if share:
                out[self.templates[t].label] = share
        return out

    def _share_of_words(self, t: int, words: list[bytes], present: set[bytes]) -> float:
        """The largest share of template t in the runs of its window's words, 0 if none is enough."""
        template, place = self.templates[t], self.places[t]
        if len(place.keys() & present) < template.need:  # length filter
            return 0.0
        at = [i for i, w in enumerate(words) if w in place]
        held: dict[bytes, int] = {}
        best = first = 0
        for i in at:
            held[words[i]] = held.get(words[i], 0) + 1
            while i - at[first] >= template.window:
                w = words[at[first]]
                held[w] -= 1
                if not held[w]:
                    del held[w]
                first += 1
            best = max(best, len(held))
        return best / len(place) if best >= template.need else 0.0

    def _share(self, t: int, lines: list[bytes], sets: dict[int, set[bytes]], start: int) -> float:
        """The largest share of template t in the blocks of lines that start at a line, 0 if none is enough."""
        block: set[bytes] = set()
        best = 0.0
        for i in range(start, min(len(lines), start + self.span)):
            if i not in sets:
                sets[i] = set(lines[i].split())
            block |= sets[i]
            best = max(best, self._share_of(t, block))
        return best

    def _share_of(self, t: int, block: set[bytes]) -> float:
        """The share of template t in a block, 0 if it isn't enough."""
        template = self.templates[t]
        if len(block) < template.need:  # length filter
            return 0.0
        seen, last = 0, len(template.order)
        for p, w in enumerate(template.order):
            if w in block:
                seen += 1
            if seen + last - p - 1 < template.need:  # positional filter
                return 0.0
        return seen / last


def base_places(words: list[bytes], phrases: dict[str, str]) -> tuple[list[int], set[str]]:
    """Starts of all places where a phrase's words stand one after another, and the labels of those found."""
    at: list[int] = []
    labels: set[str] = set()
    line = b" " + b" ".join(words) + b" "
    for phrase, label in phrases.items():
        needle = b" " + b" ".join(tokens(phrase)) + b" "
        i, counted, n = line.find(needle), 0, 0
        while i >= 0:
            n += line.count(b" ", counted, i)
            counted = i
            at.append(n)
            labels.add(label)
            i = line.find(needle, i + 1)
    return at, labels


def frequencies(docs: DataFrame, text: str, wanted: set[bytes]) -> dict[bytes, int]:
    """How many rows of docs have each wanted token.  Each task sends one row per wanted token at most."""
    small_batches(docs.sparkSession)

    def run(batches):
        n: dict[bytes, int] = {}
        for b in batches:
            for t in b.column(0).to_pylist():
                for w in wanted & set(tokens(t or "")):
                    n[w] = n.get(w, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["w", "n"])

    table = Plain(docs)
    counted = table.df.select(F.col(table.name(text)).cast("string").alias("text")).mapInArrow(run, "w binary, n bigint")
    return {bytes(r["w"]): r["n"] for r in counted.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def license_scan(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None, least: float = LEAST, span: int = SPAN, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels and score appended.

    n_base: all places where a phrase's words stand one after another; first_word
    and last_word: the least and greatest start among them, words from 0, null
    without one.  labels: base_labels and those of the templates that a block
    contains, distinct, in order, joined by commas.  score: 1 with a base label,
    else the largest share of a template contained, 0 without one.

    Null and empty texts have no words and no labels.  Columns of docs named as
    an appended one, in any case, are replaced.  Repeated rows are judged alike.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    matcher = Matcher(templates, frequencies(docs, text, {w for t in templates.values() for w in tokens(t)}), least, span)
    made = {"n_words": T.LongType(), "n_base": T.LongType(), "first_word": T.LongType(), "last_word": T.LongType(), "base_labels": T.StringType(), "labels": T.StringType(), "score": T.DoubleType()}
    table = Plain(docs, made)
    column = table.name(text)
    slim = table.slim(column)

    def judge(t: str | None) -> tuple:
        low = (t or "").encode("utf-8", "surrogatepass").lower()
        raw = low.translate(_APART_IN_LINE)
        words = raw.split()
        at, base = base_places(words, phrases)
        found = matcher.best(raw.split(b"\n"), [not x.strip() for x in low.split(b"\n")]) if words else {}
        score = 1.0 if base else max(found.values(), default=0.0)
        return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | found.keys())), score

    def run(batches):
        for b in batches:
            rows = [judge(t) for t in b.column(b.schema.names.index(column)).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(made)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            if not keep_text:
                b = b.drop_columns([column])
            yield with_columns(b, list(made), [pa.array(c, k) for c, k in zip(columns, types, strict=True)])

    return slim.mapInArrow(run, appended(slim.schema, [] if keep_text else [column], **made)).select(*table.own(*([] if keep_text else [column])), *made)
