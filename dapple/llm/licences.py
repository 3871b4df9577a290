"""Licence scans by an exact set-similarity join.

Templates and text blocks are sets of words.  Words stand in one global order,
rarest in the corpus first.  A block that holds a share ``least`` of a
template's words must hold one of the template's first ``n - ceil(least n) + 1``
words in that order (prefix filter), must have ``ceil(least n)`` words (length
filter), and what can still follow the first match must suffice (positional
filter).  Blocks that pass are compared exactly, so all and only the blocks
above the threshold are found.

Each template has blocks of its own length: windows of twice its words at a
step of its words, so any passage no longer than the template lies whole in a
block, and words scattered over more text than that are none of it.  Phrases are templates of share 1 whose words must also stand in order;
they are sought in the whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import ALNUM, as_bytes, words
from .scratch import small_batches

#: The base phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Opening passages of public licences and notices, and their labels.
TEMPLATES = (
    ("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("warranty-disclaimer", "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-3-statement", "This work is licensed under the GNU General Public License, version 3"),
    ("apache-2.0-statement", "Licensed under the Apache License, Version 2.0"),
    ("mit-statement", "Released under the MIT License"),
    ("cc-by-nc-4.0-statement", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0-statement", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("rights-reserved", "All rights reserved"),
)
#: Share of a template's words that a block must hold.
LEAST = 0.8

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def cut(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().translate(_UPPER))


def _hash(tokens: list[bytes]) -> dict[bytes, int]:
    unique = sorted(set(tokens))
    return {t: int(next(words([t], ALNUM)).hashes[0]) for t in unique}


class Catalogue:
    """Templates and phrases over a vocabulary in global order."""

    def __init__(self, templates, phrases, frequency: dict[bytes, int], least: float):
        tokens = {t for _, text in templates for t in cut(text)} | {t for text, _ in phrases for t in cut(text)}
        order = sorted(tokens, key=lambda t: (frequency.get(t, 0), t))
        self.rank = {t: i for i, t in enumerate(order)}
        hashes = _hash(order)
        by_hash = sorted((hashes[t], i) for t, i in self.rank.items())
        self.hashes = np.array([h for h, _ in by_hash], dtype=np.uint64)
        self.ranks = np.array([i for _, i in by_hash], dtype=np.int32)
        self.templates = []
        self.starters: list[np.ndarray] = []
        for label, text in templates:
            tokens = cut(text)
            ordered = sorted({self.rank[t] for t in tokens})
            need = max(1, math.ceil(least * len(ordered) - 1e-9))
            # prefix filter: one of these words stands in every block that holds enough
            starts = np.zeros(len(order) + 1, dtype=bool)
            starts[ordered[: len(ordered) - need + 1]] = True
            self.starters.append(starts)
            self.templates.append((label, np.array(ordered, dtype=np.int32), need, len(tokens)))
        self.phrases = []
        for text, label in phrases:
            seq = [self.rank[t] for t in cut(text)]
            self.phrases.append((label, np.array(seq, dtype=np.int32), int(np.argmin(seq))))
        self.start_table = np.any(self.starters, axis=0) if self.starters else np.zeros(len(order) + 1, dtype=bool)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 outside the vocabulary."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ranks[at], -1)

    def places(self, ranks: np.ndarray) -> list[tuple[int, str]]:
        """Start and label of every place of a phrase, found at its rarest word, in order."""
        out = []
        for label, seq, rare in self.phrases:
            for at in np.flatnonzero(ranks == seq[rare]) - rare:
                if at >= 0 and at + len(seq) <= len(ranks) and (ranks[at : at + len(seq)] == seq).all():
                    out.append((int(at), label))
        return sorted(out)

    def blocks(self, ranks: np.ndarray) -> list[tuple[int, int, str, float]]:
        """First word, end, label and contained share of every block above a template's threshold."""
        known = np.flatnonzero(ranks >= 0)
        word = ranks[known]
        if not self.start_table[word].any():
            return []
        out = []
        for (label, ordered, need, step), starts in zip(self.templates, self.starters, strict=True):
            hits = known[starts[word]]
            if not len(hits):
                continue
            for k in np.unique(np.concatenate([hits // step, np.maximum(hits // step - 1, 0)])):
                lo, hi = int(k) * step, min(len(ranks), (int(k) + 2) * step)
                if lo and len(ranks) <= lo + step:  # lies whole in the block before
                    continue
                a, b = np.searchsorted(known, (lo, hi))
                if b - a < need:  # length filter: words of any template, repeats counted
                    continue
                block = np.unique(word[a:b])
                # positional filter: from the first word of the template that the block holds, both must go on long enough
                at = int(np.argmax(starts[block])) if starts[block].any() else len(block)
                if at == len(block) or min(len(block) - at, len(ordered) - int(np.searchsorted(ordered, block[at]))) < need:
                    continue
                both = len(np.intersect1d(block, ordered, assume_unique=True))
                if both >= need:
                    out.append((lo, hi, label, both / len(ordered)))
        return sorted(out)


def _count(batches: Iterator[pa.RecordBatch], hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How many texts hold each vocabulary word; one row a word and task."""
    total = np.zeros(len(hashes), dtype=np.int64)
    for batch in batches:
        for w in words(as_bytes(batch.column(0)), ALNUM):
            at = np.minimum(np.searchsorted(hashes, w.hashes), len(hashes) - 1)
            hit = hashes[at] == w.hashes
            pairs = np.unique(w.doc[hit] * len(hashes) + at[hit])
            total += np.bincount(pairs % len(hashes), minlength=len(hashes))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(hashes))), pa.array(total)], names=["word", "n"])


def frequencies(docs: DataFrame, text_col: str, templates=TEMPLATES, phrases=PHRASES) -> dict[bytes, int]:
    """Document frequency, over all texts, of the templates' words (as many as the templates have)."""
    tokens = sorted({t for _, text in templates for t in cut(text)} | {t for text, _ in phrases for t in cut(text)})
    by_hash = sorted((h, t) for t, h in _hash(tokens).items())
    hashes = np.array([h for h, _ in by_hash], dtype=np.uint64)
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_count, hashes=hashes), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {by_hash[r["word"]][1]: r["n"] for r in counted.collect()}


FOUND = "n_words long, phrases array<struct<start:long,label:string>>, blocks array<struct<start:long,end:long,label:string,share:double>>"


def _scan(batches: Iterator[pa.RecordBatch], book: Catalogue) -> Iterator[pa.RecordBatch]:
    phrase = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string())]))
    block = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))
    for batch in batches:
        counts, phrases, blocks = [], [], []
        for w in words(as_bytes(batch.column(batch.num_columns - 1)), ALNUM):
            ranks = book.of(w.hashes)
            for i in range(w.hi - w.lo):
                own = ranks[w.of(i)]
                counts.append(len(own))
                phrases.append([{"start": a, "label": b} for a, b in book.places(own)])
                blocks.append([{"start": a, "end": b, "label": c, "share": d} for a, b, c, d in book.blocks(own)])
        arrays = [pa.array(counts, pa.int64()), pa.array(phrases, phrase), pa.array(blocks, block)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], names=[*batch.schema.names[:-1], "n_words", "phrases", "blocks"])


def scan(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), templates=TEMPLATES, phrases=PHRASES, least: float = LEAST) -> DataFrame:
    """Columns ``keep`` with n_words, phrases (start, label) and blocks (start, end, label, share) of every text.

    Starts count words from 0.  Null and empty texts have no words and find
    nothing; texts of any length are scanned whole.  Repeated rows give repeated
    results, an empty table gives no rows, and further columns are ignored but
    for those named in ``keep``, whose values pass unchanged.  The templates,
    not the texts, bound what the driver and the tasks hold besides one batch.
    """
    small_batches(docs.sparkSession)
    book = Catalogue(templates, phrases, frequencies(docs, text_col, templates, phrases), least)
    rows = docs.select(*keep, F.col(text_col).alias("__scanned"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(partial(_scan, book=book), f"{schema}, {FOUND}")


def sql(table: str = "documents") -> str:
    """DuckDB SQL of the digest of ``scan``: every block of every template by its definition, without filters."""
    words_of = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    templates = ", ".join(f"({quoted(label)}, {quoted(text)})" for label, text in TEMPLATES)
    phrases = ", ".join(f"({quoted(label)}, {quoted(text)})" for text, label in PHRASES)
    return f"""
WITH d AS (SELECT doc_id, {words_of("coalesce(text, '')")} AS w FROM {table}),
p AS (SELECT label, string_split(phrase, ' ') AS q FROM (VALUES {phrases}) AS v(label, phrase)),
places AS (SELECT doc_id, label, unnest(list_filter(range(len(w)), lambda i: w[i + 1:i + len(q)] = q)) AS place FROM d, p),
base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
t AS (SELECT label, len(w) AS step, list_distinct(w) AS s, ceil({LEAST} * len(list_distinct(w)) - 1e-9) AS need FROM (SELECT label, {words_of("body")} AS w FROM (VALUES {templates}) AS v(label, body))),
numbers AS (SELECT doc_id, w, label, s, step, need, unnest(range(greatest(1, CAST(ceil(len(w) / step) AS BIGINT) - 1))) AS k FROM d, t WHERE len(list_intersect(w, s)) >= need),
blocks AS (SELECT doc_id, label, len(list_intersect(list_distinct(w[k * step + 1:(k + 2) * step]), s)) AS held, len(s) AS size, need FROM numbers),
found AS (SELECT doc_id, list(DISTINCT label) AS labels, max(held / size) AS share FROM blocks WHERE held >= need GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, a AS first_word, b AS last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
       greatest(coalesce(share, 0.0), CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)"""
