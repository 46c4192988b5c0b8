"""License scans by a positional rare-token index over license templates.

The words of all templates are the licence words; one scan counts in how many files each occurs. Of each template the rarest
words are looked up in the files that hold its mandatory key phrase; one that stands at p and that the template has at q
speaks for the template starting at p - q. One word more is looked up than a start may miss, so every start that holds is
found, however frequent the words. A start is verified word by word, and the key phrase must stand at it in full.

Base phrases are found beside that at every place they stand and always give their labels.

Scale: two scans, no text is shuffled; the counts are as many as the templates have words, whatever the corpus.

Defined cases: a null or empty text has no words, no labels and score 0; ids may be null or repeat, each row is scanned;
equally rare words are taken in alphabetical order, which changes no result; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quire.llm.words import Texts, pieces

# Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Label, mandatory key phrase, words of the notice as commonly published.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "mit license", "licensed under the mit license"),
    ("apache", "apache license", "licensed under the apache license version 2 0"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "general public license", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "cc by 4 0", "licensed under cc by 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc0", "cc0 1 0", "licensed under cc0 1 0 universal"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved", "copyright all rights reserved"),
)
LEAST_SCORE = 0.6

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:0x30] = _SEPARATOR[0x3A:0x61] = _SEPARATOR[0x7B:0x80] = True


class Index:
    """Words and key phrases of the templates; words have numbers in alphabetical order."""

    def __init__(self, templates=TEMPLATES, base=BASE):
        self.templates = [(label, key.split(), words.split()) for label, key, words in templates]
        self.base = [(p.split(), label) for p, label in base]
        texts = [w for _, k, t in self.templates for w in (*k, *t)] + [w for p, _ in self.base for w in p]
        self.words = sorted(set(texts))
        self.number = {w: k for k, w in enumerate(self.words)}
        self.keys: dict[str, list[int]] = defaultdict(list)  # key phrase -> templates
        for t, (_, key, _) in enumerate(self.templates):
            self.keys[" ".join(key)].append(t)
        own = Texts(pa.array(self.words, pa.large_string()), lower=True, separators=_SEPARATOR)
        h = own.word_hashes()
        self.order = np.argsort(h)
        self.sorted = h[self.order]

    def numbers(self, t: Texts) -> np.ndarray:
        """The number of each word, -1 for others."""
        h = t.word_hashes()
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1)

    def phrase(self, n: np.ndarray, owner: np.ndarray, words: list[str]) -> np.ndarray:
        """Starts at which the words stand one after the other in one text."""
        m = len(n) - len(words) + 1
        if m <= 0:
            return np.zeros(0, np.int64)
        hit = owner[:m] == owner[len(words) - 1 :]
        for k, w in enumerate(words):
            hit &= n[k : k + m] == self.number[w]
        return np.flatnonzero(hit)

    def rarest(self, files: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words (sorted) and positions to look up of each template: its rarest, one more than a verified start may miss."""
        out = []
        for _, _, words in self.templates:
            own = np.array([self.number[w] for w in words])
            miss = sum(k / len(words) >= LEAST_SCORE for k in range(len(words)))
            at = np.lexsort((own, files[own]))[: miss + 1]
            at = at[np.argsort(own[at], kind="stable")]
            out.append((own[at], at))
        return out

    def match(self, n: np.ndarray, keys: dict[int, np.ndarray], rarest: list[tuple[np.ndarray, np.ndarray]]) -> tuple[set[str], float]:
        """Labels and score of one file from its words' numbers. keys: where the key phrases of templates stand in it."""
        labels, score = set(), 0.0
        for t, stands in keys.items():
            label, key, words = self.templates[t]
            want, m = np.array([self.number[w] for w in words]), len(words)
            looked, places = rarest[t]
            at = np.flatnonzero(np.isin(n, looked))
            lo, hi = np.searchsorted(looked, n[at], "left"), np.searchsorted(looked, n[at], "right")
            starts = np.unique(np.concatenate([p - places[x:y] for p, x, y in zip(at.tolist(), lo.tolist(), hi.tolist())] or [at]))
            # the key phrase begins at most its own length before the start, and before the template's end
            next_key = np.searchsorted(stands, np.maximum(starts - len(key), 0))
            starts = starts[np.append(stands, len(n) + m)[next_key] < np.minimum(starts + m, len(n))]
            same = np.zeros(len(starts), np.int64)
            for q in range(m):
                inside = (starts + q >= 0) & (starts + q < len(n))
                same += inside & (n[np.clip(starts + q, 0, len(n) - 1)] == want[q])
            best = same.max(initial=0) / m
            if best >= LEAST_SCORE:
                labels.add(label)
                score = max(score, best)
        return labels, score


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates=TEMPLATES, base=BASE, most_files: float | None = None) -> DataFrame:
    """The id and SCHEMA for each row. most_files, once a cut of frequent words, has no effect: a word's rank is its rarity."""
    slim = docs.select(F.col(id_col).alias("given"), F.col(text).alias("measured"))
    index = Index(templates, base)
    held = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches):
        own, n, rows = held.value, np.zeros(len(held.value.words) + 1, np.int64), 0
        for batch in batches:
            for a, b in pieces(batch, "measured"):
                t = Texts(batch.slice(a, b - a).column("measured"), lower=True, separators=_SEPARATOR)
                k = own.numbers(t)
                pair = np.unique(t.owner()[k >= 0] * len(n) + k[k >= 0])
                n += np.bincount(pair % len(n), minlength=len(n))
                rows += t.n
        n[-1] = rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["word", "files"])

    found = np.zeros(len(index.words) + 1, np.int64)
    for r in slim.select("measured").mapInArrow(count, "word long, files long").groupBy("word").agg(F.sum("files").alias("files")).collect():
        found[r["word"]] = r["files"]

    rarest = index.rarest(found[:-1])

    def run(batches):
        own = held.value
        for batch in batches:
            for a, b in pieces(batch, "measured"):
                part = batch.slice(a, b - a)
                t = Texts(part.column("measured"), lower=True, separators=_SEPARATOR)
                n, owner = own.numbers(t), t.owner()
                number, first, last = np.zeros(t.n, np.int64), np.full(t.n, 1 << 60), np.full(t.n, -1)
                labels: list[set[str]] = [set() for _ in range(t.n)]
                for words, label in own.base:
                    at = own.phrase(n, owner, words)
                    number += np.bincount(owner[at], minlength=t.n)
                    np.minimum.at(first, owner[at], at - t.first[owner[at]])
                    np.maximum.at(last, owner[at], at - t.first[owner[at]])
                    for k in np.unique(owner[at]).tolist():
                        labels[k].add(label)
                score, more = np.zeros(t.n), [set(x) for x in labels]
                keys: dict[int, dict[int, np.ndarray]] = defaultdict(dict)
                for phrase, of in own.keys.items():
                    at = own.phrase(n, owner, phrase.split())
                    at, texts = at - t.first[owner[at]], owner[at]
                    for k in np.unique(texts).tolist():
                        keys[k].update(dict.fromkeys(of, at[np.searchsorted(texts, k) : np.searchsorted(texts, k, "right")]))
                for k, where in keys.items():
                    new, score[k] = own.match(n[t.first[k] : t.last[k]], where, rarest)
                    more[k] |= new
                none = number == 0
                join = lambda x: pa.array([",".join(sorted(y)) for y in x], pa.string())
                yield pa.RecordBatch.from_arrays([part.column("given"), pa.array(t.count), pa.array(number), pa.array(first, mask=none), pa.array(last, mask=none), join(labels), join(more), pa.array(score)], names=names)

    schema = StructType([slim.schema["given"], *[StructField(f.name, f.dataType) for f in StructType.fromDDL(SCHEMA)]])
    names = schema.names
    return slim.mapInArrow(run, schema).withColumnRenamed("given", id_col)
