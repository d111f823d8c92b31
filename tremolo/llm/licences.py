"""Operator 5: licence scans. Headers and licence files are held against templates by the cosine of sparse TF-IDF vectors; files
without a licence of their own take that of the nearest ancestor directory that has a licence file, by joins on paths.

Segments of a text (itself, its blocks, lines, sentences, and runs of consecutive lines as long as a template) are compared,
without comment marks. Templates are notices and whole licence texts (``licence_texts``). Inverse document frequencies of the
templates' words are of the whole corpus; other words weigh as much as these do on average. A text is looked into only if it has
a word without which no template can come near enough, and held only against templates that its words could come near to, so
nothing that could match is passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontaminate import words_of

COSINE = 0.7
#: A file is a licence file if its whole text is this near a whole licence, or if its name says so and a licence is found in it.
FILE_COSINE = 0.7
FILE_NAME = re.compile(r"(?i)(un)?licen[cs]e|copying|copyright|notice")
#: Directories up to which their table is broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_DIRS = 200_000

#: The identifier that any licence in the same text goes before.
RESERVED = "LicenseRef-proprietary"
#: Comment marks that are words; the others are no part of words.
MARKS = re.compile(r"^[ \t]*(?:dnl|rem)\b", re.IGNORECASE | re.MULTILINE)
#: Of matches one within the other, that of a template so many times as long counts.
LONGER = 1.5
#: Words of a text whose repetitions bound the lengths of its runs of lines.
FREQUENT = 32

#: Notices by which licences are granted, by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license. See the LICENSE file in the project root for full license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (RESERVED, "All rights reserved."),
)


def full_texts() -> tuple[tuple[str, str], ...]:
    """Whole licences, by SPDX identifier."""
    found = (f for f in (resources.files(__package__) / "licence_texts").iterdir() if f.name.endswith(".txt"))
    return tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(found, key=lambda f: f.name))


WHOLE = full_texts()
TEMPLATES = (*NOTICES, *WHOLE)

FOUND = "doc_id long, path string, licence string, cosine double, kind string, n_notices long"


def sources(templates: tuple[tuple[str, str], ...]) -> set[bytes]:
    return {w for _, text in templates for w in words_of(text)}


def document_frequencies(files: DataFrame, vocabulary: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """The number of texts, and in how many each word of the templates is."""
    common.bounded_batches(files.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[bytes] = Counter()
        n = 0
        for batch in batches:
            for text in batch["text"]:
                total.update(vocabulary.intersection(words_of(text)))
                n += 1
        yield pd.DataFrame([(b"", n), *total.items()], columns=["word", "n"])

    # a row a word of the templates
    found = {bytes(r["word"]): r["n"] for r in files.select("text").mapInPandas(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return found.pop(b"", 0), found


class Matcher:
    """Templates as unit vectors."""

    def __init__(self, templates: tuple[tuple[str, str], ...], n: int, frequencies: dict[bytes, int], least: float = COSINE):
        self.least = least
        self.idf = {w: math.log((1 + n) / (1 + frequencies.get(w, 0))) + 1 for w in sorted(sources(templates))}
        self.other = sum(self.idf.values()) / max(1, len(self.idf))
        self.vectors = [(name, self.vector(words_of(text))) for name, text in templates]
        self.sizes = [len(words_of(text)) for _, text in templates]
        self.whole = [t in WHOLE for t in templates]
        self.place = {w: i for i, w in enumerate(self.idf)}
        self.weights = np.array(list(self.idf.values()))
        self.table = np.zeros((len(self.vectors), len(self.place)))
        for k, (_, v) in enumerate(self.vectors):
            self.table[k, [self.place[w] for w in v]] = list(v.values())
        # words by weight, the commonest first, as long as they alone can't bring any template near enough
        held = [0.0] * len(self.vectors)
        self.telling = set(self.idf)
        for word in sorted(self.idf, key=lambda w: (self.idf[w], w)):
            more = [h + v.get(word, 0.0) ** 2 for h, (_, v) in zip(held, self.vectors, strict=True)]
            if max(more) >= least * least:
                break
            held = more
            self.telling.discard(word)

    def vector(self, words: list[bytes]) -> dict[bytes, float]:
        counts = Counter(words)
        weights = {w: c * self.idf.get(w, self.other) for w, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in weights.values())) or 1.0
        return {w: x / norm for w, x in weights.items()}

    def nearest(self, words: list[bytes], among: list[int] | None = None) -> tuple[float, str | None]:
        """The largest cosine and its template; of equal ones the first template."""
        cosine, k = self._nearest(words, range(len(self.vectors)) if among is None else among)
        return cosine, None if k is None else self.vectors[k][0]

    def _nearest(self, words: list[bytes], among) -> tuple[float, int | None]:
        own = self.vector(words)
        best = (0.0, None)
        for k in among:
            vector = self.vectors[k][1]
            few, many = (own, vector) if len(own) < len(vector) else (vector, own)
            cosine = sum(x * many[w] for w, x in few.items() if w in many)
            if cosine > best[0] + 1e-12:
                best = (cosine, k)
        return best

    def near(self, words: set[bytes]) -> list[int]:
        """The templates that a text of such words could come near to: no cosine is over the length of a template's part in them."""
        places = [self.place[w] for w in words if w in self.place]
        bound = (self.table[:, places] ** 2).sum(axis=1)
        return np.flatnonzero(bound >= self.least * self.least - 1e-9).tolist()

    def segments(self, lines: list[list[int]]) -> Iterator[tuple[int, int]]:
        """(first word, end) of blocks, lines and sentences; ``lines`` has the numbers of words of each line's sentences."""
        at = block = n_lines = 0
        for sizes in [*lines, None]:
            if sizes is None or not sizes:
                if n_lines > 1 and at > block:
                    yield block, at
                block, n_lines = at, 0
                continue
            first = at
            for n in sizes:
                if len(sizes) > 1 and n:
                    yield at, at + n
                at += n
            if at > first:
                yield first, at
            n_lines += 1

    def runs(self, words: list[bytes], offsets: np.ndarray, near: list[int]) -> Iterator[tuple[float, int, int, int]]:
        """(cosine, template, first word, end) of runs of lines that are as long as a template, to the line below and above, and near it."""
        own: dict[bytes, int] = {}
        ids = np.array([self.place[w] if w in self.place else len(self.place) + own.setdefault(w, len(own)) for w in words])
        weight = np.append(self.weights, self.other)[np.minimum(ids, len(self.weights))]
        square = np.concatenate(([0.0], np.cumsum(weight * weight)))
        held, counts = np.unique(ids, return_counts=True)
        often = [(np.concatenate(([0], np.cumsum(ids == i))), self.weights[i] if i < len(self.weights) else self.other) for i in held[np.argsort(-counts, kind="stable")[:FREQUENT]]]
        starts = offsets[:-1]
        for k in near:
            part = np.append(self.table[k], 0.0)[np.minimum(ids, len(self.weights))] * weight
            dots = np.concatenate(([0.0], np.cumsum(part)))
            above = np.minimum(np.searchsorted(offsets, starts + self.sizes[k]), len(offsets) - 1)
            first, end = np.concatenate((starts, starts)), np.concatenate((offsets[above], offsets[above - 1]))
            keep = end > first
            first, end = first[keep], end[keep]
            dot, least = dots[end] - dots[first], square[end] - square[first]
            # a word's repetitions lengthen the vector by more than their number
            keep = dot >= self.least * np.sqrt(least) * (1 - 1e-9)
            first, end, dot, least = first[keep], end[keep], dot[keep], least[keep]
            if not first.size:
                continue
            for upto, w in often:
                c = upto[end] - upto[first]
                least = least + (c * c - c) * (w * w)
            for i in np.flatnonzero(dot >= self.least * np.sqrt(least) * (1 - 1e-9)).tolist():
                which, n = np.unique(ids[first[i] : end[i]], return_counts=True)
                cosine = float(dot[i]) / float(np.linalg.norm(n * np.append(self.weights, self.other)[np.minimum(which, len(self.weights))]))
                if cosine >= self.least:
                    yield cosine, k, int(first[i]), int(end[i])

    def matches(self, text: str, near: list[int]) -> list[tuple[float, int]]:
        """(cosine, template) of the parts of a text that are near a template, none within another; longer templates go first."""
        lines, words = [], []
        for line in MARKS.sub("", text).split("\n"):
            parts = [words_of(p) for p in re.split(r"(?<=[.!?;])\s+", line)]
            lines.append([len(p) for p in parts] if line.strip(" \t\r") else [])
            words += [w for p in parts for w in p]
        found = set()
        for first, end in self.segments(lines):
            own = words[first:end]
            if not self.telling.isdisjoint(own):
                cosine, k = self._nearest(own, near)
                if cosine >= self.least:
                    found.add((cosine, k, first, end))
        offsets = np.unique(np.concatenate(([0], np.cumsum([sum(x) for x in lines], dtype=np.int64))))
        found.update(self.runs(words, offsets, near))
        covered, out = np.zeros(len(words)), []
        for _, k, first, end in sorted(found, key=lambda f: (self.sizes[f[1]], f)):
            covered[first:end] = self.sizes[k]
        taken = np.zeros(len(words), bool)
        for cosine, k, first, end in sorted(found, key=lambda f: (-round(f[0], 9), self.vectors[f[1]][0], f[2], f[3], f[1])):
            if not taken[first:end].any() and covered[first:end].min() < LONGER * self.sizes[k]:
                taken[first:end] = True
                out.append((cosine, k))
        return out

    def scan(self, text: str, named: bool = False) -> tuple[str | None, float, str | None, int]:
        """Licence, cosine, kind (file or header) and the number of notices. ``named``: the file's name is that of a licence file."""
        words = words_of(text)
        if self.telling.isdisjoint(words) or not (near := self.near(set(words))):
            return None, 0.0, None, 0
        cosine, k = self._nearest(words, near)
        if cosine >= FILE_COSINE:
            return self.vectors[k][0], cosine, "file" if named or self.whole[k] else "header", 1
        found = [(cosine, self.vectors[k][0]) for cosine, k in self.matches(text, near)]
        granted = [f for f in found if f[1] != RESERVED] or found
        if not granted:
            return None, 0.0, None, 0
        cosine, name = min(granted, key=lambda f: (-f[0], f[1]))
        return name, cosine, "file" if named and name != RESERVED else "header", len({n for _, n in found})


def names_a_licence(path: str) -> bool:
    """Whether a path's last part is a name of licence files, by its stem or its ending (LICENSE, COPYING.lesser, MIT-LICENSE.txt)."""
    return any(FILE_NAME.fullmatch(part) for part in re.split(r"[._\-\s]", path.rsplit("/", 1)[-1]))


@common.tidy
def scan_licences(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """Per row of ``files`` (doc_id, path, text, any more): doc_id, path, licence, cosine, kind, n_notices, licence_dir.

    kind is file, header, inherited or null. A text with notices of several licences gets the nearest, reserved rights after all
    others; n_notices counts them. Of several licence files in a directory the nearest counts, then the smallest licence and path.
    A notice, however alone in its text, makes no licence file: that takes a whole licence, or a licence file's name. Null texts
    count as empty, null paths as files at the root. Repeated rows come out each. Very long texts are compared whole and in all
    their parts. An empty table gives none; other columns, whatever their names, aren't read.
    """
    rows = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), common.text_of().alias("text"))
    n, frequencies = document_frequencies(rows, sources(templates))
    sent = files.sparkSession.sparkContext.broadcast(Matcher(templates, n, frequencies))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            frame = pd.DataFrame([sent.value.scan(t, names_a_licence(p)) for t, p in zip(batch["text"], batch["path"], strict=True)], columns=["licence", "cosine", "kind", "n_notices"])
            frame["doc_id"], frame["path"] = batch["doc_id"].astype("Int64"), batch["path"]
            yield frame

    found = common.cut(rows.mapInPandas(scan, FOUND).withColumn("dir", F.regexp_replace("path", "/?[^/]*$", "")), keep=True)
    licensed = found.where("kind = 'file'").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("a"), F.col("licence").alias("b"), F.col("path").alias("c"))).alias("best"))
    licensed = common.cut(licensed.select(F.col("dir").alias("licence_dir"), F.col("best.b").alias("of"), (-F.col("best.a")).alias("near")))
    # each directory's ancestors, itself too, from the root down
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    dirs = found.select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("licence_dir"))
    licensed = F.broadcast(licensed) if licensed.count() <= BROADCAST_DIRS else licensed
    files_in = found.groupBy("dir").agg(F.count("*").alias("files"))
    nearest = dirs.join(licensed, "licence_dir").groupBy("dir").agg(F.max_by(F.struct("licence_dir", "of", "near"), F.length("licence_dir")).alias("up"))
    nearest = common.cut(nearest.join(files_in, "dir"), keep=True)
    joined = common.looked_up(found, nearest, "dir", ["up"], "files", BROADCAST_DIRS)
    own = F.col("licence").isNotNull()
    return joined.select(
        "doc_id", "path", F.coalesce("licence", "up.of").alias("licence"), F.when(own, F.col("cosine")).otherwise(F.col("up.near")).alias("cosine"),
        F.when(own, F.col("kind")).when(F.col("up").isNotNull(), "inherited").alias("kind"), "n_notices", F.when(~own, F.col("up.licence_dir")).alias("licence_dir"),
    )


def laid_out(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text) of a tree that ``documents`` don't have: a document lies in the folder of its number by 256, and there in that
    of its number by 16. The first of a folder is the folder's licence file, by its name; whether it holds a licence is for the scan
    to say."""
    number = F.col("doc_id").cast("long")
    wide, narrow = F.floor(number / 256).cast("string"), F.floor(number / 16).cast("string")
    own = F.concat_ws("/", wide, narrow, F.when(number % 16 == 0, "LICENSE").otherwise(number.cast("string")))
    place = F.when(number % 256 == 0, F.concat_ws("/", wide, F.lit("LICENSE"))).when(number.isNotNull(), own).otherwise("unknown")
    return docs.select("doc_id", place.alias("path"), "text")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, as files number by 256/number by 16/number; the first of a folder is named LICENSE."""
    return scan_licences(laid_out(common.table(spark, sf_dir, "documents")))
