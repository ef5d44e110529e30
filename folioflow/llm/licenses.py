"""License scan: a trained paragraph classifier, confirmed against templates.

Each line, and each join of neighbouring lines that together reach a template, is classified by multinomial logistic regression over sparse word n-grams (1 to 3 words, those
of the templates) into licence families and ``unknown``. It is trained here on the templates, whole and with words left out, by
themselves and within prose, and on paragraphs of a bounded sample of ``SAMPLE`` texts and shuffled template words as unknown. A
temperature fitted on a third of the rows, with unknown paragraphs that training has not seen, calibrates the probabilities; a family must reach ``SURE``. A prediction
counts only if a template of the family confirms it: at least ``OVERLAP`` of the template's word pairs stand in the paragraph.

Notices are often wrapped hard, also within comments. A join is looked for in runs of lines that all have word pairs of one template (comment
markers do not count, a pair may span two lines, a hyphen at a line's end joins its words) and no blank line between them: the fewest lines that reach ``OVERLAP``, then their neighbours as
long as these add pairs. It is classified from the first of these pairs to the last, else as whole lines, and reported under its first line unless one of its lines is a hit of the family by itself.
Of joins that share words the one with most pairs counts, and a line's own hit of another family within a join gives way to it.

Scoring maps over whole texts, nothing is shuffled, and the model's size follows the templates.

Defined results: null and blank texts have no paragraphs and no licence. A text with several families reports the
likeliest, ties by name, and all of them in ``families``. Without documents the model is that of shuffled templates. Repeated rows stay. Extra columns are not read. Without
any text to sample, unknown is learnt from shuffled template words alone.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import only

SAMPLE, SURE, OVERLAP = 400, 0.6, 0.6
#: Of a sampled text so many paragraphs, none of more words.
PARAGRAPHS, PARAGRAPH_WORDS = 8, 1000
#: Customary short statements of each family.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Released under CC0 1.0 into the public domain."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
_WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")
#: Comment markers that are words, at the start of a line; all others are no words anyway.
MARKERS = ("c", "dnl", "rem")
_HYPHEN = re.compile(r"[a-z0-9]-\s*$", re.IGNORECASE)
UNKNOWN = "unknown"


def words_of(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def ngrams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)}


def pairs(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class Model:
    def __init__(self, templates: dict[str, list[str]]):
        self.families = [*sorted(templates), UNKNOWN]
        self.templates = {f: [pairs(words_of(t)) for t in ts] for f, ts in templates.items()}
        self.vocabulary = {g: i for i, g in enumerate(sorted({g for ts in templates.values() for t in ts for g in ngrams(words_of(t))}))}
        self.single = frozenset(g for g in self.vocabulary if " " not in g)
        #: the templates (family, number in it) that have a pair of words
        self.owners: dict[tuple[str, str], list[tuple[str, int]]] = {}
        for f, ts in self.templates.items():
            for k, t in enumerate(ts):
                for pair in t:
                    self.owners.setdefault(pair, []).append((f, k))
        self.weights = np.zeros((len(self.vocabulary) + 2, len(self.families)))
        self.temperature = 1.0

    def features(self, words: list[str]) -> tuple[list[int], float]:
        """Indices of the n-grams present, and the share of words outside the vocabulary."""
        known = [w if w in self.single else None for w in words]
        found, v = set(), self.vocabulary
        for i, w in enumerate(known):
            if w is not None:
                found.add(v[w])
                if i + 1 < len(known) and known[i + 1] is not None:
                    two = f"{w} {known[i + 1]}"
                    if two in v:
                        found.add(v[two])
                        if i + 2 < len(known) and known[i + 2] is not None and (three := f"{two} {known[i + 2]}") in v:
                            found.add(v[three])
        return sorted(found), 1 - sum(w is not None for w in known) / max(1, len(words))

    def logits(self, words: list[str]) -> np.ndarray:
        found, outside = self.features(words)
        return self.weights[found].sum(0) / math.sqrt(len(found) or 1) + self.weights[-2] + outside * self.weights[-1]

    def predict(self, words: list[str]) -> tuple[str, float]:
        z = self.logits(words) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return (self.families[k], float(p[k])) if p[k] >= SURE else (UNKNOWN, float(p[-1]))

    def similarity(self, family: str, words: list[str]) -> float:
        have = pairs(words)
        return max((len(t & have) / len(t) for t in self.templates[family] if t), default=0.0)

    def joins(self, lines: list[str], words: list[list[str]]) -> list[tuple[int, int, int, tuple[int, int], list[list[str]]]]:
        """Joins that reach a template, those with most of its pairs first: pairs, first and last line, place of the words in the text, and the
        words: from the first pair to the last, the same of the fewest lines, whole lines."""
        runs: dict[tuple[str, int], list[tuple[int, dict]]] = {}
        out: list[tuple[int, int, int, tuple[int, int], list[list[str]]]] = []
        #: words since the last blank line, and how many were before; the lines and where each begins
        before = 0
        said: list[str] = []
        numbers: list[int] = []
        starts: list[int] = []
        hyphen = False

        def close(key: tuple[str, int]) -> None:
            for x, y, x0, y0 in _shortest(run := runs.pop(key), len(self.templates[key[0]][key[1]])):
                spans = []
                for i, j in ((x, y), (x0, y0)):
                    places = [p for _, found in run[i : j + 1] for ps in found.values() for p in ps]
                    spans.append((min(places), max(places) + 2))
                at, end = bisect_right(starts, spans[0][0]) - 1, run[y][0] - numbers[0] + 1
                if numbers[at] < run[y][0]:
                    spans.append((starts[at], starts[end] if end < len(starts) else len(said)))
                    pairs_found = len({p for _, found in run[x : y + 1] for p in found})
                    out.append((pairs_found, numbers[at], run[y][0], (before + spans[0][0], before + spans[0][1]), [said[p:q] for p, q in dict.fromkeys(spans)]))

        for i, own in enumerate(words):
            if own and own[0] in MARKERS:
                own = own[1:]
            if not own:
                for key in list(runs):
                    close(key)
                before += len(said)
                said, numbers, starts, hyphen = [], [], [], False
                continue
            first = len(said)
            if hyphen and said:
                first -= 1
                said[-1] += "-" + own[0]
                own = own[1:]
            said.extend(own)
            hyphen = bool(_HYPHEN.search(lines[i]))
            numbers.append(i)
            starts.append(first)
            hits: dict[tuple[str, int], dict] = {}
            for at in range(max(0, first - 1), len(said) - 1):
                pair = (said[at], said[at + 1])
                for key in self.owners.get(pair, ()):
                    hits.setdefault(key, {}).setdefault(pair, []).append(at)
            for key in [k for k in runs if k not in hits]:
                close(key)
            for key, found in hits.items():
                runs.setdefault(key, []).append((i, found))
        for key in list(runs):
            close(key)
        return sorted(out, key=lambda x: (-x[0], x[1:4]))

    def scan(self, text: str | None) -> tuple[int, list[dict]]:
        """Lines with words, and the confirmed paragraphs: line, family, probability, similarity."""
        n, hits = 0, []
        lines = (text or "").split("\n")
        words = [words_of(line) for line in lines]

        def judged(i: int, own: list[str]) -> dict | None:
            family, p = self.predict(own)
            if family != UNKNOWN and (s := self.similarity(family, own)) >= OVERLAP:
                return {"line": i, "family": family, "probability": round(p, 6), "similarity": round(s, 6)}
            return None

        for i, (line, own) in enumerate(zip(lines, words, strict=True)):
            n += bool(own or line.strip())
            if not self.single.isdisjoint(own) and (hit := judged(i, own)):
                hits.append(hit)
        told = {(h["line"], h["family"]) for h in hits}
        taken: list[tuple[int, int]] = []
        for _, a, b, (p, q), spans in self.joins(lines, words):
            if any(p < y and x < q for x, y in taken):
                continue
            hit = next((h for own in spans if (h := judged(a, own))), None)
            if hit:
                taken.append((p, q))
                # a line that looked like a notice by itself may be the start of this one
                hits = [h for h in hits if not a <= h["line"] <= b or h["family"] == hit["family"] or not OVERLAP <= self.similarity(h["family"], spans[0]) <= hit["similarity"]]
                if all((i, hit["family"]) not in told for i in range(a, b + 1)):
                    hits.append(hit)
        return n, sorted(hits, key=lambda h: h["line"])


def _shortest(run: list[tuple[int, dict]], size: int) -> list[tuple[int, int, int, int]]:
    """Of a run of lines (number, pairs of a template of ``size`` pairs) the joins that reach ``OVERLAP`` with the fewest lines:
    first and last place in the run with all neighbours that add pairs, and without these."""
    out, count, have, a, done = [], {}, 0, 0, -1
    for b, (_, found) in enumerate(run):
        for pair in found:
            have += not count.get(pair)
            count[pair] = count.get(pair, 0) + 1
        if have < OVERLAP * size:
            continue
        while a < b and (rest := have - sum(count[p] == 1 for p in run[a][1])) >= OVERLAP * size:
            for pair in run[a][1]:
                count[pair] -= 1
            have, a = rest, a + 1
        if a <= done:
            continue
        seen, x, y = {p for p in count if count[p]}, a, b
        while x - 1 > done and not run[x - 1][1].keys() <= seen:
            x -= 1
            seen |= run[x][1].keys()
        while y + 1 < len(run) and not run[y + 1][1].keys() <= seen:
            y += 1
            seen |= run[y][1].keys()
        out.append((x, y, a, b))
        done = y
    return out


def train(paragraphs: list[str], templates: dict[str, list[str]] | None = None, steps: int = 300) -> Model:
    """Fit on templates and the paragraphs (unknown); deterministic."""
    templates = TEMPLATES if templates is None else templates
    model, rng = Model(templates), random.Random(7)
    prose = [w for p in paragraphs for w in words_of(p)] or ["lorem", "ipsum"]
    rows: list[tuple[list[str], str]] = []
    templates_pairs = [t for ts in model.templates.values() for t in ts if t]

    def like_template(words: list[str]) -> bool:
        have = pairs(words)
        return any(len(t & have) / len(t) >= OVERLAP for t in templates_pairs)

    for family, texts in templates.items():
        for text in texts:
            words = words_of(text)
            for _ in range(24):
                kept = [w for w in words if rng.random() > 0.06] or words
                k, m = rng.choice((0, 0, 0, 4, 12, 30)), rng.choice((0, 0, 0, 4, 12, 30))
                rows.append(([*rng.choices(prose, k=k), *kept, *rng.choices(prose, k=m)], family))
                mixed = rng.sample(words, len(words) if rng.random() < 0.5 else max(1, len(words) // 4))
                if not like_template(mixed):  # a short notice may come out whole
                    rows.append((mixed, UNKNOWN))
    rows += [(words, UNKNOWN) for words in map(words_of, paragraphs) if not like_template(words)]
    # a paragraph is on one side of the split, however often it is repeated
    sides = [zlib.crc32(" ".join(words).encode()) % 3 == 0 if family == UNKNOWN else rng.random() < 1 / 3 for words, family in rows]
    rows = [r for r, s in zip(rows, sides, strict=True) if not s] + [r for r, s in zip(rows, sides, strict=True) if s]
    x = np.zeros((len(rows), len(model.vocabulary) + 2))
    y = np.zeros((len(rows), len(model.families)))
    for i, (words, family) in enumerate(rows):
        found, outside = model.features(words)
        x[i, found] = 1 / math.sqrt(len(found) or 1)
        x[i, -2:] = 1, outside
        y[i, model.families.index(family)] = 1
    fit, check = slice(0, len(rows) - sum(sides)), slice(len(rows) - sum(sides), None)
    w, first, second = model.weights, 0.0, 0.0
    for t in range(1, steps + 1):
        z = x[fit] @ w
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x[fit].T @ (p - y[fit]) / max(1, len(p)) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w = w - 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    model.weights = w

    def loss(temperature: float) -> float:
        z = x[check] @ w / temperature
        return float(-((z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True))) * y[check]).sum())

    model.temperature = min((0.5, 0.75, 1.0, 1.5, 2.0, 3.0), key=loss)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Train with paragraphs of the ``sample`` ids that hash lowest as unknown: of each id one text, and of it the ``PARAGRAPHS`` whose digests are lowest.
    The ids' hashes come to the driver first, then no more than these paragraphs."""
    hashed = only(docs, id_col, text_col).toDF("id", "text").where("text is not null").select(F.xxhash64(F.col("id").cast("string")).alias("h"), "text")
    lowest = [r.h for r in hashed.select("h").distinct().orderBy("h").limit(sample).collect()]
    model = Model(TEMPLATES)

    def unknown(text: str) -> list[str]:
        """Lines that are no part of a notice over several lines."""
        lines = text.split("\n")
        words = [words_of(line) for line in lines]
        inside = {i for _, a, b, _, _ in model.joins(lines, words) for i in range(a, b + 1)}
        found = [line for i, line in enumerate(lines) if line.strip() and i not in inside and len(words[i]) <= PARAGRAPH_WORDS]
        return sorted(found, key=lambda line: (zlib.crc32(line.encode()), line))[:PARAGRAPHS]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()), pa.array([unknown(t) for t in texts], pa.list_(pa.string()))], ["h", "at", "lines"])

    found = hashed.where(F.col("h").isin(lowest)).mapInArrow(run, "h long, at long, lines array<string>")
    rows = found.groupBy("h").agg(F.min(F.struct("at", "lines")).alias("one")).select("h", "one.lines").collect()  # a row for each hash
    return train([line for r in sorted(rows) for line in r["lines"]])


def scanned(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_paragraphs``, ``license`` (or null), ``probability``, ``families``, ``hits`` (line, family, probability, similarity)."""
    kind = only(docs, id_col).toDF("id").schema[0]
    hit = pa.struct([("line", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("similarity", pa.float64())])

    def run(batches):
        for batch in batches:
            rows = [model.scan(t) for t in batch.column(1).to_pylist()]
            best = [min(h, key=lambda x: (-x["probability"], x["family"])) if h else None for _, h in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([b and b["family"] for b in best], pa.string()), pa.array([b and b["probability"] for b in best], pa.float64()), pa.array([sorted({x["family"] for x in h}) for _, h in rows], pa.list_(pa.string())), pa.array([h for _, h in rows], pa.list_(hit))],
                ["id", "n_paragraphs", "license", "probability", "families", "hits"],
            )

    rest = StructType.fromDDL("n_paragraphs long, license string, probability double, families array<string>, hits array<struct<line: long, family: string, probability: double, similarity: double>>")
    out = only(docs, id_col, text_col).mapInArrow(run, StructType([kind, *rest.fields]))
    return out.withColumnRenamed("id", id_col)
