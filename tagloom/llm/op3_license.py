"""License scan: text against license templates by Dice's coefficient over word bigrams.

A text is cut into segments: every line, every paragraph (lines up to an empty
one) and the whole text. Beside them, windows over the bigrams of the whole text find
notices among other words: of windows that overlap, or lie in a segment found, the best counts. A segment is normalised (lower case, words of letters,
digits and version points) and compared with every template by
2 * |A and B| / (|A| + |B|) over the sets of word bigrams. For a threshold t
that can only be reached where |A| * t / (2 - t) <= |B| <= |A| * (2 - t) / t,
so templates outside of these bounds are never compared.

Each text is scanned whole where it lies, with no shuffle. Null and empty
texts have no license; of templates that match equally well the first by name
counts; repeated rows are scanned one by one; extra columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from .common import table

THRESHOLD = 0.8

# License notices as they are commonly written.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or
        agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF
        ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "gpl-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "isc-notice": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    "lgpl-2.1-notice": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-notice": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
        publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
        subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
        portions of the Software.""",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "public-domain": "This work is dedicated to the public domain.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def bigrams(text: str) -> frozenset[tuple[str, str]]:
    words = _WORD.findall(text.lower())
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.templates = sorted(((len(b), name, b) for name, t in templates.items() if (b := bigrams(t))), key=lambda x: x[:2])
        self.sizes = [n for n, _, _ in self.templates]
        self.carriers: dict[tuple[str, str], list[int]] = {}
        for k, (_, _, b) in enumerate(self.templates):
            for g in b:
                self.carriers.setdefault(g, []).append(k)

    def best(self, segment: str) -> tuple[float, str] | None:
        """The best template of a segment that reaches the threshold."""
        grams = bigrams(segment)
        n, t = len(grams), self.threshold
        low, high = bisect_left(self.sizes, n * t / (2 - t) - 1e-9), bisect_right(self.sizes, n * (2 - t) / t + 1e-9)
        found = [(-2 * len(grams & b) / (n + m), name) for m, name, b in self.templates[low:high] if n]
        score, name = min(found, default=(0.0, ""))
        return (-score, name) if -score >= t else None

    def windows(self, words: list[str]) -> list[tuple[float, int, int, str]]:
        """-coefficient, start, end (in words) and template of windows that reach the threshold: the best from each start at a shared bigram.

        A window that holds its first bigram once more says no more than without it, so none goes on that far."""
        grams, t = list(zip(words, words[1:], strict=False)), self.threshold
        places: dict[int, list[int]] = {}
        for i, g in enumerate(grams):
            for k in self.carriers.get(g, ()):
                places.setdefault(k, []).append(i)
        out = []
        for k, at in places.items():
            m, name, b = self.templates[k]
            if len({grams[i] for i in at}) < m * t / (2 - t) - 1e-9:
                continue
            for i in at:
                seen: set[tuple[str, str]] = set()
                shared, best = 0, None
                for j in range(i, len(grams)):
                    g = grams[j]
                    if g in seen:
                        if g == grams[i]:
                            break
                        continue
                    seen.add(g)
                    if len(seen) > m * (2 - t) / t + 1e-9:
                        break
                    if g in b:
                        shared += 1
                        score = 2 * shared / (len(seen) + m)
                        if score >= t and (best is None or -score < best[0]):
                            best = (-score, i, j + 2, name)
                if best:
                    out.append(best)
        return out

    def scan(self, text: str) -> dict[str, tuple[float, int]]:
        """For each license found: its best coefficient and the number of different segments that it suits best."""
        found: dict[str, tuple[float, int]] = {}
        lines = text.split("\n")
        paragraphs = re.split(r"\n[ \t\r]*\n", text)
        seen: dict[str, tuple[float, str] | None] = {}
        words = _WORD.findall(text.lower())
        near = self.windows(words)
        taken = bytearray(len(words) if near else 0)
        for level in (lines, paragraphs if len(paragraphs) < len(lines) else [], [text] if len(lines) > 1 else []):
            at = 0
            for segment in level:
                if len(segment) >= 3 and segment not in seen:
                    seen[segment] = hit = self.best(segment)
                    if hit:
                        score, n = found.get(hit[1], (0.0, 0))
                        found[hit[1]] = (max(score, hit[0]), n + 1)
                if near:
                    size = len(_WORD.findall(segment.lower()))
                    if seen.get(segment):
                        taken[at : at + size] = b"\1" * size
                    at += size
        told: set[tuple[str, ...]] = set()
        for minus, i, j, name in sorted(near):
            if any(taken[i:j]):
                continue
            taken[i:j] = b"\1" * (j - i)
            if (key := tuple(words[i:j])) not in told:
                told.add(key)
                score, n = found.get(name, (0.0, 0))
                found[name] = (max(score, -minus), n + 1)
        return found


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_licenses, licenses (names in order, comma-joined), best (the highest coefficient, 0 if none), n_segments."""
    schema = StructType([
        docs.schema["doc_id"],
        StructField("n_licenses", IntegerType(), False),
        StructField("licenses", StringType(), False),
        StructField("best", DoubleType(), False),
        StructField("n_segments", IntegerType(), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            found = [scanner.scan(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(map(len, found), pa.int32()),
                    pa.array([",".join(sorted(f)) for f in found], pa.string()),
                    pa.array([max((s for s, _ in f.values()), default=0.0) for f in found], pa.float64()),
                    pa.array([sum(n for _, n in f.values()) for f in found], pa.int32()),
                ],
                names=schema.names,
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).withColumn("best", F.round("best", 6))
