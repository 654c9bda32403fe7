"""License notices by patience alignment with templates.

A text is cut into words. For a template of n words a notice must match at least
``COVERAGE`` of them, so at most ``n - ceil(COVERAGE * n)`` words may be missing; of any
one more words of the template at least one has to occur. The longest words of each
template are these seeds, and a stretch of text around each seed, as long as the
template to both sides of the seed's place in it, with some slack that is doubled, once
at least, while more words match, is aligned with the whole template: words unique to both sides are anchors, the longest increasing
subsequence of anchors is kept, the gaps between anchors are aligned in the same way,
and where a gap has no anchor its equal ends are matched. The share of the template's
words matched is its coverage. The words that name a license or its version are required: a
notice matches all of them, and the longest is the template's only seed.

Of hits that overlap, the one with the most matched words is the notice, so a longer
wording wins over a shorter one that it contains. Every notice has the span of its first
to last matched word in characters. No text is cut or skipped, and no number
of notices is limited.

Defined cases: null, empty or wordless texts have no notices; repeated notices are
counted each; ties in coverage go to the earlier span; repeated rows give repeated
results; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rowscribe.llm.batches import in_small_batches
from rowscribe.llm.registry import query, read

COVERAGE = 0.8
SLACK = 0.25  # of a template's length, to both sides of a stretch at first
LEAST_SLACK = 4  # words, to both sides of a widened stretch
WORDS = re.compile(r"[^\W_]+")

# Wordings of public licenses and notices.
TEMPLATES: dict[str, str] = {
    "all-rights-reserved": "All rights reserved.",
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "Apache-1.1-notice": "Licensed under the Apache License, Version 1.1.",
    "BSD-notice": "Released under the BSD License.",
    "ISC-notice": "Released under the ISC License.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0-notice": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-ND-4.0-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-SA-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-3.0-work": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "GPL-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met"
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}

# Words of a template that a notice has to match: names, versions and kinds.
REQUIRED: dict[str, str] = {
    "MIT-notice": "MIT",
    "Apache-1.1-notice": "Apache 1",
    "Apache-2.0-notice": "Apache 2",
    "Apache-2.0-header": "Apache 2",
    "BSD-notice": "BSD",
    "ISC-notice": "ISC",
    "CC-BY-4.0-notice": "CC BY 4",
    "CC-BY-SA-4.0-notice": "CC BY SA 4",
    "CC-BY-ND-4.0-notice": "CC BY ND 4",
    "CC-BY-NC-4.0-notice": "CC BY NC 4",
    "CC-BY-NC-SA-4.0-notice": "CC BY NC SA 4",
    "CC-BY-NC-ND-4.0-notice": "CC BY NC ND 4",
    "CC-BY-4.0-work": "Creative Commons Attribution 4",
    "CC-BY-SA-4.0-work": "Creative Commons Attribution ShareAlike 4",
    "CC-BY-ND-4.0-work": "Creative Commons Attribution NoDerivatives 4",
    "CC-BY-NC-4.0-work": "Creative Commons Attribution NonCommercial 4",
    "CC-BY-NC-SA-4.0-work": "Creative Commons Attribution NonCommercial ShareAlike 4",
    "CC-BY-NC-ND-4.0-work": "Creative Commons Attribution NonCommercial NoDerivatives 4",
    "CC-BY-3.0-work": "Creative Commons Attribution 3",
    "GPL-2.0-notice": "GNU General Public 2",
    "GPL-3.0-notice": "GNU General Public 3",
    "LGPL-3.0-notice": "GNU Lesser General Public 3",
    "AGPL-3.0-notice": "GNU Affero General Public 3",
    "GPL-header": "GNU General Public",
}


def words_of(text: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(text)]


def _unique(words: list[str], low: int, high: int) -> dict[str, int]:
    seen: dict[str, int] = {}
    for i in range(low, high):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs whose second parts increase; first parts do already."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        j = bisect.bisect_left(tails, b)
        back.append(at[j - 1] if j else -1)
        if j == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[j], at[j] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched positions of two word lists, increasing in both."""
    found: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        ours, theirs = _unique(a, a0, a1), _unique(b, b0, b1)
        anchors = _increasing(sorted((i, theirs[w]) for w, i in ours.items() if w in theirs))
        if anchors:
            found += anchors
            edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:])]
            continue
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
    return sorted(found)


class Scanner:
    """Finds the notices of a catalogue of templates."""

    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE, required: dict[str, str] = REQUIRED):
        self.coverage = coverage
        self.required: dict[str, set[int]] = {}  # places in the template
        self.templates = {name: words_of(text) for name, text in templates.items()}
        self.seeds: dict[str, list[tuple[str, int]]] = {}  # word -> template, place in it
        for name, words in self.templates.items():
            spare = len(words) - math.ceil(coverage * len(words) - 1e-9)
            order = sorted(range(len(words)), key=lambda i: (-len(words[i]), i))
            must = words_of(required.get(name, ""))
            self.required[name] = {words.index(w) for w in must}
            wanted: set[str] = {max(must, key=len)} if must else set()
            for rank, i in enumerate(order):
                if rank <= spare and not must:
                    wanted.add(words[i])
            for i, word in enumerate(words):
                if word in wanted:
                    self.seeds.setdefault(word, []).append((name, i))

    def _aligned(self, words: list[str], name: str, start: int) -> list[tuple[str, float, int, int]]:
        """The best notice of a template that would start about here, if any."""
        template, required = self.templates[name], self.required[name]
        first = slack = math.ceil(SLACK * len(template))
        most, out = 0, []
        while True:
            low, high = max(0, start - slack), min(len(words), start + len(template) + slack)
            matched = patience(words[low:high], template)
            grown, share = len(matched) > most, len(matched) / len(template)
            if grown:
                most = len(matched)
            if (grown or not out) and share >= self.coverage - 1e-9 and required <= {j for _, j in matched}:
                out = [(name, share, low + matched[0][0], low + matched[-1][0])]
            if out and most == len(template) or slack > first and not grown or low == 0 and high == len(words):
                return out
            slack = max(LEAST_SLACK, 2 * slack)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) of every notice, by start."""
        words = words_of(text or "")
        seeds = self.seeds
        hits = [i for i, w in enumerate(words) if w in seeds]
        if not hits:
            return []
        tried = set()
        found = []
        for i in hits:
            for name, place in seeds[words[i]]:
                if (name, i - place) not in tried:
                    tried.add((name, i - place))
                    found += self._aligned(words, name, i - place)
        if not found:
            return []
        kept: list[tuple[str, float, int, int]] = []
        starts: list[int] = []
        ends: list[int] = []
        for hit in sorted(found, key=lambda h: (-round(h[1] * len(self.templates[h[0]])), -h[1], h[3] - h[2], h[2], h[0])):
            _, _, first, last = hit
            place = bisect.bisect_right(starts, last)
            if not place or ends[place - 1] < first:
                starts.insert(place, first)
                ends.insert(place, last)
                kept.append(hit)
        spans = [m.span() for m in WORDS.finditer(text)]
        return sorted(((n, s, spans[a][0], spans[b][1]) for n, s, a, b in kept), key=lambda h: (h[2], h[3], h[0]))


NOTICES = "array<struct<license:string,coverage:double,start:bigint,end:bigint>>"


def scan_licenses(docs: DataFrame, text: str, templates: dict[str, str], into: str = "notices") -> DataFrame:
    """The columns of ``docs`` without ``text``, and the notices found in it."""
    schema = StructType([f for f in docs.schema.fields if f.name not in (text, into)])
    kept = list(schema.names)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))
    full = schema.add(into, docs.sparkSession.createDataFrame([], f"{into} {NOTICES}").schema[into].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scanner(templates).scan
        for batch in batches:
            found = [[dict(zip(("license", "coverage", "start", "end"), h)) for h in scan(t.as_py())] for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, kind)], [*kept, into])

    return in_small_batches(docs).mapInArrow(run, full)


@query("op10_license_scan")
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", TEMPLATES)
    best = F.array_max(F.transform("notices", lambda n: F.struct(n["coverage"], (-n["start"]).alias("at"), n["license"])))
    return found.select(
        "doc_id",
        F.size("notices").cast("bigint").alias("n_notices"),
        best["license"].alias("license"),
        F.coalesce(best["coverage"], F.lit(0.0)).alias("coverage"),
        F.array_join(F.transform("notices", lambda n: F.concat_ws(":", n["license"], n["start"].cast("string"), n["end"].cast("string"))), ",").alias("spans"),
    )
