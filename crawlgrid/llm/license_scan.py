"""License notices found by conditional compression.

A text that holds a cue is searched whole, as one sequence of words. A
candidate block starts at any template word, wherever its line began or ends,
is as long as the template, and has enough of its words (a cheap count of
words, in any order, that leaves out no near wording). Each block is
compressed by zstandard, alone and with the template as raw dictionary; the
templates are ranked by the bytes that this saves, and the winners are
confirmed in this order by the exact wording: the first whose missing and
extra words are within ``TOLERANCE`` of the template's length is the finding.
``size_reduction`` is the share saved on the finding's own words. All is
compressed as lower-case words, so that line breaks and comment marks don't
matter. The search goes on at the word behind a finding; no number of
findings, templates or lines is capped.

One row for each finding. Null and empty texts have none; repeated rows are
searched each by itself.
"""

from __future__ import annotations

import difflib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbuf import returning

# Short notices as their licenses (or their stewards) word them.
TEMPLATES = {
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-4.0-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-terms": "Distributed under the terms of the MIT license.",
    "MIT-warranty": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
# fixed values: identifiers that a line "SPDX-License-Identifier: ..." may name
IDENTIFIERS = ("AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0",
               "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later",
               "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
TEMPLATES.update({f"SPDX-{name}": f"SPDX-License-Identifier: {name}" for name in IDENTIFIERS})
CUE = r"(?i)licen[sc]e|permission|redistribution|copyright|warrant|public\W+domain|SPDX"
LEVEL = 3
TOLERANCE = 0.1
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def word_list(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Scanner:
    def __init__(self, templates: Mapping[str, str]):
        import zstandard as z

        options = dict(level=LEVEL, write_content_size=False, write_dict_id=False)
        self.wording = {k: word_list(t) for k, t in templates.items()}
        self.alone = z.ZstdCompressor(**options)
        self.with_template = {k: z.ZstdCompressor(dict_data=z.ZstdCompressionDict(" ".join(w).encode(), dict_type=z.DICT_TYPE_RAWCONTENT), **options) for k, w in self.wording.items()}
        self.counts = {k: Counter(w) for k, w in self.wording.items()}
        self.room = {k: int(len(w) * (1 + 2 * TOLERANCE)) + 1 for k, w in self.wording.items()}
        self.least = {k: math.ceil(len(w) * (1 - TOLERANCE) - 1e-9) for k, w in self.wording.items()}
        self.number = {w: i for i, w in enumerate(sorted({w for ws in self.wording.values() for w in ws}))}
        self.member = {k: np.array([*(w in c for w in self.number), False]) for k, c in self.counts.items()}
        self.cue = re.compile(CUE)

    def saved(self, words: Sequence[str], name: str) -> tuple[int, int]:
        """(bytes that the template saves, bytes without it) of compressed words."""
        raw = " ".join(words).encode()
        size = len(self.alone.compress(raw))
        return size - len(self.with_template[name].compress(raw)), size

    def reductions(self, window: str) -> list[tuple[float, str]]:
        """Share of the window's compressed size that each template saves, the most first."""
        words = word_list(window)
        shares = [(name, *self.saved(words, name)) for name in self.wording]
        return sorted(((n / size, name) for name, n, size in shares), key=lambda x: (-x[0], -len(self.wording[x[1]]), x[1]))

    def ranked(self, words: list[str], s: int, names: Iterable[str]) -> list[str]:
        """The templates of a block's start by the bytes they save on their block, most first."""
        saved = {name: self.saved(words[s:s + len(self.wording[name])], name)[0] for name in names}
        return sorted((n for n in saved if saved[n] > 0), key=lambda n: (-saved[n], -len(self.wording[n]), n))

    def wording_gap(self, words: list[str], name: str) -> tuple[int, int, int] | None:
        """(missing, extra, end) of the template in the words from their start on."""
        template = self.wording[name]
        blocks = [m for m in difflib.SequenceMatcher(None, template, words[:self.room[name]], autojunk=False).get_matching_blocks() if m.size]
        if not blocks:
            return None
        same, end = sum(m.size for m in blocks), blocks[-1].b + blocks[-1].size
        return len(template) - same, end - blocks[0].b - same, end

    def starts(self, words: list[str]) -> dict[int, list[str]]:
        """Templates that enough words of the block from a place on belong to, by place."""
        n, out = len(words), {}
        number = np.fromiter((self.number.get(w, -1) for w in words), np.int64, n)
        for name, member in self.member.items():
            own = member[number]
            total = np.concatenate(([0], np.cumsum(own)))
            stop = np.minimum(np.arange(n) + self.room[name], n)
            for s in np.flatnonzero(own & (total[stop] - total[:-1] >= self.least[name])).tolist():
                out.setdefault(s, []).append(name)
        return out

    def scan(self, text: str) -> Iterator[tuple[int, int, str, float, int, int]]:
        """(first line, last line, template, reduction, missing, extra) of each finding."""
        if not self.cue.search(text):
            return
        words = word_list(text)
        starts = self.starts(words)
        if not starts:
            return
        breaks = [m.start() for m in re.finditer("\n", text)]
        line = [bisect_left(breaks, m.start()) for m in WORD.finditer(text)]
        free, later = 0, {}
        for s in sorted(starts):
            if s < free:
                continue
            known = later.pop(s, {})  # near wording that an earlier block met here
            for name in self.ranked(words, s, {*starts[s], *known}):
                found, gap = known.get(name), self.wording_gap(words[s:s + self.room[name]], name)
                if gap and gap[0] + gap[1] <= TOLERANCE * len(self.wording[name]):
                    missing, extra, end = gap
                    lead = end - extra - (len(self.wording[name]) - missing)
                    if lead:  # begins at a later start, which is tried by itself
                        later.setdefault(s + lead, {}).setdefault(name, (missing, extra, end - lead))
                    else:
                        found = gap
                if not found:
                    continue
                missing, extra, end = found
                n, size = self.saved(words[s:s + end], name)
                yield line[s], line[s + end - 1], name, n / size, missing, extra
                free = s + end
                break


FOUND = "first_line long, last_line long, license string, size_reduction double, missing_words long, extra_words long"


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row for each finding: ``carry`` columns and FOUND. Texts without a
    cue are left out before Python sees them."""
    df = docs.where(F.col(text_col).rlike(CUE)).select(F.struct(*carry).alias("r"), F.col(text_col).alias("t"))
    extra = T._parse_datatype_string(FOUND)
    schema = T.StructType([df.schema.fields[0], *extra.fields])
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            at, rows = [], []
            for k, text in enumerate(batch.column(1)):
                for found in scanner.scan(text.as_py()):
                    at.append(k)
                    rows.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=schema.names)

    return df.mapInArrow(returning(run), schema).select("r.*", *extra.names)
