"""License notices by conditional compression.

A block is a run of lines around a line with a hint word; neighbouring lines join it while
most of their words belong to the templates' vocabulary. Each block is compressed by
zstandard without a dictionary and with every template as a raw dictionary. What a notice
saves is a small share of a long block, so a block is compressed as a whole and in spans of
bounded size around each of its hints, a short and a long one. Templates are
ranked by the size they save, and down the ranking those are confirmed whose wording the
block really has: one of the template's phrases, word by word, with few words missing,
none of them a word that tells licenses apart, and no such word put in between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgauge.llm import kernels as K

HINT = re.compile(r"licen[sc]|copyright|spdx|permission is hereby|all rights reserved|public domain|redistribut|creative commons", re.IGNORECASE)
_WORD = re.compile(r"\w+(?:\.\d+)*")
#: How much of the block's compressed size a template must save to be looked at, and the share of a phrase's words that may be missing.
LEAST_SAVED, MISSING = 0.05, 0.12
#: Characters on both sides of a hint in its spans (more than any template has), and how far hints share spans.
REACHES, SHARED = (160, 640), 40

# Notices and references of well-known licenses, as their owners publish them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0",
        "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "MPL-2.0": (
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0.",),
}
TELLING = frozenset("mit apache gnu general lesser affero library mozilla bsd isc cc0 cc by sa nc nd attribution sharealike noncommercial noderivatives 2 3 4 1 2.0 3.0 4.0 1.0 gpl agpl lgpl mpl v3.0 v2.0 clause not".split())


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(1)
def _compressors() -> tuple[zstandard.ZstdCompressor, dict[str, zstandard.ZstdCompressor]]:
    make = lambda phrases: zstandard.ZstdCompressionDict("\n".join(phrases).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    plain = zstandard.ZstdCompressor(level=6, write_content_size=False, write_checksum=False)
    return plain, {name: zstandard.ZstdCompressor(level=6, dict_data=make(p), write_content_size=False, write_checksum=False, write_dict_id=False) for name, p in TEMPLATES.items()}


@lru_cache(1)
def _vocabulary() -> frozenset[str]:
    return frozenset(w for p in TEMPLATES.values() for t in p for w in words(t))


def blocks(text: str) -> list[str]:
    """Runs of lines around hints, as they stand in the text."""
    if not HINT.search(text):
        return []
    lines = text.split("\n")
    near = {}

    def legal(i: int) -> bool:
        if i not in near:
            own = words(lines[i])
            near[i] = len(own) >= 2 and 10 * sum(w in _vocabulary() for w in own) >= 7 * len(own)
        return near[i]

    out, reach = [], 0
    for i, line in enumerate(lines):
        if i < reach or not HINT.search(line):
            continue
        a = b = i
        while a > reach and legal(a - 1):
            a -= 1
        while b + 1 < len(lines) and (HINT.search(lines[b + 1]) or legal(b + 1)):
            b += 1
        out.append("\n".join(lines[a : b + 1]))
        reach = b + 1
    return out


def saved(block: str) -> list[tuple[float, str]]:
    """(share of the compressed size that the template saves, template), best first."""
    plain, own = _compressors()
    data = block.encode()
    size = len(plain.compress(data))
    return sorted(((1 - len(c.compress(data)) / size, name) for name, c in own.items()), key=lambda x: (-x[0], x[1]))


def wording(block: list[str], phrase: list[str]) -> bool:
    """Whether the phrase stands in the block but for a few words that do not tell licenses apart."""
    match = SequenceMatcher(None, phrase, block, autojunk=False)
    parts = [m for m in match.get_matching_blocks() if m.size]
    kept = sum(m.size for m in parts)
    if len(phrase) - kept > MISSING * len(phrase):
        return False
    there = {k for m in parts for k in range(m.a, m.a + m.size)}
    if any(phrase[k] in TELLING for k in range(len(phrase)) if k not in there):
        return False
    inside = [block[k] for x, y in zip(parts, parts[1:], strict=False) for k in range(x.b + x.size, y.b)]
    return len(inside) <= max(2, MISSING * len(phrase)) and not any(w in TELLING for w in inside)


def spans(block: str) -> list[str]:
    """The block and, where it is longer, its spans around hints."""
    out, reach = {block: None}, -1
    for m in HINT.finditer(block):
        if m.end() <= reach:
            continue
        reach = m.end() + SHARED
        for near in REACHES:
            a, b = max(0, m.start() - near), min(len(block), reach + near)
            while a and a < m.start() and not block[a - 1].isspace():
                a += 1
            while b < len(block) and b > m.end() and not block[b].isspace():
                b -= 1
            out[block[a:b]] = None
    return list(out)


def licenses(block: str) -> list[tuple[str, float]]:
    """(license, largest share saved) of the templates confirmed in the block or a span of it, best first."""
    out: dict[str, float] = {}
    for span in spans(block):
        own = words(span)
        for share, name in saved(span):
            if share < LEAST_SAVED:
                break
            if share > out.get(name, 0) and any(wording(own, words(phrase)) for phrase in TEMPLATES[name]):
                out[name] = share
    return sorted(((name, round(share, 4)) for name, share in out.items()), key=lambda x: (-x[1], x[0]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_blocks, licenses (sorted names) and best_saved.

    ``n_blocks`` counts blocks with a hint, ``best_saved`` is the largest share saved among
    confirmed templates (null without any). Null and empty texts have no blocks; repeated
    rows are scanned each; a null id stays null; other columns are ignored.
    """
    kind = pa.schema([("doc_id", pa.int64()), ("n_blocks", pa.int64()), ("licenses", pa.list_(pa.string())), ("best_saved", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, best = [], [], []
            for text in batch.column(1):
                found = blocks(text.as_py() or "")
                won = [x for b in found for x in licenses(b)]
                n.append(len(found))
                names.append(sorted({x for x, _ in won}))
                best.append(max((s for _, s in won), default=None))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(names, kind.field(2).type), pa.array(best, pa.float64())], schema=kind)

    return K.arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_blocks long, licenses array<string>, best_saved double")
