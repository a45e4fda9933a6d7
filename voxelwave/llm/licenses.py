"""Operator 2: license scans by conditional compression.

A template is a wording and the words that decide for it (a version, a name); the first of them is its anchor. Around each anchor
in a text, as many words as one and a half times the template are looked at on both sides; overlapping ranges form a candidate
block. Each block is compressed alone and with every template as a raw zstandard dictionary; templates are ranked by the bytes
that saves. Winners are confirmed by exact wording around their anchors: the template's words that the text lacks there, in
order, are listed; too many of them, or a missing deciding word, reject the template. Of findings that share most of their
words, the one that saves most stays. SPDX tags are read by the ids of their expression.

A confirmed wording holds all deciding words, so no block without an anchor could be confirmed: tests hold this against all
places of a text and all templates. Texts, lines and blocks of any length are searched whole. ``templates`` may be given, full
license texts too (``read_templates`` makes them from a folder); those here are notices and short licenses.

Cases: null and empty texts have no findings. Equal savings go to the wording with fewer missing words, then to the name, then
to the place. Repeated rows repeat; ids of any type, null ones too, are kept. An empty table gives an empty table. Extra columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from voxelwave.llm.rows import pick
from voxelwave.runtime import ship

#: Common license notices and short licenses, and the words that decide for each, the anchor first.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", ("apache", "2.0")),
    "Apache-2.0-header": ('Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0', ("apache", "2.0", "compliance")),
    "MIT": ("Released under the MIT License.", ("mit",)),
    "MIT-text": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("permission", "granted", "restriction")),
    "MIT-license": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("noninfringement", "sublicense", "restriction"),
    ),
    "ISC-license": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("disclaims", "fee", "tortious"),
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ("redistributions", "retain", "disclaimed"),
    ),
    "BSD-text": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution", "permitted")),
    "ISC-text": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("permission", "fee", "granted")),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "2")),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", ("gnu", "general", "3")),
    "LGPL": ("This work is licensed under the GNU Lesser General Public License", ("gnu", "lesser")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("mozilla", "2.0")),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", ("cc", "by", "4.0")),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", ("by-sa", "4.0")),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", ("by-nc", "4.0")),
    "CC0-1.0": ("To the extent possible under law, the author has dedicated all copyright to the public domain worldwide", ("domain", "public")),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", ("unencumbered", "public")),
    "All-rights-reserved": ("All rights reserved.", ("reserved", "all", "rights")),
}
#: Tags of one line, by id.
SPDX = ("0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later "
        "GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-2.0 Unlicense Zlib").split()  # fmt: skip
TAG = "spdx-license-identifier"
TAGS = {f"{i}-spdx": (f"SPDX-License-Identifier: {i}", (TAG, i.lower())) for i in SPDX}
_TAG = re.compile(TAG + r":[ \t]*(\(*[\w.+-]+\)*(?:[ \t]+(?:and|or|with)[ \t]+\(*[\w.+-]+\)*)*)")
_WORD = re.compile(r"[a-z0-9][a-z0-9.-]*")
#: Least bytes saved, and the share of a template's words that may be missing.
LEAST_SAVED = 4
MISSING = 0.2
#: Blocks of up to so many characters are remembered, so many at once.
MEMO_CHARS, MEMO = 2000, 1 << 12


@dataclass(frozen=True)
class Finding:
    license: str
    start: int
    end: int
    saved: int
    missing: tuple[str, ...]


Templates = dict[str, tuple[str, tuple[str, ...]]]


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)  # keeps places


def word_list(text: str) -> list[str]:
    return [w.rstrip(".-") for w in _WORD.findall(text.lower())]


def _placed(low: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words, and where each starts and ends."""
    found = list(_WORD.finditer(low))
    return [m[0].rstrip(".-") for m in found], [m.span() for m in found]


def _confirm(wording: list[str], deciding: tuple[str, ...], have: list[str], start: int = 0) -> tuple[tuple[str, ...], list[int]] | None:
    """The words that are missing, and the places of those that are there."""
    same = difflib.SequenceMatcher(None, wording, have, autojunk=False).get_matching_blocks()
    used = [start + m.b + i for m in same for i in range(m.size)]
    kept = {m.a + i for m in same for i in range(m.size)}
    missing = tuple(w for i, w in enumerate(wording) if i not in kept)
    return None if len(missing) > MISSING * len(wording) or any(w in missing for w in deciding) else (missing, used)


class Scanner:
    """Templates made ready: compressors with their dictionaries, wordings and anchors."""

    def __init__(self, templates: Templates):
        self.plain = zstandard.ZstdCompressor(level=3)
        self.tools = {}
        for name, (text, deciding) in (templates | TAGS).items():
            d = zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.tools[name] = (zstandard.ZstdCompressor(level=3, dict_data=d), word_list(text), deciding)
        self.by_anchor: dict[str, list[str]] = {}
        for name in templates:
            self.by_anchor.setdefault(self.tools[name][2][0], []).append(name)
        # a word may carry trailing dots and dashes
        edge = r"(?<![a-z0-9.-])(?:%s)[.-]*(?![a-z0-9])"
        self.anchors = re.compile(edge % "|".join(map(re.escape, sorted(self.by_anchor, key=len, reverse=True))))
        self.judge = lru_cache(maxsize=MEMO)(self._judge)

    def reach(self, name: str) -> int:
        return len(self.tools[name][1]) * 3 // 2

    def _judge(self, block: str) -> tuple[tuple[str, int, tuple[str, ...], tuple[int, int], frozenset[int]], ...]:
        """(template, bytes saved, missing words, place, places of words) of a block."""
        low = lowered(block)
        have, spans = _placed(low)
        hits: dict[str, list[int]] = {}
        for i, w in enumerate(have):
            for name in self.by_anchor.get(w, ()):
                hits.setdefault(name, []).append(i)
        near = {}
        for name, at in hits.items():
            _, wording, deciding = self.tools[name]
            r = self.reach(name)
            at = [i for i in at if set(deciding) <= set(have[max(0, i - r) : i + r + 1])]
            if at:
                near[name] = at
        if not near:
            return ()
        raw = block.encode()
        alone = len(self.plain.compress(raw))
        ranked = sorted(((alone - len(self.tools[name][0].compress(raw)), name) for name in near), key=lambda r: (-r[0], r[1]))
        found = []
        for saved, name in ranked:
            if saved < LEAST_SAVED:
                break
            _, wording, deciding = self.tools[name]
            r, used = self.reach(name), set()
            for i in near[name]:
                if i in used:
                    continue
                lo = max(0, i - r)
                seen = _confirm(wording, deciding, have[lo : i + r + 1], lo)
                if seen and not used & set(seen[1]):
                    used.update(seen[1])
                    found.append((name, saved, seen[0], (spans[seen[1][0]][0], spans[seen[1][-1]][1]), frozenset(spans[k][0] for k in seen[1])))
        return tuple(found)

    def blocks(self, low: str) -> list[tuple[int, int]]:
        """Code point ranges around the anchors of a lowered text."""
        anchors = list(self.anchors.finditer(low))
        if not anchors:
            return []
        _, spans = _placed(low)
        starts = {a: i for i, (a, _) in enumerate(spans)}
        out: list[list[int]] = []
        for m in anchors:
            if m.start() not in starts:
                continue
            i = starts[m.start()]
            r = max(map(self.reach, self.by_anchor[m[0].rstrip(".-")]))
            a, z = max(0, i - r), min(len(spans) - 1, i + r)
            while out and a <= out[-1][1]:
                a, z = min(a, out[-1][0]), max(z, out[-1][1])
                out.pop()
            out.append([a, z])
        return [(spans[a][0], spans[z][1]) for a, z in out]

    def tags(self, text: str, low: str) -> list[tuple[str, int, tuple[str, ...], tuple[int, int], frozenset[int]]]:
        out = []
        for m in _TAG.finditer(low):
            line = text[m.start() : m.end()].encode()
            alone = len(self.plain.compress(line))
            for w, (a, z) in zip(*_placed(m[1])):
                for name, (c, _, deciding) in self.tools.items():
                    if name in TAGS and deciding[1] == w:
                        out.append((name, alone - len(c.compress(line)), (), (m.start(1) + a, m.start(1) + z), frozenset()))
        return out

    def findings(self, text: str | None) -> list[Finding]:
        text = text or ""
        low = lowered(text)
        found = self.tags(text, low) if TAG in low else []
        for a, z in self.blocks(low):
            block = text[a:z]
            for name, saved, missing, (p, q), at in (self.judge if z - a <= MEMO_CHARS else self._judge)(block):
                found.append((name, saved, missing, (a + p, a + q), frozenset(a + k for k in at)))
        out, taken = [], set()
        # a template whose words mostly belong to a better one says nothing new
        for name, saved, missing, (a, z), at in sorted(found, key=lambda f: (-f[1], len(f[2]), f[0], f[3])):
            if not at or 2 * len(at - taken) > len(at):
                while z < len(text) and text[z] in CLOSING:
                    z += 1
                out.append(Finding(name, a, z, saved, missing))
                taken |= at
        return sorted(out, key=lambda f: (f.start, -f.saved, f.license))


#: Marks after a finding's last word that belong to it.
CLOSING = ".,;:!?\"')]}"


@lru_cache(maxsize=2)
def _scanner(templates: tuple) -> Scanner:
    return Scanner(dict(templates))


def findings(text: str | None, templates: Templates = TEMPLATES) -> list[Finding]:
    return _scanner(tuple(templates.items())).findings(text)


def read_templates(spark: SparkSession, folder: str, deciding: int = 3) -> Templates:
    """Full license texts of a folder, by file name; their longest words that no other text has (else the longest) decide.

    The texts come to the driver and go with the scan to the executors, so the folder should hold licenses only.
    """
    texts = {r.path.rsplit("/", 1)[-1]: bytes(r.content).decode("utf-8", "replace") for r in spark.read.format("binaryFile").load(folder).select("path", "content").collect()}
    sets = {name: set(word_list(text)) for name, text in texts.items()}
    out = {}
    for name, text in sorted(texts.items()):
        others = set().union(*(s for n, s in sets.items() if n != name))
        own = sorted(sets[name] - others or sets[name], key=lambda w: (-len(w), w))
        if own:
            out[name] = (text, tuple(own[:deciding]))
    return out


def scan(df: DataFrame, templates: Templates = TEMPLATES) -> DataFrame:
    """doc_id, n_licenses, licenses (sorted, comma-joined), findings (license:start:end:saved:missing words, by place)."""
    ship(df.sparkSession)
    given = tuple(templates.items())

    def run(batches):
        scanner = _scanner(given)
        for b in batches:
            n, names, all_ = [], [], []
            for text in b.column(1).to_pylist():
                found = scanner.findings(text)
                kinds = sorted({f.license for f in found})
                n.append(len(kinds))
                names.append(",".join(kinds))
                all_.append(";".join(f"{f.license}:{f.start}:{f.end}:{f.saved}:{' '.join(f.missing)}" for f in found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(all_, pa.string())], ["doc_id", "n_licenses", "licenses", "findings"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return pick(df, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_licenses long, licenses string, findings string")
