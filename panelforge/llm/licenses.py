"""License scans: texts and their passages compared to templates by Dice over word bigrams.

A passage is a run of neighbouring lines as long as a template.  Bounds on the size prune: Dice of
sets of a and b bigrams is at most 2 * min(a, b) / (a + b), and passages only begin at lines that hold a
bigram of a template and end before they outgrow all of them.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_TABLE, small_batches

THRESHOLD = 0.8

# Wording of common licence notices, by SPDX name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "BSD-2-Clause-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS "
        "OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, "
        "OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "ISC-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
        "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "Zlib-full": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of "
        "this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, "
        "subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use "
        "this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked "
        "as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
    ),
    "Unlicense-full": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, "
        "the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the "
        "public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future "
        "rights to this software under copyright law."
    ),
}


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    """Distinct pairs of neighbouring words; a single word pairs with nothing."""
    return set(zip(words, words[1:], strict=False)) if len(words) > 1 else {(w, b"") for w in words}


def dice(a: set, b: set) -> float:
    return 2.0 * len(a & b) / (len(a) + len(b)) if a or b else 0.0


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        self.threshold = threshold
        words = {name: text.encode().translate(WORD_TABLE).split() for name, text in templates.items()}
        self.sets = {name: bigrams(w) for name, w in sorted(words.items())}
        self.sizes = {name: len(s) for name, s in self.sets.items()}
        self.most = {name: int((2 - threshold) * n / threshold + 1e-9) for name, n in self.sizes.items()}
        self.of: dict[tuple[bytes, bytes], list[str]] = {}
        for name, own in self.sets.items():
            for pair in own:
                self.of.setdefault(pair, []).append(name)
        self.first = frozenset(a for a, _ in self.of)
        self.single = {a: names for (a, b), names in self.of.items() if not b}

    def may(self, n: int, size: int) -> bool:
        """Whether sets of these sizes can reach the threshold."""
        return 2 * min(n, size) >= self.threshold * (n + size) - 1e-9

    def scan(self, raw: bytes) -> list[tuple[str, int, int, float]]:
        """Best passages (template, first line, last line, score): lines joined until the template's size is passed.

        Of passages of one template that overlap the best stays, of equal ones the shortest, then the
        first.  A passage is not drawn on once all bigrams that begin in its first line occur in it
        again: without that line it has the same ones.  So few passages pass over any line, and the
        work is in proportion to the text.
        """
        lines = [x.split() for x in raw.translate(_KEEP_LINES).split(b"\n")]
        words = [w for line in lines for w in line]
        first, of = self.first, self.of
        known = [p for p, w in enumerate(words) if w in first and (p + 1 < len(words) and (w, words[p + 1]) in of or w in self.single)]
        if not known:
            return []
        pairs = list(zip(words, words[1:], strict=False))
        again, seen = [0] * len(pairs), {}
        for p in range(len(pairs) - 1, -1, -1):
            again[p] = seen.get(pairs[p], len(words))
            seen[pairs[p]] = p
        begins = [0]
        for line in lines:
            begins.append(begins[-1] + len(line))
        found: dict[str, list[tuple[float, int, int]]] = {}
        for i in dict.fromkeys(bisect.bisect_right(begins, p) - 1 for p in known):
            able = {name for p in range(begins[i], min(begins[i + 1], len(pairs))) for name in of.get(pairs[p], ())}
            if len(lines[i]) == 1:
                for name in self.single.get(lines[i][0], ()):
                    if self.may(1, self.sizes[name]) and (d := 2.0 / (1 + self.sizes[name])) >= self.threshold:
                        found.setdefault(name, []).append((d, i, i))
            until = max((again[p] for p in range(begins[i], min(begins[i + 1], len(pairs)))), default=0)
            own: set[tuple[bytes, bytes]] = set()
            common: Counter = Counter()
            most = max((self.most[name] for name in able), default=0)
            at = begins[i]
            for j in range(i, len(lines)):
                before = len(own)
                while at < begins[j + 1] - 1 and len(own) <= most:
                    if pairs[at] not in own:
                        own.add(pairs[at])
                        common.update(of.get(pairs[at], ()))
                    at += 1
                if len(own) > before:
                    able = {name for name in able if len(own) <= self.most[name]}
                    if not able:
                        break
                    for name in able:
                        if self.may(len(own), self.sizes[name]) and (d := 2.0 * common[name] / (len(own) + self.sizes[name])) >= self.threshold:
                            found.setdefault(name, []).append((d, i, j))
                if begins[j + 1] - 2 >= until and j > i:
                    break
        out = []
        for name, passages in found.items():
            taken: list[tuple[int, int]] = []
            for d, i, j in sorted(passages, key=lambda p: (-p[0], p[2] - p[1], p[1])):
                k = bisect.bisect_left(taken, (i, 0))
                if (k == len(taken) or taken[k][0] > j) and (not k or taken[k - 1][1] < i):
                    taken.insert(k, (i, j))
                    out.append((name, i, j, d))
        return sorted(out, key=lambda m: (m[1], m[0], m[2]))


_KEEP_LINES = bytes(0x0A if b == 0x0A else WORD_TABLE[b] for b in range(256))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and matches (license, first_line, last_line, score) of each row, whole texts scanned.

    Null, empty and wordless texts have no matches; repeated rows each give a row.  ``templates``
    (name to text) are few and go to the executors with the code.
    """
    small_batches(docs.sparkSession)
    matcher = Matcher(TEMPLATES if templates is None else templates, threshold)
    fields = [("license", pa.string()), ("first_line", pa.int64()), ("last_line", pa.int64()), ("score", pa.float64())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip([f[0] for f in fields], m, strict=True)) for m in matcher.scan(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct(fields)))], ["doc_id", "matches"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        scan, f"doc_id {kind}, matches array<struct<license: string, first_line: bigint, last_line: bigint, score: double>>"
    )


def op4_license_dice(docs: DataFrame) -> DataFrame:
    """Licences found in each document, with the best score of each and the lines.

    Null, empty and wordless texts have none (a null best score); repeated rows, also of one doc_id or
    none, each give a row; other columns are not looked at; no rows, no rows.
    """
    found = scan_licenses(docs)
    each = F.transform("matches", lambda m: F.concat_ws(":", m.license, m.first_line.cast("string"), m.last_line.cast("string"), F.format_number(m.score, 4)))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.license))), ",").alias("licenses"),
        F.round(F.array_max(F.transform("matches", lambda m: m.score)), 6).alias("best_score"), F.array_join(each, ",").alias("passages"),
    )
