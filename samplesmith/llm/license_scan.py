"""License scan: winnowed fingerprints pick candidates, banded alignment measures them.

Texts and templates are folded to lower-case letters and digits with single
spaces.  The winnowed fingerprints of the templates form an inverted index that
is as large as the template list; a document's own fingerprints are looked up in
it, hits on the same diagonal make a candidate, and a banded alignment of words
around that diagonal gives the share of the template found and its span.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from samplesmith.llm.common import id_and_bytes
from samplesmith.llm.winnow import gram_hashes, minimizers

# Short public notices, openings and whole texts of short public licenses, headers of the long ones.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
           "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
           "the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at "
                  "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation, either version 3 of the License, "
               "or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
               "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE "
        "AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS "
        "IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES "
        "OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
        "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
        "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
        "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE."),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain "
        "the above copyright notice, this list of conditions and the following disclaimer. 2. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO "
        "EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
        "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
        "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF "
        "THE POSSIBILITY OF SUCH DAMAGE."),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice "
        "appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES "
        "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
        "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES "
        "WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN "
        "NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES "
        "OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software. Permission is "
        "granted to anyone to use this software for any purpose, including commercial applications, and "
        "to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of "
        "this software must not be misrepresented; you must not claim that you wrote the original "
        "software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. 3. This notice may not be "
        "removed or altered from any source distribution."),
    "Unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In "
        "jurisdictions that recognize copyright laws, the author or authors of this software dedicate any "
        "and all copyright interest in the software to the public domain. We make this dedication for the "
        "benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights "
        "to this software under copyright law."),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
        "in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License."),
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation; either version 2 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation; either version "
        "2.1 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License "
        "for more details."),
    "LGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Lesser General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License "
        "for more details."),
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU Affero General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope "
        "that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License "
        "for more details."),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse "
        "Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
}
GRAM, WINDOW = 12, 6  # every shared stretch of GRAM + WINDOW - 1 folded characters shares a fingerprint
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)], np.uint8)
WORD = re.compile(rb"[a-z0-9]+")


def folded(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters with single spaces, and the place of each in the text."""
    a = FOLD[np.frombuffer(text, np.uint8)]
    keep = np.flatnonzero((a != 32) | np.r_[True, a[:-1] != 32])
    return a[keep], keep


def fingerprints(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed (hash, place); a text too short for a window gives all its hashes."""
    h = gram_hashes(a, GRAM)
    if len(h) < WINDOW:
        return h, np.arange(len(h))
    place = np.unique(np.concatenate([p for _, _, p in minimizers(h, WINDOW)]))
    return h[place], place


class Index:
    """Inverted index of the templates' fingerprints: hash -> (template, place)."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        self.words, self.starts, posts = [], [], []
        for t, name in enumerate(self.names):
            a, _ = folded(b" " + templates[name].encode())
            found = [(m.group(), m.start()) for m in WORD.finditer(a.tobytes())]
            self.words.append([w for w, _ in found])
            self.starts.append(np.array([at for _, at in found]))
            h, place = fingerprints(a)
            posts += [(int(x), t, int(p)) for x, p in zip(h, place)]
        posts.sort()
        self.hash = np.array([p[0] for p in posts], np.uint64)
        self.post = [(t, p) for _, t, p in posts]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.hash >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, h: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, place in template, place in text) of every shared fingerprint."""
        may = np.flatnonzero(self.sieve[(h >> np.uint64(48)).astype(np.int64)])
        lo, hi = np.searchsorted(self.hash, h[may], "left"), np.searchsorted(self.hash, h[may], "right")
        return [(*self.post[j], int(place[may[i]])) for i in np.flatnonzero(hi > lo) for j in range(lo[i], hi[i])]


def align(template: list[bytes], words: list[bytes], shift: int, band: int) -> tuple[int, int, int]:
    """Banded longest common subsequence: (matched words, first, last matched word of ``words``).

    Template word i may match words ``i + shift - band`` to ``i + shift + band``.
    """
    empty = (0, -1, -1)
    row: dict[int, tuple[int, int, int]] = {}
    for i, w in enumerate(template):
        new: dict[int, tuple[int, int, int]] = {}
        left = empty
        for j in range(max(0, i + shift - band), min(len(words), i + shift + band + 1)):
            best = max(left, row.get(j, empty), key=lambda x: x[0])
            if words[j] == w:
                n, first, _ = row.get(j - 1, empty)
                if n + 1 > best[0]:
                    best = (n + 1, j if first < 0 else first, j)
            new[j] = left = best
        row = {**{min(new, default=0) - 1: row.get(min(new, default=0) - 1, empty)}, **new}
    return max(row.values(), key=lambda x: x[0], default=empty)


def scan_text(text: bytes, index: Index, coverage: float, band: int) -> list[tuple[str, float, int, int, int]]:
    """(template, coverage, matched words, start, end) with byte offsets, best first kept where spans overlap."""
    if not text:
        return []
    a, at = folded(b" " + text)
    hits = index.hits(*fingerprints(a))
    if not hits:
        return []
    found = [(m.group(), m.start()) for m in WORD.finditer(a.tobytes())]
    starts = np.array([s for _, s in found])
    seen, out = set(), []
    for t, p, q in sorted(hits):
        words = index.words[t]
        i = int(np.searchsorted(index.starts[t], p, "right")) - 1
        j = int(np.searchsorted(starts, q, "right")) - 1
        step = min(band, max(1, len(words) // 4))
        if (t, (j - i) // step) in seen:
            continue  # neighbouring diagonals lie in the same band
        seen |= {(t, (j - i) // step)}
        n = first = last = 0
        for wide in dict.fromkeys((step, band)):  # in a band wider than a short template its next copy may win
            if n < len(words):
                low = max(0, j - i - 2 * wide)
                near = found[low:j - i + len(words) + 2 * wide + 1]
                m, *span = align(words, [w for w, _ in near], j - i - low, 2 * wide)
                if m > n:
                    n, (first, last), part = m, span, near
        if n and n / len(words) >= coverage:
            end_word, end_at = part[last]
            out.append((n / len(words), n, index.names[t], int(at[part[first][1]]) - 1, int(at[end_at + len(end_word) - 1])))
    kept: list[tuple[int, int, str, float, int]] = []  # disjoint spans in order
    for c, n, name, start, end in sorted(out, key=lambda x: (-x[1], -x[0], x[2], x[3])):
        k = bisect.bisect_left(kept, (start,))
        if (k == len(kept) or end <= kept[k][0]) and (k == 0 or kept[k - 1][1] <= start):
            kept.insert(k, (start, end, name, c, n))
    return [(name, c, n, start, end) for start, end, name, c, n in kept]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.75, band: int = 6) -> DataFrame:
    """``(doc_id, license, coverage, n_words, start, end)``: a row per template found in a text.

    ``coverage`` is the share of the template's words that the alignment matches;
    ``start`` and ``end`` are code point offsets of the matched span.  Overlapping
    finds keep the one with more words.  Null and empty texts, and texts without
    a template, give no row; repeated rows give repeated finds; an empty table
    gives none; other columns are never read.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen)
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                finds = scan_text(text, index, coverage, band)
                if finds:  # code points before each byte
                    at = np.r_[0, np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)]
                    rows += [(doc, name, c, n, int(at[start]), int(at[end])) for name, c, n, start, end in finds]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, kinds)],
                                             ["doc_id", "license", "coverage", "n_words", "start", "end"])
    return id_and_bytes(docs).mapInArrow(run, "doc_id long, license string, coverage double, n_words int, start long, end long")
