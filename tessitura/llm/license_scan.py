"""Licence scans: Dice coefficient over word bigrams against templates.

The lines, the paragraphs and the whole of each text are normalised and
compared with each licence template whose size allows the wanted similarity:
``dice >= t`` needs sizes within a factor of ``(2 - t) / t``. So that notices
inside longer lines, or wrapped in comments, are found too, every run of as many
words as a template has is compared with that template: distinct and shared
bigrams of all runs follow from running sums, in one pass over a text for each
template of which the text has enough bigrams.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, raw_texts, window_hashes

THRESHOLD = 0.8
EDGES = b".,;:!?\"'()[]{}<>*#-_/\\|&%$"

# Texts of short licences. Longer ones are known by their notices.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_ISC = f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_NO_WARRANTY}"
_ZERO_BSD = f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_NO_WARRANTY}"
_BSD_OPENS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_ENDS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."
)

# Notices of common licences, and the texts above.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-3-clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/."),
    ("mit", _MIT),
    ("isc", _ISC),
    ("0bsd", _ZERO_BSD),
    ("bsd-2-clause", f"{_BSD_OPENS} {_BSD_CLAUSES} {_BSD_ENDS}"),
    ("bsd-3-clause", f"{_BSD_OPENS} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_ENDS}"),
    ("zlib", _ZLIB),
    ("unlicense", _UNLICENSE),
    ("bsl-1.0", _BOOST),
    ("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide."),
)


def _fact(word: bytes) -> tuple[int, int]:
    bare = word.lower().strip(EDGES)
    return int(bool(bare)), xxhash.xxh3_64_intdigest(bare) if bare else 0


def pairs_of(words: list[bytes], known: WordTable) -> np.ndarray:
    """Hashes of the word pairs of normalised words, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    facts = known.of(words)
    return window_hashes(facts[facts[:, 0] == 1, 1], 2)


def bigrams(words: list[bytes], known: WordTable) -> np.ndarray:
    """Distinct hashes of the word pairs of normalised words, sorted."""
    return np.unique(pairs_of(words, known))


def distinct_in_runs(earlier: np.ndarray, at: np.ndarray, n: int, length: int) -> np.ndarray:
    """How many of the distinct pairs at places ``at`` each run of ``length``
    of ``n`` pairs holds. A place counts for the runs that hold it, but not the
    place ``earlier`` of the same pair."""
    runs = n - length + 1
    low, high = np.maximum(earlier + 1, at - length + 1), np.minimum(at, runs - 1)
    ok = low <= high
    steps = np.bincount(low[ok], minlength=runs + 1) - np.bincount(high[ok] + 1, minlength=runs + 1)
    return np.cumsum(steps)[:runs]


def segments(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(line number it begins at, text) of lines, paragraphs and the whole, each once."""
    lines = text.split(b"\n")
    for i, line in enumerate(lines):
        yield i, line
    begin = 0
    paragraphs = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not lines[i].strip():
            if i - begin > 1:
                paragraphs += 1
                yield begin, b"\n".join(lines[begin:i])
            begin = i + 1
    if len(lines) > 1 and not (paragraphs == 1 and all(x.strip() for x in lines)):
        yield 0, text


class Templates:
    """Templates by size; :meth:`best` gives the likest one within bounds. Of
    those alike enough, the one that shares most bigrams is the likest, then the
    greater coefficient, then the first name."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float) -> None:
        known = WordTable(_fact, 2)
        found = [(name, pairs_of(text.encode().split(), known)) for name, text in templates]
        self.by_size = sorted(((len(np.unique(b)), name, np.unique(b), len(b)) for name, b in found if len(b)), key=lambda x: x[:2])
        self.sizes = [x[0] for x in self.by_size]
        self.every = np.unique(np.concatenate([x[2] for x in self.by_size])) if self.by_size else np.zeros(0, np.uint64)
        self.member = np.array([np.isin(self.every, x[2]) for x in self.by_size])
        self.threshold, self.reach = threshold, (2 - threshold) / threshold
        #: A likeness takes so many shared bigrams at least.
        self.least = [x[0] * threshold / (2 - threshold) - 1e-9 for x in self.by_size]

    def known(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the pairs that some template has, and which of :attr:`every`."""
        if not len(pairs) or not len(self.every):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.every, pairs), len(self.every) - 1)
        at = np.flatnonzero(self.every[which] == pairs)
        return at, which[at]

    def touched(self, which: np.ndarray) -> bool:
        """Whether there may be enough bigrams for any template."""
        return bool(self.least) and len(which) >= min(self.least)

    def best(self, pairs: np.ndarray) -> tuple[int, float, str] | None:
        """(minus shared bigrams, minus dice, name) for distinct pairs."""
        n = len(pairs)
        low, high = bisect_left(self.sizes, n / self.reach - 1e-9), bisect_right(self.sizes, n * self.reach + 1e-9)
        found = []
        for size, name, of, _ in self.by_size[low:high]:
            shared = len(np.intersect1d(pairs, of, assume_unique=True))
            if 2 * shared >= self.threshold * (n + size):
                found.append((-shared, -2 * shared / (n + size), name))
        return min(found, default=None)

    def best_run(self, pairs: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[int, float, str, int] | None:
        """As :meth:`best`, over all runs of the pairs as long as a template,
        and where the run begins (the first of equals)."""
        found, earlier = [], None
        counts = self.member[:, which].sum(1)
        for k, (size, name, _, length) in enumerate(self.by_size):
            if counts[k] < self.least[k] or len(pairs) < length:
                continue
            if earlier is None:
                order = np.argsort(pairs, kind="stable")
                same = np.flatnonzero(pairs[order[1:]] == pairs[order[:-1]])
                earlier = np.full(len(pairs), -1)
                earlier[order[same + 1]] = order[same]
            mine = at[self.member[k, which]]
            shared = distinct_in_runs(earlier[mine], mine, len(pairs), length)
            # Few runs come near: only those with enough shared bigrams are measured whole.
            if shared.max() < self.least[k]:
                continue
            size_of = distinct_in_runs(earlier, np.arange(len(pairs)), len(pairs), length)
            alike = np.flatnonzero(2 * shared >= self.threshold * (size_of + size))
            if len(alike):
                dice = 2 * shared[alike] / (size_of[alike] + size)
                first = np.lexsort((alike, -dice, -shared[alike]))[0]
                found.append((-int(shared[alike[first]]), -float(dice[first]), name, int(alike[first])))
        return min(found, default=None)


def line_of_pair(text: bytes, pair: int, known: WordTable) -> int:
    """The line of the word that the pair begins with."""
    for line, part in enumerate(text.split(b"\n")):
        words = part.split()
        pair -= int((known.of(words)[:, 0] == 1).sum()) if words else 0
        if pair < 0:
            return line
    return 0


_OUT = "doc_id long, license string, dice double, line int, n_notices long"


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The likest licence of every row of ``docs`` (doc_id, text).

    Returns doc_id, license and dice (null if no segment reaches the
    threshold), line (where the likest segment begins: that with most shared
    bigrams; ties: the greater coefficient, by name, then the first), n_notices
    (lines that reach the threshold). Whole texts are read;
    null and empty texts have no licence. Other columns are ignored; rows may
    repeat.
    """
    shared = docs.sparkSession.sparkContext.broadcast((templates, threshold))  # a short list

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        against, known = Templates(*shared.value), WordTable(_fact, 2)
        for batch in batches:
            rows = []
            for text in raw_texts(batch.column(1)):
                found, notices = [], 0
                pairs = pairs_of(text.split(), known) if text else np.zeros(0, np.uint64)
                at, which = against.known(pairs)
                if against.touched(which):
                    if run := against.best_run(pairs, at, which):
                        found.append((*run[:3], line_of_pair(text, run[3], known)))
                    n_lines = text.count(b"\n") + 1
                    for k, (line, part) in enumerate(segments(text)):
                        pairs = bigrams(part.split(), known)
                        if hit := against.best(pairs) if against.touched(against.known(pairs)[1]) else None:
                            notices += k < n_lines
                            found.append((*hit, line))
                best = min(found, default=None)
                rows.append((best[2], -best[1], best[3], notices) if best else (None, None, None, 0))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            types = [pa.string(), pa.float64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "license", "dice", "line", "n_notices"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)
