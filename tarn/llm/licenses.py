"""Licence scans by conditional compression.

In a window around each word that speaks of licences, wide enough for a
template wherever its lines break, the passage is found that differs from the
template by the fewest words, those that the template has and the passage
lacks, and the reverse, counted exactly. The passage is compressed on its own
and again with the template as a raw zstandard dictionary; what that saves is
held against a least share and tells passages apart that differ as much.
A text may hold several notices; passages of different notices are
disjoint.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a notice must hold to be a candidate; checked in the JVM for whole texts, then by word.
SPEAKS = r"(?i)licen[cs]|copyright|creative commons|\bCC[ -](?:BY|0)|public domain|all rights reserved|lizenz|licencia"

_BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GPL_END = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program"

TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
        + _GPL_END,
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."
        + _GPL_END,
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-3-Clause": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        _BSD_START + _BSD_NAMES + _BSD_END,
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", _BSD_START + _BSD_END),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0 Universal.",),
    "All-Rights-Reserved": ("All rights reserved.",),
}
WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def windows(at: list[int], n: int, size: int) -> Iterator[tuple[int, int]]:
    """(first, last + 1) of overlapping windows over ``size`` words: a passage of up to ``n`` words that
    holds one of the words ``at``, in order, lies wholly in one of them."""
    done = -1
    for i in at:
        if i > done:
            done = i + n
            yield max(0, i - n), min(size, done + n)


def _costs(want: np.ndarray, have: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Fewest words missing and extra between ``want`` and a passage that ends before each word of ``have``;
    ``costs`` are those of an empty ``want``."""
    at = np.arange(len(have) + 1, dtype=np.int32)
    for w in want:
        new = costs + 1
        np.minimum(new[1:], np.where(have == w, costs[:-1], new[1:]), out=new[1:])
        costs = np.minimum.accumulate(new - at) + at
    return costs


def passages(want: np.ndarray, have: np.ndarray, most: float, first: int = 0) -> Iterator[tuple[int, int, int]]:
    """(start, end, words missing and extra) of disjoint passages that differ from ``want`` by at most ``most`` words, best first."""
    costs = _costs(want, have, np.zeros(len(have) + 1, dtype=np.int32))
    hi = int(costs.argmin())
    if costs[hi] > most or hi == 0:
        return
    lo = hi - int(_costs(want[::-1], have[:hi][::-1], np.arange(hi + 1, dtype=np.int32)).argmin())
    yield first + lo, first + hi, int(costs[hi])
    yield from passages(want, have[:lo], most, first)
    yield from passages(want, have[hi:], most, first + hi)


class Scanner:
    """Compressors for each template, made once for a task."""

    def __init__(self, templates: dict[str, tuple[str, ...]], level: int = 9):
        import zstandard

        def compressor(data: str | None):
            d = None if data is None else zstandard.ZstdCompressionDict(data.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

        self.plain = compressor(None)
        self.ids = {}
        self.with_ = []
        for name, ts in templates.items():
            for t in ts:
                want = words(t)
                ids = np.array([self.ids.setdefault(w, len(self.ids)) for w in want], dtype=np.int32)
                self.with_.append((name, ids, frozenset(ids.tolist()), compressor(" ".join(want))))

    def scan(self, text: str, speaks: re.Pattern, least: float, differ: float) -> list[tuple[int, str, float, int, int, bool]]:
        """(line, licence, saved share, words missing, words differing within the passage, exact) of each notice, in order."""
        found = list(WORD.finditer(text))
        starts = [m.start() for m in found]
        have = [m.group().lower() for m in found]
        ids = np.array([self.ids.get(w, -1) for w in have], dtype=np.int32)
        at = sorted({max(0, bisect_right(starts, m.start()) - 1) for m in speaks.finditer(text)})
        here = set(ids.tolist())
        candidates = []
        for name, want, kinds, c in self.with_:
            most = differ * len(want)
            # a word that is nowhere is missing each time that the template has it
            if len(kinds - here) > most:
                continue
            for lo, hi in windows(at, int(len(want) + most) + 1, len(have)):
                if len(kinds - set(ids[lo:hi].tolist())) > most:
                    continue
                for a, b, cost in passages(want, ids[lo:hi], most, lo):
                    raw = " ".join(have[a:b]).encode()
                    saved = 1 - len(c.compress(raw)) / len(self.plain.compress(raw))
                    if saved >= least:
                        kept = (len(want) + b - a - cost) // 2
                        candidates.append(((cost / differ - len(want) if differ else -len(want), cost, -saved, name, a, b), (name, saved, len(want) - kept, b - a - kept, cost == 0)))
        taken: list[tuple[int, int]] = []
        out = []
        for (*_, a, b), notice in sorted(candidates):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((a, (text.count("\n", 0, starts[a]), *notice)))
        return [x for _, x in sorted(out)]


def _scanning(templates: dict, speaks: str, least: float, differ: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, pattern = Scanner(templates), re.compile(speaks)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(doc, *notice) for notice in scanner.scan(text, pattern, least, differ)]
            cols = list(zip(*out)) or [[]] * 7
            types = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "line", "licence", "saved", "words_missing", "words_extra", "exact"]
            )

    return run


def scan_licences(
    docs: DataFrame,
    templates: dict[str, tuple[str, ...]] = TEMPLATES,
    speaks: str = SPEAKS,
    least: float = 0.2,
    differ: float = 0.25,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, line, licence, saved, words_missing, words_extra, exact) of each passage confirmed as a notice.

    ``line`` is the one that the passage begins on, which may be wrapped at
    will. ``saved`` is the share of the passage's compressed size that the
    template saves, at least ``least``; the text around it does not count; words that differ are at most
    ``differ`` of the template's. Of passages that overlap, the one stands
    whose template has most words beyond ``1 / differ`` for each difference;
    then the fewest differences, the greater saving, the name. Texts that do not speak of licences never leave the
    JVM. Null and empty texts have no notices; rows without an id are reported
    with a null id, repeated rows repeatedly; an empty table gives no rows.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where(F.col("text").rlike(speaks))
    schema = "doc_id long, line int, licence string, saved double, words_missing int, words_extra int, exact boolean"
    return rows.mapInArrow(_scanning(templates, speaks, least, differ), schema)
