"""License scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are normalised to lower-case words of letters and digits. What is compared with a template is
each run of words that begins and ends with one of the template's bigrams, whatever the lines. Dice is
2 |A and B| / (|A| + |B|) over multisets of bigrams, so a template of `n` bigrams can reach the threshold t only
with runs of t / (2 - t) * n to (2 - t) / t * n bigrams, t / (2 - t) * n of them the template's: a template is pruned
where no run of such a size holds that many, and only the others' runs are counted. Nothing is shuffled.

A stretch of text counts for one template alone. Runs are taken in the order of the bigrams that they share with their
template, so that a whole text goes before a notice that it begins with, and GPL, LGPL and AGPL don't all claim one
notice; a run that meets one taken before is cut down to what is left before it, if that reaches the threshold. Where a run
and its template both name versions, the same ones are asked for: "version 3" is no GPL-2.0.

One row for each document and licence: its best run (ties: the first, then the shortest). A null or empty text
holds none. Null and repeated ids are kept, each row scanned. Extra columns are ignored; an empty table gives
an empty table. A text of any length is scanned whole; memory grows with the words of one text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

THRESHOLD = 0.8

# Wordings of licence notices, as their publishers give them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
]

WORD = re.compile(r"[^\W_]+")
#: The templates by size.
ORDER = sorted(TEMPLATES, key=lambda x: (len(WORD.findall(x[1])), x))
# Words that a licence's version number follows.
VERSIONED = set("version v by sa nc nd attribution sharealike noncommercial noderivatives gpl lgpl agpl mpl apache".split())


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:], strict=False))


@cache
def wanted(k: int) -> set[str]:
    """The versions that a template names."""
    return versions(words_of(ORDER[k][1]))


@cache
def templates() -> tuple[list[tuple[int, str, Counter]], dict[tuple[str, str], tuple[int, ...]]]:
    """(bigrams, licence, their counts) by size, and for each bigram the places of the templates that hold it."""
    own = [(len(b := bigrams(words_of(t))), name, Counter(b)) for name, t in ORDER]
    holders: dict[tuple[str, str], list[int]] = {}
    for k, (_, _, counts) in enumerate(own):
        for b in counts:
            holders.setdefault(b, []).append(k)
    return own, {b: tuple(ks) for b, ks in holders.items()}


def versions(words: list[str], end: int | None = None) -> set[str]:
    """The version numbers in a list of words: those behind a word (of the first `end` ones) that a version follows, without
    final zeros."""
    out = set()
    for i, w in enumerate(words[:end]):
        if w in VERSIONED or w in ("v2", "v3"):
            own = [w[1:]] if w not in VERSIONED else []
            for x in words[i + 1 : i + 3]:
                if not x.isdigit():
                    break
                own.append(x)
            while len(own) > 1 and own[-1] == "0":
                own.pop()
            if own:
                out.add(".".join(own))
    return out


def run_from(i: int, at: list[int], grams: list[tuple[str, str]], n: int, want: Counter, threshold: float, stop: int) -> tuple[float, int, int, int] | None:
    """(Dice, bigrams shared, first word, words) of a template's best run that begins with its i-th bigram in the text and
    ends before the word `stop`. at: places of its bigrams (`grams`) in the text."""
    most = (2 - threshold) / threshold * n + 1e-9
    need = max(1, ceil(threshold / (2 - threshold) * n - 1e-9))
    if i + need > len(at) or at[i + need - 1] - at[i] + 1 > most:  # pruned: no run from here holds enough
        return None
    have: Counter = Counter()
    shared, best = 0, None
    for j in range(i, len(at)):
        size = at[j] - at[i] + 1
        if size > most or at[j] + 1 >= stop:
            break
        have[grams[j]] += 1
        shared += have[grams[j]] <= want[grams[j]]
        dice = 2 * shared / (size + n)
        if dice >= threshold and (best is None or dice > best[0]):
            best = (dice, shared, at[i], size + 1)
    return best


def scan(text: str, threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """(licence, Dice, first line, last line) of each licence's best run of words."""
    own, holders = templates()
    words = words_of(text)
    hits: dict[int, list[int]] = {}
    for i, b in enumerate(zip(words, words[1:], strict=False)):
        for k in holders.get(b, ()):
            hits.setdefault(k, []).append(i)
    grams = {k: [(words[i], words[i + 1]) for i in at] for k, at in hits.items()}
    queue: list[tuple] = []

    def offer(k: int, i: int, stop: int) -> None:
        n, name, want = own[k]
        run = run_from(i, hits[k], grams[k], n, want, threshold, stop)
        if run:
            heappush(queue, (-run[1], -run[0], run[2], run[3], name, k, i))

    for k, at in hits.items():
        for i in range(len(at)):
            offer(k, i, len(words) + 1)
    firsts: list[int] = []  # of the runs taken, in order, and the word behind each
    lasts: list[int] = []
    best: dict[str, tuple[float, int, int]] = {}
    while queue:
        _, dice, lo, size, name, k, i = heappop(queue)
        place = bisect_right(firsts, lo)
        if place and lasts[place - 1] > lo:
            continue
        if place < len(firsts) and firsts[place] < lo + size:
            offer(k, i, firsts[place])
            continue
        said = versions(words[lo : lo + size + 2], size)  # a number may stand right behind the run
        if said and wanted(k) and said != wanted(k):
            continue
        firsts.insert(place, lo)
        lasts.insert(place, lo + size)
        if name not in best or (dice, lo, size) < best[name]:
            best[name] = (dice, lo, size)
    if not best:
        return []
    ends: list[int] = []  # words up to the end of each line
    for line in text.split("\n"):
        ends.append((ends[-1] if ends else 0) + len(words_of(line)))
    return [(name, -x, bisect_right(ends, lo), bisect_right(ends, lo + size - 1)) for name, (x, lo, size) in sorted(best.items())]


def found(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, first_line, last_line."""
    source = docs.select("doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *x) for i, text in enumerate(batch.column(1)) for x in scan(text.as_py() or "", threshold)]
            at, name, dice, first, last = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(name, pa.string()), pa.array([round(x, 6) for x in dice], pa.float64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                names=["doc_id", "license", "dice", "first_line", "last_line"],
            )

    return source.mapInArrow(run, f"doc_id {kind}, license string, dice double, first_line long, last_line long")
