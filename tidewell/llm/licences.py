"""Licence scans: passages compared with licence templates by the Dice coefficient of their word bigrams.

Texts are normalised (lower case, ASCII letters and digits). Candidate passages are each line, each paragraph, the whole text, and
windows of words that slide over the whole text: for each template the windows of the best coefficients that don't overlap. A window
can only reach t if it holds one of the template's anchors: as many bigrams as it may lack, and one more. A passage of n bigrams can reach a coefficient t with a template of m bigrams only if n lies between m*t/(2-t) and
m*(2-t)/t; other templates are pruned before anything is compared. Bigrams are counted with their repeats.

Null and empty texts match nothing. Each row is judged by itself, so repeated rows give repeated results; nothing is shuffled
and no part of a text is skipped. Windows that overlap a line, paragraph or text that matches aren't counted again. Of equally good matches the first template by name, then the first passage is told.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame

from tidewell.llm.common import Taken, decoded, documents, slices

LEAST = 0.8
#: Short licences, and the notices and heads of long ones, as their authors word them (fixed values).
TEMPLATES = {
    "AGPL-3.0 (short)": "Licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0 (head)": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "Apache-2.0 (head)": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions.",
    "Apache-2.0 (short)": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause (short)": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0 (short)": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0 (short)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-4.0 (short)": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the CC0 Public Domain Dedication along with this software. If not, see http://creativecommons.org/publicdomain/zero/1.0/.",
    "GPL-2.0 (head)": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0 (head)": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "GPL-3.0 (short)": "Licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 (head)": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "LGPL-3.0 (short)": "Licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT (short)": "Licensed under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
WORDS = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
PARAGRAPH = re.compile(r"\n[\x20\t\r]*\n")


def normal(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    n = a.total() + b.total()
    return 2 * (a & b).total() / n if n else 0.0


class Scanner:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.templates = [(name, own, own.total()) for name, own in ((n, bigrams(normal(t))) for n, t in sorted(templates.items())) if own]
        self.low = min((m * least / (2 - least) for _, _, m in self.templates), default=1)
        self.words = {w for _, own, _ in self.templates for pair in own for w in pair}
        self.anchors: dict[tuple[str, str], list[int]] = {}
        often = Counter(w for _, own, _ in self.templates for w in {w for pair in own for w in pair})
        for k, (_, own, m) in enumerate(self.templates):
            lacks = m - self.least_common(m)
            for pair in sorted(own, key=lambda p: (min(often[w] for w in p), -len(p[0] + p[1]), p)):  # the rarest first
                if lacks < 0:
                    break
                self.anchors.setdefault(pair, []).append(k)
                lacks -= own[pair]
        self.anchor_words = {a for a, _ in self.anchors}

    def least_common(self, m: int) -> int:
        """A window that reaches the coefficient shares so many of the template's m bigrams: t*(n+m)/2, where n is no less."""
        return max(1, int(np.ceil(m * self.least / (2 - self.least) - 1e-9)))

    def windows(self, text: str) -> list[tuple[int, int]]:
        """(first character, end) of the best windows of words, by position, longer ones first; those of a template don't overlap each other."""
        low = text.lower()
        words = WORDS.findall(low)
        if self.anchor_words.isdisjoint(words):
            return []
        pairs = list(zip(words, words[1:], strict=False))
        near = sorted({k for pair in self.anchors.keys() & set(pairs) for k in self.anchors[pair]})
        chosen = {w for k in near for w in self.slide(pairs, *self.templates[k][1:])}
        if not chosen:
            return []
        spans = [m.span() for m in WORDS.finditer(low)]
        at = range(len(text)) if len(low) == len(text) else [k for k, c in enumerate(text) for _ in c.lower()]
        return sorted(((at[spans[a][0]], at[spans[b + 1][1] - 1] + 1) for a, b in chosen), key=lambda w: (w[0], -w[1]))

    def slide(self, pairs: list[tuple[str, str]], own: Counter, m: int) -> list[tuple[int, int]]:
        """(first, last bigram) of the windows that reach the coefficient, the best first, none that overlaps a better one.

        The best windows begin and end with a common bigram. One counts in a window that holds fewer before it than the template has.
        """
        low, most = self.least_common(m), int(m * (2 - self.least) / self.least + 1e-9)
        places = [k for k, pair in enumerate(pairs) if pair in own]
        earlier: dict = {}
        since = []
        for k in places:
            seen = earlier.setdefault(pairs[k], [])
            since.append(seen[-own[pairs[k]]] if len(seen) >= own[pairs[k]] else -1)
            seen.append(k)
        at, before = np.array(places, np.int64), np.array(since, np.int64)
        ends = np.searchsorted(at, at + most)
        found = []
        for s in np.flatnonzero(ends - np.arange(len(at)) >= low).tolist():
            e, first = int(ends[s]), places[s]
            n = at[s:e] - first + 1
            score = 2 * np.cumsum(before[s:e] < first) / (n + m)
            k = int(score.argmax())
            if score[k] >= self.least:
                found.append((-float(score[k]), first, places[s + k]))
        out, taken = [], Taken()
        for _, a, b in sorted(found):
            if not taken.meets(a, b + 2):  # bigrams side by side share a word
                taken.add(a, b + 2)
                out.append((a, b))
        return out

    def passages(self, text: str):
        """(first character, end) of each line, each paragraph of several lines, the whole text, and the best windows of words."""
        seen = set()
        for a, b in self.blocks(text):
            seen.add((a, b))
            yield a, b
        for a, b in self.windows(text):
            if (a, b) not in seen:
                seen.add((a, b))
                yield a, b

    def blocks(self, text: str):
        seen, at = set(), 0
        for line in text.split("\n"):
            seen.add((at, at + len(line)))
            yield at, at + len(line)
            at += len(line) + 1
        start = 0
        for a, b in [(m.start(), m.end()) for m in PARAGRAPH.finditer(text)] + [(len(text), len(text))]:
            if (start, a) not in seen:
                seen.add((start, a))
                yield start, a
            start = b
        if (0, len(text)) not in seen:
            yield 0, len(text)

    def best(self, text: str) -> tuple:
        """(number of passages that match, licence, coefficient, first character, end) of the best match."""
        best, spans = (None, None, None, None), []
        for a, b in self.passages(text):
            words = normal(text[a:b])
            n = len(words) - 1
            if n < self.low - 1e-9:
                continue
            close = [x for x in self.templates if x[2] * self.least <= n * (2 - self.least) + 1e-9 and n * self.least <= x[2] * (2 - self.least) + 1e-9]
            # a coefficient of t needs t*(n+m)/2 common bigrams, so at least as many words of the templates
            if not close or sum(w in self.words for w in words) < self.least * (n + min(x[2] for x in close)) / 2 - 1e-9:
                continue
            own = bigrams(words)
            score, name = max(((dice(own, x[1]), x[0]) for x in close), key=lambda s: s[0])
            if score >= self.least:
                spans.append((a, b))
                if best[1] is None or score > best[1]:
                    best = (name, score, a, b)
        blocks = set(self.blocks(text)) if spans else set()
        counted, taken = 0, Taken()
        for a, b in spans:  # blocks come first
            if (a, b) in blocks or not taken.meets(a, b):
                taken.add(a, b)
                counted += 1
        return counted, *best


def scan(df: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: doc_id, n_matches, licence, dice, first and end (code points) of the best passage; the last four null without a match."""
    kind = df.schema[id_col].dataType.simpleString()
    own = TEMPLATES if templates is None else templates

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(own, least)
        kinds = [pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        for batch in batches:
            for part, texts in slices(batch, 1):
                rows = [scanner.best(decoded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", "n_matches", "licence", "dice", "first", "end"])

    return df.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_matches bigint, licence string, dice double, first bigint, end bigint")


def op4_licence_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
