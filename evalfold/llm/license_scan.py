"""License scans by a trained paragraph classifier.

A paragraph is a run of lines with words; each of its lines is judged alone as well, so that a notice is found on a line of its own and
over wrapped lines alike. It is a sparse vector of hashed word n-grams (1 to 3 words, present or not). A multinomial
logistic regression over the license families and an unknown class is trained by Spark ML on labelled paragraphs made from
templates: whole paragraphs, pieces of them as wrapping leaves them, embedded ones, and ordinary or merely license-like sentences.
The probability that a paragraph must reach is calibrated on held-out unknown paragraphs, so that at most FALSE_RATE of
them pass; below it the paragraph is unknown. A prediction counts only when the template comparison confirms it: enough of
the paragraph's word pairs, or of a template's, agree.

Scanning is one pass with a model of fixed size. Both tests must pass, so the cheaper one goes first: only paragraphs
that some template could confirm are scored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalfold.llm.arrow import blocks
from evalfold.llm.common import read, small_batches
from evalfold.llm.decontaminate import WORD
from evalfold.llm.words import Words, mix

UNKNOWN = "unknown"
#: Buckets of the hashed n-grams, words of the longest, training paragraphs of a family, share of unknown ones let through.
BUCKETS, LONGEST, SAMPLES, FALSE_RATE = 1 << 14, 3, 160, 0.002
#: Percent of a paragraph's word pairs in one template, or of that template's in the paragraph, that confirm a family; and of a
#: line's words in such pairs that make it part of a notice over several lines.
CONFIRM, PART = 60, 50
BLOCK_BYTES = 2 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)

# Paragraphs and sentences of each family's notices, as published with the licenses.
_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        _AS_IS,
        "Licensed under the simplified two-clause BSD license.",
    ],
    "BSL-1.0": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "Released under the GNU General Public License, version 2.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, see <https://www.gnu.org/licenses/>.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "This source code is licensed under the MIT license found in the LICENSE file in the root directory of this source tree.",
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is Incompatible With Secondary Licenses, as defined by the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Proprietary": [
        "All rights reserved.",
        "Copyright by the authors. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ],
    "Public-Domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "Dedicated to the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "Zlib": [
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
}
_NEAR = [
    "The driver renewed his license at the public office in version two of the form.", "A general public meeting was held and all were free to copy the minutes.", "The software was released under pressure and without restriction of scope.",
    "Copyright law is taught in the second year.", "Apache helicopters flew over the valley in the morning.", "All members reserved their rights to speak.", "The work is under review and the terms will follow.", "Creative people share common ground in their work.",
    "You may use the kitchen except on Sundays.", "Permission was granted to anyone who asked for a copy of the minutes.", "In no event will the fair be held in the rain.", "The above names appear in all copies of the list.", "The library is open to any person with a card.", "MIT is a university in Massachusetts.", "The mozilla was a mascot of the browser.", "Redistribution of wealth was the topic of the debate.",
]
_PLAIN = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man even most made after also did many"
).split()


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every n-gram of each of a run of paragraphs, repeats included: paragraph and bucket."""
    w = Words(data, offsets, WORD)
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(owner)) - np.repeat(w.first[:-1], counts)
    hashes = w.hashes(np.arange(len(owner)))
    owners, keys, h = [], [], np.zeros(len(owner), np.uint64)
    for n in range(1, LONGEST + 1):
        last = np.flatnonzero(place >= n - 1)
        h = mix(h[last - 1] * _STEP + hashes[last]) if n > 1 else hashes  # h holds the n - 1 words up to each word
        owners.append(owner[last])
        keys.append((h & np.uint64(BUCKETS - 1)).astype(np.int64))
        if n < LONGEST:
            full = np.zeros(len(owner), np.uint64)
            full[last] = h
            h = full
    return np.concatenate(owners), np.concatenate(keys)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each of a run of paragraphs: paragraph and bucket, sorted."""
    owner, bucket = ngrams(data, offsets)
    both = np.unique(owner * BUCKETS + bucket)
    return both // BUCKETS, both % BUCKETS


def _run(paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(paragraphs), np.uint8), np.cumsum([0, *map(len, paragraphs)])


def pairs(paragraph: bytes) -> np.ndarray:
    """The distinct hashed pairs of neighbouring words."""
    w = Words(*_run([paragraph]), WORD)
    h = w.hashes(np.arange(len(w.starts)))
    return np.unique(mix(h[:-1] * _STEP + h[1:])) if len(h) > 1 else np.zeros(0, np.uint64)


def labelled_paragraphs(samples: int = SAMPLES, seed: int = 1, templates: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(paragraph, family) rows: `samples` of each family and eight times as many unknown ones, the same at every run."""
    r = random.Random(seed)
    templates = templates or TEMPLATES
    plain = lambda n: " ".join(r.choice(_PLAIN) for _ in range(n))
    out = []
    for family, sentences in sorted(templates.items()):
        for i in range(samples):
            words = sentences[i % len(sentences)].split()
            if i >= len(sentences) and len(words) > 6:
                # A piece of it, as long as a wrapped line at least.
                size = r.randrange(max(6, len(words) // 4), len(words) + 1)
                first = r.randrange(len(words) - size + 1)
                words = words[first : first + size]
            if i >= len(sentences) and r.random() < 0.4:
                around = plain(r.randrange(1, max(5, len(words) // 2))).split()
                words = [*around, *words] if r.random() < 0.5 else [*words, *around]
            out.append((" ".join(words), family))
    for i in range(8 * samples):
        if i % 3 == 0:
            words = r.choice(_NEAR).split()
            a = r.randrange(len(words))
            out.append((" ".join(words[: a + 3]) + " " + plain(r.randrange(2, 12)), UNKNOWN))
        elif i % 3 == 1:
            # Single words of templates among ordinary ones.
            own = [w for w in r.choice(r.choice([*templates.values()])).split() if w.strip(".,:;()").isalpha()] or ["license"]
            out.append((plain(r.randrange(2, 9)) + " " + r.choice(own) + " " + plain(r.randrange(2, 9)), UNKNOWN))
        else:
            out.append((plain(r.randrange(1, 60)), UNKNOWN))
    return out


class Model:
    """Coefficients (buckets by classes), intercepts, class names, the least probability, and the templates' word pairs.

    The pairs are arrays: `known` holds them in order; `known_from` and `known_of` tell which templates hold each.
    """

    def __init__(self, coefficients: np.ndarray, intercepts: np.ndarray, names: list[str], least: float) -> None:
        self.coefficients, self.intercepts, self.names, self.least = coefficients, intercepts, names, least
        own = [(family, pairs(s.encode())) for family, sentences in sorted(TEMPLATES.items()) for s in sentences]
        self.family = np.array([names.index(f) if f in names else -1 for f, _ in own])
        self.sizes = np.array([len(p) for _, p in own])
        every, of = np.concatenate([p for _, p in own]), np.repeat(np.arange(len(own)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.known, self.known_from = np.unique(every[order], return_index=True)
        self.known_of, self.known_from = of[order], np.append(self.known_from, len(of))

    def probabilities(self, owner: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        logits = np.tile(self.intercepts, (n, 1))
        np.add.at(logits, owner, self.coefficients[bucket])
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def where(self, pair: np.ndarray) -> np.ndarray:
        """Of each pair, its number among the known ones, or -1."""
        at = np.minimum(np.searchsorted(self.known, pair), len(self.known) - 1)
        return np.where(self.known[at] == pair, at, -1)

    def confirming(self, unit: np.ndarray, known: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each paragraph and template, whether the template confirms it. unit, known: the paragraphs' distinct known pairs; sizes: all
        their distinct pairs."""
        n = np.diff(self.known_from)[known]
        at = np.repeat(self.known_from[known] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shared = np.bincount(np.repeat(unit, n) * len(self.sizes) + self.known_of[at], minlength=len(sizes) * len(self.sizes)).reshape(len(sizes), -1)
        return (shared > 0) & (shared * 100 >= CONFIRM * np.minimum(sizes[:, None], self.sizes))


def train(spark: SparkSession, paragraphs: list[tuple[str, str]]) -> Model:
    """The classifier of (paragraph, family) rows; every fifth row is held out for calibration."""
    names = [UNKNOWN, *sorted({f for _, f in paragraphs} - {UNKNOWN})]
    owner, bucket = features(*_run([p.encode() for p, _ in paragraphs]))
    bounds = np.searchsorted(owner, np.arange(len(paragraphs) + 1))
    rows = [(float(names.index(f)), Vectors.sparse(BUCKETS, bucket[a:b].tolist(), [1.0] * int(b - a))) for (_, f), a, b in zip(paragraphs, bounds[:-1], bounds[1:])]
    fitted = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40, standardization=False).fit(spark.createDataFrame([x for i, x in enumerate(rows) if i % 5], ["label", "features"]).coalesce(2))
    model = Model(fitted.coefficientMatrix.toArray().T.copy(), np.array(fitted.interceptVector.toArray()), names, 0.0)
    p = model.probabilities(owner, bucket, len(paragraphs))
    held = [1 - p[i, 0] for i in range(0, len(paragraphs), 5) if paragraphs[i][1] == UNKNOWN]
    # The least probability of not being unknown: at least one half.
    model.least = max(0.5, float(np.quantile(held, 1 - FALSE_RATE, method="higher"))) if held else 0.5
    return model


@cache
def standard_model(spark: SparkSession) -> Model:
    """The classifier of the templates above, trained once in a session."""
    return train(spark, labelled_paragraphs())


_FOUND = pa.list_(pa.struct([("family", pa.string()), ("line", pa.int64()), ("last_line", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))


def _units(n_words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """First and last line of each paragraph, then of each line of paragraphs of several lines; and the number of paragraphs."""
    full = n_words > 0
    joined = full[1:] & full[:-1] & (text_of[1:] == text_of[:-1])
    first = np.flatnonzero(full & ~np.append(False, joined))
    last = np.flatnonzero(full & ~np.append(joined, False))
    single = np.flatnonzero(full & (np.append(False, joined) | np.append(joined, False)))
    return np.concatenate([first, single]), np.concatenate([last, single]), len(first)


def _scan(model: Model, data: np.ndarray, bounds: np.ndarray, text_of: np.ndarray) -> tuple[list[tuple[int, int, str, float]], np.ndarray]:
    """The notices (first line, last line, family, probability) among a run of lines, and the first lines of all paragraphs.

    bounds: where each line starts in `data`, and the end; text_of: the text that each line belongs to.
    """
    w = Words(data, bounds, WORD)
    first, last, n_paragraphs = _units(np.diff(w.first), text_of)
    paragraphs = first[:n_paragraphs]
    h = w.hashes(np.arange(len(w.starts)))
    pair = mix(h[:-1] * _STEP + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    known = model.where(pair)
    hits = np.append(0, np.cumsum(known >= 0))
    # Pairs a..b-1 lie inside a unit of the words a..b.
    a, b = w.first[first], w.first[last + 1] - 1
    # A unit of two distinct pairs or more must have two in common with a template of as many.
    least = 2 if CONFIRM * min(2, int(model.sizes.min())) > 100 else 1
    some = np.flatnonzero(hits[np.maximum(b, a)] - hits[a] >= np.minimum(least, np.maximum(b - a, 1)))
    if not len(some):
        return [], paragraphs
    n = (b - a)[some]
    at = np.repeat(a[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    unit = np.repeat(np.arange(len(some)), n)
    order = np.lexsort((pair[at], unit))
    unit, own = unit[order], pair[at][order]
    new = np.append(True, (unit[1:] != unit[:-1]) | (own[1:] != own[:-1])) if len(own) else np.zeros(0, bool)
    unit, number = unit[new], known[at][order][new]
    confirmed = model.confirming(unit[number >= 0], number[number >= 0], np.bincount(unit, minlength=len(some)))
    some, confirmed = some[confirmed.any(axis=1)], confirmed[confirmed.any(axis=1)]
    if not len(some):
        return [], paragraphs
    p = model.probabilities(*features(*_run([data[bounds[i] : bounds[j + 1]].tobytes() for i, j in zip(first[some].tolist(), last[some].tolist())])), len(some))
    found = []
    for row in np.flatnonzero((1 - p[:, 0] >= model.least) & (p[:, 1:].max(axis=1) > p[:, 0])):
        family = 1 + int(p[row, 1:].argmax())
        agree = confirmed[row] & (model.family == family)
        if agree.any():
            lines = (int(first[some[row]]), int(last[some[row]]))
            if lines[0] < lines[1]:
                lines = _notice(model, w, known, np.flatnonzero(agree), *lines)
            found.append((*lines, model.names[family], float(p[row].max())))
    return _merged(found), paragraphs


def _notice(model: Model, w: Words, known: np.ndarray, templates: np.ndarray, first: int, last: int) -> tuple[int, int]:
    """The lines of a paragraph from the first to the last that the confirming templates hold PART percent of the words of."""
    a, b = int(w.first[first]), int(w.first[last + 1])
    held = np.array([k >= 0 and bool(np.isin(model.known_of[model.known_from[k] : model.known_from[k + 1]], templates).any()) for k in known[a : b - 1].tolist()], dtype=bool)
    inside = np.append(held, False) | np.append(False, held)
    lines = np.repeat(np.arange(first, last + 1), np.diff(w.first[first : last + 2]))
    share = np.bincount(lines - first, weights=inside) * 100 >= PART * np.bincount(lines - first)
    own = np.flatnonzero(share)
    return (first + int(own[0]), first + int(own[-1])) if len(own) else (first, last)


def _merged(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Notices of one family that overlap as one, with the highest probability."""
    out: list[tuple[int, int, str, float]] = []
    for f in sorted(found, key=lambda f: (f[2], f[0], f[1])):
        if out and out[-1][2] == f[2] and f[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], f[1]), f[2], max(out[-1][3], f[3]))
        else:
            out.append(f)
    return sorted(out)


def find_licenses(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with n_paragraphs and licenses: (family, line, last_line, start, end, probability), code points, end exclusive, by line.

    A paragraph is a maximal run of lines with words. A null or empty text has none and no license. Existing columns of
    the two names are replaced.
    """
    docs = small_batches(docs).drop("n_paragraphs", "licenses")
    names = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in blocks(batch.column("text"), BLOCK_BYTES):
                n = len(offsets) - 1
                breaks = np.flatnonzero(data == 10) + 1
                # A text that begins where another's line feed ends gives that bound twice; one line is then empty.
                bounds = np.sort(np.concatenate([offsets, breaks]))
                text_of = np.minimum(np.searchsorted(offsets, bounds[:-1], side="right") - 1, n - 1)
                notices, paragraphs = _scan(sent.value, data, bounds, text_of)
                before = np.append(0, np.cumsum((data & 0xC0) != 0x80))  # code points before each byte
                found: list[list[dict]] = [[] for _ in range(n)]
                for first, last, family, p in notices:
                    i = int(text_of[first])
                    top = int(np.searchsorted(bounds[:-1], offsets[i], side="right")) - 1  # the text's first line
                    end = int(bounds[last + 1]) - (1 if data[bounds[last + 1] - 1] == 10 else 0)
                    found[i].append({"family": family, "line": first - top, "last_line": last - top, "start": int(before[bounds[first]] - before[offsets[i]]), "end": int(before[end] - before[offsets[i]]), "probability": p})
                own = batch.slice(at, n)
                counts = np.bincount(text_of[paragraphs], minlength=n) if len(paragraphs) else np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(counts, pa.int64()), pa.array(found, _FOUND)], names=[*names, "n_paragraphs", "licenses"])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_paragraphs long, licenses array<struct<family:string,line:long,last_line:long,start:long,end:long,probability:double>>"]))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_paragraphs, n_licenses, families (sorted, comma-joined), spans (family:line:last_line:start:end)."""
    found = find_licenses(read(spark, sf_dir, "documents").select("doc_id", "text"), standard_model(spark))
    spans = F.transform("licenses", lambda x: F.concat_ws(":", x["family"], *(x[c].cast("string") for c in ("line", "last_line", "start", "end"))))
    return found.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct("licenses.family")), ",").alias("families"), F.array_join(spans, ",").alias("spans"))
