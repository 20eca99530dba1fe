"""Licences of files: sparse TF-IDF cosine of headers and whole files to templates, then inheritance from directories.

A unit of text is a vector over its words with weights tf * idf, idf from the templates, which are few and fixed; a word of
no template has the largest idf. Units of a file are each of its lines, each block of lines between blank ones (a
header wrapped over lines), and the whole text. A unit's licence is the template of the best cosine, at least ``least``, ties to
the smaller name. A file's own licence is that of its whole text, else of a block, else of a line, the best cosine first, however long the file is; a
licence that only reserves rights (``RESERVED``) counts only if nothing else is found, as such a line stands above other licences too. The
score is the best cosine of a unit with the file's own licence.
A licence file is one whose whole text reaches ``least``, or one with a licence that is called LICENSE, LICENCE, COPYING or UNLICENSE, whatever follows a dot,
hyphen or underscore; there the first block, where a long licence has its title, goes before all other blocks. It speaks for its directory (the
smallest path, if there are several). A file without its own licence takes that of its nearest ancestor directory with one, by an
equi-join of all its ancestors, the longest first, with the licensed directories.

Sums over words are differences of running sums, so a file's lines cost no more than its words. A unit's norm needs its
word counts; it is taken only where the score can reach ``least`` with a norm as if no word came twice, which is
the smallest that the unit can have.

Null path or text: an own licence of null; a null path inherits nothing. Empty table: no rows. Repeated rows: a row each.
Other columns of ``files`` are ignored. Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.store import Scratch
from coffer.llm.textkernel import ALNUM, Words, chunks, utf8

# Names of public licences, each with the notices and texts that stand for it.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004",
        "Apache License 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
        "the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "BSD-3-Clause": [
        "BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
        "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND "
        "CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "ISC": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
        "This work is licensed under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along "
        "with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "LGPL-3.0": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "CC0 1.0 Universal Public Domain Dedication"],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved. Proprietary and confidential."],
}
LEAST = 0.75
RESERVED = "Proprietary"
LICENCE_NAME = re.compile(r"(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[._-][^/]*)?$", re.I)
_LINE, _BLOCK, _HEAD, _WHOLE = range(4)
_WORD = "[0-9A-Za-z\x80-\U0010ffff]+"
_SCHEMA = "file_id long, path string, own string, score double, is_licence_file boolean"


class Templates:
    """Their words' hashes with idf, and their vectors of unit length, one column each in the order of names."""

    def __init__(self, templates: dict[str, list[str]]):
        texts = [(n, re.findall(_WORD, t.lower())) for n in sorted(templates) for t in templates[n]]
        self.names = [n for n, _ in texts]
        vocabulary = sorted({w for _, ws in texts for w in ws})
        number = {w: k for k, w in enumerate(vocabulary)}
        df = np.array([sum(w in ws for ws in [set(x) for _, x in texts]) for w in vocabulary])
        idf = 1 + np.log(len(texts) / df)
        self.unseen = 1 + math.log(len(texts))
        vectors = np.zeros((len(vocabulary), len(texts)))
        for j, (_, ws) in enumerate(texts):
            for w in ws:
                vectors[number[w], j] += idf[number[w]]
        vectors /= np.sqrt((vectors**2).sum(0))
        hashes = Words(pa.array(vocabulary, pa.string()), ALNUM).hash
        order = np.argsort(hashes)
        self.hashes, self.idf, self.vectors = hashes[order], idf[order], vectors[order]

    def score(self, words: Words, begin: np.ndarray, end: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """The best template of each unit of words [begin, end), and its cosine, as far as that is ``least`` or more; else -1 and 0."""
        best, score = np.full(len(begin), -1), np.zeros(len(begin))
        at = np.searchsorted(self.hashes, words.hash)
        at[at == len(self.hashes)] = 0
        known = np.flatnonzero(self.hashes[at] == words.hash)
        idf = np.full(len(words.hash), self.unseen)
        idf[known] = self.idf[at[known]]
        square = np.concatenate([[0], np.cumsum(idf * idf)])
        lo, hi = np.searchsorted(known, begin), np.searchsorted(known, end)
        # A norm as if no word came twice is the least that a unit can have, so this is above its cosine.
        units = np.flatnonzero(hi > lo)
        for a in range(0, len(units), 4096):
            u = units[a : a + 4096]
            k0, k1 = int(lo[u].min()), int(hi[u].max())
            part = known[k0:k1]
            total = np.zeros((len(part) + 1, len(self.names)))
            np.cumsum(idf[part][:, None] * self.vectors[at[part]], axis=0, out=total[1:])
            dot = total[hi[u] - k0] - total[lo[u] - k0]
            most = dot.max(1) / np.sqrt(np.maximum(square[end[u]] - square[begin[u]], 1e-300))
            for i in np.flatnonzero(most >= least - 1e-9).tolist():
                b, e = int(begin[u[i]]), int(end[u[i]])
                _, place, n = np.unique(words.hash[b:e], return_index=True, return_counts=True)
                norm = math.sqrt(float(((n * idf[b:e][place]) ** 2).sum()))
                cosine = np.round(dot[i] / norm, 9)
                j = int(cosine.argmax())
                if cosine[j] >= least:
                    best[u[i]], score[u[i]] = j, cosine[j]
        return best, score


def _units(column: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end, level) of each line, each block of several lines, and each whole text that has words. A line between blank ones is
    a block; the first block of a text is its head."""
    data, off = utf8(column)
    n_rows = len(off) - 1
    feed = np.flatnonzero(data == 0x0A)
    cut = np.union1d(off[:-1], feed + 1)  # where lines start; a text that starts at the end of the data is empty
    cut = cut[cut < len(data)]
    line_end = np.append(cut[1:], len(data))
    b, e = np.searchsorted(words.start, cut), np.searchsorted(words.start, line_end)
    row = np.searchsorted(off, cut, "right") - 1
    full = e > b
    # A block ends at a line without words and at the end of a text.
    opens = full & np.concatenate([[True], ~full[:-1] | (row[1:] != row[:-1])])[: len(full)]
    closes = full & np.concatenate([~full[1:] | (row[1:] != row[:-1]), [True]])[: len(full)]
    several = np.flatnonzero(closes) > np.flatnonzero(opens)
    first, last = words.first[:-1], words.first[1:]
    whole = np.flatnonzero(last > first)
    rows = np.concatenate([row[full], row[opens][several], whole])
    block = np.full(len(several), _BLOCK)
    block[np.unique(row[opens], return_index=True)[1]] = _HEAD
    line = np.full(len(full), _LINE)
    line[np.flatnonzero(opens)[~several]] = block[~several]
    level = np.concatenate([line[full], block[several], np.full(len(whole), _WHOLE)])
    return rows, np.concatenate([b[full], b[opens][several], first[whole]]), np.concatenate([e[full], e[closes][several], last[whole]]), level


def _scorer(templates: dict[str, list[str]], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Templates(templates)
        reserved = np.array([n == RESERVED for n in model.names])
        for part in chunks(batches, "text"):
            column = part.column(2)
            words = Words(column, ALNUM)
            n = part.num_rows
            rows, begin, end, level = _units(column, words)
            best, score = model.score(words, begin, end, least)
            named = np.array([bool(p and LICENCE_NAME.search(p)) for p in part.column(1).to_pylist()], dtype=bool)
            level = np.where((level == _HEAD) & ~named[rows], _BLOCK, level)
            own, top, speaks = [None] * n, np.zeros(n), np.zeros(n, dtype=bool)
            found = np.flatnonzero(best >= 0)
            order = np.lexsort((best[found], -score[found], -level[found], reserved[best[found]]))
            for i in found[order][::-1].tolist():  # the first in this order comes last and stays
                own[rows[i]] = model.names[best[i]]
                speaks[rows[i]] |= named[rows[i]] or level[i] == _WHOLE
            for i in found.tolist():
                if own[rows[i]] == model.names[best[i]]:
                    top[rows[i]] = max(top[rows[i]], score[i])
            none = np.array([x is None for x in own], dtype=bool)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(own, pa.string()), pa.array(top, mask=none), pa.array(speaks)], names=["file_id", "path", "own", "score", "is_licence_file"]
            )

    return run


def own_licences(files: DataFrame, least: float = LEAST, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """file_id, path, own (licence or null), score and is_licence_file of each row of (file_id, path, text)."""
    rows = files.select(F.col("file_id").cast("long").alias("file_id"), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scorer(templates or TEMPLATES, least), _SCHEMA)


def scan_licences(files: DataFrame, least: float = LEAST, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``files``: (file_id, path, text). One row per file: file_id, path, own, score, licence, inherited_from."""
    table = Scratch(files.sparkSession, "licences").keep(own_licences(files, least, templates), "own")  # texts are read once
    parent = F.regexp_replace("path", "/?[^/]*$", "")
    licensed = table.where("is_licence_file and path is not null").groupBy(parent.alias("dir")).agg(F.min_by("own", F.struct("path", "own")).alias("dir_licence"))
    bare = table.where("own is null and path is not null").select(parent.alias("p")).distinct()
    dirs = bare.select("p", F.explode(F.array_distinct(ancestors_of(F.col("p")))).alias("dir"))
    nearest = dirs.join(licensed, "dir").groupBy("p").agg(F.max_by(F.struct("dir", "dir_licence"), F.length("dir")).alias("d"))
    out = table.withColumn("__p", F.when(F.col("own").isNull(), parent)).join(nearest.withColumnRenamed("p", "__p"), "__p", "left")
    return out.select("file_id", "path", "own", "score", F.coalesce("own", "d.dir_licence").alias("licence"), F.col("d.dir").alias("inherited_from"))


def ancestors_of(path: Column) -> Column:
    """The directories above a directory, itself first, the root (an empty path) last."""
    parts = F.split(path, "/")
    return F.array_append(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")), F.lit(""))
