"""License scans: normalised text against licence templates, by Dice over word bigrams.

Each line of a text is normalised (lower case, words of letters and digits) and compared with
the templates. With a and b bigrams, Dice is 2 * common / (a + b), at most
2 * min(a, b) / (a + b): a template of b bigrams is a candidate only for lines of between
b * t / (2 - t) and b * (2 - t) / t bigrams. Most lines are outside every such bound by their
number of words alone and are never normalised further.

Bigrams are counted as often as they occur. A template of several lines is compared with as
many consecutive lines of the text. Templates are a parameter of at most MAX_TEMPLATES.

Notices that are wrapped, commented or stand inside a line, and the full texts and headers of
TEXTS, are met in windows over all words of a text, whatever its lines. A window that reaches t
has t * b / (2 - t) of a template's b bigrams at least, so it has one of any b - that + 1 of
them: the rarest are its seeds, and a text without a seed has no window. Where windows and
lines overlap, the one with more bigrams in common counts, then the line. A window is no
shorter than a template of fewer than LONG bigrams: less than a short notice is none.

Defined cases: a null or empty text has no licence; of equal scores the first template by
name counts; rows that repeat an id are scanned each by itself; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

THRESHOLD = 0.8
LONG = 20
MAX_TEMPLATES = 1_000
#: Short notices that documents carry, compared with whole lines and with windows.
NOTICES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-you": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'


def _gnu(name: str, version: str) -> str:
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see https www gnu org licenses."


#: Full texts and the usual headers of files, compared with windows only.
TEXTS = {
    "agpl-3.0-header": _gnu("GNU Affero General Public License", "3"),
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE 2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause-text": _BSD + _BSD_END,
    "bsd-3-clause-text": _BSD + _BSD_3 + _BSD_END,
    "gpl-2.0-header": _gnu("GNU General Public License", "2"),
    "gpl-3.0-header": _gnu("GNU General Public License", "3"),
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "lgpl-2.1-header": _gnu("GNU Lesser General Public License", "2.1"),
    "lgpl-3.0-header": _gnu("GNU Lesser General Public License", "3"),
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. ' + _AS_IS,
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https mozilla org MPL 2.0.",
}
_WORD = re.compile(r"[^\W_]+")


def bigrams(text: str) -> Counter:
    """Word bigrams of the normalised text; a single word stands for itself."""
    words = _WORD.findall(text.lower())
    return Counter(zip(words, words[1:], strict=False)) if len(words) != 1 else Counter([(words[0], "")])


def dice(a: Counter, b: Counter) -> float:
    total = sum(a.values()) + sum(b.values())
    return 2 * sum((a & b).values()) / total if total else 0.0


class Scanner:
    """Templates by the number of lines they have, with their bounds."""

    def __init__(self, templates: dict[str, str], threshold: float):
        if len(templates) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.threshold = threshold
        self.by_lines: dict[int, list] = {}
        for name in sorted(templates):
            grams = bigrams(templates[name])
            n = sum(grams.values())
            lines = sum(bool(x.strip()) for x in templates[name].split("\n"))
            self.by_lines.setdefault(lines, []).append((name, grams, n * threshold / (2 - threshold), n * (2 - threshold) / threshold))

    def scan(self, text: str) -> list[tuple[int, str, float]]:
        """(line, template, Dice) of each place where a template is met: the best one there."""
        lines = text.split("\n")
        found = []
        for count, templates in self.by_lines.items():
            low, high = min(t[2] for t in templates), max(t[3] for t in templates)
            for i in range(len(lines) - count + 1):
                passage = "\n".join(lines[i : i + count]) if count > 1 else lines[i]
                words = _words(passage, high + 1)
                if not words:
                    continue
                grams = Counter(zip(words, words[1:], strict=False)) if len(words) != 1 else Counter([(words[0], "")])
                size = max(1, len(words) - 1)
                if size < low:
                    continue
                for name, other, least, most in templates:
                    if least <= size <= most and (d := dice(grams, other)) >= self.threshold:
                        found.append((i, name, d))
        best: dict[int, tuple] = {}
        for i, name, d in found:
            if i not in best or (-d, name) < (-best[i][2], best[i][1]):
                best[i] = (i, name, d)
        return [best[i] for i in sorted(best)]


class Windows:
    """Templates met anywhere in the words of a text, and the lines that a Scanner finds."""

    def __init__(self, templates: dict[str, str], texts: dict[str, str], threshold: float):
        if len(templates) + len(texts) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        self.threshold, self.lines = threshold, Scanner(templates, threshold)
        self.grams = {k: bigrams(t) for k, t in {**templates, **texts}.items()}
        spread = Counter(w for g in self.grams.values() for w in {w for pair in g for w in pair})
        self.known, self.seeds = [], {}
        for name, grams in sorted(self.grams.items()):
            n = sum(grams.values())
            if not n or any(not b for _, b in grams):
                continue  # no words, or one: lines only
            need = math.ceil(n * threshold / (2 - threshold) - 1e-9)
            self.known.append((name, grams, n, need, n * (2 - threshold) / threshold))
            missing = n - need + 1
            for pair in sorted(grams, key=lambda g: (spread[g[0]] + spread[g[1]], -len(g[0]) - len(g[1]), g)):
                self.seeds.setdefault(pair, []).append(len(self.known) - 1)
                missing -= grams[pair]
                if missing <= 0:
                    break
        self.every = frozenset(self.seeds)

    def scan(self, text: str) -> list[tuple[int, str, float]]:
        """(line, template, Dice) of each place, in order."""
        words = _WORD.findall(text.lower())
        met = self.every.intersection(zip(words, words[1:], strict=False))
        lines = self.lines.scan(text)
        if not met:
            return lines
        words, begins = [], []
        for line in text.split("\n"):
            begins.append(len(words))
            words += _WORD.findall(line.lower())
        begins.append(len(words))
        pairs = list(zip(words, words[1:], strict=False))
        found = []
        for k in sorted({k for pair in met for k in self.seeds[pair]}):
            found += self._met(pairs, *self.known[k])
        for i, name, d in lines:
            last = i + self._n_lines(name)
            grams = bigrams(" ".join(words[begins[i] : begins[last]]))
            found.append((-sum((grams & self.grams[name]).values()), 0, -d, name, begins[i], begins[last], i))
        taken, out = bytearray(len(words)), []
        for _, _, d, name, start, end, i in sorted(found):
            if not any(taken[start:end]):
                taken[start:end] = b"\1" * (end - start)
                out.append((bisect_right(begins, start) - 1 if i < 0 else i, start, name, -d))
        return [(i, name, d) for i, _, name, d in sorted(out)]

    def _n_lines(self, name: str) -> int:
        return next(n for n, some in self.lines.by_lines.items() if any(t[0] == name for t in some))

    def _met(self, pairs: list[tuple], name: str, grams: Counter, n: int, need: int, most: float) -> list[tuple]:
        """The best window from each start; it starts and ends with bigrams of the template."""
        at = [i for i, g in enumerate(pairs) if g in grams]
        found = []
        for a in range(len(at) - need + 1):
            start = at[a]
            if at[a + need - 1] - start + 1 > most:
                continue
            used, common, best = {}, 0, None
            for b in range(a, len(at)):
                end = at[b] + 1
                if end - start > most:
                    break
                g = pairs[end - 1]
                if used.get(g, 0) < grams[g]:
                    used[g] = used.get(g, 0) + 1
                    common += 1
                    d = 2 * common / (n + (end - start if n >= LONG else max(end - start, n)))
                    if d >= self.threshold and (best is None or d > best[0]):
                        best = (d, common, end)
            if best:
                found.append((-best[1], 1, -best[0], name, start, best[2] + 1, -1))
        return found


def _words(passage: str, most: float) -> list[str] | None:
    """The normalised words of a passage, or None once they are too many for every template."""
    words = []
    for m in _WORD.finditer(passage):
        words.append(m[0].lower())
        if len(words) > most:
            return None
    return words


def license_scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: dict[str, str] = NOTICES, threshold: float = THRESHOLD, texts: dict[str, str] = TEXTS) -> DataFrame:
    """id, n_licenses (places), license and dice (the best of the text; null if none), first_line (of it), licenses (all names, in order)."""
    thin = docs.select(F.col(id_column), text_of(text).alias("__mr_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Windows(templates, texts, threshold)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                hits = [scanner.scan(t) for t in some.column(1).to_pylist()]
                best = [min(h, key=lambda x: (-x[2], x[1], x[0])) if h else (None, None, None) for h in hits]
                cols = [some.column(0), pa.array(list(map(len, hits)), pa.int64()), pa.array([b[1] for b in best], pa.string()), pa.array([None if b[2] is None else round(b[2], 6) for b in best], pa.float64()), pa.array([b[0] for b in best], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([sorted({x[1] for x in h}) for h in hits], pa.list_(pa.string()))], names=[id_column, "n_licenses", "license", "dice", "first_line", "licenses"])

    return thin.mapInArrow(run, f"`{id_column}` {thin.schema[id_column].dataType.simpleString()}, n_licenses long, license string, dice double, first_line long, licenses array<string>")


def _sql() -> str:
    """The same rows in DuckDB, for templates of one line."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(NOTICES.items()))
    gram = "CASE WHEN len(w) = 1 THEN w[1] || ' ' ELSE w[k] || ' ' || w[k + 1] END"
    return rf"""
WITH p(name, body) AS (VALUES {values}),
tw AS (SELECT name, w, unnest(range(1, greatest(len(w), 2))) AS k FROM (SELECT name, list_transform(regexp_extract_all(body, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS w FROM p)),
tb AS (SELECT name, {gram} AS g, count(*) AS c FROM tw GROUP BY ALL), tn AS (SELECT name, sum(c) AS n FROM tb GROUP BY name),
a AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
lw AS (SELECT doc_id, i, w, unnest(range(1, greatest(len(w), 2))) AS k FROM (SELECT doc_id, i, list_transform(regexp_extract_all(line, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)) AS w FROM a WHERE length(line) < 2000) WHERE len(w) BETWEEN 1 AND 100),
lb AS (SELECT doc_id, i, {gram} AS g, count(*) AS c FROM lw GROUP BY ALL), ln AS (SELECT doc_id, i, sum(c) AS n FROM lb GROUP BY ALL),
m AS (SELECT lb.doc_id, lb.i, name, sum(least(lb.c, tb.c)) AS shared FROM lb JOIN tb USING (g) GROUP BY ALL),
h AS (SELECT m.doc_id, m.i, m.name, 2.0::DOUBLE * shared / (ln.n + tn.n) AS dice FROM m JOIN ln ON m.doc_id = ln.doc_id AND m.i = ln.i JOIN tn ON m.name = tn.name WHERE 2.0::DOUBLE * shared / (ln.n + tn.n) >= {THRESHOLD}),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY dice DESC, name) AS r FROM h) WHERE r = 1),
g AS (SELECT doc_id, count(*) AS n, first(name ORDER BY dice DESC, name, i) AS license, max(dice) AS dice, first(i ORDER BY dice DESC, name, i) AS first_line, array_to_string(list_sort(list(DISTINCT name)), ',') AS licenses FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_licenses, license, round(dice, 6) AS dice, first_line, coalesce(licenses, '') AS licenses FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL = _sql()
