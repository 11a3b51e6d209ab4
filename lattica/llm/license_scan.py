"""License scans: phrase places, and an exact set-similarity join with license templates.

Templates go by classes of length: one of up to K words, K a power of two from
``least_words`` on, is looked for in blocks of 2 K words, a new one every K / 2 words, so
an occurrence of up to 1.5 K words lies in some block whole.  The join finds every block
of a text whose distinct words contain at least ``containment`` of a template's of that
class.  All words of templates are ordered by their frequency over all texts,
rarest first.  A template of n words that must share o = ceil(containment * n) shares
one of its n - o + 1 rarest, so only those are indexed (prefix filter); a block with
fewer than o words that any template has is passed over (length filter); and a block is
left as soon as the words behind a hit can't make up o any more (positional filter).
What is left is counted exactly.

Templates are a table of labelled texts that is small by nature: it is checked against
``max_template_words`` and then broadcast with the index.

Edge cases: null and empty texts have no words and no labels.  Ties in frequency are
ordered by the word.  Repeated rows are scanned one by one.  No templates: only phrases.
A template without words is left out.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.text import pieces, text_column
from lattica.session import prepare

#: Phrases with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Characteristic sentences of well-known licenses and of notices that name them.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "Released under the MIT License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
        "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details. "
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
)
_SPACES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


@dataclass(frozen=True)
class Params:
    containment: float = 0.85
    least_words: int = 32  # of the shortest class
    max_template_words: int = 100_000


def words_of(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and all other characters from U+0080 on, A-Z lower-cased."""
    return text.translate(_SPACES).split()


class Index:
    """Templates under a global order of their words."""

    def __init__(self, templates, frequency: dict[bytes, int], p: Params):
        read = [(label, words_of(text.encode())) for label, text in templates]
        self.rank = {w: i for i, w in enumerate(sorted({w for _, own in read for w in own}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates: list[tuple[str, frozenset, int, int]] = []
        self.prefix: dict[int, dict[int, list]] = {}  # class -> rank -> (template, place in its order)
        for label, own in read:
            if not own:
                continue
            order = sorted({self.rank[w] for w in own})
            need = max(1, math.ceil(p.containment * len(order) - 1e-9))
            words = max(p.least_words, 1 << (len(own) - 1).bit_length())
            t = len(self.templates)
            self.templates.append((label, frozenset(order), len(order), need))
            for i in range(len(order) - need + 1):
                self.prefix.setdefault(words, {}).setdefault(order[i], []).append((t, i))

    def matches(self, words: list[bytes]) -> dict[tuple[int, int, int], float]:
        """Containment of each (class, block, template) that meets the threshold."""
        found: dict[tuple[int, int, int], float] = {}
        places = [(i, r) for i, r in enumerate(map(self.rank.get, words)) if r is not None]
        if not places:
            return found
        where, ranks = [i for i, _ in places], [r for _, r in places]
        for size, prefix in self.prefix.items():
            block, stride = 2 * size, size // 2 or 1
            last = max(0, math.ceil((len(words) - block) / stride))
            blocks = {b for i, r in places if r in prefix for b in range(max(0, (i - block) // stride + 1), min(last, i // stride) + 1)}
            for b in sorted(blocks):
                own = sorted(set(ranks[bisect_left(where, b * stride) : bisect_left(where, b * stride + block)]))
                alive: dict[int, bool] = {}
                for j, r in enumerate(own):
                    for t, i in prefix.get(r, ()):
                        if t not in alive:
                            _, _, n, need = self.templates[t]
                            # this is the first word that both share: the rest has to make up for it
                            alive[t] = len(own) >= need and 1 + min(len(own) - j - 1, n - i - 1) >= need
                for t, ok in alive.items():
                    if ok:
                        _, order, n, need = self.templates[t]
                        shared = sum(r in order for r in own)
                        if shared >= need:
                            found[size, b, t] = shared / n
        return found


def phrase_places(words: list[bytes], phrases) -> dict[str, list[int]]:
    """Starts of each label's phrases, words counted from 0."""
    joined, out = b" " + b" ".join(words) + b" ", {}
    for phrase, label in phrases:
        key = b" " + phrase + b" "
        at, seen, word = joined.find(key), 0, 0
        while at >= 0:
            word += joined.count(b" ", seen, at)
            seen = at
            out.setdefault(label, []).append(word)
            at = joined.find(key, at + 1)
    return out


def frequencies(docs: DataFrame, vocabulary: set[bytes], text: str = "text") -> dict[bytes, int]:
    """Texts of all rows that have each word of the vocabulary."""

    def run(batches):
        counts: Counter = Counter()
        for batch in pieces(batches):
            for own in text_column(batch).cast(pa.binary()).to_pylist():
                counts.update(vocabulary.intersection(words_of(own)))
        yield pa.record_batch({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = docs.select(F.col(text).alias("text")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, params: Params | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of ``docs``: phrase places, labels, and the best containment."""
    p = params or Params()
    spark = prepare(docs.sparkSession)
    vocabulary = {w for _, t in templates for w in words_of(t.encode())}
    if sum(len(words_of(t.encode())) for _, t in templates) > p.max_template_words:
        raise ValueError("more template words than max_template_words")
    index = spark.sparkContext.broadcast(Index(templates, frequencies(docs, vocabulary, text), p))
    keys = [(" ".join(w.decode() for w in words_of(x.encode())).encode(), label) for x, label in phrases]

    def run(batches):
        own = index.value
        for batch in pieces(batches):
            out: dict[str, list] = {c.split()[0]: [] for c in SCANNED.split(", ")}
            for doc, data in zip(batch.column("doc_id").to_pylist(), text_column(batch).cast(pa.binary()).to_pylist()):
                words = words_of(data)
                places = phrase_places(words, keys)
                found = own.matches(words)
                starts = [i for x in places.values() for i in x]
                row = (doc, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(places)))
                labels = {own.templates[t][0] for *_, t in found} | set(places)
                score = 1.0 if places else max(found.values(), default=0.0)
                for c, v in zip(out, (*row, ",".join(sorted(labels)), score, len({key[:2] for key in found}))):
                    out[c].append(v)
            types = {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}
            yield pa.record_batch([pa.array(out[c], types[t]) for c, t in (x.split() for x in SCANNED.split(", "))], names=list(out))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SCANNED)
