"""License notices by a positional index of rare words.

Every template, a short notice or a licence's whole text, is a sequence of words with
a mandatory key phrase. One pass over the corpus counts in how many documents each
template word occurs. A file looks up its own licence words of highest inverse
document frequency, as many as it takes: first it rules out the templates of which it
has too few words at all, then it adds words, rarest first, until they stand at more
places of each remaining template than a match may have wrong. A word at place p
that stands at offset o of a template proposes the start p - o; the postings are
intersected by that start, and where enough of them agree, the words there are
compared with the template one by one. So no match is missed.

Base phrases must be there word for word; other templates with 80 % of their words at
their places. Null and empty texts have no words. Ties of frequency go to the smaller
word, so results do not depend on the order of rows; repeated rows give repeated
results, an empty table an empty one. Time grows with the words of a text, however
long. Only the id and text columns are read, so others may have any name.
"""

from __future__ import annotations

import math
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textio import buffers, map_texts

#: Phrases that name a licence, with their labels.
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: Fixed values, further notices: label, words of the notice, mandatory key phrase.
ADDED = (
    ("gpl-3", "gnu general public license version 3", "general public license version 3"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("mpl-2", "mozilla public license version 2", "mozilla public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("cc0", "creative commons zero universal public domain dedication", "public domain dedication"),
)
#: Fixed values, whole texts: label, text, mandatory key phrase.
TEXTS = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""", "permission is hereby granted free of charge"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,
DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""", "with or without fee is hereby granted"),
    ("bsd-2", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of
source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
     "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3", """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
written permission.""", "may be used to endorse or promote products"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""", "except in compliance with the license"),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "either version 3 of the license"),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;
either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""", "either version 2 of the license"),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/.""", "subject to the terms of the mozilla public license"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this
software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""", "must not claim that you wrote the original software"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "released into the public domain"),
)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Share of a template's words that must stand at their places (base phrases: all).
MATCH = 0.8


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


@cache
def templates() -> tuple[tuple[str, list[bytes], list[bytes], int], ...]:
    """(label, words, key phrase, how many words must stand at their places); base phrases first."""
    out = [(label, words_of(p), words_of(p), len(words_of(p))) for label, p in BASE.items()]
    return (*out, *((label, words_of(p), words_of(key), math.ceil(MATCH * len(words_of(p)))) for label, p, key in ADDED + TEXTS))


def texts_of(texts):
    """Whole texts as bytes with A-Z in lower case."""
    data, off = buffers(texts)
    raw = data.tobytes().lower()
    return (raw[off[k] : off[k + 1]] for k in range(len(off) - 1))


def document_frequency(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of documents, and in how many each template word occurs (as many numbers as the templates have words)."""
    vocabulary = {w for _, words, *_ in templates() for w in words}

    def start():
        def work(ids, texts):
            df = dict.fromkeys(vocabulary, 0)
            for raw in texts_of(texts):
                for w in vocabulary.intersection(WORD.findall(raw)):
                    df[w] += 1
            return {"word": [*(w.decode() for w in df), ""], "n": [*df.values(), len(texts)]}

        return work

    got = map_texts(docs, id_col, text_col, start, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {r["word"].encode(): r["n"] for r in got}
    return df.pop(b"", 0), df


class Index:
    """Postings (template, offset) of all template words, the words by inverse document frequency, and how often a template has each."""

    def __init__(self, n_docs: int, df: dict[bytes, int]):
        known = templates()
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, words, *_) in enumerate(known):
            for offset, w in enumerate(words):
                self.postings.setdefault(w, []).append((t, offset))
        idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) for w in self.postings}
        self.order = {w: k for k, w in enumerate(sorted(idf, key=lambda w: (-idf[w], w)))}
        self.has = np.zeros((len(self.order), len(known)), np.int64)
        for w, places in self.postings.items():
            for t, _ in places:
                self.has[self.order[w], t] += 1
        self.size, self.needed = (np.array(x) for x in ([len(k[1]) for k in known], [k[3] for k in known]))

    def rarest(self, words: set[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Of a file's licence words the rarest that decide all templates, and for each template how many of its places they must agree on (0: it can't match)."""
        own = sorted(words, key=self.order.__getitem__)
        reach = np.cumsum(self.has[[self.order[w] for w in own]], axis=0)
        wrong = self.size - self.needed
        possible = reach[-1] >= self.needed
        if not possible.any():
            return [], np.zeros_like(wrong)
        enough = 1 + int((reach[:, possible] > wrong[possible]).argmax(axis=0).max())
        return own[:enough], np.where(possible, reach[enough - 1] - wrong, 0)


def lookup(words: list[bytes], index: Index) -> tuple[list[tuple[int, str]], set[str], float]:
    """Base hits (first word, label), labels and the best score of a file."""
    own = index.order.keys() & set(words)
    chosen, agree = index.rarest(own) if own else ([], None)
    if not chosen:
        return [], set(), 0.0
    votes: dict[tuple[int, int], int] = {}
    rare = {w: [p for p in index.postings[w] if agree[p[0]]] for w in chosen}
    for at, w in enumerate(words):
        for t, offset in rare.get(w, ()):
            votes[t, at - offset] = votes.get((t, at - offset), 0) + 1
    hits, labels, best = [], set(), 0.0
    known = templates()
    for (t, start), n in sorted(votes.items()):
        if n < agree[t]:
            continue
        label, want, key, needed = known[t]
        got = [words[k] if 0 <= k < len(words) else b"" for k in range(start, start + len(want))]
        same = sum(a == b for a, b in zip(got, want, strict=True))
        if same >= needed and any(got[k : k + len(key)] == key for k in range(len(got) - len(key) + 1)):
            best = max(best, same / len(want))
            labels.add(label)
            if t < len(BASE):
                hits.append((start, label))
    return hits, labels, best


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_words, ``hits`` (start word, label) of the base phrases, all labels, score (the best share of a match, 0 without)."""
    n_docs, df = document_frequency(docs, id_col, text_col)

    def start():
        index = Index(n_docs, df)

        def work(ids, texts):
            out = {"id": ids, "n_words": [], "hits": [], "labels": [], "score": []}
            for raw in texts_of(texts):
                words = WORD.findall(raw)
                hits, labels, score = lookup(words, index)
                out["n_words"].append(len(words))
                out["hits"].append([{"start": a, "label": x} for a, x in hits])
                out["labels"].append(sorted(labels))
                out["score"].append(score)
            return out

        return work

    schema = "id long, n_words long, hits array<struct<start:long,label:string>>, labels array<string>, score double"
    return map_texts(docs, id_col, text_col, start, schema).withColumnRenamed("id", id_col)
