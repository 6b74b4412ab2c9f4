"""License scan with a positional rare-token index.

Templates of licence notices, short names and tags are cut into words. Document
frequencies of the licence words are counted over all documents (one
aggregation; the licence vocabulary is fixed, so some hundred rows come back) and
give each word its IDF. A template is indexed by its own ``RARE`` words of highest
IDF: postings word -> (template, position).

A text's licence words are looked up in these postings. A template with at least
``AGREE`` of its rare words in the text is followed by position: every place of a
rare word votes for the template at the offset place - position, and the postings
are intersected by relative position, that is, at least ``AGREE`` of the rare words
must stand at offsets at most ``DRIFT`` apart (small insertions and deletions).
There the template is aligned in order: the share of its words found is that of
the longest common subsequence with the words of the region, and the key phrases
must stand consecutively in it. Rarity thus decides where a template is looked
for at all, and position and order what matches; words in another order do not.
No template, place or offset is left out because a text holds many of them.

The base phrases are found wherever their words stand consecutively. Their
labels always stay; the index adds labels.

Words are runs of letters, digits and non-ASCII characters of the text with A-Z
in lower case. Null text counts as empty and has no words. Repeated rows and
ids keep their rows. A word without any document has the largest IDF; of equal
ones those of fewer templates come first, then those earlier in the template. An empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facsimile.llm.common import ship, text_of
from facsimile.llm.tokens import text_slices

# Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Notices as their licences word them, label -> (notice, key phrases).
TEMPLATES: dict[str, tuple[str, list[str]]] = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ["except in compliance with the license", "unless required by applicable law"],
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ["redistribution and use in source and binary forms", "conditions are met"],
    ),
    "cc-by-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    "cc-by-nc-4.0": ("Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    "cc-by-sa-4.0": ("Licensed under CC BY-SA 4.0", ["cc by sa 4 0"]),
    "gpl-2.0": ("This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    "gpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        ["redistribute it and or modify it", "gnu general public license"],
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify", "with or without fee is hereby granted"],
    ),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License", ["gnu lesser general public license"]),
    "mit": ("Released under the MIT License", ["mit license"]),
    "mit-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    "unlicense": ("This is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    "agpl-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license", "version 3"]),
    "agpl-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        ["redistribute it and or modify it", "gnu affero general public license"],
    ),
    "artistic-2.0": ("Licensed under the Artistic License 2.0", ["artistic license 2 0"]),
    "bsd-2-clause": ("Licensed under the BSD 2-Clause License", ["bsd 2 clause"]),
    "bsd-3-clause": ("Licensed under the BSD 3-Clause License", ["bsd 3 clause"]),
    "bsd-3-clause-notice": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        ["may be used to endorse or promote products derived from this software without specific prior written permission"],
    ),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0", ["boost software license", "version 1 0"]),
    "cc0-1.0": ("Released under CC0 1.0 Universal", ["cc0 1 0"]),
    "cc0-1.0-notice": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    "cddl-1.0": ("Subject to the terms of the Common Development and Distribution License, Version 1.0", ["common development and distribution license", "version 1 0"]),
    "epl-1.0": ("Made available under the terms of the Eclipse Public License v1.0", ["eclipse public license v1 0"]),
    "epl-2.0": ("Made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    "epl-2.0-v": ("Made available under the terms of the Eclipse Public License v2.0", ["eclipse public license v2 0"]),
    "eupl-1.2": ("Licensed under the EUPL, Version 1.2", ["eupl", "version 1 2"]),
    "lgpl-2.1": ("This library is licensed under the GNU Lesser General Public License, version 2.1", ["gnu lesser general public license", "version 2 1"]),
    "lgpl-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3", ["gnu lesser general public license", "version 3"]),
    "lgpl-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        ["redistribute it and or modify it", "gnu lesser general public license"],
    ),
    "mpl-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1", ["mozilla public license version 1 1"]),
    "ofl-1.1": ("This Font Software is licensed under the SIL Open Font License, Version 1.1", ["sil open font license", "version 1 1"]),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        ["in no event will the authors be held liable for any damages"],
    ),
}
# Creative Commons licences by short and by long name, in all their versions.
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives", "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike", "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}
for _kind, _name in _CC.items():
    for _version, _port in (("1.0", "Generic"), ("2.0", "Generic"), ("2.5", "Generic"), ("3.0", "Unported"), ("4.0", "International")):
        _long = _name if _version == "4.0" else _name.replace("NoDerivatives", "NoDerivs")
        _label = f"cc-{_kind}-{_version}"
        _short = (f"Licensed under CC {_kind.upper()} {_version}", [f"cc {_kind} {_version}"])
        _notice = (f"This work is licensed under a Creative Commons {_long} {_version} {_port} License", [f"creative commons {_long} {_version}"])
        for _template in (_short, _notice):
            if not any(notice == _template[0] for notice, _ in TEMPLATES.values()):
                TEMPLATES[_label if _label not in TEMPLATES else f"{_label}-notice" if _template is _notice else f"{_label}-short"] = _template

# Further paragraphs of the same licences.
TEMPLATES |= {
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details.",
        ["in the hope that it will be useful", "gnu general public license for more details"],
    ),
    "mit-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY",
        ["fitness for a particular purpose and noninfringement"],
    ),
    "bsd-warranty": (
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ["copyright holders and contributors as is"],
    ),
    "isc-warranty": (
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
        ["the author disclaims all warranties with regard to this software"],
    ),
    "mpl-2.0-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["if a copy of the mpl was not distributed"]),
    "zlib-conditions": (
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, "
        "an acknowledgment in the product documentation would be appreciated but is not required.",
        ["the origin of this software must not be misrepresented"],
    ),
    "unlicense-terms": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["anyone is free to copy modify publish use compile sell or distribute this software"]),
}
# Short names of the GNU licences, and identifiers of the SPDX tags.
for _name in ("GPL", "LGPL", "AGPL"):
    for _version in ("2", "2.1", "3"):
        if (_name, _version) in (("GPL", "2.1"), ("LGPL", "2"), ("AGPL", "2"), ("AGPL", "2.1")):
            continue
        for _form, _mark in (("v", ""), (" v", "-spaced")):
            _short = f"{_name}{_form}{_version}"
            TEMPLATES[f"{_name.lower()}-{_version}{'.0' if '.' not in _version else ''}-short{_mark}"] = (f"GNU {_short}", [f"gnu {_short}"])
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 "
    "CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later "
    "LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-1.1 MPL-2.0 MS-PL MS-RL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL Python-2.0 Unlicense UPL-1.0 WTFPL Zlib"
).split()
for _id in SPDX:
    TEMPLATES[f"spdx-{_id.lower()}"] = (f"SPDX-License-Identifier: {_id}", [f"spdx license identifier {_id}"])

MIN_MATCH = 0.6  # share of a template's words found in order
DRIFT = 3  # words that places of a template may be apart
RARE = 6  # words that index a template
AGREE = 0.5  # share of them that must stand at one offset

# Word characters, in lower case; every other ASCII byte is a break.
_WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split()


def _places(words: list[bytes], line: bytes, phrase: list[bytes]) -> list[int]:
    """Starts of ``phrase`` in ``words``; ``line`` is the words joined by spaces, with a space at both ends."""
    if b" " + b" ".join(phrase) + b" " not in line:
        return []
    first, n = phrase[0], len(phrase)
    out, at = [], -1
    while True:
        try:
            at = words.index(first, at + 1)
        except ValueError:
            return out
        if words[at : at + n] == phrase:
            out.append(at)


def common_in_order(template: dict[bytes, int], size: int, region: list[bytes]) -> int:
    """Length of the longest common subsequence; ``template`` has the places of each word as bits."""
    full = (1 << size) - 1
    v = full
    for w in region:
        if m := template.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


class Index:
    """Templates indexed by their rarest words, with the IDF of every licence word."""

    def __init__(self, document_frequency: dict[bytes, int], documents: int):
        self.templates = {label: words_of(notice) for label, (notice, _) in TEMPLATES.items()}
        self.keys = {label: [b" " + b" ".join(words_of(k)) + b" " for k in keys] for label, (_, keys) in TEMPLATES.items()}
        self.idf = {w: math.log((documents + 1) / (document_frequency.get(w, 0) + 1)) for words in self.templates.values() for w in words}
        self.bits: dict[str, dict[bytes, int]] = {}
        self.rare: dict[str, list[int]] = {}  # positions of the words that index a template
        self.need: dict[str, int] = {}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        spread = Counter(w for words in self.templates.values() for w in set(words))
        for label, words in self.templates.items():
            bits: dict[bytes, int] = defaultdict(int)
            for i, w in enumerate(words):
                bits[w] |= 1 << i
            self.bits[label] = dict(bits)
            self.rare[label] = sorted(range(len(words)), key=lambda i, words=words: (-self.idf[words[i]], spread[words[i]], i))[:RARE]
            self.need[label] = math.ceil(AGREE * len(self.rare[label]))
            for i in self.rare[label]:
                self.postings[words[i]].append((label, i))
        self.base = [(words_of(p), label) for p, label in BASE.items()]

    def scan(self, text: str) -> dict:
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        starts, base_labels = [], set()
        for phrase, label in self.base:
            if found := _places(words, line, phrase):
                base_labels.add(label)
                starts += found
        matches = self._matches(words)
        best = max((score for score, _, _ in matches.values()), default=0.0)
        return {
            "n_words": len(words), "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)), "labels": ",".join(sorted(base_labels | set(matches))), "score": 1.0 if base_labels else best,
            "matches": [(label, at, size, score) for label, (score, at, size) in sorted(matches.items())],
        }

    def _matches(self, words: list[bytes]) -> dict[str, tuple[float, int, int]]:
        """label -> (share of the template found in order, first word, words) of its best place."""
        here = self.postings.keys() & set(words)
        met = Counter(label for w in here for label, _ in self.postings[w])
        labels = {label for label, n in met.items() if n >= self.need[label]}
        if not labels:
            return {}
        wanted = {w: own for w in here if (own := [p for p in self.postings[w] if p[0] in labels])}
        votes: dict[str, list[tuple[int, int]]] = defaultdict(list)  # (offset, position) of each template
        for at, w in enumerate(words):
            for label, i in wanted.get(w, ()):
                votes[label].append((at - i, i))
        best = {label: self._best(label, words, sorted(found)) for label, found in votes.items()}
        return {label: m for label, m in best.items() if m}

    def _best(self, label: str, words: list[bytes], votes: list[tuple[int, int]]) -> tuple[float, int, int] | None:
        """(share found, first word, words) of the template's best place, of all where enough rare words agree."""
        template, need = self.templates[label], self.need[label]
        size = len(template)
        best, found = (MIN_MATCH, -1.0, 0), None
        inside: Counter = Counter()  # rare positions with an offset in the window
        high, tried = 0, None
        for low, (offset, i) in enumerate(votes):
            while high < len(votes) and votes[high][0] <= offset + DRIFT:
                inside[votes[high][1]] += 1
                high += 1
            if len(inside) >= need and offset != tried:
                tried = offset
                region = words[max(0, offset - DRIFT) : max(0, offset + size + 2 * DRIFT)]
                share = common_in_order(self.bits[label], size, region) / size
                if share >= best[0]:
                    line = b" " + b" ".join(region) + b" "
                    if all(k in line for k in self.keys[label]):
                        weight = sum(1 + self.idf[template[j]] for o, j in votes[low:high] if o == offset)
                        if (share, weight, -offset) > best:
                            best, found = (share, weight, -offset), (share, max(0, offset), size)
            inside[i] -= 1
            if not inside[i]:
                del inside[i]
        return found


def licence_words() -> list[bytes]:
    return sorted({w for notice, _ in TEMPLATES.values() for w in words_of(notice)})


def _frequencies(vocabulary: frozenset[bytes]):
    def run(batches):
        count: Counter = Counter()
        for batch in batches:
            for _, texts in text_slices(batch, "text"):
                for t in texts:
                    count.update(vocabulary.intersection(words_of(t)))
                count[b""] += len(texts)  # the number of documents
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    return run


def build_index(docs: DataFrame, text_col: str = "text") -> Index:
    """Index with IDF from the document frequencies of all documents."""
    ship(docs.sparkSession)
    vocabulary = frozenset(licence_words())
    counts = docs.select(text_of(text_col).alias("text")).mapInArrow(_frequencies(vocabulary), "word binary, n bigint")
    df = {bytes(r.word): r.n for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return Index(df, df.pop(b"", 0))


_FIELDS = [("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("matches", "array<struct<label:string,first_word:bigint,words:bigint,share:double>>")]
_ARROW = {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
_MATCH = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))


def _scan(index: Index):
    def run(batches):
        for batch in batches:
            for at, texts in text_slices(batch, "text"):
                found = [index.scan(t) for t in texts]
                for f in found:
                    f["matches"] = [dict(zip(("label", "first_word", "words", "share"), m)) for m in f["matches"]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), *(pa.array([f[name] for f in found], _ARROW.get(kind, _MATCH)) for name, kind in _FIELDS)],
                    ["id", *(name for name, _ in _FIELDS)],
                )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """One row per document: id, counts and places of base phrases, labels, score, matches.

    ``matches`` lists label, first word, length and matched share of every
    template found. ``score`` is 1 for a base phrase, else the best share.
    """
    index = index or build_index(docs, text_col)
    ship(docs.sparkSession)
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), text_of(text_col).alias("text"))
    return slim.mapInArrow(_scan(index), "id bigint, " + ", ".join(f"{n} {k}" for n, k in _FIELDS))
