"""Licence notices in documents, by a positional index of rare licence words.

A template has a text and mandatory key phrases, several where the licence has a text of its own; one-line notices have one. The document
frequency of every licence word is counted over the corpus. Of each document only its highest-IDF licence words are looked up, those that are the
rarest of a phrase; their postings name template, phrase and place. Postings of the phrase's RARE rarest words are intersected by relative position,
which leaves few places, and these are verified by the rest of the phrase. A template is found where all its phrases stand at their places
relative to the first one, give or take `slack` words. As a phrase cannot stand without its words, nothing is missed.

Words are runs of ASCII letters, digits and bytes above 127; ASCII letters compare in lower case.

Cases: null and empty texts have no notice. Each row is scanned by itself, also with null or repeated doc_ids; equal rows give equal results.
Several notices in a document, also of one licence, are several rows. Empty tables give empty results. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Hasher, pieces, runs, words

SLACK, RARE = 12, 3


@dataclass(frozen=True)
class Template:
    license: str
    text: str
    keys: tuple[str, ...]


TEMPLATES = (
    Template("MIT", "Released under the MIT License.", ("MIT License",)),
    Template("MIT", "SPDX-License-Identifier: MIT", ("SPDX-License-Identifier: MIT",)),
    Template(
        "MIT-text",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND',
        ("Permission is hereby granted, free of charge", "to deal in the Software without restriction", "this permission notice shall be included in all copies", 'provided "AS IS", WITHOUT WARRANTY OF ANY KIND'),
    ),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0.", ("Apache License, Version 2.0",)),
    Template("Apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("SPDX-License-Identifier: Apache-2.0",)),
    Template(
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        ("Apache License, Version 2.0", "you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing", 'distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND'),
    ),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3.", ("GNU General Public License, version 3",)),
    Template("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("GNU General Public License, version 2",)),
    Template(
        "GPL-header",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("you can redistribute it and/or modify it under the terms of the", "GNU General Public License as published by the Free Software Foundation", "at your option any later version", "without even the implied warranty of MERCHANTABILITY"),
    ),
    Template("LGPL", "under the terms of the GNU Lesser General Public License", ("GNU Lesser General Public License",)),
    Template(
        "LGPL-header",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        ("This library is free software", "GNU Lesser General Public License as published by the Free Software Foundation", "at your option any later version"),
    ),
    Template("AGPL-3.0", "under the terms of the GNU Affero General Public License", ("GNU Affero General Public License",)),
    Template(
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("Redistribution and use in source and binary forms", "Redistributions of source code must retain the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice"),
    ),
    Template(
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("Redistribution and use in source and binary forms", "Redistributions of source code must retain the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ),
    Template(
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("and/or distribute this software for any purpose with or without fee is hereby granted", "this permission notice appear in all copies"),
    ),
    Template(
        "Zlib",
        "In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
        ("In no event will the authors be held liable for any damages", "Permission is granted to anyone to use this software for any purpose", "to alter it and redistribute it freely"),
    ),
    Template(
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        ("Boost Software License", "any person or organization obtaining a copy of the software and accompanying documentation"),
    ),
    Template("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ("Mozilla Public License, v. 2.0",)),
    Template(
        "MPL-2.0-header",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file"),
    ),
    Template(
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        ("free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ),
    Template("CC0-1.0", "CC0 1.0 Universal", ("CC0 1.0",)),
    Template("CC-BY-4.0", "Licensed under CC BY 4.0.", ("CC BY 4.0",)),
    Template("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", ("CC BY-SA 4.0",)),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0.", ("CC BY-NC 4.0",)),
    Template("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0.", ("CC BY-ND 4.0",)),
    Template("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.", ("CC BY-NC-SA 4.0",)),
    Template("all-rights-reserved", "All rights reserved.", ("All rights reserved",)),
)


def fold_table() -> np.ndarray:
    """Bytes to words: letters in lower case, anything that separates to a space."""
    table = np.full(256, 32, np.uint8)
    table[48:58] = np.arange(48, 58)
    table[65:91] = table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def fold(text: str) -> list[str]:
    return fold_table()[np.frombuffer(text.encode(), np.uint8)].tobytes().decode().split()


def phrase_table(templates) -> list[tuple[int, int, int, list[str]]]:
    """(template, phrase, place of the phrase in the template, words)."""
    out = []
    for t, template in enumerate(templates):
        text = fold(template.text)
        for p, key in enumerate(template.keys):
            own = fold(key)
            at = next(i for i in range(len(text) - len(own) + 1) if text[i : i + len(own)] == own)
            out.append((t, p, at, own))
    return out


class PositionalIndex:
    """Postings of the rarest word of each phrase: hash of the word to phrases, and the phrases' places in the order of rarity."""

    def __init__(self, templates, frequency: dict[str, int], n: int) -> None:
        self.phrases = phrase_table(templates)
        hasher = Hasher()
        self.hashes = [words(pa.array([" ".join(own)]), hasher)[0] for *_, own in self.phrases]
        idf = lambda w: math.log((1 + n) / (1 + frequency.get(w, 0)))
        posting: dict[int, list[int]] = {}
        # places of each phrase by falling IDF of their words
        self.rarest = [sorted(range(len(own)), key=lambda k, own=own: (-idf(own[k]), -len(own[k]), k)) for *_, own in self.phrases]
        for i, places in enumerate(self.rarest):
            posting.setdefault(int(self.hashes[i][places[0]]), []).append(i)
        self.anchors = np.sort(np.array(list(posting), np.uint64))
        self.posting = [posting[int(h)] for h in self.anchors]
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.anchors & np.uint64(0xFFFF)).astype(np.int64)] = True

    def occurrences(self, hashes: np.ndarray, at: np.ndarray):
        """(phrase, document, place in the document) of each verified phrase."""
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.anchors, hashes[maybe]), len(self.anchors) - 1)
        sure = self.anchors[slot] == hashes[maybe]
        place, slot = maybe[sure], slot[sure]
        for s in np.unique(slot):
            here = place[slot == s]
            doc = np.searchsorted(at, here, "right") - 1
            for phrase in self.posting[s]:
                own, places = self.hashes[phrase], self.rarest[phrase]
                first = here - places[0]
                fits = (first >= at[doc]) & (first + len(own) <= at[doc + 1])
                d, first = doc[fits], first[fits]
                # the other rare words at their relative places, then the rest
                for k in (*places[1:RARE], *places[RARE:]):
                    if not len(d):
                        break
                    same = hashes[first + k] == own[k]
                    d, first = d[same], first[same]
                if len(d):
                    yield phrase, d, first - at[d]


def matches(index: PositionalIndex, hashes: np.ndarray, at: np.ndarray, slack: int) -> list[tuple[int, int, int]]:
    """(document, template, word where its first phrase starts), all phrases at their places."""
    found: dict[tuple[int, int], dict[int, list[int]]] = {}
    for phrase, doc, place in index.occurrences(hashes, at):
        t, p, *_ = index.phrases[phrase]
        for d, w in zip(doc.tolist(), place.tolist()):
            found.setdefault((d, t), {}).setdefault(p, []).append(w)
    need: dict[int, list[int]] = {}
    for t, _, offset, _ in index.phrases:
        need.setdefault(t, []).append(offset)
    out = []
    for (d, t), seen in found.items():
        if len(seen) < len(need[t]):
            continue
        others = [(np.sort(seen[p]), need[t][p] - need[t][0]) for p in range(1, len(need[t]))]
        for w in seen[0]:
            # the nearest place of each phrase on either side
            if all(len(v[(lo := np.searchsorted(v, w + off - slack)) : lo + 1]) and v[lo] <= w + off + slack for v, off in others):
                out.append((d, t, w))
    return sorted(out)


def word_frequencies(docs: DataFrame, templates) -> tuple[dict[str, int], int]:
    """(documents of each licence word, all documents)."""
    vocabulary = sorted({w for *_, own in phrase_table(templates) for w in own})

    def count(batches):
        hasher, table = Hasher(), fold_table()
        own = words(pa.array([" ".join(vocabulary)]), hasher)[0]
        order = np.argsort(own)
        ranked = own[order]
        bits = np.zeros(1 << 16, bool)
        bits[(own & np.uint64(0xFFFF)).astype(np.int64)] = True
        total = np.zeros(len(own) + 1, np.int64)
        for batch in pieces(batches, 0):
            hashes, at = words(batch.column(0), hasher, fold=table)
            total[-1] += batch.num_rows
            place = np.flatnonzero(bits[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(ranked, hashes[place]), len(ranked) - 1)
            sure = ranked[slot] == hashes[place]
            doc = np.searchsorted(at, place[sure], "right") - 1
            pair = np.sort(doc * len(own) + order[slot[sure]])
            pair = pair[runs(pair)[:-1]] if len(pair) else pair
            total[:-1] += np.bincount(pair % len(own), minlength=len(own))
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["word", "n"])

    got = {r.word: r.n for r in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: got.get(i, 0) for i, w in enumerate(vocabulary)}, got.get(len(vocabulary), 0)


def license_notices(docs: DataFrame, templates=TEMPLATES, slack: int = SLACK) -> DataFrame:
    """(doc_id, license, start_word): where the first key phrase of each notice starts, counted in folded words from 0."""
    index = PositionalIndex(templates, *word_frequencies(docs, templates))
    names = [t.license for t in templates]

    def scan(batches):
        hasher, table = Hasher(), fold_table()
        for batch in pieces(batches, 1):
            hashes, at = words(batch.column(1), hasher, fold=table)
            rows = sorted({(d, names[t], w) for d, t, w in matches(index, hashes, at, slack)})
            yield pa.record_batch([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], ["doc_id", "license", "start_word"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, license string, start_word long")


def license_sql(templates=TEMPLATES, slack: int = SLACK) -> str:
    """The same in DuckDB SQL: all places of all phrases, then a join by relative place."""
    quote = lambda own: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in own) + "]"
    rows = ", ".join(f"({t}, '{templates[t].license}', {p}, {at}, {quote(own)})" for t, p, at, own in phrase_table(templates))
    return f"""
WITH phrase(t, license, p, place, own) AS (VALUES {rows}),
word AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]', ' ', 'g')), ' +'), lambda x: x <> '') AS w FROM documents),
token AS (SELECT doc_id, w, i, w[i + 1] AS x FROM word, unnest(range(0, len(w))) AS u(i)),
hit AS (SELECT doc_id, t, license, p, place, i FROM token JOIN phrase ON x = own[1] WHERE w[i + 1 : i + len(own)] = own),
need AS (SELECT t, count(*) AS n FROM phrase GROUP BY t)
SELECT DISTINCT doc_id, license, i AS start_word FROM (
  SELECT a.doc_id, a.t, a.license, a.i, count(DISTINCT b.p) AS seen
  FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.t = b.t AND a.p = 0 AND (b.p = 0 AND b.i = a.i OR b.p > 0 AND abs((b.i - a.i) - (b.place - a.place)) <= {slack})
  GROUP BY ALL
) JOIN need USING (t) WHERE seen = n
"""
