"""Licence recognition by sentence rules, no shuffle.

A text is cut into passages at marks and at lines without a letter or digit, so that a wrapped sentence, comment marks
and all, stays in one.  The words of a passage's lines are normalised (A-Z lower-cased, "licence" spelt "license", all
but letters, digits and inner dots to single blanks), and each run of whole lines whose words are a known licence sentence
is found, unless a larger run that is found holds it.  The identifiers found, in text order, are matched against the rules in
their order: a rule is a sequence of neighbouring identifiers (unknown sentences between them are passed over), and what
it matches is used up, so longer notices come before their parts; what stood on both sides of it doesn't become neighbours.

Defined cases: null and empty texts have no licence; a sentence that repeats is found each time and its licence
named once; each row is on its own, repeated rows included; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Where passages end: at marks before a blank or the end, and at lines without a letter or digit.
ENDS = r"[.!?;:]+(?:\s+|$)|\n(?:[^\p{L}\p{N}\n]*\n)+"
_CUT = re.compile(r"[.!?;:]+(?:[ \t\n\f\r]+|\Z)|\n(?:(?:[^\w\n]|_)*\n)+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    s = sentence.translate(str.maketrans(_UPPER, _LOWER)).replace("licence", "license").replace("licencing", "licensing")
    return re.sub(r"^[ .]+|[ .]+$", "", re.sub(r"[^a-z0-9.]+", " ", s))


def line_words(line: str) -> list[str]:
    return normal(line).split(" ") if line else []


_KNOWN = {
    "AllRights": ["All rights reserved."],
    "ApacheRef2": ["Licensed under the Apache License, Version 2.0.", "This project is licensed under the Apache License 2.0", "Released under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License")'],
    "ApacheComply": ["you may not use this file except in compliance with the License"],
    "ApacheCopy": ["You may obtain a copy of the License at"],
    "ApacheAsIs": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "MitRef": ["Released under the MIT License.", "Licensed under the MIT License", "This project is licensed under the MIT License", "MIT License", "The MIT License"],
    "MitGrant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "MitNotice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MitAsIs": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "GplRef3": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3", "Released under the GNU General Public License v3.0"],
    "GplRef2": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2", "Released under the GNU General Public License v2.0"],
    "GplFree3": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "GplFree3a": ["This program is free software"], "GplFree3b": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "MitLiable": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"],
    "IscGrant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "IscRef": ["ISC License", "The ISC License", "Licensed under the ISC License", "Released under the ISC License"],
    "LgplFree": ["This library is free software"], "LgplTerms21": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "Lgpl21Later": ["either version 2.1 of the License, or (at your option) any later version"],
    "Lgpl3b": ["you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "LgplRef3": ["Licensed under the GNU Lesser General Public License, version 3", "Released under the GNU Lesser General Public License v3.0", "This work is licensed under the GNU Lesser General Public License, version 3"],
    "Agpl3b": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License, or (at your option) any later version"],
    "AgplRef3": ["Licensed under the GNU Affero General Public License, version 3", "Released under the GNU Affero General Public License v3.0", "This work is licensed under the GNU Affero General Public License, version 3"],
    "EplTerms2": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v. 2.0 which is available at", "Licensed under the Eclipse Public License 2.0"],
    "Cc0": ["This work is licensed under CC0 1.0", "Licensed under CC0 1.0", "This work is dedicated to the public domain under CC0 1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
    "UnlicenseGrant": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"],
    "BsdAsIs": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'],
    "GplFree2b": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "either version 2 of the License, or (at your option) any later version"],
    "GplWarranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "BsdGrant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BsdSource": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "BsdBinary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "BsdEndorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "MplRef2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v"],
    "CcByNc4": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CcBySa4": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CcBy4": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
}
SENTENCES = {normal(s): key for key, forms in _KNOWN.items() for s in forms}
#: In order; each rule's identifiers stand next to each other in a text's sequence.
RULES = [
    ("Apache-2.0", ["ApacheRef2", "ApacheComply", "ApacheCopy", "ApacheAsIs"]), ("Apache-2.0", ["ApacheRef2"]), ("Apache-2.0", ["ApacheComply", "ApacheCopy"]),
    ("MIT", ["MitRef", "MitGrant", "MitNotice", "MitAsIs", "MitLiable"]), ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiable"]), ("MIT", ["MitRef", "MitGrant", "MitNotice", "MitAsIs"]), ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]), ("MIT", ["MitGrant", "MitNotice"]), ("MIT", ["MitRef"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs"]), ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]), ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs"]), ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["GplFree3a", "GplFree3b", "GplWarranty"]), ("GPL-3.0-or-later", ["GplFree3a", "GplFree3b"]), ("GPL-3.0-or-later", ["GplFree3"]), ("GPL-2.0-or-later", ["GplFree3a", "GplFree2b", "GplFree2b", "GplWarranty"]), ("GPL-2.0-or-later", ["GplFree3a", "GplFree2b", "GplFree2b"]),
    ("AGPL-3.0-or-later", ["GplFree3a", "Agpl3b"]), ("AGPL-3.0-or-later", ["Agpl3b"]), ("LGPL-3.0-or-later", ["LgplFree", "Lgpl3b"]), ("LGPL-3.0-or-later", ["GplFree3a", "Lgpl3b"]), ("LGPL-2.1-or-later", ["LgplFree", "LgplTerms21", "Lgpl21Later"]),
    ("LGPL-3.0-only", ["LgplRef3"]), ("AGPL-3.0-only", ["AgplRef3"]), ("EPL-2.0", ["EplTerms2"]), ("ISC", ["IscRef", "IscGrant"]), ("ISC", ["IscGrant"]), ("ISC", ["IscRef"]), ("CC0-1.0", ["Cc0"]), ("Unlicense", ["Unlicense", "UnlicenseGrant"]), ("Unlicense", ["Unlicense"]),
    ("GPL-3.0-only", ["GplRef3"]), ("GPL-2.0-only", ["GplRef2"]), ("MPL-2.0", ["MplRef2"]), ("CC-BY-NC-4.0", ["CcByNc4"]), ("CC-BY-SA-4.0", ["CcBySa4"]), ("CC-BY-4.0", ["CcBy4"]), ("Proprietary", ["AllRights"]),
]
#: Known sentences by their first two words.
_BY_START: dict[tuple[str, ...], list[tuple[list[str], str]]] = {}
for _sentence, _id in SENTENCES.items():
    _BY_START.setdefault(tuple(_sentence.split(" ")[:2]), []).append((_sentence.split(" "), _id))
#: Inside single words, which texts hold unchanged however they are spaced: passages without one hold no known sentence.
_SIGN = re.compile("licen[sc]|reserved|permission|warrant|redistribut|software|copyright|cc0|public")
assert all(_SIGN.search(s) for s in SENTENCES), "every known sentence holds a sign"
MOST = max(s.count(" ") + 1 for s in SENTENCES)


def identifiers(text: str) -> list[str]:
    """The identifiers of the known sentences of a text, in its order."""
    out: list[str] = []
    if not _SIGN.search(text.lower()):
        return out
    for passage in _CUT.split(text):
        if not _SIGN.search(passage.lower()):
            continue
        lines = [w for w in map(line_words, passage.split("\n")) if w != [""] and w]
        if not lines:
            continue
        words = [w for line in lines for w in line]
        ends, at = set(), 0
        starts = []
        for line in lines:
            starts.append(at)
            at += len(line)
            ends.add(at)
        runs = []
        for start in starts:
            for known, name in _BY_START.get(tuple(words[start : start + 2]), ()):
                end = start + len(known)
                if end in ends and words[start:end] == known:
                    runs.append((start, end, name))
        out += [name for start, end, name in sorted(runs) if not any(a <= start and end <= b and (a, b) != (start, end) for a, b, _ in runs)]
    return out


def by_rules(ids: list[str]) -> tuple[list[str], list[str]]:
    """(licences, identifiers that no rule took); None stands where a rule has matched."""
    names: list[str] = []
    for name, seq in RULES:
        k, out = 0, []
        while k < len(ids):
            if ids[k : k + len(seq)] == seq:
                names += [name] if name not in names else []
                out.append(None)
                k += len(seq)
            else:
                out.append(ids[k])
                k += 1
        ids = out
    return names, [x for x in ids if x is not None]


def _found(batches):
    for batch in batches:
        ids = [identifiers(t) if t else [] for t in batch.column(1).to_pylist()]
        rules = [by_rules(i) if i else ([], []) for i in ids]
        columns = [[",".join(n) for n, _ in rules], [",".join(i) for i in ids], [",".join(r) for _, r in rules]]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string()) for c in columns]], names=["id", "licenses", "sentence_ids", "unmatched_ids"])


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses, sentence_ids, unmatched_ids): comma-separated names and identifiers in order of discovery."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_rows(picked, _found, f"id {picked.schema['id'].dataType.simpleString()}, licenses string, sentence_ids string, unmatched_ids string")


def op10_license_sentences(spark, sf_dir: str) -> DataFrame:
    return licences(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


def _sql() -> str:
    """Runs of lines by their numbers, each spelt out and looked up; rules by replacing text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(s)}, {quoted(k)})" for s, k in SENTENCES.items())
    steps, last = [], "r0"
    for k, (name, seq) in enumerate(RULES, 1):
        mark = quoted("".join(f",{x}," for x in seq))
        steps.append(
            f"r{k} AS (SELECT doc_id, ids, replace(rest, {mark}, ',-,') rest, CASE WHEN contains(rest, {mark}) AND NOT list_contains(names, {quoted(name)}) THEN list_append(names, {quoted(name)}) ELSE names END names FROM {last})"
        )
        last = f"r{k}"
    clean = f"regexp_replace(regexp_replace(replace(replace(translate(x, '{_UPPER}', '{_LOWER}'), 'licence', 'license'), 'licencing', 'licensing'), '[^a-z0-9.]+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"
    return rf"""
WITH known(sentence, sid) AS (VALUES {known}),
c AS (SELECT doc_id, regexp_split_to_array(coalesce(text, ''), '{ENDS}') ps FROM documents),
p AS (SELECT doc_id, unnest(ps) passage, generate_subscripts(ps, 1) p FROM c),
l AS (SELECT doc_id, p, list_filter(list_transform(string_split(passage, chr(10)), lambda x: {clean}), lambda x: x <> '') ls FROM p),
i AS (SELECT doc_id, p, ls, unnest(range(1, len(ls) + 1)) a FROM l WHERE len(ls) > 0),
j AS (SELECT doc_id, p, ls, a, unnest(range(a, least(len(ls), a + {MOST} - 1) + 1)) b FROM i),
f AS (SELECT doc_id, p, a, b, sid FROM (SELECT doc_id, p, a, b, array_to_string(ls[a:b], ' ') sentence FROM j) JOIN known USING (sentence)),
g AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.p = f.p AND o.a <= f.a AND o.b >= f.b AND (o.a < f.a OR o.b > f.b))),
q AS (SELECT doc_id, list(sid ORDER BY p, a, b) ids FROM g GROUP BY doc_id),
r0 AS (SELECT d.doc_id, coalesce(array_to_string(ids, ','), '') ids, ',' || coalesce(array_to_string(ids, ',,'), '') || ',' rest, CAST([] AS VARCHAR[]) names FROM documents d LEFT JOIN q USING (doc_id)),
{", ".join(steps)}
SELECT doc_id, array_to_string(names, ',') licenses, ids sentence_ids, array_to_string(list_filter(string_split(rest, ','), lambda x: x NOT IN ('', '-')), ',') unmatched_ids FROM {last}
"""


OP10_SQL = _sql()
