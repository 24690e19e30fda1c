"""License scans by sentence rules.

A text is cut into sentences after ``.``, ``;`` or ``:`` before white space and at lines
without a letter or digit; other line ends are white space, so that hard-wrapped texts
are read whole. Sentences are normalised (lower case, runs of anything but letters, digits
and dots become one space) and looked up in a table of known license sentences. A known
sentence may also begin at any line and end at any line end, so a notice on lines of its
own is found without punctuation about it; it then counts as a sentence. A known sentence
may have slots (``<holder>``) for one to ``SLOT`` words. A sentence that grants under named
licenses ("This software is licensed under the MIT License") is one identifier a name,
and the identifiers of an SPDX expression behind its mark are one each.

A rule is an ordered sequence of sentence identifiers; at each place the longest rule that
matches the identifiers found, unknown sentences apart, wins and its sentences are used up.
At most ``GAP`` unknown sentences may stand between two sentences of a rule. A rule that is
a list of conditions (``LISTS``) matches nothing where the list goes on with a condition
not known: that is another license. Null and empty
texts have no licenses; an empty table gives an empty result; repeated rows are scanned
each; columns other than id and text are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import by_bytes, documents, whole

GAP = 2
#: Words of a slot at most.
SLOT = 12

# Public license sentences by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-law": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": "This program is free software:",
    "gpl3-version": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;",
    "gpl2-version": "either version 2 of the License, or (at your option) any later version.",
    "lgpl-redistribute": "This library is free software:",
    "lgpl21-terms": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;",
    "lgpl21-version": "either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-version": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-name": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-of": "Neither the name of <holder> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-holder": "Neither the name of <holder> nor the names of any contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name-the": "The name of <holder> may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "agpl3-version": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "bsl1-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "mit0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
    "ofl-font": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "wtfpl-do": "You just DO WHAT THE FUCK YOU WANT TO.",
    "gpl-title": "GNU GENERAL PUBLIC LICENSE",
    "lgpl-title": "GNU LESSER GENERAL PUBLIC LICENSE",
    "agpl-title": "GNU AFFERO GENERAL PUBLIC LICENSE",
    "title-v3-june": "Version 3, 29 June 2007",
    "title-v3-november": "Version 3, 19 November 2007",
    "title-v2-june": "Version 2, June 1991",
    "title-v21": "Version 2.1, February 1999",
    "apache-title": "Apache License",
    "apache-title-2": "Version 2.0, January 2004",
    "mpl-title": "Mozilla Public License Version 2.0",
    "mpl-definitions": "Definitions",
    "mpl-contributor": "means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl2-copy-http": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "spdx": "SPDX-License-Identifier:",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc0": "This work is dedicated to the public domain under CC0 1.0.",
}

# Identifiers of SPDX expressions.
SPDX = ("Apache-2.0", "MIT", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "Unlicense", "Zlib", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC0-1.0",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-1.0", "EPL-2.0", "BSL-1.0", "MIT-0", "0BSD", "BSD-4-Clause", "PostgreSQL", "OFL-1.1", "WTFPL", "NCSA", "Artistic-2.0", "CDDL-1.0", "EUPL-1.2", "MS-PL", "Python-2.0", "CC-BY-ND-4.0", "CC-BY-NC-SA-4.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")

# Names of licenses, normalised, without a last "license".
NAMES = {
    "mit": "MIT", "apache license version 2.0": "Apache-2.0", "apache license 2.0": "Apache-2.0", "apache 2.0": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license v2": "GPL-2.0", "gnu general public license version 3": "GPL-3.0", "gnu general public license v3": "GPL-3.0",
    "gnu lesser general public license version 2.1": "LGPL-2.1", "gnu lesser general public license version 3": "LGPL-3.0", "gnu affero general public license version 3": "AGPL-3.0",
    "mozilla public license version 2.0": "MPL-2.0", "mozilla public license 2.0": "MPL-2.0", "eclipse public license version 2.0": "EPL-2.0", "eclipse public license 2.0": "EPL-2.0", "eclipse public license v1.0": "EPL-1.0", "eclipse public license version 1.0": "EPL-1.0",
    "bsd 2 clause": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "isc": "ISC", "zlib": "Zlib", "unlicense": "Unlicense", "boost software license version 1.0": "BSL-1.0",
    "sil open font license version 1.1": "OFL-1.1", "artistic license 2.0": "Artistic-2.0", "postgresql": "PostgreSQL",
    "cc by 4.0": "CC-BY-4.0", "cc by sa 4.0": "CC-BY-SA-4.0", "cc by nc 4.0": "CC-BY-NC-4.0", "cc0 1.0": "CC0-1.0",
    "creative commons attribution 4.0 international": "CC-BY-4.0", "creative commons attribution sharealike 4.0 international": "CC-BY-SA-4.0", "creative commons attribution noncommercial 4.0 international": "CC-BY-NC-4.0",
}

# Ordered rules: license, identifiers.
RULES = (
    *((x, ("spdx", f"spdx-{x}")) for x in SPDX),
    *((x, (f"named-{x}",)) for x in dict.fromkeys(NAMES.values())),
    ("AGPL-3.0", ("gpl-redistribute", "agpl3-version")),
    ("EPL-2.0", ("epl2-available",)),
    ("EPL-1.0", ("epl1-available",)),
    ("BSL-1.0", ("bsl1-grant",)),
    ("MIT-0", ("mit0-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("PostgreSQL", ("postgresql-grant",)),
    ("OFL-1.1", ("ofl-font",)),
    ("WTFPL", ("wtfpl-do",)),
    ("GPL-3.0", ("gpl-title", "title-v3-june")),
    ("GPL-2.0", ("gpl-title", "title-v2-june")),
    ("LGPL-3.0", ("lgpl-title", "title-v3-june")),
    ("LGPL-2.1", ("lgpl-title", "title-v21")),
    ("AGPL-3.0", ("agpl-title", "title-v3-november")),
    ("Apache-2.0", ("apache-title", "apache-title-2")),
    ("MPL-2.0", ("mpl-title", "mpl-definitions", "mpl-contributor")),
    ("GPL-2.0", ("gpl-redistribute", "gpl2-terms", "gpl2-version")),
    ("LGPL-2.1", ("lgpl-redistribute", "lgpl21-terms", "lgpl21-version")),
    ("LGPL-3.0", ("lgpl-redistribute", "lgpl3-version")),
    ("LGPL-3.0", ("gpl-redistribute", "lgpl3-version")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-form", "mpl2-copy-http")),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-free", "unlicense-use")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Apache-2.0", ("apache-grant", "apache-use", "apache-copy", "apache-law")),
    ("Apache-2.0", ("apache-grant", "apache-use")),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-short-2",)),
    ("GPL-3.0", ("gpl-redistribute", "gpl3-version", "gpl-warranty")),
    ("GPL-3.0", ("gpl3-short",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    *(("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", x)) for x in ("bsd-name-of", "bsd-name-holder", "bsd-name-the")),
    *(("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", x)) for x in ("bsd-name", "bsd-name-of", "bsd-name-holder", "bsd-name-the")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC0-1.0", ("cc0",)),
)

#: Rules that are lists of conditions: the last one's identifier.
LISTS = {"BSD-2-Clause": "bsd-binary"}

_CUT = re.compile(r"(?<=[.;:])\s+")
#: A list mark before a sentence; those that end in a dot are cut off as it is.
_MARK = re.compile(r"[^\w(]*\(?(?:\d{1,2}|[a-z]|[ivx]{1,4})\)\s+", re.I)
_BARE = re.compile(r"\d{1,2}|[a-z]|[ivx]{1,4}")
_CONDITION = ("neither the name", "the name of", "the names of", "all advertising", "redistributions")
_OTHER = re.compile(r"[^\w.]+|_+")
_SLOT = re.compile(r"<[a-z]+>")
_EXPRESSION = re.compile(r"SPDX-License-Identifier:\s*(.*)", re.I)
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.\-]*\+?")
_GRANT = re.compile(r"(?:(?:this|the|these|all)(?: \S+){1,5} (?:is|are) (?:made )?)?(?:licensed|released|distributed|available) under (?:the terms (?:and conditions )?of )?(?:the )?")
_OPENS = {"this", "the", "these", "all", "licensed", "released", "distributed"}
_SPDX = {x.lower(): x for x in SPDX}
_LONGEST = max(len(x.split()) for x in NAMES)


def normalise(sentence: str) -> str:
    return _OTHER.sub(" ", sentence.lower()).strip(" .")


def _tables(sentences: dict[str, str], rules) -> tuple[dict[str, list], dict[str, list]]:
    """Known sentences by first word, long ones first, as text, name, and for those with
    slots their pattern, beginning and most words; rules by first identifier."""
    known: dict[str, list] = {}
    for name, text in sorted(sentences.items(), key=lambda x: -len(normalise(x[1]))):
        pieces = [normalise(x) for x in _SLOT.split(text)]
        whole_one, slots = " ".join(pieces), None
        if len(pieces) > 1:
            slots = re.compile(rf"(?: \S+){{1,{SLOT}}}? ".join(map(re.escape, pieces))), pieces[0], len(whole_one.split()) + SLOT * (len(pieces) - 1)
        known.setdefault(whole_one.split(" ", 1)[0], []).append((whole_one, name, slots))
    first: dict[str, list] = {}
    for license_id, ids in sorted(rules, key=lambda r: -len(r[1])):
        first.setdefault(ids[0], []).append((license_id, ids))
    return known, first


def spdx_identifiers(expression: str) -> tuple[list[str], int]:
    """Known identifiers of the SPDX expression at the start of a text, and where it ends:
    operands joined by AND or OR, in parentheses or not, an operand with WITH and an
    exception, ``+`` for later versions. The expression ends at the first word that
    does not fit."""
    out: list[str] = []
    end, seen, want, exception = 0, 0, True, False
    for m in _TOKEN.finditer(expression):
        token = m[0]
        if expression[seen : m.start()].strip():
            break
        seen = m.end()
        if token in "()":
            if want != (token == "("):
                break
        elif exception:
            want = exception = False
        elif want:
            plain = token.rstrip(".").lower()
            later = plain.removesuffix("+")
            name = _SPDX.get(plain) or (_SPDX.get(later + "-or-later") or _SPDX.get(later) if later != plain else None)
            if not name and not plain.startswith(("licenseref-", "documentref-")):
                break
            out += [name] if name else []
            want = False
        elif token.upper() in ("AND", "OR"):
            want = True
            continue  # it counts only before an operand
        elif token.upper() == "WITH":
            want = exception = True
            continue
        else:
            break
        end = m.end()
    return out, end


def _granted(sentence: str) -> list[str]:
    """Licenses that a normalised sentence grants by name."""
    m = _GRANT.match(sentence)
    out: list[str] = []
    rest = sentence[m.end() :].split()[: 4 * _LONGEST] if m else []
    while rest:
        for k in range(min(_LONGEST, len(rest)), 0, -1):
            name = NAMES.get(" ".join(rest[:k]))
            if name:
                break
        else:
            break
        out.append(name)
        rest = rest[k:]
        if rest and rest[0] in ("license", "licence"):
            rest = rest[1:]
        if not rest or rest[0] not in ("or", "and"):
            break
        rest = rest[2:] if rest[1:2] == ["the"] else rest[1:]
    return out


def _parts(text: str) -> list[tuple[str, bool, bool | tuple]]:
    """Normalised parts of a text, cut at line ends too; whether a sentence ends there;
    whether a list mark stood before it, or the identifiers of an SPDX expression."""
    out: list[tuple[str, bool, bool | tuple]] = []
    for line in text.split("\n"):
        line = line.rstrip()
        spdx = _EXPRESSION.search(line) if "dentifier:" in line else None
        if spdx:
            names, end = spdx_identifiers(spdx[1])
            if names:
                before = normalise(line[: spdx.start()])
                out += [(before, True, False)] if before else []
                out.append(("spdx license identifier", True, tuple(names)))
                line = line[spdx.start(1) + end :]
        marked = _MARK.match(line)
        parts = [normalise(x) for x in _CUT.split(line[marked.end() :] if marked else line)]
        if not any(parts):
            if out and not spdx:
                out[-1] = (out[-1][0], True, out[-1][2])
            continue
        ends = [True] * (len(parts) - 1) + [line[-1] in ".;:"]
        out += [(x, e, bool(marked) and i == 0) for i, (x, e) in enumerate(zip(parts, ends, strict=True)) if x]
    return out


def _slotted(parts, i: int, slots) -> int:
    """The part after the sentence with slots that begins with part ``i``, or 0. A dot in a
    slot ("Inc.") ends no sentence."""
    pattern, begins, most = slots
    so_far, j = parts[i][0], i
    while True:
        if pattern.fullmatch(so_far):
            return j + 1
        within = so_far.startswith(begins + " ") or so_far == begins
        if j + 1 >= len(parts) or so_far.count(" ") > most or not (within or begins.startswith(so_far + " ") and not parts[j][1]):
            return 0
        j += 1
        so_far += " " + parts[j][0]


def _known_at(parts, i: int, known: dict[str, list]) -> tuple[list[str], int]:
    """Identifiers of the longest known sentence that begins with part ``i``, and the part
    after it."""
    if isinstance(parts[i][2], tuple):
        return [x for name in parts[i][2] for x in ("spdx", f"spdx-{name}")], i + 1
    word = parts[i][0].split(" ", 1)[0]
    for sentence, name, slots in known.get(word, ()):
        if slots:
            after = _slotted(parts, i, slots)
            if after:
                return [name], after
            continue
        so_far, j = parts[i][0], i
        while sentence.startswith(so_far + " ") and not parts[j][1] and j + 1 < len(parts):
            j += 1
            so_far += " " + parts[j][0]
        if so_far == sentence:
            return [name], j + 1
    if word in _OPENS:
        so_far, j = parts[i][0], i
        while not parts[j][1] and j + 1 < len(parts) and so_far.count(" ") < 4 * _LONGEST:
            j += 1
            so_far += " " + parts[j][0]
        names = _granted(so_far) if "under " in so_far else []
        if names:
            return [f"named-{x}" for x in names], j + 1
    return [], i + 1


def scan(text: str, known: dict[str, list], first: dict[str, list], gap: int = GAP) -> list[tuple[str, int, int]]:
    """``(license, first sentence, last sentence)`` of the matches, in text order."""
    found = []  # (place, identifier, part after it)
    parts, part, at, within = _parts(text), 0, 0, False
    while part < len(parts):
        names, after = _known_at(parts, part, known)
        if names:
            at += within  # an unknown sentence ends before a known one
            for k, name in enumerate(names):  # an SPDX mark and its identifier are two sentences
                found.append((at, name, after))
                at += name == "spdx" or name.startswith("spdx-") and k + 1 < len(names)
        within = not (names or parts[part][1])
        at += not within
        part = after

    def goes_on(last) -> bool:
        """Whether a condition that is not known follows."""
        j, marked = last[2], False
        if j < len(parts) and _BARE.fullmatch(parts[j][0]):
            j, marked = j + 1, True
        if j >= len(parts) or _known_at(parts, j, known)[0]:
            return False
        return marked or parts[j][2] is True or parts[j][0].startswith(_CONDITION)

    out, i = [], 0
    while i < len(found):
        for license_id, ids in first.get(found[i][1], ()):
            span = found[i : i + len(ids)]
            most = 0 if ids[0] == "spdx" else gap  # the mark and its identifier stand together
            if [x[1] for x in span] == list(ids) and all(b[0] - a[0] - 1 <= most for a, b in zip(span, span[1:])):
                if LISTS.get(license_id) == ids[-1] and goes_on(span[-1]):
                    continue
                out.append((license_id, span[0][0], span[-1][0]))
                i += len(ids)
                break
        else:
            i += 1
    return out


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """``doc_id, licenses`` (distinct, sorted), ``n_matches, spans`` (sentence numbers),
    a row per input row; no shuffle."""
    kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        known, first = _tables(sentences, rules)
        for b in by_bytes(batches):
            found = [scan(t, known, first) for t in b.column(1).to_pylist()]
            spans = [[{"license": x, "first": i, "last": j} for x, i, j in f] for f in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted({x for x, _, _ in f}) for f in found], pa.list_(pa.string())), pa.array(map(len, found), pa.int64()), pa.array(spans, kind)], ["doc_id", "licenses", "n_matches", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), whole(text_col).alias("text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)[id_col]}, licenses array<string>, n_matches long, spans array<struct<license:string,first:long,last:long>>")


def op10(spark, sf_dir):
    return license_scan(documents(spark, sf_dir))
