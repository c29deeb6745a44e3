"""License scans by sentence rules.

A text is cut into sentences: at sentence ends, at line ends, and again with the lines of a paragraph joined, since
notices are wrapped. A sentence is normalised (case, comment marks, punctuation, spaces) and looked up among the known
sentences of licences, which gives its identifier; sentences with free parts are known by a pattern, and those that name
licences in other words (a verb, names, versions, "or later", "or") by a small grammar. The identifiers in
the order of the text are then matched against ordered rules: the first rule whose sequence is found names a licence and
uses its sentences up, until no rule fits. An SPDX line is read as it is written: each licence of its expression is
named, deprecated names by their successors. Of alternatives (OR) the mildest kind counts, of joint ones (AND) the
strictest; parentheses are read over. The kind of a name that is not known is `unknown`.

Defined results: a null or empty text has no sentences and no licences. Repeated sentences count once per place. A
sentence that speaks of a licence but is not known is counted in n_unknown. Rows that repeat are read apart; a null
doc_id is kept. An empty table gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Sentences of public licences and of their usual notices, by identifier.
SENTENCES = {
    "all-rights": ["All rights reserved."],
    "mit-title": ["The MIT License", "MIT License", "The MIT License (MIT)"],
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "This software is released under the MIT License.", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "mit-grant": [
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
    ],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-asis": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "isc-asis": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd-ref": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD License.", "Released under the BSD License."],
    "apache-ref": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License");', "Released under the Apache License, Version 2.0.", "This project is licensed under the Apache License, Version 2.0."],
    "apache-terms": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-asis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "This program is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License, version 3."],
    "gpl2-ref": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Released under the GNU General Public License, version 2."],
    "gpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-title": ["GNU GENERAL PUBLIC LICENSE"],
    "lgpl-title": ["GNU LESSER GENERAL PUBLIC LICENSE"],
    "agpl-title": ["GNU AFFERO GENERAL PUBLIC LICENSE"],
    "june-2007": ["Version 3, 29 June 2007"],
    "june-1991": ["Version 2, June 1991"],
    "february-1999": ["Version 2.1, February 1999"],
    "november-2007": ["Version 3, 19 November 2007"],
    "fsf-verbatim": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."],
    "gpl3-preamble": ["The GNU General Public License is a free, copyleft license for software and other kinds of works."],
    "gpl2-preamble": ["The licenses for most software are designed to take away your freedom to share and change it."],
    "lgpl3-terms": ["This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."],
    "lgpl3-ref": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is licensed under the GNU Lesser General Public License, version 3.", "Released under the GNU Lesser General Public License, version 3."],
    "lgpl21-ref": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU Lesser General Public License, version 2.1."],
    "lgpl3-later": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl3-ref": ["Licensed under the GNU Affero General Public License, version 3.", "This program is licensed under the GNU Affero General Public License, version 3."],
    "apache-title": ["Apache License"],
    "january-2004": ["Version 2.0, January 2004"],
    "apache-url": ["http://www.apache.org/licenses/", "https://www.apache.org/licenses/"],
    "apache-heading": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-meaning": ['"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.'],
    "mpl-title": ["Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"],
    "mpl-ref": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "epl1-title": ["Eclipse Public License - v 1.0"],
    "epl2-title": ["Eclipse Public License - v 2.0"],
    "epl-terms": ['THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT").'],
    "epl-accept": ["ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT'S ACCEPTANCE OF THIS AGREEMENT."],
    "epl2-ref": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Licensed under the Eclipse Public License, version 2.0.", "Licensed under the Eclipse Public License 2.0."],
    "zlib-asis": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-damages": ["In no event will the authors be held liable for any damages arising from the use of this software."],
    "boost-ref": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc0-ref": ["Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}
#: Sentences with free parts, over the normalised form.
PATTERNS = [
    ("cc", re.compile(r"(?:(?:this work|content|text|this article) is )?(?:licensed|released|available) under (?:a |the )?(?:cc|creative commons) ?(?P<name>(?:by|attribution)[a-z ]*)(?P<version>[0-9.]+)?(?: [a-z]+)*(?: license)?")),
    ("copyright", re.compile(r"copyright (?:c )?[0-9 ]*[0-9]{4}.*")),
    # holders are free
    ("bsd-names", re.compile(r"(?:[0-9.]+ )?neither the names? of .{1,120}? nor the names of (?:its|their|any|the)(?: of its)? contributors may be used to endorse or promote products derived from this software without (?:specific )?prior written permission")),
    ("isc-asis", re.compile(r"the software is provided as is and .{1,80}? disclaims? all warranties with regard to this software including all implied warranties of merchantability and fitness")),
]
#: How notices name licences: (its words, SPDX name, version if none is told, whether GNU's "or later" is in its name).
NAMES = [
    (r"(?:gnu )?(?:affero (?:gnu )?(?:general )?public licen[sc]e|agpl)", "AGPL", "3.0", True), (r"(?:gnu )?(?:lesser|library) (?:gnu )?(?:general )?public licen[sc]e|(?:gnu )?lgpl", "LGPL", "3.0", True), (r"gnu (?:general )?public licen[sc]e|general public licen[sc]e|gnu gpl|gpl", "GPL", "3.0", True),
    (r"apache(?: software)?(?: public)?(?: licen[sc]e)?|asl", "Apache", "2.0", False), (r"(?:the )?(?:mit x11|mit expat|mit|expat|x11)(?: style)?", "MIT", "", False), (r"isc", "ISC", "", False), (r"(?:2 clause bsd|bsd 2 clause|simplified bsd|freebsd)", "BSD-2-Clause", "", False),
    (r"(?:3 clause bsd|bsd 3 clause|new bsd|modified bsd|revised bsd)", "BSD-3-Clause", "", False), (r"(?:0bsd|bsd 0 clause|zero clause bsd)", "0BSD", "", False), (r"bsd(?: style)?", "BSD", "", False), (r"mozilla public licen[sc]e|mpl", "MPL", "2.0", False), (r"eclipse public licen[sc]e|epl", "EPL", "2.0", False),
    (r"boost(?: software)?(?: licen[sc]e)?|bsl", "BSL", "1.0", False), (r"zlib(?: libpng)?", "Zlib", "", False), (r"unlicense", "Unlicense", "", False), (r"creative commons (?:zero|cc0)|cc0", "CC0", "1.0", False), (r"do what the fuck you want to public licen[sc]e|wtfpl", "WTFPL", "", False),
    (r"artistic licen[sc]e", "Artistic", "2.0", False), (r"postgresql", "PostgreSQL", "", False), (r"(?:python software foundation|psf)", "PSF", "2.0", False), (r"european union public licen[sc]e|eupl", "EUPL", "1.2", False), (r"common development and distribution licen[sc]e|cddl", "CDDL", "1.0", False),
]
_NAMED = re.compile("|".join(f"(?P<n{i}>{words})" for i, (words, *_) in enumerate(NAMES)))
#: What leads to a name (after it come "license", a version and what may be later), and what joins two of them.
_LEADS = re.compile(r"(?:licen[sc]ed|released|distributed|redistributed?|available|published|provided|covered|governed|modif(?:y|ied)|subject|use|used)(?: [a-z]+){0,5}? (?:under|by|to)(?: (?:the|a|an|either|both|one|terms?|and|conditions?|of|same|dual|which|license)\b)*(?: |$)|^(?:[a-z]+ ){0,4}licen[sc]e (?:is )?(?:the )?|^")
_VERSION = re.compile(r"(?: ?licen[sc]es?)?(?: ?(?:version |v\.? ?|ver\.? )?(?P<v>[0-9]+(?:\.[0-9]+)*))?(?P<later>\+| or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?(?: at your option)?)?(?: ?licen[sc]es?)?(?: only)?")
_JOINS = re.compile(r" (?:(?P<or>or|and or)|and)(?: (?:the|a|an|under))* ")
_PERL = re.compile(r"(?:under the )?same terms as (?:the )?perl(?: ?5)?(?: programming language system)?(?: itself)?")


def referred(sentence: str) -> str | None:
    """The SPDX expression of a normalised sentence that names licences in its own words: a lead and names, or names and `licensed`."""
    if _PERL.search(sentence):
        return "Artistic-1.0-Perl OR GPL-1.0-or-later"
    for lead in _LEADS.finditer(sentence):
        at, told = lead.end(), ""
        while (name := _NAMED.match(sentence, at)) and (name.end() == len(sentence) or not sentence[name.end()].isalpha() or sentence[name.end()] == "v"):
            words, spdx, default, gnu = NAMES[int(name.lastgroup[1:])]
            version = _VERSION.match(sentence, name.end())
            number, later = version["v"] or "", bool(version["later"])
            if default:
                number = number or default
                spdx += f"-{number if '.' in number else number + '.0'}"
            elif number and spdx.startswith("BSD"):
                spdx = "BSD"
            told += spdx + (("-or-later" if later else "-only") if gnu else "+" if later and default else "")
            join = _JOINS.match(sentence, version.end())
            after = sentence[version.end() :]
            at = join.end() if join else len(sentence)
            if not join or not _NAMED.match(sentence, at):
                # a name alone is no notice: a verb leads to it, or `licensed` follows, or the sentence ends after `license`
                if lead.group() or re.match(r" ?(?:licen[sc]ed|at your option)", after) or (not after.strip() and re.search(r"licen[sc]e", version.group() + name.group())):
                    return told
                break
            told += " OR " if join["or"] else " AND "
    if short := re.fullmatch(r"(?:[a-z]+ ){0,4}(?:is|are|code) (?P<name>.+?) licen[sc]ed", sentence):
        return referred(f"licensed under {short['name']}")
    return None


#: Ordered rules: a licence, the identifiers that must follow one another (a trailing ? may lack), the kind of its terms.
RULES = [
    ("MIT", ["mit-title?", "copyright?", "all-rights?", "mit-grant", "mit-notice", "mit-asis?"], "permissive"),
    ("ISC", ["copyright?", "isc-grant", "isc-asis?"], "permissive"),
    ("BSD-3-Clause", ["copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], "permissive"),
    ("BSD-2-Clause", ["copyright?", "all-rights?", "bsd-grant", "bsd-source", "bsd-binary"], "permissive"),
    ("Apache-2.0", ["copyright?", "apache-ref", "apache-terms?", "apache-copy?", "apache-asis?"], "permissive"),
    ("Apache-2.0", ["apache-title", "january-2004", "apache-url?", "apache-heading?", "apache-meaning?"], "permissive"),
    ("AGPL-3.0-only", ["agpl-title", "november-2007", "copyright?", "fsf-verbatim?"], "copyleft"),
    ("LGPL-3.0-only", ["lgpl-title", "june-2007", "copyright?", "fsf-verbatim?", "lgpl3-terms?"], "copyleft"),
    ("LGPL-2.1-only", ["lgpl-title", "february-1999", "copyright?", "fsf-verbatim?", "gpl2-preamble?"], "copyleft"),
    ("GPL-3.0-only", ["gpl-title", "june-2007", "copyright?", "fsf-verbatim?", "gpl3-preamble?"], "copyleft"),
    ("GPL-2.0-only", ["gpl-title", "june-1991", "copyright?", "fsf-verbatim?", "gpl2-preamble?"], "copyleft"),
    ("AGPL-3.0-or-later", ["copyright?", "agpl3-later", "gpl-hope?"], "copyleft"),
    ("LGPL-3.0-or-later", ["copyright?", "lgpl3-later", "gpl-hope?"], "copyleft"),
    ("LGPL-2.1-or-later", ["copyright?", "lgpl21-later", "gpl-hope?"], "copyleft"),
    ("GPL-3.0-or-later", ["copyright?", "gpl3-later", "gpl-hope?"], "copyleft"),
    ("GPL-2.0-or-later", ["copyright?", "gpl2-later", "gpl-hope?"], "copyleft"),
    ("AGPL-3.0-only", ["copyright?", "agpl3-ref"], "copyleft"),
    ("LGPL-3.0-only", ["copyright?", "lgpl3-ref"], "copyleft"),
    ("LGPL-2.1-only", ["copyright?", "lgpl21-ref"], "copyleft"),
    ("GPL-3.0-only", ["copyright?", "gpl3-ref"], "copyleft"),
    ("GPL-2.0-only", ["copyright?", "gpl2-ref"], "copyleft"),
    ("MPL-2.0", ["copyright?", "mpl-title?", "mpl-ref", "mpl-copy?"], "copyleft"),
    ("MPL-2.0", ["mpl-title"], "copyleft"),
    ("EPL-2.0", ["epl2-title", "epl-terms?", "epl-accept?"], "copyleft"),
    ("EPL-1.0", ["epl1-title", "epl-terms?", "epl-accept?"], "copyleft"),
    ("EPL-2.0", ["copyright?", "epl2-ref"], "copyleft"),
    ("Zlib", ["copyright?", "zlib-asis", "zlib-damages"], "permissive"),
    ("BSL-1.0", ["copyright?", "boost-ref"], "permissive"),
    ("Unlicense", ["unlicense"], "permissive"),
    ("CC0-1.0", ["cc0-ref"], "permissive"),
    ("MIT", ["mit-ref"], "permissive"),
    ("MIT", ["mit-title"], "permissive"),
    ("BSD", ["bsd-ref"], "permissive"),
    ("Proprietary", ["copyright?", "all-rights"], "restricted"),
]
#: Beginnings of SPDX names by the kind of their terms, tried in this order, and what they mean in the words of Creative Commons.
FAMILIES = (
    ("restricted", ("cc-by-nc", "cc-by-nd", "proprietary", "busl-", "sspl-", "elastic-")),
    ("copyleft", ("gpl-", "lgpl-", "agpl-", "mpl-", "epl-", "cddl-", "eupl-", "osl-", "cc-by-sa", "ms-rl", "cpl-", "qpl-", "sleepycat", "ofl-")),
    ("permissive", ("mit", "isc", "0bsd", "bsd-", "apache-", "zlib", "libpng", "bsl-", "unlicense", "cc0-", "cc-by-", "wtfpl", "python-", "psf-", "postgresql", "ncsa", "artistic-", "x11", "curl", "unicode-", "afl-", "ecl-", "upl-", "blueoak-", "ms-pl", "ftl", "ijg", "hpnd", "tcl", "ruby")),
)
CREATIVE = {"attribution": "BY", "by": "BY", "noncommercial": "NC", "nc": "NC", "noderivatives": "ND", "noderivs": "ND", "nd": "ND", "sharealike": "SA", "sa": "SA"}
STRICTNESS = ("permissive", "unknown", "copyleft", "restricted")
_NAME = r"[()]*[A-Za-z0-9][A-Za-z0-9.+:_-]*[()]*"
SPDX = re.compile(rf"SPDX-License-Identifier:[ \t]*({_NAME}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_NAME})*)", re.IGNORECASE)
SPEAKS = re.compile(r"licen[sc]|same terms as perl|neither the names? of|\b[al]?gpl|wtfpl|copyright|rights reserved|spdx|warranty|redistribut|public domain|permission is hereby|permission to use|\bas is\b|unless required|above copyright|creative commons|under cc")
_MARKS = re.compile(r"^[\s/*#;>|.-]+|[\s/*#|-]+$")
_GAPS = re.compile(r"[^a-z0-9.+]+")
_ENDS = re.compile(r"(?<=[.;:!?])(?<!dentifier:)(?<!icense:)(?<!icence:)\s+")


def normalised(sentence: str) -> str:
    plain = _GAPS.sub(" ", sentence.lower())
    return " ".join(w.strip(".") for w in plain.split() if w.strip("."))


_KNOWN = {normalised(s): name for name, group in SENTENCES.items() for s in group}
#: How known sentences begin; a line may break after one or two words.
_OPENINGS = {" ".join(k.split()[:n]) for k in _KNOWN for n in (1, 2, 3)}
_LONGEST = max(len(k.split()) for k in _KNOWN)


def identified(sentence: str) -> str | None:
    """The identifier of a normalised sentence; for patterns with its free part after a colon."""
    if (name := _KNOWN.get(sentence)) is not None:
        return name
    for name, pattern in PATTERNS:
        if m := pattern.fullmatch(sentence):
            parts = {k: v for k, v in m.groupdict().items() if v}
            return f"{name}:{' '.join(x.strip() for x in parts.values())}" if parts else name
    return None


def _paragraphs(text: str) -> Iterator[list[tuple[int, str, str | None]]]:
    """Runs of lines with words: (line, normalised part, SPDX expression or None) of each part of a sentence in them."""
    held: list[tuple[int, str, str | None]] = []
    for i, line in enumerate(text.split("\n")):
        if spdx := SPDX.search(line):
            held.append((i, normalised(line), spdx[1]))
            continue
        parts = [(i, plain, None) for x in _ENDS.split(_MARKS.sub("", line)) if (plain := normalised(x))]
        if not parts and held:
            yield held
            held = []
        held += parts
    yield held


def sentences(text: str) -> list[tuple[int, str, str | None]]:
    """(line, normalised sentence, identifier or None) of all that speaks of a licence, in the order of the text."""
    found: list[tuple[int, str, str | None]] = []
    for parts in _paragraphs(text):
        at = 0
        while at < len(parts):
            line, plain, spdx = parts[at]
            name = f"spdx:{spdx}" if spdx else identified(plain) if plain in _KNOWN or SPEAKS.search(plain) else None
            end = at + 1
            if name is None and " ".join(plain.split()[:3]) in _OPENINGS:
                # perhaps wrapped, or with a semicolon inside: join parts until they are a known sentence
                joined = plain
                while end < len(parts) and parts[end][2] is None and len(joined.split()) < _LONGEST:
                    joined, end = f"{joined} {parts[end][1]}", end + 1
                    if name := _KNOWN.get(joined):
                        plain = joined
                        break
                else:
                    end = at + 1
            if name is None and len(plain) <= 300 and SPEAKS.search(plain) and (expression := referred(plain)):
                name = f"named:{expression}"
            if name is not None or SPEAKS.search(plain):
                found.append((line, plain, name))
            at = end
    return found


def _match(rule: list[str], names: list[str], start: int) -> int:
    """Where the rule's sequence that begins at start ends, or -1."""
    at, used = start, 0
    for want in rule:
        optional = want.endswith("?")
        if at < len(names) and names[at].split(":")[0] == want.rstrip("?"):
            at, used = at + 1, used + 1
        elif not optional:
            return -1
    return at if used else -1


def kind_of(name: str) -> str:
    return next((kind for kind, beginnings in FAMILIES if name.lower().startswith(beginnings)), "unknown")


def of_expression(expression: str) -> list[tuple[str, str]]:
    """(licence, kind) of each name in an SPDX expression; the name after WITH is an exception, not a licence."""
    found: list[tuple[str, str]] = []
    kinds = []
    for alternative in re.split(r"\s+OR\s+", re.sub("[()]", "", expression), flags=re.IGNORECASE):
        names = [re.split(r"\s+WITH\s+", x, flags=re.IGNORECASE)[0] for x in re.split(r"\s+AND\s+", alternative, flags=re.IGNORECASE)]
        names = [re.sub(r"(?i)^(A?GPL|LGPL)-([0-9.]+)(\+?)$", lambda m: f"{m[1].upper()}-{m[2]}-{'or-later' if m[3] else 'only'}", x) for x in names]
        kinds.append(max(map(kind_of, names), key=STRICTNESS.index))
        found += [(x, "") for x in names]
    mildest = min(kinds, key=STRICTNESS.index)
    return [(x, mildest) for x, _ in found]


def recognised(names: list[str]) -> list[tuple[str, str]]:
    """(licence, kind) in the order of the text. Copyright lines alone name none."""
    left = list(names)
    found: list[tuple[int, str, str]] = []
    for licence, rule, kind in RULES:
        at = 0
        while at < len(left):
            end = _match(rule, left, at)
            if end > at:
                found.append((at, licence, kind))
                left[at:end] = [""] * (end - at)
                at = end
            else:
                at += 1
    for at, name in enumerate(left):
        head, _, rest = name.partition(":")
        if head in ("spdx", "named"):
            found += [(at, *x) for x in of_expression(rest)]
        elif head == "cc":
            words = [CREATIVE.get(x, x.upper()) for x in rest.split()]
            licence = "CC-" + "-".join(words)
            found.append((at, licence, kind_of(licence if len(words) > 1 else f"{licence}-")))
    return [(licence, kind) for _, licence, kind in sorted(found, key=lambda x: x[0])]


def body_sentences(text: str) -> set[str]:
    """The normalised sentences of six words or more of a text whose lines are joined within paragraphs."""
    whole = (normalised(x) for part in re.split(r"\n[\s/*#;>|.-]*\n", text) for x in _ENDS.split(" ".join(_MARKS.sub("", line) for line in part.split("\n"))))
    return {x for x in whole if x.count(" ") > 4}


def of_bodies(text: str, bodies: dict[str, set[str]], least: float = 0.5) -> list[str]:
    """Of full licence texts those of which a text has such a share of sentences that no better one has used up."""
    own, found = body_sentences(text), []
    while True:
        share, name = max(((len(own & body) / len(body), name) for name, body in bodies.items() if body), default=(0.0, ""))
        if share < least:
            return found
        found.append(name)
        own -= bodies[name]


def scanned(text: str, bodies: dict[str, set[str]] | None = None) -> tuple[list[str], str, list[dict], int]:
    low = text.lower()
    if not SPEAKS.search(low) and not ("\n" in low and SPEAKS.search(_GAPS.sub(" ", low))):  # words may be wrapped
        return [], "none", [], 0
    found = sentences(text)
    known = [(line, name) for line, _, name in found if name]
    licences = recognised([n for _, n in known])
    if bodies and len(found) > 5:
        licences += [(name, kind_of(name)) for name in of_bodies(text, bodies) if all(name != x for x, _ in licences)]
    kinds = {k for _, k in licences}
    verdict = next((k for k in reversed(STRICTNESS) if k in kinds), "none")
    return list(dict.fromkeys(n for n, _ in licences)), verdict, [{"line": a, "sentence": b} for a, b in known], sum(n is None for _, _, n in found)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """texts: full texts of licences by SPDX name, known by half of their sentences. Returns doc_id, licenses (in the order of the text), verdict (the strictest kind: restricted, copyleft, unknown, permissive or none), sentences (line, identifier), n_unknown."""
    found_type = pa.list_(pa.struct([("line", pa.int64()), ("sentence", pa.string())]))
    kinds = [("licenses", pa.list_(pa.string())), ("verdict", pa.string()), ("sentences", found_type), ("n_unknown", pa.int64())]

    bodies = {name: body_sentences(text) for name, text in (texts or {}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            found = [scanned(x.as_py() or "", bodies) for x in batch.column("text")]
            columns = zip(*found, strict=True) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(list(c), kind) for c, (_, kind) in zip(columns, kinds, strict=True))], names=["doc_id", *(n for n, _ in kinds)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, licenses array<string>, verdict string, sentences array<struct<line: bigint, sentence: string>>, n_unknown long")
