"""Licences named in other words than those of the module's sentences, held out of it; full texts; documents without any."""

import pathlib
import time

import pytest

from tidemark.llm.licenses import body_sentences, license_scan, scanned

HELD_OUT = {
    "Licensed under Apache 2.0": ["Apache-2.0"],
    "Licensed under GPLv3": ["GPL-3.0-only"],
    "This code is MIT licensed.": ["MIT"],
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ["Apache-2.0", "MIT"],
    "# This library is distributed under the terms of the GNU LGPL v2.1 or later.": ["LGPL-2.1-or-later"],
    "License: MIT": ["MIT"],
    "Released under the 3-clause BSD license.": ["BSD-3-Clause"],
    "Dual licensed under the MIT and GPL licenses.": ["MIT", "GPL-3.0-only"],
    "This module is free software; you can redistribute it and/or modify it under the same terms as Perl itself.": ["Artistic-1.0-Perl", "GPL-1.0-or-later"],
    "Distributed under the WTFPL.": ["WTFPL"],
    "This file is part of Foo, released under GPL-2.0+": ["GPL-2.0-or-later"],
    "// This program is licensed under the AGPLv3.": ["AGPL-3.0-only"],
    "Available under the ISC license": ["ISC"],
    "Code is BSD licensed": ["BSD"],
    "licensed under CC0": ["CC0-1.0"],
    "You may use this under the Apache-2.0 license": ["Apache-2.0"],
    "Licensed under GPL version 2 or any later version": ["GPL-2.0-or-later"],
    "This software is covered by the Mozilla Public License 2.0.": ["MPL-2.0"],
    "The source is made available under the Boost Software License 1.0": ["BSL-1.0"],
    "All of this is published under the PostgreSQL License.": ["PostgreSQL"],
    "It is distributed under the simplified BSD license, see COPYING.": ["BSD-2-Clause"],
    "Subject to the terms of the Eclipse Public License v2.0.": ["EPL-2.0"],
    "Licence: GPL-3.0 or later": ["GPL-3.0-or-later"],
    "The plugin is released to you under the zlib license.": ["Zlib"],
}
CLEAN = [
    "The licence was revoked by the mayor.", "A driving license is used by the agency to mit people.", "They released the report under apache leaders", "He was released by mit students", "A fishing license or permit is available under the bridge.", "Licensed under a commercial agreement",
    "The artistic director was licensed by the city.", "Boost your sales under license from the brand.", "The general public is licensed to fish.", "New BSD meetings are governed by the chair.",
]


def test_notices_held_out():
    right = {t: scanned(t)[0] for t in HELD_OUT}
    assert sum(right[t] == want for t, want in HELD_OUT.items()) >= 0.9 * len(HELD_OUT), {t: x for t, x in right.items() if x != HELD_OUT[t]}
    assert {t: scanned(t)[0] for t in CLEAN if scanned(t)[0]} == {}


def test_holders_are_free():
    names = "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    bsd += "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    assert scanned(bsd + "3. " + names)[0] == ["BSD-3-Clause"] and scanned(bsd)[0] == ["BSD-2-Clause"]


def test_full_texts_by_their_sentences(spark):
    made = {"X-1.0": "\n\n".join(f"Sentence number {i} of the license X grants the reader of it the right number {i}." for i in range(30)), "Y-1.0": "\n\n".join(f"Under this license the holder {i} warrants\nnothing at all to anybody else of group {i}." for i in range(30))}
    rows = [(1, made["X-1.0"]), (2, made["Y-1.0"].replace("\n", "\n# ")), (3, "\n\n".join(made["X-1.0"].split("\n\n")[:10])), (4, made["X-1.0"] + "\n\n" + made["Y-1.0"]), (5, None)]
    got = {r.doc_id: r.licenses for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string"), texts=made).collect()}
    assert got[1] == ["X-1.0"] and got[2] == ["Y-1.0"] and got[3] == [] and sorted(got[4]) == ["X-1.0", "Y-1.0"] and got[5] == []


@pytest.mark.skipif(not pathlib.Path("/usr/share/common-licenses/GPL-3").exists(), reason="this machine has no licence texts")
def test_full_texts_of_this_machine():
    folder = pathlib.Path("/usr/share/common-licenses")
    texts = {n: (folder / f).read_text() for n, f in (("GPL-3.0-only", "GPL-3"), ("GPL-2.0-only", "GPL-2"), ("LGPL-2.1-only", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("Apache-2.0", "Apache-2.0"), ("CC0-1.0", "CC0-1.0")) if (folder / f).exists()}
    bodies = {n: body_sentences(t) for n, t in texts.items()}
    for name, text in texts.items():
        assert name in scanned(text[len(text) // 5 :], bodies)[0]


@pytest.mark.parametrize("part", ["licensed under ", "license ", "mit or ", "licensed a b c d e ", "neither the name of ", "gpl 2 or later and "])
def test_a_megabyte_of_notices(part):
    began = time.time()
    scanned(part * (1_000_000 // len(part)))
    scanned((part + "\n") * (1_000_000 // len(part)))
    assert time.time() - began < 30
