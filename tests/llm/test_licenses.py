"""Slots, names, SPDX expressions and lists of conditions of the license scan."""

import textwrap

import pytest

from quadrille.llm import licenses
from quadrille.llm.licenses import SENTENCES as S

KNOWN, FIRST = licenses._tables(licenses.SENTENCES, licenses.RULES)


def found(text):
    return [x for x, _, _ in licenses.scan(text, KNOWN, FIRST)]


@pytest.mark.parametrize("expression,want", [
    ("MIT", ["MIT"]),
    ("Apache-2.0 OR MIT", ["Apache-2.0", "MIT"]),
    ("(MIT AND BSD-3-Clause)", ["MIT", "BSD-3-Clause"]),
    ("GPL-2.0+", ["GPL-2.0-or-later"]),
    ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0-only", "MIT"]),
    ("((MIT OR ISC) AND Zlib) */", ["MIT", "ISC", "Zlib"]),
    ("LicenseRef-own OR MIT", ["MIT"]),
    ("MIT and so on", ["MIT"]),
    ("mit.", ["MIT"]),
    ("MIT Apache-2.0", ["MIT"]),
    ("something else", []),
    ("OR MIT", []),
    ("", []),
])
def test_expressions(expression, want):
    assert found(f"// SPDX-License-Identifier: {expression}\nint main;") == want
    assert found(f"a text before SPDX-License-Identifier: {expression}") == want


@pytest.mark.parametrize("text,want", [
    ("This software is licensed under the MIT License", ["MIT"]),
    ("Some prose. This little library is released under the terms of the Apache License, Version 2.0.", ["Apache-2.0"]),
    ("The files in this folder are licensed under the MIT License or the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    ("This work is distributed under the\nCreative Commons Attribution 4.0\nInternational License.", ["CC-BY-4.0"]),
    ("This road is available under the old bridge.", []),
    ("This software is not licensed under the MIT License.", []),
    ("The MIT License is short.", []),
    (" * " + S["gpl-redistribute"] + " " + S["agpl3-version"], ["AGPL-3.0"]),
    ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n", ["GPL-3.0"]),
    (S["0bsd-grant"], ["0BSD"]),
    (S["mit0-grant"], ["MIT-0"]),
    (S["isc-grant"], ["ISC"]),
    (S["epl2-available"], ["EPL-2.0"]),
    ("", []),
])
def test_names_and_notices(text, want):
    assert found(text) == want


BSD = ["bsd-grant", "bsd-source", "bsd-binary"]
HOLDERS = ["the copyright holder", "the University", "the University of California, Berkeley", "Example Inc.", "Example, Inc."]


def bsd(*more, mark="{}. "):
    body = [S["bsd-grant"], *(mark.format(i + 1) + x for i, x in enumerate([S["bsd-source"], S["bsd-binary"], *more]))]
    return "Copyright (c) 2020 Somebody\n\n" + "\n\n".join(body) + "\n\nTHIS SOFTWARE IS PROVIDED AS IS.\n"


@pytest.mark.parametrize("holder", HOLDERS)
@pytest.mark.parametrize("mark", ["{}. ", "({}) ", "", "* "])
@pytest.mark.parametrize("width", [60, 10_000])
def test_any_holder(holder, mark, width):
    text = bsd(f"Neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", mark=mark)
    text = "\n\n".join(textwrap.fill(x, width) for x in text.split("\n\n"))
    assert found(text) == ["BSD-3-Clause"]


def test_a_list_that_goes_on_is_another_license():
    assert found(bsd()) == found(bsd(mark="")) == ["BSD-2-Clause"]
    assert found(bsd("The software must be sung aloud.")) == []
    assert found(bsd("The software must be sung aloud.", mark="({}) ")) == []
    assert found(bsd("Neither the name of " + "very " * 20 + "long nor others may be used.", mark="")) == []
    assert found(" ".join(S[x] for x in BSD) + "\nSome prose follows.") == ["BSD-2-Clause"]


def test_slots_have_a_bound_and_end():
    long = "Neither the name of " + "x " * 100_000
    assert found(bsd() + long) == ["BSD-2-Clause"]
    assert found("neither the name of\n" * 2000) == []
