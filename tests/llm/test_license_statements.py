"""Statements of licenses that one-line templates used to miss."""

import pytest
from weir.llm import licenses

T = licenses.Templates(licenses.TEMPLATES)


@pytest.mark.parametrize("text", ["All rights reserved.", "words\nAll rights reserved.\nmore words", "Copyright 2020 Foo. All rights reserved."])
def test_reserved_rights(text):
    score, name = T.scan(text)
    assert name == "Proprietary" and score >= licenses.THRESHOLD


@pytest.mark.parametrize("name, text", [(n, t) for n, some in licenses.TEMPLATES.items() for t in some if n != "Proprietary"])
def test_reserved_rights_yield_to_a_license(name, text):
    assert T.scan(f"Copyright 2020 Foo. All rights reserved.\n\n{text}")[1] == name


MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."


@pytest.mark.parametrize(
    "name, text",
    [
        ("MPL-2.0", MPL),
        ("MPL-2.0", "x = 1\n" * 50 + "\n".join("# " + line for line in MPL.split("\n")) + "\ny = 2" * 50),
        ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the\npublic domain"),
        ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public\ndomain"),
        ("GPL-3.0", "Some words of a program that come first. This work is\nlicensed under the GNU General Public\nLicense, version 3. Other words of the program follow here."),
        ("Proprietary", "# All rights\n# reserved."),
    ],
)
def test_statements_over_line_ends(name, text):
    score, found = T.scan(text)
    assert found == name and score >= 0.9


LONG = {n: max(some, key=len) for n, some in licenses.TEMPLATES.items() if len(max(some, key=len).split()) > licenses.NEAR}


@pytest.mark.parametrize("name", sorted(LONG))
def test_whole_texts_and_versions_are_told_apart(name):
    """Whole licence texts, wrapped, under a title and a copyright line, alone and at the top of a long file."""
    words = LONG[name].split()
    wrapped = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
    for text in (f"The License\n\nCopyright (c) 2024 Jane Doe\n\n{wrapped}\n", "\n".join(f"// {line}" for line in wrapped.split("\n")) + "\nint x = 1;" * 400):
        score, found = T.scan(text)
        assert found == name and score >= 0.75


@pytest.mark.parametrize(
    ("name", "text"),
    [
        ("GPL-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 2 as\npublished by the Free Software Foundation."),
        ("GPL-3.0", "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
        ("AGPL-3.0", "it under the terms of the GNU Affero General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."),
        ("LGPL-2.1", "modify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version."),
    ],
)
def test_versions_of_notices(name, text):
    score, found = T.scan(text)
    assert found == name and score >= licenses.THRESHOLD


def test_one_very_long_line():
    score, found = T.scan("word " * 200_000 + "Licensed under the ISC license. " + "word " * 200_000)
    assert found == "ISC" and score >= licenses.THRESHOLD
