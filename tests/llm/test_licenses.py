"""Notices and bodies that the table of sentences was not written from: names in slots, wrapped bodies, expressions; and texts that name no licence."""

import duckdb
import pyarrow as pa
import pytest

from atlas.llm import licenses
from tests.conftest import rows as rows_of

_BSD = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:\n\n   * Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\n   * Redistributions in binary form must reproduce the above\ncopyright notice, this list of conditions and the following disclaimer\nin the documentation and/or other materials provided with the\ndistribution.\n"
_GPL = "# {0} is free software{1} you can redistribute it and/or modify\n# it under the terms of the GNU {2} Public License as published by\n# the Free Software Foundation{3}\n#\n# It is distributed in the hope that it will be useful.\n"
HELD_OUT = [
    ("BSD-3-Clause", "// Copyright 2014 The Some Authors. All rights reserved.\n//\n" + "\n".join("// " + x for x in (_BSD + "   * Neither the name of Google Inc. nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.").split("\n"))),
    ("BSD-3-Clause", _BSD + " * Neither the name of Foo Bar, the Baz Project, nor the names of its contributors may be\n used to endorse or promote products derived from this software without specific\n prior written permission.\n"),
    ("BSD-3-Clause", _BSD.replace("* ", "1. ", 1) + "3. The name of the author may not be used to endorse or promote products\n   derived from this software without specific prior written permission.\n"),
    ("BSD-4-Clause", _BSD + "3. All advertising materials mentioning features or use of this software\n   must display the following acknowledgement:\n   This product includes software developed by the University of\n   California, Berkeley and its contributors.\n4. Neither the name of the University nor the names of its contributors\n   may be used to endorse or promote products derived from this software\n   without specific prior written permission.\n"),
    ("BSD-2-Clause", _BSD + "\nTHIS SOFTWARE IS PROVIDED BY ITS MAKERS.\n"),
    ("Apache-2.0", "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n      \"License\" shall mean the terms."),
    ("GPL-3.0-only", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n"),
    ("LGPL-2.1-only", "\t\t  GNU LESSER GENERAL PUBLIC LICENSE\n\t\t       Version 2.1, February 1999\n\n Copyright (C) 1991, 1999 Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"),
    ("GPL-2.0-only", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n"),
    ("AGPL-3.0-only", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007\n\nEveryone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n\n1.1. \"Contributor\"\n    means each individual or legal entity that creates, contributes to\n    the creation of, or owns Covered Software.\n"),
    ("EPL-2.0", "Eclipse Public License - v 2.0\n\n    THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE\n    PUBLIC LICENSE (\"AGREEMENT\"). ANY USE OF IT\n"),
    ("GPL-2.0-or-later", _GPL.format("GNU Foo", ";", "General", "; either version 2, or (at your option)\n# any later version.")),
    ("GPL-3.0-or-later", _GPL.format("Frob", ":", "General", ", either version 3 of the\n# License, or (at your option) any later version.")),
    ("AGPL-3.0-or-later", _GPL.format("The frob server", ":", "Affero General", ", either version 3, or (at your option)\n# any later version.")),
    ("GPL-3.0-only", _GPL.format("This file", ":", "General", ", version 3.")),
    ("GPL-3.0-only", "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License version 3 as published by\nthe Free Software Foundation."),
    ("GPL-2.0-only", "/* SPDX-License-Identifier: GPL-2.0 */\n#include <x.h>\n"), ("MIT", "/* SPDX-License-Identifier: MIT */ int x;"), ("MIT", "// SPDX-License-Identifier: GPL-2.0-only OR MIT\n"),
    ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception\n"), ("GPL-2.0-or-later", "; spdx-license-identifier:GPL-2.0+\n"), ("MIT", "<!-- SPDX-License-Identifier: (MIT OR Apache-2.0) -->"), ("GPL-2.0-only", "# SPDX-License-Identifier: EPL-2.0 OR GPL-2.0 WITH Classpath-exception-2.0"),
    ("EPL-2.0", " * This program and the accompanying materials are made\n * available under the terms of the Eclipse Public License 2.0\n * which is available at https://www.eclipse.org/legal/epl-2.0/\n"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain\nworldwide. This software is distributed without any warranty."), ("CC0-1.0", "Creative Commons\n\nCC0 1.0 Universal\n"),
    (None, "Neither the name of the rose nor the thorn may be forgotten."), (None, "He is free software; you can not."), (None, "SPDX-License-Identifier: LicenseRef-Own"), (None, "SPDX-License-Identifier: MITX"), (None, "The Apache License is one of many."), (None, "# SPDX-License-Identifier:\n\nMIT"),
]
ALL_OF = {17: ["GPL-2.0-only"], 19: ["GPL-2.0-only", "MIT"], 22: ["Apache-2.0", "MIT"], 23: ["EPL-2.0", "GPL-2.0-only"], 3: ["BSD-2-Clause", "BSD-4-Clause"]}


@pytest.fixture(scope="module")
def scanned(spark):
    return licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(HELD_OUT)], "doc_id long, text string")).toPandas().sort_values("doc_id", ignore_index=True)


def test_held_out_notices(scanned):
    got = [None if x != x else x for x in scanned["license"]]
    assert [(i, g, w) for i, (g, (w, _)) in enumerate(zip(got, HELD_OUT)) if g != w] == []
    assert {i: scanned["licenses"][i].split(",") for i in ALL_OF} == ALL_OF


def test_sql_agrees_on_held_out_notices(scanned):
    documents = pa.table({"doc_id": range(len(HELD_OUT)), "text": [t for _, t in HELD_OUT]})
    other = duckdb.sql(licenses.oracle()).df()  # reads documents
    assert len(documents) == len(other) and rows_of(scanned) == rows_of(other)


def test_slots_are_bounded(spark):
    """A name of more than SLOT words fills no slot, and long runs of words cost time in proportion."""
    text = lambda n: "Neither the name of " + " ".join(["Some"] * n) + " nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [(1, text(licenses.SLOT)), (2, text(licenses.SLOT + 1)), (3, "neither the name of a " * 100_000)]
    got = {r.doc_id: r.n_sentences for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
