"""Licence scans by sentence rules: known sentences become identifiers, ordered identifiers make licences. SQL functions only."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of common licence texts and notices, and their identifiers.
TEXTS = [
    ("gpl3-work", "This work is licensed under the GNU General Public License version 3"),
    ("cc-by-nc-4", "Licensed under CC BY-NC 4.0"),
    ("mit-released", "Released under the MIT License"),
    ("apache2-short", "Licensed under the Apache License, Version 2.0"),
    ("apache2-grant", "Licensed under the Apache License, Version 2.0 (the License)"),
    ("apache2-comply", "you may not use this file except in compliance with the License"),
    ("apache2-copy", "You may obtain a copy of the License at"),
    ("apache2-warranty", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache2-limits", "See the License for the specific language governing permissions and limitations under the License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of <> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names", "Neither the name of <> nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names", "The name of <> may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-names", "The names of <> may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-advert", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-product", "This product includes software developed by <>"),
    ("bsd-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    *[(f"gpl{n}-grant", f"<> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {n}{of}, or (at your option) any later version") for n in (2, 3) for of in (" of the License", "")],
    *[(f"gpl{n}-only", f"<> is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License {words}") for n in (2, 3) for words in (f"version {n} as published by the Free Software Foundation", f"as published by the Free Software Foundation, version {n} of the License", f"as published by the Free Software Foundation, version {n}")],
    ("gpl-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-details", "See the GNU General Public License for more details"),
    ("gpl-copy", "You should have received a copy of the GNU General Public License along with this program"),
    *[(f"lgpl{i}-grant", f"<> is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version {n}{of}, or (at your option) any later version") for i, n in (("21", "2.1"), ("3", "3")) for of in (" of the License", "")],
    ("lgpl-warranty", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("lgpl-details", "See the GNU Lesser General Public License for more details"),
    ("lgpl-copy", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    *[("agpl3-grant", f"<> is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3{of}, or (at your option) any later version") for of in (" of the License", "")],
    ("agpl-details", "See the GNU Affero General Public License for more details"),
    ("agpl-copy", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc-warranty", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"),
    ("mpl2-subject", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl2-copy", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"),
    ("unlicense-domain", "This is free and unencumbered software released into the public domain"),
    ("unlicense-anyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("zlib-warranty", "This software is provided as-is, without any express or implied warranty"),
    ("zlib-liability", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("boost-short", "Distributed under the Boost Software License, Version 1.0"),
    ("cc-by-4-work", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4-work", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4-work", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4-work", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-4", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4", "Licensed under CC BY-SA 4.0"),
    ("all-rights", "All rights reserved"),
    ("apache2-title", "Apache License, Version 2.0, January 2004"),
    ("apache2-terms", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("gpl3-title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("gpl2-title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("lgpl21-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("lgpl3-title", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("agpl3-title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("fsf-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("mpl2-title", "Mozilla Public License Version 2.0"),
    ("mpl2-contributor", "Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software"),
    ("epl2-title", "Eclipse Public License - v 2.0"),
    ("epl2-terms", "THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE (AGREEMENT)"),
    ("epl2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at <>"),
    ("epl2-notice", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at <>"),
    ("cc0-title", "CC0 1.0 Universal"),
    ("cc0-notice", "To the extent possible under law, <> dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("cc0-notice", "To the extent possible under law, <> waived all copyright and related or neighboring rights to this work"),
    ("mit-notice", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"),
]
# Licences that a tag of one line can name, and older identifiers for some of them.
TAGGED = ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "AGPL-3.0-or-later", "MPL-2.0", "ISC", "0BSD", "Unlicense", "Zlib", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC0-1.0", "EPL-2.0", "BSD-4-Clause", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only"]
OLDER = {"GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-only", "LGPL-2.1": "LGPL-2.1-only", "LGPL-3.0": "LGPL-3.0-only", "AGPL-3.0": "AGPL-3.0-only"}
# Rules in order of preference; identifiers must follow one another, with no other known sentence between them.
RULES = [
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"], "text"),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"], "text"),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"], "text"),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], "text"),
    ("ISC", ["isc-grant", "isc-warranty"], "text"),
    ("0BSD", ["0bsd-grant", "isc-warranty"], "text"),
    ("Unlicense", ["unlicense-domain", "unlicense-anyone"], "text"),
    ("Zlib", ["zlib-warranty", "zlib-liability", "zlib-grant"], "text"),
    ("Apache-2.0", ["apache2-title", "apache2-terms"], "text"),
    ("GPL-3.0-only", ["gpl3-title", "fsf-verbatim"], "text"),
    ("GPL-2.0-only", ["gpl2-title", "fsf-verbatim"], "text"),
    ("LGPL-2.1-only", ["lgpl21-title", "fsf-verbatim"], "text"),
    ("LGPL-3.0-only", ["lgpl3-title", "fsf-verbatim"], "text"),
    ("AGPL-3.0-only", ["agpl3-title", "fsf-verbatim"], "text"),
    ("MPL-2.0", ["mpl2-title", "mpl2-contributor"], "text"),
    ("EPL-2.0", ["epl2-title", "epl2-terms"], "text"),
    ("Apache-2.0", ["apache2-grant", "apache2-comply", "apache2-copy", "apache2-warranty"], "notice"),
    ("Apache-2.0", ["apache2-short", "apache2-comply", "apache2-copy", "apache2-warranty"], "notice"),
    ("AGPL-3.0-or-later", ["agpl3-grant", "gpl-warranty", "agpl-details"], "notice"),
    ("LGPL-2.1-or-later", ["lgpl21-grant", "lgpl-warranty"], "notice"),
    ("LGPL-3.0-or-later", ["lgpl3-grant", "lgpl-warranty"], "notice"),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty", "gpl-copy"], "notice"),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty", "gpl-details"], "notice"),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty", "gpl-copy"], "notice"),
    ("GPL-2.0-or-later", ["gpl2-grant", "gpl-warranty", "gpl-details"], "notice"),
    ("GPL-2.0-only", ["gpl2-only", "gpl-warranty"], "notice"),
    ("GPL-3.0-only", ["gpl3-only", "gpl-warranty"], "notice"),
    ("EPL-2.0", ["epl2-notice"], "notice"),
    ("CC0-1.0", ["cc0-notice"], "notice"),
    ("GPL-3.0-or-later", ["gpl3-grant"], "reference"),
    ("GPL-2.0-or-later", ["gpl2-grant"], "reference"),
    ("GPL-2.0-only", ["gpl2-only"], "reference"),
    ("GPL-3.0-only", ["gpl3-only"], "reference"),
    ("CC0-1.0", ["cc0-title"], "reference"),
    ("AGPL-3.0-or-later", ["agpl3-grant"], "reference"),
    ("LGPL-2.1-or-later", ["lgpl21-grant"], "reference"),
    ("LGPL-3.0-or-later", ["lgpl3-grant"], "reference"),
    ("GPL-3.0-only", ["gpl3-work"], "reference"),
    ("Apache-2.0", ["apache2-grant"], "reference"),
    ("Apache-2.0", ["apache2-short"], "reference"),
    ("MIT", ["mit-released"], "reference"),
    ("MIT", ["mit-grant"], "reference"),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"], "reference"),
    ("CC-BY-4.0", ["cc-by-4"], "reference"),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"], "reference"),
    ("CC-BY-4.0", ["cc-by-4-work"], "reference"),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-work"], "reference"),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-work"], "reference"),
    ("CC-BY-ND-4.0", ["cc-by-nd-4-work"], "reference"),
    ("ISC", ["isc-grant"], "reference"),
    ("MPL-2.0", ["mpl2-subject"], "reference"),
    ("Unlicense", ["unlicense-domain"], "reference"),
    ("BSL-1.0", ["boost-short"], "reference"),
    *[(name, [f"spdx-{name.lower()}"], "tag") for name in TAGGED],
]


def words(sentence: str) -> str:
    """A sentence as it is looked for: lower case, words only, * for <>, which stands for one to SLOT words."""
    return " ".join(re.findall(r"[a-z0-9]+|\*", sentence.lower().replace("<>", " * ")))


#: Words that a name within a sentence may have, and one that a sentence begins with.
SLOT, LEADING = 12, 5
SENTENCES = {words(text): name for name, text in TEXTS}
#: Licence identifiers as words, with what they name; the longest come first, so that none is taken for the beginning of another.
IDS = dict(sorted(({words(name): name for name in TAGGED} | {words(old): name for old, name in OLDER.items()} | {words(f"{old} or later"): f"{old}-or-later" for old in OLDER}).items(), key=lambda x: -len(x[0])))
MARKER, EXCEPTION = "spdx license identifier", "with [a-z]+(?: [a-z0-9]+){0,3}? exception(?: [0-9]+){0,2}"

#: A full stop, question or exclamation mark before white space or the end always ends a sentence, as a blank line does. One after "v" before a
#: number, one after "inc", "corp", "ltd" or "co", a semicolon, a colon and a single line break may stand within a sentence too: notices are wrapped, and "free software: you can" is one sentence.
STRONG, WEAK, VERSION = r"(?<![.!?;:])[;:]*+[.!?][.!?;:]*+(?=\s|$)", r"(?<![.!?;:])[;:]++(?=\s|$)", r"\.(?:(?<=(?<![a-z0-9])v\.)(?=\s+[0-9])|(?<=(?<![a-z0-9])(?:inc|corp|ltd|co)\.)(?=\s))"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def marked(text: Column) -> Column:
    """Words with one space between them, " | " where a sentence must end and " / " where it may. Every pattern reads a text in linear time."""
    out = F.replace(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(".0+"), F.lit(".0 or later"))  # no A-Z from here on, so that S, W and N can mark what ends a sentence, what may, and lines
    for pattern, mark in ((VERSION, "W"), (STRONG, "S"), (WEAK, "W")):
        out = F.regexp_replace(out, pattern, mark)
    out = F.translate(out, "\n", "N")
    for pattern, mark in ((r"[^a-z0-9SWN]++", " "), (r"N[ W]*+N", "S"), (r"(?<![ WN])[ WN]*+S[ SWN]*+", " | "), (r" ?[WN][ WN]*+", " / ")):
        out = F.regexp_replace(out, pattern, mark)
    return F.concat(F.lit("| "), F.trim(out), F.lit(" |"))


def slotted(sentence: str, gap: str) -> str:
    """A regular expression for a sentence whose words are parted by gap."""
    slot = lambda i: rf"[a-z0-9]+(?:{gap}[a-z0-9]+){{0,{(SLOT if i else LEADING) - 1}}}?"
    return gap.join(slot(i) if w == "*" else w for i, w in enumerate(sentence.split(" ")))


def any_of(sentences: list[str], gap: str) -> str:
    """One regular expression for all sentences, the longest first among those that begin alike; what they begin with is looked for once."""
    heads: dict[str, list[str]] = {}
    for sentence in sorted(sentences, key=lambda s: (-len(s), s)):
        heads.setdefault(sentence.split(" ")[0], []).append(sentence)
    out = []
    for same in heads.values():
        split = [s.split(" ") for s in same]
        shared = len(os.path.commonprefix(split))
        rests = [slotted(" ".join(["-", *x[shared:]]), gap)[1:] for x in split]  # each with the gap before it; a slot there is no first word
        begin = slotted(" ".join(split[0][:shared]), gap)
        out.append(begin + (f"(?:{'|'.join(rests)})" if len(rests) > 1 else rests[0]))
    return "|".join(out)


def expression(gap: str = " ") -> str:
    """A regular expression for a licence expression in words: identifiers, with exceptions, joined by and, or. One with a number isn't taken for one without."""
    one = rf"(?:{'|'.join(IDS)})(?: {EXCEPTION})?"
    return rf"{one}(?: (?:and|or) {one})*"


def sentence_ids(text: Column, sentences: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in order; of two that begin together the longer. Others are left out. A tag gives one for each licence of its expression."""
    known = F.create_map(*[F.lit(x) for kv in sentences.items() if "*" not in kv[0] for x in kv])
    every = any_of(list(sentences), "(?: /)? ")
    found = F.regexp_extract_all(marked(text), F.lit(rf"(?<=[|/] )(?:(?:{every})(?= [|/])|{MARKER}(?: /)? {expression()}(?= ))"), F.lit(0))
    tags = F.create_map(*[F.lit(x) for w, name in IDS.items() for x in (w, f"spdx-{name.lower()}")])

    def told(s: Column) -> Column:
        plain = F.replace(s, F.lit(" / "), F.lit(" "))
        opened = [F.when(plain.rlike(f"^{slotted(sentence, ' ')}$"), F.lit(i)) for sentence, i in sorted(sentences.items(), key=lambda x: -len(x[0])) if "*" in sentence]
        name = F.coalesce(F.element_at(known, plain), *opened)
        bare = F.regexp_replace(plain, f" {EXCEPTION}", "")
        each = F.transform(F.regexp_extract_all(bare, F.lit(rf"(?<= )(?:{'|'.join(IDS)})(?= |$)"), F.lit(0)), lambda x: F.element_at(tags, x))
        return F.when(plain.startswith(MARKER + " "), each).otherwise(F.array(name))

    return F.flatten(F.transform(found, told))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", sentences: dict[str, str] = SENTENCES, rules: list = RULES) -> DataFrame:
    """doc_id, sentence_ids, n_sentences, licenses, n_licenses, license, kind; one row per row of docs.

    A rule holds where its identifiers occur one after another in the row's identifiers. licenses: the names of all rules that
    hold, sorted, each once; license and kind: those of the first rule that holds (null if none). Null and empty texts
    have none. Notices may be wrapped, indented and stand behind comment marks. Texts are read whole, however long, in linear time, row by row, with no shuffle;
    repeated rows repeat their result, null keys stay, an empty table gives no rows, and columns other than the two that are named are left out.
    """
    ids = docs.select(docs[key].alias("doc_id"), sentence_ids(docs[text], sentences).alias("sentence_ids"))
    line = F.concat(F.lit(" "), F.array_join("sentence_ids", " "), F.lit(" "))
    holds = [(F.contains(F.col("line"), F.lit(f" {' '.join(need)} ")), name, kind) for name, need, kind in rules]
    first = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("license"), F.lit(k).alias("kind"))) for c, n, k in holds]), lambda x: x.isNotNull())
    out = ids.withColumn("line", line).withColumn("held", F.when(F.size("sentence_ids") > 0, first).otherwise(F.array().cast("array<struct<license:string,kind:string>>")))
    names = F.array_sort(F.array_distinct(F.transform("held", lambda x: x["license"])))
    return out.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join(names, ",").alias("licenses"), F.size(names).cast("long").alias("n_licenses"), F.try_element_at("held", F.lit(1))["license"].alias("license"), F.try_element_at("held", F.lit(1))["kind"].alias("kind"))


def oracle(sentences: dict[str, str] = SENTENCES, rules: list = RULES) -> str:
    """The same scan by other means: texts are cut into pieces wherever a sentence must or may end, and every run of pieces within one sentence is
    looked up as a whole. Of the hits those go that begin within an earlier one, or are the shorter of two that begin together."""
    known = ", ".join(f"('{s}', '{i}')" for s, i in sentences.items() if "*" not in s)
    open_ = ", ".join(f"('{slotted(s, ' ')}', '{s.split(' * ')[-1].removeprefix('* ').removesuffix(' *')}', '{'*' if s[0] == '*' else s.split(' ')[0]}', '{i}')" for s, i in sentences.items() if "*" in s)
    tags = ", ".join(f"('{w}', 'spdx-{name.lower()}')" for w, name in IDS.items())
    ruled = ", ".join(f"({n}, '{name}', ' {' '.join(need)} ', '{kind}')" for n, (name, need, kind) in enumerate(rules))
    longest = max(map(len, sentences)) + 100
    return rf"""
WITH known(sentence, id) AS (VALUES {known}), open(pattern, has, one, id) AS (VALUES {open_}), tags(w, id) AS (VALUES {tags}), rules(n, name, need, kind) AS (VALUES {ruled}),
docs AS (SELECT row_number() OVER () rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') low, replace(low, '.0+', '.0 or later') t FROM documents),
-- Q ends a sentence, P may end one; a full stop after a lone v before a number only may
versions AS (SELECT rid, regexp_replace(regexp_replace(' ' || t || ' ', '([^a-z0-9]v)\.(\s+[0-9])', '\1P\2', 'g'), '([^a-z0-9](?:inc|corp|ltd|co))\.(\s)', '\1P\2', 'g') t FROM docs),
ended AS (SELECT rid, regexp_replace(regexp_replace(t, '[.!?;:]*[.!?][.!?;:]*(\s)', 'Q\1', 'g'), '[;:]+(\s)', 'P\1', 'g') t FROM versions),
lined AS (SELECT rid, regexp_replace(regexp_replace(t, '\n[^a-z0-9QP\n]*(\n[^a-z0-9QP\n]*)+', 'Q', 'g'), '\n', 'P', 'g') t FROM ended),
strong AS (SELECT rid, unnest(list_zip(s, range(len(s)))) p FROM (SELECT rid, string_split(t, 'Q') s FROM lined)),
parts AS (SELECT rid, p[2] sid, list_filter(list_transform(string_split(p[1], 'P'), lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), lambda x: x <> '') w FROM strong),
firsts AS (SELECT rid, sid, w, unnest(range(1, len(w) + 1)) i FROM parts WHERE len(w) > 0),
begins AS (SELECT DISTINCT string_split(sentence, ' ')[1] one FROM known UNION SELECT one FROM open WHERE one <> '*'),
hopeful AS (SELECT f.* FROM firsts f WHERE string_split(w[i], ' ')[1] IN (SELECT one FROM begins) OR contains(array_to_string(w[i:i + 2], ' '), ' is free software')),
runs AS (SELECT rid, sid, i, j, array_to_string(w[i:j], ' ') s FROM (SELECT rid, sid, w, i, unnest(range(i, least(len(w), i + {longest}) + 1)) j FROM hopeful) WHERE length(array_to_string(w[i:j], ' ')) <= {longest}),
found AS (SELECT rid, sid, i, j, id FROM runs JOIN known ON s = sentence UNION SELECT rid, sid, i, j, id FROM runs JOIN open ON contains(s, has) AND (one = '*' OR starts_with(s, one)) AND regexp_full_match(s, pattern)),
told AS (SELECT rid, sid, i, regexp_extract(CASE WHEN w[i] = '{MARKER}' THEN coalesce(w[i + 1], '') ELSE substr(w[i], {len(MARKER) + 2}) END || ' ', '^({expression()}) ', 1) e FROM firsts WHERE w[i] = '{MARKER}' OR starts_with(w[i], '{MARKER} ')),
named AS (SELECT rid, sid, i, unnest(list_zip(l, range(len(l)))) x FROM (SELECT *, regexp_extract_all(regexp_replace(e, ' {EXCEPTION}', '', 'g'), '(?:^|(?:and|or) )({"|".join(IDS)})', 1) l FROM told)),
hits AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM found g WHERE g.rid = f.rid AND g.sid = f.sid AND ((g.i < f.i AND g.j >= f.i) OR (g.i = f.i AND g.j > f.j)))),
every_hit AS (SELECT rid, sid, i, 0 k, id FROM hits UNION ALL SELECT rid, sid, i, x[2], tags.id FROM named JOIN tags ON x[1] = tags.w),
lists AS (SELECT rid, string_agg(id, ',' ORDER BY sid, i, k) ids, count(*) n FROM every_hit GROUP BY rid),
held AS (SELECT rid, string_agg(DISTINCT name, ',' ORDER BY name) names, count(DISTINCT name) n_names, arg_min(name, r.n) license, arg_min(kind, r.n) kind FROM lists JOIN rules r ON contains(' ' || replace(ids, ',', ' ') || ' ', need) GROUP BY rid)
SELECT doc_id, coalesce(ids, '') sentence_ids, coalesce(lists.n, 0)::BIGINT n_sentences, coalesce(names, '') licenses, coalesce(n_names, 0)::BIGINT n_licenses, license, kind
FROM docs LEFT JOIN lists USING (rid) LEFT JOIN held USING (rid)
"""
