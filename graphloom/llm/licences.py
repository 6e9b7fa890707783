"""Licence scans by sentence rules: normalised sentences get the identifier of a known licence sentence,
and ordered rules are matched against a text's sequence of identifiers. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "MIT_REF",
    "licensed under the mit license": "MIT_REF",
    "this software is released under the mit license": "MIT_REF",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MIT_GRANT",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MIT_NOTICE",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MIT_WARRANTY",
    "licensed under the apache license version 2 0": "APACHE2_REF",
    "licensed under the apache license version 2 0 the license": "APACHE2_REF",
    "you may not use this file except in compliance with the license": "APACHE2_USE",
    "you may obtain a copy of the license at": "APACHE2_COPY",
    "this work is licensed under the gnu general public license version 3": "GPL3_REF",
    "this work is licensed under the gnu general public license version 2": "GPL2_REF",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3_LATER",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2_LATER",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPL_WARRANTY",
    "see the gnu general public license for more details": "GPL_DETAILS",
    "licensed under cc by nc 4 0": "CC_BY_NC_4_REF",
    "licensed under cc by 4 0": "CC_BY_4_REF",
    "licensed under cc by sa 4 0": "CC_BY_SA_4_REF",
    "this work is licensed under a creative commons attribution 4 0 international license": "CC_BY_4_REF",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSD_GRANT",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSD_SOURCE",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSD_BINARY",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BSD_ENDORSE",
    "this is free and unencumbered software released into the public domain": "UNLICENSE",
    "this file is in the public domain": "PUBLIC_DOMAIN",
}
# Ordered rules; the identifiers must follow one another. The first rule that fits a place names it.
RULES = (
    ("MIT", "MIT_GRANT MIT_NOTICE MIT_WARRANTY"),
    ("BSD-3-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY BSD_ENDORSE"),
    ("BSD-2-Clause", "BSD_GRANT BSD_SOURCE BSD_BINARY"),
    ("Apache-2.0", "APACHE2_REF APACHE2_USE APACHE2_COPY"),
    ("GPL-3.0-or-later", "GPL3_LATER GPL_WARRANTY GPL_DETAILS"),
    ("GPL-2.0-or-later", "GPL2_LATER GPL_WARRANTY GPL_DETAILS"),
    ("GPL-3.0-or-later", "GPL3_LATER"),
    ("GPL-2.0-or-later", "GPL2_LATER"),
    ("MIT", "MIT_REF"),
    ("Apache-2.0", "APACHE2_REF"),
    ("GPL-3.0-only", "GPL3_REF"),
    ("GPL-2.0-only", "GPL2_REF"),
    ("CC-BY-NC-4.0", "CC_BY_NC_4_REF"),
    ("CC-BY-4.0", "CC_BY_4_REF"),
    ("CC-BY-SA-4.0", "CC_BY_SA_4_REF"),
    ("Unlicense", "UNLICENSE"),
    ("Public-Domain", "PUBLIC_DOMAIN"),
)
# Sentences and rules of further licences, by the same form.
_GNU = "{0} is free software you can redistribute it and or modify it under the terms of the gnu {1} general public license as published by the free software foundation either version {2} of the license or at your option any later version"
_NAMED = {
    "gnu general public license version 3 0": "GPL3_REF",
    "gnu general public license version 2 0": "GPL2_REF",
    "gnu general public license version 3": "GPL3_REF",
    "gnu general public license version 2": "GPL2_REF",
    "gnu lesser general public license version 3": "LGPL3_REF",
    "gnu lesser general public license version 2 1": "LGPL21_REF",
    "gnu affero general public license version 3": "AGPL3_REF",
    "mozilla public license version 2 0": "MPL2_REF",
    "boost software license version 1 0": "BSL1_REF",
    "isc license": "ISC_REF",
    "mit license": "MIT_REF",
    "apache license version 2 0": "APACHE2_REF",
    "bsd 3 clause license": "BSD3_REF",
    "bsd 2 clause license": "BSD2_REF",
    "cc0 1 0 universal license": "CC0_REF",
}
MORE_SENTENCES = {
    **{f"{verb} under {the}{name}": i for name, i in _NAMED.items() for verb in ("licensed", "released", "distributed") for the in ("the ", "")},
    **{_GNU.format(what, kind, v): i for what in ("this program", "this library") for kind, v, i in (("lesser", "3", "LGPL3_LATER"), ("lesser", "2 1", "LGPL21_LATER"), ("affero", "3", "AGPL3_LATER"))},
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2_REF",
    "distributed under the boost software license version 1 0 see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt": "BSL1_REF",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISC_GRANT",
    "licensed under cc0 1 0": "CC0_REF",
}
MORE_RULES = (
    ("LGPL-3.0-or-later", "LGPL3_LATER"),
    ("LGPL-2.1-or-later", "LGPL21_LATER"),
    ("AGPL-3.0-or-later", "AGPL3_LATER"),
    ("LGPL-3.0-only", "LGPL3_REF"),
    ("LGPL-2.1-only", "LGPL21_REF"),
    ("AGPL-3.0-only", "AGPL3_REF"),
    ("MPL-2.0", "MPL2_REF"),
    ("BSL-1.0", "BSL1_REF"),
    ("ISC", "ISC_GRANT"),
    ("ISC", "ISC_REF"),
    ("BSD-3-Clause", "BSD3_REF"),
    ("BSD-2-Clause", "BSD2_REF"),
    ("CC0-1.0", "CC0_REF"),
)
# Identifiers that a line "SPDX-License-Identifier: ..." may name; also what says that a work is under them.
SPDX = "MIT Apache-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause ISC Zlib BSL-1.0 MPL-2.0 EPL-1.0 EPL-2.0 EUPL-1.2 CDDL-1.0 Artistic-2.0 WTFPL Unlicense CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-ND-4.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later".split()
_plain = lambda name: re.sub("[^a-z0-9]+", " ", name.lower()).strip()
MORE_SENTENCES |= {f"spdx license identifier {_plain(n)}": f"SPDX_{_plain(n).replace(' ', '_').upper()}" for n in SPDX}
MORE_RULES += tuple((n, f"SPDX_{_plain(n).replace(' ', '_').upper()}") for n in SPDX)
ALL_SENTENCES, ALL_RULES = {**MORE_SENTENCES, **SENTENCES}, (*RULES, *MORE_RULES)


def _prefilter(sentences) -> str:
    """An expression that finds a word of every sentence: a few words first, then the longest word of what they miss."""
    words = ["licens", "permission", "warrant", "redistribut", "public", "copyright"]
    for s in sentences:
        if not any(w in s for w in words):
            words.append(max(s.split(), key=len))
    return "(?i)" + "|".join(words)


_MAY = _prefilter(ALL_SENTENCES)
#: What may stand before a reference: "this project is".
_SUBJECT = "(?:(?:this|the) (?:[a-z0-9]+ (?:\\x02 )?){1,3}(?:is|are) (?:\\x02 )?)?"


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known licence sentences of a text, in its order.

    A known sentence stands between borders: line breaks and sentence ends. Line breaks inside a paragraph and
    semicolons may also stand between its words (written \\x02), blank lines, dashes of lists and other sentence
    ends (\\x01) may not. Marks of comments are no letters and so vanish.
    """
    all_of = ALL_SENTENCES
    known = F.create_map(*[F.lit(x) for pair in all_of.items() for x in pair])
    any_of = "|".join(s.replace(" ", " (?:\\x02 )?") for s in sorted(all_of, key=lambda s: (-len(s), s)))
    t = F.regexp_replace(F.regexp_replace(F.lower(text), "\r", ""), r"(?<=[.:!?])\x20+", "\x01")
    t = F.regexp_replace(F.regexp_replace(t, r"(?<=;)\x20+", "\x02"), r"\n[^a-z0-9\x01]*\n[^a-z0-9\x01]*|\n[\x20\t>#*/]*[-•]\x20", "\x01")
    t = F.regexp_replace(F.regexp_replace(t, "\n", "\x02"), r"[^a-z0-9\x01\x02]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"[\x01\x02]", " $0 "), r"\x20{2,}", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"\x02 (?:\x02 )++", "\x02 "), r"\x01 \x02", "\x01")
    t = F.concat(F.lit("\x01 "), F.trim(t), F.lit(" \x01"))
    found = F.regexp_extract_all(t, F.lit(f"(?<=[\\x01\\x02] ){_SUBJECT}({any_of})(?= [\\x01\\x02])"), F.lit(1))
    named = F.transform(found, lambda s: F.element_at(known, F.regexp_replace(s, " \x02", "")))
    return F.when(text.rlike(_MAY), named).otherwise(F.array().cast("array<string>"))


def find_licences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with licence_sentences (identifiers in order), licences (distinct names, sorted) and partly.

    Rules are tried at each place in order, and what one has matched is not read again; partly is true if
    some identifiers fit no rule. Null and empty texts have empty arrays; repeated rows get equal results; empty
    docs give no rows. Columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("licence_sentences", sentence_ids(text))
    line = F.concat(F.lit("  "), F.array_join("licence_sentences", "  "), F.lit("  "))
    # two blanks between identifiers: one on each side of a match; inside a rule they are written as two
    rules = {ids.replace(" ", "  "): name for name, ids in ALL_RULES}
    pattern = "|".join(f"(?<=\\x20){ids}(?=\\x20)" for ids in rules)
    names = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
    found = F.regexp_extract_all(line, F.lit(f"({pattern})"), F.lit(1))
    used = F.aggregate(found, F.lit(0), lambda a, x: a + F.size(F.split(x, r"\x20+")))
    return out.withColumns({"licences": F.array_sort(F.array_distinct(F.transform(found, lambda x: F.element_at(names, x)))), "partly": used < F.size("licence_sentences")})
