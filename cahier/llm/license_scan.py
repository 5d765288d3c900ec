"""Licence scans by sentence-rule recognition.

Sentences of a text are normalised (a-z and 0-9 with single spaces) and looked up among known licence sentences; the
identifiers found, in the order of the text, are matched against ordered rules: at each place the first rule whose
sequence stands there wins and consumes it; identifiers that no rule takes are counted as unmatched.

A text is cut into sentences twice, with line ends as boundaries and without them (for licences that are wrapped);
comment marks at line starts are dropped. In the second cut blank lines end sentences too, and copyright lines, which
stand between a licence's title and its text, count as blank. An SPDX line with one identifier counts as a notice that
names the licence. The cut that finds more known sentences counts, the first on a tie.
Everything is expressions inside the text's own row; there is no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of licences as notices write them, by SPDX identifier.
NAMES = {
    "MIT": ["MIT License", "MIT license terms", "Expat License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2", "GNU GPL v2", "GPLv2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL v2.1", "LGPL-2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "BSD-3-Clause"],
    "ISC": ["ISC License", "ISC"],
    "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
}
#: A notice after normalisation: whose it is and the verb do not matter, the name after "under" does.
NOTICE = r"^(?:(?:this|the) [a-z]+ is )?(?:licensed|released|distributed|published|made available|available) under (?:the terms of )?(?:the )?"
# Sentences of licence texts and headers, by identifier.
SENTENCES = {
    "MIT:grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "MIT:notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "MIT:asis": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "ISC:grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "BSD:grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD:source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BSD:binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSD:endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "Apache:header": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "Apache:comply": "you may not use this file except in compliance with the License",
    "Apache:obtain": "You may obtain a copy of the License at",
    "Apache:asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "GPL2:later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL3:later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPL:warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "MPL2:header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Public:domain": "This is free and unencumbered software released into the public domain",
    "Rights:reserved": "All rights reserved",
}
# Rules in order: licence, sequence of identifiers; "?" after one makes it optional.
RULES = [
    ("MIT", ["MIT:grant", "MIT:notice?", "MIT:asis?"]),
    ("ISC", ["ISC:grant"]),
    ("BSD-3-Clause", ["BSD:grant", "BSD:source", "BSD:binary", "BSD:endorse"]),
    ("BSD-2-Clause", ["BSD:grant", "BSD:source", "BSD:binary"]),
    ("Apache-2.0", ["Apache:header", "Apache:comply?", "Apache:obtain?", "Apache:asis?"]),
    ("GPL-2.0-or-later", ["GPL2:later", "GPL:warranty?"]),
    ("GPL-3.0-or-later", ["GPL3:later", "GPL:warranty?"]),
    ("MPL-2.0", ["MPL2:header"]),
    ("Unlicense", ["Public:domain"]),
    *[(name, [f"{name}:named"]) for name in NAMES],
]
# GPL notices, piece by piece: their first pieces are the same once normalised, the versions tell them apart.
GPL_WHOLE = ("GPL2:later", "GPL3:later")
GPL_GRANT = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
GPL_PIECES = {
    "GPL:lead": "This program is free software",
    "GPL:grant": GPL_GRANT,
    "GPL2:version": "either version 2 of the License, or (at your option) any later version",
    "GPL3:version": "either version 3 of the License, or (at your option) any later version",
    "GPL2:grant": GPL_GRANT + ", either version 2 of the License, or (at your option) any later version",
    "GPL3:grant": GPL_GRANT + ", either version 3 of the License, or (at your option) any later version",
}
GPL_RULES = [(f"GPL-{v}.0-or-later", ["GPL:lead?", *ids, "GPL:warranty?"]) for v in (2, 3) for ids in (["GPL:grant", f"GPL{v}:version"], [f"GPL{v}:grant"])]
SCAN_RULES = [*GPL_RULES, *[r for r in RULES if not set(r[1]) & set(GPL_WHOLE)]]
# Identifiers that only SPDX lines use.
SPDX_ONLY = ["Unlicense", *[f"{name}-{how}" for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0") for how in ("only", "or-later")]]
SCAN_RULES += [(name, [f"{name}:named"]) for name in SPDX_ONLY]
#: Every known sentence has one of these words, as written or normalised, so texts without any hold none.
KEYWORDS = ["under", "permi", "redistribut", "warrant", "copyright", "public", "software", "rights", "compliance", "licen", "merchant"]
COMMENT = r"(?m)^[\t ]*(?://+|#+|\*+|;+|--+|%+)[\t ]*"
LINE_CUT = r"\n|(?<=[.!?;:])[\x20\t]+"

#: The second cut; copyright lines (without a claim to all rights behind them) are blank lines in it.
TEXT_CUT = r"(?<=[.!?;:])[\x20\t\n]+|\n[\x20\t]*\n[\x20\t\n]*"
COPYRIGHT = r"(?im)^[\t ]*(?:copyright[\t ]+(?:\(c\)|©|[0-9]{4})|\(c\)[\t ]*(?:copyright|[0-9]{4})|©)(?:(?!all rights reserved)[^\n])*"
SPDX = r"(?im)^[\t ]*(?:/\*+|<!--)?[\t ]*SPDX-License-Identifier:[\t ]*([a-z0-9.+-]+)[\t ]*(?:\*/|-->)?[\t ]*$"


def normalise(sentence: str) -> str:
    return re.sub(NOTICE, "under ", re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip())


def pieces(sentence: str) -> list[str]:
    """A known sentence as the scan sees it, which ends sentences at semicolons and colons too."""
    return [normalise(s) for s in re.split(r"(?<=[.!?;:])[\x20\t\n]+", sentence)]


def known_sentences(sentences: dict[str, str]) -> dict[str, str]:
    """Normalised sentence -> identifier, of the names and ``sentences``; one sentence with two identifiers is an error."""
    known: dict[str, str] = {}

    def add(key: str, i: str) -> None:
        if known.setdefault(key, i) != i:
            raise ValueError(f"{known[key]} and {i} are one sentence: {key}")

    for name, texts in NAMES.items():
        for text in texts:
            add(normalise(f"licensed under {text}"), f"{name}:named")
    for name in {name for name, _ in SCAN_RULES}:
        add(normalise(f"licensed under {name}"), f"{name}:named")
    for i, text in sentences.items():
        add(pieces(text)[0], i)
    for text in sentences.values():
        for part in pieces(text)[1:]:  # the rest of a sentence that one piece tells apart adds nothing
            known.setdefault(part, "")
    return known


def pattern_parts(rules: list[tuple[str, list[str]]] = SCAN_RULES) -> list[str]:
    """The rules, in order, as patterns over '<id>' sequences."""
    return ["".join(f"(?:<{re.escape(i.rstrip('?'))}>)" + ("?" if i.endswith("?") else "") for i in ids) for _, ids in rules]


def full_catalogue() -> dict[str, str]:
    """What the scan and its SQL know."""
    return known_sentences({i: t for i, t in SENTENCES.items() if i not in GPL_WHOLE} | GPL_PIECES)


def _identify(text: Column, cut: str, known: Column) -> Column:
    normal = F.transform(F.split(text, cut), lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), NOTICE, "under "))
    worth = F.filter(normal, lambda s: s.rlike("|".join(KEYWORDS)))
    return F.filter(F.transform(worth, lambda s: F.try_element_at(known, s)), lambda i: i != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, sentence_ids (array, in order), licences (array, in order, repeats kept),
    n_unmatched (identifiers in no rule).

    Null and empty texts hold nothing; texts are scanned whole; repeated rows are scanned each; an empty table gives
    no rows; other columns are not read.
    """
    table = full_catalogue()
    known = F.map_from_arrays(F.array(*[F.lit(s) for s in table]), F.array(*[F.lit(i) for i in table.values()]))
    text = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n?", "\n"), COMMENT, "")
    text = F.regexp_replace(text, SPDX, "\n\nLicensed under $1\n\n")
    worth = docs.select(F.col(id_col).alias("doc_id"), F.when(F.col(text_col).rlike("(?i)" + "|".join(KEYWORDS)), text).otherwise(F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    found = worth.select("doc_id", *[F.when(F.col("t") == "", none).otherwise(_identify(t, cut, known)).alias(n) for n, t, cut in (("a", F.col("t"), LINE_CUT), ("b", F.regexp_replace("t", COPYRIGHT, "\n\n"), TEXT_CUT))])
    found = found.select("doc_id", F.when(F.size("a") >= F.size("b"), F.col("a")).otherwise(F.col("b")).alias("sentence_ids"))
    pattern = "|".join(f"(?:{p})" for p in pattern_parts())
    chain = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    taken = F.regexp_extract_all(chain, F.lit(f"({pattern})"), F.lit(1))
    licence = lambda m: F.coalesce(*[F.when(m.rlike("^" + p + "$"), F.lit(name)) for (name, _), p in zip(SCAN_RULES, pattern_parts())])
    out = found.select("doc_id", "sentence_ids", taken.alias("m"))
    left = F.size("sentence_ids") - F.aggregate("m", F.lit(0), lambda n, m: n + F.length(m) - F.length(F.replace(m, F.lit("<"), F.lit(""))))
    return out.select("doc_id", "sentence_ids", F.transform("m", licence).alias("licences"), left.alias("n_unmatched"))


COPYRIGHT_HEAD = r"(?i)^[\t ]*(?:copyright[\t ]+(?:\(c\)|©|[0-9]{4})|\(c\)[\t ]*(?:copyright|[0-9]{4})|©)"


def oracle() -> str:
    """The same scan as DuckDB SQL, with the same catalogue and rules in it."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = full_catalogue()
    keys, ids = ", ".join(map(quote, table)), ", ".join(map(quote, table.values()))
    pattern = "|".join(f"(?:{p})" for p in pattern_parts())
    licence = " ".join(f"WHEN regexp_full_match(m, {quote(p)}) THEN {quote(name)}" for (name, _), p in zip(SCAN_RULES, pattern_parts()))
    comment = quote(r"(^|\n)[\t ]*(?://+|#+|\*+|;+|--+|%+)[\t ]*")
    line = r"string_split_regex(regexp_replace(t, '([.!?;:])[\x20\t]+', '\1' || chr(1), 'g'), '[\x01\n]')"
    # No lookahead there: copyright lines are cut line by line, up to a claim to all rights.
    blanked = f"array_to_string([CASE WHEN regexp_matches(l, {quote(COPYRIGHT_HEAD)}) THEN chr(10) || chr(10) || regexp_extract(l, '(?i)all rights reserved.*') ELSE l END FOR l IN string_split(t, chr(10))], chr(10))"
    whole = rf"string_split(regexp_replace(regexp_replace({blanked}, '([.!?;:])[\x20\t\n]+', '\1' || chr(1), 'g'), '\n[\x20\t]*\n[\x20\t\n]*', chr(1), 'g'), chr(1))"
    ids_of = lambda parts: f"list_filter([known[regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), {quote(NOTICE)}, 'under ')] FOR s IN {parts}], lambda i: i <> '')"
    return f"""
WITH k AS (SELECT map([{keys}], [{ids}]) AS known),
c AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), {comment}, '\\1', 'g'), {quote(SPDX)}, chr(10) || chr(10) || 'Licensed under \\1' || chr(10) || chr(10), 'g') AS t FROM documents
      WHERE regexp_matches(text, '(?i){"|".join(KEYWORDS)}')),
f AS (SELECT doc_id, {ids_of(line)} AS a, {ids_of(whole)} AS b FROM c, k),
i AS (SELECT doc_id, CASE WHEN len(a) >= len(b) THEN a ELSE b END AS ids FROM f),
m AS (SELECT doc_id, ids, regexp_extract_all(list_aggregate(list_transform(ids, lambda x: '<' || x || '>'), 'string_agg', ''), {quote(pattern)}) AS ms FROM i),
r AS (SELECT doc_id, ids, list_transform(ms, lambda m: CASE {licence} END) AS ls, coalesce(list_sum(list_transform(ms, lambda m: length(m) - length(replace(m, '<', '')))), 0) AS taken FROM m)
SELECT d.doc_id, coalesce(len(ids), 0)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(ls, ','), '') AS licences, coalesce(len(ids) - taken, 0)::BIGINT AS n_unmatched
FROM documents d LEFT JOIN r USING (doc_id)
"""
