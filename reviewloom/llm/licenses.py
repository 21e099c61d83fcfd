"""Licence recognition by known sentences and ordered rules. DataFrame functions only.

A text is normalised to words between boundaries, its known sentences are found wherever they stand between boundaries
(line breaks and full stops of abbreviations inside one are allowed), and the sequence of their identifiers is matched against rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-notice-2": "Licensed under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-keep": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl2-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-nc4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa4-notice": "Licensed under CC BY-SA 4.0.",
    "cc0-notice": "Licensed under CC0 1.0.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-advert": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "apache11-ack": "The end-user documentation included with the redistribution, if any, must include the following acknowledgment:",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License.",
    "gpl2-only-2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl2-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl3-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl3-later-2": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "lgpl2-details": "See the GNU Library General Public License for more details.",
    "agpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "epl1-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl2-notice-2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "gpl3-text": "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "gpl2-text": "By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    "agpl3-text": "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
}
# Licences as ordered identifiers. Known sentences in no rule are counted as n_unexplained.
RULES = {
    "MIT": [["mit-title", "mit-grant", "mit-keep", "mit-as-is"], ["mit-grant", "mit-keep", "mit-as-is"], ["mit-notice"], ["mit-notice-2"], ["mit-title"]],
    "Apache-2.0": [["apache-grant", "apache-copy", "apache-as-is"], ["apache-grant", "apache-copy"], ["apache-notice"]],
    "GPL-3.0-or-later": [["gpl3-later", "gpl-hope", "gpl-details"], ["gpl3-later"]],
    "GPL-2.0-or-later": [["gpl2-later", "gpl-hope", "gpl-details"], ["gpl2-later"]],
    # A copy of a licence text ends with the notice it recommends; the text alone says nothing of later versions.
    "GPL-3.0-only": [["gpl3-notice"], ["gpl3-text", "gpl3-later", "gpl-hope", "gpl-details"], ["gpl3-text"]],
    "GPL-2.0-only": [["gpl2-text", "gpl2-later", "gpl-hope", "gpl-details"], ["gpl2-text"], ["gpl2-only", "gpl-hope", "gpl-details"], ["gpl2-only"], ["gpl2-only-2", "gpl-hope", "gpl-details"], ["gpl2-only-2"], ["gpl2-notice"]],
    "LGPL-2.0-or-later": [["lgpl2-later", "lgpl-hope", "lgpl2-details"], ["lgpl2-later"]],
    "LGPL-2.1-or-later": [["lgpl21-later", "lgpl-hope", "lgpl-details"], ["lgpl21-later"]],
    "LGPL-3.0-or-later": [["lgpl3-later", "lgpl-hope", "lgpl-details"], ["lgpl3-later"], ["lgpl3-later-2", "gpl-hope", "lgpl-details"], ["lgpl3-later-2"]],
    "AGPL-3.0-only": [["agpl3-text", "agpl3-later", "gpl-hope", "agpl-details"], ["agpl3-text"]],
    "Zlib": [["zlib-as-is", "zlib-grant"], ["zlib-grant"]],
    "AGPL-3.0-or-later": [["agpl3-later", "gpl-hope", "agpl-details"], ["agpl3-later"]],
    "BSD-4-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-names"]],
    "Apache-1.1": [["bsd-grant", "bsd-source", "bsd-binary", "apache11-ack", "bsd-names"]],
    "BSD-3-Clause": [["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]],
    "BSD-2-Clause": [["bsd-grant", "bsd-source", "bsd-binary"]],
    "Unlicense": [["unlicense-free", "unlicense-anyone"], ["unlicense-free"]],
    "BSL-1.0": [["boost-notice"], ["boost-grant"]],
    "EPL-1.0": [["epl1-notice"]],
    "EPL-2.0": [["epl2-notice"], ["epl2-notice-2"]],
    "ISC": [["isc-grant"]],
    "MPL-2.0": [["mpl2-notice"]],
    "CC-BY-NC-4.0": [["cc-by-nc4-notice"]],
    "CC-BY-4.0": [["cc-by4-notice"]],
    "CC-BY-SA-4.0": [["cc-by-sa4-notice"]],
    "CC0-1.0": [["cc0-notice"]],
}
# Identifiers of SPDX-License-Identifier lines, with the names they now go by where they are old.
SPDX = {x.lower(): x for x in """0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0
    BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0
    CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-NC-ND-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0
    EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.2-only GFDL-1.3-only GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-only
    GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later HPND ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only
    LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0
    Ruby SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1""".split()}
SPDX |= {f"{x}-{v}".lower(): f"{x}-{v}-only" for x, v in [("GPL", "1.0"), ("GPL", "2.0"), ("GPL", "3.0"), ("LGPL", "2.0"), ("LGPL", "2.1"), ("LGPL", "3.0"), ("AGPL", "3.0")]}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TRIGGER = "licens|warrant|permission|redistribut|mozilla|acknowledg|unencumbered|non.commercial"  # every sentence above holds one of these stems
HARD, SOFT = " | | ", " / / "  # ends of sentences, ends of lines; doubled, so that each sentence has its own pair


def words_of(sentence: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).split()


# A number for each identifier, in the order above, written as a character, so that a sequence of identifiers is a string.
FIRST, LAST = "\u3400", "\u4dbf"  # a run of 6,592 characters
LETTERS = {name: chr(ord(FIRST) + n) for n, name in enumerate(SENTENCES)}
BY_WORDS = {" ".join(words_of(text)): LETTERS[name] for name, text in SENTENCES.items()}
# Long sentences are tried first, then long rules; both patterns mean the same in any engine that takes the leftmost match.
SENTENCE_PATTERN = "[|/] (?:" + "|".join("(?: [|/] [|/])? ".join(words.split()) for words in sorted(BY_WORDS, key=lambda w: (-len(w), w))) + ") [|/]"
SEQUENCES = {"".join(LETTERS[n] for n in names): licence for licence, rules in RULES.items() for names in rules}
RULE_PATTERN = "|".join(sorted(SEQUENCES, key=lambda s: (-len(s), s))) + f"|[{FIRST}-{LAST}]"

# Beyond the fixed sentences: what follows has no fixed words, so SCAN_SQL below, made of the fixed ones, does not know it.
SPDX_LINE, SPDX_OTHER = "spdx license identifier", chr(0x9FFF)
SPDX_LETTERS = {licence: chr(0x4E00 + n) for n, licence in enumerate(sorted(set(SPDX.values())))}
ALL_WORDS = BY_WORDS | {" ".join([SPDX_LINE, *words_of(name)]): SPDX_LETTERS[licence] for name, licence in SPDX.items()}
ALL_NAMES = {v: k for k, v in LETTERS.items()} | {v: f"spdx-{k}" for k, v in SPDX_LETTERS.items()} | {SPDX_OTHER: "spdx-other"}
ALL_SEQUENCES = SEQUENCES | {v: k for k, v in SPDX_LETTERS.items()}
# Possessive, so that the words of a very long line are read in a loop and never given back.
ALL_SENTENCES = SENTENCE_PATTERN + f"|[|/] {SPDX_LINE}(?: [|/] [|/])?(?: [a-z0-9]++)++ [|/]"
ALL_RULES = RULE_PATTERN + "|[\u4e00-\u9fff]"
GAP = "(?: [|/] [|/])? "
# The clause on names speaks of any holder; what follows its last fixed word does not matter.
NAMES_CLAUSE = (f"(?<=[|/] )(?:neither{GAP})?the{GAP}names?{GAP}(?:(?!redistribution)[a-z0-9|/]+ ){{1,80}}?"
                + GAP.join("endorse or promote products derived from this software".split()) + "(?: [a-z0-9]+){0,40}?(?= [|/])")


def _quoted(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def normalised(text: Column) -> Column:
    """Lower-case words with marks at the ends of sentences and lines."""
    marked = F.regexp_replace(F.translate(text, UPPER, LOWER), r"[.!?;:]+([ \t\r\n]|$)", "\x01$1")
    lines = F.regexp_replace(marked, r"[ \t\r]*\n[ \t\r]*", "\x02")
    words = F.regexp_replace(lines, "[^a-z0-9\x01\x02]+", " ")
    hard = F.regexp_replace(words, " *[\x01\x02]*\x01[\x01\x02]* *", HARD)
    return F.concat(F.lit("| "), F.trim(F.regexp_replace(hard, " *\x02+ *", SOFT)), F.lit(" |"))


def _spdx_lines(text: Column) -> Column:
    """Each identifier of an SPDX expression on a line of its own: exceptions (WITH) go, a plus becomes -or-later."""
    mark = "(?i:spdx-license-identifier:)"
    told = F.regexp_replace(text, f"(?<={mark}[^\\n]{{0,300}})[ \t]+WITH[ \t]+[A-Za-z0-9.-]+", "")
    told = F.regexp_replace(told, f"(?<={mark}[^\\n]{{0,300}})[ \t]+(?:OR|AND)[ \t]+", "\nSPDX-License-Identifier: ")
    told = F.regexp_replace(told, f"({mark}[ \t(]*[A-Za-z0-9.-]+)[+]", "$1-or-later")
    told = F.regexp_replace(told, f"{mark}[ \t(]*([A-Za-z0-9.-]+)", "\nSPDX-License-Identifier: $1\n")
    return F.when(F.translate(text, UPPER, LOWER).contains("spdx-license-identifier:"), told).otherwise(text)


def _one_wording(words: Column) -> Column:
    """Normalised text whose clauses on names and acknowledgements have the words of SENTENCES."""
    told = F.regexp_replace(words, NAMES_CLAUSE, " ".join(words_of(SENTENCES["bsd-names"])))
    told = F.regexp_replace(told, f"(display{GAP}the{GAP}following{GAP})acknowledgment(?= [|/])", "$1acknowledgement")
    told = F.regexp_replace(told, f"(include{GAP}the{GAP}following{GAP})acknowledgement(?= [|/])", "$1acknowledgment")
    return F.when(words.contains(" endorse "), told).otherwise(words)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones found), sentences (their identifiers, comma-joined, in order), licences (one per
    matched rule, in order, comma-joined), n_unexplained (known sentences in no rule) for every row of `docs`.

    Rules are matched from left to right in the sequence of known sentences, the longest first, and use up what they match.
    Identifiers of SPDX-License-Identifier lines are sentences and rules by themselves; one that SPDX does not list is unexplained.
    Null and empty texts and texts without known sentences have no sentences and no licences (empty strings). Repeated rows are
    scanned each; texts and lines may be of any length.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lowered = F.translate(text, UPPER, LOWER)
    found = F.when(lowered.rlike(TRIGGER), F.regexp_extract_all(_one_wording(normalised(_spdx_lines(text))), F.lit(ALL_SENTENCES), F.lit(0)))
    plain = lambda s: F.regexp_replace(F.regexp_replace(s, "^[|/] | [|/]$", ""), r" [|/] [|/]", "")
    letters = F.transform(F.coalesce(found, F.array().cast("array<string>")), lambda s: F.coalesce(F.element_at(_quoted(ALL_WORDS), plain(s)), F.lit(SPDX_OTHER)))
    named = F.transform("letters", lambda x: F.element_at(_quoted(ALL_NAMES), x))
    runs = docs.select("doc_id", letters.alias("letters")).select(
        "doc_id", F.size("letters").cast("long").alias("n_sentences"), F.array_join(named, ",").alias("sentences"),
        F.regexp_extract_all(F.array_join("letters", ""), F.lit(ALL_RULES), F.lit(0)).alias("runs"))
    licence = lambda r: F.element_at(_quoted(ALL_SEQUENCES), r)
    explained = F.filter(F.transform("runs", licence), lambda x: x.isNotNull())
    return runs.select("doc_id", "n_sentences", "sentences", F.array_join(explained, ",").alias("licences"),
                       (F.size("runs") - F.size(explained)).cast("long").alias("n_unexplained"))


def _map_sql(mapping: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in mapping.items()) + "}"


SCAN_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
m AS (SELECT doc_id, low, regexp_replace(regexp_replace(regexp_replace(low, '[.!?;:]+([ \\t\\r\\n]|$)', chr(1) || '\\1', 'g'),
             '[ \\t\\r]*\\n[ \\t\\r]*', chr(2), 'g'), '[^a-z0-9\\x01\\x02]+', ' ', 'g') AS words FROM t),
n AS (SELECT doc_id, low, '| ' || trim(regexp_replace(regexp_replace(words, ' *[\\x01\\x02]*\\x01[\\x01\\x02]* *', '{HARD}', 'g'), ' *\\x02+ *', '{SOFT}', 'g'), ' ') || ' |' AS norm FROM m),
f AS (SELECT doc_id, CASE WHEN regexp_matches(low, '{TRIGGER}') THEN regexp_extract_all(norm, '{SENTENCE_PATTERN}') ELSE [] END AS found FROM n),
l AS (SELECT doc_id, list_transform(found, lambda s: {_map_sql(BY_WORDS)}[regexp_replace(regexp_replace(s, '^[|/] | [|/]$', '', 'g'), ' [|/] [|/]', '', 'g')]) AS letters FROM f),
r AS (SELECT doc_id, letters, regexp_extract_all(coalesce(array_to_string(letters, ''), ''), '{RULE_PATTERN}') AS runs FROM l),
e AS (SELECT *, list_filter(list_transform(runs, lambda r: {_map_sql(SEQUENCES)}[r]), lambda x: x IS NOT NULL) AS explained FROM r)
SELECT doc_id, len(letters)::BIGINT AS n_sentences,
       coalesce(array_to_string(list_transform(letters, lambda x: {_map_sql({v: k for k, v in LETTERS.items()})}[x]), ','), '') AS sentences,
       coalesce(array_to_string(explained, ','), '') AS licences, (len(runs) - len(explained))::BIGINT AS n_unexplained
FROM e"""
