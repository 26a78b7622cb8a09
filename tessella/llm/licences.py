"""Licence recognition by sentences: normalised sentences are mapped to identifiers of known licence sentences, and the
sequence of identifiers of a text is matched against ordered licence rules.

Comment marks at line starts and list numbers are dropped, then wrapped lines are joined: a sentence may run over any
number of lines. Normalising lower-cases, spells `licence` one way, and leaves words and numbers with single spaces. A
sentence begins at the start of a line or after a full stop, colon, semicolon, comma or bracket, and is looked up by its
first three words; all its words must then be there, where `*` in the table stands for up to twelve words such as names
and years. Where several known sentences begin at one place the longest is taken, and the next one begins after it.

A rule is a sequence of identifiers that must come in this order; sentences that are not known and those of `ASIDE` may
come in between, other known ones may not. Rules are tried from the most specific, and what a rule has used counts once.

Nulls: a null text has no sentences. Texts without licence sentences have empty arrays. Null ids are kept and repeated
rows are scanned one by one. Very long texts are scanned whole, in one pass. Other columns are not read. An empty table
gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import small_batches, whole_text

# Sentences of public licences and of usual notices, by identifier.
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
    "mit-name": "mit license",
    "x11-name": "except as contained in this notice the name * shall not be used in advertising or otherwise to promote the sale use or other dealings in this software",
    "apache2-name": "apache license version 2 0",
    "apache2-comply": "you may not use this file except in compliance with the license",
    "apache2-copy": "you may obtain a copy of the license at",
    "apache2-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-endorse": "neither the name of * nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-endorse-holder": "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by * as is and any express or implied warranties",
    "bsd3-name": "bsd 3 clause license",
    "bsd2-name": "bsd 2 clause license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software",
    "gpl2-free": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3-free": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-only-free": "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    "lgpl21-free": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl3-free": "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-hope": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl-copy": "you should have received a copy of the gnu lesser general public license along with this",
    "agpl-copy": "you should have received a copy of the gnu affero general public license along with this program",
    "gpl3-name": "gnu general public license version 3",
    "gpl2-name": "gnu general public license version 2",
    "gpl3-v-name": "gplv3",
    "gpl2-v-name": "gplv2",
    "gpl3-gnu-name": "gnu gpl v3",
    "gpl2-gnu-name": "gnu gpl v2",
    "gpl3-later-name": "gnu gpl v3 or later",
    "gpl2-later-name": "gnu gpl v2 or later",
    "mpl2-short-name": "mozilla public license 2 0",
    "mpl2-version-name": "mozilla public license version 2 0",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "mpl2-name": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "mpl11-name": "the contents of this file are subject to the mozilla public license version 1 1",
    "epl1-name": "eclipse public license v1 0",
    "epl2-name": "eclipse public license 2 0",
    "epl2-name-v": "eclipse public license v 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "boost-name": "boost software license version 1 0",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "wtfpl": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    "cc-by4-name": "cc by 4 0",
    "cc-by4-long": "creative commons attribution 4 0 international",
    "cc-by-sa4-name": "cc by sa 4 0",
    "cc-by-sa4-long": "creative commons attribution sharealike 4 0 international",
    "cc-by-nc4-name": "cc by nc 4 0",
    "cc-by-nc4-long": "creative commons attribution noncommercial 4 0 international",
    "cc-by-nd4-name": "cc by nd 4 0",
    "cc-by-nd4-long": "creative commons attribution noderivatives 4 0 international",
    "cc0-name": "cc0 1 0",
    "cddl-name": "the contents of this file are subject to the terms of the common development and distribution license",
    "artistic2-name": "artistic license 2 0",
    "psf-name": "python software foundation license version 2",
    "mspl-name": "microsoft public license",
    "ofl-name": "this font software is licensed under the sil open font license version 1 1",
    "eupl-name": "european union public licence v 1 2",
    "upl-name": "universal permissive license version 1 0",
    "odbl-name": "open database license",
    "copyright": "copyright * all rights reserved",
    "all-rights": "all rights reserved",
    "see-license": "see the license file for details",
    "spdx": "spdx license identifier",
}
# Other wordings of sentences, by the identifier that they have too.
VARIANTS = {
    "mit-notice": ("the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice shall be included in all copies of the software"),
    "isc-grant": ("permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this notice appear in all copies", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this notice appear in all copies"),
}
# Words that stand before a licence's name in usual notices, in front of the identifiers that end in -name or -long.
BEFORE_NAMES = ("licensed under the", "licensed under a", "licensed under", "released under the", "distributed under the", "available under the", "this work is licensed under the", "this work is licensed under a", "this work is licensed under", "under the terms of the", "released under the terms of the", "licensed under the terms of the", "the")
# Ordered rules, from the most specific.
RULES = (
    ("Apache-2.0", ("apache2-name", "apache2-comply", "apache2-copy", "apache2-unless")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-as-is")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse-holder", "bsd-as-is")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-as-is")),
    ("X11", ("mit-grant", "mit-notice", "mit-as-is", "x11-name")),
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is", "mit-liability")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl3-free", "gpl-hope", "gpl-copy")),
    ("GPL-2.0-only", ("gpl2-only-free", "gpl-hope", "gpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "gpl-hope", "lgpl-copy")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "gpl-hope", "lgpl-copy")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope", "lgpl-copy")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope", "agpl-copy")),
    ("Zlib", ("zlib-as-is", "zlib-grant", "zlib-origin")),
    ("BSL-1.0", ("boost-name", "boost-grant")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("MPL-2.0", ("mpl2-name", "mpl2-copy")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT-0", ("mit-grant", "mit-as-is")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0-or-later", ("gpl3-free",)),
    ("GPL-2.0-only", ("gpl2-only-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("GPL-3.0", ("gpl3-title",)),
    ("GPL-2.0", ("gpl2-title",)),
    ("LGPL-3.0", ("lgpl3-title",)),
    ("LGPL-2.1", ("lgpl21-title",)),
    ("AGPL-3.0", ("agpl3-title",)),
    ("Apache-2.0", ("apache2-name",)),
    ("BSD-3-Clause", ("bsd3-name",)),
    ("BSD-2-Clause", ("bsd2-name",)),
    ("MIT", ("mit-name",)),
    ("GPL-3.0", ("gpl3-name",)),
    ("GPL-2.0", ("gpl2-name",)),
    ("GPL-3.0-or-later", ("gpl3-later-name",)),
    ("GPL-2.0-or-later", ("gpl2-later-name",)),
    ("GPL-3.0", ("gpl3-v-name",)),
    ("GPL-2.0", ("gpl2-v-name",)),
    ("GPL-3.0", ("gpl3-gnu-name",)),
    ("GPL-2.0", ("gpl2-gnu-name",)),
    ("MPL-2.0", ("mpl2-short-name",)),
    ("MPL-2.0", ("mpl2-version-name",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("MPL-2.0", ("mpl2-name",)),
    ("MPL-1.1", ("mpl11-name",)),
    ("EPL-1.0", ("epl1-name",)),
    ("EPL-2.0", ("epl2-name",)),
    ("EPL-2.0", ("epl2-name-v",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-name",)),
    ("WTFPL", ("wtfpl",)),
    ("CC-BY-4.0", ("cc-by4-name",)),
    ("CC-BY-4.0", ("cc-by4-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-name",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-name",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-long",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4-name",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4-long",)),
    ("CC0-1.0", ("cc0-name",)),
    ("CDDL", ("cddl-name",)),
    ("Artistic-2.0", ("artistic2-name",)),
    ("PSF-2.0", ("psf-name",)),
    ("MS-PL", ("mspl-name",)),
    ("OFL-1.1", ("ofl-name",)),
    ("EUPL-1.2", ("eupl-name",)),
    ("UPL-1.0", ("upl-name",)),
    ("ODbL", ("odbl-name",)),
    ("SPDX", ("spdx",)),
    ("See-file", ("see-license",)),
    ("All-rights-reserved", ("copyright",)),
    ("All-rights-reserved", ("all-rights",)),
)
#: Sentences that may stand between those of any rule.
ASIDE = frozenset({"copyright", "all-rights"})
#: Licences that lack a condition of another: their grants must not be followed by words that no known sentence has, as
#: these may be that condition reworded.
LAX = frozenset({"MIT-0", "0BSD", "BSD-2-Clause", "BSD-3-Clause"})
SPDX = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\n]*)", re.I)
SPDX_PART = re.compile(r"[()\s]*([a-z0-9][a-z0-9.-]*\+?)[()]*", re.I)
#: Each known sentence holds one of these in lower case, so texts without any are passed over.
MARKS = re.compile(r"licen[sc]e|warrant|copyright|permission|redistribut|liable|endorse|unencumbered|reserved|compliance|permitted|cc0|cc\W{0,8}by|useful|misrepresented|distribute|mpl\W{1,8}was|commons|acknowledg|advertis|gpl|mozilla")
#: Comment marks at the start of a line, then the number or bullet of a list; ends of comments.
LINE_START = re.compile(r"^[ \t]*(?:(?:#+|//+|/\*+|\*+/?|--+|;+|%+|<!--|\"\"\"|'''|>+|rem\b|dnl\b)[ \t]*)*(?:\(?[0-9a-z]{1,2}[.)][ \t]+|[-•][ \t]+)?", re.I | re.M)
LINE_END = re.compile(r"[ \t]*(?:\*+/|-->|\*+)?[ \t]*$", re.M)
ENDS = re.compile(r"[.!?]+(?=\s|$)|\n\s*\n")
WORD_OR_BREAK = re.compile(r"[^\W_]+|[\n.,:;!?()\[\]]")
VARIABLE = 12  # words that * may stand for


def sentence_table(sentences: dict[str, str]) -> dict[tuple[str, ...], list[tuple[str, list[list[str]]]]]:
    """Known sentences by their first words (three, or all before a variable part), longest first: (identifier, its parts)."""
    table: dict[tuple[str, ...], list] = {}
    wordings = [(name, t) for name, text in sentences.items() for t in (text, *VARIANTS.get(name, ()))]
    for name, text in wordings:
        heads = [f"{b} " for b in BEFORE_NAMES] if name.endswith(("-name", "-long")) else []
        for head in ["", *heads]:
            parts = [p.split() for p in (head + text).replace("licence", "license").split("*")]
            table.setdefault(tuple(parts[0][:3]), []).append((name, parts))
    for found in table.values():
        found.sort(key=lambda x: -sum(map(len, x[1])))
    return table


def length_of(parts: list[list[str]], words: list[str], at: int) -> int:
    """How many words from `at` the sentence takes, 0 if it is not there."""
    end = at + len(parts[0])
    if words[at:end] != parts[0]:
        return 0
    for part in parts[1:]:
        end = next((i + len(part) for i in range(end, min(end + VARIABLE, len(words) - len(part)) + 1) if words[i : i + len(part)] == part), 0)
        if not end:
            return 0
    return end - at


def found_sentences(text: str, table: dict) -> tuple[list[str], int, list[bool]]:
    """Identifiers of the known sentences of a text, in order, the number of its sentences, and whether unknown words follow
    each: up to the next known sentence, or to the end of its own if it is the last. List numbers are no such words."""
    n = sum(1 for p in ENDS.split(text) if p and not p.isspace())
    text = text.lower()
    if not MARKS.search(text):
        return [], n, []
    words, starts, stops = [], [0], []
    for w in WORD_OR_BREAK.findall(LINE_END.sub("", LINE_START.sub("", text)).replace("licence", "license")):
        if w.isalnum():
            words.append(w)
            continue
        if starts[-1] != len(words):
            starts.append(len(words))
        if w in ".!?":
            stops.append(len(words))
    out, spans, free = [], [], 0
    for at in starts:
        if at < free:
            continue
        for k in (3, 2, 1):
            for name, parts in table.get(tuple(words[at : at + k]), ()):
                if at >= free and (taken := length_of(parts, words, at)):
                    out.append(name)
                    free = at + taken
                    spans.append((at, free))
    stops.append(len(words))
    ends = [at for at, _ in spans[1:]] + [stops[bisect_left(stops, e)] for _, e in spans[-1:]]
    return out, n, [any(len(w) > 2 for w in words[e:to]) for (_, e), to in zip(spans, ends, strict=True)]


def sentence_ids(text: str, table: dict) -> tuple[list[str], int]:
    """Identifiers of the known sentences of a text, in order, and the number of its sentences."""
    return found_sentences(text, table)[:2]


def spdx_names(text: str) -> list[str]:
    """The licences of the SPDX expressions of a text, in order; exceptions after WITH are none. Those that rules know are
    written as there, others as in the text."""
    names = {name.lower(): name for name, _ in RULES}
    found = []
    for m in SPDX.finditer(text):
        at, before = 0, "and"
        while (part := SPDX_PART.match(m[1], at)) and (here := part[1].rstrip(".-")):
            operator = here.lower() in ("and", "or", "with")
            if operator == (before in ("and", "or", "with")):
                break
            if not operator and before != "with":
                found.append(names.get(here.lower(), here))
            at, before = part.end(), here.lower() if operator else ""
    return list(dict.fromkeys(found))


def licences(ids: list[str], rules=RULES, aside: frozenset = ASIDE, followed: list[bool] | None = None, lax: frozenset = LAX) -> tuple[list[str], list[bool]]:
    """Names of the rules that match, in the order of their places, and which identifiers they used; each is used once.
    followed: whether unknown words follow each identifier's sentence, which ends the rules of `lax` names."""
    used, found = [False] * len(ids), []
    for name, sequence in rules:
        i = 0
        strict = followed and name in lax and not sequence[-1].endswith("-name")
        while i < len(ids):
            places, j = [], i
            while j < len(ids) and len(places) < len(sequence) and not used[j]:
                if ids[j] == sequence[len(places)]:
                    places.append(j)
                elif not places or ids[j] not in aside:
                    break
                if strict and followed[j] and (len(places) < len(sequence) or len(sequence) == 1):
                    break
                j += 1
            if len(places) == len(sequence) and not (strict and len(sequence) == 1 and followed[places[0]]):
                found.append((i, name))
                for p in places:
                    used[p] = True
                i = j
            else:
                i += 1
    return list(dict.fromkeys(name for _, name in sorted(found))), used


def text_licences(text: str, table: dict, rules=RULES) -> tuple[list[str], int, list[str], list[bool]]:
    """The known sentences of a text, its number of sentences, its licences, and which of the known sentences these use."""
    ids, n, followed = found_sentences(text, table)
    found, used = licences(ids, rules, followed=followed)
    if "SPDX" in found and (named := spdx_names(text)):
        k = found.index("SPDX")
        found = list(dict.fromkeys([*found[:k], *named, *found[k + 1 :]]))
    return ids, n, found, used


SCANNED = "doc_id long, n_sentences long, sentence_ids array<string>, licences array<string>, unmatched long"


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules=RULES) -> DataFrame:
    """One row for each of docs (doc_id, text): its known sentences, the licences that rules find, and how many of the
    known sentences no rule has used."""
    small_batches(docs.sparkSession)
    known = sentences or SENTENCES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sentence_table(known)
        names = [c.split()[0] for c in SCANNED.split(", ")]
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids, n, found, used = text_licences(text, table, rules)
                rows.append((doc_id, n, ids, found, used.count(False)))
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, SCANNED)
