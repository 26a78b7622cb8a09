import itertools
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

import corpus_pipeline
from tessella.llm import licences, queries, roles

SCHEMA = "conv_id long, turn long, role string, text string, block int, cost int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def number(role):
    role = (role or "").strip().lower()
    role = roles.ALIASES.get(role, role)
    return roles.ROLES.index(role) + 1 if role in roles.ROLES else -1


def brute_cost(found):
    """Least cost by trying all choices for each turn, with insertions by breadth-first search."""
    best = None
    for choice in itertools.product(("merge", 1, 2, 3), repeat=len(found)):
        state, cost = roles.START, 0
        for role, x in zip(found, choice, strict=True):
            if x == "merge":
                if state == roles.START:
                    break
                cost += roles.MERGE + (roles.RELABEL if role != state else 0)
            else:
                if (state, x) not in roles.INSERTIONS:
                    break
                cost += roles.INSERT * len(roles.INSERTIONS[state, x]) + (roles.RELABEL if x != role else 0)
                state = x
        else:
            cost += roles.INSERT * len(roles.ENDINGS[state])
            best = cost if best is None else min(best, cost)
    return best


def test_repair_against_all_choices(spark):
    rng = random.Random(2)
    names = ["system", "user", "assistant", "tool", None, "human"]
    conversations = {i: [rng.choice(names) for _ in range(rng.randint(1, 5))] for i in range(60)}
    rows = [(c, t, r, f"{c}.{t}") for c, found in conversations.items() for t, r in enumerate(found)]
    got = {r["conv_id"]: r for r in roles.repaired(turns(spark, rows)).collect()}
    for c, found in conversations.items():
        assert got[c]["cost"] == brute_cost([number(r) for r in found])
        assert all(f"{c}.{t}" in got[c]["rendered"] for t in range(len(found)))
        marks = [x.split("\n")[0] for x in got[c]["rendered"].split("<|im_start|>")[1:]]
        state = roles.START
        for m in marks:
            assert roles.ROLES.index(m) + 1 in roles.LEGAL[state]
            state = roles.ROLES.index(m) + 1
        assert state == roles.ASSISTANT and got[c]["rendered"].count("<|im_end|>") == len(marks)


def test_blocks_repair_like_the_whole(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "x"]), f"<{t}>") for c in range(4) for t in range(50)]
    whole = {r["conv_id"]: r for r in roles.rendered_conversations(roles.repaired(turns(spark, rows))).collect()}
    monkeypatch.setattr(roles, "BLOCK", 7)
    monkeypatch.setattr(roles, "GROUP", 3)
    parts = {r["conv_id"]: r for r in roles.rendered_conversations(roles.repaired(turns(spark, rows))).collect()}
    assert {c: r["cost"] for c, r in parts.items()} == {c: r["cost"] for c, r in whole.items()}
    for r in parts.values():
        assert r["rendered"].count("<|im_start|>") == r["rendered"].count("<|im_end|>") and all(f"<{t}>" in r["rendered"] for t in range(50))


def test_one_turn_number_is_cut_into_blocks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(c, 1, rng.choice(["user", "assistant", " User", "x", None]), f"<{i}>") for c in (None, 5) for i in range(400)]
    rows += [(c, t, "user", "same") for c in (1, 9) for t in (0, None) for _ in range(40)]
    whole = {r["conv_id"]: r for r in roles.rendered_conversations(roles.repaired(turns(spark, rows))).collect()}
    monkeypatch.setattr(roles, "BLOCK", 8)
    monkeypatch.setattr(roles, "GROUP", 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        blocks = roles.repaired(turns(spark, rows).repartition(5))
        got = {r["conv_id"]: r for r in roles.rendered_conversations(blocks).collect()}
        sizes = [(r["conv_id"], r["n_turns"]) for r in blocks.collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(n for c, n in sizes if c is None) == [8] * 50 and sorted(n for c, n in sizes if c == 9) == [8] * 10
    assert {c: (r["n_turns"], r["cost"]) for c, r in got.items()} == {c: (r["n_turns"], r["cost"]) for c, r in whole.items()}
    for c in (None, 5):
        assert re.findall("<[0-9]+>", got[c]["rendered"]) == re.findall("<[0-9]+>", whole[c]["rendered"]) and len(re.findall("<[0-9]+>", got[c]["rendered"])) == 400


def test_legal_conversations_cost_nothing(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "User", "q"), (1, 2, "bot", "a"), (2, 5, "user", "q"), (2, 9, "assistant", None)]
    got = {r["conv_id"]: r for r in roles.repaired(turns(spark, rows)).collect()}
    assert got[1]["cost"] == got[2]["cost"] == 0
    assert got[1]["rendered"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"


def test_repair_odd_rows(spark):
    rows = [(None, 1, "user", "a"), (3, None, None, None), (3, 1, "user", "x"), (3, 1, "user", "x"), (4, -5, "assistant", "")]
    got = roles.repaired(turns(spark, rows)).collect()
    assert {(r["conv_id"]) for r in got} == {None, 3, 4} and sum(r["n_turns"] for r in got) == len(rows)
    assert roles.repaired(turns(spark, rows).limit(0)).count() == 0
    assert queries.op1_role_repair(spark, "/root/testdata/sf0.001").selectExpr("sum(n_turns)").first()[0] == spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").count()


MIT = """Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.
IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
BSD = """Copyright (c) 2001, Some One
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{}
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES ARE DISCLAIMED.
"""
BSD3 = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""


def commented(text, mark):
    return {"": text, "/*": "/*\n" + "".join(f" * {x}\n" for x in text.split("\n")) + " */\n"}.get(mark) or "".join(f"{mark} {x}\n" for x in text.split("\n"))


@pytest.mark.parametrize("mark", ["", "#", "//", "/*", "--", ";;"])
@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, ["MIT"]), (APACHE, ["Apache-2.0"]), (GPL, ["GPL-3.0-or-later"]), (BSD.format(""), ["All-rights-reserved", "BSD-2-Clause"]), (BSD.format(BSD3), ["All-rights-reserved", "BSD-3-Clause"]), (MPL, ["MPL-2.0"]),
        ("Words before. Licensed under the Apache License, Version 2.0.\nWords after.", ["Apache-2.0"]),
        ("Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3.", ["MIT", "GPL-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]), ("The licence of poets is wide. No warranty here.", []), ("", []),
    ],
)
def test_licence_texts_plain_and_in_comments(text, want, mark):
    ids, _ = licences.sentence_ids(commented(text, mark), licences.sentence_table(licences.SENTENCES))
    found, used = licences.licences(ids)
    assert found == want and all(used)


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE.
"""
NOTICE = "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software."


@pytest.mark.parametrize("mark", ["", "#", "/*"])
@pytest.mark.parametrize(
    ("text", "want"),
    [
        (MIT, ["MIT"]), (ISC, ["ISC"]), (BSD.format(""), ["All-rights-reserved", "BSD-2-Clause"]), (BSD.format(BSD3), ["All-rights-reserved", "BSD-3-Clause"]),
        (ISC.replace("this permission notice", "this notice"), ["ISC"]), (ISC.replace("appear in all copies", "are kept by all who copy"), []),
        (re.sub(r",\s+provided.*?copies\.", ".", ISC, flags=re.S), ["0BSD"]),
        (BSD.format("3. Everybody who uses this must say so on each of their pages."), ["All-rights-reserved"]),
        ("SPDX-License-Identifier: MIT", ["MIT"]), ("SPDX-License-Identifier: Apache-2.0\nint main;", ["Apache-2.0"]),
        ("SPDX-License-Identifier: (mit OR GPL-2.0-only WITH Classpath-exception-2.0) AND Foo-1.0+", ["MIT", "GPL-2.0-only", "Foo-1.0+"]), ("SPDX-License-Identifier:", ["SPDX"]),
        ("Released under the GPLv3.", ["GPL-3.0"]), ("GNU GPL v3 or later", ["GPL-3.0-or-later"]), ("Licensed under the Mozilla Public License 2.0.", ["MPL-2.0"]),
    ],
)
def test_no_rule_drops_a_condition(text, want, mark):
    table = licences.sentence_table(licences.SENTENCES)
    assert licences.text_licences(commented(text, mark), table)[2] == want


def test_rewording_of_the_notice_gives_no_laxer_licence():
    table = licences.sentence_table(licences.SENTENCES)
    notice = re.compile(r"The above copyright notice and this.*?Software\.", re.S)
    assert notice.search(MIT)
    for new, want in ((NOTICE, "MIT"), (NOTICE.replace("notice shall", "notice (including the next\nparagraph) shall"), "MIT"), (NOTICE.replace("shall be", "are to be"), None)):
        found = licences.text_licences(notice.sub(new, MIT), table)[2]
        assert "MIT-0" not in found and (want is None or want in found)
    free = re.sub(r",?\s*subject to\s+the following conditions:", ".", notice.sub("", MIT))
    assert "MIT-0" in licences.text_licences(free, table)[2]


def brute_sentences(text):
    """Known sentences by a pattern for each, tried at each start."""
    lines = []
    for x in text.split("\n"):
        x = re.sub(r"^\s*((#+|//+|/\*+|\*+/?|--+|;+)\s*)*", "", x)
        lines.append(re.sub(r"^(\(?[0-9a-z]{1,2}[.)]|[-•])[ \t]+", "", re.sub(r"\s*\*+/?\s*$", "", x), flags=re.I))
    parts, patterns = [], []
    for p in re.split(r"[\n.,:;!?()\[\]]", "\n".join(lines).lower().replace("licence", "license")):
        parts.append(re.findall(r"[^\W_]+", p))
    for name, t in [(name, t) for name, text in licences.SENTENCES.items() for t in (text, *licences.VARIANTS.get(name, ()))]:
        for head in ["", *[b + " " for b in licences.BEFORE_NAMES]] if name.endswith(("-name", "-long")) else [""]:
            whole = (head + t).replace("licence", "license")
            patterns.append((len(whole.split()) - whole.count("*"), name, re.compile(whole.replace(" * ", r"(?: \w+){0,12}? ") + r"(?!\w)")))
    patterns.sort(key=lambda x: -x[0])
    found, free, at = [], 0, 0
    for i, p in enumerate(parts):
        if p and at >= free:
            rest = " ".join(w for q in parts[i:] for w in q)
            for _, name, pattern in patterns:
                if m := pattern.match(rest):
                    found.append(name)
                    free = at + len(m[0].split())
                    break
        at += len(p)
    return found


@given(st.lists(st.sampled_from([*licences.SENTENCES]), min_size=1, max_size=5), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_sentences_against_a_brute_force_matcher(names, seed):
    rng = random.Random(seed)
    text = ""
    for n in names:
        filled = licences.SENTENCES[n].replace("*", " ".join(rng.choices(["Some", "Body", "2020", "and"], k=rng.randint(0, 12))))
        if n.endswith(("-name", "-long")) and rng.random() < 0.5:
            filled = rng.choice(licences.BEFORE_NAMES).capitalize() + " " + filled
        words = filled.split()
        text += rng.choice(["", "Other words. ", "words, "]) + "".join(w + rng.choice([" ", " ", " ", "\n", ", "]) for w in words) + rng.choice([". ", ".\n", ";\n\n"])
    text = commented(text, rng.choice(["", "#", "//", "/*"]))
    assert licences.sentence_ids(text, licences.sentence_table(licences.SENTENCES))[0] == brute_sentences(text)


def test_each_rule_is_found_by_its_sentences():
    table = licences.sentence_table(licences.SENTENCES)
    for name, sequence in licences.RULES:
        text = " words of no licence.\n\n".join(licences.SENTENCES[x].replace("*", "one two").capitalize() + "." for x in sequence)
        ids, _ = licences.sentence_ids(text, table)
        assert tuple(ids) == sequence and licences.licences(ids)[0] == [name]
    assert all(licences.MARKS.search(x) for x in licences.SENTENCES.values()) and len({n for n, _ in licences.RULES}) >= 40


def test_rules_are_ordered_sequences():
    rules = (("long", ("a", "b", "c")), ("short", ("a", "b")), ("one", ("c",)))
    assert licences.licences(["a", "b", "c"], rules) == (["long"], [True] * 3)
    assert licences.licences(["c", "a", "b"], rules)[0] == ["one", "short"]
    assert licences.licences(["a", "c", "b"], rules) == (["one"], [False, True, False])
    assert licences.licences(["a", "copyright", "b"], rules) == (["short"], [True, False, True])
    assert licences.licences(["a", "a", "b"], rules) == (["short"], [False, True, True])
    assert licences.licences(["mit-grant", "mit-name"]) == (["MIT"], [False, True])


def test_licence_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op2_licence_sentences(spark, sf).collect()}
    assert set(got) == set(docs)
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "All rights reserved.": "All-rights-reserved"}
    n = 0
    for d, t in docs.items():
        want = {v for k, v in lines.items() if k in t}
        n += bool(want)
        assert set(got[d]["licences"]) == want
    assert n > 0
    odd = spark.createDataFrame([(1, None), (1, ""), (None, "MIT License")], "doc_id long, text string")
    assert licences.scan(odd).count() == 3 and licences.scan(odd.limit(0)).count() == 0


def test_pipeline_stages_keep_columns_and_pack_all(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "packing":
            docs = docs.cache()
            assert docs.columns == columns and 0 < docs.count() <= before
            before = docs.count()
            kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in docs.select("doc_id").distinct().collect()} == kept
    whole = corpus_pipeline.run(spark, sf)
    assert whole.groupBy().sum("length").first()[0] == docs.groupBy().sum("length").first()[0]


def test_pipeline_stages_on_odd_documents(spark):
    """Nulls, empty and long texts, repeated rows, columns of names that the stages use, and an empty table."""
    sf = "/root/testdata/sf0.001"
    long = " ".join(f"w{i}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "some words of a text without an id"), (5, long), (6, long + " more"), (7, " \n "), (8, "x" * 20000)]
    docs = spark.createDataFrame([(d, t, None, "s" if d else None, 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(3) for c in ("label", "score", "text_id", "hits", "kept_id", "spans", "mark", "row", "words", "fingerprint", "bucket", "_digest")})
    for start in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[1:]:
            found = stage(spark, start, sf)
            assert name == "packing" or found.columns == docs.columns
            assert 0 < found.count() <= 9 * (1 if name != "packing" else 100) if start is docs else found.count() == 0
        quality = corpus_pipeline.STAGES[0][1](spark, start, sf)
        assert quality.columns == docs.columns and quality.count() <= 9
    near = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert near == {1, 3, 5, 8, None}
