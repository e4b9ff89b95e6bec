import itertools
import textwrap

from helpers import documents

from beleg.llm import licenses
from beleg.llm.license_texts import TEMPLATES

MIT, APACHE = TEMPLATES["MIT"], TEMPLATES["Apache-2.0-notice"]


def slow_wording(template, block):
    best = len(template)
    for a, b in itertools.combinations(range(len(block) + 1), 2):
        part = block[a:b]
        row = list(range(len(part) + 1))
        for i, w in enumerate(template, 1):
            new = [i]
            for j, v in enumerate(part, 1):
                new.append(min(row[j - 1] + (w != v), row[j] + 1, new[-1] + 1))
            row = new
        best = min(best, row[-1])
    return best


def test_wording_equals_all_stretches():
    words = "a b c d".split()
    for t in itertools.product("abx", repeat=3):
        for block in (["a"], ["b", "a", "x"], "c a b x d".split(), "x x a a b".split(), words):
            assert licenses.wording(list(t), block) == slow_wording(list(t), block), (t, block)


def test_every_template_is_found_as_itself():
    known = licenses.Templates(TEMPLATES)
    for name, text in TEMPLATES.items():
        found = known.judge(licenses.words_of(text.upper()))
        assert found[0] == name and found[4] == 0, (name, found)


def test_scan(spark):
    wrapped = "\n".join(textwrap.wrap(MIT, 70))
    texts = [
        None, "", "no notice here", f"Some code.\n{APACHE}\nFoxes sleep.", f"Tale of a fox.\nCopyright (c) 2020 Jane Doe\n{MIT}\nThe fox ran off.", wrapped,
        MIT.replace("Software", "Program", 3), "The warranty of my new car was a good deal and I liked it.", f"{APACHE} And then\nnothing.\n\n{TEMPLATES['Proprietary']}", APACHE + " x" * 20000,
        "it mentions a license"]
    rows = [*enumerate(texts), (3, texts[3])]
    got = {}
    for r in licenses.scan(documents(spark, rows).selectExpr("*", "1 AS license", "2 AS start")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == {3, 4, 5, 6, 7, 8, 9, 10}
    assert len(got[3]) == 2 and {(r["license"], r["n_different"]) for r in got[3]} == {("Apache-2.0-notice", 0)}
    assert all(texts[3][r["start"]:r["stop"]] == APACHE for r in got[3])
    (mit,) = got[4]
    assert mit["license"] == "MIT" and mit["n_different"] == 0 and texts[4][mit["start"]:mit["stop"]].startswith("Copyright") and texts[4][mit["start"]:mit["stop"]].endswith("SOFTWARE.")
    assert [(r["license"], r["n_different"]) for r in got[6]] == [("MIT", 3)]
    assert [r["license"] for r in got[7]] == ["unconfirmed"] and [r["license"] for r in got[10]] == ["unconfirmed"]
    assert sorted(r["license"] for r in got[8]) == ["Apache-2.0-notice", "Proprietary"]
    assert [(r["start"], r["license"]) for r in got[9]] == [(0, "Apache-2.0-notice")]
    assert [(r["license"], r["n_different"] < 40) for r in got[5]] == [("MIT", True)]


def test_each_license_of_a_block(spark):
    bsd = TEMPLATES["BSD-3-Clause"]
    texts = [f"{APACHE} Released under the MIT License.", f"Copyright 2020 Jane Doe. All rights reserved.\n{bsd}", f"{MIT}\n\n{TEMPLATES['Apache-2.0']} {APACHE}"]
    got = [[], [], []]
    for r in licenses.scan(documents(spark, texts)).collect():
        text = texts[r["doc_id"]]
        assert (r["start"], r["stop"], r["n_different"]) == (0, len(text), 0)
        got[r["doc_id"]].append((r["match_start"], r["license"], text[r["match_start"]:r["match_stop"]]))
    assert [[x[1] for x in sorted(g)] for g in got] == [["Apache-2.0-notice", "MIT-notice"], ["Proprietary", "BSD-3-Clause"], ["MIT", "Apache-2.0", "Apache-2.0-notice"]]
    assert [x[2] for x in sorted(got[0])] == [APACHE[:-1], "Released under the MIT License"]


def test_wording_that_tells_licenses_apart():
    gpl = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free "
           "Software Foundation; either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be "
           "useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General "
           "Public License for more details.")
    long = "This work is licensed under a Creative Commons {} 4.0 International License."
    cases = {
        gpl.format("", 2): "GPL-2.0-or-later", gpl.format("", 3): "GPL-3.0-or-later", gpl.format("Lesser ", 3): "LGPL-3.0-or-later", gpl.format("Affero ", 3): "AGPL-3.0-or-later",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0", "Licensed under CC BY 4.0.": "CC-BY-4.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "Licensed under CC BY-NC 2.5.": "unconfirmed",
        long.format("Attribution-NonCommercial"): "CC-BY-NC-4.0", long.format("Attribution-ShareAlike"): "CC-BY-SA-4.0", "Licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "Released under the ISC License.": "ISC", "Released under the Foo License.": "unconfirmed", "Licensed under the BSD 2-Clause License": "BSD-2-Clause", TEMPLATES["BSD-2-Clause"]: "BSD-2-Clause"}
    known = licenses.Templates(TEMPLATES)
    for text, want in cases.items():
        (got,) = known.all(licenses.words_of(text))
        assert got[0] == want or got[0].startswith(want + "-") and got[0].removeprefix(want + "-") in ("notice", "short", "long", "first"), (text, got)


def test_ranking_is_by_saved_bytes():
    known = licenses.Templates(TEMPLATES)
    size, ranked = known.ranked(licenses.words_of(MIT + " and some more words"))
    assert ranked[0][1] == "MIT" and [r[0] for r in ranked] == sorted((r[0] for r in ranked), reverse=True) and size > ranked[0][0] > 0


def test_empty_table(spark):
    assert licenses.scan(documents(spark, []).filter("doc_id < 0")).collect() == []
