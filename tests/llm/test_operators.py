"""The operators of lorewell.llm on small hand-made tables, against brute force."""

import hashlib
import io
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

TRICKY = [
    None, "", " \n\t ", "one", "one two three four", "Hello, it's 3.14 o'clock… l'été d'Été 'S 'll",
    "<|endoftext|> between <|startoftext|> words", "日本語 テキスト と 한국어", "a" * 5000, "word " * 3000, "x\x1cy \x00 z", "İI ẞß ﬁ ½ W̊ é", "Ünïcode ÀÉ, ÖÜ;", "...!!!---", "12 345 6",
]


def docs(spark, texts, extra=True):
    rows = [(k, t, "en", "s", 0, 1, "x", 2) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, rep string, bucket long")
    return df if extra else df.select("doc_id", "text", "lang", "source", "n_chars")


@pytest.fixture(scope="module")
def tokenizer():
    from lorewell.llm._tokens import load, tokenizer_path

    return load(tokenizer_path("word_bpe_49k.json"))


def ids_of(tokenizer, t):
    return tokenizer.encode(t or "", add_special_tokens=False).ids


# ---- 1
def test_chat_keeps_maximal_conversations(spark):
    from lorewell.llm.chat_format import chat_format

    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, None, None), (5, 0, None, ""), (None, 0, "user", "z"), (6, 0, "user", "b"), (6, 0, "user", "a")]
    df = spark.createDataFrame([(*r, 1, "e") for r in rows], "conv_id long, turn long, role string, text string, pos long, h1 string")
    got = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in chat_format(df).collect()}
    assert set(got) == {2, 4, 5, 6, None}
    assert got[2] == (2, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n")
    assert got[4] == (1, "<|im_start|>unknown\n<|im_end|>\n") and got[6][1].index("\na<") < got[6][1].index("\nb<")
    assert chat_format(df.limit(0)).count() == 0
    long = spark.createDataFrame([("a", k, "user", "x" * 50_000) for k in range(40)] + [("b", k, "user", "x" * 50_000) for k in range(39)] + [(None, 0, "user", "x" * 50_000)], "conv_id string, turn long, role string, text string")
    assert [(r["conv_id"], r["n_turns"], len(r["rendered"]) > 2_000_000) for r in chat_format(long.union(long)).collect()] == [("a", 40, True)]


# ---- 2
def test_license_rules(spark):
    from lorewell.llm.license_scan import license_scan

    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
    texts = [None, "", "Prose. Released under the MIT License. More.", "Licensed under the Apache License, Version 2.0.\nLicensed under CC BY-NC 4.0.", "released under the  mit\nlicense", "All Rights Reserved! " * 2, apache, "the MIT licence is nice"]
    got = [r["licenses"] for r in license_scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["", "", "MIT", "Apache-2.0,CC-BY-NC-4.0", "MIT", "Proprietary", "Apache-2.0", ""]
    assert license_scan(docs(spark, texts)).where("doc_id = 5").first()["n_sentences"] == 2
    assert license_scan(docs(spark, []).limit(0)).count() == 0


# ---- 3
MIT = """Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software{0} you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation{1} either version {2} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
ISC = """Copyright (c) 2004, Someone

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.
"""
CC = """This work is licensed under a Creative Commons
Attribution{0} 4.0 International License.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented.
"""
EPL = """This program and the accompanying materials are made available under the
terms of the Eclipse Public License 2.0 which is available at
https://www.eclipse.org/legal/epl-2.0/
"""


def wrapped(text, width):
    import textwrap

    return "\n\n".join(textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in text.split("\n\n")) + "\n"


def test_license_texts_wrapped_and_in_capitals(spark):
    from lorewell.llm.license_scan import license_scan

    rights = "Copyright (c) 2020, Someone\nAll rights reserved.\n\n"
    affero = GPL.format(":", ",", 3).replace("GNU General", "GNU Affero General").replace("GNU\nGeneral", "GNU Affero\nGeneral")
    lesser = GPL.format(":", ",", 3).replace("GNU General", "GNU Lesser General")
    whole = [
        (MIT, "MIT"), (APACHE, "Apache-2.0"), (GPL.format(":", ",", 3), "GPL-3.0-or-later"), (GPL.format(";", ";", 2), "GPL-2.0-or-later"), (LGPL, "LGPL-2.1-or-later"), (lesser, "LGPL-3.0-or-later"), (affero, "AGPL-3.0-or-later"),
        (rights + BSD, "BSD-3-Clause"), (rights + BSD[: BSD.index("3. Neither")], "BSD-2-Clause"), (MPL, "MPL-2.0"), (ISC, "ISC"), (ZLIB, "Zlib"), (EPL, "EPL-2.0"),
        (CC.format(""), "CC-BY-4.0"), (CC.format("-ShareAlike"), "CC-BY-SA-4.0"), (CC.format("-NonCommercial"), "CC-BY-NC-4.0"), (CC.format("-NonCommercial-ShareAlike"), "CC-BY-NC-SA-4.0"), (CC.format("-NoDerivatives"), "CC-BY-ND-4.0"),
        ("x. This License establishes the terms under which a given free software Package may be copied, modified, distributed, and/or redistributed.", "Artistic-2.0"), ("Licensed under CC0 1.0.", "CC0-1.0"),
    ]
    forms = [lambda t: t, str.upper, *(lambda t, n=n: wrapped(t, n) for n in (40, 60, 72, 200)), lambda t: wrapped(t.upper(), 50)]
    cases = [(form(t), name) for t, name in whole for form in forms] + [("word " * 300_000 + "\n\n" + MIT, "MIT"), (rights, "Proprietary"), (rights.upper(), "Proprietary")]
    got = [r["licenses"] for r in license_scan(docs(spark, [t for t, _ in cases])).orderBy("doc_id").collect()]
    assert [(g, t[:60]) for (t, name), g in zip(cases, got, strict=True) if g != name] == []


def test_license_canonical_texts(spark):
    from lorewell.llm.license_scan import license_scan

    whole = [(MIT, "MIT", 3), (APACHE, "Apache-2.0", 5), (GPL.format(":", ",", 3), "GPL-3.0-or-later", 3), (GPL.format(";", ";", 2), "GPL-2.0-or-later", 3), (MPL, "MPL-2.0", 2), (BSD, "BSD-3-Clause", 4)]
    forms = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "".join(f"# {x}\n" for x in t.splitlines()), lambda t: "/*\n" + "".join(f" * {x}\n" for x in t.splitlines()) + " */\n"]
    cases = [(form("Some prose\n\n" + t), name, n) for t, name, n in whole for form in forms]
    cases += [("It is not licensed under the MIT License.", "", 0), ("Licensed under the Apache License, Version 2.0.\nThe License.", "Apache-2.0", 1), ("It is not\nlicensed under the MIT License.", "", 0)]
    got = license_scan(docs(spark, [t for t, *_ in cases])).orderBy("doc_id").collect()
    assert [(r["licenses"], r["n_sentences"]) for r in got] == [(name, n) for _, name, n in cases]


PAGE = '<!DOCTYPE html><html><head><title>t{0}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h2>Site</h2></header><nav><ul><li><a href=x>Menu {0}</a></li></ul></nav><div class="ad-box">Buy {0}</div>{1}<div id="comments"><p>nice {0}</p></div><aside>side {0}</aside><div class="cookie-notice">We use cookies</div><footer>&copy; {0}</footer></body></html>'


def test_html_main_text(spark):
    from lorewell.llm.html_extraction import extract, html_extraction

    bodies = [f"<article><h1>Title {k}</h1><p>First&nbsp;&amp; <b>bold</b>   text {k}<br>next<p>Second {k}<form>search</form><p>Posted by the site</p></article>" for k in range(6)]
    want = [f"Title {k}\n\nFirst & bold text {k} next\n\nSecond {k}" for k in range(6)]
    assert extract([PAGE.format(k, b) for k, b in enumerate(bodies)]) == want
    plain = [f"<div class=wrap><div class=x><p>Long running text number {k}, that goes on and on.</p><p>It ends {k}.</p></div></div>" for k in range(5)]
    assert extract([PAGE.format(k, b) for k, b in enumerate(plain)]) == [f"Long running text number {k}, that goes on and on.\n\nIt ends {k}." for k in range(5)]
    rows = [(k, f"http://h.example/{k}", PAGE.format(k, b), "h", 1) for k, b in enumerate(bodies)] + [(90, None, None, "h", 1), (91, "http://h.example/x", "", "h", 1), (92, "bad", "<p>only <i>this", "h", 1), (0, "http://h.example/0", PAGE.format(0, bodies[0]), "h", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, part int")
    got = html_extraction(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    by = {r["page_id"]: r["text"] for r in got}
    assert [by[k] for k in range(6)] == want and by[90] == by[91] == "" and by[92] == "only this"
    assert html_extraction(df.limit(0)).count() == 0


def test_html_never_crashes():
    from lorewell.llm.html_extraction import extract

    odd = ["<", "<<>>", "</p>", "<p", "<!--", "<script>", "a<b>c", "&#0;&#xD800;&bogus;&amp", "<table><tr><td>x<td>y</table>", "<div>" * 3 + "deep" + "</div>"]
    assert len(extract(odd)) == len(odd) and extract(["<p>x" * 2000])[0].count("x") == 2000


# ---- 4
def test_html_raw_elements_end_where_lower_case_is_longer():
    from lorewell.llm.html_extraction import extract

    page = "<html><head><TITLE>İstanbul</Title><style>p{}</STYLE></head><body><article><p>İlk söz.</p><script>a()</Script><p>Son söz.</p></article></body></html>"
    assert extract([page]) == ["İlk söz.\n\nSon söz."]


def test_html_template_goes_from_every_page_of_a_host(spark):
    from lorewell.llm.html_extraction import html_extraction

    page = "<html><body><article><h1>Title {0}</h1><p>Story {0} is told here.</p><p>All stories are made up.</p></article></body></html>"
    rows = [(1000 * n + k, f"https://h{n}.example/{k}", page.format(1000 * n + k)) for n in (5, 33, 35, 66, 131) for k in range(n)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in html_extraction(df).collect()}
    assert got == {k: f"Title {k}\n\nStory {k} is told here." for k, _, _ in rows}


def test_html_long_notices_and_long_child_lists():
    from lorewell.llm.html_extraction import extract

    notice = "This notice is long. " * 200
    pages = [f"<html><body><article><p>Story {k} is told here.</p><p>{notice}</p></article></body></html>" for k in range(6)]
    assert extract(pages) == [f"Story {k} is told here." for k in range(6)]


def random_tree(rng, depth):
    from lorewell.llm.html_extraction import Node

    node = Node("abc"[rng.integers(0, 2)], frozenset(["x", "y"][: int(rng.integers(0, 2))]))
    if depth:
        node.kids = [random_tree(rng, depth - 1) for _ in range(int(rng.integers(0, 5)))]
    return node


def brute_gain(a, b):
    if a.tag != b.tag:
        return 0
    best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids):
        for j, y in enumerate(b.kids):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute_gain(x, y))
    return 1 + (a.marks == b.marks) + best[-1][-1]


@pytest.mark.parametrize("cells", [1 << 20, 4])
def test_html_tree_matching_against_brute_force(monkeypatch, cells):
    from lorewell.llm import html_extraction as H

    monkeypatch.setattr(H, "MOST_CELLS", cells)
    rng, m = np.random.default_rng(cells), H.Matcher()
    for _ in range(150):
        a, b = random_tree(rng, 3), random_tree(rng, 3)
        assert m.gain(m.number(a), m.number(b)) == brute_gain(a, b)
        pairs = m.align([m.number(k) for k in a.kids], [m.number(k) for k in b.kids])
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))


def test_html_wrapper_decides_without_telling_names():
    from lorewell.llm.html_extraction import extract

    page = "<html><body><div class=k1><div class=k2>The daily something, since 1900</div><div class=k3><h1>All the news</h1><a href=/{0}>Other {0}</a> <a href=/b>More of it {0}</a></div><div class=k4><h2>Title {0}</h2><p>It was told {0} times, and at some length.<p>Sign up for our letter today.<div>One, {0}, end.</div></div><div class=k5><p>Terms apply to all readers of this site, wherever they may be and whatever they read.</p></div></div></body></html>"
    pages = [page.format(k) for k in range(7)]
    want = [f"Title {k}\n\nIt was told {k} times, and at some length.\n\nOne, {k}, end." for k in range(7)]
    assert extract(pages) == want and extract(pages, induce=False) != want
    assert extract(pages[:2]) == extract(pages[:2], induce=False)


def test_html_deep_and_unclosed_pages_are_fast():
    import time

    from lorewell.llm.html_extraction import extract

    began = time.time()
    assert extract(["<div>" * 10_000 + f"deep {k}" + "</div>" * 10_000 + f"<p>after {k}" for k in range(5)]) == [f"deep {k}\n\nafter {k}" for k in range(5)]
    assert extract(["<a " * 200_000])[0].startswith("<a <a") and extract(["<b '" * 50_000 + '<i "' * 50_000]) is not None
    nested = [("<div><ul><li>" * d) + "x" + ("<p>y" * k) for k, d in enumerate((20, 21, 24, 30))]
    assert len(extract(nested)) == 4 and time.time() - began < 20


def test_packing_is_whole_and_tight(spark, tokenizer):
    from lorewell.llm.best_fit_packing import best_fit_packing

    texts = [*TRICKY, *(" ".join(["the"] * n) for n in range(100, 1000, 45)), "the " * 9000]
    df = docs(spark, texts)
    rows = best_fit_packing(df.union(df.where("doc_id = 3"))).collect()
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for k, t in enumerate(texts):
        want = [*ids_of(tokenizer, t), 1]
        own = sorted(by_doc[k], key=lambda r: r["piece"])[:: 2 if k == 3 else 1]
        assert [r["start"] for r in own] == list(range(0, len(want), 4096))
        for r in own:
            part = np.array(want[r["start"] : r["start"] + 4096], "<u4")
            assert r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part.tobytes())
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(sequences) == -(-sum(r["length"] for r in rows) // 4096)
    assert best_fit_packing(df.limit(0)).count() == 0


def test_crossover_keeps_every_piece():
    from lorewell.llm.best_fit_packing import Packer

    rng = np.random.default_rng(3)
    lengths = np.sort(rng.integers(1, 100, 300))[::-1]
    p = Packer(lengths, 100, rng)
    population = p.evolve([], 30, 5)
    child = p.crossover(population[0], population[-1])
    for bins in [*population, child]:
        assert (bins >= 0).all() and p.fills(bins).max() <= 100 and p.fills(bins).min() > 0
    assert len(p.fills(population[0])) <= len(p.fills(p.fresh(0.0)))


def triples(n, capacity, seed=1):
    rng, out = np.random.default_rng(seed), []
    for _ in range(n // 3):
        a = int(rng.integers(int(capacity * 0.38), int(capacity * 0.49) + 1))
        b = int(rng.integers(capacity // 4, (capacity - a) // 2))
        out += [a, b, capacity - a - b]
    return np.sort(np.array(out))[::-1].copy()


@pytest.mark.parametrize("n", [120, 501, 3000])
def test_genetic_packing_beats_best_fit_on_triples(n):
    from lorewell.llm.best_fit_packing import EPOCHS, GENERATIONS, POPULATION, Packer

    p = Packer(triples(n, 4096), 4096, np.random.default_rng(0))
    assert p.bound == n // 3
    population = []
    for _ in range(EPOCHS):
        population = p.evolve(population, GENERATIONS, POPULATION)
    for bins in population:
        assert (bins >= 0).all() and p.fills(bins).max() <= 4096 and p.fills(bins).min() > 0
    assert len(p.fills(population[0])) <= n // 3 + 1 and len(p.fills(p.fresh(0.0))) > 1.05 * n // 3


def test_least_bins_bounds_every_packing():
    from lorewell.llm.best_fit_packing import Packer, least_bins

    rng = np.random.default_rng(1)
    for _ in range(60):
        lengths = np.sort(rng.integers(1, 100, int(rng.integers(0, 40))))[::-1].copy()
        p = Packer(lengths, 100, rng)
        for noise in (0.0, 1.0):
            assert -(-int(lengths.sum()) // 100) <= least_bins(lengths, 100) <= len(p.fills(p.fresh(noise)))
    assert least_bins(np.array([60, 60, 60, 10]), 100) == 3 and least_bins(np.array([51, 51, 50, 50, 50]), 100) == 4


def test_packing_pools_over_blocks(spark, monkeypatch):
    from lorewell.llm import best_fit_packing as B

    monkeypatch.setattr(B, "BLOCK", 40)
    lengths = triples(240, 4096)
    df = docs(spark, ["the " * (int(n) - 1) for n in lengths])
    rows = B.best_fit_packing(df).select("sequence_id", "length").collect()
    assert sum(r["length"] for r in rows) == lengths.sum() and 80 <= len({r["sequence_id"] for r in rows}) <= 85 < len(set(B.Packer(lengths, 4096, None).fresh(0.0).tolist()))
    alone = B.best_fit_packing(docs(spark, ["the " * 2500] * 90)).select("sequence_id").distinct().count()
    assert alone == 90


# ---- 5
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_decontamination(texts, items, window=10):
    lower = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for t in texts:
        w, hit, found = lower(t), set(), set()
        for item, it in items:
            x = lower(it)
            n = min(window, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[a : a + n]:
                        hit.update(range(p, p + n))
                        found.add(item)
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    return out


def test_decontamination_against_brute_force(spark):
    from lorewell.llm.decontamination import decontaminate

    rng = np.random.default_rng(0)
    vocab = ["The", "the", "été", "Zoo", "a1", "x"]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(1, say(14)), (2, say(10)), (10, "the zoo"), (3, None), (4, ""), (5, say(30)), (10, "x x x"), (None, "été a1 été")]
    texts = [None, "", "THE-zoo!", items[0][1], say(300), "q " * 9 + items[1][1].upper().replace("É", "é"), *(say(int(n)) for n in rng.integers(1, 60, 30)), items[5][1][:40]]
    df, bench = docs(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[1:] for r in decontaminate(df, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").orderBy("doc_id").collect()]
    assert got == brute_decontamination(texts, items)
    assert decontaminate(df.limit(0), bench).count() == 0
    assert not any(r["n_hit"] for r in decontaminate(df, bench.limit(0)).collect())
    long = decontaminate(docs(spark, ["the cat " * 300_000 + items[0][1]]), bench.where("item_id = 1")).first()
    assert (long["n_words"], long["n_items"]) == (600_014, 1) and long["n_hit"] >= 14
    near = [r["near_items"] for r in decontaminate(docs(spark, ["one two three four", "four x one", "one", None, "x four " + "y " * 9 + "one"]), spark.createDataFrame([(7, "One four"), (8, "four")], "item_id long, text string"), within=3).orderBy("doc_id").collect()]
    assert near == [["7", "8"], ["7", "8"], [], [], ["8"]]


@pytest.mark.parametrize("within", [2, 6])
def test_proximity_against_brute_force(spark, monkeypatch, within):
    from lorewell.llm import decontamination as D

    monkeypatch.setattr(D, "PLACES", 7)
    rng = np.random.default_rng(within)
    say = lambda n: " ".join(rng.choice(list("abcdefgh"), n))
    items, texts = [(k, say(int(rng.integers(1, 5)))) for k in range(8)], [say(int(rng.integers(0, 25))) for _ in range(25)]
    got = D.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=3, within=within).orderBy("doc_id").collect()
    assert [tuple(r)[1:6] for r in D.decontaminate(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), window=3).orderBy("doc_id").collect()] == brute_decontamination(texts, items, 3)
    count = {w: sum(t.split().count(w) for t in texts) for w in "abcdefgh"}
    for r, t in zip(got, texts, strict=True):
        w, want = t.split(), set()
        for item, it in items:
            x = it.split()
            for a in range(max(1, len(x) - 2)):
                own = x[a : a + 3]
                rare = min(own, key=lambda v: count[v])
                if any(v == rare and all(o in w[max(0, p - within) : p + within + 1] for o in own) for p, v in enumerate(w)):
                    want.add(str(item))
        assert r["near_items"] == sorted(want)


def test_decontamination_follows_matches():
    """Ten times the windows, none of them met: the places followed stay as few as the shared rarest terms give."""
    import pyarrow as pa

    from lorewell.llm import decontamination as D

    def followed(n):
        q = D.query_windows([(str(k), " ".join(f"q{k}x{j} common" for j in range(8))) for k in range(n)])
        hashes = np.concatenate([h for _, _, h, _ in D.words(pa.array(["q0x0 common " * 5 + "common text " * 500]), 1 << 20)])
        order = np.argsort(hashes, kind="stable")
        terms, begin = np.unique(hashes[order], return_index=True)
        shard = D.Shard([1], [0, len(hashes) + 1], terms.tobytes(), np.append(begin, len(order)).astype(np.uint32).tobytes(), order.astype(np.uint32).tobytes())
        vocabulary = np.unique(q.words)
        counts = np.zeros(len(vocabulary), np.int64)
        at = np.searchsorted(vocabulary, terms)
        ok = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == terms)
        counts[at[ok]] = np.diff(np.append(begin, len(order)))[ok]
        q.rank(vocabulary, counts)
        assert not len(shard.phrases(q)[0])
        return sum(len(w) for w, _ in shard.rarest(q))

    assert followed(1000) <= followed(100) <= 5 * 8


# ---- 6
def test_decontamination_searches_a_large_benchmark_in_parts(spark, monkeypatch):
    from lorewell.llm import decontamination as D

    items = [" ".join(f"w{(7 * k + j) % 90}" for j in range(14)) for k in range(12)]
    texts = [None, "", items[3], "a " + items[5] + " b " + items[11], " ".join(items), "nothing of it"]
    bench = spark.createDataFrame([(k % 9, t) for k, t in enumerate(items)] + [(None, items[0]), (20, None)], "item_id long, text string")
    whole = sorted(map(tuple, D.decontaminate(docs(spark, texts), bench).collect()))
    monkeypatch.setattr(D, "QUERY_BYTES", 100)
    assert len(list(D._parts(bench))) > 5
    assert sorted(map(tuple, D.decontaminate(docs(spark, texts), bench).collect())) == whole and sum(r[5] for r in whole) == 3


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return [(len(s), v) for s, v in zip(sets, label, strict=True)]


@pytest.mark.parametrize("tile", [1024, 4])
def test_jaccard_against_brute_force(spark, monkeypatch, tile):
    from lorewell.llm import jaccard_join as J

    monkeypatch.setattr(J, "TILE", tile)
    rng = np.random.default_rng(1)
    say = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 50, n))
    texts = [*TRICKY, "Same text here", "same\ttext HERE", "same text there"]
    for n in (6, 8, 10, 13, 16, 40, 120):
        base = say(n).split()
        for _ in range(8):
            own = list(base)
            for _ in range(int(rng.integers(0, 3))):
                own[int(rng.integers(0, len(own)))] = f"z{rng.integers(0, 9)}"
            texts.append(" ".join(own[int(rng.integers(0, 2)) :]))
    passage = say(60)
    texts += [passage + " " + say(int(n)) for n in rng.integers(5, 40, 15)]
    got = [(r["n_shingles"], r["component_id"]) for r in J.jaccard_join(docs(spark, texts).repartition(3)).orderBy("doc_id").collect()]
    assert got == brute_components(texts)


def test_jaccard_edges(spark):
    from lorewell.llm.jaccard_join import boundary, jaccard_join, needed

    df = docs(spark, ["a b c d e f", None])
    assert jaccard_join(df.limit(0)).count() == 0
    assert jaccard_join(df.union(df)).where("component_id <> doc_id").count() == 0
    assert needed(10, 10) == 9 and needed(9, 11) == 9 and boundary({}, 1.0) == 0 and 4 < boundary({n: 10 for n in range(1, 60)}, 3.0) < 24


# ---- 7
def test_language_id(spark):
    from lorewell.llm.language_id import language_id

    rng = np.random.default_rng(2)
    words = {"aa": ["kala", "talo", "vesi", "puu"], "bb": ["zrnx", "qwrt", "pfgh", "xzkl"]}
    rows = []
    for k in range(200):
        lang = ["aa", "bb"][k % 2]
        rows.append((k, " ".join(rng.choice(words[lang], int(rng.integers(3, 60)))), lang, "s", 0))
    rows += [(200, None, "aa", "s", 0), (201, "123 !!", "aa", "s", 0), (202, "kala talo", None, "s", 0), (203, "", None, "s", 0), (204, "kala talo vesi " * 2000, None, "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, nth long")
    got = {r["doc_id"]: r for r in language_id(df).collect()}
    assert len(got) == 205 and all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    held = [k for k in range(200) if got[k]["held_out"]]
    assert np.mean([got[k]["lang_pred"] == ["aa", "bb"][k % 2] for k in held]) > 0.95
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (200, 201, 203)) and got[204]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_gradients_by_differences():
    from lorewell.llm.language_id import ByteTagger

    rng = np.random.default_rng(0)
    m = ByteTagger(["a", "b", "c"])
    for layer in (m.ahead, m.back):
        layer.w, layer.u = layer.w.astype(np.float64), layer.u.astype(np.float64)
    xs, d = rng.integers(0, 5, (7, 4)), rng.standard_normal((7, 8, 4))
    loss = lambda: float((m.ahead.states(xs)[0] * d).sum())
    _, kept = m.ahead.states(xs, keep=True)
    g_w, g_u = m.ahead.backward(xs, kept, d.astype(np.float32))
    for weights, gradient, at in ((m.ahead.w, g_w, (2, 5)), (m.ahead.w, g_w, (3, 20)), (m.ahead.u, g_u, (1, 3)), (m.ahead.u, g_u, (18, 2))):
        old = weights[at]
        weights[at] = old + 1e-2
        up = loss()
        weights[at] = old - 1e-2
        down = loss()
        weights[at] = old
        assert gradient[at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=5e-3)


# ---- 8 and 9
def test_token_counts(spark, tokenizer):
    from lorewell.llm.token_count import token_count

    got = {r["doc_id"]: r for r in token_count(docs(spark, TRICKY)).collect()}
    for k, t in enumerate(TRICKY):
        n = len(ids_of(tokenizer, t))
        assert (got[k]["n_bytes"], got[k]["n_tokens"], got[k]["over_limit"]) == (len((t or "").encode()), n, n > 2048), repr(t)[:60]
    assert token_count(docs(spark, []).limit(0)).count() == 0


def test_token_counts_around_special_strings(spark, tokenizer):
    from lorewell.llm.token_count import token_count

    rng = np.random.default_rng(12)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", " ", "Word", "İ", "'s", "\n", "e\u0301", "<|ENDOFTEXT|>", "12"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 12)))) for _ in range(200)]
    got = token_count(docs(spark, texts).union(docs(spark, texts[:3]))).collect()
    assert len(got) == 203 and all(r["n_tokens"] == len(ids_of(tokenizer, texts[r["doc_id"]])) for r in got)


def test_merger_on_random_words(tokenizer):
    from lorewell.llm._tokens import tokenizer_path
    from lorewell.llm.token_count import chunk_counter

    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdeéßaaan'1!-"), int(rng.integers(1, 30)))) for _ in range(800)] + ["aaaaaaa", "ananananan", "a"]
    flat, _ = chunk_counter(tokenizer_path("word_bpe_49k.json"))(words)
    assert flat.tolist() == [len(ids_of(tokenizer, w)) for w in words]


def test_token_files_round_trip(spark, tokenizer):
    from lorewell.llm.token_output import read_token_files, write_token_files

    df = docs(spark, TRICKY)
    df = df.union(df.where("doc_id = 5")).union(df.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    manifest = write_token_files(df.repartition(3))
    got = sorted(read_token_files(manifest).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, *sorted([*range(len(TRICKY)), 5])]
    at = 0
    for r in got:
        want = np.array([*ids_of(tokenizer, TRICKY[6 if r["doc_id"] is None else r["doc_id"]]), 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert sorted(r["doc_id"] for r in read_token_files(manifest, [9, 5]).collect()) == [5, 5, 9]
    assert read_token_files(write_token_files(df.limit(0))).count() == 0


def test_token_files_tell_null_from_the_least_id(spark):
    from lorewell.llm.token_output import token_output

    df = spark.createDataFrame([(-(1 << 63), "one"), (None, "two"), (None, None), (5, "three")], "doc_id long, text string")
    assert [r["doc_id"] for r in token_output(df).orderBy("start").collect()] == [None, None, -(1 << 63), 5]


def test_training_sample_is_bounded_with_repeated_rows(spark):
    from lorewell.llm.language_id import training_spans

    k0 = next(k for k in range(200, 300) if zlib.crc32(str(k).encode()) % 4 != 2)
    df = spark.createDataFrame([(k0, "kala talo", "aa")] * 500 + [(k0, "vesi puu", "aa")] * 20 + [(k, f"zrnx {k}", "bb") for k in range(100)], "doc_id long, text string, lang string")
    languages, spans, lengths, labels = training_spans(df, 10)
    assert languages == ["aa", "bb"] and (labels == 0).sum() <= 2 and (labels == 1).sum() <= 10 and len(spans) == len(lengths) == len(labels)


def test_probabilities_against_a_plain_network():
    from lorewell.llm.language_id import SPAN, UNITS, ByteTagger

    rng = np.random.default_rng(3)
    m = ByteTagger(["a", "b", "c"])
    soft = lambda x: x / (1 + abs(x))

    def run(layer, data):
        h, out = np.zeros(UNITS), []
        for x in data:
            g, u = layer.w[x].astype(float), layer.u.astype(float) @ h
            z, r = (soft(g[k * UNITS : (k + 1) * UNITS] + u[k * UNITS : (k + 1) * UNITS]) / 2 + 0.5 for k in (0, 1))
            n = soft(g[2 * UNITS :] + r * u[2 * UNITS :])
            h = n + z * (h - n)
            out.append(h)
        return np.array(out)

    texts = [bytes(rng.integers(0, 256, n).tolist()) for n in (1, 95, 96, 97, 500)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = m.pooled(np.frombuffer(b"".join(texts), np.uint8), offsets)
    for t, p in zip(texts, got, strict=True):
        each = []
        for a in range(0, len(t), SPAN):
            part = list(t[a : a + SPAN])
            padded = part + [0] * (SPAN - len(part))  # the state from the right starts at the span's end
            logits = np.concatenate([run(m.ahead, padded), run(m.back, padded[::-1])[::-1]], axis=1)[: len(part)] @ m.v.T.astype(float) + m.b[:, 0]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            each.append(e / e.sum(axis=1, keepdims=True))
        assert p == pytest.approx(np.concatenate(each).mean(axis=0), abs=1e-4)


def test_training_lowers_the_loss_and_splits_languages():
    from lorewell.llm.language_id import ByteTagger

    rng = np.random.default_rng(4)
    spans = np.concatenate([rng.integers(97, 107, (1000, 96)), rng.integers(107, 117, (1000, 96))]).astype(np.uint8)
    labels, lengths = np.repeat([0, 1], 1000), np.full(2000, 96)
    m = ByteTagger(["a", "b"])
    before = m.probabilities(np.ascontiguousarray(spans.T))[:, labels, np.arange(2000)].mean()
    m.train(spans, lengths, labels)
    after = m.probabilities(np.ascontiguousarray(spans.T))[:, labels, np.arange(2000)].mean()
    assert before < 0.7 < 0.9 < after


def test_frames_are_independent_and_checked():
    import pyarrow as pa

    from lorewell.llm.token_output import FrameWriter, read_frames

    out = io.BytesIO()
    w = FrameWriter(out, frame_ids=50)
    for k in range(40):
        w.add(k, np.arange(k, dtype=np.uint32))
    w.close()
    data = out.getvalue()
    assert [d.tolist() for d, _, _ in read_frames(pa.BufferReader(data), [39])][-1][-1] == 39 and len(list(read_frames(pa.BufferReader(data), [39]))) == 1
    import zstandard

    assert len(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()) == sum(b for _, b, _ in w.table)
    bad = bytearray(data)
    bad[w.table[0][0] // 2] ^= 255
    with pytest.raises(Exception):  # noqa: B017
        list(read_frames(pa.BufferReader(bytes(bad))))


# ---- 10
@pytest.mark.parametrize("tile", [1024, 8])
def test_embeddings_against_brute_force(spark, monkeypatch, tile):
    from lorewell.llm import embedding_dedup as E

    monkeypatch.setattr(E, "TILE", tile)
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        base = rng.standard_normal(16)
        rows += [(g % 3, (base + rng.standard_normal(16) * s).tolist()) for s in (0, 0, 0.02, 0.1, 0.2, 0.3, 0.35)]
    rows += [(0, rng.standard_normal(16).tolist()) for _ in range(40)]
    rows += [(None, rows[0][1]), (0, None), (0, []), (0, [0.0] * 16), (0, [math.nan] * 16), (0, [math.inf] + [1.0] * 15), (0, [None] + [1.0] * 15), (0, [1.0, 2.0]), (0, [2.0, 4.0])]
    df = spark.createDataFrame([(k, v, x, 9, "c") for k, (x, v) in enumerate(rows)], "vec_id long, embedding array<float>, label int, m long, rep string")
    vectors = {r["vec_id"]: (r["label"], r["embedding"]) for r in df.collect()}
    ok = {k: (x, np.array(v, np.float64)) for k, (x, v) in vectors.items() if x is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    near = {k: [j for j, (y, w) in ok.items() if j != k and y == x and len(w) == len(v) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93] for k, (x, v) in ok.items()}
    label = {k: k for k in vectors}
    for _ in vectors:
        for k, js in near.items():
            label[k] = min([label[k], *(label[j] for j in js)])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.embedding_dedup(df).collect()}
    assert got == {k: (len(near.get(k, [])), label[k], label[k] == k) for k in vectors}
    assert E.embedding_dedup(df.limit(0)).count() == 0
    bits, tables = E.tables_for(10_000)
    assert 1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** tables > 0.999


def test_embedding_recall_at_the_threshold(spark):
    from lorewell.llm.embedding_dedup import embedding_dedup, tables_for

    rng = np.random.default_rng(9)
    base = rng.standard_normal((600, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.standard_normal((600, 32))
    side -= (side * base).sum(axis=1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.9301, 0.95, (600, 1))
    vectors = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * side, np.float32([[-0.0, 1.0] + [0.0] * 30, [0.0, 1.0] + [0.0] * 30])]).astype(np.float32)
    v = vectors.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = (v @ v.T >= 0.93).sum(axis=1) - 1
    assert tables_for(100_000)[1] < 40
    for kind in ("float", "double"):
        df = spark.createDataFrame([(k, x, 1) for k, x in enumerate(vectors.tolist())], f"vec_id long, embedding array<{kind}>, label int")
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup(df).collect()}
        assert sum(min(got[k], int(n)) for k, n in enumerate(near)) >= 0.995 * near.sum() and all(got[k] <= n for k, n in enumerate(near)) and got[1200] == got[1201] == 1


# ---- shared
def test_components_of_a_long_path(spark):
    from lorewell.llm._shared import components

    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r["id"]: r["component"] for r in components(edges, "t").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 99: 99, 100: 99}
    assert components(edges.limit(0), "t").count() == 0


def test_ids_by_bucket(spark):
    from lorewell.llm._shared import with_ids, without_ids

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id long, text string")
    ids = spark.createDataFrame([(2,), (5,)], "doc_id long")
    assert sorted(r["text"] for r in with_ids(rows, ids, "doc_id").collect()) == ["b", "c"]
    assert sorted(r["text"] for r in without_ids(rows, ids, "doc_id").collect()) == ["a", "d"]


# ---- pipeline
def test_pipeline_stages(spark, tmp_path, tokenizer):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(8)
    words = {"aa": ["kala", "talo", "vesi", "puu", "meri", "maa"], "bb": ["zrnx", "qwrt", "pfgh", "xzkl", "mnrt", "wqpl"]}
    rows = [(k, " ".join(rng.choice(words[["aa", "bb"][k % 2]], 30)), ["aa", "bb"][k % 2], "s", 0) for k in range(60)]
    rows += [(60, rows[0][1], "aa", "s", 0), (61, None, None, "s", 0), (62, "1 2 3", None, "s", 0), rows[3], (63, "kala " + rows[5][1], "bb", "s", 0)]
    item = " ".join(rows[10][1].split()[4:16])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs_ = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs_.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs_ = stage(spark, docs_, str(tmp_path))
        assert docs_.columns == columns
        docs_.write.parquet(f"{tmp_path}/{name}")
        docs_ = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r["doc_id"] for r in docs_.collect())
    assert kept["language ID"] == sorted([*range(61), 3, 63])
    once = [r for k, r in enumerate(rows) if r[0] not in (61, 62) and k != 63]
    dup = {i for i, (_, c) in enumerate(brute_components([r[1] for r in once])) if c != i}
    order = [r[0] for r in once]
    assert kept["n-gram Jaccard join"] == sorted(order[i] for i in range(len(order)) if i not in dup)
    assert kept["benchmark decontamination"] == [k for k in kept["n-gram Jaccard join"] if k != 10]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r["doc_id"] for r in packed}) == kept["benchmark decontamination"]
    assert len({r["sequence_id"] for r in packed}) == -(-sum(r["length"] for r in packed) // 4096)


def test_pipeline_stages_without_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "item one two")], "item_id long, text string").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    rows = spark.createDataFrame([(1, "a b", "aa", "s", 0), (1, "a b", "aa", "s", 0), (None, None, None, None, None), (None, "c d e f g h", "aa", "s", 0)], schema)
    for name, stage in corpus_pipeline.STAGES[1:3]:
        assert stage(spark, rows, str(tmp_path)).count() == (3 if name == "n-gram Jaccard join" else 4)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1


BSD_TWO = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

   * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
   * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
"""


@pytest.mark.parametrize("holder", ["the copyright holder", "Google Inc.", "The Regents of the University of Somewhere, Inc.", "the <organization>", "Foo S.A., its parent,"])
def test_bsd_with_any_holder(spark, holder):
    from lorewell.llm.license_scan import license_scan

    third = f"   * Neither the name of {holder} nor the names of its\ncontributors may be used to endorse or promote products derived from\nthis software without specific prior written permission.\n"
    got = [r["licenses"] for r in license_scan(docs(spark, [BSD_TWO + third, BSD_TWO, BSD_TWO + third + BSD_TWO, third])).orderBy("doc_id").collect()]
    assert got == ["BSD-3-Clause", "BSD-2-Clause", "BSD-3-Clause", ""]


def test_licence_tags_gaps_and_comment_words(spark):
    from lorewell.llm.license_scan import license_scan

    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    commented = "\n".join(f"dnl {line}" for line in BSD_TWO.splitlines())
    texts = [
        "// SPDX-License-Identifier: MIT\nint x;", "# SPDX-License-Identifier: GPL-3.0-or-later\n", "SPDX-License-Identifier: NotALicence\n", commented,
        "This project is licensed under the MIT License - see the [LICENSE.md](LICENSE.md) file for details.", "Not licensed under the MIT License or so. " + mit,
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.", "neither the name of " + "x " * 17 + "nor the names of its contributors",
    ]
    got = [r["licenses"] for r in license_scan(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == ["MIT", "GPL-3.0-or-later", "", "BSD-2-Clause", "MIT", "", "CC-BY-SA-3.0", ""]


@pytest.mark.parametrize(("kind", "labels"), [("double", [1.2, 1.2, 1.4, None, 0.0, -0.0]), ("string", ["a", "a", "b", None, "", ""]), ("long", [2**53, 2**53, 2**53 + 1, None, 7, 7]), ("date", ["d1", "d1", "d2", None, "d3", "d3"])])
def test_embedding_labels_as_they_are(spark, kind, labels):
    import datetime

    from lorewell.llm.embedding_dedup import embedding_dedup

    if kind == "date":
        labels = [None if x is None else datetime.date(2020, 1, int(x[1])) for x in labels]
    df = spark.createDataFrame([(k, [1.0, 0.5 + 0.01 * k], x) for k, x in enumerate(labels)], f"vec_id long, embedding array<double>, label {kind}")
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup(df).collect()} == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4)}
