"""Licence notices (7), packing (8) and page extraction (9)."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from portfold.llm import html_extraction, license_scan, packing

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    whole = Tokenizer.from_file(VOCABULARY)
    whole.encode_special_tokens = True
    return whole


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb c", "it's we'll 'tis  x", "tab\tand \t mix", "1 22 333 4,4", "naïve café  où",
    " nbsp  x", " em space", "zero​width", "日本語 テキスト", "\U0001f600 \U0001f468‍\U0001f469", "<|endoftext|> x <|endoftext|>",
    "a\x00b \x1c c", "\r\nline\r\n end", "x" * 3000, "the end.\nThe start ### $$$",
]


def test_ids_are_those_of_the_library(tokenizer):
    rng = random.Random(1)
    pieces = [*TEXTS, " ", "\n", "  ", "word", " 's", "é", "　", "\n\n", "!'s", "'ll", "×÷", "Ł1ß", "ᴀ"]
    texts = TEXTS + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(600)]
    expected = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    for known_bytes in (0, packing.KNOWN_BYTES):  # the tables are emptied before each call, or kept
        encoder = packing.Encoder(VOCABULARY, known_bytes)
        for step in (1, 7, len(texts), len(texts)):
            found = [ids for k in range(0, len(texts), step) for ids in encoder.encode(texts[k:k + step])]
            for text, ids, want in zip(texts, found, expected, strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
    assert encoder.room > 0 and packing.Encoder(VOCABULARY, 0).encode([]) == []


def test_long_texts_in_slices(tokenizer, monkeypatch):
    texts = ["short one", "some words  here, and\nmore of them " * 300, "", "x" * 500, "last"]
    expected = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    for size in (1, 10, 333, 10**6):
        monkeypatch.setattr(packing, "GROUP_CHARS", size)
        found = list(packing._encoded(packing.Encoder(VOCABULARY), texts))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == expected


def checked_packing(rows, docs, tokenizer, length):
    ids = [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in docs]
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"]
    # The ids of the pieces of an id, in order of start, are those of its documents.
    got = Counter()
    for pieces in by_doc.values():
        for p in pieces:
            got.update((p["doc_id"], p["start"] + k, i, p["doc_tokens"]) for k, i in enumerate(p["ids"]))
    return ids, got, by_sequence


def test_round_trip(odd_docs, small_docs, no_docs, tokenizer):
    for frame, length in ((small_docs.repartition(3), 2048), (odd_docs, 2048), (small_docs, 100)):
        docs = frame.select("doc_id", "text").collect()
        rows = packing.pack(frame, VOCABULARY, length=length, with_ids=True).collect()
        ids, got, by_sequence = checked_packing(rows, [d["text"] for d in docs], tokenizer, length)
        expected = Counter((d["doc_id"], k, i, len(own)) for d, own in zip(docs, ids, strict=True) for k, i in enumerate(own))
        assert got == expected
        for pieces in by_sequence.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p["offset"]):
                assert p["offset"] == at and p["length"] > 0
                at += p["length"]
            assert at <= length
        tokens = sum(map(len, ids))
        tasks = len({r["sequence_id"] >> 32 for r in rows})
        assert len(by_sequence) <= tokens // length + tasks
    assert packing.pack(no_docs, VOCABULARY).count() == 0


def test_packing_by_hand():
    """Descending, each to the cheapest sequence with room; whole lengths apart; cut only what fits nowhere."""
    pieces = packing.packed(np.array([10, 6, 5, 4, 3, 2, 25]), 10)
    # Whole lengths: document 0, and two of document 6 (rest 5). Rests 6 5 5 4 3 2 = 25 tokens in three sequences.
    assert pieces[:3] == [(0, 0, 10, 0), (6, 0, 10, 1), (6, 10, 10, 2)]
    assert [(d, n) for d, _, n, _ in pieces[3:]] == [(1, 6), (2, 5), (6, 5), (3, 4), (4, 3), (5, 2)]
    assert [s for *_, s in pieces[3:6]] == [3, 4, 5]
    assert pieces[6][3] == 4  # 5 + 4, as cheap as the other five and first
    assert pieces[7][3] == 5 and pieces[8][3] == 3  # to the other five; then six is cheapest


@pytest.mark.parametrize("seed", range(5))
def test_packing_fills_and_balances(seed):
    lengths = np.random.default_rng(seed).integers(1, 5000, 300)
    pieces = packing.packed(lengths, 2048)
    filled, spent = Counter(), Counter()
    for _, _, n, s in pieces:
        filled[s] += n
        spent[s] += packing.cost(n)
    assert max(filled.values()) <= 2048 and len(filled) == -(-int(lengths.sum() - (lengths // 2048 * 2048).sum()) // 2048) + (lengths // 2048).sum()
    assert sum(filled.values()) == lengths.sum()
    covered = defaultdict(list)
    for d, start, n, _ in pieces:
        covered[d].append((start, n))
    for d, parts in covered.items():
        parts.sort()
        assert [p[0] for p in parts] == [0, *np.cumsum([p[1] for p in parts])[:-1]] and sum(p[1] for p in parts) == lengths[d]


def lcs_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(1500):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randrange(14))] for _ in range(2))
        found = html_extraction.common_lines(a, b)
        rest = iter(b)
        assert found == sorted(set(found)) and all(a[i] in rest for i in found)
        assert len(found) == lcs_length(a, b)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies<div>More</div></div>
<div class="ad">Buy</div>{main}<aside>Side</aside><form>Name <input><button>Go</button></form><div id="comments">Nice!</div>
<footer>&copy; x</footer></body></html>"""


@pytest.mark.parametrize(("main", "expected"), [
    ("<article><h1>A &amp; B</h1><p>One\n  two&nbsp;<b>th</b>ree<p>Four<br>five</article>", "A & B\n\nOne two three\n\nFour five"),
    ("<main><p>x &lt;b&gt; &#233;&#x20AC; &amp;amp;</p><!-- no --><section class='comments'>c</section><p>y</main>", "x <b> é€ &amp;\n\ny"),
    ("<article><p>a <span class='share'>tweet</span>b</p><div hidden>h</div><ul><li>i<li>j</ul></article>", "a\n\nb\n\ni\n\nj"),
    ("<article></article>", ""),
    ("<div><p>open one</p><p>open two</div>", "open one\n\nopen two"),
    ("<article><p>1 < 2 and 3 > 2</p><p title='a > b'>q</p></article>", "1 < 2 and 3 > 2\n\nq"),
    ("<article><p>unclosed <b>bold<p>next", "unclosed bold\n\nnext"),
])
def test_main_text(main, expected):
    assert html_extraction.main_text(html_extraction.lines(PAGE.format(main=main))).split("\n\nSite")[0].startswith(expected)
    if not main.endswith("next"):
        assert html_extraction.main_text(html_extraction.lines(PAGE.format(main=main))) == expected


def test_pages_without_article_lose_what_their_neighbours_share(spark):
    def page(body):
        return f"<html><body><p>Welcome to the site</p>{body}<p>Call us now</p></body></html>"
    long = "a much longer story than the lines around it "
    rows = [
        (1, "http://h.example/en/1", page(f"<p>{long}one</p>")), (2, "http://h.example/en/2.html", page(f"<p>{long}two</p>")),
        (3, "http://h.example/zz", page(f"<p>{long}one</p>")), (4, "http://other.example/en/1", page("<p>alone</p>")),
        (5, None, page("<p>no address</p>")), (6, None, page("<p>no address either</p>")), (7, "http://c.example/1", page("<p>copy</p>")),
        (8, "http://c.example/2", page("<p>copy</p>")), (9, "http://h.example/en/1", None), (10, "http://e.example/", ""),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(frame.repartition(1)).collect()}
    assert got[1] == f"{long}one"  # the empty page of the same address is no neighbour
    assert got[2] == f"{long}two"
    assert got[4].split("\n\n") == ["Welcome to the site", "alone", "Call us now"]
    assert got[7] == got[8] == "Welcome to the site\n\ncopy\n\nCall us now"
    assert "no address" in got[5] and "Welcome" in got[5]
    assert got[9] == got[10] == ""


def test_a_short_story_under_a_long_template(spark):
    """Most of the open text is shared, and still only the template goes; a copy between other pages keeps its text."""
    template = "".join(f"<p>menu entry number {i} of the site</p>" for i in range(30))
    rows = [(i, f"http://h.example/{i:02d}", f"<body>{template}<p>story {i}</p></body>") for i in range(6)]
    rows += [(10 + i, f"http://h.example/copy/{i}", f"<body>{template}<p>copied story</p></body>") for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extraction.extract(frame).collect()}
    assert [got[i] for i in range(6)] == [f"story {i}" for i in range(6)]
    assert got[10] == "copied story"  # its other neighbour tells another story
    assert "copied story" in got[11] or got[11] == ""


def test_differences_decide_on_marked_pages_too(spark):
    """An element that both neighbours have line for line is template, marked or not; a repeated passage in an article of its own stays."""
    def page(i):
        return (f"<body><article><h1>story {i}</h1><p>a passage that all repeat</p><p>end of {i}</p></article>"
                "<article><h2>The card of the week</h2><p>on every page</p></article></body>")
    rows = [(i, f"http://h.example/{i:02d}", page(i)) for i in range(40)] + [(90, "http://one.example/1", page(90))]
    rows += [(100 + i, f"http://copies.example/{i}", "<body><article><p>copied</p></article></body>") for i in range(3)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for pages in (frame, frame.repartition(7)):
        got = {r["page_id"]: r["text"] for r in html_extraction.extract(pages).collect()}
        assert [got[i] for i in range(40)] == [f"story {i}\n\na passage that all repeat\n\nend of {i}" for i in range(40)]
        assert got[90].endswith("The card of the week\n\non every page") and {got[100], got[101], got[102]} == {"copied"}


def test_neighbours_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = []
    for i in range(300):
        template = f"<p>top of section {i // 40}</p><p>site</p>"
        body = "" if i % 11 == 0 else f"{template}<p>story {rng.randrange(40)}</p><p>tail {i}</p>" if i % 7 else f"{template}<article>marked {i}</article>"
        rows.append((i % 290, f"http://h{i // 150}.example/{i // 40}/{i:03d}" if i % 13 else None, f"<body>{body}</body>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for partitions in ("1", "2", "40", "299"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found.append(Counter(map(tuple, html_extraction.extract(frame).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == found[1] == found[2] == found[3] and sum(found[0].values()) == 300
    assert any("top of section" not in text and "tail" in text for _, _, text, _ in found[0])


def test_every_page_by_brute_force(spark):
    import html
    import re

    frame = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in frame.collect()}
    rows = html_extraction.extract(frame).collect()
    assert Counter(r["page_id"] for r in rows) == Counter(list(pages))
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.DOTALL)[1]
        assert r["text"].split() == html.unescape(re.sub(r"<[^>]*>", " ", article)).split()
        assert r["n_chars"] == len(r["text"])


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars int")
    assert html_extraction.extract(empty).count() == 0


BACKGROUND = [f"the {a} of a {b} is in the {c} and it may be used by all" for a in ("house", "tree", "law") for b in ("man", "dog") for c in ("sea", "sun", "sky")]


@pytest.fixture(scope="module")
def notices():
    return license_scan.train(BACKGROUND * 8, seed=1)


def test_held_out_notices(notices):
    """Variants that training did not see: families are told apart, and plain lines are unknown."""
    rng = np.random.default_rng(99)
    background = [license_scan.tokens(line) for line in BACKGROUND]
    right = total = 0
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts:
            for parts in license_scan.variants(license_scan.tokens(text), background, rng, 12):
                found = notices.notices(parts)
                right += found is not None and found[0] == family
                total += 1
    assert right / total > 0.93
    assert sum(notices.notices(parts) is not None for parts in background) == 0


def test_templates_confirm(notices):
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts:
            found = notices.notices(license_scan.tokens(text))
            assert found[0] == family and found[1] > 0.5 and found[2] == 1.0
    assert notices.notices([]) is None and notices.notices(["zzz"]) is None


def test_skipping_changes_nothing(notices):
    """Windows without a starting word would be unknown if they were scored."""
    rng = random.Random(4)
    words = sorted({w for g in notices.weights for w in g.split()} - notices.starts) + ["zzz"]
    for _ in range(200):
        parts = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        assert notices.classes[int(notices.probabilities(parts).argmax())] == license_scan.UNKNOWN


def test_scan_of_whole_and_odd_texts(spark, odd_docs, no_docs, notices):
    far = "word " * 30_000 + "Licensed under the Apache License, Version 2.0. " + "word " * 500
    rows = [(1, "x\ny\nReleased under the MIT License.\n"), (2, far), (2, far), (None, "SPDX-License-Identifier: GPL-3.0-or-later"), (3, None), (4, "")]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), notices).collect()
    assert sorted((r["doc_id"] or 0, r["line"], r["family"], r["confirmed"]) for r in found) == [
        (0, 0, "GPL", True), (1, 2, "MIT", True), (2, 0, "Apache", True), (2, 0, "Apache", True)]
    assert all(abs(r["first_word"] - 30_000) <= license_scan.WINDOW for r in found if r["doc_id"] == 2)
    assert license_scan.scan(odd_docs, notices).count() == 0 and license_scan.scan_documents(no_docs).count() == 0


def test_every_notice_of_a_line(spark, notices):
    mixed = "Copyright 2020. All rights reserved. Licensed under the Apache License, Version 2.0."
    far = "Released under the MIT License. " + "word " * 10_000 + license_scan.TEMPLATES["GPL"][1]
    found = license_scan.scan(spark.createDataFrame([(1, mixed), (2, far)], "doc_id long, text string"), notices).collect()
    assert sorted((r["doc_id"], r["family"], r["first_word"]) for r in found if r["confirmed"]) == [
        (1, "Apache", 5), (1, "Proprietary", 0), (2, "GPL", 10_005), (2, "MIT", 0)]
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts:
            assert [n[0] for n in notices.all_notices(license_scan.tokens(text))] == [family]


@pytest.mark.parametrize("width", [60, 70, 80])
def test_wrapped_notices(notices, width):
    import textwrap
    for family, texts in license_scan.TEMPLATES.items():
        for text in texts:
            wrapped = "Some words ahead.\n\n" + "\n".join(textwrap.wrap(text, width)) + "\n\nMore words."
            found = list(license_scan.notices_of_text(notices, wrapped))
            assert [(at[0], n[0], n[2]) for at, n in found if n[2] >= 0.5] == [(2, family, 1.0)], (text, found)


@pytest.mark.parametrize("main", [
    "<article class='post category-social tag-share'><p>whole</p></article>", "<main class='has-sidebar'><p>whole</p></main>",
    "<div id='page' class='header-fixed no-comments'><article><p>whole</p></article></div>", "<div class='has-sidebar'><p>whole</p></div>",
    "<div class='widget' role='main'><p>whole</p></div>", "<article class='share'><p>whole</p></article>",
    "<article><p>whole</p></article><div id='comments'><article class='comment'>nice</article></div>",
    "<div class='ad-slot'>buy</div><main><p>whole</p><div class='x share'>tweet</div></main>",
])
def test_class_words_lose_no_article(main):
    assert html_extraction.main_text(html_extraction.lines(PAGE.format(main=main))) == "whole"


class _Everything(frozenset):
    """A set that holds every word: no window is skipped."""

    def __contains__(self, word):
        return True


def test_license_query_by_every_window(spark):
    """The registered query against all windows of all lines and blocks, judged one by one without skipping any."""
    from dataclasses import replace

    from portfold.llm import queries
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = replace(license_scan.train(license_scan.background_lines(frame), seed=3), starts=_Everything())
    expected = Counter()
    for r in frame.collect():
        for (line, first), found in license_scan.notices_of_text(model, r["text"] or ""):
            expected[r["doc_id"], line, first, found[0], round(found[1], 9), round(found[2], 9)] += 1
    got = Counter((r["doc_id"], r["line"], r["first_word"], r["family"], round(r["probability"], 9), round(r["similarity"], 9))
                  for r in queries.op7_license_scan(spark, "/root/testdata/sf0.001").collect())
    assert got == expected and sum(got.values()) > 0


# Notices as projects word them, in forms that the templates' variants do not make.
NOTICES_OF_OTHERS = [
    ("Apache", "This file is part of Foo. Foo is licensed to you under the Apache License, Version 2.0; see the LICENSE file in the root of this repository."),
    ("Apache", "you may not use this software except in compliance with the Apache License 2.0, a copy of which is in the file NOTICE"),
    ("MIT", "Released under the MIT license. Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT."),
    ("GPL", "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2.1"),
    ("AGPL", "Bar is licensed under the GNU Affero General Public License; if you run it on a server, you must offer its source"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC", "Except where otherwise noted, content on this site is licensed under a Creative Commons Attribution 4.0 International license."),
    ("Proprietary", "Confidential and proprietary. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited."),
]


def test_notices_that_the_generator_did_not_make(notices):
    found = [{family for _, (family, *_) in license_scan.notices_of_text(notices, text)} for _, text in NOTICES_OF_OTHERS]
    right = sum(family in families for (family, _), families in zip(NOTICES_OF_OTHERS, found, strict=True))
    assert right >= 10, [(n, f) for n, f in zip(NOTICES_OF_OTHERS, found, strict=True) if n[0] not in f]
