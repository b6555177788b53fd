"""Rows that shortcuts used to lose."""

import pytest

import corpus_pipeline
from metaquarry.llm import html_text, licenses

SENTENCES = [
    ("SPDX_MIT", "SPDX-License-Identifier: MIT"),
    ("SPDX_OTHER", "SPDX-License-Identifier: Zlib"),
    ("APACHE2_GRANT", "Licensed under the Apache Licence, Version 2.0"),
    ("APACHE2_COMPLY", "You may not use this file except in compliance with the License"),
    ("APACHE2_COPY", "You may obtain a copy of the License at"),
    ("APACHE2_ASIS", "Distributed under the License is distributed on an \"AS IS\" BASIS"),
    ("APACHE2_SEE", "See the License for the specific language governing permissions"),
    ("AGPL", "This is AGPL code"),
    ("AGPL_LATER", "GNU Affero General Public License version 3 or any later version"),
    ("LGPL", "Released under LGPLv2"),
    ("LGPL_LATER", "GNU Lesser General Public License version 2 or any later version"),
    ("GPL3_LATER", "GNU General Public License version 3 or any later version"),
    ("GPL2_LATER", "GNU General Public License version 2 or any later version"),
    ("GPL3", "Released under GPLv3"),
    ("GPL2", "Released under GPL version 2"),
    ("GPL_HOPE", "Distributed in the hope that it will be useful"),
    ("GPL_COPY", "You should have received a copy of the GNU"),
    ("GPL_ANY", "It is GNU GPL code"),
    ("MPL2", "Mozilla Public License, version 2"),
    ("EPL", "Eclipse Public License"),
    ("CC0", "Marked CC0 by us"),
    ("CC0", "Creative Commons Zero"),
    ("CC_BY_NC_SA", "Under CC BY-NC-SA 4"),
    ("CC_BY_NC_SA", "Under Attribution-NonCommercial-ShareAlike"),
    ("CC_BY_NC_ND", "Under CC-BY-NC-ND 4"),
    ("CC_BY_NC_ND", "Under Attribution-NonCommercial-NoDerivs"),
    ("CC_BY_NC", "Under CC BY-NC 4"),
    ("CC_BY_NC", "Under Attribution-NonCommercial"),
    ("CC_BY_SA", "Under CC BY-SA 4"),
    ("CC_BY_SA", "Under Attribution-ShareAlike"),
    ("CC_BY_ND", "Under CC BY-ND 4"),
    ("CC_BY_ND", "Under Attribution-NoDerivs"),
    ("CC_BY", "Under CC BY 4"),
    ("CC_BY", "Creative Commons Attribution 4"),
    ("MIT_NAMED", "Available under the terms of the Expat License"),
    ("MIT_GRANT", "Permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MIT_NOTICE", "The above copyright notice and this permission notice shall be included"),
    ("MIT_ASIS", "The software is provided \"as is\", without warranty"),
    ("MIT_LIABLE", "In no event shall the authors or copyright holders be liable"),
    ("ISC_GRANT", "Permission to use, copy, modify, and/or distribute this software"),
    ("BSD_NAMED", "Under the modified BSD licence"),
    ("BSD_GRANT", "Redistribution and use in source and binary forms"),
    ("BSD_SOURCE", "Redistributions of source code must retain"),
    ("BSD_BINARY", "Redistributions in binary form must reproduce"),
    ("BSD_ENDORSE", "Neither the name of X nor others may be used to endorse or promote"),
    ("BSD_ASIS", "This software is provided by X as is and any express or implied warranties"),
    ("PUBLIC_DOMAIN", "This is in the public domain"),
    ("ALL_RIGHTS", "All rights reserved"),
    ("APACHE1", "Apache Software License, Version 1.1"),
    ("MIT_TITLE", "The MIT License"),
    ("ISC_NAMED", "Under the ISC License"),
    ("ZLIB", "Under the zlib License"),
    ("ZLIB", "Altered source versions must be plainly marked as such"),
    ("UNLICENSE", "This is free and unencumbered software released into the public domain"),
    ("BOOST", "Boost Software License"),
    ("OFL", "SIL Open Font License"),
    ("ARTISTIC", "The Artistic License"),
    ("EUPL", "Released under EUPL"),
    ("EUPL", "European Union Public Licence"),
]


@pytest.mark.parametrize("gap", [" ", "\n", " *\t"])
def test_a_text_with_only_one_sentence_is_found(spark, gap):
    rows = [(i, "La que. " + s.replace(" ", gap) + ". La.") for i, (_, s) in enumerate(SENTENCES)]
    rows.append((-1, "nothing of the kind"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df, "doc_id", "text").collect()}
    assert got[-1]["sentence_ids"] == ""
    for i, (name, text) in enumerate(SENTENCES):
        assert got[i]["sentence_ids"] == f"<{name}>", text
    listed = {n for n, _ in SENTENCES}
    assert all(n in listed for n, _ in licenses.SENTENCES if not n.startswith("SPDX_"))
    by_name = {n: got[i]["licenses"] for i, (n, _) in enumerate(SENTENCES)}
    assert by_name["ALL_RIGHTS"] == ["All-Rights-Reserved"] and by_name["CC_BY_SA"] == ["CC-BY-SA"]
    assert by_name["GPL3"] == ["GPL-3.0"] and by_name["CC0"] == ["CC0-1.0"]


def test_copies_of_an_article_are_no_template(spark):
    story = "<h1>Flood</h1><p>The river rose.</p><p>Many left.</p>"
    wrap = "<div>menu of the site</div>{}<div>seen {} times</div>"
    rows = [(i, f"http://h.org/{i}", wrap.format(f"<article>{story}</article>", i)) for i in range(12)]
    rows += [(20 + i, f"http://m.org/{i}", wrap.format(f"<main>{story}</main>", i)) for i in range(12)]
    rows += [(40 + i, f"http://d.org/{i}", f"<div id=x{i}>{story}</div>") for i in range(12)]
    other = "<article><p>text {}</p><div>Read our other news</div></article>"
    rows += [(1000 * n + i, f"http://{h}.org/o{i}", wrap.format(other.format(i), i)) for n, h in enumerate("hmd", 1) for i in range(24)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_text(pages, "page_id", "url", "html").collect()}
    for i in (*range(12), *range(20, 32), *range(40, 52)):
        assert got[i] == "Flood\n\nThe river rose.\n\nMany left."
    assert all(got[1000 * n + i] == f"text {i}" for n in (1, 2, 3) for i in range(24))  # this still goes


BODY = "<p>The river rose in the night.</p><p>Many left.</p>"
TEXT = "The river rose in the night.\n\nMany left."
WRAPPERS = [
    "layout has-sidebar", "page overflow-hidden", "content with-header", "site-content no-sidebar",
    "post comments-open", "search-results", "header_wrap",
]


@pytest.mark.parametrize("name", WRAPPERS)
def test_a_wrapper_with_a_bad_name_keeps_its_text(name):
    wrap = f'<div class="{name}"><div class="sidebar">news</div>{{}}</div><p>(c) us</p>'
    assert html_text.main_text(wrap.format(f"<main>{BODY}</main>")) == TEXT
    assert html_text.main_text(wrap.format(f"<article>{BODY}</article><article><p>two")) == TEXT + "\n\ntwo"
    assert html_text.main_text(wrap.format(BODY)) == TEXT + "\n\n(c) us"


def test_bad_names_of_minor_parts_still_count():
    long = "<li>menu entry</li>" * 9
    assert html_text.main_text(f'<ul class="menu">{long}</ul><p>short') == "short"
    assert html_text.main_text(f'<p>short</p><div id="comments">{BODY}</div>') == "short"
    assert html_text.main_text(f'<div class="related"><article>{BODY}</article></div><article>own</article>') == "own"
    # below a wrapper that is a minor part of the page, all articles and the main element are found
    small = f'<div class="search">{{}}</div><div class="menu">{long * 3}</div>'
    assert html_text.main_text(small.format("<article>one</article><article>two</article>")) == "one\n\ntwo"
    assert html_text.main_text(small.format("<main><p>one</main>")) == "one"


def test_different_texts_of_one_id_stay(spark):
    text = "one two three four five six seven eight nine ten"
    other = "uno dos tres cuatro cinco seis siete ocho nueve diez"
    rows = [(1, text), (1, other), (2, other), (2, text), (3, "quite another text of some seven words"), (3, None)]
    df = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], ", ".join(
        ["doc_id long", "text string", "lang string", "source string", "n_chars long"]
    ))
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, None)
    got = sorted((r["doc_id"], r["text"] or "") for r in kept.collect())
    assert got == sorted([(1, text), (1, other), (3, rows[4][1]), (3, "")])
