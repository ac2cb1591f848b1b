"""The chain of the quality classifier against all labelings, and main texts of pages of many shapes."""

import itertools
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import quality_crf as crf
from lakeloom.llm.dom import Page, consistent
from lakeloom.llm.html_text import fitted, main_texts
from lakeloom.llm.license_scan import TEMPLATES, Template, words_of
from lakeloom.llm.near_dedup import _Words
from lakeloom.llm.token_files import MAGIC, file_bytes, pack, read_file


@given(st.lists(st.lists(st.floats(-3, 3), min_size=1, max_size=6), min_size=1, max_size=3), st.lists(st.floats(-2, 2), min_size=4, max_size=4))
@settings(max_examples=60, deadline=None)
def test_marginals_and_pairs_against_all_labelings(chains, pair):
    pair = np.array(pair).reshape(2, 2)
    model = crf.QualityModel(np.zeros(crf.WIDTH), pair)
    first = np.cumsum([0, *map(len, chains)])
    odds = np.concatenate(chains)
    m = model.marginals(odds, first)
    expected, pairs = [], np.zeros((2, 2))
    for own in chains:
        total, good, both = 0.0, np.zeros(len(own)), np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(own)):
            weight = np.exp(sum(o * y for o, y in zip(own, labels, strict=True)) + sum(pair[a, b] for a, b in itertools.pairwise(labels)))
            total += weight
            good += weight * np.array(labels)
            for a, b in itertools.pairwise(labels):
                both[a, b] += weight
        expected.append(good / total)
        pairs += both / total
    np.testing.assert_allclose(m, np.concatenate(expected), atol=1e-9)
    np.testing.assert_allclose(crf._pair_counts(model, odds, first, m), pairs, atol=1e-9)


def test_long_texts_are_scored_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    text = "\n".join(rng.choice(["a line of some words.", "MORE $$$ | ||", "", "once again, words", "x" * 90], 400)).encode()
    weights, hasher = rng.normal(size=crf.WIDTH), _Words()
    whole = crf.line_odds([text], hasher, weights)
    score = crf.QualityModel(weights, np.array([[1.0, 0], [0, 0.5]])).scores(*whole)
    monkeypatch.setattr(crf, "PIECE", 300)
    monkeypatch.setattr(crf, "LINES", 7)
    pieces = crf.line_odds([text], hasher, weights)
    for a, b in zip(whole, pieces, strict=True):
        np.testing.assert_allclose(a, b, atol=1e-9)
    np.testing.assert_allclose(score, crf.QualityModel(weights, np.array([[1.0, 0], [0, 0.5]])).scores(*pieces))


def test_scores_do_not_depend_on_the_texts_beside_them():
    rng = np.random.default_rng(2)
    words = ["a line of some words.", "MORE $$$ | ||", "", "once again, words", "x" * 90, "ünï 12 34", "so it goes, and goes."]
    texts = ["\n".join(rng.choice(words, rng.integers(1, 60))).encode() for _ in range(300)]
    model, hasher = crf.QualityModel(rng.normal(size=crf.WIDTH), np.array([[1.0, 0], [0, 0.5]]), 1.3, 0.2), _Words()
    score = lambda own: model.scores(*crf.line_odds(own, hasher, model.weights)).tolist()
    alone = [score([t])[0] for t in texts]
    assert score(texts) == alone
    for size in (2, 7, 64):
        assert [s for k in range(0, 300, size) for s in score(texts[k : k + size])] == alone


def test_the_fit_is_bounded_by_lines_of_whole_texts(spark):
    """A text that has more lines than are left is passed over, whole; the others are read whole."""
    docs = spark.createDataFrame([(k, f"line {k}\n" * (5 if k else 5000)) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    rest = docs.where("doc_id > 0")
    a, b = crf.train_quality(docs, labels, sample_lines=1000), crf.train_quality(rest, labels, sample_lines=1000)
    assert (a.weights == b.weights).all() and a.slope == b.slope
    assert not (crf.train_quality(docs, labels).weights == a.weights).all()
    assert crf.train_quality(docs, labels, sample_lines=3).shift == 0.0


@given(st.lists(st.integers(0, 5), max_size=7), st.lists(st.floats(-5, 5), min_size=8, max_size=8))
@settings(max_examples=100, deadline=None)
def test_hierarchical_choice_against_all_choices(up, odds):
    parent = [-1, *(min(k, p) for k, p in enumerate(up))]
    odds = np.array(odds[: len(parent)])
    allowed = (c for c in itertools.product((False, True), repeat=len(parent)) if all(not c[k] or k == 0 or c[parent[k]] for k in range(len(parent))))
    best = max(float(odds[list(c)].sum()) for c in allowed)
    got = consistent(parent, odds)
    assert all(not got[k] or k == 0 or got[parent[k]] for k in range(len(parent)))
    assert float(odds[got].sum()) == pytest.approx(best, abs=1e-9)


@pytest.mark.parametrize("part", ['<a "', "<span><div>", "<li><span>", "<b><p>", "<select><option>", "</p>", "<!-", "<table><tr>"])
def test_the_parser_takes_linear_time(part):
    n = 1_000_000 // len(part) // 4
    took = []
    for times in (n, 4 * n):
        began = time.perf_counter()
        Page(part * times)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 1


#: (page, blocks of its article), written by hand after common forms.
PAGES = [
    ("<p>Bare text only, nothing else on this page at all.</p>", ["Bare text only, nothing else on this page at all."]),
    ("<article><p>The value <math><mi>x</mi>=5</math> holds.</p><p>Press <button>Start</button> now.</p></article>", ["The value x=5 holds.", "Press Start now."]),
    (
        "<html><body><table><tr><td><a href=/a>Home</a><br><a href=/b>News</a><br><a href=/c>About</a></td><td><h2>On Rivers</h2><p>Rivers carry water from the hills to the sea, and silt with it.</p>"
        "<p>Their floods feed the fields along the banks.</p></td></tr></table></body></html>",
        ["On Rivers", "Rivers carry water from the hills to the sea, and silt with it.", "Their floods feed the fields along the banks."],
    ),
    (
        "<body><div id=nav><a href=/>Home</a> <a href=/x>More</a></div><div class=post><h1>A day out</h1><p>We went up to the lake, and it rained all day.</p><p>Still, it was <em>good</em>.</p></div>"
        "<div class=comments><p>Nice post!</p></div><div id=footer>(c) 2020 Somebody</div></body>",
        ["A day out", "We went up to the lake, and it rained all day.", "Still, it was good."],
    ),
    (
        "<body><header><h1>Site</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header><main><article><header><h1>Real title</h1></header><p>First paragraph of the story, with enough words to count.</p>"
        "<aside class=related><h3>Related</h3><ul><li><a href=/1>One</a></li></ul></aside><p>Second paragraph follows here.</p></article></main><footer><p>Copyright</p></footer></body>",
        ["Real title", "First paragraph of the story, with enough words to count.", "Second paragraph follows here."],
    ),
    (
        "<body><div class='cookie-banner'>We use cookies. <button>Fine</button></div><div class=content><h2>How to</h2><ol><li>Take a bowl of flour and salt.</li><li>Add water, and knead it well.</li></ol><pre>bake 30 min</pre></div>"
        "<form action=/s><label>Search</label><input name=q></form></body>",
        ["How to", "Take a bowl of flour and salt.", "Add water, and knead it well.", "bake 30 min"],
    ),
]


def _framed(core: str) -> str:
    return f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a> <a href=/c>Contact</a></nav>{core}<footer><p>Copyright 2021 The Paper, all rights reserved.</p></footer></body></html>"


STORY = ["The old mill", "For a hundred years the mill by the river ground the corn of four villages, and then it stopped.", "Nobody remembers why, but the wheel still turns when the snow melts."]
_STORY = f"<h1>{STORY[0]}</h1><p>{STORY[1]}</p><p>{STORY[2]}</p>"
_SIDE = "<ul><li><a href=/1>One thing</a></li><li><a href=/2>Another thing</a></li><li><a href=/3>A third</a></li></ul>"
#: Shapes kept apart from the made-up pages that the trees learn from: state and theme words on articles, among others.
SHAPES = [
    *((_framed(f"<{t} class='{c}'>{_STORY}</{t}>"), STORY) for t in ("div", "article") for c in ("post comment-enabled", "feedback-article", "discussion-paper", "thread", "legal-notice", "article-more", "post has-sidebar", "privacy")),
    *((_framed(f"<{t} class='{c}'>{_STORY}</{t}>"), STORY) for t, c in (("section", "single single-post comments-open"), ("main", "page sidebar-right"), ("div", "hentry tag-news"), ("div", "entry related-posts-on"), ("div", "layout nav-collapsed"), ("section", "top-stories"), ("div", "reply-letter"), ("article", "ad-free popular"))),
    (_framed("<article><h1>Reading list</h1><ul>" + "".join(f"<li><a href=/b{k}>Book number {k}</a></li>" for k in range(8)) + "</ul></article>"), ["Reading list", *(f"Book number {k}" for k in range(8))]),
    (_framed(f"<main>{_STORY}<div class='related-work'><h2>Earlier work</h2><p>Two studies had looked at the mill before, but neither had asked the miller's family about it.</p></div></main>"), [*STORY, "Earlier work", "Two studies had looked at the mill before, but neither had asked the miller's family about it."]),
    (_framed(f"<article>{_STORY}<xmp>code <b>sample</b> here</xmp></article>"), [*STORY, "code <b>sample</b> here"]),
    (_framed(f"<article>{_STORY}<svg><text>label</text></svg></article>"), [*STORY, "label"]),
    (_framed(f"<article>{_STORY}<video src=v>No film here</video></article>"), [*STORY, "No film here"]),
    (_framed(f"<div id=main>{_STORY}</div><div class='comments content'><div class=comment><p>I worked there as a boy, and it was cold.</p></div><div class=comment><p>Lovely story!</p></div></div>"), STORY),
    (_framed(f"<div class=post>{_STORY}</div><div class='sidebar text'><h3>More</h3>{_SIDE}</div>"), STORY),
    (_framed(f"<div class=story>{_STORY}</div><div class='related article-list'><h3>Related</h3>{_SIDE}</div>"), STORY),
    (_framed(f"<div class='cookie-notice content'><p>We use cookies to make this site work.</p></div><article>{_STORY}</article>"), STORY),
    (_framed(f"<article>{_STORY}<div class='ad-box body'>Buy our flour now</div></article>"), STORY),
    (_framed(f"<div><div><div class='col main-col'>{_STORY}</div><div class='col side'>{_SIDE}</div></div></div>"), STORY),
    (_framed(f"<article>{_STORY}</article><form class=subscribe><label>Your address</label><input><button>Send</button></form>"), STORY),
    (_framed(f"<article>{_STORY}<div class='share copy'><a href=/f>Facebook</a> <a href=/t>Twitter</a></div></article>"), STORY),
    (_framed(f"<div class='page text'><blockquote><p>{STORY[1]}</p></blockquote><p>{STORY[2]}</p></div>"), STORY[1:]),
    (_framed(f"<table class=layout><tr><td class=left>{_SIDE}</td><td>{_STORY}</td></tr></table>"), STORY),
    (_framed(f"<article><header><h1>{STORY[0]}</h1></header><p>{STORY[1]}</p><aside class=related>{_SIDE}</aside><p>{STORY[2]}</p></article>"), STORY),
]


def test_main_text_of_pages_of_other_shapes():
    for pages, least in ((PAGES, 0.9), (SHAPES, 0.93)):
        said = [set(t.split("\n")) - {""} for t in main_texts([p for p, _ in pages], fitted())]
        hits = sum(len(a & set(b)) for a, (_, b) in zip(said, pages, strict=True))
        assert hits / sum(len(a) for a in said) >= least and hits / sum(len(b) for _, b in pages) >= least
    assert len(SHAPES) >= 40 and all(said)  # of these one loses its list of links, which looks like a menu


NOTICES = {
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n * Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": "The code is licensed under the MIT License.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
}


@pytest.mark.parametrize("label", NOTICES)
def test_license_wording(label):
    def found(text: str) -> set[str]:
        words = words_of(text)
        return {k for k, t in TEMPLATES.items() if Template(k, t).spans(words, b" " + b" ".join(words) + b" ")}

    text = "Before. " + NOTICES[label] + " After."
    assert label in found(text)
    if not label.endswith("-notice"):
        words = NOTICES[label].split()
        assert label not in found(" ".join(words[: len(words) // 2] + ["missing"] + words[len(words) // 2 + 1 :]))  # a mandatory word is another


def test_files_are_read_in_pieces(monkeypatch):
    from lakeloom.llm import token_files

    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 2 ** rng.choice([3, 12, 20, 28]), rng.integers(0, 60)) for _ in range(50)]
    counts = np.array([len(d) for d in docs])
    content = file_bytes([None, *range(1, 50)], counts.tolist(), *pack(np.concatenate(docs), counts))
    monkeypatch.setattr(token_files, "READ_IDS", 100)
    parts = list(read_file(memoryview(content)))
    assert content[:8] == MAGIC and len(parts) > 5
    assert [i for ids, _, _ in parts for i in ids] == [None, *range(1, 50)]
    assert np.concatenate([r for _, _, r in parts]).tolist() == np.concatenate(docs).tolist()
