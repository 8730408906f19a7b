"""The whole job where it once was cut: rows, templates, pages, items and passages that used to be lost."""

import time
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from geoloom.llm import jaccard
from geoloom.llm.decontamination import leaks, without_leaks
from geoloom.llm.html_text import main_text
from geoloom.llm.licenses import Scanner
from geoloom.llm.quality_classifier import FEATURES, Attention, passages, score
from geoloom.llm.words import Block

from test_llm_texts import near_rows, plain_groups


# --- near duplicates: splits planned anew between jobs

@pytest.fixture
def replanned(spark, tmp_path, monkeypatch):
    """(rows, documents in files whose splits change each time links are worked out)."""
    rows = near_rows()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(9).write.parquet(str(tmp_path / "docs"))
    plain, parts = jaccard._links, iter([30, 3, 60])

    def links(*args):
        spark.conf.set("spark.sql.files.minPartitionNum", next(parts))
        return plain(*args)

    monkeypatch.setattr(jaccard, "_links", links)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    yield rows, spark.read.parquet(str(tmp_path / "docs"))
    spark.conf.unset("spark.sql.files.minPartitionNum")


def test_groups_survive_other_splits(replanned):
    rows, docs = replanned
    assert sorted(map(str, map(tuple, jaccard.jaccard_groups(docs).collect()))) == sorted(map(str, plain_groups(rows)))


def test_leaders_survive_other_splits(replanned):
    rows, docs = replanned
    groups = plain_groups(rows)
    want = Counter({g for _, n, g in groups if n and g is not None}) + Counter(i for i, n, _ in groups if not n)
    assert Counter(r.doc_id for r in jaccard.one_of_each_group(docs).collect()) == want


# --- licenses: all words that may be missing left out, the marks first

def test_every_template_without_its_spare_words():
    scanner = Scanner()
    for (name, words), marks, least in zip(scanner.all, scanner.marks, scanner.least):
        order = sorted(range(len(words)), key=lambda i: (words[i] not in marks, i))
        gone = set(order[:len(words) - least])
        text = " ".join(f"x{i}" if i in gone else w for i, w in enumerate(words))
        found = [(c, n) for license, c, n, *_ in scanner.scan(f"before {text} after") if license == name]
        assert (least / len(words), least) in found, (name, text)


def test_short_notices_in_other_words():
    for text, name in (("Distributed under the MIT License.", "MIT"), ("Available under CC BY 4.0", "CC-BY-4.0"), ("Released under CC BY-NC 4.0", "CC-BY-NC-4.0"),
                       ("Released under CC BY-SA 4.0", "CC-BY-SA-4.0")):
        assert [n[:2] for n in Scanner().notices(text)] == [(name, 0.8)], text


def test_words_that_name_a_license_may_not_be_missing():
    none = ["Licensed under the Apache License.", "The album was released under the Columbia license in 1970.", "Licensed under CC BY 3.0.", "Licensed under CC BY-ND 4.0.",
            "Licensed under the Apache License, Version 1.1.", "This work is licensed under the GNU General Public License, version 1.", "Licensed under the Eclipse Public License, version 3.", ""]
    for text in none:
        assert list(Scanner().notices(text)) == [], text
    for text, name in (("Released under the BSD License.", "BSD"), ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
                       ("// SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("Licensed under the Apache License. And this under the MIT license.", "MIT"),
                       ("Licensed under the Apache License. Licensed under the MIT License.", "MIT")):
        assert [n[0] for n in Scanner().notices(text)] == [name], text
    own = Scanner({"Acme": ["Shared under the Acme Terms."], "Bolt": ["Shared under the Bolt Terms."]})
    assert [n[0] for n in own.notices("Given under the Bolt Terms. Shared under the Cask Terms.")] == ["Bolt"]


# --- pages: names on what holds the article, links in it

ARTICLE = "<h2><a href='/x'>Title</a></h2><p>A first sentence, with <a href='/y'>a link</a>, and more. Another one.</p><ul><li>Item one</li></ul><p>Short</p>"
TEXT = "Title A first sentence, with a link, and more. Another one. Item one Short"


def test_named_elements_around_the_article():
    for name in ("class='container has-sidebar'", "class=no-header", "class='with-banner'", "class='form-page'", "id='page-with-comments'"):
        for inner in (f"<article>{ARTICLE}</article>", f"<main>{ARTICLE}</main>", f"<div>{ARTICLE}</div>", ARTICLE):
            page = f"<body><nav>Menu</nav><div {name}>{inner}<div class='sidebar'><p>Buy this now. Very cheap.</p></div></div><footer>Foot.</footer></body>"
            assert main_text(page)[0] == TEXT, page
    assert main_text(f"<article class='post with-banner'><div class='form-page'>{ARTICLE}</div></article>")[0] == TEXT
    assert main_text(f"<div>{ARTICLE}</div><div id='comments'><p>Very nice, thank you.</p></div>")[0] == TEXT


def test_links_in_the_article():
    links = "<div><a href='/a'>Tag one</a> <a href='/b'>Tag two</a></div><ol><li><a href='/c'>Other page</a></li><li><a href='/d'>One more page</a></li></ol>"
    assert main_text(f"<article>{ARTICLE}{links}</article>")[0] == TEXT
    assert main_text(f"<article>{links}</article>")[0] == "Tag one Tag two Other page One more page"


# --- benchmark leaks: values with two places, rows of one id

def test_one_value_in_two_places_asked_anew(spark):
    item = "Every shop on the long street sells 2 boxes of fresh fruit that stay good for about 2 days in summer."
    anew = item.replace("2 boxes", "3 boxes").replace("2 days", "7 days")
    docs = spark.createDataFrame([(1, f"words before it. {anew} words after"), (2, item)], "doc_id long, text string")
    found = {r.doc_id: r for r in leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()}
    assert set(found) == {1, 2} and not found[1].exact and found[2].exact and found[1].n_slots == 2
    assert found[1].n_windows == found[2].n_windows


def test_rows_of_one_id_are_matched_each(spark):
    item = "Every shop on the long street sells 2 boxes of fresh fruit that stay good in summer."
    docs = spark.createDataFrame([(1, item), (1, item.replace("2", "9"))], "doc_id long, text string")
    found = leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert len(found) == 1 and found[0].exact


def test_items_without_a_window(spark):
    items = {1: "What is the capital of France?", 2: "Who?", 3: "too short", 4: "12 34 56 78 and 9 10 11 12 13", 5: "one 1 two 2 3 4 three 5 6 7 8 9 four 10 five", 6: "", 7: "add 3 and 4"}
    docs = {1: "so, what is the capital of Spain? who", 2: "it is too short", 3: "x 12 34 56 78 and 9 10 11 12 13 y", 4: "x 12 34 56 78 and 9 10 11 12 14 y", 5: "z one 8 two 2 3 4 three 5 6 7 8 9 four 10 five",
            6: "add 3 and 5", 7: "we add 3 and 4", 8: "", 9: "four 10 five one"}
    docs[5] = docs[5].replace("one 8", "one 1")
    found = {(r.doc_id, r.item_id): (r.exact, r.coverage) for r in leaks(spark.createDataFrame(list(docs.items()), "doc_id long, text string"),
                                                                         spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert found == {(1, 1): (False, 1.0), (1, 2): (True, 1.0), (2, 3): (True, 1.0), (3, 4): (True, 1.0), (5, 5): (True, 1.0), (7, 7): (True, 1.0)}


def test_decontamination_judges_row_by_row(spark, tmp_path):
    item = "Every shop on the long street sells 2 boxes of fresh fruit that stay good in summer."
    spark.createDataFrame([(5, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None, item, "a"), (None, "clean", "b"), (1, item, "c"), (1, "clean too", "d"), (2, None, "e"), (3, "", "f")], "doc_id long, text string, row string")
    left = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and {r.row for r in left.collect()} == {"b", "d", "e", "f"}


# --- pages: names inside the article, malformed pages

def test_names_inside_the_article():
    prose = "A sentence of prose, which is long. " * 3
    page = (f"<article><h1>T</h1><p>{prose}</p><h2 id='related-work'>Related</h2><p>{prose}</p><section id='search-methods'><h2 class='share'>Search</h2><p>{prose}</p></section>"
            f"<div class='share-price'><p>The price rose, much.</p></div><p class='has-drop-share'>Drop.</p><div class='form-group'><p>Group, here.</p></div><p id='search'>Last.</p>"
            f"<div class='comment-list'><p>{prose}</p></div><div class='postComments'><p>Nice, this.</p></div><section id='comments'><p>{prose}</p></section></article>")
    p = prose.strip()
    assert main_text(page)[0] == f"T {p} Related {p} Search {p} The price rose, much. Drop. Group, here. Last."


@pytest.mark.parametrize("part", ["<a ", "><a ", "<p a='", "<p a='>'", "<div>x", "<!", "<!--", "<span>x", "</p", "<p a=\"'>"])
def test_malformed_pages_take_linear_time(part):
    start = time.process_time()
    text, _ = main_text("<article><p>Be.</p></article>" + part * 30_000)
    assert text.startswith("Be.") and time.process_time() - start < 10


# --- benchmark leaks: windows judged one by one, too little evidence

def test_copied_windows_count_where_a_value_stays_and_changes(spark):
    item = "If Tom has 5 apples in the basket and gives away some of them then how many are left of the 5 pears now?"
    docs = spark.createDataFrame([(1, "before. " + item.replace("5 pears", "9 pears")), (2, item), (3, item.replace("5", "7")), (4, "nothing of it")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert {r.doc_id for r in leaks(docs, items).collect()} == {2, 3}
    found = {r.doc_id: r for r in leaks(docs, items, each_window=True).collect()}
    assert set(found) == {1, 2, 3} and 0 < found[1].coverage < found[2].coverage and found[1].n_windows < found[2].n_windows


def test_little_evidence_and_both_joins(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Tell me why it rains so much."), (2, "Why?"), (3, "So: what is the capital of France?"), (None, "why"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, "Why?"), (6, "What is the capital of France?")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in leaks(docs, items, evidence=16).collect()} == {(2, 5), (3, 6)}
    for bound in (0, 10):
        assert {r.doc_id for r in without_leaks(docs, items, bound).collect()} == {1, 4}


# --- quality: long texts have passages like any other

def plain_score(model, text):
    """Attention by plain loops over the passages of one text."""
    x = ((passages(Block([text.encode()]), None)[0].astype(float)) - model.mean) / model.scale
    w, top, total = model.w, np.zeros(len(model.w["out"])), 0.0
    for row in x:
        h = np.tanh(row @ w["W"] + w["c"])
        weight = np.exp(sum(a * np.tanh(h @ v) / (1 + np.exp(-(h @ u))) for a, v, u in zip(w["a"], w["V"].T, w["U"].T)))
        top, total = top + weight * h, total + weight
    return 1 / (1 + np.exp(-(top / total @ w["out"] + w["bias"][0])))


def test_long_texts_are_scored_by_passages_of_one_size(spark):
    words = [f"w{k % 97}" for k in range(20_000)]
    x, own = passages(Block([" ".join(words).encode()]), None)
    assert x.shape == (417, FEATURES)
    model = Attention()
    texts = [" ".join(words), "", "one", " ".join(words[:3073]) + " #$%"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in score(docs, model).collect():
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-9
