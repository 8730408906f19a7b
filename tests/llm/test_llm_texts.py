"""Quality, duplicates, leaks, licenses, pages and URLs against brute force on small tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from geoloom.llm.components import components
from geoloom.llm.decontamination import leaks, marked_words
from geoloom.llm.html_text import extract_text, main_text
from geoloom.llm.jaccard import jaccard_groups, one_of_each_group
from geoloom.llm.licenses import TEMPLATES, Scanner, align, ascending, scan_licenses
from geoloom.llm.quality_classifier import FEATURES, Attention, accepted, passages, score, train
from geoloom.llm.quality_rules import base_counts, passing, quality_rules
from geoloom.llm.url_filters import DOMAIN, HOST, PATH, URL, filter_urls
from geoloom.llm.words import Block
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(draw, n, vocabulary=400):
    return " ".join(f"{draw.choice('abcdefgh')}{draw.randrange(vocabulary)}" for _ in range(n))


# --- words and base rules

def plain_base(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    eight = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if eight[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def base_texts():
    draw = random.Random(2)
    return ["", " \n ", "a", "a b c d e f g h " * 3, "x\nx\n\nx \nx", "é ñ #x# $5 <b>", "word " * 50, "\t\v\f\r", "日本 語 x"] + [
        "".join(draw.choices(["a ", "b ", "c\n", "é#", "\n", "longer words here ", "$ "], k=draw.randrange(1, 120))) for _ in range(60)]


def test_base_counts():
    texts = base_texts()
    got = base_counts(Block([t.encode() for t in texts]))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[k][i]) for k in names) for i in range(len(texts))] == [plain_base(t) for t in texts]


def plain_ratio(texts, good):
    """The same multinomials without hashing: with far fewer n-grams than buckets, few share one."""
    def grams(t):
        tokens = re.findall(r"[^\W_]+|[!-/:-@\[-`{-~]+", t.lower())
        return [*((a,) for a in tokens), *zip(tokens, tokens[1:])]
    raw, kept = Counter(), Counter()
    for t, g in zip(texts, good):
        raw.update(grams(t))
        kept.update(grams(t) if g else [])
    share = sum(kept.values()) / sum(raw.values())
    return [np.mean([np.log((kept[x] + 20) / (raw[x] * share + 20)) for x in grams(t)]) if grams(t) else 0.0 for t in texts]


@pytest.fixture(scope="module")
def quality(spark):
    draw = random.Random(3)
    rows = []
    for i in range(240):
        text = prose(draw, draw.randrange(25, 200), 60)
        rows.append((i, text if i % 4 else " ".join(w + draw.choice(["###", "$$$", "&&&"]) for w in text.split()), "src"))
    docs = spark.createDataFrame(rows + [(None, None, "src"), (5000, "", None), (5001, "Few words.", "src")], "doc_id long, text string, label string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240) if i % 3] + [(None, 1, 0), (1, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_quality_rules(quality):
    rows, docs, labels = quality
    found = {r.doc_id: r for r in quality_rules(docs, labels.filter("quality = 1"), count=1 << 20).collect()}
    want = plain_ratio([*(t for _, t, _ in rows), 'Few words.'], [*(i % 4 > 0 and i % 3 > 0 for i, *_ in rows), False])
    assert max(abs(found[i].log_ratio - w) for (i, *_), w in zip(rows, want)) < 0.02  # a few share a bucket
    found = {r.doc_id: r for r in quality_rules(docs, labels.filter("quality = 1")).collect()}
    assert [found[i].kept for i, *_ in rows] == [i % 4 > 0 for i, *_ in rows]
    for i in (None, 5000, 5001):
        assert found[i].base_failed and not found[i].kept
    assert {r.doc_id for r in passing(docs, labels.filter("quality = 1")).collect()} == {i for i, *_ in rows if i % 4}
    nothing = quality_rules(docs, labels.limit(0)).collect()
    assert all(r.log_ratio == 0 for r in nothing) and quality_rules(docs.limit(0), labels).count() == 0


def test_passages_cover_all_words():
    texts = ["", "one", " ".join(["w"] * 49), " ".join(["w"] * 20000), "tail"]
    x, own = passages(Block([t.encode() for t in texts]))
    assert np.bincount(own).tolist() == [1, 1, 2, 64, 1] and x.shape == (69, FEATURES) and np.isfinite(x).all() and not x[0].any()


def test_attention_gradient():
    draw = np.random.default_rng(0)
    x, own, labels = draw.normal(size=(9, FEATURES)), np.array([0, 0, 0, 1, 1, 2, 3, 3, 3]), np.array([0.0, 1, 1, 0])
    model = Attention(4, 3)
    loss = lambda: -np.mean(labels * np.log(p := model.scores(x, own, 4)) + (1 - labels) * np.log(1 - p))
    before = loss()
    model.fit(x, own, labels, rounds=200)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-3
    assert loss() < 0.2 * before


def test_classifier(quality):
    rows, docs, labels = quality
    model = train(docs, labels)
    found = {r.doc_id: r for r in score(docs, model).collect()}
    assert len(found) == len(rows) + 3 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found.values())
    held = [i for i, *_ in rows if found[i].held_out]
    assert np.mean([found[i].predicted == (i % 4 > 0) for i in held]) > 0.95
    assert {r.doc_id for r in accepted(docs, model).collect()} == {i for i, r in found.items() if r.predicted}
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0
    assert {r.score for r in score(docs, train(docs, labels.limit(0))).collect()} == {0.5}


# --- near duplicates

def plain_groups(rows, n=4, percent=85):
    sets = []
    for _, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]) and group[i] != group[j]:
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    lowest = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return [(i, len(s), lowest[g]) for (i, _), s, g in zip(rows, sets, group)]


def edited(draw, text, edits):
    words = text.split()
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"z{draw.randrange(10 ** 6)}"
    return " ".join(words)


def near_rows():
    draw = random.Random(4)
    rows = [(1, None), (2, ""), (3, "  "), (4, "one two"), (5, "One Two"), (6, "one two three four"), (7, "two one"), (None, "one two"), (None, None), (8, "x"), (8, "x")]
    number = 100
    common = prose(draw, 60)
    for family in range(12):
        base = prose(draw, draw.choice([12, 40, 90, 300]))
        if family % 3 == 0:
            base = base + " " + common
        for k in range(draw.randrange(1, 9)):
            rows.append((number, edited(draw, base, k)))
            number += 1
    chain = prose(draw, 200)
    for _ in range(25):  # each near the one before, the first and last far apart
        rows.append((number, chain))
        chain, number = edited(draw, chain, 2), number + 1
    rows += [(number + k, common + f" {k} {k} {k} {k} {k} {k} {k}") for k in range(30)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("percent", [85, 60])
def test_jaccard(spark, tmp_path, percent):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string").repartition(4).cache()
    got = sorted(map(str, map(tuple, jaccard_groups(docs, percent=percent, folder=str(tmp_path / "j")).collect())))
    assert got == sorted(map(str, plain_groups(rows, percent=percent)))
    assert jaccard_groups(docs.limit(0)).count() == 0


def test_one_of_each_group(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, place string").repartition(4).cache()
    kept = Counter(r.doc_id for r in one_of_each_group(docs).collect())
    groups = plain_groups(rows)
    want = Counter({g for i, n, g in groups if n and g is not None}) + Counter(i for i, n, _ in groups if not n)
    assert kept == want and one_of_each_group(docs).columns == docs.columns


def test_components(spark):
    draw = random.Random(6)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7)]
    low = {x: x for p in links for x in p}
    for _ in range(400):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: c for x, c in low.items() if any(a != b and x in (a, b) for a, b in links)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- benchmark leaks

QUESTION = "A farmer called Anna has 12 red apples and gives 5 kg of them to Bob before Anna buys 12 more at the market."


def test_marked_words(spark):
    df = spark.createDataFrame([("He met Ann Lee (3.5 km) on 1,000 days. The end, 7% x<y",), (None,), ("",)], "text string")
    got = [r[0] for r in df.select(marked_words(F.col("text"))).collect()]
    assert got[0] == ["he", "met", "<name>=ann", "<name>=lee", "<num>=3.5", "<unit>=km", "on", "<num>=1000", "<unit>=days", "the", "end", "<num>=7", "<unit>=%", "x", "y"]
    assert got[1:] == [[], []]


def test_leaks(spark):
    draw = random.Random(8)
    around = lambda text: f"{prose(draw, 30)}. {text} {prose(draw, 20)}"
    plain = prose(draw, 40)
    docs = [(1, around(QUESTION)), (2, around(QUESTION.replace("12", "31").replace("Anna", "Eve").replace("5 kg", "8 lb"))),
            (3, around(QUESTION.replace("12", "31", 1).replace("Anna", "Eve", 1))), (4, prose(draw, 300)), (5, None), (6, ""), (None, QUESTION), (7, around(plain)), (7, around(plain)),
            (8, around(QUESTION.lower().replace("12 red", "12 green")))]
    spark_docs = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item_id string").repartition(2)
    items = spark.createDataFrame([(10, QUESTION), (11, plain), (12, None), (13, "too short"), (None, plain)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in leaks(spark_docs, items).collect()}
    assert found[1, 10].exact and found[1, 10].coverage == 16 / 17  # one window has too few literals
    assert not found[2, 10].exact and found[2, 10].n_slots == 4 and found[2, 10].coverage == 16 / 17
    assert (3, 10) not in found  # one value of the item stands for two
    assert found[7, 11].exact
    assert {k for k in found} <= {(1, 10), (2, 10), (7, 11), (8, 10)}
    assert sorted(map(str, leaks(spark_docs, items, broadcast_windows=0).collect())) == sorted(map(str, found.values()))
    assert leaks(spark_docs.limit(0), items).count() == 0 and leaks(spark_docs, items.limit(0)).count() == 0


# --- licenses

def test_alignment():
    assert ascending([(0, 5), (1, 1), (2, 2), (3, 0), (4, 3)]) == [(1, 1), (2, 2), (4, 3)]
    draw = random.Random(9)
    for _ in range(200):
        a, b = ([draw.choice("abcdefghijklmnop") for _ in range(draw.randrange(0, 25))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))
        assert align(a, a) == [(i, i) for i in range(len(a))]


def test_scan_licenses(spark):
    draw = random.Random(10)
    mit, gpl = TEMPLATES["MIT"][2], TEMPLATES["GPL-3.0"][0]
    around = lambda text: f"{prose(draw, 300)} {text} {prose(draw, 300)}"
    docs = [(1, around(mit)), (2, around(" ".join(w if k % 12 else "changed" for k, w in enumerate(mit.split())))), (3, around(" ".join(w if k % 3 else "no" for k, w in enumerate(mit.split())))),
            (4, around(gpl) + around(gpl) + mit), (5, None), (6, ""), (None, gpl), (7, prose(draw, 5000)), (8, gpl), (8, gpl)]
    found = {}
    for r in scan_licenses(spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, license string")).collect():
        found.setdefault(r.doc_id, {})[r.license] = r
    assert found[1]["MIT"].coverage == 1.0 and found[1]["MIT"].first_word == 300 and 0.8 <= found[2]["MIT"].coverage < 1
    assert 3 not in found and 5 not in found and 6 not in found and 7 not in found
    assert found[4]["GPL-3.0"].n_notices == 2 and "MIT" in found[4] and found[None]["GPL-3.0"].coverage == 1.0
    assert {k for k in found[8]} == {"GPL-3.0"}  # version 2 comes near, but a better notice holds its place
    for name, texts in TEMPLATES.items():
        for t in texts:
            assert any(n == name and c == 1.0 for n, c, *_ in Scanner().scan(around(t))), (name, t[:40])


# --- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies. Accept them, please.</div><div class="ad">Buy this now. Very cheap.</div>
<main><article><h1>Title &amp; more</h1><p>First <b>bold</b> para&shy;graph, with&nbsp;some   text.<p>Second one:<br>line &lt;two&gt; &#233;.
<ul><li>Item one.</li><li>Item two.</li></ul><form>Your name <input></form></article>
<section id="comments"><article class="comment"><p>I like this very much, thank you so much for it.</p></article></section></main>
<aside>Related: <a href="/c">other pages</a>.</aside><footer>&copy; 2024 Site. All rights reserved.</footer></body></html>"""


def test_main_text():
    want = "Title & more First bold para\xadgraph, with some text. Second one: line <two> é. Item one. Item two."
    assert main_text(PAGE)[0] == want
    for page, text in ((None, ""), ("", ""), ("just text", "just text"), ("<nav>x</nav>", ""), ("<p>a < b & c</p>", "a < b & c"), ("<p>open <b>bold", "open bold"),
                       ("<script>x", ""), ("<p title='it's'>x</p>", "x"), ("<article><p>Be.</p></article><footer>Long footer text, with marks. And more.</footer>", "Be."),
                       ("<!-- open", ""), ("<div><p>x</div></div></p>y", "x y")):
        assert main_text(page)[0] == text, page


def test_extract_text(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, None), (1, "u", PAGE, "x"), (2, "v", "<p>" + "word, " * 50_000, "x")]
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == 4 and all(r.n_chars == len(r.text) for r in found) and max(r.n_chars for r in found) == 300_000 - 1
    assert extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- URLs

def test_urls_of_very_many_folders(spark):
    url = "http://a.org" + "/" * 60_000 + "x"  # all its folders would be 1.8 GB
    captures = spark.createDataFrame([(1, url, "2024-01-05"), (2, "http://a.org/f/g", "2024-01-05")], "page_id long, url string, fetched string")
    edits = spark.createDataFrame([("block", PATH, "a.org/f/", "add", "2024-01-01", 1), ("block", PATH, "a.org///", "add", "2024-01-01", 2)],
                                  "list string, kind int, pattern string, action string, day string, seq long")
    found = {r.page_id: (r.kept, r.pattern) for r in filter_urls(captures, edits).collect()}
    assert found == {1: (False, "a.org///"), 2: (False, "a.org/f/")}


def test_filter_urls(spark):
    draw = random.Random(11)
    hosts = ["a.example.com", "b.example.com", "x.y.example.org", "other.net", "example.com"]
    urls = [f"http{draw.choice(['', 's'])}://{draw.choice(hosts)}{draw.choice(['', '/', '/f/p', '/f/q?x=1', '/g/h/i#t'])}" for _ in range(120)]
    days = [f"2024-{m:02d}-{d:02d}" for m in range(1, 8) for d in (1, 9, 17, 28)]
    pattern = {URL: ["a.example.com/f/p", "other.net/"], PATH: ["a.example.com/f/", "b.example.com/g/h/"], HOST: hosts, DOMAIN: ["example.com", "y.example.org"]}
    edits = []
    for seq in range(300):
        kind = draw.choice([URL, PATH, HOST, DOMAIN])
        edits.append((draw.choice(["allow", "block"]), kind, draw.choice(pattern[kind]), draw.choice(["add", "remove"]), draw.choice(days), seq))
    captures = [(k, u, draw.choice(days)) for k, u in enumerate(urls)] + [(500, None, "2024-02-02"), (501, urls[0], None), (None, urls[1], "2024-03-03"), (1, urls[1], "2024-04-04"), (1, urls[1], "2024-04-04")]

    def plain(page, url, day):
        best = None
        if url and day:
            bare = re.sub(r"[?#].*$", "", re.sub(r"^https?://", "", url))
            host = bare.split("/")[0]
            for kind, name in {(e[1], e[2]) for e in edits}:
                fits = {URL: bare == name, PATH: bare.startswith(name), HOST: host == name, DOMAIN: host == name or host.endswith("." + name)}[kind]
                for which in ("allow", "block"):
                    own = sorted((e[4], e[5], e[3]) for e in edits if (e[0], e[1], e[2]) == (which, kind, name) and e[4] <= day)
                    if fits and own and own[-1][2] == "add":
                        rank = (kind, which == "allow", len(name), which, name)
                        best = max(best, rank) if best else rank
        return (page, url, day, best[1] if best else True, *((best[3], best[0], best[4]) if best else (None,) * 3))

    df = spark.createDataFrame(captures, "page_id long, url string, fetched string").withColumn("list", F.lit("x"))
    log = spark.createDataFrame([*edits, (None, 2, "other.net", "add", "2024-01-01", 1), ("block", HOST, "other.net", "odd", "2024-01-01", 1)],
                                "list string, kind int, pattern string, action string, day string, seq long").withColumn("day", F.col("day").cast("date"))
    for slice_days in (7, 30, 400):
        got = [(r.page_id, r.url, r.fetched and str(r.fetched), r.kept, r["list"], r.kind, r.pattern) for r in filter_urls(df, log, slice_days).collect()]
        assert sorted(map(str, got)) == sorted(map(str, (plain(*c) for c in captures)))
    assert filter_urls(df.limit(0), log).count() == 0 and filter_urls(df, log.limit(0)).filter("kept").count() == len(captures)
