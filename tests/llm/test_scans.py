"""Licence scans, page text, nearest neighbours and toxicity."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.llm import html_text, licences, neighbours, toxicity

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def plain_base(text):
    """Base places by walking over the words."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(i, label) for i in range(len(words)) for p, label in BASE.items() if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


WORDS = ["cc", "by", "CC-BY", "general", "public", "license", "all", "rights", "reserved", "GNU", "v3", "2.0", "licensed", "under", "the", "MIT", "é", "Ünder", ".", "(c)", "-", "apache", "nc", "4.0"]


def test_base_places():
    rng = random.Random(2)
    texts = [None, "", "  ", "CC\nBY", "xcc by", "cc byé", "éall rights reserved", "all rights reserved all rights reserved", "cc by cc by"]
    texts += [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(60))) for _ in range(400)]
    for t in texts:
        r = licences.scan(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_base(t), t
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_gate_changes_nothing():
    """Without the keyword gate the same detections are found."""
    rng = random.Random(4)
    for _ in range(150):
        low = " ".join(rng.choice(WORDS) for _ in range(40)).lower()
        every = [(m.start(), m.end(), r) for r in licences.RULES for m in r.pattern.finditer(low)]
        key = lambda d: (d[0], d[1], d[2].label, d[2].priority)
        assert sorted(map(key, licences.detections(low))) == sorted(map(key, every))


def test_suppression():
    rng = random.Random(6)
    rules = [r for r in licences.RULES if not r.base]
    for _ in range(200):
        found = [(a, a + rng.randrange(1, 30), rng.choice(rules)) for a in (rng.randrange(60) for _ in range(12))]
        taken = []
        for d in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[0], d[2].label)):
            if not any(t[0] <= d[0] and t[1] >= d[1] for t in taken):
                taken.append(d)
        assert licences.resolved(found) == taken


@pytest.mark.parametrize(
    ("text", "label"),
    [("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("GNU Lesser General Public License v2.1", "lgpl-2.1"), ("Released under the MIT License.", "mit"), ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"), ("SPDX-License-Identifier: MPL-2.0", "mpl-2.0"), ("alle Rechte vorbehalten", "reserved")],
)
def test_labels(text, label):
    assert label in licences.scan(text)["labels"].split(",")


def test_licences_of_a_table(spark):
    docs = spark.createDataFrame([(1, "CC BY 4.0", 3), (1, "CC BY 4.0", 3), (None, None, 1)], "doc_id long, text string, n_words int")
    got = licences.scanned(docs).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [0, 4, 4] and len(licences.RULES) > 300
    assert licences.scanned(docs.limit(0)).count() == 0


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>one<b>two</b>  three<p>four<br>five</article><footer>F</footer></body></html>", "A & B onetwo three four five"),
    ("<body><div class='sidebar'>no</div><div id=content><p>yes</p><script>var t='</p>';</script><!-- no --><form>no<input></form><div class='comments'>no</div></div></body>", "yes"),
    ("<main><ul><li>1<li>2</ul><aside>no</aside><p hidden>no</p></main>tail", "1 2"),
    ("plain text &lt;b&gt; &eacute;&#233;&nbsp;x", "plain text <b> éé x"),
    ("<article class=post><header><h1>H</h1></header><p>t</p><section id='comments'><article class='comment'>no</article></section></article>", "H t"),
    ("<p>a <a href='x>y'>b</a> c</p><p>\"q\" < 3</p>", 'a b c "q" < 3'),
    ("<article><p>unclosed <i>x", "unclosed x"),
    ("", ""), (None, ""), ("<", "<"), ("<script>never closed", ""), ("<div " + "a=\"" * 5000, None),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_pages(page, text):
    got = html_text.main_text(page)[0]
    assert text is None or got == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article class='post has-comments'><p>kept</p></article>", "kept"),
        ("<div class='content with-sidebar'><p>kept</p></div>", "kept"),
        ("<div class='overflow-hidden' style='overflow:hidden'><p>kept</p></div>", "kept"),
        ("<main><p>the long text of the page itself</p><article class='card'>teaser</article></main>", "the long text of the page itself teaser"),
        ("<article><p>a</p><figure><figcaption>caption</figcaption></figure></article>", "a caption"),
        ("<div class='site-footer'>no</div><div class='comments-list'>no</div><div style='display:none'>no</div><p>yes</p>", "yes"),
    ],
)
def test_marks_leave_content(page, text):
    assert html_text.main_text(page)[0] == text


def test_templates_go(spark):
    rows = [(i, f"http://Site.example/{i}", f"<body><div class=x>Same everywhere</div><div><p>Own text {i}</p></div></body>", "k") for i in range(12)]
    rows += [(100 + i, f"https://other.example/{i}", f"<body><div class=x>Same everywhere</div><p>{i}</p></body>", "k") for i in range(3)]
    rows += [(200, None, None, "k"), (None, "no url", "<p>x</p>", "k"), (0, rows[0][1], rows[0][2], "k")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r.page_id, r.url): r.text for r in html_text.extracted(pages).collect()}
    assert got[3, "http://Site.example/3"] == "Own text 3"
    assert got[101, "https://other.example/1"] == "Same everywhere 1"
    assert got[200, None] == "" and got[None, "no url"] == "x"


def test_rare_templates_without_running_text_go(spark):
    menu, quoted, listed = "<div>Home Shop</div>", "<div><p>quoted</p></div>", "<ul><li>in a list</ul>"
    rows = [(i, "http://a/x", f"{menu * (i < 5)}{quoted * (i < 5)}<article><p>{i}</p>{listed * (i < 5)}</article>" if i % 2 else f"{menu * (i < 5)}{quoted * (i < 5)}<p>{i}</p>") for i in range(60)]
    rows += [(100, "http://b/x", menu)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extracted(pages).collect()}
    assert got[0] == "quoted 0" and got[2] == "quoted 2" and got[50] == "50" and got[100] == "Home Shop"
    assert "in a list" in got[1]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<div class='content has-sidebar'><p>kept</p></div>", "kept"),
        ("<div style='overflow:hidden'><p>kept</p></div>", "kept"),
        ("<article class='post related-ready'><p>kept</p></article>", "kept"),
        ("<form id='aspnet'><article><p>kept</p></article></form>", "kept"),
        ("<form><p>search</p></form><div><p>kept</p></div>", "kept"),
        ("<div class='promo'><div class='ad'><p>buy</p></div><p>kept</p></div>", "kept"),
        ("<div class='comments'><p>first!</p></div>", ""),
    ],
)
def test_a_wrapper_keeps_the_only_paragraphs(page, text):
    assert html_text.main_text(page)[0] == text


def menu(i):
    links = "".join(f"<li class='{'active' if i % 6 == k else ''} n{k + i}'><a href='/{i}/{k}'>{'Home News About Shop Team Help'.split()[k]} {i * k}</a></li>" for k in range(4 + i % 3))
    return f"<div id='m{i}'><ul>{links}</ul></div>"


def test_menus_with_other_links_are_one_template(spark):
    """Neither names nor marks tell what is template here, and no two pages have the same source for it."""
    rows = [(i, f"http://a/{i}", f"<body>{menu(i)}<div><p>Text {i} of its own</p></div><div>Visited {i * 37} times</div></body>") for i in range(12)]
    rows += [(100, "http://b/", f"<body>{menu(3)}</body>")]
    got = {r.page_id: (r.text, r.n_templates) for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i][0] == f"Text {i} of its own" and got[i][1] >= 2 for i in range(12))
    assert got[100][0].startswith("Home 0")


def test_a_page_of_links_keeps_them(spark):
    rows = [(i, f"http://a/{i}", f"<div><ul><li><a href=x>topic {chr(97 + i)}</a><li><a href=y>more {chr(97 + i)}</a></ul></div>") for i in range(8)]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"topic {chr(97 + i)} more {chr(97 + i)}" for i in range(8)}


def test_counts_are_those_of_the_hosts(spark):
    rng = random.Random(2)
    parts = [f"<div>note {i}</div>" for i in "abcdef"] + [menu(i) for i in range(3)] + [f"<section><p>passage {i}</p></section>" for i in "xyz"]
    rows = [(i, f"http://h{rng.randrange(3)}/", "".join(rng.sample(parts, 4)) + f"<p>{i}</p>") for i in range(90)]
    found = {(r.host, r.hash) for r in html_text.templates(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    seen, pages = {}, {}
    for _, url, page in rows:
        pages[url[7:9]] = pages.get(url[7:9], 0) + 1
        for digest in html_text.Page(page).hashes:
            seen[url[7:9], digest] = seen.get((url[7:9], digest), 0) + 1
    assert found == {(h, d) for (h, d), n in seen.items() if n >= 5 and (d & 3 == html_text.OTHER or n >= 0.3 * pages[h])} and len(found) > 20


def test_templates_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(html_text, "MOST_BROADCAST", -1)
    rows = [(i, "http://a/x", f"<div>menu</div><p>{i}</p>") for i in range(8)]
    out = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(r.text for r in out.collect()) == [str(i) for i in range(8)] and "n_chars" in out.columns
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def brute_neighbours(rows, k):
    out = {}
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for q in sorted({i for i, _ in good if i % 20 == 0}):
        own = min((v.tolist() for i, v in good if i == q))
        near = sorted((-float((v * np.array(own)).sum()), i) for i, v in good if i != q and len(v) == len(own))
        out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("shard", [40, 8192])
def test_factor_one_is_exact(spark, monkeypatch, shard):
    monkeypatch.setattr(neighbours, "SHARD", shard)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1 + i % 3)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, None), (2020, []), (2040, [0.0] * 6), (2060, [1.0, None] * 3), (2080, [float("nan")] * 6), (2100, [1.0, 2.0]), (2101, [2.0, 1.0]), (None, [1.0] * 6), (40, rows[40][1])]
    vectors = spark.createDataFrame([(i, v, 5) for i, v in rows], "vec_id long, embedding array<double>, score int")
    out = neighbours.search(neighbours.index(vectors), vectors.where(F.col("vec_id") % 20 == 0), factor=1.0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = brute_neighbours(rows, neighbours.K)
    assert got.keys() == expected.keys() - {q for q, v in expected.items() if not v}
    for q in got:
        assert [i for i, _ in got[q]] == [i for i, _ in expected[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in expected[q]], rtol=1e-12)


@pytest.mark.parametrize("factor", [1.0, 4.0])
def test_ties_go_to_the_least_ids(spark, monkeypatch, factor):
    """Hundreds of vectors have one inner product with the query, and many more are equal to others."""
    monkeypatch.setattr(neighbours, "SHARD", 150)
    monkeypatch.setattr(neighbours, "LEAF", 16)
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, [1.0, *rng.integers(-3, 4, 3).astype(float).tolist()]) for i in rng.permutation(np.arange(1, 601)).tolist()]
    rows += [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(601, 900)] + [(0, [1.0, 0.0, 0.0, 0.0])] * 30 + [(7, rows[3][1])] * 2
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in sorted(neighbours.search(neighbours.index(vectors), vectors.where(F.col("vec_id") % 20 == 0), factor=factor).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    expected = {q: v for q, v in brute_neighbours(rows, neighbours.K).items() if v}
    if factor == 1:
        assert got == expected
    else:
        assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in v}) / len(v) for q, v in expected.items()]) >= 0.5
        assert all(v == sorted(v, key=lambda x: (-x[1], x[0])) for v in got.values())


def test_queries_in_passes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(800)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(neighbours, "SHARD", 100)
    index = neighbours.index(vectors)
    asked = vectors.where(F.col("vec_id") % 20 == 0)
    key = lambda r: (r.query_id, r["rank"], r.vec_id)
    whole = sorted(map(key, neighbours.search(index, asked, factor=1.0).collect()))
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 9)
    monkeypatch.setattr(neighbours, "GROUP", 4)
    assert sorted(map(key, neighbours.search(index, asked, factor=1.0).collect())) == whole


def test_recall_with_the_default_factor(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v)]) for i, v in enumerate(rng.normal(size=(1500, 64)))]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(neighbours.index(vectors), vectors.where(F.col("vec_id") % 20 == 0)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    expected = brute_neighbours(rows, neighbours.K)
    assert np.mean([len(got[q] & {i for i, _ in v}) / len(v) for q, v in expected.items()]) >= 0.9
    assert neighbours.search(neighbours.index(vectors.limit(0)), vectors.limit(0)).count() == 0


def toxic_table(spark, n=900):
    rng = random.Random(9)
    bad = ["vile", "scumbag", "loathsome", "trashy"]
    rows = []
    for i in range(n):
        own = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 5))) for _ in range(30)]
        toxic = rng.random() < 0.2
        if toxic:
            own[3:5] = rng.sample(bad, 2)
        rows.append((i, " ".join(own), int(toxic), rng.random() < 0.6))
    docs = spark.createDataFrame([(i, t, "s") for i, t, *_ in rows] + [(5000, None, "s"), (None, "", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x, known in rows if known], "doc_id long, quality int, toxic int")
    return docs, labels, {i: x for i, _, x, _ in rows}


def test_toxicity(spark):
    docs, labels, truth = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    assert len(got) == len(truth) + 2 and all(0 <= s <= 1 for s in got.values()) and got[5000] == got[None] < 0.5
    held = [i for i in truth if __import__("zlib").crc32(str(i).encode()) % 5 == 0]
    right = sum((got[i] >= 0.5) == bool(truth[i]) for i in held)
    assert right / len(held) > 0.95
    # Labels of held-out rows aren't read.
    flipped = labels.withColumn("toxic", F.when(toxicity.remainder(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.fit(docs, flipped)
    assert again.weights == model.weights and again.bias == model.bias
    assert toxicity.without_toxic(docs, model).columns == docs.columns


def test_toxicity_without_labels(spark):
    docs, labels, _ = toxic_table(spark, 20)
    model = toxicity.fit(docs, labels.limit(0))
    assert toxicity.scored(docs, model).agg(F.max("score")).first()[0] < 1e-9
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_risk_stays_useful_when_clean_risk_is_negative():
    """All unlabelled rows toxic-like: the clean part is clipped, and the fit still tells the word apart."""
    toxic, rest = [np.array([0])] * 50, [np.array([0])] * 10 + [np.array([1])] * 90
    w, b = toxicity.nonnegative_fit(toxic, rest, np.ones(2), 0.3)
    assert w[0] + b > 0 > w[1] + b
