"""Extraction, toxicity and quality: fixtures with known answers, held-out accuracy, odd inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("loamgraph.llm")
from loamgraph.llm import extract, quality, toxicity
from loamgraph.llm.dom import parse
from loamgraph.llm.pagemaker import MARK, Maker

PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href='/'>home</a></li><li><a href='/n'>news page</a></li></ul></nav><div class='cookie-notice'>We use cookies here.</div><article><h1>A &amp; B</h1><p>First   line\n of text.<p><b>Second <i>line</b> &eacute;t&#233;.<br></article><section class='comments'><div class='comment'>I disagree.</div></section><aside class='sidebar'><p>Read more</p></aside><form><input name=q><button>go</button></form><footer>&copy; us"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, kept string")


def test_extract_article_only(spark):
    got = {r.page_id: r for r in extract.main_text(pages(spark, [(1, "u", PAGE, "x", "y"), (2, None, None, None, None), (3, "v", "", "", ""), (3, "v", "", "", ""), (4, "w", "<" * 500 + "<div>" * 1500, "", "")])).collect()}
    assert got[1].text == "A & B\nFirst line of text.\nSecond line été."
    assert got[1].n_chars == len(got[1].text)
    assert got[2].text == "" and got[2].n_chars == 0 and got[3].text == ""
    assert 4 in got


WRITTEN = [
    ("""<body><div id="masthead"><h1>The Daily Heron</h1></div><div class="topnav"><a href=/a>World</a> <a href=/b>Sport</a></div>
<div class="post-content"><h1>Rivers rise</h1><p>The river rose by two metres on Monday, and the lower town was closed to traffic until the evening.</p>
<div class="ad">Buy new boots now!</div><p>Officials said that &quot;nobody was hurt&quot; and that the bridges would be checked again on Tuesday.</p>
<ul><li>North bridge: open</li><li>South bridge: closed<ul><li>until Friday, the council said</li></ul></li></ul>
<p>Rain is expected to end during the night, according to the weather service.</p>
<section class="comments"><h3>2 comments</h3><div class="comment"><p>My cellar is full of water, thanks for nothing.</p></div><div class="comment"><p>First!</p></div></section></div>
<div class="footer">&copy; The Daily Heron, all rights reserved</div>""",
     "Rivers rise The river rose by two metres on Monday, and the lower town was closed to traffic until the evening. Officials said that \"nobody was hurt\" and that the bridges would be checked again on Tuesday. North bridge: open South bridge: closed until Friday, the council said Rain is expected to end during the night, according to the weather service."),
    ("""<header class="site-header"><p>Notes on bread</p></header><nav><ul><li><a href=/1>Home</a><li><a href=/2>About me</a></ul></nav><main><article>
<h2>Sourdough in four days</h2><p>Mix flour and water, and wait. On the second day the jar smells of apples; on the third it doubles.</p>
<aside class="related"><p>See also: rye for beginners</p></aside><h3>What you need</h3><ol><li>500 g of flour</li><li>350 g of water</li></ol>
<blockquote><p>Bread is patience with a crust, my grandmother used to say.</p></blockquote>
<p>Bake at 240 degrees for forty minutes and let the loaf cool before you cut it.</p></article></main>
<form id="subscribe"><label>Your mail</label><input name=m><button>Subscribe</button></form><div class="cookie-notice"><p>This site uses cookies to count its visitors.</p></div><footer>Imprint</footer>""",
     "Sourdough in four days Mix flour and water, and wait. On the second day the jar smells of apples; on the third it doubles. What you need 500 g of flour 350 g of water Bread is patience with a crust, my grandmother used to say. Bake at 240 degrees for forty minutes and let the loaf cool before you cut it."),
    ("""<table><tr><td class="menu"><a href=/x>Index</a><br><a href=/y>Archive</a></td><td class="text"><h1>On the harbour</h1><p>The cranes stand still on Sundays. A ferry crosses twice an hour, and children count the jellyfish.
<p>In the evening the fish market opens; the catch is sold by the box, quickly and without many words.<div class="sponsored">Loans at 2 %</div><p>Then the lamps go on, one after the other, and the water turns black.</td></tr></table>
<div class="comment-thread"><div class="comment"><b>Jo</b><p>Lovely, I was there last year and it was just like that.</p></div></div>""",
     "On the harbour The cranes stand still on Sundays. A ferry crosses twice an hour, and children count the jellyfish. In the evening the fish market opens; the catch is sold by the box, quickly and without many words. Then the lamps go on, one after the other, and the water turns black."),
]


def test_extract_written_pages():
    """Words of pages written by hand, with comments inside the article, nested lists and adverts between paragraphs."""
    model = extract.Extractor(extract.trained())
    both = made = asked = 0
    for page, want in WRITTEN:
        a, b = Counter(model.one(page).split()), Counter(want.split())
        both, made, asked = both + (a & b).total(), made + a.total(), asked + b.total()
    assert both >= 0.95 * made and both >= 0.95 * asked


def test_extract_whatever_depth_and_siblings():
    model = extract.Extractor(extract.trained())
    items = "".join(f"<p>This is sentence number {k} of the long article, and it goes on.</p>" for k in range(300))
    page = lambda n: "<nav><a href=/>home</a></nav>" + "<div>" * n + f"<article><h1>Title of it</h1>{items}</article>" + "</div>" * n + "<footer>end of the site</footer>"
    assert [len(model.one(page(n)).split("\n")) for n in (0, 900)] == [301, 301]
    nodes = parse(page(900))
    assert max(x.depth for x in nodes) > 900
    whole = extract.Columns(nodes).rows(0, len(nodes), model.model.place)
    assert np.array_equal(whole, np.concatenate([extract.Columns(nodes).rows(k, min(k + 7, len(nodes)), model.model.place) for k in range(0, len(nodes), 7)]))


def test_extract_empty_table(spark):
    assert extract.main_text(pages(spark, [])).count() == 0


def test_extract_generated_pages():
    model = extract.Extractor(extract.trained())
    right = 0
    for k in range(60):
        page = Maker(77_000_000 + k).page()
        want = "\n".join(n.parts.replace(MARK, "") for n in parse(page) if MARK in n.parts)
        right += model.one(page.replace(MARK, "")) == want
    assert right >= 42


def test_decoding_keeps_no_node_under_a_dropped_one():
    r = np.random.default_rng(1)
    for k in range(20):
        nodes = parse(Maker(k).page())
        kept = extract.decode(nodes, r.normal(0, 3, len(nodes)))
        assert all(kept[n.parent] for n, on in zip(nodes[1:], kept[1:], strict=True) if on)


def texts(n, seed=0):
    r = random.Random(seed)
    pool = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    for _ in range(n):
        yield [r.choice(pool) for _ in range(r.randint(5, 200))]


def labelled(kind):
    r, docs, labels = random.Random(4), [], []
    for k, words in enumerate(texts(900)):
        y = r.random() < 0.3
        if kind == "toxic" and y:
            words[r.randrange(len(words))] = r.choice(["Nitwit,", "blockhead", "dunce!"])
        if kind == "quality" and not y:
            words = r.choice([[w.upper() + "!!" for w in words], [w for w in words[:8] for _ in range(9)], [w + " |" for w in words]])
        docs.append((k, " ".join(words)))
        labels.append((k, int(y)))
    return docs, labels


@pytest.mark.parametrize(("model", "kind", "cut"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_held_out_accuracy(spark, model, kind, cut):
    docs, labels = labelled(kind)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, f"doc_id long, {kind} int")
    got = model.score(d, model.train(d, lab)).collect()
    y = dict(labels)
    out = [r for r in got if r.held_out]
    assert {r.doc_id for r in out} == {k for k, _ in docs if zlib.crc32(str(k).encode()) % 5 == 0}
    assert all(r.predicted == int(r.score >= cut) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == y[r.doc_id] for r in out) / len(out) > 0.97


@pytest.mark.parametrize(("model", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_odd_inputs(spark, model, kind):
    docs, labels = labelled(kind)
    lab = spark.createDataFrame(labels, f"doc_id long, {kind} int")
    odd = [(1, None, "a"), (2, "", "b"), (None, "word", None), (3, "the same", "c"), (3, "the same", "c"), (4, "long " * 200_000, "d"), (5, "\x00\x1f é漢", "")]
    d = spark.createDataFrame(odd, "doc_id long, text string, score string")
    m = model.train(spark.createDataFrame(docs, "doc_id long, text string"), lab)
    got = model.score(d, m).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert model.clean(d, m).columns == d.columns
    none = model.train(d, lab.where("false"))
    assert all(r.score < 1e-6 for r in model.score(d, none).collect())
    assert model.score(d.where("false"), m).count() == 0


def test_factor_pairs_learn_a_combination():
    """Neither word alone says anything; both together do."""
    r = random.Random(9)
    found, y = [], []
    for _ in range(4000):
        a, b = r.random() < 0.5, r.random() < 0.5
        found.append(toxicity.terms(" ".join(["base", *(["alpha"] if a else []), *(["beta"] if b else [])])))
        y.append(int(a and b))
    score = toxicity.fit(found, np.array(y)).scorer()
    assert score(["base alpha beta"])[0] > 0.8 > 0.3 > max(score(["base alpha", "base beta", "base"]))


def test_factor_pairs_learn_an_exclusive_or():
    """Each word by itself says nothing; one without the other does."""
    r = random.Random(10)
    found, y = [], []
    for _ in range(4000):
        a, b = r.random() < 0.5, r.random() < 0.5
        noise = [f"n{r.randrange(200)}" for _ in range(5)]
        found.append(toxicity.terms(" ".join(["base", *(["insult"] if a else []), *(["group"] if b else []), *noise])))
        y.append(int(a != b))
    score = toxicity.fit(found, np.array(y)).scorer()
    assert min(score(["base insult", "base group n7"])) > 0.8 and max(score(["base insult group", "base n3"])) < 0.3


def test_scores_are_the_plain_sum_over_pairs():
    r = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    inputs = np.unique(np.concatenate([toxicity.terms(w) for w in words[:40]]))
    m = toxicity.Machine(inputs, 0.3, r.normal(0, 1, len(inputs)), r.normal(0, 0.5, (len(inputs), toxicity.FACTORS)))
    for _ in range(50):
        text = " ".join(r.choice(words, r.integers(0, 30)))
        at = [i for i, x in enumerate(inputs) if x in set(toxicity.terms(text).tolist())]
        z = m.w0 + sum(m.w[i] for i in at) + sum(m.v[i] @ m.v[k] for n, i in enumerate(at) for k in at[:n])
        assert abs(m.scorer()([text])[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_margins_are_the_plain_weighted_sum():
    """Margins from raw n-grams, one by one, and the gap between the hinge loss and its dual."""
    docs, labels = labelled("quality")
    found, y = [quality.terms(t) for _, t in docs[:400]], np.array([v for _, v in labels[:400]])
    m = quality.fit(found, y)
    at = {int(g): k for k, g in enumerate(m.grams)}
    for x, margin in zip(found[:60], m.margins(found[:60]), strict=True):
        mine = [at[int(g)] for g in x if int(g) in at]
        norm = np.sqrt(sum(m.ratio[k] ** 2 for k in mine)) or 1.0
        assert abs(margin - m.bias - sum(m.weight[k] for k in mine) / norm) < 1e-9
    p = [(1 + sum(int(g) in x for x in sets)) / (2 + len(sets)) for sets in ([set(f.tolist()) for f, v in zip(found, y, strict=True) if v == k] for k in (1, 0)) for g in m.grams[:5]]
    assert np.allclose(m.ratio[:5], np.log(np.array(p[:5]) / np.array(p[5:])))


def test_dual_coordinate_descent_ends_near_the_least_loss():
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(30, 6, replace=False)) for _ in range(200)]
    y = np.where([5 in x or 7 in x for x in rows], 1, -1)
    values = np.abs(r.normal(1, 0.2, 30))
    w = quality.descend(rows, y, 30, values)
    scaled = [values[x] / np.sqrt((values[x] ** 2).sum()) for x in rows]
    top = np.where(y > 0, quality.COST * 200 / (2 * (y > 0).sum()), quality.COST * 200 / (2 * (y < 0).sum()))
    hinge = lambda v: 0.5 * v @ v + sum(t * max(0.0, 1 - k * (v[x] @ s + v[30])) for t, k, x, s in zip(top, y, rows, scaled, strict=True))
    assert all(hinge(w) <= 1.02 * hinge(w + r.normal(0, 0.02, 31)) for _ in range(200))


@pytest.mark.parametrize(("model", "kind"), [(toxicity, "toxic"), (quality, "quality")])
def test_fit_ignores_partitions_and_repeats(spark, model, kind):
    """Rows in another order and partitioning give the same scores; a repeated id is one row of the sample."""
    docs, labels = labelled(kind)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, f"doc_id long, {kind} int")
    again = spark.createDataFrame(docs[::-1] + docs[:1] * 300, "doc_id long, text string").repartition(7, "text")
    scores = lambda m: [r.score for r in model.score(d, m).orderBy("doc_id").collect()]
    assert scores(model.train(d, lab, 400)) == scores(model.train(again, lab, 400))
