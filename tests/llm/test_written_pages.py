"""Main text of pages written by hand: precision and recall of words on each; broken pages, and time on them."""

import time
from collections import Counter

import pytest

pytest.importorskip("loamgraph.llm")
from loamgraph.llm import extract
from loamgraph.llm.dom import parse

HEAD = "<html><head><title>x</title><style>p{color:red}</style></head><body>"
A = "The council met on Tuesday to discuss the new tram line, which has been planned for eleven years."
B = "Three members spoke against it, since the old bridge would have to be widened before any rail is laid."
C = "A vote was taken at half past nine, and the plan was accepted with a small majority of two."
D = "Work on the first section will begin in spring, the mayor said to reporters after the meeting."


def joined(*paragraphs):
    return " ".join(paragraphs)


PAGES = {
    "script with a slash in its source": (f"{HEAD}<nav><a href=/>Home</a></nav><article><h1>Tram line</h1><p>{A}</p><script src=/js/>window.ads = window.ads || []; push('buy');</script><p>{B}</p><p>{C}</p></article><footer>imprint</footer>", joined("Tram line", A, B, C)),
    "style and script written as if empty": (f"{HEAD}<header><p>The Daily Post</p></header><main><h1>Tram line</h1><p>{A}</p><style/>.ad {{ width: 3px }}</style><p>{B}</p><script/>track('page');</script><p>{C}</p></main>", joined("Tram line", A, B, C)),
    "inline picture that is empty": (f"{HEAD}<nav><ul><li><a href=/a>News</a><li><a href=/b>Sport</a></ul></nav><article><h1>Tram <svg width=3 /> line</h1><p>{A}</p><p>{B} <svg viewBox='0 0 1 1'/></p><p>{D}</p></article>", joined("Tram line", A, B, D)),
    "comments of markup with tags in them": (f"{HEAD}<!-- <article><p>old text of the page</p></article> --><div class=content><h1>Tram line</h1><p>{A}</p><!-- > --><p>{B}</p><!--[if IE]><p>update your browser</p><![endif]--><p>{C}</p></div><div class=footer>terms of use</div>", joined("Tram line", A, B, C)),
    "signs in attribute values": (f"{HEAD}<div id=menu><a href=/a title='a > b'>Start</a></div><div class='article-body'><h2 data-x=\"1 > 0\">Tram line</h2><p title='<b>'>{A}</p><p>{B}</p><p>If 3 < 5 and 7 > 6, the sum holds for every member.</p></div>", joined("Tram line", A, B, "If 3 < 5 and 7 > 6, the sum holds for every member.")),
    "character references": (f"{HEAD}<nav><a href=/>Home</a></nav><article><h1>Caf&eacute; &amp; tram</h1><p>{A} &#8220;At last&#x201D;, said one.</p><p>{B}</p></article>", joined("Café & tram", A, "“At last”, said one.", B)),
    "reader comments in a list": (f"{HEAD}<article><h1>Tram line</h1><p>{A}</p><p>{B}</p><p>{C}</p></article><ol class=commentlist><li class=comment><cite>Ann</cite><p>I have waited for this line since I was a child.</p><li class=comment><cite>Bob</cite><p>Too late and too dear, as ever in this town.</p></ol>", joined("Tram line", A, B, C)),
    "advert between paragraphs": (f"{HEAD}<main><article><h1>Tram line</h1><p>{A}</p><div class='ad-banner advertisement'><p>Sofas at half price until Sunday!</p></div><p>{B}</p><div class='promo sponsored'><a href=/x>Click here for loans</a></div><p>{D}</p></article></main>", joined("Tram line", A, B, D)),
    "sidebar with links and a form": (f"{HEAD}<div class=wrapper><div class=main-content><h1>Tram line</h1><p>{A}</p><p>{B}</p><p>{C}</p><p>{D}</p></div><div class=sidebar><h3>Most read</h3><ul><li><a href=/1>Ten ways to cook rice</a></li><li><a href=/2>Rain again</a></li></ul><form><label>Search</label><input name=q><button>Go</button></form></div></div>", joined("Tram line", A, B, C, D)),
    "lists, quotes and a table in the article": (f"{HEAD}<header class=top><a href=/>Post</a></header><article><h1>Tram line</h1><p>{A}</p><ul><li>North: eleven stops on the old road</li><li>South: nine stops along the river</li></ul><blockquote><p>We have talked long enough about this.</p></blockquote><p>{C}</p></article><footer><p>All rights reserved</p></footer>", joined("Tram line", A, "North: eleven stops on the old road South: nine stops along the river We have talked long enough about this.", C)),
    "nothing closed": (f"{HEAD}<nav><ul><li><a href=/a>News<li><a href=/b>Sport</ul></nav><article><h1>Tram line</h1><p>{A}<p>{B}<p>{C}<p>{D}", joined("Tram line", A, B, C, D)),
    "notice of cookies first": (f"{HEAD}<div id=cookie-consent class='notice banner'><p>We use cookies to make this site better for you.</p><button>Accept</button></div><article class=post><h1>Tram line</h1><p>{A}</p><p>{B}</p><p>{D}</p></article>", joined("Tram line", A, B, D)),
}


@pytest.fixture(scope="module")
def model():
    return extract.Extractor(extract.trained())


@pytest.mark.parametrize("name", PAGES)
def test_words(name, model):
    page, want = PAGES[name]
    got, asked = Counter(model.one(page).split()), Counter(want.split())
    both = (got & asked).total()
    assert both >= 0.95 * got.total() and both >= 0.95 * asked.total(), model.one(page)


def test_raw_elements_never_reach_the_text(model):
    for raw in ("<script src=/js/>", "<script/>", "<SCRIPT async/ >", "<style media=x/>"):
        end = "</script >" if "cript" in raw.lower() else "</style\n>"
        assert "leak" not in model.one(f"{HEAD}<article><h1>Tram line</h1><p>{A}</p>{raw}leak {{ leak }}{end}<p>{B}</p></article>")
    assert model.one(f"{HEAD}<article><h1>Tram line</h1><p>{A}</p><p>{B}</p></article><script>leak") == "\n".join(["Tram line", A, B])


@pytest.mark.parametrize("piece", ["<a ", "<a \">\"", "<video/>", "<svg/>", "<li></li>", "<a '\">", "<!--", "<p><li>", "</p", "<td><tr>", "<script ", "<center>"])
def test_time_is_linear(piece):
    began = time.time()
    parse(piece * (400_000 // (1 if piece == "<a " else len(piece))) + "</svg></center>")
    assert time.time() - began < 5


def test_many_items_below_deep_blocks():
    began = time.time()
    parse("<ul><li>" + "<center>" * 20_000 + "<li>x</li>" * 20_000)
    parse("<ul><li><div>" + "<center>" * 20_000 + "<li>x</li>" * 20_000)
    assert time.time() - began < 5
