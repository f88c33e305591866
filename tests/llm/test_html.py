"""Main text of pages against a second extractor on another parser, and against pages whose text is known."""

import random
from html.parser import HTMLParser

import pytest

from pagewright.llm import html_text

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "a good many words of prose " * 12 + "</p>"


def text_of(source):
    return html_text.joined([(block, text) for block, text, _ in html_text.Page(source).runs])


class Plain(HTMLParser):
    """Text of the article of a well-formed page, block by block, without what ``unwanted`` names."""

    inline = {"a", "b", "em", "span", "i"}

    def __init__(self, unwanted):
        super().__init__()
        self.unwanted, self.open, self.blocks = unwanted, [], [""]

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.blocks[-1] += " " if self.wanted() else ""
            return
        classes = dict(attrs).get("class", "").split()
        self.open.append((tag, tag in self.unwanted or not self.unwanted.isdisjoint(classes)))
        if tag not in self.inline:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.open.pop()
        if tag not in self.inline:
            self.blocks.append("")

    def wanted(self):
        return any(t == "article" for t, _ in self.open) and not any(bad for _, bad in self.open)

    def handle_data(self, data):
        if self.wanted():
            self.blocks[-1] += data

    def text(self):
        return "\n".join(x for x in (" ".join(b.split()) for b in self.blocks) if x)


def grown(rng, depth):
    """A piece of well-formed markup."""
    words = " ".join(rng.choice(["uno", "zwei&amp;", "tre&#233;s", "quatre", "İki", "&lt;five&gt;", "a b"]) for _ in range(rng.randint(1, 6)))
    if depth == 0 or rng.random() < 0.3:
        return words
    tag = rng.choice(["div", "p", "section", "ul", "b", "em", "span", "h2", "blockquote", "aside", "nav", "script", "style"])
    if tag in ("script", "style"):
        return f"<{tag}>if (a < b) x = '</p>';</{tag.upper()}>"
    if tag == "ul":
        return "<ul>" + "".join(f"<li>{grown(rng, 0)}</li>" for _ in range(rng.randint(1, 3))) + "</ul>"
    kind = rng.choice(["", "", "", ' class="lead has-sidebar"', ' class="x share"', ' class="sidebar"', " id=k1"])
    inner = [grown(rng, depth - 1) for _ in range(rng.randint(1, 3))] if tag not in ("p", "h2", "b", "em", "span") else [words, "<br>", words]
    return f"<{tag}{kind}>" + rng.choice(["", " ", "\n"]).join(inner) + f"</{tag}>"


def test_agrees_with_a_second_extractor():
    rng = random.Random(8)
    for _ in range(400):
        source = "<html><head><title>t</title></head><body><nav>menu</nav><article>" + "".join(grown(rng, 4) for _ in range(4)) + "</article><footer>foot</footer></body></html>"
        plain = Plain({"aside", "nav", "script", "style", "share", "sidebar", "title", "footer"})
        plain.feed(source)
        assert text_of(source) == plain.text()


@pytest.mark.parametrize("name", ["has-sidebar", "layout-with-sidebar", "no-comments", "menu-open", "newsletter-archive", "ad-free", "sidebar", "page-banner"])
def test_what_holds_the_article_stays(name):
    assert text_of(f'<title>t</title><div class="{name}"><article>{LONG}</article></div>').startswith("a good many")


@pytest.mark.parametrize("name", ["has-sidebar", "no-comments", "menu-open", "ad-free"])
def test_names_count_by_whole_words(name):
    assert text_of(f'<div class="{name}">{LONG}</div>').startswith("a good many")


@pytest.mark.parametrize("name", ["sidebar", "site-nav", "commentList", "cookie_banner", "ads top-1", "related-posts"])
def test_named_elements_go(name):
    assert text_of(f'<div>{LONG}</div><div class="{name}">gone</div><div id="{name.split()[0]}">gone</div>').count("gone") == 0


def test_pages_whose_text_is_known():
    assert text_of("<title>t</title><body><article><p>İstanbul güzel</p></article>") == "İstanbul güzel"
    assert text_of("<SCRIPT>'<p>no</p>'</ScRiPt ><p>yes") == "yes"
    assert text_of("<article>one<p style='color:red; Display : NONE'>two<p hidden>three<p aria-hidden=true>four<p>five</article>") == "one\nfive"
    # A teaser's article isn't the article of a page that is mostly something else; one beside the article isn't either.
    assert text_of(f"<div><article>More</article></div><div>{LONG}</div>").startswith("More\na good")
    assert text_of(f"<div class=sidebar><article>More</article></div><div>{LONG}</div>").startswith("a good")
    assert text_of(f"<div class=sidebar><article>More</article></div><article>{LONG}</article>").startswith("a good")
    assert text_of("<article>story<article class=comment>reader</article></article>") == "story"
    assert text_of("<form><header>top</header><main><header><h1>T</h1></header>x</main><footer>f</footer></form>") == "T\nx"
    assert text_of("<div role=main>x</div><div>y</div>") == "x"
    assert text_of("") == text_of("<p>") == text_of("<!-- a") == ""
    assert text_of("a < b &amp; c > d") == "a < b & c > d"


def rows():
    out = [(i, f"http://Big.example:80/{i}", f"<div>Welcome here</div><p>Story {i} of its own</p>") for i in range(40)]
    out += [(100 + i, f"https://u@small.example/{i}?q", f"<div>Welcome here</div><p>Story {i}</p>") for i in range(5)]
    out += [(200 + i, None, f"<div>Welcome here</div><p>Tale {i}</p>") for i in range(20)]
    return [*out, out[0], out[0], (None, None, None), (300, "::bad[", ""), (301, "http://big.example/x", "<p>" + "İ word " * 60_000 + "</p>")]


@pytest.mark.parametrize("broadcast", [html_text.BROADCAST, 0])
def test_templates_of_hosts(spark, broadcast):
    df = spark.createDataFrame(rows(), PAGES).selectExpr("*", "1 AS host", "2 AS template", "3 AS text").repartition(4)
    got = html_text.main_text(df, broadcast=broadcast).collect()
    assert len(got) == len(rows())
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[i] == f"Story {i} of its own" for i in range(40)) and sum(r["page_id"] == 0 for r in got) == 3
    assert all(text[100 + i] == f"Welcome here\nStory {i}" for i in range(5))
    assert all(text[200 + i] == f"Welcome here\nTale {i}" for i in range(20))
    assert text[None] == text[300] == "" and len(text[301]) == 7 * 60_000 - 1
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.main_text(df.where("false"), broadcast=broadcast).count() == 0
