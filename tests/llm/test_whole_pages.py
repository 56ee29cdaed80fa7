"""Pages whose markup must not swallow their text."""

from html.parser import HTMLParser

import pytest

from spanlab.llm import html_text

BODY = "<h1>Head</h1><p>The long body of the page with words in it.</p><p>More of the body of the page, on and on.</p>"
TEXT = "Head\nThe long body of the page with words in it.\nMore of the body of the page, on and on."


@pytest.mark.parametrize("before", ["<svg class='i' viewBox=\"0 0 1 1\"/>", "<math />", "<object-view>", "<title-bar></title-bar>", "<template-x>", "<svg><path d='M0 0'/></svg>", "<script>var a = '<svg>';</script>"])
def test_raw_elements_end_where_they_end(before):
    assert html_text.main_text(f"<body>{before}<article>{BODY}</article></body>") == TEXT


WRAPPED = [
    f"<form id=aspnetForm>{BODY}</form>",
    f"<form><nav><a href=x>Home</a></nav><article>{BODY}</article><footer>us</footer></form>",
    f"<div class='content with-sidebar'>{BODY}</div>",
    f"<div id='page' class='has-header'><main>{BODY}</main></div>",
    f"<section class='related-work'>{BODY}</section>",
    f"<article><div class='article-header'><h1>Head</h1></div>{BODY[13:]}</article>",
    f"<div class='widget'><div class='sidebar'>{BODY}</div></div>",
    f"<header><article>{BODY}</article></header>",
    f"<article><div class='widget'>{BODY}</div></article>",
    f"<div class='comments'>{BODY}</div>",
    # and what stays out
    f"<article>{BODY}</article><div class='sidebar'>{'A long text beside the article. ' * 20}</div>",
    f"<article>{BODY}<div class='comments'><p>{'A long comment of a reader. ' * 20}</p></div></article>",
    f"<div class='site-header'>Site</div><div>{BODY}</div><div class='cookie-banner'>We use cookies.</div><footer>{'Terms. ' * 90}</footer>",
    f"<main>{BODY}</main><aside><article><p>A teaser.</p></article></aside>",
]


@pytest.mark.parametrize("page", WRAPPED)
def test_wrappers_keep_the_text_they_hold(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == TEXT


LONG = "A paragraph of the page with quite a number of words in it, on and on."
LINK = "<a href=x>Home</a>"
SPREAD = {
    f"<article><h2>One</h2><p>{LONG}</p></article><article><h2>Two</h2><p>{LONG} 2</p></article>": f"One\n{LONG}\nTwo\n{LONG} 2",
    f"<article><h2>One</h2><p>{LONG}</p></article>" + f"<p>{LINK}</p>" * 4 + f"<article><h2>Two</h2><p>{LONG} 2</p></article>": f"One\n{LONG}\nTwo\n{LONG} 2",
    f"<div>{LINK}</div><p>{LONG} before</p><article><h2>One</h2><p>{LONG}</p><p>{LONG}</p></article><p>{LONG} after</p><div>(c) us</div>": f"{LONG} before\nOne\n{LONG}\n{LONG}\n{LONG} after",
    f"<div>{LINK}</div><p>{LONG}</p><p>See <a href=y>the other page about all of this</a>.</p><p>{LONG}</p><div>{LINK}</div>": f"{LONG}\nSee the other page about all of this.\n{LONG}",
    f"<p><a href=y>{LONG}</a> {LONG[:40]}</p><p>{LONG}</p>": f"{LONG} {LONG[:40]}\n{LONG}",
    # and what stays out
    f"<div>{LINK}</div><div>My site</div><article><h2>One</h2><p>{LONG}</p><p>{LONG}</p></article><div>(c) us</div>": f"One\n{LONG}\n{LONG}",
}


@pytest.mark.parametrize("page", SPREAD)
def test_text_between_surge_and_dive_is_kept(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == SPREAD[page]


LIST = "".join(f"<li><a href=/{k}>Another story of the site, number {k}</a></li>" for k in range(5))
MENUS = [
    f"<article><h1>Head</h1><p>{LONG}</p><ul>{LIST}</ul><p>{LONG}</p></article>",
    f"<article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><ul>{LIST}</ul></article>",
    f"<ul>{LIST}</ul><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><ul>{LIST}</ul><p>(c)</p>",
    f"<h1>Head</h1><p>{LONG}</p><ul>{LIST}</ul><p>{LONG}</p>",
]


@pytest.mark.parametrize("page", MENUS)
def test_surge_and_dive_decide(page, monkeypatch):
    """Lists of links that nothing marks go by the distribution alone, with an article and without."""
    page = f"<html><body>{page}</body></html>"
    assert html_text.main_text(page) == f"Head\n{LONG}\n{LONG}"
    monkeypatch.setattr(html_text, "runs", lambda weight, *_: [[(0, len(weight))]])
    assert html_text.main_text(page) != f"Head\n{LONG}\n{LONG}"


@pytest.mark.parametrize("name", ["post-header", "entry-header", "side-by-side", "headers", "admission", "navy-blue", "share-price"])
def test_only_whole_hints_count(name):
    assert html_text.main_text(f"<article><div class='{name}'><h1>Head</h1></div>{BODY[13:]}</article>") == TEXT


NAMED = "comment-body comment-content comment-respond user-comment discussion cookie-consent-banner gdpr-overlay sidebar-inner wp-sidebar google-ad advert-wrap page-footer-inner newsletter-signup notification author-bio recommended trending related site-info".split()


@pytest.mark.parametrize("name", NAMED)
def test_usual_names_are_left_out(name):
    aside = f"<div class='{name}'><p>{LONG}</p></div>"
    for page in (f"<article>{BODY}</article>{aside}", f"<article>{BODY}{aside}</article>", f"<div>{BODY}</div>{aside}"):
        assert html_text.main_text(f"<html><body>{page}</body></html>") == TEXT


def test_deep_and_long_pages_take_linear_time():
    import time

    n = 40_000
    for page in ("<i>" * n + "</b>" * n, "<div class='sidebar'>" * n + "x<br>" * n, "<i>" * n + "x<br>" * n + "</i>" * n, "<article>" * n + "x" + "</article>" * n, "<p>a " * n, "<a '" * n, "<!--" * n):
        start = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - start < 6


def plainly(weight, level, least, loose, window=3):
    """Lines in a run, each found by looking at the whole page anew."""
    seen = [i for i, w in enumerate(weight) if w >= 0]
    w = [weight[i] for i in seen]
    ahead = lambda k: sum(w[k : k + window])
    state, spans = None, []
    for k in range(len(w) + 1):
        if state is None and k < len(w) and ahead(k) > level:
            state = k
        elif state is not None and (k == len(w) or ahead(k) == 0):
            carrying = [j for j in range(state, k) if w[j] > least]
            if carrying:
                spans.append((min(carrying), max(carrying)))
            state = None
    inside = {j for a, b in spans for j in range(a, b + 1)}
    for a, b in spans:
        for step, j in ((-1, a - 1), (1, b + 1)):
            while 0 <= j < len(w) and j not in inside and loose[seen[j]]:
                inside.add(j)
                j += step
    return {seen[j] for j in inside}


def test_runs_match_a_plain_search():
    import random

    rng = random.Random(3)
    for _ in range(500):
        weight = [rng.choice([0, 0, 0, 5, 40, 200, -1]) for _ in range(rng.randrange(25))]
        loose = [rng.random() < 0.5 for _ in weight]
        level, least = rng.choice([10, 60]), rng.choice([3, 20])
        found = html_text.runs(weight, level, least, loose)
        lines = [i for run in found for a, b in run for i in range(a, b)]
        assert len(lines) == len(set(lines)) and set(lines) == plainly(weight, level, least, loose)


class Contract(HTMLParser):
    """The contract restated for the tables' pages: blocks of the article, adverts and menus left out."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.blocks, self.parts, self.inside, self.out = [], [], False, []
        self.feed(page or "")
        self.close()
        self.flush()

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.blocks += [text] if text else []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "i", "a", "em", "strong", "span", "br"):
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag == "article":
            self.inside = True
        if tag in ("nav", "aside", "form", "footer", "script", "style") or dict(attrs).get("class") in ("ad", "comments"):
            self.out.append(tag)

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "em", "strong", "span"):
            self.flush()
        if tag == "article":
            self.inside = False
        if self.out and self.out[-1] == tag:
            self.out.pop()

    def handle_data(self, data):
        if self.inside and not self.out:
            self.parts.append(data)


def test_the_query_meets_the_contract(spark, sf_dir):
    from spanlab.llm.queries import op2_html_text

    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op2_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == "\n".join(Contract(pages[r.page_id].html).blocks) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
