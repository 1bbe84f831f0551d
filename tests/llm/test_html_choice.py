"""Which blocks are the article: pages that must keep theirs, and the choice against a plain version of it."""

import random

import pytest

from grantscope.llm import html_text
from test_llm import LONG, naive_scores

PARTS = [f"This is full paragraph {n}, with some words, a few commas, and it goes on for quite a while so that it counts." for n in range(3)]
BODY, WHOLE = "".join(f"<p>{x}</p>" for x in PARTS), "\n\n".join(PARTS)
ONE = "One paragraph here, which is long enough, and has commas, to count as text."


@pytest.mark.parametrize("name", ["promo-content", "search-page", "widget", "social-story", "related-box", "teaser", "banner main"])
@pytest.mark.parametrize("page", ["<main><div class='{}'>{}</div></main>", "<div class='{}'>{}</div>", "<div id='{}'>{}</div><p>Short note.</p>", "<nav><a href=/>Home</a></nav><div class='{}'><div>{}</div></div><footer>(c)</footer>"])
def test_a_page_whose_only_container_has_a_listed_name_keeps_its_text(name, page):
    assert html_text.main_text(page.format(name, BODY)).removesuffix("\n\nShort note.") == WHOLE


@pytest.mark.parametrize("name", ["comments", "cookie-notice", "newsletter-signup", "ad", "main-menu", "login-box"])
def test_some_names_never_are_the_article(name):
    assert html_text.main_text(f"<div class='{name}'>{BODY}</div>") == ""
    assert html_text.main_text(f"<div class='{name}'>{BODY}</div><div>{BODY}</div>") == WHOLE


@pytest.mark.parametrize("name", ["promo-content", "widget", "related-box"])
def test_listed_names_beside_an_article_go(name):
    assert html_text.main_text(f"<div>{BODY}</div><div class='{name}'><p>{PARTS[0]}</p></div>") == WHOLE


@pytest.mark.parametrize(("attrs", "shown"), [
    ('title="a hidden gem"', True), ('class="block hidden md:block"', True), ('style="overflow: hidden ; color:red"', True), ("data-hidden=1", True), ("hidden", False), ('hidden=""', False), ("HIDDEN class=x", False),
    ("class=x hidden", False), ('style="display: none"', False), ('aria-hidden="true"', False), ("hidden=until-found", False),
])
def test_hidden_is_an_attribute(attrs, shown):
    assert html_text.main_text(f"<div><p {attrs}>{ONE}</p>{BODY}</div>") == (f"{ONE}\n\n{WHOLE}" if shown else WHOLE)


def test_a_form_that_holds_the_page_is_no_form():
    assert html_text.main_text(f"<body><form action=x><input name=a><nav>Menu</nav><div>{BODY}</div><label>Name</label><button>Go</button></form></body>") == WHOLE
    assert html_text.main_text(f"<div>{BODY}</div><form><p>Write to us, if you like, by this form.</p><select><option>x</select></form>") == WHOLE
    assert html_text.main_text("<form><p>Only a form, and little text.</p></form>") == ""


@pytest.mark.parametrize(("inside", "kept"), [
    ("<ul>" + "".join(f"<li>Item {n} of eight</li>" for n in range(8)) + "</ul>", [f"Item {n} of eight" for n in range(8)]), ("<h2>A heading</h2><ol><li>first<ol><li>inner</ol></ol>", ["A heading", "first", "inner"]),
    ("<table><tr><td>a</td><td>b</td></tr></table>", ["a", "b"]), ("<dl><dt>word</dt><dd>meaning</dd></dl>", ["word", "meaning"]), ("<ul><li><a href=1>Link one</a><li><a href=2>Link two</a></ul>", []), ("<ul class=tags><li>tag</ul>", []),
])
def test_lists_of_the_container_belong_to_it(inside, kept):
    assert html_text.main_text(f"<body><ul><li>Before</ul><div><p>{PARTS[0]}</p>{inside}</div><div><ul><li>Elsewhere</ul></div></body>") == "\n\n".join([PARTS[0], *kept])


def naive_choice(blocks):
    """The text from the definition of the choice, block by block."""
    size = lambda b: len(b.text) - b.link
    total = sum(map(size, blocks))
    blocks = [b for b in blocks if b.form == 0 or (own := sum(size(x) for x in blocks if x.form == b.form)) >= total / 2 and own >= 200]
    named = [b for b in blocks if b.weight == html_text.STRONG and not b.never]
    held = sum(map(size, named))
    if held >= 200 and any(size(b) >= 80 for b in named) and sum(size(b) for b in blocks if b.weight > html_text.STRONG) < held / 4:
        for b in named:
            b.weight = html_text.WEAK
    if not blocks:
        return ""
    scores = naive_scores(blocks)
    best = [max(s for s, x in zip(scores, blocks, strict=True) if x.path == b.path) for b in blocks]
    keep = [s > 0 and s >= max(scores) * (0.1 if any(x.inside for x in blocks if x.path == b.path and x is b) else 0.35) for s, b in zip(best, blocks, strict=True)]
    paths = {b.path for b, k in zip(blocks, keep, strict=True) if k}
    keep = [b.path in paths and b.weight > html_text.STRONG and b.link < 0.9 * len(b.text) for b in blocks]
    plain = list(keep)
    for i, b in enumerate(blocks):
        linked = sum(x.link for x in blocks if x.path == b.path) / sum(len(x.text) for x in blocks if x.path == b.path)
        before = any(plain[j] and blocks[j].holder < 0 and blocks[j].within == b.holder for j in range(i))
        keep[i] = keep[i] or b.holder >= 0 and before and b.weight == 1 and linked < 0.5
    for i in range(len(blocks) - 2, -1, -1):
        b, after = blocks[i], blocks[i + 1]
        keep[i] = keep[i] or b.heading and b.weight == 1 and keep[i + 1] and (b.parent == after.parent or b.within == after.holder)
    return "\n\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def test_the_choice_against_brute_force():
    rng = random.Random(6)
    tags = ["div", "p", "section", "article", "ul", "li", "h2", "table", "td", "form", "blockquote", "div class='share-price'", "div class=promo", "div class=comments", "a href=x", "p hidden"]
    some = 0
    for _ in range(400):
        page, open_ = "", []
        for _ in range(rng.randrange(1, 50)):
            if rng.random() < 0.45:
                tag = rng.choice(tags)
                page += f"<{tag}>"
                open_.append(tag.split()[0])
            elif open_ and rng.random() < 0.5:
                page += f"</{open_.pop(rng.randrange(-1, len(open_)))}>"
            page += rng.choice(["", " ", "word, ", "A sentence, of words. ", LONG])
        found = html_text.main_text(page)
        assert found == naive_choice(html_text.blocks_of(page))
        some += bool(found)
    assert some > 200
