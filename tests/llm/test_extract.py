import math

import pytest

from coverlace.llm import extract
from coverlace.llm.extract import main_text

LONG = "A sentence with some length, and a comma. Another one follows here, with more words than a menu has."


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_article_with_everything_around():
    html = page(
        f"""<header><a href="/">Site</a></header><nav><ul><li><a href=a>Menu, one.</a></li></ul></nav>
        <div class="ad">Buy this, now. It is cheap, good and here.</div>
        <article><h1>Title &amp; more</h1><p>{LONG}</p><p>Short.</p><ul><li>One</li><li>Two</li></ul>
        <form><label>Name</label><input></form><blockquote>Quoted words.</blockquote>
        <script>var t="</p>";</script><style>p{{}}</style><p>{LONG} <b>bold</b>face</p>
        <section class="comments"><p>{LONG}</p></section></article>
        <aside><p>{LONG}</p></aside><div id="cookie-notice">{LONG}</div><footer>&copy; me</footer>"""
    )
    assert main_text(html).split("\n\n") == ["Title & more", LONG, "Short.", "One", "Two", "Quoted words.", f"{LONG} boldface"]


def test_no_article_element():
    html = page(f'<div><a href=1>one</a> <a href=2>two</a></div><div id=x><h2>Head</h2><p>{LONG}</p><p>{LONG}<p>Third,\n\t open.</div><div><a href=3>three</a></div>')
    assert main_text(html).split("\n\n") == ["Head", LONG, LONG, "Third, open."]


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<!-- only", "<script>x", "<p", "<nav>menu</nav>"])
def test_pages_without_text(html):
    assert main_text(html) == "" or html == "<p"


def test_entities_spaces_and_unclosed_tags():
    assert main_text(page(f"<article><p><b>{LONG}<br>x&nbsp;y&#233;&lt;<p>{LONG}</article>")).split("\n\n") == [f"{LONG} x yé<", LONG]


def test_very_long_page():
    assert main_text(page("<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>")).count("\n\n") == 19_999


def test_opening_of_a_long_article_stays():
    body = "".join(f"<p>{LONG}</p>" for _ in range(30))
    assert main_text(page(f"<article><div><p>The lead, with a comma, is here. {LONG}</p></div><div>{body}</div></article>")).split("\n\n")[0].startswith("The lead")
    assert main_text(page(f"<article><header><h1>Title</h1></header><div class=content>{body}</div></article>")).split("\n\n")[0] == "Title"


def test_short_blocks_stay_where_the_body_holds_the_text():
    html = page(f"<h1>Title</h1><p>{LONG}</p><h2>Second</h2><p>{LONG}</p><ul><li>One</li></ul><ul><li><a href=a>Link</a></li></ul><p>{LONG}</p><div>tail</div>")
    assert main_text(html).split("\n\n") == ["Title", LONG, "Second", LONG, "One", LONG]


BODY = "".join(f"<p>{LONG} Paragraph {i} says a little more, and ends.</p>" for i in range(8))
BLOCKS = [f"{LONG} Paragraph {i} says a little more, and ends." for i in range(8)]


@pytest.mark.parametrize(
    "body",
    [
        f"<form>{BODY}</form>",
        f'<article><div class="header-content">{BODY}</div></article>',
        f'<article>{BODY[: len(BODY) // 2]}<section class="related-work">{BODY[len(BODY) // 2 :]}</section></article>',
        f'<div class="comments">{BODY}</div>',
        f'<div class=wrap><div><a href=1>One</a> <a href=2>Two</a></div><div>{BODY}</div><div>Cheap, good, here.</div></div>',
        f"<table><tr><td><a href=1>One</a><td>{BODY}<td>Short words</table>",
    ],
)
def test_names_alone_decide_nothing(body):
    assert main_text(page(body)).split("\n\n") == BLOCKS


def test_unlabelled_thread_after_the_article():
    thread = "".join(f"<div><b>user{i}</b><p>I liked this one, thanks a lot. Number {i}!</p></div>" for i in range(12))
    assert main_text(page(f"<article>{BODY}</article><div>{thread}</div>")).split("\n\n") == BLOCKS
    long = "".join(f"<p>{LONG * 3} Paragraph {i}.</p>" for i in range(5))
    assert "user3" not in main_text(page(f"<div class=post>{long}</div><div class=thread>{thread}</div>"))


def test_unnamed_advert_and_linked_heading():
    got = main_text(page(f"<div>Buy this, now. It is cheap.</div><article><h1><a href=x>Title</a></h1>{BODY}<ul><li><a href=a>Next</a></li></ul></article>"))
    assert got.split("\n\n") == ["Title", *BLOCKS]


def plain_ratios(nodes, paths):
    """The ratios as the module's text says, path by path."""
    ratio, order = {}, list(dict.fromkeys(paths))
    of = {p: [x for x, q in zip(nodes, paths) if q == p] for p in order}
    text = {p: sum(len(x.text.strip()) for x in of[p]) for p in order}
    for p in order:
        blocks = len({x.block for x in of[p]})
        marks = sum(c in ".,;:!?…。，、；：！？" for x in of[p] for c in x.text)
        ratio[p] = text[p] / blocks * math.log2(2 + marks / blocks)
    out = {}
    for p in order:
        x = of[p][0]
        box = [q for q in order if of[q][0].box == x.box]
        k = box.index(p)
        smooth = 0.25 * ratio[box[max(0, k - 1)]] + 0.5 * ratio[p] + 0.25 * ratio[box[min(k + 1, len(box) - 1)]]
        share = lambda q: sum(len(y.text.strip()) for y in of[q] if y.linked and y.tag not in extract.HEADINGS) / max(1, text[q])
        mean = lambda some: sum(text[q] * ratio[q] for q in some) / max(1, sum(text[q] for q in some))
        held = mean(box)
        article = [q for q in order if x.article and of[q][0].article == x.article and share(q) < 1 and text[q] and of[q][0].weight >= 1]
        if article:
            held = max(held, mean(article) / 2)
            smooth = max(smooth, held / 2)
        out[p] = smooth**0.25 * held**0.75 * (1 - share(p)) * x.weight
    return out


def test_ratios_equal_plain_ones():
    html = page(f"<nav>menu</nav><div class=ad>Buy.</div><article><header><h1>Title</h1></header>{BODY}<ul><li>One<li><a href=a>Two</a></ul><div class=comments><p>Me, too.</p></div></article><div><p>Short <a href=b>link</a>, here</p></div>")
    nodes = extract.text_nodes(html)
    paths = extract.leaf_paths(nodes)
    assert extract.path_ratios(nodes, paths) == pytest.approx(plain_ratios(nodes, paths))
    fused = plain_ratios(nodes, paths)
    assert extract.content_paths(nodes, paths) == {p for p, f in fused.items() if f >= 0.3 * max(fused.values()) and f > 0}


def test_the_threshold_selects(monkeypatch):
    html = page(f"<div>Buy this, now.</div><div class=x>{BODY}</div><div class=y><p>Small talk.</p></div>")
    assert main_text(html).split("\n\n") == BLOCKS
    monkeypatch.setattr(extract.content_paths, "__defaults__", (0.0,))
    assert main_text(html).split("\n\n") == ["Buy this, now.", *BLOCKS, "Small talk."]


def test_pages_as_a_table(spark):
    rows = [(1, "u", page(f"<article>{BODY}</article>"), "x"), (1, "u", page(f"<article>{BODY}</article>"), "x"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract.main_texts(pages).collect()
    assert sorted((r.page_id is None, r.text, r.n_chars) for r in got) == [(False, "\n\n".join(BLOCKS), len("\n\n".join(BLOCKS)))] * 2 + [(True, "", 0)]
    assert extract.main_texts(pages.limit(0)).count() == 0
