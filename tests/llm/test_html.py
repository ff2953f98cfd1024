"""Main text of generated and odd pages."""

import random
import time

import pytest
from siteoverlap.llm import html_extract as h

WORDS = "the of and report river stone winter was it city that with a for near bridge market they people in".split()


def prose(draw, n):
    return " ".join(draw.choice(WORDS) for _ in range(n)).capitalize() + "."


@pytest.mark.parametrize("seed", range(60))
def test_article_of_generated_pages(seed):
    draw = random.Random(seed)
    parts = [prose(draw, draw.randint(1, 120)) for _ in range(draw.randint(1, 8))]
    title = prose(draw, draw.randint(2, 9))
    body = "".join(f"<p>{p}</p>" if draw.random() < 0.7 else f"<p><b>{p}<br>" for p in parts)
    inner = f"<h1>{title}</h1>{body}"
    inner += draw.choice(["", f'<aside>{prose(draw, 40)}</aside>', f'<div class="comments"><p>{prose(draw, 60)}</p></div>', f"<form>{prose(draw, 30)}<input></form>"])
    page = f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <header>{prose(draw, 30)}</header><nav><ul><li><a href="/a">{prose(draw, 3)}</a></li></ul></nav><div class="ad">{prose(draw, 50)}</div><!-- <p>{prose(draw, 50)}</p> -->
    <article>{inner}</article><div id="cookie-notice">{prose(draw, 40)}</div><footer>&copy; {prose(draw, 40)}</footer>{draw.choice(["", "</body></html>"])}"""
    assert h.main_text(page) == " ".join([title, *parts])


def test_page_without_article_element():
    draw = random.Random(4)
    a, b, short = prose(draw, 80), prose(draw, 90), "A short line"
    page = f'<div><a href="/">Home</a> <a href="/x">News</a></div><h2>Head</h2><p>{a}</p><p>{short}</p><p>{b}</p><div><a href="/y">{prose(draw, 40)}</a></div><p>Imprint</p>'
    assert h.main_text(page) == f"Head {a} {short} {b}"


@pytest.mark.parametrize("page", ["", "<", "<p", "</", "<p class='", '<p class="x>text', "<!-- open", "<script>never closed", "&#xZZ; &amp", "<a><b></a></b>", "plain text only", "<" * 500, '<a "' * 300])
def test_broken_markup(page):
    assert isinstance(h.main_text(page), str)


def test_references_and_white_space():
    assert h.main_text("<article><p>a&amp;b&#x41;&eacute;  c\n\td<br>e <b>f</b>g</p></article>") == "a&bAé c d e fg"


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x</p></article>", "clash"), (2, None, None, ""), (3, "", "", "")], "page_id long, url string, html string, text string")
    assert sorted(map(tuple, h.extract(pages, ("url",)).collect())) == [(1, "u", "x"), (2, None, ""), (3, "", "")]
    assert h.extract(pages.where("false"), ("url",)).collect() == []


def plain_second_pass(found, parents, labels):
    """The rule of the docstring, by looking at all blocks for each block."""
    def chain(c):
        return [c] if c == 0 else [c, *chain(parents[c])]

    keep = []
    for k, b in enumerate(found):
        if labels[k] is not None:
            keep.append(labels[k])
            continue
        for c in chain(b.container):
            own = [m for m, x in enumerate(found) if c in chain(x.container) and labels[m] is not None]
            if own or c == 0:
                break
        # of all decided blocks of the page the nearest counts, if it is in the container
        every = [m for m in range(len(found)) if labels[m] is not None]
        x = next((labels[m] for m in reversed(every) if m < k and m in own), None)
        y = next((labels[m] for m in every if m > k and m in own), None)
        if c == 0:
            x, y = bool(x), bool(y)
        direct = sorted((abs(m - k), m) for m in every if found[m].container == b.container)
        keep.append(bool(y if x is None else x) if x is None or y is None or x == y else labels[direct[0][1]] if direct else b.heading and y)
    return keep


@pytest.mark.parametrize("seed", range(120))
def test_second_pass_equals_plain_version(seed):
    draw = random.Random(seed)
    parents = [0] + [draw.randrange(k) for k in range(1, 9)]

    def build(c):
        inner = [f"<p>{prose(draw, draw.choice([1, 2, 5, 60]))}</p>" for _ in range(draw.randint(0, 3))]
        inner += [f"<div>{build(x)}</div>" for x in range(1, 9) if parents[x] == c]
        inner += draw.choice([[], ['<ul><li><a href="/">link here</a></li></ul>'], [f"<h2>{prose(draw, 2)}</h2>"]])
        draw.shuffle(inner)
        return "".join(inner)

    found, up = h.blocks(build(0))
    labels = [h.first_pass(b) for b in found]
    if True in labels:
        assert h.second_pass(found, up, labels) == plain_second_pass(found, up, labels)


def generated(draw):
    body = "".join(f"<p>{prose(draw, n)}</p>" for n in [*draw.choices([1, 3, 8, 30, 90], k=draw.randint(2, 8)), 60])
    item = lambda: f'<li><a href="/{draw.random()}">{prose(draw, 2)}</a></li>'
    return f"""<html><body><nav><ul>{item()}{item()}{item()}</ul></nav><div class="ad">{prose(draw, 9)}</div><article><h1>{prose(draw, 6)}</h1>{body}</article>
    <footer>&copy; host &middot; {prose(draw, 8)}</footer></body></html>"""


@pytest.mark.parametrize("seed", range(40))
def test_rules_carry_pages_without_names(seed, monkeypatch):
    page = generated(random.Random(seed))
    full = h.main_text(page)
    assert full
    for name in ("NEVER", "MARKS", "ROLES"):
        monkeypatch.setattr(h, name, frozenset())
    for bare in (page, page.replace("article>", "div>"), page.replace("<article>", "").replace("</article>", ""), page.replace('class="ad"', "").replace("nav>", "div>").replace("footer>", "div>")):
        assert h.main_text(bare) == full


LONG = ['<a "' * 60000, "<a " * 60000, "<b>" * 40000 + "</i>" * 40000, '<a ">"' * 40000, "<div>x" * 40000, "<script" * 40000, "<svg>" * 20000, "<i><div></i>" * 40000, "<!-- " * 60000, "<![a" * 60000 + ">", "<p>x" * 100_000, "<td>" * 60000, "&" * 200_000]


@pytest.mark.parametrize("page", LONG)
def test_very_long_pages_take_seconds(page):
    began = time.time()
    h.main_text(page)
    assert time.time() - began < 15
