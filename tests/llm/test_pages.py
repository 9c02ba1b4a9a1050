"""Main text of pages whose article lies in several subtrees, or that mark none."""

import math
import random
import time
from html.parser import HTMLParser

import pytest

from strandline.llm.html_density import Page, main_text

WORDS = "these are some words of a paragraph that is long enough to be read as text"
PARAGRAPHS = ["".join(f"<p>{WORDS} {k}{i}</p>" for i in range(5)) for k in "ab"]
LINES = ["\n".join(f"{WORDS} {k}{i}" for i in range(5)) for k in "ab"]
LINKS = "<ul>" + "".join(f"<li><a href=x>source number {i}</a></li>" for i in range(4)) + "</ul>"
CASES = {
    "siblings": (f"<body><div>{PARAGRAPHS[0]}</div><div>{PARAGRAPHS[1]}</div></body>", "\n".join(LINES)),
    "no body": (f"<div>{PARAGRAPHS[0]}</div><div>{PARAGRAPHS[1]}</div>", "\n".join(LINES)),
    "title": (f"<body><h1>Title</h1><div>{PARAGRAPHS[0]}</div></body>", f"Title\n{LINES[0]}"),
    "title beside the article": (f"<body><h1>Title</h1><article>{PARAGRAPHS[0]}</article></body>", f"Title\n{LINES[0]}"),
    "two articles": (f"<body><article>{PARAGRAPHS[0]}</article><article>{PARAGRAPHS[1]}</article></body>", "\n".join(LINES)),
    "links of the article": (f"<body><article>{PARAGRAPHS[0]}{LINKS}</article></body>", LINES[0] + "".join(f"\nsource number {i}" for i in range(4))),
    "more links than text": (f"<body>{LINKS * 30}<div>{PARAGRAPHS[0]}</div></body>", LINES[0]),
    "links beside it": (f"<body><div>{PARAGRAPHS[0]}</div><h2>More</h2>{LINKS}<div>{PARAGRAPHS[1]}</div><nav>menu</nav></body>", None),
}


@pytest.mark.parametrize("name", CASES)
def test_articles_in_several_subtrees(name):
    source, wanted = CASES[name]
    found = main_text(source)
    if wanted is None:
        assert all(line in found.split("\n") for lines in LINES for line in lines.split("\n")) and "source number" not in found and "menu" not in found
    else:
        assert found == wanted


P = f"<p>{WORDS}</p>"
MARKUP = {
    "values of other attributes": ("<article><p title='The hidden valley'>one two</p><p data-id='comment-5'>three</p></article>", "one two\nthree"),
    "self-closed drawings": (f"<article><svg class='i'/><math/><p>{WORDS}</p></article>", WORDS),
    "custom elements": (f"<title-bar>x</title-bar><article><style-guide>{P}</style-guide></article>", WORDS),
    "compound names of text": ("<article><p class='notice-board'>a b</p><h2 id='social-contract'>c</h2><section id='ad-hominem'><p>d</p></section></article>", "a b\nc\nd"),
    "names of parts": (f"<article>{P}<div class='comment-list'>x</div><div id='comment-5'>y</div><div class='ad'>z</div><div class='page-footer'>f</div><p class='notice'>n</p></article>", WORDS),
    "hidden": (f"<article>{P}<p hidden>x</p><div aria-hidden=true>y</div><div style='display: none'>z</div></article>", WORDS),
    "lists of links in the densest part": (f"<body><nav>m</nav><div>{PARAGRAPHS[0]}{LINKS}</div></body>", LINES[0] + "".join(f"\nsource number {i}" for i in range(4))),
}


MARKUP |= {
    "a form around the page": (f"<body><form><div>{PARAGRAPHS[0]}<input name=q><button>Go</button><select><option>x</select></div></form></body>", LINES[0]),
    "a form around all but a line": (f"<body><form><div>{PARAGRAPHS[0]}</div></form><div>c 2024</div></body>", LINES[0]),
    "a search form": (f"<body><form><p>Search here</p><input></form><div>{PARAGRAPHS[0]}</div></body>", LINES[0]),
    "a wrapper named top": (f"<body><div class='top'><div>{PARAGRAPHS[0]}</div></div></body>", LINES[0]),
    "forms within forms": (f"<body><div class='head'><form><nav>menu</nav><div>{PARAGRAPHS[0]}</div></form></div></body>", LINES[0]),
    "a page of comments only": ("<body><div class='comments'><p>a b c</p></div></body>", "a b c"),
    "comments longer than the article": (f"<body><article>{P}</article><div class='comments'>{PARAGRAPHS[0]}</div></body>", WORDS),
    "a hidden page": (f"<body><div hidden>{P}</div></body>", ""),
    "a stray quote": ('<article><p class="a"">one > two</p><p>three</p></article>', "one > two\nthree"),
    "an apostrophe in a value": ("<article><p data-x=don't>one</p><p>It's two</p><p>three</p></article>", "one\nIt's two\nthree"),
    "a quoted angle": ("<article><p title='a > b'>one</p></article>", "one"),
    "formulas": ("<article><p>where <math><mi>E</mi>=<mi>m</mi><annotation>tex</annotation></math> holds</p></article>", "where E=m holds"),
    "nested drawings": (f"<article><svg><svg><text>x</text></svg><text>label</text></svg>{P}</article>", WORDS),
    "an open drawing": (f"<article><svg><text>x</text>{P}</article>", WORDS),
    "character data": (f"<article>{P}<![CDATA[ x > y ]]></article>", WORDS),
    "teasers": (f"<body><article>{PARAGRAPHS[0]}</article><article class='teaser'>{P}</article><article class='comment'>{P}</article></body>", LINES[0]),
}


@pytest.mark.parametrize("name", MARKUP)
def test_markup(name):
    source, wanted = MARKUP[name]
    assert main_text(source) == wanted


@pytest.mark.parametrize("source", ["<i>" * 60_000 + "</b>" * 60_000 + "x", "<i>" * 30_000 + "<p>" * 30_000 + "x", "<div><p>" * 30_000 + "x", "<li><b>" * 30_000 + "x", "<p>" + "word " * 400_000, "<svg>" * 40_000 + "<p>x", "<form>" * 3_000 + "<p>x", "<p a=' " * 20_000 + "<p>x", "<p a" + "=" * 200_000 + ">x"])
def test_long_and_broken_pages_take_linear_time(source):
    start = time.perf_counter()
    assert main_text(source).endswith(("x", "word"))
    assert time.perf_counter() - start < 20


class Plain(HTMLParser):
    """An element tree of its own: (tag, children); texts are strings."""

    def __init__(self, source):
        super().__init__()
        self.root = ("#root", [])
        self.open = [self.root]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        node = (tag, [])
        self.open[-1][1].append(node)
        self.open.append(node)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1][1].append(data)


def elements(node):
    yield node
    for child in node[1]:
        if not isinstance(child, str):
            yield from elements(child)


def characters(node, linked=False, only_linked=False):
    linked = linked or node[0] == "a"
    return sum(
        (len(child.replace(" ", "")) if linked or not only_linked else 0) if isinstance(child, str) else characters(child, linked, only_linked) for child in node[1]
    )


def composite_density(node, body):
    c, lc = characters(node), characters(node, only_linked=True)
    if not c:
        return 0.0
    inside = list(elements(node))[1:]
    t, lt = max(1, len(inside)), max(1, sum(e[0] == "a" for e in inside))
    base = math.log(c / max(1, c - lc) * lc + characters(body, only_linked=True) / max(1, characters(body)) * c + math.e)
    if base <= 1 or c * t <= max(1, lc) * lt:
        return c / t * (1 if not lc else (c - lc) / c)
    return c / t * math.log(c / max(1, lc) * (t / lt) + 1e-9, base)


def grown(rng, depth=0):
    if depth > 3 or rng.random() < 0.3:
        return "".join(f"<p>{'some words ' * rng.randrange(1, 12)}</p>" if rng.random() < 0.7 else f"<a>{'link ' * rng.randrange(1, 4)}</a>" for _ in range(rng.randrange(1, 4)))
    return "".join(f"<{t}>{grown(rng, depth + 1)}</{t}>" for t in rng.choices(["div", "section", "span"], k=rng.randrange(1, 4)))


def test_densities_equal_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        source = f"<body>{grown(rng)}</body>"
        _, _, _, densities, sums, body = Page(source).measured()
        nodes = list(elements(Plain(source).root))
        assert len(nodes) == len(sums) and nodes[body][0] == "body"
        for node, density, total in zip(nodes[1:], densities[1:], sums[1:]):
            assert density == pytest.approx(composite_density(node, nodes[body]))
            assert total == pytest.approx(sum(composite_density(c, nodes[body]) for c in node[1] if not isinstance(c, str)))
