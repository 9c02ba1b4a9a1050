"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, lowered where its characters and
tags are those of links. A node's density sum adds its children's densities;
the node with the largest sum heads the main text. On the path from it up to
body, the text widens to the highest ancestor that is at least as dense as
body itself, so an article that is cut into sections is taken whole. Beside it
every subtree comes out that is at least as dense as the least dense node of the
path, and the headings of what comes out; where the page marks its article, only
further articles do. Lists of links go, but not those of the article itself or of the densest node. What
markup names as menus, headers, footers, sidebars, notices, adverts, forms or
reader comments never counts and never comes out, with one exception: a form or a
part named like a header that holds the page's main text stays, its controls go,
and no name at all empties a page.

Pages are independent of one another: one Arrow-batched pass, no exchange.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm._store import text_or_empty

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|title|textarea|noscript|iframe|xmp|noembed|noframes|template"
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html caption tbody td tfoot th thead tr legend".split())
SAME_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div body html td th aside nav main header footer blockquote form".split())
# Elements, roles and class or id words of what isn't main text.
NOT_MAIN = frozenset("head nav footer aside form button select option menu dialog object canvas audio video label svg annotation annotation-xml".split())
NOT_MAIN_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOT_MAIN_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter "
    "subscribe subscription comment comments disqus reply replies respond share sharing social related recommended widget toolbar "
    "copyright disclaimer alert signup login search pagination pager skip topbar".split()
)
HEADER_WORDS = frozenset({"header", "head", "top"})
#: Names of articles that aren't the page's own.
OTHER_ARTICLES = frozenset("teaser teasers related recommended promo sponsored ad comment comments reply".split())
#: A part that markup rules out holds the page's main text if it has so many paragraphs and more than half of all text.
MAIN_PARAGRAPHS = 2
#: A page that wraps its text in more such parts than this has names that mean nothing.
WRAPPERS = 4
LINKED_SHARE = 0.6
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: What follows a word of NOT_MAIN_WORDS in the name of a part of a page, as in comment-list or ad-slot.
PART_WORDS = frozenset(
    "area bar block body bottom box button buttons container content column entry footer form header holder icons inner item items left link "
    "links list listing module outer overlay panel popup post posts right section slot thread title toggle top unit wrap wrapper zone".split()
)
#: Elements that hold text themselves: a compound name says nothing against these.
TEXT_ELEMENTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th caption figcaption span a b i em strong q cite code mark small sub sup u font summary".split())

# Attributes as HTML reads them: a quote opens a value only behind an equals sign, anywhere else it is part of a name.
_ATTRIBUTES = r"(?:[\s/]+|=|[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)?)*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<({RAW})(?=[\s/>]){_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACES = re.compile(r"\s+")


def _names_boilerplate(word: str, tag: str, inside_main: bool) -> bool:
    """Whether a class or id names a part of the page that isn't main text: comment, comment-5, comment-list, page-footer,
    but not notice-board or has-sidebar; a text element only by the plain word."""
    parts = [x for x in re.split(r"[-_]+|(?<=[a-z])(?=\d)", word) if x]
    if not parts or parts[0] in ("has", "with", "no", "is", "js"):
        return False
    while len(parts) > 1 and parts[-1].isdigit():
        parts.pop()
    if len(parts) == 1:
        return parts[0] in NOT_MAIN_WORDS or (not inside_main and parts[0] in HEADER_WORDS)
    if tag in TEXT_ELEMENTS:
        return False
    if parts[-1] in NOT_MAIN_WORDS or (not inside_main and len(parts) < 3 and parts[-1] in HEADER_WORDS):
        return True
    return parts[0] in NOT_MAIN_WORDS and parts[-1] in PART_WORDS


def _not_main(tag: str, attributes: str, inside_main: bool) -> bool:
    if tag in NOT_MAIN or (tag == "header" and not inside_main):
        return True
    if tag == "article":
        words = {w for name, *values in _ATTRIBUTE.findall(attributes) if name.lower() == "class" for w in "".join(values).lower().split()}
        return bool(words & OTHER_ARTICLES)
    if not attributes or tag in ("html", "body", "main"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value in NOT_MAIN_ROLES and not (value == "banner" and inside_main):
            return True
        if name in ("class", "id") and any(_names_boilerplate(w, tag, inside_main) for w in value.split()):
            return True
    return False


def _hidden(attributes: str) -> bool:
    return any(name.lower() == "hidden" or (name.lower(), "".join(values).lower()) == ("aria-hidden", "true") for name, *values in _ATTRIBUTE.findall(attributes or ""))


class Page:
    """A page's element tree as parallel lists in document order, with the text events that lie between."""

    def __init__(self, source: str, spared: frozenset[int] = frozenset(), names: bool = True):
        self.spared, self.names = spared, names
        # Of each part that markup rules out: text, paragraphs, articles and the like, and whether it is a form or a header by name.
        self.ruled_out: dict[int, list] = {}
        self.tags, self.parents, self.dead, self.ends = ["#root"], [-1], [False], [0]
        self.chars, self.linked = [0], [0]
        self.events: list[tuple[int, str | None]] = []  # (node, text), or (node, None) where a node begins or ends
        self.starts = [0]
        self._read(source)

    def _read(self, source: str) -> None:
        stack, links, mains, at, is_open, outer = [0], 0, 0, 0, Counter(), [0]
        tags, parents, dead = self.tags, self.parents, self.dead

        def pop() -> None:
            nonlocal links, mains
            node = stack.pop()
            is_open[tags[node]] -= 1
            self.ends[node] = len(self.events)
            links -= tags[node] == "a"
            mains -= tags[node] in ("article", "main")
            if tags[node] in BLOCK:
                self.events.append((node, None))

        def text(piece: str) -> None:
            node = stack[-1]
            if dead[node]:
                if outer[node] > 0:
                    self.ruled_out[outer[node]][0] += len(piece) - sum(map(piece.count, " \n\t\r"))
                return
            piece = entities.unescape(piece) if "&" in piece else piece
            self.events.append((node, piece))
            n = len(piece) - sum(map(piece.count, " \n\t\r"))
            self.chars[node] += n
            if links:
                self.linked[node] += n

        for m in _TOKEN.finditer(source):
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if m[2]:
                if not is_open[tag]:  # no need to look through all that is open
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if tags[stack[depth]] == tag:
                        while len(stack) > depth:
                            pop()
                        break
                continue
            if tag == "form" and is_open["form"]:  # forms don't nest
                continue
            if tag in BLOCK and is_open["svg"] and not is_open["foreignobject"]:  # a drawing that was never closed
                while is_open["svg"]:
                    pop()
            if tag in CLOSES_P and is_open["p"]:
                self._close(stack, {"p"}, pop)
            if tag in SAME_CLOSES and any(is_open[x] for x in SAME_CLOSES[tag]):
                self._close(stack, SAME_CLOSES[tag], pop)
            node, parent = len(tags), stack[-1]
            tags.append(tag)
            parents.append(parent)
            gone = tag in NOT_MAIN and tag != "form" or _hidden(m[4])
            dead.append(dead[parent] or gone or (self.names and node not in self.spared and _not_main(tag, m[4], mains > 0)))
            root = outer[parent]  # the outermost part that is ruled out, -1 where it is gone for good
            if dead[node] and not dead[parent]:
                root = -1 if gone else node
                if root == node:
                    self.ruled_out[node] = [0, 0, 0, tag == "form" or not _not_main(tag, m[4], True)]
            elif root > 0 and tag in NOT_MAIN and tag != "form":
                root = -1
            outer.append(root)
            if root > 0 and root != node:
                self.ruled_out[root][1] += tag == "p"
                self.ruled_out[root][2] += tag in ("article", "main", "h1")
            self.chars.append(0)
            self.linked.append(0)
            self.starts.append(len(self.events))
            self.ends.append(0)
            if tag in VOID:
                self.ends[node] = len(self.events)
                if not dead[node] and tag in ("br", "wbr", "hr"):
                    self.events.append((node, " " if tag == "br" else "" if tag == "wbr" else None))
                continue
            if tag in BLOCK:
                self.events.append((node, None))
            if m[4].endswith("/") and tag not in BLOCK and tag != "a":
                self.ends[node] = len(self.events)
                continue
            stack.append(node)
            is_open[tag] += 1
            links += tag == "a"
            mains += tag in ("article", "main")
        if at < len(source):
            text(source[at:])
        while len(stack) > 1:
            pop()
        self.ends[0] = len(self.events)

    def _close(self, stack: list[int], names: set[str], pop) -> None:
        """End the nearest open element of these names, unless a scope lies between."""
        for depth in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[depth]]
            if tag in names:
                while len(stack) > depth:
                    pop()
                return
            if tag in SCOPES:
                return

    def measured(self) -> tuple[list[int], list[int], list[int], list[float], list[float], int]:
        """chars, linked, links, density and density sum of every node, and the body's number."""
        n = len(self.tags)
        chars, linked, inner, links = self.chars[:], self.linked[:], [0] * n, [0] * n
        for i in range(n - 1, 0, -1):
            if self.dead[i]:
                continue
            p = self.parents[i]
            chars[p] += chars[i]
            linked[p] += linked[i]
            inner[p] += inner[i] + 1
            links[p] += links[i] + (self.tags[i] == "a")
        body = next((i for i in range(n) if self.tags[i] == "body"), 0)
        body_chars, body_linked = max(1, chars[body]), linked[body]

        def density(i: int) -> float:
            c, t, lc, lt = chars[i], max(1, inner[i]), linked[i], max(1, links[i])
            if not c:
                return 0.0
            base = math.log(c / max(1, c - lc) * lc + body_linked / body_chars * c + math.e)
            return c / t * math.log(c / max(1, lc) * (t / lt) + 1e-9, base) if base > 1 and c * t > max(1, lc) * lt else c / t * (1 if not lc else (c - lc) / c)

        densities = [0.0 if self.dead[i] else density(i) for i in range(n)]
        sums = [0.0] * n
        for i in range(1, n):
            sums[self.parents[i]] += densities[i]
        return chars, linked, links, densities, sums, body

    def main_nodes(self) -> tuple[bytearray, bytearray]:
        """Flags of the nodes whose own text is main text, and of those that are dropped as lists of links."""
        n = len(self.tags)
        chars, linked, links, densities, sums, body = self.measured()
        alive = [i for i in range(n) if not self.dead[i]]
        inside = [i for i in alive if i >= body] or [0]
        best = max(inside, key=lambda i: (sums[i], -i))
        if not sums[best]:
            best = body
        least, node, up, article = densities[body], best, best, best
        while up != body and up > 0:
            if self.tags[up] in ("article", "main"):
                article = up
            up = self.parents[up]
            if up != body and densities[up] >= least or self.tags[up] in ("article", "main"):
                node = up
        if self.tags[up] in ("article", "main"):
            article = up
        kept = self._kept(body if not chars[node] else node, best, up, densities, chars, self.tags[article] in ("article", "main"))
        inner, listed, above = bytearray(n), bytearray(n), {0, body}  # what holds the main text is no list
        for i in (best, node):
            while i > 0:
                above.add(i)
                i = self.parents[i]
        for i in range(1, n):
            p = self.parents[i]
            inner[i] = inner[p] or i == article != up or i == best != up
            listed[i] = listed[p] or (not inner[i] and i not in above and self.tags[i] in BLOCK and links[i] >= 3 and linked[i] >= LINKED_SHARE * chars[i])
        return kept, listed

    def _kept(self, node: int, best: int, top: int, densities: list[float], chars: list[int], marked: bool) -> bytearray:
        """Flags of node's subtree and of what else under top is dense enough, with its headings; node itself has a 2."""
        n, parents, dead = len(self.tags), self.parents, self.dead
        kept, path, least = bytearray(n), set(), densities[top]
        kept[node] = 2
        up = best
        while up != top and up > 0:
            least = min(least, densities[up])
            up = parents[up]
        up = node
        while up != top and up > 0:
            up = parents[up]
            path.add(up)
        open_, holds, heads = bytearray(n), bytearray(n), {}
        open_[top] = node != top
        for i in range(1, n):
            p = parents[i]
            if kept[p]:
                kept[i] = 1
            elif open_[p] and not dead[i] and not kept[i]:
                dense = densities[i] >= least and densities[i] > 0 and i not in path
                kept[i] = dense and (not marked or self.tags[i] in ("article", "main"))
                open_[i] = not kept[i]
        for i in range(n - 1, 0, -1):
            p = parents[i]
            if not open_[p] or dead[i]:
                continue
            if self.tags[i] in HEADINGS:
                kept[i] = kept[i] or heads.get(p, False)
            elif chars[i]:
                heads[p] = bool(kept[i] or holds[i])
            holds[p] = holds[p] or bool(kept[i]) or holds[i]
        for i in range(1, n):
            kept[i] = kept[i] or bool(kept[parents[i]])
        loose = [i for i in range(top, n) if open_[i] and not kept[i] and not marked and self.chars[i] - self.linked[i] >= max(least, 1)]
        for i in loose:  # bare text between what is kept
            kept[i] = 1
        return kept

    def text(self) -> str:
        """Blocks of the main text, joined by line ends."""
        kept, listed = self.main_nodes()
        blocks: list[str] = []
        now: list[str] = []

        def end() -> None:
            if now and (block := _SPACES.sub(" ", "".join(now)).strip()):
                blocks.append(block)
            now.clear()

        for i, piece in self.events:
            if piece is None:
                end()
            elif kept[i] and not self.dead[i] and not listed[i]:
                now.append(piece)
        end()
        return "\n".join(blocks)


def _to_spare(page: Page) -> set[int]:
    """The parts that are ruled out though they hold the page's main text: a form or a part named like a header that has
    an article, or paragraphs and most of the text; if nothing else has any text, whatever has most of it."""
    left = sum(page.chars)
    total = left + sum(x[0] for x in page.ruled_out.values())
    found = {i for i, (n, paragraphs, articles, mild) in page.ruled_out.items() if mild and n and 2 * n > total and (articles or paragraphs >= MAIN_PARAGRAPHS)}
    if not found and not left and total:
        found = {max(page.ruled_out, key=lambda i: (page.ruled_out[i][0], -i))}
    return found


def main_text(source: str) -> str:
    """The page's main text; empty if it has none."""
    if not source:
        return ""
    page = Page(source)
    while page.names and (more := _to_spare(page) - page.spared):  # what stays may hold a further such part
        page = Page(source, page.spared | more, len(page.spared) < WRAPPERS)
    return page.text()


def extract_pages(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of df: the id, the url, text, n_chars (code points).

    The whole html counts, null as empty. Character references are decoded, white space inside a block becomes one space,
    blocks follow the page's order, joined by one line end. A page that breaks off ends there: an unfinished tag is no
    text. Repeated rows come out each; an empty table gives an empty one; other columns of df are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(html_col).alias("html"))
    return rows.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnRenamed("id", id_col)
