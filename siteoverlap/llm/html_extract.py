"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass looks at each block
alone: long blocks with enough stop words are good, blocks that are mostly links are
bad, all others are undecided. In the second pass an undecided block inherits the
label of its nearest decided neighbours, before and after it, within the innermost
container (div, list, section, ...) that holds any decided block; at the level of the
page a missing neighbour counts as bad, for menus and notices stand there. Where the
two disagree, the nearest decided block directly in the same container decides, then
a heading follows the block after it; what is left is bad. On a page without any good
block the container with most text takes their place, paragraphs and headings first.

Names only ever lower a block: what lies in an element that says it is a menu,
footer, form, advert or comment, by tag, role, class or id, is bad from the start.
No name raises one, so pages without <article> or <main> fare the same.

White space inside a block becomes one space, blocks are joined by one space. Null
and empty pages have an empty text; broken markup never fails: a tag that never ends
is text, and after a tag whose quotes never end, quotes no longer count. Ties go to
the neighbour before. Time is linear in the length of a page, however it is nested.
Repeated rows give repeated results, an empty table an empty one. Only the named
columns are read, so others may have any name.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textio import arrow_schema, slices, small_batches

#: Least characters and share of stop words of a good block, share of characters in links from which a block is bad.
LENGTH_GOOD, STOP_GOOD, LINKS_MAX = 120, 0.15, 0.35

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
EDGE = re.compile(r"""[>"']""")
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
LETTERS = re.compile(r"[^\W\d_]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is not markup: skipped up to the closing tag.
RAW = frozenset("script style noscript template textarea iframe title svg math object canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of the first kind ends an open element of the second.
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
SCOPE = frozenset("article aside body div footer form header main nav ol section table td ul".split())
#: Elements that are a block of their own and no container of blocks.
LEAVES = HEADINGS | frozenset("p pre dt dd li caption figcaption summary legend td th tr tbody thead tfoot option".split())

NEVER = frozenset("nav footer aside form button select head menu dialog label fieldset".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of class and id attributes that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer legal login masthead menu modal nav navbar navigation newsletter notice notices pagination popup promo related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Frequent words of English, German, French and Spanish.
STOP = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this to was we were which with you
    als am an auch auf aus bei das dem den der des die durch ein eine einen er es für hat ich im in ist mit nach nicht noch sich sie sind so um und von war werden wie zu zum
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y
    al como con de del el ella ellos en era es esta este ha la las lo los más me mi muy no o para pero por que se si sin su sus también un una y ya""".split()
)


class Block:
    __slots__ = ("bad", "container", "heading", "leaf", "links", "text")

    def __init__(self, text: str, links: int, bad: bool, container: int, heading: bool, leaf: bool):
        self.text, self.links, self.bad, self.container, self.heading, self.leaf = text, links, bad, container, heading, leaf


def marked(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element and all it holds is not part of an article."""
    if name in NEVER or (name == "header" and not inside):
        return True
    if not attrs.strip():
        return False
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            words = re.split(r"[\s_-]+", value)
            if not MARKS.isdisjoint(words) or ("header" in words and not inside):
                return True
        elif key == "role" and value in ROLES:
            return True
        elif key == "hidden" or (key == "style" and "display:none" in value.replace(" ", "")) or (key == "aria-hidden" and value == "true"):
            return True
    return False


class Tags:
    """The tags of a page in order: (start, end, name with a slash if it closes, attributes); comments and the like have no name."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, page.rfind(">")

    def after(self, at: int) -> tuple[int, int, str, str] | None:
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), "", ""
            if at > self.last:
                return None
            m = NAME.match(page, at + 1)
            if m:
                end = self.end_of(m.end())
                return at, end + 1, m[0].lower(), page[m.end() : end]
            if page[at + 1] in "!?/":
                return at, page.index(">", at) + 1, "", ""
            at += 1
        return None

    def end_of(self, at: int) -> int:
        """Place of the > that ends a tag, outside of quotes where these are closed."""
        place = at
        while self.quotes:
            m = EDGE.search(self.page, place)
            if m and m[0] == ">":
                return m.start()
            place = self.page.find(m[0], m.end()) + 1 if m else 0
            if not place:
                self.quotes = False
        return self.page.index(">", at)


def blocks(page: str) -> tuple[list[Block], list[int]]:
    """The text blocks of a page, in order, and the parent of each container (the page is 0)."""
    out: list[Block] = []
    parents = [0]
    stack: list[tuple[str, bool, bool, int, bool]] = []  # name, not part of an article, part of one, container, leaf
    places: dict[str, list[int]] = {}  # open elements of each name
    scopes: list[int] = []
    unclosed: set[str] = set()
    parts: list[str] = []
    links = anchors = headings = 0

    def end() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, bad, _, container, leaf = stack[-1] if stack else ("", False, False, 0, False)
                out.append(Block(text, links, bad, container, headings > 0, leaf))
            parts.clear()
        links = 0

    def add(piece: str) -> None:
        nonlocal links
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if anchors:
                links += len(piece.strip())

    def pop_to(k: int) -> None:
        nonlocal anchors, headings
        for name, *_ in stack[k:]:
            places[name].pop()
            anchors -= name == "a"
            headings -= name in HEADINGS
        while scopes and scopes[-1] >= k:
            scopes.pop()
        del stack[k:]

    at, tags = 0, Tags(page)
    while tag := tags.after(at):
        start, stop, name, attrs = tag
        add(page[at:start])
        at = stop
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if name in BLOCK:
                end()
            if places.get(name) and (name in BLOCK or not scopes or scopes[-1] <= places[name][-1]):
                pop_to(places[name][-1])
            continue
        if name in RAW:
            if attrs.endswith("/"):
                continue
            if name in ("title", "script", "style"):
                end()
            close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            if close:
                at = close.end()
            else:
                unclosed.add(name)
                at = len(page) if name in ("script", "style") else at
            continue
        if name in BLOCK:
            end()
            ended = max((places[x][-1] for x in ("p" if name != "br" else "", *ENDS.get(name, "").split()) if places.get(x)), default=-1)
            if ended >= 0 and (not scopes or ended >= scopes[-1]):
                pop_to(ended)
        if name in VOID:
            continue
        _, bad, inside, container, leaf = stack[-1] if stack else ("", False, False, 0, False)
        if name in BLOCK and name not in LEAVES and name not in ("html", "body"):
            parents.append(container)
            container, leaf = len(parents) - 1, False
        places.setdefault(name, []).append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        stack.append((name, bad or marked(name, attrs, inside), inside or name in ("article", "main"), container, leaf or name in LEAVES))
        anchors += name == "a"
        headings += name in HEADINGS
    add(page[at:])
    end()
    return out, parents


def stop_share(text: str) -> float:
    words = LETTERS.findall(text.lower())
    return sum(w in STOP for w in words) / max(1, len(words))


def first_pass(block: Block) -> bool | None:
    """True: good, False: bad, None: undecided."""
    n = len(block.text)
    if block.bad or block.links > LINKS_MAX * n:
        return False
    return True if n >= LENGTH_GOOD and stop_share(block.text) >= STOP_GOOD else None


def with_most_text(found: list[Block], labels: list[bool | None]) -> set[int]:
    """The undecided blocks of the container with most text that looks like prose; none if nothing on the page does."""
    weight: dict[int, float] = {}
    for b, label in zip(found, labels, strict=True):
        if label is None:
            weight[b.container] = weight.get(b.container, 0.0) + len(b.text) * (0.5 + stop_share(b.text)) * (4 if b.leaf else 1)
    if not weight:
        return set()
    best = max(weight, key=lambda c: (weight[c], -c))
    return {k for k, b in enumerate(found) if b.container == best and labels[k] is None}


def second_pass(found: list[Block], parents: list[int], labels: list[bool | None]) -> list[bool]:
    """Which blocks to keep: undecided ones inherit the labels of their nearest decided neighbours."""
    if True not in labels:
        chosen = with_most_text(found, labels)
        labels = [True if k in chosen else x for k, x in enumerate(labels)]
    n = len(found)
    before, after, near = [-1] * n, [n] * n, [-1] * n
    first, last, holds = [n] * len(parents), [-1] * len(parents), [False] * len(parents)
    seen: dict[int, int] = {}
    at = -1
    for k, b in enumerate(found):
        before[k], near[k] = at, seen.get(b.container, -1)
        first[b.container], last[b.container] = min(first[b.container], k), k
        if labels[k] is not None:
            at, holds[b.container] = k, True
            seen[b.container] = k
    seen, at = {}, n
    for k in range(n - 1, -1, -1):
        after[k] = at
        c = found[k].container
        if labels[k] is not None:
            at = seen[c] = k
        elif c in seen and (near[k] < 0 or seen[c] - k < k - near[k]):
            near[k] = seen[c]
    for c in range(len(parents) - 1, 0, -1):  # a container lies behind its parent
        p = parents[c]
        first[p], last[p], holds[p] = min(first[p], first[c]), max(last[p], last[c]), holds[p] or holds[c]
    up = [0] * len(parents)
    for c in range(1, len(parents)):
        up[c] = c if holds[c] else up[parents[c]]
    keep = []
    for k, b in enumerate(found):
        if labels[k] is not None:
            keep.append(labels[k])
            continue
        c = up[b.container]
        x = labels[before[k]] if before[k] >= first[c] else None
        y = labels[after[k]] if after[k] <= last[c] else None
        if c == 0:
            x, y = bool(x), bool(y)
        if x is None or y is None or x == y:
            keep.append(bool(y if x is None else x))
        elif near[k] >= 0:
            keep.append(labels[near[k]])
        else:
            keep.append(b.heading and y)
    return keep


def main_text(page: str) -> str:
    """The text of a page's article."""
    found, parents = blocks(page)
    kept = second_pass(found, parents, [first_pass(b) for b in found])
    return " ".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(pages: DataFrame, keep: tuple[str, ...] = (), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row a page: id, the columns of ``keep``, and text."""
    small_batches(pages.sparkSession)
    inner = pages.select(F.col(id_col).cast("long").alias("c0"), F.col(html_col).cast("string").alias("text"), *(F.col(c).alias(f"k{n}") for n, c in enumerate(keep)))
    schema = T.StructType([f for f in inner.schema if f.name != "text"] + [T.StructField("text", T.StringType())])

    def run(batches):
        out = arrow_schema(schema)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [main_text(x) if x else "" for x in part.column(1).to_pylist()]
                cols = [part.column(0), *(part.column(2 + n) for n in range(len(keep))), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return inner.mapInArrow(run, schema).toDF(id_col, *keep, "text")
