"""Main text of web pages by tree scoring.

A page is parsed into a tree; parts that are never article text (scripts, menus,
forms) are left out, and so is what names itself an advert, a notice, a sidebar, a
menu or a comment. A name is judged as a whole: ``comment-body`` is a comment, not a
body. An element with such a name stays only if the tree says that the name is of
the page's layout (``content-sidebar-wrap``): it has an article, main or h1 element or,
unless it names a comment, an advert or the like, an element named as an article, and
more than half of the page's text outside links.

Every paragraph passes points for its length and its commas to its ancestors, halved
with each step; a container's points are discounted by its link density. The best
container is kept, with the article or main element around it. From there on up,
blocks beside it are kept unless they are mostly links: with an article or main
element those that have paragraphs, headings or an article of their own, without one
all of them, up to the highest ancestor where there are such. A form that holds most
of the page's text outside links is no form but the page.

Defined cases: a null or empty page has an empty text; a page without any
paragraph falls back to the whole body under the same exclusions; unclosed and
stray tags are closed as browsers do; null and repeated ids and other columns are
unaffected (one row out for each row in); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Never article text.
SKIPPED = frozenset("script style noscript template head title iframe object svg math canvas audio video map nav footer aside form button select textarea input label fieldset dialog menu".split())
BLOCKS = frozenset("address article blockquote body center dd details div dl dt figcaption figure form h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An open p ends where one of these begins.
ENDS_P = BLOCKS | {"form", "nav", "aside", "footer", "fieldset", "menu"}
#: What an element of the key's name closes if it is open, up to a boundary.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What makes a block beside an article element part of the article.
PROSE = HEADINGS | {"p", "pre", "blockquote", "article"}
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
CONTAINERS = frozenset("body html div article section main td blockquote center".split())
#: Words of a class or id that mark what is not the article, whatever is beside them ...
FURNITURE = re.compile(
    r"ads?|adv|advert\w*|adsense|adbox|adunit|dfp|sponsor\w*|promo\w*|banners?|cookies?\w*|consent\w*|gdpr|ccpa|notices?|notification\w*|alerts?|popups?|modals?|newsletter\w*|subscri\w*|signup|signin|login|register|paywall|"
    r"nav|navs|navi|navbar\w*|navigation\w*|navlinks?|menus?|menubar|submenu|dropdown|breadcrumbs?|pagination|paginator|pager|sidebars?\w*|widgets?|related\w*|recommend\w*|recirculation|trending|teasers?|share|shares|sharing|sharebar|sharethis|social\w*|"
    r"comments?|commentlist|commentbox|commentform|commenting|disqus\w*|repl(?:y|ies)|respond|footers?|foot|masthead|skiplinks?"
)
#: ... and those that do so unless an article's name is beside them.
UNSURE = re.compile(r"headers?|head|side|toolbar|copyright|search\w*|hidden|tags?|skip|overlay|discussions?|rail|meta")
#: What names of an article are made of.
LIKELY = re.compile(r"article\w*|content\w*|main|post|posts|entry|story|body|text|hentry")
#: No name inside one of these shows that it is layout.
HARD = re.compile(r"ads?|adv|advert\w*|sponsor\w*|promo\w*|cookies?\w*|consent\w*|menus?|nav\w*|comments?|comment\w+|disqus\w*|repl(?:y|ies)|respond|footers?|related\w*|teasers?|newsletter\w*|notices?|alerts?")
#: Before these an article element lists its subjects.
SUBJECTS = re.compile(r"tags?|category|cat|topic|term|type|format|status")
#: Words that make a name a remark on the layout: has-sidebar, no-ads, comments-open.
REMARK = re.compile(r"has|have|with|without|no|not|non|is|open|closed|enabled|disabled")
#: Words of the page's frame: content-sidebar-wrap.
FRAME = re.compile(r"wrap|wrapper|layout|grid|container|columns?|cols?|left|right")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("box", "children", "hard", "inside", "links", "name", "named", "parent", "points", "size", "skip", "suspect")

    def __init__(self, name: str, parent: Node | None, skip: bool, suspect: bool = False, hard: bool = False, named: bool = False):
        self.name, self.parent, self.skip, self.suspect, self.hard, self.named = name, parent, skip, suspect, hard, named
        #: Whether it is in an article or main element.
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main"))
        self.box: Node | None = None
        self.children: list[Node | str] = []
        self.points = 0.0
        self.size = self.links = 0


def judged(name: str, attrs: list[tuple[str, str | None]], inside: bool) -> tuple[bool, bool, bool, bool]:
    """(never article text; named as furniture; with a hard word; named as an article)."""
    # whether a form is left out depends on the whole page
    if (name in SKIPPED and name != "form") or (name == "header" and not inside):
        return True, False, False, False
    suspect = hard = named = False
    for key, value in attrs:
        value = value or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog")):
            return True, False, False, False
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, False, False
        if key not in ("class", "id"):
            continue
        for one in value.split():
            words = [w.lower() for w in WORD.findall(one)]
            if not words:
                continue
            likely = [bool(LIKELY.fullmatch(w)) for w in words]
            named = named or all(likely)
            if any(REMARK.fullmatch(w) for w in words) or name == "main":
                continue
            if any(FURNITURE.fullmatch(w) for w in words):
                if name == "article" and SUBJECTS.fullmatch(words[0]):
                    continue
                suspect = True
                hard = hard or (any(HARD.fullmatch(w) for w in words) and not any(FRAME.fullmatch(w) for w in words))
            elif name == "article":
                continue
            elif any(UNSURE.fullmatch(w) for w in words) and not likely[0] and not (inside and any(w.startswith("head") for w in words)):
                suspect = True
    return False, suspect, hard, named and not suspect


class Builder(HTMLParser):
    """The tree of a page; parts left out keep their place but no content."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False)
        #: How many elements of each name are open.
        self.open: Counter[str] = Counter()

    def _up(self, node: Node) -> None:
        """Close the open elements up to and with ``node``."""
        while True:
            self.open[self.at.name] -= 1
            last, self.at = self.at, self.at.parent
            if last is node:
                return

    def _close(self, names: set[str] | frozenset[str], boundary: set[str]) -> None:
        if not any(self.open[n] > 0 for n in names):
            return
        node = self.at
        while node.parent is not None and node.name not in boundary:
            above = node.parent
            if node.name in names:
                self._up(node)
            # what else of that kind is open above goes too
            node = above

    def handle_starttag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        if name in ENDS_P:
            self._close({"p"}, {"td", "th", "button", "html", "body"})
        if name in SIBLINGS:
            self._close(*SIBLINGS[name])
        if name in ("html", "body"):
            return
        if name in VOID:
            self.at.children.append(" " if name in ("br", "wbr") else "\n" if name == "hr" else "")
            return
        skip, suspect, hard, named = judged(name, attrs, self.at.inside or self.at.name in ("article", "main"))
        node = Node(name, self.at, self.at.skip or skip, suspect, hard, named)
        self.at.children.append(node)
        self.at = node
        self.open[name] += 1

    def handle_startendtag(self, name: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(name, attrs)

    def handle_endtag(self, name: str) -> None:
        if name in ("html", "body") or self.open[name] <= 0:
            return
        node = self.at
        while node.parent is not None and node.name != name:
            # an inline end tag does not reach out of its block
            if name not in BLOCKS and name not in SKIPPED and node.name in BLOCKS:
                return
            node = node.parent
        if node.parent is not None:
            self._up(node)

    def handle_data(self, data: str) -> None:
        if not self.at.skip:
            self.at.children.append(data)


def walk(root: Node) -> list[Node]:
    """The nodes, parents first, without recursion: pages nest deeply."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if isinstance(c, Node) and not c.skip)
    return out


def skip_furniture(root: Node) -> None:
    """Leave out the forms that hold at most half of the text outside links, and what
    is named as furniture, unless the tree shows that it is not."""
    nodes = walk(root)
    if not any(n.name == "form" or n.suspect for n in nodes):
        return
    text: dict[int, int] = {}
    shown: dict[int, tuple[bool, bool]] = {}  # an article element or h1; a name of one
    for node in reversed(nodes):
        text[id(node)] = 0 if node.name == "a" else sum(len(c.strip()) if isinstance(c, str) else text.get(id(c), 0) for c in node.children)
        below = [shown.get(id(c), (False, False)) for c in node.children if isinstance(c, Node) and not c.suspect]
        shown[id(node)] = any(x for x, _ in below) or (node.name in ("article", "main", "h1") and not node.suspect), any(x for _, x in below) or node.named
    whole = text[id(root)]
    for node in nodes:
        most = 2 * text[id(node)] > whole
        if node.name == "form":
            node.skip = not most
        if node.suspect:
            element, name = shown[id(node)]
            node.skip = not (most and (element or (name and not node.hard)))


def score(nodes: list[Node]) -> None:
    for node in nodes:
        if node.parent is not None:
            node.box = node.parent if node.parent.name in CONTAINERS else node.parent.box
        node.size = sum(len(c.strip()) for c in node.children if isinstance(c, str))
    commas = {id(n): sum(c.count(",") + c.count("，") + c.count("、") for c in n.children if isinstance(c, str)) for n in nodes}
    for node in reversed(nodes):
        if node.name == "a":
            node.links = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
            if node.name not in BLOCKS:  # inline text belongs to its block
                commas[id(node.parent)] = commas.get(id(node.parent), 0) + commas[id(node)]
    for node in nodes:
        direct = any(isinstance(c, str) and c.strip() for c in node.children)
        if node.name not in PARAGRAPHS and not (direct and node.name in CONTAINERS):
            continue
        size = node.size
        if not size:
            continue
        points = (1 + commas[id(node)] + min(size / 100, 3) + min(size / 25, 1)) * (1 - node.links / size)
        up, share = (node if node.name in CONTAINERS else node.box), 1.0
        while up is not None and share > 1e-9:
            up.points += points * share
            share /= 2
            up = up.box


def density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def runs(node: Node) -> Iterator[tuple[list[Node | str], int, int]]:
    """The children that are left: blocks one by one, what is between them
    together; with their text and link sizes."""
    held: list[Node | str] = []
    size = links = 0
    for c in node.children:
        if isinstance(c, Node) and c.skip:
            continue
        if isinstance(c, Node) and c.name in BLOCKS:
            if held:
                yield held, size, links
            yield [c], c.size, c.links
            held, size, links = [], 0, 0
        else:
            held.append(c)
            size += len(c.strip()) if isinstance(c, str) else c.size
            links += 0 if isinstance(c, str) else c.links
    if held:
        yield held, size, links


def around(best: Node, strict: bool) -> Node:
    """The highest ancestor of ``best`` with paragraphs or headings besides it. Blocks
    beside the way there that are mostly links are taken out; if ``strict``, those
    outside a main element without paragraphs, headings or an article as well."""
    top = node = best
    while node.parent is not None:
        up, others = node.parent, []
        loose = not strict or up.name == "main" or up.inside
        for items, size, links in runs(up):
            if node in items:
                others.append(items)
            elif 2 * links < size or not size or (isinstance(items[0], Node) and items[0].name in HEADINGS):
                beside = [n for c in items if isinstance(c, Node) for n in walk(c)]
                prose = any(n.name in (PARAGRAPHS if loose else PROSE) and n.size and (n.name in HEADINGS or 2 * n.links < n.size) for n in beside)
                if prose:
                    top = up
                if prose or loose:
                    others.append(items)
        up.children = [c for items in others for c in items]
        node = up
    return top


def kept(root: Node, nodes: list[Node]) -> Node:
    """The part of the tree that is the article."""
    # the outermost of equals, so that a wrapper around the article counts too
    best = max(nodes, key=lambda n: n.points * (1 - density(n)), default=root)
    if best.points <= 0:
        return root
    # an article or main element around the best container is kept whole
    up = best
    while up is not None and up.name not in ("article", "main"):
        up = up.parent
    return around(best if up is None else up, up is not None)


def blocks(node: Node) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    todo: list[Node | str | None] = [node]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            held.append(item)
        elif not item.skip:
            block = item.name in BLOCKS
            if block:
                end()
                todo.append(None)
            todo.extend(reversed(item.children))
    end()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    builder = Builder()
    builder.feed(html)
    builder.close()
    skip_furniture(builder.root)
    nodes = walk(builder.root)
    score(nodes)
    return "\n".join(blocks(kept(builder.root, nodes)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page its id, url and main text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h.as_py()) for h in b.column(2)], pa.string())], ["page_id", "url", "text"])

    return pages.select(pages[id_col].cast("long"), pages[url_col].cast("string"), pages[html_col].cast("string")).mapInArrow(run, "page_id long, url string, text string")
