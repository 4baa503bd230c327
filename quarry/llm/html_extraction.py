"""Main text of web pages by composite text density over the document tree."""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(?:!--|!|\?|(/?)([a-zA-Z][^\s/>]*))")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""", re.I)
_SPACE = re.compile(r"\s+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template".split())
#: Elements that never hold article text, whatever their density.
_SKIPPED = frozenset("head script style title textarea noscript iframe noembed noframes template nav header footer aside form button select option input svg math canvas object embed applet video audio map dialog menu menuitem datalist fieldset label".split())
_BLOCK = frozenset("address article blockquote body center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = _BLOCK | frozenset("nav header footer aside form fieldset menu dialog".split())
_SAME = {"li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}), "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"})}
_SCOPE = frozenset("ul ol dl table div article section main body aside nav form td th blockquote".split())
_NAME = (
    r"(?:ads?|adverts?|advertis(?:ement|ing)s?|adsense|sponsor(?:s|ed|ship)?|promo(?:s|tions?|ted)?|banners?|side-?bar|widgets?|menu|nav(?:bar|igation)?|breadcrumbs?|foot(?:er)?|masthead|head(?:er)?|comments?|disqus|replies|respond"
    r"|cookies?|consent|gdpr|notices?|alert|pop-?up|modal|overlay|newsletter|subscri(?:be|ptions?)|signup|login|share|sharing|social|related|recommend(?:ed|ations?)|toolbar|pagination|pager|tags?|skip|hidden|copyright|legal|disclaimer|paywall)"
)
_BESIDE = r"(?:site|page|main|top|bottom|left|right|global|primary|secondary|mobile|box|bar|list|links|posts|articles|stories|block|wrapper|container|area|section|\d+)"
#: Whole names of menus, adverts, notices and comments, alone or with words of place and form.
_BOILERPLATE = re.compile(rf"(?:{_BESIDE}[_-])*{_NAME}(?:[_-](?:{_NAME}|{_BESIDE}))*", re.I)
#: Elements that a name can cut; text-level ones, headings and paragraphs stay with what is around them.
_NAMED = frozenset("div section ul ol li dl table td details figure center".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())


class _Node:
    __slots__ = ("tag", "parent", "depth", "parts", "skipped", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: _Node | None, skipped: bool, named: bool = False):
        self.tag, self.parent, self.parts, self.skipped, self.named = tag, parent, [], skipped, named
        self.depth = 0 if parent is None else parent.depth + 1
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _tag_end(page: str, at: int) -> int:
    """Index of the '>' that ends a tag, past quoted values; the end of the page if there is none."""
    while True:
        end = page.find(">", at)
        if end < 0:
            return len(page)
        quotes = [(page.find(q, at, end), q) for q in "\"'"]
        opened = [(i, q) for i, q in quotes if i >= 0 and page[at:i].rstrip().endswith("=")]
        if not opened:
            return end
        i, q = min(opened)
        close = page.find(q, i + 1)
        if close < 0:
            return end
        at = close + 1


def _boilerplate(tag: str, attributes: str) -> bool:
    if tag in _SKIPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "role" and value.lower() in _ROLES:
            return True
        if name == "itemprop" and value.lower() == "comment":
            return True
    return False


def _named(tag: str, attributes: str) -> bool:
    """Whether a class or the id of a container is a boilerplate name as a whole."""
    if not attributes or tag not in _NAMED:
        return False
    return any(_BOILERPLATE.fullmatch(v) for name, a, b, c in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for v in (a or b or c).split())


def _skip_named(root: _Node) -> None:
    """Skips subtrees of boilerplate names, but none that holds most of the page's text outside links.

    If nothing would be left, names don't count at all.
    """
    order, stack = [], [(root, False)]
    while stack:
        node, linked = stack.pop()
        linked = linked or node.tag == "a"
        node.chars = 0 if linked else sum(len(_SPACE.sub("", _html.unescape(x))) for x in node.parts if isinstance(x, str))
        order.append(node)
        stack.extend((x, linked) for x in node.parts if isinstance(x, _Node) and not x.skipped)
    for node in reversed(order):
        if node.parent is not None:
            node.parent.chars += node.chars
    cut = [n for n in order if n.named and 2 * n.chars <= root.chars]
    inside, rest = {id(n) for n in cut}, root.chars
    within: set[int] = set()
    for node in order:  # parents come before their children
        if node.parent is not None and id(node.parent) in within:
            within.add(id(node))
        elif id(node) in inside:
            within.add(id(node))
            rest -= node.chars
    if rest or not root.chars:
        for node in cut:
            node.skipped = True
    for node in order:
        node.chars = 0


class _Open:
    """The open elements by name, so that finding the innermost of some names takes no walk over the ancestors."""

    def __init__(self, root: _Node):
        self.here = root
        self.by_tag: dict[str, list[_Node]] = {}

    def innermost(self, tags: Iterable[str]) -> _Node | None:
        found = [x[-1] for x in map(self.by_tag.get, tags) if x]
        return max(found, key=lambda n: n.depth) if found else None

    def enter(self, node: _Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(node)
        self.here = node

    def leave(self, node: _Node) -> None:
        """Ends an open element and all inside it."""
        while self.here is not node.parent:
            self.by_tag[self.here.tag].pop()
            self.here = self.here.parent


def parse(page: str) -> _Node:
    """A tree of the page. Unclosed elements end with their parents, new paragraphs and items close old ones.

    Takes linear time: an element is entered and left once, and an end tag without an open element costs nothing.
    """
    root = _Node("html", None, False)
    open_, at, any_named, unclosed = _Open(root), 0, False, set()
    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            open_.here.parts.append(page[at:])
            break
        if m.start() > at:
            open_.here.parts.append(page[at : m.start()])
        if m.group(2) is None:
            if page.startswith("<!--", m.start()):
                end = page.find("-->", m.start() + 4)
                at = len(page) if end < 0 else end + 3
            else:
                at = _tag_end(page, m.end()) + 1
            continue
        tag, end = m.group(2).lower(), _tag_end(page, m.end())
        attributes = page[m.end() : end]
        at = end + 1
        if m.group(1):
            node = open_.innermost((tag,))
            if node is not None:
                open_.leave(node)
            elif tag == "p":
                open_.here.parts.append(_Node("p", open_.here, open_.here.skipped))
            continue
        if tag in ("html", "body"):
            continue
        if tag in _CLOSES_P:
            node = open_.innermost(("p", *_SCOPE))
            if node is not None and node.tag == "p":
                open_.leave(node)
        if tag in _SAME:
            node = open_.innermost(_SAME[tag] | _SCOPE)
            if node is not None and node.tag in _SAME[tag]:
                while node.parent is not None and node.parent.tag in _SAME[tag]:
                    node = node.parent
                open_.leave(node)
        here = open_.here
        node = _Node(tag, here, here.skipped or _boilerplate(tag, attributes), _named(tag, attributes))
        any_named = any_named or node.named
        here.parts.append(node)
        if tag in _RAW:
            close = None if tag in unclosed else re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            if close:
                at = _tag_end(page, close.start()) + 1
            else:
                unclosed.add(tag)  # no later one is closed either
                at = at if tag in ("template", "noscript") else len(page)
        elif tag not in _VOID and not attributes.endswith("/"):
            open_.enter(node)
    if any_named:
        _skip_named(root)
    return root


def _measure(root: _Node) -> list[_Node]:
    """Characters, tags and those in links of every node, then densities; returns nodes in page order."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(x for x in reversed(node.parts) if isinstance(x, _Node) and not x.skipped)
    for node in reversed(order):
        for x in node.parts:
            if isinstance(x, str):
                node.chars += len(_SPACE.sub("", _html.unescape(x)))
            elif not x.skipped:
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags + (x.tag == "a")
        if node.tag == "a":
            node.link_chars = node.chars
    whole = max(1, root.chars)
    for node in order:
        if node.chars:
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * node.link_chars + root.link_chars / whole * node.chars + math.e)
            ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.density = node.chars / max(1, node.tags) * max(0.0, math.log(ratio) / math.log(max(base, 1.0001)) if base != 1 else math.log(ratio))
    for node in order:
        node.total = sum(x.density for x in node.parts if isinstance(x, _Node) and not x.skipped)
    return order


def _chosen(root: _Node) -> list[_Node]:
    """The article's subtrees in page order: for each block no thinner than the thinnest on the path to the
    best one, the subtree of it with the largest sum of child densities.

    A block is as thick as that path by composite density or, as that grows with a block's size, by
    characters a block (inline tags aren't counted) if it isn't mostly links. Where most of a block's text lies in no block below it, the
    block itself is taken. A subtree in an <article> stands for all of it, one right below <main> for that,
    and what lies between two chosen neighbours belongs to them unless it is mostly links.
    """
    order = _measure(root)
    if not root.chars:
        return []
    at = {id(n): i for i, n in enumerate(order)}
    size = [1] * len(order)
    blocks = [0] * len(order)
    block = [n.tag not in _INLINE for n in order]
    peak = list(range(len(order)))
    for i in range(len(order) - 1, -1, -1):
        node = order[i]
        below = [at[id(x)] for x in node.parts if isinstance(x, _Node) and not x.skipped]
        size[i] += sum(size[j] for j in below)
        blocks[i] = sum(blocks[j] + block[j] for j in below)
        block[i] = block[i] or any(block[j] for j in below)
        own = node.chars - sum(order[j].chars for j in below if block[j])
        if 2 * own < node.chars:
            for j in below:
                if block[j] and order[peak[j]].total > order[peak[i]].total:
                    peak[i] = peak[j]
    best = max((n for i, n in enumerate(order) if block[i]), key=lambda n: n.total)
    if best.total == 0:
        return [root]
    plain = lambda n: n.chars / max(1, blocks[at[id(n)]])
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    composite = min((n.density for n in path if n.density), default=math.inf)
    simple = min(plain(n) for n in path)
    article: list[int | None] = []
    for i, node in enumerate(order):
        article.append(i if node.tag == "article" else article[at[id(node.parent)]] if node.parent is not None else None)

    def whole(i: int) -> int:
        node = order[i]
        if article[i] is not None:
            return article[i]
        under = node.parent is not None and node.parent.tag == "main" and node.tag not in ("main", "body")
        return at[id(node.parent)] if under else i

    marked = {whole(at[id(best)])}
    for i, node in enumerate(order):
        if block[i] and (node.density >= composite or (2 * node.link_chars < node.chars and plain(node) >= simple)):
            marked.add(whole(peak[i]))
    for i, node in enumerate(order):
        if i in marked:
            continue
        below = [at[id(x)] for x in node.parts if isinstance(x, _Node) and not x.skipped]
        taken = [k for k, j in enumerate(below) if j in marked]
        if taken:
            marked.update(j for j in below[taken[0] : taken[-1]] if block[j] and order[j].chars and 2 * order[j].link_chars < order[j].chars)
    found, i = [], 0
    while i < len(order):
        if i in marked:
            found.append(order[i])
            i += size[i]
        else:
            i += 1
    return found


def main_text(page: str) -> str:
    """The page's article: blocks in page order, white space made single, joined by a line feed."""
    root = parse(page)
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", _html.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    for top in _chosen(root):
        stack: list[tuple[_Node, int]] = [(top, 0)]
        while stack:
            node, i = stack.pop()
            if i < len(node.parts):
                stack.append((node, i + 1))
                x = node.parts[i]
                if isinstance(x, str):
                    run.append(x)
                elif x.tag == "br":
                    run.append(" ")
                elif x.tag in _CLOSES_P:
                    flush()
                    if not x.skipped:
                        stack.append((x, 0))
                elif not x.skipped:
                    stack.append((x, 0))
            elif node.tag in _CLOSES_P or not stack:
                flush()
    return "\n".join(blocks)


def _extract(batches):
    for batch in batches:
        texts = [main_text(h or "") for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, text, n_chars (code points) of every page from its whole html; null html is empty.

    Pages without article text have an empty text. Repeated rows are treated alike, very long and
    badly nested pages take linear time, and other columns are ignored. An empty table gives an empty one.
    """
    source = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}
    rows = source.mapInArrow(_extract, f"id {kinds['id']}, url {kinds['url']}, text string, n_chars long")
    return rows.withColumnRenamed("id", id_col).withColumnRenamed("url", url)
