"""Main text of web pages by scoring the tree of blocks.

A tolerant scanner turns a page into a tree of its block elements. Paragraphs score points for
being one, for each comma and for each 100 characters (three at most). A container's points are
those of its paragraphs and half of its containers' points, and they are discounted by the share of its
text that stands in links. The best container wins. Around it, the outermost ``<main>``, or else
``<article>``, is taken whole; of a ``<main>`` with one article that holds most of its text, that article and what leads up to it. Without either the
container is taken, with siblings that score well enough (ones of its own kind: a fifth of its points) or are long paragraphs with few links. Headings and
leads that stand in front of it belong to it. Behind prose, lists whose items all begin with a line of who or when are readers' comments.
A button's text counts as a link's, and stays only within a line of other text.

Left out is what a tag or attribute says is no article: navigation, headers, footers, asides,
forms, dialogs, hidden parts, scripts and styles. Names alone (class, id, role) leave an element
out if all parts of one name speak of page furniture (``cookie-notice``, but not ``share-price``),
and even then not ``<article>``, ``<main>``, what holds a ``<main>``, an element with a name of the article as
well, or one with most of the page's paragraph text, unless the article is surely elsewhere. Lists that are
all links are menus in front of the first prose of a container, and everywhere on a page that has no container.

Text: character references are decoded, white space within a block becomes one space, empty
blocks go, blocks are joined in page order by a line feed. ``<br>`` is white space.

Defined cases: a null or empty page, and one without text, give the empty text. Unclosed,
misnested and cut-off tags are allowed. page_id and url may be null or repeated; each row stands
for itself; of equally good containers the first wins. Other columns are dropped. Every
step takes time and memory in proportion to the page, however long or malformed; a batch holds
about ``BATCH_BYTES`` of pages, or one longer page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.runtime import bounded_batches

TAG = re.compile(r"</?([a-z][^\s/>]*)", re.I)
ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*"|'[^']*')*+>""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*+(?:=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Their content is no markup; without an end they run to the page's end.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Left out with all they hold, if they end.
SKIPPED = frozenset("noscript template svg select object canvas audio video annotation annotation-xml".split())
ENDS = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW | SKIPPED}
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NOT_TEXT = frozenset("nav aside footer menu dialog fieldset head".split())
#: Words in class, id or role that mark what is not the article.
UNWANTED = frozenset(
    "ad ads adbox adsbygoogle adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist complementary consent "
    "contentinfo cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination "
    "popup promo promoted promotion related replies respond responses search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that may stand beside one of these in the name of page furniture.
BESIDE = frozenset(
    "site page main content article post posts entry story blog user users reader readers list lists box boxes bar links link item items button "
    "buttons icons icon block section wrapper wrap container area panel form message overlay text title inner outer left right top bottom "
    "primary secondary tertiary global mobile desktop header head body group policy info by google sticky fixed floating small large a the of for and "
    "articles stories count thread reply replies field input slot unit slots units row col column columns js layer inline".split()
)
#: Of these, what marks an advert inside a line of text, on the tags below.
ADVERTS = frozenset("ad ads adbox adsbygoogle adslot advert advertisement advertising adverts promo promoted promotion sponsor sponsored".split())
INLINE = frozenset(("ins", "span"))
#: Parts of an item that are looked at to tell readers' comments.
LOOKED_AT = 60
#: Characters of paragraphs from which text is large, or an article found.
LEAST_PROSE = 200
WANTED = frozenset("article body content entry main post story text".split())
PARAGRAPHS = frozenset(("p", "pre", "td", "li", "dd"))
SCORED = PARAGRAPHS | frozenset(("blockquote", "div", "section", "article", "main"))
LISTS = frozenset(("ul", "ol", "dl", "div", "table"))
#: What a container hands on of its points to the one around it.
HANDED_ON = 0.5


class Control(str):
    """Text of a button: kept within a line of text, dropped where it stands alone."""

    __slots__ = ()


class Node:
    __slots__ = ("links", "parts", "parent", "points", "score", "size", "tag", "anchors", "unwanted", "suspect", "wanted", "prose", "main", "heading", "label")

    def __init__(self, tag: str, parent: Node | None, unwanted: bool = False, suspect: bool = False, wanted: bool = False, label: str = ""):
        self.tag, self.parent, self.unwanted, self.suspect, self.wanted, self.label = tag, parent, unwanted, suspect, wanted, label
        self.parts: list[Node | str] = []
        self.points, self.score, self.size, self.links, self.anchors, self.prose = 0.0, 0.0, 0, 0, 0, 0
        self.main, self.heading = tag == "main", tag in HEADINGS


def _furniture(word: str, in_article: bool) -> bool:
    """Whether every part of a name speaks of what stands around articles."""
    parts = [p for p in re.split("[_-]+", word) if p]
    # An article's own header holds its title.
    header = not in_article and WANTED.isdisjoint(parts)
    marks = [p in UNWANTED or (p == "header" and header) for p in parts]
    return any(marks) and all(m or p in BESIDE or p.strip("0123456789x") == "" for m, p in zip(marks, parts, strict=True))


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is surely not, by its names perhaps not, or likely, the article."""
    unwanted = tag in NOT_TEXT or (tag == "header" and not in_article)
    wanted = tag in ("article", "main")
    # Some sites put a form around the whole page.
    doubt, named = tag == "form", False
    for name, value in ATTRIBUTE.findall(attrs) if attrs and tag not in ("html", "body") else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "style":
            unwanted |= bool(re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", value))
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            unwanted = True
        elif name in ("class", "id", "role"):
            for word in value.split():
                bad = _furniture(word, in_article)
                doubt |= bad
                named |= not bad and not WANTED.isdisjoint(re.split("[_-]+", word))
    return unwanted, doubt and not wanted and not named, (wanted or named and not doubt) and not unwanted


def _classes(attrs: str) -> str:
    return next((value.strip("\"'") for name, value in ATTRIBUTE.findall(attrs) if name.lower() == "class"), "") if attrs else ""


def _advert(attrs: str) -> bool:
    """Whether an inline element's names are those of an advert."""
    for name, value in ATTRIBUTE.findall(attrs):
        if name.lower() in ("class", "id"):
            for word in value.strip("\"'").lower().split():
                if not ADVERTS.isdisjoint(re.split("[_-]+", word)) and _furniture(word, True):
                    return True
    return False


def scan(page: str) -> Iterator[tuple[str, str, str]]:
    """Text ("", text, ""), opening ("<", tag, attributes) and closing tags (">", tag, "") in order."""
    at, end, last = 0, len(page), page.rfind(">")
    # Quotes that never close make a tag end at its first ``>``; searches for their ends are rationed.
    ration, endless = 4 * end + 1000, set()
    held = 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            yield "", page[held:at], ""
            to = page.find("-->", at + 4)
            at = held = to + 3 if to >= 0 else end
            continue
        found = TAG.match(page, at)
        if found is None:
            if at + 1 < end and page[at + 1] in "!?/":
                yield "", page[held:at], ""
                to = page.find(">", at)
                at = held = to + 1 if to >= 0 else end
            else:
                at += 1
            continue
        yield "", page[held:at], ""
        if at > last:
            held = end
            break
        closes, tag, begin = page[at + 1] == "/", found[1].lower(), found.end()
        to = page.find(">", begin)
        if not closes and ration > 0 and ('"' in page[begin : to + 1] or "'" in page[begin : to + 1]):
            whole = ATTRIBUTES.match(page, begin)
            if whole:
                to = whole.end() - 1
            else:
                ration -= end - begin
        at = held = to + 1
        if closes:
            yield ">", tag, ""
        elif tag in ENDS and tag not in endless:
            over = ENDS[tag].search(page, at)
            if over:
                at = held = over.end()
            elif tag in RAW:
                at = held = end
            else:
                endless.add(tag)
        elif tag not in ENDS:
            yield "<", tag, page[begin:to]
    yield "", page[held:], ""


def parse(page: str) -> Node:
    """The tree of blocks; text in links counts in ``links`` as well as ``size``."""
    root = at = Node("html", None)
    opened: Counter[str] = Counter()
    in_link, button = False, None

    def leave() -> None:
        nonlocal at, button
        if at is button:  # one that never closes ends with the block around it
            button = None
        opened[at.tag] -= 1
        at = at.parent

    for kind, tag, attrs in scan(page):
        if not kind:
            if tag:
                at.parts.append(tag if button is None else Control(tag))
                if not tag.isspace():
                    n = len(" ".join(tag.split()))
                    at.size += n
                    if in_link or button is not None:
                        at.links += n
        elif tag == "a":
            in_link = kind == "<"
            at.anchors += in_link
        elif tag == "br":
            at.parts.append(" ")
        elif tag == "button":
            button = at if kind == "<" else None
        elif tag in INLINE and (opened[tag] or (kind == "<" and attrs and _advert(attrs))):
            # An advert within a line, and what is nested in it.
            if kind == "<":
                node = Node(tag, at, unwanted=True)
                at.parts.append(node)
                at = node
                opened[tag] += 1
            elif at.tag == tag:
                leave()
        elif tag == "html" or tag not in BLOCKS:
            continue
        elif kind == ">":
            in_link = False
            if opened[tag]:
                while at.tag != tag:
                    leave()
                leave()
        else:
            in_link = False
            if tag not in ("div", "ul", "li"):  # no button holds prose: this one was never closed
                button = None
            while at.tag == "p" or at.tag in HEADINGS or (at.tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                leave()
            if tag == "hr":
                at.parts.append(Node(tag, at))
                continue
            node = Node(tag, at, *_marks(tag, attrs, opened["article"] > 0), _classes(attrs))
            at.parts.append(node)
            at = node
            opened[tag] += 1
    return root


def _walk(node: Node) -> Iterator[Node]:
    """All nodes that may be text, parents first."""
    stack = [node]
    while stack:
        now = stack.pop()
        yield now
        stack += [p for p in reversed(now.parts) if isinstance(p, Node) and not p.unwanted]


def _own_prose(node: Node) -> int:
    return node.size - node.links if node.tag in SCORED and (node.tag == "p" or node.size >= 25) else 0


def settle(root: Node) -> None:
    """Decides which suspect elements are left out; each node is seen a fixed number of times."""
    nodes = list(_walk(root))
    if not any(n.suspect for n in nodes):
        return
    for node in nodes:
        node.prose = _own_prose(node)
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.prose += node.prose
            node.parent.main |= node.main
    found, stack, large = 0, [(root, False)], None
    while stack or large:
        if not stack:
            # Only one can hold most of the page. It is looked into if the rest has no article.
            large[0].suspect = False
            large[0].unwanted = found >= LEAST_PROSE
            if large[0].unwanted:
                break
            stack, large = [large], None
        node, inside = stack.pop()
        inside |= node.wanted
        found += _own_prose(node) * inside
        for part in node.parts:
            if not isinstance(part, Node) or part.unwanted:
                continue
            if not part.suspect or part.main:
                stack.append((part, inside))
            elif 2 * part.prose > root.prose and part.prose >= LEAST_PROSE:
                large = (part, inside)
            else:
                part.unwanted = True


def score(root: Node) -> None:
    """Gives every container its points, and every node its subtree's sizes."""
    nodes = list(_walk(root))
    for node in nodes:
        if node.tag in SCORED:
            own = " ".join(" ".join(p.split()) for p in node.parts if isinstance(p, str) and not p.isspace() and not isinstance(p, Control))
            if own and (node.tag == "p" or len(own) >= 25):
                # A block that holds text of its own beside other blocks is a container too.
                to = node.parent if node.tag in PARAGRAPHS and node.parent is not None else node
                to.points += 1 + own.count(",") + own.count("，") + min(len(own) / 100, 3)
    for node in reversed(nodes):
        up = node.parent
        if up is not None:
            up.points += HANDED_ON * node.points
            up.size += node.size
            up.links += node.links
            up.anchors += node.anchors
            up.heading |= node.heading
        few = 1 - node.links / max(node.size, 1)
        node.points *= few
        node.score = node.points + few * (0 if not node.wanted else 25 if node.tag in ("article", "main") else 10)


def _line(held: list[str]) -> str:
    """A block's text; none if it is all of buttons."""
    return "".join(held) if any(not isinstance(h, Control) and not h.isspace() for h in held) else ""


def _first_lines(item: Node) -> tuple[list[tuple[str, str]], int]:
    """The first two blocks (tag, text) of an item, and the parts looked at for them, ``LOOKED_AT`` at most."""
    out: list[tuple[str, str]] = []
    seen, stack, text = 0, [(item, iter(item.parts))], ""
    while stack and len(out) < 2 and seen < LOOKED_AT:
        now, parts = stack[-1]
        part = next(parts, None)
        seen += 1
        if isinstance(part, str):
            text += part
            continue
        if text.strip():
            out.append((now.tag, " ".join(text.split())))
        text = ""
        if part is None:
            stack.pop()
        elif not part.unwanted:
            stack.append((part, iter(part.parts)))
    return out, seen


def _comments(node: Node) -> bool:
    """Whether a list is one of readers' comments: two items or more of one kind, each with a short line without
    a full stop that names who or when (a link, a time, a number), and text behind it."""
    items = [p for p in node.parts if isinstance(p, Node) and not p.unwanted and p.tag not in HEADINGS]
    if len(items) < 2 or len({(p.tag, p.label) for p in items}) > 1 or items[0].tag not in ("li", "div", "article", "section"):
        return False
    for item in items[:20]:
        lines, _ = _first_lines(item)
        if len(lines) < 2 or lines[0][0] in HEADINGS:
            return False
        line = lines[0][1]
        if len(line) > 60 or line[-1] in ".!?:" or not (item.anchors or any(c.isdigit() for c in line)):
            return False
    return True


def _blocks(node: Node, menus: str) -> Iterator[str]:
    """Raw text of the blocks in order; lists of links are left out in front of the first prose
    (``menus`` is "front"), everywhere ("all") or nowhere (""), and comments behind prose. Recursion is replaced by a stack of iterators."""
    stack, held, prose = [(node, iter(node.parts))], [], False
    while stack:
        now, parts = stack[-1]
        for part in parts:
            if isinstance(part, str):
                held.append(part)
                continue
            if part.unwanted and part.tag in INLINE:
                continue
            yield _line(held)
            held = []
            listed = part.tag in LISTS and part.anchors >= 3 and part.links >= 0.8 * part.size
            if not part.unwanted and not (listed and (menus == "all" or menus == "front" and not prose)):
                if prose and part.tag in ("ol", "ul", "div", "section") and _comments(part):
                    continue
                prose |= part.tag == "p" and part.size >= 25 and part.links < 0.25 * part.size
                stack.append((part, iter(part.parts)))
                break
        else:
            yield _line(held)
            held = []
            stack.pop()


def _only_article(main: Node, marked: list[Node]) -> Node | None:
    """The one outermost article of a ``<main>`` that holds the best container and most of the text."""
    found, stack = [], [main]
    while stack and len(found) < 2:
        for part in stack.pop().parts:
            if isinstance(part, Node) and not part.unwanted:
                (found if part.tag == "article" else stack).append(part)
    if len(found) != 1 or found[0] not in marked or 2 * (found[0].size - found[0].links) < main.size - main.links:
        return None
    return found[0]


def _taken(root: Node) -> list[tuple[Node, str]]:
    """The elements whose text is the article, each with how link lists in it are treated."""
    best = max(_walk(root), key=lambda n: n.score)
    if best.score <= 0:
        return [(root, "all")]
    marked = [best] if best.tag in ("article", "main") else []
    up = best
    while (up := up.parent) is not None:
        if up.tag in ("article", "main"):
            marked.append(up)
    top = next((n for n in reversed(marked) if n.tag == "main"), marked[-1] if marked else best)
    only = _only_article(top, marked) if top.tag == "main" else None
    top = only or top
    while top.parent is not None and top.parent.parent is not None and top.parent.size == top.size:
        top = top.parent
    if top.parent is None or top.tag == "body":
        return [(top, "all")]
    out, front = [], True
    for n in top.parent.parts:
        if n is top:
            out.append((n, "" if marked else "front"))
            front = False
        elif isinstance(n, Node) and not n.unwanted and n.links < 0.25 * n.size and (front or only is None):
            # A sibling of the same kind need only be near the best; any other one needs points of its own.
            alike = n.tag == top.tag and n.label == top.label
            least = (0.2 if n.label else 0.5) * top.points if alike else max(10.0, 0.2 * top.points)
            prose = n.tag == "p" and n.size >= 80
            if 0 < least <= n.points or prose or (front and (n.tag == "p" or n.heading)):
                out.append((n, "front"))
    return out


def extract(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    root = parse(page)
    settle(root)
    score(root)
    lines = (" ".join(html.unescape(b).split()) for n, menus in _taken(root) for b in _blocks(n, menus))
    return "\n".join(line for line in lines if line)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html)."""
    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )
