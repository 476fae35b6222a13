"""Main-text extraction by tree scoring.

A page is read into a tree of elements.  Every paragraph-like block passes points for its
length and commas to its ancestors, halved at each step up, and each element's points are
discounted by its link density.  The best element and those of its siblings that score well,
or are prose themselves, are the article, with headings, lists, quotes, tables and bare text beside
it where no article element marks its bounds; boilerplate elements inside are left out.  What looks
like boilerplate but holds the page's only article element, or most of the prose of a page without
one, is a wrapper and stays.

Defined results: a null or empty page has an empty text.  A page where nothing scores (no block of
25 characters) keeps all of its text but boilerplate and blocks of links.  Pages are read one by one; repeated rows repeat and an empty table gives none.  Ties in points go to the
deeper element, then to the earlier one.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa

from .common import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<(?![a-zA-Z/]|/[a-zA-Z])|</(?![a-zA-Z]))",
    re.S,
)
#: a tag with a quote that never ends stops at the next mark
_BROKEN = re.compile(r"<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>]*)(?:>|\Z)")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPACE = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video".split())
#: elements that never hold article text
_CHROME = frozenset("head nav header footer aside form button select menu dialog fieldset".split())
_BLOCK = frozenset(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html li main ol p pre "
    "section summary table tbody td tfoot th thead tr ul".split()
)
_PARAGRAPH = frozenset("p pre blockquote li td dd h1 h2 h3 h4 h5 h6 div section article figcaption".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: blocks that are kept beside an article that no element marks, however short
_SHORT = _HEADING | frozenset("ul ol dl blockquote pre table figure".split())
#: an open element of the first kind ends where one of the second kind opens
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: a stray end of the second kind does not reach out of an element of the first kind
_WALL, _INSIDE = frozenset("table article main".split()), frozenset("a b em i li p span strong".split())
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|advertisement|banner|breadcrumbs?|comments?|cookie|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|pagination|popup|promo|promoted|related|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
#: long threads outweigh their article: these are wrappers only around a single one
_THREAD = re.compile(r"(?:^|[\s_-])(?:comments?|disqus)(?:$|[\s_-])", re.I)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert".split())


class Node:
    __slots__ = ("tag", "up", "kids", "bad", "unseen", "thread", "points", "n", "linked", "commas", "depth", "order")

    def __init__(self, tag, up, bad, order):
        self.tag, self.up, self.bad, self.order = tag, up, bad, order
        self.unseen = self.thread = False
        self.kids, self.points, self.n, self.linked, self.commas = [], 0.0, 0, 0, 0
        self.depth = up.depth + 1 if up else 0


def _is_unseen(tag, attrs):
    """Whether a reader never sees the element as text."""
    if tag in ("head", "select", "button", "menu"):
        return True
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return " hidden" in attrs.lower() and bool(re.search(r"\shidden(?:\s|=|/|$)", attrs, re.I))


def _is_thread(attrs):
    return any(name.lower() in ("class", "id") and _THREAD.search(a or b or c) for name, a, b, c in _ATTR.findall(attrs))


def _is_bad(tag, attrs):
    if tag in _CHROME:
        return True
    if not attrs or tag in ("html", "body", "article", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id") and _BAD_NAME.search(value):
            return True
        if name == "role" and value.lower() in _BAD_ROLE:
            return True
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return " hidden" in attrs.lower() and bool(re.search(r"\shidden(?:\s|=|/|$)", attrs, re.I))


class _Open:
    """The open elements from the root down, with where each tag and the nearest block stand: nothing is searched."""

    def __init__(self, root):
        self.path, self.blocks, self.walls, self.at = [root], [], [], {}

    def push(self, node):
        depth = len(self.path)
        self.path.append(node)
        self.at.setdefault(node.tag, []).append(depth)
        if node.tag in _BLOCK:
            self.blocks.append(depth)
        if node.tag in _WALL:
            self.walls.append(depth)

    def cut(self, depth):
        """Close the element at ``depth`` and all below it."""
        while len(self.path) > depth:
            node = self.path.pop()
            for stack in (self.at[node.tag], self.blocks, self.walls):
                if stack and stack[-1] == len(self.path):
                    stack.pop()

    def close(self, tag):
        """Close the nearest element of the tag; an inline one is not sought outside a table or an article."""
        found = self.at.get(tag)
        if found and not (tag in _INSIDE and self.walls and self.walls[-1] > found[-1]):
            self.cut(found[-1])


def parse(page):
    """(root, elements in page order); text is a str child.  Unclosed tags end with their parents."""
    root = Node("#root", None, False, 0)
    nodes, at, size = [root], 0, len(page)
    open_, endless = _Open(root), set()
    while at < size:
        m = _TOKEN.match(page, at) or _BROKEN.match(page, at)
        at = m.end()
        here = open_.path[-1]
        tag = m["tag"]
        if tag is None:
            text = m["text"] or m["cdata"]
            if text:
                here.kids.append(html.unescape(text) if m["text"] else text)
            continue
        tag = tag.lower()
        if m["close"]:
            open_.close(tag)
            continue
        if tag in _RAW:
            end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None:
                endless.add(tag)
            if end or tag in ("script", "style", "textarea", "title"):
                at = end.end() if end else size
                if tag not in ("script", "style", "title"):
                    here.kids.append(" ")
                continue
        if tag in _BLOCK and open_.blocks:  # a block ends an open paragraph, with the inline elements in it
            depth = open_.blocks[-1]
            if open_.path[depth].tag == "p" or open_.path[depth].tag in _HEADING and tag in _HEADING:
                open_.cut(depth)
        here = open_.path[-1]
        if tag in _CLOSES.get(here.tag, ()):
            open_.cut(len(open_.path) - 1)
            here = open_.path[-1]
        node = Node(tag, here, _is_bad(tag, m["attrs"]), len(nodes))
        if node.bad:
            node.unseen, node.thread = _is_unseen(tag, m["attrs"]), _is_thread(m["attrs"])
        nodes.append(node)
        here.kids.append(node)
        if tag not in _VOID and not m["attrs"].endswith("/"):
            open_.push(node)
    return root, nodes


def _clear_wrappers(nodes):
    """Where no article element is in the open: take the mark from elements around one, or around most of the prose.

    Prose is the text of paragraphs outside links and outside what is never seen.
    """
    if not any(node.bad and not node.unseen for node in nodes):
        return
    flags = []  # by order: (below a marked element, below an unseen one, below a link, in a paragraph)
    prose, articles = [0] * len(nodes), [0] * len(nodes)
    outside = False
    for node in nodes:
        bad, unseen, link, block = flags[node.up.order] if node.up is not None else (False, False, False, False)
        bad, unseen, link = bad or node.bad, unseen or node.unseen, link or node.tag == "a"
        block = node.tag in _PARAGRAPH or block and node.tag not in _BLOCK
        flags.append((bad, unseen, link, block))
        if block and not unseen and not link:
            prose[node.order] = sum(len(kid.strip()) for kid in node.kids if isinstance(kid, str))
        if node.tag in ("article", "main") and not unseen:
            articles[node.order] = 1
            outside = outside or not bad
    if outside:  # a marked article in the open: what is marked elsewhere stays so, however long
        return
    for node in reversed(nodes):  # children come after their parents
        if node.up is not None:
            prose[node.up.order] += prose[node.order]
            articles[node.up.order] += articles[node.order]
    for node in nodes:
        if node.bad and not node.unseen:
            held = articles[node.order] > 0
            most = prose[node.order] * 2 > prose[0]
            node.bad = not (held and most and articles[node.order] <= 2 if node.thread else held or most)


def _measure(nodes):
    """Characters and linked characters below each element, and the blocks' own points."""
    for node in reversed(nodes):
        own = 0
        inline = True
        for kid in node.kids:
            if isinstance(kid, str):
                own += len(kid.strip())
                node.commas += kid.count(",")
            elif not kid.bad:
                node.n += kid.n
                node.linked += kid.linked
                if kid.tag not in _BLOCK:
                    node.commas += kid.commas
                inline = inline and kid.tag not in _BLOCK
        node.n += own
        if node.tag == "a":
            node.linked = node.n
        if node.tag in _PARAGRAPH and (inline or own > 25) and not node.bad:
            length = node.n if inline else own
            if length >= 25:
                gained = (1 + node.commas + min(length / 100, 3)) * (1 - node.linked / max(node.n, 1))
                share, up = 1.0, node.up
                while up is not None and share > 0.1:
                    up.points += gained * share
                    share /= 2
                    up = up.up
                if node.tag in ("article", "section", "div", "td"):
                    node.points += gained


def _blocks(node, out):
    """Append the element's blocks of text, leaving boilerplate out."""
    run = []

    def flush():
        text = _SPACE.sub(" ", "".join(run)).strip()
        run.clear()
        if text:
            out.append(text)

    stack = [(node, 0)]
    while stack:
        here, k = stack.pop()
        if k == 0 and here.tag in _BLOCK:
            flush()
        while k < len(here.kids):
            kid = here.kids[k]
            k += 1
            if isinstance(kid, str):
                run.append(kid)
            elif kid.tag in ("br", "hr"):
                run.append(" ")
            elif not kid.bad:
                stack.append((here, k))
                stack.append((kid, 0))
                break
        else:
            if here.tag in _BLOCK:
                flush()
    flush()


def _short_page(root, nodes):
    """All text of a page without prose that scores, or of its marked article, but for blocks that are links for the most part."""
    marked = [n for n in nodes if n.tag in ("article", "main") and not n.bad]
    for node in nodes:  # parents come first
        menu = node.tag in _BLOCK and node.tag not in ("html", "body", "article", "main") and node.linked > 0 and node.linked * 2 >= node.n
        node.bad = node.bad or menu or (node.up is not None and node.up.bad)
    out = []
    _blocks((marked or [root])[0], out)
    return "\n".join(out)


def main_text(page):
    """The article's text: one line for each block."""
    if not page:
        return ""
    root, nodes = parse(page)
    _clear_wrappers(nodes)
    for node in nodes:  # parents come first
        node.bad = node.bad or (node.up is not None and node.up.bad)
    _measure(nodes)
    open_ = [n for n in nodes if not n.bad and n.tag not in ("p", "li", "#root", "html") and n.tag not in _HEADING and n.points > 0]
    if not open_:
        return _short_page(root, nodes)
    score = lambda n: n.points * (1 - n.linked / max(n.n, 1))
    best = max(open_, key=lambda n: (score(n), n.depth, -n.order))
    holder = best
    while holder is not None and holder.tag not in ("article", "main"):
        holder = holder.up
    if holder is not None:  # a marked article is not left in pieces
        best = holder
    least = max(2.0, 0.2 * score(best))
    out = []
    for kid in best.up.kids if best.up is not None and best.tag not in ("body", "main") else [best]:
        if isinstance(kid, str):
            line = _SPACE.sub(" ", kid).strip()
            if line and holder is None:
                out.append(line)
            continue
        if kid.bad:
            continue
        density = kid.linked / max(kid.n, 1)
        if holder is None and density < 0.25 and kid.n > 0 and kid.tag in _SHORT:  # belongs to the blocks beside it
            _blocks(kid, out)
            continue
        prose = kid.tag == "p" and (kid.n > 80 and density < 0.25 or kid.n > 0 and density == 0 and kid.points == 0 and kid.n > 40)
        if kid is best or score(kid) >= least or prose:
            _blocks(kid, out)
    return "\n".join(out)


def extract_text(pages, id_col="page_id", url_col="url", html_col="html"):
    """id, url, text and n_chars of every page."""
    src = pages.select(id_col, url_col, html_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema[:2])

    def run(batches):
        for batch in batches:
            # a few pages at a time: the trees of a whole batch are never held together
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=[id_col, url_col, "text", "n_chars"])

    return src.mapInArrow(run, f"{fields}, text string, n_chars long")


def query(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))
