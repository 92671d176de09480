"""HTML extraction by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import prepare, without

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Open elements that a start tag closes, up to a container of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
SCOPE = frozenset("article aside body blockquote details div fieldset figure footer header main nav section td th table form".split())

#: Elements whose content is never text of the page, and elements that are never article text.
UNSEEN = frozenset(
    "script style noscript template iframe svg canvas object audio video button select textarea head title datalist noembed noframes".split()
)
ASIDE = frozenset("nav footer aside dialog menu".split())
#: Words of class, id or role that mark such parts: one of the first is enough; of the others, and of words that may stand
#: beside them, a name has to be made as a whole.
TELLING_WORDS = frozenset(
    "ad ads adv adslot adsense advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos "
    "comment comments commenter commenters commentlist disqus replies sidebar sidebars share sharing sharebar social cookie "
    "cookies consent gdpr ccpa newsletter newsletters popup modal breadcrumb breadcrumbs footer navbar related recommended "
    "recommendations taboola outbrain paywall".split()
)
#: What the names of such parts begin or end with when they are written as one word.
TELLING_PARTS = re.compile(r"\A(?:adsby|advert|googlead|doubleclick|comments|sidebar|newsletter|cookie|breadcrumb|sharethis|addthis)|(?:comments?|sidebar|footer|newsletter|advert|navbar)\Z")
MARKS = TELLING_WORDS | frozenset(
    "promotion aside menu menus nav navigation banner notice notices alert subscribe subscription signup login overlay respond "
    "reply discussion widget widgets toolbar pagination pager masthead topbar skip contentinfo complementary search form".split()
)
BESIDE = frozenset(
    "list item items box block wrap wrapper container section area bar panel slot unit site global header body inner main "
    "primary secondary top bottom left right thread form links posts text content c js".split()
)
#: Names of wrappers that say what a page has, not what they are.
WRAPS = frozenset("has with without no hide layout".split())
#: Words with which menus are named in longer names; there they have to be lists of links, too.
MENUS = frozenset("menu menus nav navigation pagination pager toolbar search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset({"article", "main"})
WHOLE = frozenset({"html", "body", "article", "main"})
#: Elements that hold running text or its headings.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figcaption".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>",
    re.S,
)
#: A tag that ends at the first >, whatever its quotes.
SHORT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile(r"(?i)class|id|role|hidden|style")
UNSHOWN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
NAME_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Node:
    """An element. soft: 1 if its tag or a hiding attribute leaves it out, 2 if its names do so unless it holds the page's
    text or is a section of it, 3 if they do so only where it is a list of links."""

    __slots__ = ("tag", "parent", "parts", "soft", "names", "within", "core", "linked", "forms", "paragraphs", "articles", "chars", "tags", "link_chars", "link_tags", "prose", "density", "total", "start", "end")

    def __init__(self, tag: str, parent, soft: int = 0, within: int = 0, names: frozenset = frozenset()):
        self.tag, self.parent, self.parts, self.soft, self.within, self.names = tag, parent, [], soft, within, names


def _words(name: str) -> list[str]:
    return [w.lower() for w in NAME_PARTS.findall(name)]


def _aside(words: list[str], tag: str) -> int:
    """0, 2 or 3 (see Node) for the words of one class, id or role."""
    if any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE for w in words):
        return 2
    if tag in PROSE or any(w in WRAPS for w in words):
        return 0
    if any(w in TELLING_WORDS or TELLING_PARTS.search(w) for w in words):
        return 2
    return 3 if any(w in MENUS for w in words) else 0


def _soft(tag: str, attributes: str, inside: bool) -> tuple[int, frozenset]:
    """soft of an element, and the words of the names that decide it."""
    if tag in ASIDE or (tag == "header" and not inside):
        return 1, frozenset()
    found = [(2, "form")] if tag == "form" else []
    if attributes and tag not in WHOLE and TELLING.search(attributes):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and UNSHOWN.search(value)):
                return 1, frozenset()
            if key in ("class", "id", "role") and tag not in HEADINGS:
                named = [(_aside(words, tag), words) for words in map(_words, value.split())]
                found += [(k, w) for k, words in named if k for w in words]
    soft = min((k for k, _ in found), default=0)
    return soft, frozenset(w for k, w in found if k == soft)


def parse(page: str) -> Node:
    """The DOM of a page without unseen content: parts of a node are nodes and texts, in page order; time is linear.

    Once quotes in a tag do not balance up to the end of the page, tags of the rest end at their first >.
    """
    root = at = Node("#root", None)
    pos, last, balanced = 0, page.rfind(">"), True
    open_nodes: list[Node] = []
    places: dict[str, list[int]] = {}  # of each tag, where its open elements stand in open_nodes

    def pop() -> None:
        nonlocal at
        node = open_nodes.pop()
        places[node.tag].pop()
        at = node.parent

    def close(tag: str, stop: frozenset | set) -> None:
        """Close the last open element of a tag and all in it, unless an element of stop lies between."""
        own = places.get(tag)
        if own and all(own[-1] >= places[t][-1] for t in stop if places.get(t)):
            for _ in range(len(open_nodes) - own[-1]):
                pop()

    while pos < len(page):
        lt = page.find("<", pos)
        m = None
        if 0 <= lt <= last or page.startswith("<!", lt):
            m = TOKEN.match(page, lt) if balanced or page.startswith("<!", lt) else SHORT.match(page, lt)
            if m is None and balanced:
                m = SHORT.match(page, lt)
                balanced = m is None
        if m is None:
            end = len(page) if lt < 0 else lt + 1
            at.parts.append(html.unescape(page[pos:end]))
            pos = end
            continue
        if lt > pos:
            at.parts.append(html.unescape(page[pos:lt]))
        pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in VOID:
                close(tag, SCOPE if tag not in SCOPE else frozenset())
            continue
        attributes = m[3] or ""
        if tag in BLOCK and tag not in ("html", "body", "head"):
            close("p", SCOPE)
        if tag in CLOSES:
            for t in CLOSES[tag][0]:
                close(t, CLOSES[tag][1])
        if tag in VOID:
            at.parts.append(Node(tag, at, 0, at.within))
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[^>]*>", re.I).search(page, pos)
            body, pos = (page[pos : end.start()], end.end()) if end else (page[pos:], len(page))
            if tag not in UNSEEN:
                at.parts.append(html.unescape(body))
            continue
        if attributes.endswith("/") and tag in ("svg", "path"):
            continue
        soft, names = (1, frozenset()) if tag in UNSEEN else _soft(tag, attributes, at.within > 0)
        child = Node(tag, at, soft, at.within + (tag in ARTICLE), names)
        at.parts.append(child)
        places.setdefault(tag, []).append(len(open_nodes))
        open_nodes.append(child)
        at = child
    return root


def _in_order(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return order


def _shown(text: str) -> int:
    """Characters of a text other than white space."""
    return len("".join(text.split()))


def _stem(words) -> set[str]:
    return {w.rstrip("s") for w in words}


def _is_section(n: Node) -> bool:
    """Whether a named part inside an article is a section of it: its heading says the name, as ids of sections do, its own
    paragraphs (not those of items in it) are most of it, with few links and no form."""
    if n.tag != "section" or not n.within or n.forms or n.core < 120 or n.linked * 4 > n.core:
        return False
    kids = [p for p in n.parts if isinstance(p, Node)]
    heads = [k for k in kids if k.tag in HEADINGS]
    said = _stem(w for h in heads[:1] for p in _in_order(h) for t in p.parts if isinstance(t, str) for w in _words(t))
    return _stem(n.names) <= said and 2 * sum(k.core for k in kids if k.tag in PROSE) > n.core


def prune(root: Node) -> None:
    """Cut off menus, footers, adverts and the like.

    A part known by its names only stays if it is a section of the article, or what the page is about and no article or main
    element stands elsewhere: it holds such an element and most of the text outside links, or nearly all of it and all
    paragraphs. Names that say a menu among other words count where the part is mostly links.
    """
    order = _in_order(root)
    if not any(n.soft for n in order):
        return
    for n in reversed(order):
        kids = [p for p in n.parts if isinstance(p, Node)]
        own, link = sum(_shown(p) for p in n.parts if isinstance(p, str)), n.tag == "a"
        n.linked = own * link + sum(k.core * link + k.linked for k in kids)
        n.core = 0 if link else own + sum(k.core for k in kids if not k.soft)
        n.paragraphs = (n.tag == "p" and n.core > 0) + sum(k.paragraphs for k in kids if not k.soft)
        n.articles = (n.tag in ARTICLE) + sum(k.articles for k in kids if not k.soft)
        n.forms = (n.tag in ("form", "input")) + sum(k.forms for k in kids)
        if n.soft == 3:
            n.soft = 2 if n.linked > n.core else 0
    rest, paragraphs, articles = root.core, root.paragraphs, root.articles
    stack = [root]
    while stack:
        n = stack.pop()
        kept = []
        for p in n.parts:
            if isinstance(p, Node) and p.soft:
                alone = articles <= p.within - (p.tag in ARTICLE)
                own = p.articles > 0 and p.core > rest
                about = alone and (own or (p.core >= 200 and rest < 100 and not paragraphs))
                if p.soft == 1 or not (about or _is_section(p)):
                    continue
                rest, paragraphs, articles = rest + p.core, paragraphs + p.paragraphs, articles + p.articles
            kept.append(p)
        n.parts = kept
        stack += [p for p in reversed(kept) if isinstance(p, Node)]


def measure(root: Node) -> list[Node]:
    """Set chars, tags, link_chars, link_tags and density of every node and the sum of its children's densities; nodes in page order."""
    order = _in_order(root)
    for k, node in enumerate(order):
        node.start = k
    for node in reversed(order):
        kids = [p for p in node.parts if isinstance(p, Node)]
        node.end = kids[-1].end if kids else node.start
        node.chars = sum(_shown(p) for p in node.parts if isinstance(p, str)) + sum(k.chars for k in kids)
        node.tags = len(kids) + sum(k.tags for k in kids)
        node.prose = node.tag in PROSE or any(k.prose for k in kids)
        link = node.tag == "a"
        node.link_chars = node.chars if link else sum(k.link_chars for k in kids)
        node.link_tags = int(link) + sum(k.link_tags for k in kids)
    whole = root.link_chars / max(root.chars, 1)
    for node in reversed(order):
        c, t, lc, lt = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not c:
            node.density = node.total = 0.0
            continue
        base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + whole * c + math.e)
        node.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(base), 0.1)
        node.total = sum(p.density for p in node.parts if isinstance(p, Node))
    return order


def select(order: list[Node]) -> tuple[Node, Node, float]:
    """(subtree of the article, subtree of the largest density sum, threshold) of measured nodes in page order.

    The threshold is the least density on the path from the largest sum to the body. Subtrees that reach it are
    article text too; the smallest subtree around them and the largest sum is taken, not beyond the outermost article
    element around the sum, else the outermost main element. There, headings and paragraphs count as well.
    """
    best = max(order, key=lambda n: (n.total, n.density, -n.tags))
    path, node = [], best
    while node is not None:
        path.append(node)
        node = node.parent
    least = min((n.density for n in path if n.tag not in ("#root", "html")), default=0.0)
    bound = ([n for n in path if n.tag == "article"] or [n for n in path if n.tag == "main"] or path)[-1]
    low, high = best.start, best.end
    for n in order[bound.start : bound.end + 1]:
        dense = n.density >= least and n.total >= least and n.tag in BLOCK and n.link_chars * 2 < n.chars
        prose = n.tag in PROSE and bound.tag in ARTICLE
        if n.chars and (dense or prose) and not n.start <= best.start <= n.end:
            low, high = min(low, n.start), max(high, n.end)
    return next(n for n in path if n.start <= low and n.end >= high), best, least


def _thin(n: Node, top: Node, best: Node, least: float) -> bool:
    """Whether a part of the article is no text of it by its density.

    That is a list of links, or a container outside the largest sum without paragraphs or headings, less dense than
    all that leads to the largest sum.
    """
    if n is top or n.density >= least or n.start <= best.start <= n.end:
        return False
    if n.tag in ("ul", "ol", "dl") and n.link_tags > 1 and n.link_chars * 10 >= n.chars * 9:
        return True
    return n.tag in ("div", "section") and not n.prose and not best.start <= n.start <= best.end


def blocks(top: Node, best: Node, least: float) -> list[str]:
    """Texts of the blocks below a node, white space turned to single spaces."""
    out: list[list[str]] = [[]]
    stack: list = [top]
    while stack:
        x = stack.pop()
        if x is None:
            out.append([])
        elif isinstance(x, str):
            out[-1].append(x)
        elif x.tag == "br":
            out[-1].append(" ")
        elif not _thin(x, top, best, least):
            edge = x.tag in BLOCK
            stack += [None] * edge + x.parts[::-1] + [None] * edge
    got = (" ".join("".join(b).split()) for b in out)
    return [b for b in got if b]


def extract(page: str | None) -> str:
    """The main text of a page; "" if it has none."""
    if not page:
        return ""
    root = parse(page)
    prune(root)
    return "\n".join(blocks(*select(measure(root))))


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text and n_chars (code points): the main text of the whole html.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go; character
    references are decoded; a block's white space becomes single spaces; blocks are joined by \\n in page order. Null,
    empty and textless pages give "". Columns named text or n_chars are replaced, others pass through.
    """
    prepare(pages.sparkSession)

    @F.arrow_udf("string")
    def main_text(htmls: pa.Array) -> pa.Array:
        return pa.array([extract(h) for h in htmls.to_pylist()], pa.string())

    found = pages.withColumn("_text", main_text(F.col(column)))
    names = without(pages, "text", "n_chars").columns
    return found.select(*names, F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")
