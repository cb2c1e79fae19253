"""Main text of raw web pages by composite text density.

A page is read leniently into a tree. Menus, forms, scripts and the like are known by their element
or by a word of their class or id. For every other node the density is its characters per tag,
lowered by the share of link characters and tags:

    density = C/T * log(C/LC * T/LT) / log(ln(C/(C-LC) * LC + LCb/Cb * C + e))

with C characters, T tags, LC and LT those of links, and b for the whole body. The sum of its
children's densities singles out the node that holds the text; the smallest density on the path from
the body to that node is the threshold that other nodes must reach to belong to the text. Where the
chosen node lies in an ``article`` or ``main`` element, that element is the text. If it has no ``h1``, the
nearest one before it is its title, and what lies between belongs to the text.

Defined results: a null or empty page, or one without text, gives an empty text; repeated rows each
keep a row; unclosed elements end where a browser ends them, a tag without an end is text; pages of
any depth and length are read whole. Further columns of the pages are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed: elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
#: Elements with markup inside that a page does not show. One without an end of its own holds nothing.
EMBEDDED = set("noscript template svg canvas object".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mspace msub msup msubsup mfrac msqrt mroot mover munder munderover mstyle mpadded mphantom".split()
)
#: Elements between two text runs that do not part them.
UNSEEN = INLINE | set("script style template noscript".split())
NOT_TEXT = set("nav footer aside form button select option input fieldset dialog menu head audio video".split()) | RAW
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
#: Open elements that a start tag ends, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words of a class, id or role that mark what is not the article.
ASIDE = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice "
    "notices notification alert popup modal overlay newsletter subscribe signup share sharing social related recommended recommendations "
    "sidebar sidebars rail widget widgets comment comments commentlist disqus replies respond discussion menu menus nav navbar navigation "
    "breadcrumb breadcrumbs pagination pager masthead header footer copyright skip toolbar complementary contentinfo search login".split()
)
#: Further parts of names such as ``share-buttons`` or ``left-sidebar``.
FILLER = set(
    "area bar block bottom box btn button buttons container content entry form global group inner item items left link links list main outer "
    "page panel post posts primary right row secondary section site slot top unit wrap wrapper".split()
)
#: Those that are hardly ever what an article is about, in any element; as the first and as the last word of a longer name.
STRONG = set(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo cookie cookies consent gdpr popup modal newsletter "
    "subscribe signup sidebar sidebars comments commentlist disqus replies respond breadcrumb breadcrumbs pagination pager widget widgets".split()
)
FIRST = set(
    "ad ads adv advert adverts advertisement advertisements sponsored disqus comments commentlist newsletter sidebar sidebars promo popup modal "
    "breadcrumb breadcrumbs pagination".split()
)
LAST = STRONG - set("adv advertising sponsor consent cookie cookies gdpr respond widget widgets".split())
#: First words of names that say what a page is like, such as ``with-sidebar``.
STATES = set("has hide is no not show with without".split())
#: Words that as an id of a section of the article may be the anchor of its heading.
TOPICS = set(
    "alert banner comment copyright discussion footer header login menu menus navigation notice notices notification overlay promotion related "
    "search share sharing social".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that a less certain name leaves out inside an article.
CONTAINERS = set("div section article ul ol dl table center details header blockquote figure".split())
#: How far a name marks what is not the article.
PART_OF_NAME, TOPIC, WHOLE, CERTAIN = 1, 2, 3, 4

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
UNQUOTED_END = re.compile(r"=\s*[^\s\"'>]+$")


class Tree:
    """Nodes in the order of the page; text runs are nodes without a tag."""

    def __init__(self) -> None:
        self.parent: list[int] = [-1]
        self.tag: list[str] = ["body"]
        self.text: list[str] = [""]
        self.named: list[int] = [0]
        self.ended: set[int] = set()  # nodes with an end tag of their own

    def add(self, parent: int, tag: str, text: str = "", named: int = 0) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.text.append(text)
        self.named.append(named)
        return len(self.tag) - 1


def _named_aside(attributes: str) -> int:
    """How far class, id or role mark what is not the article: 0 not, a part of a name, a topic as the id, a whole name, certain."""
    most = 0
    for attribute, *values in NAMED.findall(attributes):
        for name in "".join(values).split():
            words = [word.lower() for word in PART.findall(name)]
            if not words or not any(word in ASIDE or word in STRONG for word in words):
                continue
            whole = all(word in ASIDE or word in STRONG or word in FILLER or word.isdigit() for word in words)
            if words[0] in STATES:
                level = PART_OF_NAME
            elif words[0] in FIRST or words[-1] in LAST or (whole and any(word in STRONG for word in words)):
                level = CERTAIN
            elif not whole:
                level = PART_OF_NAME
            else:
                level = TOPIC if attribute.lower() == "id" and len(words) == 1 and words[0] in TOPICS else WHOLE
            most = max(most, level)
    return most


def parse(page: str) -> Tree:
    tree, stack, at = Tree(), [0], 0

    def text(run: str) -> None:
        if run:
            tree.add(stack[-1], "", html.unescape(run))

    def end(names: set[str], beyond: set[str], own: bool = False) -> None:
        """Close down to the nearest open element of these names, unless one of ``beyond`` is nearer."""
        for depth in range(len(stack) - 1, 0, -1):
            if tree.tag[stack[depth]] in names:
                if own:
                    tree.ended.add(stack[depth])
                del stack[depth:]
                return
            if tree.tag[stack[depth]] in beyond:
                return

    while True:
        found = TOKEN.search(page, at)
        if not found:
            text(page[at:])
            return tree
        text(page[at : found.start()])
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            continue
        name = name.lower()
        if name in ("html", "body"):
            continue
        if closing:
            end({name}, {"td", "th", "table"} - {name} if name in ("p", "li", "div", "span", "a", "b") else set(), own=True)
            continue
        if name in CLOSES_P:
            end({"p"}, {"td", "th", "table", "li", "div", "article", "section", "main", "button", "blockquote", "aside", "footer", "header", "nav"})
        elif name == "body":
            end({"head"}, set())
        if name in ENDS:
            end(*ENDS[name])
        node = tree.add(stack[-1], name, named=_named_aside(attributes) if attributes and "=" in attributes else 0)
        empty = attributes.endswith("/") and not UNQUOTED_END.search(attributes)  # the slash may belong to a value
        if name in RAW and not (empty and any(tree.tag[k] in ("svg", "math") for k in stack)):
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
        elif name not in VOID and not empty:
            stack.append(node)


def _bulk(tree: Tree, shown: list[bool]) -> list[int]:
    """Characters of each node that are not in links, of nodes that are shown."""
    count = len(tree.tag)
    chars = [0] * count
    for k in range(count - 1, 0, -1):
        if not tree.tag[k]:
            chars[k] = len(" ".join(tree.text[k].split()))
        if shown[k] and tree.tag[k] != "a":
            chars[tree.parent[k]] += chars[k]
    return chars


def _ends(tree: Tree) -> list[int]:
    """The node after the last one below each node."""
    ends = list(range(1, len(tree.tag) + 1))
    for k in range(len(tree.tag) - 1, 0, -1):
        ends[tree.parent[k]] = max(ends[tree.parent[k]], ends[k])
    return ends


def _titles(tree: Tree, ends: list[int]) -> list[int]:
    """The ``h1`` nodes with text of their own, not only a link."""
    found = []
    for k, tag in enumerate(tree.tag):
        if tag == "h1":
            linked = [j for j in range(k, ends[k]) if tree.tag[j] == "a"]
            if any(tree.text[j].strip() and not any(a < j < ends[a] for a in linked) for j in range(k, ends[k])):
                found.append(k)
    return found


def _left_out(tree: Tree) -> list[bool]:
    """Whether a node belongs to menus, notices and the like.

    A class or id does not take out the article itself: what holds a ``h1``, ``main`` or ``article``, or,
    on a page without the latter two, most of the text outside links (nearly all of it, if the whole name
    says so). Inside an article a certain name takes out any element but a heading, and a less certain one
    containers only. A header outside the article stays if it has no menu and the page's only title.
    """
    count, ends = len(tree.tag), _ends(tree)
    titles = _titles(tree, ends)
    holds = [False] * count
    marked = False
    inside = [False] * count
    shown = [True] * count
    for k in range(1, count):
        inside[k] = inside[tree.parent[k]] or tree.tag[k] in ("article", "main")
        marked = marked or tree.tag[k] == "main" or (tree.tag[k] == "article" and not tree.named[k])
        head = tree.tag[k] == "header" and not inside[tree.parent[k]]
        if head and titles and all(k < j < ends[k] for j in titles) and not any(tree.tag[j] == "nav" for j in range(k, ends[k])):
            head = False
        shown[k] = not (tree.tag[k] in NOT_TEXT or (tree.tag[k] in EMBEDDED and k in tree.ended) or head)
    for k in range(count - 1, 0, -1):
        if tree.tag[k] in ("h1", "main") or (tree.tag[k] == "article" and tree.named[k] < TOPIC):
            holds[k] = True
        if holds[k]:
            holds[tree.parent[k]] = True
    chars = _bulk(tree, shown)
    out = [False] * count
    for k in range(1, count):
        up, named, tag = tree.parent[k], tree.named[k], tree.tag[k]
        if tag in HEADINGS:
            goes = False
        elif inside[up]:
            goes = named == CERTAIN or (tag in CONTAINERS and named >= (WHOLE if tag == "section" else TOPIC))
        else:
            goes = named >= (TOPIC if tag == "p" or tag in INLINE else PART_OF_NAME)
        if goes and not marked and chars[k] > (0.8 if named >= TOPIC else 0.5) * chars[0]:
            goes = False
        out[k] = out[up] or not shown[k] or (goes and not holds[k])
    return out


def densities(tree: Tree, out: list[bool]) -> tuple[list[float], list[float]]:
    """Composite density of each node, and the sum of its children's."""
    count = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * count, [0] * count, [0] * count, [0] * count
    for k in range(count - 1, -1, -1):
        if out[k]:
            continue
        if not tree.tag[k]:
            chars[k] = len(" ".join(tree.text[k].split()))
        elif tree.tag[k] == "a":
            link_chars[k], link_tags[k] = chars[k], link_tags[k] + 1
        if k:
            up = tree.parent[k]
            chars[up] += chars[k]
            tags[up] += tags[k] + bool(tree.tag[k])
            link_chars[up] += link_chars[k]
            link_tags[up] += link_tags[k]
    share = link_chars[0] / max(1, chars[0])
    density, total = [0.0] * count, [0.0] * count
    for k in range(count - 1, -1, -1):
        c, t, lc, lt = chars[k], max(1, tags[k]), link_chars[k], link_tags[k]
        if out[k] or not c:
            continue
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        density[k] = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1e-9) / math.log(base) if base > 1.0 + 1e-9 else c / t * math.log(max(1.0, c * t))
        if k:
            total[tree.parent[k]] += density[k]
    return density, total


def chosen(tree: Tree) -> list[bool]:
    """Whether a node belongs to the main text."""
    count = len(tree.tag)
    out = _left_out(tree)
    density, total = densities(tree, out)
    best = max((k for k in range(count) if not out[k] and tree.tag[k]), key=lambda k: (total[k], -k))
    path = [best]
    while path[-1]:
        path.append(tree.parent[path[-1]])
    threshold = min(density[k] for k in path)
    roots = [k for k in path if tree.tag[k] in ("article", "main")]
    root = roots[-1] if roots else best
    within, above = [False] * count, set(path)
    for k in range(count):
        up = tree.parent[k]
        if out[k]:
            continue
        if k == root or (k and within[up]):
            within[k] = True
        elif not roots and k not in above and up in above and density[k] >= threshold > 0:
            within[k] = True
    _add_title(tree, out, within, root)
    return within


def _add_title(tree: Tree, out: list[bool], within: list[bool], root: int) -> None:
    """The nearest title before a text without one, and the blocks between, if they are not mostly links.

    Where the text begins with a heading of its own and a menu lies between, the title is the site's.
    """
    ends = _ends(tree)
    if any(within[k] and tree.tag[k] == "h1" for k in range(len(tree.tag))):
        return
    before = [k for k in _titles(tree, ends) if k < root and not out[k]]
    if not before:
        return
    title = before[-1]
    first = next((k for k in range(root, ends[root]) if within[k] and tree.text[k].strip()), root)
    up = first
    while up > root and tree.tag[up] not in HEADINGS:
        up = tree.parent[up]
    if up > root and any(out[k] and tree.tag[k] for k in range(ends[title], root)):
        return
    k = title
    while k < root:
        if ends[k] > root or out[k]:  # around the text, or left out
            k = k + 1 if ends[k] > root else ends[k]
            continue
        runs = [(j, len(" ".join(tree.text[j].split()))) for j in range(k, ends[k]) if not out[j] and tree.text[j]]
        linked = [j for j in range(k, ends[k]) if tree.tag[j] == "a"]
        in_links = sum(n for j, n in runs if any(a < j < ends[a] for a in linked))
        if k == title or 2 * in_links <= sum(n for _, n in runs):
            for j in range(k, ends[k]):
                within[j] = not out[j]
        k = ends[k]


def main_text(page: str) -> str:
    """The main text: blocks in page order, white space and block ends as one space."""
    tree = parse(page)
    if len(tree.tag) == 1:
        return ""
    within = chosen(tree)
    words: list[str] = []
    last = 0
    for k in range(1, len(tree.tag)):
        if tree.tag[k]:
            continue
        if within[k]:
            if last and _apart(tree, last, k):
                words.append(" ")
            words.append(tree.text[k])
            last = k
    return " ".join("".join(words).split())


def _apart(tree: Tree, before: int, after: int) -> bool:
    """Whether a block begins or ends between two text runs."""
    if any(tree.tag[k] and tree.tag[k] not in UNSEEN for k in range(before + 1, after)):
        return True
    ups = set()
    k = tree.parent[before]
    while k >= 0:
        ups.add(k)
        if tree.tag[k] not in INLINE:
            break
        k = tree.parent[k]
    k = tree.parent[after]
    while k >= 0 and tree.tag[k] in INLINE and k not in ups:
        k = tree.parent[k]
    return k not in ups


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page.as_py() or "") for page in batch.column(2)]
        sizes = pa.array([len(t) for t in texts], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of pages (page_id, url, html)."""
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return source.mapInArrow(_extract, schema)
