"""Main text of web pages: page structure, and removal of a site's template.

Every element's subtree has a hash of its tags and texts. Spark counts on how many pages of a
host each hash occurs; subtrees that recur on many pages of their host are the site's
template and are deleted, whatever their names. Elements that name themselves as menus,
adverts, comments and the like are left out as well.
"""

from __future__ import annotations

import hashlib
import html
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metaquarry.llm.common import query, stored, table
from metaquarry.llm.url_cascade import url_parts
from metaquarry.session import ship_package

#: A subtree is template if it is on this many pages of its host, and on this share of them.
TEMPLATE_PAGES, TEMPLATE_SHARE = 8, 0.3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
#: Elements that never hold main text.
DROPPED = frozenset(
    "head nav footer aside form script style noscript template iframe object embed svg math canvas "
    "button select option textarea input label fieldset dialog menu audio video map title".split()
)
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
    "pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
#: What a start tag closes, if it is open within the nearest of the barriers.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_NAMES = (
    "ad|ads|adv|adsense|adbox|adslot|[a-z]*advert[a-z]*|[a-z]*banner|breadcrumbs?|"
    "[a-z]*comments?|commentlist|respond|responses|repl(?:y|ies)|disqus|discussion|consent|cookie[a-z]*|gdpr|"
    "[a-z]*footer|foot|[a-z]*header|masthead|[a-z]*menus?|[a-z]*nav|navbar|[a-z]*navigation|topbar|toolbar|"
    "modal|popup|overlay|newsletter|subscribe|subscription|signup|login|[a-z]*notices?|alert|notification|"
    "disclaimer|copyright|pagination|pager|paywall|promo|promoted|promotion|related|recommended|"
    "recommendations|share|sharing|[a-z]*sidebars?|skip|social|sponsor|sponsored|tags|teaser|widgets?|hidden|search"
)
_BAD_NAME = re.compile(rf"(?:^|[^a-z0-9])(?:{_NAMES})(?=$|[^a-z])")
#: Names that tell of a page's state or parts ('has-sidebar', 'overflow-hidden', 'comments-open').
_STATE_NAME = re.compile(
    r"(?<![\w-])(?:has|with|without|no|not|is|overflow)-[\w-]+"
    r"|(?<![\w-])[\w-]+-(?:open|closed|enabled|disabled|hidden|visible|results)(?![\w-])"
)
#: Names of what is never a wrapper of main text, however long it is.
#: Elements that a class or id can name; a paragraph, heading or item of an article cannot be.
_NAMEABLE = frozenset(
    "article body center details div dl figure fieldset form frameset header footer html nav aside ol section "
    "table tbody td th tr ul".split()
)
_PROSE_NAME = re.compile(
    r"comment|respond|responses|repl(?:y|ies)|disqus|discussion|consent|cookie|gdpr|modal|popup|newsletter|"
    r"subscri|notice|disclaimer|copyright|paywall|foot|related|recommend|teaser|promo|sponsor|advert"
)
STATE, PART, PROSE = 1, 2, 3
_BAD_ROLE = frozenset(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A tag up to its end. A quote opens a value only right after ``=``, as in browsers; any other
#: quote is a character like the rest. Nothing is tried twice, so a tag is read in one go.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>", re.S)
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
_SPACE = re.compile(r"\s+")


class Node:
    """An element; ``parts`` are texts (str) and elements (Node) in page order."""

    __slots__ = (
        "tag", "bad", "named", "hidden", "main", "parts", "hash", "length", "visible", "prose", "holds"
    )

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.parts, self.hash, self.length = tag, [], 0, 0
        self.bad, self.hidden, self.main = tag in DROPPED, False, tag == "main"
        self.named, self.visible, self.prose, self.holds = 0, 0, 0, False
        if not attributes.strip():
            return
        for name, *values in _ATTR.findall(attributes):
            name, value = name.lower(), html.unescape("".join(values)).lower()
            if name in ("class", "id"):
                self.named = max(self.named, _name_kind(tag, value.replace("_", "-")))
            elif name == "role":
                self.bad |= value in _BAD_ROLE
                self.main |= value == "main"
            elif name == "hidden" or (name == "aria-hidden" and value == "true"):
                self.hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                self.hidden = True
        if self.main:
            self.named = 0


def _name_kind(tag: str, value: str) -> int:
    """0 for a class or id that says nothing, else STATE, PART or PROSE."""
    if tag not in _NAMEABLE or tag in ("html", "body") or tag == "article" and "comment" not in value or not _BAD_NAME.search(value):
        return 0
    rest = _STATE_NAME.sub(" ", value)
    if not _BAD_NAME.search(rest):
        return 0 if tag == "article" else STATE
    return PROSE if tag == "article" or _PROSE_NAME.search(rest) else PART


class _Open:
    """The open elements, with the places of each tag, so that no end tag searches them."""

    def __init__(self, root: Node):
        self.nodes, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names) -> int:
        """Place of the innermost open element of these names, 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.nodes) > place:
            node = self.nodes.pop()
            self.places[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def close(self, names, barriers=()) -> None:
        """Close the innermost element of ``names`` unless one of ``barriers`` is inside it."""
        place = self.last(names)
        if place and place > self.last(barriers):
            self.cut(place)

    def end(self, tag: str) -> None:
        """An end tag; inline ones do not close blocks, and one without a start is ignored."""
        place = self.last((tag,))
        if place and (tag in BLOCK or place > self.blocks[-1]):
            self.cut(place)


_P_BARRIERS = ("article", "main", "section", "div", "td", "th", "li", "body", "table", "blockquote", "aside")
#: What starts like a tag but is none, and what ends it.
_MARKUP = {"<!--": "-->", "<![CDATA[": "]]>", "<!": ">", "<?": ">"}


def parse(page: str) -> Node:
    """The element tree of a page; unclosed and misnested tags are repaired as browsers do.

    One pass from front to back. A tag without an end makes the rest of the page text. Where a
    quoted value never ends before the page does, tags from there on end at the next ``>``.
    """
    root = Node("html")
    stack, at, n, pattern = _Open(root), 0, len(page), _TAG

    def text(value: str) -> None:
        if value:
            stack.nodes[-1].parts.append(value)

    while at < n:
        start = page.find("<", at)
        if start < 0 or start == n - 1:
            text(html.unescape(page[at:]))
            break
        text(html.unescape(page[at:start]))
        at = start
        opened = next((x for x in _MARKUP if page.startswith(x, start)), None)
        if opened:
            stop = page.find(_MARKUP[opened], start + len(opened))
            at = n if stop < 0 else stop + len(_MARKUP[opened])
            if opened == "<![CDATA[":
                text(page[start + len(opened) : n if stop < 0 else stop])
            continue
        if not (page[start + 1].isascii() and page[start + 1].isalpha() or page[start + 1] == "/"):
            text("<")
            at = start + 1
            continue
        m = pattern.match(page, start)
        if not m and page[start + 1] == "/" and not page[start + 2 : start + 3].isalpha():
            text("<")
            at = start + 1
            continue
        if not m and pattern is _TAG:
            pattern = _PLAIN_TAG
            m = pattern.match(page, start)
        if not m:
            text(html.unescape(page[start:]))
            break
        at = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        empty = attributes.endswith("/")
        if closing:
            stack.end(tag)
        elif tag == "br":
            text("\n")
        elif tag in ("html", "body"):
            if tag == "body":
                stack.close(("head",))
                root.bad = False
        else:
            if tag in BLOCK:
                stack.close(("p",), _P_BARRIERS)
            if stack.nodes[-1].tag == "head" and tag in BLOCK:
                stack.close(("head",))
            if tag in _CLOSES:
                stack.close(*_CLOSES[tag])
            node = Node(tag, attributes)
            stack.nodes[-1].parts.append(node)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                if tag in ("textarea", "title"):
                    node.parts.append(html.unescape(page[at : end.start() if end else n]))
                at = end.end() if end else n
            elif tag not in VOID and not empty:
                stack.push(node)
    _measure(root)
    return root


def _walk(root: Node) -> list[Node]:
    """All elements, each after its parent."""
    out = [root]
    for node in out:
        out.extend(p for p in node.parts if isinstance(p, Node))
    return out


def _measure(root: Node) -> None:
    """Hash of every subtree, length of its text, and which names count, without recursion."""
    nodes = _walk(root)
    for node in reversed(nodes):
        h = hashlib.blake2b(node.tag.encode(), digest_size=8)
        for p in node.parts:
            if isinstance(p, Node):
                h.update(p.hash.to_bytes(8, "big", signed=True))
                node.length += p.length
                if not (p.bad or p.hidden):
                    node.visible += p.visible
                    if p.named < PROSE:
                        node.prose += p.visible if p.tag in ("p", "pre", "blockquote") else p.prose
                        node.holds |= p.holds or p.main or p.tag == "article"
            else:
                words = " ".join(p.split())
                h.update(b"\0" + words.encode("utf-8", "surrogatepass"))
                node.length += len(words)
                node.visible += len(words)
        node.hash = int.from_bytes(h.digest(), "big", signed=True)
    half = root.visible / 2
    for node in nodes:
        # a name does not delete what wraps most of the page
        wraps = node.named < PROSE and node.visible > half
        node.bad |= bool(node.named) and not (wraps and (node.named == STATE or node.holds or node.prose > half))


def subtree_hashes(root: Node) -> list[int]:
    """Distinct hashes of the subtrees that hold text and are not left out anyway."""
    found, todo = set(), [root]
    while todo:
        node = todo.pop()
        if node.bad or node.hidden:
            continue
        if node.length and node.tag not in ("html", "body", "article", "main"):
            found.add(node.hash)
        todo.extend(p for p in node.parts if isinstance(p, Node))
    return list(found)


def _gather(root: Node, template: frozenset[int]) -> list[str]:
    """The blocks of text below ``root``."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    end = object()
    inside_header = 0
    todo: list = [root]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            if inside_header <= 0:
                line.append(p)
            continue
        if isinstance(p, tuple):
            kind, value = p
            if kind is end:
                if value != "inline":
                    flush()
                if value == "header":
                    inside_header = 0
                elif value == "heading" and inside_header < 0:
                    inside_header = 1
            continue
        if p is not root and (p.bad or p.hidden or p.hash in template and p.tag not in ("article", "main")):
            continue
        block = p.tag in BLOCK
        label = "block" if block else "inline"
        if block:
            flush()
        if p.tag == "header" and not inside_header:
            inside_header, label = 1, "header"  # of it, only headings are text
        elif p.tag in _HEADINGS and inside_header > 0:
            inside_header, label = -1, "heading"
        todo.append((end, label))
        todo.extend(reversed(p.parts))
    flush()
    return blocks


def _inner(wrapped: list[Node], deep: bool) -> tuple[list[Node], list[Node]]:
    """Outermost articles and main elements below wrappers; ``deep``: below left out elements too."""
    articles, mains, todo = [], [], [p for w in reversed(wrapped) for p in reversed(w.parts)]
    while todo:
        node = todo.pop()
        if not isinstance(node, Node) or (node.bad or node.hidden) and not deep:
            continue
        if node.main and not node.bad:
            mains.append(node)
        if node.tag == "article" and not node.bad:
            articles.append(node)
        else:
            todo.extend(reversed(node.parts))
    return articles, mains


def main_text(page: str, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page: its articles, else its main element, else its body."""
    return _main_text(parse(page), template)


def _main_text(root: Node, template: frozenset[int]) -> str:
    articles, mains, wrapped, todo = [], [], [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        if node.bad or node.hidden:
            wrapped.append(node)
            continue
        if node.tag == "article":
            if not inside:
                articles.append(node)
            inside = True
        if node.main:
            mains.append(node)
        todo.extend((p, inside) for p in reversed(node.parts) if isinstance(p, Node))
    # articles and main elements whose wrapper merely has the name of something else
    wrapped = [w for w in wrapped if w.tag not in DROPPED]
    lost, lost_mains = _inner(wrapped, False)
    deep, deep_mains = _inner(wrapped, True)
    for chosen in (articles, mains[:1], lost, lost_mains[:1], deep, deep_mains[:1], [root]):
        blocks = [b for node in chosen for b in _gather(node, template)]
        if blocks:
            return "\n\n".join(blocks)
    return ""


def page_hashes(page: str) -> tuple[list[int], int | None]:
    """Hashes of the subtrees, and one of the main text, which copies have in common."""
    root = parse(page)
    text = _main_text(root, frozenset())
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest()
    return subtree_hashes(root), int.from_bytes(digest, "big", signed=True) if text else None


@F.pandas_udf(T.StructType().add("hashes", T.ArrayType(T.LongType())).add("content", T.LongType()))
def hashes_of(pages: pd.Series) -> pd.DataFrame:
    found = [page_hashes(p) if isinstance(p, str) else ([], None) for p in pages]
    return pd.DataFrame(
        {"hashes": [h for h, _ in found], "content": pd.array([c for _, c in found], dtype="Int64")}
    )


@F.pandas_udf(T.StringType())
def text_of(pages: pd.Series, templates: pd.Series) -> pd.Series:
    return pd.Series(
        [
            main_text(p, frozenset(t) if t is not None else frozenset()) if isinstance(p, str) else ""
            for p, t in zip(pages, templates, strict=True)
        ],
        dtype=object,
    )


def extract_text(
    pages: DataFrame,
    id_col: str,
    url_col: str,
    html_col: str,
    min_pages: int = TEMPLATE_PAGES,
    min_share: float = TEMPLATE_SHARE,
) -> DataFrame:
    """(page_id, url, text) of every row.

    Null and empty pages have an empty text; pages whose url has no host are one host. Pages of
    a host with the same main text (before any template goes) are counted as one, so an article
    that many pages copy is not taken for a template. Pages of any length are read in one pass,
    whatever is left open in them. Repeated rows come back each, null ids too; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    ship_package(pages.sparkSession)
    own = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    ).withColumns(
        {
            "host": url_parts(F.col("url"))[0],
            "page": F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))),
        }
    )
    seen = stored(
        own.select("page", "host", hashes_of("html").alias("found")).select(
            "page", "host", "found.hashes", F.coalesce("found.content", "page").alias("content")
        ),
        "subtrees",
    )
    # of copies, the page with the least hash is counted
    distinct = seen.groupBy("host", "content").agg(F.min_by("hashes", "page").alias("hashes"))
    n_pages = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    each = distinct.select("host", F.explode("hashes").alias("hash"))
    counts = each.groupBy("host", "hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    template = stored(
        counts.join(n_pages, "host").filter(F.col("n") >= min_share * F.col("pages")).select("host", "hash"),
        "template",
    )
    on_all = seen.dropDuplicates(["page"]).select("page", "host", F.explode("hashes").alias("hash"))
    on_page = stored(
        on_all.join(template, ["host", "hash"]).groupBy("page").agg(F.collect_set("hash").alias("template")),
        "on-page",
    )
    return own.join(on_page, "page", "left").select("page_id", "url", text_of("html", "template").alias("text"))


@query("op10_site_template")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = extract_text(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))  # code points
