"""Main text of web pages with site template removal.

Pass 1 parses every page, hashes its element subtrees (tag, attributes, text,
children) and counts, per host in Spark, the different pages each subtree occurs
on.  Copies count once: pages are different when their main roots (the article
or main element with the most text) are, without one when their html is, and a
box inside a root counts once for equal roots.
Pass 2 parses again, deletes the subtrees that recur on many pages of their
host from the whole tree, chooses the content roots, deletes what is never
article text (menus, headers and footers outside the article, sidebars, notices,
adverts, forms, scripts, styles, comments) and joins the remaining blocks.

Inside article and main elements boxes (div, section, lists, tables) that recur
go, paragraphs, headings, quotes and preformatted text never: a paragraph that
many articles of a site quote is still their text.  The root with the most text
of a page and the elements around it stay.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cataloom.llm.common import out, sub_batches

#: A subtree is a template when it occurs on at least this many different pages of a host.
MIN_PAGES = 5

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are never part of the article.
DROP = RAW | frozenset("head nav aside footer form button select option svg math canvas template "
                       "object audio video dialog menu label input".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q "
                   "ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose start closes an open p.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset "
                     "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu "
                     "nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
        "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table ul ol dl div article section main body td th".split())
#: Elements inside an article that are its text however often they recur, and elements
#: that go only with the box they are in.
QUOTED = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre".split())
CELLS = frozenset("li dt dd tbody thead tfoot tr td th caption figcaption".split())
#: Words of the class, id and role names of boxes that are page furniture, and words that
#: such names are completed with.  A name counts when all its words are of these two lists
#: and at least one is of the first, so "share-buttons" does and "side-effects" does not.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies "
    "consent gdpr notice notices newsletter subscribe popup modal nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar widget related recommended share sharing social comment "
    "comments disqus replies respond footer masthead pagination pager skip toolbar complementary "
    "contentinfo".split())
COMPLETES = frozenset(
    "area bar block box bottom button buttons container form inner item items left link links list "
    "outer panel policy posts right section signup site slot thread top unit widgets wrap wrapper".split())
WORDS = re.compile(r"[a-z]+|[0-9]+")
#: A box is not furniture by its name when it holds more than this share of the text.
MOST_TEXT = 0.75
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(/?)>"
    r"|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "parts", "key")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.parts, self.key = tag, attrs, [], 0


def parse(html: str) -> Node:
    """A forgiving element tree: unclosed elements end with their parent."""
    root = Node("#root")
    stack = [root]
    at, n = 0, len(html)
    while at < n:
        m = MARKUP.search(html, at)
        if not m:
            stack[-1].parts.append(html[at:])
            break
        if m.start() > at:
            stack[-1].parts.append(html[at:m.start()])
        at = m.end()
        close, tag = m[1], m[2] or m[5]
        if close:
            _close(stack, close.lower())
        elif tag:
            tag = tag.lower()
            _imply(stack, tag)
            node = Node(tag, (m[3] or m[6] or "").strip())
            stack[-1].parts.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                node.parts.append(html[at:end.start() if end else n])
                at = end.end() if end else n
            elif tag not in VOID and not m[4]:
                stack.append(node)
        elif m[0].startswith("<![CDATA["):
            stack[-1].parts.append(m[0][9:].removesuffix("]]>"))
    return root


def _close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag in INLINE and stack[i].tag not in INLINE:
            return  # an inline end tag doesn't close blocks
        if tag == "p" and stack[i].tag in SCOPE:
            return


def _imply(stack: list[Node], tag: str) -> None:
    """End tags that a start tag implies."""
    ends = SAME.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
    if not ends:
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in ends:
            del stack[i:]
            return
        if stack[i].tag in SCOPE:
            return


def hash_tree(root: Node) -> None:
    """Set ``key`` (a signed 64-bit hash) on every element, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(p for p in node.parts if not isinstance(p, str))
    for node in reversed(order):
        h = xxhash.xxh3_64(f"{node.tag}\0{node.attrs}".encode())
        for p in node.parts:
            if isinstance(p, str):
                if t := WHITE.sub(" ", p).strip():
                    h.update(b"\1" + t.encode("utf-8", "surrogatepass"))
            else:
                h.update(b"\2" + p.key.to_bytes(8, "little", signed=True))
        node.key = int.from_bytes(h.digest(), "little", signed=True)


def attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "")
            for m in ATTR.finditer(node.attrs)}


def named_furniture(name: str) -> bool:
    """Whether one class, id or role name is that of page furniture."""
    words = [w for w in WORDS.findall(name.lower()) if not w.isdigit()]
    return any(w in FURNITURE for w in words) and all(w in FURNITURE or w in COMPLETES for w in words)


def is_furniture(node: Node, in_article: bool) -> bool:
    """By tag, or hidden."""
    if node.tag in DROP or node.tag == "header" and not in_article:
        return True
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    a = attributes(node)
    return "hidden" in a or a.get("aria-hidden") == "true"


def is_named_furniture(node: Node) -> bool:
    """By a name; paragraphs, headings and quotes are never furniture by name."""
    if not node.attrs or node.tag in QUOTED or node.tag in ("html", "body", "article", "main"):
        return False
    a = attributes(node)
    return any(named_furniture(n) for k in ("class", "id", "role") for n in a.get(k, "").split())


def content_roots(root: Node) -> list[Node]:
    """The outermost article elements, else main elements, else the whole page.  Boxes with a
    name of furniture are searched only when there is none outside them."""
    for inside in (False, True):
        for tag in ("article", "main"):
            found, todo = [], [root]
            while todo:
                node = todo.pop()
                if node.tag == tag:
                    found.append(node)
                elif (node.tag not in DROP and not is_furniture(node, False)
                        and (inside or not is_named_furniture(node))):
                    todo.extend(p for p in reversed(node.parts) if not isinstance(p, str))
            if found:
                return found
    return [root]


def _length(root: Node) -> int:
    n, todo = 0, [root]
    while todo:
        for p in todo.pop().parts:
            if isinstance(p, str):
                n += len(p)
            else:
                todo.append(p)
    return n


def _deletable(root: Node) -> Iterator[tuple[Node, Node, Node]]:
    """(parent, element, owner) of the elements that go when they recur; the owner is
    the content root they are in, else the main root of the page (``root`` if none)."""
    roots = [x for x in content_roots(root) if x is not root]
    inside = {id(x) for x in roots}
    kept = {id(root)}
    main = root
    if roots:
        way, todo = {}, [root]
        while todo:
            node = todo.pop()
            for p in node.parts:
                if not isinstance(p, str):
                    way[id(p)] = node
                    todo.append(p)
        main = top = roots[0] if len(roots) == 1 else max(roots, key=_length)
        while top is not root:
            kept.add(id(top))
            top = way[id(top)]
    stack: list[tuple[Node, Node | None]] = [(root, None)]
    while stack:
        parent, article = stack.pop()
        for node in parent.parts:
            if isinstance(node, str) or node.tag in RAW or node.tag == "head":
                continue
            if article and node.tag in QUOTED:
                continue
            if (id(node) not in kept and node.tag not in ("html", "body") and node.parts
                    and node.tag not in INLINE and not (article and node.tag in CELLS)):
                yield parent, node, article or main
            stack.append((node, article or (node if id(node) in inside else None)))


def template_candidates(root: Node, html: str) -> set[tuple[int, int]]:
    """(hash of the element, hash of the content it counts for) of the elements with
    content that go when they recur."""
    own = xxhash.xxh3_64_intdigest(html.encode("utf-8", "surrogatepass")) - (1 << 63)
    return {(node.key, own if owner is root else owner.key)
            for _, node, owner in _deletable(root)}


def delete(root: Node, templates: frozenset[int] | set[int]) -> None:
    """Take the recurring elements out of the tree."""
    found = [x for x in _deletable(root) if x[1].key in templates]
    gone = {id(node) for _, node, _ in found}
    for parent in {id(parent): parent for parent, _, _ in found}.values():
        parent.parts = [Node("div") if id(p) in gone else p for p in parent.parts]


def main_text(root: Node) -> str:
    """The blocks of the content roots in page order, white space collapsed."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(run)).split()):
            blocks.append(text)
        run.clear()

    for top in content_roots(root):
        article = top is not root
        whole = None
        todo: list[Node | str | None] = [top]
        while todo:
            node = todo.pop()
            if node is None:
                flush()
            elif isinstance(node, str):
                run.append(node)
            elif node is not top and (is_furniture(node, article) or is_named_furniture(node)):
                if not is_furniture(node, article):
                    whole = _length(top) if whole is None else whole
                    if _length(node) > MOST_TEXT * whole:      # the page itself, whatever its name
                        flush()
                        todo.append(None)
                        todo.extend(reversed(node.parts))
                        continue
                if node.tag not in INLINE:
                    flush()
            elif node.tag in INLINE:
                todo.extend(reversed(node.parts))
            else:  # br ends a line, everything else a block
                flush()
                todo.append(None)
                todo.extend(reversed(node.parts))
        flush()
    return " ".join(blocks)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def page_subtrees(pages: DataFrame) -> DataFrame:
    """pages (row, host, html) -> (row, host, subtree, content): distinct per page; the
    content is what the subtree counts for, once however many copies there are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("host", pa.int64()), ("subtree", pa.int64()),
                            ("content", pa.int64())])
        for b, texts in sub_batches(batches, "html"):
            at, keys = [], []
            for i, t in enumerate(texts):
                root = parse(t)
                hash_tree(root)
                own = template_candidates(root, t)
                at += [i] * len(own)
                keys += own
            index = pa.array(at, pa.int64())
            yield out(schema, b.column(0).take(index), b.column(1).take(index),
                      [k for k, _ in keys], [c for _, c in keys])

    return pages.select("row", F.xxhash64("host").alias("host"), "html").mapInArrow(
        run, "row long, host long, subtree long, content long")


def templates(subtrees: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, subtree) of the subtrees that recur on many different pages of their host."""
    return (subtrees.select("host", "subtree", "content").distinct()
            .groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= min_pages).select("host", "subtree"))


def extract(df: DataFrame, id_col: str, url_col: str, html_col: str,
            min_pages: int = MIN_PAGES) -> DataFrame:
    """One row per input row: id, url, text, n_chars.

    Null html is empty and gives an empty text; a null url belongs to the host
    "".  Broken markup (unclosed or truncated tags) is read as far as it goes.
    Texts of any length are read whole.  Pages whose rows are equal share one decision;
    repeated rows and null ids pass through; an empty table gives no rows; other columns are ignored."""
    pages = df.select(df[id_col].alias("id"), df[url_col].alias("url"),
                      df[html_col].alias("html"))
    pages = pages.select(F.xxhash64("url", "html").alias("row"), "id", "url",
                         host_of(F.col("url")).alias("host"), "html")
    id_type = pages.schema["id"].dataType.simpleString()
    subtrees = page_subtrees(pages)
    found = templates(subtrees, min_pages)
    hits = (subtrees.join(found, ["host", "subtree"]).groupBy("row")
            .agg(F.collect_set("subtree").alias("gone")))
    joined = pages.select("row", "id", "url", "html").join(hits, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for b, texts in sub_batches(batches, "html"):
            schema = schema or pa.schema([("id", b.schema.field("id").type), ("url", pa.string()),
                                          ("text", pa.string()), ("n_chars", pa.int64())])
            found = []
            for t, gone in zip(texts, b.column(b.schema.get_field_index("gone")).to_pylist()):
                root = parse(t)
                if gone:
                    hash_tree(root)
                    delete(root, set(gone))
                found.append(main_text(root))
            found = [t.encode("utf-8", "replace").decode() for t in found]
            yield out(schema, b.column(1), b.column(2), found, [len(t) for t in found])

    return joined.mapInArrow(run, f"id {id_type}, url string, text string, n_chars long")
