"""Main text of HTML pages, without site templates.

Every element's subtree is hashed; Spark counts each hash per host, and subtrees that recur on many pages of their
host are deleted, as are elements that say by tag, role or class that they are menus, adverts, comments and the like.
Inside `article` and `main` a class that may be a topic (related, search) says so only where it recurs on many pages of its host.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foralia.runtime import materialize, table

#: A subtree is template when this share of its host's different pages, and at least so many of them, hold it.
MIN_SHARE = 0.2
MIN_PAGES = 5

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
DROPPED = RAW | {"head", "nav", "footer", "aside", "form", "svg", "button", "select", "object", "canvas", "dialog", "menu", "audio", "video", "map"}
PARAGRAPHS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dt", "dd", "td", "th", "figcaption"}
BLOCKS = PARAGRAPHS | {"html", "body", "main", "article", "section", "header", "div", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "caption", "figure", "address", "hr", "br", "fieldset", "details", "summary", "center", "nav", "footer", "aside", "form"}
CONTAINERS = BLOCKS - PARAGRAPHS
ENDS_P = BLOCKS - {"br", "html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "summary"}
#: Start tag -> (tags it closes when open, tags at which the search for them ends).
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
SCOPES = {"html", "body", "table", "td", "th", "caption", "object"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
#: Words of class and id values that mark what is not the article, where a value holds nothing but these and FURNITURE.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "masthead", "footer", "sidebar", "aside", "widget", "widgets",
    "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login",
    "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "toolbar", "search",
}
#: Of these, words that also name what an article may be about: inside one they mark an element only with a word for controls.
TOPICS = {
    "banner", "promotion", "navigation", "menu", "footer", "notice", "overlay", "subscription", "login", "respond", "reply", "replies", "share", "sharing",
    "social", "related", "recommended", "search", "aside", "consent", "comment",
}
CONTROLS = {"button", "buttons", "btn", "icon", "icons", "bar", "count"}
HEADERS = {"header", "topbar"}
#: Words that say where or what kind of box an element is, and nothing about its content.
FURNITURE = {
    "site", "page", "top", "bottom", "left", "right", "main", "global", "primary", "secondary", "sticky", "fixed", "inline", "mobile", "desktop", "native",
    "box", "block", "bar", "area", "section", "wrapper", "wrap", "container", "content", "inner", "outer", "list", "item", "items", "panel", "region", "group",
    "row", "col", "column", "slot", "unit", "zone", "link", "links", "form", "title", "text", "icon", "icons", "button", "buttons", "btn", "count", "feed", "thread", "trail",
    "post", "posts", "article", "articles", "entry", "story", "stories", "user", "users", "reader", "readers", "visitor", "new", "more", "media", "js", "is", "has", "id", "header",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

OPENS = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
#: What follows a tag's name up to its end; a `>` inside quotes does not end it.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Tags whose quotes do not close before the page is told to be read without regard to quotes: each costs a look at the whole rest.
MOST_OPEN_QUOTES = 8
#: Open elements looked at one by one before the places of the tags in question are compared.
NEAR = 8
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: str, parent: int) -> None:
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []


_BOUND, _LOOSE = frozenset(SCOPES), frozenset(BLOCKS | SCOPES)


class Stack:
    """Open elements, with the places of each tag, so that closing an element takes no search through deep nesting."""

    def __init__(self) -> None:
        self.nodes, self.tags, self.places, self.loose = [0], ["html"], {"html": [0]}, [0]

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in _LOOSE:
            self.loose.append(len(self.tags))
        self.nodes.append(node)
        self.tags.append(tag)

    def pop_to(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        """Closes the innermost element of `tags` and all inside it, unless one of `stop` lies further in."""
        if not any(map(self.places.get, tags)):
            return None
        for k in range(len(self.tags) - 1, max(0, len(self.tags) - 1 - NEAR), -1):
            if self.tags[k] in tags:
                return self._cut(k)
            if self.tags[k] in stop:
                return None
        last = lambda names: max((p[-1] for p in map(self.places.get, names) if p), default=0)
        k = last(tags)
        if k > 0 and k > (self.loose[-1] if stop is _LOOSE else last(stop - tags)):
            self._cut(k)
        return None

    def _cut(self, k: int) -> None:
        for tag in self.tags[k:]:
            self.places[tag].pop()
        while self.loose[-1] >= k:
            self.loose.pop()
        del self.nodes[k:], self.tags[k:]


_P, _BEFORE_P = frozenset({"p"}), frozenset(BLOCKS - {"p"})
_CLOSES = {tag: (frozenset(closed), frozenset(stop)) for tag, (closed, stop) in CLOSES.items()}
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def tokens(page: str) -> Iterator[tuple[str, bool, str, str]]:
    """(text, False, '', '') and ('', closing, tag, attributes) in page order; comments and declarations are left out.

    Takes time in proportion to the page. A tag that never ends is text.
    """
    at, end, last, open_quotes = 0, len(page), page.rfind(">"), 0
    text_from = 0
    while (found := OPENS.search(page, at)) and found.end() <= last:
        start, tag = found.start(), found[2]
        if tag is None:
            close = page.find("-->", found.end()) if found[0] == "<!--" else page.find(">", found.end())
            stop, attributes = (end if close < 0 else close + (3 if found[0] == "<!--" else 1)), ""
        else:
            rest = REST.match(page, found.end()) if open_quotes < MOST_OPEN_QUOTES else None
            open_quotes += rest is None
            stop = rest.end() if rest else page.find(">", found.end()) + 1
            attributes = page[found.end() : stop - 1]
        if start > text_from:
            yield page[text_from:start], False, "", ""
        at = text_from = stop
        if tag is None:
            continue
        name = tag.lower()
        yield "", bool(found[1]), name, attributes
        if name in RAW and not found[1]:
            close = _RAW_ENDS[name].search(page, at)
            at = text_from = close.end() if close else end
    rest = page[text_from:]
    if rest and not (found and found[0] == "<!--"):
        yield rest, False, "", ""
    elif rest and found.start() > text_from:
        yield page[text_from : found.start()], False, "", ""


def parse(page: str) -> list[Node]:
    """Elements in page order, parents first; children are element numbers and raw texts. Any string is a page."""
    nodes, stack = [Node("html", "", -1)], Stack()
    for text, closing, tag, attributes in tokens(page):
        if text:
            nodes[stack.nodes[-1]].children.append(text)
        elif closing:
            stack.pop_to(frozenset({tag}), _BOUND - {tag} if tag in BLOCKS or tag in DROPPED else _LOOSE)
        elif tag == "html":
            nodes[0].attributes += attributes
        else:
            if tag in ENDS_P:
                stack.pop_to(_P, _BEFORE_P)
            if tag in _CLOSES:
                stack.pop_to(*_CLOSES[tag])
            nodes.append(Node(tag, attributes, stack.nodes[-1]))
            nodes[stack.nodes[-1]].children.append(len(nodes) - 1)
            if tag not in RAW and tag not in VOID and not attributes.endswith("/"):
                stack.push(len(nodes) - 1, tag)
    return nodes


def subtree_hashes(nodes: list[Node]) -> list[int | None]:
    """Signed 64-bit hash of each element's tags and texts below it; None where there is no text."""
    out: list[int | None] = [None] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        parts, full = [nodes[k].tag], False
        for child in nodes[k].children:
            if isinstance(child, int):
                full |= out[child] is not None
                parts.append(f"<{out[child]}>")
            elif words := child.split():
                full = True
                parts.append(" ".join(words))
        if full:
            out[k] = _signed(xxhash.xxh64_intdigest("\x00".join(parts).encode(errors="replace")))
    return out


def held_subtrees(page: str) -> tuple[int | None, list[tuple[int | None, int | None, int]]]:
    """The page's own hash; each different subtree and hash of the container around it, 1 at the first one of a subtree, else 0.

    The first entry is (None, None, 1) for the page itself. Paragraphs and inline elements are no containers. Class names that may be
    topics inside article or main are counted like subtrees, once a page.
    """
    nodes = parse(page)
    hashes, around, seen = subtree_hashes(nodes), [0] * len(nodes), {None}
    held = {(None, None): 1}
    for k in range(1, len(nodes)):
        up = nodes[k].parent
        around[k] = up if up == 0 or nodes[up].tag in CONTAINERS else around[up]
        pair = hashes[k], hashes[around[k]]
        if hashes[k] is not None and pair not in held:
            held[pair] = int(hashes[k] not in seen)
            seen.add(hashes[k])
    inside = [False] * len(nodes)
    for k in range(1, len(nodes)):
        inside[k] = nodes[k].tag in ("article", "main") or inside[nodes[k].parent]
        if inside[k] and (mark := mark_of(nodes[k], True)) and mark[1]:
            held[mark[0], hashes[0]] = 1
    return hashes[0], [(h, a, f) for (h, a), f in held.items()]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def mark_of(node: Node, inside: bool) -> tuple[int, bool] | None:
    """The first class or id value that says the element is not part of the article: its hash, and whether it may be a topic of
    the article; None without any. Headings have none."""
    if "=" in node.attributes and node.tag not in HEADINGS:
        for name, a, b, c in ATTRIBUTE.findall(node.attributes):
            if name.lower() in ("class", "id"):
                for value in (a or b or c).split():
                    words = {w.lower() for w in WORDS.findall(value)}
                    if words & MARKS and words <= MARKS | FURNITURE or not inside and words & HEADERS and words <= FURNITURE | HEADERS:
                        topic = inside and words & MARKS <= TOPICS and not words & CONTROLS
                        return _signed(xxhash.xxh64_intdigest(f"mark\x00{node.tag}\x00{value}".encode(errors="replace"))), topic
    return None


def hidden(node: Node, inside: bool) -> bool:
    """Whether tag, role or style say that the element is not part of the article."""
    if node.tag in DROPPED or node.tag == "header" and not inside:
        return True
    if "=" not in node.attributes:
        return bool(re.search(r"\bhidden\b", node.attributes))
    for name, a, b, c in ATTRIBUTE.findall(node.attributes):
        value = a or b or c
        match name.lower():
            case "role":
                if value.lower() in ROLES:
                    return True
            case "aria-hidden":
                if value.lower() == "true":
                    return True
            case "style":
                if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    return True
    return False


def _chosen(nodes: list[Node], gone: list[bool]) -> tuple[list[int], set[int]]:
    """The elements that hold the page's main text, in page order, and articles in them that are teasers of other pages.

    Of `main` elements the one with the most text, whatever stands beside articles in it. Without one, the outermost articles,
    unless most of the page's text stands outside them and under a heading there: then the page without its articles.
    """
    text = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        if not gone[k]:
            text[k] += sum(len("".join(c.split())) for c in nodes[k].children if isinstance(c, str))
            if k:
                text[nodes[k].parent] += text[k]
    mains = [k for k, node in enumerate(nodes) if node.tag == "main" and not gone[k] and text[k]]
    within = [False] * len(nodes)
    outer = []
    for k, node in enumerate(nodes):
        within[k] = k > 0 and (within[node.parent] or nodes[node.parent].tag == "article")
        if node.tag == "article" and not gone[k] and not within[k] and text[k]:
            outer.append(k)
    held = sum(text[k] for k in outer)
    if mains:
        return [max(mains, key=lambda k: text[k])], set()
    titled = any(node.tag in ("h1", "h2") and text[k] and not gone[k] and not within[k] and nodes[node.parent].tag != "article" for k, node in enumerate(nodes))
    if outer and (2 * held >= text[0] or not titled):
        return outer, set()
    return [0], set(outer)


def main_text(page: str, templates: set[int]) -> str:
    """The page's blocks, one a line. Inside article or main, recurring paragraphs stay: only recurring containers go.

    A page that would have no text for the sake of its class names keeps what only they mark.
    """
    nodes = parse(page)
    return _main_text(nodes, templates, True) or _main_text(nodes, templates, False)


def _main_text(nodes: list[Node], templates: set[int], by_class: bool) -> str:
    hashes = subtree_hashes(nodes) if templates else []
    holds = [False] * len(nodes)
    for k in range(len(nodes) - 1, 0, -1):
        if holds[k] or nodes[k].tag in ("article", "main"):
            holds[nodes[k].parent] = True
    inside, gone = [False] * len(nodes), [False] * len(nodes)
    for k, node in enumerate(nodes):
        up = node.parent
        inside[k] = node.tag in ("article", "main") or k > 0 and inside[up]
        gone[k] = k > 0 and gone[up]
        if k and not gone[k] and node.tag != "body" and not holds[k]:
            mark = mark_of(node, inside[k]) if by_class else None
            gone[k] = hidden(node, inside[k]) or mark is not None and (not mark[1] or mark[0] in templates)
            if templates and not gone[k] and hashes[k] in templates:
                gone[k] = not inside[k] or node.tag in BLOCKS - PARAGRAPHS - {"article", "main", "br", "hr"}
    kept, teasers = _chosen(nodes, gone)
    for k in teasers:
        gone[k] = True
    blocks: list[str] = []
    pending: list[str] = []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(pending)).split()):
            blocks.append(text)
        pending.clear()

    done = -1
    for root in kept:
        if root <= done:
            continue
        stack = [(root, iter(nodes[root].children))]
        while stack:
            k, children = stack[-1]
            child = next(children, None)
            if child is None:
                stack.pop()
                if nodes[k].tag in BLOCKS:
                    flush()
            elif isinstance(child, str):
                pending.append(child)
            else:
                done = child
                if not gone[child]:
                    if nodes[child].tag in BLOCKS:
                        flush()
                    stack.append((child, iter(nodes[child].children)))
        flush()
    return "\n".join(blocks)


def host(url: str | Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def site_templates(pages: DataFrame, min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, templates array<long>): at most 1 / min_share times a page's elements for any host, however many pages it has.

    Pages with equal elements and texts count once, and a subtree counts no more often than there are different
    containers around it: what recurs only because the text around it was copied is no template.
    """

    @F.pandas_udf("root long, held array<struct<hash:long,around:long,first:long>>")
    def hashes(pages_: pd.Series) -> pd.DataFrame:
        found = [held_subtrees(x) for x in pages_]
        root = pd.Series([r for r, _ in found], dtype="Int64")
        return pd.DataFrame({"root": root, "held": [[{"hash": h, "around": a, "first": f} for h, a, f in held] for _, held in found]})

    found = pages.select(host("url").alias("host"), hashes(F.coalesce("html", F.lit(""))).alias("page")).select("host", "page.*")
    found = found.groupBy("host", "root").agg(F.first("held").alias("held")).select("host", F.inline("held"))
    counts = found.groupBy("host", "hash", "around").agg(F.sum("first").alias("n"))
    counts = counts.groupBy("host", "hash").agg(F.sum("n").alias("n"), F.count("*").alias("n_around"))
    counts = counts.select("host", "hash", F.when(F.col("hash").isNull(), F.col("n")).otherwise(F.least("n", "n_around")).alias("n"))
    counts = materialize(counts.where(F.col("hash").isNull() | (F.col("n") >= min_pages)), "subtrees")
    total = counts.where("hash is null").select("host", F.col("n").alias("n_pages"))
    often = counts.where(F.col("hash").isNotNull()).join(total, "host")
    return often.where(F.col("n") >= min_share * F.col("n_pages")).groupBy("host").agg(F.collect_list("hash").alias("templates"))


def extract_text(pages: DataFrame, min_share: float = MIN_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """All columns of `pages` (url, html among them) and `text`.

    Null or empty html gives empty text; a null or odd url belongs to the empty host; each row of pages that repeat
    gets its text; deep nesting and unclosed elements are read like a browser would, approximately, in time that grows
    with the page and no faster. A column `text` is replaced; no pages give no rows.
    """
    templates = materialize(site_templates(pages, min_share, min_pages), "templates").withColumnRenamed("host", "_host")

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for pages_, known in batches:
            yield pd.Series([main_text(x, set() if t is None else set(map(int, t))) for x, t in zip(pages_, known, strict=True)], dtype=object)

    joined = pages.withColumn("_of", host("url")).join(templates, F.col("_of") == F.col("_host"), "left")
    return joined.withColumn("text", extract(F.coalesce("html", F.lit("")), "templates")).select(*(c for c in pages.columns if c != "text"), "text")


def op7_html(spark, sf_dir: str) -> DataFrame:
    """The main text of every page; see extract_text for edge cases."""
    out = extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
