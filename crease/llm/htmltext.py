"""Main text of pages by a site style tree.

The DOMs of a host's pages are merged: an element's place is its path of tags and classes, and for every place the
tree keeps how the element is presented (which children it has) and which texts stand in it, each with the number of
different pages that show it.  From these come two importances between 0 and 1:

* presentation: the entropy of the presentations, to the base of the number of pages (a place that looks alike on all
  pages has 0).  A presentation is the row of children, with the length class and link share of texts among them;
* content: 1 less the mean entropy of its texts over the pages (texts that stand on every page have 0).

and what kind of text stands there: a place is *prose* if its blocks have ``PROSE_CHARS`` characters on average, less
than half of them in links.

A page's branch has the composite importance ``(1 - GAMMA**l) * presentation + GAMMA**l * mean over its parts``, with
``l`` presentations and, as parts, its own texts' content importance and its children.  A branch is removed if it and
all its descendants are under ``LEAST_IMPORTANCE``.  Pages of a host with equal main text (what tags and names alone
leave) count once, whatever menus and adverts stand around it, so copies of an article don't make it look like a
template, and places on fewer than ``LEAST_PAGES`` different pages have no evidence and are kept.

The tree also finds where the text is: an element with prose right below it holds the text, and all that stands in
it belongs to it.  On a page that has such an element, a branch outside of all of them is removed if the site's pages show
that no place in it is prose, such as menus, adverts and footers whose words change from page to page.

Tags and names that say what a branch is (``nav``, ``class="ad"`` ...) settle it without entropy, as does ``article`` or
``main`` for where the text is.  Inside the article names decide nothing, but for a few that mean adverts and comments
as a whole class or id.

Only counts are shuffled, never html: one short row for each place, presentation and text of a page.  The importances
are broadcast after a check of their number; beyond ``BROADCAST_PLACES`` they are joined to short rows (page, place), and
each page is sent those of its own places, which is when its html is shuffled once, by page.

Defined cases: a null or empty html has an empty text; a null or strange url has the empty host, whose pages form one
site; markup that is cut off is closed at the end; repeated rows are pages each; an empty table gives no rows; other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches, materialise, small_enough

GAMMA = 0.9
LEAST_IMPORTANCE = 0.2
LEAST_PAGES = 8
PROSE_CHARS = 80
BROADCAST_PLACES = 200_000
#: A branch outside the article whose text is links to this share, and that has some of them, is a menu.
LINK_SHARE, MENU_LINKS = 0.8, 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a new block of text.
BLOCK = frozenset("""address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td
    tfoot th thead tr ul""".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style template noscript textarea title iframe svg canvas select object video audio".split())
#: Start tags that end an open element of these kinds.
ENDS = {tag: frozenset(kinds.split()) for tag, kinds in (
    ("li", "li"), ("dt", "dt dd"), ("dd", "dt dd"), ("tr", "tr td th"), ("td", "td th"), ("th", "td th"))}
PARAGRAPH, NOT_PARAGRAPH = frozenset(("p",)), BLOCK - {"p"}
#: Elements that a search for an open element to end stops at.
LIMIT = frozenset("article aside body dl footer form header main nav ol section table ul".split())
NOISE_TAGS = frozenset("aside button dialog footer form head header menu nav".split())
#: Words in class, id or role that name something other than the article.
NOISE_NAMES = frozenset("""ad ads adsense advert advertisement advertisements advertising adverts alert alerts banner
    breadcrumb breadcrumbs byline comment comments commentlist consent contentinfo cookie cookies copyright disclaimer
    disqus dropdown feedback footer form gdpr header hidden legal login masthead menu modal nav navbar navigation
    newsletter notice notices notification notifications pager pagination popup promo promoted promotion recommended
    related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe
    subscription tags teaser toolbar warning widget widgets""".split())
COMMENT_NAMES = frozenset("comment comments reply replies teaser related ad advert sponsored promo".split())
#: Inside the article only these decide, as a whole class or id and on elements that hold others: adverts and threads of
#: comments.  Any other word may be what the article is about.
ARTICLE_NOISE = frozenset("ad ads advert advertisement comments comment-list commentlist disqus_thread".split())
HOLDERS = frozenset("div section ul ol table".split())

#: A quote that is never closed ends with its tag.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[A-Za-z][a-z]*|[0-9]+")


class Node:
    """An element; the last four slots are of its whole branch, and ``survey`` sets them."""

    __slots__ = ("tag", "key", "names", "tokens", "hidden", "parent", "kids", "place",
                 "chars", "link_chars", "links", "holds_main")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.names, self.tokens, self.hidden, styled = frozenset(), frozenset(), False, ""
        if attributes:
            words, tokens = [], []
            for name, value in _NAMES.findall(attributes):
                name, value = name.lower(), unescape(value.strip("\"'"))
                if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                    self.hidden = True
                elif name == "style":
                    self.hidden |= bool(re.search(r"display\s*:\s*none", value, re.I))
                elif name in ("class", "id", "role"):
                    words += [w.lower() for w in _WORD.findall(value)]
                    tokens += value.lower().split()
                    styled += f".{value}" if name == "class" else ""
            self.names, self.tokens = frozenset(words), frozenset(tokens)
        self.key = tag + styled
        above = parent.place if parent else 0
        self.place = xxhash.xxh3_64_intdigest(self.key.encode(), seed=above & 0x7FFFFFFFFFFFFFFF) >> 1


class Text:
    """A block of text, how many of its characters (but white space) stand in links, and the number of links."""

    __slots__ = ("text", "link_chars", "links")

    def __init__(self, text: str, link_chars: int, links: int):
        self.text, self.link_chars, self.links = text, link_chars, links


def parse(html: str) -> Node:
    """The tree of block elements with their texts; inline elements belong to the text around them."""
    root = node = Node("html", "", None)
    words, link_words, links, in_link = [], [], 0, False
    opened = Counter()  # open elements by tag: a search for one that is not open need not begin

    def flush() -> None:
        nonlocal links
        if words:
            text = " ".join("".join(words).split())
            if text:
                node.kids.append(Text(text, len("".join("".join(link_words).split())), links))
            words.clear()
            link_words.clear()
        links = 0

    def close(kinds: frozenset[str], limit: frozenset[str]) -> None:
        """Close the innermost open element of these kinds, unless one of ``limit`` lies further in."""
        nonlocal node
        if not any(opened[kind] for kind in kinds):
            return
        at = node
        while at.tag not in kinds:
            if at.parent is None or at.tag in limit:
                return
            at = at.parent
        while True:
            opened[node.tag] -= 1
            last, node = node, node.parent
            if last is at:
                return

    def say(piece: str) -> None:
        if piece:
            piece = unescape(piece) if "&" in piece else piece
            words.append(piece)
            if in_link:
                link_words.append(piece)

    at = 0
    while True:
        found = _TOKEN.search(html, at)
        if found is None:
            say(html[at:])
            break
        say(html[at:found.start()])
        at = found.end()
        tag = found[2] or found[5]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), bool(found[1] or found[4]), found[3] or found[6] or ""
        if tag in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            words.append(" ")
        elif tag == "a":
            in_link = not closing
            links += not closing
        elif tag not in BLOCK and tag not in NOISE_TAGS:
            if tag == "br":
                words.append(" ")
        elif closing:
            flush()
            in_link = False
            close(frozenset((tag,)), frozenset() if tag in LIMIT or tag == "div" else LIMIT)
        else:
            flush()
            in_link = False
            close(PARAGRAPH, NOT_PARAGRAPH)
            if tag in ENDS:
                close(ENDS[tag], LIMIT)
            if tag in VOID or tag == "html":
                continue
            child = Node(tag, attributes, node)
            node.kids.append(child)
            opened[tag] += 1
            node = child
    flush()
    survey(root)
    return root


def survey(root: Node) -> None:
    """What is needed of whole branches, in one pass from below."""
    for node in reversed(list(elements(root))):
        node.chars = node.link_chars = node.links = 0
        node.holds_main = node.tag in ("article", "main") and not node.names & COMMENT_NAMES
        for kid in node.kids:
            node.link_chars += kid.link_chars
            node.links += kid.links
            if isinstance(kid, Text):
                node.chars += len(kid.text.replace(" ", ""))
            else:
                node.chars += kid.chars
                node.holds_main |= kid.holds_main


def elements(node: Node) -> Iterator[Node]:
    stack = [node]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))


def is_noise(node: Node, in_article: bool) -> bool:
    """Whether tag, names or attributes tell that the branch is no part of the article."""
    if node.tag in ("html", "body", "main"):
        return False
    if node.hidden:
        return True
    if node.tag == "article":
        return bool(node.names & COMMENT_NAMES)
    if node.tag in NOISE_TAGS:
        return not (in_article and node.tag == "header")
    if in_article:
        return node.tag in HOLDERS and bool(node.tokens & ARTICLE_NOISE)
    # a wrapper may be named after what stands beside the article in it
    return bool(node.names & NOISE_NAMES) and not node.holds_main


def text_shape(text: Text) -> str:
    """Length class and link share class of a text."""
    chars = max(1, len(text.text.replace(" ", "")))
    return f"#{chars.bit_length()}.{2 * text.link_chars // chars}"


def site_rows(root: Node) -> Iterator[tuple[int, bool, int, int, int, int]]:
    """(place, whether a presentation or a text, its hash, blocks, characters, characters in links), each once for the
    page; the sums are those of a place's texts and stand with its presentation."""
    shown: dict[int, set[int]] = {}
    sums: dict[int, list[int]] = {}
    for node in elements(root):
        children, last = [], None
        total = sums.setdefault(node.place, [0, 0, 0])
        for kid in node.kids:
            name = kid.key if isinstance(kid, Node) else text_shape(kid)
            if name != last:
                children.append(name)
            last = name
            if isinstance(kid, Text):
                for i, x in enumerate((1, len(kid.text), kid.link_chars)):
                    total[i] += x
        shown.setdefault(node.place, set()).add(xxhash.xxh3_64_intdigest(" ".join(children).encode()) >> 1)
    for place, ways in shown.items():
        # elements at one place are one presentation: all the ways they look
        yield place, True, xxhash.xxh3_64_intdigest(np.array(sorted(ways), np.uint64).tobytes()) >> 1, *sums[place]
    yield from {(node.place, False, xxhash.xxh3_64_intdigest(kid.text.encode()) >> 1, 0, 0, 0)
                for node in elements(root) for kid in node.kids if isinstance(kid, Text)}


#: Place -> presentation importance, number of presentations, content importance (none without texts), prose or not.
Importance = dict[int, tuple[float, int, float | None, bool]]


def low_branches(root: Node, known: Importance) -> set[int]:
    """The branches (by ``id``) that are under ``LEAST_IMPORTANCE`` and hold nothing else: one pass from below.  An
    element without evidence is not low."""
    value: dict[int, float] = {}
    low: set[int] = set()
    for node in reversed(list(elements(root))):
        found = known.get(node.place)
        kids = [k for k in node.kids if isinstance(k, Node)]
        if found is None:
            value[id(node)] = 1.0
            continue
        presentation, ways, content, _ = found
        parts = [value[id(k)] for k in kids]
        if content is not None and len(kids) < len(node.kids):
            parts.append(content)
        damp = GAMMA ** ways
        value[id(node)] = (1 - damp) * presentation + damp * (sum(parts) / len(parts)) if parts else presentation
        if value[id(node)] < LEAST_IMPORTANCE and all(id(k) in low for k in kids):
            low.add(id(node))
    return low | without_prose(root, known)


def without_prose(root: Node, known: Importance) -> set[int]:
    """The outermost branches (by ``id``) that hold no prose and stand in no element with prose right below it; none on
    a page without such an element."""
    prose: set[int] = set()  # elements whose own texts are prose
    open_branch: set[int] = set()  # branches with prose, or with an element without evidence
    holders: set[int] = set()
    for node in reversed(list(elements(root))):
        found = known.get(node.place)
        if found is not None and found[3] and any(isinstance(k, Text) for k in node.kids):
            prose.add(id(node))
        if found is None or id(node) in prose or any(id(k) in open_branch for k in node.kids):
            open_branch.add(id(node))
        if id(node) in prose or any(id(k) in prose for k in node.kids):
            holders.add(id(node))
    out: set[int] = set()
    waiting = [root] if holders else []
    while waiting:
        for kid in waiting.pop().kids:
            if isinstance(kid, Node) and id(kid) not in holders:
                if id(kid) in open_branch:
                    waiting.append(kid)
                else:
                    out.add(id(kid))
    return out


def menu_like(node: Node) -> bool:
    return node.links >= MENU_LINKS and node.link_chars >= LINK_SHARE * node.chars


def kept_texts(root: Node, known: Importance) -> list[str]:
    low = low_branches(root, known) if known else set()

    def scopes(tag: str) -> list[Node]:
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if is_noise(node, False):
                continue
            if node.tag == tag:
                found.append(node)
            else:
                stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))
        return found

    for tag in ("article", "main"):
        texts = [t for scope in scopes(tag) for t in _texts(scope, True, low)]
        if texts:
            return texts
    return _texts(root, False, low)


def _texts(scope: Node, in_article: bool, low: set[int]) -> list[str]:
    out, stack = [], [scope]
    while stack:
        node = stack.pop()
        if isinstance(node, Text):
            out.append(node.text)
            continue
        if node is not scope and (id(node) in low or is_noise(node, in_article) or not in_article and menu_like(node)):
            continue
        stack.extend(reversed(node.kids))
    return out


def main_text(html: str | None, known: Importance) -> str:
    return "\n".join(kept_texts(parse(html), known)) if html else ""


def site_importance(sites: DataFrame) -> DataFrame:
    """``host, place, presentation, ways, content, prose`` of every place on ``LEAST_PAGES`` different pages at least.

    Pages are told apart by the text that tags and names leave of them.  Of the ways in which copies present a place
    one counts, picked by hash.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in names]
            for host, html in zip(batch["host"].to_pylist(), batch["html"]):
                html = html.as_py()
                if html:
                    root = parse(html)
                    page = xxhash.xxh3_64_intdigest("\n".join(kept_texts(root, {})).encode()) >> 1
                    for row in site_rows(root):
                        for column, x in zip(columns, (host, page, *row)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    names = ["host", "page", "place", "shown", "what", "blocks", "chars", "link_chars"]
    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    rows = map_batches(sites.select("host", "html"), count, "host string, page long, place long, shown boolean, "
                       "what long, blocks int, chars int, link_chars int")
    kinds = names[5:]
    shown, n, what, page = map(F.col, ("shown", "n", "what", "page"))
    # a page has one row for a place and text, and one for a place's presentation: of those of copies the smallest,
    # mixed with the page, so that no presentation is picked more often than others
    once = rows.groupBy("host", "place", "shown", F.when(~shown, what).alias("text"), "page").agg(
        F.min(what.bitwiseXOR(page)).alias("mixed"), *(F.max(c).alias(c) for c in kinds))
    pages = (once.select("host", "place", "shown", F.col("mixed").bitwiseXOR(page).alias("what"), *kinds)
             .groupBy("host", "place", "shown", "what").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in kinds)))
    sums = pages.groupBy("host", "place").agg(
        F.sum(F.when(shown, n)).alias("m"), F.count(F.when(shown, 1)).cast("int").alias("ways"),
        F.sum(F.when(shown, n * F.log(n))).alias("shown_log"), F.count(F.when(~shown, 1)).alias("texts"),
        F.sum(F.when(~shown, F.log(n))).alias("text_log"), *(F.sum(c).alias(c) for c in kinds))
    log_m = F.log("m")
    return (sums.where(F.col("m") >= LEAST_PAGES)
            .select("host", "place", F.greatest(F.lit(0.0), 1 - F.col("shown_log") / (F.col("m") * log_m))
                    .alias("presentation"), "ways",
                    F.when(F.col("texts") > 0, 1 - F.col("text_log") / (F.col("texts") * log_m)).alias("content"),
                    ((F.col("chars") >= PROSE_CHARS * F.col("blocks")) & (2 * F.col("link_chars") < F.col("chars")))
                    .alias("prose")))


def known_by_page(sites: DataFrame, importance: DataFrame) -> DataFrame:
    """``host, page, known``: for each page of ``sites`` (host, html, page), a list of the importances of its own places."""
    def list_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages, places = [], [], []
            for host, page, html in zip(batch["host"].to_pylist(), batch["page"].to_pylist(), batch["html"]):
                html = html.as_py()
                own = {node.place for node in elements(parse(html))} if html else ()
                hosts += [host] * len(own)
                pages += [page] * len(own)
                places += own
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages, pa.int64()),
                                              pa.array(places, pa.int64())], names=["host", "page", "place"])

    places = map_batches(sites.select("host", "page", "html"), list_places, "host string, page long, place long")
    packed = F.collect_list(F.struct("place", "presentation", "ways", "content", "prose")).alias("known")
    return places.distinct().join(importance, ["host", "place"]).groupBy("host", "page").agg(packed)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (page_id, url, html)."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"(?s)^[^:]*://([^/?#]*)", 1), F.lit("")))
    sites = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                         F.col("html").cast("string").alias("html"), host.alias("host"))
    importance = materialise(site_importance(sites), "importance")
    few = small_enough(importance, BROADCAST_PLACES)
    spark = pages.sparkSession
    if few:
        told: dict[str, Importance] = {}
        for r in importance.collect():  # at most BROADCAST_PLACES rows
            told.setdefault(r["host"], {})[r["place"]] = (r["presentation"], r["ways"], r["content"], r["prose"])
        shared = spark.sparkContext.broadcast(told)
        ready = sites
    else:
        shared = None
        paged = sites.withColumn("page", F.xxhash64("html"))
        ready = paged.join(known_by_page(paged, importance), ["host", "page"], "left").select(
            "page_id", "url", "html", "host", "known")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i, (html, host) in enumerate(zip(batch["html"], batch["host"].to_pylist())):
                if shared is not None:
                    known = shared.value.get(host, {})
                else:
                    known = {r["place"]: (r["presentation"], r["ways"], r["content"], r["prose"])
                             for r in batch["known"][i].as_py() or ()}
                texts.append(main_text(html.as_py(), known))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return map_batches(ready, extract, EXTRACTED)
