"""Main text of web pages by site style trees.

First pass: each page's elements become style nodes, named by their path of tags and classes;
the pages of a host are merged by counting, for every node, how many distinct pages show each
presentation (sequence of child tags) and each content. A node's importance is the entropy of
its contents, mixed with that of its presentations, as a share of the most that so many pages
could have: 0 for a menu that is the same everywhere, near 1 for article text. Second pass:
each page is walked again, and branches of low importance on its host are left out.

Where few pages of a host show a node, its importance leans on the prior that it is content: the
prior counts as PRIOR_PAGES pages of importance 1, inside article and main elements as more. So
no number of pages switches the tree on, and each further page weighs in.

Entropy alone can't tell a menu or advert whose words change on every page from an article. So a
branch is also left out by what its markup says it is: its tag (nav, footer, aside, form and so
on), or a whole name among its classes, ids and roles that consists of boilerplate words and
words of place alone (ad, site-footer, sidebar_left; not comments-open, cookie-recipe or
search-results). Within article and main elements only names of reader comments, adverts, notices,
sign-up boxes, sidebars and menus count.
Where article and main elements hold the larger part of the kept text, only what lies in
them is taken, with the page's own h1 and lead in front of them. Articles that share their path
with others (cards of teasers) are ordinary branches. Names and forms
decide neither about article and main elements nor about branches that hold the larger part of
the page's text or half of what such elements hold.

Contents are counted per distinct page, in two combined steps; a host of any size is many
(node, content) keys. Pages are not shuffled: hosts' low nodes are joined to them. A page that
the tree would leave without any text (mirrors of one article) is taken without the tree, and
one that its markup then leaves without any is taken by its tags alone.

Nulls: null html is an empty page with text ""; a null or odd URL counts as host "". Repeated
pages count once in the tree and are extracted each. Whole pages are read, and nothing but
the branches named is dropped. Empty tables give empty results. Other columns pass through; one
named as the result is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_column, materialize, sliced, spread_join

#: Fixed values of HTML: tags, comments, elements without end tags, of raw text, and of blocks.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</[^a-zA-Z>][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
#: Elements and the words of classes, ids and roles that say a branch isn't the article. A form may
#: wrap the whole page, so it is judged as the words are.
BOILERPLATE_TAGS = frozenset("nav footer aside head script style noscript template iframe svg button select textarea menu dialog object embed canvas audio video".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar widget "
    "footer masthead cookie cookies consent gdpr notice notices popup modal overlay alert newsletter subscribe subscription signup login search share sharing social "
    "related recommended recommendations trending comment comments commentlist disqus respond reply replies discussion toolbar pagination pager skip copyright disclaimer "
    "complementary contentinfo dialog".split()
)
#: The same within article and main elements, and words of place that may stand beside either.
WORDS_IN_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising sponsored promo comment comments commentlist disqus respond newsletter subscribe subscription signup sidebar "
    "cookie cookies consent gdpr notice notices popup modal overlay breadcrumb breadcrumbs nav navbar navigation menu".split()
)
PLACE_WORDS = frozenset("site page main top bottom left right upper lower inner outer first second third primary secondary global local mobile desktop header box bar list links section area block wrapper wrap container content unit slot".split())

#: Pages of full importance that a node starts with, elsewhere and inside an article or main element, and the importance below which it is left out.
PRIOR_PAGES, PRIOR_PAGES_IN_MAIN = 2, 8
LOW = 0.3
CONTENT_SHARE = 0.9


#: What parse() tells besides texts and elements (their numbers).
POP, FLUSH, BREAK, SKIPPED = "pop", "flush", "break", "skipped"


class Element:
    """An element of a page: its style node, what its markup says, and the text that lies in it."""

    __slots__ = ("tag", "parent", "path", "hard", "weak", "main", "dead", "inside", "size", "main_size")

    def __init__(self, tag: str, parent: int, path: int, hard: bool, weak: str, main: bool) -> None:
        self.tag, self.parent, self.path, self.hard, self.weak, self.main = tag, parent, path, hard, weak, main
        self.dead, self.inside, self.size, self.main_size = False, False, 0, 0


class Walker:
    """Walks pages, leaving out branches, and names their style nodes."""

    def __init__(self) -> None:
        self.paths: dict[tuple, tuple[int, bool, bool, str, bool]] = {}

    def node(self, parent: int, in_main: bool, tag: str, attributes: str) -> tuple[int, bool, bool, str, bool]:
        """(path, is boilerplate by its tag, is hidden, what else says so ("", "name", "form"), is main) of an element."""
        key = (parent, in_main, tag, attributes if "=" in attributes or "hidden" in attributes.lower() else "")
        if (known := self.paths.get(key)) is not None:
            return known
        words, named, name, hidden, role = set(), False, tag, False, ""
        telling = WORDS_IN_MAIN if in_main else BOILERPLATE_WORDS
        for kind, a, b, c in ATTRIBUTE.findall(key[3]):
            kind, value = kind.lower(), a or b or c
            if kind in ("class", "id", "role"):
                for x in value.split():
                    own = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()))
                    words |= own
                    named |= bool(own & telling) and own <= telling | PLACE_WORDS
                name += f".{value}" if kind == "class" else ""
                role = value.lower() if kind == "role" else role
            elif kind == "style":
                hidden |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif kind in ("hidden", "aria-hidden"):
                hidden |= kind == "hidden" or value.lower() == "true"
        main = tag in ("article", "main") or role in ("main", "article")
        hard = tag in BOILERPLATE_TAGS or tag == "header" and not in_main
        outer = role == "banner" or "header" in words and not in_main and tag in ("div", "section", "table")
        weak = "name" if named else "form" if tag == "form" or outer else ""
        weak = "" if main or tag in ("html", "body") else weak
        found = xxhash.xxh3_64_intdigest(f"{parent}/{name}") >> 1, hard, hidden, weak, main
        if len(self.paths) > 200_000:
            self.paths.clear()
        self.paths[key] = found
        return found

    def parse(self, html: str, tags_alone: bool) -> tuple[list[Element], list]:
        """A page's elements and, in order, its texts (1-tuples), elements (numbers), and POP, FLUSH, BREAK
        and (SKIPPED, tag). An element is left out by its name or as a form only if neither the larger part of
        the page's text nor half of what article and main elements hold lies in it; where such elements have
        text, an element with a telling name is left out at any length."""
        elements = [Element("", -1, 0, False, "", False)]
        events: list = []
        stack = [0]
        at = 0

        def pop_to(k: int) -> None:
            while len(stack) > k:
                stack.pop()
                events.append(POP)

        while True:
            m = TOKEN.search(html, at)
            text = html[at : m.start()] if m else html[at:]
            if text:
                events.append((text,))
                top = elements[stack[-1]]
                if not top.dead:
                    top.size += len(text.strip())
            if not m:
                break
            at, tag = m.end(), m[2]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1]:
                k = next((k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag), 0)
                if k:
                    pop_to(k)
                elif tag not in INLINE:
                    events.append(FLUSH)
                continue
            if tag in VOID:
                if tag not in INLINE:
                    events.append(FLUSH)
                elif tag == "br":
                    events.append(BREAK)
                continue
            if tag not in INLINE:
                for k in range(len(stack) - 1, 0, -1):  # end tags that a start tag implies
                    own = elements[stack[k]].tag
                    if own == "p" or own in ENDS.get(tag, ()):
                        pop_to(k)
                    elif own in HOLDS.get(tag, "") or own not in INLINE and tag not in ENDS:
                        break
                events.append(FLUSH)
            if tag in RAW:
                events.append((SKIPPED, tag))
                end = re.compile(rf"</{tag}\b", re.I).search(html, at)
                at = end.start() if end else len(html)
                if end:
                    at = html.find(">", end.end()) + 1 or len(html)
                continue
            up = elements[stack[-1]]
            path, hard, hidden, weak, main = self.node(up.path, up.inside, tag, m[3])
            made = Element(tag, stack[-1], path, hard or hidden and not tags_alone, weak if not tags_alone or tag == "form" else "", main)
            made.dead, made.inside = up.dead or made.hard, up.inside or main
            stack.append(len(elements))
            events.append(len(elements))
            elements.append(made)
        pop_to(1)
        shown = Counter(x.path for x in elements if x.main and x.tag != "main")
        for x in elements:
            x.main = x.main and (x.tag == "main" or shown[x.path] == 1)
        for x in reversed(elements):
            x.main_size = x.size if x.main else x.main_size
            if x.parent >= 0:
                elements[x.parent].size += x.size
                elements[x.parent].main_size += x.main_size
        whole = elements[0]
        for x in elements:
            holds_main = x.main_size and 2 * x.main_size >= whole.main_size
            holds_text = 2 * x.size > whole.size and (x.weak == "form" or not whole.main_size)
            x.weak = x.weak if x.weak and not holds_main and not holds_text else ""
        return elements, events

    def walk(self, html: str, low: frozenset[int] = frozenset(), low_in_main: frozenset[int] = frozenset(), nodes: list | None = None, tags_alone: bool = False) -> list[str]:
        """The kept blocks of a page; nodes gets (path, presentation, content, in main) of each block element."""
        elements, events = self.parse(html, tags_alone)
        blocks: list[tuple[str, bool, bool]] = []  # text, in main, in h1
        run: list[str] = []
        # tag, path, left out, in main, first block, child tags, in h1
        stack: list[list] = [["", 0, False, False, 0, [], False]]
        top = stack[0]

        def flush() -> None:
            if run:
                text = " ".join("".join(run).split())
                run.clear()
                if text:
                    blocks.append((text, top[3], top[6]))

        for e in events:
            if isinstance(e, int):
                x = elements[e]
                out = top[2] or x.hard or bool(x.weak) or x.path in (low_in_main if top[3] else low)
                top[5].append(x.tag)
                top = [x.tag, x.path, out, not out and (top[3] or x.main), len(blocks), [], top[6] or x.tag == "h1"]
                stack.append(top)
            elif e is POP:
                tag, path, out, main, first, children, _ = top
                if tag not in INLINE:
                    flush()
                    if nodes is not None and not out:
                        nodes.append((path, " ".join(children), "\n".join(b for b, _, _ in blocks[first:]), main))
                stack.pop()
                top = stack[-1]
            elif e is FLUSH:
                flush()
            elif e is BREAK:
                if not top[2]:
                    run.append(" ")
            elif e[0] is SKIPPED and len(e) == 2:
                top[5].append(e[1])
            elif not top[2]:
                run.append(unescape(e[0]))
        flush()
        inside = [k for k, (_, main, _) in enumerate(blocks) if main]
        if 2 * sum(len(blocks[k][0]) for k in inside) <= sum(len(b) for b, _, _ in blocks):
            return [b for b, _, _ in blocks]
        if not any(blocks[k][2] for k in inside):
            headings = [k for k in range(inside[0]) if blocks[k][2]]
            inside = list(range(headings[-1], inside[0])) + inside if headings else inside
        return [blocks[k][0] for k in inside]


@arrow_column("array<struct<path:bigint,kind:string,seen:bigint,main:boolean>>")
def style_nodes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A page's style nodes: hashes of the presentation (p) and the content (c) of each."""
    walker, h = Walker(), lambda x: xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) >> 1
    kind = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.string()), ("seen", pa.int64()), ("main", pa.bool_())]))
    for pages in batches:
        found = []
        for part in sliced(pages):
            for html in part:
                nodes: list = []
                walker.walk(html or "", nodes=nodes)
                own = {(path, k, h(x), main) for path, shown, text, main in nodes if text for k, x in (("p", shown), ("c", text))}
                found.append([dict(zip(("path", "kind", "seen", "main"), x)) for x in own])
        yield pa.array(found, kind)


@arrow_column("string")
def main_text(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    walker = Walker()
    for pages, low, low_in_main in batches:
        out = []
        for i in range(0, len(pages), 256):
            for html, a, b in zip(*(x.slice(i, 256).to_pylist() for x in (pages, low, low_in_main))):
                out.append("\n".join(walker.walk(html or "", frozenset(a or ()), frozenset(b or ())) or (a or b) and walker.walk(html or "") or walker.walk(html or "", tags_alone=True)))
        yield pa.array(out, pa.string())


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def importance(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The site style trees: host, path, main, pages (distinct), importance."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    nodes = pages.select(host_of(F.col(url_col)).alias("host"), F.xxhash64(html).alias("page"), F.explode(style_nodes(html)).alias("n"))
    shown = nodes.groupBy("host", "n.path", "n.main", "n.kind", "n.seen", "page").agg(F.count("*")).groupBy("host", "path", "main", "kind", "seen").agg(F.count("*").cast("double").alias("c"))
    sums = shown.groupBy("host", "path", "main", "kind").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    entropy = F.when(F.col("n") > 1, (F.log("n") - F.col("s") / F.col("n")) / F.log("n")).otherwise(1.0)
    both = sums.withColumn("e", entropy).groupBy("host", "path", "main").agg(F.max(F.when(F.col("kind") == "c", F.col("n"))).alias("pages"), F.max(F.when(F.col("kind") == "c", F.col("e"))).alias("content"), F.max(F.when(F.col("kind") == "p", F.col("e"))).alias("presentation"))
    return both.select("host", "path", "main", "pages", (CONTENT_SHARE * F.col("content") + (1 - CONTENT_SHARE) * F.col("presentation")).alias("importance"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", out: str = "text") -> DataFrame:
    """pages with the main text of each."""
    tree = importance(pages, url_col, html_col)
    prior = F.when(F.col("main"), PRIOR_PAGES_IN_MAIN).otherwise(PRIOR_PAGES)
    tree = tree.where((prior + F.col("pages") * F.col("importance")) / (prior + F.col("pages")) < LOW)
    low = tree.groupBy("host").agg(F.collect_set(F.when(~F.col("main"), F.col("path"))).alias("_hn_low"), F.collect_set(F.when(F.col("main"), F.col("path"))).alias("_hn_low_in_main"))
    low = low.where((F.size("_hn_low") > 0) | (F.size("_hn_low_in_main") > 0)).withColumnRenamed("host", "_hn_host")
    low = materialize(low, "style-trees")
    rows = spread_join(pages.withColumn("_hn_host", host_of(F.col(url_col))), low, ["_hn_host"], "left", F.coalesce(F.col(id_col), F.lit(0)))
    return rows.withColumn(out, main_text(F.col(html_col), "_hn_low", "_hn_low_in_main")).drop("_hn_host", "_hn_low", "_hn_low_in_main")
