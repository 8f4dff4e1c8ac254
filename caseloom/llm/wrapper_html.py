"""HTML extraction by wrapper induction.

Pages of one host come from one template.  Each page is parsed to a DOM tree;
siblings of one label (tag and first class) are folded into one repeated node,
so a tree's size does not depend on how long the article is.  Trees of
a host are aligned by simple tree matching, top down and in order, and merged
into a wrapper: a node whose own text is the same on all pages is constant,
any other is a slot.  A page is aligned with its host's wrapper; its constant
nodes are template.  Its slots are judged over the host (``judge``): from the root
down, the part with most slot text outside links leads to the main text; parts
beside that way whose slot text is mostly links, with another label behind it that
hold structured items in varying number (reader comments), or that are articles of less
text, stand beside the text, whatever their tags and classes.  All other slots
are content, unless their own place says otherwise: headers, footers, sidebars,
notices, adverts and forms go by tag, role and class, but never with the page's
article or most of its slot text inside.  Hosts of fewer than ``LEAST_PAGES``
distinct pages have tags, roles and classes only.  A first heading inside an
article is its title and stays, constant or not.
The content slots inside all articles (or else all of the page's) are written
as blocks.

Merging is associative, so every task folds its own pages, partial wrappers
of a host are merged under a salt and then per host: a hot host's pages are
never gathered, only small trees.  A wrapper that outgrows ``WRAPPER_NODES``,
or is handed on, loses the nodes that fewer than ``KEEP`` of its pages have,
which leaves at most 1 / ``KEEP`` times the nodes of an average page: such nodes
are no template, so their text is kept.  Pages of one host with equal
html count once, over all tasks.  A node is template only if it is constant on
``SHARE`` of its host's distinct pages and on ``LEAST_PAGES`` or more, so an
article that a few pages copy is not taken for template.

Handled: null and empty html (empty text), broken markup, null or odd urls (a
host of their own), repeated rows, long pages; extra columns stay.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import small_batches, written

LEAST_PAGES = 4
#: Of a host's distinct pages, the share that must have a node for it to be template.
SHARE = 0.8
#: Nodes of partial wrappers that a task holds before it hands them on.
HELD_NODES = 200_000
SALTS = 64
#: Nodes and pages from which on a wrapper is pruned, and the share of its pages that a node needs to stay.
WRAPPER_NODES, PRUNED_PAGES, KEEP = 1000, 16, 0.25
#: Bytes of all wrappers up to which they are broadcast by host; beyond, they are joined to the pages.
BROADCAST_BYTES = 16_000_000
#: Characters of wrappers that a task keeps parsed.
KNOWN_CHARS = 8_000_000
#: A slot with more of its text in links is a list of links; a part with so much of the text outside links leads to the main text.
LINKS, MOST = 0.5, 0.5
#: Elements nested deeper lie beside their content, which keeps its text.
DEPTH = 200

#: Comments, declarations, tags, tags with odd quotes, text.  Every part is possessive or bounded, so that broken markup costs no backtracking.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"]{0,4000}"|'[^']{0,4000}')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|([^<]++|<)""", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: Raw elements whose text is never shown; any other that is not closed hides nothing.
UNSEEN = frozenset("script style".split())
#: A start tag of the key ends an open element of its values.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
DROP_TAG = frozenset("nav footer aside form button select dialog menu head canvas object audio video datalist label input".split()) | RAW
DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
DROP_WORD = frozenset(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice "
    "notices pager pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget widgets".split())
HEAD_WORD = frozenset("header masthead".split())
#: Parts that a class may have beside words of the above and still name the same thing (site-footer, comment-list).
PLACE_WORD = frozenset("area bar block bottom box center container global inner item items left link links list main page primary right row secondary section site top".split())
MAIN_TAG = {"article": 1, "main": 2}
#: Beside the text, however much they hold.
SIDE_TAG = frozenset("nav footer aside menu button select datalist label input canvas object audio video".split())
SIDE_WORD = frozenset("ad ads adv advert adverts advertisement breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu nav navbar navigation newsletter pager pagination related replies respond sidebar".split())


#: Elements that divide a page; up to so many siblings of one label are told apart by their order.
PART = frozenset("article aside body div footer form header main nav section table ul".split())
MOST_PARTS = 8


class Node:
    __slots__ = ("tag", "label", "drop", "main", "side", "kids", "hide", "weight")

    def __init__(self, tag: str, label: str, drop: bool, main: int, side: bool = False):
        self.tag, self.label, self.drop, self.main, self.side = tag, label, drop, main, side  # main: 1 an article, 2 the main part
        self.kids: list = []  # nodes and strings, in order
        self.hide: set = set()  # places of strings that are template
        self.weight: int | None = None  # characters of content, links left out


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(raw)}


def names(shown: str, words: frozenset) -> bool:
    """Whether a class or id, as a whole, is one of ``words``: no-sidebar or
    ad-free name no sidebar and no advert."""
    for token in shown.split():
        parts = [x for x in re.split(r"[_\-:]+", token) if x]
        if any(x in words for x in parts) and all(x in words or x in DROP_WORD or x in PLACE_WORD or x.isdigit() for x in parts):
            return True
    return False


def label_of(tag: str, classes: str) -> str:
    """Tag and first class without digits: those behind it and numbered ones
    often go by page (post-7, category-x)."""
    if tag in ("html", "body", "article", "main"):
        return tag
    return f"{tag}.{next((x for x in classes.lower().split() if not re.search('[0-9]', x)), '')}"


def _start(tag: str, raw: str, inside: bool) -> Node:
    if len(raw) < 5:
        return Node(tag, tag, tag in DROP_TAG or tag == "header" and not inside, MAIN_TAG.get(tag, 0), tag in SIDE_TAG)
    a = _attributes(raw)
    shown = f"{a.get('class', '')} {a.get('id', '')}".lower()
    role = a.get("role", "").lower()
    main = max(MAIN_TAG.get(tag, 0), MAIN_TAG.get(role, 0), 2 * (a.get("itemprop", "").lower() == "articlebody"))
    drop = tag in DROP_TAG or role in DROP_ROLE or "hidden" in a or a.get("aria-hidden") == "true"
    if not main and tag not in ("html", "body"):
        drop |= names(shown, DROP_WORD) or not inside and (tag == "header" or names(shown, HEAD_WORD))
    return Node(tag, label_of(tag, a.get("class", "")), drop, main, drop and (tag in SIDE_TAG or names(shown, SIDE_WORD)))


def parse(page: str | None) -> Node:
    """The DOM tree of a page; elements end where HTML lets them."""
    root = Node("#root", "#root", False, 0)
    stack, at, page = [root], 0, page or ""
    mains, unclosed = 0, set()
    while True:
        m = _TOKEN.match(page, at)
        if m is None:
            if at >= len(page):
                break
            stack[-1].kids.append(page[at])  # a "<" that begins nothing
            at += 1
            continue
        at = m.end()
        ending, tag, rest = m.group(1, 2, 3) if m[2] else m.group(4, 5, 6)
        if tag is None:
            if m[7]:
                stack[-1].kids.append(m[7])
            continue
        tag = tag.lower()
        if ending:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    mains -= sum(n.main for n in stack[i:])
                    del stack[i:]
                    break
            continue
        if tag in RAW and not rest.endswith("/"):
            close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if close or tag in UNSEEN:
                at = close.end() if close else len(page)
            else:
                unclosed.add(tag)
            continue
        ends = ENDS.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            t = stack[i].tag
            if t in ends or t == "p" and tag in BLOCK:
                mains -= sum(n.main for n in stack[i:])
                del stack[i:]
                break
            if t in ("ul", "ol", "dl", "table", "td", "th") or t in BLOCK and tag not in ENDS:
                break
        node = _start(tag, rest, mains > 0)
        stack[-1].kids.append(node)
        if tag not in VOID and not rest.endswith("/") and len(stack) < DEPTH:
            stack.append(node)
            mains += node.main
    return root


class Folded:
    """A wrapper node: label, pages that have it, hash of its own text (None:
    varies), children; over its pages, characters of own text outside and
    inside links, and the least and most siblings of its label.  members: the
    DOM nodes of a page behind it.  beside: judged to stand beside the text."""

    __slots__ = ("label", "pages", "text", "kids", "members", "prose", "links", "few", "many", "beside")

    def __init__(self, label, pages, text, kids, members=(), prose=0, links=0, few=1, many=1):
        self.label, self.pages, self.text, self.kids, self.members = label, pages, text, kids, members
        self.prose, self.links, self.few, self.many, self.beside = prose, links, few, many, False


def squeezed(s: str) -> str:
    return " ".join(html.unescape(s).split())


def fold(members: list[Node], linked: bool = False, siblings: int = 1) -> Folded:
    """A node's children with siblings of one label as one node, in the order
    of their first; a few parts of a page of one label stay apart."""
    own: list[str] = []
    kids: list[Folded] = []
    linked = linked or members[0].tag == "a"
    for n in members:
        own += [t for k in n.kids if isinstance(k, str) and (t := squeezed(k))]
        nodes = [k for k in n.kids if isinstance(k, Node)]
        count = Counter(k.label for k in nodes)
        groups: list[list[Node]] = []
        first: dict[str, list[Node]] = {}
        for k in nodes:
            if k.tag in PART and count[k.label] <= MOST_PARTS:
                groups.append([k])
            elif k.label in first:
                first[k.label].append(k)
            else:
                groups.append(first.setdefault(k.label, [k]))
        folded = [fold(g, linked, count[g[0].label]) for g in groups]
        kids = merge_kids(kids, folded) if kids else folded
    chars = sum(map(len, own))
    text = xxhash.xxh3_64_intdigest("\n".join(own)) >> 1 if own else 0
    return Folded(members[0].label, 1, text, kids, members, 0 if linked else chars, chars if linked else 0, siblings, siblings)


def matching(a: Folded, b: Folded) -> int:
    """Simple tree matching: the most node pairs that an order-preserving,
    top-down alignment of two trees can have."""
    if a.label != b.label:
        return 0
    return 1 + (_table(a.kids, b.kids)[0][-1][-1] if a.kids and b.kids else 0)


def _table(a: list[Folded], b: list[Folded]):
    score = [[matching(x, y) for y in b] for x in a]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + score[i - 1][j - 1])
    return best, score


def align(a: list[Folded], b: list[Folded]) -> list[tuple[Folded | None, Folded | None]]:
    """Children of two nodes in a common order; None where one has none."""
    if [x.label for x in a] == [y.label for y in b]:
        return list(zip(a, b))
    best, score = _table(a, b)
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and score[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + score[i - 1][j - 1]:
            i, j = i - 1, j - 1
            out.append((a[i], b[j]))
        elif j and (not i or best[i][j] == best[i][j - 1]):
            j -= 1
            out.append((None, b[j]))
        else:
            i -= 1
            out.append((a[i], None))
    return out[::-1]


def merge(a: Folded, b: Folded) -> Folded:
    a.pages += b.pages
    a.prose, a.links, a.few, a.many = a.prose + b.prose, a.links + b.links, min(a.few, b.few), max(a.many, b.many)
    if a.text != b.text:
        a.text = None
    a.members = [*a.members, *b.members] if a.members or b.members else ()
    a.kids = merge_kids(a.kids, b.kids)
    return a


def merge_kids(a: list[Folded], b: list[Folded]) -> list[Folded]:
    return [merge(x, y) if x is not None and y is not None else x or y for x, y in align(a, b)]


def merge_page(wrapper: Folded, page: Folded) -> Folded:
    """A wrapper with one more page or partial wrapper."""
    return merge(wrapper, page)


def bare(f: Folded) -> Folded:
    """Without its page's nodes, every count one page."""
    return Folded(f.label, 1, f.text, [bare(k) for k in f.kids], (), f.prose, f.links, f.few, f.many)


def dump(f: Folded) -> str:
    pack = lambda x: [x.label, x.pages, x.text, [pack(k) for k in x.kids], x.prose, x.links, x.few, x.many]
    return json.dumps(pack(f), separators=(",", ":"), ensure_ascii=False)


def load(s: str) -> Folded:
    make = lambda x: Folded(x[0], x[1], x[2], [make(k) for k in x[3]], (), *x[4:])
    return make(json.loads(s))


def size(f: Folded) -> int:
    return 1 + sum(map(size, f.kids))


def prune(f: Folded) -> Folded:
    """A wrapper of many pages without the nodes that few of them have."""

    def cut(n: Folded, least: float) -> None:
        n.kids = [k for k in n.kids if k.pages >= least]
        for k in n.kids:
            cut(k, least)

    if f.pages >= PRUNED_PAGES:
        cut(f, KEEP * f.pages)
    return f


class Growing:
    """A wrapper under construction, with its nodes counted after every merge.
    It is pruned when it has doubled since the last time."""

    __slots__ = ("tree", "nodes", "bound")

    def __init__(self, tree: Folded):
        self.tree, self.nodes, self.bound = tree, size(tree), WRAPPER_NODES

    def add(self, tree: Folded) -> int:
        """Merge one more; the nodes that came with it."""
        before = self.nodes
        self.tree = merge_page(self.tree, tree)
        self.nodes = size(self.tree)
        if self.nodes > self.bound and self.tree.pages >= PRUNED_PAGES:
            self.nodes = size(prune(self.tree))
            self.bound = max(WRAPPER_NODES, 2 * self.nodes)
        return self.nodes - before


def _inline(label: str) -> bool:
    return label != "#root" and label.split(".")[0] not in BLOCK


def _fixed(w: Folded) -> bool:
    """Whether a block's text, inline elements included, never varies."""
    return w.text is not None and all(_fixed(k) for k in w.kids if _inline(k.label))


def _hide(n: Node) -> None:
    for i, k in enumerate(n.kids):
        if isinstance(k, str):
            n.hide.add(i)
        elif _inline(k.label):
            _hide(k)


def _least(wrapper: Folded) -> float:
    """Pages on which a node of a host is constant when it is template."""
    return max(LEAST_PAGES, SHARE * wrapper.pages)


def _tag(label: str) -> str:
    return label.split(".")[0]


def _named_side(label: str) -> bool:
    tag, _, first = label.partition(".")
    return tag in SIDE_TAG or names(first, SIDE_WORD)


def _slots(n: Folded, least: float, known: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """Characters of slot text under a node outside and inside links."""
    prose, links = (0, 0) if n.text is not None and n.pages >= least else (n.prose, n.links)
    for k in n.kids:
        p, q = _slots(k, least, known)
        prose, links = prose + p, links + q
    known[id(n)] = prose, links
    return prose, links


def _items(n: Folded, pages: int) -> bool:
    """Whether a part holds blocks of several blocks each that repeat in
    varying number from page to page, as comments do."""
    if n.many > 1 and (n.few < n.many or n.pages < pages) and sum(not _inline(k.label) for k in n.kids) > 1:
        return True
    return any(_items(k, n.pages) for k in n.kids)


def judge(wrapper: Folded) -> Folded:
    """The wrapper with the parts marked that stand beside its host's main text,
    by what the host's pages hold there."""
    if wrapper.pages < LEAST_PAGES:
        return wrapper
    known: dict[int, tuple[int, int]] = {}
    _slots(wrapper, _least(wrapper), known)
    prose = lambda x: known[id(x)][0]
    n, off = wrapper, []  # off: articles that the way down passes by
    while n.label not in MAIN_TAG:
        kids = [k for k in n.kids if not _named_side(k.label)]
        if not kids:
            break
        main = max(kids, key=lambda k: (prose(k), k.label in MAIN_TAG))
        leads = (main.label == "html" or _tag(main.label) in PART) and prose(main) > MOST * prose(n)
        at = next(i for i, k in enumerate(n.kids) if k is main)
        for i, k in enumerate(n.kids):
            if k is main or _tag(k.label) not in PART:
                continue
            p, q = known[id(k)]
            # a part of the main one's own label is more of the same, not what readers say to it
            k.beside = q > LINKS * (p + q) or i > at and k.label not in (main.label, *MAIN_TAG) and _items(k, n.pages)
            if leads and not k.beside:
                off += _articles(k)
        if not leads:
            break
        n = main
    if n.label not in MAIN_TAG and prose(n) and not _articles(n):
        for k in off:
            k.beside = True
    return wrapper


def _articles(n: Folded) -> list[Folded]:
    return [n] if n.label in MAIN_TAG else [x for k in n.kids for x in _articles(k)]


def mark_template(wrapper: Folded, page: Folded, least: float | None = None, inside: bool = False) -> None:
    """Hide the text of the page's blocks that the wrapper has constant on
    ``least`` pages (at the root: by ``SHARE`` of all its pages), and drop the
    parts that it has beside the text."""
    if least is None:
        least = _least(wrapper)
    inside = inside or wrapper.label in MAIN_TAG
    if wrapper.beside:
        for n in page.members:
            n.drop = n.side = True
    if inside and _tag(wrapper.label) == "h1":
        return
    if not _inline(wrapper.label) and wrapper.pages >= least and wrapper.text == page.text and _fixed(wrapper):
        for n in page.members:
            _hide(n)
    for w, p in align(wrapper.kids, page.kids):
        if w is not None and p is not None:
            mark_template(w, p, least, inside)


def _weight(n: Node) -> int:
    if n.weight is None:
        n.weight = 0 if n.drop else _below(n)
    return n.weight


def _below(n: Node) -> int:
    """Characters of slot text under a node, dropped itself or not."""
    return sum((0 if i in n.hide else len(k.strip())) if isinstance(k, str) else _weight(k) * (k.tag != "a") for i, k in enumerate(n.kids))


def _regions(n: Node) -> list[Node]:
    """The article's nodes, outermost first."""
    out = []
    for k in n.kids:
        if isinstance(k, Node) and not k.drop:
            out += [k] if k.main else _regions(k)
    return out


def _dropped(n: Node) -> list[Node]:
    """The outermost dropped nodes below a node."""
    out = []
    for k in n.kids:
        if isinstance(k, Node):
            out += [k] if k.drop else _dropped(k)
    return out


def _shown(n: Node) -> bool:
    """Whether a node has any text that is no template, links included."""
    return not n.drop and any(i not in n.hide and bool(k.strip()) if isinstance(k, str) else _shown(k) for i, k in enumerate(n.kids))


def spare(root: Node) -> None:
    """Take back what was dropped wrongly: a node around a main part; where no
    article lies elsewhere, a node around one or with more slot text than all
    else.  Parts that by name stand beside the text go back only with the
    article and most of the text inside."""
    while True:
        outside, total, again = any(map(_shown, _regions(root))), _weight(root), False
        for n in _dropped(root):
            inner = [x for x in _regions(n) if _shown(x)]
            most = not outside and _below(n) > total
            if any(x.main > 1 for x in inner) or most and (inner or not n.side) or inner and not outside and not n.side:
                n.drop, again = False, True
        if not again:
            return
        _reweigh(root)


def _reweigh(n: Node) -> None:
    n.weight = None
    for k in n.kids:
        if isinstance(k, Node):
            _reweigh(k)


def content(root: Node) -> list[Node]:
    """The nodes that hold the content: all articles and main parts with text,
    or else the whole page."""
    spare(root)
    return [r for r in _regions(root) if _shown(r)] or [root]


def blocks(regions: list[Node]) -> list[str]:
    out, line = [], []

    def end():
        text = " ".join(html.unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    def walk(n: Node):
        block = n.tag in BLOCK
        if block:
            end()
        elif n.tag in ("br", "td", "th"):
            line.append(" ")
        for i, k in enumerate(n.kids):
            if isinstance(k, str):
                if i not in n.hide:
                    line.append(k)
            elif not k.drop:
                walk(k)
        if block:
            end()

    for r in regions:
        walk(r)
        end()
    return out


def extract(page: str | None, wrapper: Folded | None) -> str:
    """The main text of a page, its host's template taken off; where the
    template leaves nothing of it, the article as it stands."""
    if not page:
        return ""
    root = parse(page)
    if wrapper is not None:
        mark_template(wrapper, fold([root]))
        text = "\n".join(blocks(content(root)))
        if text:
            return text
        root = parse(page)
    return "\n".join(blocks(content(root)))


def host_of(url: Column) -> Column:
    """The host of a url in lower case; the url itself where it names none."""
    found = F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found).otherwise(F.concat(F.lit("?"), F.coalesce(url.cast("string"), F.lit(""))))


def _deep(fn, *args):
    """With room for the recursion over DEPTH levels."""
    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH + 1000))
    return fn(*args)


def _induce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Growing] = {}
    nodes = 0

    def out():
        return pd.DataFrame([(h, _deep(lambda t: dump(prune(t)), w.tree)) for h, w in held.items()], columns=["host", "wrapper"])

    for f in frames:
        for host, page in zip(f["host"].tolist(), f["html"].tolist()):
            tree = _deep(lambda p: bare(fold([parse(p)])), page)
            if host in held:
                nodes += _deep(held[host].add, tree)
            else:
                held[host] = _deep(Growing, tree)
                nodes += held[host].nodes
            if nodes > HELD_NODES:
                yield out()
                held, nodes = {}, 0
    if held:
        yield out()


def _merge_group(f: pd.DataFrame) -> pd.DataFrame:
    parts = sorted(f["wrapper"].tolist())
    wrapper = _deep(lambda p: Growing(load(p)), parts[0])
    for p in parts[1:]:
        _deep(lambda x: wrapper.add(load(x)), p)
    return f.head(1).assign(wrapper=_deep(lambda t: dump(prune(t)), wrapper.tree))


def distinct_pages(rows: DataFrame) -> DataFrame:
    """host and html, each pair once.  Only hashes are shuffled to find the
    copies; html is shuffled for copied pages alone."""
    keys = ["host", "h1", "h2"]
    rows = rows.filter("html != ''").withColumn("h1", F.xxhash64(F.lit(1), "html")).withColumn("h2", F.xxhash64(F.lit(2), "html"))
    copied = written(rows.groupBy(*keys).count().filter("count > 1").drop("count"), "page-copies")
    once = rows.join(copied, keys, "left_anti").select("host", "html")
    return once.union(rows.join(copied, keys, "left_semi").groupBy(*keys).agg(F.first("html").alias("html")).select("host", "html"))


def induce(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """host and wrapper (JSON) of every host."""
    rows = pages.select(host_of(F.col(url)).alias("host"), F.col(page).cast("string").alias("html"))
    parts = distinct_pages(rows).mapInPandas(_induce, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)).cast("int"))
    parts = parts.groupBy("host", "salt").applyInPandas(_merge_group, "host string, wrapper string, salt int")
    return parts.drop("salt").groupBy("host").applyInPandas(_merge_group, "host string, wrapper string")


class Known:
    """Parsed wrappers, up to ``KNOWN_CHARS`` of them."""

    def __init__(self):
        self.trees: dict[str, Folded] = {}
        self.chars = 0

    def get(self, wrapper: str | None) -> Folded | None:
        if not wrapper:
            return None
        if wrapper not in self.trees:
            if self.chars > KNOWN_CHARS:
                self.trees, self.chars = {}, 0
            self.trees[wrapper] = _deep(lambda x: judge(load(x)), wrapper)
            self.chars += len(wrapper)
        return self.trees[wrapper]


def main_text(pages: DataFrame, url: str = "url", page: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with the column ``main_text`` appended."""
    spark = pages.sparkSession
    wrappers = written(induce(pages, url, page), "wrappers")
    rows = pages.select(F.struct(*[pages[x] for x in pages.columns]).alias("_row"), host_of(F.col(url)).alias("host"), F.col(page).cast("string").alias("_html"))
    columns = [F.col("_row")[x].alias(x) for x in pages.columns if x != "main_text"]

    if (wrappers.agg(F.sum(F.octet_length("host") + F.octet_length("wrapper"))).first()[0] or 0) <= broadcast_bytes:
        by_host = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.collect()})
        wrapper_of = lambda x: by_host.value.get(x)
        given = F.col("host")
    else:
        small_batches(spark, 500)
        rows = rows.join(wrappers, "host", "left")
        wrapper_of = lambda x: x
        given = F.col("wrapper")

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = Known()
        for htmls, keys in batches:
            yield pd.Series([_deep(extract, h, known.get(wrapper_of(k))) for h, k in zip(htmls.tolist(), keys.tolist())], dtype=object)

    return rows.select(*columns, run("_html", given).alias("main_text"))
