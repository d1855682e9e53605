"""Main text of web pages by wrapper induction over the pages of a host."""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialise, shuffle_partitions, with_columns

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:@][^\s=/>"']*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
NAMED = re.compile("class|id=|id |role|hidden|style|itemprop", re.I)

#: HTML's elements by how they bear on text.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Never shown as text; the rest of a page is aligned before anything is judged by name.
NO_TEXT = frozenset("head svg canvas object audio video map datalist".split()) | RAW
FORMS = frozenset("form fieldset".split())
CHROME_TAGS = frozenset("nav footer aside button select option menu dialog label".split()) | FORMS
#: What a start tag ends: elements whose end tags may be left out.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPES = frozenset("table ul ol dl select html body article section main div td th blockquote".split())
#: Words in class, id or role that name what isn't the article.
CHROME = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices notification alert popup popover modal overlay toast newsletter subscribe subscription signup paywall comment comments commentlist commenter disqus reply replies respond discussion sidebar sidebars sidenav aside nav navbar navigation menu menus topbar toolbar breadcrumb breadcrumbs pagination pager footer foot copyright colophon masthead share sharing social related recommended recommendations trending popular widget widgets login search skip tags".split()
)
HEADS = frozenset("header head topnav contentinfo complementary".split())
CENTRES = frozenset(("article", "main"))
REMARKS = frozenset("comment comments commentlist reply replies respond".split())
#: Words at the front of a class that say what an element has, or how it is filed, not what it is.
ABOUT = frozenset("no not non without has have with hide hides show shows is category cat tag tagged topic post type format single page template paged status term taxonomy author date js layout align".split())
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")

LEAST_PAGES = 3  # distinct pages of a host that hold a template node
LEAST_SHARE, LEAST_SHARE_INSIDE = 0.2, 0.4  # of a host's distinct pages; for nodes within an article or main element
STEADY = 0.5  # of the pages that have a slot, in which its text must be the same
TOGETHER = 32  # distinct pages of a host that are aligned with one wrapper
EQUAL, DIFFERENT, DISTURBED, SHAPE_ONLY = 4, 2, 1, 1  # weights of matched nodes: same text, another text, another text where the slot looks constant, leaf with inner node
AT_ONCE = 1 << 20  # cells of an alignment of children that are kept; longer lists are halved first


class Node:
    """An element, or a leaf: a block of text, with the element around it where that has nothing else."""

    __slots__ = ("centre", "head", "inside", "keep", "kids", "label", "level", "safe", "size", "tag", "text")

    def __init__(self, tag: str, label: str, text: str | None = None) -> None:
        self.tag, self.label, self.text, self.kids = tag, label, text, []
        self.size, self.level, self.head, self.centre, self.safe, self.keep, self.inside = 0, 0, False, False, False, False, False


def attributes(text: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(text)}


def named(tag: str, attrs: dict[str, str]) -> tuple[int, bool]:
    """How surely an element's tag or names say that what it holds isn't the article (2: surely, 1: by a part of a
    name, 0: they don't), and whether they call it a header."""
    if tag in CHROME_TAGS:
        return 2, False
    if not attrs:
        return 0, tag == "header"
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return 2, False
    if tag in ("html", "body", "main"):
        return 0, False
    level, head = 0, tag == "header"
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')} {attrs.get('role', '')}".split():
        words = [w.lower() for w in SPLIT.split(name) if w]
        if len(words) > 1 and words[0] in ABOUT and not (tag == "article" and words[0] in REMARKS):
            continue
        head = head or bool(HEADS.intersection(words))
        known = REMARKS if tag == "article" else CHROME
        if len(words) == 1 and words[0] in known or name.lower() in known:
            level = 2
        elif known.intersection(words):
            level = max(level, 1)
    return level, head


def parse(page: str) -> Node:
    """A tree of block elements whose leaves are blocks of text.

    Inline elements only add their text to the block (those with names of adverts and the like are left out); a line break
    is white space. A block start ends an open paragraph.
    """
    root = Node("", "")
    stack = [root]
    inline: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        if parts:
            text = "".join(parts)
            parts.clear()
            words = (html.unescape(text) if "&" in text else text).split()
            if words:
                stack[-1].kids.append(Node("#", "#", " ".join(words)))

    at, n = 0, len(page)
    muted = 0  # inline elements that are open up to the one that isn't text
    gone = 0  # block elements that are open up to the one that is never text
    while at < n:
        m = TAG.search(page, at)
        if not m:
            if not muted and not gone:
                parts.append(page[at:])
            break
        if m.start() > at and not muted and not gone:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA[") and not muted and not gone:
                parts.append(html.escape(m[0][9:-3], quote=False))
            continue
        tag, closing, attrs = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if tag not in BLOCKS:
            if tag == "br" or tag == "wbr":
                parts.append(" " if tag == "br" and not gone and not muted else "")
            elif closing:
                if tag in inline:
                    while inline.pop() != tag:
                        pass
                    if len(inline) < muted:
                        muted = 0
            elif tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = end.end() if end else n
            elif tag not in VOID and not attrs.rstrip().endswith("/"):
                inline.append(tag)
                if not muted and (tag in NO_TEXT or named(tag, attributes(attrs) if NAMED.search(attrs) else {})[0]):
                    muted = len(inline)
            continue
        flush()
        inline.clear()
        muted = 0
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        elif tag != "hr":
            if tag == "body":  # a head that was never closed ends here
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "head":
                        del stack[k:]
                        break
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPES or stack[k].tag in ("li", "dd", "dt"):
                    break
            if tag in ENDS:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in ENDS[tag]:
                        del stack[k:]
                        if tag not in ("tr", "tbody", "tfoot"):
                            break
                    elif stack[k].tag in SCOPES and stack[k].tag not in ("td", "th"):
                        break
            found = attributes(attrs) if NAMED.search(attrs) else {}
            names = ".".join(sorted({re.sub(r"\d+", "0", x) for x in found["class"].split()})) if "class" in found and tag not in CENTRES and tag not in ("html", "body") else ""
            node = Node(tag, f"{tag}.{names}" if names else tag)
            node.level, node.head = named(tag, found)
            node.centre = tag in CENTRES or found.get("role") == "main" or found.get("itemprop") == "articleBody"
            stack[-1].kids.append(node)
            if not gone and tag in NO_TEXT:
                gone = len(stack)
            stack.append(node)
        if gone >= len(stack):
            gone = 0
    if not gone:
        flush()
    return root


def in_order(root: Node) -> list[Node]:
    """Nodes, each before what it holds, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += reversed(node.kids)
    return out


def judged(root: Node) -> list[Node]:
    """The leaves in page order, with ``keep`` where no name speaks against them; elements without text are cut off.

    The largest article or main element and what it stands in are never named away, nor a form, or an element whose names only
    contain such a word, that holds half of the page's text. Where an article or main element has text, only such text is kept.
    """
    nodes = in_order(root)
    for node in reversed(nodes):
        node.size = len(node.text) if node.text is not None else sum(k.size for k in node.kids)
        node.kids = [k for k in node.kids if k.size]
    centres = [x for x in nodes if x.centre and x.level < 2 and x.size]
    if centres:
        main, at = max(centres, key=lambda x: x.size), root
        todo, above = [root], {}
        while todo:
            at = todo.pop()
            if at is main:
                break
            for k in at.kids:
                above[id(k)] = at
                todo.append(k)
        while at is not None:
            at.safe = True
            at = above.get(id(at))
    leaves: list[Node] = []
    down: list[tuple[Node, bool, bool]] = [(root, False, False)]
    while down:
        node, dead, inside = down.pop()
        safe = node.safe or 2 * node.size >= root.size and (node.level == 1 or node.tag in FORMS)
        dead = dead or not safe and (node.level > 0 or node.head and not inside)
        inside = inside or node.centre and not dead
        node.keep, node.inside = not dead, inside and not dead
        if node.text is not None:
            leaves.append(node)
        down += [(k, dead, inside) for k in reversed(node.kids)]
    if any(x.inside for x in leaves):
        for x in leaves:
            x.keep = x.inside
    return leaves


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


def joined(path: int, value: int) -> int:
    return xxhash.xxh64_intdigest(value.to_bytes(8, "little"), path)


TREE = np.dtype([("depth", "<i4"), ("inside", "<i4"), ("label", "<u8"), ("value", "<u8")])
PARSED = "page_id long, url string, host long, mark long, tree binary, blocks array<struct<node:long,inside:boolean,text:string>>"


def tree_of(page: str) -> tuple[bytes, list[tuple[int, bool, str]]]:
    """The page's tree by hashes, a row a node, and the blocks of text that names leave: the hash of the labels above and
    of the text, whether within an article or main element, the text."""
    root = parse(page)
    leaves = judged(root)
    rows, out = [], []
    todo = [(root, 0, 0)]
    while todo:
        node, depth, path = todo.pop()
        leaf = node if node.text is not None else node.kids[0] if len(node.kids) == 1 and node.kids[0].tag == "#" else None
        label = hashed(node.label)
        path = joined(path, label)
        if leaf is None:
            rows.append((depth, 0, label, 0))
            todo += [(k, depth + 1, path) for k in reversed(node.kids)]
        else:
            value = hashed(leaf.text) or 1
            rows.append((depth, int(leaf.inside), label, value))
            if leaf.keep:
                out.append((joined(path, value), leaf.inside, leaf.text))
    return (np.array(rows, TREE).tobytes() if leaves else b""), out


def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    struct = pa.struct([("node", pa.int64()), ("inside", pa.bool_()), ("text", pa.string())])
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            trees = [tree_of(x or "") for x in part.column("html").to_pylist()]
            hosts = pa.array([signed(hashed(host(u))) for u in part.column("url").to_pylist()], pa.int64())
            marks = pa.array([signed(xxhash.xxh64_intdigest(t)) for t, _ in trees], pa.int64())
            found = pa.array([[{"node": signed(k), "inside": i, "text": t} for k, i, t in b] for _, b in trees], pa.list_(struct))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), hosts, marks, pa.array([t for t, _ in trees], pa.binary()), found], ["page_id", "url", "host", "mark", "tree", "blocks"])


class Slot:
    """A node of a wrapper: what is at one place in the pages that have it."""

    __slots__ = ("inside", "kids", "label", "most", "pages", "path", "seen", "values")

    def __init__(self, label: int, path: int) -> None:
        self.label, self.path, self.pages, self.most, self.inside = label, path, 0, 0, False
        self.kids: list[Slot] = []
        self.values: dict[int, list[int]] = {}  # of leaves: the pages that have this text here; ``most`` is the longest list
        self.seen: set[int] = set()  # of other nodes: texts of the leaves right below

    def leaf_weight(self) -> int:
        """Of a match with a leaf of another text."""
        return SHAPE_ONLY if self.kids else DISTURBED if self.most > 1 and self.most >= STEADY * self.pages else DIFFERENT


class Tag:
    """A node of a page, from its row."""

    __slots__ = ("inside", "kids", "label", "value")

    def __init__(self, inside: int, label: int, value: int) -> None:
        self.inside, self.label, self.value = inside, label, value
        self.kids: list[Tag] = []


def grown(tree: bytes) -> tuple[Tag, int]:
    """A page's tree from its rows, and its depth."""
    above: list[Tag] = []
    deepest = 0
    for depth, inside, label, value in np.frombuffer(tree, TREE).tolist():
        node = Tag(inside, label, value)
        del above[depth:]
        if above:
            above[-1].kids.append(node)
        above.append(node)
        deepest = max(deepest, depth)
    return above[0], deepest


def heaviest(n: int, m: int, row: Callable[[int], np.ndarray]) -> tuple[int, list[tuple[int, int]]]:
    """Weight and pairs (i, j) of the heaviest matching in order, ``row(i)`` being the weights of i with each j; pairs of
    weight 0 don't match. Long lists are halved where the best halves meet, so that memory stays linear."""

    def totals(rows: range, lo: int, hi: int, back: bool) -> np.ndarray:
        best = np.zeros(hi - lo + 1, dtype=np.int64)
        for i in rows:
            w = row(i)[lo:hi]
            w = w[::-1] if back else w
            best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + w))
        return best

    weight, pairs, todo = 0, [], [(0, n, 0, m)]
    while todo:
        a, b, lo, hi = todo.pop()
        if a == b or lo == hi:
            continue
        if (b - a) * (hi - lo) > AT_ONCE and b - a > 1:
            mid = (a + b) // 2
            cut = lo + int(np.argmax(totals(range(a, mid), lo, hi, False) + totals(range(b - 1, mid - 1, -1), lo, hi, True)[::-1]))
            todo += [(a, mid, lo, cut), (mid, b, cut, hi)]
            continue
        best, each = np.zeros((b - a + 1, hi - lo + 1), dtype=np.int64), []
        for i in range(a, b):
            each.append(row(i)[lo:hi])
            best[i - a + 1, 1:] = np.maximum.accumulate(np.maximum(best[i - a, 1:], best[i - a, :-1] + each[-1]))
        weight += int(best[-1, -1])
        i, j = b - a, hi - lo
        while i and j:
            w = int(each[i - 1][j - 1])
            if w and best[i, j] == best[i - 1, j - 1] + w:
                i, j = i - 1, j - 1
                pairs.append((a + i, lo + j))
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return weight, sorted(pairs)


def tree_matching(slot: Slot, node: Tag, known: dict[tuple[int, int], tuple[int, list]]) -> int:
    """Simple tree matching: weight of the heaviest matching that keeps labels, levels and order. ``known`` gets the pairs of
    children of every two nodes that were compared."""
    if slot.label != node.label:
        return 0
    if node.value:
        return EQUAL if node.value in slot.values else slot.leaf_weight()
    if not slot.kids:
        return SHAPE_ONLY
    at = (id(slot), id(node))
    if at in known:
        return known[at][0]
    xs, ys = slot.kids, node.kids
    if len(xs) == len(ys) == 1:
        weight = tree_matching(xs[0], ys[0], known)
        known[at] = DIFFERENT + weight, [(0, 0)] * bool(weight)
        return DIFFERENT + weight
    ours, theirs = np.array([x.label for x in xs], np.uint64), np.array([y.label for y in ys], np.uint64)
    leaf, plain = np.array([y.value != 0 for y in ys]), np.array([x.leaf_weight() for x in xs])
    where: dict[int, list[int]] = {}
    for j, y in enumerate(ys):
        if y.value in slot.seen:
            where.setdefault(y.value, []).append(j)

    def rows(lo: int, hi: int) -> np.ndarray:
        """Weights of our children from lo on with all of theirs."""
        same = ours[lo:hi, None] == theirs
        out = np.where(same, np.where(leaf, plain[lo:hi, None], SHAPE_ONLY), 0)
        for i in range(lo, hi) if where else ():
            for v in xs[i].values.keys() & where.keys():
                for j in where[v]:
                    if same[i - lo, j]:
                        out[i - lo, j] = EQUAL
        inner = np.array([bool(x.kids) for x in xs[lo:hi]])
        for i, j in np.argwhere(same & inner[:, None] & ~leaf).tolist():
            out[i, j] = tree_matching(xs[lo + i], ys[j], known)
        return out

    if len(xs) * len(ys) <= AT_ONCE:
        whole = rows(0, len(xs))
        weight, pairs = heaviest(len(xs), len(ys), lambda i: whole[i])
    else:
        weight, pairs = heaviest(len(xs), len(ys), lambda i: rows(i, i + 1)[0])
    known[at] = DIFFERENT + weight, pairs
    return DIFFERENT + weight


def merge(wrapper: Slot, page: Tag, number: int) -> None:
    """Aligns a page with the wrapper; what the wrapper lacks becomes part of it."""
    known: dict[tuple[int, int], tuple[int, list]] = {}
    tree_matching(wrapper, page, known)
    todo = [(wrapper, page)]
    while todo:
        slot, node = todo.pop()
        slot.pages += 1
        slot.inside = slot.inside or bool(node.inside)
        if node.value:
            mine = slot.values.setdefault(node.value, [])
            mine.append(number)
            slot.most = max(slot.most, len(mine))
            continue
        pairs = dict((j, i) for i, j in known.get((id(slot), id(node)), (0, []))[1])
        kids, done = [], 0
        for j, kid in enumerate(node.kids):
            if j in pairs:
                kids += slot.kids[done : pairs[j] + 1]
                done = pairs[j] + 1
                mine = slot.kids[pairs[j]]
            else:
                mine = Slot(kid.label, joined(slot.path, kid.label))
                kids.append(mine)
            if kid.value:
                slot.seen.add(kid.value)
            todo.append((mine, kid))
        slot.kids = kids + slot.kids[done:]


def constants(table: pa.Table) -> pa.Table:
    """One group of a host's pages, in the order of their marks: (host, node, inside, n) for the nodes that are constant at
    their place in the wrapper, n being the pages that have them there."""
    table = table.sort_by("mark")
    wrapper, held = None, {}
    for number, tree in enumerate(table.column("tree").to_pylist()):
        page, depth = grown(tree)
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * depth + 2000))
        wrapper = wrapper or Slot(page.label, joined(0, page.label))
        merge(wrapper, page, number)
    todo = [wrapper]
    while todo:
        slot = todo.pop()
        todo += slot.kids
        for value, pages in slot.values.items():
            if len(pages) > 1 and len(pages) >= STEADY * slot.pages:
                key = joined(slot.path, value)
                inside, mine = held.get(key, (False, set()))
                held[key] = inside or slot.inside, mine | set(pages)
    columns = [[table.column("host")[0].as_py()] * len(held), np.array(list(held), np.uint64).astype(np.int64), [i for i, _ in held.values()], [len(p) for _, p in held.values()]]
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()))], ["host", "node", "inside", "n"])


def templates(table: DataFrame) -> DataFrame:
    """(host, nodes): the nodes of a host that are template, from the distinct trees of its pages.

    A host's trees are dealt by their hash into groups of about TOGETHER, each aligned with a wrapper of its own; votes of all groups
    are summed. Groups don't depend on how the pages lie, and a large host is as many groups as it needs.
    """
    trees = table.where("octet_length(tree) > 0").select("host", "mark", "tree").dropDuplicates(["host", "mark"])
    trees = materialise(trees, "trees")
    sizes = materialise(trees.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES), "hosts")
    dealt = trees.join(sizes, "host").withColumn("part", F.pmod(F.xxhash64("mark"), F.ceil(F.col("pages") / TOGETHER)))
    dealt = dealt.select("host", "part", "mark", "tree").repartition(shuffle_partitions(table.sparkSession), "host", "part")
    votes = dealt.groupBy("host", "part").applyInArrow(constants, "host long, node long, inside boolean, n long")
    total = votes.groupBy("host", "node").agg(F.max("inside").alias("inside"), F.sum("n").alias("n")).join(sizes, "host")
    share = F.when(F.col("inside"), LEAST_SHARE_INSIDE).otherwise(LEAST_SHARE)
    return total.where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= share * F.col("pages"))).groupBy("host").agg(F.collect_list("node").alias("nodes"))


def html_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text (blocks in page order, joined by \\n) and n_chars, its code points.

    The whole DOM, cut down to block elements and blocks of text, is aligned with those of the same host by simple tree
    matching (see ``merge``, ``templates``). A text that stays the same at its place in the wrapper, in three distinct pages or more and a fifth of the host's
    (two fifths within an article or main element), is template and goes; varying slots are content. What alignment can't
    decide, slots that vary, names do: navigation, headers, footers, asides, forms, adverts, notices and comments go, and where the
    page has an article or main element all outside it (see ``judged``). Pages whose trees are equal count once; where
    template nodes would take more than half of the text in a page's article, pages are copies of one another and it stays.

    Null html is empty, as is a page without text. A null url is a host of its own. Broken markup, unclosed tags or
    comments, any depth and rows that repeat do no harm. The result doesn't depend on how rows are dealt. Empty in, empty
    out; other columns aren't looked at.
    """
    pages = with_columns(pages, page_id="long", url="string", html="string")
    table = materialise(pages.mapInArrow(parsed, PARSED), "pages")
    found = materialise(templates(table), "templates")
    joined_rows = table.select("page_id", "url", "host", "blocks").join(found, "host", "left")

    def chars(keep) -> Column:
        return F.aggregate(F.filter("blocks", keep), F.lit(0).cast("long"), lambda n, b: n + F.length(b["text"]))

    cut = lambda b: F.coalesce(F.array_contains("nodes", b["node"]), F.lit(False))
    copies = 2 * chars(lambda b: b["inside"] & cut(b)) > chars(lambda b: b["inside"])
    rows = joined_rows.withColumn("copies", F.when(F.col("nodes").isNull(), False).otherwise(copies))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: ~cut(b) | (b["inside"] & F.col("copies"))), lambda b: b["text"]), "\n")
    rows = rows.select("page_id", "url", F.when(F.col("nodes").isNull(), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n")).otherwise(text).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
