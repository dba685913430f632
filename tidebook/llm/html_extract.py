"""Main text of web pages by wrapper induction.

Pages of a host share a wrapper.  All of a host's pages are parsed into trees, and its first page (by
a hash of its id) is aligned with each of the others by simple tree matching; what they find is
counted in each task and added up by host, so that no task holds a host.  Nodes of the first whose
text stays the same on the others are template; nodes that align but differ are slots.  Counts are
of the first page's nodes, a number bounded by that page.  A host's wrapper is then known as two things: the
texts of its template, and, for each path of tags and classes, how much of what hangs there is
constant.  Every page, whole, is parsed once more with its host's wrapper, and gives the text of its
content blocks: what neither the wrapper nor the meaning of its tags (navigation, header, footer,
aside, form, script, style, advert, notice, comment section ...) takes away.  Where a page has an
article or main element, the content is within it.

Defined results: a null or empty html gives an empty text; a null url is a host of its own; broken
markup is read as browsers do for the tags that matter (a new block closes the paragraph, a
closing tag closes what it encloses); an empty table gives no rows; repeated rows give a row each.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.common import staged

#: Names of HTML's elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td"
    " tfoot th thead tr ul caption".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas select head xmp noembed noframes".split())
DROPPED = frozenset("nav header footer aside form menu dialog button script style noscript template iframe select textarea title head svg math object canvas".split())
#: Words that mark a part as something else than the article, in class, id and role.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adbox sponsor sponsored sponsors promo promoted promotion banner banners"
    " cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup"
    " sidebar sidebars aside widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs toolbar pagination pager"
    " header masthead topbar footer foot colophon copyright related recommended recommendations share sharing social"
    " comment comments respond replies disqus discussion reader-comments login search searchbox skip skip-link tags"
    " complementary contentinfo".split()
)
#: Words that say only where a part is or what it is made of.  A name of marks and
#: these marks, as cookie-notice or comments-area do; post-header and category-social do not.
PLACES = frozenset("site global top bottom left right upper lower box bar area list wrapper wrap container buttons button links link icons".split())
#: Marks of what readers wrote.
READERS = frozenset("comment comments respond replies disqus discussion reader-comments".split())
#: Marks of what is no content even where it is most of a page.
NEVER = READERS | frozenset("ad ads advert adverts advertisement advertising adbox sponsor sponsored sponsors cookie cookies consent gdpr popup modal newsletter".split())
#: Ids of readers' parts, which no heading's anchor has; other ids in an article name its sections.
THREADS = frozenset("comments respond disqus_thread reader-comments".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
#: Name and value of each attribute; a quoted value is taken whole, so that nothing in it is read as a name.
_ATTRIBUTE = re.compile(r"""([^\s/=]++|=[^\s/=]*+)(?:\s*+=\s*+("[^"]*+"?|'[^']*+'?|\S*+))?""")
_WORDS = re.compile(r"[^\W\d_]+")


class Node:
    """An element: its label (tag and classes), its children, and its own text as text children."""

    __slots__ = ("article", "children", "dropped", "label", "parent", "shape", "tag", "text", "whole")

    def __init__(self, tag: str, label: str, parent: Node | None, dropped: bool = False):
        self.tag, self.label, self.parent, self.dropped = tag, label, parent, dropped
        self.article: bool = tag == "article" or parent is not None and parent.article
        self.children: list[Node | str] = []
        self.text: str | None = None


def marks_of(name: str) -> frozenset[str]:
    """Marks in a class, id or role, if the whole name is one or has nothing but marks and places."""
    parts = _WORDS.findall(name)
    whole = "-".join(parts)
    if whole in MARKS:
        return frozenset((whole,))
    return MARKS.intersection(parts) if all(x in MARKS or x in PLACES for x in parts) else frozenset()


def marked(attributes: str, tag: str, within: bool) -> tuple[str, bool, frozenset[str]]:
    """Classes and id of a tag, whether it is hidden, and the marks of something else than content.

    An id on a heading or `within` an article is the name of a place to link to, and marks nothing;
    an article itself is marked by the class of a reader's comment only."""
    names, hidden, seen, marks = [], False, set(), frozenset()
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in seen:  # the first of a name counts
            continue
        seen.add(key)
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            hidden = True
        elif key in ("class", "id", "role"):
            names += value.split()
            for name in value.split():
                if key == "id" and (tag in HEADINGS or (within and name not in THREADS)):
                    continue
                found = marks_of(name)
                if tag == "article":
                    found = found & READERS if key == "class" else frozenset()
                marks |= found
    return ".".join(sorted(names)), hidden, marks


def parse(page: str) -> Node:
    """The page's tree.  Raw elements (scripts, styles ...) are left out."""
    root = Node("", "", None)
    doubtful: list[tuple[Node, frozenset[str]]] = []
    at, node, end = 0, root, len(page)
    while at < end:
        m = _TAG.search(page, at)
        low = m.start() if m else end
        if low > at:
            node.children.append(entities.unescape(page[at:low]))
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA["):
                node.children.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = name.lower()
        if m[1]:
            above = node
            while above.parent is not None and above.tag != tag and not (tag not in BLOCK and above.tag in BLOCK):
                above = above.parent
            if above.tag == tag and above.parent is not None:
                node = above.parent
            continue
        if tag in BLOCK:
            node = _closed(node, tag)
        if tag in RAW and not m[3].rstrip().endswith("/"):
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if stop or tag not in ("head", "select", "object"):
                at = stop.end() if stop else end
            continue
        names, hidden, marks = marked(m[3], tag, node.article) if m[3].strip() else ("", False, frozenset())
        taken = tag in DROPPED or (hidden and tag not in ("html", "body", "main"))
        child = Node(tag, f"{tag}.{names}" if names else tag, node, taken)
        if marks and not taken and tag not in ("html", "body", "main"):
            doubtful.append((child, marks))
        node.children.append(child)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            node = child
    if doubtful:
        _drop(root, doubtful)
    return root


def _drop(root: Node, doubtful: list[tuple[Node, frozenset[str]]]) -> None:
    """Drops marked elements, but for those that hold most of the page's text in paragraphs; what
    readers wrote, adverts and consent stay only as an article that does."""
    order: list[tuple[Node, bool]] = []
    todo = [(root, False)]
    while todo:
        x, within = todo.pop()
        order.append((x, within))
        todo.extend((c, within or c.tag == "p") for c in x.children if isinstance(c, Node) and not c.dropped)
    letters: dict[int, int] = {}
    for x, within in reversed(order):
        letters[id(x)] = sum(letters.get(id(c), 0) if isinstance(c, Node) else len(c) if within else 0 for c in x.children)
    for x, marks in doubtful:
        most = 2 * letters.get(id(x), 0) > letters[id(root)]
        x.dropped = not (most and (x.tag == "article" or marks.isdisjoint(NEVER)))


def _closed(node: Node, tag: str) -> Node:
    """Where a new block goes: it ends an open paragraph, and an item ends the item before."""
    ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, ())
    above = node
    while above.parent is not None:
        if above.tag == "p" or above.tag in ends:
            return _closed(above.parent, tag)
        if above.tag in BLOCK:
            break
        above = above.parent
    return node


def text_of(node: Node) -> str:
    out: list[str] = []
    todo: list[Node | str] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            out.append(" ")
            todo.extend(reversed(x.children))
    return " ".join("".join(out).split())


def signed(root: Node) -> Node:
    """The tree with hashes of each node's labels below (`shape`) and of labels and texts (`whole`)."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(c for c in x.children if isinstance(c, Node))
    for x in reversed(order):
        x.shape = hash((x.label, *[c.shape for c in x.children if isinstance(c, Node)]))
        x.whole = hash((x.label, *[c.whole if isinstance(c, Node) else c for c in x.children]))
    return root


def matched(a: Node, b: Node, path: str, most: int, depth: int = 0) -> tuple[int, list[tuple[Node, Node, str]]]:
    """Simple tree matching of signed trees: the most nodes that align between two trees in order,
    and the pairs.

    Children at the end that are the same, and those at the beginning that have the same labels, are
    each other's partners: none is better.  `most` children of a node between them are aligned in
    full; what follows is compared position by position."""
    left = [x for x in a.children if isinstance(x, Node)]
    right = [x for x in b.children if isinstance(x, Node)]
    pairs = [(a, b, path)]
    if depth > 200:
        return 1, pairs
    found: dict[tuple[int, int], tuple[int, list]] = {}

    def same(i: int, j: int) -> tuple[int, list]:
        if left[i].label != right[j].label:
            return 0, []
        if (i, j) not in found:
            found[i, j] = matched(left[i], right[j], f"{path}/{left[i].label}", most, depth + 1)
        return found[i, j]

    total, below, ends = 0, [], min(len(left), len(right))
    tail = 0
    while tail < ends and left[-1 - tail].whole == right[-1 - tail].whole:
        tail += 1
    low = 0
    while low < ends - tail and left[low].shape == right[low].shape:
        low += 1
    for i, j in [*((k, k) for k in range(low)), *((len(left) - k, len(right) - k) for k in range(tail, 0, -1))]:
        more, down = same(i, j)
        total += more
        below.extend(down)
    left_end, right_end = len(left) - tail, len(right) - tail
    n, m = min(left_end - low, most), min(right_end - low, most)
    grid = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            grid[i + 1][j + 1] = max(grid[i][j + 1], grid[i + 1][j], grid[i][j] + same(low + i, low + j)[0])
    i, j = n, m
    total += grid[n][m]
    while i and j:
        if grid[i][j] == grid[i - 1][j]:
            i -= 1
        elif grid[i][j] == grid[i][j - 1]:
            j -= 1
        else:
            below.extend(same(low + i - 1, low + j - 1)[1])
            i, j = i - 1, j - 1
    for i in range(low + most, min(left_end, right_end)):
        more, down = same(i, i)
        total += more
        below.extend(down)
    return 1 + total, pairs + below


def longest(root: Node) -> str:
    """The longest text of a block outside of dropped parts that has no block in it."""
    best, todo = "", [root]
    while todo:
        x = todo.pop()
        below = [c for c in x.children if isinstance(c, Node) and not c.dropped]
        todo.extend(below)
        if x.tag in BLOCK and not any(c.tag in BLOCK for c in below):
            best = max(best, text_of(x), key=len)
    return best


class Reference:
    """A host's first page, which all of its pages are aligned with."""

    def __init__(self, page: str):
        self.root = signed(parse(page))
        self.longest = longest(self.root)

    def text(self, node: Node) -> str:
        if node.text is None:
            node.text = text_of(node)
        return node.text

    def aligned(self, page: str, most: int) -> tuple[set[str], Counter[str], Counter[str]] | None:
        """Texts of blocks that are the same on the page, and of each path how many blocks align and
        how many of them are the same.  None for the page itself and others with its longest text: a
        copy of the article would make its content look like template."""
        other = parse(page)
        if self.longest in text_of(other) and longest(other) == self.longest:
            return None
        here: set[str] = set()
        met: Counter[str] = Counter()
        steady: Counter[str] = Counter()
        for a, b, path in matched(self.root, signed(other), "", most)[1]:
            if a.tag not in BLOCK:
                continue
            one = self.text(a)
            two = one if a.whole == b.whole else text_of(b)
            if not one and not two:
                continue
            met[path] += 1
            if one == two:
                steady[path] += 1
                here.add(one)
        return here, met, steady


def induce(pages: list[str], most: int = 24) -> tuple[list[str], list[str]]:
    """Template texts and steady paths of a few pages at hand, the first of which is the reference."""
    first = Reference(pages[0])
    found = [x for x in (first.aligned(page, most) for page in pages[1:]) if x is not None]
    texts: Counter[str] = Counter()
    met: Counter[str] = Counter()
    steady: Counter[str] = Counter()
    for here, more, same in found:
        texts.update(here)
        met.update(more)
        steady.update(same)
    template = [x for x, n in texts.items() if n >= max(2, len(found) * 0.5)]
    return sorted(template), sorted(p for p, n in met.items() if n >= max(3, (len(found) + 1) // 2) and steady[p] >= 0.9 * n)


def extract(page: str, template: frozenset[str], steady: frozenset[str]) -> str:
    """Content blocks of one page, in page order."""
    root = parse(page)
    inside = _main(root)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text and not (inside is root and text in template):
            blocks.append(text)

    todo: list[tuple[Node | str | None, str]] = [(inside, _path(inside))]
    while todo:
        x, path = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif _gone(x, inside) or (path in steady and x.tag in BLOCK and text_of(x) in template):
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            line.append(" ")
        else:
            if x.tag in BLOCK:
                flush()
                todo.append((None, ""))
            for child in reversed(x.children):
                todo.append((child, f"{path}/{child.label}" if isinstance(child, Node) else ""))
    flush()
    return "\n\n".join(blocks)


def _path(node: Node) -> str:
    out = ""
    while node.parent is not None:
        out, node = f"/{node.label}{out}", node.parent
    return out


def _gone(node: Node, inside: Node) -> bool:
    """Dropped, but for the head of an article that holds its title."""
    if not node.dropped or node is inside:
        return False
    titled = inside.tag == "article" and "header" in node.label and any(isinstance(x, Node) and x.tag == "h1" for x in node.children)
    return not titled


def _letters(node: Node, apart: bool = False) -> int:
    """Letters of a node's text outside of dropped parts and links, and of articles if `apart`."""
    total, todo = 0, [node]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, str):
                total += len(" ".join(c.split()))
            elif not (c.dropped or c.tag == "a" or (apart and c.tag == "article")):
                todo.append(c)
    return total


def _main(root: Node) -> Node:
    """The article element with most text, outside of dropped parts and of other articles; but the
    main element, else the page, if the article is a small part (less than a quarter, or less than
    what is outside of all articles) of its text."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [root]
    while todo:
        x = todo.pop()
        if x.dropped:
            continue
        if x.tag in found:
            found[x.tag].append(x)
            if x.tag == "article":
                continue
        todo.extend(c for c in x.children if isinstance(c, Node))
    whole = max(found["main"], key=_letters) if found["main"] else root
    if not found["article"]:
        return whole
    article = max(found["article"], key=_letters)
    size = _letters(article)
    return article if size >= _letters(whole, apart=True) and 4 * size >= _letters(whole) else whole


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: Kinds of counts: pages of a host that are aligned, texts of blocks, paths.
PAGES, TEXT, PATH = 0, 1, 2


def wrappers(rows: DataFrame, broadcast_bytes: int, most: int = 24) -> DataFrame:
    """(host, template, steady) of every host, from all of its pages.

    Texts of the template are those that at least half of the pages have (two at least); steady are
    paths whose content is constant on nearly all pages with it, if half of them (three at least) are."""
    pages = rows.where("length(html) > 0")
    first = F.min_by("html", F.struct(F.xxhash64("page_id"), F.xxhash64("html"))).alias("first")
    firsts = staged(pages.groupBy("host").agg(first))
    paired = pages.join(_small(firsts, F.length("first").cast("long") + 64, broadcast_bytes), "host").select("host", "html", "first")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Reference] = {}
        sums: dict[tuple[str, int, str], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys, values = list(sums), list(sums.values())
            sums.clear()
            columns = [*(pa.array([x[k] for x in keys], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))), *(pa.array([x[k] for x in values], pa.int64()) for k in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, names=["host", "kind", "value", "met", "same"])

        def add(key: tuple[str, int, str], met: int, same: int) -> None:
            held = sums.setdefault(key, [0, 0])
            held[0] += met
            held[1] += same

        for batch in batches:
            for host, page, begin in zip(*(batch.column(c) for c in ("host", "html", "first")), strict=True):
                host, begin = host.as_py(), begin.as_py()
                if host not in known:
                    if len(known) >= 64:
                        known.clear()
                    known[host] = Reference(begin)
                found = known[host].aligned(page.as_py(), most)
                if found is None:
                    continue
                here, met, steady = found
                add((host, PAGES, ""), 1, 0)
                for text in here:
                    add((host, TEXT, text), 1, 1)
                for path, n in met.items():
                    add((host, PATH, path), n, steady[path])
                if len(sums) > 20_000:
                    yield flush()
        yield flush()

    counts = paired.mapInArrow(count, "host string, kind int, value string, met long, same long")
    counts = staged(counts.groupBy("host", "kind", "value").agg(F.sum("met").alias("met"), F.sum("same").alias("same")))
    pages_of = counts.where(F.col("kind") == PAGES).select("host", F.col("met").alias("pages"))
    both = counts.where(F.col("kind") != PAGES).join(pages_of, "host")
    template = F.when((F.col("kind") == TEXT) & (F.col("met") >= F.greatest(F.lit(2.0), F.col("pages") * 0.5)), F.col("value"))
    often = F.col("met") >= F.greatest(F.lit(3), F.floor((F.col("pages") + 1) / 2))
    steady = F.when((F.col("kind") == PATH) & often & (F.col("same") >= 0.9 * F.col("met")), F.col("value"))
    return both.groupBy("host").agg(F.sort_array(F.collect_list(template)).alias("template"), F.sort_array(F.collect_list(steady)).alias("steady"))


def _small(side: DataFrame, size: Column, most: int) -> DataFrame:
    """A side of few bytes goes to every task; a larger one is joined by a shuffle."""
    return F.broadcast(side) if (side.agg(F.sum(size)).first()[0] or 0) <= most else side


def main_text(pages: DataFrame, broadcast_bytes: int = 16_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    known = staged(wrappers(rows, broadcast_bytes))
    letters = F.expr("aggregate(concat(template, steady), 64L, (n, x) -> n + length(x) + 16)")
    wrapped = rows.join(_small(known, letters, broadcast_bytes), "host", "left").select("page_id", "url", "html", "template", "steady")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                texts = []
                for page, template, steady in zip(part.column("html"), part.column("template"), part.column("steady"), strict=True):
                    texts.append(extract(page.as_py() or "", frozenset(template.as_py() or ()), frozenset(steady.as_py() or ())))
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pc.cast(pa.array(texts), pa.string())], names=["page_id", "url", "text"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return wrapped.mapInArrow(read, f"page_id {kind}, url string, text string")
