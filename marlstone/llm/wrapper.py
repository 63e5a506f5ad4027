"""Main text of pages by wrapper induction.

Pages of a host come from few templates. A page's layout is the row of its containers with their
classes. A bounded number of different pages of each host, and of each layout of a host that has
enough, (smallest hash of the html) is aligned by simple tree matching - the largest
order-preserving matching of equal-named block elements - into one tree: the wrapper. Runs of
paragraphs, headings and list items of equal structure are one node of it.

The wrapper then chooses the content from what its slots hold on these pages. Text that most of them
repeat is template. A slot whose text is mostly links is navigation. What is left varies, and the
main region is found by its mass: from the root on, as long as one container holds DOMINANT of the
varying text, the containers beside it are side slots and the search goes on inside it. Elements and
classes that say what they are (article, nav, footer, advert, comments, ...) are heeded where a page
has them: an article is the region, and a slot so named is out unless it has MAJOR of all varying
text. Every page is aligned with its layout's wrapper, or else its host's, and the blocks in its
content slots are its text, without the constant ones. Where that leaves nothing, the page is judged
by its own tree.

Constants are counted over all pages. A block of any length is template if CONSTANT_SHARE of a host's
different pages repeat it at one place, or of those in one layout, or of those that have the place
at all. In the last two counts pages with one longest block are one, so that an article's
own lines are not template because the article was copied with another date. Pages without any block
don't count, and only blocks that a host repeats at all go through these counts.

The wrappers are small, one row a host or layout; pages meet them by a join, whose hot keys AQE
splits. No task holds a host, and Arrow batches are bounded in bytes. Matching costs the product of
two child lists in vectorised steps, in bounded memory, and each pair of different structures once.

Defined cases: null or empty html has empty text; a null or odd url belongs to the host ''; a page
alone on its host is judged by its own tree; repeated rows each get a row; broken markup never
fails, however deep; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, give_back, join_apart, values
from .html_dom import Kind, Page, read

#: Different pages of a host or layout that its wrapper is induced from at most.
EXEMPLARS = 8
#: A block on so many and such a share of different pages, is template; a layout with
#: so many different pages has a wrapper of its own.
CONSTANT_PAGES = 3
CONSTANT_SHARE = 0.6
LINK_SHARE = 0.6
#: Share of a container's varying text that makes a part of it the main one; share of a page's
#: varying text that outweighs a class name.
DOMINANT = 0.75
MAJOR = 0.9
#: Cells of an alignment that are held at once; larger ones are halved.
CELLS = 1 << 26
#: Elements that are parts of a flow of text, and so may repeat in a run; all others are containers.
FLOW = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre option legend figcaption hr summary".split())
#: What a node of a wrapper is: content; on the way to it, with or without text of its own that counts;
#: beside it; navigation; named as no content.
CONTENT, WAY, STRICT_WAY, SIDE, LINKS, BOILER = "cwxslb"


class Tree:
    """A wrapper node, or a page's in the same form. own: text -> on how many pages, characters, of
    these in links."""

    __slots__ = ("kind", "kids", "nodes", "own", "structure", "size", "role")

    def __init__(self, kind: Kind):
        self.kind = kind
        self.kids: list[Tree] = []
        self.nodes: list[int] = []
        self.own: dict[int, list[int]] = {}
        self.structure, self.size, self.role = 0, 1, CONTENT

    def seal(self) -> None:
        """Name this tree's structure, once its children's are named."""
        self.size = 1 + sum(k.size for k in self.kids)
        self.structure = xxhash.xxh64_intdigest(f"{self.kind.name}:{','.join(str(k.structure) for k in self.kids)}")


def _each(root: Tree) -> list[Tree]:
    """All nodes, parents before their children."""
    out, stack = [], [root]
    while stack:
        t = stack.pop()
        out.append(t)
        stack.extend(t.kids)
    return out


def _add_own(into: Tree, other: Tree, pages: bool) -> None:
    for text, (n, chars, links) in other.own.items():
        got = into.own.setdefault(text, [0, 0, 0])
        got[0] = got[0] + n if pages else max(got[0], n)
        got[1] += chars
        got[2] += links


def _fold(into: Tree, other: Tree) -> None:
    """Put a tree of equal structure on the same page into this one."""
    stack = [(into, other)]
    while stack:
        a, b = stack.pop()
        a.nodes += b.nodes
        _add_own(a, b, pages=False)
        stack.extend(zip(a.kids, b.kids))


def text_name(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def tree_of(page: Page) -> Tree:
    trees = [Tree(k) for k in page.kinds]
    for node, text, links in page.blocks:
        got = trees[node].own.setdefault(text_name(text), [1, 0, 0])
        got[1] += len(text)
        got[2] += links
    for i in range(len(trees) - 1, -1, -1):  # children come after their parents, so all are whole here
        t = trees[i]
        t.nodes.append(i)
        t.kids.reverse()
        folded: list[Tree] = []
        for k in t.kids:
            if folded and k.kind.tag in FLOW and k.structure == folded[-1].structure:
                _fold(folded[-1], k)
            else:
                folded.append(k)
        t.kids = folded
        t.seal()
        if i:
            trees[page.parent[i]].kids.append(t)
    return trees[0]


def _rows(ix: np.ndarray, iy: np.ndarray, weight: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of the alignment's table, each from the one before."""
    row = np.zeros(len(iy) + 1, dtype=np.int64)
    for i in ix:
        new = np.zeros_like(row)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weight[i][iy]), out=new[1:])
        yield new
        row = new


def _last_row(ix: np.ndarray, iy: np.ndarray, weight: np.ndarray) -> np.ndarray:
    row = np.zeros(len(iy) + 1, dtype=np.int64)
    for row in _rows(ix, iy, weight):
        pass
    return row


def align(ix: np.ndarray, iy: np.ndarray, weight: np.ndarray, cells: int = CELLS) -> list[tuple[int, int]]:
    """The order-preserving pairs of two sequences of the largest total weight."""
    pairs: list[tuple[int, int]] = []
    stack = [(0, len(ix), 0, len(iy))]
    while stack:
        a, b, c, d = stack.pop()
        n, m = b - a, d - c
        if not n or not m:
            continue
        if n > 1 and n * m > cells:  # the best path crosses the middle row somewhere: halve it there
            mid = a + n // 2
            down = _last_row(ix[a:mid], iy[c:d], weight)
            up = _last_row(ix[mid:b][::-1], iy[c:d][::-1], weight)[::-1]
            at = c + int(np.argmax(down + up))
            stack += [(mid, b, at, d), (a, mid, c, at)]
            continue
        from_above, from_left = [], []
        row = np.zeros(m + 1, dtype=np.int64)
        for new in _rows(ix[a:b], iy[c:d], weight):
            from_above.append(np.packbits(new[1:] == row[1:]))
            from_left.append(np.packbits(new[1:] == new[:-1]))
            row = new
        bit = lambda bits, j: bits[j >> 3] >> (7 - (j & 7)) & 1
        i, j, part = n, m, []
        while i and j:
            if bit(from_above[i - 1], j - 1):
                i -= 1
            elif bit(from_left[i - 1], j - 1):
                j -= 1
            else:
                i, j = i - 1, j - 1
                part.append((a + i, c + j))
        pairs += part[::-1]
    return pairs


def _small_align(ix: list[int], iy: list[int], weight: list[list[int]]) -> list[tuple[int, int]]:
    """align() for a few cells, where setting up vectors costs more."""
    n, m = len(ix), len(iy)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        w, above, row = weight[ix[i]], best[i], best[i + 1]
        for j in range(m):
            row[j + 1] = max(above[j + 1], row[j], above[j] + w[iy[j]])
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _unequal(xs: list[Tree], ys: list[Tree], memo: dict) -> list[tuple[Tree, Tree]]:
    """Pairs of different structures under one name whose matching isn't known yet."""
    by_name: dict[str, dict[int, Tree]] = {}
    for y in ys:
        by_name.setdefault(y.kind.name, {})[y.structure] = y
    out: dict[tuple[int, int], tuple[Tree, Tree]] = {}
    for x in {x.structure: x for x in xs}.values():
        for y in by_name.get(x.kind.name, {}).values():
            key = (x.structure, y.structure)
            if x.structure != y.structure and key not in memo:
                if x.kids and y.kids:
                    out[key] = (x, y)
                else:
                    memo[key] = 1
    return list(out.values())


def _pairs(a: Tree, b: Tree, memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """Matched children of two nodes, by position, and the size of the matching below them. The
    matchings of the children's own pairs are in memo."""
    xs, ys = a.kids, b.kids
    lo, top = 0, min(len(xs), len(ys))
    while lo < top and xs[lo].structure == ys[lo].structure:  # equal ends belong to a largest matching
        lo += 1
    hi = 0
    while hi < top - lo and xs[-1 - hi].structure == ys[-1 - hi].structure:
        hi += 1
    n, m = len(xs) - hi, len(ys) - hi
    mid: list[tuple[int, int]] = []
    size = sum(x.size for x in xs[:lo]) + sum(x.size for x in xs[n:])
    if lo < n and lo < m:
        at_x, at_y = ({s: i for i, s in enumerate(dict.fromkeys(t.structure for t in ts))} for ts in (xs[lo:n], ys[lo:m]))
        first_x, first_y = ({t.structure: t for t in ts} for ts in (xs[lo:n], ys[lo:m]))
        weight = [
            [(x.size if s == r else memo[s, r]) if x.kind.name == first_y[r].kind.name else 0 for r in at_y]
            for s, x in ((s, first_x[s]) for s in at_x)
        ]
        ix, iy = [at_x[t.structure] for t in xs[lo:n]], [at_y[t.structure] for t in ys[lo:m]]
        if len(ix) * len(iy) <= 256:
            mid = _small_align(ix, iy, weight)
        else:
            mid = align(np.array(ix), np.array(iy), np.array(weight, dtype=np.int64))
        size += sum(weight[ix[i]][iy[j]] for i, j in mid)
    return size, [*((i, i) for i in range(lo)), *((lo + i, lo + j) for i, j in mid), *((n + k, m + k) for k in range(hi))]


def match(a: Tree, b: Tree, memo: dict | None = None) -> int:
    """Simple tree matching of two trees: the nodes of the largest matching that keeps names,
    parents and order. memo has what is known of pairs of structures."""
    memo = {} if memo is None else memo
    if a.kind.name != b.kind.name:
        return 0
    if a.structure == b.structure:
        return a.size
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        key = (x.structure, y.structure)
        if key not in memo and (wanted := _unequal(x.kids, y.kids, memo)):
            stack += wanted
            continue
        stack.pop()
        if key not in memo:
            memo[key] = 1 + _pairs(x, y, memo)[0]
    return memo[a.structure, b.structure]


def _merge(into: Tree, other: Tree, memo: dict) -> None:
    match(into, other, memo)
    stack = [(into, other)]
    while stack:
        a, b = stack.pop()
        _add_own(a, b, pages=True)
        pairs = [(i, i) for i in range(len(a.kids))] if a.structure == b.structure else _pairs(a, b, memo)[1]
        kids: list[Tree] = []
        i = j = 0
        for p, q in [*pairs, (len(a.kids), len(b.kids))]:
            kids += a.kids[i:p] + b.kids[j:q]
            if p < len(a.kids):
                kids.append(a.kids[p])
                stack.append((a.kids[p], b.kids[q]))
            i, j = p + 1, q + 1
        a.kids = kids
    for t in reversed(_each(into)):
        t.seal()


def _give_roles(root: Tree, n_pages: int, names: bool) -> None:
    """names: heed what elements and classes are called."""
    nodes = _each(root)
    constant = max(CONSTANT_PAGES, CONSTANT_SHARE * n_pages)
    text, links, varying = {}, {}, {}
    for t in reversed(nodes):
        of = (t.own.values(), [(text[id(k)], links[id(k)], varying[id(k)]) for k in t.kids])
        text[id(t)] = sum(c for _, c, _ in of[0]) + sum(k[0] for k in of[1])
        links[id(t)] = sum(x for _, _, x in of[0]) + sum(k[1] for k in of[1])
        varying[id(t)] = sum(c - x for n, c, x in of[0] if n < constant) + sum(k[2] for k in of[1])
    v = lambda t: varying[id(t)]
    major = MAJOR * v(root)
    for t in nodes:
        heavy = bool(t.kids) and v(t) > 0 and v(t) >= major
        if names and (t.kind.never or (t.kind.marked and not heavy)):
            t.role = BOILER
        elif text[id(t)] and links[id(t)] > LINK_SHARE * text[id(t)] and t.kind.tag not in ("p", "h1", "body", "html", "article", "main", "#root"):
            t.role = LINKS
    if names and _way_to_articles(root, text):
        return
    here = root
    while True:
        here.role = WAY
        parts = [k for k in here.kids if k.kind.tag not in FLOW and k.role == CONTENT]
        best = max(parts, key=v, default=None)
        if best is None or not v(best) or v(best) < DOMINANT * sum(v(k) for k in here.kids if k.role == CONTENT):
            break
        for k in parts:
            if k is not best:
                k.role = SIDE
        here = best
    here.role = CONTENT


def _way_to_articles(root: Tree, text: dict[int, int]) -> bool:
    """If the wrapper has articles, mark the way to the outermost ones, and all beside it as such."""
    order: list[tuple[Tree, Tree | None]] = []
    stack: list[tuple[Tree, Tree | None]] = [(root, None)]
    articles = []
    while stack:
        t, up = stack.pop()
        order.append((t, up))
        if t.role != CONTENT:
            continue
        if t.kind.content and text[id(t)]:
            articles.append(t)
        else:
            stack.extend((k, t) for k in t.kids)
    above = {id(t): up for t, up in order}
    way: set[int] = set()
    for t in articles:
        while (t := above[id(t)]) is not None and id(t) not in way:
            way.add(id(t))
    found = {id(t) for t in articles}
    for t, up in order:
        if id(t) in way:
            t.role = STRICT_WAY
        elif up is not None and id(up) in way and id(t) not in found and t.role == CONTENT:
            t.role = SIDE
    return bool(articles)


def induce(pages: list[Page], names: bool = True) -> Tree:
    """The wrapper of pages of one host or layout."""
    trees = [tree_of(p) for p in pages]
    memo: dict = {}
    for t in trees[1:]:
        _merge(trees[0], t, memo)
    _give_roles(trees[0], len(trees), names)
    return trees[0]


def to_json(wrapper: Tree) -> str:
    """Names, roles and numbers of children, parents before children."""
    out, stack = [], [wrapper]
    while stack:
        t = stack.pop()
        out.append([t.kind.name, t.role, len(t.kids)])
        stack.extend(reversed(t.kids))
    return json.dumps(out, separators=(",", ":"))


def from_json(text: str) -> Tree:
    items = json.loads(text)
    trees: list[Tree] = []
    open_: list[tuple[Tree, int]] = []
    for name, role, n in items:
        t = Tree(Kind(name.split(".")[0], name))
        t.role = role
        trees.append(t)
        while open_ and len(open_[-1][0].kids) == open_[-1][1]:
            open_.pop()
        if open_:
            open_[-1][0].kids.append(t)
        open_.append((t, n))
    for t in reversed(trees):
        t.seal()
    return trees[0]


def _in_content(page: Page, tree: Tree, wrapper: Tree, memo: dict, names: bool) -> list[bool]:
    """Of each node whether its own blocks are content."""
    role: dict[int, str] = {}
    below: dict[int, str] = {}  # roles of aligned nodes that have other children on this page
    if match(tree, wrapper, memo):
        stack = [(tree, wrapper)]
        while stack:
            x, y = stack.pop()
            for n in x.nodes:
                role[n] = y.role
            if y.role in (CONTENT, WAY, STRICT_WAY):
                pairs = [(i, i) for i in range(len(x.kids))] if x.structure == y.structure else _pairs(x, y, memo)[1]
                stack += [(x.kids[i], y.kids[j]) for i, j in pairs]
    inside = [True] * len(page.kinds)  # of nodes that lead to content: whether children count
    own = [True] * len(page.kinds)
    for i, kind in enumerate(page.kinds):
        up = page.parent[i]
        if i and not inside[up]:
            inside[i] = own[i] = False
            continue
        got = role.get(i)
        if got is None:  # not in the wrapper: part of what holds it, unless it is beside the way
            above = role.get(up, CONTENT)
            out = names and (kind.never or kind.marked)
            out = out or (above == STRICT_WAY and not kind.content) or (above == WAY and kind.tag not in FLOW)
            inside[i] = own[i] = not out
        else:
            inside[i] = got in (CONTENT, WAY, STRICT_WAY)
            own[i] = got in (CONTENT, WAY)
    return own


def extract(page: Page, wrapper: Tree | None, constants: set[tuple[int, int]] = frozenset(), memo: dict | None = None, names: bool = True) -> str:
    """The blocks of a page in content slots of its host's wrapper, joined by line ends."""
    memo = {} if memo is None else memo
    fresh = [text for node, text, _ in page.blocks if not constants or (page.path[node], text_name(text)) not in constants]
    if not fresh:
        return ""
    tree = tree_of(page)
    for w in (wrapper, None):
        if w is None:
            w = tree
            _give_roles(w, 1, names)
        own = _in_content(page, tree, w, memo, names)
        good = [text for node, text, _ in page.blocks if own[node] and (page.path[node], text_name(text)) not in constants]
        if good or w is tree:
            return "\n".join(good)
    return ""


# -- over tables ----------------------------------------------------------------------------------


def _host():
    return F.lower(F.coalesce(F.regexp_extract("url", r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _layout():
    """A hash of the containers of a page with their classes, as they are opened."""
    tags = F.regexp_extract_all(F.lower("html"), F.lit(r"<(?:div|section|article|main|nav|aside|header|footer|form|table|center)\b[^<>]*"), F.lit(0))
    name = lambda t: F.regexp_extract(t, r"^<(\w+)", 1)
    marks = lambda t: F.regexp_replace(F.regexp_extract(t, r"\sclass\s*=\s*(\"[^\"]*|'[^']*|[^\s>]*)", 1), r"[\"'\d]+", "0")
    return F.xxhash64(F.transform(tags, lambda t: F.concat_ws(".", name(t), marks(t))))


_COUNTED = "place long, host string, layout long, path long, text long, page long, main long"


def _block_batches(names: bool):
    """The different blocks of each page that are not named as no content; place names host, path and
    text, page and main name the page by its html and by its longest block."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            seen: dict = {}
            for host, layout, page, source in zip(*map(values, batch.columns)):
                parsed = read(source)
                out = [False] * len(parsed.kinds)
                for i, k in enumerate(parsed.kinds):
                    out[i] = names and (k.never or k.marked) or (i > 0 and out[parsed.parent[i]])
                blocks = [(parsed.path[n], t) for n, t, _ in parsed.blocks if not out[n]]
                main = text_name(max((t for _, t in blocks), key=lambda t: (len(t), t), default=""))
                for path, text in blocks:
                    seen[(host, layout, path, text_name(text), page, main)] = None
            rows = list(zip(*seen)) or [[]] * 6
            place = [xxhash.xxh64_intdigest(f"{p:x}/{t:x}/{h}") >> 1 for h, p, t in zip(rows[0], rows[2], rows[3])]
            kinds = (pa.int64(), pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(list(r), k) for r, k in zip((place, *rows), kinds)], [c.split()[0] for c in _COUNTED.split(", ")])
        give_back()

    return batches


def _induce_group(names: bool):
    def group(key: tuple, table: pa.Table) -> pa.Table:
        pages = sorted(zip(table.column("page").to_pylist(), table.column("html").to_pylist()))
        wrapper = induce([read(html) for _, html in pages], names)
        return pa.table([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int64()), pa.array([to_json(wrapper)])], ["host", "layout", "wrapper"])

    return group


def _extract_batches(names: bool):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: dict = {}
        for batch in it:
            texts = []
            wrappers, *constants = (batch.column(c) for c in ("wrapper", "constants", "own_constants"))
            for row, (host, layout, source) in enumerate(zip(*(values(batch.column(c)) for c in ("host", "layout", "html")))):
                key = (host, layout)  # two hosts may have one wrapper, but each has constants of its own
                if key not in learned:
                    if len(learned) > 256:
                        learned.clear()
                    wrapper = wrappers[row].as_py()
                    learned[key] = (from_json(wrapper) if wrapper else None, {(c["path"], c["text"]) for some in constants for c in some[row].as_py() or ()}, {})
                wrapper, gone, memo = learned[key]
                if len(memo) > 50_000:
                    memo.clear()
                texts.append(extract(read(source), wrapper, gone, memo, names))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["id", "url", "text", "n_chars"],
            )
        give_back()

    return batches


def _constants(counted: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Constant blocks of each host, and of each layout of a host; pages has each different page with
    any block once."""
    often = counted.groupBy("place").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONSTANT_PAGES).select("place")
    repeated = cut(join_apart(counted, often, ["place"]).drop("place"))
    listed = F.sort_array(F.collect_set(F.struct("path", "text")))
    mains = F.count_distinct("main")
    of_host = (
        repeated.groupBy("host", "path", "text")
        .agg(F.count_distinct("page").alias("on"), mains.alias("mains"))
        .filter(F.col("on") >= CONSTANT_PAGES)
        .join(pages.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host")
        .join(counted.groupBy("host", "path").agg(mains.alias("with_path")), ["host", "path"])
        .filter((F.col("on") >= CONSTANT_SHARE * F.col("n")) | ((F.col("mains") >= CONSTANT_PAGES) & (F.col("mains") >= CONSTANT_SHARE * F.col("with_path"))))
        .groupBy("host")
        .agg(listed.alias("constants"))
    )
    of_layout = (
        repeated.groupBy("host", "layout", "path", "text")
        .agg(mains.alias("mains"))
        .filter(F.col("mains") >= CONSTANT_PAGES)
        .join(counted.groupBy("host", "layout").agg(mains.alias("n")), ["host", "layout"])
        .filter(F.col("mains") >= CONSTANT_SHARE * F.col("n"))
        .groupBy("host", "layout")
        .agg(listed.alias("own_constants"))
    )
    return of_host, of_layout


def _wrappers(p: DataFrame, pages: DataFrame, exemplars: int, names: bool) -> DataFrame:
    """host, layout, wrapper; the host's own has no layout. The pages are chosen by their hashes, then read."""
    by_hash = lambda *of: F.row_number().over(Window.partitionBy(*of).orderBy("page"))
    of_host = pages.withColumn("k", by_hash("host")).filter(F.col("k") <= exemplars).withColumn("of", F.lit(None).cast("long"))
    sizes = pages.groupBy("host", "layout").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= CONSTANT_PAGES).drop("n")
    first = pages.withColumn("k", by_hash("host", "layout")).filter(F.col("k") <= exemplars)
    of_layout = first.join(sizes, ["host", "layout"], "left_semi").withColumn("of", F.col("layout"))
    chosen = cut(of_host.unionByName(of_layout).drop("k", "layout"))
    met = p.select("host", "page", "html").join(_bounded(chosen, F.octet_length("host") + 16), ["host", "page"])
    return (
        met.groupBy("host", "of", "page")
        .agg(F.min("html").alias("html"))
        .groupBy("host", "of")
        .applyInArrow(_induce_group(names), "host string, layout long, wrapper string")
    )


#: A learned table of up to so many bytes goes to all executors; a larger one is joined by a shuffle.
BROADCAST_BYTES = 64 << 20


def _bytes(df: DataFrame, of_row) -> int:
    return df.agg(F.sum(of_row.cast("long"))).first()[0] or 0


def _bounded(df: DataFrame, of_row) -> DataFrame:
    return F.broadcast(df) if _bytes(df, of_row) <= BROADCAST_BYTES else df


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", exemplars: int = EXEMPLARS, names: bool = True) -> DataFrame:
    """One row per input row: id, url, text, n_chars. names=False: learn from structure and text alone,
    without what elements and classes are called."""
    p = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    p = p.withColumn("host", _host()).withColumn("layout", F.coalesce(_layout(), F.lit(0))).withColumn("page", F.xxhash64("html"))

    counted = cut(p.select("host", "layout", "page", "html").mapInArrow(_block_batches(names), _COUNTED))
    different = cut(counted.select("host", "layout", "page").distinct())
    constants, own_constants = _constants(counted, different)
    wrappers = cut(_wrappers(p, different, exemplars, names))
    hosts = cut(wrappers.filter("layout is null").drop("layout").withColumnRenamed("wrapper", "host_wrapper").join(constants, "host", "left"))
    layouts = cut(wrappers.filter("layout is not null").join(own_constants, ["host", "layout"], "left"))
    listed = lambda c: 16 * F.coalesce(F.size(c), F.lit(0))
    learned = _bytes(hosts, F.octet_length("host_wrapper") + listed("constants")) + _bytes(layouts, F.octet_length("wrapper") + listed("own_constants"))
    if learned <= BROADCAST_BYTES:
        met = p.join(F.broadcast(hosts), "host", "left").join(F.broadcast(layouts), ["host", "layout"], "left")
    else:  # the pages travel once, to what their host and layout have learned
        learned_of = different.select("host", "layout").distinct().join(hosts, "host").join(layouts, ["host", "layout"], "left")
        met = p.join(cut(learned_of), ["host", "layout"], "left")
    met = met.select("id", "url", "html", "host", "layout", F.coalesce("wrapper", "host_wrapper").alias("wrapper"), "constants", "own_constants")
    out = met.mapInArrow(_extract_batches(names), "id long, url string, text string, n_chars long")
    return out.toDF(id_col, url_col, "text", "n_chars")
