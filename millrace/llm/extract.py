"""Main text of web pages by wrapper induction.

Pages of one host and layout (the set of kinds of containers on them) share a template.  For each of a host's LAYOUTS most common
layouts one page (smallest hash of page_id) gives a reference tree; every page is aligned by simple tree matching with the reference of
its layout, or of its host's most common one.  Counts over all pages tell what each node of a reference is:

* template: the same text in TEMPLATE of at least MIN_PAGES aligned pages; it is dropped, wherever it stands;
* slot: text that varies; text of nodes that a reference does not have counts for the nearest node above that it has;
* menu: a list or container below the region whose text over all pages is link text by a share of MENU or more; it is dropped.

The region is the deepest container with a share of REGION of all varying text that is not link text.  A page's main text is what
stands in the node aligned with that region.  Names (class, id, role) and kinds of elements only decide what the counts leave open: a slot
that is named like an advert is dropped, unless it holds REGION of the host's varying text itself.  Pages whose tree does not align with
the region (and hosts where nothing varies) fall back on their own article, main or body element.

Matching is iterative, so nesting of any depth is followed.  Siblings whose table would have more than MOST_CELLS cells (or a page's
tables more than PAGE_CELLS) are paired in order by equal subtrees and then by label instead.

Skew: reference pages come from a partial aggregate (min_by); they are broadcast if few, else joined to
pages over salted hosts, so a host with a third of all pages is spread over SALTS tasks.  Statistics leave a task summed up.

Defined results: null html is an empty page; a null url is a host of its own (the empty name); a page without
main text gives an empty string; repeated rows stay; an empty table gives an empty table; only ``page_id``, ``url`` and
``html`` are read.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, read
from .dom import CONTAINERS, LISTS, Node, blocks, clean, number, own_text, parse
from .urls import split_url

TEMPLATE, MIN_PAGES, REGION, MENU, LAYOUTS = 0.8, 5, 0.6, 0.8, 3
MOST_CELLS, PAGE_CELLS = 10_000, 300_000
#: References, and characters of them, up to which these are broadcast.
MOST_BROADCAST, MOST_CHARS, SALTS = 3000, 32_000_000, 64


def in_order(xs: list[Node], ys: list[Node]) -> list[tuple[Node, Node]]:
    """Pairs of two long lists in linear time: the longest run of equal subtrees in order, between them equal labels."""
    where: dict[int, list[int]] = {}
    for j, y in enumerate(ys):
        where.setdefault(y.shape, []).append(j)
    nth, equal = Counter(), []
    for i, x in enumerate(xs):
        places = where.get(x.shape, ())
        if nth[x.shape] < len(places):
            equal.append((i, places[nth[x.shape]]))
            nth[x.shape] += 1
    ends: list[int] = []  # smallest last place of an increasing run of each length
    last: list[int] = []
    before: list[int] = []
    for k, (_, j) in enumerate(equal):
        n = bisect_left(ends, j)
        ends[n:n + 1], last[n:n + 1] = [j], [k]
        before.append(last[n - 1] if n else -1)
    run, k = [], last[-1] if last else -1
    while k >= 0:
        run.append(equal[k])
        k = before[k]
    run.reverse()
    found, i0, j0 = [], 0, 0
    for i1, j1 in [*run, (len(xs), len(ys))]:
        labels: dict[str, list[int]] = {}
        for j in range(j0, j1):
            labels.setdefault(ys[j].label, []).append(j)
        at = j0
        for i in range(i0, i1):
            places = labels.get(xs[i].label, ())
            n = bisect_left(places, at)
            if n < len(places):
                found.append((xs[i], ys[places[n]]))
                at = places[n] + 1
        if i1 < len(xs) and j1 < len(ys):
            found.append((xs[i1], ys[j1]))
        i0, j0 = i1 + 1, j1 + 1
    return found


class Matching:
    """Simple tree matching of two trees: the largest pairing of nodes that keeps labels, ancestors and order."""

    def __init__(self, cells: int = MOST_CELLS, page_cells: int = PAGE_CELLS):
        self.cells, self.left = cells, page_cells
        self.weights: dict[tuple[int, int], int] = {}
        self.plans: dict[tuple[int, int], tuple] = {}

    def plan(self, a: Node, b: Node) -> tuple[int, int, int, list | None]:
        """Where the children's equal start ends and their equal ends start, and pairs in between if too many for a table."""
        key = (a.index, b.index)
        if key not in self.plans:
            xs, ys, low = a.children, b.children, 0
            n, m = len(xs), len(ys)
            while low < n and low < m and xs[low].shape == ys[low].shape:
                low += 1
            while n > low and m > low and xs[n - 1].shape == ys[m - 1].shape:
                n, m = n - 1, m - 1
            area = (n - low) * (m - low)
            wide = area > min(self.cells, self.left)
            self.left -= 0 if wide else area
            self.plans[key] = low, n, m, in_order(xs[low:n], ys[low:m]) if wide else None
        return self.plans[key]

    def weight(self, a: Node, b: Node) -> int | None:
        """Nodes that the two subtrees have in common; None if not known yet."""
        if a.label != b.label:
            return 0
        return a.size if a.shape == b.shape else self.weights.get((a.index, b.index))

    def table(self, xs: list[Node], ys: list[Node]) -> list[list[int]]:
        best = [[0] * (len(ys) + 1)]
        for x in xs:
            row, above = [0], best[-1]
            for j, y in enumerate(ys):
                w = self.weight(x, y)
                row.append(max(above[j + 1], row[-1], above[j] + w if w else 0))
            best.append(row)
        return best

    def solve(self, a: Node, b: Node) -> int:
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self.weight(x, y) is not None:
                todo.pop()
                continue
            low, n, m, pairs = self.plan(x, y)
            xs, ys = x.children, y.children
            below = pairs if pairs is not None else [(c, d) for c in xs[low:n] for d in ys[low:m]]
            open_ = [p for p in below if self.weight(*p) is None]
            if open_:
                todo.extend(open_)
                continue
            ends = sum(c.size for c in xs[:low]) + sum(c.size for c in xs[n:])
            inner = sum(self.weight(*p) for p in pairs) if pairs is not None else self.table(xs[low:n], ys[low:m])[-1][-1]
            self.weights[x.index, y.index] = 1 + ends + inner
            todo.pop()
        return self.weight(a, b)

    def pairs(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The paired children of two paired nodes."""
        low, n, m, found = self.plan(a, b)
        xs, ys = a.children, b.children
        ends = [*zip(xs[:low], ys[:low]), *zip(xs[n:], ys[m:])]
        if found is not None:
            return ends + found
        xs, ys = xs[low:n], ys[low:m]
        best = self.table(xs, ys)
        i, j = len(xs), len(ys)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                ends.append((xs[i], ys[j]))
        return ends


def align(reference: Node, page: Node) -> list[tuple[Node, Node]]:
    """(node of the reference, node of the page) for all matched nodes."""
    if reference.label != page.label:
        return []
    matching = Matching()
    matching.solve(reference, page)
    found, todo = [], [(reference, page)]
    while todo:
        pair = todo.pop()
        found.append(pair)
        todo.extend(matching.pairs(*pair))
    return found


class Wrapper:
    """A layout's reference tree and what the counts say of its nodes.

    Counts per node: pages aligned, pages with the same text, characters that vary (without link text), link text.
    """

    def __init__(self, page: str, counts: str | None = None):
        self.root = parse(page)
        self.nodes = number(self.root)
        self.texts = [clean(own_text(n)) for n in self.nodes]
        self.region: Node | None = None
        self.constant: set[int] = set()
        self.menus: set[int] = set()
        self.trusted: set[int] = set()
        if counts:
            rows = json.loads(counts)
            self.learn(*[{r[0]: r[c] for r in rows} for c in (1, 2, 3, 4)])

    def _sums(self, values: dict[int, int], hidden: set[int]) -> list[int]:
        total = [0] * len(self.nodes)
        for n in reversed(self.nodes):
            if n.index not in hidden:
                total[n.index] = values.get(n.index, 0) + sum(total[c.index] for c in n.children)
        return total

    def _hidden(self, dropped) -> set[int]:
        hidden: set[int] = set()
        for n in self.nodes:  # page order: parents come first
            if dropped(n) or n.index in hidden:
                hidden.update(c.index for c in n.children)
                hidden.add(n.index)
        return hidden

    def learn(self, aligned: dict[int, int], same: dict[int, int], varying: dict[int, int], linked: dict[int, int]) -> None:
        # what only a name speaks against is believed if most of what varies is in it
        total = self._sums(varying, self._hidden(lambda n: n.forced))
        self.trusted = {n.index for n in self.nodes if n.dropped and not n.forced and total[0] and total[n.index] >= REGION * total[0]}
        hidden = self._hidden(lambda n: n.dropped and n.index not in self.trusted)
        total, links = self._sums(varying, hidden), self._sums(linked, hidden)
        many = {k for k, n in aligned.items() if n >= MIN_PAGES}
        self.constant = {k for k in many if same.get(k, 0) >= TEMPLATE * aligned[k] and self.texts[k]}
        best = None
        for n in self.nodes:
            if n.tag in CONTAINERS and n.index not in hidden and total[0] and total[n.index] >= REGION * total[0]:
                best = n  # nodes come in page order, so the last one is the deepest
                if n.tag in ("article", "main"):
                    break
        self.region = best
        self.menus = {
            n.index
            for n in self.nodes
            if n.tag in LISTS and n.index in many and total[n.index] < REGION * total[0]
            and links[n.index] >= MENU * (links[n.index] + total[n.index]) > 0
        }

    def mark(self, root: Node) -> Node | None:
        """Settles which nodes of a page are dropped; the node that stands for the region."""
        pairs = align(self.root, root)
        region = next((b for a, b in pairs if a is self.region), None)
        if region is None:
            return None
        for a, b in pairs:
            if a.index in self.trusted and not b.forced:
                b.dropped = False
            elif a.index in self.menus:
                b.dropped = True
            elif a.index in self.constant and not b.children and clean(own_text(b)) == self.texts[a.index]:
                b.dropped = True
        return region


def own_region(nodes: list[Node]) -> Node:
    """The page's article (the largest, if there are several and no main holds them), main or whole tree."""
    for tag in ("main", "article"):
        found = [n for n in nodes if n.tag == tag and not n.dropped]
        if tag == "main" and found:
            inner = [n for n in nodes if n.tag == "article" and not n.dropped]
            return inner[0] if len(inner) == 1 else found[0]
        if len(found) == 1:
            return found[0]
        if found:
            return max(found, key=lambda n: sum(map(len, blocks(n))))
    return nodes[0]


def main_text(page: str, wrapper: Wrapper | None) -> str:
    root = parse(page)
    nodes = number(root)
    region = None
    if wrapper is not None and wrapper.region is not None:
        region = wrapper.mark(root)
    if region is None:
        region = own_region(nodes)
    return " ".join(blocks(region))


#: What travels to the workers: the references and counts of a host (kind 0, best first) ahead of its pages (kind 1).
_SENT = ["host", "kind", "layout", "page_id", "url", "html", "counts"]
_KINDS = "article|main|section|div|nav|header|footer|aside|form|table|ul|ol|dl"


def layout(html: Column) -> Column:
    """The set of kinds of containers on a page."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?i)<({_KINDS})\b"), 1)
    return F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(tags, lambda t: F.lower(t)))), " "), F.lit(""))


def _run(pages: DataFrame, side: DataFrame, few: bool, work, schema: str) -> DataFrame:
    """``work`` over all pages with their wrappers; ``side`` has host, layout, place, reference and counts (may be null)."""
    host, _ = split_url(F.col("url"))
    rows = pages.select(
        host.alias("host"), F.lit(1).alias("kind"), layout(F.col("html")).alias("layout"), F.col("page_id").cast("long").alias("page_id"),
        "url", "html", F.lit(None).cast("string").alias("counts"),
    )
    sent = None
    if few:
        known: dict[str, dict[str, tuple]] = {}
        for r in side.orderBy("host", "place").collect():
            known.setdefault(r.host, {})[r.layout] = (r.reference, r.counts)
        sent = pages.sparkSession.sparkContext.broadcast(known)
    else:
        # references go to all salts of their host, where they are sorted ahead of the pages
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
        heads = side.select(
            "host", (F.col("place") - 1 - LAYOUTS).alias("kind"), "layout", F.lit(None).cast("long").alias("page_id"),
            F.lit(None).cast("string").alias("url"), F.col("reference").alias("html"), "counts",
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
        )
        rows = rows.unionByName(heads).repartition("host", "salt").sortWithinPartitions("host", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[tuple[str, str], Wrapper] = {}
        here: dict[str, tuple] = {}
        at = None

        def wrapper(host: str, mine: str) -> tuple[str, Wrapper]:
            own = here if sent is None else sent.value[host]
            mine = mine if mine in own else next(iter(own))
            if (host, mine) not in ready:
                if len(ready) > 300:
                    ready.clear()
                ready[host, mine] = Wrapper(*own[mine])
            return mine, ready[host, mine]

        def rows_of() -> Iterator[tuple]:
            nonlocal at
            for b in batches:
                for h, kind, kinds, i, url, page, counts in zip(*[b.column(c) for c in range(7)]):
                    h, kinds = h.as_py(), kinds.as_py()
                    if kind.as_py() < 1:
                        if at != h or here and kinds in here:
                            here.clear()
                            ready.clear()
                            at = h
                        here[kinds] = (page.as_py(), counts.as_py())
                    else:
                        yield i.as_py(), url.as_py(), h, page.as_py() or "", *wrapper(h, kinds)

        yield from work(rows_of())

    return rows.select(*_SENT).mapInArrow(run, schema)


_COUNTS = ["aligned", "same", "varying", "linked"]


def count_page(w: Wrapper, page: str) -> Iterator[tuple[int, int, int, int, int]]:
    """(node of the reference, aligned, same, varying characters, link characters) of one page."""
    root = parse(page)
    number(root)
    of = {n.index: a for a, n in align(w.root, root)}
    todo = [(root, None)]
    while todo:
        n, above = todo.pop()
        a = of.get(n.index)
        here = a if a is not None else above
        if here is not None:
            text = clean(own_text(n))
            links = min(len(text), n.linked)
            if a is None:
                yield here.index, 0, 0, len(text) - links, links
            elif text == w.texts[a.index]:
                yield a.index, 1, 1, 0, links
            else:
                yield a.index, 1, 0, len(text) - links, links
        # what stands in a part that is never main text does not count for the part above it
        todo.extend((c, here) for c in n.children if c.index in of or not c.dropped)


def _count(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """host, layout, node and its counts, summed over up to many pages."""
    sums: dict[tuple[str, str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        flat = [(*k, *v) for k, v in sums.items()]
        sums.clear()
        kinds = [pa.string()] * 2 + [pa.int64()] * 5
        return pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in flat], t) for c, t in enumerate(kinds)], names=["host", "layout", "node", *_COUNTS]
        )

    for _, _, h, page, kinds, w in rows:
        for k, *more in count_page(w, page):
            s = sums.setdefault((h, kinds, k), [0, 0, 0, 0])
            for c in range(4):
                s[c] += more[c]
        if len(sums) > 50_000:
            yield out()
    yield out()


def _extract(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    found: list[tuple] = []

    def out() -> pa.RecordBatch:
        cols = [pa.array([r[c] for r in found], t) for c, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64()))]
        found.clear()
        return pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])

    for i, url, _, page, _, w in rows:
        text = main_text(page, w)
        found.append((i, url, text, len(text)))
        if len(found) >= 500:
            yield out()
    yield out()


def references(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """host, layout, place (1: the most common layout) and reference of each host's LAYOUTS most common layouts."""
    host, _ = split_url(F.col("url"))
    order = F.struct(F.xxhash64("page_id"), F.coalesce(F.col("page_id").cast("long"), F.lit(-1).cast("long")))
    every = scratch.keep(
        pages.select(host.alias("host"), "page_id", layout(F.col("html")).alias("layout"), F.coalesce("html", F.lit("")).alias("html"))
        .groupBy("host", "layout")
        .agg(F.min_by("html", order).alias("reference"), F.count("*").alias("n"))
    )
    # pages without any container are no layout where the host has others
    by = Window.partitionBy("host").orderBy(F.col("layout") == "", F.desc("n"), "layout")
    best = every.select("host", "layout", "n").withColumn("place", F.row_number().over(by)).where(F.col("place") <= LAYOUTS)
    return scratch.keep(every.drop("n").join(best.drop("n"), ["host", "layout"]))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    scratch = Scratch(pages.sparkSession, "wrappers")
    side = references(pages, scratch)
    few = bounded(side, MOST_BROADCAST)
    few = few and (side.agg(F.sum(F.length("reference"))).first()[0] or 0) <= MOST_CHARS
    blank = side.withColumn("counts", F.lit(None).cast("string"))
    schema = "host string, layout string, node long, " + ", ".join(f"{c} long" for c in _COUNTS)
    counts = (
        _run(pages, blank, few, _count, schema)
        .groupBy("host", "layout", "node")
        .agg(*[F.sum(c).alias(c) for c in _COUNTS])
        .groupBy("host", "layout")
        .agg(F.to_json(F.sort_array(F.collect_list(F.array("node", *_COUNTS)))).alias("counts"))
    )
    learned = scratch.keep(side.join(counts, ["host", "layout"], "left"))
    return _run(pages, learned, few, _extract, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read(spark, sf_dir, "pages"))
