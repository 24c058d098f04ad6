"""HTML extraction by wrapper induction.

Of each host some pages are drawn by a hash, and the one that has most nodes in common with the others is its reference, so an error page or an index drawn by chance
is outvoted. Every page of the host is aligned with it by simple tree matching: two nodes
match if tag and class agree, and the children of matching nodes are matched in order so that as many nodes as
possible match. Over all pages of the host this tells, for each node of the reference, how often its text is the
same and how much text varies. The content slot is found by that alone: from the root down to the child that gathers most of the varying text, but not past a heading
that varies beside it, and not into one of several siblings of one tag and class unless the pages agree on each of them. Nodes that say the same on nearly every page are
template. A page's text is what its own tree holds in the slot and in
the slot's siblings of its tag and class that match nothing, less template and less what
inside it tag, class or id mark as menu, header, footer, sidebar, notice, advert, form or comments; but a class or id drops only by a name that says nothing else, and
nothing that holds half or more of the host's varying text.

Pages are read where they lie: the references travel, and they are broadcast only if their counted size is below
MOST_BYTES; beyond it pages and references meet in a join on host. Counts are summed by host and node before they move, so a hot host
costs each task one row a node.

Defined cases: null or empty html gives an empty text. A null url, or one without ://, belongs to the host "". A host with
one page, or a page that doesn't hold the slot, is read by its own tags (main, article, else body). Rows with one page_id are
read alone. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches, materialise, tune

#: The references are broadcast up to this many characters. Pages drawn of each host to choose its reference from.
MOST_BYTES, DRAWN = 4 << 20, 5

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'">]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|[^<]+|<""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
#: What an opening tag ends of its own kind, if open; and where the search for it stops.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("html body table ul ol dl article section main aside nav div td th button".split())
DROPPED_TAGS = frozenset("head nav aside footer form script style noscript template iframe button select textarea input svg object embed canvas dialog title menu".split())
#: Marks in class, id or role of what isn't content: whole names, or names made of these words alone.
DROPPED_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget widgets ad ads adv advert adverts advertisement advertisements banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations comment comments replies reply respond disqus footer foot header masthead topbar toolbar copyright pagination pager skip hidden contentinfo complementary".split())
HEADER_PARENTS = frozenset(("article", "main", "section"))
HEADINGS = frozenset(("h1", "h2", "h3", "hgroup", "header"))


#: Why a node is dropped: its words, which the host's pages can overrule; its tag, or that it is hidden.
KEPT, BY_WORDS, BY_TAG = 0, 1, 2


class Node:
    """An element: tag, mark (tag and class), children, own text parts by place among the children, why it is dropped itself,
    and whether it or a node above it is."""

    __slots__ = ("tag", "mark", "children", "items", "dropped", "why", "number", "parent", "sign", "size")

    def __init__(self, tag: str, mark: str, why: int, parent: Node | None) -> None:
        self.tag, self.mark, self.why, self.parent = tag, mark, why, parent
        self.dropped = why > KEPT or parent is not None and parent.dropped
        self.children: list[Node] = []
        self.items: list[str | Node] = []
        self.number = -1
        self.sign = self.size = 0

    def own(self) -> str:
        """The text that stands in the node itself."""
        return " ".join(" ".join(x for x in self.items if x.__class__ is str).split())


def _why(tag: str, attributes: dict[str, str], parent: Node) -> int:
    if tag in DROPPED_TAGS or tag == "header" and parent.tag not in HEADER_PARENTS:
        return BY_TAG
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return BY_TAG
    if tag in ("body", "html", "main", "article"):
        return KEPT
    for word in " ".join(attributes.get(k, "") for k in ("class", "id", "role")).split():
        parts = re.findall("[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", word).lower())
        if parts and DROPPED_WORDS.issuperset(parts):
            return BY_WORDS
    return KEPT


def parse(page: str) -> Node:
    """The tree of a page, however malformed."""
    root = Node("#root", "#root", KEPT, None)
    at, place, end = root, 0, len(page)
    while place < end:
        m = _TOKEN.match(page, place)
        place = m.end()
        name = m[2] or m[5]
        if name is None:
            t = m[0]
            if t[0] != "<" or t == "<":
                at.items.append(t)
            continue
        tag = name.lower()
        if m[1] or m[4]:  # an end tag ends the nearest open element of its name
            x = at
            while x is not root and x.tag != tag:
                x = x.parent
            if x is not root:
                at = x.parent
            continue
        if tag in BLOCKS or tag in ENDS:
            ends = ENDS.get(tag, ()) if tag in ENDS else ()
            x = at
            while x is not root and (x.tag in ends or x.tag not in WALLS) and x.tag != "p" and x.tag not in ends:
                x = x.parent
            if x.tag in ends or x.tag == "p" and tag in BLOCKS:
                at = x.parent
        attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(m[3] or m[6] or "")}
        node = Node(tag, f"{tag}.{attributes.get('class', '')}", _why(tag, attributes, at), at)
        at.children.append(node)
        at.items.append(node)
        if tag in _RAW:
            stop = _RAW[tag].search(page, place)
            place = stop.start()
            node.why, node.dropped = BY_TAG, True
        if tag not in VOID:
            at = node
    return root


def number(root: Node) -> list[Node]:
    """All nodes in page order, numbered."""
    out, stack = [], [root]
    while stack:
        x = stack.pop()
        x.number = len(out)
        out.append(x)
        stack.extend(reversed(x.children))
    return out


def _sign(root: Node) -> None:
    """Sets sign and size of every node: subtrees of one sign have the same shape and marks."""
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(x.children)
    for x in reversed(order):
        x.sign = hash((x.mark, *(c.sign for c in x.children)))
        x.size = 1 + sum(c.size for c in x.children)


def _between(x: Node, y: Node) -> tuple[int, int, int]:
    """How many first and how many last children are alike, and how many nodes these hold. Some best matching always pairs them."""
    p, q = x.children, y.children
    most, lo, hi, held = min(len(p), len(q)), 0, 0, 0
    while lo < most and p[lo].sign == q[lo].sign:
        held += p[lo].size
        lo += 1
    while lo + hi < most and p[-1 - hi].sign == q[-1 - hi].sign:
        held += p[-1 - hi].size
        hi += 1
    return lo, hi, held


def _table(p: list[Node], q: list[Node], known: dict[tuple[int, int], int]) -> list[list[int]]:
    """best[i][j]: the most nodes that p[i:] and q[j:] match in order."""
    best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
    for i in range(len(p) - 1, -1, -1):
        row, below, x = best[i], best[i + 1], p[i]
        for j in range(len(q) - 1, -1, -1):
            y = q[j]
            row[j] = max(below[j], row[j + 1], below[j + 1] + _known(x, y, known) if x.mark == y.mark else 0)
    return best


def _known(x: Node, y: Node, known: dict[tuple[int, int], int]) -> int:
    if x.sign == y.sign:
        return x.size
    return known[id(x), id(y)] if x.children and y.children else 1


def _weigh(a: Node, b: Node, known: dict[tuple[int, int], int]) -> None:
    """Puts into known how many nodes match at most, for a and b and for what they need below."""
    stack = [(a, b, False)]
    while stack:
        x, y, ready = stack.pop()
        key = id(x), id(y)
        if key in known or x.sign == y.sign or not x.children or not y.children:
            continue
        lo, hi, held = _between(x, y)
        p, q = x.children[lo : len(x.children) - hi], y.children[lo : len(y.children) - hi]
        if ready:
            known[key] = 1 + held + _table(p, q, known)[0][0]
        else:
            stack.append((x, y, True))
            stack.extend((c, d, False) for c in p for d in q if c.mark == d.mark)


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """The pairs of matching nodes of two trees with matching roots, by simple tree matching: children are matched in order so that
    as many nodes as possible match in all, theirs and those below. Subtrees alike in whole are paired without weighing."""
    for root in (a, b):
        if not root.size:
            _sign(root)
    known: dict[tuple[int, int], int] = {}
    _weigh(a, b, known)
    pairs, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        pairs.append((x, y))
        if not x.children or not y.children:
            continue
        if x.sign == y.sign:
            stack.extend(zip(x.children, y.children, strict=True))
            continue
        lo, hi, _ = _between(x, y)
        p, q = x.children[lo : len(x.children) - hi], y.children[lo : len(y.children) - hi]
        stack.extend(zip(x.children[:lo], y.children[:lo], strict=True))
        stack.extend(zip(x.children[len(x.children) - hi :], y.children[len(y.children) - hi :], strict=True))
        best = _table(p, q, known)
        i = j = 0
        while i < len(p) and j < len(q):
            if p[i].mark == q[j].mark and best[i][j] == best[i + 1][j + 1] + _known(p[i], q[j], known):
                stack.append((p[i], q[j]))
                i, j = i + 1, j + 1
            elif best[i][j] == best[i + 1][j]:
                i += 1
            else:
                j += 1
    return pairs


def text_of(nodes: list[Node], template: set[int]) -> str:
    """The blocks under the nodes, in page order; template: nodes (by id()) to leave out."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        t = " ".join(html.unescape("".join(parts)).split())
        if t:
            blocks.append(t)
        parts.clear()

    for top in nodes:
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif x.__class__ is str:
                parts.append(x)
            elif x.dropped or id(x) in template:
                flush() if x.tag in BLOCKS else parts.append(" ")
            elif x.tag in ("br", "td", "th"):
                parts.append(" ")
                stack.extend(reversed(x.items))
            elif x.tag in BLOCKS or x is top:
                flush()
                stack.append(None)
                stack.extend(reversed(x.items))
            else:
                stack.extend(reversed(x.items))
        flush()
    return "\n\n".join(blocks)


def by_tags(nodes: list[Node]) -> list[Node]:
    """The content of a page by its own tags."""
    for tag in ("main", "article", "body"):
        found = [x for x in nodes if x.tag == tag and not x.dropped]
        if found:
            inside = {id(x) for x in found}
            return [x for x in found if not any(id(p) in inside for p in _above(x))]
    return nodes[:1]


def _above(x: Node) -> Iterator[Node]:
    while x.parent is not None:
        x = x.parent
        yield x


def _spare(nodes: list[Node], spared: set[int]) -> None:
    """Drops nodes (in page order) anew: those spared (by id()) not for their words."""
    for x in nodes:
        x.dropped = x.why == BY_TAG or x.why == BY_WORDS and id(x) not in spared or x.parent is not None and x.parent.dropped


def overruled(nodes: list[Node], counts: dict[int, tuple[int, int, int, int]]) -> set[int]:
    """The numbers of nodes that their words would drop, but that hold half or more of the text that varies."""
    _spare(nodes, {id(x) for x in nodes})
    varying = [0] * len(nodes)
    for x in reversed(nodes):
        if not x.dropped:
            varying[x.number] += counts.get(x.number, (0, 0, 0, 0))[2]
            if x.parent is not None:
                varying[x.parent.number] += varying[x.number]
    return {x.number for x in nodes if x.why == BY_WORDS and not x.dropped and 0 < varying[0] <= 2 * varying[x.number]}


def slot_and_template(nodes: list[Node], counts: dict[int, tuple[int, int, int, int]]) -> tuple[int | None, set[int], set[int]]:
    """The number of the slot, those of template nodes inside it, and those of nodes kept against their words. counts: by number,
    pages that match, pages that say the same, characters that vary, and characters that don't."""
    spared = overruled(nodes, counts)
    _spare(nodes, {id(nodes[i]) for i in spared})
    varying, same = [0] * len(nodes), [0] * len(nodes)
    for x in reversed(nodes):
        if not x.dropped:
            _, _, v, s = counts.get(x.number, (0, 0, 0, 0))
            varying[x.number] += v
            same[x.number] += s
            if x.parent is not None:
                varying[x.parent.number] += varying[x.number]
                same[x.parent.number] += same[x.number]
    if not varying[0]:
        return None, set(), spared
    slot, pages = nodes[0], lambda x: counts.get(x.number, (0, 0, 0, 0))[0]
    while True:
        child = max(slot.children, key=lambda x: varying[x.number], default=None)
        if child is None or child.tag not in BLOCKS or varying[child.number] * 10 < varying[slot.number] * 7:
            break
        if any(x is not child and x.tag in HEADINGS and varying[x.number] for x in slot.children):
            break
        alike = [x for x in slot.children if x.mark == child.mark]
        if len(alike) > 1 and min(map(pages, alike)) * 10 < pages(slot) * 9:  # which of them a page's content is, isn't known
            break
        slot = child
    if slot.tag == "p" and slot.parent is not None:
        slot = slot.parent
    inside = [x for x in nodes if x is slot or slot in _above(x)]
    fixed = {x.number for x in inside if not x.children and (c := counts.get(x.number)) and c[0] >= 10 and c[1] * 10 >= c[0] * 9}
    few = sum(counts[i][3] for i in fixed) * 5 <= varying[slot.number] + same[slot.number]
    return slot.number, fixed if few else set(), spared


def _with_siblings(slots: list[Node], matched: set[int]) -> list[Node]:
    """The page's slot among its siblings of the same mark that match nothing, in page order, without those dropped."""
    out = []
    for y in slots:
        around = y.parent.children if y.parent is not None else [y]
        out += [x for x in around if not x.dropped and (x is y or x.mark == y.mark and id(x) not in matched)]
    return out


@lru_cache(maxsize=256)
def _reference(page: str) -> tuple[Node, list[Node]]:
    root = parse(page)
    return root, number(root)


def _choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pages drawn of a host the one that matches the others best, the first of equals."""
    for b in batches(it):
        chosen = []
        for drawn in b.column("drawn").to_pylist():
            pages = list(dict.fromkeys(p for p in drawn if p))
            trees = [parse(p) for p in pages]
            alike = [sum(len(align(x, y)) for y in trees if y is not x) for x in trees]
            chosen.append(pages[alike.index(max(alike))] if pages else None)
        yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(chosen, pa.string())], ["host", "ref"])


def _count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int], list[int]] = {}

    def out() -> pa.RecordBatch:
        cols = [pa.array([h for h, _ in sums]), pa.array([i for _, i in sums], pa.int32()), *(pa.array([v[k] for v in sums.values()], pa.int64()) for k in range(4))]
        return pa.RecordBatch.from_arrays(cols, ["host", "node", "pages", "equal", "varying", "same"])

    for b in batches(it):
        for host, page, ref in zip(*(b.column(c).to_pylist() for c in ("host", "html", "ref")), strict=True):
            if not page or not ref:
                continue
            for x, y in align(_reference(ref)[0], parse(page)):
                s = sums.setdefault((host, x.number), [0, 0, 0, 0])
                p, q = x.own(), y.own()
                s[0] += 1
                s[1] += p == q
                s[2 + (p == q)] += len(q)
        if len(sums) > 50_000:
            yield out()
            sums.clear()
    if sums:
        yield out()


def _extract(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple[int | None, set[int], set[int]]] = {}
    for b in batches(it):
        texts = []
        for host, page, ref, counts in zip(*(b.column(c).to_pylist() for c in ("host", "html", "ref", "counts")), strict=True):
            if not page:
                texts.append("")
                continue
            root = parse(page)
            content, template = None, set()
            if ref and counts and max(c["pages"] for c in counts) > 1:
                reference, nodes = _reference(ref)
                if host not in known:
                    if len(known) >= 256:
                        known.clear()
                    known[host] = slot_and_template(nodes, {c["node"]: (c["pages"], c["equal"], c["varying"], c["same"]) for c in counts})
                slot, fixed, spared = known[host]
                pairs = align(reference, root) if slot is not None else []
                if spared and pairs:
                    kept, matched = {id(y) for x, y in pairs if x.number in spared}, {id(y) for _, y in pairs}
                    kept |= {id(z) for x, y in pairs if x.number in spared and x.number == slot for z in y.parent.children if z.mark == y.mark and id(z) not in matched}
                    _spare(number(root), kept)
                content = _with_siblings([y for x, y in pairs if x.number == slot], {id(y) for _, y in pairs})
                template = {id(y) for x, y in pairs if x.number in fixed and x.own() == y.own()}
            texts.append(text_of(content or by_tags(number(root)), template))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text (empty if none) of every row of pages (page_id, url, html)."""
    tune(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))
    pages = pages.select("page_id", "url", host.alias("host"), "html")
    page = F.when(F.length("html") > 0, F.col("html"))
    drawn = F.array(*(F.min_by(page, F.when(page.isNotNull(), F.struct(F.xxhash64("page_id", F.lit(i)), F.col("page_id")))) for i in range(DRAWN))).alias("drawn")
    refs = materialise(pages.groupBy("host").agg(drawn).mapInArrow(_choose, "host string, ref string"))
    size = refs.agg(F.sum(F.length("ref")), F.count("*")).first()
    near = F.broadcast if (size[0] or 0) + 100 * size[1] <= MOST_BYTES else lambda df: df
    counted = pages.select("host", "html").join(near(refs), "host").mapInArrow(_count, "host string, node int, pages long, equal long, varying long, same long")
    sums = counted.groupBy("host", "node").agg(*(F.sum(c).alias(c) for c in ("pages", "equal", "varying", "same")))
    counts = sums.groupBy("host").agg(F.collect_list(F.struct("node", "pages", "equal", "varying", "same")).alias("counts"))
    wrappers = materialise(refs.join(counts, "host", "left"))
    return pages.join(near(wrappers), "host").select("page_id", "url", "host", "html", "ref", "counts").mapInArrow(_extract, "page_id long, url string, text string")
