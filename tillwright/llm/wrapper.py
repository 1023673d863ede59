"""Main text of web pages by wrapper induction.

Pages of a host come from one template. A few reference pages per host are chosen by a hash of their content. Every
page is aligned with them by simple tree matching (Yang, 1991), which pairs nodes of equal label in order and level by
level. For each text slot of a reference the pages vote whether they hold the same text there. Slots with one text on
nearly all distinct pages of the host are template, the others hold content; a block is kept whole if any of its slots
holds content. Extraction aligns a page with its host's
wrapper again and leaves out template slots, and besides what an element says it is: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments, by name, class or id. Where a page has an article or main
element, only that counts.

The votes are sums per host and slot, combined in the tasks before they are moved; the wrappers are small and go back
to the pages by a join on the host, broadcast only below a checked size. A host with few distinct pages has no template
slots. Copies of a page vote once. Null or empty html gives an empty text; a null url is a host of its own. Rows with
equal ids are kept. An empty table gives no rows. Other columns are ignored.

Very long and very deep pages take memory in proportion to their nodes. Of pages
with equal content one may be a reference.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwright.llm.common import in_chunks, stage_compressed
from tillwright.llm.dom import BLOCK, RAW, Node, one_spaced, parse
from tillwright.plans.skew import join_key_facts

REFERENCES = 2
# A slot is template if this share of the host's distinct pages, and at least so many pages, hold the same text in it.
CONSTANT_SHARE, CONSTANT_PAGES = 0.9, 5
# Tables of more cells than this are not kept for alignment; halves of the list are aligned on their own then.
TABLE_CELLS = 160_000
BROADCAST_HOSTS = 2_000
# Calls of Python functions within each other: a few per level of a page. They take heap memory, not the thread's stack.
MOST_CALLS = 10_000_000

# Element names and words in class, id or role that mark what is not the article.
ASIDE_TAGS = frozenset("nav header footer aside form button input select option dialog menu head".split()) | RAW
ASIDE_WORD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|hidden|masthead|menu|"
    r"modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|share|sharing|"
    r"sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])"
)
# Class words that say what an element comes with or without, not what it is.
MODIFIER = re.compile(r"(?:^|(?<=\s))(?:[^\s]*[_-])?(?:has|no|with|without)[_-]\S*")
# Reader comments stay aside however long they are.
COMMENT_WORD = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|replies|respond)(?:$|[\s_-])")
MAIN_TAGS = ("article", "main")


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute address, empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _is_aside(node: Node) -> bool:
    return node.tag in ASIDE_TAGS or bool(node.text and ASIDE_WORD.search(MODIFIER.sub(" ", node.text)))


def _is_main(node: Node) -> bool:
    return node.tag in MAIN_TAGS or node.text == "main" and node.tag != "#text"


def _layout_elements(root: Node, template: set[int]) -> tuple[set[int], set[int]]:
    """Ids of elements that hold the page whatever they are called, and of those that are or hold an article.

    The first are html, body, what is or holds a main element, and forms or elements with a telling class that hold
    more than half of the text that isn't template. Elements that a name of HTML or a class of comments sets aside are
    not among them for their text alone.
    """
    order, pending = [], [(root, -1)]
    while pending:
        node, parent = pending.pop()
        pending += [(child, len(order)) for child in node.children]
        order.append((node, parent))
    sizes, mains, articles = [0] * len(order), [False] * len(order), [False] * len(order)
    for at in range(len(order) - 1, -1, -1):
        node, parent = order[at]
        if node.tag == "#text":
            sizes[at] = 0 if id(node) in template else len(node.text.strip())
        elif _is_main(node):
            articles[at] = True
            mains[at] |= node.tag != "article"
        if parent >= 0:
            sizes[parent] += sizes[at]
            mains[parent] |= mains[at]
            articles[parent] |= articles[at]
    layout, holding = set(), set()
    for (node, _), size, main, article in zip(order, sizes, mains, articles, strict=True):
        if article:
            holding.add(id(node))
        if node.tag in ("html", "body") or main:
            layout.add(id(node))
        elif 2 * size > sizes[0] and node.tag != "#text" and (node.tag == "form" or node.tag not in ASIDE_TAGS):
            if not COMMENT_WORD.search(node.text):
                layout.add(id(node))
    return layout, holding


def tree_match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of matched nodes of two trees whose roots have equal labels, by simple tree matching.

    Children are aligned in order so that the number of matched nodes below is greatest; runs of equal children at
    both ends pair off first.

    Scores are taken by functions that call each other level by level, directly and not through built-in functions, so
    that a page may have as many levels as memory holds.
    """
    sys.setrecursionlimit(max(sys.getrecursionlimit(), MOST_CALLS))
    pairs, pending, sizes = [], [(a, b)], {}
    shapes, numbers = {}, {}

    def score(x: Node, y: Node) -> int:
        if x.label != y.label:
            return 0
        key = (id(x), id(y))
        if key not in sizes:
            sizes[key] = 1 + (_aligned(x.children, y.children)[0] if x.children and y.children else 0)
        return sizes[key]

    def _table(inner: list[Node], other: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
        best = [[0] * (len(other) + 1) for _ in range(len(inner) + 1)]
        for i, x in enumerate(inner):
            row, above = best[i + 1], best[i]
            for j, y in enumerate(other):
                gain = score(x, y) if x.label == y.label else 0
                row[j + 1] = max(row[j], above[j + 1], above[j] + gain if gain else 0)
        i, j, middle = len(inner), len(other), []
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                middle.append((inner[i], other[j]))
        return best[-1][-1], middle[::-1]

    def shape(node: Node) -> int:
        """Equal for subtrees of equal labels, which score alike."""
        if id(node) not in shapes:
            below = [shape(child) for child in node.children]
            shapes[id(node)] = numbers.setdefault((node.label, *below), len(numbers))
        return shapes[id(node)]

    def _middle(inner: list[Node], other: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
        """The best alignment of two lists; long ones are halved where it passes (Hirschberg, 1975), a row in memory."""
        if len(inner) * len(other) <= TABLE_CELLS:
            return _table(inner, other)
        rows, columns = [np.unique([shape(x) for x in nodes], return_index=True, return_inverse=True) for nodes in (inner, other)]
        kinds = [[score(inner[i], other[j]) for j in columns[1]] for i in rows[1]]
        gains = np.array(kinds, np.int64).reshape(len(rows[1]), len(columns[1]))[:, columns[2]]

        def last_row(span: range, low: int, high: int, step: int) -> np.ndarray:
            best = np.zeros(high - low + 1, np.int64)
            for i in span:
                gain = gains[rows[2][i], low:high][::step]
                best[1:] = np.maximum(best[1:], np.where(gain > 0, best[:-1] + gain, 0))
                np.maximum.accumulate(best, out=best)
            return best

        total, found, spans = 0, [], [(0, len(inner), 0, len(other))]
        while spans:
            top, bottom, low, high = spans.pop()
            if top == bottom or low == high:
                continue
            if bottom - top > 1 and (bottom - top) * (high - low) > TABLE_CELLS:
                half = (top + bottom) // 2
                upper = last_row(range(top, half), low, high, 1)
                lower = last_row(range(bottom - 1, half - 1, -1), low, high, -1)[::-1]
                at = low + int((upper + lower).argmax())
                spans += [(half, bottom, at, high), (top, half, low, at)]
            elif bottom - top == 1:
                row = gains[rows[2][top], low:high]
                if row.max() > 0:
                    total += int(row.max())
                    found.append((inner[top], other[low + int(row.argmax())]))
            else:
                gained, pairs = _table(inner[top:bottom], other[low:high])
                total += gained
                found += pairs
        return total, found

    def _aligned(left: list[Node], right: list[Node]) -> tuple[int, list[tuple[Node, Node]]]:
        start = 0
        while start < min(len(left), len(right)) and left[start].label == right[start].label:
            start += 1
        end = 0
        while end < min(len(left), len(right)) - start and left[-1 - end].label == right[-1 - end].label:
            end += 1
        matched = list(zip(left[:start], right[:start], strict=True))
        tail = list(zip(left[len(left) - end :], right[len(right) - end :], strict=True))
        total = 0
        for x, y in matched + tail:
            total += score(x, y)
        inner, other = left[start : len(left) - end], right[start : len(right) - end]
        if inner and other:
            gained, middle = _middle(inner, other)
            total += gained
            matched += middle
        return total, matched + tail

    while pending:
        x, y = pending.pop()
        pairs.append((x, y))
        if x.children and y.children:
            pending += _aligned(x.children, y.children)[1]
    return pairs


def _digest(text: str) -> int:
    packed = hashlib.blake2b(one_spaced(text).encode("utf-8", "replace"), digest_size=8).digest()
    return int.from_bytes(packed, "big", signed=True)


def _slots(root: Node) -> list[Node]:
    """Text nodes with visible text, in page order."""
    found, pending = [], [root]
    while pending:
        node = pending.pop()
        if node.tag == "#text":
            if node.text.strip():
                found.append(node)
        else:
            pending += reversed(node.children)
    return found


def _pack_reference(html: str) -> bytes:
    """A reference page as lists over its nodes (tag, label, text, number of the parent), texts being digests."""
    root = parse(html)
    for slot in _slots(root):
        slot.text = _digest(slot.text)
    rows, pending = [], [(root, -1)]
    while pending:
        node, parent = pending.pop()
        pending += [(child, len(rows)) for child in reversed(node.children)]
        rows.append((node.tag, node.label, node.text, parent))
    return zlib.compress(pickle.dumps(list(zip(*rows, strict=True))), 1)


def _unpack_reference(packed: bytes) -> Node:
    nodes: list[Node] = []
    for tag, label, text, parent in zip(*pickle.loads(zlib.decompress(packed)), strict=True):
        nodes.append(Node(tag, label, text))
        if parent >= 0:
            nodes[parent].children.append(nodes[-1])
    return nodes[0]


def _slot_numbers(root: Node) -> dict[int, int]:
    found, pending = {}, [root]
    while pending:
        node = pending.pop()
        if node.tag == "#text":
            if isinstance(node.text, int):
                found[id(node)] = len(found)
        else:
            pending += reversed(node.children)
    return found


def agreeing_slots(page: Node, reference: Node, numbers: dict[int, int]) -> Iterator[tuple[int, Node]]:
    """Slots of a reference in which the page holds the same text, with the page's text node."""
    for own, other in tree_match(page, reference):
        number = numbers.get(id(other))
        if number is not None and _digest(own.text) == other.text:
            yield number, own


def main_text(root: Node, template: set[int]) -> str:
    """Blocks of the article in page order. ``template`` has ids of text nodes that belong to the template; a block
    goes only if all its text does. Of a form that wraps the page only the controls go."""
    layout, holding = _layout_elements(root, template)

    def aside(node: Node) -> bool:
        return id(node) not in layout and _is_aside(node)

    def mains() -> list[Node]:
        found, pending = [], [root]
        while pending:
            node = pending.pop()
            if _is_main(node):
                if not aside(node):
                    found.append(node)
            elif node.tag != "#text" and not aside(node):
                pending += reversed(node.children)
        return found

    found = mains()
    if not found and holding:
        # All articles are inside of something set aside, which is the page's frame then.
        layout |= holding
        found = mains()
    blocks, current = [], []

    def close() -> None:
        if not all(constant for _, constant in current) and (text := one_spaced("".join(part for part, _ in current))):
            blocks.append(text)
        current.clear()

    for start in found or [root]:
        walk: list[Node | None] = [start]
        while walk:
            node = walk.pop()
            if node is None:
                close()
            elif node.tag == "#text":
                current.append((node.text, id(node) in template or not node.text.strip()))
            elif node.tag == "br":
                current.append((" ", True))
            elif node is start or not aside(node):
                if node.tag in BLOCK:
                    close()
                    walk.append(None)
                walk += reversed(node.children)
        close()
    return " ".join(blocks)


def host_references(pages: DataFrame, references: int = REFERENCES) -> DataFrame:
    """(host, pages, references): distinct pages and a few reference trees per host, by least content hash.

    The rank limit on the hashes of a host is taken inside the tasks first; no host is gathered.
    """
    content = F.xxhash64(F.coalesce("html", F.lit("")))
    keyed = pages.select(host_of(F.col("url")).alias("host"), content.alias("content"), "html")
    distinct = stage_compressed(keyed.select("host", "content").distinct(), "page-hashes")
    counts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    order = Window.partitionBy("host").orderBy("content")
    picked = distinct.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= references).drop("nth")
    picked = stage_compressed(picked, "reference-hashes")

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("host", pa.string()), ("content", pa.int64()), ("tree", pa.binary())])
        for batch in batches:
            rows = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            yield from in_chunks(((h, c, _pack_reference(html or "")) for h, c, html in rows), schema, 500)

    found = keyed.join(F.broadcast(picked) if picked.count() <= BROADCAST_HOSTS else picked, ["host", "content"])
    packed = found.select("host", "content", "html").dropDuplicates(["host", "content"]).mapInArrow(
        trees, "host string, content bigint, tree binary"
    )
    grouped = packed.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("content", "tree"))).alias("references"))
    return counts.select("host", "pages").join(grouped, "host")


def _with_wrapper(pages: DataFrame, wrappers: DataFrame, hosts: int) -> DataFrame:
    """Bring each page its host's wrapper; beyond a checked number of hosts by a join that spreads hot hosts."""
    if hosts <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(wrappers.drop("pages")), "host")
    return join_key_facts(pages, wrappers, "host", "pages")


def _trees(packed: list[dict], cache: dict) -> list[tuple[Node, dict[int, int]]]:
    """Unpacked references of a host, kept for its next pages in the task."""
    key = tuple(reference["content"] for reference in packed)
    if key not in cache:
        if len(cache) > 200:
            cache.clear()
        roots = [_unpack_reference(reference["tree"]) for reference in packed]
        cache[key] = [(root, _slot_numbers(root)) for root in roots]
    return cache[key]


def induce_wrappers(
    pages: DataFrame, references: DataFrame, hosts: int, share: float = CONSTANT_SHARE, least_pages: int = CONSTANT_PAGES
) -> DataFrame:
    """(host, template): the constant slots of each host as (reference, slot) pairs, from the votes of all pages.

    A page's ballot is the list of slots it agrees with; copies of a page cast equal ballots, of which one counts.
    """
    ballot = pa.schema([("host", pa.string()), ("content", pa.int64()), ("slots", pa.list_(pa.int64()))])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    page, agreed = parse(row["html"] or ""), []
                    for at, (root, numbers) in enumerate(_trees(row["references"], cache)):
                        agreed += [at << 32 | slot for slot, _ in agreeing_slots(page, root, numbers)]
                    yield row["host"], row["content"], agreed

        yield from in_chunks(rows(), ballot, 2_000)

    content = F.xxhash64(F.coalesce("html", F.lit("")))
    keyed = pages.select(host_of(F.col("url")).alias("host"), content.alias("content"), "html")
    ballots = _with_wrapper(keyed, references, hosts).select("host", "content", "html", "references").mapInArrow(
        vote, "host string, content bigint, slots array<bigint>"
    )
    counted = (
        ballots.dropDuplicates(["host", "content"]).select("host", F.explode("slots").alias("slot"))
        .groupBy("host", "slot").agg(F.count(F.lit(1)).alias("votes"))
    )
    constant = counted.join(references.select("host", "pages"), "host").filter(
        (F.col("votes") >= share * F.col("pages")) & (F.col("pages") >= least_pages)
    )
    return constant.groupBy("host").agg(F.collect_list("slot").alias("template"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    references = stage_compressed(host_references(pages), "references")
    hosts = references.count()
    templates = induce_wrappers(pages, references, hosts)
    wrappers = stage_compressed(references.join(templates, "host", "left"), "wrappers")
    texts = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for row in batch.to_pylist():
                    page, template, constant = parse(row["html"] or ""), set(), set(row["template"] or ())
                    if constant:
                        for at, (root, numbers) in enumerate(_trees(row["references"], cache)):
                            template |= {
                                id(own) for slot, own in agreeing_slots(page, root, numbers) if at << 32 | slot in constant
                            }
                    text = main_text(page, template)
                    yield row["page_id"], row["url"], text, len(text)

        yield from in_chunks(rows(), texts, 1_000)

    keyed = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    return _with_wrapper(keyed, wrappers, hosts).select("page_id", "url", "html", "references", "template").mapInArrow(
        extract, "page_id bigint, url string, text string, n_chars bigint"
    )
