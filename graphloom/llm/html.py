"""Operator 5, HTML extraction by wrapper induction.

The pages of a host share a template.  It is found by aligning DOM trees with simple tree matching: the maximum number
of nodes that two trees can share, keeping tags, parents and the order of siblings.  The aligned trees are merged into
one wrapper tree, node by node.  Each page is then aligned with its host's wrapper, which says in which slot each of
its texts stands; a slot whose text is the same on most pages is template, any other is content.

Only the shapes of pages, trees of labels without text, go into a wrapper, and few of a host's pages have a shape of
their own.  Shapes are dealt to groups of ``GROUP`` by hash, each group makes a wrapper, and these are merged by the
same alignment, as many at a time, so no host is one task by itself.  Which shapes meet first depends on the deal, and
with it which of several best matches a wrapper keeps; the deal depends on the shapes alone.

Texts are not shuffled.  A page's texts are counted by the hash of slot and text, one number each, and the numbers of a
host's template are sent back to its pages.  The pages themselves are shuffled, by host, only if the wrappers or those
numbers are too large to be sent to the tasks.
"""

from __future__ import annotations

import html
import json
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import pick, table

#: Shapes, or wrappers, that one task merges at a time.
GROUP = 200
#: Bytes of wrappers that may be sent to every task; beyond it pages are joined to them by host.
SENT_BYTES = 64_000_000
#: A slot's text is template if it stands there on this share of the host's pages, those of equal content counted once.
TEMPLATE_SHARE = 0.5
#: Elements whose text is not shown, and nav, which is about the site even where its text varies.
HIDDEN = frozenset(("script", "style", "noscript", "template", "head", "nav"))
#: Pairs of children beyond which two lists are aligned row by row, each row at once, without the whole table.
_PAIRS = 250_000
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?![a-z0-9:-])", re.I) for tag in ("script", "style", "textarea", "title")}
_CLOSES = {  # an opening tag ends these open elements
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
} | {t: {"p"} for t in "p div article section ul ol table h1 h2 h3 h4 h5 h6 header footer nav main form pre blockquote".split()}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]++|<", re.S)
_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
_QUOTE = re.compile(r"[>\"']")
_MARK = re.compile(r"""\b(?:id|class)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_BLANK = re.compile(r"\s+")

Node = list  # [label, children, texts, tag]: children are Nodes, the pieces texts[i] stand before child i, the last at the end


def _tag_end(source: str, at: int, dead: set[int]) -> int:
    """Where the tag at ``at`` ends, outside quotes, or -1; quotes in ``dead`` are known to lead to no end."""
    path: list[int] = []
    while (m := _QUOTE.search(source, at)) is not None and m.group() != ">":
        i = m.start()
        path.append(i)
        close = -1 if i in dead else source.find(m.group(), i + 1)
        if close < 0:
            break
        at = close + 1
    if m is not None and m.group() == ">":
        return m.start()
    dead.update(path)
    return -1


def parse(source: str) -> Node:
    """The DOM tree of a page: labels are tags, with their class or id for elements that have one.

    Time is in proportion to the length of the page, however broken: a tag whose quotes leave it without an end ends
    at the next ``>``, and what has no ``>`` behind it is text.
    """
    root: Node = ["", [], [[]], ""]
    stack = [root]
    opened: Counter = Counter()
    dead: set[int] | None = None  # of pages with a broken tag
    unended: set[str] = set()
    at, size, last = 0, len(source), source.rfind(">")
    while at < size:
        if at > last:
            stack[-1][2][-1].append(source[at:])
            break
        tag = _OPEN.match(source, at) if dead is not None else None
        if tag is not None:
            end = _tag_end(source, tag.end(), dead)
            end = source.find(">", tag.end()) if end < 0 else end
            closing, name, rest = tag.group(1), tag.group(2), source[tag.end() : end]
            at = end + 1
        else:
            m = _TOKEN.match(source, at)
            closing, name, rest = m.groups()
            if name is None:
                piece = m.group()
                if piece == "<" and _OPEN.match(source, at):
                    dead = set()
                    continue
                if piece[0] != "<" or piece == "<":
                    stack[-1][2][-1].append(piece)
                at = m.end()
                continue
            at = m.end()
        name = name.lower()
        if closing:
            while opened[name]:
                gone = stack.pop()[3]
                opened[gone] -= 1
                if gone == name:
                    break
            continue
        ends = _CLOSES.get(name)
        while ends and stack[-1][3] in ends:
            opened[stack.pop()[3]] -= 1
        mark = _MARK.search(rest) if rest else None
        label = f"{name}.{next(g for g in mark.groups() if g is not None)}" if mark else name
        node: Node = [label, [], [[]], name]
        parent = stack[-1]
        parent[1].append(node)
        parent[2].append([])
        if rest.endswith("/") or name in _VOID:
            continue
        if name in _RAW_END and name not in unended:
            end = _RAW_END[name].search(source, at)
            if end is not None:
                node[2][-1].append(source[at : end.start()])
                close = source.find(">", end.end())
                at = size if close < 0 else close + 1
                continue
            unended.add(name)
            if name in ("script", "style"):
                break
        stack.append(node)
        opened[name] += 1
    return root


def clean(text: str) -> str:
    return _BLANK.sub(" ", html.unescape(text)).strip()


def shape(tree: list) -> str:
    """A tree without its texts, as JSON: label and number of children of each node, in the order of the page."""
    out: list = []
    stack = [tree]
    while stack:
        node = stack.pop()
        out += (node[0], len(node[1]))
        stack += reversed(node[1])
    return json.dumps(out, ensure_ascii=False, separators=(",", ":"))


def tree_of(text: str) -> list:
    """The tree ``[label, children]`` of a shape."""
    flat = json.loads(text)
    root: list = [flat[0], []]
    stack = [(root, flat[1])]
    for label, n in zip(flat[2::2], flat[3::2], strict=True):
        while len(stack[-1][0][1]) == stack[-1][1]:
            stack.pop()
        node: list = [label, []]
        stack[-1][0][1].append(node)
        stack.append((node, n))
    return root


def numbered(tree: list) -> dict[int, int]:
    """Numbers of a wrapper's nodes, in the order of the page."""
    numbers: dict[int, int] = {}
    stack = [tree]
    while stack:
        node = stack.pop()
        numbers[id(node)] = len(numbers)
        stack += reversed(node[1])
    return numbers


class Kinds:
    """Numbers for the shapes of trees, equal for equal ones, and how many nodes any two of them share."""

    def __init__(self) -> None:
        self.number: dict[tuple, int] = {}
        self.parts: list[tuple] = []  # label and the kinds of the children
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def of(self, tree: list) -> dict[int, int]:
        """The kind of each node of a tree, by the node's ``id``."""
        found: dict[int, int] = {}
        order, depth = [(tree, 1)], 0
        for node, level in order:  # grows as it is read: parents come before their children
            depth = max(depth, level)
            order += [(c, level + 1) for c in node[1]]
        for node, _ in reversed(order):
            key = (node[0], *[found[id(c)] for c in node[1]])
            kind = self.number.get(key)
            if kind is None:
                kind = self.number[key] = len(self.parts)
                self.parts.append(key)
                self.size.append(1 + sum(self.size[k] for k in key[1:]))
            found[id(node)] = kind
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 3 * depth + 1000))  # ``shared`` goes as deep as the trees
        return found

    def shared(self, a: int, b: int) -> int:
        """Nodes that two trees share: simple tree matching."""
        if a == b:
            return self.size[a]
        if self.parts[a][0] != self.parts[b][0]:
            return 0
        key = (a, b)
        if key not in self.known:
            left, right = self.parts[a][1:], self.parts[b][1:]
            n, m, head = len(left), len(right), 0
            while head < n and head < m and left[head] == right[head]:  # equal ends match in some best match
                head += 1
            while n > head and m > head and left[n - 1] == right[m - 1]:
                n, m = n - 1, m - 1
            score = 1 + sum(self.size[k] for k in left[:head]) + sum(self.size[k] for k in left[n:])
            if n > head and m > head:
                score += self._best(left[head:n], right[head:m])
            self.known[key] = score
        return self.known[key]

    def _best(self, left: tuple, right: tuple) -> int:
        if len(left) * len(right) > _PAIRS:
            a, b, weights = self.compact(left, right)
            best = np.zeros(len(b) + 1, np.int64)
            for i in a[::-1]:
                best = _above(best, weights[i][b])
            return int(best[0])
        row = [0] * (len(right) + 1)
        for x in left:
            before, row = row, [0]
            for j, y in enumerate(right):
                w = self.shared(x, y)
                row.append(max(before[j + 1], row[j], before[j] + w))
        return row[-1]

    def compact(self, left: tuple | list, right: tuple | list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both lists as numbers of their different kinds, and the nodes that these share."""
        (at_a, a), (at_b, b) = (np.unique(np.array(x, np.int64), return_inverse=True) for x in (left, right))
        return a, b, np.array([[self.shared(x, y) for y in at_b.tolist()] for x in at_a.tolist()], np.int64)


def _above(row: np.ndarray, weights: np.ndarray) -> np.ndarray:
    best = np.append(np.maximum(row[:-1], row[1:] + weights), 0)
    return np.maximum.accumulate(best[::-1])[::-1]


def align(a: list, b: list, kinds: Kinds | None = None, of_a: dict[int, int] | None = None, of_b: dict[int, int] | None = None) -> list[tuple[int, int]]:
    """Pairs of children of ``a`` and ``b`` in the best match of the two trees by simple tree matching."""
    if kinds is None or of_a is None or of_b is None:
        kinds = kinds or Kinds()
        of_a, of_b = kinds.of(a), kinds.of(b)
    left, right = [of_a[id(c)] for c in a[1]], [of_b[id(c)] for c in b[1]]
    n, m = len(left), len(right)
    head = 0
    while head < n and head < m and left[head] == right[head]:  # equal heads match in some best match
        head += 1
    pairs = [(i, i) for i in range(head)]
    left, right = left[head:], right[head:]
    rows, columns = n - head, m - head
    if not rows or not columns:
        return pairs
    if rows * columns > _PAIRS:
        return pairs + [(head + i, head + j) for i, j in _long(left, right, kinds)]
    score = [[0] * (columns + 1) for _ in range(rows + 1)]
    weight = [[kinds.shared(x, y) for y in right] for x in left]
    for i in range(rows - 1, -1, -1):
        for j in range(columns - 1, -1, -1):
            w = weight[i][j]
            score[i][j] = max(score[i + 1][j], score[i][j + 1], w + score[i + 1][j + 1] if w else 0)
    i = j = 0
    while i < rows and j < columns:
        if weight[i][j] and score[i][j] == weight[i][j] + score[i + 1][j + 1]:
            pairs.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif score[i][j] == score[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs


def _long(left: list[int], right: list[int], kinds: Kinds) -> list[tuple[int, int]]:
    """The pairs of the best match of two long lists; every so many rows of the table are kept, the others made again."""
    a, b, table = kinds.compact(left, right)
    n, m = len(left), len(right)
    step = int(n**0.5) + 1
    kept = {n: np.zeros(m + 1, np.int64)}
    row = kept[n]
    for i in range(n - 1, -1, -1):
        row = _above(row, table[a[i]][b])
        if i % step == 0:
            kept[i] = row
    pairs, j = [], 0
    for low in range(0, n, step):
        high = min(low + step, n)
        score = {high: kept[high]}
        for i in range(high - 1, low - 1, -1):
            score[i] = _above(score[i + 1], table[a[i]][b])
        i = low
        while i < high and j < m:
            w = table[a[i], b[j]]
            if w and score[i][j] == w + score[i + 1][j + 1]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif score[i][j] == score[i + 1][j]:
                i += 1
            else:
                j += 1
    return pairs


def _match(a: list, b: list, cache: dict) -> int:
    """Nodes that two trees share; ``cache`` keeps the kinds between calls."""
    kinds = cache.setdefault("kinds", Kinds())
    return kinds.shared(kinds.of(a)[id(a)], kinds.of(b)[id(b)])


def _merge(into: list, tree: list, kinds: Kinds) -> None:
    of_into, of_tree = kinds.of(into), kinds.of(tree)
    stack = [(into, tree)]
    while stack:
        x, y = stack.pop()
        if of_into[id(x)] == of_tree[id(y)]:
            continue
        pairs = align(x, y, kinds, of_into, of_tree)
        stack += [(x[1][i], y[1][j]) for i, j in pairs]
        matched = {j: i for i, j in pairs}
        children, at = [], 0
        for j, child in enumerate(y[1]):
            if j in matched:
                children += x[1][at : matched[j] + 1]
                at = matched[j] + 1
            else:
                children.append(child)
        x[1] = children + x[1][at:]


def induce(shapes: list[list]) -> list:
    """The wrapper tree of several shapes, merged one after the other; parts of the shapes go into it."""
    wrapper: list = ["", []]
    kinds = Kinds()
    for tree in shapes:
        _merge(wrapper, tree, kinds)
    return wrapper


def places(wrapper: list, numbers: dict[int, int], kinds: Kinds, of_wrapper: dict[int, int], tree: list, hidden: frozenset[str] = HIDDEN) -> list[str]:
    """The slot of each text of a page of this shape, in the order of ``texts``.

    The text before a child stands in the slot of that child, the last one of a node in that of the node itself.
    """
    out: list[str] = []
    of_tree = kinds.of(tree)

    def frame(node: list, at: list) -> list:
        return [node, at, numbers[id(at)], {j: i for i, j in align(at, node, kinds, of_wrapper, of_tree)}, 0]

    stack = [frame(tree, wrapper)]
    while stack:
        node, at, number, pairs, j = top = stack[-1]
        inside, paired = j < len(node[1]), at is not None and j in pairs
        if at is None:
            out.append(number)
        else:
            out.append(f"{number}>{numbers[id(at[1][pairs[j]])]}" if paired else f"{number}?{j}" if inside else f"{number}")
        if not inside:
            stack.pop()
            continue
        top[4] += 1
        child = node[1][j]
        if child[0].partition(".")[0] in hidden:
            continue
        if paired:
            stack.append(frame(child, at[1][pairs[j]]))
        else:  # pages that made the wrapper have no such child, or it is within one
            stack.append([child, None, number if at is None else f"{number}?{j}", None, 0])
    return out


def texts(page: Node, hidden: frozenset[str] = HIDDEN) -> list[str]:
    """The texts of a page, blank ones too, without those of hidden elements."""
    out: list[str] = []
    stack = [[page, 0]]
    while stack:
        node, j = top = stack[-1]
        out.append("".join(node[2][j]))
        if j == len(node[1]):
            stack.pop()
            continue
        top[1] += 1
        if node[1][j][3] not in hidden:
            stack.append([node[1][j], 0])
    return out


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port; empty for a NULL URL or one without a host."""
    authority = F.regexp_extract(F.coalesce(F.trim(url), F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^@/?#]*@)?([^/?#:]*)", 1)
    return F.lower(authority)


def _shape_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {(h, shape(parse(s))) for h, s in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)}
        columns = list(zip(*sorted(found), strict=True)) if found else [[]] * 2
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["host", "tree"])


def _merged(group: pa.Table) -> pa.Table:
    trees = sorted(set(group.column("tree").to_pylist()), key=lambda t: (-len(t), t))
    tree = shape(induce([tree_of(t) for t in trees])) if len(trees) > 1 else trees[0]
    return pa.table({"host": group.column("host")[:1], "groups": pa.array([-(-group.column("groups")[0].as_py() // GROUP)], pa.int64()), "tree": [tree]})


def wrappers(pages: DataFrame) -> DataFrame:
    """``(host, tree)``: the wrapper tree of each host, as JSON."""
    shapes = table(pages.select("host", "html").mapInArrow(_shape_rows, "host string, tree string").distinct())
    sizes = shapes.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    left, parts = sizes.agg(F.max("groups")).first()[0] or 1, shapes.join(sizes, "host")
    while True:
        dealt = parts.select("host", F.pmod(F.xxhash64("tree"), "groups").alias("group"), "groups", "tree")
        parts = dealt.groupBy("host", "group").applyInArrow(_merged, "host string, groups long, tree string")
        if left == 1:
            return parts.select("host", "tree")
        left = -(-left // GROUP)


def _slot_rows(batches: Iterator[pa.RecordBatch], sent: Broadcast | None, hidden: frozenset[str]) -> Iterator[pa.RecordBatch]:
    made: dict[str, tuple] = {}
    known: dict[tuple[str, str], list[int]] = {}

    def slots(host: str, text: str, wrapper: str) -> list[int]:
        """A number for the slot of each text of a shape."""
        if (host, text) not in known:
            if len(known) > 5000:
                known.clear()
            if host not in made:
                if len(made) > 500:
                    made.clear()
                tree, kinds = tree_of(wrapper), Kinds()
                made[host] = tree, numbered(tree), kinds, kinds.of(tree)
            known[host, text] = [xxhash.xxh3_64_intdigest(p) for p in places(*made[host], tree_of(text), hidden)]
        return known[host, text]

    for batch in batches:
        rows = []
        trees = [None] * batch.num_rows if sent else batch.column("tree").to_pylist()
        for page, host, source, tree in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "html")), trees, strict=True):
            root = parse(source)
            found = [(k, t) for k, t in enumerate(map(clean, texts(root, hidden))) if t]
            keys = []
            if host and found:
                at = slots(host, shape(root), sent.value[host] if sent else tree)
                keys = [xxhash.xxh3_64_intdigest(t, at[k]) - (1 << 63) for k, t in found]
            rows.append((page, host, keys, [t for _, t in found]))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "host", "keys", "texts"])


def extract_content(pages: DataFrame, template_share: float = TEMPLATE_SHARE, hidden: frozenset[str] = HIDDEN) -> DataFrame:
    """``(page_id, content, n_slots, n_template)``: the texts of a page that are not its host's template, by line.

    A slot's text is template on a page if, over all pages of the host, at least ``template_share`` have that very
    text in the slot, and two pages at least.  Pages with the same texts in the same slots count once; only if all of
    a host's pages are such copies of one, each counts.  So a constant text that fewer pages have is content.

    Texts in ``hidden`` elements are left out, and not counted in ``n_slots``: what is not rendered, and ``nav``
    unless a set without it is given.  All others, in footer, aside, form, button and select too, are template or
    content by their slots alone.

    Rows with a NULL id are left out.  A NULL page has NULL content, an empty one or one that is all template has
    empty content.  Pages with a NULL URL, or one without a host, have no template: all their texts are content.
    Repeated rows, and pages that repeat an id, are pages of their own.  Broken markup is read as far as it goes:
    missing ends are supplied, stray ones ignored; pages may be as long, as deep and as wide as they like.  Of several
    best matches the one with the earliest pairs is taken, so the result is the same at each run.
    """
    rows = pick(pages, page_id="page_id", url="url", html="html").filter("page_id IS NOT NULL")
    rows = rows.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    full = rows.filter("html IS NOT NULL")
    made = table(wrappers(full.filter("host <> ''")))
    size = made.agg(F.sum(F.octet_length("tree"))).first()[0] or 0
    sent = pages.sparkSession.sparkContext.broadcast({r.host: r.tree for r in made.collect()}) if size <= SENT_BYTES else None
    given = full if sent else full.join(made, "host", "left")
    placed = table(given.mapInArrow(partial(_slot_rows, sent=sent, hidden=hidden), "page_id long, host string, keys array<long>, texts array<string>"))
    contents = placed.filter("size(keys) > 0").groupBy("host", F.xxhash64("keys").alias("c")).agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias("copies"))
    hosts = contents.groupBy("host").agg(F.count(F.lit(1)).alias("several"), F.sum("copies").alias("rows"))
    hosts = hosts.select("host", F.expr("IF(several = 1, rows, several)").alias("pages"), (F.col("several") == 1).alias("one"))
    counted = contents.join(hosts, "host").select("host", F.when(F.col("one"), F.col("copies")).otherwise(1).alias("n"), F.explode(F.array_distinct("keys")).alias("key"))
    by_key = counted.groupBy("host", "key").agg(F.sum("n").alias("n")).filter("n > 1")
    # At most 1 / template_share times the mean number of texts on the host's pages.
    constant = table(by_key.join(hosts, "host").filter(F.col("n") >= template_share * F.col("pages")).groupBy("host").agg(F.collect_list("key").alias("template")))
    marked = placed.join(constant, "host", "left").withColumn("template", F.coalesce("template", F.array().cast("array<long>")))
    kept = F.filter(F.transform("texts", lambda t, i: F.when(~F.array_contains("template", F.coalesce(F.get("keys", i), F.lit(0))) | (F.size("keys") == 0), t)), lambda t: t.isNotNull())
    result = (
        marked.select("page_id", F.size("texts").alias("n_slots"), kept.alias("kept"))
        .select("page_id", F.array_join("kept", "\n").alias("content"), "n_slots", (F.col("n_slots") - F.size("kept")).alias("n_template"))
    )
    nothing = rows.filter("html IS NULL").select("page_id", F.lit(None).cast("string").alias("content"), F.lit(0).alias("n_slots"), F.lit(0).alias("n_template"))
    return result.unionByName(nothing)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_content(spark.read.parquet(f"{sf_dir}/pages.parquet"))
