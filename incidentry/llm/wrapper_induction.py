"""Main text of web pages by wrapper induction over the pages of a host.

Each page becomes a small tree: elements that are boilerplate by their own tag, role or class are left out, and
neighbours of one kind are one node. All different pages of a host are aligned with one reference page of it by
simple tree matching. Per reference node the pages that have it, those with the same text there, and the text they hold are
counted; nodes whose text is constant are template, and the node around most of the varying text is the content slot.
A page's text is then what lies in its articles or, without one, in the elements of its host's slot, less boilerplate
and template.

A host may hold a third of all pages: alignments are counted before they are shuffled, and a page meets one row of its
host only. What is kept per host is bounded by its reference page.

Defined results: null or empty html gives an empty text; unclosed and unmatched tags are repaired as browsers do in
the common cases; a page alone on its host has no template; pages without a host share one. Repeated rows and ids give
one row each. Paragraphs, headings and list items inside the article, and what stands in them, are never template. Exact
copies of a page are one page of the host. A line break tag is white space. Columns beyond id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.llm.common import BROADCAST_BYTES, arrow_schema, row_map, written

#: Different pages of a host that must have a node, and the share of them with equal text, before it is template.
LEAST_PAGES = 3
CONSTANT_SHARE = 0.6
#: Share of the varying text that the content slot must hold.
SLOT_SHARE = 0.8

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
#: What an opening tag closes: the open elements of these names up to the nearest of the barriers.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
NOISE_TAGS = frozenset(
    "head script style noscript template iframe svg math canvas object embed audio video nav footer aside form button select "
    "textarea input label menu dialog title link meta".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id attributes that mark boilerplate.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot sponsor sponsored sponsors promo promotion banner nav "
    "navbar navigation menu submenu breadcrumb breadcrumbs sidebar footer cookie cookies consent gdpr notice notices popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond widget widgets toolbar pagination pager masthead topbar "
    "skiplink trending paywall disclaimer".split())
CONTENT_WORDS = frozenset("article content main post entry story body text".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt tr figcaption caption".split())
BLANKS = re.compile(r"[\s\x00]+")


class Page:
    """A parsed page: parallel lists of its elements, parents first, and its text in page order."""

    def __init__(self, source: str | None):
        self.tags, self.parents, self.labels, self.noise = ["#"], [-1], ["#"], [False]
        self.article = [False]
        #: (element, text); a text of None parts blocks.
        self.items: list[tuple[int, str | None]] = []
        self._read(source or "")

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        named = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        words = set(re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", f"{named.get('class', '')} {named.get('id', '')}").lower()))
        inside = self.article[parent] or tag in ("article", "main")
        noise = self.noise[parent] or tag in NOISE_TAGS or (
            tag not in ("html", "body", "article", "main") and (
                named.get("role", "").lower() in NOISE_ROLES or bool(words & NOISE_WORDS)
                or (not inside and (tag == "header" or "header" in words))))
        self.tags.append(tag)
        self.parents.append(parent)
        self.labels.append(tag + "".join("." + w for w in sorted(named.get("class", "").lower().split())[:4])[:60])
        self.noise.append(noise)
        self.article.append(inside)
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        count = {"p": 0}
        items, tags = self.items, self.tags

        def close(k: int) -> None:
            for node in stack[k:]:
                if tags[node] == "p":
                    count["p"] -= 1
            if any(tags[node] in BLOCKS for node in stack[k:]):
                items.append((stack[k], None))
            del stack[k:]

        for m in TAG.finditer(source):
            if m.start() < at:
                continue
            if m.start() > at:
                items.append((stack[-1], source[at:m.start()]))
            at = m.end()
            tag = m.group(2)
            if tag is None:
                if m.group(0).startswith("<![CDATA["):
                    items.append((stack[-1], m.group(0)[9:-3]))
                continue
            tag = tag.lower()
            if m.group(1):
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == tag:
                        close(k)
                        break
                continue
            if tag in BLOCKS and count["p"] and tag not in ("html", "body"):
                k = next(k for k in range(len(stack) - 1, 0, -1) if tags[stack[k]] == "p")
                close(k)
            if tag in CLOSES:
                names, barriers = CLOSES[tag]
                lowest = None
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in barriers:
                        break
                    if tags[stack[k]] in names:
                        lowest = k
                if lowest is not None:
                    close(lowest)
            node = self._open(stack[-1], tag, m.group(3))
            if tag in BLOCKS:
                items.append((node, None))
            elif tag in ("br", "td", "th"):
                items.append((stack[-1], " "))
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
                at = end.end() if end else len(source)
            elif tag not in VOID and not m.group(3).endswith("/"):
                stack.append(node)
                count["p"] += tag == "p"
        if at < len(source):
            items.append((stack[-1], source[at:]))

    def texts(self) -> list[str]:
        """The text that stands directly in each element."""
        own: list[list[str]] = [[] for _ in self.tags]
        for node, text in self.items:
            if text:
                own[node].append(text)
        return [BLANKS.sub(" ", entities.unescape(" ".join(t))).strip() if t else "" for t in own]

    def skeleton(self) -> list[tuple[int, str, int, int, list[int]]]:
        """(parent, label, text hash, text length, elements) of each node of the small tree, parents first."""
        kids: list[list[int]] = [[] for _ in self.tags]
        for node in range(1, len(self.tags)):
            if not self.noise[node]:
                kids[self.parents[node]].append(node)
        own = self.texts()
        out, todo = [], [(-1, [0])]
        while todo:
            parent, members = todo.pop()
            text = "\n".join(own[x] for x in members)
            out.append((parent, self.labels[members[0]], xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2 ** 63,
                        sum(len(own[x]) for x in members), members))
            me = len(out) - 1
            groups: list[list[int]] = []
            for kid in (k for x in members for k in kids[x]):
                if groups and self.labels[groups[-1][0]] == self.labels[kid]:
                    groups[-1].append(kid)
                else:
                    groups.append([kid])
            todo += [(me, g) for g in reversed(groups)]
        return out


def matched(a_parents: list[int], a_labels: list[str], b_parents: list[int], b_labels: list[str]) -> list[tuple[int, int]]:
    """Pairs of nodes in the largest top-down, order-keeping match of two labelled trees (simple tree matching)."""
    kids = []
    for parents in (a_parents, b_parents):
        rows: list[list[int]] = [[] for _ in parents]
        for node, parent in enumerate(parents):
            if parent >= 0:
                rows[parent].append(node)
        kids.append(rows)
    if not a_parents or not b_parents or a_labels[0] != b_labels[0]:
        return []
    # Pairs of one label below pairs of one label, parents first; a page may be deeper than Python recurses.
    pairs = [(0, 0)]
    for a, b in pairs:
        y = kids[1][b]
        pairs += [(c, d) for c in kids[0][a] for d in y if a_labels[c] == b_labels[d]]
    memo: dict[tuple[int, int], tuple[int, list]] = {}
    for a, b in reversed(pairs):
        x, y = kids[0][a], kids[1][b]
        best = [[0] * (len(y) + 1)]
        for c in x:
            above, row = best[-1], [0]
            for j, d in enumerate(y):
                row.append(max(above[j + 1], row[j], above[j] + memo[c, d][0] if (c, d) in memo else 0))
            best.append(row)
        memo[a, b] = best[-1][-1] + 1, best
    out, todo = [], [(0, 0)]
    while todo:
        a, b = todo.pop()
        out.append((a, b))
        x, y, best = kids[0][a], kids[1][b], memo[a, b][1]
        i, j = len(x), len(y)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x[i], y[j]))
    return out


def _path_keys(parents: list[int], labels: list[str]) -> list[int]:
    """A hash of each node's path, in which the hash of its parent stands for the path so far."""
    out: list[int] = []
    for parent, label in zip(parents, labels):
        out.append(xxhash.xxh3_64_intdigest(label.encode("utf-8", "surrogatepass"), out[parent] if parent >= 0 else 0))
    return out


def _path(parents: list[int], labels: list[str], node: int) -> str:
    out = []
    while node >= 0:
        out.append(labels[node])
        node = parents[node]
    return "/".join(reversed(out))


def _at_path(parents: list[int], labels: list[str], path: str) -> list[bool]:
    """Which nodes have this path; only what its length and last label allow is put together."""
    lengths: list[int] = []
    for parent, label in zip(parents, labels):
        lengths.append(len(label) + (lengths[parent] + 1 if parent >= 0 else 0))
    return [n == len(path) and path.endswith(labels[k]) and _path(parents, labels, k) == path for k, n in enumerate(lengths)]


def _template_key(path_key: int, text_hash: int) -> int:
    return xxhash.xxh3_64_intdigest(text_hash.to_bytes(8, "little", signed=True), path_key) - 2 ** 63


def decide(parents: list[int], labels: list[str], hashes: list[int], counts: dict[int, tuple[int, int, int]]):
    """(content path, template keys) of a host from its reference tree and (pages, same, chars) per node."""
    pages = max((c[0] for c in counts.values()), default=0)
    keys, template, varying = _path_keys(parents, labels), [], [0] * len(parents)
    for node in range(len(parents)):
        n, same, chars = counts.get(node, (0, 0, 0))
        if pages >= LEAST_PAGES and n >= CONSTANT_SHARE * pages and same >= CONSTANT_SHARE * pages and chars:
            template.append(_template_key(keys[node], hashes[node]))
        else:
            varying[node] += chars
    for node in range(len(parents) - 1, 0, -1):
        varying[parents[node]] += varying[node]
    slot = 0
    while True:
        heavy = [k for k in range(slot + 1, len(parents)) if parents[k] == slot
                 and varying[k] >= SLOT_SHARE * max(1, varying[0]) and labels[k].split(".")[0] not in PARAGRAPHS]
        if not heavy:
            break
        slot = heavy[0]
    return (_path(parents, labels, slot) if varying[0] else None), template


def main_text(source: str | None, content: str | None = None, template: frozenset[int] | None = None) -> str:
    """The main text of a page, given the content path and the template of its host."""
    page = Page(source)
    n = len(page.tags)
    named = {k for k in range(1, n) if page.tags[k] == "article" and not page.noise[k]} or {
        k for k in range(1, n) if page.tags[k] == "main" and not page.noise[k]}
    dropped: set[int] = set()
    if template or content:
        tree = page.skeleton()
        parents, labels = [t[0] for t in tree], [t[1] for t in tree]
        keys = _path_keys(parents, labels)
        there = _at_path(parents, labels, content) if not named and content else [False] * len(tree)
        slot = {m for here, t in zip(there, tree) if here for m in t[4]}
        #: Per node: whether it lies in the slot, and its nearest paragraph.
        held_by, paragraph = [], []
        for me, (parent, label, text_hash, chars, members) in enumerate(tree):
            kind = label.split(".")[0] in PARAGRAPHS
            above = paragraph[parent] if parent >= 0 else -1
            held_by.append(there[me] or (parent >= 0 and held_by[parent]))
            paragraph.append(me if kind else above)
            if chars and template and _template_key(keys[me], text_hash) in template and not (
                    page.article[members[0]] and (kind or above >= 0)
                    # Without an article a list may be a menu: words in a paragraph stay if it has others beside them.
                    or not named and (kind or held_by[me] and above >= 0 and tree[above][3])):
                dropped.update(members)
        named = named or slot
    roots = named or {next((k for k in range(1, n) if page.tags[k] == "body"), 0)}
    inside = [False] * n
    blocks, held = [], []
    for k in range(n):
        inside[k] = k in roots or (page.parents[k] >= 0 and inside[page.parents[k]])

    def flush() -> None:
        text = BLANKS.sub(" ", entities.unescape("".join(held))).strip()
        held.clear()
        if text:
            blocks.append(text)

    for node, text in page.items:
        if text is None:
            flush()
        elif inside[node] and not page.noise[node] and node not in dropped:
            held.append(text)
    flush()
    return "\n".join(blocks)


def host_of(url_col: str):
    """The host of a url in lower case; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def skeletons(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, pick, parents, labels, hashes, sizes) of each page; the least ``pick`` of a host is its reference."""

    def one(host, source):
        tree = Page(source).skeleton()
        return (host, xxhash.xxh3_64_intdigest((source or "").encode("utf-8", "surrogatepass")) - 2 ** 63,
                *([t[k] for t in tree] for k in range(4)))

    return row_map(pages.select(host_of(url_col).alias("host"), html_col), one,
                   "host string, pick long, parents array<int>, labels array<string>, hashes array<long>, sizes array<int>",
                   ["host", html_col], rows=100)


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, content, template) of each host."""
    # A copy says nothing new of what a host repeats.
    trees = written(skeletons(pages, url_col, html_col).dropDuplicates(["host", "pick"]), "skeletons")
    picks = trees.groupBy("host").agg(F.min("pick").alias("pick"), F.count("*").alias("pages")).where(
        F.col("pages") >= LEAST_PAGES).select("host", "pick")
    references = written(trees.join(picks, ["host", "pick"]).groupBy("host").agg(
        F.first(F.struct("parents", "labels", "hashes")).alias("reference")), "references")

    def align(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            host, node, same, chars = [], [], [], []
            for row in batch.to_pylist():
                ref = row["reference"]
                for a, b in matched(row["parents"], row["labels"], ref["parents"], ref["labels"]):
                    host.append(row["host"]), node.append(b), chars.append(row["sizes"][a])
                    same.append(int(row["hashes"][a] == ref["hashes"][b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t.type) for c, t in zip((host, node, same, chars), aligned)], schema=aligned)

    schema = "host string, node int, same int, chars long"
    aligned = arrow_schema(schema)
    counts = trees.join(references, "host").select("host", "parents", "labels", "hashes", "sizes", "reference").mapInArrow(
        align, schema).groupBy("host", "node").agg(
        F.count("*").alias("n"), F.sum("same").alias("same"), F.sum("chars").alias("chars"))
    nodes = counts.groupBy("host").agg(F.collect_list(F.struct("node", "n", "same", "chars")).alias("nodes"))

    def one(host, reference, nodes):
        content, template = decide(reference["parents"], reference["labels"], reference["hashes"],
                                   {x["node"]: (x["n"], x["same"], x["chars"]) for x in nodes})
        return host, content, template

    return row_map(references.join(nodes, "host"), one, "host string, content string, template array<long>",
                   ["host", "reference", "nodes"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: its id, url, ``text`` and ``n_chars``."""
    found = written(wrappers(pages.select(url_col, html_col), url_col, html_col), "wrappers")
    width = found.agg(F.sum(F.octet_length("host") + F.coalesce(F.octet_length("content"), F.lit(0))
                            + 8 * F.size("template") + 64)).first()[0] or 0
    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                         host_of(url_col).alias("host"))
    placed = named.join(F.broadcast(found) if width <= BROADCAST_BYTES else found, "host", "left")

    def one(i, url, source, content, template):
        text = main_text(source, content, frozenset(template or ()))
        return i, url, text, len(text)

    kinds = dict(pages.dtypes)
    return row_map(placed, one, f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long",
                   ["id", "url", "html", "content", "template"], rows=100)
