"""Main text of web pages by a tree-structured graphical model.

Each element and each text of a page's tree is a node that is article or not. A node's potential comes from its tag, its
class and id words, and how much of its text is links; parent-child potentials say how labels are handed down. Sum-product
messages go from the leaves to the root and back, which gives each node's marginal. Potentials are trained from labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.common import map_column
from factloom.llm.labelled_pages import labelled_pages

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)", re.S)
END_OR_QUOTE = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(?<![^\s=\"'<>/])([^\s=\"'<>/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
NAME_WORD = re.compile(r"[a-z]{2,}")
#: Fixed values of HTML: elements without content, with raw text, without rendered text, and those that begin a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
RAW_END = {tag: re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I) for tag in RAW}
UNSEEN = frozenset("head script style title noscript template iframe textarea select option svg math object audio video canvas noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br center caption dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
#: What stands in a head; a text that is not blank, and the start of any other element, closes an open one.
IN_HEAD = frozenset("head html base basefont bgsound link meta title style script noscript template noframes".split())
#: Which open elements an element closes when it begins, up to the nearest of its scopes.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Ends of these don't reach out of a table's cell.
INLINE = frozenset("p div b i span a".split())
CLOSE_P = BLOCKS - {"br", "body", "html", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "legend"}
SECTIONS = frozenset("nav header footer aside form article main section button label".split())
SMOOTHING, DAMPING = 0.5, 0.6


class Node:
    __slots__ = ("parent", "tag", "names", "text", "links", "label", "children", "start")

    def __init__(self, parent: int, tag: str, names: str, label: str | None):
        self.parent, self.tag, self.names, self.label = parent, tag, names, label
        self.text = self.links = self.children = 0
        self.start = ""


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order, parents first, and what is written in order: (node, its text), (-1, "") where a block begins or ends."""
    nodes, out, stack = [Node(-1, "#root", "", None)], [], [0]
    at, n, hidden, last_end = 0, len(page), 0, page.rfind(">")
    # where tags stand in stack, and all blocks and all that isn't seen, deepest last: the stack itself is never searched
    places: defaultdict[str, list[int]] = defaultdict(list)
    blocks, unseen = [0], [0]

    def tag_end(start: int) -> int:
        """Where a tag ends, its name ending at start: at a > that isn't quoted; a quote that is never closed is none. -1 if it doesn't end."""
        while start <= last_end and (m := END_OR_QUOTE.search(page, start)):
            if m.group() == ">":
                return m.start()
            closed = page.find(m.group(), m.end())
            if closed < 0:
                return page.find(">", m.end())
            start = closed + 1
        return -1

    def write(start: int, end: int) -> None:
        raw = page[start:end]
        if hidden or not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        if not text.strip():
            if out and out[-1][0] >= 0:
                out.append((out[-1][0], " "))
            return
        node = Node(stack[-1], "#text", "", None)
        node.text, node.start = len(text), text
        nodes.append(node)
        out.append((len(nodes) - 1, text))

    def close(depth: int) -> None:
        nonlocal hidden
        while len(stack) > depth:
            tag = nodes[stack.pop()].tag
            places[tag].pop()
            if tag in UNSEEN:
                hidden -= 1
                unseen.pop()
            if tag in BLOCKS:
                out.append((-1, ""))
                blocks.pop()

    def deepest(*tags: str) -> int:
        return max((places[t][-1] for t in tags if places[t]), default=0)

    def leave_head(start: int, end: int) -> None:
        if nodes[stack[-1]].tag == "head" and page[start:end].strip():
            close(len(stack) - 1)

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            leave_head(at, n)
            write(at, n)
            break
        tag, end = m.group(2), m.end()
        if tag is not None and (end := tag_end(m.end())) < 0:  # no tag, but text
            leave_head(at, m.end())
            write(at, m.end())
            at = m.end()
            continue
        leave_head(at, m.start())
        write(at, m.start())
        at = end if tag is None else end + 1
        if tag is None:
            continue
        tag, attributes = tag.lower(), page[m.end() : end]
        if m.group(1):
            if places[tag] and not (tag in INLINE and places[tag][-1] < deepest("td", "th", "table")):
                close(places[tag][-1])
            continue
        if tag not in IN_HEAD and nodes[stack[unseen[-1]]].tag == "head":
            close(unseen[-1])
        if tag in CLOSE_P and nodes[stack[blocks[-1]]].tag == "p":
            close(blocks[-1])
        if tag in CLOSES:
            own, scopes = CLOSES[tag]
            if deepest(*own) > deepest(*scopes):
                close(deepest(*own))
        if tag in BLOCKS:
            out.append((-1, ""))
        if tag in VOID:
            continue
        names, label = "", None
        if "=" in attributes:
            for key, *values in ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("class", "id", "role"):
                    names += " " + "".join(values).lower()
                elif key == "data-content":
                    label = "".join(values)
        nodes.append(Node(stack[-1], tag, names, label))
        if tag in RAW:
            close_tag = RAW_END[tag].search(page, at)  # without one, the rest of the page is raw
            at = close_tag.end() if close_tag else n
            continue
        if not attributes.endswith("/") or tag in BLOCKS:
            places[tag].append(len(stack))
            if tag in BLOCKS:
                blocks.append(len(stack))
            if tag in UNSEEN:
                unseen.append(len(stack))
                hidden += 1
            stack.append(len(nodes) - 1)
    return nodes, out


def features(nodes: list[Node]) -> tuple[list[list[str]], list[list[str]]]:
    """Features of each node by itself, once texts and links are summed up to the root; and those that it hands down to all below
    it, without what a node above it hands down."""
    in_link = [False] * len(nodes)
    for k, x in enumerate(nodes):
        if x.parent >= 0:
            in_link[k] = in_link[x.parent] or x.tag == "a"
        if x.tag == "#text" and in_link[k]:
            x.links = x.text
    for x in reversed(nodes):
        if x.parent >= 0:
            up = nodes[x.parent]
            up.text += x.text
            up.links += x.links
            up.children += 1
    out, handed = [], []
    path, above = [], set()  # nodes from the root to the last one, and what they hand down
    for k, x in enumerate(nodes):
        while path and path[-1] != x.parent:
            above.difference_update(handed[path.pop()])
        words = dict.fromkeys(NAME_WORD.findall(x.names))
        handed.append([f for f in (f"in {w}" for w in dict.fromkeys((*words, x.tag))) if f not in above] if words or x.tag in SECTIONS else [])
        path.append(k)
        above.update(handed[k])
        share = min(3, 4 * x.links // x.text) if x.text else -1
        size = min(5, int(math.log(x.text + 1, 4)))
        if x.tag == "#text":
            stripped = x.start.strip()
            out.append([f"text {size}", f"linked {in_link[k]}", f"stop {stripped[-1:] in '.!?:;,'}", f"mark {stripped[:1] in '©®™|»'}"])
        else:
            out.append([f"tag {x.tag}", f"links {share}", f"size {size}", *(f"name {w}" for w in words)])
    return out, handed


def train(pages: list[str]) -> dict:
    """Potentials by smoothed counts over labelled pages: log-odds of features, and how often a child's label follows its parent's."""
    counts, edges = defaultdict(Counter), Counter()
    for page in pages:
        nodes, _ = parse(page)
        labels: list[int] = []
        for x in nodes:
            labels.append(int(x.label) if x.label is not None else labels[x.parent] if x.parent >= 0 else 0)
        within: list[list[str]] = []
        for x, y, found, handed in zip(nodes, labels, *features(nodes), strict=True):
            above = within[x.parent] if x.parent >= 0 else []
            within.append(above + handed)
            for f in (*found, *above):
                counts[f][y] += 1
                counts[f.split(" ")[0] + " *"][y] += 1
            if x.parent >= 0:
                edges[labels[x.parent], y] += 1
    odds = {f: math.log((c[1] + SMOOTHING) / (counts[f.split(" ")[0] + " *"][1] + 1)) - math.log((c[0] + SMOOTHING) / (counts[f.split(" ")[0] + " *"][0] + 1)) for f, c in counts.items() if not f.endswith(" *")}
    hand = [[math.log((edges[p, y] + SMOOTHING) / (edges[p, 0] + edges[p, 1] + 1)) for y in (0, 1)] for p in (0, 1)]
    return {"odds": odds, "hand": hand}


def marginals(nodes: list[Node], model: dict) -> list[float]:
    """Probability of each node to be article, by messages up to the root and down again. Logs of ratios and of sums are used."""
    odds, ((h00, h01), (h10, h11)) = model["odds"], model["hand"]
    n = len(nodes)
    own, within = [0.0] * n, [0.0] * n  # within: what a node and those above it hand down
    for k, (found, handed) in enumerate(zip(*features(nodes), strict=True)):
        above = within[nodes[k].parent] if k else 0.0
        within[k] = above + sum(odds.get(f, 0.0) for f in handed)
        own[k] = DAMPING * (above + sum(odds.get(f, 0.0) for f in found))
    up0, up1 = [0.0] * n, [0.0] * n  # what a node's subtree says to its parent's label 0 and 1
    in0, in1 = [0.0] * n, own[:]  # a node's own potential and its children's messages
    for k in range(n - 1, 0, -1):
        a, b = in0[k], in1[k]
        up0[k], up1[k] = log_sum(h00 + a, h01 + b), log_sum(h10 + a, h11 + b)
        p = nodes[k].parent
        in0[p] += up0[k]
        in1[p] += up1[k]
    all0, all1 = in0[:], in1[:]
    all1[0] -= 30.0  # the root is no article
    for k in range(1, n):
        p = nodes[k].parent
        d0, d1 = all0[p] - up0[k], all1[p] - up1[k]
        all0[k] += log_sum(h00 + d0, h10 + d1)
        all1[k] += log_sum(h01 + d0, h11 + d1)
    return [1 / (1 + math.exp(min(700.0, max(-700.0, a - b)))) for a, b in zip(all0, all1, strict=True)]


def log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def extract(page: str | None, model: dict, threshold: float = 0.5) -> str:
    """The texts whose marginal is above the threshold: white space in a block becomes one space, blocks are joined by one."""
    if not page:
        return ""
    nodes, out = parse(page)
    p = marginals(nodes, model)
    blocks, block = [], []
    for k, text in [*out, (-1, "")]:
        if k >= 0:
            if p[k] > threshold:
                block.append(text)
        elif block:
            blocks.append(" ".join("".join(block).split()))
            block = []
    return " ".join(b for b in blocks if b)


def extract_pages(pages: DataFrame, html_col: str = "html", model: dict | None = None) -> DataFrame:
    """Adds text and n_chars (code points) to pages; columns with those names are replaced.

    Null and empty pages, and pages without an article, have an empty text. Pages are read whole, broken markup included;
    a page of plain text is judged as one text. Repeated rows and other columns stay; an empty table gives an empty one.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or train(labelled_pages()))

    def make():
        model = shared.value

        def work(values):
            texts = [extract(v, model) for v in values]
            return texts, [len(t) for t in texts]

        return work

    return map_column(pages, html_col, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)
