"""Operator 3, main text of web pages by tag-path ratios.

A page is cut into blocks (runs of text between block-level tags); a block's path is the chain
of tags from the root. For every path the text length and the punctuation of its blocks are
added up and divided by their number; links count against it. Both series are smoothed over
neighbouring blocks in page order, multiplied, and compared with a threshold from their spread;
a path is content if its best block passes, and if by itself it has ``ALONE`` of the best path's ratio. Only scripts and the like and what is hidden are left
out beforehand. Elements whose tag or name tells something else than the article (navigation,
footers, adverts, comments, forms, ...), and what lies outside of article and main elements where
there are any, count by the square of twice their share of the page's unlinked text, in full from
half of it on; where both speak against a block, or its tag does (``FIRM``), by the fourth power, in
full from nine tenths on, and where tag and place do, by the sixteenth, in full from 0.97 on. So
nothing alone discards a page's text. Headings next to content paths belong to the content.

A page's elements are nodes of a tree, one for each path, so time and memory grow with the page's
length whatever its depth.

Defined cases: null or empty html, and pages without text, give an empty text; unclosed and
stray tags are tolerated; rows are independent, so repeated rows repeat; other columns pass
through ``extract`` (``text`` and ``n_chars`` are replaced).
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_TELLING = {"class", "id", "role", "aria-label", "hidden", "style"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math select object canvas video audio".split())
OUT = {"head"} | RAW
WEAK = set("nav footer button menu header aside form dialog label fieldset".split())  # weighed as named elements are
ALONE = 0.3
FIRM = set("nav footer menu button".split())  # of these, tags that never hold the article by their meaning
HIDDEN = "hidden"
#: share of the text from which a block counts in full, and the power below it, by how much speaks against it
LEVELS = ((0.5, 2), (0.9, 4), (0.97, 16))
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table"}
ENDS_P = set("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: words in class, id or role that name what is not the article
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|promoted|outbrain|taboola|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|rail|widget|"
    r"footer|header|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|"
    r"recommended|recommendations|more-stories|comments?|comment-list|disqus|respond|replies|reply|reviews?|pagination|pager|tags|search|copyright|legal|disclaimer|"
    r"contentinfo|complementary|skip|hidden)(?:$|[\s_-])",
    re.I,
)
#: what even an article element may be named when it is not the article
_NAMED_ARTICLE = re.compile(r"(?:^|[\s_-])(?:comments?|reply|replies|ads?|advert\w*|sponsor\w*|promo\w*|related|recommended|teaser)(?:$|[\s_-])", re.I)
_ABOUT = re.compile(r"\b(?:has|with|no|without)[-_]\w+", re.I)  # names of a wrapper that tell what it holds or lacks
_SPACE = re.compile(r"\s+")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")


class Block:
    __slots__ = ("node", "parts", "linked")

    def __init__(self, node: int):
        self.node = node
        self.parts: list[str] = []
        self.linked = 0


class Tree:
    """Nodes of a page, one for each path; a child's number is above its parent's."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, str], int] = {}
        self.parent, self.label = [-1], [""]
        self.named, self.out, self.home, self.heading = [False], [False], [False], [False]

    def child(self, parent: int, tag: str, named: str) -> int:
        key = (parent, tag + named)
        if key not in self.known:
            self.known[key] = len(self.parent)
            self.parent.append(parent)
            self.label.append(key[1])
            self.named.append(bool(named))
            self.out.append(self.out[parent] or named == HIDDEN)
            self.home.append(self.home[parent] or (tag in ("article", "main") and not named))
            self.heading.append(self.heading[parent] or tag in HEADINGS)
        return self.known[key]

    def path(self, node: int) -> str:
        labels = []
        while node > 0:
            labels.append(self.label[node])
            node = self.parent[node]
        return "/".join(reversed(labels))


class _Stack:
    """Open elements, with the places of each tag so that nothing is searched for."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.nodes: list[int] = []
        self.places: dict[str, list[int]] = defaultdict(list)

    def push(self, tag: str, node: int) -> None:
        self.places[tag].append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def last(self, tags: set[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def cut(self, at: int) -> None:
        while len(self.tags) > at:
            self.places[self.tags.pop()].pop()
            self.nodes.pop()

    def node(self) -> int:
        return self.nodes[-1] if self.nodes else 0


def _named(tag: str, attributes: str) -> str:
    """The word by which the attributes name something else than the article, HIDDEN if they hide it."""
    word = ""
    for a in _ATTR.finditer(attributes):
        kind, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if kind not in _TELLING:
            continue
        if kind == "hidden":
            return HIDDEN
        if kind == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return HIDDEN
        elif tag not in ("html", "body", "main"):
            if not word and (m := (_NAMED_ARTICLE if tag == "article" else _NAMED).search(_ABOUT.sub("", value))):
                word = "!" + m[0].strip(" \t\r\n_-").lower()
    return word


def blocks(html: str) -> tuple[Tree, list[tuple[Block, str]]]:
    """The page's tree and its blocks with text, in page order."""
    tree, stack = Tree(), _Stack()
    found: list[Block] = []
    now: Block | None = None
    unclosed: set[str] = set()  # tags that end nowhere in the rest of the page
    at, end = 0, len(html)

    def text(piece: str) -> None:
        nonlocal now
        if not piece:
            return
        if now is None:
            if piece.isspace():
                return
            now = Block(stack.node())
            found.append(now)
        piece = unescape(piece)
        now.parts.append(piece)
        if stack.places["a"]:
            now.linked += len(piece)

    while at < end:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag = tag.lower()
        if m[1]:
            if tag not in INLINE:
                now = None
            if (place := stack.last({tag})) >= 0:
                stack.cut(place)
            continue
        if tag == "br":
            text(" ")
            continue
        if tag not in INLINE:
            now = None
        if tag in VOID:
            continue
        if tag in RAW:
            if not m[0].endswith("/>"):
                close = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                if close is None:
                    unclosed.add(tag)
                at = close.end() if close else (at if tag in ("svg", "math", "object", "canvas", "video", "audio", "select", "noscript") else end)
            continue
        if tag in ENDS_P and (place := stack.last({"p"})) >= 0:
            stack.cut(place)
        elif tag in CLOSES and (place := stack.last(CLOSES[tag])) > stack.last(LISTS):
            stack.cut(place)
        if m[0].endswith("/>") and tag not in ("p", "div", "article", "section"):
            continue
        named = HIDDEN if tag in OUT else _named(tag, m[3] or "")
        inside = tree.home[stack.node()]
        if named == "!header" and inside:  # an article's own
            named = ""
        elif not named and tag in WEAK and not (tag == "header" and inside):
            named = "!"
        node = stack.node()
        stack.push(tag, node if tag in INLINE and not named else tree.child(node, tag, named))
    out = []
    for block in found:
        joined = _SPACE.sub(" ", "".join(block.parts)).strip()
        if joined:
            out.append((block, joined))
    return tree, out


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.array([0.25, 0.5, 0.25])
    return np.convolve(np.pad(x, 1, mode="edge"), kernel, "valid") if len(x) else x


def _weight(share: float, against: int) -> float:
    full, power = LEVELS[against]
    return min(1.0, share / full) ** power


def _weights(tree: Tree, found: list[tuple[Block, str]]) -> tuple[np.ndarray, float]:
    """Weight of every block from 0 to 1, and the share of unlinked text outside article and main."""
    plain = np.array([max(len(t) - b.linked, 0) for b, t in found], float)
    held, told = [0.0] * len(tree.parent), [0.0] * len(tree.parent)  # text of each node, and what of it has punctuation
    for (block, text), size in zip(found, plain.tolist()):
        held[block.node] += size
        told[block.node] += size if _PUNCTUATION.search(text) else 0.0
    for node in range(len(held) - 1, 0, -1):  # children come after their parents
        held[tree.parent[node]] += held[node]
        told[tree.parent[node]] += told[node]
    whole = max(float(plain.sum()), 1.0)
    home = np.array([tree.home[b.node] for b, _ in found])
    # by node: its weight if its place does not speak against it, and if it does
    named, loose, strict = [False] * len(held), [1.0] * len(held), [1.0] * len(held)
    for node in range(1, len(held)):
        up = tree.parent[node]
        named[node], loose[node], strict[node] = named[up] or tree.named[node], loose[up], strict[up]
        if tree.named[node]:
            against = 1 if tree.label[node].rstrip("!") in FIRM else 0
            share = (told if against else held)[node] / whole
            loose[node] *= _weight(share, against)
            strict[node] *= _weight(share, against + 1)
    both = np.array([named[b.node] for b, _ in found]) & ~home & home.any()
    weights = np.where(both, [strict[b.node] for b, _ in found], [loose[b.node] for b, _ in found])
    inside, outside = float((plain * weights)[home].sum()), float((plain * weights)[~home].sum())
    if not home.any():
        return weights, 0.0
    share = outside / max(inside + outside, 1e-9)
    weights[~home] *= np.where(both[~home], _weight(share, 1), _weight(share, 0))
    return weights, share


def scores(tree: Tree, found: list[tuple[Block, str]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of every block the fused ratio of its path, smoothed over neighbours and as it is, and the threshold."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    for block, text in found:
        total = sums[block.node]
        total[0] += max(len(text) - 2 * block.linked, 0)
        total[1] += len(_PUNCTUATION.findall(text))
        total[2] += 1
    lengths = np.array([sums[b.node][0] / sums[b.node][2] for b, _ in found]) * weights
    marks = np.array([sums[b.node][1] / sums[b.node][2] for b, _ in found]) * weights
    fused = np.sqrt(_smooth(lengths) * (_smooth(marks) + 0.5)) * weights
    own = np.sqrt(lengths * (marks + 0.5)) * weights
    bar = min(0.5 * float(fused.std()), 0.6 * float(fused.max())) if len(fused) > 1 else 0.0
    return fused, own, bar


def main_text(html: str) -> str:
    tree, found = blocks(html)
    found = [(b, t) for b, t in found if not tree.out[b.node]]
    if not found:
        return ""
    weights, outside = _weights(tree, found)
    fused, own, bar = scores(tree, found, weights)
    good: set[int] = set()
    for (block, _), value, alone in zip(found, fused, own):
        low = 0.15 if tree.home[block.node] and outside <= 0.5 else 1.0  # inside an article element that holds the text little is needed
        if value >= low * bar and alone >= low * ALONE * own.max() and alone > 0:
            good.add(block.node)
    if not good:
        good = {b.node for (b, _), w in zip(found, weights) if w > 0}
    above: set[int] = set()  # nodes that hold a content path
    for node in good:
        node = tree.parent[node]
        while node >= 0 and node not in above:
            above.add(node)
            node = tree.parent[node]
    near = lambda node, weight: tree.heading[node] and weight >= 0.5 and tree.parent[node] in above
    return "\n".join(t for (b, t), w in zip(found, weights) if b.node in good or near(b.node, w))


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (code points) of every page."""
    keep = tuple(c for c in keep if c not in ("text", "n_chars"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text((h or b"").decode("utf-8", "replace")) for h in batch.column("_raw").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    chosen = pages.select(*keep, F.col("html").cast("binary").alias("_raw"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.drop("_raw").schema.fields)
    return common.map_batches(chosen, work, f"{kinds}, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"), "page_id", "url")
