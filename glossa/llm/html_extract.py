"""Main-text extraction with a site style tree.

The DOMs of a host are merged: nodes with the same path of (tag, class, id) are one node of the host's style tree. A node's
importance combines how its pages present it (entropy of the child-tag sequences seen there) with what they say
there (one minus the mean entropy of its text blocks over the pages: a block that every page repeats says nothing), and
is weighted by what its markup declares (navigation, adverts, forms and the like weigh nothing, an article and its plain
text elements weigh fully, anything else is undecided, or a little less where a class only hints at furniture). Branches of
low importance are removed from each page, but none that holds an article for its class alone; the rest is the text.

Scale: a page sends one small row a node, with the hashes of the blocks that are directly its own; counts are combined
before they are shuffled, so a host with a third of all pages is spread by node and block. The list of branches
to remove comes back to each page by its id, never as a whole site to one task, and html crosses the shuffle
compressed. Each page is parsed twice in tasks by a tolerant parser of linear time.

Defined results: a null or empty html has the empty text; pages without a host form one host together; markup that never
ends is closed at the end of the page; repeated rows are extracted each (rows that share a ``page_id`` share the branches
found in any of them); an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import map_docs, store

#: A branch is removed where weight * (1 + importance) / 2 is below THRESHOLD.
THRESHOLD = 0.3
#: Weights: undecided nodes, and nodes inside an article that aren't plain text elements.
UNDECIDED, INSIDE = 0.5, 0.55
#: Weight of nodes with a class or id that hints at furniture: below ``UNDECIDED``, and importance decides.
HINTED = 0.4
#: Distinct pages of a host below which repetition says nothing.
MIN_PAGES = 5
#: Share of a node's own presentation in its importance; the rest is its content.
PRESENTATION = 0.1

# HTML elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes noembed iframe xmp".split())
BLOCK = frozenset(("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                   "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table "
                   "tbody td tfoot th thead tr ul option select caption").split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption option select body html head li dd dt legend summary".split())
SAME_LEVEL = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
              "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
LIST_SCOPE = frozenset("ul ol menu dl table select tbody thead tfoot body article div section td th".split())
NEVER_TEXT = frozenset(("head nav footer aside form script style noscript template iframe button select input textarea svg canvas "
                        "object embed dialog menu title noframes noembed xmp audio video").split())
CONTENT = frozenset(("article", "main"))
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption b i em strong a span "
                 "code q cite small sub sup u s mark br hr".split())
BOILERPLATE_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu submenu "
    "breadcrumb breadcrumbs header masthead topbar footer bottombar sidebar aside widget widgets related recommended share sharing "
    "social comment comments commentlist disqus reply replies respond notice notices notification alert cookie cookies consent gdpr "
    "privacy popup modal overlay subscribe subscription newsletter signup login search searchbox pagination pager toolbar copyright "
    "legal skip hidden").split())
# Of these, words that also name content or its layout: alone they hint, as any listed word does among others (has-sidebar).
AMBIGUOUS_WORDS = frozenset(("header masthead menu aside related recommended share sharing social comment reply replies respond alert privacy "
                             "search legal skip hidden").split())
BOILERPLATE_ROLES = frozenset(("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar "
                               "status").split())

_TOKEN = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))|(?P<markup><[!?][^>]*(?:>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z]+")
_DIGITS = re.compile(r"\d+")


_ALL = (1 << 64) - 1
_signed = lambda h: h - (1 << 64) if h >> 63 else h


@dataclass
class Node:
    """An open element."""
    tag: str
    key: int
    weight: float
    inside: bool  # within an article
    children: list[str] = field(default_factory=list)
    parent: Node | None = None
    silent: bool = False  # its text is not read: it is removed, or it interrupts a block without being one
    gone: bool = False  # it or an ancestor is removed
    named: bool = False  # weighted by its class or id alone
    holds: bool = False  # an article is below it
    content: bool = False  # it is one


class Labels(dict):
    """Attribute text of a tag -> (its label in the style tree, boilerplate, listed words, article), kept for the last
    distinct ones. Listed words: "" without any, "declared" where a name consists of unambiguous ones, else "hint"."""

    def __missing__(self, at: tuple[str, str]) -> tuple[str, bool, str, bool]:
        tag, attrs = at
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in _ATTR.finditer(attrs)} if attrs else {}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        words = [set(_SPLIT.split(name)) - {""} for name in names.split()]
        content = tag in CONTENT or found.get("role") in ("main", "article")
        bad = tag in NEVER_TEXT or found.get("role") in BOILERPLATE_ROLES or "hidden" in found
        listed = ""
        if tag not in ("html", "body") and not content and any(w & BOILERPLATE_WORDS for w in words):
            listed = "declared" if any(w and w <= BOILERPLATE_WORDS - AMBIGUOUS_WORDS for w in words) else "hint"
        label = f"{tag} {' '.join(sorted(_DIGITS.sub('', names).split()))}"
        if len(self) > 50_000:
            self.clear()
        self[at] = out = (label, bad, listed, content)
        return out


def _weight(tag: str, label: str, bad: bool, listed: str, content: bool, parent: Node) -> tuple[float, bool, bool]:
    """(weight, within an article, whether listed words alone lowered it)."""
    inside = parent.inside or content
    if bad or (tag == "header" and not parent.inside):
        return 0.0, inside, False
    if content:
        return 1.0, inside, False
    if listed == "declared":
        return 0.0, inside, True
    if inside and (tag in TEXT or label == f"{tag} "):
        return 1.0, inside, False
    if listed:
        return HINTED, inside, True
    return (INSIDE if inside else UNDECIDED), inside, False


def parse(page: str, host: str, labels: Labels, gone: set[int] = frozenset()) -> Iterator[tuple[str, Node, str]]:
    """("close", node, "") for every element, ("block", node, text) for every block of text, in page order, without the
    branches in ``gone``. A block belongs to the innermost element open where it began."""
    root = Node("", _signed(xxhash.xxh3_64_intdigest(host)), UNDECIDED, False)
    stack, text, owner = [root], [], root
    pos, n = 0, len(page)

    def flush():
        nonlocal text
        if text:
            block = " ".join(_html.unescape("".join(text)).split())
            text = []
            if block:
                yield "block", owner, block

    def close(upto: int):
        while len(stack) > upto:
            node = stack.pop()
            if node.tag in BLOCK:
                yield from flush()
            yield "close", node, ""

    def find(tags, barrier) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in barrier:
                break
        return 0

    while pos < n:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        if (part := m["text"]) is not None:
            if not stack[-1].silent and (text or not part.isspace()):
                if not text:
                    owner = stack[-1]
                text.append(part)
            continue
        if m["name"] is None:
            continue
        tag = m["name"].lower()
        if m["end"]:
            at = find((tag,), () if tag in BLOCK else BLOCK)
            if at:
                if tag in BLOCK:
                    yield from flush()
                yield from close(at)
            continue
        if tag == "br":
            if text:
                text.append(" ")
            continue
        if tag in BLOCK:
            yield from flush()
        if tag in CLOSES_P and (at := find(("p",), LIST_SCOPE)):
            yield from close(at)
        if tag in SAME_LEVEL and (at := find(SAME_LEVEL[tag], LIST_SCOPE - set(SAME_LEVEL[tag]))):
            yield from close(at)
        parent = stack[-1]
        label, bad, listed, content = labels[tag, m["attrs"]]
        weight, inside, named = _weight(tag, label, bad, listed, content, parent)
        parent.children.append(tag)
        if tag in VOID:
            continue
        key = _signed(xxhash.xxh3_64_intdigest(label, parent.key & _ALL))
        lost = parent.gone or key in gone
        silent = lost or (parent.silent and not content) or (weight == 0 and tag not in BLOCK)
        node = Node(tag, key, weight, inside, parent=parent, silent=silent, gone=lost, named=named, content=content)
        while content and parent and not parent.holds:
            parent.holds, parent = True, parent.parent
        if tag in RAW:  # never text: go on behind it
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, pos)
            pos = end.start() if end else n
        stack.append(node)
    yield from flush()
    yield from close(1)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-zA-Z][\w+.-]*://", "", url or "").split("/", 1)[0].rpartition("@")[2].lower()


# ---- the style tree -----------------------------------------------------------------------------

def _page_nodes(batches):
    """Pass one: the distinct nodes of each page, with their style, their own blocks, their ancestors and whether, weighted by
    their class alone, they hold an article."""
    labels = Labels()
    for b in batches:
        rows = []
        for page_id, url, page in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            nodes: dict[int, tuple[Node, list, set]] = {}
            holding = set()
            sid = _signed(xxhash.xxh3_64_intdigest(f"{host_of(url)}\0{page}"))
            for what, node, text in parse(page or "", host_of(url), labels):
                if what == "close":
                    nodes.setdefault(node.key, (node, [], set()))[1].append(",".join(node.children))
                    if node.named and node.holds:
                        holding.add(node.key)
                elif what == "block" and node.parent:
                    nodes.setdefault(node.key, (node, [], set()))[2].add(_signed(xxhash.xxh3_64_intdigest(text)))
            marked = any(node.content for node, _, _ in nodes.values())
            for key, (node, styles, blocks) in nodes.items():
                # outside the article of a page, a hint is enough
                outside = marked and node.weight == HINTED and not node.inside and key not in holding
                up, at = [], node
                while at.parent:
                    up.append(at.key)
                    at = at.parent
                style = _signed(xxhash.xxh3_64_intdigest("|".join(sorted(set(styles)))))
                rows.append((page_id, sid, key, node.weight, style, up, list(blocks), key in holding, outside))
        cols = list(zip(*rows)) or [()] * 9
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                                         names=["page_id", "sid", "node", "weight", "style", "up", "blocks", "holds", "outside"])


NODES = "page_id long, sid long, node long, weight double, style long, up array<long>, blocks array<long>, holds boolean, outside boolean"


def page_nodes(page: DataFrame) -> DataFrame:
    """Rows of ``NODES`` with share: one over the rows that hold the same page of the same host, so that copies of a page count
    as one page."""
    nodes = map_docs(page, _page_nodes, NODES)
    roots = nodes.filter(F.size("up") == 1).groupBy("sid", "node").agg(F.count("*").alias("n")).filter("n > 1")
    same = store(roots.groupBy("sid").agg(F.max("n").alias("n")))
    return nodes.join(same, "sid", "left").select("page_id", "node", "weight", "style", "up", "blocks", "holds", "outside", (1 / F.coalesce("n", F.lit(1))).alias("share"))


def importance(nodes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(node, weight, importance) of every node of the style trees.

    With m pages at a node: presentation is the entropy (base m) of its styles; a block on n of them has entropy log_m n; content
    is one minus the mean over the distinct blocks of the node's subtree. A node on fewer than ``min_pages`` pages
    is fully important, and a subtree without blocks has only its presentation."""
    n = F.sum("share").alias("n")
    pages = store(nodes.groupBy("node").agg(F.sum("share").alias("m"), F.max("weight").alias("weight"), F.first("up").alias("up")))
    spread = (nodes.groupBy("node", "style").agg(n).groupBy("node")
              .agg((F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("bits")))
    own = (nodes.select("node", "share", F.explode("blocks").alias("block")).groupBy("node", "block").agg(n)
           .groupBy("node").agg(F.count("*").alias("l"), F.sum(F.log("n")).alias("logs")))
    enough = F.col("m") > min_pages - 0.5
    tree = (pages.join(own, "node").select(F.explode("up").alias("node"), "l", F.when(enough, F.col("logs") / F.log("m")).otherwise(0.0).alias("h"))
            .groupBy("node").agg(F.sum("l").alias("l"), F.sum("h").alias("h")))
    shown, said = F.col("bits") / F.log("m"), 1 - F.col("h") / F.col("l")
    value = F.when(~enough, 1.0).when(F.col("l").isNull(), shown).otherwise(PRESENTATION * shown + (1 - PRESENTATION) * said)
    return pages.join(spread, "node").join(tree, "node", "left").select("node", "weight", value.alias("importance"))


def _compress(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for b in batches:
        packed = [None if t is None else squeeze.compress(t) for t in b.column(2).cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["page_id", "url", "z"])


def _extract(batches):
    """Pass two: the blocks outside removed branches."""
    labels, inflate = Labels(), zstandard.ZstdDecompressor()
    for b in batches:
        texts = []
        for url, z, removed in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            page = inflate.decompress(z).decode("utf-8", "replace") if z else ""
            kept = [text for what, _, text in parse(page, host_of(url), labels, set(removed or ())) if what == "block"]
            texts.append("\n".join(kept))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract_text(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text): the main text of every page, a block a line."""
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    nodes = store(page_nodes(page))
    fails = lambda weight: weight * (1 + F.col("importance")) / 2 < threshold
    low = store(importance(nodes).filter(fails(F.col("weight"))).select("node", fails(F.lit(UNDECIDED)).alias("undecided_fails")))
    found = nodes.select("page_id", "node", "holds").join(low, "node").filter(~F.col("holds") | F.col("undecided_fails")).select("page_id", "node")
    removed = (found.union(nodes.filter("outside").select("page_id", "node")).groupBy("page_id").agg(F.collect_set("node").alias("removed"))
               .withColumnRenamed("page_id", "at"))
    packed = map_docs(page, _compress, "page_id long, url string, z binary")
    met = packed.join(removed, F.col("page_id").eqNullSafe(F.col("at")), "left").select("page_id", "url", "z", "removed")
    return map_docs(met, _extract, "page_id long, url string, text string")
