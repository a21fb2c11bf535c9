"""Main text of web pages by wrapper induction (operator 9).

Every page is parsed to a tree and aligned, by simple tree matching, with a reference page of its host, and with one of its
layout (pages of the host with the same kinds of frame elements) where the host has several. Aligned nodes whose text is the same are constant, others vary. The votes of all pages of a host or layout, added up, give its wrapper: whether the text
that varies lies mostly in the elements that the author marked as `article` or `main` or elsewhere, and the constant texts
of the template. A page's article is what the marked elements hold (the whole page if none is marked, or if the votes are
for the page), without template texts and without menus, forms, adverts, comments and the like, which are known by their
elements and by their class, id and role, taken as whole names. Within marked elements fewer names count, and none for headers and
what holds the h1; formulas and noscript are text. There a text is constant only if all of its
run of like siblings is, so a sentence that articles share, between paragraphs that differ, stays.

Runs of like leaf siblings (paragraphs, list items) are drawn together before matching, so the work of a pair of pages
grows with their different kinds of nodes and not with the square of their paragraphs. Votes are added up within each
task before the shuffle; a host with a third of all pages sends one row for each vote and task. One reference page per
host and layout is found by a map-side minimum; references and wrappers are broadcast only if their counted size allows.

Defined results: a null or empty html gives the empty text and 0. A null url is kept and belongs to the empty host. A page
with the same text as its reference casts no vote, one with most of its marked blocks and letters none on marked texts; hosts of a single page have no template and use the page alone. Rows that repeat an
id are pages of their own. An empty table gives an empty result. Other columns are ignored. Text outside any block, broken
nesting and unclosed elements are read as browsers do in the common cases. `br` is white space within its block.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import Scratch, read, small_enough

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<([!?])|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)", re.S)
#: What ends a tag or begins a quoted value in it.
SIGN = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "template", "iframe", "xmp", "svg"}
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Formulas are text of their block.
INLINE |= set("math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle".split())
INLINE |= set("msub msubsup msup mtable mtd mtext mtr munder munderover semantics none".split())
#: Other spellings of a formula, which no browser shows: left out without ending the block.
UNSHOWN = {"annotation", "annotation-xml"}
#: An element of the first kind is closed by the start of one of the second, and ends open elements within it.
CLOSED_BY = {
    "p": set("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"},
}
SCOPES = {"ul", "ol", "table", "dl", "article", "section", "div", "body", "main", "aside", "nav", "form", "blockquote"}
JUNK_TAGS = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "object", "audio", "video", "canvas", "input"}
JUNK_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead share sharing social related recommended comment comments commentlist reply replies "
    "respond disqus newsletter subscribe subscription signup login search pagination pager skip toolbar widget".split()
)
#: Of these, the class words that name no part of an article. Within marked elements only they count; the votes decide on the rest.
JUNK_WORDS_WITHIN = set(
    "ad ads advert adverts advertisement sponsored nav navbar breadcrumb breadcrumbs sidebar share sharing comment comments commentlist reply replies respond disqus "
    "newsletter pagination pager toolbar".split()
)
#: Words that, beside one of those, only say which one or what holds it: a token names junk if all its words are of either kind.
HOLDERS = set(
    "box block bar list item items section area wrap wrapper container inner outer panel slot unit zone region group row col column button buttons link links icon icons "
    "count form input field title head body content main site page global primary secondary top bottom left right post entry blog article user reader thread wp js the".split()
)
#: Elements by which an author marks what the page is about.
MARKED = {"article", "main"}
#: A text is the template's if so large a share of the pages that were aligned with it have it, of so many pages at least.
CONSTANT, PAGES = 0.9, 5
#: Parsed references that a task keeps.
TREES = 64


#: Elements below this depth are read as siblings, as browsers do at a limit of theirs.
DEEPEST = 200


def names_junk(token: str, junk: set[str]) -> bool:
    """Whether a whole class, id or role names such a part: "ad", "comment-list", "shareButtons", but not "ad-hoc"."""
    words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", token)}
    return bool(words & junk) and words <= JUNK_WORDS | HOLDERS


class Node:
    __slots__ = ("tag", "name", "junk", "worded", "parts", "parent", "depth", "marked")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.parent, self.parts, self.depth = tag, parent, [], parent.depth + 1 if parent else 0
        self.name, self.junk, self.worded = tag, tag in JUNK_TAGS, False
        self.marked = tag in MARKED or parent is not None and parent.marked
        if attributes and tag not in INLINE:
            found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(attributes)}
            if "class" in found:
                self.name = f"{tag}.{'.'.join(sorted(found['class'].lower().split()))}"
            junk = JUNK_WORDS_WITHIN if self.marked else JUNK_WORDS
            self.worded = any(names_junk(t, junk) for k in ("class", "id", "role") for t in found.get(k, "").split()) and tag not in ("html", "body", *MARKED, *(("header", "h1") if self.marked else ()))
            self.junk |= "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) is not None
        if tag == "header":  # an article's own header belongs to it
            self.junk |= not self.marked
        if tag == "main" or tag == "h1" and self.marked:  # no word of its holders makes them junk
            while parent is not None and parent.tag not in (MARKED if tag == "h1" else ()):
                parent.worded, parent = False, parent.parent

    @property
    def skipped(self) -> bool:
        return self.junk or self.worded


class Tags:
    """Reads the tags of a text in order. Whatever is sought and not there is remembered, so broken markup is read once."""

    def __init__(self, text: str):
        self.text, self.place, self.attributes = text, 0, ""
        self.missing: dict[str, int] = {}
        self.near, self.hopeless = (0, -1), set()

    def find(self, sign: str, place: int) -> int:
        """Where a sign stands from a place on, or -1."""
        if place >= self.missing.get(sign, len(self.text) + 1):
            return -1
        found = self.text.find(sign, place)
        if found < 0:
            self.missing[sign] = place
        return found

    def end_of(self, tag: str, place: int) -> int | None:
        """The end of the next closing tag of a kind."""
        key = f"</{tag}"
        if place >= self.missing.get(key, len(self.text) + 1):
            return None
        stop = re.compile(rf"</{tag}\s*+>", re.I).search(self.text, place)
        if not stop:
            self.missing[key] = place
        return stop.end() if stop else None

    def sign(self, place: int) -> int:
        """Where the next quote or end of a tag stands, or the text's end."""
        if not self.near[0] <= place <= self.near[1]:
            found = SIGN.search(self.text, place)
            self.near = place, found.start() if found else len(self.text)
        return self.near[1]

    def close(self, place: int) -> int:
        """Where a tag ends whose attributes begin here, or -1. Quotes from which no end is reached are remembered."""
        seen, at = [], self.sign(place)
        while at < len(self.text) and self.text[at] != ">" and at not in self.hopeless:
            seen.append(at)
            closing = self.find(self.text[at], at + 1)
            if closing < 0:
                break
            found = SIGN.search(self.text, closing + 1)
            at = found.start() if found else len(self.text)
        if at < len(self.text) and self.text[at] == ">":
            return at
        self.hopeless.update(seen)
        return -1

    def next(self, place: int) -> re.Match | None:
        """The next tag or comment; its end and attributes are kept. A tag whose quotes or end are missing is text."""
        while m := TOKEN.search(self.text, place):
            place = m.end()
            if not m[1] and not m[3]:
                self.place, self.attributes = place, ""
                return m
            end = self.find(">", place) if m[1] else self.close(place)
            if end >= 0:
                self.place, self.attributes = end + 1, self.text[place:end]
                return m
        return None


def parse(text: str) -> Node:
    """The tree of a page. Parts of a node are texts and nodes in order; inline elements dissolve into their texts."""
    root = at = Node("#root", "", None)
    place, end, tags = 0, len(text), Tags(text)
    while place < end:
        m = tags.next(place)
        if not m:
            at.parts.append(text[place:])
            break
        if m.start() > place:
            at.parts.append(text[place : m.start()])
        place, attributes = tags.place, tags.attributes
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in UNSHOWN:
            if not m[2] and not attributes.rstrip().endswith("/"):
                stop = tags.end_of(tag, place)
                place = place if stop is None else stop
            continue
        if tag in INLINE:
            if tag in ("br", "mtd"):
                at.parts.append(" ")
            continue
        if m[2]:
            node = at
            while node is not root and node.tag != tag:
                node = node.parent
            if node is not root:
                at = node.parent
            elif tag == "p":  # closes nothing, but ends the text before it
                at.parts.append(Node("p", "", at))
            continue
        closing = at
        while closing is not root and closing.tag not in SCOPES:
            if tag in CLOSED_BY.get(closing.tag, ()):
                at = closing.parent
            closing = closing.parent
        node = Node(tag, attributes, at)
        at.parts.append(node)
        if tag in RAW:
            stop = tags.end_of(tag, place)
            place = end if stop is None else stop
        elif tag not in VOID and not attributes.rstrip().endswith("/") and node.depth < DEEPEST:
            at = node
    return root


def clean(text: str) -> str:
    return " ".join((entities.unescape(text) if "&" in text else text).split())


def blocks(node: Node, path: str = "") -> Iterator[tuple[str, str]]:
    """(path, text) of the blocks below a node in page order, without junk."""
    held: list[str] = []
    for part in node.parts:
        if isinstance(part, str):
            held.append(part)
            continue
        if text := clean("".join(held)):
            yield path, text
        held = []
        if not part.skipped:
            yield from blocks(part, f"{path}/{part.name}")
    if text := clean("".join(held)):
        yield path, text


# ---- alignment ----


class Tree:
    """A node for matching: children are drawn together in runs of leaves of one name; a run holds its texts."""

    __slots__ = ("name", "path", "texts", "children", "size", "marked")

    def __init__(self, node: Node, path: str):
        self.name, self.path, self.children, self.size, self.marked = node.name, path, [], 1, node.marked
        direct = clean("".join(p for p in node.parts if isinstance(p, str)))
        self.texts = [direct] if direct else []
        for part in node.parts:
            if isinstance(part, str) or part.skipped:
                continue
            child = Tree(part, f"{path}/{part.name}")
            last = self.children[-1] if self.children else None
            if last is not None and last.name == child.name and not last.children and not child.children:
                last.texts += child.texts
            else:
                self.children.append(child)
        self.size += sum(c.size for c in self.children)


def simple_tree_matching(one: Tree, two: Tree) -> tuple[int, list[tuple[Tree, Tree]]]:
    """The size of the largest order-keeping match of two trees with equal roots, and its pairs."""
    if one.name != two.name:
        return 0, []
    if not one.children or not two.children:
        return 1, [(one, two)]
    rows, columns = len(one.children), len(two.children)
    best = [[0] * (columns + 1) for _ in range(rows + 1)]
    inner: dict[tuple[int, int], tuple[int, list]] = {}
    for i, a in enumerate(one.children, 1):
        line, above = best[i], best[i - 1]
        for j, b in enumerate(two.children, 1):
            match = 0
            if a.name == b.name:
                inner[i, j] = simple_tree_matching(a, b)
                match = inner[i, j][0]
            line[j] = max(above[j], line[j - 1], above[j - 1] + match)
    pairs, i, j = [(one, two)], rows, columns
    while i and j:
        match = inner.get((i, j), (0, []))
        if match[0] and best[i][j] == best[i - 1][j - 1] + match[0]:
            pairs += match[1]
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return 1 + best[rows][columns], pairs


def region(root: Node) -> tuple[str, list[tuple[str, Node]]]:
    """"marked" with the paths and nodes of all outermost marked elements that hold text, or "" with the whole page."""
    found = list(_marked(root, ""))
    return ("marked", found) if found else ("", [("", root)])


def _marked(node: Node, path: str) -> Iterator[tuple[str, Node]]:
    for part in node.parts:
        if isinstance(part, Node) and not part.skipped:
            own = f"{path}/{part.name}"
            if part.tag not in MARKED:
                yield from _marked(part, own)
            elif next(blocks(part, own), None):
                yield own, part


def marked_texts(root: Node) -> list[str]:
    """The texts of the blocks of all marked elements."""
    return [text for path, node in _marked(root, "") for _, text in blocks(node, path)]


def near_copy(own: list[str], reference: set[str]) -> bool:
    """Whether more than half of the blocks, and of the letters, of a page's marked texts are the reference's too."""
    same = [t for t in own if t in reference]
    return 2 * len(same) > len(own) and 2 * sum(map(len, same)) > sum(map(len, own))


def page_votes(page: Tree, reference: Tree, own_region: str, copied: bool = False) -> Iterator[tuple[str, str, bool]]:
    """(path, text, same) for the texts of the reference that were aligned; and, from a page with a region of its own,
    ("region", "marked" or "page", True) by where more of its text varies. A near copy has no say on marked texts."""
    varying = {True: 0, False: 0}  # letters in and outside of marked elements
    open_ = [page]
    while open_:
        node = open_.pop()
        varying[node.marked] += sum(map(len, node.texts))
        open_ += node.children
    for ours, theirs in simple_tree_matching(page, reference)[1]:
        own, other = set(ours.texts), set(theirs.texts)
        varying[ours.marked] -= sum(len(t) for t in ours.texts if t in other)
        if theirs.marked and copied:
            continue
        for text in dict.fromkeys(theirs.texts):
            yield theirs.path, text, (ours.texts == theirs.texts if theirs.marked else text in own)
    if own_region:
        yield "region", "page" if varying[False] > varying[True] else "marked", True


def article(root: Node, goal: str | None, template: set[tuple[str, str]]) -> str:
    """The text of the region, without the template's: of the marked elements, or of the whole page if the goal is "page"."""
    found = [("", root)] if goal == "page" else region(root)[1]
    return "\n\n".join(text for path, node in found for own, text in blocks(node, path) if (own, text) not in template)


# ---- the operator ----


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


#: Elements that make up a page's layout, as opposed to its text.
FRAME = r"(?i)<(?:div|section|main|article|header|nav|aside|footer|form)\b[^>]*>"


def layout_of(html: Column) -> Column:
    """A hash of the kinds of frame elements of a page: their tags and classes without digits, whatever their number and order."""

    def kind(tag: Column) -> Column:
        names = F.regexp_extract(tag, r"(?i)\bclass\s*=\s*[\"']?([^\"'>]*)", 1)
        return F.lower(F.concat_ws(".", F.regexp_extract(tag, r"<(\w+)", 1), F.regexp_replace(names, "[0-9]+", "")))

    return F.xxhash64(F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(FRAME), F.lit(0)), kind))))


def _references(pages: DataFrame, keys: list[str]) -> DataFrame:
    """One page for each key, by a minimum that is taken before the shuffle, and the number of pages."""
    picked = pages.groupBy(*keys).agg(F.min(F.struct(F.xxhash64("page_id", "html").alias("order"), "html")).alias("first"), F.count("*").alias("n"))
    return picked.select(*keys, "n", F.col("first.html").alias("reference"))


def induce(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """The wrappers: host, layout (null: of all pages of the host), region ("marked", "page" or null), template as an array of (path, text)."""
    hosted = pages.select(host_of(F.col("url")).alias("host"), layout_of(F.col("html")).alias("layout"), "page_id", "html").where("html <> ''")
    hosts = scratch.cut(_references(hosted, ["host"]).where("n > 1").select(F.col("host").alias("h"), F.col("n").alias("all"), "reference"), "references")
    # a layout of all pages of its host, or of too few for a template, needs no reference of its own
    layouts = _references(hosted, ["host", "layout"]).where(F.col("n") > PAGES).join(hosts.select("h", "all"), (F.col("host") == F.col("h")) & (F.col("n") < F.col("all")))
    layouts = scratch.cut(layouts.select(F.col("host").alias("g"), F.col("layout").alias("l"), F.col("reference").alias("own")), "layouts")
    aligned = hosted
    for table, text, on in (hosts.drop("all"), "reference", F.col("host") == F.col("h")), (layouts, "own", (F.col("host") == F.col("g")) & (F.col("layout") == F.col("l"))):
        most = table.agg(F.max(F.octet_length(text))).first()[0] or 0
        aligned = aligned.join(small_enough(table, most + 100), on, "left")
    aligned = aligned.where("reference IS NOT NULL AND (html <> reference OR html <> own)").select("host", "l", "html", "reference", "own")

    def vote(batches: Iterator[pa.RecordBatch]):
        known: dict[str, tuple[Tree, str, set[str]]] = {}

        def reference_of(text: str) -> tuple[Tree, str, set[str]]:
            if text not in known:
                root = parse(text)
                if len(known) == TREES:
                    known.pop(next(iter(known)))
                known[text] = Tree(root, ""), article(root, None, set()), set(marked_texts(root))
            return known[text]

        for batch in batches:
            votes: Counter = Counter()
            for host, layout, page, reference, own in zip(*(batch[c].to_pylist() for c in ("host", "l", "html", "reference", "own"))):
                root = parse(page)
                tree, text, kind, marked = Tree(root, ""), article(root, None, set()), region(root)[0], marked_texts(root)
                levels: dict[str, list[int | None]] = {reference: [None]}
                if own is not None:
                    levels.setdefault(own, []).append(layout)
                for other, keys in levels.items():
                    theirs, their_text, their_marked = reference_of(other)
                    if other != page and text != their_text:
                        cast = list(page_votes(tree, theirs, kind, near_copy(marked, their_marked)))
                        votes.update((host, key, *v) for key in keys for v in cast)
            columns = list(zip(*((*k, n) for k, n in votes.items()))) or [[]] * 6
            types = pa.string(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "layout", "path", "text", "same", "n"])

    votes = aligned.mapInArrow(vote, "host string, layout long, path string, text string, same boolean, n long")
    total = votes.groupBy("host", "layout", "path", "text").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("same"))
    constant = (F.col("path") != "region") & (F.col("n") >= PAGES) & (F.col("same") >= CONSTANT * F.col("n"))
    wrappers = total.groupBy("host", "layout").agg(
        F.max_by("text", F.when(F.col("path") == "region", F.struct("n", "text"))).alias("region"),
        F.collect_list(F.when(constant, F.struct("path", "text"))).alias("template"),
    )
    return scratch.cut(wrappers, "wrappers")


def main_text(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    pages = pages.select("page_id", "url", "html")
    scratch = scratch or Scratch(pages.sparkSession, "extraction")
    wrappers = induce(pages, scratch)
    size = wrappers.agg(F.max(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    hosts = wrappers.where("layout IS NULL").select(F.col("host").alias("h"), "region", "template")
    layouts = wrappers.where("layout IS NOT NULL").select(F.col("host").alias("g"), F.col("layout").alias("l"), F.col("region").alias("own_region"), F.col("template").alias("own_template"))
    joined = pages.withColumns({"host": host_of(F.col("url")), "layout": layout_of(F.col("html"))})
    joined = joined.join(small_enough(hosts, size), F.col("host") == F.col("h"), "left")
    joined = joined.join(small_enough(layouts, size), (F.col("host") == F.col("g")) & (F.col("layout") == F.col("l")), "left")

    def extract(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            texts = []
            for page, goal, template, own in zip(*(batch[c].to_pylist() for c in ("html", "region", "template", "own_template"))):
                texts.append(article(parse(page), goal, {(t["path"], t["text"]) for part in (template, own) for t in part or ()}) if page else "")
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    chosen = joined.select("page_id", "url", "html", F.coalesce("own_region", "region").alias("region"), "template", "own_template")
    return chosen.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def extract_pages(spark, sf_dir: str) -> DataFrame:
    """Query op9_extraction: the main text of every page."""
    return main_text(read(spark, sf_dir, "pages"))
