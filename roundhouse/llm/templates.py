"""Main text of web pages by deducing each host's template from classes of tokens that occur alike.

Tokens of a page are its elements, words and blocks of text, each told apart by its role: the path of block elements it stands in. A
token's occurrence vector holds its count on every page of the host. Vectors aren't kept: each is summed up as ``count * r(page)`` with a
random 64-bit number for each page, so equal vectors have equal sums and a host's pages, however many, are summed on the map side.

1. Classes: frequent tokens of a host (on most of its pages) with equal vectors that lie in one slot. Large ones (several words or elements)
   are the template, and form a tree: a class's slot is an element of the class above it.
2. Blocks made of template tokens only are dropped wherever they stand, in ``article`` and ``main`` too, and so are slots below elements
   that hold menus, forms, notices and the like, unless they hold most of the page's text.
3. The article is the lowest element of the page that holds nearly all text that is left and isn't linked, with the elements around it
   that add more text than links or cards. ``article`` and ``main`` are hints: one that stands alone is followed if it holds most of that text.
4. What the article's slots hold is the text, in page order.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from roundhouse.llm.shared import Scratch, fresh

#: a template class has at least so many tokens, and is on at least this share of a host's pages, of which there are enough to tell
CLASS_TOKENS, FREQUENT, ENOUGH_PAGES = 3, 0.8, 10
#: shares of a page's text that count as most and as nearly all
MOST, NEARLY = 0.8, 0.9

# fixed values: elements of HTML by what they mean here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts".split())
DROPPED = frozenset("head nav footer aside form button select option menu dialog fieldset".split())
#: these are dropped however much text they hold
ALWAYS = frozenset("nav footer button select option menu".split())
#: never dropped by a name in class, id or role
KEPT = frozenset("html body main article".split())
#: outside the article these aren't text; inside it they are
INSIDE = frozenset("header noscript".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: an element that is none of these inside a paragraph ends the paragraph
ARTICLE = frozenset(("article", "main"))
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
# names in class or id that mark what isn't the article: whole names, made of a word that says so and of words that say nothing else
_SAYS = (
    r"(?:ad|ads|advert\w*|adbox|adslot|sponsor|sponsored|promo|promos|promotion|banner|banners|nav|navbar|navigation|menu|menus|submenu|breadcrumb|breadcrumbs|sidebar|sidebars|footer|masthead"
    r"|cookie|cookies|cookiebar|consent|notice|gdpr|popup|modal|newsletter|subscribe|subscription|share|sharing|sharebar|social|comment|comments|reply|replies|disqus|related|recommended"
    r"|recommendations|widget|widgets|login|signup|search|searchbar|searchbox|toolbar|pagination|pager)"
)
_PLAIN = (
    r"(?:site|page|global|main|top|bottom|left|right|primary|secondary|mobile|desktop|sticky|google|the|box|bar|block|area|section|container|wrapper|wrap|inner|outer|holder|slot|unit|list|item|items"
    r"|link|links|button|buttons|icon|icons|form|field|input|panel|overlay|message|posts|articles|stories|thread|respond|\d+)"
)
MARKS = re.compile(rf"(?:{_PLAIN}[-_]+)*{_SAYS}(?:[-_]+(?:{_SAYS}|{_PLAIN}))*|side|(?:site|page|global|top)[-_]+(?:header|head)", re.I)
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s>/]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z))", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def role(name: str, attributes: str) -> tuple[str, bool]:
    """An element's step in a path, and whether it marks what isn't the article."""
    if "=" not in attributes:
        return name, name in DROPPED
    found = NAMES.findall(attributes)
    names = " ".join(a or b or c for kind, a, b, c in found if kind.lower() != "role")
    roles = {w.lower() for kind, a, b, c in found if kind.lower() == "role" for w in (a or b or c).split()}
    dropped = name in DROPPED or (name not in KEPT and (bool(roles & ROLES) or any(map(MARKS.fullmatch, names.split()))))
    step = re.sub(r"\d+", "0", names.strip().lower())
    return (f"{name}.{step}" if step else name), dropped


class Page:
    """A page's elements and blocks of text, in order.

    Inline elements don't cut a block, ``br`` is a space. Open paragraphs and items end where HTML says; what isn't closed is open.
    Of each element: ``names``, ``paths``, ``parents`` (-1: none; always before the element) and ``marks`` (outside the article by itself).
    ``blocks`` are ``(element, text, linked)``.
    """

    def __init__(self, page: str):
        self.names: list[str] = []
        self.paths: list[str] = []
        self.parents: list[int] = []
        self.marks: list[bool] = []
        self.blocks = list(self.read(page))

    def path(self, element: int) -> str:
        return self.paths[element] if element >= 0 else ""

    def read(self, page: str) -> Iterator[tuple[int, str, bool]]:
        stack: list[int] = []
        parts: list[str] = []
        linked = total = 0
        in_link = False
        at = 0

        def block() -> Iterator[tuple[int, str, bool]]:
            nonlocal linked, total
            text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
            if text:
                yield stack[-1] if stack else -1, text, linked * 2 > total
            parts.clear()
            linked = total = 0

        for found in iter(lambda: TAG.search(page, at), None):
            if found.start() > at:
                parts.append(page[at : found.start()])
                total += found.start() - at
                linked += (found.start() - at) * in_link
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name, closing = name.lower(), bool(found[1])
            if name == "a":
                in_link = not closing
            if name == "br":
                parts.append(" ")
            if name in INLINE or name == "br":
                continue
            yield from block()
            if name in RAW and not closing:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
                continue
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if self.names[stack[k]] == name:
                        del stack[k:]
                        break
                continue
            if name == "body" and stack and self.names[stack[-1]] == "head":
                stack.pop()
            if stack and (self.names[stack[-1]] in CLOSES.get(name, ()) or self.names[stack[-1]] == "p"):
                stack.pop()
            if name not in VOID:
                step, marked = role(name, found[3])
                parent = stack[-1] if stack else -1
                stack.append(len(self.names))
                self.names.append(name)
                self.paths.append(f"{self.paths[parent]}>{step}" if stack[0] != stack[-1] else step)
                self.parents.append(parent)
                self.marks.append(marked)
        parts.append(page[at:])
        total += len(page) - at
        linked += (len(page) - at) * in_link
        yield from block()

    def inherited(self, own: Iterable[bool]) -> list[bool]:
        """For each element, whether it or one above it has the property."""
        out: list[bool] = []
        for parent, x in zip(self.parents, own):
            out.append(bool(x) or (parent >= 0 and out[parent]))
        return out

    def mass(self, blocks: Iterable[tuple[int, str, bool]]) -> list[int]:
        """For each element, the characters of these blocks in it that aren't linked."""
        out = [0] * len(self.names)
        for element, text, linked in blocks:
            if element >= 0 and not linked:
                out[element] += len(text)
        for k in range(len(out) - 1, -1, -1):
            if self.parents[k] >= 0:
                out[self.parents[k]] += out[k]
        return out

    def dropped(self) -> list[bool]:
        """For each element, whether it lies outside the article by a mark.

        One that holds most of the page's text isn't outside, unless the page has one article or main element with text, and that elsewhere.
        """
        always = self.inherited(n in ALWAYS for n in self.names)
        rest = [b for b in self.blocks if b[0] < 0 or not always[b[0]]]
        mass, total = self.mass(rest), sum(len(text) for _, text, linked in rest if not linked)
        inner = self.inherited(n in ARTICLE for n in self.names)
        outer = [k for k, n in enumerate(self.names) if n in ARTICLE and mass[k] and (self.parents[k] < 0 or not inner[self.parents[k]])]
        touched = self.inherited(k in outer for k in range(len(self.names)))
        at = outer[0] if len(outer) == 1 else -1
        while at >= 0:
            touched[at], at = True, self.parents[at]
        spared = [x >= MOST * total > 0 and (t or len(outer) != 1) for x, t in zip(mass, touched)]
        return self.inherited(a or (m and not x) for a, m, x in zip(always, self.marks, spared))

    def tokens(self) -> Iterator[tuple[str, str]]:
        """Path and word of each token: ``""`` for an element, the words of a path with one block, and a space and the text for a block.

        Where a path repeats, as in running text, a word doesn't tell its place; there the block as a whole is the token.
        """
        often = Counter(self.path(b[0]) for b in self.blocks)
        yield "", ""
        for path in self.paths:
            yield path, ""
        for element, text, _ in self.blocks:
            path = self.path(element)
            yield path, f" {text}"
            if often[path] == 1:
                for word in text.split():
                    yield path, word

    def without(self, fixed: frozenset[int]) -> list[tuple[int, str, bool]]:
        """Blocks that aren't of the template's tokens only."""
        if not fixed:
            return self.blocks
        often = Counter(self.path(b[0]) for b in self.blocks)

        def of_template(block: tuple[int, str, bool]) -> bool:
            path = self.path(block[0])
            return spark_hash(path, f" {block[1]}") in fixed or (often[path] == 1 and all(spark_hash(path, w) in fixed for w in block[1].split()))

        return [b for b in self.blocks if not of_template(b)]


def hashed(text: str) -> int:
    """64 bits of a string, alike in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(text)


#: ``words`` is 0 for elements, and what a block has for blocks
TOKENS = pa.schema([("host", pa.string()), ("path", pa.string()), ("token", pa.int64()), ("words", pa.int64()), ("vector", pa.int64()), ("pages", pa.int64()), ("count", pa.int64())])
#: sums that a task keeps before it hands them on
HELD = 100_000


def tokens(pages: DataFrame) -> DataFrame:
    """Sums for each host and token of ``row, host, html``, in parts."""

    def handed(sums: dict[tuple[str, str, str], list[int]]) -> pa.RecordBatch:
        keys, values = list(sums), np.array([[v[0] - (1 << 64) if v[0] >> 63 else v[0], *v[1:]] for v in sums.values()], np.int64).reshape(-1, 3)
        ids = [spark_hash(path, word) for _, path, word in keys]
        words = [len(word.split()) for _, _, word in keys]
        arrays = [pa.array([k[i] for k in keys], pa.string()) for i in range(2)] + [pa.array(x, pa.int64()) for x in (ids, words)] + [pa.array(values[:, i]) for i in range(3)]
        return pa.RecordBatch.from_arrays(arrays, schema=TOKENS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[str, str, str], list[int]] = defaultdict(lambda: [0, 0, 0])
            for row, host, page in zip(*(batch.column(k).to_pylist() for k in range(3))):
                weight = hashed(f"page {row}")
                for (path, word), n in Counter(Page(page or "").tokens()).items():
                    own = sums[host, path, word]
                    own[0] = (own[0] + n * weight) & 0xFFFFFFFFFFFFFFFF
                    own[1] += 1
                    own[2] += n
                if len(sums) >= HELD:
                    yield handed(sums)
                    sums.clear()
            yield handed(sums)

    return pages.mapInArrow(run, "host string, path string, token bigint, words bigint, vector bigint, pages bigint, count bigint")


def template(found: list[dict]) -> list[int]:
    """The template's words and blocks among a host's frequent tokens (``path, token, words, vector, count``), sorted.

    A class lies in a slot: the lowest element above its tokens that occurs otherwise than they do. Tokens with equal vectors in different
    slots don't nest, so they are classes of their own, and each must be large enough.
    """
    elements = {t["path"]: (t["vector"], t["count"]) for t in found if t["words"] == 0}
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in found:
        vector, slot = (t["vector"], t["count"]), t["path"]
        while slot and elements.get(slot) == vector:
            slot = slot.rpartition(">")[0]
        classes[vector, slot].append(t)
    valid = [c for c in classes.values() if sum(max(1, t["words"]) for t in c) >= CLASS_TOKENS]
    return sorted({t["token"] for c in valid for t in c if t["words"]})


def templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """``host, fixed``: hashes of the template's words and blocks with their paths, for hosts with enough pages.

    ``pages`` has ``row, host, html``. ``fixed`` is as long as what most pages of the host share.
    """
    # sums of sums: the vector's sum runs modulo 2 ** 64, which decimal keeps apart from overflow
    wide = F.sum(F.col("vector").cast("decimal(38,0)"))
    found = tokens(pages).groupBy("host", "path", "token", "words").agg(wide.alias("vector"), *(F.sum(c).alias(c) for c in ("pages", "count")))
    two64 = F.lit(str(1 << 64)).cast("decimal(38,0)")
    found = found.where(F.col("pages") >= FREQUENT * ENOUGH_PAGES)  # fewer are never frequent
    found = scratch.save(found.withColumn("vector", (((F.col("vector") % two64) + two64) % two64).cast("string")))
    hosts = found.where("path = '' AND words = 0").select("host", F.col("pages").alias("of"))
    often = found.join(hosts, "host").where((F.col("of") >= ENOUGH_PAGES) & (F.col("pages") >= FREQUENT * F.col("of")))
    listed = often.groupBy("host").agg(F.collect_list(F.struct("path", "token", "words", "vector", "count")).alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = [template(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fixed, pa.list_(pa.int64()))], names=["host", "fixed"])

    return listed.mapInArrow(run, "host string, fixed array<bigint>")


def article_root(read: Page, blocks: list[tuple[int, str, bool]]) -> tuple[int, int]:
    """The elements that hold nearly all of the article and all of it (-1: the page), among blocks that neither the template nor a mark has dropped.

    An article or main element that stands alone and holds most of the text is it. Otherwise it is the lowest element with nearly all
    text; then the elements around it, as long as they add more text than links. A heading, a lead or a short section beside a long one adds
    text. Cards, several article elements that hold the lesser part of the text, count as links.
    """
    total = sum(len(b[1]) for b in blocks if not b[2])
    mass = read.mass(blocks)
    named = [k for k, n in enumerate(read.names) if n in ARTICLE and mass[k]]
    inner = read.inherited(n in ARTICLE for n in read.names)
    outer = [k for k in named if read.parents[k] < 0 or not inner[read.parents[k]]]
    held = sum(mass[k] for k in outer)
    if len(outer) == 1 and 2 * held >= total:
        return outer[0], outer[0]
    cards = len(outer) > 1 and 2 * held < total
    other = [b[2] or (cards and b[0] >= 0 and inner[b[0]]) for b in blocks]
    mass = read.mass(b for b, x in zip(blocks, other) if not x)
    total = sum(len(b[1]) for b, x in zip(blocks, other) if not x)
    if not total:
        return -1, -1
    # below an element that has nearly all text, at most one has; the last of them is the lowest
    core = root = max((k for k, n in enumerate(mass) if n >= NEARLY * total), default=-1)
    if core >= 0 and core not in read.parents:  # a paragraph isn't an article
        core = root = read.parents[core]
    furniture = read.mass((e, text, False) for (e, text, _), x in zip(blocks, other) if x)
    while root >= 0:
        parent = read.parents[root]
        links = furniture[parent] if parent >= 0 else sum(len(b[1]) for b, x in zip(blocks, other) if x)
        if links - furniture[root] > (mass[parent] if parent >= 0 else total) - mass[root]:
            break
        root = parent
    return core, root


def of_article(read: Page, blocks: list[tuple[int, str, bool]]) -> list[tuple[int, str, bool]]:
    """Blocks of the article: those in its root, and if its title stands before, what isn't linked from there on.

    Headers and ``noscript`` don't decide on the root. They are kept below ``article`` and ``main``, and below the root, if that isn't the body.
    """
    apart = read.inherited(n in INSIDE for n in read.names)
    named = read.inherited(n in ARTICLE for n in read.names)
    core, root = article_root(read, [b for b in blocks if b[0] < 0 or not apart[b[0]]])
    below = read.inherited(k == root for k in range(len(read.names)))
    near = read.inherited(k == core for k in range(len(read.names)))
    around = set()  # elements between the body and the core, in which a header with a title is the article's
    at = core
    while at >= 0 and read.names[at] not in ("html", "body"):
        around.add(at)
        at = read.parents[at]
    titled = {e for e, _, linked in blocks if not linked and e >= 0 and read.names[e] in ("h1", "h2", "h3")}
    heads = [False] * len(read.names)
    for e in titled:
        while e >= 0 and not heads[e]:
            heads[e] = True
            e = read.parents[e]
    core_is_body = core < 0 or read.names[core] in ("html", "body")
    own = read.inherited(n == "header" and heads[k] and read.parents[k] in around for k, n in enumerate(read.names))

    def kept(e: int) -> bool:
        if e < 0 or not apart[e]:
            return root < 0 or (e >= 0 and below[e])
        return (root < 0 or below[e]) and (named[e] or own[e] or (not core_is_body and near[e]))

    inside = [kept(e) for e, _, _ in blocks]
    first = inside.index(True) if any(inside) else 0
    plain = [not linked and not (e >= 0 and (named[e] or (apart[e] and not own[e]))) for e, _, linked in blocks]
    title = next((k for k in range(first) if plain[k] and blocks[k][0] >= 0 and read.names[blocks[k][0]] == "h1"), first)
    return [b for k, b in enumerate(blocks) if inside[k] or (title <= k < first and plain[k])]


def main_text(page: str, fixed: frozenset[int] = frozenset()) -> str:
    """Text of the slots that are left of a page."""
    read = Page(page)
    dropped = read.dropped()
    blocks = [b for b in read.without(fixed) if b[0] < 0 or not dropped[b[0]]]
    return " ".join(b[1] for b in of_article(read, blocks))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """All columns of every row, and ``main_text`` (made unique if taken): '' for null or empty pages.

    The host is taken from the URL; pages without one share the host ''. Rows that repeat an id count as pages of their own. Pages of
    hosts with few pages are cut by their elements alone. An empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "templates")
    host, fixed, out = fresh(pages.columns, "host_", "fixed_", "main_text")
    of_host: Column = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))
    rows = pages.select(F.xxhash64(id_col, url_col, html_col).alias("row"), of_host.alias("host"), F.col(html_col).alias("html"))
    found = scratch.save(templates(rows, scratch).where("size(fixed) > 0"))
    words = found.select(F.col("host").alias(host), F.col("fixed").alias(fixed))

    @arrow_udf(T.StringType())
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, fixed_words in batches:
            out, last, known = [], None, frozenset()
            for k, page in enumerate(texts.to_pylist()):
                listed = fixed_words[k]
                if listed.is_valid and (last is None or not listed.equals(last)):
                    last, known = listed, frozenset(listed.as_py())
                out.append(main_text(page or "", known if listed.is_valid else frozenset()))
            yield pa.array(out, pa.string())

    joined = pages.withColumn(host, of_host).join(words, host, "left")
    return joined.withColumn(out, run(F.col(html_col), F.col(fixed))).select(*pages.columns, out)


def spark_hash(path: str, word: str) -> int:
    """Spark's ``xxhash64`` of two strings."""
    import xxhash

    value = xxhash.xxh64_intdigest(word.encode(), xxhash.xxh64_intdigest(path.encode(), 42))
    return value - (1 << 64) if value >> 63 else value
