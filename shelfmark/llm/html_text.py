"""Main text of web pages, with site templates removed by counting subtrees.

A page is read once into elements and blocks of text. Every element's subtree is hashed twice from its children's hashes: with
its text, and by its shape (names and classes, text masked, equal neighbours as one), since menus and adverts keep their shape
and change their words. Spark counts on how many different pages of a host each hash stands, and how much of those pages'
text it holds. Places (paths of names and classes) that hold half of the host's text or more are its content and stay.
Beside them, what recurs on many pages goes: by text at once, by shape if it is short or mostly links. Inside them only
what recurs much more often goes. Beside the count the page's own marks tell what is no text: elements that HTML defines for
menus, forms and the like, and classes made of words for such parts. Words that an article may well use of its own parts
(`related`, `menu`, `notice`) say nothing by themselves inside an article: there the host's count decides, and on hosts of a few pages such a part goes only
if it is mostly links. A headline that stands before an article without one belongs to it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable, mix, small_batches

#: Pages that a template stands on: at least so many, and at least the square root of the host's pages (by text) or this share of them (by shape).
LEAST_PAGES, SHARE_SHAPE = 3, 0.1
#: The share inside the content: of a paragraph or a list of links; and of a paragraph inside an element that says it is the article (on LEAST_STATED pages at least).
SHARE_INSIDE, SHARE_STATED, LEAST_STATED = 0.5, 0.9, 10
#: A recurring shape is short if it holds at most this share of its pages' text.
SHORT = 0.2
#: Pages from which on a host's count decides about doubtful marks inside articles.
LEAST_DECIDED = 10
#: Hashes of all hosts' templates that are sent to all tasks (8 bytes each); beyond, pages are dealt out by host and meet its templates there.
MOST_BROADCAST = 1_000_000
#: Pages of a host that one task reads, where pages are dealt out by host.
PAGES_A_TASK = 20_000

# HTML element names, and words that name parts of a page.
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("button option optgroup select caption head html body".split())
CLOSED_BY_SAME = {"li": frozenset(("ul", "ol", "menu", "dir")), "dd": frozenset(("dl",)), "dt": frozenset(("dl",)), "tr": frozenset(("table", "tbody", "thead", "tfoot")), "td": frozenset(("tr", "table")), "th": frozenset(("tr", "table")), "option": frozenset(("select",))}
LEFT_OUT = frozenset("head nav footer aside form button select dialog menu svg canvas object audio video map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tooltip".split())
CONTAINERS = frozenset("aside center details div dl fieldset footer form header menu nav ol section table ul".split())
HEADINGS = frozenset("h1 h2 hgroup".split())
PARTS = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations pagination pager toolbar skip login signup searchform searchbox".split())
DOUBTFUL = frozenset("alert banner menu notice notices promotion related widget".split())
AROUND_PARTS = frozenset("area bar block bottom box buttons column container content dialog form global group header inline inner item items js left link links list main media message nav outer page panel policy post posts primary right row secondary section site slot text thread title top unit wrap wrapper".split())
SUBJECT = frozenset("abstract article body content entry headline heading intro lead main post story summary text title".split())
ARTICLE = frozenset(("article", "main"))
# End of the fixed values.

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_END = re.compile(r"[^<>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^<>\"']*+)*+>")
_ATTRIBUTE = re.compile(r"""(?i)(?<![a-z0-9-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in RAW}

#: Kinds of hashes that are counted.
SLOT, TEXT, SHAPE = range(3)
_ROOT = 0
#: What is known of a host (see `site_templates`).
SETS = ["content", "outside", "inside", "stated", "containers"]


def _hash(*parts: bytes) -> int:
    return int.from_bytes(blake2b(b"\x00".join(parts), digest_size=8).digest(), "little", signed=True)


#: Places and shapes are few, so their hashes are kept.
_kept_hash = lru_cache(1 << 16)(_hash)


def _encoded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _attributes(name: str, source: str) -> tuple[tuple[str, ...], bool, bool]:
    """Stable classes (without digits), and whether the attributes say that the element is no part of the article, or say so by a word that may be the article's own."""
    classes: tuple[str, ...] = ()
    out = doubtful = False
    for key, value in _ATTRIBUTE.findall(source):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            out = True
        elif name in ARTICLE or name in ("html", "body"):
            continue
        elif key == "role":
            out |= value in ROLES
        elif key in ("class", "id") and name in CONTAINERS:
            for words in map(_WORD.findall, value.split()):
                # a class or id counts if it has a word for such a part and no word that may be an article's
                if not PARTS.isdisjoint(words) and all(w in PARTS or w in AROUND_PARTS or w.isdigit() for w in words):
                    if len(words) == 1 and words[0] in DOUBTFUL:
                        doubtful = True
                    else:
                        out = True
        if key == "class":
            classes = tuple(sorted({c for c in value.split() if not any(x.isdigit() for x in c)}))
    return classes, out, doubtful


class Page:
    """Elements and blocks of a page, in order. Element 0 stands for the page.

    Of each element: name, parent, classes, marked (by the page's own marks), doubtful (marked inside an article by a word that may be its own), chars and links (code points of text, and of that in links),
    plain (chars that no mark covers), slot (hash of its path), shape and text hash. blocks: (text, element).
    """

    def __init__(self, source: str, marks: bool = True) -> None:
        self.names, self.parent, self.classes, self.marked, self.doubtful, self.in_article = ["#page"], [-1], [()], [False], [False], [False]
        self.blocks: list[tuple[str, int]] = []
        self._seq: list[list[int]] = [[]]  # of each element: -1 - block, or child element
        self._link_chars: list[int] = []
        self._stack: list[tuple[str, int, bool, bool]] = []  # name, element, text left out, inside a link
        self._open_at: dict[str, list[int]] = {}  # places in the stack by name
        self._blocks_at: list[int] = []  # and those of all blocks
        self._text: list[str] = []
        self._linked = 0
        self._marks = marks
        self._read(source)
        self._measure()

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                element = self._stack[-1][1] if self._stack else 0
                self._seq[element].append(-1 - len(self.blocks))
                self.blocks.append((text, element))
                self._link_chars.append(min(len(text), self._linked))
            self._text, self._linked = [], 0

    def _close(self, depth: int) -> None:
        """Closes all elements from depth on."""
        if self._blocks_at and self._blocks_at[-1] >= depth:
            self._flush()
        while len(self._stack) > depth:
            name = self._stack.pop()[0]
            self._open_at[name].pop()
            if name in BLOCK:
                self._blocks_at.pop()

    def _last(self, names) -> int:
        """Place in the stack of the innermost open element of these names; -1 without one."""
        return max((at[-1] for n in names if (at := self._open_at.get(n))), default=-1)

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self._flush()
            if name in CLOSES_P:
                at = self._last(("p",))
                if at >= 0 and at == self._blocks_at[-1]:  # no other block is open inside it
                    self._close(at)
            if name in CLOSED_BY_SAME:
                at = self._last({"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,)))
                if at > self._last(CLOSED_BY_SAME[name]):
                    self._close(at)
        if name in VOID:
            if name == "br":
                self._text.append(" ")
            return
        element, out, link = self._stack[-1][1:] if self._stack else (0, False, False)
        classes, marked, doubtful = _attributes(name, attributes) if attributes else ((), False, False)
        if name in BLOCK and name not in ("html", "body"):
            inside = self.in_article[element]
            marked |= name in LEFT_OUT or name == "header" and not inside or doubtful and not inside
            self.parent.append(element)
            self._seq[element].append(len(self.names))
            element = len(self.names)
            self.names.append(name), self.classes.append(classes), self._seq.append([])
            self.marked.append(marked and self._marks)
            self.doubtful.append(doubtful and not marked and self._marks)
            self.in_article.append(inside or name in ARTICLE or "main" in attributes and bool(re.search(r"role\s*=\s*[\"']?main\b", attributes)))
        else:
            out |= name in LEFT_OUT or marked and name not in ("html", "body")
        self._open_at.setdefault(name, []).append(len(self._stack))
        if name in BLOCK:
            self._blocks_at.append(len(self._stack))
        self._stack.append((name, element, out, link or name == "a"))

    def _add(self, text: str) -> None:
        out, link = self._stack[-1][2:] if self._stack else (False, False)
        if not out:
            text = entities.unescape(text)  # a reference does not go on behind a tag
            self._text.append(text)
            self._linked += len(text.strip()) if link else 0

    def _read(self, source: str) -> None:
        """One pass: each search begins where the last one ended, and an end that was sought in vain is not sought again."""
        at = start = 0
        absent: set[str] = set()

        def after(mark: str, begin: int) -> int:
            if mark in absent:
                return -1
            found = source.find(mark, begin)
            if found < 0:
                absent.add(mark)
                return -1
            return found + len(mark)

        while (at := source.find("<", at)) >= 0:
            end, tag = -1, None
            if source.startswith("<!--", at):
                end = after("-->", at + 4)
            elif source.startswith("<![CDATA[", at):
                end = after("]]>", at + 9)
            if end < 0 and source.startswith(("<!", "<?"), at):
                end = after(">", at + 2)
            elif end < 0 and (tag := _NAME.match(source, at + 1)):
                match = _TAG_END.match(source, tag.end())
                end = match.end() if match else -1
            if end < 0:  # a sign of the text
                at += 1
                continue
            if at > start:
                self._add(source[start:at])
            if tag:
                name = tag[2].lower()
                if tag[1]:
                    depth = self._last((name,))
                    if depth >= 0:
                        self._close(depth)
                elif name in RAW:
                    found = _RAW_END[name].search(source, end)
                    end = found.end() if found else len(source)
                else:
                    self._open(name, source[tag.end() : end - 1])
            start = at = end
        if start < len(source):
            self._add(source[start:])
        self._close(0)
        self._flush()

    def _measure(self) -> None:
        n = len(self.names)
        self.chars, self.links, self.plain = [0] * n, [0] * n, [0] * n
        self.covered = list(self.marked)  # by a mark of its own or of an element around it
        self.slot = [_ROOT] * n
        heads = [b"\x01".join(map(_encoded, (name, *classes))) for name, classes in zip(self.names, self.classes, strict=True)]
        for i in range(1, n):
            self.covered[i] |= self.covered[self.parent[i]]
            self.slot[i] = _kept_hash(b"slot", b"%x" % self.slot[self.parent[i]], heads[i])
        for (text, element), linked in zip(self.blocks, self._link_chars, strict=True):
            self.chars[element] += len(text)
            self.links[element] += linked
            self.plain[element] += 0 if self.covered[element] else len(text)
        self.shape, self.text_hash, self.leaf = [0] * n, [0] * n, [True] * n
        self.titled = [name in HEADINGS or not SUBJECT.isdisjoint(w for c in classes for w in _WORD.findall(c)) for name, classes in zip(self.names, self.classes, strict=True)]
        for i in range(n - 1, -1, -1):
            shape, text = [], []
            for x in self._seq[i]:
                if x < 0:
                    part, whole = b"#", _encoded(self.blocks[-1 - x][0])
                else:
                    if not self.chars[x]:
                        continue
                    self.leaf[i] = False
                    part, whole = (b"%x" % v[x] for v in (self.shape, self.text_hash))
                text.append(whole)
                if not shape or shape[-1] != part:
                    shape.append(part)
            self.shape[i], self.text_hash[i] = _kept_hash(b"shape", heads[i], *shape), _hash(b"text", heads[i], *text)
            if i:
                up = self.parent[i]
                self.chars[up] += self.chars[i]
                self.links[up] += self.links[i]
                self.plain[up] += self.plain[i]
                self.titled[up] |= self.titled[i] and up > 0
        # the innermost element, no paragraph, with more than half of the page's text; of children at most one has that
        self.core, total = 0, self.plain[0]
        for i in range(1, n):
            if self.parent[i] == self.core and 2 * self.plain[i] > total and (self.names[i] in CONTAINERS or self.names[i] in ARTICLE):
                self.core = i

    def signature(self) -> int:
        """Equal for pages with the same main part; its copies count as one page."""
        return self.text_hash[self.core]

    def counted(self) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(kind, hash) of what stands on the page: its text, the page's, and text in links."""
        out: dict[tuple[int, int], tuple[int, int, int]] = {(SLOT, _ROOT): (self.plain[0], self.plain[0], 0)}
        for i in range(1, len(self.names)):
            if self.chars[i]:
                found = [(TEXT, self.text_hash[i], self.chars[i], self.chars[0]), (SHAPE, self.shape[i], self.chars[i], self.chars[0])]
                if self.names[i] in CONTAINERS or self.names[i] in ARTICLE:  # a paragraph is no place for content of its own
                    found.append((SLOT, self.slot[i], self.plain[i], self.plain[0]))
                for kind, value, chars, page in found:
                    before = out.get((kind, value), (0, 0, 0))
                    out[kind, value] = (before[0] + chars, page, before[2] + self.links[i])
        return out

    def hashes(self) -> list[np.ndarray]:
        """The page's hashes that can be in each of SETS."""
        slot, text, shape = (np.array(x, dtype=np.int64) for x in (self.slot, self.text_hash, self.shape))
        both = np.concatenate((text, shape))
        return [slot, both, both, text, text]

    def kept(self, content: frozenset[int], outside: frozenset[int], inside: frozenset[int], stated: frozenset[int], containers: frozenset[int], decided: bool = False) -> list[str]:
        """The blocks that stay, given the host's content places and templates (see `site_templates`), and whether it has LEAST_DECIDED pages."""
        n = len(self.names)
        stays = [i > 0 and self.slot[i] in content for i in range(n)]
        if not any(stays):  # the host says nothing about this page: what holds most of it stays
            at = self.core
            while at > 0:
                stays[at], at = True, self.parent[at]
        goes_on = [False] * n  # does the content go on in a smaller element?
        for i in range(n - 1, 0, -1):
            if stays[i] or goes_on[i]:
                goes_on[self.parent[i]] = True
        says_so = self._marks and any(stays[i] and self.names[i] in ARTICLE for i in range(n))
        main = {0}  # the elements around the page's main part
        at = self.core
        while at > 0:
            main.add(at)
            at = self.parent[at]
        gone, in_content, in_stated = [False] * n, [not goes_on[0]] * n, [False] * n
        for i in range(1, n):
            up = self.parent[i]
            in_content[i] = not goes_on[i] if stays[i] else in_content[up] and not goes_on[i]
            in_stated[i] = in_stated[up] or stays[i] and self.names[i] in ARTICLE
            if gone[up] or self.marked[i]:
                gone[i] = True
            elif i not in main:
                text, shape, part = self.text_hash[i], self.shape[i], self.names[i] in CONTAINERS
                if self.doubtful[i] and (text in outside or shape in outside if decided else 2 * self.links[i] >= self.chars[i]):
                    gone[i] = True
                elif part and not self.leaf[i] and text in (inside if in_stated[up] else containers):
                    gone[i] = True
                elif stays[i] or goes_on[i]:
                    pass
                elif not in_content[up] and not in_stated[up]:
                    gone[i] = text in outside or part and not self.titled[i] and shape in outside
                else:
                    gone[i] = text in (stated if in_stated[i] else inside) or part and shape in inside
        headline = self._headline(gone, in_stated) if says_so else -1
        return [text for at, (text, i) in enumerate(self.blocks) if not gone[i] and (in_stated[i] or not says_so or at == headline)]

    def _headline(self, gone: list[bool], in_stated: list[bool]) -> int:
        """The last block of an h1 before an article that has none itself; -1 without one."""
        found, before = -1, True
        for at, (_, i) in enumerate(self.blocks):
            if gone[i]:
                continue
            if in_stated[i] and self.names[i] == "h1":
                return -1
            before = before and not in_stated[i]
            if before and self.names[i] == "h1":
                found = at
        return found


def host(url):
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)), F.lit(""))


_SEEN = "site bigint, kind int, hash bigint, mark bigint, chars bigint, page_chars bigint, links bigint"


def _seen(marks: bool):
    """A row for each different hash of a page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, ...]] = []
            for site, source in zip(batch.column("site").to_pylist(), as_bytes(batch.column("html")), strict=True):
                page = Page((source or b"").decode(errors="replace"), marks)
                mark = page.signature()
                rows += [(site, kind, value, mark, *sizes) for (kind, value), sizes in page.counted().items()]
            kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 5
            columns = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SEEN.split(", ")])

    return run


def _named(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64(host(F.col("url").cast("string"))).alias("site"))


def _templates(pages: DataFrame, marks: bool) -> DataFrame:
    """As `site_templates`, with the number of the host's different pages; hosts of LEAST_DECIDED pages are there without templates too."""
    small_batches(pages.sparkSession)
    seen = _named(pages).select("site", "html").mapInArrow(_seen(marks), _SEEN)
    each = seen.groupBy("site", "kind", "hash", "mark").agg(*[F.max(c).alias(c) for c in ("chars", "page_chars", "links")])
    root = (F.col("kind") == SLOT) & (F.col("hash") == _ROOT)
    counts = each.groupBy("site", "kind", "hash").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("chars", "page_chars", "links")])
    counts = durable(counts.where(root | (F.col("n") >= LEAST_PAGES)))
    sites = counts.where(root).select("site", F.col("n").alias("pages"))
    judged = counts.join(sites, "site")
    n, pages_, kind = F.col("n"), F.col("pages"), F.col("kind")
    often, by_shape, mostly = n >= F.sqrt(pages_), n >= SHARE_SHAPE * pages_, n >= SHARE_INSIDE * pages_
    linked, short = 2 * F.col("links") >= F.col("chars"), F.col("chars") <= SHORT * F.col("page_chars")
    sets = {
        "content": ~root & (kind == SLOT) & often & (2 * F.col("chars") >= F.col("page_chars")) & (F.col("page_chars") > 0),
        "outside": (kind == TEXT) & often | (kind == SHAPE) & by_shape & (linked | short),
        "inside": (kind == TEXT) & mostly & (n > LEAST_PAGES) | (kind == SHAPE) & mostly & linked,
        "stated": (kind == TEXT) & (n >= SHARE_STATED * pages_) & (n >= LEAST_STATED),
        "containers": (kind == TEXT) & often & (n > LEAST_PAGES),
    }
    some = sets["content"] | sets["outside"] | sets["inside"] | sets["stated"] | sets["containers"] | root & (n >= LEAST_DECIDED)
    return judged.where(some).groupBy("site", "pages").agg(*[F.collect_list(F.when(c, F.col("hash"))).alias(name) for name, c in sets.items()])


def site_templates(pages: DataFrame, marks: bool = True) -> DataFrame:
    """(site, content, outside, inside, stated, containers): hashes by host (site is the hash of its name).

    content: places with half of the host's text. outside: texts on as many pages as the square root of the host's, and shapes that are short or
    mostly links on SHARE_SHAPE of them. inside: texts and shapes made of links on SHARE_INSIDE of them. stated: texts on SHARE_STATED of them.
    containers: as outside, by text; where they are more than a paragraph they go inside the content too, but inside an element that says it is the article only those that are in `inside` as well.
    Pages with the same main part count once. marks: whether the pages' own marks tell what is no text.
    The hashes of a host are at most about as many as the square root of its pages times the elements of a page.
    """
    some = [F.size(c) > 0 for c in SETS]
    return _templates(pages, marks).where(some[0] | some[1] | some[2] | some[3] | some[4]).select("site", *SETS)


def _keys(site: np.ndarray, hashes: np.ndarray, number: int) -> np.ndarray:
    """One number for a host, a hash and the number of the set it is in."""
    return mix(hashes.astype(np.int64).view(np.uint64) ^ mix(np.atleast_1d(np.asarray(site, dtype=np.int64)).view(np.uint64) + np.uint64(number)))


def _table(rows: pa.Table) -> np.ndarray:
    """All templates as one sorted array of `_keys`; hosts of LEAST_DECIDED pages have one of the number after the sets'."""
    sites, parts = rows.column("site").to_numpy(), []
    for number, name in enumerate(SETS):
        lists = rows.column(name).combine_chunks()
        parts.append(_keys(np.repeat(sites, lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False), number))
    large = sites[rows.column("pages").to_numpy() >= LEAST_DECIDED]
    return np.sort(np.concatenate((*parts, _keys(large, np.zeros(len(large), dtype=np.int64), len(SETS)))))


def _among(keys: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted table?"""
    if not len(table):
        return np.zeros(len(keys), dtype=bool)
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _text(page: Page, site: int, table: np.ndarray) -> str:
    """The page's text, given all templates of its host: only the page's own hashes are looked up."""
    hashes = page.hashes()
    found = [frozenset(h[_among(_keys(site, h, number), table)].tolist()) for number, h in enumerate(hashes)]
    return "\n".join(page.kept(*found, bool(_among(_keys(site, np.zeros(1, dtype=np.int64), len(SETS)), table)[0])))


def _extracted(marks: bool, shared):
    """Texts of pages, by templates that all tasks have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, dtype=np.uint64)
        for batch in batches:
            texts = [_text(Page((source or b"").decode(errors="replace"), marks), site, table) for site, source in zip(batch.column("site").to_pylist(), as_bytes(batch.column("html")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def _extracted_by_host(marks: bool):
    """Texts of pages that follow the row of their host's templates; a task holds the templates of one host at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, of = np.zeros(0, dtype=np.uint64), None
        for batch in batches:
            texts, rows = [], []
            is_page = batch.column("is_page").to_pylist()
            for i, (site, source) in enumerate(zip(batch.column("site").to_pylist(), as_bytes(batch.column("html")), strict=True)):
                if not is_page[i]:
                    table, of = _table(pa.Table.from_batches([batch.slice(i, 1)])), site
                    continue
                texts.append(_text(Page((source or b"").decode(errors="replace"), marks), site, table if of == site else table[:0]))
                rows.append(i)
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(at), batch.column("url").take(at), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def _dealt(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Pages in partitions by host, behind a row of the host's templates each. A host of many pages is dealt over several, each with the templates."""
    sites = pages.groupBy("site").agg(F.ceil(F.count("*") / PAGES_A_TASK).cast("int").alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("html", "page_id", "url"), F.col("parts")).cast("int"), F.lit(0)).alias("part")
    # equal rows of one page are one text, so that they may lie in one part
    own = pages.join(sites, "site", "left").select("site", part, F.lit(True).alias("is_page"), "page_id", "url", "html")
    first = templates.join(sites, "site", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).withColumn("is_page", F.lit(False)).drop("parts")
    return own.unionByName(first, allowMissingColumns=True).repartition("site", "part").sortWithinPartitions("site", "part", "is_page")


def main_text(pages: DataFrame, marks: bool = True, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """page_id, url, text and n_chars of each page.

    A null or empty html gives an empty text; bytes that are no UTF-8 become replacement characters. Pages without a URL make up one host. Null and
    repeated page_ids are ordinary rows; other columns are left out; an empty table gives an empty one. A page is read as a whole by one task, in time
    proportional to its length. marks: whether elements and classes that HTML or their words say are no article go where the count does not decide.
    most_broadcast: templates that are sent to all tasks; more of them meet their pages by host, with the same texts.
    """
    small_batches(pages.sparkSession)
    templates = durable(_templates(pages, marks))
    size = templates.agg(F.coalesce(F.sum(sum((F.size(c) for c in SETS), F.lit(2))), F.lit(0))).first()[0]
    named = _named(pages)
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"
    if size <= most_broadcast:
        shared = pages.sparkSession.sparkContext.broadcast(_table(templates.toArrow()).tobytes())
        out = named.mapInArrow(_extracted(marks, shared), schema)
    else:
        out = _dealt(named, templates).mapInArrow(_extracted_by_host(marks), schema)
    return out.withColumn("n_chars", F.length("text").cast("long"))
