"""HTML extraction (operator 6): markup roles, and substrings that a host's pages repeat.

A page is read into blocks of text, in one pass over it. Blocks in an article are its text; marked parts
(menus, footers, forms, adverts, comments, ...) never are. On a page without an article, main or content element,
markup says nothing about the remaining blocks. There the pages of a host decide, by the suffixes of their
token streams: these are ranked by their first 1, 2, 4, ... tokens as a suffix array is built by prefix doubling,
with hashes for ranks, so that no task has to hold a host. Suffixes of one rank share a prefix of REPEAT_TOKENS
tokens; an aggregate over the whole host counts their distinct pages. The union of what is shared by
enough pages is all maximal repeats of that length or more; tokens that it covers go, and unique runs stay.

Text inside an article is never judged by repetition, since copied articles are text too.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables

#: Tokens of a repeated substring (a power of two), and the distinct pages that repeat it at least.
REPEAT_TOKENS = 8
LEAST_PAGES = 3

#: Element names of HTML by role.
_RAW = set("script style textarea title iframe noscript noembed noframes xmp template".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
_MARKED = set("nav footer aside menu dialog head search fieldset svg object canvas video audio select button datalist".split()) | _RAW
_MARKED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark what isn't an article, and words that may stand beside these.
_NAMES = set(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner nav navbar "
    "navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices "
    "comment comments commentlist disqus respond share sharing social related newsletter subscribe subscription signup login popup modal "
    "overlay masthead topbar toolbar pagination pager copyright disclaimer skip".split()
)
_BESIDE = set(
    "a area article articles bar blog body bottom box btn button buttons col column container content count desktop entry field fixed float "
    "footer for form global group head header heading holder icon icons inline inner item items js label latest layer layout left link links "
    "list main media mid middle mobile module more nav outer page panel popular position post posts primary reader recent region reply "
    "replies right row secondary section sections section site slot social space sticky stories story strip text the thread title to toggle "
    "top unit user view widget wrap wrapper zone".split()
)
#: Words of names of a page's own header; beside others a header may be an article's.
_HEADERS = set("header site page top global bar inner left right wrap wrapper container area desktop mobile sticky fixed".split())
#: What may be the name of a section of an article, too.
_TOPICS = {"social"}
_HIDDEN = re.compile(r"(^|;)\s*(display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_CONTENT = set("content main article post entry story articlebody maincontent postcontent entrycontent articlecontent postbody storybody".split())
#: Which open elements a start tag ends, and beyond which elements it doesn't look for them.
_CLOSES = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "option": ("option", "select optgroup datalist"),
    "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
}
_CLOSES = {name: (ends.split(), beyond.split()) for name, (ends, beyond) in _CLOSES.items()}
_TABLE = set("table caption thead tbody tfoot tr td th".split())
_CELLS = set("td th caption".split())

_BODY, _MAIN, _ARTICLE = 0, 1, 2
#: Marks: text; a form, which an article may stand in; what is never text.
_TEXT, _FORM, _NEVER = 0, 1, 2

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _named(value: str) -> bool:
    """Whether a class list or id has a name that marks: all of a name's words have to fit, one of them has to mark."""
    for token in value.split():
        words = [w.lower() for w in _PARTS.findall(token)]
        if any(w in _NAMES for w in words) and all(w in _NAMES or w in _BESIDE or w.isdigit() for w in words):
            return True
        if token.lower() in _NAMES or "".join(words) in _NAMES:
            return True
    return False


def _heads(value: str) -> bool:
    """Whether a class list or id has the name of a page's header."""
    parts = [{w.lower() for w in _PARTS.findall(token)} for token in value.split()]
    return any("header" in words and words <= _HEADERS for words in parts)


def _role(name: str, attributes: dict[str, str], inside: int = _BODY) -> tuple[int, int]:
    """An element's mark, and what container it is; inside: the container that it stands in.

    A header is the page's outside of an article, main or content element, else it belongs to the text.
    """
    marked, container = name in _MARKED or (name == "header" and inside == _BODY), _ARTICLE if name == "article" else _MAIN if name == "main" else _BODY
    for key, value in attributes.items():
        if key in ("class", "id"):
            if name in ("article", "main"):  # replies are marked up as articles too
                marked = marked or bool({"comment", "comments"} & set(value.lower().split()))
            elif not (name == "section" and inside != _BODY and value.lower() in _TOPICS):
                marked = marked or _named(value) or (inside == _BODY and _heads(value))
            if name in ("div", "section", "td"):
                tokens = value.lower().split()
                words = set(re.split(r"[^a-z0-9]+", value.lower())) | {re.sub(r"[^a-z]", "", t) for t in tokens}
                container = max(container, _MAIN if words & _CONTENT else _BODY)
        elif key == "role":
            marked = marked or value.lower() in _MARKED_ROLES
            container = max(container, {"article": _ARTICLE, "main": _MAIN}.get(value.lower(), _BODY))
        elif key == "hidden" or (key == "style" and _HIDDEN.search(value)):
            marked = True
    if name in ("html", "body"):
        return _TEXT, container
    return _NEVER if marked else _FORM if name == "form" else _TEXT, container


class _Page:
    """Reads a page once from left to right; every step looks at what it passes, so time follows the page's length."""

    def __init__(self, page: str):
        self.page = page
        self.out: list[tuple[int, bool, str]] = []
        self._parts: list[str] = []
        # name, mark, container, and whether it is dropped within its block of text, which then goes on after it
        self._stack: list[tuple[str, int, int, bool]] = [("", _TEXT, _BODY, False)]
        self._places: dict[str, list[int]] = {}  # where elements of a name are on the stack
        self._blocks, self._cells = [0], [0]  # where blocks and table cells are
        self._last_quote = {q: page.rfind(q) for q in "\"'"}
        self._unclosed: set[str] = set()

    def flush(self) -> None:
        if self._parts:
            text = "".join(self._parts)
            self._parts.clear()
            if "&" in text:
                text = entities.unescape(text)
            if text := " ".join(text.split()):
                _, mark, container, _ = self._stack[-1]
                self.out.append((container, mark != _TEXT, text))

    def _push(self, name: str, mark: int, container: int, dropped: bool) -> None:
        at = len(self._stack)
        self._places.setdefault(name, []).append(at)
        if name in _BLOCKS:
            self._blocks.append(at)
        if name in _CELLS:
            self._cells.append(at)
        self._stack.append((name, mark, container, dropped))

    def _cut(self, at: int) -> None:
        """Ends the elements from a place on; a block of text ends with them if one is a block or has a role."""
        if not self._stack[at][3] and (self._blocks[-1] >= at or self._stack[-1][1:3] != self._stack[at - 1][1:3]):
            self.flush()
        while len(self._stack) > at:
            name = self._stack.pop()[0]
            self._places[name].pop()
        for places in (self._blocks, self._cells):
            while places[-1] >= at and len(places) > 1:
                places.pop()

    def _place(self, name: str) -> int:
        places = self._places.get(name)
        return places[-1] if places else 0

    def _attributes(self, at: int) -> tuple[dict[str, str], int, bool]:
        """Attributes from a place on, where their tag ends (-1: never), and whether it ends in />."""
        page, found = self.page, {}
        while True:
            m = _ATTRIBUTE.match(page, at)
            if not m:  # only white space and / before the end
                end = page.find(">", at)
                return found, end, end > at and page[end - 1] == "/"
            at, value = m.end(), ""
            if m[2]:
                quote = page[at : at + 1]
                if quote in self._last_quote and self._last_quote[quote] > at:
                    end = page.index(quote, at + 1)
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = _BARE.match(page, at)
                    value, at = bare[0], bare.end()
            found.setdefault(m[1].lower(), value)

    def _open(self, name: str, attributes: dict[str, str]) -> None:
        _, mark, container, dropped = self._stack[-1]
        if dropped:  # what stands in it goes with it
            self._push(name, mark, container, True)
            return
        if name in _BLOCKS:
            self.flush()
            if self._place("p") > self._cells[-1]:
                self._cut(self._place("p"))
        ends, beyond = _CLOSES.get(name, ((), ()))
        last = max(map(self._place, ends), default=0)
        if last > max(map(self._place, beyond), default=0):
            self._cut(min(p for p in map(self._place, ends) if p > max(map(self._place, beyond), default=0)))
        _, mark, container, _ = self._stack[-1]
        own_mark, own = _role(name, attributes, container)
        if own_mark == _NEVER and name not in _BLOCKS:
            self._push(name, mark, container, True)
            return
        # a form around an article is no part of it
        now = own_mark if mark == _FORM and container == _BODY and own > _BODY else max(mark, own_mark)
        if now != mark or own > container:
            self.flush()
        self._push(name, now, max(container, own), False)

    def _close(self, name: str) -> None:
        dropped = self._stack[-1][3]
        if name == "p" and not dropped:
            self.flush()
        at = self._place(name)
        if dropped and at and self._stack[at][3]:
            self._cut(at)
            return
        # an end tag of what stands around a dropped element ends it as well, if that is a block
        if dropped and name not in _BLOCKS:
            return
        # what isn't a block ends in its own block only, and what is no part of a table in its own cell only
        if at and at >= (self._cells[-1] if name in _BLOCKS else self._blocks[-1]) or at and name in _TABLE:
            self._cut(at)

    def _say(self, text: str) -> None:
        if not self._stack[-1][3]:
            self._parts.append(text)

    def read(self) -> list[tuple[int, bool, str]]:
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            start = page.find("<", at)
            if start < 0:
                self._say(page[at:])
                break
            if start > at:
                self._say(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), start):
                end = page.find(">", start)
                at = size if end < 0 else end + 1
                continue
            closing = page.startswith("</", start)
            m = _NAME.match(page, start + 1 + closing)
            if not m:  # a sign, no tag
                self._say("<")
                at = start + 1
                continue
            name = m[0].lower()
            attributes, end, alone = self._attributes(m.end())
            if end < 0:
                break
            at = end + 1
            if closing:
                self._close(name)
            elif name == "br":
                self._say(" ")
            elif name in _VOID or (alone and name not in _BLOCKS and name not in _RAW):
                if name in _BLOCKS:
                    self._open(name, {})
                    self._cut(len(self._stack) - 1)
            elif name in _RAW and name not in self._unclosed and (found := _CLOSING[name].search(page, at)):
                at = found.end()
            else:  # a raw element that is never closed ends with its parent, like any other
                if name in _RAW:
                    self._unclosed.add(name)
                self._open(name, attributes)
        self.flush()
        return self.out


def blocks(page: str) -> list[tuple[int, bool, str]]:
    """Blocks of a page in order: container, marked, text (character references decoded, white space one space)."""
    return _Page(page).read()


def container_of(found: list[tuple[int, bool, str]]) -> int:
    """The container whose unmarked blocks are a page's text, by amount: the innermost that has half of the text around it.

    Articles that are teasers in a longer text, or one of its parts, don't stand for it. What stands outside
    of articles, main and content elements never rules these out.
    """
    chars = [sum(len(t) for c, marked, t in found if c >= level and not marked) for level in (_BODY, _MAIN, _ARTICLE)]
    if not chars[_MAIN]:
        return _BODY
    return _ARTICLE if 2 * chars[_ARTICLE] >= chars[_MAIN] else _MAIN


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text (null where the host's pages decide) and open blocks of pages (page_id, url, html, host, id)."""
    for batch in batches:
        texts, opens = [], []
        for page in batch.column(2).to_pylist():
            found = blocks(page or "")
            best = container_of(found)
            unsure = not best and not all(marked for _, marked, _ in found)
            texts.append(None if unsure else "\n".join(t for c, marked, t in found if c >= best and not marked) if best else "")
            # what the host's pages are compared on: everything outside the article
            opens.append([("" if marked or best else "?") + "\t" + t for c, marked, t in found if marked or c < best or not best])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(texts, pa.string()), pa.array(opens, pa.list_(pa.string()))], ["page_id", "url", "host", "id", "text", "open"])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    both = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return both ^ (both >> np.uint64(31))


def _windows(host: str, found: list[str]) -> np.ndarray:
    """Hashes of host and each substring of REPEAT_TOKENS tokens of a page's open blocks, in order (prefix doubling)."""
    words = [w for block in found for w in block.split("\t", 1)[1].split(" ")]
    if len(words) < REPEAT_TOKENS:
        return np.zeros(0, np.int64)
    rank = pd.util.hash_array(np.array(words, object), categorize=False)
    size = 1
    while size < REPEAT_TOKENS:
        rank = _mixed(rank[:-size], rank[size:])
        size *= 2
    return _mixed(rank, pd.util.hash_array(np.array([host], object), categorize=False)).view(np.int64)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and each distinct window of pages (id, host, open)."""
    for batch in batches:
        held = [np.unique(_windows(h, o)) for h, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        ids = np.repeat(batch.column(0).to_numpy(), [len(x) for x in held])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *held]))], ["id", "window"])


def repeated(tokens: np.ndarray, page: np.ndarray, length: int, least: int) -> np.ndarray:
    """Which tokens lie in a substring of `length` tokens (a power of two) that `least` or more distinct pages hold.

    The same in one array, which tests compare with. Prefix doubling: ranks of substrings of 1 token, then 2, 4, ... ; equal ranks are equal substrings.
    Substrings don't cross pages.
    """
    covered = np.zeros(len(tokens), bool)
    _, rank = np.unique(tokens, return_inverse=True)
    size = 1
    while size < length:
        if len(rank) <= size:
            return covered
        _, rank = np.unique(rank[:-size] * np.int64(len(tokens) + 1) + rank[size:], return_inverse=True)
        size *= 2
    inside = page[: len(rank)] == page[length - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return covered
    pairs = np.unique(np.stack([rank[at], page[at]], 1), axis=0)
    pages = np.bincount(pairs[:, 0], minlength=int(rank.max()) + 1)
    hits = at[pages[rank[at]] >= least]
    ends = np.zeros(len(tokens) + 1, np.int64)
    np.add.at(ends, hits, 1)
    np.add.at(ends, hits + length, -1)
    return np.cumsum(ends[:-1]) > 0


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages (page_id, url, host, open, windows) with the text of their open blocks without the repeated windows."""
    for batch in batches:
        texts = []
        for host, found, windows in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
            split = [block.split("\t", 1)[1].split(" ") for block in found]
            place = np.cumsum([0, *map(len, split)])
            hits = np.flatnonzero(np.isin(_windows(host, found), np.array(windows or [], np.int64)))
            ends = np.zeros(place[-1] + 1, np.int64)
            np.add.at(ends, hits, 1)
            np.add.at(ends, hits + REPEAT_TOKENS, -1)
            covered = np.cumsum(ends[:-1]) > 0
            runs = []
            for k, words in enumerate(split):
                if found[k][0] == "?":
                    runs.append(" ".join(w for w, c in zip(words, covered[place[k] : place[k + 1]], strict=True) if not c))
            texts.append("\n".join(filter(None, runs)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (blocks joined by a line end) and n_chars (code points) of each row of pages (page_id, url, html).

    Null or empty html gives an empty text. Every row gives a row, repeated rows and null ids included; pages
    without a url are a host of their own; an empty table gives no rows; further columns are ignored, whatever
    their names. What LEAST_PAGES rows of a host repeat is repeated, however many pages the host has. Very long
    pages are read in time that follows their length. Nothing is ranked, so ties need no rule.
    """
    spark = pages.sparkSession
    tables.bounded_batches(spark)
    host = F.lower(F.coalesce(F.regexp_extract(F.col("url").cast("string"), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    keyed = rows.withColumn("id", F.xxhash64("host", "html"))
    read = tables.written(spark, keyed.mapInArrow(_read, "page_id long, url string, host string, id long, text string, open array<string>"))
    sure, unsure = read.where("text is not null"), read.where("text is null")
    # only hosts with such pages are counted, by all of their pages
    hosts = unsure.select("host").distinct()
    held = read.join(hosts, "host", "left_semi").select("id", "host", "open").mapInArrow(_held, "id long, window long")
    repeats = held.groupBy("window").count().where(F.col("count") >= LEAST_PAGES).select("window")
    # pages with the same id are the same page of the same host
    own = unsure.select("id", "host", "open").mapInArrow(_held, "id long, window long").distinct()
    found = own.join(repeats, "window").groupBy("id").agg(F.collect_list("window").alias("windows"))
    judged = unsure.join(found, "id", "left").select("page_id", "url", "host", "open", "windows").mapInArrow(_judge, "page_id long, url string, text string")
    whole = sure.select("page_id", "url", "text").unionByName(judged)
    return whole.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
