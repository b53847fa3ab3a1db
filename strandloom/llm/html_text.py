"""Main text of web pages by consensus paths of each host.

1. Each page's containers (article, div, section ...) are measured by the text of all blocks in them, less the share that stands in
   links. The search begins at the article, else the main element, that holds half of the page's text or more, else at the whole page. It goes
   inward while one child holds nearly all of that text (INNER_SHARE), or while links are the larger part and one child holds half; it stops where the text
   is spread over several children, so none of them is dropped, and at an article. The page votes for the generalised path found: tags with
   their classes, digits replaced by #.
2. Votes are summed per host in Spark (each batch of pages sums its own first). A host's winners are all paths that get
   VOTE_SHARE of its votes or more, best first: 1 / VOTE_SHARE of them at most.
3. Each page is read again with its host's winners: the first that occurs in the page gives the text, or, if none does, the page's own best.

Inside the winner, menus, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left out by tag and role, and by class or id where a
name says so by its last telling word (`post-footer`, `comment-list`; not `search-engines`) and no other name of the element says that it is the text itself.
What stands around the winner, and the winner's own names, leave nothing out: the host's vote decides there. A header counts as part of an article
it stands in and is left out elsewhere.

Defined results: null or empty html gives an empty text; a null url is a host of its own (''); repeated rows each get a row; an empty table gives an
empty result; other columns are ignored. Pages cut off anywhere are read to their end. A line break is white space. Character references are decoded in each piece of text
between tags, so `&<b>amp;</b>` stays as it is. A self-closing svg or math element holds nothing; one that is never closed hides nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import stored, tidied

VOTE_SHARE = 0.02
INNER_SHARE = 0.9
BROADCAST_BYTES = 32 << 20  # of all hosts' winners; more of them are joined by host and a salt
SALTS = 64

# Tags by what they are, and words in class, id or role that mark what isn't main text.
CONTAINERS = frozenset("html body main article section div aside nav header footer form ul ol dl table tbody tr td th menu dialog details figure blockquote fieldset center".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre address figcaption caption hr legend summary thead tfoot title option".split())
WITHIN_TEXT = frozenset("ul ol dl blockquote figure details".split())  # parts of a text, never the whole of it
LEFT_OUT_WITHIN_LINES = frozenset("button select datalist object video audio map".split())
LEFT_OUT = LEFT_OUT_WITHIN_LINES | frozenset("head nav footer aside form menu dialog".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
RAW = frozenset("script style noscript template textarea iframe svg math canvas xmp noframes noembed title".split())
VOID = frozenset("br hr img input meta link area base col embed param source track wbr".split())
LEFT_OUT_WORDS = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer "
    "cookie cookies consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus reply replies respond share sharing social "
    "related recommended newsletter subscribe subscription signup login search widget pagination pager toolbar masthead".split()
)
SAY_NOTHING = frozenset("box block list area section wrapper wrap container inner outer item items slot unit bar top bottom left right fixed links link buttons button icons content text body posts articles header title row col group panel".split())
TEXT_ITSELF = frozenset("article post story entry hentry main content".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
DIGITS = re.compile(r"\d+")
WORDS = re.compile(r"[^a-z]+")


def names_in(attributes: str | None) -> tuple[list[str], list[str], str]:
    """Generalised classes, names of class and id, and role."""
    classes, names, role = [], [], ""
    if attributes and "=" in attributes:
        for key, *value in ATTRIBUTE.findall(attributes):
            value = "".join(value).lower()
            if key.lower() == "role":
                role = value.strip()
            else:
                names += value.split()
            if key.lower() == "class":
                classes = sorted(set(DIGITS.sub("#", value).split()))
    return classes, names, role


def by_name(names: list[str], role: str = "") -> bool:
    """Whether names (or the role) say that an element isn't part of the text."""
    out = role in LEFT_OUT_ROLES
    for name in names:
        parts = [p for p in WORDS.split(name) if p]
        if parts and parts[-1] in TEXT_ITSELF and len(parts) == 1:
            return False
        while len(parts) > 1 and parts[-1] in SAY_NOTHING:
            parts.pop()
        out = out or bool(parts) and parts[-1] in LEFT_OUT_WORDS
    return out


class Page:
    """Blocks of a page in order: (text, characters in links, chain of containers)."""

    def __init__(self, html: str | None):
        self.blocks: list[tuple[str, int, tuple[str, ...], tuple[int, ...]]] = []  # the last: which containers are left out by name
        self._held: list[str] = []
        self._in_links = 0
        self._stack: list[tuple[str, str, bool, bool]] = []  # tag, path, left out by tag or role (or within such), left out by name
        self._skip = False  # a paragraph that is left out by name
        self._links = 0
        self._tags: dict[str, str] = {}  # of each path
        if html:
            self._read(html)

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            if text:
                shown = [s for s in self._stack if not s[2]]
                self.blocks.append((text, min(self._in_links, len(text)), tuple(s[1] for s in shown), tuple(i for i, s in enumerate(shown) if s[3])))
            self._held.clear()
        self._in_links = 0

    def _hidden(self) -> bool:
        return bool(self._stack) and self._stack[-1][2]

    def _text(self, text: str) -> None:
        if text and not self._skip and not self._hidden():
            text = unescape(text) if "&" in text else text
            self._held.append(text)
            if self._links:
                self._in_links += len(text)

    def _read(self, html: str) -> None:
        at, n, lower = 0, len(html), None
        while at < n:
            found = TOKEN.search(html, at)
            if not found:
                self._text(html[at:])
                break
            self._text(html[at : found.start()])
            at = found.end()
            end, tag = found[1], found[2]
            if not tag:
                continue
            tag = tag.lower()
            if tag in ("svg", "math") and found[3].rstrip().endswith("/"):
                continue
            if tag in RAW and not end:
                if lower is None:
                    lower = html.lower()
                    lower = lower if len(lower) == n else "".join(c.lower() if c.isascii() else c for c in html)
                close = lower.find(f"</{tag}", at)
                if close >= 0 or tag not in ("svg", "math"):
                    at = n if close < 0 else close
                continue
            if tag == "a":
                self._links = 0 if end else 1
            elif tag == "br":
                self._text(" ")
            if tag not in LEFT_OUT_WITHIN_LINES:
                if tag not in BLOCKS and tag not in LEFT_OUT:
                    continue
                if not end and tag != "title" and self._stack and self._stack[-1][0] == "head":
                    self._stack.pop()  # a head ends where the body begins
                if not self._hidden():
                    self._flush()
                self._skip = False
                if tag not in CONTAINERS and tag not in LEFT_OUT:
                    self._skip = not end and by_name(*names_in(found[3])[1:])
                    continue
            if end:
                for i in range(len(self._stack) - 1, -1, -1):
                    if self._stack[i][0] == tag:
                        del self._stack[i:]
                        break
            elif tag not in VOID:
                self._open(tag, found[3])
        self._flush()

    def _open(self, tag: str, attributes: str) -> None:
        outer, hidden = (self._stack[-1][1], self._stack[-1][2]) if self._stack else ("", False)
        classes, names, role = names_in(attributes)
        path = f"{outer}/{tag}" + "".join(f".{c}" for c in classes)
        top = tag in ("html", "body")
        hidden = hidden or tag in LEFT_OUT or (role in LEFT_OUT_ROLES and not top) or (tag == "header" and "/article" not in outer)
        self._stack.append((tag, path, hidden, not top and by_name(names)))
        self._tags[path] = tag

    def best(self) -> str:
        """Path of the innermost container that still holds the page's main text; '' is the whole page."""
        own: Counter = Counter()  # characters outside links
        every: Counter = Counter()
        inner: dict[str, dict[str, None]] = {}
        shown = [b for b in self.blocks if not b[3]]
        if 10 * sum(len(b[0]) for b in shown) < sum(len(b[0]) for b in self.blocks):
            shown = self.blocks  # names that leave out nearly all of a page aren't believed
        for text, links, chain, _ in shown:
            outer = ""
            for path in ("", *chain):
                own[path] += len(text) - links
                every[path] += len(text)
                if path:
                    inner.setdefault(outer, {})[path] = None
                outer = path
        most = lambda paths: min(paths, key=lambda p: (-own[p], len(p), p), default="")
        half = [p for p in own if p and 2 * own[p] >= own[""]]
        path = most(p for p in half if self._tags[p] == "article") or most(p for p in half if self._tags[p] == "main")
        while self._tags.get(path) != "article":
            child = most(p for p in inner.get(path, ()) if self._tags[p] not in WITHIN_TEXT)
            if not child or own[child] < (0.5 if 2 * own[path] < every[path] else INNER_SHARE) * own[path]:
                break
            path = child
        return path

    def text(self, winners: list[str]) -> str:
        found = {p for b in self.blocks for p in b[2]}
        path = next((w for w in winners if w in found), None)
        if path is None:
            path = self.best()
        if not path:
            return "\n\n".join(b[0] for b in self.blocks if not b[3]) or "\n\n".join(b[0] for b in self.blocks)
        return "\n\n".join(t for t, _, chain, named in self.blocks if path in chain and not (named and named[-1] > chain.index(path)))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: Counter = Counter()
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            for host, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if path := Page(html).best():
                    votes[host, path] += 1
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 500):
            part = batch.slice(i, 500)
            texts = [Page(h).text(w or []) for h, w in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])


def with_host(pages: DataFrame) -> DataFrame:
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))


def winning_paths(pages: DataFrame) -> DataFrame:
    """host, winners (paths, best first)."""
    votes = with_host(pages).select("host", "html").mapInArrow(tidied(_votes), "host string, path string, votes long").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    totals = votes.groupBy("host").agg(F.sum("votes").alias("total"))
    won = votes.join(totals, "host").where(F.col("votes") >= VOTE_SHARE * F.col("total"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("votes")).alias("less"), "path")))
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("winners"))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`."""
    winners, rows = stored(winning_paths(pages), "winners"), with_host(pages)
    size = winners.agg(F.sum(F.length("host") + F.aggregate("winners", F.lit(0), lambda n, w: n + F.length(w)) + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        rows = rows.join(F.broadcast(winners), "host", "left")
    else:  # a host may hold a third of all pages
        dealt = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", F.length("html")), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"], "left")
    return rows.select("page_id", "url", "html", "winners").mapInArrow(tidied(_texts), "page_id long, url string, text string, n_chars long")
