"""Main text of web pages: site templates are found by counting element subtrees for each host.

Every page is parsed twice. The first time its elements get names, each a hash, made bottom-up as elements close:

* *content*: a block's subtree, with all its text. One that stands on a large share of a host's pages whose texts differ is
  a template.
* *shape*: a block's subtree without its text, with repeated siblings as one, if nearly all its text is links. One that
  stands on most pages of a host is a menu, though each page's own differs.
* *label*: what markup says an element is: a tag, a role, or a class or id that names menus, headers, footers, sidebars, notices,
  adverts, forms or comments. It is a template where most of the host's pages that have it mark their article beside it, or where
  it holds the smaller part of their text; a form around a whole page, or a class that only sounds like one, is none.
* *beside*: the tag and classes of a block beside a marked article, where markup says no more. It is a template where it
  holds the smaller part of the text of the host's pages that have it.

Spark counts pages, text and link text by host and name, and what it finds to be templates decides: the second time, pages
come with the names that go, and all that such elements hold goes. Scripts, styles and other elements whose content is no text
are never text, nor is what stands in no block of its own around a marked article.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm._io import cut, small_batches

#: Element names by what they do here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NO_TEXT = RAW | frozenset("noscript template svg select head object canvas audio video datalist".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article main div section body html td th table ul ol dl li nav header footer aside form blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What labels an element: its tag, its role, a class or id, or the last part of one without a part that turns its meaning.
LABEL_TAGS = frozenset("nav header footer aside form button dialog menu".split())
LABEL_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar toolbar alert".split())
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
LABEL_WORDS = COMMENTS | frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead"
    " share sharing social newsletter subscribe signup popup modal overlay related recommended widget notice notices alert pagination pager login toolbar".split()
)
TURNS = frozenset("has no not non with without is are free".split())
#: Kinds of names.
CONTENT, CONTENT_IN_ARTICLE, SHAPE, LABEL, COMMENT, BESIDE = range(6)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
_PARTS = re.compile(r"[a-z0-9]+")


class _Element:
    """An open element. serial: its number, or that of the one around it, if nothing is counted of it."""

    __slots__ = ("name", "serial", "silent", "article", "header", "digest", "shape", "last", "chars", "links")

    def __init__(self, name: str, serial: int, silent: bool, article: bool, header: int):
        self.name, self.serial, self.silent, self.article, self.header = name, serial, silent, article, header
        self.digest, self.shape = xxhash.xxh64(), xxhash.xxh64()
        self.last, self.chars, self.links = b"", 0, 0


def _label(name: str, attrs: str, in_article: bool) -> str | None:
    """What an element's markup says it is, None if it doesn't say, '' if it is hidden."""
    found = {name} if name in LABEL_TAGS else set()
    if name not in ("html", "body", "main") and attrs:
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key == "hidden" or key == "aria-hidden" and value == "true":
                return ""
            if key == "role" and value in LABEL_ROLES:
                found.add(value)
            if key in ("class", "id"):
                for token in value.split():
                    parts = _PARTS.findall(token)
                    word = token if token in LABEL_WORDS else parts[-1] if parts and not TURNS & set(parts) else ""
                    if word in LABEL_WORDS and not (in_article and word in ("header", "banner")):
                        found.add(word)
    return " ".join(sorted(found)) or None


def _signed(digest: xxhash.xxh64) -> int:
    return digest.intdigest() - (1 << 63)


class Page:
    """A page's texts with the numbers of the elements they stand in, and the elements' names.

    texts: (text, number of the innermost counted element); a line feed tells blocks apart. around[n]: the number of the
    element around n (0: the page). names[n]: [(kind, hash)]; chars[n], links[n]: letters that are not white space, and those in
    links; inside[n]: whether it is the marked article or in it; holds[n]: whether it has that within.
    """

    def __init__(self, source: str):
        self.texts: list[tuple[str, int]] = []
        self.around, self.chars, self.links = [0], [0], [0]
        self.names: list[list[tuple[int, int]]] = [[]]
        self.inside, self.holds = [False], [False]
        self._looks, self._forms = [""], set()
        self._stack: list[_Element] = [_Element("", 0, False, False, 0)]
        self._open_links = 0
        self._read(source)
        self._close(1)
        self.chars[0], self.links[0] = self._stack[0].chars, self._stack[0].links
        for n in range(len(self.names) - 1, 0, -1):
            if self.inside[n] or self.holds[n]:
                self.holds[self.around[n]] |= not self.inside[self.around[n]]
        for n in range(1, len(self.names)):
            if self.beside(n) and self.holds[self.around[n]]:
                self.names[n].append((BESIDE, _signed(xxhash.xxh64("beside " + self._looks[n]))))

    def beside(self, n: int) -> bool:
        """Whether the page marks its article, and outside of this element, which is not part of it."""
        return self.holds[0] and not self.inside[n] and not self.holds[n]

    def _break(self) -> None:
        self.texts.append(("\n", self._stack[-1].serial))

    def _text(self, text: str) -> None:
        top = self._stack[-1]
        if top.silent:
            return
        n = len("".join(text.split()))
        self.texts.append((text, top.serial))
        top.digest.update(text.encode("utf-8", "surrogatepass"))
        top.chars += n
        top.links += n if self._open_links else 0

    def _close(self, to: int) -> None:
        while len(self._stack) > to:
            e, up = self._stack.pop(), self._stack[-1]
            if e.name == "a":
                self._open_links -= 1
            block = e.name not in INLINE
            if block:
                self.texts.append(("\n", up.serial))
            content, shape = e.digest.digest(), e.shape.digest()
            up.digest.update(content)
            if block and shape != up.last:  # repeated siblings count as one
                up.shape.update(shape)
                up.last = shape
            up.chars += e.chars
            up.links += e.links
            if e.serial == up.serial:
                continue
            self.chars[e.serial], self.links[e.serial] = e.chars, e.links
            if block and e.chars and e.name not in ("html", "body"):
                self.names[e.serial].append((CONTENT_IN_ARTICLE if up.article else CONTENT, _signed(e.digest)))
                if e.links >= 0.8 * e.chars:
                    self.names[e.serial].append((SHAPE, _signed(e.shape)))

    def _open(self, name: str, tag: str, attrs: str) -> None:
        top = self._stack[-1]
        label = _label(name, attrs, top.article)
        silent = top.silent or name in NO_TEXT or label == ""
        article = top.article or name in ("article", "main") and not silent and not label and not any(kind >= LABEL and self.labels_block(n) for n in self._numbers() for kind, _ in self.names[n])
        looks = f"{name} {' '.join(sorted((m[2] or m[3] or m[4] or '') for m in _ATTR.finditer(attrs) if m[1].lower() == 'class'))}" if attrs else name
        header = top.header
        serial = top.serial
        if name not in INLINE or label:
            serial = len(self.names)
            up = top.serial
            if header and name in HEADINGS:
                up = self.around[header]  # of an article's own header the headings are text
            self.around.append(up)
            self.names.append([])
            self.chars.append(0)
            self.links.append(0)
            self.inside.append(article)
            self.holds.append(False)
            self._looks.append(looks)
            if label:
                kind = COMMENT if COMMENTS & set(label.split()) else LABEL
                self.names[serial].append((kind, _signed(xxhash.xxh64(f"{name} {label}"))))
            if name == "header" and top.article:
                header = serial
            if label == "form":
                self._forms.add(serial)
        e = _Element(name, serial, silent, article, header)
        e.digest.update(tag.encode("utf-8", "surrogatepass"))
        e.shape.update(looks.encode("utf-8", "surrogatepass"))
        self._open_links += name == "a"
        self._stack.append(e)

    def _numbers(self) -> Iterator[int]:
        n = self._stack[-1].serial
        while n:
            yield n
            n = self.around[n]

    def labels_block(self, n: int) -> bool:
        """Whether a label keeps what is in the element from being the article: a form doesn't."""
        return n not in self._forms

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            if not m:
                self._text(source[at:])
                return
            if m.start() > at:
                self._text(source[at : m.start()])
            at = max(m.end(), m.start() + 1)
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self._text(m[0][9:].removesuffix("]]>"))
                continue
            name = m[2].lower()
            if m[1]:
                for i in range(len(self._stack) - 1, 0, -1):
                    if self._stack[i].name == name:
                        self._close(i)
                        break
                    if name in INLINE and self._stack[i].name in SCOPE:
                        break
                if name not in INLINE:
                    self._break()
                continue
            own = SAME.get(name, ())
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i].name in own or name in CLOSES_P and self._stack[i].name == "p":
                    self._close(i)
                    break
                if self._stack[i].name in SCOPE:
                    break
            if name not in INLINE:
                self._break()
            if name in VOID:
                self._stack[-1].digest.update(m[0].encode("utf-8", "surrogatepass"))
                continue
            if name in RAW:
                end = re.compile(rf"</{name}[\s/>]|\Z", re.I).search(source, at)
                at = end.start()
                if end[0]:
                    at = source.find(">", at) + 1 or len(source)
                continue
            self._open(name, m[0], m[3] or "")

    def text(self, gone: frozenset[int] | set[int] = frozenset()) -> str:
        """The main text, without elements that have a name in ``gone``: references decoded, white space as one blank, trimmed."""
        out = [False] * len(self.names)
        for n in range(1, len(self.names)):  # an element's number is above that of the one around it
            out[n] = out[self.around[n]] or any(h in gone for _, h in self.names[n])
        pieces = [t for t, n in self.texts if t == "\n" or not out[n] and not self.holds[n]]
        return " ".join(html.unescape("".join(pieces)).split())


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


_SUBTREES = "key long, host long, body long, total long, names array<struct<kind: int, name: long, chars: long, beside: boolean>>"


def _rows(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(key, page_id, url, html): equal rows have equal keys."""
    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.withColumn("key", F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("page_id", "url", "html")]))


def subtrees(rows: DataFrame) -> DataFrame:
    """Hashes of each page's host and text, and the names of its elements, each once, with the text in all that have it."""
    small_batches(rows.sparkSession)
    entry = pa.struct([("kind", pa.int32()), ("name", pa.int64()), ("chars", pa.int64()), ("beside", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, bodies, totals, names = [], [], [], []
            for url, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                page = Page(source or "")
                hosts.append(_signed(xxhash.xxh64(host_of(url).encode("utf-8", "surrogatepass"))))
                bodies.append(_signed(xxhash.xxh64(page.text().encode("utf-8", "surrogatepass"))))
                totals.append(page.chars[0])
                found: dict[tuple[int, int], tuple[int, bool]] = {}
                for n, own in enumerate(page.names):
                    for name in own:
                        chars, beside = found.get(name, (0, True))
                        found[name] = chars + page.chars[n], beside and page.beside(n)
                names.append([{"kind": k, "name": h, "chars": c, "beside": x} for (k, h), (c, x) in found.items()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hosts), pa.array(bodies, pa.int64()), pa.array(totals, pa.int64()), pa.array(names, pa.list_(entry))], names=["key", "host", "body", "total", "names"]
            )

    return rows.select("key", "url", "html").mapInArrow(run, _SUBTREES)


def templates(found: DataFrame, least_pages: int = 3, share: float = 1 / 3, share_in_article: float = 1 / 2, menu_share: float = 2 / 3, most_text: float = 1 / 2) -> DataFrame:
    """(host, name) of what goes from a host's pages; hosts by their hashes.

    Pages of one text count as one, so that a page that was copied is no template. Contents: on ``least_pages`` pages and that
    ``share`` of the host's, more for parts of marked articles. Shapes of links: on ``menu_share``. Labels: where half of the
    pages that have them mark their article beside them, or where they hold at most ``most_text`` of those pages' text; labels
    of comments always. Blocks beside an article: where they hold at most ``most_text``.
    """
    each = found.select("host", "body", "total", F.explode("names").alias("e")).select("host", "body", "total", "e.kind", "e.name", "e.chars", "e.beside")
    once = each.groupBy("host", "kind", "name", "body").agg(F.max("chars").alias("chars"), F.max("total").alias("total"), F.min("beside").alias("beside"))
    counted = once.groupBy("host", "kind", "name").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("total").alias("total"), F.avg(F.col("beside").cast("int")).alias("beside"))
    small = F.col("chars") <= most_text * F.col("total")
    said = counted.filter(
        (F.col("kind") == COMMENT) | (F.col("kind") == LABEL) & ((F.col("beside") >= 0.5) | small) | (F.col("kind") == BESIDE) & small
    )
    # only what recurs meets the numbers of hosts' pages: few rows, of a hot host too
    often = counted.filter((F.col("pages") >= least_pages) & F.col("kind").isin(CONTENT, CONTENT_IN_ARTICLE, SHAPE))
    hosts = found.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("of"))
    part = F.col("pages") / F.col("of")
    goes = (
        F.when(F.col("kind") == CONTENT, part >= share).when(F.col("kind") == CONTENT_IN_ARTICLE, part >= share_in_article).otherwise((part >= menu_share) & small)
    )
    recurring = often.join(hosts.hint("merge"), "host").filter(goes)
    return said.select("host", "name").unionByName(recurring.select("host", "name")).distinct()


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; text is empty where nothing remains.

    Null html is empty. Rows with null or odd urls share one host without a name. Repeated rows are answered each, alike.
    Broken markup is read to its end: elements left open end with what holds them. A very long page is one Python object like
    others; its names are hashed as it is read, so depth costs nothing. Other columns are ignored, whatever their names; an
    empty table gives an empty one. Pages meet the names that go from them in one merge join, in which a hot host is no key.
    """
    rows = _rows(df, id_col, url_col, html_col)
    found = cut(subtrees(rows), "subtrees")
    named = cut(templates(found, least_pages), "templates")
    # a host's templates and its pages' names meet by both; one name of a hot host is a skewed key of a merge join
    held = found.select("key", "host", F.explode(F.array_distinct(F.col("names.name"))).alias("name")).join(named.hint("merge"), ["host", "name"])
    gone = held.groupBy("key").agg(F.collect_set("name").alias("gone"))
    joined = rows.join(gone.hint("merge"), "key", "left").select("page_id", "url", "html", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(source or "").text(set(names or ())) for source, names in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    rest = joined.mapInArrow(run, "page_id long, url string, text string")
    return rest.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
