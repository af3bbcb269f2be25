"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is a sequence of tokens: the starts and ends of block elements, told apart by the elements around them, and whole
text nodes, told apart by their element. Over the pages of a host, each token has an occurrence vector (how often it
stands in each page); tokens of a host with equal vectors form an equivalence class. Vectors are never gathered: Spark
sums a hash of (page, count) per token, which is equal for equal vectors.

A class is a candidate if it has CLASS tokens at least, an element among them, on a share of the host's pages. Its texts
don't count if they are most of what its pages say: these are copies of one article. A candidate is valid if its tokens stand
in one order in nearly all its pages, as often as they repeat, and if it nests: it stands in one gap of each class of
more pages. The valid classes are the host's template; a host with pages of several kinds has a class for each. What
lies between neighbouring tokens of the nested classes are its slots. Texts of valid classes are part of the template
and go. The main slot is the deepest element of a class that holds most of the text, which must vary, of its pages.

The template of a host is one small row, joined to its pages; the pages themselves aren't grouped, so those of a hot
host stay spread over all tasks.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.llm.common import BROADCAST_ROWS, slices
from recallgrid.tables import discard, written

#: Tokens of a candidate class, and pages that have it, as a number and as a share of the host's.
CLASS, PAGES, SHARE = 3, 3, 0.2
#: Largest share of its pages' text that a class's texts have, else they stay; share of its pages where it is in order and nests.
SAID, ORDERED = 2 / 3, 0.9
#: Share of the text outside boilerplate in a class's pages that the main slot holds.
MAIN_SHARE = 0.6
#: Elements that hold no text of their own to read, and those without an end tag.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "select", "button", "object", "audio", "video", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that don't part blocks.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
#: Elements, and words of class, id and role, of containers that are not the article.
ASIDE = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "head", "fieldset"}
WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related responses respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
#: Whole classes, ids and roles of containers that hold adverts or readers' comments wherever they stand, in articles too,
#: and those containers. Headings and paragraphs of such a class are an article about it.
BOXED = set(
    "ad ads ad-box ad-container ad-slot ad-unit adbox adsbygoogle advert adverts advertisement advertising commentlist comment-list comment-section comment-thread comments comments-area comments-list comments-section disqus_thread reader-comments responses sponsored-content user-comments".split()
)
BOXES = {"div", "section", "aside", "ul", "ol", "dl", "table", "figure", "details"}
#: Elements that can be a page's main slot.
CONTAINERS = ("html", "body", "main", "article", "section", "div", "table", "tbody", "tr", "td", "center")
#: Elements whose start ends an open element of the same kind: their end tags may be left out.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ENDS_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD, _NUMBER = re.compile(r"[a-z]+"), re.compile(r"\d{3,}")
_P, _NOTHING = ("p",), frozenset()
_AROUND_P = frozenset({"table", "article", "section", "div", "li", "blockquote"})
_AROUND_ITEMS = frozenset({"ul", "ol", "dl", "table", "select"})
_AROUND_INLINE = frozenset({"article", "main", "table"})


@lru_cache(1 << 16)
def names(attributes: str) -> tuple[str, frozenset[str], bool]:
    """What tells an element apart, its classes, ids and roles with numbers of three digits or more left out (they number
    pages), the words in them, and whether one is BOXED as a whole."""
    values = [x.lower() for v in _NAMED.findall(attributes) for x in v if x]
    own = sorted({_NUMBER.sub("#", x) for v in values for x in v.split()})
    return "".join(f".{x}" for x in own), frozenset(w for v in values for w in _WORD.findall(v)), not BOXED.isdisjoint(own)


@lru_cache(1 << 16)
def child(token: int, name: str) -> int:
    """The token of an element in that of its parent, or of a text in its element."""
    return xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), token) >> 1


class Page:
    """Elements and text nodes of one page, in document order.

    An element is (name, token, parent's number, depth, whether in a boilerplate container), the first one the page; a
    text is (element's number, block number, text, whether aside, place). ``spans`` has the places of an element's start
    and end among all starts, ends and texts.
    """

    def __init__(self, source: str | None) -> None:
        self.elements: list[tuple[str, int, int, int, bool]] = [("", 0, -1, 0, False)]
        self.spans: list[list[int]] = [[0, 0]]
        self.texts: list[tuple[int, int, str, bool, int]] = []
        #: Open elements: name, whether inside a boilerplate container, whether inside an article or main element, and
        #: the number of the block element that they are or are in.
        self.stack: list[tuple[str, bool, bool, int]] = [("", False, False, 0)]
        self.open: dict[str, int] = {}
        self.place = 0
        self.block = at = 0
        source = source or ""
        while at < len(source):
            m = _TOKEN.search(source, at)
            self._text(source[at : m.start() if m else len(source)])
            if not m:
                break
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    self._text(html.escape(m[0][9:].removesuffix("]]>")))
            elif tag == "br":
                self._text(" ")
            elif m[1]:
                self.block += tag not in INLINE
                self._close((tag,), _AROUND_INLINE if tag in INLINE else _NOTHING)
            elif tag in RAW:
                self.block += tag not in INLINE
                close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = close.end() if close else len(source)
            else:
                self._start(tag, m[3])
        self._end(0)

    def _text(self, text: str) -> None:
        if text:
            _, aside, _, number = self.stack[-1]
            self.place += 1
            self.texts.append((number, self.block, text, aside, self.place))

    def _start(self, tag: str, attributes: str) -> None:
        self.block += tag not in INLINE
        if tag in ENDS_P:
            self._close(_P, _AROUND_P)
        if tag in CLOSES:
            self._close(CLOSES[tag], _AROUND_ITEMS)
        if tag in VOID or attributes.endswith("/"):
            return
        _, aside, inside, number = self.stack[-1]
        own, words, boxed = names(attributes) if attributes else ("", _NOTHING, False)
        if not aside and tag not in ("html", "body", "main", "article"):
            # An article's own header has its title, and single words of a class say nothing there.
            aside = (tag in ASIDE and tag != "header" or boxed and tag in BOXES) if inside else tag in ASIDE or not WORDS.isdisjoint(words)
        if tag not in INLINE:
            _, token, _, depth, _ = self.elements[number]
            self.elements.append((tag, child(token, tag + own), number, depth + 1, aside))
            self.place += 1
            self.spans.append([self.place, 0])
            number = len(self.elements) - 1
        self.stack.append((tag, aside, inside or tag in {"article", "main"}, number))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _end(self, level: int) -> None:
        """Closes all elements from a level of the stack on, the innermost first."""
        for k in range(len(self.stack) - 1, level - 1, -1):
            tag, _, _, number = self.stack[k]
            if k:
                self.open[tag] -= 1
            if tag not in INLINE:
                self.place += 1
                self.spans[number][1] = self.place
        del self.stack[level:]

    def _close(self, kinds: tuple[str, ...], within: frozenset[str]) -> None:
        """Ends the innermost open element of ``kinds`` that isn't outside one of ``within``."""
        opened, stack = self.open, self.stack
        for kind in kinds:
            if opened.get(kind):
                break
        else:
            return
        for k in range(len(stack) - 1, 0, -1):
            tag = stack[k][0]
            if tag in kinds:
                self._end(k)
                return
            if tag in within:
                return

    def sizes(self) -> list[int]:
        """For each element, the characters of text outside boilerplate in it at any depth."""
        out = [0] * len(self.elements)
        for number, _, text, aside, _ in self.texts:
            if not aside:
                out[number] += len(text.strip())
        for number in range(len(out) - 1, 0, -1):
            out[self.elements[number][2]] += out[number]
        return out

    def tokens(self) -> tuple[Counter[int], Counter[int]]:
        """How often each element's token and each text's outside boilerplate stands in the page."""
        said = (self.text_token(number, text) for number, _, text, aside, _ in self.texts if not aside and not text.isspace())
        return Counter(e[1] for e in self.elements[1:]), Counter(said)

    def text_token(self, number: int, text: str) -> int:
        """The token of a text node: that of its element with its text, white space folded."""
        return xxhash.xxh3_64_intdigest(" ".join(text.split()).encode("utf-8", "surrogatepass"), self.elements[number][1] ^ 1) >> 1

    def blocks(self, inside: int | None, fixed: set[int]) -> list[str]:
        """The texts of the blocks in elements of token ``inside`` (None: anywhere) and outside boilerplate, without the
        template's texts."""
        within = [inside is None]
        for _, token, parent, _, _ in self.elements[1:]:
            within.append(within[parent] or token == inside)
        out: list[tuple[int, list[str]]] = []
        for number, block, text, aside, _ in self.texts:
            if aside or not within[number] or (fixed and self.text_token(number, text) in fixed):
                continue
            if out and out[-1][0] == block:
                out[-1][1].append(html.unescape(text))
            else:
                out.append((block, [html.unescape(text)]))
        found = (" ".join("".join(parts).split()) for _, parts in out)
        return [x for x in found if x]

    def main(self, mains: set[int]) -> int | None:
        """The token of the main slot: the deepest element among ``mains``; without one the article or main element with
        the most text; None is the whole page."""
        deepest = max(((depth, -number) for number, (_, token, _, depth, aside) in enumerate(self.elements) if token in mains and not aside), default=None)
        if deepest:
            return self.elements[-deepest[1]][1]
        total: Counter[int] = Counter()
        for (name, token, _, _, aside), size in zip(self.elements, self.sizes(), strict=True):
            if name in ("article", "main") and not aside:
                total[token] += size
        return max(total, key=lambda t: (total[t], t), default=None)

    def classes(self, of: dict[int, int]) -> tuple[dict[int, tuple[int, bool]], int]:
        """For each class of the tokens ``of``: a hash of its order, and whether it nests; and the text outside it all.

        A class repeats its tokens as one unit; one that doesn't has order 0. It nests if no class of a lower number has
        a token between its first and its last one in each unit.
        """
        events: list[tuple[int, int, int]] = []
        for (_, token, _, _, _), (start, end) in zip(self.elements, self.spans, strict=True):
            if token in of:
                events += [(start, of[token], token), (end, of[token], ~token)]
        rest = 0
        for number, _, text, aside, place in self.texts:
            if not aside and not text.isspace():
                token = self.text_token(number, text)
                if token in of:
                    events.append((place, of[token], token))
                else:
                    rest += len(text.strip())
        events.sort()
        orders: dict[int, list[int]] = {}
        places: dict[int, list[int]] = {}
        for i, (_, c, token) in enumerate(events):
            orders.setdefault(c, []).append(token)
            places.setdefault(c, []).append(i)
        lowest = [(c, i) for i, (_, c, _) in enumerate(events)]
        out = {}
        for c, order in orders.items():
            unit = len(set(order))
            whole = len(order) % unit == 0 and order == order[:unit] * (len(order) // unit)
            nests = whole
            for at in range(0, len(order), unit) if whole else ():
                first, last = places[c][at], places[c][at + unit - 1]
                if last - first + 1 > unit and min(lowest[first : last + 1])[0] < c:
                    nests = False
                    break
            out[c] = (xxhash.xxh3_64_intdigest(repr(order[:unit]).encode()) >> 1 if whole else 0), nests
        return out, rest


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for each row of ``pages``.

    Character references are decoded, white space inside a block is one space, blocks are joined by one space. Pages of
    hosts with fewer than PAGES pages, and those without the host's main slot, give all text outside boilerplate of
    their article or main element, or else of the page. A null or empty page gives an empty text; a null or odd url is
    a host of its own. Repeated rows each count as a page of the host. Other columns are ignored.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host.alias("host"))
    template = _templates(rows)
    out = _joined(rows, template, "mains", "fixed").select("id", "url", "html", "mains", "fixed")
    found = out.mapInArrow(_extracted, out.select("id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema)
    return found.withColumnsRenamed({"id": id_col, "url": url_col})


def _joined(rows: DataFrame, small: DataFrame, *lists: str) -> DataFrame:
    """Pages with their host's row of a written table, which is broadcast if its lists are counted as small."""
    size = small.agg(F.count("*") + sum(F.coalesce(F.sum(F.size(F.coalesce(c, F.array()))), F.lit(0)) for c in lists)).first()[0]
    return rows.join(F.broadcast(small) if size <= BROADCAST_ROWS else small, "host", "left")


def _templates(rows: DataFrame) -> DataFrame:
    """(host, mains, fixed): tokens of the elements that can be the main slot, and of the template's texts."""
    tokens = rows.select("host", "html").mapInArrow(_tokens, "host string, token long, name string, once boolean, size long, said long, vector long")
    tokens = tokens.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum(F.col("vector").cast("decimal(38,0)")).alias("vector"), F.bool_and("once").alias("once"), F.max("name").alias("name"), F.sum("size").alias("size"), F.sum("said").alias("said")
    )
    whole = rows.groupBy("host").agg(F.count("*").alias("of"))
    tokens = tokens.where(F.col("pages") >= PAGES).join(whole, "host").where(F.col("pages") >= SHARE * F.col("of"))
    one = F.collect_list(F.struct("token", "name", "once")).alias("tokens")
    same = tokens.groupBy("host", "vector").agg(one, F.max("pages").alias("pages"), F.max("said").alias("said"), F.sum("size").alias("size"))
    same = same.where((F.size("tokens") >= CLASS) & F.exists("tokens", lambda t: t["name"] != ""))
    same = same.withColumn("tokens", F.when(F.col("size") > SAID * F.col("said"), F.filter("tokens", lambda t: t["name"] != "")).otherwise(F.col("tokens")))
    # Classes of a host are numbered from the most pages down; there are few, as each page has few tokens.
    numbered = same.groupBy("host").agg(F.sort_array(F.collect_list(F.struct(-F.col("pages"), -F.size("tokens"), "vector", "tokens"))).alias("classes"))
    classes = written(numbered.select("host", F.posexplode("classes").alias("class", "c")).select("host", "class", F.explode("c.tokens").alias("t")).select("host", "class", "t.*"))
    candidates = written(classes.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("tokens")))
    seen = _joined(rows.select("host", "html"), candidates, "tokens").where("tokens is not null").mapInArrow(_ordered, "host string, class int, order long, nests boolean, rest long, token long, size long, said long")
    seen = written(
        seen.groupBy("host", "class", "order", "token").agg(F.count("*").alias("n"), F.count_if("nests").alias("nested"), F.sum("rest").alias("rest"), F.sum("size").alias("size"), F.min("said").alias("first"), F.max("said").alias("last"))
    )
    orders = seen.where("class is not null").groupBy("host", "class").agg(F.max(F.when(F.col("order") != 0, F.col("n"))).alias("most"), F.sum("n").alias("n"), F.sum("nested").alias("nested"), F.sum("rest").alias("rest"))
    valid = classes.join(orders.where((F.col("most") >= ORDERED * F.col("n")) & (F.col("nested") >= ORDERED * F.col("n"))), ["host", "class"])
    slots = seen.where("token is not null and first <> last").select("host", "token", F.col("size").alias("held"))
    mains = valid.where(F.col("once") & F.col("name").isin(*CONTAINERS)).join(slots, ["host", "token"]).where(F.col("held") >= MAIN_SHARE * F.col("rest"))
    mains = mains.groupBy("host").agg(F.collect_set("token").alias("mains"))
    fixed = valid.where("name = ''").groupBy("host").agg(F.collect_set("token").alias("fixed"))
    out = written(mains.join(fixed, "host", "full_outer"))
    for table in (classes, candidates, seen):
        discard(table)
    return out


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(schema)], [n for n, _ in schema])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page, its distinct tokens with a hash of (page, count) and the page's text; elements have a name."""
    schema = [("host", pa.string()), ("token", pa.int64()), ("name", pa.string()), ("once", pa.bool_()), ("size", pa.int64()), ("said", pa.int64()), ("vector", pa.int64())]
    for batch in slices(batches):
        out: list[tuple] = []
        for host, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            page = Page(source)
            key = xxhash.xxh3_64_intdigest((source or "").encode("utf-8", "surrogatepass"))
            vector = lambda n, key=key: (key * (2 * n + 1) & (1 << 64) - 1) >> 2
            of = {e[1]: e[0] for e in page.elements[1:]}
            sizes: dict[int, int] = {}
            for number, _, text, aside, _ in page.texts:
                if not aside and not text.isspace():
                    sizes[page.text_token(number, text)] = len(text.strip())
            elements, texts = page.tokens()
            said = page.sizes()[0]
            out += [(host, t, of[t], n == 1, 0, said, vector(n)) for t, n in elements.items()]
            out += [(host, t, "", n == 1, n * sizes[t], said, vector(n)) for t, n in texts.items()]
        yield _batch(out, schema)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page, its classes' order and nesting, and the text of each candidate element that stands once in it."""
    schema = [("host", pa.string()), ("class", pa.int32()), ("order", pa.int64()), ("nests", pa.bool_()), ("rest", pa.int64()), ("token", pa.int64()), ("size", pa.int64()), ("said", pa.int64())]
    for batch in slices(batches):
        out: list[tuple] = []
        for host, source, tokens in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "tokens")), strict=True):
            page = Page(source)
            of = {t["token"]: t["class"] for t in tokens}
            found, rest = page.classes(of)
            out += [(host, c, order, nests, rest, None, None, None) for c, (order, nests) in found.items()]
            own = [0] * len(page.elements)
            said = [0] * len(page.elements)
            for number, _, text, aside, _ in page.texts:
                if not aside and not text.isspace() and (token := page.text_token(number, text)) not in of:
                    own[number] += len(text.strip())
                    said[number] = (said[number] * 31 + token) & (1 << 62) - 1
            for number in range(len(own) - 1, 0, -1):
                name, token, parent, _, aside = page.elements[number]
                own[parent] += own[number]
                said[parent] = (said[parent] * 31 + said[number]) & (1 << 62) - 1
                if own[number] and not aside and token in of and name in CONTAINERS:
                    out.append((host, None, None, None, None, token, own[number], said[number]))
        yield _batch(out, schema)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = []
        for source, mains, fixed in zip(*(batch.column(c).to_pylist() for c in ("html", "mains", "fixed")), strict=True):
            page = Page(source)
            texts.append(" ".join(page.blocks(page.main(set(mains or ())), set(fixed or ()))))
        sizes = [len(t) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["id", "url", "text", "n_chars"])
