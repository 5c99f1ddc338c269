"""Main text of web pages: subtrees that a site's pages share go, then parts that are no content by their own markup.

Every element subtree of every page is hashed (its tags and text nodes). For each host Spark counts on how many different
pages a hash occurs; subtrees on many pages of their host are its template and are deleted, whatever they are called.
Elements whose tag, role or name says that they are no content go as well, as on hosts of a few pages nothing recurs.

Parsing is linear in a page's length: tags are found without backtracking, an element's hash is a difference of two prefix
hashes, and what an end tag closes is looked up, not searched for.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.common import column_or_null, materialize

_NAME = re.compile(r"[A-Za-z][^\s/>]*+")
_QUOTE_OR_END = re.compile(r">|=\s*+[\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)\s*+=\s*+(?:"([^"]*+)"?|'([^']*+)'?|([^\s>]++))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|$)")
_QUOTED = re.compile(r"\"[^\"]*+\"|'[^']*+'")
_NO_DISPLAY = re.compile(r"display\s*:\s*none")
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E6F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside isn't parsed and isn't shown as text.
RAW = frozenset(
    "script style textarea title noscript template iframe noembed noframes svg canvas object audio video".split()
)
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
#: Elements that are often content of their own where they repeat: inline ones, cells, items, headings, and paragraphs, as
#: articles share passages and quotations.
PARTS = frozenset(
    "td th tr li dt dd caption legend option optgroup summary h1 h2 h3 h4 h5 h6 p blockquote pre".split()
)
#: Elements and roles that are no content.
DROPPED = frozenset("head nav footer aside form button select dialog menu datalist".split())
ROLES = frozenset(
    "navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split()
)
#: Words that name no content, and words that only say where a thing is or what form it has. A class or id counts where
#: it holds one of the first and nothing but these: site-nav does, share-price and related-work don't.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs header footer masthead comment comments disqus respond replies share sharing "
    "social related recommended pagination pager toolbar skip".split()
)
PLACES = frozenset(
    "site page main top bottom left right global primary secondary inner outer content bar box list form banner wrapper wrap "
    "container widget section area block links link buttons button posts articles items item row col slot unit panel "
    "message to my the".split()
)
#: Within an article or main: whole classes, and ids, that say no content whatever the article is about.
INNER_CLASSES = frozenset(
    "ad ads advert adverts advertisement adsense adsbygoogle sponsored newsletter-signup newsletter-form cookie-banner "
    "cookie-notice cookie-consent share-buttons social-share social-buttons related-posts related-articles comments "
    "comment-list comment-form navbar sidebar breadcrumb breadcrumbs pagination pager skip-link".split()
)
INNER_IDS = frozenset("comments disqus_thread respond sidebar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an open element of these kinds is closed by, and what keeps it from being seen.
_CLOSES = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_PARAGRAPH = (("p",), ("table", "td", "th", "button", "object"))


#: Words of readers' comments: outside of articles a class that holds one is no content whatever else it says, unless one of
#: the others says that it is only about whether there are any.
COMMENTS = frozenset("comment comments disqus replies".split())
ABOUT = frozenset("has have no not with without allow allows open opened closed enabled disabled on off".split())
_NUMBER = re.compile("v?[0-9]+$")


@lru_cache(maxsize=1 << 14)
def _parts(value: str) -> tuple[str, ...]:
    """Words of a class or id, without the numbers and versions at their ends."""
    return tuple(p for p in (_NUMBER.sub("", x) for x in re.split(r"[-_]+", value)) if p)


def _named_no_content(value: str) -> bool:
    """Whether a class or id holds a word of NAMES and otherwise only words of PLACES."""
    parts = _parts(value)
    return any(p in NAMES for p in parts) and all(p in NAMES or p in PLACES for p in parts)


def _comments(value: str) -> bool:
    parts = _parts(value)
    return any(p in COMMENTS for p in parts) and not any(p in ABOUT for p in parts)


def _no_content(tag: str, attributes: str, in_article: bool, in_root: bool) -> bool:
    """in_root: within an article or main, where fewer names decide. Ids of headings are slugs of what they say."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name in ("class", "id"):
            whole = value.split()
            if name == "class" and not in_article and any(map(_comments, whole)):
                return True
            if in_root:
                known = INNER_CLASSES if name == "class" else INNER_IDS
                if any(x in known for x in whole) or "header" in whole and not in_article:
                    return True
            elif not (tag in HEADINGS and name == "id") and any(map(_named_no_content, whole)):
                return True
        elif name == "role" and value in ROLES or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and _NO_DISPLAY.search(value):
            return True
    return _HIDDEN.search(_QUOTED.sub("", attributes)) is not None


# ---------------------------------------------------------------- parsing


@dataclass
class Page:
    """Text nodes and block edges in page order, which of them may be content, and the elements around them."""

    pieces: list[str] = field(default_factory=list)
    kept: list[bool] = field(default_factory=list)
    #: (first piece, end piece, tag, first token, end token, whether an article or main lies in it), innermost first
    elements: list[tuple[int, int, str, int, int, bool]] = field(default_factory=list)
    tokens: list[str] = field(default_factory=list)  # tags that open and text nodes, for hashes

    def text(self, gone: list[tuple[int, int]] = ()) -> str:
        """The content without some stretches of pieces."""
        kept = self.kept
        if gone:
            kept, past = list(kept), 0
            for a, b in sorted(gone):
                if b > past:  # else it lies in one before
                    kept[a:b] = [False] * (b - a)
                    past = b
        return " ".join("".join([p if k else " " for p, k in zip(self.pieces, kept, strict=True)]).split())


def _tag_end(html: str, at: int, last: dict[str, int]) -> int:
    """Where the tag that is open at `at` ends: at a > that isn't in a quoted value. A quote that nothing closes is text."""
    while m := _QUOTE_OR_END.search(html, at):
        mark = m[0][-1]
        if mark == ">":
            return m.start()
        at = m.end()
        if last.setdefault(mark, html.rfind(mark)) >= at:
            at = html.index(mark, at) + 1
    return len(html)


_raw_ends: dict[str, re.Pattern] = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}


def parse(html: str) -> Page:
    page = Page()
    stack: list[tuple[str, int, int, bool]] = []  # tag, first piece, first token, dropped
    places: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
    blocks: list[int] = []
    roots: list[int] = []  # tokens at which an article or main began
    last: dict[str, int] = {}
    at, n = 0, len(html)
    pieces, kept, tokens = page.pieces, page.kept, page.tokens

    def dropped() -> bool:
        return bool(stack) and stack[-1][3]

    def put(text: str, keep: bool) -> None:
        pieces.append(text)
        kept.append(keep)

    def close(depth: int) -> None:
        while len(stack) > depth:
            tag, piece, token, gone = stack.pop()
            places[tag].pop()
            if tag in BLOCK:
                blocks.pop()
                put(" ", not gone)
            if piece < len(pieces):
                page.elements.append((piece, len(pieces), tag, token, len(tokens), bool(roots) and roots[-1] >= token))

    def innermost(tags: tuple[str, ...]) -> int:
        found = -1
        for t in tags:
            if (open_ones := places.get(t)) and open_ones[-1] > found:
                found = open_ones[-1]
        return found

    def nearest(tags: tuple[str, ...], barrier: tuple[str, ...]) -> int | None:
        here = innermost(tags)
        return here if here >= 0 and here > innermost(barrier) else None

    while at < n:
        start = html.find("<", at)
        while 0 <= start < n - 1 and not (html[start + 1] in "!?/" or html[start + 1].isascii() and html[start + 1].isalpha()):
            start = html.find("<", start + 1)
        if start == n - 1:
            start = -1
        text = html[at : start if start >= 0 else n]
        if text:
            put(unescape(text), not dropped())
            if bare := " ".join(text.split()):
                tokens.append(f"={bare}")
        if start < 0:
            break
        if html[start + 1] in "!?":
            comment = html.startswith("<!--", start)
            end = html.find("-->", start + 4) if comment else html.find(">", start)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        name = _NAME.match(html, start + (2 if html[start + 1] == "/" else 1))
        if not name:  # an end tag without a name is a comment
            end = html.find(">", start)
            at = n if end < 0 else end + 1
            continue
        tag = name[0].lower()
        end = _tag_end(html, name.end(), last)
        attributes, at = html[name.end() : end], end + 1
        if html[start + 1] == "/":
            if places[tag] and (tag in BLOCK or not blocks or blocks[-1] < places[tag][-1]):
                close(places[tag][-1])
            elif tag == "p" and not dropped():
                put(" ", True)
            continue
        if tag in RAW:
            stop = _raw_ends[tag].search(html, at)
            at = n if not stop else _tag_end(html, stop.end(), last) + 1
            continue
        if tag in VOID:
            if tag in BLOCK:
                put(" ", not dropped())
            continue
        k = nearest(*_CLOSES[tag]) if tag in _CLOSES else None
        if k is None and tag in BLOCK:
            k = nearest(*_PARAGRAPH)
        if k is not None:
            close(k)
        in_article = bool(places["article"])
        gone = dropped() or _no_content(tag, attributes, in_article, in_article or bool(places["main"]))
        if tag in BLOCK:
            put(" ", not gone)
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in ("article", "main"):
            roots.append(len(tokens))
        places[tag].append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append((tag, len(pieces), len(tokens), gone))
        tokens.append(f"<{tag}")
    close(0)
    return page


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def subtrees(page: Page) -> Iterator[tuple[int, int, int, bool]]:
    """Hash, first and end piece of each subtree with text and without an article or main in it, and whether it is a part
    (PARTS, or inline)."""
    total, power, texts, known = [0], [1], [0], {}
    here, grown, count = 0, 1, 0
    for token in page.tokens:
        if token not in known:
            known[token] = _hash(token)
        here, grown, count = (here * _BASE + known[token]) % _PRIME, grown * _BASE % _PRIME, count + (token[0] != "<")
        total.append(here)
        power.append(grown)
        texts.append(count)
    for start, end, tag, a, b, holds_root in page.elements:
        if not holds_root and tag not in ("html", "body") and texts[b] > texts[a]:
            yield (total[b] - total[a] * power[b - a]) % _PRIME, start, end, tag in PARTS or tag not in BLOCK


def main_text(html: str, template: set[int] = frozenset()) -> str:
    """Content of a page without subtrees of the template."""
    page = parse(html)
    return page.text([(a, b) for h, a, b, _ in subtrees(page) if h in template] if template else [])


# ---------------------------------------------------------------- tables


def page_host(url: str = "url"):
    """Host of a URL in lower case, empty where there is none."""
    form = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)"
    return F.coalesce(F.regexp_extract(F.lower(url), form, 1), F.lit(""))


def host_subtrees(pages: DataFrame) -> DataFrame:
    """page, host, subtree, body, part: each different subtree of each page (page, host, html); body: of what its own
    markup leaves of the page."""
    names = ["page", "host", "subtree", "body", "part"]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for page, host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parsed = parse(html or "")
                body = _hash(parsed.text())
                out += [(page, host, h, body, part) for h, part in {(x[0], x[3]) for x in subtrees(parsed)}]
            columns = zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)

    wanted = pages.select("page", "host", "html")
    return wanted.mapInArrow(run, "page long, host long, subtree long, body long, part boolean")


def site_templates(found: DataFrame, min_pages: int, share: float, least_pages: int, least_share: float) -> DataFrame:
    """(host, subtree) of the subtrees that are template, of found (host, subtree, body, part). See extract."""
    # distinct first, so that counts of a hot host, or of its menu, are summed where they are read
    enough = F.when(F.col("part"), min_pages).otherwise(least_pages)
    per = found.select("host", "subtree", "body", "part").distinct().groupBy("host", "subtree", "part")
    per = per.agg(F.count("*").alias("n")).where(F.col("n") >= enough)
    hosts = found.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    half = F.col("n") >= share * F.col("pages")
    block = F.when(F.col("n") >= min_pages, F.col("n") >= least_share * F.col("pages")).otherwise(half)
    return per.join(hosts, "host").where(F.when(F.col("part"), half).otherwise(block)).select("host", "subtree")


def extract(
    pages: DataFrame,
    min_pages: int = 10,
    share: float = 0.5,
    least_pages: int = 3,
    least_share: float = 0.1,
    broadcast_rows: int = 50_000,
    salts: int = 32,
) -> DataFrame:
    """Per page of pages (page_id, url, html): page_id, url, text, n_chars.

    A block is template where it stands on at least `min_pages` different pages of its host and on at least `least_share`
    of them, so a section's template goes too; on a smaller host, on at least `least_pages` and `share` of its pages.
    PARTS and inline elements repeat in content as well: on their own they are template on at least `min_pages` pages and
    `share` of them. Pages differ where what their own markup leaves of them does.

    Character references are decoded, white space (Unicode's) within a block is one space, blocks are joined by one space.
    Null and empty html give an empty text; a null url is the host ""; repeated rows, and rows with one page_id, are pages
    of their own; other columns aren't read; an empty table gives no rows. Broken markup is read as browsers do: implied
    ends, references without semicolon, pages that end anywhere; a quote that nothing closes doesn't hide a tag's end.
    broadcast_rows: templates of up to so many (page, subtree) rows are broadcast, more are joined by page. salts: shares
    in which pages of one host look up a subtree.
    """
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.col("url").cast("string").alias("url"),
        column_or_null(pages, "html", "string").alias("html"),
    ).withColumn("page", F.xxhash64("url", "html"))
    found = host_subtrees(rows.withColumn("host", F.xxhash64(page_host())))
    found = materialize(found, "subtrees")
    templates = site_templates(found, min_pages, share, least_pages, least_share)
    # pages of a hot host meet a subtree of its template in `salts` shares
    spread = templates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = found.select("host", "subtree", "page", F.pmod("page", F.lit(salts)).cast("int").alias("salt"))
    hits = mine.join(spread, ["host", "subtree", "salt"]).select("page", "subtree").distinct()
    hits = materialize(hits, "templates")
    few = hits.limit(broadcast_rows + 1).count() <= broadcast_rows
    per_page = hits.groupBy("page").agg(F.collect_list("subtree").alias("template"))
    joined = rows.join(F.broadcast(per_page) if few else per_page, "page", "left")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            made = [main_text(html or "", set(t or ())) for html, t in pairs]
            columns = [batch.column(0), batch.column(1).cast(pa.string()), pa.array(made, pa.string())]
            columns.append(pa.array(map(len, made), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    wanted = joined.select("page_id", "url", "html", "template")
    return wanted.mapInArrow(texts, "page_id long, url string, text string, n_chars long")
