"""Main text of web pages, with site templates removed.

Pass one parses each page into a tree of its block-level elements and hashes each subtree bottom up: an element's hash is made of its
tag, its own text and its children's hashes in order. Spark counts for each host on how many pages of different text a subtree
stands; one on MIN_PAGES or more, and on at least MIN_SHARE of the host's pages of different text, belongs to the site's template. Pass
two parses again and deletes the template's subtrees. No count can show text that stands in a template's place and changes from page to
page, so elements that HTML itself sets apart (by tag or role), hidden ones, and those whose class or id is a plain word for adverts,
comments and the like go by fixed rules. A form or an element so named stays if the page's article, or most of its text, stands in it.

If a page's article elements (or else its main elements) hold most of what rules and template leave, its text is what stands in them,
and nothing inside them is taken for template. A page for which the rules alone tell so isn't shuffled; others are joined with their
template's subtrees. An article that holds less, such as a teaser, decides nothing.

Blocks end at block-level tags; inline tags and line breaks don't end them. Character references are decoded, white space
in a block becomes one space, blocks are joined by an empty line.

Defined results: a null or empty page has no text. Pages equal in url and bytes share their deletions, repeated rows and
ids included, and count as one page of their host. Pages without a url have the host "". Tags left open end where their parent ends. A
table without rows gives none. Other columns are not looked at.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, stored

#: Pages of different text from which a subtree of a host is template, and the least share of the host's.
MIN_PAGES, MIN_SHARE = 5, 0.1
#: Elements whose content is no text, parts of forms, elements that hold no article, and roles of such.
RAW = frozenset("script style noscript template textarea title iframe svg annotation annotation-xml object head select datalist option".split())
CONTROLS = frozenset("button label".split())
NO_ARTICLE = frozenset("nav footer aside form menu dialog header fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Block-level elements, and those that a start tag ends if they are the innermost one.
BLOCKS = frozenset("nav footer aside form menu dialog header fieldset div section ul ol dl table figure main article body p h1 h2 h3 h4 h5 h6 li dt dd tr td th thead tbody tfoot caption blockquote pre address hr figcaption details summary center html".split())
ENDED_BY = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "tr": ("p", "td", "th", "tr"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tbody": ("p", "td", "th", "tr", "thead"), "tfoot": ("p", "td", "th", "tr", "tbody")}
#: Classes and ids, as whole words, of text that changes from page to page and is no article; those of reader comments.
MARKS = frozenset("ad ads advert adverts advertisement banner sponsored promo sidebar cookie-notice cookie-banner notice newsletter breadcrumbs breadcrumb menu navbar navigation pagination popup modal share sharing social related recommended subscribe signup login".split())
COMMENTS = frozenset("comment comments comment-list disqus_thread replies".split())
#: The elements that may be a template's; paragraphs, headings, items and cells go with one of these around them.
CONTAINERS = frozenset("div section ul ol dl table figure details center address blockquote header fieldset".split())
#: Quotes hold a value only right behind an equals sign; elsewhere they are characters like others.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_BARE_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|/|=|$)", re.I)
_ENDS = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW | CONTROLS}
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
#: What a fixed rule says: an element stays, goes, goes unless the article stands in it, or goes unless most of the text does.
STAYS, GOES, UNLESS_ARTICLE, UNLESS_MOST = range(4)


def _rule(tag: str, attributes: str, in_article: bool) -> int:
    if tag == "form":
        return UNLESS_MOST
    if tag in NO_ARTICLE and not (tag == "header" and in_article):
        return GOES
    if not attributes.strip():
        return STAYS
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    role = found.get("role", "").lower()
    if role in ROLES:
        return UNLESS_MOST if role == "form" else GOES
    if found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")) or _BARE_HIDDEN.search(_ATTRIBUTE.sub(" ", attributes)):
        return GOES
    if tag in ("body", "html", "main"):
        return STAYS
    marks = set(f"{found.get('class', '')} {found.get('id', '')}".lower().split())
    if marks & COMMENTS:
        return GOES
    return UNLESS_ARTICLE if marks & MARKS else STAYS


class Element:
    """A block-level element: its range of blocks, what its fixed rule says, and what it is made of."""

    __slots__ = ("tag", "parent", "rule", "main", "has_main", "first", "last", "made_of", "hash", "goes")

    def __init__(self, tag, parent, rule, main, first):
        self.tag, self.parent, self.rule, self.main, self.first = tag, parent, rule, main, first
        self.has_main, self.last, self.made_of, self.hash, self.goes = False, first, [], None, False


def parse(page: str | None) -> tuple[list[str], list[Element]]:
    """The page's blocks in order, and its block-level elements, parents ahead of their children."""
    import xxhash

    page = page or ""
    root = Element("", None, STAYS, False, 0)
    blocks, elements, text, at, pos, open_ = [], [root], [], root, 0, Counter()

    def flush():
        if text:
            joined = "".join(text)
            text.clear()
            if block := " ".join(_html.unescape(joined).split() if "&" in joined else joined.split()):
                blocks.append(block)
                at.made_of.append(b"t" + xxhash.xxh64_digest(block.encode("utf-8", "replace")))

    def close(e: Element) -> Element:
        e.last = len(blocks)
        open_[e.tag] -= 1
        if e.made_of:
            hash_ = xxhash.xxh64(e.tag.encode())
            for part in e.made_of:
                hash_.update(part)
            e.hash, e.made_of = hash_.intdigest() - (1 << 63), None
            if e.parent is not None:
                e.parent.made_of.append(b"e" + (e.hash + (1 << 63)).to_bytes(8, "big"))
        if e.parent is not None:
            e.parent.has_main |= e.has_main or (e.tag in ("article", "main") and e.rule == STAYS and e.last > e.first)
        return e.parent

    while (m := _TAG.search(page, pos)) is not None:
        if m.start() > pos:
            text.append(page[pos : m.start()])
        pos = m.end()
        if (tag := m[2]) is None:
            continue
        tag = tag.lower()
        if tag in RAW or tag in CONTROLS:
            if not m[1] and not m[3].rstrip().endswith("/"):
                end = _ENDS[tag].search(page, pos)
                if end is None and (tag == "head" or tag in CONTROLS):
                    continue
                pos = len(page) if end is None else end.start()
        elif tag == "br":
            text.append(" ")
        elif tag in BLOCKS:
            flush()
            if m[1]:
                if open_[tag]:
                    while at.tag != tag:
                        at = close(at)
                    at = close(at)
                continue
            for ended in ENDED_BY.get(tag, ("p",)):
                if at.tag == ended:
                    at = close(at)
            if tag == "hr":
                continue
            at = Element(tag, at, _rule(tag, m[3], at.main), at.main or tag in ("article", "main"), len(blocks))
            open_[tag] += 1
            elements.append(at)
    text.append(page[pos:])
    flush()
    while at is not None:
        at = close(at)
    _apply_rules(blocks, elements)
    return blocks, elements


def _covered(elements, n: int) -> list[bool]:
    """Of n blocks, those that stand in one of the elements."""
    edges = [0] * (n + 1)
    for e in elements:
        edges[e.first] += 1
        edges[e.last] -= 1
    return [depth > 0 for depth in accumulate(edges[:-1])]


def _apply_rules(blocks: list[str], elements: list[Element]) -> None:
    """Set which elements go by the fixed rules, their own or those of an element around them."""
    sure = _covered((e for e in elements if e.rule == GOES), len(blocks))
    left = [0, *accumulate(0 if g else len(b) for b, g in zip(blocks, sure, strict=True))]
    for e in elements[1:]:
        most = 2 * (left[e.last] - left[e.first]) > left[-1]
        own = e.rule == GOES or (e.rule == UNLESS_ARTICLE and not e.has_main) or (e.rule == UNLESS_MOST and not e.has_main and not most)
        e.goes = own or e.parent.goes


def _may_be_template(e: Element) -> bool:
    return e.tag in CONTAINERS and e.hash is not None and not (e.goes or e.main or e.has_main)


def _scope(blocks: list[str], elements: list[Element], template: frozenset[int] = frozenset()) -> tuple[str | None, list[bool]]:
    """The tag of the elements that hold most of the text that the fixed rules and the template leave, None if the page has no such; and the blocks that go."""
    out = _covered((e for e in elements if e.goes or (e.hash in template and _may_be_template(e))), len(blocks))
    total = sum(len(b) for b, o in zip(blocks, out, strict=True) if not o)
    ruled = _covered((e for e in elements if e.goes), len(blocks))
    for tag in ("article", "main"):
        inside = _covered((e for e in elements if e.tag == tag and not e.goes), len(blocks))
        if 2 * sum(len(b) for b, i, o in zip(blocks, inside, out, strict=True) if i and not o) > total:
            return tag, [r or not i for r, i in zip(ruled, inside, strict=True)]
    return None, out


def subtrees(page: str | None) -> tuple[int, bool, list[int]]:
    """The hash of the page, whether a marked article holds most of its text, and the hashes of the subtrees that may be template."""
    blocks, elements = parse(page)
    return elements[0].hash or 0, _scope(blocks, elements)[0] is not None, sorted({e.hash for e in elements if _may_be_template(e)})


def main_text(page: str | None, template: frozenset[int] = frozenset()) -> str:
    """The page's main text without unwanted elements and the subtrees in ``template``.

    Where articles, or else main elements, hold most of what these leave, the text is what stands in them, and the template takes nothing out of it.
    """
    blocks, elements = parse(page)
    return "\n\n".join(b for b, gone in zip(blocks, _scope(blocks, elements, template)[1], strict=True) if not gone)


def _find_subtrees(batches):
    """For each page a row with its hash and, if its article isn't marked, its key; and one for each subtree that may be template."""
    for batch in batches:
        keys, hosts, pages, trees = [], [], [], []
        for key, host, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            digest, marked, own = subtrees(page)
            keys += [None if marked else key] * (len(own) + 1)
            hosts += [host] * (len(own) + 1)
            pages += [digest] * (len(own) + 1)
            trees += [None, *own]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(trees, pa.int64())], names=["key", "host", "page", "tree"])


@F.pandas_udf(T.StringType())
def _extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for pages, gone in batches:
        yield pd.Series([main_text(p if isinstance(p, str) else None, frozenset(g) if g is not None else frozenset()) for p, g in zip(pages, gone, strict=True)], dtype=object)


def template_of(found: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, tree): the subtrees of each host's template, from what ``_find_subtrees`` gives."""
    own = found.where("tree is not null").groupBy("host", "tree").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= min_pages)
    hosts = found.where("tree is null").groupBy("host").agg(F.count_distinct("page").alias("n_pages"))
    return own.join(hosts, "host").where(F.col("n") >= min_share * F.col("n_pages")).select("host", "tree")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """A row for each row of ``pages``: id_col, url_col, text."""
    url, page = F.coalesce(F.col(url_col), F.lit("")), F.coalesce(F.col(html_col), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("\n", url, page)))
    rows = pages.select(key.alias("key"), F.lower(F.regexp_extract(url, _HOST, 1)).alias("host"), page.alias("html"))
    found = stored(rows.mapInArrow(_find_subtrees, "key binary, host string, page long, tree long"), "subtrees")
    template = stored(template_of(found, min_pages, min_share), "template")  # the join below has plain sides then, so that a hot subtree is split
    gone = stored(found.where("key is not null").join(template, ["host", "tree"]).groupBy("key").agg(F.collect_set("tree").alias("gone")), "gone")
    docs = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), page.alias("__html"), key.alias("__key"))
    straight, maybe = apart(docs, F.col("__key"), gone.select("key"))
    plain = straight.withColumn("gone", F.array().cast("array<bigint>"))
    docs = plain.unionByName(maybe.join(gone, F.col("__key") == F.col("key"), "left").drop("key"))
    return docs.select(F.col("__id").alias(id_col), F.col("__url").alias(url_col), _extract("__html", "gone").alias("text"))
