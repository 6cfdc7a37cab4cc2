"""Main text of web pages by removal of site templates.

Every block element's subtree is hashed (tag, class, text and children) together with its place,
the path of tags and classes from the root. Spark counts, per host, on how many pages of different
main content each subtree stands: copies of a page count once, so a page with many copies doesn't
make its own text a template. A subtree that recurs on many pages is deleted if recurrence is the
rule at its place (most of what stands there recurs) or if it stands on most of the host's pages;
where recurrence is the exception, it is a passage that documents share, and stays.

An article's mark only breaks ties: inside a marked article just the second ground counts, and
what templates leave standing outside it goes too, as do elements that are furniture by their tag,
class, id or role; hosts with too few pages to count have nothing else to go by.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: A subtree recurs if it stands on so many pages of different content, in number and as a share of
#: the host's pages. The share bounds how many a host can have: 500 for each place of a page.
LEAST_PAGES, LEAST_SHARE = 5, 0.002
#: Of what stands at a place, the share that recurs where recurrence is the rule.
RULE = 0.5
#: Pages that a template inside a marked article stands on at least, and the share of the host's
#: pages that makes any subtree a template.
LEAST_INSIDE, MOST_PAGES = 10, 0.6
#: Hashes that are broadcast at most (32 MB); with more, pages are joined by host and salt. A host
#: with more than one in HOT_HOSTS of all rows is hot, so there are at most as many.
BROADCAST_HASHES, HOT_HOSTS, SALTS = 4_000_000, 1_000, 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that a start tag of the key ends, if open inside the nearest of SCOPE.
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div dl fieldset footer form header html li main nav ol section table td th ul".split())
FURNITURE_TAGS = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg canvas object embed audio video dialog menu".split())
#: Whole class tokens and ids of furniture outside the main articles, and those that are furniture inside them too.
FURNITURE_NAMES = frozenset("ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer menu modal navbar navigation newsletter notice notices pagination popup promo promotion related replies reply share sharing sidebar social sponsor sponsored subscribe toolbar widget site-header site-footer cookie-banner ad-banner comment-list comments-area related-posts share-buttons".split())
INSIDE_NAMES = frozenset("ad ads advert advertisement advertisements adverts sponsored ad-banner cookie-banner comments comment-list comments-area disqus".split())
#: Elements in which an article is none of the page's main ones: comments, cards, teasers.
ASIDES = frozenset("aside nav footer header dialog menu template".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())

_tag = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_stop = re.compile("[>\"']")
_attribute = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_digits = re.compile("[0-9]+")
_raw_end = {name: re.compile(f"</{name}(?![^\\s/>])", re.I) for name in RAW}


class Page:
    """A page's elements and its events in order: (element, None) begins, (-1, element) ends, (-2, text).

    The page is read once from start to end, whatever stands in it: what is searched for and not
    found is not searched for again, and the open elements are kept by tag.
    """

    def __init__(self, html: str):
        self.tags, self.parents, self.marks, self.events = [], [], [], []
        self._stack: list[int] = []
        self._open: dict[str, list[int]] = {}  # places in the stack by tag
        self._scopes: list[int] = []
        self._missing: set[str] = set()  # quotes of which there are no more
        at, n, events = 0, len(html), self.events
        while at < n:
            begin = html.find("<", at)
            if begin < 0:
                begin = n
            if begin > at:
                events.append((-2, html[at:begin]))
            if begin == n:
                break
            m = _tag.match(html, begin)
            if m is None:
                at = self._skip(html, begin)
                continue
            name = m[1].lower()
            close = self._tag_end(html, m.end())
            if html[begin + 1] == "/":
                at = close + 1
                if places := self._open.get(name):
                    self._pop(places[-1])
                continue
            if close == n:  # a tag that the page ends in
                break
            at = self._start(name, html[m.end() : close], html, close + 1)
        self._pop(0)

    @staticmethod
    def _past(html: str, what: str, at: int) -> int:
        found = html.find(what, at)
        return len(html) if found < 0 else found + len(what)

    def _skip(self, html: str, at: int) -> int:
        """The end of a comment or declaration at `at`; a lone < is text."""
        if html.startswith("<!--", at):
            return self._past(html, "-->", at + 4)
        if html[at + 1 : at + 2] in ("!", "?", "/"):
            return self._past(html, ">", at)
        self.events.append((-2, "<"))
        return at + 1

    def _tag_end(self, html: str, at: int) -> int:
        """The place of the > that ends a tag, outside of quoted values; the page's end without one."""
        while m := _stop.search(html, at):
            quote, at = m[0], m.end()
            if quote == ">":
                return m.start()
            if quote not in self._missing and html[m.start() - 1 : m.start()] in ("=", " ", "\n", "\t"):
                end = html.find(quote, at)
                if end < 0:
                    self._missing.add(quote)
                else:
                    at = end + 1
        return len(html)

    def _start(self, name: str, attributes: str, html: str, at: int) -> int:
        """Open an element; returns where reading goes on."""
        self._imply(name)
        node = len(self.tags)
        self.tags.append(name)
        self.parents.append(self._stack[-1] if self._stack else -1)
        self.marks.append({k.lower(): a or b or c for k, a, b, c in _attribute.findall(attributes)} if attributes else {})
        self.events.append((node, None))
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            self.events.append((-1, node))
        elif name in RAW:
            end = _raw_end[name].search(html, at)
            at = self._past(html, ">", end.start()) if end else len(html)
            self.events.append((-1, node))
        else:
            self._open.setdefault(name, []).append(len(self._stack))
            if name in SCOPE:
                self._scopes.append(len(self._stack))
            self._stack.append(node)
        return at

    def _pop(self, place: int) -> None:
        """End the open elements from `place` in the stack on."""
        while len(self._stack) > place:
            node = self._stack.pop()
            self._open[self.tags[node]].pop()
            if self._scopes and self._scopes[-1] == len(self._stack):
                self._scopes.pop()
            self.events.append((-1, node))

    def _imply(self, name: str) -> None:
        """End the elements that the start tag ends: a block ends a paragraph, an item an item."""
        ends = ENDS.get(name) or ({"p"} if name in BLOCKS else ())
        place = max((self._open[e][-1] for e in ends if self._open.get(e)), default=-1)
        if place >= 0 and place >= (self._scopes[-1] if self._scopes else -1):
            self._pop(place)

    def articles(self) -> set[int]:
        """Elements that hold the main content: marked article, else main, else none.

        An article inside another, or inside what is beside the main content (comments, sidebars,
        headers, footers), isn't one of them; nor is one in a list, unless all are.
        """
        for tags, role in (({"article"}, "article"), ({"main"}, "main")):
            beside: list[bool] = []
            listed: list[bool] = []
            found: dict[int, bool] = {}
            for i, (tag, parent) in enumerate(zip(self.tags, self.parents)):
                marked = tag in tags or self.marks[i].get("role") == role
                out = parent >= 0 and beside[parent] or self._named(i, FURNITURE_NAMES)
                if marked and not out:
                    found[i] = parent >= 0 and listed[parent]
                beside.append(out or marked or tag in ASIDES)
                listed.append(tag in ("li", "ul", "ol") or parent >= 0 and listed[parent])
            if found:
                return {i for i, in_list in found.items() if not in_list} or set(found)
        return set()

    def _named(self, node: int, names: frozenset[str]) -> bool:
        """Whether a class token, the id or the role of an element is one of furniture; the page as a whole is none."""
        marks = self.marks[node]
        if not marks or self.tags[node] in ("html", "body"):
            return False
        words = [*marks.get("class", "").lower().split(), marks.get("id", "").lower()]
        return marks.get("role") in FURNITURE_ROLES or not names.isdisjoint(words)

    def furniture(self, articles: set[int]) -> set[int]:
        """Elements that are furniture by themselves; a form around a main article isn't."""
        holds = set()
        for a in articles:
            while a >= 0 and a not in holds:
                holds.add(a)
                a = self.parents[a]
        inside = self._inside(articles)
        names = (FURNITURE_NAMES, INSIDE_NAMES)
        return {i for i, t in enumerate(self.tags) if i not in holds and (t in FURNITURE_TAGS or t == "header" and not inside[i] or self._named(i, names[inside[i]]))}

    def _inside(self, articles: set[int]) -> list[bool]:
        inside: list[bool] = []
        for i, parent in enumerate(self.parents):
            inside.append(i in articles or parent >= 0 and inside[parent])
        return inside

    def places(self) -> list[int]:
        """A hash of each element's path of tags and classes, without digits, from the root."""
        import xxhash

        out: list[int] = []
        for tag, parent, marks in zip(self.tags, self.parents, self.marks):
            out.append(xxhash.xxh64_intdigest(f"{out[parent] if parent >= 0 else ''}/{tag}.{_digits.sub('', marks.get('class', ''))}") - (1 << 63))
        return out

    def subtrees(self) -> dict[int, tuple[int, int]]:
        """(place, hash of place and subtree) of each block element that has text."""
        import xxhash

        parts: list[list[str]] = []
        places, out = self.places(), {}
        for kind, value in self.events:
            if kind >= 0:
                parts.append([])
            elif kind == -2:
                if parts and (text := " ".join(value.split())):
                    parts[-1].append(text)
            else:
                own = parts.pop()
                if own:
                    h = xxhash.xxh64_intdigest("\0".join([self.tags[value], self.marks[value].get("class", ""), *own]))
                    if self.tags[value] in BLOCKS:
                        out[value] = places[value], xxhash.xxh64_intdigest(f"{places[value]} {h}") - (1 << 63)
                    if parts:
                        parts[-1].append(str(h))
        return out

    def text(self, drop: set[int], only: set[int]) -> str:
        """Blocks outside the elements of `drop`, and inside those of `only` if there are any."""
        blocks: list[str] = []
        line: list[str] = []
        dropped = within = 0

        def flush() -> None:
            if line:
                if text := " ".join(unescape("".join(line)).split()):
                    blocks.append(text)
                line.clear()

        for kind, value in self.events:
            if kind == -2:
                if not dropped and (within or not only):
                    line.append(value)
                continue
            node = kind if kind >= 0 else value
            tag, step = self.tags[node], 1 if kind >= 0 else -1
            if tag in BLOCKS or node in drop or node in only:
                flush()
            elif tag == "br":
                line.append(" ")
            dropped += step * (node in drop)
            within += step * (node in only)
        flush()
        return "\n".join(blocks)


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def subtree_counts(pages: DataFrame) -> DataFrame:
    """(host, inside, place, hash, pages): on how many pages of different content each subtree stands.

    `hash` 0 counts the host's pages of different content.
    """
    import xxhash  # noqa: F401  workers need it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            seen: set = set()
            for host, html in zip(b.column(0).to_pylist(), b.column(1)):
                page = Page(html.as_py() or "")
                articles = page.articles()
                content = xxhash.xxh64_intdigest(page.text(page.furniture(articles), articles)) - (1 << 63)
                inside = page._inside(articles)
                seen.add((host, False, 0, 0, content))
                seen.update((host, inside[i], place, h, content) for i, (place, h) in page.subtrees().items() if i not in articles and page.tags[i] not in ("html", "body"))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*seen) if seen else [[]] * 5, kinds)], names=["host", "inside", "place", "hash", "content"])

    picked = pages.select(F.xxhash64(_host()).alias("host"), F.col("html").cast("string").alias("html"))
    rows = picked.mapInArrow(run, "host long, inside boolean, place long, hash long, content long").distinct()
    return rows.groupBy("host", "inside", "place", "hash").agg(F.count("*").alias("pages"))


def templates(pages: DataFrame, least: int = LEAST_PAGES, rule: float = RULE, least_inside: int = LEAST_INSIDE, most: float = MOST_PAGES) -> DataFrame:
    """(host, hashes): the subtrees to delete, one row a host.

    Each of them stands on LEAST_SHARE of the host's pages at least, so a host's list is bounded,
    however many pages it has.
    """
    counts = materialize(subtree_counts(pages), "subtrees")
    hosts = counts.where("hash = 0").select("host", F.col("pages").alias("all_pages"))
    often = counts.where("hash <> 0").where(F.col("pages") >= least)
    # a place's shares need its totals only; what recurs is few rows beside them
    totals = counts.where("hash <> 0").groupBy("host", "place").agg(F.sum("pages").alias("total"), F.sum(F.when(F.col("pages") >= least, F.col("pages")).otherwise(0)).alias("recurring"))
    often = often.join(totals.where("recurring > 0"), ["host", "place"]).join(hosts, "host")
    everywhere = F.col("pages") >= most * F.col("all_pages")
    rule_there = F.col("recurring") >= rule * F.col("total")
    enough = (F.col("pages") >= LEAST_SHARE * F.col("all_pages")) & F.when(F.col("inside"), everywhere & (F.col("pages") >= least_inside)).otherwise(everywhere | rule_there)
    return often.where(enough).groupBy("host").agg(F.collect_set("hash").alias("hashes"))


def _with_templates(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """`keyed` with its host's `hashes`; a hot host's pages are dealt over salts if html must move."""
    if (found.agg(F.sum(F.size("hashes"))).first()[0] or 0) <= BROADCAST_HASHES:
        return keyed.join(F.broadcast(found), "host", "left")
    rows = materialize(keyed.groupBy("host").agg(F.count("*").alias("rows")), "host-rows")
    hot = [r.host for r in rows.where(F.col("rows") * HOT_HOSTS > rows.agg(F.sum("rows")).first()[0]).select("host").collect()]
    salts = lambda n: F.when(F.col("host").isin(hot), n).otherwise(F.lit(0))
    keyed = keyed.withColumn("salt", salts(F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(F.lit(SALTS - 1)))))
    return keyed.join(found.hint("shuffle_hash"), ["host", "salt"], "left")


def main_text(pages: DataFrame, **options) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars, n_templates.

    `n_templates` counts the subtrees with text that were deleted as templates. Null and empty html
    give an empty text; a null url is a host of its own. Repeated rows and null page_ids are kept;
    other columns are ignored; an empty table gives no rows. Subtrees are counted before this
    returns.
    """
    found = materialize(templates(pages, **options), "templates")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), F.xxhash64(_host()).alias("host"))
    keyed = _with_templates(keyed, found).select("page_id", "url", "html", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, deleted = [], []
            for html, hashes in zip(b.column(2), b.column(3)):
                page = Page(html.as_py() or "")
                articles = page.articles()
                hashes = set(hashes.as_py() or ())
                drop = {i for i, (_, h) in page.subtrees().items() if i not in articles and h in hashes} if hashes else set()
                deleted.append(len(drop))
                texts.append(page.text(drop | page.furniture(articles), articles))
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(deleted, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_templates"])

    return keyed.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_templates long")
