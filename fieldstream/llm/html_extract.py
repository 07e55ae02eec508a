"""Main text of web pages by consensus paths of a host.

First pass: in each page, containers gain the lengths of their paragraphs, and
the best ones vote, by share, for their generalised tag-class path.  Votes are
summed per host and path, and with them how many pages a path leads and in how many it is among the best.  Second pass: a page is extracted again at the first of its host's
winning paths that holds enough.  A host may mix layouts: a path that leads most of the pages it is among the best of is one of them, and a page that such a path leads is only
read at a winning path that has half of its text.  A container that no other pages speak for needs eleven times the text of a winning path to be taken instead.

Words of a class that mark comments, adverts and the like only make an element a suspect: one
that holds most of the page's text together with its article or title stays and takes part in the vote.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldstream.llm.shared import in_parts, keep

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe math select object audio video canvas".split())
GONE = frozenset("head nav footer aside button dialog menu label".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = frozenset("article main section div td body".split())
PARAGRAPHS = frozenset("p pre blockquote li dd h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = "p"
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WALLS = frozenset("ul ol dl table div article section main body".split())
# Words of a class, id or role that mark what is no part of an article.
BOILERPLATE = frozenset(
    """ad ads advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert newsletter subscribe subscription
    share sharing social related recommended recommendations sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments discussion discussions disqus replies respond responses footer popup modal overlay
    login signup register search widget widgets pagination pager toolbar skip complementary contentinfo disclaimer masthead topbar""".split()
)
# Words beside them that speak of how a page looks, not of what an element holds.
QUALIFIERS = frozenset("has no not with without free open closed enabled disabled".split())
# Words of BOILERPLATE that mark what readers write; beside a qualifier they still do, unless the element holds most of the page's text.
READERS = frozenset("comment comments discussion discussions disqus replies respond responses".split())
#: Elements that mark an article.
MARKERS = frozenset("article main h1".split())
SITE = frozenset("site page global top main logo brand".split())
BONUS = {"article": 1.6, "main": 1.4, "body": 0.7}
#: Below this depth a path is a hash of its parent's and the element's own step.
DEEPEST = 40
#: Containers of a page that vote, and winning paths of a host that are tried.
VOTERS, WINNERS = 3, 3
#: The share of the own best container's text that the text at a winning path must have: where the own path is a layout of the host, and where it is none.
HALF, FAIR = 0.5, 0.09
#: Pages that a path must lead to be a layout of its host, and the layouts of a host that are kept beside the winning paths.
LEAST_LEADS, LAYOUTS = 3, 16
#: Parts that the rows of a host with many pages are dealt to; the share of all pages that makes a host such a one, so there are at most 1,000.
SALTS, MANY = 64, 0.001
#: Bytes of all hosts and paths up to which they are broadcast; beyond, pages and paths are joined by host.
BROADCAST_BYTES = 32 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NUMBER = re.compile(r"\d+")


class Page:
    """Elements in page order with parent, tag, path, end and place of their text; text pieces in page order with their element."""

    def __init__(self, source: str):
        self.tags, self.parents, self.paths, self.ends = ["#"], [0], [""], [0]
        self.first, self.last = [0], [0]  # pieces of the subtree
        self.gone, self.suspect, self.links, self.depth = [False], [False], [False], [0]
        self.qualified: set[int] = set()  # suspects by a word of readers beside a qualifier
        self.holder, self.inside = [0], [False]  # the container that holds the element, and whether a paragraph lies between
        self.pieces: list[tuple[int, str]] = []
        self._stack, self._open_at = [0], {}
        self._parse(source)
        self._judge()

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        up, k = stack[-1], len(self.tags)
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
        step = ".".join([tag, *sorted(NUMBER.sub("#", c.lower()) for c in found.get("class", "").split())])
        gone = self.gone[up] or tag in GONE or "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        suspect, qualified = tag == "form", False  # some sites wrap the whole page in a form
        if not gone and found and tag not in ("html", "body"):
            for token in f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}".split():
                words = {w.lower() for w in PART.findall(token)}
                if words & QUALIFIERS:
                    qualified = qualified or bool(words & READERS)
                else:
                    suspect = suspect or bool(words & BOILERPLATE)
        if tag == "header" and not gone:  # a site's; an article's own header has its title
            gone = self.tags[up] in ("#", "html", "body") or bool(SITE & {w.lower() for k in ("class", "id") for w in PART.findall(found.get(k, ""))})
        self.tags.append(tag)
        self.parents.append(up)
        deep = self.depth[up] + 1
        self.depth.append(deep)
        self.paths.append((self.paths[up] if deep <= DEEPEST else "~" + xxhash.xxh3_64_hexdigest(self.paths[up].encode("utf-8", "surrogatepass"))) + ">" + step)
        self.ends.append(k + 1)
        self.first.append(len(self.pieces))
        self.last.append(len(self.pieces))
        self.gone.append(gone)
        self.suspect.append(suspect or qualified)
        if qualified and not suspect:
            self.qualified.add(k)
        self.links.append(self.links[up] or tag == "a")
        own = tag in CONTAINERS
        self.holder.append(k if own else self.holder[up])
        self.inside.append(not own and (self.inside[up] or tag in PARAGRAPHS))
        if tag not in VOID:
            self._open_at.setdefault(tag, []).append(len(stack))
            stack.append(k)

    def _close(self, down_to: int) -> None:
        stack = self._stack
        while len(stack) > down_to:
            k = stack.pop()
            self.ends[k], self.last[k] = len(self.tags), len(self.pieces)
            if k:
                self._open_at[self.tags[k]].pop()

    def _highest(self, tags) -> int:
        """Place on the stack of the innermost open element with one of these tags; 0 without one."""
        return max((at[-1] for t in tags if (at := self._open_at.get(t))), default=0)

    def _parse(self, source: str) -> None:
        stack, at, last = self._stack, 0, source.rfind(">")
        while at < len(source):
            m = TOKEN.search(source, at) if at <= last else None  # behind the last ">" nothing can be a tag
            text = source[at : m.start() if m else len(source)]
            if text:
                self.pieces.append((stack[-1], text))
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            block = tag not in INLINE
            if m[1]:
                if place := self._highest((tag,)):
                    if block:
                        self.pieces.append((stack[-1], "\n"))
                    self._close(place)
                continue
            if block:
                self.pieces.append((stack[-1], "\n"))
                # a block ends an open paragraph; an item ends its sibling
                enders = SAME.get(tag, set()) | ({CLOSED_BY_BLOCK} if tag not in VOID or tag == "hr" else set())
                place = self._highest(enders)
                if place and place >= self._highest(WALLS):
                    self._close(place)
            self._open(tag, m[3])
            if tag in RAW and not m[3].endswith("/"):  # what it holds isn't markup of the page
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
                at = end.end() if end else len(source)
                self._close(len(stack) - 1)
        self._close(0)

    def _judge(self) -> None:
        """Suspects go, but for one that holds most of the page's text and its article or title, or nearly all of the text; with a qualifier, most is enough."""
        if any(self.suspect):
            weight, marks = [0], [0]
            for e, t in self.pieces:
                weight.append(weight[-1] + (0 if self.gone[e] or self.links[e] else len(t.strip())))
            for tag, gone, suspect in zip(self.tags, self.gone, self.suspect, strict=True):
                marks.append(marks[-1] + (tag in MARKERS and not gone and not suspect))
            for k in range(1, len(self.tags)):
                if self.suspect[k]:
                    own = weight[self.last[k]] - weight[self.first[k]]
                    marked = self.tags[k] in MARKERS or marks[self.ends[k]] > marks[k]
                    self.suspect[k] = not (2 * own > weight[-1] and (marked or k in self.qualified or 10 * own >= 9 * weight[-1]))
        for k in range(1, len(self.tags)):
            self.gone[k] = self.gone[k] or self.suspect[k] or self.gone[self.parents[k]]

    def text(self, k: int) -> str:
        """Text of the subtree of element k without what is no part of an article."""
        parts = [html.unescape(t) if "&" in t else t for e, t in self.pieces[self.first[k] : self.last[k]] if not self.gone[e]]
        return " ".join("".join(parts).split())

    def scores(self) -> dict[int, float]:
        """Containers: the lengths of paragraphs directly in them, half of those one level deeper, less link text."""
        weight: dict[int, float] = {}
        for e, t in self.pieces:
            n = len(t.strip())
            if not n or self.gone[e]:
                continue
            n = -n if self.links[e] else n
            share = 1.0 if self.inside[e] else 0.3
            e = self.holder[e]
            for _ in range(3):
                if not e:
                    break
                weight[e] = weight.get(e, 0.0) + share * n
                e, share = self.holder[self.parents[e]], share / 2
        return {k: w * BONUS.get(self.tags[k], 1.0) for k, w in weight.items() if w > 0}

    def best(self) -> int:
        """The container with the highest score, the outer of equals; without any, the whole page."""
        found = self.scores()
        return max(found, key=lambda k: (found[k], -k)) if found else 0

    def at_path(self, path: str) -> str:
        """Text at all elements with this path that don't lie in one another."""
        out, end = [], 0
        for k, p in enumerate(self.paths):
            if k >= end and p == path and k:
                out.append(self.text(k))
                end = self.ends[k]
        return " ".join(filter(None, out))

    def extract(self, paths: list[str] | None, layouts: list[str] | None = None) -> str:
        """Text at the first winning path that holds enough of the own best container's, else at the own path, if that is a layout, or in the container."""
        best = self.best()
        own, path = self.text(best), self.paths[best]
        known = path in (paths or ()) or path in (layouts or ())
        for other in paths or ():
            found = self.at_path(other)
            if found and len(found) >= (HALF if known else FAIR) * len(own):
                return found
        return self.at_path(path) if known else own


def votes(source: str) -> list[tuple[str, float]]:
    """(path, share) of a page's best containers, the best one first."""
    page = Page(source)
    found = page.scores()
    top = sorted(found, key=lambda k: (-found[k], k))[:VOTERS]
    total = sum(found[k] for k in top)
    by_path: dict[str, float] = {}
    for k in top:
        by_path[page.paths[k]] = by_path.get(page.paths[k], 0.0) + found[k] / total
    return list(by_path.items())


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches, "html"):
        tally: dict[tuple[str, str], list] = {}
        for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for place, (path, share) in enumerate(votes(source)):
                row = tally.setdefault((host, path), [0.0, 0, 0])
                row[0], row[1], row[2] = row[0] + share, row[1] + (place == 0), row[2] + 1
        # hundredths, so that sums don't depend on their order
        numbers = [pa.array(v, pa.int64()) for v in ([round(100 * r[0]) for r in tally.values()], [r[1] for r in tally.values()], [r[2] for r in tally.values()])]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in tally], pa.string()), pa.array([p for _, p in tally], pa.string()), *numbers], names=["host", "path", "votes", "leads", "seen"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in in_parts(batches, "html"):
        texts = [Page(s).extract(p, more) for s, p, more in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def host_of(url: Column) -> Column:
    """Host in lower case, without user and port; null where the url has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, paths, layouts): the path with the most votes of each host and others with at least half as many, and further paths that lead most of the pages they are among the best of, by the pages they lead; ties go to the smaller path."""
    rows = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).where("host is not null")
    sums = [F.sum(c).alias(c) for c in ("votes", "leads", "seen")]
    tally = rows.mapInArrow(_vote, "host string, path string, votes long, leads long, seen long").groupBy("host", "path").agg(*sums)
    layout = F.when((F.col("leads") >= LEAST_LEADS) & (2 * F.col("leads") >= F.col("seen")), F.col("leads"))

    def first_of(rows: DataFrame, *part: str) -> DataFrame:
        """The first rows by votes, and those by leads."""
        of = Window.partitionBy(*part)
        ranks = rows.withColumn("n", F.row_number().over(of.orderBy(F.desc("votes"), "path"))).withColumn("m", F.row_number().over(of.orderBy(F.desc_nulls_last("layout"), "path")))
        return ranks.where((F.col("n") <= WINNERS) | F.col("layout").isNotNull() & (F.col("m") <= WINNERS + LAYOUTS))

    # a host may have as many paths as pages, so the first of each part come first
    parts = first_of(tally.withColumn("layout", layout).withColumn("part", F.pmod(F.xxhash64("path"), F.lit(SALTS))), "host", "part")
    top = first_of(parts, "host").withColumn("wins", (F.col("n") <= WINNERS) & (2 * F.col("votes") >= F.max("votes").over(Window.partitionBy("host"))))
    listed = lambda of, by: F.transform(F.array_sort(F.collect_list(F.when(of, F.struct(by, "path")))), lambda x: x.path)
    return top.groupBy("host").agg(listed(F.col("wins"), "n").alias("paths"), listed(~F.col("wins") & F.col("layout").isNotNull(), "m").alias("layouts"))


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text ("" if none), n_chars.

    A null html is empty.  A page without a host, or without enough text at its host's
    paths, gives the text of its own best container or its layout.  Very long and very deep pages are read whole, in time that grows with their length.  Rows that repeat
    give equal rows; an empty table gives no rows; other columns are not read.
    The paths are broadcast if all of them, as counted, take ``broadcast_bytes`` at most, and pages are not shuffled.
    Else pages meet their host's paths in a join that deals hosts with many pages to ``salts`` parts.
    """
    paths = keep(host_paths(pages), "paths")
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    size = paths.agg(F.sum(F.octet_length("host") + F.octet_length(F.array_join("paths", "")) + F.octet_length(F.array_join("layouts", "")) + 100)).first()[0] or 0
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:
        per_host = keep(rows.groupBy("host").count(), "hosts")
        every = per_host.agg(F.sum("count")).first()[0] or 0
        many = F.broadcast(per_host.where((F.col("count") >= MANY * every) & F.col("host").isNotNull()).select("host", F.lit(True).alias("many")))
        salt = F.when(F.col("many") | F.col("host").isNull(), F.pmod(F.xxhash64("page_id", "url"), F.lit(salts))).otherwise(0).cast("int")
        dealt = rows.join(many, "host", "left").withColumn("salt", salt).withColumn("host", F.coalesce("host", F.lit("")))
        spread = F.when(F.col("many"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        joined = dealt.join(paths.join(many, "host", "left").withColumn("salt", F.explode(spread)).select("host", "salt", "paths", "layouts").hint("merge"), ["host", "salt"], "left")
    return joined.select("page_id", "url", "html", "paths", "layouts").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
