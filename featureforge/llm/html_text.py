"""Main text of web pages by consensus of the paths of a host.

Every page's containers are scored by the text in the blocks below them, less
what is linked, fading with the distance. The best container's generalised
path (tags and classes of the nearest levels, digits masked) is the page's
vote. Votes are counted per host in Spark; the host's winning path is then used
to extract each of its pages again. A page without that path keeps its own best.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are told by their tags and by words of their class or id.

Defined results: null or empty html, and pages without text, give an empty
text; a null or odd url is the host ''; ties of scores go to the outer
container, ties of votes to the smaller path; repeated rows are returned each;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from featureforge.staging import stage

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of an article.
DROPPED = frozenset(
    "head title script style noscript template iframe object svg math canvas nav footer aside form button select textarea "
    "dialog menu audio video map".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article main section div td body blockquote center".split())
#: Words of classes and ids that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted related replies respond "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split())
#: An opening tag closes an open element of the second set, up to an element of the third.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol"})), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})), "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
FADE, LEVELS = 0.85, 6
#: Distances beyond this add nothing that counts to a score (0.85 ** 60 is 6e-5).
FAR = 60


def step_of(tag: str, attributes: dict[str, str | None]) -> str:
    classes = sorted({re.sub(r"\d+", "#", c) for c in (attributes.get("class") or "").lower().split()})
    return ".".join([tag, *classes])


def is_marked(attributes: dict[str, str | None]) -> bool:
    names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower()
    return (attributes.get("role") or "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search") or not MARKS.isdisjoint(re.split(r"[^a-z]+", names))


class Page(HTMLParser):
    """Blocks of a page; with ``wanted``, only those inside a container of that path."""

    def __init__(self, wanted: str | None = None):
        super().__init__(convert_charrefs=True)
        self.wanted, self.texts = wanted, []
        self.open: list[tuple[str, str, bool, int]] = []  # tag, path, dropped, container
        self.paths: list[str] = []
        self.scores: list[float] = []
        self.chain: list[int] = []
        self.inside = self.dropped = self.links = self.articles = 0
        self.run: list[str] = []
        self.linked = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        end = self.rawdata.find(">", i)
        return -1 if end < 0 else end + 1

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        if text:
            if self.wanted is None:
                weight = len(text) - 2 * min(self.linked, len(text))
                for far, c in enumerate(reversed(self.chain[-FAR:])):
                    self.scores[c] += weight * FADE**far
            elif self.inside:
                self.texts.append(text)
        self.run, self.linked = [], 0

    def pop(self) -> None:
        tag, path, dropped, container = self.open.pop()
        if tag in BLOCKS:
            self.flush()
        self.dropped -= dropped
        self.links -= tag == "a"
        self.articles -= tag in ("article", "main")
        if container >= 0:
            self.chain.pop()
        self.inside -= path == self.wanted and tag in CONTAINERS

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.run.append(" ")
            return
        if tag in BLOCKS:
            self.flush()
            if any(o[0] == "p" for o in self.open[-8:]):
                self.close("p", CONTAINERS)
        if tag in VOID:
            return
        if tag in CLOSES:
            closed, scope = CLOSES[tag]
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] in closed or self.open[i][0] in scope), -1)
            if at >= 0 and self.open[at][0] in closed:
                self.close_tag(at)
        attributes = dict(attrs)
        above = self.open[-1][1] if self.open else ""
        path = ">".join([*above.split(">")[-(LEVELS - 1):], step_of(tag, attributes)]) if above else step_of(tag, attributes)
        dropped = tag in DROPPED or tag == "header" and not self.articles or tag not in ("html", "body", "article", "main") and is_marked(attributes)
        container = -1
        if tag in CONTAINERS and not (dropped or self.dropped):
            container = len(self.paths)
            self.paths.append(path)
            self.scores.append(0.0)
            self.chain.append(container)
        self.open.append((tag, path, dropped, container))
        self.dropped += dropped
        self.links += tag == "a"
        self.articles += tag in ("article", "main")
        self.inside += path == self.wanted and tag in CONTAINERS

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def close_tag(self, at: int) -> None:
        while len(self.open) > at:
            self.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), -1)
        if at >= 0:
            self.close_tag(at)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.run.append(data)
            if self.links:
                self.linked += len(data)

    def read(self, html: str) -> Page:
        self.feed(html)
        HTMLParser.close(self)
        self.close_tag(0)
        self.flush()
        return self

    def close(self, tag: str | None = None, scope: frozenset = frozenset()) -> None:
        """Close an open element inside its scope."""
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag or self.open[i][0] in scope), -1)
        if at >= 0 and self.open[at][0] == tag:
            self.close_tag(at)

    def best(self) -> str:
        """Path of the best container; articles count a quarter more."""
        if not self.paths:
            return ""
        weighed = [s * (1.25 if re.search(r"(^|>)(article|main)[^>]*$", p) else 1.0) for s, p in zip(self.scores, self.paths)]
        top = max(weighed)
        return self.paths[weighed.index(top)] if top > 0 else ""


def vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html) to (host, path): each page's vote."""
    for batch in batches:
        paths = [Page().read(html).best() if html else "" for html in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.string())], ["host", "path"])


def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, path, html) to (page_id, url, path, text)."""
    for batch in batches:
        used, texts = [], []
        for path, html in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            blocks = Page(path).read(html).texts if html and path else []
            if html and not blocks:
                path = Page().read(html).best()
                blocks = Page(path).read(html).texts if path else []
            used.append(path or "")
            texts.append("\n\n".join(blocks))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(used, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "path", "text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, path, text)``, one row per page."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    votes = rows.select("host", "html").mapInArrow(vote_rows, "host string, path string")
    counts = votes.where(F.col("path") != "").groupBy("host", "path").agg(F.count("*").alias("votes"))
    winners = stage(counts.groupBy("host").agg(F.min(F.struct(-F.col("votes"), F.col("path")))["path"].alias("path")), "winners")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.join(winners, "host", "left").select("page_id", "url", "path", "html").mapInArrow(
        text_rows, f"page_id {kinds['page_id']}, url {kinds['url']}, path string, text string")
