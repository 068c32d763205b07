"""Article pages and feeds: parsers that name candidates, and columns that choose among them.

A page is read once by the standard library's parser, which writes down what
might be a field: (field, rank, value), the rank saying where it stood. What a
field becomes is then a rule over that array in the JVM: the best rank for most,
the longest text for the body.
"""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC
from email.utils import parsedate_to_datetime
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions.text import cleaned as clean
from newsloom.plans.durable import checkpointed
from newsloom.plans.joins import top_per

# Where a field may stand, best rank first.
LINKED = {"headline": ("title", 0), "description": ("lead", 0), "articleBody": ("body", 0), "datePublished": ("published_at", 0), "image": ("image_url", 0), "keywords": ("keyword", 0)}
META = {"og:title": ("title", 2), "description": ("lead", 1), "og:image": ("image_url", 1), "twitter:image": ("image_url", 2), "keywords": ("keyword", 1)}
ARTICLE_TYPES = {"NewsArticle", "Article"}
LEAST_BLOCK, MOST_KEYWORDS, KEYWORD_CHARS = 20, 12, 64

CANDIDATES = pa.list_(pa.struct([("field", pa.string()), ("rank", pa.int32()), ("at", pa.int32()), ("value", pa.string())]))


def strings(x) -> Iterator[str]:
    """The texts in a value of linked data, whatever its shape: of a node, that of its address."""
    if isinstance(x, str):
        yield x
    elif isinstance(x, list):
        for y in x:
            yield from strings(y)
    elif isinstance(x, dict):
        yield from strings(x.get("url"))


def nodes(x) -> Iterator[dict]:
    """The nodes of linked data, those of its graphs behind those that stand alone."""
    level = [x]
    while level:
        flat = [z for y in level for z in (y if isinstance(y, list) else [y]) if isinstance(z, dict)]
        yield from flat
        level = [z["@graph"] for z in flat if isinstance(z.get("@graph"), list)]


class Reader(HTMLParser):
    """Names the candidates of a page as it goes by."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.found, self.links = base, [], 0
        self.depth = 0  # of article elements
        self.sinks: list[tuple[str, str, list[str]]] = []  # (tag, what becomes of its text, the text)
        self.article = None

    def name(self, field: str, rank: int, value: str) -> None:
        value = clean(value)
        if field == "keyword":
            value = value[:KEYWORD_CHARS]
        if field == "image_url" and value:
            value = urljoin(self.base, value)
        if value:
            self.found.append((field, rank, len(self.found), value))

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "a":
            self.links += bool(a.get("href"))
        elif tag == "meta":
            field, rank = META.get(a.get("property") or a.get("name"), ("", 0))
            for value in a.get("content", "").split(",") if field == "keyword" else [a.get("content", "")] * bool(field):
                self.name(field, rank, value)
        elif tag in ("script", "style"):
            self.sinks.append((tag, "linked" if a.get("type") == "application/ld+json" else "", []))
        elif tag in ("p", "h1"):
            self.drain("p", "h1")
            self.sinks.append((tag, "block" if tag == "p" else "title", []))
        self.depth += tag == "article"

    def handle_data(self, data):
        if self.sinks:
            self.sinks[-1][2].append(data)

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "script", "style"):
            self.drain(tag)
        elif tag in ("div", "article", "body"):
            self.drain("p", "h1")
        self.depth = max(0, self.depth - (tag == "article"))

    def drain(self, *tags: str) -> None:
        """What has been gathered under the innermost of ``tags``, if that is what is open."""
        if not self.sinks or self.sinks[-1][0] not in tags:
            return
        _, what, text = self.sinks.pop()
        if what == "linked":
            self.linked("".join(text))
        elif what == "title":
            self.name("title", 1, "".join(text))
        elif what == "block" and len(clean("".join(text))) > LEAST_BLOCK:
            self.name("block", 0 if self.depth else 1, "".join(text))

    def linked(self, text: str) -> None:
        try:
            article = next((n for n in nodes(json.loads(text)) if n.get("@type") in ARTICLE_TYPES), None)
        except ValueError:
            return
        if article is None or self.article is not None:
            return
        self.article = article
        for key, (field, rank) in LINKED.items():
            for value in strings(article.get(key)):
                for part in value.split(",") if field == "keyword" and isinstance(article[key], str) else [value]:
                    self.name(field, rank, part)


def read_page(text: str | None, url: str | None) -> tuple[list[dict], int]:
    """The candidates of a page, and how many links it has."""
    reader = Reader(url or "")
    reader.feed(text or "")
    reader.close()
    while reader.sinks:
        before = len(reader.sinks)
        reader.drain("p", "h1", "script", "style")
        if len(reader.sinks) == before:
            break
    return [dict(zip(("field", "rank", "at", "value"), x, strict=True)) for x in reader.found], reader.links


def candidates(pages: DataFrame) -> DataFrame:
    """(page_id, found, n_links): what each page of (page_id, url, html) offers."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                read = [read_page(t, u) for u, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f for f, _ in read], CANDIDATES), pa.array([n for _, n in read], pa.int64())], names=["page_id", "found", "n_links"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, found array<struct<field:string,rank:int,at:int,value:string>>, n_links long")


def _of(found: Column, field: str) -> Column:
    return F.filter(found, lambda x: x["field"] == field)


def _best(found: Column, field: str) -> Column:
    """The value of the best rank, the first of them."""
    return F.coalesce(F.array_min(F.transform(_of(found, field), lambda x: F.struct(x["rank"], x["at"], x["value"])))["value"], F.lit(""))


def _level(found: Column, field: str) -> Column:
    """All values of the best rank that has any, in order."""
    own = _of(found, field)
    least = F.array_min(F.transform(own, lambda x: x["rank"]))
    return F.transform(F.filter(own, lambda x: x["rank"] == least), lambda x: x["value"])


def choose(found: DataFrame) -> DataFrame:
    """A page's fields from its candidates. The longer body wins, linked data on a tie; the tier says which."""
    c = F.col("found")
    linked, blocks = _best(c, "body"), F.array_join(_level(c, "block"), "\n")
    own = F.length(linked) >= F.length(blocks)
    return found.select(
        "page_id",
        *[_best(c, f).alias(f) for f in ("title", "lead")],
        F.when(own, linked).otherwise(blocks).alias("content"),
        F.when(own, "jsonld").otherwise("css").alias("extraction_tier"),
        *[_best(c, f).alias(f) for f in ("published_at", "image_url")],
        F.slice(F.array_distinct(_level(c, "keyword")), 1, MOST_KEYWORDS).alias("keywords"),
        "n_links",
    )


def extract(pages: DataFrame) -> DataFrame:
    """S08 to S10 over a table of pages (page_id, url, html)."""
    return choose(candidates(pages))


# The elements of a feed's item, by local name, and the field and rank of each.
ITEM = {"title": ("title", 0), "description": ("lead", 0), "summary": ("lead", 1), "encoded": ("content", 0), "content": ("content", 1), "pubDate": ("published_at", 0), "published": ("published_at", 1), "updated": ("published_at", 2), "date": ("published_at", 3)}


def utc(text: str) -> str:
    """A mail date in UTC, as ISO text; what cannot be read stays as it is."""
    try:
        moment = parsedate_to_datetime(text)
    except (ValueError, TypeError):
        return text
    return (moment if moment.tzinfo else moment.replace(tzinfo=UTC)).astimezone(UTC).isoformat()


def _elements(item: ET.Element) -> Iterator[tuple[str, int, str]]:
    for x in item:
        name, text = x.tag.rsplit("}", 1)[-1], (x.text or "").strip()
        if name in ITEM:
            yield (*ITEM[name], text)
        elif name == "link":
            yield "url", 0, text
            yield "url", 1, x.get("href", "") if x.get("rel", "alternate") == "alternate" else ""
        elif name == "enclosure" and x.get("type", "image").startswith("image"):
            yield "image_url", 0, x.get("url", "")
        elif name == "category":
            yield "native_category", 0, (x.get("domain") or text).lower()


def parse_feed(text: str) -> list[dict]:
    """Items of RSS 2.0, RSS 1.0 and Atom. What is not XML, or has no item, raises; items without a link or a
    title are left out; of Atom's links the alternate one counts; dates are in UTC, one that cannot be read stays as text."""
    try:
        items = [x for x in ET.fromstring(text).iter() if x.tag.rsplit("}", 1)[-1] in ("item", "entry")]
    except ET.ParseError as e:
        raise ValueError(f"not a feed: {e}") from e
    if not items:
        raise ValueError("a feed without items")
    out = []
    for item in items:
        best: dict[str, tuple[int, str]] = {}
        for field, rank, value in _elements(item):
            if value and rank < best.get(field, (9, ""))[0]:
                best[field] = (rank, value)
        row = {f: best.get(f, (0, ""))[1] for f in ("url", "title", "lead", "content", "published_at", "image_url", "native_category")}
        row |= {f: clean(re.sub(r"<[^>]+>", " ", row[f])) for f in ("lead", "content")} | {"title": clean(row["title"]), "published_at": utc(row["published_at"])}
        if row["url"] and row["title"]:
            out.append(row | {"content": row["content"] or row["lead"]})
    return out


def merged(feed: dict, page: dict) -> dict:
    """The feed's fields first, the page's where they are empty; the page's content first."""
    out = {k: feed.get(k) or page.get(k) or "" for k in {*feed, *page}}
    return out | {"content": page.get("content") or feed.get("content") or "", "extraction_tier": page.get("extraction_tier", "feed") if page.get("content") else "feed"}


def merge_tables(feed: DataFrame, pages: DataFrame, fields: tuple[str, ...] = ("title", "lead", "published_at", "image_url", "native_category")) -> DataFrame:
    """S04, S11 over tables keyed by url: the feed's ``fields`` where it has them, the page's content where that has one; a
    page that is gone (``gone``) leaves the feed's row, marked so."""
    f, p = feed.alias("f"), pages.alias("p")
    full = lambda side, c: F.nullif(F.col(f"{side}.{c}"), F.lit("")) if c in (feed if side == "f" else pages).columns else F.lit(None).cast("string")
    body = full("p", "content")
    return f.join(p, "url", "left").select(
        "url",
        *[F.coalesce(full("f", c), full("p", c), F.lit("")).alias(c) for c in fields],
        F.coalesce(body, full("f", "content"), F.lit("")).alias("content"),
        F.when(body.isNotNull(), F.col("p.extraction_tier")).otherwise("feed").alias("extraction_tier"),
        F.coalesce(F.col("p.gone"), F.lit(False)).alias("gone"),
    )


def listing(text: str, base: str) -> list[str]:
    """The links of a listing, absolute, each once, in order."""
    found = re.findall(r"""<a\b[^>]*\bhref=["']([^"'#]+)""", text, re.I)
    return list(dict.fromkeys(urljoin(base, html.unescape(x)) for x in found))


def relay(text: str, base: str) -> str:
    """Where a page hands on to: a frame, else a refresh, else itself."""
    if m := re.search(r"""<iframe\b[^>]*\bsrc=["']([^"']+)""", text, re.I):
        return urljoin(base, html.unescape(m[1]))
    if m := re.search(r"""http-equiv=["']refresh["'][^>]*url=([^"'>\s]+)""", text, re.I):
        return urljoin(base, html.unescape(m[1]))
    return base


def feed_items(feeds: DataFrame) -> DataFrame:
    """S02, S03 over a table (source_id, text): a row for each item; ``error`` names a feed that cannot be read, which has no other row."""
    names = ("url", "title", "lead", "content", "published_at", "image_url", "native_category", "error")

    def read(text: str | None) -> list[dict]:
        try:
            return parse_feed(text or "")
        except ValueError as e:
            return [{"error": str(e).split(":")[0]}]

    def run(batches):
        for batch in batches:
            rows = [(s, item) for s, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for item in read(t)]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()), *[pa.array([x.get(n, "") for _, x in rows], pa.string()) for n in names]], names=["source_id", *names])

    return feeds.select("source_id", "text").mapInArrow(run, "source_id string, " + ", ".join(f"{n} string" for n in names))


def listed(pages: DataFrame) -> DataFrame:
    """S05, S06 over a table (page_id, url, html): the links of each page in order, and where it hands on to."""

    def run(batches):
        for batch in batches:
            rows = [(i, listing(t or "", u or ""), relay(t or "", u or "")) for i, u, t in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.list_(pa.string()), pa.string()))], names=["page_id", "links", "relay"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, links array<string>, relay string")


#: An archive's pages in one walk at most, and pages in a row without a new link that end it.
MOST_PAGES, STALE_PAGES = 500, 2
#: Fixed value: pages of a listing that one crawl walks at most.
MOST_LISTING_PAGES = 8


def listing_walk(pages: DataFrame, limit: int, most: int = MOST_LISTING_PAGES) -> DataFrame:
    """(source_id, url, page, place): the first ``limit`` links of each source's listing, page by page, each where it is first
    shown; a page that is not there or shows nothing new ends the walk. ``pages``: source_id, page (from 1), links."""
    shown = pages.where(F.col("page") <= most).select("source_id", "page", F.posexplode("links").alias("place", "url"))
    fresh = shown.groupBy("source_id", "url").agg(F.min(F.struct("page", "place")).alias("at")).select("source_id", "url", "at.page", "at.place")
    new = fresh.select("source_id", "page").distinct().withColumn("_new", F.lit(True))
    order = Window.partitionBy("source_id").orderBy("page")
    each = pages.where(F.col("page") <= most).select("source_id", "page").distinct().join(new, ["source_id", "page"], "left")
    ends = each.where(F.col("_new").isNull()).groupBy("source_id").agg(F.min("page").alias("stale"))
    gaps = each.withColumn("_r", F.row_number().over(order)).where("_r <> page").groupBy("source_id").agg(F.min("_r").alias("gap"))
    walked = fresh.join(ends, "source_id", "left").join(gaps, "source_id", "left").where(F.col("page") < F.coalesce(F.least("stale", "gap"), F.lit(most + 1)))
    return top_per(walked, ["source_id"], limit, F.asc("page"), F.asc("place")).select("source_id", "url", "page", "place")


def archive_walk(pages: DataFrame, details: DataFrame, known: DataFrame, since: Column, most: int = MOST_PAGES) -> tuple[DataFrame, DataFrame]:
    """The articles that a walk over archive pages brings, and per archive how far it went and why it ended.

    ``pages``: archive, page (from 1), links array<string>; ``details``: url, published_at, for articles that could be fetched;
    ``known``: url, of what is stored. A link counts on the first page that shows it, where it is not known. The walk ends at a
    page that is not there ('missing'), at the second page in a row without a new link ('stale'), after a page with an article
    from before ``since`` ('floor'), or at the cap ('cap'). Gives (archive, page, url, published_at) and (archive, pages, ended).
    Whether a link is new does not depend on where the walk ends, so no page waits for the one before it."""
    shown = pages.where(F.col("page") <= most).select("archive", "page", F.explode("links").alias("url"))
    fresh = shown.groupBy("archive", "url").agg(F.min("page").alias("page")).join(known.select("url").distinct(), "url", "left_anti")
    found = fresh.join(details.groupBy("url").agg(F.min("published_at").alias("published_at"), F.lit(True).alias("_got")), "url", "left")
    counted = found.groupBy("archive", "page").agg(F.count("*").alias("_new"), F.coalesce(F.bool_or(F.col("published_at") < since), F.lit(False)).alias("_floor"))
    each = pages.where(F.col("page") <= most).select("archive", "page").distinct().join(counted, ["archive", "page"], "left")
    order = Window.partitionBy("archive").orderBy("page")
    stale = F.col("_new").isNull()
    place = F.row_number().over(order)
    marked = each.withColumns({"_stale": stale, "_before": F.when(place != F.col("page"), place - 1)})
    both = marked.withColumn("_twice", F.col("_stale") & F.coalesce(F.lag("_stale", STALE_PAGES - 1).over(order), F.lit(False)))
    at = lambda c: F.min(F.when(c, F.col("page")))
    ends = both.groupBy("archive").agg(at(F.col("_twice")).alias("twice"), at(F.coalesce("_floor", F.lit(False))).alias("floor"), F.max("page").alias("last"), F.min("_before").alias("before"))
    reach = F.least("twice", "floor", F.coalesce("before", "last"))
    why = F.when(F.col("twice") == reach, "stale").when(F.col("floor") == reach, "floor").when(reach >= most, "cap").otherwise("missing")
    walks = ends.select("archive", reach.cast("int").alias("pages"), why.alias("ended"))
    taken = found.where("_got").join(walks, "archive").where(F.col("page") <= F.col("pages")).select("archive", "page", "url", "published_at")
    return taken, walks


def relay_ends(relays: DataFrame) -> DataFrame:
    """(url, final, hops, cyclic) for pages (url, target) that hand on to another page: where the chain of those in the table
    ends. A page that hands on to itself, or to what is not in the table, ends it; one whose chain runs in a circle is marked,
    and its final is null.

    Pointers double: after k rounds each spans 2^k hops, and every page no further from its end has arrived; those take no
    part in further rounds. Of chains that end, the nearest ones arrive in each round, so a round in which none does leaves
    circles alone."""
    pages = relays.groupBy("url").agg(F.min("target").alias("target")).withColumn("target", F.coalesce("target", "url"))
    nodes = pages.select(F.col("url").alias("target")).withColumn("_in", F.lit(True))
    ends = F.col("target") == F.col("url")
    begun = checkpointed(pages.join(nodes, "target", "left").select("url", F.col("target").alias("at"), F.when(ends, 0).otherwise(1).cast("long").alias("hops"), (ends | F.col("_in").isNull()).alias("done")))
    done, open_ = begun.where("done"), begun.where("not done")
    left = open_.count()
    while left:
        onward = done.unionByName(open_).select(F.col("url").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        moved = open_.join(onward, "at").select("url", F.col("_at").alias("at"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"))
        moved = checkpointed(moved)
        done, open_, was = done.unionByName(moved.where("done")), moved.where("not done"), left
        left = open_.count()
        if left == was:
            break
    nowhere = open_.select("url", F.lit(None).cast("string").alias("final"), F.lit(None).cast("long").alias("hops"), F.lit(True).alias("cyclic"))
    return done.select("url", F.col("at").alias("final"), "hops", F.lit(False).alias("cyclic")).unionByName(nowhere)


def relayed(entries: DataFrame, relays: DataFrame, pages: DataFrame, fields: tuple[str, ...] = ("title", "lead", "published_at", "image_url", "native_category")) -> DataFrame:
    """A listing's entries (url and fields) with what stands behind their relays: the entry's fields where it has them, the
    final page's (of ``pages``) where not. final_url is where the chain ends after
    ``hops``, the entry's own address for a circle."""
    known = entries.select("url").distinct().join(relay_ends(relays), "url", "left")
    placed = known.select("url", F.coalesce("final", "url").alias("final_url"), "hops", F.coalesce("cyclic", F.lit(False)).alias("cyclic"))
    behind = placed.join(pages.withColumnRenamed("url", "final_url"), "final_url").drop("final_url", "hops", "cyclic")
    return merge_tables(entries, behind, fields).join(placed, "url")


#: Parsers by a source's strategy.
STRATEGIES = {"rss": parse_feed, "listing": listing, "relay": relay, "page": read_page}


def strategy(name: str):
    if name not in STRATEGIES:
        raise ValueError(f"unknown strategy {name!r}")
    return STRATEGIES[name]
