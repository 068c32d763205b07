"""Archives, relays, stored partitions and rolling cut-offs over the driver's tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from newsloom import vocab
from newsloom.adapt import ctes, domain
from newsloom.functions import text as T
from newsloom.operators import events as E
from newsloom.plans import store
from newsloom.plans.durable import shared_dir
from newsloom.queries.articles import FLAG
from newsloom.queries.events import IMPACT
from newsloom.registry import query
from newsloom.sources import pages as S
from newsloom.streaming import intake as I
from newsloom.tables import read

# --- S07

SINCE = "2024-01-06 00:00:00"
_ARCHIVE = f"""a AS (SELECT url, concat('archive', CAST(id % 5 AS VARCHAR)) AS archive, id, published_at, max(id) OVER () AS top FROM article),
shown AS (SELECT archive, CAST(1 + (top - id) // 40 AS INTEGER) AS page, url, published_at, id FROM a WHERE NOT (id % 5 = 2 AND (top - id) // 40 = 6)
          UNION ALL SELECT archive, CAST(2 + (top - id) // 40 AS INTEGER), url, published_at, id FROM a WHERE id % 9 = 0 AND NOT (id % 5 = 2 AND (top - id) // 40 = 5)),
p AS (SELECT DISTINCT archive, page FROM shown WHERE page <= 500),
found AS (SELECT archive, url, min(page) AS page, any_value(published_at) AS published_at, any_value(id) AS id FROM shown WHERE page <= 500 AND NOT (id % 5 = 1 AND ((SELECT max(id) FROM article) - id) // 40 IN (3, 4)) AND id % 7 <> 0 GROUP BY archive, url),
m AS (SELECT p.archive, p.page, count(f.url) = 0 AS stale, coalesce(bool_or(f.published_at < TIMESTAMP '{SINCE}' AND f.id % 6 <> 0), false) AS floor_ FROM p LEFT JOIN found f USING (archive, page) GROUP BY ALL),
o AS (SELECT *, row_number() OVER w AS r, stale AND coalesce(lag(stale) OVER w, false) AS twice FROM m WINDOW w AS (PARTITION BY archive ORDER BY page)),
e AS (SELECT archive, min(page) FILTER (twice) AS twice, min(page) FILTER (floor_) AS floor_, coalesce(min(r - 1) FILTER (r <> page), max(page)) AS whole FROM o GROUP BY archive),
walks AS (SELECT archive, CAST(least(twice, floor_, whole) AS INTEGER) AS pages, CASE WHEN twice = least(twice, floor_, whole) THEN 'stale' WHEN floor_ = least(twice, floor_, whole) THEN 'floor' WHEN whole >= 500 THEN 'cap' ELSE 'missing' END AS ended FROM e)"""


def _archive(spark, sf_dir):
    """Five archives of pages with the articles of 40 ids each, some shown again on the next page; one page is missing, two in a
    row of another archive hold only what is known."""
    a = domain(spark, sf_dir, "article").select("id", "url", "published_at", F.concat(F.lit("archive"), (F.col("id") % 5).cast("string")).alias("archive"))
    top = a.agg(F.max("id").alias("top"))
    back = F.floor((F.col("top") - F.col("id")) / 40).cast("int")
    placed = a.crossJoin(F.broadcast(top)).withColumn("back", back)  # one row by its aggregate
    again = placed.where("id % 9 = 0").withColumn("back", F.col("back") + 1)
    shown = placed.unionByName(again).where("not (id % 5 = 2 and back = 6)").withColumn("page", F.col("back") + 1)
    pages = shown.groupBy("archive", "page").agg(F.collect_list("url").alias("links"))
    known = placed.where("(id % 5 = 1 and back in (3, 4)) or id % 7 = 0").select("url")
    return S.archive_walk(pages, a.where("id % 6 <> 0").select("url", "published_at"), known, F.lit(SINCE).cast("timestamp_ntz"))


@query("s07_archive_articles", f"WITH {ctes('article')}, {_ARCHIVE} SELECT f.archive, f.page, f.url, f.published_at FROM found f JOIN walks w USING (archive) WHERE f.page <= w.pages AND f.id % 6 <> 0")
def s07(spark, sf_dir):
    return _archive(spark, sf_dir)[0]


@query("s07_archive_walks", f"WITH {ctes('article')}, {_ARCHIVE} SELECT archive, pages, ended FROM walks")
def s07_walks(spark, sf_dir):
    return _archive(spark, sf_dir)[1]


_LISTING = """a AS (SELECT url, concat('s', CAST(id % 5 AS VARCHAR)) AS source_id, id % 5 AS k, id, (max(id) OVER () - id) // 40 AS back FROM article),
l AS (SELECT source_id, CAST(back + 1 AS INTEGER) AS page, id, url FROM a WHERE NOT (k = 3 AND back = 4) AND NOT (k = 2 AND back = 5) UNION ALL SELECT source_id, 5, id, url FROM a WHERE k = 3 AND back = 3 UNION ALL SELECT source_id, CAST(back + 2 AS INTEGER), id, url FROM a WHERE k = 1 AND id % 3 = 0),
p AS (SELECT source_id, page, id, url, row_number() OVER (PARTITION BY source_id, page ORDER BY id DESC) - 1 AS place FROM l WHERE page <= 8),
f AS (SELECT source_id, url, page, place FROM p QUALIFY row_number() OVER (PARTITION BY source_id, url ORDER BY page, place) = 1),
g AS (SELECT source_id, page, row_number() OVER (PARTITION BY source_id ORDER BY page) AS r FROM (SELECT DISTINCT source_id, page FROM p)),
e AS (SELECT g.source_id, min(CASE WHEN NOT EXISTS (SELECT 1 FROM f WHERE f.source_id = g.source_id AND f.page = g.page) THEN g.page WHEN g.page <> r THEN r END) AS stop FROM g GROUP BY 1)"""


@query("s05_listing_walk", f"WITH {ctes('article')}, {_LISTING} SELECT f.source_id, f.url, f.page, f.place FROM f JOIN e USING (source_id) WHERE f.page < coalesce(stop, 9) QUALIFY row_number() OVER (PARTITION BY f.source_id ORDER BY f.page, f.place) <= 50")
def s05_walk(spark, sf_dir):
    """Five listings, fifty links of each: one with a page of known links, one without a page, one that shows some links twice."""
    a = domain(spark, sf_dir, "article").select("id", "url", (F.col("id") % 5).alias("k"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source_id"))
    top = a.agg(F.max("id").alias("top"))
    placed = a.crossJoin(F.broadcast(top)).withColumn("page", (F.floor((F.col("top") - F.col("id")) / 40) + 1).cast("int"))  # one row by its aggregate
    again = placed.where("k = 3 and page = 4").withColumn("page", F.lit(5)).unionByName(placed.where("k = 1 and id % 3 = 0").withColumn("page", F.col("page") + 1))
    shown = placed.where("not (k = 3 and page = 5) and not (k = 2 and page = 6)").unionByName(again)
    links = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("id", "url")))), lambda x: x["url"])
    return S.listing_walk(shown.groupBy("source_id", "page").agg(links.alias("links")), 50)


# --- T12

_FORMS = "CASE user_id % 8 WHEN 0 THEN '0' WHEN 1 THEN '+98 ' WHEN 2 THEN '0098-' WHEN 3 THEN '98' WHEN 4 THEN '' WHEN 5 THEN '(0)' WHEN 6 THEN '1' ELSE '+98۹' END"
_NUMBER = f"concat({_FORMS}, CASE WHEN user_id % 8 = 7 THEN '' ELSE '9' END, lpad(CAST(user_id AS {{}}), 9, '0'), CASE WHEN user_id % 50 = 9 THEN '7' ELSE '' END)"


@query("t12_phones", f"WITH {ctes('account')}, r AS (SELECT user_id, {_NUMBER.format('VARCHAR')} AS raw FROM account), b AS (SELECT user_id, regexp_replace(replace(raw, '۹', '9'), '[\\s\\-()]', '', 'g') AS bare FROM r) SELECT user_id, concat('+98', nullif(regexp_extract(bare, '^(?:\\+98|0098|98|0)?(9[0-9]{{9}})$', 1), '')) AS phone FROM b WHERE regexp_matches(bare, '^(?:\\+98|0098|98|0)?(9[0-9]{{9}})$') UNION ALL SELECT user_id, NULL FROM b WHERE NOT regexp_matches(bare, '^(?:\\+98|0098|98|0)?(9[0-9]{{9}})$')")
def t12(spark, sf_dir):
    """Numbers as people type them, some of them none."""
    a = domain(spark, sf_dir, "account").select("user_id").selectExpr("user_id", f"{_NUMBER.format('STRING')} AS raw")
    return a.select("user_id", T.phone(F.col("raw")).alias("phone"))


# --- S06

_TARGETS = "CASE page_id % 10 WHEN 1 THEN page_id + 1 WHEN 2 THEN page_id + 1 WHEN 4 THEN page_id + 1 WHEN 5 THEN -page_id WHEN 7 THEN page_id + 1 WHEN 8 THEN page_id - 1 WHEN 9 THEN page_id - 1 ELSE page_id END"
_RELAYS = f"""r AS (SELECT page_id AS k, CASE WHEN {_TARGETS} = page_id THEN NULL ELSE {_TARGETS} END AS t FROM pages),
walk AS (SELECT k, k AS at_, 0 AS hops FROM r UNION ALL SELECT w.k, r.t, w.hops + 1 FROM walk w JOIN r ON r.k = w.at_ WHERE r.t IS NOT NULL AND w.hops < 10),
far AS (SELECT k, max(hops) AS hops, arg_max(at_, hops) AS at_ FROM walk GROUP BY k)"""


@query(
    "s06_relays",
    f"WITH RECURSIVE {_RELAYS} SELECT far.k AS page_id, CASE WHEN hops < 10 THEN at_ END AS final, CASE WHEN hops < 10 THEN CAST(hops AS BIGINT) END AS hops, hops >= 10 AS cyclic, CASE WHEN far.k % 2 = 0 THEN 'listed' WHEN hops < 10 AND at_ IN (SELECT page_id FROM pages) THEN concat('page ', CAST(at_ AS VARCHAR)) WHEN hops >= 10 THEN concat('page ', CAST(far.k AS VARCHAR)) ELSE '' END AS title FROM far",
)
def s06(spark, sf_dir):
    """Pages that hand on once, twice, out of the table, or in circles; entries without a title take the final page's."""
    p = read(spark, sf_dir, "pages").select("page_id")
    name = lambda c: F.concat(F.lit("https://example.org/"), F.expr(c).cast("string"))
    relays = p.select(name("page_id").alias("url"), name(_TARGETS).alias("target"))
    entries = p.select(name("page_id").alias("url"), F.when(F.col("page_id") % 2 == 0, "listed").otherwise("").alias("title"))
    behind = p.select(name("page_id").alias("url"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.lit("body").alias("content"), F.lit("page").alias("extraction_tier"), F.lit(False).alias("gone"))
    number = lambda c: F.regexp_extract(c, "/(-?\\d+)$", 1).cast("long")
    out = S.relayed(entries, relays, behind, ("title",))
    return out.select(number("url").alias("page_id"), F.when(~F.col("cyclic"), number("final_url")).alias("final"), "hops", "cyclic", "title")


# --- K04

_FIRST = "f AS (SELECT id, source_id, title, created_at::DATE AS day, 1 AS version FROM article WHERE id % 3 <> 0)"
_SECOND = "s AS (SELECT id, source_id, title, CASE WHEN id % 10 = 0 THEN created_at::DATE + 1 ELSE created_at::DATE END AS day, 2 AS version FROM article WHERE id % 5 = 0 AND id % 400 < 200)"


@query("k04_stored_upsert", f"WITH {ctes('article')}, {_FIRST}, {_SECOND} SELECT id, source_id, title, day, version FROM f WHERE id NOT IN (SELECT id FROM s) UNION ALL SELECT * FROM s")
def k04_stored(spark, sf_dir):
    """Two loads into one table partitioned by day; the second moves some rows to another day."""
    a = domain(spark, sf_dir, "article").select("id", "source_id", "title", F.to_date("created_at").alias("day"))
    path = f"{shared_dir(spark)}/articles-{uuid.uuid4().hex}"
    k = F.col("id")
    store.upsert(a.where(k % 3 != 0).withColumn("version", F.lit(1)), path, ["id"], "day", F.desc("version"))
    moved = a.where((k % 5 == 0) & (k % 400 < 200)).withColumn("day", F.when(k % 10 == 0, F.date_add("day", 1)).otherwise(F.col("day"))).withColumn("version", F.lit(2))
    store.upsert(moved, path, ["id"], "day", F.desc("version"))
    return spark.read.parquet(path).select("id", "source_id", "title", "day", "version")


# --- R13

_WINDOWS = f"""scored AS (SELECT event_time::DATE AS at_, unnest([{{'axis': 'iran', 'score': iran_score}}, {{'axis': 'global', 'score': global_score}}, {{'axis': 'impact', 'score': {IMPACT}}}], recursive := true) FROM news_event WHERE iran_score IS NOT NULL AND global_score IS NOT NULL AND category <> 'other'),
counted AS (SELECT at_, axis, score, count(*) AS n FROM scored GROUP BY ALL),
ends AS (SELECT DISTINCT at_ + CAST(k AS INTEGER) AS day FROM counted, unnest(range(30)) AS t(k)),
windows AS (SELECT day, axis, score, sum(n) AS n FROM ends JOIN counted ON at_ <= day AND at_ > day - 30 GROUP BY ALL),
summed AS (SELECT *, sum(n) OVER (PARTITION BY day, axis ORDER BY score DESC) AS above, sum(n) OVER (PARTITION BY day, axis) AS total FROM windows)"""


@query("r13_rolling_cutoffs", f"WITH {ctes('news_event')}, {_WINDOWS} SELECT CAST(day AS DATE) AS day, axis, CASE WHEN max(total) >= 150 THEN 'relative' ELSE 'fixed' END AS basis, CAST(max(total) AS BIGINT) AS sample, {', '.join(f'CASE WHEN max(total) >= 150 THEN coalesce(min(score) FILTER (above <= {s}::DOUBLE * total), {chr(39)}Infinity{chr(39)}::DOUBLE) ELSE {b}::DOUBLE END AS cut{k}' for k, (s, b) in enumerate(zip(E.TOP_SHARES, E.FIXED_BANDS, strict=True), 2))} FROM summed GROUP BY day, axis")
def r13(spark, sf_dir):
    """The cut-offs of every day of all events. The driver's tables have few events a day, so the least sample is lower here."""
    c = E.rolling_cutoffs(E.daily_histograms(domain(spark, sf_dir, "news_event")), min_sample=150)
    return c.select("day", "axis", "basis", "sample", *[F.col("cuts")[k].alias(f"cut{k + 2}") for k in range(4)])


# --- C01, C04

_BATCHES = f"""crawled AS (
  SELECT id, 0 AS batch, id AS seq, url, title, lead, content, published_at, native_category, false AS gone FROM article WHERE id % 3 <> 0
  UNION ALL SELECT id, 1, id + 1000000000, url, title, lead, CASE WHEN id % 8 = 0 THEN concat('corrected ', content) ELSE content END, published_at, native_category, id % 20 = 4 FROM article WHERE id % 4 = 0
), f AS (SELECT *, {FLAG} AS quality_flag, CASE WHEN native_category = 'cat3' THEN 'slug:cat3' ELSE '' END AS prefilter_reason FROM crawled)"""


@query(
    "c01_intake_batches",
    f"WITH {ctes('article')}, {_BATCHES} SELECT seq AS id, batch, 'live' AS url_status, quality_flag, prefilter_reason FROM f WHERE batch = 0 OR (id % 3 = 0 AND NOT gone) UNION ALL SELECT f.id, 1, CASE WHEN f.gone THEN 'gone' ELSE 'live' END, CASE WHEN f.gone THEN b.quality_flag ELSE f.quality_flag END, b.prefilter_reason FROM f JOIN f b ON b.id = f.id AND b.batch = 0 WHERE f.batch = 1 AND (f.gone OR f.id % 8 = 0)",
)
def c01_intake(spark, sf_dir):
    """Two crawls of all articles through the whole chain, the second done twice: a version for whatever it changed."""
    sinks = I.Sinks(f"{shared_dir(spark)}/intake-{uuid.uuid4().hex}")
    a, k = domain(spark, sf_dir, "article").select("source_id", "url", "title", "lead", "content", "published_at", "native_category", "id"), F.col("id")
    first = a.where(k % 3 != 0).withColumns({"seq": k, "gone": F.lit(False)})
    second = a.where(k % 4 == 0).withColumns({"seq": k + 1_000_000_000, "gone": k % 20 == 4, "content": F.when(k % 8 == 0, F.concat(F.lit("corrected "), "content")).otherwise(F.col("content"))})
    topics = F.array(*map(F.lit, vocab.EVENT_CATEGORIES))
    answers = a.select("url", topics[(k % 9).cast("int")].alias("category"), (k % 5).cast("double").alias("iran"), (k % 4).cast("double").alias("global"), (F.lit(1.0) - (k % 10) / 10.0).alias("confidence"), F.array(F.lit("tech"), F.lit("day")).alias("tags"))
    rules = spark.createDataFrame([(True, None, "cat3")], "enabled boolean, source_id string, native_category string")
    take = I.intake(sinks, answers, [("tech", ["computer", "software"]), ("day", ["day", "the"])], rules, datetime(2024, 1, 20))
    for batch, rows in enumerate((first, second, second)):
        take(rows, min(batch, 1))
    return sinks.all(spark, "articles", I.ARTICLE).select("id", "batch", "url_status", "quality_flag", "prefilter_reason")
