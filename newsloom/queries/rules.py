"""Parsers and rules of a single row over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import vocab
from newsloom.adapt import ctes, domain
from newsloom.functions import score as X
from newsloom.functions import text as T
from newsloom.functions import time as D
from newsloom.operators import desk as K
from newsloom.operators import events, export, ops
from newsloom.registry import query
from newsloom.sources import pages as S
from newsloom.tables import read

_TITLE = "trim(regexp_replace(nfc_normalize(replace(title || ' &amp; more', '&amp;', '&')), '\\s+', ' ', 'g'))"


@query("t01_clean", f"WITH {ctes('article')} SELECT id, {_TITLE} AS shown FROM article")
def t01(spark, sf_dir):
    return domain(spark, sf_dir, "article").select("id", T.clean(F.concat("title", F.lit(" &amp; more"))).alias("shown"))


@query("d_rules", f"WITH {ctes('article')} SELECT id, published_at AS parsed, NULL::TIMESTAMP AS odd, coalesce(CASE WHEN id % 3 <> 0 THEN published_at END, CASE WHEN id % 2 = 0 THEN created_at END, TIMESTAMP '2024-01-01') AS reported_at, greatest(1, least(id % 500, 365))::BIGINT AS days, {D.jalali_sql('published_at::DATE')} AS jalali FROM article")
def d_rules(spark, sf_dir):
    """Times from text with a Z, the moment of a report, a window of days."""
    k, p = F.col("id"), F.col("published_at")
    reported = D.reported_at(F.when(k % 3 != 0, p), F.when(k % 2 == 0, F.col("created_at")), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    a = domain(spark, sf_dir, "article")
    return a.select("id", D.parse_iso(F.date_format(p, "yyyy-MM-dd'T'HH:mm:ss'Z'")).cast("timestamp_ntz").alias("parsed"), D.parse_iso(F.lit("no time")).cast("timestamp_ntz").alias("odd"), reported.alias("reported_at"), D.window_days(k % 500).alias("days"), D.jalali(F.to_date(p)).alias("jalali"))


_MONTH = "[" + ", ".join(f"'{m}'" for m in D.MONTHS) + "]"


@query("d04_jalali_words", f"WITH {ctes('article')}, j AS (SELECT id, {D.jalali_sql('published_at::DATE')} AS j FROM article) SELECT id, CASE WHEN id % 7 = 0 THEN 'soon' ELSE substr(j, 9, 2)::INT || ' ' || {_MONTH}[substr(j, 6, 2)::INT] || ' ' || substr(j, 1, 4) END AS words FROM j")
def d04(spark, sf_dir):
    day = F.when(F.col("id") % 7 == 0, "soon").otherwise(D.jalali(F.to_date("published_at")))
    return domain(spark, sf_dir, "article").select("id", D.jalali_words(day).alias("words"))


@query("x_answer_rules", f"WITH {ctes('news_event')}, e AS (SELECT *, id % 6 AS k FROM news_event) SELECT id, 1 + (global_score >= 20)::INT + (global_score >= 40)::INT + (global_score >= 60)::INT + (global_score >= 80)::INT AS band, confidence >= 0.9::DOUBLE AND k IN (0, 1) AS matched, CASE WHEN k < 4 THEN ['reports', 'supports', 'contradicts', 'updates'][k + 1] ELSE 'reports' END AS stance, CASE WHEN k <> 5 THEN confidence END AS stance_confidence, CASE WHEN k <> 4 THEN (global_score * 1000)::BIGINT END AS price FROM e")
def x_answers(spark, sf_dir):
    """Bands, prices as text with digits of two scripts, matches, stances."""
    k = (F.col("id") % 6).cast("int")
    stance, sure = X.stance(vocab.pick(("reports", "supports", "contradicts", "updates", "odd", ""), k + 1), F.when(k == 5, 1.5).otherwise(F.col("confidence")))
    number = F.translate(F.concat(F.col("global_score").cast("int").cast("string"), F.lit(",000")), "0123456789", "۰۱۲۳۴۵۶۷۸۹")
    price = X.price(F.when(k == 4, "n/a").when(F.col("global_score") == 0, "0").otherwise(number)).cast("long")
    return domain(spark, sf_dir, "news_event").select("id", X.band(F.col("global_score")).alias("band"), X.matched(vocab.pick(("a", "b", "c", "d", "e", "f"), k + 1), F.array(F.lit("a"), F.lit("b")), F.col("confidence")).alias("matched"), stance.alias("stance"), sure.alias("stance_confidence"), price.alias("price"))


@query("x14_error_classes", "WITH e AS (SELECT event_id AS id, event_id % 9 AS k FROM events) SELECT id, ['network', 'rate_limit', 'gone', 'blocked', 'blocked', 'network', 'provider', 'parse', ''][k + 1] AS cause FROM e")
def x14(spark, sf_dir):
    said = ("ReadTimeout: 30 s", "HTTPError: HTTP 429", "Gone: HTTP 410", "HTTPError: HTTP 451", "RobotsBlocked: no", "HTTPError: HTTP 502", "BudgetExceeded: month", "KeyError: 'a timeout'", "")
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), X.error_class(vocab.pick(said, 1 + F.col("event_id") % 9)).alias("cause"))


@query("s02_feed_items", "SELECT source AS source_id, 'https://example.org/' || doc_id AS url, 'Item ' || doc_id || ' & more' AS title, 'lead of ' || doc_id AS lead, CASE WHEN doc_id % 2 = 0 THEN 'body of ' || doc_id ELSE 'lead of ' || doc_id END AS content, CASE WHEN doc_id % 3 = 0 THEN 'soon' ELSE '2024-01-01T06:30:00+00:00' END AS published_at, CASE WHEN doc_id % 2 = 0 THEN 'politics' ELSE '' END AS native_category FROM documents WHERE doc_id % 10 <> 7")
def s02(spark, sf_dir):
    """A feed of each document, RSS and Atom by turns; items without a link are left out."""
    k = F.col("doc_id").cast("string")
    link = F.when(F.col("doc_id") % 10 == 7, "").otherwise(F.concat(F.lit("https://example.org/"), k))
    date = F.when(F.col("doc_id") % 3 == 0, "soon").otherwise("Mon, 01 Jan 2024 10:00:00 +0330")
    rss = F.concat(F.lit('<rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><item><title>Item '), k, F.lit(" &amp; more</title><link>"), link, F.lit("</link><description>&lt;b&gt;lead of&lt;/b&gt; "), k, F.lit("</description><pubDate>"), date, F.lit('</pubDate><category domain="Politics">x</category><content:encoded>&lt;p&gt;body of '), k, F.lit("&lt;/p&gt;</content:encoded></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Item '), k, F.lit(' &amp; more</title><link rel="self" href="https://example.org/feed"/><link href="'), link, F.lit('"/><summary>lead of '), k, F.lit("</summary><published>"), date, F.lit("</published></entry></feed>"))
    feeds = read(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, rss).otherwise(atom).alias("text"))
    return S.feed_items(feeds).where("error = ''").select("source_id", "url", "title", "lead", "content", "published_at", "native_category")


@query("s05_listed", "SELECT page_id, 'https://example.org/a' || page_id || ',https://other.example/b' AS links, CASE WHEN page_id % 3 = 0 THEN 'https://example.org/in' || page_id WHEN page_id % 3 = 1 THEN 'https://example.org/next' ELSE 'https://example.org/list' END AS relay FROM pages")
def s05(spark, sf_dir):
    k = F.col("page_id").cast("string")
    hand = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<iframe src="/in'), k, F.lit('"></iframe>'))).when(F.col("page_id") % 3 == 1, '<meta http-equiv="refresh" content="0;url=/next">').otherwise("")
    text = F.concat(hand, F.lit('<a href="/a'), k, F.lit('">x</a><a class="y" href="https://other.example/b">y</a><a href="/a'), k, F.lit('">again</a>'))
    rows = read(spark, sf_dir, "pages").select("page_id", F.lit("https://example.org/list").alias("url"), text.alias("html"))
    return S.listed(rows).select("page_id", F.array_join("links", ",").alias("links"), "relay")


@query("s04_merge", f"WITH {ctes('article')} SELECT id, CASE WHEN id % 4 = 0 OR coalesce(title, '') = '' THEN 'of the page' ELSE title END AS title, CASE WHEN id % 5 = 0 OR id % 3 = 0 OR id % 7 = 0 OR coalesce(content, '') = '' THEN coalesce(lead, '') ELSE content END AS content, CASE WHEN id % 5 = 0 OR id % 3 = 0 OR id % 7 = 0 OR coalesce(content, '') = '' THEN 'feed' ELSE 'css' END AS extraction_tier, id % 5 <> 0 AND id % 7 = 0 AS gone FROM article")
def s04(spark, sf_dir):
    """Feed rows with the page of each, where there is one, it has a body, and is not gone."""
    k = F.col("id")
    a = domain(spark, sf_dir, "article").withColumn("url", F.concat("url", F.lit("#"), k.cast("string")))
    feed = a.select("id", "url", F.when(k % 4 == 0, "").otherwise(F.col("title")).alias("title"), F.col("lead").alias("content"))
    page = a.where(k % 5 != 0).select("url", F.lit("of the page").alias("title"), F.when((k % 3 == 0) | (k % 7 == 0), "").otherwise(F.col("content")).alias("content"), F.lit("css").alias("extraction_tier"), (k % 7 == 0).alias("gone"))
    missing = a.where(k % 5 == 0).select("url", F.lit("of the page").alias("title"), F.lit("").alias("content"), F.lit("css").alias("extraction_tier"), F.lit(False).alias("gone"))
    merged = S.merge_tables(feed.drop("id"), page.unionByName(missing), ("title",))
    return feed.select("id", "url").join(merged, "url").select("id", "title", "content", "extraction_tier", "gone")


@query("r04_price_polls", "SELECT user_id, ts::DATE::VARCHAR AS day, count(DISTINCT (event_type, date_trunc('hour', ts))) AS n FROM events GROUP BY 1, 2")
def r04(spark, sf_dir):
    """Polls of one symbol and moment count once; a day is a tumbling window."""
    polls = read(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("observed_at")).dropDuplicates(["user_id", "symbol", "observed_at"])
    return polls.groupBy("user_id", F.window("observed_at", "1 day")["start"].cast("date").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query("c35_invalidated", f"WITH {ctes('article')} SELECT id, title, lead FROM article WHERE id % 3 <> 0 AND coalesce(title, '') || coalesce(lead, '') <> ''")
def c35(spark, sf_dir):
    """What is kept of the texts of presentations that no longer hold."""
    k = F.col("id")
    rows = domain(spark, sf_dir, "article").select("id", F.when(k % 3 != 0, F.col("title")).otherwise("").alias("title"), F.when(k % 3 != 0, F.col("lead")).alias("lead"))
    return K.invalidate(rows, ["title", "lead"])[0]


def _case(names: dict[str, str], key: str, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE '{default}' END"


_LEVEL = "CASE WHEN {0} IS NULL THEN '' ELSE [" + vocab.sql_list(vocab.LEVELS) + "][1 + ({0} >= 20)::INT + ({0} >= 40)::INT + ({0} >= 60)::INT + ({0} >= 80)::INT] END"
_VOTE = f"list_filter([nullif(coalesce(list_position([{vocab.sql_list(vocab.LEVELS)}], x), 0), 0) FOR x IN [occurrence, gold, security]], lambda x: x IS NOT NULL)"
_EVIDENCE = ("official", "multi", "single", "disputed", "")


@query("c15_workbook_rows", f"""WITH {ctes('news_event', 'report', 'tag')}, e AS (SELECT *, {vocab.sql_pick(_EVIDENCE, '(1 + id % 5)')} AS evidence_level FROM news_event WHERE status <> 'corrected'),
a AS (SELECT event_id, arg_max({{'g': CASE WHEN report_id % 7 <> 0 THEN (report_id % 101)::DOUBLE END}}, report_id).g AS gold_score FROM report GROUP BY 1),
o AS (SELECT event_id, 's' || source_id % 20 AS outlet, min(report_id) AS first_id FROM report GROUP BY 1, 2), l AS (SELECT event_id, string_agg(outlet, '، ' ORDER BY first_id, outlet) AS outlets FROM o GROUP BY 1),
w AS (SELECT event_id, string_agg(item, '، ' ORDER BY item) AS items FROM (SELECT DISTINCT event_id, item FROM tag) GROUP BY 1),
r AS (SELECT id, {_case(vocab.LEGACY_CATEGORY, 'category', 'other')} AS feed, {_case(vocab.OCCURRENCE_LEVEL, 'evidence_level', '')} AS occurrence, {_LEVEL.format('gold_score')} AS gold, CASE WHEN contains({_case(vocab.LEGACY_CATEGORY, 'category', 'other')}, 'security') THEN {_LEVEL.format('iran_score')} ELSE '' END AS security, coalesce(outlets, '') AS outlets, CASE WHEN items IS NULL THEN '' ELSE 'پایش: ' || items END AS notes, {D.jalali_sql('(event_time + INTERVAL 210 MINUTE)::DATE')} AS jalali_day FROM e LEFT JOIN a ON a.event_id = id LEFT JOIN l ON l.event_id = id LEFT JOIN w ON w.event_id = id),
s AS (SELECT *, {_VOTE} AS s FROM r) SELECT id, feed, occurrence, gold, security, outlets, notes, jalali_day, CASE WHEN len(s) < 2 THEN '{vocab.INSUFFICIENT}' WHEN list_min(s) < 2 THEN '{vocab.NO_NOTIFY}' WHEN len(list_filter(s, lambda x: x >= 4)) >= 2 THEN '{vocab.NOTIFY}' ELSE '{vocab.NO_NOTIFY}' END AS decision FROM s""")
def c15(spark, sf_dir):
    """Events with evidence, gold and Iran bands, the vote, outlets in order of their reports, and watch items by name."""
    e = domain(spark, sf_dir, "news_event").where("status <> 'corrected'").withColumns({"evidence_level": vocab.pick(_EVIDENCE, 1 + F.col("id") % 5), "title": F.lit("t"), "brief": F.lit(""), "url": F.lit("https://example.org/"), "primary_article_id": F.lit(-1).cast("long")})
    r = domain(spark, sf_dir, "report")
    k = F.col("report_id")
    assessed = r.select("event_id", k.alias("id"), F.when(k % 7 != 0, (k % 101).cast("double")).alias("gold_score"))
    outlets = r.select("event_id", k.alias("article_id"), F.concat(F.lit("s"), (F.col("source_id") % 20).cast("string")).alias("outlet"))
    tags = domain(spark, sf_dir, "tag").select("event_id", F.col("item").alias("link_id"), F.col("item").alias("name")).distinct()
    return export.workbook_rows(e, assessed, outlets, tags).select("id", "feed", "occurrence", "gold", "security", "outlets", "notes", "jalali_day", "decision")


@query("x20_answers", f"WITH e AS (SELECT event_id AS id, event_id % 10 AS k FROM events) SELECT id, CASE WHEN k < 8 THEN {vocab.sql_pick(vocab.EVENT_CATEGORIES, '(1 + id % 9)')} END AS category, CASE WHEN k < 8 THEN (k % 5) * 25 END::INT AS iran, CASE WHEN k < 8 THEN 100 END::INT AS gold, CASE WHEN k < 8 THEN 0.5 END::DOUBLE AS confidence FROM e")
def x20(spark, sf_dir):
    """Whole answers: one in ten with a category outside the vocabulary, one with a score outside the scale."""
    k = F.col("event_id") % 10
    scores = {name: F.lit(4) for name in vocab.ANSWERED_SCORES} | {"iran": F.when(k == 9, 7).otherwise(k % 5)}
    category = F.when(k == 8, "odd").otherwise(vocab.pick(vocab.EVENT_CATEGORIES, 1 + F.col("event_id") % 9))
    a = X.answered(category, scores, [F.lit(0.5), F.lit(0.9), F.lit(1.0)])
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), a.alias("a")).select("id", F.col("a.category").alias("category"), F.col("a.iran").cast("int").alias("iran"), F.col("a.asset_gold").cast("int").alias("gold"), F.col("a.confidence").alias("confidence"))


@query("a10_cost_totals", f"WITH {ctes('usage')}, s(stage) AS (VALUES {', '.join(f"('{x}')" for x in (*vocab.STAGES, 'idle'))}), m AS (SELECT stage, cost::DECIMAL(18,6) AS cost, created_at::DATE = DATE '2024-01-20' AS now FROM usage WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at <= TIMESTAMP '2024-01-20 12:00:00') SELECT stage, count(cost) AS calls, coalesce(sum(cost), 0)::DOUBLE AS month, coalesce(sum(cost) FILTER (now), 0)::DOUBLE AS today FROM s LEFT JOIN m USING (stage) GROUP BY GROUPING SETS ((), (stage))")
def a10_totals(spark, sf_dir):
    return ops.cost_totals(domain(spark, sf_dir, "usage"), vocab.table(spark, (*vocab.STAGES, "idle"), "stage"), F.lit("2024-01-20 12:00:00").cast("timestamp_ntz"))


@query("x26_untranslated", f"WITH {ctes('report')}, l AS (SELECT * FROM report QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY report_id % 5 = 0 DESC, reported_at, report_id) = 1) SELECT event_id, event_id % 3 = 0 AND report_id % 4 <> 1 AS untranslated FROM l")
def x26(spark, sf_dir):
    r = domain(spark, sf_dir, "report").select("event_id", "report_id", "reported_at", (F.col("report_id") % 5 == 0).alias("is_primary"), F.when(F.col("report_id") % 4 == 1, "fa").otherwise("en").alias("language"))
    return K.untranslated(r.select("event_id").distinct().withColumn("title", F.when(F.col("event_id") % 3 == 0, "").otherwise("t")), r)


@query("x29_next_meetings", "SELECT user_id AS bank, min(ts::DATE)::VARCHAR AS day, date_diff('day', DATE '2024-01-15', min(ts::DATE))::INT AS days FROM events WHERE ts::DATE >= DATE '2024-01-15' GROUP BY 1")
def x29(spark, sf_dir):
    dates = read(spark, sf_dir, "events").select(F.col("user_id").alias("bank"), F.to_date("ts").alias("day"))
    return K.next_meetings(dates, F.lit("2024-01-15").cast("date")).withColumn("day", F.col("day").cast("string"))


@query("x28_chart_bounds", "SELECT user_id AS symbol, CASE WHEN min(value) = max(value) THEN min(value) - 1 ELSE min(value) END AS low, CASE WHEN min(value) = max(value) THEN max(value) + 1 ELSE max(value) END AS high FROM events GROUP BY 1")
def x28(spark, sf_dir):
    return K.chart_bounds(read(spark, sf_dir, "events").select(F.col("user_id").alias("symbol"), F.col("ts").alias("observed_at"), F.col("value").alias("price")))


@query("c24_mark_read", "SELECT event_id AS alert_id, event_id % 3 = 0 OR user_id % 7 = 0 OR event_id % 10 = 1 AS is_read, event_id % 3 = 0 AS was_read FROM events")
def c24_read(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    alerts = e.select("user_id", F.col("event_id").alias("alert_id"), F.when(F.col("event_id") % 3 == 0, F.col("ts")).alias("read_at"), F.col("ts").alias("created_at"))
    asked = alerts.where("user_id % 7 = 0").select("user_id", F.lit(None).cast("long").alias("alert_id")).distinct().unionByName(alerts.where("alert_id % 10 = 1").select("user_id", "alert_id"))
    after = K.mark_read(alerts, asked, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
    return after.select("alert_id", F.col("read_at").isNotNull().alias("is_read"), F.coalesce(F.col("read_at") == F.col("created_at"), F.lit(False)).alias("was_read"))


@query("c25_acceptable", "WITH w AS (SELECT DISTINCT o_custkey AS user_id, o_orderpriority AS item FROM orders), f AS (SELECT user_id FROM w GROUP BY 1 HAVING count(*) BETWEEN 3 AND 4 AND bool_and(item <> '5-LOW')) SELECT user_id, item FROM w WHERE user_id IN (SELECT user_id FROM f)")
def c25_fine(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("item"))
    return export.acceptable_watchlists(o, o.select("item").distinct().where("item <> '5-LOW'"), 3, 4)


@query("p04_visible", f"WITH {ctes('news_event')} SELECT id FROM news_event WHERE NOT hidden AND category <> 'other' AND status <> 'withdrawn' AND primary_article_id % 19 <> 0")
def p04(spark, sf_dir):
    hidden = domain(spark, sf_dir, "article").where("id % 19 = 0").select("id")
    more = spark.range(200).where("id % 19 = 0")
    return events.visible(domain(spark, sf_dir, "news_event"), hidden.unionByName(more)).select("id")


@query("a30_models", f"WITH {ctes('usage')}, u AS (SELECT provider AS model, cost AS latency, status = 'success' AS valid, cost FROM usage), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY latency) AS r, count(*) OVER (PARTITION BY model) AS n FROM u) SELECT model, floor(median(latency))::BIGINT AS p50, max(latency) FILTER (r = greatest(floor(0.95::DOUBLE * n), 1)) AS p95, max(n)::BIGINT AS n, avg(valid::INT) AS compliance, sum(cost::DECIMAL(18,6))::DOUBLE / count(*) AS cost_per_call FROM r GROUP BY 1")
def a30_models(spark, sf_dir):
    return ops.benchmark(domain(spark, sf_dir, "usage").select(F.col("provider").alias("model"), F.col("cost").alias("latency"), (F.col("status") == "success").alias("valid"), "cost"))


@query("a06_last_day", f"WITH {ctes('usage')} SELECT stage, status, count(*) AS n FROM usage WHERE created_at >= TIMESTAMP '2024-01-14 12:00:00' AND created_at <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1, 2")
def a06_day(spark, sf_dir):
    return ops.outcomes_of_day(domain(spark, sf_dir, "usage"), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
