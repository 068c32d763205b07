"""Predicates, lists and pages over the driver's tables, each over all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom import vocab
from newsloom.adapt import NOW, ctes, domain
from newsloom.functions import text as T
from newsloom.functions import time as D
from newsloom.operators import lists as L
from newsloom.operators import ops as O
from newsloom.queries.articles import _DECIDE, FLAG, LATEST, SCORES, fold_sql
from newsloom.queries.ops import COVERAGE, LATEST_C, SQL_NOW, _states
from newsloom.registry import query
from newsloom.tables import read


def now():
    return F.lit(NOW).cast("timestamp_ntz")


@query("p03_in_window", f"WITH {ctes('article')} SELECT id FROM article WHERE created_at >= {SQL_NOW} - INTERVAL 14 DAY")
def p03(spark, sf_dir):
    return L.in_window(domain(spark, sf_dir, "article"), 14, now(), "created_at").select("id")


_TIER = "CASE id % 4 WHEN 0 THEN 'feed' WHEN 1 THEN 'listing' WHEN 2 THEN 'jsonld' ELSE 'css' END"
_FILTERS = {
    "stored_day": ("2024-01-05", "created_at >= TIMESTAMP '2024-01-04 20:30:00' AND created_at < TIMESTAMP '2024-01-05 20:30:00'"),
    "classified": (True, "id IN (SELECT article_id FROM classification)"),
    "evaluated": (False, "id NOT IN (SELECT article_id FROM evaluation)"),
    "source": ("src1", "source_id = 'src1'"),
    "outlet": ("LET SRC2", "contains(lower('Outlet ' || source_id), 'let src2')"),
    "jalali_day": ("1402-10-20", f"{D.jalali_sql('(published_at + INTERVAL 210 MINUTE)::DATE')} = '1402-10-20'"),
    "since": ("2024-01-03 00:00:00", "published_at >= TIMESTAMP '2024-01-03'"),
    "until": ("2024-01-25 00:00:00", "published_at <= TIMESTAMP '2024-01-25'"),
    "tier": ("css", f"{_TIER} = 'css'"),
    "native_category": ("cat2", "native_category = 'cat2'"),
    "category": ("economics", "id IN (SELECT article_id FROM lc WHERE category = 'economics')"),
    "notify": (vocab.NOTIFY, f"id IN (SELECT article_id FROM (SELECT article_id, {SCORES} AS s FROM latest) WHERE {_DECIDE} = '{vocab.NOTIFY}')"),
    "q": ("Ro", "contains(lower(title), 'ro') OR contains(lower(lead), 'ro') OR (id % 5 = 0 AND contains('summary ro', 'ro'))"),
    "unanalysed": (True, "id NOT IN (SELECT article_id FROM classification)"),
}


def _filter(spark, sf_dir) -> tuple[DataFrame, L.ArticleFilter]:
    a = domain(spark, sf_dir, "article").withColumns({"outlet": F.concat(F.lit("Outlet "), "source_id"), "extraction_tier": vocab.pick(("feed", "listing", "jsonld", "css"), 1 + F.col("id") % 4)})
    summaries = a.where("id % 5 = 0").select(F.col("id").alias("article_id"), F.lit("summary ro").alias("title"))
    return a, L.ArticleFilter(domain(spark, sf_dir, "classification"), domain(spark, sf_dir, "evaluation"), summaries)


@query("p06_each_filter", f"WITH {ctes('article', 'classification', 'evaluation')}, {LATEST}, lc AS (SELECT * FROM classification QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1) " + " UNION ALL ".join(f"SELECT '{name}' AS filter, id FROM article WHERE {sql}" for name, (_, sql) in _FILTERS.items()))
def p06_each(spark, sf_dir):
    """Each of the fourteen filters by itself."""
    a, keep = _filter(spark, sf_dir)
    return reduce(DataFrame.unionByName, [keep(a, **{name: value}).select(F.lit(name).alias("filter"), "id") for name, (value, _) in _FILTERS.items()])


@query("p06_filters_together", f"WITH {ctes('article', 'classification', 'evaluation')}, {LATEST}, lc AS (SELECT * FROM classification QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1) SELECT id FROM article WHERE " + " AND ".join(f"({_FILTERS[f][1]})" for f in ("classified", "since", "until", "tier", "q")) + " AND id NOT IN (SELECT article_id FROM lc WHERE category <> 'other')")
def p06_together(spark, sf_dir):
    a, keep = _filter(spark, sf_dir)
    wanted = {f: _FILTERS[f][0] for f in ("classified", "since", "until", "tier", "q")}
    return keep(a, category="other", notify=None, **wanted).select("id")


@query("p08_for_variant", f"WITH {ctes('classification')} SELECT id FROM classification WHERE (variant = 'F' AND id % 2 = 0 AND id % 3 = 0 AND article_id % 2 = 0) OR (variant = 'O' AND id % 2 = 1 AND id % 3 = 2 AND article_id % 2 = 1) OR (variant = 'P' AND id % 2 = 0 AND id % 3 = 1 AND article_id % 2 = 0)")
def p08(spark, sf_dir):
    k = F.col("id")
    answers = domain(spark, sf_dir, "classification").withColumns({"provider": F.format_string("p%d", k % 2), "model": F.format_string("m%d", k % 3), "prompt_version": F.format_string("v%d", F.col("article_id") % 2)})
    variants = spark.createDataFrame([("F", "p0", "m0", None, "m1", "v0"), ("O", "p1", "m1", "m2", "", "v1"), ("P", "p0", "m1", "", "m2", "v0")], "variant string, provider string, model string, classify_model string, advanced_model string, prompt_version string")
    return L.for_variant(answers, variants, "classify").select("id")


@query("c45_model_tiers", f"WITH {ctes('classification')} SELECT CASE id % 3 WHEN 0 THEN CASE WHEN variant = 'F' THEN 'small' ELSE 'plain' END WHEN 1 THEN CASE WHEN variant <> 'O' THEN 'large' ELSE 'plain' END ELSE 'plain' END AS model, count(*) AS n FROM classification GROUP BY 1")
def c45(spark, sf_dir):
    v = F.col("variant")
    model = L.model_for_node(vocab.pick(("classify", "summarize", "translate"), 1 + F.col("id") % 3), F.lit("plain"), F.when(v == "F", "small"), F.when(v == "O", "").otherwise("large"))
    return domain(spark, sf_dir, "classification").groupBy(model.alias("model")).agg(F.count("*").alias("n"))


@query("p09_pending_events", f"WITH {ctes('article', 'news_event')} SELECT e.id FROM news_event e WHERE category <> 'other' AND id % 4 = 1 AND primary_article_id IN (SELECT id FROM article WHERE native_category <> 'cat3' AND id % 11 <> 0) ORDER BY event_time DESC, id DESC LIMIT 200")
def p09(spark, sf_dir):
    a = domain(spark, sf_dir, "article").select("id", F.when(F.col("native_category") == "cat3", "slug:cat3").otherwise("").alias("prefilter_reason"), F.when(F.col("id") % 11 == 0, "invalid_url").otherwise("").alias("quality_flag"))
    e = domain(spark, sf_dir, "news_event")
    return L.pending_events(e, a, e.where("id % 4 <> 1").select(F.col("id").alias("event_id"))).select("id")


@query("p10_licensed", f"WITH {ctes('article')} SELECT id, title, CASE WHEN id % 3 = 0 THEN '' ELSE lead END AS lead, CASE WHEN id % 3 = 0 THEN 0 ELSE length(content) END::BIGINT AS n FROM article")
def p10(spark, sf_dir):
    a = domain(spark, sf_dir, "article").withColumn("license_mode", F.when(F.col("id") % 3 == 0, "facts_link_out").otherwise("full"))
    return L.licensed(a).select("id", "title", "lead", F.length("content").cast("long").alias("n"))


_URLS = f"u AS (SELECT id, created_at, created_at AS fetched_at, CASE WHEN id % 8 = 1 THEN 'gone' ELSE 'live' END AS url_status, CASE WHEN id % 5 <> 0 THEN created_at + to_minutes(CAST(id % 977 AS INTEGER)) END AS last_checked_at FROM article)"


def _urls(spark, sf_dir):
    k = F.col("id")
    return domain(spark, sf_dir, "article").select("id", "created_at", F.col("created_at").alias("fetched_at"), F.when(k % 8 == 1, "gone").otherwise("live").alias("url_status"), F.when(k % 5 != 0, F.col("created_at") + D.minutes((k % 977).cast("int"))).alias("last_checked_at"))


@query("p11_recent_urls", f"WITH {ctes('article')}, {_URLS} SELECT id FROM u WHERE url_status = 'live' AND created_at >= {SQL_NOW} - INTERVAL 7 DAY ORDER BY last_checked_at NULLS FIRST, id LIMIT 100")
def p11_recent(spark, sf_dir):
    return L.recent_urls(_urls(spark, sf_dir), now()).select("id")


@query("p11_stale_urls", f"WITH {ctes('article')}, {_URLS} SELECT id FROM u WHERE url_status = 'live' AND fetched_at < {SQL_NOW} - INTERVAL 7 DAY ORDER BY fetched_at, id LIMIT 100")
def p11_stale(spark, sf_dir):
    return L.stale_urls(_urls(spark, sf_dir), now()).select("id")


_RETRIES = "q AS (SELECT id, source_id, started_at + INTERVAL 1 DAY AS next_at, started_at AS updated_at, id % 4 = 0 AS gave_up, (id % 7)::INT AS attempts FROM attempt WHERE status = 'failed')"


def _retries(spark, sf_dir):
    a = domain(spark, sf_dir, "attempt").where("status = 'failed'")
    return a.select("id", "source_id", (F.col("started_at") + L.days(1)).alias("next_at"), F.col("started_at").alias("updated_at"), (F.col("id") % 4 == 0).alias("gave_up"), (F.col("id") % 7).cast("int").alias("attempts"), F.lit("").alias("error_class"))


@query("p12_due_retries", f"WITH {ctes('attempt')}, {_RETRIES} SELECT id FROM q WHERE NOT gave_up AND next_at <= TIMESTAMP '2024-01-15 00:00:00' AND source_id % 10 <> 0 ORDER BY next_at, id LIMIT 50")
def p12(spark, sf_dir):
    q = _retries(spark, sf_dir)
    return L.due_retries(q, q.select("source_id").distinct().withColumn("enabled", F.col("source_id") % 10 != 0), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")).select("id")


@query("p12_kept_retries", f"WITH {ctes('attempt')}, {_RETRIES} SELECT id FROM q WHERE NOT gave_up OR updated_at >= TIMESTAMP '2024-02-10 00:00:00' - INTERVAL 30 DAY")
def p12_kept(spark, sf_dir):
    return L.kept_retries(_retries(spark, sf_dir), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz")).select("id")


@query("r06_retry_pass", f"""WITH {ctes('attempt')}, {_RETRIES}, o AS (SELECT *, id % 5 AS k FROM q WHERE NOT (id % 5 = 0)), n AS (SELECT id, attempts + (k <> 4)::INT AS attempts, CASE k WHEN 1 THEN 'network' WHEN 2 THEN 'gone' WHEN 3 THEN 'rate_limit' ELSE '' END AS error_class, gave_up, next_at, k FROM o)
SELECT id, attempts, error_class, gave_up OR (k <> 4 AND (attempts >= 6 OR k = 2)) AS gave_up, CASE WHEN k = 4 OR attempts >= 6 OR k = 2 THEN next_at ELSE {SQL_NOW} + to_seconds(60 * least(360.0::DOUBLE, 5.0::DOUBLE * pow(2.0::DOUBLE, attempts - 1))) END AS next_at FROM n""")
def r06(spark, sf_dir):
    q = _retries(spark, sf_dir)
    k = F.col("id") % 5
    outcomes = q.where(k != 4).select("id", F.when(k == 0, "").when(k == 1, "HTTP 503").when(k == 2, "HTTP 404").otherwise("HTTP 429").alias("error"))
    return L.retried(q, outcomes, now()).select("id", "attempts", "error_class", "gave_up", "next_at")


@query("r03_gap_backfills", f"WITH {ctes('attempt')}, {COVERAGE}, l AS (SELECT *, lag(state) OVER w AS was, lag(started_at) OVER w AS from_ FROM coverage WINDOW w AS (PARTITION BY source_id ORDER BY ended_at, started_at)) SELECT source_id, started_at AS closed_at, greatest(from_, started_at - INTERVAL 3 DAY)::DATE::VARCHAR AS since FROM l WHERE state = 'covered' AND was <> 'covered' AND source_id % 2 = 0")
def r03(spark, sf_dir):
    archived = domain(spark, sf_dir, "attempt").where("source_id % 2 = 0").select("source_id")
    return L.gap_backfills(O.coverage(_states(spark, sf_dir), 86_400), archived).withColumn("since", F.col("since").cast("string"))


@query("r03_backfilled", f"WITH {ctes('article')} SELECT id FROM article WHERE published_at::DATE >= DATE '2024-01-03' AND id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, url) <= 200")
def r03_pages(spark, sf_dir):
    a = domain(spark, sf_dir, "article")
    return L.backfilled(a.withColumn("url", F.concat("url", F.lit("#"), F.col("id").cast("string"))), F.lit("2024-01-03").cast("date"), a.where("id % 3 = 0").select(F.concat("url", F.lit("#"), F.col("id").cast("string")).alias("url"))).select("id")


@query("o03_stored_page", f"WITH {ctes('article')} SELECT id, row_number() OVER (ORDER BY created_at DESC, id DESC)::INT AS place FROM article QUALIFY place BETWEEN 61 AND 90")
def o03(spark, sf_dir):
    found = L.page(domain(spark, sf_dir, "article"), 3, stored=True)
    return found.select("id", (60 + F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id")))).alias("place"))


@query("o04_worst_sources", f"WITH {ctes('article')}, s AS (SELECT source_id, count(*) FILTER (created_at <= published_at + INTERVAL 5 MINUTE) AS passed, count(*) FILTER (created_at > published_at + INTERVAL 5 MINUTE) AS failed FROM article GROUP BY 1) SELECT * FROM s WHERE failed > 0 ORDER BY failed DESC, passed, source_id LIMIT 10")
def o04(spark, sf_dir):
    return L.misses(O.discovery_slo(domain(spark, sf_dir, "article")))


@query("o05_inbox", f"WITH {ctes('attempt', 'news_event')} SELECT id, source_id AS user_id FROM attempt WHERE id % 1000 IN (SELECT id FROM news_event WHERE NOT hidden AND status <> 'corrected') QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) <= 100")
def o05(spark, sf_dir):
    alerts = domain(spark, sf_dir, "attempt").select("id", F.col("source_id").alias("user_id"), (F.col("id") % 1000).alias("event_id"), F.col("started_at").alias("created_at"))
    return L.inbox(alerts, domain(spark, sf_dir, "news_event").where("not hidden and status <> 'corrected'")).select("id", "user_id")


@query("o06_sources_in_order", f"WITH {ctes('report')} SELECT event_id, string_agg(report_id::VARCHAR, ',' ORDER BY reported_at, report_id) AS reports FROM report GROUP BY 1")
def o06(spark, sf_dir):
    return L.sources_in_order(domain(spark, sf_dir, "report")).select("event_id", F.array_join(F.transform("sources", lambda s: s["report_id"].cast("string")), ",").alias("reports"))


@query("o06_history", f"WITH {ctes('usage')} SELECT id AS revision_id, event_key AS event_id FROM usage QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY created_at DESC, id DESC) <= 20")
def o06_history(spark, sf_dir):
    return L.history(domain(spark, sf_dir, "usage").select(F.col("id").alias("revision_id"), F.col("event_key").alias("event_id"), F.col("created_at").alias("observed_at"))).select("revision_id", "event_id")


@query("o07_storyline_members", f"WITH {ctes('news_event')} SELECT id % 50 AS storyline_id, id AS event_id FROM news_event WHERE NOT hidden QUALIFY row_number() OVER (PARTITION BY id % 50 ORDER BY event_time, id) <= 20")
def o07(spark, sf_dir):
    e = domain(spark, sf_dir, "news_event")
    return L.members(e.select((F.col("id") % 50).alias("storyline_id"), F.col("id").alias("event_id")), e).select("storyline_id", "event_id")


def _gone(spark, sf_dir):
    k = F.col("id")
    a = domain(spark, sf_dir, "article").withColumns({"url_status": F.when(k % 8 == 1, "gone").otherwise("live"), "gone_http_status": F.when(k % 8 == 1, 410), "gone_at": F.lit(None).cast("timestamp_ntz"), "url": F.concat("url", F.lit("#"), k.cast("string"))})
    return L.note_gone(a, a.where("id % 6 = 1").select("url", F.lit(404).alias("http_status")), now())


@query("l07_note_gone", f"WITH {ctes('article')} SELECT id, CASE WHEN id % 8 = 1 OR id % 6 = 1 THEN 'gone' ELSE 'live' END AS url_status, CASE WHEN id % 8 = 1 THEN 410 WHEN id % 6 = 1 THEN 404 END AS gone_http_status FROM article")
def l07(spark, sf_dir):
    return _gone(spark, sf_dir)[0].select("id", "url_status", "gone_http_status")


@query("l07_revisions", f"WITH {ctes('article')} SELECT id, title, 'live' AS status FROM article WHERE id % 6 = 1 AND id % 8 <> 1")
def l07_revisions(spark, sf_dir):
    return _gone(spark, sf_dir)[1].select("id", "title", "status")


_TAKEN = "s AS (SELECT k AS id, k % 10 = 0 AS hidden FROM range(0, 500) t(k)), v AS (SELECT event_id % 500 AS id, event_id AS seq, event_id % 3 <> 0 AS hide FROM events WHERE event_id % 7 <> 0)"


def _taken(spark, sf_dir):
    e = F.col("event_id")
    state = spark.range(500).select(F.lit("article").alias("kind"), "id", (F.col("id") % 10 == 0).alias("hidden"))
    return L.takedowns(state, read(spark, sf_dir, "events").select(F.lit("article").alias("kind"), (e % 500).alias("id"), e.alias("seq"), (e % 3 != 0).alias("hide"), F.when(e % 7 == 0, " ").otherwise("a reason").alias("reason")))


@query("c18_takedowns", f"WITH {_TAKEN}, l AS (SELECT id, arg_max(hide, seq) AS hide FROM v GROUP BY 1) SELECT s.id, coalesce(hide, hidden) AS hidden FROM s LEFT JOIN l USING (id)")
def c18(spark, sf_dir):
    return _taken(spark, sf_dir)[0].select("id", "hidden")


@query("c18_audit", f"WITH {_TAKEN}, b AS (SELECT v.id, seq, hide, coalesce(lag(hide) OVER (PARTITION BY v.id ORDER BY seq), hidden) AS before_ FROM v JOIN s ON v.id = s.id) SELECT id, seq, CASE WHEN hide THEN 'hide' ELSE 'unhide' END AS action FROM b WHERE hide <> before_")
def c18_audit(spark, sf_dir):
    return _taken(spark, sf_dir)[1].select("id", "seq", "action")


@query("c07_renamed", "WITH s AS (SELECT s_suppkey AS storyline_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS name, s_suppkey % 9 AS n, CASE WHEN s_suppkey % 3 = 0 THEN NULL WHEN s_suppkey % 5 = 0 THEN s_name ELSE 'new ' || s_suppkey END AS new FROM supplier) SELECT storyline_id, CASE WHEN new IS NULL OR (n > 5 AND name <> '') THEN name ELSE new END AS name, CASE WHEN new IS NULL OR (n > 5 AND name <> '') OR name = '' OR new = name THEN 0 ELSE 1 END AS renamed FROM s")
def c07(spark, sf_dir):
    k, name = F.col("s_suppkey"), F.col("s_name")
    s = read(spark, sf_dir, "supplier")
    stories = s.select(k.alias("storyline_id"), F.when(k % 4 == 0, "").otherwise(name).alias("name"), (k % 9).alias("n_events"), F.lit(None).cast("array<struct<name:string,replaced_at:timestamp_ntz,events:bigint>>").alias("previous"))
    stories = stories.withColumn("previous", F.array().cast("array<struct<name:string,replaced_at:timestamp_ntz,events:bigint>>"))
    proposed = s.where(k % 3 != 0).select(k.alias("storyline_id"), F.when(k % 5 == 0, name).otherwise(F.concat(F.lit("new "), k.cast("string"))).alias("name"))
    return L.renamed(stories, proposed, now()).select("storyline_id", "name", F.size("previous").alias("renamed"))


@query("w08_per_category", f"WITH {ctes('article', 'classification')}, {LATEST_C.replace('PARTITION BY article_id, variant', 'PARTITION BY article_id')} SELECT a.id, category FROM article a JOIN latest l ON a.id = l.article_id WHERE category IS NOT NULL QUALIFY row_number() OVER (PARTITION BY category ORDER BY published_at DESC, a.id DESC) <= 25")
def w08(spark, sf_dir):
    return L.per_category(domain(spark, sf_dir, "article"), domain(spark, sf_dir, "classification"), 100).select("id", "category")


@query("d08_periods", "WITH p(period, since) AS (VALUES ('now', TIMESTAMP '2024-01-19 22:00:00'), ('today', TIMESTAMP '2024-01-20 20:30:00'), ('week', TIMESTAMP '2024-01-13 22:00:00'), ('latest', TIMESTAMP '2023-12-21 22:00:00')) SELECT period, since, count(*) AS n FROM p JOIN events ON ts >= since GROUP BY 1, 2")
def d08(spark, sf_dir):
    moment = F.lit("2024-01-20 22:00:00").cast("timestamp_ntz")
    e = read(spark, sf_dir, "events").select("ts", F.explode(F.array(*map(F.lit, ("now", "today", "week", "latest")))).alias("period")).withColumn("since", L.period_start(F.col("period"), moment))
    return e.where("ts >= since").groupBy("period", "since").agg(F.count("*").alias("n"))


@query("c31_source_health", f"WITH {ctes('source')} SELECT source_id, CASE WHEN tier = 1 THEN 'healthy' ELSE 'degraded' END AS health, priority FROM source WHERE priority % 3 <> 0")
def c31(spark, sf_dir):
    s = domain(spark, sf_dir, "source").select("source_id", "priority", (F.col("priority") % 3 != 0).alias("enabled"), F.when(F.col("tier") == 1, "healthy").otherwise("degraded").alias("health"), F.col("priority").alias("last_success_at"))
    return L.source_health(s).select("source_id", "health", F.col("last_success_at").alias("priority"))


@query("c31_assets", "SELECT key, false AS shared FROM (VALUES ('Brand#1'), ('gold')) t(key) UNION ALL SELECT DISTINCT p_brand, true FROM part WHERE p_brand <> 'Brand#1'")
def c31_assets(spark, sf_dir):
    own = spark.createDataFrame([("Brand#1",), ("gold",)], "key string")
    return L.asset_catalogue(own, read(spark, sf_dir, "part").select(F.col("p_brand").alias("key")).distinct())


@query("s13_market_feed", "SELECT 'gold_18k' AS symbol, floor(value) * 1000 AS price, date_trunc('second', ts) - INTERVAL 210 MINUTE AS observed_at FROM events")
def s13(spark, sf_dir):
    """A payload for each row of the stream: one series that can be read, one without a price, one without a time, others absent."""
    at = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    payload = F.concat(F.lit('{"current": {"geram18": {"p": "'), F.floor("value").cast("string"), F.lit(',000", "ts": "'), at, F.lit('"}, "ons": {"p": "n/a", "ts": "'), at, F.lit('"}, "sekee": {"p": "5", "ts": "soon"}, "other": {"p": "1"}}}'))
    return L.market_feed(read(spark, sf_dir, "events").select(payload.alias("payload"))).withColumn("price", F.col("price").cast("double"))


@query("s15_dimension", "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN c_name || '!' ELSE c_name END AS name, c_custkey % 5 <> 0 AS enabled FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 5 <> 0")
def s15(spark, sf_dir):
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer")
    stored = c.where((k % 3 != 0) | (k % 5 == 0)).where(k % 3 != 0).select(k.cast("string").alias("key"), F.when(k % 5 == 0, F.when(k % 2 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name"))).otherwise(F.col("c_name")).alias("name"))
    wanted = c.where(k % 5 != 0).select(k.cast("string").alias("key"), F.when(k % 2 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.col("c_name")).alias("name"))
    return L.dimension(stored, wanted, "key", ["name"]).withColumn("key", F.col("key").cast("long"))


@query("k04_insert_or_ignore", "SELECT min(event_id) AS id, user_id, event_type FROM events WHERE event_id % 2 = 1 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 40 = 0) GROUP BY user_id, event_type")
def k04_ignore(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    return L.insert_or_ignore(e.where("id % 40 = 0"), e.where("id % 2 = 1"), ["user_id", "event_type"], F.asc("id"))


@query("k04_insert_or_update", "WITH e AS (SELECT event_id AS id, user_id, event_type FROM events), s AS (SELECT * FROM e WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY id) = 1), n AS (SELECT * FROM e WHERE id % 3 = 1 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY id DESC) = 1) SELECT * FROM n UNION ALL SELECT s.* FROM s ANTI JOIN n ON s.user_id = n.user_id AND s.event_type = n.event_type")
def k04_update(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    keys = ["user_id", "event_type"]
    return L.insert_or_update(L.latest_per(e.where("id % 2 = 0"), keys, F.asc("id")), e.where("id % 3 = 1"), keys, F.desc("id"))


@query("x24_answers", """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 5 AS k FROM orders)
SELECT id, 'topic' AS name, CASE WHEN k < 3 THEN ['a', 'b', 'c'][k + 1] END AS choice, NULL::INT AS score, NULL::BIGINT AS tags, CASE WHEN k = 4 THEN 0.0 ELSE 1.0 END::DOUBLE AS confidence, k < 3 AS stands FROM o
UNION ALL SELECT id, 'level', NULL, CASE WHEN k < 4 THEN k END::INT, NULL, 0.5::DOUBLE, k < 4 FROM o
UNION ALL SELECT id, 'tags', NULL, NULL, CASE WHEN k = 0 THEN 0 ELSE 1 END, CASE WHEN k = 0 THEN 0.0 ELSE 0.25 END::DOUBLE, true FROM o""")
def x24(spark, sf_dir):
    k = (F.col("o_orderkey") % 5).cast("int")
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), k.alias("k"))
    none, text = F.lit(None), "string"
    raw = o.select("id", F.lit("topic").alias("name"), vocab.pick(("a", "b", "c", "x", "y"), F.col("k") + 1).alias("choice"), none.cast("int").alias("score"), none.cast("array<string>").alias("choices"), F.when(F.col("k") == 4, -3.0).otherwise(7.0).alias("confidence"))
    raw = raw.unionByName(o.select("id", F.lit("level").alias("name"), none.cast(text).alias("choice"), F.col("k").alias("score"), none.cast("array<string>").alias("choices"), F.lit(0.5).alias("confidence")))
    raw = raw.unionByName(o.where("k > 0").select("id", F.lit("tags").alias("name"), none.cast(text).alias("choice"), none.cast("int").alias("score"), F.array(F.lit("gold"), F.lit("unknown")).alias("choices"), F.lit(0.25).alias("confidence")))
    questions = [("topic", "choice", ["a", "b", "c"]), ("level", "score", ["0", "1", "2", "3"]), ("tags", "multi", ["gold", "oil"])]
    return L.answers(raw, questions).select("id", "name", "choice", "score", F.when(F.col("kind") == "multi", F.size("choices")).cast("long").alias("tags"), "confidence", "stands")


@query("x27_linked_assets", f"WITH {ctes('news_event')}, a(key, class) AS (VALUES ('gold', 'metal'), ('silver', 'metal'), ('usd', 'fx'), ('oil', 'energy')), p AS (SELECT id AS event_id, key, CASE WHEN id % 5 = 0 THEN 0 WHEN class = 'metal' THEN coalesce(iran_score, 0) ELSE global_score END::INT AS score FROM news_event, a WHERE id % 5 = 0 OR class <> 'energy') SELECT event_id, key, score, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, key)::INT AS place FROM p")
def x27(spark, sf_dir):
    e = domain(spark, sf_dir, "news_event")
    scores = F.create_map(F.lit("metal"), F.coalesce("iran_score", F.lit(0.0)).cast("int"), F.lit("fx"), F.col("global_score").cast("int"))
    return L.linked_assets(e.select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 != 0, scores).alias("asset_scores")), [("gold", "metal"), ("silver", "metal"), ("usd", "fx"), ("oil", "energy")])


_HASH = f"{fold_sql('title')} || '|' || {fold_sql('lead')} || '|' || substr({fold_sql('content')}, 1, 1500)"


@query("c01_ingest", f"""WITH {ctes('article')}, f AS (SELECT id, url || '#' || id AS url, native_category, id % 9 = 2 AS gone, id % 8 = 1 AS was_gone, id % 3 <> 0 AS known, id % 10 = 3 AS other_text, CASE WHEN quality_flag = 'invalid_url' THEN 'invalid_url' ELSE quality_flag END AS flag, {_HASH} AS h FROM (SELECT *, {FLAG.replace("TIMESTAMP '2024-01-20 06:00:00'", "TIMESTAMP '2024-01-31 06:00:00'")} AS quality_flag FROM article)),
s AS (SELECT min(id) AS first_id, CASE WHEN other_text THEN 'stored ' || id ELSE h END AS h FROM f WHERE known GROUP BY 2),
j AS (SELECT f.*, CASE WHEN NOT known AND gone THEN 'ignored' WHEN NOT known THEN 'created' WHEN gone THEN CASE WHEN was_gone THEN 'seen' ELSE 'gone' END WHEN other_text THEN 'revised' WHEN was_gone THEN 'revived' ELSE 'seen' END AS action, first_id FROM f LEFT JOIN s ON f.h = s.h)
SELECT url, action, flag AS quality_flag, CASE WHEN native_category = 'cat3' THEN 'slug:cat3' ELSE '' END AS prefilter_reason, CASE WHEN NOT known THEN first_id END AS duplicate_of, action IN ('created', 'revised') AND flag = '' AND native_category <> 'cat3' AND (known OR first_id IS NULL) AS queued FROM j""")
def c01(spark, sf_dir):
    k = F.col("id")
    a = domain(spark, sf_dir, "article").withColumn("url", F.concat("url", F.lit("#"), k.cast("string")))
    own = T.content_hash(F.col("title"), F.col("lead"), F.col("content"))
    store = a.where(k % 3 != 0).select("id", "url", F.when(k % 10 == 3, F.concat(F.lit("stored "), k.cast("string"))).otherwise(own).alias("content_hash"), F.when(k % 8 == 1, "gone").otherwise("live").alias("url_status"))
    crawl = a.select("url", "title", "lead", "content", "published_at", "native_category", (F.col("native_category") == "cat3").alias("blocked"), (k % 9 == 2).alias("gone"))
    return L.ingested(store, crawl, now()).select("url", "action", "quality_flag", "prefilter_reason", "duplicate_of", "queued")


_BAND = "(1 + ({0} >= 20)::INT + ({0} >= 40)::INT + ({0} >= 60)::INT + ({0} >= 80)::INT)"


_REVIEWS = f"""r AS (SELECT id AS event_id, event_time + INTERVAL 40 DAY AS reviewed_at, CASE WHEN id % 12 = 0 THEN 'pending' ELSE 'reviewed' END AS status, category, CASE WHEN id % 45 <> 6 THEN coalesce(iran_score, 10) END AS iran_score, global_score FROM news_event WHERE id % 3 = 0),
m AS (SELECT event_id, report_id AS id, reported_at AS created_at, {vocab.sql_pick((*vocab.LEGACY_EVENT_CATEGORIES, *vocab.EVENT_CATEGORIES), '(1 + event_id % 15)')} AS m_category, (20 * (event_id % 5))::DOUBLE AS m_iran, (report_id % 101)::DOUBLE AS m_global FROM report WHERE event_id % 7 <> 0),
st AS (SELECT r.*, m.* EXCLUDE (event_id) FROM r LEFT JOIN m ON r.event_id = m.event_id AND created_at <= reviewed_at WHERE status = 'reviewed' AND iran_score IS NOT NULL AND global_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY r.event_id ORDER BY id DESC NULLS LAST, created_at DESC) = 1),
w AS (SELECT st.*, CASE WHEN st.id IS NULL THEN e.category ELSE m_category END AS said, CASE WHEN st.id IS NULL THEN e.iran_score ELSE m_iran END AS iran, CASE WHEN st.id IS NULL THEN e.global_score ELSE m_global END AS world FROM st JOIN news_event e ON e.id = st.event_id),
d AS (SELECT coalesce(nullif(today, ''), 'unassessed') AS category, today = category AS c, coalesce({_BAND.format('iran_score')} = {_BAND.format('iran')} AND {_BAND.format('global_score')} = {_BAND.format('world')}, false) AS b
      FROM (SELECT *, CASE said {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.LEGACY_EVENT_CATEGORIES.items())} ELSE coalesce(said, '') END AS today FROM w))"""


@query("a22_review_statistics", f"WITH {ctes('news_event', 'report')}, {_REVIEWS} SELECT category, count(*) AS reviewed, round(count(*) FILTER (c AND b) / count(*)::DOUBLE, 3) AS agreement_rate, round(count(*) FILTER (c) / count(*)::DOUBLE, 3) AS category_match_rate, round(count(*) FILTER (b) / count(*)::DOUBLE, 3) AS tier_match_rate FROM d GROUP BY GROUPING SETS ((), (category))")
def a22(spark, sf_dir):
    """Some reviews are not finished, some lack a score, some events have no assessment, some assessments an older category."""
    every = domain(spark, sf_dir, "news_event")
    e, i = every.where("id % 3 = 0"), F.col("id")
    reviews = e.select(
        i.alias("event_id"), (F.col("event_time") + L.days(40)).alias("reviewed_at"), F.when(i % 12 == 0, "pending").otherwise("reviewed").alias("status"), "category",
        F.when(i % 45 != 6, F.coalesce("iran_score", F.lit(10.0))).alias("iran_score"), "global_score",
    )
    k = F.col("event_id")
    names = (*vocab.LEGACY_EVENT_CATEGORIES, *vocab.EVENT_CATEGORIES)
    m = domain(spark, sf_dir, "report").where(k % 7 != 0).select("event_id", F.col("report_id").alias("id"), F.col("reported_at").alias("created_at"), vocab.pick(names, 1 + k % 15).alias("category"), (20 * (k % 5)).cast("double").alias("iran_score"), (F.col("report_id") % 101).cast("double").alias("global_score"))
    # report ids repeat in the driver's tables, all with one category and scores: the last column tells them apart by time
    return L.review_statistics(reviews, m, every.select(i.alias("event_id"), "category", "iran_score", "global_score"))
