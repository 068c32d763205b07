"""Retrieval, storylines, extraction, exports and row rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import vocab
from newsloom.adapt import EVENT_NOW, NOW, ctes, domain
from newsloom.functions import score as X
from newsloom.functions import time as D
from newsloom.operators import export as K
from newsloom.operators import neighbours as N
from newsloom.operators import retrieval as R
from newsloom.plans.joins import latest_per
from newsloom.queries.articles import grams_sql, key_sql
from newsloom.queries.events import IMPACT
from newsloom.registry import query
from newsloom.sources import pages as S
from newsloom.tables import read


def now():
    return F.lit(EVENT_NOW).cast("timestamp_ntz")


_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_COS = f"({_DOT.format('a.embedding', 'b.embedding')} / sqrt({_DOT.format('a.embedding', 'a.embedding')} * {_DOT.format('b.embedding', 'b.embedding')}))"


@query("j16_nearest", f"WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 10 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id)::INT AS place FROM s QUALIFY place <= 5")
def j16(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    rows = N.rows_of(v)
    return N.nearest(rows.where("id % 10 = 0"), rows, 5).select("query_id", "id", "place")


_BY_CATEGORY = f"(a.category IS NULL OR b.category = a.category OR b.category = '{vocab.BOTH_CATEGORIES}')"
_MEMORY = f"""v AS (SELECT vec_id AS id, embedding, vec_id % 97 = 0 AS reviewed, CASE WHEN vec_id % 41 <> 0 THEN vec_id END AS at_, {vocab.sql_pick(vocab.CATEGORIES, "(1 + vec_id % 4)")} AS category FROM embeddings),
q AS (SELECT id, embedding, at_, CASE WHEN id % 3 <> 0 THEN category END AS category FROM v WHERE id % 10 = 0),
m AS (SELECT a.id AS query_id, b.id, a.id % 70 = 0 AS blind, b.reviewed AND {_BY_CATEGORY} AND (a.at_ IS NULL OR b.at_ IS NULL OR b.at_ < a.at_) AS human, a.at_ IS NULL OR coalesce(b.at_ < a.at_, false) AS past, a.embedding AS x, b.embedding AS y FROM q a JOIN v b ON a.id <> b.id),
s AS (SELECT query_id, id, human AS reviewed, {_COS.replace("a.embedding", "x").replace("b.embedding", "y")} AS score FROM m WHERE NOT blind AND (human OR past)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, reviewed ORDER BY score DESC, id) AS r FROM s),
g AS (SELECT id, {grams_sql(key_sql("title"))} AS g FROM article),
t AS (SELECT m.query_id, m.id, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS both_ FROM m JOIN g a ON a.id = m.query_id JOIN g b ON b.id = m.id WHERE blind AND human),
u AS (SELECT query_id, id, reviewed, score FROM n WHERE (reviewed AND r <= 8) OR (NOT reviewed AND r <= 24 AND id % 3 <> 0) UNION ALL SELECT query_id, id, true, shared / (both_ - shared)::DOUBLE FROM t WHERE shared > 0)"""


@query("c11_memory_examples", f"WITH {ctes('article')}, {_MEMORY} SELECT query_id, id, reviewed, row_number() OVER (PARTITION BY query_id ORDER BY reviewed DESC, score DESC, id)::INT AS place FROM u QUALIFY place <= 8")
def c11_memory(spark, sf_dir):
    """Examples for the query set, a tenth of the rows: those that a person labelled, then the past that a model did. Some queries
    have no vector, some rows no moment, some queries no category."""
    titles = domain(spark, sf_dir, "article").select("id", "title")
    k = F.col("id")
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 41 != 0, F.timestamp_seconds("vec_id")).alias("at"), vocab.pick(vocab.CATEGORIES, 1 + F.col("vec_id") % 4).alias("category"))
    v = v.join(titles, "id", "left")
    queries = v.where(k % 10 == 0).withColumns({"vector": F.when(k % 70 != 0, F.col("vector")), "category": F.when(k % 3 != 0, F.col("category"))})
    return R.memory_examples(queries, v.where(k % 97 == 0), v.withColumn("usable", k % 3 != 0), 8).select("query_id", "id", "reviewed", "place")


@query("c11_similar_titles", f"WITH {ctes('article')}, g AS (SELECT id, {grams_sql(key_sql('title'))} AS g FROM article), s AS (SELECT a.id AS query_id, b.id, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE AS score FROM g a JOIN g b ON a.id % 50 = 0 AND a.id <> b.id WHERE len(list_intersect(a.g, b.g)) > 0) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 3")
def c11(spark, sf_dir):
    a = domain(spark, sf_dir, "article")
    return R.similar_titles(a.where("id % 50 = 0"), a, 3)


_LV = _COS.replace("a.embedding", "l.v").replace("b.embedding", "b.v")


@query(
    "c06_storylines",
    f"""WITH RECURSIVE {ctes('news_event', 'tag')}, e AS (SELECT id, event_time, category, b.embedding AS v FROM news_event LEFT JOIN embeddings b ON b.vec_id = id % 500 WHERE category <> 'other' AND id % 23 <> 0 AND id % 29 <> 0), t AS (SELECT DISTINCT event_id, item FROM tag WHERE event_id IN (SELECT id FROM e)),
sh AS (SELECT x.event_id AS l_id, y.event_id AS e_id, count(*) AS shared FROM t x JOIN t y USING (item) WHERE x.event_id <> y.event_id GROUP BY ALL),
p AS (SELECT l.id AS l_id, b.id AS e_id, b.event_time AS e_at, coalesce(CASE WHEN round({_LV}, 9) >= 0.75 THEN round({_LV}, 9) END, 0) AS s, coalesce(shared, 0) AS shared, l.category = b.category AS same FROM e l JOIN e b ON (b.event_time < l.event_time OR (b.event_time = l.event_time AND b.id < l.id)) AND l.event_time - b.event_time <= INTERVAL 14 DAY LEFT JOIN sh ON sh.l_id = l.id AND sh.e_id = b.id),
parent AS MATERIALIZED (SELECT l_id, e_id FROM p WHERE s >= 0.85 OR (s >= 0.75 AND shared >= 1) OR (shared >= 2 AND same) QUALIFY row_number() OVER (PARTITION BY l_id ORDER BY s + 0.1::DOUBLE * shared DESC, e_at, e_id) = 1),
edge AS MATERIALIZED (SELECT l_id AS u, e_id AS v FROM parent UNION SELECT e_id, l_id FROM parent), reach(id, node) AS (SELECT DISTINCT u, u FROM edge UNION SELECT r.id, e.v FROM reach r JOIN edge e ON r.node = e.u)
SELECT id AS event_id, min(node) AS storyline_id FROM reach GROUP BY 1""",
)
def c06(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_k"), F.col("embedding").alias("vector"))
    e = domain(spark, sf_dir, "news_event")
    e = e.withColumns({"status": F.when(F.col("id") % 23 == 0, "withdrawn").otherwise(F.col("status")), "category": F.when(F.col("id") % 29 == 0, "").otherwise(F.col("category"))})
    e = R.storied(e).join(v, F.col("id") % 500 == F.col("_k"), "left").select("id", "event_time", "category", "vector")
    tags = domain(spark, sf_dir, "tag").join(e.select(F.col("id").alias("event_id")), "event_id", "left_semi").select("event_id", "item")
    return R.storylines(e, tags)


@query("s08_extract_pages")
def s08(spark, sf_dir):
    """HTML is beyond SQL; tests hold fields against pages written by hand."""
    return S.extract(read(spark, sf_dir, "pages"))


_WB = f"w AS (SELECT id, event_time, category, {D.jalali_sql('(event_time + INTERVAL 210 MINUTE)::DATE')} AS jalali_day FROM news_event), n AS (SELECT *, row_number() OVER (PARTITION BY jalali_day ORDER BY event_time, id)::INT AS number FROM w)"


def _workbook(spark, sf_dir):
    return K.workbook(domain(spark, sf_dir, "news_event"))


_FORMULA = """'=IF(COUNT(E' || r || ':G' || r || ')<2,"insufficient",IF(MIN(E' || r || ':G' || r || ')<2,"no",IF(COUNTIF(E' || r || ':G' || r || ',">=4")>=2,"notify","no")))'"""


@query("k01_workbook", f"WITH {ctes('news_event')}, {_WB} SELECT jalali_day, number, id, {_FORMULA.replace('r ||', '(number + 1) ||')} AS notify_formula FROM n")
def k01(spark, sf_dir):
    return _workbook(spark, sf_dir).select("jalali_day", "number", "id", K.notify_formula(F.col("number") + 1).alias("notify_formula"))


@query("k02_feeds", f"WITH {ctes('news_event')}, {_WB} SELECT jalali_day, category AS feed, count(*) AS n, string_agg(id::VARCHAR || ' ' || category, chr(10) ORDER BY number) AS text FROM n GROUP BY 1, 2")
def k02(spark, sf_dir):
    rows = _workbook(spark, sf_dir)
    return K.feeds(rows.select("jalali_day", "number", F.col("category").alias("feed"), F.concat_ws(" ", F.col("id").cast("string"), "category").alias("line")))


@query("c16_changed_days", f"WITH {ctes('news_event')}, {_WB} SELECT id, jalali_day FROM n WHERE jalali_day IN (SELECT jalali_day FROM n WHERE id % 97 = 0)")
def c16(spark, sf_dir):
    rows = _workbook(spark, sf_dir)
    return K.changed_days(rows, rows.where("id % 97 = 0").select("id")).select("id", "jalali_day")


@query("k03_retention", "WITH f AS (SELECT concat('wb', o_custkey) AS name, o_orderstatus AS kind, max(o_orderdate) AS modified_at FROM orders GROUP BY ALL) SELECT name, kind FROM f QUALIFY row_number() OVER (PARTITION BY kind ORDER BY modified_at DESC, name DESC) > 30")
def k03(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return K.outdated(o.groupBy(F.concat(F.lit("wb"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("kind")).agg(F.max("o_orderdate").alias("modified_at")), 30).select("name", "kind")


@query("c22_email_digest", f"WITH {ctes('account')}, a AS (SELECT event_id AS alert_id, user_id, ts AS created_at FROM events), o AS (SELECT user_id FROM account WHERE dial <> 'high') SELECT alert_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, alert_id DESC)::INT AS place FROM a WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY AND alert_id % 9 <> 0 AND user_id IN (SELECT user_id FROM o) QUALIFY place <= 20")
def c22(spark, sf_dir):
    alerts = domain(spark, sf_dir, "attempt").select(F.col("id").alias("alert_id"), F.col("source_id").alias("user_id"), F.col("started_at").alias("created_at"))
    sent = alerts.where("alert_id % 9 = 0").select("alert_id", F.lit("email").alias("channel"))
    accounts = domain(spark, sf_dir, "account").withColumn("email_digest", F.col("dial") != "high")
    return K.digest(alerts, sent, accounts, F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(10))).select("alert_id", "user_id", "place")


@query("c25_watchlist", f"WITH {ctes('account')}, c AS (SELECT user_id, item FROM account WHERE user_id % 3 <> 0), w AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'Brand#1' ELSE item END AS item FROM account WHERE user_id % 5 <> 0) SELECT coalesce(c.user_id, w.user_id) AS user_id, coalesce(c.item, w.item) AS item, CASE WHEN c.user_id IS NULL THEN 'add' WHEN w.user_id IS NULL THEN 'remove' ELSE 'keep' END AS action FROM c FULL JOIN w ON c.user_id = w.user_id AND c.item = w.item")
def c25(spark, sf_dir):
    a = domain(spark, sf_dir, "account")
    return K.replace_watchlist(a.where("user_id % 3 <> 0"), a.where("user_id % 5 <> 0").withColumn("item", F.when(F.col("user_id") % 4 == 0, "Brand#1").otherwise(F.col("item"))))


@query("x_row_rules", f"""WITH {ctes('news_event')}, i AS (SELECT *, (id % 8)::INT AS k, coalesce(iran_score, 0) AS i0 FROM news_event) SELECT id,
least(360.0::DOUBLE, 5.0::DOUBLE * pow(2.0::DOUBLE, k)) AS retry_minutes, k >= 5 OR status = 'corrected' AS gives_up, CASE WHEN k <= 4 THEN k * 25 END AS stored_score,
coalesce(confidence >= 0.8::DOUBLE AND (k % 2 = 0 OR k >= 2) AND (iran_score >= 80 OR global_score >= 85 OR i0 >= 80), false) AS push_worthy,
CASE WHEN k <= 4.9::DOUBLE THEN 7 ELSE 30 END AS chart_days, floor(i0 * 10 + 0.5::DOUBLE) / 100.0::DOUBLE AS toman, CASE WHEN global_score * 12345 / 10.0::DOUBLE >= 1000 THEN floor(global_score * 12345 / 10.0::DOUBLE + 0.5::DOUBLE) ELSE floor(global_score * 12345 / 10.0::DOUBLE * 100 + 0.5::DOUBLE) / 100.0::DOUBLE END AS toman_large, CASE WHEN i0 > 40 THEN '▲' WHEN i0 < 40 THEN '▼' ELSE '→' END AS glyph,
CASE WHEN k = 0 THEN 'wallet_empty' WHEN k IN (1, 2) THEN 'circuit_open' WHEN i0 >= 80 THEN 'monthly_budget' WHEN global_score >= 60 THEN 'daily_budget' ELSE '' END AS pause_reason, CASE WHEN global_score >= 95 THEN 'breaking' WHEN NOT hidden AND k >= CASE id % 4 WHEN 0 THEN 2 WHEN 2 THEN 4 ELSE 3 END THEN 'watch' ELSE '' END AS alert_reason, k - CASE WHEN hidden THEN 5.5::DOUBLE ELSE 0.0::DOUBLE END AS boosted, {IMPACT} AS impact,
(k * 1000.0::DOUBLE * 0.15::DOUBLE + 500.0::DOUBLE * 0.6::DOUBLE) / 1e6::DOUBLE AS token_cost FROM i""")
def x_rules(spark, sf_dir):
    """Rules of a single row: retries, answers, push, charts, money, pauses, boosts."""
    e = domain(spark, sf_dir, "news_event")
    k = (F.col("id") % 8).cast("int")
    i0 = F.coalesce("iran_score", F.lit(0.0))
    return e.select(
        "id",
        X.retry_minutes(k + 1).alias("retry_minutes"),
        X.gives_up(k + 1, F.when(F.col("status") == "corrected", "parse").otherwise("network")).alias("gives_up"),
        X.stored_score(k).alias("stored_score"),
        X.push_worthy(F.col("confidence"), 1 + k % 2, k, F.col("iran_score"), F.col("global_score"), i0).alias("push_worthy"),
        X.chart_days(k.cast("double")).alias("chart_days"),
        X.toman(i0).alias("toman"),
        X.toman(F.col("global_score") * 12345).alias("toman_large"),
        X.direction_glyph(i0 - 40).alias("glyph"),
        X.pause_reason(vocab.pick((*vocab.OPEN_CIRCUITS, "closed", "closed", "closed", "closed", "probing"), k + 1), i0, F.col("global_score"), F.lit(80.0), F.lit(60.0)).alias("pause_reason"),
        X.alert_reason(vocab.pick(("low", "medium", "high", "other"), F.col("id") % 4 + 1), k, F.when(F.col("global_score") >= 95, 5).otherwise(4), ~F.col("hidden")).alias("alert_reason"),
        X.boosted_place(k, F.col("hidden")).alias("boosted"),
        X.impact(F.col("iran_score"), F.col("global_score")).alias("impact"),
        X.token_cost(k * 1000.0, F.lit(500.0), F.lit(0.15), F.lit(0.6)).alias("token_cost"),
    )


@query("a19_funnel", f"WITH {ctes('usage')} SELECT stage, count(*) AS n, count(*) FILTER (status = 'failed') AS failed, count(DISTINCT run_id) AS runs, count(DISTINCT event_key) AS articles FROM usage GROUP BY 1")
def a19(spark, sf_dir):
    return domain(spark, sf_dir, "usage").groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_distinct("run_id").alias("runs"), F.count_distinct("event_key").alias("articles"))


@query("a20_feed_stats", f"WITH {ctes('report')} SELECT independence_group, count(*) AS reports, count(DISTINCT event_id) AS events, count(DISTINCT source_id) AS sources, bool_or(stance = 'contradicts') AS disputes FROM report GROUP BY 1")
def a20(spark, sf_dir):
    """By independence group."""
    return domain(spark, sf_dir, "report").groupBy("independence_group").agg(F.count("*").alias("reports"), F.count_distinct("event_id").alias("events"), F.count_distinct("source_id").alias("sources"), F.bool_or(F.col("stance") == "contradicts").alias("disputes"))


@query("a26_cost_estimate", f"WITH {ctes('article')} SELECT language, sum(ceil(length(content) / 3.0::DOUBLE))::BIGINT AS tokens FROM article GROUP BY 1")
def a26(spark, sf_dir):
    return domain(spark, sf_dir, "article").groupBy("language").agg(F.sum(F.ceil(F.length("content") / 3.0)).cast("long").alias("tokens"))


@query("c24_unread", f"WITH {ctes('attempt')} SELECT source_id AS user_id, count(*) AS alerts, count(*) FILTER (status <> 'success') AS unread FROM attempt GROUP BY 1")
def c24(spark, sf_dir):
    """Alerts on hidden events count (Q13)."""
    return domain(spark, sf_dir, "attempt").groupBy(F.col("source_id").alias("user_id")).agg(F.count("*").alias("alerts"), F.count_if(F.col("status") != "success").alias("unread"))


@query("c32_article_cards", f"WITH {ctes('article', 'classification')}, c AS (SELECT * FROM classification QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1) SELECT a.id, coalesce(nullif(CASE WHEN a.id % 3 = 0 THEN '* ' || title ELSE '' END, ''), title) AS card_title, category FROM article a LEFT JOIN c ON a.id = c.article_id")
def c32(spark, sf_dir):
    a = domain(spark, sf_dir, "article")
    c = latest_per(domain(spark, sf_dir, "classification"), ["article_id"], F.desc("created_at"), F.desc("id")).select(F.col("article_id").alias("id"), "category")
    optimised = F.when(F.col("id") % 3 == 0, F.concat(F.lit("* "), "title")).otherwise(F.lit(""))
    return a.join(c, "id", "left").select("id", F.coalesce(F.nullif(optimised, F.lit("")), "title").alias("card_title"), "category")


@query("x15_topics", f"WITH {ctes('news_event')} SELECT category, count(*) AS n FROM news_event GROUP BY 1")
def x15(spark, sf_dir):
    return domain(spark, sf_dir, "news_event").groupBy(X.event_topic(F.col("category")).alias("category")).agg(F.count("*").alias("n"))


@query("c38_failure_counters", f"WITH {ctes('usage')} SELECT created_at::DATE::VARCHAR AS day, stage, CASE event_key % 4 WHEN 0 THEN 'timeout' WHEN 1 THEN 'schema' ELSE 'other' END AS kind, count(*) AS n FROM usage WHERE status = 'failed' GROUP BY ALL")
def c38(spark, sf_dir):
    u = domain(spark, sf_dir, "usage").where("status = 'failed'")
    raw = F.when(F.col("event_key") % 4 == 0, "timeout").when(F.col("event_key") % 4 == 1, "schema").otherwise("mystery")
    return u.groupBy(F.to_date("created_at").cast("string").alias("day"), "stage", F.when(raw.isin("timeout", "schema", "network", "budget", "refused"), raw).otherwise("other").alias("kind")).agg(F.count("*").alias("n"))


@query("c40_translation_cache", f"WITH {ctes('article')}, cache AS (SELECT id AS article_id, title AS source_title FROM article WHERE id % 2 = 0 UNION ALL SELECT id, title || '?' FROM article WHERE id % 6 = 1) SELECT a.id FROM article a WHERE language <> 'en' AND NOT EXISTS (SELECT 1 FROM cache c WHERE c.article_id = a.id AND c.source_title = a.title)")
def c40(spark, sf_dir):
    """Titles whose translation is not cached: the key holds the source title, so a changed one misses."""
    a = domain(spark, sf_dir, "article")
    cache = a.where("id % 2 = 0").select("id", "title").unionByName(a.where("id % 6 = 1").select("id", F.concat("title", F.lit("?")).alias("title")))
    return a.where("language <> 'en'").join(cache, ["id", "title"], "left_anti").select("id")
