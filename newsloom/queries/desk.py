"""The desk's operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.adapt import ctes, domain
from newsloom.functions import score as X
from newsloom.operators import desk as K
from newsloom.plans.joins import latest_per
from newsloom.queries.events import IMPACT
from newsloom.queries.market import MOMENTS, moments, prices
from newsloom.registry import query
from newsloom.tables import read


@query("c03_split", f"WITH {ctes('article')}, m AS (SELECT id % 20 AS event_id, id AS article_id FROM article) SELECT DISTINCT CASE WHEN event_id = 3 AND article_id IN (23, 24) THEN 99 ELSE event_id END AS event_id, article_id FROM m")
def c03(spark, sf_dir):
    a = domain(spark, sf_dir, "article").select("id", F.when(F.col("id") == 24, F.lit(23)).alias("duplicate_of"))
    return K.split_event(a.select((F.col("id") % 20).alias("event_id"), F.col("id").alias("article_id")), a, 3, 23, 99).withColumn("event_id", F.col("event_id").cast("long"))


@query("c03_primary", f"WITH {ctes('article')} SELECT id % 20 AS event_id, arg_min(id, published_at) AS article_id FROM article GROUP BY 1")
def c03p(spark, sf_dir):
    a = domain(spark, sf_dir, "article").select("id", F.col("published_at").alias("reported_at"))
    return K.primary(a.select((F.col("id") % 20).alias("event_id"), F.col("id").alias("article_id")), a)


@query("c04_review_sample", f"WITH {ctes('news_event')}, r AS (SELECT id, CASE WHEN {IMPACT} >= 60 AND confidence < 0.7::DOUBLE THEN 'uncertain' WHEN id % 20 = 0 THEN 'audit' END AS reason FROM news_event) SELECT * FROM r WHERE reason IS NOT NULL")
def c04(spark, sf_dir):
    e = domain(spark, sf_dir, "news_event")
    return K.review_sample(e.withColumn("impact", X.impact(F.col("iran_score"), F.col("global_score")))).select("id", "reason")


@query("c05_next_step", f"WITH {ctes('article', 'classification')}, c AS (SELECT article_id AS id, bool_or(category = 'other') AS stopped FROM classification GROUP BY 1) SELECT a.id, CASE WHEN c.id IS NULL THEN 'classify' WHEN a.id % 2 = 0 THEN 'summarise' ELSE 'evaluate' END AS next_step FROM article a LEFT JOIN c ON a.id = c.id WHERE NOT coalesce(stopped, false)")
def c05(spark, sf_dir):
    a = domain(spark, sf_dir, "article").select("id")
    c = domain(spark, sf_dir, "classification").select(F.col("article_id").alias("id"), F.lit("classify").alias("step"), F.col("category").alias("value"))
    e = a.where("id % 2 = 0").select("id", F.lit("evaluate").alias("step"), F.lit("").alias("value"))
    return K.answered_gate(a, c.unionByName(e), ("classify", "evaluate", "summarise"))


@query("c12_timeline", f"WITH {ctes('article', 'price')}, {MOMENTS}, d AS (SELECT symbol, observed_at::DATE AS day, arg_max(price, observed_at) AS price FROM price GROUP BY ALL), n AS (SELECT symbol, happened::DATE AS day, count(*) AS n FROM moments WHERE id % 100 >= 50 GROUP BY ALL) SELECT d.symbol, d.day::VARCHAR AS day, price, price - lag(price) OVER (PARTITION BY d.symbol ORDER BY d.day) AS change, coalesce(n, 0)::BIGINT AS markers FROM d LEFT JOIN n ON n.symbol = d.symbol AND n.day = d.day")
def c12(spark, sf_dir):
    m = moments(spark, sf_dir).withColumn("relevance", F.col("id") % 100)
    return K.timeline(prices(spark, sf_dir), m).withColumn("day", F.col("day").cast("string"))


@query("c19_prefilter_deltas", f"WITH {ctes('article')} SELECT count(*) FILTER (native_category <> 'cat1' AND native_category = 'cat3') AS held, count(*) FILTER (native_category = 'cat1' AND native_category <> 'cat3') AS released FROM article")
def c19(spark, sf_dir):
    a = domain(spark, sf_dir, "article")
    mark = lambda c: a.select("id", F.when(F.col("native_category") == c, "slug").otherwise("").alias("prefilter_reason"))
    return K.deltas(mark("cat1"), mark("cat3"))


@query("c20_image_work", f"WITH {ctes('article')} SELECT id FROM article WHERE id % 3 = 0 AND source_id <> 'src3' ORDER BY created_at DESC, id DESC LIMIT 200")
def c20(spark, sf_dir):
    a = domain(spark, sf_dir, "article").withColumns({"image_url": F.concat(F.lit("https://"), "source_id", F.lit("/i.jpg")), "image_status": F.when(F.col("id") % 3 == 0, "pending").otherwise("stored")})
    return K.image_work(a, spark.createDataFrame([("src3",)], "host string")).select("id")


@query("c23_deliveries", f"WITH {ctes('attempt')}, d AS (SELECT id AS alert_id, source_id * 2 + k AS device_id FROM attempt, unnest([0, 1]) t(k)) SELECT alert_id, device_id FROM d WHERE NOT (alert_id % 3 = 0 AND device_id % 2 = 0)")
def c23(spark, sf_dir):
    d = domain(spark, sf_dir, "attempt").select(F.col("id").alias("alert_id"), F.explode(F.array(F.col("source_id") * 2, F.col("source_id") * 2 + 1)).alias("device_id"))
    return K.deliveries(d, d.where("alert_id % 3 = 0 and device_id % 2 = 0"))


@query("c26_next_pair", f"WITH {ctes('account')}, p AS (SELECT unnest(range(0, 20)) AS pair_id), u AS (SELECT user_id FROM account) SELECT user_id, min(pair_id) AS pair_id FROM u CROSS JOIN p WHERE NOT (pair_id <= user_id % 25) GROUP BY 1")
def c26(spark, sf_dir):
    users = domain(spark, sf_dir, "account").select("user_id")
    pairs = spark.range(20).withColumnRenamed("id", "pair_id")
    seen = users.select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("user_id") % 25)).alias("pair_id"))
    return K.next_pair(pairs, seen, users)


@query("c29_outcomes", f"WITH {ctes('review', 'classification')}, c AS (SELECT * FROM classification QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1) SELECT r.article_id AS id, CASE WHEN c.id % 5 <> 0 THEN category END AS predicted, coalesce(c.id % 5 <> 0 AND category = CASE WHEN toxic = 1 THEN 'security' ELSE 'economics' END, false) AS hit, CASE WHEN toxic = 1 THEN 'security' ELSE 'economics' END AS truth FROM review r LEFT JOIN c USING (article_id)")
def c29(spark, sf_dir):
    c = latest_per(domain(spark, sf_dir, "classification"), ["article_id"], F.desc("created_at"), F.desc("id"))
    labels = domain(spark, sf_dir, "review").select(F.col("article_id").alias("id"), F.when(F.col("toxic") == 1, "security").otherwise("economics").alias("truth"))
    return K.outcomes(labels, c.select(F.col("article_id").alias("id"), F.col("category").alias("answer"), (F.col("id") % 5 != 0).alias("usable")))


@query("a24_grouping_quality", "SELECT count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') / nullif(count(*) FILTER (l_returnflag = 'R'), 0)::DOUBLE AS precision, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') / nullif(count(*) FILTER (l_linestatus = 'F'), 0)::DOUBLE AS recall FROM lineitem")
def a24(spark, sf_dir):
    return K.grouping_quality(read(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").alias("called"), (F.col("l_linestatus") == "F").alias("same")))


@query("c33_canary", f"WITH {ctes('attempt')} SELECT source_id, sum(fetched % 3)::BIGINT AS parsed, count(*) FILTER (id % 2 = 0) AS with_image, sum(fetched % 3) = 0 AS degraded, string_agg(DISTINCT status, ',' ORDER BY status) AS tiers FROM attempt GROUP BY 1")
def c33(spark, sf_dir):
    a = domain(spark, sf_dir, "attempt")
    return K.canary(a.select("source_id", (F.col("fetched") % 3).alias("parsed"), (F.col("id") % 2 == 0).alias("with_image"), F.col("status").alias("tier"))).withColumn("tiers", F.array_join("tiers", ","))


@query("c34_embedding_backlog", f"WITH {ctes('article')} SELECT id FROM article WHERE id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0) ORDER BY created_at DESC, id DESC LIMIT 100")
def c34(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 2 == 0, "m").otherwise("n").alias("model"))
    return K.embedding_backlog(domain(spark, sf_dir, "article"), e, "m", 100)


@query("c37_independence", f"WITH {ctes('source')} SELECT source_id, CASE WHEN NOT is_aggregator THEN coalesce(nullif(independence_group, ''), source_id) END AS key FROM source")
def c37(spark, sf_dir):
    s = domain(spark, sf_dir, "source")
    return s.select("source_id", K.independence_key(F.col("source_id"), F.col("independence_group"), F.col("is_aggregator")).alias("key"))


@query("c41_tags", f"WITH {ctes('tag')}, o AS (SELECT event_id, item FROM tag WHERE event_id % 2 = 0), n AS (SELECT event_id, item, max(CAST(substr(item, 7) AS INT) % 4) AS level FROM tag GROUP BY ALL), t AS (SELECT event_id, item FROM n WHERE level >= 1 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY level DESC, item) <= 2) SELECT * FROM o UNION SELECT * FROM t")
def c41(spark, sf_dir):
    t = domain(spark, sf_dir, "tag").select("event_id", "item")
    answered = t.distinct().withColumn("level", F.substring("item", 7, 9).cast("int") % 4)
    return K.accumulate_tags(t.where("event_id % 2 = 0"), answered, 2)


@query("c43_log_tail", f"WITH {ctes('usage')} SELECT id, stage FROM usage ORDER BY created_at DESC, id DESC LIMIT 500")
def c43(spark, sf_dir):
    return K.log_tail(domain(spark, sf_dir, "usage")).select("id", "stage")


def _interested(events, spark, sf_dir):
    e = events.select(F.col("id").alias("event_id"), F.array(F.lit("iran"), F.col("category")).alias("topics"))
    u = F.col("user_id")
    s = domain(spark, sf_dir, "account").select(F.concat(F.lit("u"), u.cast("string")).alias("endpoint"), (u % 10 == 0).alias("iran"), F.lit(False).alias("world"), F.when(u % 4 == 1, F.array(F.lit("disasters"))).otherwise(F.array().cast("array<string>")).alias("assets"))
    return K.interested(e, s)


_J15 = f"WITH {ctes('news_event', 'account')}, t AS (SELECT id AS event_id, unnest(['iran', category]) AS topic FROM news_event), w AS (SELECT user_id, 'iran' AS topic FROM account WHERE user_id % 10 = 0 UNION SELECT user_id, 'disasters' FROM account WHERE user_id % 4 = 1) SELECT DISTINCT event_id, 'u' || user_id AS endpoint FROM t JOIN w USING (topic)"
@query("j15_interested", _J15)
@query("j15_interested_whole", _J15)
def j15(spark, sf_dir):
    return _interested(domain(spark, sf_dir, "news_event"), spark, sf_dir)


@query("x26_lead_outlet", f"WITH {ctes('report')}, o AS (SELECT event_id, reported_at, report_id, CASE WHEN source_id % 9 = 0 THEN 'nine' ELSE 's' || source_id END AS o FROM report) SELECT event_id, arg_min(o, strftime(reported_at, '%Y-%m-%d') || printf('%012d', report_id) || o) AS lead, (count(DISTINCT o) - 1)::BIGINT AS others FROM o GROUP BY 1")
def x26(spark, sf_dir):
    r = domain(spark, sf_dir, "report")
    s = F.concat(F.lit("s"), F.col("source_id").cast("string"))
    return K.lead_outlet(r.select("event_id", "reported_at", "report_id", F.when(F.col("source_id") % 9 == 0, "nine").otherwise("").alias("outlet"), s.alias("source_name")))


@query("a37_sections", f"WITH {ctes('news_event')}, r AS (SELECT category AS section, row_number() OVER (ORDER BY event_time DESC, id DESC) AS place FROM news_event) SELECT section, min(place)::INT AS best, count(*) AS n FROM r GROUP BY 1")
def a37(spark, sf_dir):
    """Sections of all events by the place of their newest."""
    e = domain(spark, sf_dir, "news_event")
    return K.section_places(e.select(F.col("category").alias("section"), "event_time", "id")).withColumnRenamed("place", "best")


_GATES = """v AS (SELECT id, iran_score, CASE WHEN id % 6 = 0 THEN NULL WHEN id % 50 = 7 THEN 100 - coalesce(iran_score, 0) ELSE coalesce(iran_score, 0) END AS found FROM news_event WHERE id % 3 = 0),
j AS (SELECT count(*) AS reviewed, count(*) FILTER (coalesce(iran_score, 0) >= 80 AND found < 80) AS wrong, count(*) FILTER (coalesce(iran_score, 0) < 80 AND found >= 80) AS missed, count(*) FILTER (coalesce(iran_score, 0) >= 80) AS predicted, count(*) FILTER (found >= 80) AS actual FROM v WHERE found IS NOT NULL),
s AS (SELECT source_id, max(started_at) FILTER (status = 'success') AS last_at FROM attempt GROUP BY 1),
c AS (SELECT count(*) AS sources, count(*) FILTER (source_id % 10 <> 1 AND last_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 6 HOUR) AS recent FROM s WHERE source_id % 9 <> 0),
d AS (SELECT count(*) AS seen, quantile_disc((epoch(created_at) - epoch(published_at)) / 60.0::DOUBLE, 0.95) AS p95 FROM article),
u AS (SELECT sum(CAST(cost / 10000.0::DOUBLE AS DECIMAL(18,6)))::DOUBLE AS spent FROM usage),
m(name, value, floor_, ceiling_, n, least_) AS (
  SELECT 'enabled_sources', sources::DOUBLE, 25, NULL, sources, 0 FROM c UNION ALL SELECT 'healthy_sources', recent, 25, NULL, sources, 0 FROM c UNION ALL SELECT 'reviewed', reviewed, 100, NULL, reviewed, 0 FROM j
  UNION ALL SELECT 'top_cases', least(predicted, actual), 10, NULL, reviewed, 0 FROM j UNION ALL SELECT 'visibility_p95', p95, NULL, 10, seen, 100 FROM d
  UNION ALL SELECT 'false_top', coalesce(wrong / nullif(predicted, 0)::DOUBLE, 0), NULL, 0.02, predicted, 0 FROM j UNION ALL SELECT 'missed_top', coalesce(missed / nullif(actual, 0)::DOUBLE, 0), NULL, 0.05, actual, 0 FROM j
  UNION ALL SELECT 'month_usd', spent, NULL, 100, 1, 0 FROM u)"""


@query("a28_release_gate", f"WITH {ctes('article', 'news_event', 'attempt', 'usage')}, {_GATES} SELECT name, value, n, n >= least_ AND coalesce(value >= floor_, true) AND coalesce(value <= ceiling_, true) AS passed FROM m")
def a28(spark, sf_dir):
    """Every gate of a release: sources that are on and worked in the last six hours, finished reviews, visibility, errors at the
    top, the month's cost."""
    k = F.col("id")
    score = F.coalesce("iran_score", F.lit(0.0))
    reviews = domain(spark, sf_dir, "news_event").where(k % 3 == 0).select("iran_score", F.when(k % 6 == 0, None).when(k % 50 == 7, 100 - score).otherwise(score).alias("reviewed_iran_score"))
    last = domain(spark, sf_dir, "attempt").groupBy("source_id").agg(F.max(F.when(F.col("status") == "success", F.col("started_at"))).alias("last_success_at"))
    sources = last.select((F.col("source_id") % 9 != 0).alias("enabled"), (F.col("source_id") % 10 != 1).alias("healthy"), "last_success_at")
    minutes = (F.unix_timestamp(F.col("created_at").cast("timestamp")) - F.unix_timestamp(F.col("published_at").cast("timestamp"))) / 60.0
    seen = domain(spark, sf_dir, "article").select(minutes.alias("minutes"))
    usage = domain(spark, sf_dir, "usage").select((F.col("cost") / 10_000.0).alias("cost"))
    measures = K.release_measures(reviews, seen, sources, usage, F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"))
    return K.gate(measures).select("name", "value", "n", "passed")
