"""Events over the driver's orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.adapt import EVENT_NOW, ctes, domain
from newsloom.functions import score as X
from newsloom.operators import events as E
from newsloom.plans.joins import latest_per
from newsloom.registry import query

NOW = f"TIMESTAMP '{EVENT_NOW}'"

def now():
    return F.lit(EVENT_NOW).cast("timestamp_ntz")


IMPACT = "coalesce(0.6::DOUBLE * iran_score + 0.4::DOUBLE * global_score, iran_score, global_score)"
RECENT = f"news_event WHERE event_time >= {NOW} - INTERVAL 365 DAY"
AXIS = f"axis_scores AS (SELECT unnest([{{'axis': 'iran', 'score': iran_score}}, {{'axis': 'global', 'score': global_score}}, {{'axis': 'impact', 'score': {IMPACT}}}], recursive := true) FROM {RECENT} AND iran_score IS NOT NULL AND global_score IS NOT NULL AND category <> 'other')"
CUTS = f"""{AXIS}, counted AS (SELECT axis, score, count(*) AS n FROM axis_scores GROUP BY ALL), summed AS (SELECT *, sum(n) OVER (PARTITION BY axis ORDER BY score DESC) AS above, sum(n) OVER (PARTITION BY axis) AS total FROM counted),
cuts AS (SELECT axis, CASE WHEN max(total) >= 200 THEN 'relative' ELSE 'fixed' END AS basis, max(total)::BIGINT AS sample, {", ".join(f"CASE WHEN max(total) >= 200 THEN coalesce(min(score) FILTER (above <= {s}::DOUBLE * total), 'Infinity'::DOUBLE) ELSE {b}::DOUBLE END AS cut{k}" for k, (s, b) in enumerate(zip(E.TOP_SHARES, E.FIXED_BANDS, strict=True), 2))} FROM summed GROUP BY axis)"""
EVIDENCE = """led AS (SELECT event_id, nullif(min({'r': report_id, 'g': coalesce(independence_group, '')}).g, '') AS lead FROM report GROUP BY 1), evidence AS (
SELECT event_id, CASE WHEN bool_or(stance = 'contradicts' AND independence_group IS NOT NULL AND independence_group IS DISTINCT FROM lead) THEN 'disputed' WHEN coalesce(bool_or(starts_with(independence_group, 'official')), false) THEN 'official' WHEN count(DISTINCT independence_group) > 1 THEN 'multi' ELSE 'single' END AS evidence_level, count(DISTINCT independence_group) AS n_groups FROM report JOIN led USING (event_id) GROUP BY 1)"""


def tier_sql(score: str, axis: str) -> str:
    return f"(SELECT CASE WHEN {score} IS NOT NULL THEN 1 + ({score} >= cut2)::INT + ({score} >= cut3)::INT + ({score} >= cut4)::INT + ({score} >= cut5)::INT END FROM cuts WHERE axis = '{axis}')"


def _recent(spark, sf_dir):
    return domain(spark, sf_dir, "news_event").where(F.col("event_time") >= now() - F.make_dt_interval(days=F.lit(365)))


def _cuts(spark, sf_dir):
    return E.cutoffs(E.axis_scores(_recent(spark, sf_dir)))


@query("a15_cutoffs", f"WITH {ctes('news_event')}, {CUTS} SELECT * FROM cuts")
def a15(spark, sf_dir):
    c = _cuts(spark, sf_dir)
    return c.select("axis", "basis", "sample", *[F.col("cuts")[k].alias(f"cut{k + 2}") for k in range(4)])


@query("a15_cutoffs_small", f"WITH {ctes('news_event')}, {CUTS.replace('365 DAY', '30 DAY')} SELECT axis, basis, sample, cut2 FROM cuts")
def a15_small(spark, sf_dir):
    """The thirty days of the rule; where they hold too few events, fixed bands."""
    e = domain(spark, sf_dir, "news_event").where(F.col("event_time") >= now() - F.make_dt_interval(days=F.lit(30)))
    return E.cutoffs(E.axis_scores(e)).select("axis", "basis", "sample", F.col("cuts")[0].alias("cut2"))


@query("x07_tiers", f"WITH {ctes('news_event')}, {CUTS} SELECT id, {IMPACT} AS impact, {tier_sql(IMPACT, 'impact')} AS tier, {tier_sql('global_score', 'global')} AS global_tier, (1 + (global_score >= 20)::INT + (global_score >= 40)::INT + (global_score >= 60)::INT + (global_score >= 80)::INT) AS band FROM {RECENT}")
def x07(spark, sf_dir):
    return E.with_tiers(_recent(spark, sf_dir), _cuts(spark, sf_dir)).select("id", "impact", "tier", "global_tier", X.band(F.col("global_score")).alias("band"))


@query("a32_evidence", f"WITH {ctes('report')}, {EVIDENCE} SELECT * FROM evidence")
def a32(spark, sf_dir):
    return E.evidence(domain(spark, sf_dir, "report"))


_RANK = f"(0.6::DOUBLE * coalesce(iran_score, 0) + 0.4::DOUBLE * coalesce(global_score, 0)) * pow(0.5::DOUBLE, (epoch({NOW}) - epoch(event_time)) / 3600.0::DOUBLE / 12.0::DOUBLE)"


@query(
    "c21_reader_feed",
    f"""WITH {ctes('news_event', 'report')}, {CUTS}, {EVIDENCE}, newest AS (SELECT * FROM news_event WHERE NOT hidden AND category <> 'other' AND status <> 'withdrawn' ORDER BY event_time DESC, id DESC LIMIT 300),
ranked AS (SELECT *, {_RANK} AS rank_score FROM newest ORDER BY rank_score DESC, event_time DESC, id DESC LIMIT 50),
listed AS (SELECT event_id, count(*) AS n_reports, string_agg(report_id::VARCHAR, ',' ORDER BY reported_at, report_id) AS reports FROM report GROUP BY 1)
SELECT r.id, event_time, category, rank_score, {IMPACT} AS impact, {tier_sql(IMPACT, 'impact')} AS tier, evidence_level, coalesce(n_reports, 0)::BIGINT AS n_reports, reports FROM ranked r LEFT JOIN evidence e ON r.id = e.event_id LEFT JOIN listed l ON r.id = l.event_id""",
)
def c21(spark, sf_dir):
    """The flagship: the reader's feed with tiers, evidence and each event's reports in order."""
    top = E.with_tiers(E.feed(domain(spark, sf_dir, "news_event"), now()), _cuts(spark, sf_dir))
    # fifty events at most: their reports are found by a semi-join before anything is gathered
    ids = top.select(F.col("id").alias("event_id"))
    reports = domain(spark, sf_dir, "report").join(F.broadcast(ids), "event_id", "left_semi")
    listed = reports.groupBy("event_id").agg(F.count("*").alias("n_reports"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reported_at", "report_id"))), lambda x: x["report_id"].cast("string")), ",").alias("reports"))
    known = E.evidence(reports).join(listed, "event_id")
    return top.join(known, top["id"] == known["event_id"], "left").select("id", "event_time", "category", "rank_score", "impact", "tier", "evidence_level", F.coalesce("n_reports", F.lit(0)).alias("n_reports"), "reports")


@query("a33_refresh", f"WITH {ctes('report')} SELECT event_id, min(reported_at) AS event_time, min(reported_at + INTERVAL 3 HOUR) AS first_seen_at, CASE WHEN bool_and(report_id % 3 = 0) THEN 'withdrawn' WHEN bool_or(report_id % 29 = 0) THEN 'corrected' WHEN bool_or(report_id % 2 = 0) THEN 'assessed' ELSE 'developing' END AS status FROM report GROUP BY 1")
def a33(spark, sf_dir):
    r = domain(spark, sf_dir, "report")
    i = F.col("report_id")
    return E.refresh(r.select("event_id", "reported_at", (F.col("reported_at") + F.make_dt_interval(hours=F.lit(3))).alias("created_at"), (i % 3 == 0).alias("gone"), (i % 29 == 0).alias("revised"), (i % 2 == 0).alias("assessed"), F.lit("developing").alias("status")))


def _candidates(articles, e):
    a = articles.select("id", (F.col("event_time") + F.make_dt_interval(hours=F.lit(5))).alias("published_at"))
    return E.candidates(a, e, a.select(F.col("id").alias("article_id"), F.col("id").alias("event_id")))


_J11 = f"WITH {ctes('news_event')}, a AS (SELECT id AS article_id, event_time + INTERVAL 5 HOUR AS published_at FROM news_event) SELECT article_id, id AS event_id FROM a JOIN news_event ON event_time BETWEEN published_at - INTERVAL 36 HOUR AND published_at + INTERVAL 36 HOUR WHERE NOT (article_id = id) QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY event_time DESC, id DESC) <= 10"
@query("j11_event_candidates", _J11)
@query("j11_event_candidates_whole", _J11)
def j11(spark, sf_dir):
    e = domain(spark, sf_dir, "news_event")
    return _candidates(e, e)


@query("j12_attach", f"WITH {ctes('article')}, a AS (SELECT id, CASE WHEN id % 5 = 4 THEN id - 1 END AS duplicate_of FROM article), l AS (SELECT id % 50 AS event_id, id AS canonical_id FROM a WHERE duplicate_of IS NULL) SELECT DISTINCT event_id, a.id AS article_id FROM l JOIN a ON coalesce(a.duplicate_of, a.id) = l.canonical_id WHERE NOT (a.id % 20 = 9)")
def j12(spark, sf_dir):
    a = domain(spark, sf_dir, "article").select("id", F.when(F.col("id") % 5 == 4, F.col("id") - 1).alias("duplicate_of"))
    links = a.where("duplicate_of is null").select((F.col("id") % 50).alias("event_id"), F.col("id").alias("article_id"))
    apart = a.where("id % 20 = 9").select((F.coalesce("duplicate_of", "id") % 50).alias("event_id"), F.col("id").alias("article_id"))
    return E.attach(links, a, apart)


_MATCH = f"""tiered AS (SELECT id, {tier_sql(IMPACT, 'impact')} AS tier, {tier_sql('global_score', 'global')} AS global_tier
  FROM (SELECT *, CASE WHEN id % 13 = 0 THEN 'withdrawn' ELSE status END AS state FROM news_event) WHERE NOT hidden AND state <> 'withdrawn' AND category NOT IN ('', 'other') AND iran_score IS NOT NULL AND primary_article_id % 31 <> 0),
  entitled AS (SELECT user_id, dial FROM account WHERE user_id % 6 <> 0)"""


@query("j14_alert_matches", f"WITH {ctes('news_event', 'tag', 'account')}, {CUTS}, {_MATCH} SELECT DISTINCT user_id, t.id AS event_id, 'watch' AS reason FROM tiered t JOIN tag ON t.id = tag.event_id JOIN account a ON a.item = tag.item JOIN entitled e USING (user_id) WHERE tier >= CASE e.dial WHEN 'low' THEN 2 WHEN 'high' THEN 4 ELSE 3 END AND NOT coalesce(global_tier >= 5, false) UNION ALL SELECT user_id, id, 'breaking' FROM entitled, tiered WHERE global_tier >= 5")
def j14(spark, sf_dir):
    """All events, against readers whose plan has alerts; some events are withdrawn and some primary articles hidden."""
    e = domain(spark, sf_dir, "news_event").withColumn("status", F.when(F.col("id") % 13 == 0, "withdrawn").otherwise(F.col("status")))
    hidden = e.select(F.col("primary_article_id").alias("id")).distinct().where("id % 31 = 0")
    accounts = domain(spark, sf_dir, "account").withColumn("alerts", F.col("user_id") % 6 != 0)
    open_ = E.with_tiers(E.alertable(e, hidden), _cuts(spark, sf_dir)).select("id", "tier", "global_tier")
    return E.alert_matches(open_, domain(spark, sf_dir, "tag"), accounts, accounts)


@query("j13_brief_eligible", f"WITH {ctes('news_event', 'tag', 'account')}, {CUTS}, w AS (SELECT DISTINCT event_id FROM tag WHERE item IN (SELECT item FROM account)), t AS (SELECT *, {tier_sql(IMPACT, 'impact')} AS tier, id IN (SELECT event_id FROM w) AS watched FROM {RECENT}) SELECT id, watched, coalesce(category NOT IN ('', 'other') AND (tier >= 4 OR (watched AND tier >= 3)), false) AS eligible FROM t")
def j13(spark, sf_dir):
    items = domain(spark, sf_dir, "account").select("item").distinct()
    watched = domain(spark, sf_dir, "tag").join(items, "item", "left_semi").select(F.col("event_id").alias("id")).distinct().withColumn("watched", F.lit(True))
    t = E.with_tiers(_recent(spark, sf_dir), _cuts(spark, sf_dir)).join(watched, "id", "left").withColumn("watched", F.coalesce("watched", F.lit(False)))
    return t.select("id", "watched", X.brief_eligible(F.col("category"), F.col("tier"), F.col("watched")).alias("eligible"))


def _changes(spark, sf_dir):
    r = domain(spark, sf_dir, "report")
    return r.select((F.col("event_id") % 40).alias("user_id"), (F.col("event_id") % 300).alias("event_id"), F.col("reported_at").alias("at"), F.col("report_id").alias("seq"), (1 + F.col("source_id") % 5).cast("int").alias("tier"), F.when(F.col("stance") == "contradicts", "disputed").otherwise("multi").alias("evidence_level"), (F.col("report_id") % 37 == 0).alias("merged"))


_LEDGER = """c AS (SELECT event_id % 40 AS user_id, event_id % 300 AS event_id, reported_at AS at_, report_id AS seq, (1 + source_id % 5)::INT AS tier, CASE WHEN stance = 'contradicts' THEN 'disputed' ELSE 'multi' END AS evidence_level, report_id % 37 = 0 AS merged FROM report),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id, event_id ORDER BY at_, seq, tier, evidence_level, merged) AS k FROM c),
t AS (SELECT *, 'new' AS kind, tier AS t, evidence_level AS e FROM n WHERE k = 1 UNION ALL SELECT n.*, CASE WHEN n.merged THEN '' WHEN n.evidence_level <> t.e OR n.tier > t.t THEN 'update' ELSE '' END, CASE WHEN n.merged OR n.evidence_level <> t.e OR n.tier > t.t THEN n.tier ELSE t.t END, CASE WHEN n.merged OR n.evidence_level <> t.e OR n.tier > t.t THEN n.evidence_level ELSE t.e END FROM t JOIN n ON n.user_id = t.user_id AND n.event_id = t.event_id AND n.k = t.k + 1)"""


@query("r08_alert_ledger", f"WITH RECURSIVE {ctes('report')}, {_LEDGER} SELECT user_id, event_id, at_ AS \"at\", seq, tier, evidence_level, kind FROM t WHERE kind <> ''")
def r08(spark, sf_dir):
    """Each reader's changes against what was told last; streaming is held against this."""
    return E.alert_ledger(_changes(spark, sf_dir))


_MIN = "(hour(at_ + INTERVAL 210 MINUTE) * 60 + minute(at_ + INTERVAL 210 MINUTE))"
_QUIET = f"CASE WHEN quiet_start = quiet_end THEN false WHEN quiet_start < quiet_end THEN {_MIN} >= quiet_start AND {_MIN} < quiet_end ELSE {_MIN} >= quiet_start OR {_MIN} < quiet_end END"


@query("x10_pushes", f"WITH {ctes('account')}, alerts AS (SELECT event_id % 400 AS event_id, ts AS at_, event_id AS seq, user_id, (1 + event_id % 5)::INT AS tier, event_id % 23 = 0 AS breaking FROM events), m AS (SELECT *, (at_ + INTERVAL 210 MINUTE)::DATE AS day, breaking OR tier >= 5 AS exempt, {_QUIET} AS quiet FROM alerts JOIN account USING (user_id)), c AS (SELECT *, coalesce(sum((NOT exempt AND NOT quiet)::INT) OVER (PARTITION BY user_id, day ORDER BY at_, event_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM m) SELECT seq, user_id, CASE WHEN exempt THEN '' WHEN quiet THEN 'quiet' WHEN n >= 2 THEN 'cap' ELSE '' END AS held FROM c")
def x10(spark, sf_dir):
    alerts = domain(spark, sf_dir, "attempt").select((F.col("id") % 400).alias("event_id"), F.col("started_at").alias("at"), F.col("id").alias("seq"), F.col("source_id").alias("user_id"), (1 + F.col("id") % 5).cast("int").alias("tier"), (F.col("id") % 23 == 0).alias("breaking"))
    return E.pushes(alerts, domain(spark, sf_dir, "account"), cap=2).select("seq", "user_id", "held")


@query("o01_review_queue", f"WITH {ctes('news_event')} SELECT id, row_number() OVER (ORDER BY CASE WHEN id % 7 = 0 THEN event_time END NULLS FIRST, confidence NULLS LAST, {IMPACT} DESC NULLS LAST, event_time DESC, id) AS place FROM news_event QUALIFY place <= 200")
def o01(spark, sf_dir):
    e = domain(spark, sf_dir, "news_event").withColumn("impact", X.impact(F.col("iran_score"), F.col("global_score")))
    skipped = e.where("id % 7 = 0").select("id", F.col("event_time").alias("skipped_at"))
    first = E.review_queue(e, skipped).limit(200).select("id", "skipped_at", "confidence", "impact", "event_time")
    order = Window.orderBy(F.col("skipped_at").asc_nulls_first(), F.col("confidence").asc_nulls_last(), F.col("impact").desc_nulls_last(), F.desc("event_time"), F.asc("id"))
    return first.select("id", F.row_number().over(order).cast("long").alias("place"))


@query("l08_latest_assessment_as_of", f"WITH {ctes('news_event')}, asked AS (SELECT CAST(floor(id / 5) AS BIGINT) AS event_id, id, event_time AS created_at, category FROM news_event), r AS (SELECT event_id, TIMESTAMP '1998-01-01' + to_days((event_id % 900)::INTEGER) AS reviewed_at FROM asked GROUP BY 1) SELECT r.event_id, max(a.id) AS assessment_id, arg_max(a.category, a.id) AS category FROM r JOIN asked a ON a.event_id = r.event_id AND a.created_at <= r.reviewed_at GROUP BY 1")
def l08(spark, sf_dir):
    """The latest assessment at the time of a review, of every event; five assessments each."""
    e = domain(spark, sf_dir, "news_event")
    asked = e.select(F.floor(F.col("id") / 5).alias("event_id"), "id", F.col("event_time").alias("created_at"), "category")
    r = asked.select("event_id").distinct().withColumn("reviewed_at", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("event_id") % 900).cast("int")))
    seen = r.join(asked, "event_id").where("created_at <= reviewed_at")
    return latest_per(seen, ["event_id"], F.desc("id")).select("event_id", F.col("id").alias("assessment_id"), "category")


@query("c28_review_state", f"WITH {ctes('news_event')}, log AS (SELECT id, id % 500 AS event_id, event_time AS at_, ['agree', 'fix', 'skip', 'undo'][1 + id % 4] AS action, category FROM news_event), last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY at_ DESC, id DESC) = 1) SELECT event_id, CASE action WHEN 'undo' THEN 'pending' WHEN 'skip' THEN 'skipped' ELSE 'reviewed' END AS status, CASE WHEN action IN ('agree', 'fix') THEN category END AS reviewed_category FROM last")
def c28(spark, sf_dir):
    e = domain(spark, sf_dir, "news_event")
    names = F.array(*map(F.lit, ("agree", "fix", "skip", "undo")))
    return E.latest_actions(e.select("id", (F.col("id") % 500).alias("event_id"), F.col("event_time").alias("at"), names[(F.col("id") % 4).cast("int")].alias("action"), "category"))


@query("c02_merge", f"WITH {ctes('report')} SELECT DISTINCT CASE WHEN event_id = 7 THEN 3 ELSE event_id END AS event_id, source_id FROM report")
@query("c02_merge_whole", f"WITH {ctes('report')} SELECT DISTINCT CASE WHEN event_id = 7 THEN 3 ELSE event_id END AS event_id, source_id FROM report")
def c02(spark, sf_dir):
    return E.merged_into(domain(spark, sf_dir, "report").select("event_id", "source_id"), F.lit(7), F.lit(3).cast("long"))


@query("a16_visibility_p95", f"WITH {ctes('article', 'source')}, d AS (SELECT greatest(0, epoch(created_at) - epoch(published_at)) / 60.0::DOUBLE AS delay FROM article JOIN source USING (source_id) WHERE tier = 1), o AS (SELECT delay, row_number() OVER (ORDER BY delay) AS r, count(*) OVER () AS n FROM d) SELECT max(n)::BIGINT AS n, max(delay) FILTER (r = ceil(0.95::DOUBLE * n)) AS p95, avg((delay <= 10)::INT) AS within_ten FROM o")
def a16(spark, sf_dir):
    """By nearest rank; delays below zero count as none."""
    a = domain(spark, sf_dir, "article").join(domain(spark, sf_dir, "source").where("tier = 1"), "source_id", "left_semi")
    delay = F.greatest(F.lit(0.0), (F.unix_timestamp(F.col("created_at").cast("timestamp")) - F.unix_timestamp(F.col("published_at").cast("timestamp"))) / 60.0)
    return a.select(delay.alias("delay")).agg(F.count("*").alias("n"), F.expr("percentile_disc(0.95) within group (order by delay)").alias("p95"), F.avg((F.col("delay") <= 10).cast("double")).alias("within_ten"))
