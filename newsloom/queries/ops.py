"""Operations over the driver's event stream, orders and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import vocab
from newsloom.adapt import NOW, ctes, domain
from newsloom.functions.score import level_score
from newsloom.functions.time import local_day
from newsloom.operators import ops as O
from newsloom.plans.joins import latest_per
from newsloom.registry import query
from newsloom.tables import read


def now():
    return F.lit(NOW).cast("timestamp_ntz")


SQL_NOW = f"TIMESTAMP '{NOW}'"
LATEST_C = "latest AS (SELECT * FROM classification QUALIFY row_number() OVER (PARTITION BY article_id, variant ORDER BY created_at DESC, id DESC) = 1)"


@query("a02_daily_new", f"WITH {ctes('article', 'source')}, n AS (SELECT (created_at + INTERVAL 210 MINUTE)::DATE AS day, source_id, count(*) AS n FROM article GROUP BY ALL), d AS (SELECT unnest(generate_series(DATE '2024-01-10', DATE '2024-01-16', INTERVAL 1 DAY))::DATE AS day) SELECT d.day::VARCHAR AS day, s.source_id, coalesce(n, 0)::BIGINT AS n FROM d CROSS JOIN source s LEFT JOIN n ON n.day = d.day AND n.source_id = s.source_id")
def a02(spark, sf_dir):
    return O.daily_new(domain(spark, sf_dir, "article"), domain(spark, sf_dir, "source"), "2024-01-10", "2024-01-16", local_day(F.col("created_at"))).withColumn("day", F.col("day").cast("string"))


@query("a04_attempt_totals", f"WITH {ctes('attempt')} SELECT source_id, count(*) AS attempts, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'empty') AS empty, sum(fetched)::BIGINT AS fetched, sum(new)::BIGINT AS new FROM attempt GROUP BY 1")
def a04(spark, sf_dir):
    return O.attempt_totals(domain(spark, sf_dir, "attempt"))


#: Attempts of the stream, of which one in thirteen has not come to an end, and the state of each source at noon of a day within it.
SEEN, SQL_SEEN = "2024-01-15 12:00:00", "TIMESTAMP '2024-01-15 12:00:00'"
_ATTEMPTS = f"t AS (SELECT source_id, id, started_at, CASE WHEN id % 13 = 0 THEN 'running' ELSE status END AS status, CASE WHEN id % 13 <> 0 THEN started_at + INTERVAL 2 MINUTE END AS finished_at FROM attempt WHERE started_at <= {SQL_SEEN}), s AS (SELECT DISTINCT source_id, source_id % 10 <> 0 AS enabled, source_id % 3 <> 0 AS has_new FROM attempt), l AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, id DESC) = 1)"


@query("a05_source_state", f"WITH {ctes('attempt')}, {_ATTEMPTS}, j AS (SELECT s.*, started_at, finished_at, CASE WHEN status = 'running' AND started_at < {SQL_SEEN} - INTERVAL 30 MINUTE THEN 'interrupted' ELSE status END AS last_status FROM s LEFT JOIN l USING (source_id)) SELECT source_id, started_at AS last_at, last_status, CASE WHEN NOT enabled THEN 'disabled' WHEN last_status IN ('failed', 'partial', 'empty', 'interrupted') THEN last_status WHEN {SQL_SEEN} - finished_at <= INTERVAL 15 MINUTE THEN 'healthy' WHEN last_status = 'running' THEN 'running' WHEN has_new THEN 'stale' ELSE 'unknown' END AS state FROM j")
def a05(spark, sf_dir):
    seen = F.lit(SEEN).cast("timestamp_ntz")
    a = domain(spark, sf_dir, "attempt")
    sources = a.select("source_id").distinct().select("source_id", (F.col("source_id") % 10 != 0).alias("enabled"), F.when(F.col("source_id") % 3 != 0, seen).alias("last_new_at"))
    open_ = F.col("id") % 13 == 0
    tried = a.where(F.col("started_at") <= seen).select("source_id", "id", "started_at", F.when(open_, "running").otherwise(F.col("status")).alias("status"), F.when(~open_, F.col("started_at") + F.make_dt_interval(mins=F.lit(2))).alias("finished_at"))
    return O.source_state(sources, tried, seen)


@query("a03_quality", f"WITH {ctes('article')} SELECT count(*) FILTER (id % 9 = 4) AS duplicates, count(*) FILTER (id % 4 IN (0, 1)) AS feed_only, count(*) FILTER (content = '') AS empty_body, count(*) FILTER (id % 11 = 0) AS quality_flagged FROM article")
def a03(spark, sf_dir):
    k = F.col("id")
    a = domain(spark, sf_dir, "article").select("content", F.when(k % 9 == 4, k - 1).alias("duplicate_of"), vocab.pick(("feed", "listing", "jsonld", "css"), 1 + k % 4).alias("extraction_tier"), F.when(k % 11 == 0, "invalid_url").otherwise("").alias("quality_flag"))
    return O.quality(a)


def _states(spark, sf_dir):
    a = domain(spark, sf_dir, "attempt")
    bad = F.col("status") == "failed"
    return a.select("source_id", F.col("started_at").alias("at"), F.col("id").alias("seq"), F.when(bad, "gap").otherwise("covered").alias("state"), F.when(bad, F.substring("error", 6, 3)).otherwise("").alias("error_class"))


COVERAGE = """o AS (SELECT source_id, started_at AS at_, id AS seq, CASE WHEN status = 'failed' THEN 'gap' ELSE 'covered' END AS state, CASE WHEN status = 'failed' THEN substr(error, 6, 3) ELSE '' END AS error_class FROM attempt),
g AS (SELECT *, lag(at_) OVER w AS before_, lag(state || error_class) OVER w AS was FROM o WINDOW w AS (PARTITION BY source_id ORDER BY at_, seq)), m AS (SELECT *, before_ IS NOT NULL AND at_ - before_ > INTERVAL 24 HOUR AS silent FROM g),
k AS (SELECT *, before_ IS NULL OR silent AS fresh FROM m), i AS (SELECT *, sum((fresh OR state || error_class <> was)::INT) OVER (PARTITION BY source_id ORDER BY at_, seq) AS island FROM k),
coverage AS (SELECT source_id, min(CASE WHEN fresh THEN at_ ELSE before_ END) AS started_at, max(at_) AS ended_at, any_value(state) AS state, any_value(error_class) AS error_class FROM i GROUP BY source_id, island UNION ALL SELECT source_id, before_, at_, 'unknown', '' FROM i WHERE silent)"""


@query("r02_coverage", f"WITH {ctes('attempt')}, {COVERAGE} SELECT * FROM coverage")
def r02(spark, sf_dir):
    """Ten minutes of silence on a live crawl; a day on the driver's sparse stream."""
    return O.coverage(_states(spark, sf_dir), 86_400)


@query("a07_coverage_hours", f"WITH {ctes('attempt')}, {COVERAGE} SELECT source_id, state, sum((epoch_us(least(ended_at, {SQL_NOW})) - epoch_us(greatest(started_at, {SQL_NOW} - INTERVAL 7 DAY))) / 3.6e9::DOUBLE) AS hours FROM coverage WHERE ended_at > {SQL_NOW} - INTERVAL 7 DAY AND started_at < {SQL_NOW} GROUP BY 1, 2")
def a07(spark, sf_dir):
    return O.coverage_hours(O.coverage(_states(spark, sf_dir), 86_400), now() - F.make_dt_interval(days=F.lit(7)), now())


@query("a14_priority_gaps", f"WITH {ctes('attempt')}, {COVERAGE}, l AS (SELECT * FROM coverage QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ended_at DESC, started_at DESC) = 1) SELECT source_id, started_at, ended_at, error_class FROM l WHERE state = 'gap' AND ended_at - started_at >= INTERVAL 30 MINUTE")
def a14(spark, sf_dir):
    return O.open_gaps(O.coverage(_states(spark, sf_dir), 86_400), 30)


@query("a08_coverage_summary", f"""WITH {ctes('attempt')}, {COVERAGE}, own AS (SELECT * FROM coverage WHERE ended_at >= {SQL_NOW} - INTERVAL 7 DAY), l AS (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY ended_at DESC, started_at DESC) = 1),
h AS (SELECT source_id, round(sum(CASE WHEN state = 'gap' THEN t ELSE 0 END), 1) AS gap_hours, round(sum(CASE WHEN state = 'unknown' THEN t ELSE 0 END), 1) AS unknown_hours FROM (SELECT source_id, state, (epoch_us(least(ended_at, {SQL_NOW})) - epoch_us(greatest(started_at, {SQL_NOW} - INTERVAL 7 DAY))) / 3.6e9::DOUBLE AS t FROM own WHERE ended_at > {SQL_NOW} - INTERVAL 7 DAY) GROUP BY 1),
r AS (SELECT source_id, count(*) AS retries_pending FROM attempt WHERE status = 'failed' AND id % 4 <> 0 GROUP BY 1), s AS (SELECT DISTINCT source_id FROM attempt),
j AS (SELECT s.source_id, l.* EXCLUDE (source_id), {SQL_NOW} - ended_at > INTERVAL 12 HOUR OR ended_at IS NULL AS unseen, gap_hours, unknown_hours, retries_pending FROM s LEFT JOIN l USING (source_id) LEFT JOIN h USING (source_id) LEFT JOIN r USING (source_id))
SELECT source_id, CASE WHEN unseen THEN 'unknown' WHEN state <> 'covered' THEN state END AS open_gap, CASE WHEN NOT unseen AND state <> 'covered' THEN error_class ELSE '' END AS open_class, CASE WHEN unseen THEN ended_at WHEN state <> 'covered' THEN started_at END AS open_since, coalesce(gap_hours, 0)::DOUBLE AS gap_hours, coalesce(unknown_hours, 0)::DOUBLE AS unknown_hours, coalesce(retries_pending, 0)::BIGINT AS retries_pending FROM j""")
def a08(spark, sf_dir):
    a = domain(spark, sf_dir, "attempt")
    retries = a.where("status = 'failed'").select("source_id", (F.col("id") % 4 == 0).alias("gave_up"))
    return O.coverage_summary(a.select("source_id").distinct(), O.coverage(_states(spark, sf_dir), 86_400), retries, now(), unobserved_minutes=720)


@query("a09_cost_breakdown", f"WITH {ctes('usage')} SELECT stage, provider, count(*) AS calls, sum(cost::DECIMAL(18,6))::DOUBLE AS cost, count(*) FILTER (created_at::DATE = DATE '2024-01-30') AS today_calls, coalesce(sum(cost::DECIMAL(18,6)) FILTER (created_at::DATE = DATE '2024-01-30'), 0)::DOUBLE AS today_cost FROM usage GROUP BY 1, 2")
def a09(spark, sf_dir):
    return O.cost_breakdown(domain(spark, sf_dir, "usage"), F.lit("2024-01-30").cast("date"))


@query("a10_daily_cost", f"WITH {ctes('usage')}, d AS (SELECT unnest(generate_series(DATE '2024-01-26', DATE '2024-02-01', INTERVAL 1 DAY))::DATE AS day), s(stage) AS (VALUES {', '.join(f"('{x}')" for x in vocab.STAGES)}), n AS (SELECT created_at::DATE AS day, stage, sum(cost::DECIMAL(18,6))::DOUBLE AS cost FROM usage GROUP BY ALL) SELECT d.day::VARCHAR AS day, s.stage, coalesce(cost, 0)::DOUBLE AS cost FROM d CROSS JOIN s LEFT JOIN n ON n.day = d.day AND n.stage = s.stage")
def a10(spark, sf_dir):
    return O.daily_cost(domain(spark, sf_dir, "usage"), vocab.table(spark, vocab.STAGES, "stage"), "2024-02-01").withColumn("day", F.col("day").cast("string"))


@query("a11_crawl_errors", f"WITH {ctes('attempt')}, f AS (SELECT *, CASE substr(error, 6) WHEN '429' THEN 'rate_limit' WHEN '503' THEN 'network' WHEN '404' THEN 'gone' WHEN '403' THEN 'blocked' ELSE 'parse' END AS error_class FROM attempt WHERE status = 'failed' AND started_at >= {SQL_NOW} - INTERVAL 7 DAY) SELECT source_id, error_class, count(*) AS week, count(*) FILTER (started_at >= {SQL_NOW} - INTERVAL 1 DAY) AS day FROM f GROUP BY GROUPING SETS ((source_id, error_class), (error_class))")
def a11(spark, sf_dir):
    return O.crawl_errors(domain(spark, sf_dir, "attempt"), now())


@query("a12_discovery_slo", f"WITH {ctes('article', 'source')} SELECT source_id, count(*) FILTER (created_at <= published_at + INTERVAL 5 MINUTE) AS passed, count(*) FILTER (created_at > published_at + INTERVAL 5 MINUTE) AS failed FROM article WHERE source_id IN (SELECT source_id FROM source WHERE tier = 1) GROUP BY 1")
def a12(spark, sf_dir):
    return O.discovery_slo(domain(spark, sf_dir, "article").join(domain(spark, sf_dir, "source").where("tier = 1"), "source_id", "left_semi"))


@query("a13_brief_slo", f"WITH {ctes('article', 'usage')}, b AS (SELECT event_key, min(created_at) AS briefed_at FROM usage WHERE stage = 'brief' GROUP BY 1) SELECT id, CASE WHEN briefed_at <= published_at + INTERVAL 10 MINUTE THEN 'passed' WHEN briefed_at IS NOT NULL OR {SQL_NOW} > published_at + INTERVAL 10 MINUTE THEN 'failed' ELSE 'pending' END AS outcome FROM article LEFT JOIN b ON id = event_key")
def a13(spark, sf_dir):
    return O.brief_slo(domain(spark, sf_dir, "article").select("id", F.col("published_at").alias("first_seen_at")), domain(spark, sf_dir, "usage"), now())


@query("a06_analysis_summary", f"WITH {ctes('article', 'classification')}, l AS (SELECT * FROM classification QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1) SELECT coalesce(category, 'none') AS category, count(*) AS n FROM article LEFT JOIN l ON article.id = l.article_id GROUP BY 1")
def a06(spark, sf_dir):
    """Duplicates count in the total (Q10)."""
    last = latest_per(domain(spark, sf_dir, "classification"), ["article_id"], F.desc("created_at"), F.desc("id")).select(F.col("article_id").alias("id"), "category")
    return domain(spark, sf_dir, "article").select("id").join(last, "id", "left").groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


def _reviewed(spark, sf_dir):
    e = latest_per(domain(spark, sf_dir, "evaluation"), ["article_id"], F.desc("created_at"), F.desc("id"))
    r = domain(spark, sf_dir, "review")
    return r.join(e, "article_id").select("article_id", "variant", F.col("axis1").alias("predicted"), vocab.pick(vocab.LEVELS, 1 + F.col("article_id") % 6).alias("reviewed"))


def _lv(x):
    return f"nullif(coalesce(list_position([{vocab.sql_list(vocab.LEVELS)}], {x}), 0), 0)"


REVIEWED = f"e AS (SELECT * FROM evaluation QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1), reviewed AS (SELECT r.article_id, variant, axis1 AS predicted, {vocab.sql_pick(vocab.LEVELS, '(1 + r.article_id % 6)')} AS reviewed FROM review r JOIN e USING (article_id)), scored AS (SELECT *, {_lv('predicted')} AS p, {_lv('reviewed')} AS q FROM reviewed)"


@query("a17_agreement", f"WITH {ctes('evaluation', 'review')}, {REVIEWED} SELECT variant, count(*) FILTER (p IS NOT NULL AND q IS NOT NULL) AS n, count(*) FILTER (p = q) AS exact, count(*) FILTER (abs(p - q) <= 1) AS within_one FROM scored GROUP BY 1")
def a17(spark, sf_dir):
    return O.agreement(_reviewed(spark, sf_dir), "variant")


@query("a17_confusion", f"WITH {ctes('evaluation', 'review')}, {REVIEWED} SELECT reviewed, predicted, count(*) AS n FROM scored GROUP BY 1, 2")
def a17c(spark, sf_dir):
    return O.confusion(_reviewed(spark, sf_dir))


@query("a23_item_metrics", f"WITH {ctes('evaluation', 'review')}, {REVIEWED} SELECT variant, reviewed AS topic, count(*) AS n, avg(coalesce(p = q, false)::INT) AS exact, avg(coalesce(abs(p - q) <= 1, false)::INT) AS within_one FROM scored GROUP BY GROUPING SETS ((), (variant), (reviewed))")
def a23(spark, sf_dir):
    """Overall, by variant and by topic in one pass; what was not answered is a miss."""
    p, q = level_score(F.col("predicted")), level_score(F.col("topic"))
    rows = _reviewed(spark, sf_dir).withColumnRenamed("reviewed", "topic").withColumns({"hit": F.coalesce(p == q, F.lit(False)).cast("int"), "near": F.coalesce(F.abs(p - q) <= 1, F.lit(False)).cast("int")})
    v, t = F.col("variant"), F.col("topic")
    return rows.groupingSets([[], [v], [t]], v, t).agg(F.count("*").alias("n"), F.avg("hit").alias("exact"), F.avg("near").alias("within_one"))


@query("a25_verdict", f"WITH {ctes('evaluation', 'review')}, {REVIEWED}, m AS (SELECT variant, count(*) AS n, avg(coalesce(p = q, false)::INT) AS exact, avg(coalesce(abs(p - q) <= 1, false)::INT) AS within_one FROM scored GROUP BY 1) SELECT variant, CASE WHEN n < 50 THEN 'insufficient' WHEN exact < 0.2 OR within_one < 0.5 THEN 'fail' ELSE 'pass' END AS verdict, CASE WHEN n >= 50 THEN concat_ws(',', CASE WHEN exact < 0.2 THEN 'exact' END, CASE WHEN within_one < 0.5 THEN 'within_one' END) ELSE '' END AS reasons FROM m")
def a25(spark, sf_dir):
    m = a23(spark, sf_dir).where("variant is not null").withColumn("aborted", F.lit(False))
    return O.verdict(m, {"exact": 0.2, "within_one": 0.5}, 50).select("variant", "verdict", F.array_join("reasons", ",").alias("reasons"))


@query("a31_disagreements", f"WITH {ctes('classification')}, {LATEST_C} SELECT article_id, count(DISTINCT category) AS categories FROM latest GROUP BY 1 HAVING count(DISTINCT category) > 1")
def a31(spark, sf_dir):
    return O.disagreements(domain(spark, sf_dir, "classification"))


@query("j20_pairwise", f"WITH {ctes('classification')}, {LATEST_C} SELECT a.variant AS variant_a, b.variant AS variant_b, count(*) AS shared, count(*) FILTER (a.category = b.category) AS same FROM latest a JOIN latest b USING (article_id) WHERE a.variant < b.variant GROUP BY 1, 2")
def j20(spark, sf_dir):
    return O.pairwise(domain(spark, sf_dir, "classification"))


def _pairs(spark, sf_dir):
    existing = spark.createDataFrame([(5, "P", "F"), (6, "F", "O")], "article_id long, variant_a string, variant_b string")
    return O.overlap(domain(spark, sf_dir, "classification"), existing)


@query("j18_overlap", f"WITH {ctes('classification')}, v AS (SELECT DISTINCT article_id, variant FROM classification) SELECT a.article_id, a.variant AS variant_a, b.variant AS variant_b FROM v a JOIN v b USING (article_id) WHERE a.variant < b.variant AND NOT (article_id = 5 AND a.variant = 'F' AND b.variant = 'P') AND NOT (article_id = 6 AND a.variant = 'F' AND b.variant = 'O')")
def j18(spark, sf_dir):
    return _pairs(spark, sf_dir).drop("shown_as_left")


_JUDGED = "judged AS (SELECT o_orderkey AS id, ['F', 'O', 'P'][1 + o_orderkey % 3] AS variant_a, ['F', 'O', 'P'][1 + (o_orderkey + 1) % 3] AS variant_b, CASE WHEN o_custkey % 2 = 0 THEN 'a' ELSE 'b' END AS shown_as_left, ['left', 'right', 'tie'][1 + o_custkey % 3] AS winner FROM orders)"


@query("a18_standings", f"WITH {_JUDGED}, w AS (SELECT *, CASE winner WHEN 'left' THEN CASE shown_as_left WHEN 'a' THEN variant_a ELSE variant_b END WHEN 'right' THEN CASE shown_as_left WHEN 'a' THEN variant_b ELSE variant_a END END AS w FROM judged), e AS (SELECT unnest([variant_a, variant_b]) AS variant, w FROM w) SELECT variant, count(*) AS appearances, count(*) FILTER (w = variant) AS wins, count(*) FILTER (w IS NULL) AS ties, count(*) FILTER (w = variant) / nullif(count(w), 0)::DOUBLE AS win_rate FROM e GROUP BY 1")
def a18(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = read(spark, sf_dir, "orders")
    variants = ("F", "O", "P")
    return O.standings(o.select(vocab.pick(variants, 1 + k % 3).alias("variant_a"), vocab.pick(variants, 1 + (k + 1) % 3).alias("variant_b"), F.when(c % 2 == 0, "a").otherwise("b").alias("shown_as_left"), vocab.pick(("left", "right", "tie"), 1 + c % 3).alias("winner")))


_NODES = "n AS (SELECT run_id, cost, event_key, CASE WHEN id % 97 = 0 THEN 'quota_exhausted' WHEN id % 89 = 0 THEN 'circuit_open' WHEN id % 83 = 0 THEN 'fatal' WHEN run_id % 5 = 0 AND id % 3 > 0 THEN 'skipped' WHEN id % 11 = 0 THEN 'retry' WHEN run_id % 7 = 0 THEN 'failed' ELSE status END AS status FROM usage)"


@query("a29_run_status", f"WITH {ctes('usage')}, {_NODES}, g AS (SELECT run_id, sum(cost::DECIMAL(18,6))::DOUBLE AS cost, count(DISTINCT event_key) FILTER (status = 'success') AS successes, list(DISTINCT status) AS had FROM n GROUP BY 1) SELECT c_custkey AS run_id, coalesce(cost, 0)::DOUBLE AS cost, coalesce(successes, 0)::BIGINT AS successes, CASE WHEN had IS NULL THEN 'no_work' WHEN 'quota_exhausted' IN had THEN 'quota_exhausted' WHEN 'circuit_open' IN had THEN 'circuit_open' WHEN 'fatal' IN had THEN 'aborted' WHEN 'success' IN had THEN CASE WHEN len(list_filter(had, lambda x: x NOT IN ('success', 'skipped', 'retry'))) > 0 THEN 'partial' ELSE 'success' END WHEN had = ['skipped'] THEN 'no_work' ELSE 'failed' END AS status FROM customer LEFT JOIN g ON c_custkey = run_id")
def a29(spark, sf_dir):
    k, r = F.col("id"), F.col("run_id")
    status = F.when(k % 97 == 0, "quota_exhausted").when(k % 89 == 0, "circuit_open").when(k % 83 == 0, "fatal").when((r % 5 == 0) & (k % 3 > 0), "skipped").when(k % 11 == 0, "retry").when(r % 7 == 0, "failed").otherwise(F.col("status"))
    return O.run_status(domain(spark, sf_dir, "account").select(F.col("user_id").alias("run_id")), domain(spark, sf_dir, "usage").withColumn("status", status))


@query("r07_sessions", f"WITH {ctes('usage')}, g AS (SELECT *, coalesce(created_at - lag(created_at) OVER (PARTITION BY run_id ORDER BY created_at) >= INTERVAL 24 HOUR, true) AS fresh FROM usage), i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY run_id ORDER BY created_at, id) AS island FROM g) SELECT run_id, min(created_at) AS started_at, max(created_at) AS ended_at, count(*) AS n FROM i GROUP BY run_id, island")
def r07(spark, sf_dir):
    return O.sessions(domain(spark, sf_dir, "usage"), "24 hours")


@query("a30_benchmark", f"WITH {ctes('usage')}, r AS (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY cost) AS r, count(*) OVER (PARTITION BY provider) AS n FROM usage) SELECT provider, floor(median(cost))::BIGINT AS p50, max(cost) FILTER (r = greatest(floor(0.95::DOUBLE * n), 1)) AS p95, max(n)::BIGINT AS n FROM r GROUP BY 1")
def a30(spark, sf_dir):
    return O.percentile_by_index(domain(spark, sf_dir, "usage"), ["provider"], "cost")


@query("r11_circuit", f"WITH {ctes('usage')}, i AS (SELECT *, sum((status = 'success')::INT) OVER (PARTITION BY provider ORDER BY created_at, id) AS i FROM usage), e AS (SELECT *, sum((status <> 'success')::INT) OVER (PARTITION BY provider, i ORDER BY created_at, id) AS n FROM i) SELECT id, provider, n::BIGINT AS errors_in_a_row, n >= 3 AS open FROM e")
def r11(spark, sf_dir):
    return O.circuit(domain(spark, sf_dir, "usage"), 3)


@query("r12_attempt_caps", f"WITH {ctes('usage')} SELECT id FROM usage QUALIFY row_number() OVER (PARTITION BY event_key, stage ORDER BY created_at, id) <= 3")
def r12(spark, sf_dir):
    return O.capped(domain(spark, sf_dir, "usage"), ["event_key", "stage"]).select("id")


@query("w05_round_robin", f"WITH {ctes('article', 'source')}, r AS (SELECT id, source_id, tier, row_number() OVER (PARTITION BY source_id, tier ORDER BY published_at DESC, id DESC)::INT AS turn FROM article JOIN source USING (source_id)) SELECT id, turn FROM r ORDER BY turn, source_id, tier LIMIT 60")
def w05(spark, sf_dir):
    a = domain(spark, sf_dir, "article").join(domain(spark, sf_dir, "source").select("source_id", "tier"), "source_id")
    return O.round_robin(a, ["source_id", "tier"], [F.desc("published_at"), F.desc("id")], 60).select("id", "turn")


@query("c13_sample", f"WITH {ctes('article', 'classification')}, {LATEST_C}, d AS (SELECT article_id AS id FROM latest GROUP BY 1 HAVING count(DISTINCT category) > 1 ORDER BY 1 LIMIT 20), u AS (SELECT id FROM article WHERE id NOT IN (SELECT article_id FROM classification) ORDER BY 1 LIMIT 20), o AS (SELECT article_id AS id FROM latest GROUP BY 1 HAVING bool_and(category = 'other') ORDER BY 1 LIMIT 20), f AS (SELECT id FROM article ORDER BY 1 LIMIT 50), e AS (SELECT id, 0 AS k, 'disagreement' AS stratum FROM d UNION ALL SELECT id, 1, 'unevaluated' FROM u UNION ALL SELECT id, 2, 'other' FROM o UNION ALL SELECT id, 3, 'round_robin' FROM f), p AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY id ORDER BY k) = 1) SELECT id, stratum FROM p ORDER BY k, id LIMIT 50")
def c13(spark, sf_dir):
    a, c = domain(spark, sf_dir, "article"), domain(spark, sf_dir, "classification")
    placed = lambda df: df.select("id", F.col("id").alias("place"))
    last = latest_per(c, ["article_id", "variant"], F.desc("created_at"), F.desc("id"))
    other = last.groupBy(F.col("article_id").alias("id")).agg(F.bool_and(F.col("category") == "other").alias("all")).where("all")
    strata = [("disagreement", O.disagreements(c).select(F.col("article_id").alias("id"))), ("unevaluated", a.join(c, a["id"] == c["article_id"], "left_anti")), ("other", other), ("round_robin", a)]
    return O.sample([(n, placed(d)) for n, d in strata], 50)
