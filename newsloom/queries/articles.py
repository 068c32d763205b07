"""Articles over the driver's documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom import vocab
from newsloom.adapt import ctes, domain
from newsloom.functions import score as X
from newsloom.functions import text as T
from newsloom.functions import time as D
from newsloom.operators import articles as A
from newsloom.plans.joins import latest_per
from newsloom.registry import query

_FOLD = "trim(regexp_replace(lower(nfc_normalize({})), '\\s+', ' ', 'g'))"


def fold_sql(x: str) -> str:
    return _FOLD.format(f"coalesce({x}, '')")


def key_sql(x: str) -> str:
    return "trim(regexp_replace(" + fold_sql(x) + ", '[^\\p{L}\\p{N}_\\x{0600}-\\x{06FF}]+', ' ', 'g'))"


def grams_sql(key: str) -> str:
    k = f"replace({key}, ' ', '')"
    return f"CASE WHEN length({k}) = 0 THEN [] WHEN length({k}) < 3 THEN [{k}] ELSE list_distinct(list_transform(range(1, length({k}) - 1), lambda i: substr({k}, i, 3))) END"


@query("t02_fold_key_hash", f"WITH {ctes('article')} SELECT id, {fold_sql('title')} AS folded, {key_sql('title')} AS title_key, len({grams_sql(key_sql('title'))})::BIGINT AS n_grams, substr(sha256({fold_sql('title')} || '|' || {fold_sql('lead')} || '|' || substr({fold_sql('content')}, 1, 1500)), 1, 32) AS content_hash, sha256(coalesce(title, '') || chr(10) || coalesce(lead, '') || chr(10) || substr(coalesce(content, ''), 1, 5000)) AS digest, substr(trim(coalesce(title, '') || chr(10) || coalesce(lead, '')), 1, 2000) AS embedding_text FROM article")
def t02(spark, sf_dir):
    a = domain(spark, sf_dir, "article")
    t, lead, c = F.col("title"), F.col("lead"), F.col("content")
    return a.select("id", T.fold(t).alias("folded"), T.title_key(t).alias("title_key"), F.size(T.trigrams(t)).cast("long").alias("n_grams"), T.content_hash(t, lead, c).alias("content_hash"), T.evidence_digest(t, lead, c).alias("digest"), T.embedding_text(t, lead).alias("embedding_text"))


@query("d02_published_fields", f"WITH {ctes('article')} SELECT id, published_at, {D.jalali_sql('(published_at + INTERVAL 210 MINUTE)::DATE')} AS jalali, strftime(published_at + INTERVAL 210 MINUTE, '%H:%M') AS clock, (published_at + INTERVAL 210 MINUTE)::DATE::VARCHAR AS local_day FROM article")
def d02(spark, sf_dir):
    p = F.col("published_at")
    return domain(spark, sf_dir, "article").select("id", "published_at", D.jalali(D.local_day(p)).alias("jalali"), F.date_format(D.local(p), "HH:mm").alias("clock"), D.local_day(p).cast("string").alias("local_day"))


_SHOWN = "length(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"
FLAG = f"CASE WHEN {_SHOWN.format('title')} = 0 THEN 'missing_title' WHEN {_SHOWN.format('title')} < 10 THEN 'title_too_short' WHEN {_SHOWN.format('title')} + {_SHOWN.format('lead')} + {_SHOWN.format('content')} < 40 THEN 'insufficient_text' WHEN published_at > TIMESTAMP '2024-01-20 06:00:00' THEN 'published_in_future' WHEN NOT (starts_with(url, 'http://') OR starts_with(url, 'https://')) THEN 'invalid_url' ELSE '' END"


@query("x03_quality_gate", f"WITH {ctes('article')}, flagged AS (SELECT {FLAG} AS quality_flag FROM article) SELECT quality_flag, count(*) AS n FROM flagged GROUP BY 1")
def x03(spark, sf_dir):
    a = domain(spark, sf_dir, "article")
    flag = X.quality_flag(F.col("title"), F.col("lead"), F.col("content"), F.col("url"), F.col("published_at"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    return a.groupBy(flag.alias("quality_flag")).agg(F.count("*").alias("n"))


_RULES = "rules(source_id, native_category, enabled) AS (VALUES ('src1', 'cat1', true), (NULL, 'cat3', true), ('src2', 'cat2', false))"


def _rules(spark):
    return spark.createDataFrame([("src1", "cat1", True), (None, "cat3", True), ("src2", "cat2", False)], "source_id string, native_category string, enabled boolean")


@query("x04_prefilter", f"WITH {ctes('article')}, {_RULES} SELECT id, CASE WHEN EXISTS (SELECT 1 FROM rules r WHERE r.enabled AND r.native_category = a.native_category AND (r.source_id IS NULL OR r.source_id = a.source_id)) THEN 'slug:' || native_category ELSE '' END AS prefilter_reason FROM article a")
def x04(spark, sf_dir):
    return A.prefilter_reason(domain(spark, sf_dir, "article"), _rules(spark)).select("id", "prefilter_reason")


@query("a21_observed_slugs", f"WITH {ctes('article', 'classification')}, {_RULES}, latest AS (SELECT article_id, category FROM classification QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1) SELECT a.source_id, native_category, count(*) AS articles, count(l.article_id) AS classified, CASE WHEN count(l.article_id) > 0 THEN count(*) FILTER (l.category = 'other') / count(l.article_id)::DOUBLE END AS other_share, bool_or(coalesce((SELECT bool_or(r.enabled AND (r.source_id IS NULL OR r.source_id = a.source_id)) FROM rules r WHERE r.native_category = a.native_category), false)) AS enabled FROM article a LEFT JOIN latest l ON a.id = l.article_id GROUP BY 1, 2 HAVING count(*) >= 5")
def a21(spark, sf_dir):
    """Observed slugs; a global rule counts as enabled as well (Q3)."""
    latest = latest_per(domain(spark, sf_dir, "classification"), ["article_id"], F.desc("created_at"), F.desc("id"))
    a = A.prefilter_reason(domain(spark, sf_dir, "article"), _rules(spark))
    joined = a.join(latest.select(F.col("article_id").alias("id"), "category"), "id", "left")
    n = F.count("category")
    return joined.groupBy("source_id", "native_category").agg(F.count("*").alias("articles"), n.alias("classified"), F.when(n > 0, F.count_if(F.col("category") == "other") / n).alias("other_share"), F.bool_or(F.col("prefilter_reason") != "").alias("enabled")).where("articles >= 5")


@query("j06_exact_duplicates", f"WITH {ctes('article')}, h AS (SELECT id, {fold_sql('title')} || '|' || {fold_sql('lead')} || '|' || substr({fold_sql('content')}, 1, 1500) AS content_hash FROM article) SELECT h.id, m.duplicate_of FROM h JOIN (SELECT content_hash, min(id) AS duplicate_of FROM h GROUP BY 1) m USING (content_hash) WHERE h.id > m.duplicate_of")
def j06(spark, sf_dir):
    return A.exact_duplicates(_hashed(spark, sf_dir))


def _hashed(spark, sf_dir):
    return domain(spark, sf_dir, "article").withColumn("content_hash", T.content_hash(F.col("title"), F.col("lead"), F.col("content")))


_PAIRS = f"""g AS MATERIALIZED (SELECT id, published_at, {grams_sql("k")} AS g FROM (SELECT id, published_at, {key_sql("title")} AS k FROM article) WHERE k <> ''),
pairs AS MATERIALIZED (SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))::DOUBLE AS score
FROM g a JOIN g b ON a.id < b.id AND b.published_at <= a.published_at + INTERVAL 36 HOUR WHERE score >= 0.75)"""


@query("j05_similar_titles", f"WITH {ctes('article')}, {_PAIRS} SELECT * FROM pairs")
def j05(spark, sf_dir):
    return A.similar_pairs(domain(spark, sf_dir, "article"))


@query("l02_find_duplicates", f"WITH {ctes('article')}, {_PAIRS}, h AS (SELECT id, {fold_sql('title')} || '|' || {fold_sql('lead')} || '|' || substr({fold_sql('content')}, 1, 1500) AS content_hash FROM article), both_ AS (SELECT h.id, m.duplicate_of, 1.0::DOUBLE AS score, 1 AS e FROM h JOIN (SELECT content_hash, min(id) AS duplicate_of FROM h GROUP BY 1) m USING (content_hash) WHERE h.id > m.duplicate_of UNION ALL SELECT right_id, left_id, score, 0 FROM pairs) SELECT id, duplicate_of, score FROM both_ QUALIFY row_number() OVER (PARTITION BY id ORDER BY e DESC, score DESC, duplicate_of DESC) = 1")
def l02(spark, sf_dir):
    return A.find_duplicates(_hashed(spark, sf_dir))


@query("l04_elect_canonical", f"""WITH RECURSIVE {ctes('article', 'source')}, {_PAIRS}, edge AS MATERIALIZED (SELECT left_id AS u, right_id AS v FROM pairs UNION SELECT right_id, left_id FROM pairs),
reach(id, node) AS (SELECT DISTINCT u, u FROM edge UNION SELECT r.id, e.v FROM reach r JOIN edge e ON r.node = e.u), part AS (SELECT id, min(node) AS component FROM reach GROUP BY id),
ranked AS (SELECT p.*, row_number() OVER (PARTITION BY component ORDER BY a.id % 3 = 0 DESC, s.priority, length(a.content) DESC, a.id) AS r FROM part p JOIN article a ON p.id = a.id JOIN source s ON a.source_id = s.source_id)
SELECT p.id, b.id AS canonical_id FROM ranked p JOIN ranked b ON p.component = b.component AND b.r = 1 WHERE p.r > 1""")
def l04(spark, sf_dir):
    a = domain(spark, sf_dir, "article")
    ranked = a.join(domain(spark, sf_dir, "source").select("source_id", "priority"), "source_id").withColumn("classified", F.col("id") % 3 == 0)
    return A.elect(ranked, A.similar_pairs(a))


@query("l06_upsert", f"WITH {ctes('article')}, o AS (SELECT url, md5(content) AS content_hash, CASE WHEN id % 9 = 0 THEN 'gone' ELSE 'live' END AS url_status FROM article WHERE id % 4 <> 0), n AS (SELECT url, md5(CASE WHEN id % 5 = 0 THEN content || '!' ELSE content END) AS content_hash, id % 13 = 0 AS gone FROM article WHERE id % 3 <> 0) SELECT coalesce(o.url, n.url) AS url, CASE WHEN o.url IS NULL AND NOT n.gone THEN 'created' WHEN n.url IS NULL THEN 'unseen' WHEN o.url IS NULL THEN 'ignored' WHEN n.gone AND url_status = 'live' THEN 'gone' WHEN n.gone THEN 'seen' WHEN o.content_hash <> n.content_hash THEN 'revised' WHEN url_status = 'gone' THEN 'revived' ELSE 'seen' END AS action, CASE WHEN NOT n.gone THEN n.content_hash ELSE o.content_hash END AS content_hash FROM o FULL JOIN n ON o.url = n.url")
def l06(spark, sf_dir):
    a = domain(spark, sf_dir, "article")
    old = a.where("id % 4 <> 0").select("url", F.md5("content").alias("content_hash"), F.when(F.col("id") % 9 == 0, "gone").otherwise("live").alias("url_status"))
    new = a.where("id % 3 <> 0").select("url", F.md5(F.when(F.col("id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))).alias("content_hash"), (F.col("id") % 13 == 0).alias("gone"))
    return A.upsert(old, new)


@query("t09_search", f"WITH {ctes('article')} SELECT id, title FROM article WHERE contains(lower(title), 'ation') OR contains(lower(lead), 'ation')")
def t09(spark, sf_dir):
    return A.search(domain(spark, sf_dir, "article"), "Ation").select("id", "title")


_ITEMS = [("article_en", ["the", "and the"]), ("article_de", ["der", "die", "das"]), ("article_fr", ["le", "la", "les"]), ("article_es", ["el", "la", "los"])]


_CLAIMED = {a: slug for slug, aliases in reversed(_ITEMS) for a in reversed(aliases)}
_WORDS = "|".join(a.replace(" ", "  ") for a in sorted(_CLAIMED, key=lambda a: (-len(a), a)))
# keys have one space between words; with two, every word has spaces of its own to stand between
_NAMED = f"""k AS (SELECT id, concat(' ', replace({key_sql('content')}, ' ', '  '), ' ') AS s FROM article),
h AS (SELECT id, unnest(l) AS a, generate_subscripts(l, 1) AS place FROM (SELECT id, regexp_extract_all(s, ' ({_WORDS}){A.ENDINGS} ', 1) AS l FROM k)),
n AS (SELECT id, CASE replace(a, '  ', ' ') {' '.join(f"WHEN '{a}' THEN '{slug}'" for a, slug in _CLAIMED.items())} END AS slug, count(*) AS hits, min(place) AS place FROM h GROUP BY ALL)"""


@query("t08_watch_shortlist", f"WITH {ctes('article')}, {_NAMED} SELECT id, slug, hits FROM n QUALIFY row_number() OVER (PARTITION BY id ORDER BY hits DESC, place) <= 3")
def t08(spark, sf_dir):
    return A.shortlist(domain(spark, sf_dir, "article"), _ITEMS, F.col("content"), 3)


@query("p01_eligible", f"WITH {ctes('article', 'news_event')}, m AS (SELECT *, {FLAG} AS quality_flag, id % 6 = 5 AS dup, id % 19 = 0 AS hid FROM article) SELECT m.id FROM m WHERE NOT dup AND NOT hid AND quality_flag = '' AND native_category <> 'cat3' AND id % 8 <> 1 AND NOT EXISTS (SELECT 1 FROM news_event e WHERE e.hidden AND e.primary_article_id = m.id)")
def p01(spark, sf_dir):
    a = domain(spark, sf_dir, "article")
    flag = X.quality_flag(F.col("title"), F.col("lead"), F.col("content"), F.col("url"), F.col("published_at"), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"))
    a = a.select("id", F.when(F.col("id") % 6 == 5, F.col("id") - 1).alias("duplicate_of"), (F.col("id") % 19 == 0).alias("hidden"), flag.alias("quality_flag"), F.when(F.col("native_category") == "cat3", "slug:cat3").otherwise("").alias("prefilter_reason"), F.when(F.col("id") % 8 == 1, "gone").otherwise("live").alias("url_status"))
    hidden = domain(spark, sf_dir, "news_event").where("hidden").select(F.col("primary_article_id").alias("id"))
    return A.eligible(A.canonical(a, hidden)).select("id")


_DECIDE = f"CASE WHEN len(s) < 2 THEN '{vocab.INSUFFICIENT}' WHEN list_min(s) < 2 THEN '{vocab.NO_NOTIFY}' WHEN len(list_filter(s, lambda x: x >= 4)) >= 2 THEN '{vocab.NOTIFY}' ELSE '{vocab.NO_NOTIFY}' END"


def score_sql(axis: str) -> str:
    return f"nullif(coalesce(list_position([{vocab.sql_list(vocab.LEVELS)}], {axis}), 0), 0)"


SCORES = f"list_filter([{', '.join(score_sql(a) for a in ('axis1', 'axis2', 'axis3'))}], lambda x: x IS NOT NULL)"
LATEST = "latest AS (SELECT * FROM evaluation QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1)"


@query("x02_decide", f"WITH {ctes('evaluation')}, s AS (SELECT id, {score_sql('axis1')}::BIGINT AS score1, {SCORES} AS s FROM evaluation) SELECT id, score1, {_DECIDE} AS decision FROM s")
def x02(spark, sf_dir):
    e = domain(spark, sf_dir, "evaluation")
    return e.select("id", X.level_score(F.col("axis1")).cast("long").alias("score1"), X.decide(F.col("axis1"), F.col("axis2"), F.col("axis3")).alias("decision"))


@query("l01_latest_per_article", f"WITH {ctes('evaluation')}, {LATEST} SELECT article_id, id, variant FROM latest")
def l01(spark, sf_dir):
    return latest_per(domain(spark, sf_dir, "evaluation"), ["article_id"], F.desc("created_at"), F.desc("id")).select("article_id", "id", "variant")


@query("a01_notify_counts", f"WITH {ctes('evaluation')}, {LATEST}, s AS (SELECT {SCORES} AS s FROM latest), d AS (SELECT {_DECIDE} AS decision FROM s), v(decision) AS (VALUES ('{vocab.NOTIFY}'), ('{vocab.NO_NOTIFY}'), ('{vocab.INSUFFICIENT}')) SELECT v.decision, count(d.decision) AS n FROM v LEFT JOIN d ON v.decision = d.decision GROUP BY 1")
def a01(spark, sf_dir):
    """All three states, also those that nothing has."""
    latest = latest_per(domain(spark, sf_dir, "evaluation"), ["article_id"], F.desc("created_at"), F.desc("id"))
    n = latest.groupBy(X.decide(F.col("axis1"), F.col("axis2"), F.col("axis3")).alias("decision")).agg(F.count("*").alias("n"))
    return vocab.table(spark, vocab.NOTIFY_STATUSES, "decision").select("decision").join(n, "decision", "left").select("decision", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("p06_filtered_articles", f"WITH {ctes('article', 'evaluation', 'classification', 'source')}, {LATEST}, c AS (SELECT * FROM classification QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1), s AS (SELECT article_id, {SCORES} AS s FROM latest) SELECT a.id FROM article a JOIN source USING (source_id) WHERE tier = 1 AND published_at >= TIMESTAMP '2024-01-03' AND published_at < TIMESTAMP '2024-01-25' AND EXISTS (SELECT 1 FROM c WHERE c.article_id = a.id AND category <> 'other') AND EXISTS (SELECT 1 FROM s WHERE s.article_id = a.id AND {_DECIDE} = '{vocab.NO_NOTIFY}')")
def p06(spark, sf_dir):
    """Filters on the latest answers as semi-joins, on the day as ranges that reach the scan."""
    evaluated = latest_per(domain(spark, sf_dir, "evaluation"), ["article_id"], F.desc("created_at"), F.desc("id")).where(X.decide(F.col("axis1"), F.col("axis2"), F.col("axis3")) == vocab.NO_NOTIFY)
    classified = latest_per(domain(spark, sf_dir, "classification"), ["article_id"], F.desc("created_at"), F.desc("id")).where("category <> 'other'")
    a = domain(spark, sf_dir, "article").where("published_at >= timestamp_ntz'2024-01-03' and published_at < timestamp_ntz'2024-01-25'")
    a = a.join(domain(spark, sf_dir, "source").where("tier = 1"), "source_id", "left_semi")
    return a.join(classified, a["id"] == classified["article_id"], "left_semi").join(evaluated, a["id"] == evaluated["article_id"], "left_semi").select("id")


@query("p07_outstanding", f"WITH {ctes('article', 'evaluation', 'classification')}, c AS (SELECT * FROM classification QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY created_at DESC, id DESC) = 1) SELECT id FROM article a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.article_id = a.id AND category = 'other') AND NOT EXISTS (SELECT 1 FROM evaluation e WHERE e.article_id = a.id AND variant = 'P') ORDER BY published_at DESC, id DESC LIMIT 50")
def p07(spark, sf_dir):
    """Outstanding work of a variant: the anti-joins come before the limit, so settled rows do not use it up."""
    a = domain(spark, sf_dir, "article")
    other = latest_per(domain(spark, sf_dir, "classification"), ["article_id"], F.desc("created_at"), F.desc("id")).where("category = 'other'")
    done = domain(spark, sf_dir, "evaluation").where("variant = 'P'")
    left = a.join(other, a["id"] == other["article_id"], "left_anti").join(done, a["id"] == done["article_id"], "left_anti")
    return left.orderBy(F.desc("published_at"), F.desc("id")).limit(50).select("id")
