"""Rules that wait, over the driver's tables; their streaming forms are held against the same batch forms in tests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.adapt import NOW, ctes, domain
from newsloom.operators import market as M
from newsloom.operators import timed
from newsloom.plans.joins import asof_join, union_all
from newsloom.queries.market import DAYS, MOMENTS, NTH, moments, prices
from newsloom.registry import query

# --- R06

_OUTCOMES = """o AS (SELECT source_id, concat('https://example.org/', CAST(id % 3 AS VARCHAR)) AS url, started_at AS at_, id AS seq, CASE WHEN id % 11 = 0 THEN '' WHEN id % 8 = 0 THEN 'gone' WHEN id % 2 = 1 THEN 'network' ELSE 'rate_limit' END AS cause FROM attempt)"""
_LOG = f"""n AS MATERIALIZED (SELECT *, cause IN ('network', 'rate_limit') AS passing, row_number() OVER (PARTITION BY source_id, url ORDER BY at_, seq) AS k FROM o),
t AS (
  SELECT DISTINCT source_id, url, CAST(0 AS BIGINT) AS k, CAST(NULL AS TIMESTAMP) AS at_, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS said, false AS due, false AS dropped,
         0 AS b_attempts, CAST(NULL AS TIMESTAMP) AS b_next, CAST(NULL AS TIMESTAMP) AS b_updated, '' AS b_cause,
         false AS held, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS next_at, false AS fired, false AS gave_up, CAST(NULL AS TIMESTAMP) AS updated_at, '' AS cause FROM n
  UNION ALL
  SELECT source_id, url, k, at_, kind, new, due, dropped, attempts, next_at, updated_at, cause,
         CASE WHEN new = '' THEN false ELSE held1 OR kind IS NOT NULL END,
         CASE kind WHEN 'scheduled' THEN 0 WHEN 'rescheduled' THEN attempts + 1 WHEN 'gave_up' THEN attempts + 1 ELSE attempts END,
         CASE kind WHEN 'scheduled' THEN at_ + INTERVAL 5 MINUTE WHEN 'rescheduled' THEN at_ + to_minutes(CAST(least(360, 5 * pow(2, attempts)) AS INTEGER)) ELSE next_at END,
         CASE WHEN kind IN ('scheduled', 'rescheduled') THEN false ELSE fired1 END,
         CASE WHEN kind = 'gave_up' THEN true WHEN kind = 'scheduled' THEN false ELSE gave_up END,
         CASE WHEN kind IN ('scheduled', 'rescheduled', 'gave_up') THEN at_ ELSE updated_at END,
         CASE WHEN kind IN ('scheduled', 'rescheduled', 'gave_up') THEN new ELSE cause END
  FROM (SELECT *, CASE WHEN new = '' THEN CASE WHEN held1 THEN 'stored' END WHEN NOT held1 THEN CASE WHEN passing THEN 'scheduled' END WHEN gave_up OR NOT fired1 THEN NULL WHEN passing AND attempts + 1 < 6 THEN 'rescheduled' ELSE 'gave_up' END AS kind
        FROM (SELECT *, held AND NOT dropped AS held1, fired OR due AS fired1
              FROM (SELECT n.source_id, n.url, n.k, n.at_, n.cause AS new, n.passing, t.held, t.attempts, t.next_at, t.fired, t.gave_up, t.updated_at, t.cause,
                           t.held AND t.gave_up AND t.updated_at + INTERVAL 30 DAY <= n.at_ AS dropped, t.held AND NOT t.gave_up AND NOT t.fired AND t.next_at <= n.at_ AS due
                    FROM t JOIN n ON n.source_id = t.source_id AND n.url = t.url AND n.k = t.k + 1)))
), ends AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY source_id, url ORDER BY k DESC) = 1),
log AS (
  SELECT source_id, url, b_next AS at_, 'due' AS kind, b_attempts AS attempts, b_next AS next_at, b_cause AS cause FROM t WHERE due
  UNION ALL SELECT source_id, url, b_updated + INTERVAL 30 DAY, 'dropped', b_attempts, NULL, b_cause FROM t WHERE dropped
  UNION ALL SELECT source_id, url, at_, kind, attempts, CASE WHEN kind <> 'stored' THEN next_at END, said FROM t WHERE kind IS NOT NULL
  UNION ALL SELECT source_id, url, next_at, 'due', attempts, next_at, cause FROM ends WHERE held AND NOT gave_up AND NOT fired AND next_at <= TIMESTAMP '{NOW}'
  UNION ALL SELECT source_id, url, updated_at + INTERVAL 30 DAY, 'dropped', attempts, NULL, cause FROM ends WHERE held AND gave_up AND updated_at + INTERVAL 30 DAY <= TIMESTAMP '{NOW}'
)"""


@query("r06_retry_log", f'WITH RECURSIVE {ctes("attempt")}, {_OUTCOMES}, {_LOG} SELECT source_id, url, at_ AS "at", kind, attempts, next_at, cause FROM log')
def r06_log(spark, sf_dir):
    """Every fetch of the stream as an outcome of three pages a source; the stream fires the same by timers."""
    k = F.col("id")
    error = F.when(k % 11 == 0, "").when(k % 8 == 0, "HTTP 404").when(k % 2 == 1, "HTTP 503").otherwise("HTTP 429")
    a = domain(spark, sf_dir, "attempt").select("source_id", F.concat(F.lit("https://example.org/"), (k % 3).cast("string")).alias("url"), F.col("started_at").alias("at"), k.alias("seq"), error.alias("error"))
    return timed.retry_log(a, datetime.fromisoformat(NOW))


# --- R05


@query(
    "r05_settlements",
    f"WITH {ctes('article', 'price')}, {MOMENTS}, {DAYS}, w AS (SELECT m.id, 1 AS days_, {NTH.format(0)} AS nth_at, happened, symbol FROM moments m UNION ALL SELECT m.id, 3, {NTH.format(2)}, happened, symbol FROM moments m) "
    "SELECT w.id, days_ AS window_days, w.nth_at, CASE WHEN p.price IS NULL THEN 'no_baseline' WHEN w.nth_at IS NULL THEN 'waiting' ELSE 'settled' END AS state FROM w ASOF LEFT JOIN price p ON w.symbol = p.symbol AND w.happened >= p.observed_at",
)
def r05(spark, sf_dir):
    """Each prediction and window: settled, waiting for the market, or without a price to start from."""
    p = prices(spark, sf_dir)
    start = asof_join(moments(spark, sf_dir), p, ["symbol"], "at", "observed_at", ["price"]).select("id", "symbol", "at", "price")
    state = F.when(F.col("price").isNull(), "no_baseline").when(F.col("nth_at").isNull(), "waiting").otherwise("settled")
    return union_all([M.nth_trading_day(start, p, n).select("id", F.lit(n).alias("window_days"), "nth_at", state.alias("state")) for n in (1, 3)])
