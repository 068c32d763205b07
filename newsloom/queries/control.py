"""Notices, budgets and circuits over the driver's event stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from newsloom.adapt import ctes, domain
from newsloom.operators import control as K
from newsloom.registry import query

# --- R09

_SPACED = """a AS MATERIALIZED (SELECT source_id::VARCHAR AS key, started_at AS at_, id AS seq FROM attempt WHERE status = 'failed'),
t AS (
  SELECT key, min({'m': at_, 'seq': seq}) AS x FROM a GROUP BY key
  UNION ALL
  SELECT a.key, min({'m': a.at_, 'seq': a.seq}) FROM t JOIN a ON a.key = t.key AND a.at_ >= t.x.m + INTERVAL 6 HOUR GROUP BY a.key
)"""


@query("r09_spaced_notices", f'WITH RECURSIVE {ctes("attempt")}, {_SPACED} SELECT key, x.m AS "at", x.seq AS seq FROM t')
def r09(spark, sf_dir):
    """First of a key, then six hours of quiet."""
    a = domain(spark, sf_dir, "attempt").where("status = 'failed'")
    return K.spaced(a.select(F.col("source_id").cast("string").alias("key"), F.col("started_at").alias("at"), F.col("id").alias("seq")))


# --- R10

#: Ceilings that runs, days and the month of the driver's stream reach; a reserve near the cost of a call.
BUDGET = K.Budget(run=2500.0, day=15_000.0, month=400_000.0, run_calls=55, reserve=60.0)

_BUDGET = f"""calls AS (
  SELECT id, run_id, created_at AS started_at, created_at + to_minutes(CAST(1 + id * 7 % 300 AS INTEGER)) AS ended_at,
         CAST(cost AS DECIMAL(28,6)) AS cost, status <> 'success' AS released, id % 4 = 0 AS optional
  FROM usage
), marks AS (
  SELECT id, run_id, started_at AS at_, 1 AS phase, cost, released, optional, false AS held FROM calls
  UNION ALL
  SELECT id, run_id, ended_at, CASE WHEN ended_at > started_at THEN 0 ELSE 2 END, cost, released, optional, date_trunc('month', started_at) = date_trunc('month', ended_at) FROM calls
), n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY at_, phase, id) AS k FROM marks),
t AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS why, CAST(NULL AS DATE) AS day, CAST(NULL AS DATE) AS month,
         CAST(0 AS DECIMAL(28,6)) AS run_spent, CAST(0 AS DECIMAL(28,6)) AS day_spent, CAST(0 AS DECIMAL(28,6)) AS month_spent, CAST(0 AS BIGINT) AS reserved,
         CAST(MAP {{}} AS MAP(BIGINT, DECIMAL(28,6))) AS spent, CAST(MAP {{}} AS MAP(BIGINT, BIGINT)) AS calls, CAST([] AS BIGINT[]) AS open
  UNION ALL
  SELECT k, CASE WHEN phase = 1 THEN id END, CASE WHEN phase = 1 THEN why END, day, month,
         CASE WHEN phase = 1 THEN own END, CAST(of_day + paid AS DECIMAL(28,6)), CAST(of_month + paid AS DECIMAL(28,6)),
         reserved + takes - gives,
         CASE WHEN paid > 0 THEN map_concat(spent, MAP {{run_id: CAST(own + paid AS DECIMAL(28,6))}}) ELSE spent END,
         CASE WHEN takes > 0 THEN map_concat(calls, MAP {{run_id: made + 1}}) WHEN backs > 0 THEN map_concat(calls, MAP {{run_id: made - 1}}) ELSE calls END,
         CASE WHEN takes > 0 THEN list_append(open, id) WHEN ends THEN list_filter(open, lambda x: x <> id) ELSE open END
  FROM (SELECT *, CASE WHEN phase = 1 AND why = '' THEN 1 ELSE 0 END AS takes, CASE WHEN ends AND held THEN 1 ELSE 0 END AS gives,
               CASE WHEN ends AND NOT released THEN cost ELSE CAST(0 AS DECIMAL(28,6)) END AS paid, CASE WHEN ends AND released THEN 1 ELSE 0 END AS backs
        FROM (SELECT *, phase <> 1 AND list_contains(open, id) AS ends,
                     CASE WHEN optional AND of_month >= {BUDGET.optional_share * BUDGET.month:.6f} THEN 'optional' WHEN own >= {BUDGET.run:.6f} THEN 'run' WHEN of_day >= {BUDGET.day:.6f} THEN 'day' WHEN of_month >= {BUDGET.month:.6f} THEN 'month'
                          WHEN made >= {BUDGET.run_calls} THEN 'calls' WHEN of_month + (reserved + 1) * {BUDGET.reserve:.6f} > {BUDGET.month:.6f} THEN 'reserved' ELSE '' END AS why
              FROM (SELECT n.k, n.id, n.run_id, n.phase, n.cost, n.released, n.optional, n.held, t.spent, t.calls, t.open,
                           CAST(n.at_ AS DATE) AS day, CAST(date_trunc('month', n.at_) AS DATE) AS month,
                           coalesce(map_extract_value(t.spent, n.run_id), CAST(0 AS DECIMAL(28,6))) AS own, coalesce(map_extract_value(t.calls, n.run_id), 0) AS made,
                           CASE WHEN t.day = CAST(n.at_ AS DATE) THEN t.day_spent ELSE CAST(0 AS DECIMAL(28,6)) END AS of_day,
                           CASE WHEN t.month = CAST(date_trunc('month', n.at_) AS DATE) THEN t.month_spent ELSE CAST(0 AS DECIMAL(28,6)) END AS of_month,
                           CASE WHEN t.month = CAST(date_trunc('month', n.at_) AS DATE) THEN t.reserved ELSE 0 END AS reserved
                    FROM t JOIN n ON n.k = t.k + 1)))
)"""


@query("r10_budget", f"WITH RECURSIVE {ctes('usage')}, {_BUDGET} SELECT id, why AS refused_by, CAST(run_spent AS DOUBLE) AS run_spent, CAST(day_spent AS DOUBLE) AS day_spent, CAST(month_spent AS DOUBLE) AS month_spent FROM t WHERE id IS NOT NULL")
def r10(spark, sf_dir):
    """All calls of the stream against ceilings for their run, day and month; what is refused takes nothing."""
    u = domain(spark, sf_dir, "usage")
    calls = u.select(
        "id", "run_id", F.col("created_at").alias("started_at"), (F.col("created_at") + F.make_dt_interval(mins=(1 + F.col("id") * 7 % 300).cast("int"))).alias("ended_at"),
        "cost", (F.col("status") != "success").alias("released"), (F.col("id") % 4 == 0).alias("optional"),
    )
    return K.admitted(calls, BUDGET).select("id", "refused_by", "run_spent", "day_spent", "month_spent")


# --- R11, C46

RULES = K.Rules(threshold=3, stop_after=2, probe_delay=timedelta(hours=12), probe_lasts=timedelta(hours=6))

_KINDS = """said AS (
  SELECT id, provider, created_at AS at_, status,
         CASE id % 6 WHEN 0 THEN 'You exceeded your current QUOTA' WHEN 1 THEN 'Daily budget exhausted: quota' WHEN 2 THEN 'insufficient credit' WHEN 3 THEN 'bad key' ELSE 'HTTP 503' END AS says,
         CASE id % 6 WHEN 1 THEN 'BudgetExceeded' WHEN 3 THEN 'Fatal' ELSE 'Transient' END AS name
  FROM usage
), events AS (
  SELECT id, provider, at_,
         CASE WHEN id % 29 = 0 THEN ['probe_ok', 'probe_ok', 'probe_budget', 'probe_failed', 'probe_failed', 'probe_failed', 'probe_crashed'][1 + (id // 29) % 7] WHEN status = 'success' THEN 'success'
              WHEN name = 'BudgetExceeded' AND contains(lower(says), 'daily budget exhausted') THEN 'ceiling' WHEN contains(lower(says), 'quota') OR contains(lower(says), 'insufficient') THEN 'wallet' WHEN name = 'Fatal' THEN 'fatal' ELSE 'error' END AS kind
  FROM said
)"""
_T, _STOP = RULES.threshold, RULES.stop_after
_CIRCUIT = f"""n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY at_, id) AS k FROM events),
t AS (
  SELECT provider, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS TIMESTAMP) AS at_, 'open_budget' AS mode, 'budget' AS cause, 0 AS errors, 0 AS probes,
         min(at_) + INTERVAL 12 HOUR AS next_at, CAST(NULL AS TIMESTAMP) AS last_at FROM n GROUP BY provider
  UNION ALL
  SELECT provider, k, id, at_,
         CASE act WHEN 'close' THEN 'closed' WHEN 'probe_close' THEN 'closed' WHEN 'wallet' THEN 'open_budget' WHEN 'probe_budget' THEN 'open_budget' WHEN 'storm' THEN 'open_errors' WHEN 'probe_errors' THEN 'open_errors'
                  WHEN 'stop' THEN 'stopped' WHEN 'probe' THEN 'probing' WHEN 'reclaim' THEN held ELSE mode END,
         CASE WHEN act IN ('close', 'probe_close') THEN '' WHEN act IN ('wallet', 'probe_budget') THEN 'budget' WHEN act IN ('storm', 'probe_errors') THEN 'provider_error' WHEN act = 'stop' THEN 'probe_failed' ELSE cause END,
         CASE WHEN act IN ('close', 'probe_close') THEN 0 WHEN act IN ('storm', 'count') THEN least(errors + 1, {_T}) ELSE errors END,
         CASE WHEN act IN ('close', 'probe_close') THEN 0 WHEN act IN ('stop', 'probe_errors') THEN least(probes + 1, {_STOP}) ELSE probes END,
         CASE WHEN act IN ('close', 'probe_close') THEN NULL WHEN act IN ('wallet', 'storm', 'probe_budget', 'probe_errors', 'stop') THEN at_ + INTERVAL 12 HOUR ELSE next_at END,
         CASE WHEN act IN ('probe', 'probe_close', 'probe_budget', 'probe_errors', 'stop') THEN at_ ELSE last_at END
  FROM (SELECT *, CASE WHEN kind = 'success' THEN CASE WHEN errors > 0 OR mode = 'probing' THEN 'close' ELSE 'keep' END WHEN kind = 'wallet' THEN 'wallet'
                       WHEN kind IN ('fatal', 'error') THEN CASE WHEN kind = 'fatal' OR errors + 1 >= {_T} THEN 'storm' ELSE 'count' END
                       WHEN kind = 'ceiling' OR held = 'probing' THEN 'keep' WHEN held = 'closed' OR coalesce(at_ < next_at, false) THEN 'reclaim'
                       WHEN kind = 'probe_crashed' THEN 'probe' WHEN kind = 'probe_ok' THEN 'probe_close' WHEN kind = 'probe_budget' OR cause = 'budget' THEN 'probe_budget'
                       WHEN probes + 1 >= {_STOP} THEN 'stop' ELSE 'probe_errors' END AS act
        FROM (SELECT n.provider, n.k, n.id, n.at_, n.kind, t.mode, t.cause, t.errors, t.probes, t.next_at, t.last_at,
                     CASE WHEN t.mode = 'probing' AND n.at_ > t.last_at + INTERVAL 6 HOUR THEN CASE t.cause WHEN 'budget' THEN 'open_budget' WHEN 'probe_failed' THEN 'stopped' ELSE 'open_errors' END ELSE t.mode END AS held
              FROM t JOIN n ON n.provider = t.provider AND n.k = t.k + 1))
), shown AS (SELECT *, CASE WHEN mode = 'probing' AND at_ > last_at + INTERVAL 6 HOUR THEN CASE cause WHEN 'budget' THEN 'open_budget' WHEN 'probe_failed' THEN 'stopped' ELSE 'open_errors' END ELSE mode END AS state FROM t WHERE id IS NOT NULL)"""


@query("r11_circuit_states", f"WITH RECURSIVE {ctes('usage')}, {_KINDS}, {_CIRCUIT} SELECT id, provider, state, cause, errors AS errors_in_a_row, probes AS probe_failures, next_at AS next_probe_at, last_at AS last_probe_at, state <> 'closed' AS blocked FROM shown")
def r11_states(spark, sf_dir):
    """Closed, open by an empty wallet or by errors, probing, stopped: after every event of three providers."""
    u, k = domain(spark, sf_dir, "usage"), F.col("id")
    says = F.when(k % 6 == 0, "You exceeded your current QUOTA").when(k % 6 == 1, "Daily budget exhausted: quota").when(k % 6 == 2, "insufficient credit").when(k % 6 == 3, "bad key").otherwise("HTTP 503")
    name = F.when(k % 6 == 1, "BudgetExceeded").when(k % 6 == 3, "Fatal").otherwise("Transient")
    went = F.array(*[F.lit(x) for x in ("probe_ok", "probe_ok", "probe_budget", "probe_failed", "probe_failed", "probe_failed", "probe_crashed")])
    kind = F.when(k % 29 == 0, went[(F.floor(k / 29) % 7).cast("int")]).when(F.col("status") == "success", "success").otherwise(K.failure_kind(says, name))
    return K.circuit_states(u.select("id", "provider", F.col("created_at").alias("at"), kind.alias("kind")), RULES)
