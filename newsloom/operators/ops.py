"""Operations: crawls, coverage, cost, service levels, agreement of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import score as X
from newsloom.plans.joins import latest_per, top_per


def daily_new(articles: DataFrame, sources: DataFrame, first_day: str, last_day: str, day: Column) -> DataFrame:
    """(day, source_id, n), zero where nothing came. The grid is sources by days of the report."""
    n = articles.groupBy(day.alias("day"), "source_id").agg(F.count("*").alias("n"))
    days = sources.select("source_id", F.explode(F.sequence(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).alias("day"))
    return days.join(n, ["day", "source_id"], "left").select("day", "source_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def attempt_totals(attempts: DataFrame) -> DataFrame:
    """Per source, all of it in one pass."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return attempts.groupBy("source_id").agg(F.count("*").alias("attempts"), is_("failed").alias("failed"), is_("empty").alias("empty"), F.sum("fetched").alias("fetched"), F.sum("new").alias("new"))


def source_state(sources: DataFrame, attempts: DataFrame, now: Column, fresh_minutes: int = 15, hung_minutes: int = 30) -> DataFrame:
    """Per source its last attempt, seen as interrupted where it runs for too long, and the state that follows.
    ``sources``: source_id, enabled, last_new_at; ``attempts``: source_id, id, started_at, finished_at, status."""
    last = latest_per(attempts, ["source_id"], F.desc("started_at"), F.desc("id"))
    within = lambda c, minutes: F.coalesce(now - F.col(c) <= F.make_dt_interval(mins=F.lit(minutes)), F.lit(False))
    seen = F.when((F.col("status") == "running") & ~within("started_at", hung_minutes), "interrupted").otherwise(F.col("status"))
    state = (
        F.when(~F.col("enabled"), "disabled")
        .when(F.col("last_status").isin("failed", "partial", "empty", "interrupted"), F.col("last_status"))
        .when(within("finished_at", fresh_minutes), "healthy")
        .when(F.col("last_status") == "running", "running")
        .otherwise(F.when(F.col("last_new_at").isNotNull(), "stale").otherwise("unknown"))
    )
    joined = sources.join(last.select("source_id", "started_at", "finished_at", seen.alias("last_status")), "source_id", "left")
    return joined.select("source_id", F.col("started_at").alias("last_at"), "last_status", state.alias("state"))


def quality(articles: DataFrame) -> DataFrame:
    """Of all articles: duplicates, known from a feed or listing only, without a body, flagged."""
    n = lambda c, name: F.count_if(c).alias(name)
    return articles.agg(n(F.col("duplicate_of").isNotNull(), "duplicates"), n(F.col("extraction_tier").isin("feed", "listing"), "feed_only"), n(F.col("content") == "", "empty_body"), n(F.col("quality_flag") != "", "quality_flagged"))


def coverage(attempts: DataFrame, silence_seconds: int = 600) -> DataFrame:
    """Contiguous intervals (source_id, started_at, ended_at, state, error_class). An equal outcome extends the
    interval; a silence longer than allowed is ``unknown``, and what comes after starts afresh. ``attempts``: source_id,
    at, seq, state, error_class."""
    order = Window.partitionBy("source_id").orderBy("at", "seq")
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    lagged = attempts.withColumns({"_before": F.lag("at").over(order), "_was": F.lag(F.struct("state", "error_class")).over(order)})
    silent = F.col("_before").isNotNull() & (seconds(F.col("at")) - seconds(F.col("_before")) > silence_seconds * 1_000_000)
    fresh = F.col("_before").isNull() | silent
    new = fresh | (F.struct("state", "error_class") != F.col("_was"))
    marked = lagged.withColumns({"_silent": silent, "_new": new, "_start": F.when(fresh, F.col("at")).otherwise(F.col("_before"))})
    marked = marked.withColumn("_island", F.sum(F.col("_new").cast("int")).over(order))
    spans = marked.groupBy("source_id", "_island").agg(F.min("_start").alias("started_at"), F.max("at").alias("ended_at"), F.first("state").alias("state"), F.first("error_class").alias("error_class")).drop("_island")
    gaps = marked.where("_silent").select("source_id", F.col("_before").alias("started_at"), F.col("at").alias("ended_at"), F.lit("unknown").alias("state"), F.lit("").alias("error_class"))
    return spans.unionByName(gaps)


def coverage_hours(intervals: DataFrame, since: Column, now: Column) -> DataFrame:
    """Hours of each state within a window, clipped to it."""
    start, end = F.greatest("started_at", since), F.least("ended_at", now)
    hours = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 3.6e9
    return intervals.where((F.col("ended_at") > since) & (F.col("started_at") < now)).groupBy("source_id", "state").agg(F.sum(hours).alias("hours"))


def open_gaps(intervals: DataFrame, minutes: int) -> DataFrame:
    """Sources whose last interval is a gap at least so long."""
    last = latest_per(intervals, ["source_id"], F.desc("ended_at"), F.desc("started_at"))
    long = F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp")) >= minutes * 60_000_000
    return last.where((F.col("state") == "gap") & long).select("source_id", "started_at", "ended_at", "error_class")


def coverage_summary(sources: DataFrame, intervals: DataFrame, retries: DataFrame, now: Column, days: int = 7, unobserved_minutes: int = 10) -> DataFrame:
    """Per source: the gap that is still open (unknown, if nobody looked for so long), hours of gap and of unknown in
    the window, and fetches that wait for another try. ``retries``: source_id, gave_up."""
    since = now - F.make_dt_interval(days=F.lit(days))
    own = intervals.where(F.col("ended_at") >= since)
    last = latest_per(own, ["source_id"], F.desc("ended_at"), F.desc("started_at")).select("source_id", "started_at", "ended_at", F.col("state").alias("last_state"), "error_class")
    hours = coverage_hours(own, since, now).groupBy("source_id").agg(*[F.round(F.coalesce(F.sum(F.when(F.col("state") == s, F.col("hours"))), F.lit(0.0)), 1).alias(f"{s}_hours") for s in ("gap", "unknown")])
    waiting = retries.where("not gave_up").groupBy("source_id").agg(F.count("*").alias("retries_pending"))
    unseen = F.col("ended_at").isNull() | (now - F.col("ended_at") > F.make_dt_interval(mins=F.lit(unobserved_minutes)))
    open_ = ~unseen & (F.col("last_state") != "covered")
    joined = sources.select("source_id").join(last, "source_id", "left").join(hours, "source_id", "left").join(waiting, "source_id", "left")
    return joined.select(
        "source_id",
        F.when(unseen, "unknown").when(open_, F.col("last_state")).alias("open_gap"),
        F.when(open_, F.col("error_class")).otherwise("").alias("open_class"),
        F.when(unseen, F.col("ended_at")).when(open_, F.col("started_at")).alias("open_since"),
        *[F.coalesce(f"{s}_hours", F.lit(0.0)).alias(f"{s}_hours") for s in ("gap", "unknown")],
        F.coalesce("retries_pending", F.lit(0)).alias("retries_pending"),
    )


def cost_breakdown(usage: DataFrame, today: Column) -> DataFrame:
    """Per stage and provider: calls, cost, and today's of both (UTC days)."""
    is_today = F.to_date("created_at") == today
    money = F.sum(F.col("cost").cast("decimal(18,6)"))
    return usage.groupBy("stage", "provider").agg(F.count("*").alias("calls"), money.cast("double").alias("cost"), F.count_if(is_today).alias("today_calls"), F.coalesce(F.sum(F.when(is_today, F.col("cost").cast("decimal(18,6)"))), F.lit(0)).cast("double").alias("today_cost"))


def cost_totals(usage: DataFrame, stages: DataFrame, now: Column) -> DataFrame:
    """A10: by stage, with those that cost nothing, and in total (stage null): calls and cost of the month, cost of today; in UTC."""
    today, money = F.to_date(now), lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("double")
    cost = F.col("cost").cast("decimal(18,6)")
    month = usage.where((F.col("created_at") >= F.date_trunc("month", now)) & (F.col("created_at") <= now)).select("stage", cost.alias("cost"), (F.to_date("created_at") == today).alias("now"))
    joined = stages.select("stage").join(month, "stage", "left")
    return joined.groupingSets([[], [F.col("stage")]], F.col("stage")).agg(F.count("cost").alias("calls"), money(F.col("cost")).alias("month"), money(F.when(F.col("now"), F.col("cost"))).alias("today"))


def daily_cost(usage: DataFrame, stages: DataFrame, last_day: str, days: int = 7) -> DataFrame:
    """A10: every stage on every one of the last days, zero where nothing was spent."""
    first = F.date_sub(F.lit(last_day).cast("date"), days - 1)
    spent = usage.where((F.to_date("created_at") >= first) & (F.to_date("created_at") <= F.lit(last_day).cast("date"))).groupBy(F.to_date("created_at").alias("day"), "stage").agg(F.sum(F.col("cost").cast("decimal(18,6)")).cast("double").alias("cost"))
    grid = stages.select("stage", F.explode(F.sequence(first, F.lit(last_day).cast("date"))).alias("day"))
    return grid.join(spent, ["day", "stage"], "left").select("day", "stage", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def crawl_errors(attempts: DataFrame, now: Column) -> DataFrame:
    """Failures by source and cause over 7 days and 24 hours, with the causes' totals (source_id null), in one pass."""
    at = F.col("started_at")
    failed = attempts.where((F.col("status") == "failed") & (at >= now - F.make_dt_interval(days=F.lit(7)))).withColumn("error_class", X.error_class(F.col("error")))
    day = F.count_if(at >= now - F.make_dt_interval(days=F.lit(1)))
    cause, source = F.col("error_class"), F.col("source_id")
    return failed.groupingSets([[source, cause], [cause]], source, cause).agg(F.count("*").alias("week"), day.alias("day"))


def discovery_slo(articles: DataFrame, minutes: int = 5) -> DataFrame:
    """By source, how many were stored in time."""
    ok = F.col("created_at") <= F.col("published_at") + F.make_dt_interval(mins=F.lit(minutes))
    return articles.where("published_at is not null").groupBy("source_id").agg(F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"))


def brief_slo(events: DataFrame, usage: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """(id, outcome) from the first brief of each event against the time it was first seen."""
    first = usage.where("stage = 'brief'").groupBy(F.col("event_key").alias("id")).agg(F.min("created_at").alias("briefed_at"))
    due = F.col("first_seen_at") + F.make_dt_interval(mins=F.lit(minutes))
    out = F.when(F.col("briefed_at") <= due, "passed").when(F.col("briefed_at").isNotNull() | (now > due), "failed").otherwise("pending")
    return events.join(first, "id", "left").select("id", out.alias("outcome"))


def agreement(pairs: DataFrame, key: str) -> DataFrame:
    """Of reviewed against predicted, exact and within one level where both are assessed (Q9: anything else counts nowhere)."""
    mine, theirs = X.level_score(F.col("predicted")), X.level_score(F.col("reviewed"))
    both = mine.isNotNull() & theirs.isNotNull()
    return pairs.groupBy(key).agg(F.count_if(both).alias("n"), F.count_if(both & (mine == theirs)).alias("exact"), F.count_if(both & (F.abs(mine - theirs) <= 1)).alias("within_one"))


def confusion(pairs: DataFrame) -> DataFrame:
    """Counts of (reviewed, predicted)."""
    return pairs.groupBy("reviewed", "predicted").agg(F.count("*").alias("n"))


def standings(judged: DataFrame) -> DataFrame:
    """Per variant: appearances, wins, ties and the share won of what was decided. ``judged``: variant_a,
    variant_b, shown_as_left ('a' or 'b'), winner ('left', 'right', 'tie')."""
    left = F.when(F.col("shown_as_left") == "a", F.col("variant_a")).otherwise(F.col("variant_b"))
    right = F.when(F.col("shown_as_left") == "a", F.col("variant_b")).otherwise(F.col("variant_a"))
    winner = F.when(F.col("winner") == "left", left).when(F.col("winner") == "right", right)
    each = judged.select(F.explode(F.array("variant_a", "variant_b")).alias("variant"), winner.alias("w"))
    won, tied = F.count_if(F.col("w") == F.col("variant")), F.count_if(F.col("w").isNull())
    return each.groupBy("variant").agg(F.count("*").alias("appearances"), won.alias("wins"), tied.alias("ties"), (won / F.nullif(F.count("w"), F.lit(0))).alias("win_rate"))


def overlap(answers: DataFrame, existing: DataFrame) -> DataFrame:
    """(article_id, variant_a, variant_b, shown_as_left) that both answered and no pair has, in either order;
    the side comes from a hash, so a rerun shows the same."""
    a = answers.select("article_id", F.col("variant").alias("variant_a")).distinct()
    b = answers.select("article_id", F.col("variant").alias("variant_b")).distinct()
    seen = existing.select("article_id", F.least("variant_a", "variant_b").alias("variant_a"), F.greatest("variant_a", "variant_b").alias("variant_b"))
    pairs = a.join(b, "article_id").where("variant_a < variant_b").join(seen, ["article_id", "variant_a", "variant_b"], "left_anti")
    parity = F.crc32(F.concat_ws("|", F.col("article_id").cast("string"), "variant_a", "variant_b").cast("binary")) % 2
    return pairs.withColumn("shown_as_left", F.when(parity == 0, "a").otherwise("b"))


def pairwise(answers: DataFrame) -> DataFrame:
    """Of every two variants on their shared articles, how often the answers are the same."""
    a, b = (latest_per(answers, ["article_id", "variant"], F.desc("created_at"), F.desc("id")).select("article_id", F.col("variant").alias(f"variant_{s}"), F.col("category").alias(f"category_{s}")) for s in "ab")
    same = F.count_if(F.col("category_a") == F.col("category_b"))
    return a.join(b, "article_id").where("variant_a < variant_b").groupBy("variant_a", "variant_b").agg(F.count("*").alias("shared"), same.alias("same"))


def disagreements(answers: DataFrame) -> DataFrame:
    """Articles whose latest answers of the variants name more than one category."""
    latest = latest_per(answers, ["article_id", "variant"], F.desc("created_at"), F.desc("id"))
    return latest.groupBy("article_id").agg(F.count_distinct("category").alias("categories")).where("categories > 1")


def sample(strata: list[tuple[str, DataFrame]], limit: int, share: float = 0.4) -> DataFrame:
    """Ids by priority of stratum; each of the first takes a share of the limit at most, the last fills up; an id
    counts for the first stratum that has it. Each stratum: id, place (its order)."""
    parts = []
    for k, (name, df) in enumerate(strata):
        most = limit if k == len(strata) - 1 else int(limit * share)
        parts.append(df.orderBy("place", "id").limit(most).select("id", F.lit(k).alias("k"), F.lit(name).alias("stratum"), "place"))
    every = reduce(DataFrame.unionByName, parts)
    return latest_per(every, ["id"], F.asc("k")).orderBy("k", "place", "id").limit(limit).select("id", "stratum")


def round_robin(rows: DataFrame, buckets: list[str], order: list[Column], n: int) -> DataFrame:
    """One of each bucket in turn, until n."""
    turn = F.row_number().over(Window.partitionBy(*buckets).orderBy(*order))
    return rows.withColumn("turn", turn).orderBy("turn", *buckets).limit(n)


def run_status(runs: DataFrame, events: DataFrame) -> DataFrame:
    """Per run its cost, distinct successes and status. An empty wallet, an open circuit and a fatal error name the
    run, in this order; what was skipped or is retried is no failure; a run of skips alone had nothing to do."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    cost, done = F.sum(F.col("cost").cast("decimal(18,6)")).cast("double"), F.count_distinct(F.when(F.col("status") == "success", F.col("event_key")))
    counted = events.groupBy("run_id").agg(cost.alias("cost"), done.alias("successes"), n("quota_exhausted").alias("_quota"), n("circuit_open").alias("_circuit"), n("fatal").alias("_fatal"), n("success").alias("_ok"), n("skipped").alias("_skipped"), F.count_if(~F.col("status").isin("success", "skipped", "retry")).alias("_bad"), F.count("*").alias("_n"))
    ok, bad = F.col("_ok") > 0, F.col("_bad") > 0
    status = F.when(F.col("_n").isNull(), "no_work").when(F.col("_quota") > 0, "quota_exhausted").when(F.col("_circuit") > 0, "circuit_open").when(F.col("_fatal") > 0, "aborted").when(ok & bad, "partial").when(ok, "success").when(F.col("_skipped") == F.col("_n"), "no_work").otherwise("failed")
    return runs.select("run_id").join(counted, "run_id", "left").select("run_id", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("successes", F.lit(0)).alias("successes"), status.alias("status"))


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """A run is over when idle for so long: (run_id, started_at, ended_at, n)."""
    s = events.groupBy("run_id", F.session_window("created_at", gap).alias("w")).agg(F.min("created_at").alias("started_at"), F.max("created_at").alias("ended_at"), F.count("*").alias("n"))
    return s.select("run_id", "started_at", "ended_at", "n")


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], buckets: int = 1024) -> DataFrame:
    """Per key the count ``n`` and the values at places (from 1) of its sorted values; ``ranks`` are columns over ``n``. Values
    fall into buckets between a key's least and greatest; only the bucket that holds a place is put in order, so a key with
    most of the rows is many groups."""
    ends = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("n"))
    width = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(buckets - 1), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets))).otherwise(F.lit(0)).cast("int")
    dealt = rows.where(F.col(value).isNotNull()).join(ends, keys).withColumn("_b", width)
    counted = dealt.groupBy(*keys, "_b").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy(*keys).orderBy("_b"))
    wanted = ends.select(*keys, "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place.cast("long").alias("place")) for name, place in ranks.items()])).alias("w")).select(*keys, "n", "w.*")
    holding = counted.withColumn("_upto", upto).join(wanted, keys).where((F.col("place") <= F.col("_upto")) & (F.col("place") > F.col("_upto") - F.col("_m")))
    inside = dealt.join(holding.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(value)))
    found = inside.select(*keys, "_b", "_r", F.col(value).alias("_v")).join(holding.withColumn("_r", F.col("place") - F.col("_upto") + F.col("_m")), [*keys, "_b", "_r"])
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])


def percentile_by_index(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median cut to whole numbers, and the p95 at place int(.95 n) - 1 of the sorted values: another
    definition than nearest rank."""
    n = F.col("n")
    places = {"_m1": F.floor((n + 1) / 2), "_m2": F.ceil((n + 1) / 2), "p95": F.greatest(F.floor(0.95 * n), F.lit(1))}
    return at_ranks(rows, keys, value, places).select(*keys, F.floor((F.col("_m1") + F.col("_m2")) / 2).cast("long").alias("p50"), "p95", "n")


def benchmark(calls: DataFrame) -> DataFrame:
    """Per model: latencies by ``percentile_by_index``, the share of answers that kept to the form, cost per call.
    ``calls``: model, latency, valid, cost."""
    kept = calls.groupBy("model").agg(F.avg(F.col("valid").cast("int")).alias("compliance"), (F.sum(F.col("cost").cast("decimal(18,6)")).cast("double") / F.count("*")).alias("cost_per_call"))
    return percentile_by_index(calls, ["model"], "latency").join(kept, "model")


def outcomes_of_day(events: DataFrame, now: Column) -> DataFrame:
    """How many steps ended how in the last 24 hours."""
    return events.where((F.col("created_at") >= now - F.make_dt_interval(hours=F.lit(24))) & (F.col("created_at") <= now)).groupBy("stage", "status").agg(F.count("*").alias("n"))


def circuit(outcomes: DataFrame, errors: int = 5) -> DataFrame:
    """After each outcome of a provider, how many errors are in a row and whether the circuit is open. A success
    closes it; a wallet failure opens it at once. Errors are counted within a day; those of the days before, back to the
    last success, come from a summary with a row for each provider and day, so few providers with all the rows are many groups."""
    ok, wallet = F.col("status") == "success", F.col("status") == "wallet"
    order = Window.partitionBy("provider", "_day").orderBy("created_at", "id")
    island = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = outcomes.withColumn("_day", F.to_date("created_at")).withColumn("_i", F.sum(ok.cast("int")).over(island))
    inside = Window.partitionBy("provider", "_day", "_i").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    counted = marked.withColumns({"_n": F.sum((~ok).cast("long")).over(inside), "_w": F.max(wallet.cast("int")).over(inside)})
    last = F.struct("created_at", "id")
    days = counted.groupBy("provider", "_day").agg(F.max("_i").alias("_ok"), F.max_by("_n", last).alias("_left"), F.max_by("_w", last).alias("_lost"))
    by_day = Window.partitionBy("provider").orderBy("_day")
    runs = days.withColumn("_g", F.sum((F.col("_ok") > 0).cast("int")).over(by_day))
    upto = Window.partitionBy("provider", "_g").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.withColumns({"_s": F.sum("_left").over(upto), "_f": F.max("_lost").over(upto)})
    carried = runs.select("provider", "_day", F.lag("_s").over(by_day).alias("_before"), F.lag("_f").over(by_day).alias("_was"))
    joined = counted.join(carried, ["provider", "_day"])
    open_run = F.col("_i") == 0
    row = F.col("_n") + F.when(open_run, F.coalesce("_before", F.lit(0))).otherwise(F.lit(0))
    fatal = F.greatest(F.col("_w"), F.when(open_run, F.coalesce("_was", F.lit(0))).otherwise(F.lit(0)))
    return joined.select("id", "provider", row.alias("errors_in_a_row"), ((row >= errors) | (fatal == 1)).alias("open"))


def capped(attempts: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The first attempts on each evidence."""
    return top_per(attempts, keys, most, F.asc("created_at"), F.asc("id"))


def verdict(metrics: DataFrame, floors: dict[str, float], least: int) -> DataFrame:
    """Aborted, insufficient, fail with its reasons, or pass."""
    below = F.filter(F.array(*[F.when(F.coalesce(F.col(k) < v, F.lit(True)), F.lit(k)) for k, v in floors.items()]), lambda x: x.isNotNull())
    out = F.when(F.col("aborted"), "aborted").when(F.col("n") < least, "insufficient").when(F.size(below) > 0, "fail").otherwise("pass")
    return metrics.withColumn("reasons", F.when(out == "fail", below).otherwise(F.array().cast("array<string>"))).withColumn("verdict", out)


