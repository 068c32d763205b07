"""The desk: reviews, deliveries, work lists, visibility and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.plans.joins import latest_per, met_by_any, top_per, union_all


def split_event(memberships: DataFrame, articles: DataFrame, event_id: int, article_id: int, new_event: int) -> DataFrame:
    """An article and its copies leave an event for one of their own."""
    moved = articles.where((F.col("id") == article_id) | (F.col("duplicate_of") == article_id)).select(F.col("id").alias("article_id"), F.lit(True).alias("_m"))
    joined = memberships.join(moved, "article_id", "left")
    leaves = (F.col("event_id") == event_id) & F.coalesce("_m", F.lit(False))
    return joined.select(F.when(leaves, F.lit(new_event)).otherwise(F.col("event_id")).alias("event_id"), "article_id").distinct()


def primary(memberships: DataFrame, articles: DataFrame) -> DataFrame:
    """The lead of an event: reported first, then the smallest id."""
    joined = memberships.join(articles.select(F.col("id").alias("article_id"), "reported_at"), "article_id")
    return latest_per(joined, ["event_id"], F.asc("reported_at"), F.asc("article_id")).select("event_id", "article_id")


def review_sample(assessments: DataFrame) -> DataFrame:
    """What a person shall look at: weighty and uncertain, or one in twenty."""
    reason = F.when((F.col("impact") >= 60) & (F.col("confidence") < 0.7), "uncertain").when(F.col("id") % 20 == 0, "audit")
    return assessments.withColumn("reason", reason).where("reason is not null")


def answered_gate(eligible: DataFrame, answers: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """The next step of each article: the first it has no answer for; ``other`` stops it."""
    have = answers.groupBy("id").agg(F.collect_set("step").alias("have"), F.bool_or((F.col("step") == steps[0]) & (F.col("value") == "other")).alias("stopped"))
    joined = eligible.join(have, "id", "left")
    left = F.filter(F.array(*map(F.lit, steps)), lambda s: ~F.coalesce(F.array_contains(F.col("have"), s), F.lit(False)))
    return joined.where(~F.coalesce("stopped", F.lit(False)) & (F.size(left) > 0)).select("id", left[0].alias("next_step"))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many rows a new set of rules holds and releases."""
    joined = before.select("id", F.col("prefilter_reason").alias("a")).join(after.select("id", F.col("prefilter_reason").alias("b")), "id")
    return joined.agg(F.count_if((F.col("a") == "") & (F.col("b") != "")).alias("held"), F.count_if((F.col("a") != "") & (F.col("b") == "")).alias("released"))


def image_work(articles: DataFrame, dead_hosts: DataFrame, most: int = 200) -> DataFrame:
    """C20: the newest pending images, hosts that are dead left out before the limit."""
    host = F.lower(F.regexp_extract("image_url", "://([^/?#]*)", 1))
    return articles.where("image_status = 'pending'").withColumn("host", host).join(dead_hosts, "host", "left_anti").orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def deliveries(devices: DataFrame, sent: DataFrame) -> DataFrame:
    """Devices that an alert has not reached: (alert_id, device_id)."""
    return devices.join(sent, ["alert_id", "device_id"], "left_anti")


def next_pair(pairs: DataFrame, feedback: DataFrame, users: DataFrame) -> DataFrame:
    """Each user's first pair without their verdict. Pairs are numbered in order; a user who has judged the first so
    many without a gap goes on behind them, so users never meet pairs but the one that comes next."""
    numbered = pairs.select("pair_id").distinct().withColumn("place", F.row_number().over(Window.orderBy("pair_id")))  # a curated set
    judged = feedback.select("user_id", "pair_id").distinct().join(numbered, "pair_id")
    ranked = judged.withColumn("_r", F.row_number().over(Window.partitionBy("user_id").orderBy("place")))
    done = ranked.groupBy("user_id").agg((F.count_if(F.col("_r") == F.col("place")) + 1).alias("place"))
    return users.join(done, "user_id", "left").withColumn("place", F.coalesce("place", F.lit(1))).join(numbered, "place").select("user_id", "pair_id")



def truth(cases: DataFrame) -> DataFrame:
    """Labels that may be used: approved, with a category."""
    return cases.where("status = 'approved' and coalesce(reviewed_category, '') <> ''")


def outcomes(labels: DataFrame, answers: DataFrame) -> DataFrame:
    """Per label, what was answered; an answer that cannot be used is no prediction."""
    joined = labels.join(answers, "id", "left")
    return joined.select("id", "truth", F.when(F.col("usable"), F.col("answer")).alias("predicted"), F.coalesce(F.col("usable") & (F.col("answer") == F.col("truth")), F.lit(False)).alias("hit"))


def grouping_quality(pairs: DataFrame) -> DataFrame:
    """Precision and recall of same-event calls."""
    tp = F.count_if(F.col("called") & F.col("same"))
    return pairs.agg((tp / F.nullif(F.count_if(F.col("called")), F.lit(0))).alias("precision"), (tp / F.nullif(F.count_if(F.col("same")), F.lit(0))).alias("recall"))


def canary(attempts: DataFrame) -> DataFrame:
    """A crawl that parses nothing is degraded; which tiers it gave."""
    return attempts.groupBy("source_id").agg(F.sum("parsed").alias("parsed"), F.count_if("with_image").alias("with_image"), F.array_sort(F.collect_set("tier")).alias("tiers")).withColumn("degraded", F.col("parsed") == 0)


def embedding_backlog(articles: DataFrame, embedded: DataFrame, model: str, most: int) -> DataFrame:
    """The newest articles without a vector of a model."""
    return articles.join(embedded.where(F.col("model") == model).select("id"), "id", "left_anti").orderBy(F.desc("created_at"), F.desc("id")).limit(most).select("id")


def invalidate(events: DataFrame, texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """The texts to keep as revisions, and the events with theirs blank; events without text are left alone."""
    some = F.concat(*[F.coalesce(c, F.lit("")) for c in texts]) != ""
    return events.where(some).select("id", *texts), events.withColumns({c: F.lit("") for c in texts})


def independence_key(name: Column, group: Column, aggregator: Column) -> Column:
    """Null for what only relays."""
    return F.when(~aggregator, F.coalesce(F.nullif(group, F.lit("")), name))


def question_hash(parts: DataFrame) -> DataFrame:
    """One row, the hash of the typed questions in order of name, whatever order they came in."""
    rows = F.array_sort(F.collect_list(F.struct("name", "kind", "choices")))
    return parts.agg(F.substring(F.sha2(F.to_json(rows).cast("binary"), 256), 1, 12).alias("hash"))


def accumulate_tags(old: DataFrame, answered: DataFrame, most: int = 5) -> DataFrame:
    """Tags are never dropped; of an assessment the strongest come in, by level and then slug."""
    new = top_per(answered.where("level >= 1"), ["event_id"], most, F.desc("level"), F.asc("item")).select("event_id", "item")
    return old.select("event_id", "item").unionByName(new).distinct()


def interested(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event_id, endpoint): a subscriber who wants what an event is: home, abroad, or an asset class. Subscribers of equal
    wishes meet an event together, and each pair is made once, at the first topic that they share."""
    wants = subscriptions.select("endpoint", F.explode(F.concat(F.when(F.col("iran"), F.array(F.lit("iran"))).otherwise(F.array().cast("array<string>")), F.when(F.col("world"), F.array(F.lit("global"))).otherwise(F.array().cast("array<string>")), "assets")).alias("topic"))
    has = events.select("event_id", F.explode("topics").alias("topic"))
    has = has.groupBy("event_id").agg(F.array_sort(F.collect_set("topic")).alias("has"))
    wants = wants.groupBy("endpoint").agg(F.array_sort(F.collect_set("topic")).alias("wants"))
    return met_by_any(has, wants, "endpoint").select("event_id", F.explode("members").alias("endpoint"))


def gate(measures: DataFrame) -> DataFrame:
    """Each gate of a release with its verdict. ``measures``: name, value, floor, ceiling, n, least."""
    ok = (F.col("n") >= F.col("least")) & F.coalesce(F.col("value") >= F.col("floor"), F.lit(True)) & F.coalesce(F.col("value") <= F.col("ceiling"), F.lit(True))
    return measures.withColumn("passed", F.coalesce(ok & F.col("value").isNotNull(), F.lit(False)))


#: What a release needs: sources that are on and that worked lately, finished reviews, top cases by either side,
#: the sample and the minutes of priority visibility, the rates of false and missed top tiers, the month's cost, the top score.
SOURCES, REVIEWS, TOP_CASES, SAMPLE, P95_MINUTES, FALSE_TOP, MISSED_TOP, MONTH_USD, TOP_SCORE = 25, 100, 10, 100, 10.0, 0.02, 0.05, 100.0, 80


def release_measures(reviews: DataFrame, visibility: DataFrame, sources: DataFrame, usage: DataFrame, now: Column) -> DataFrame:
    """The rows of ``gate``: name, value, floor, ceiling, n, least. ``reviews`` (finished): iran_score of the event (null counts
    as 0), reviewed_iran_score; ``visibility``: minutes; ``sources``: enabled, healthy, last_success_at; ``usage`` of the month: cost.
    A rate of none is no failure; too small a sample fails by itself."""
    n = F.count_if
    said, found = F.coalesce("iran_score", F.lit(0)) >= TOP_SCORE, F.col("reviewed_iran_score") >= TOP_SCORE
    judged = reviews.where("reviewed_iran_score is not null").agg(F.count("*").alias("reviewed"), n(said & ~found).alias("wrong"), n(~said & found).alias("missed"), n(said).alias("predicted"), n(found).alias("actual"))
    lately = F.col("healthy") & (F.col("last_success_at") >= now - F.make_dt_interval(hours=F.lit(6)))
    crawled = sources.where("enabled").agg(F.count("*").alias("sources"), n(lately).alias("recent"))
    seen = visibility.agg(F.count("minutes").alias("seen"), F.expr("percentile_disc(0.95) within group (order by minutes)").alias("p95"))
    spent = usage.agg(F.coalesce(F.sum(F.col("cost").cast("decimal(18,6)")).cast("double"), F.lit(0.0)).alias("spent"))
    rate = lambda part, whole: F.coalesce(F.col(part) / F.nullif(F.col(whole), F.lit(0)), F.lit(0.0))
    one = judged.crossJoin(crawled).crossJoin(seen).crossJoin(spent)  # four rows by their aggregates
    rows = [
        ("enabled_sources", F.col("sources"), float(SOURCES), None, F.col("sources"), 0),
        ("healthy_sources", F.col("recent"), float(SOURCES), None, F.col("sources"), 0),
        ("reviewed", F.col("reviewed"), float(REVIEWS), None, F.col("reviewed"), 0),
        ("top_cases", F.least("predicted", "actual"), float(TOP_CASES), None, F.col("reviewed"), 0),
        ("visibility_p95", F.col("p95"), None, P95_MINUTES, F.col("seen"), SAMPLE),
        ("false_top", rate("wrong", "predicted"), None, FALSE_TOP, F.col("predicted"), 0),
        ("missed_top", rate("missed", "actual"), None, MISSED_TOP, F.col("actual"), 0),
        ("month_usd", F.col("spent"), None, MONTH_USD, F.lit(1), 0),
    ]
    limit = lambda x: F.lit(x).cast("double")
    built = F.array(*[F.struct(F.lit(name).alias("name"), v.cast("double").alias("value"), limit(lo).alias("floor"), limit(hi).alias("ceiling"), m.cast("long").alias("n"), F.lit(least).alias("least")) for name, v, lo, hi, m, least in rows])
    return one.select(F.inline(built))


def conditions(named: dict[str, DataFrame]) -> DataFrame:
    """(condition, key) of all that calls for a notice."""
    return union_all([df.select(F.lit(name).alias("condition"), F.col(df.columns[0]).cast("string").alias("key")) for name, df in named.items()])


def lead_outlet(reports: DataFrame) -> DataFrame:
    """Per event its first outlet and how many others."""
    outlet = F.coalesce(F.nullif("outlet", F.lit("")), F.col("source_name"))
    return reports.groupBy("event_id").agg(F.min(F.struct("reported_at", "report_id", outlet.alias("o"))).getField("o").alias("lead"), (F.count_distinct(outlet) - 1).alias("others"))


def section_places(events: DataFrame) -> DataFrame:
    """(section, place, n): the place that each section's newest event has among all events, newest first, and the number
    of its events. ``events``: section, event_time, id; sections are a vocabulary. Places are counts of what is newer than a
    section's newest: every event is counted once, by how many of those it is newer than."""
    at = F.struct("event_time", "id")
    tops = events.groupBy("section").agg(F.max(at).alias("top"), F.count("*").alias("n"))
    order = F.array_sort(F.collect_set("top"))
    line = tops.agg(order.alias("tops"))
    newer = events.crossJoin(F.broadcast(line)).select(F.size(F.filter("tops", lambda t: t < at)).alias("k")).groupBy("k").agg(F.count("*").alias("m"))  # one row by its aggregate
    counted = newer.agg(F.collect_list(F.struct("k", "m")).alias("counts"))
    placed = tops.crossJoin(F.broadcast(line)).crossJoin(F.broadcast(counted)).withColumn("j", F.array_position("tops", F.col("top")))  # one row each
    ahead = F.aggregate(F.filter("counts", lambda c: c["k"] >= F.col("j")), F.lit(0).cast("long"), lambda s, c: s + c["m"])
    return placed.select("section", (ahead + 1).cast("int").alias("place"), "n")


def section_order(events: DataFrame) -> DataFrame:
    """Sections by their best-placed event."""
    return events.groupBy("section").agg(F.min("place").alias("best"), F.count("*").alias("n"))


def log_tail(events: DataFrame, most: int = 500) -> DataFrame:
    """C43."""
    return events.orderBy(F.desc("created_at"), F.desc("id")).limit(most)


def timeline(points: DataFrame, markers: DataFrame, relevance: int = 50) -> DataFrame:
    """A series' points with how many relevant events fall on each day."""
    day = F.to_date("observed_at")
    n = markers.where(F.col("relevance") >= relevance).groupBy("symbol", F.to_date("at").alias("day")).agg(F.count("*").alias("markers"))
    days = points.groupBy("symbol", day.alias("day")).agg(F.max_by("price", "observed_at").alias("price"))
    change = F.col("price") - F.lag("price").over(Window.partitionBy("symbol").orderBy("day"))
    return days.withColumn("change", change).join(n, ["symbol", "day"], "left").select("symbol", "day", "price", "change", F.coalesce("markers", F.lit(0)).alias("markers"))


def untranslated(events: DataFrame, reports: DataFrame, lang: str = "fa") -> DataFrame:
    """(event_id, untranslated): whether a reader meets a headline in another language: no title of their own, and a lead
    source that does not write in it. ``events``: event_id, title; ``reports``: event_id, report_id, reported_at, is_primary, language."""
    lead = latest_per(reports, ["event_id"], F.desc("is_primary"), F.asc("reported_at"), F.asc("report_id")).select("event_id", "language")
    return events.join(lead, "event_id", "left").select("event_id", ((F.coalesce("title", F.lit("")) == "") & F.coalesce(F.col("language") != lang, F.lit(False))).alias("untranslated"))


def next_meetings(dates: DataFrame, today: Column) -> DataFrame:
    """Per bank its next meeting from today on, and in how many days."""
    return dates.where(F.col("day") >= today).groupBy("bank").agg(F.min("day").alias("day")).withColumn("days", F.datediff("day", today))


def chart_bounds(points: DataFrame) -> DataFrame:
    """Per series the scale of its chart: least and greatest price, drawn apart where they are one."""
    ends = points.where("observed_at is not null and price is not null").groupBy("symbol").agg(F.min("price").alias("low"), F.max("price").alias("high"))
    flat = F.col("low") == F.col("high")
    return ends.select("symbol", F.when(flat, F.col("low") - 1).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + 1).otherwise(F.col("high")).alias("high"))


def mark_read(alerts: DataFrame, asked: DataFrame, now: Column) -> DataFrame:
    """The inbox after readers mark alerts as read: ``asked``: user_id, alert_id (null for all of theirs). What was read
    already keeps its moment."""
    everything = asked.where("alert_id is null").select("user_id", F.lit(True).alias("_all")).distinct()
    one = asked.where("alert_id is not null").select("user_id", "alert_id", F.lit(True).alias("_one")).distinct()
    joined = alerts.join(everything, "user_id", "left").join(one, ["user_id", "alert_id"], "left")
    return joined.withColumn("read_at", F.coalesce("read_at", F.when(F.coalesce("_all", "_one", F.lit(False)), now))).select(*alerts.columns)
