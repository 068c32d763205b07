"""Predicates, lists and pages: which rows a reader, a worker or a crawler gets, and in what order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom import vocab
from newsloom.functions import score as X
from newsloom.functions import text as T
from newsloom.functions import time as D
from newsloom.operators.articles import search
from newsloom.plans.joins import latest_per, top_per


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def in_window(rows: DataFrame, n: int, now: Column, at: str = "fetched_at") -> DataFrame:
    """Fetched within the last ``n`` days, one at least."""
    return rows.where(F.col(at) >= now - days(max(1, n)))


class ArticleFilter:
    """The article filters, each given by name; what is not given filters nothing.

    ``articles``: id, source_id, outlet, title, lead, native_category, extraction_tier, published_at, created_at.
    ``classifications`` and ``evaluations`` are all answers: those of category and notify look at the latest of an article.
    Filters on answers are semi- and anti-joins, the others conditions that reach the scan.
    """

    def __init__(self, classifications: DataFrame, evaluations: DataFrame, summaries: DataFrame | None = None):
        self.classifications, self.evaluations, self.summaries = classifications, evaluations, summaries

    def __call__(self, articles: DataFrame, **wanted) -> DataFrame:
        for name, value in wanted.items():
            if value is not None:
                articles = getattr(self, f"by_{name}")(articles, value)
        return articles

    def _has(self, articles: DataFrame, answers: DataFrame, wanted: bool) -> DataFrame:
        return articles.join(answers.select(F.col("article_id").alias("id")), "id", "left_semi" if wanted else "left_anti")

    def _latest(self, answers: DataFrame) -> DataFrame:
        return latest_per(answers, ["article_id"], F.desc("created_at"), F.desc("id"))

    def by_stored_day(self, a: DataFrame, day: str) -> DataFrame:
        start = F.lit(f"{day} 00:00:00").cast("timestamp_ntz") - D.minutes(D.OFFSET_MINUTES)
        return a.where((F.col("created_at") >= start) & (F.col("created_at") < start + days(1)))

    def by_classified(self, a: DataFrame, wanted: bool) -> DataFrame:
        return self._has(a, self.classifications, wanted)

    def by_evaluated(self, a: DataFrame, wanted: bool) -> DataFrame:
        return self._has(a, self.evaluations, wanted)

    def by_source(self, a: DataFrame, name: str) -> DataFrame:
        return a.where(F.col("source_id") == name)

    def by_outlet(self, a: DataFrame, part: str) -> DataFrame:
        return a.where(F.contains(F.lower("outlet"), F.lit(part.lower())))

    def by_jalali_day(self, a: DataFrame, day: str) -> DataFrame:
        return a.where(D.jalali(D.local_day(F.col("published_at"))) == day)

    def by_since(self, a: DataFrame, moment: str) -> DataFrame:
        return a.where(F.col("published_at") >= F.lit(moment).cast("timestamp_ntz"))

    def by_until(self, a: DataFrame, moment: str) -> DataFrame:
        return a.where(F.col("published_at") <= F.lit(moment).cast("timestamp_ntz"))

    def by_tier(self, a: DataFrame, tier: str) -> DataFrame:
        return a.where(F.col("extraction_tier") == tier)

    def by_native_category(self, a: DataFrame, slug: str) -> DataFrame:
        return a.where(F.col("native_category") == slug)

    def by_category(self, a: DataFrame, category: str) -> DataFrame:
        return self._has(a, self._latest(self.classifications).where(F.col("category") == category), True)

    def by_notify(self, a: DataFrame, status: str) -> DataFrame:
        return self._has(a, self._latest(self.evaluations).where(X.decide(F.col("axis1"), F.col("axis2"), F.col("axis3")) == status), True)

    def by_q(self, a: DataFrame, needle: str) -> DataFrame:
        return search(a, needle, self.summaries)

    def by_unanalysed(self, a: DataFrame, wanted: bool) -> DataFrame:
        return self._has(a, self.classifications, False) if wanted else a


def model_for_node(node: Column, model: Column, classify_model: Column, advanced_model: Column) -> Column:
    """A node's model: a variant may name one for classifying and one for evaluating and summarising."""
    named = F.when(node == "classify", classify_model).when(node.isin("evaluate", "summarize"), advanced_model)
    return F.coalesce(F.nullif(named, F.lit("")), model)


def for_variant(answers: DataFrame, variants: DataFrame, node: str) -> DataFrame:
    """Answers that a variant gave under the identity it has now: provider, the node's model and prompt version.
    ``variants``: variant, provider, model, classify_model, advanced_model, prompt_version."""
    now = variants.select("variant", "provider", model_for_node(F.lit(node), F.col("model"), F.col("classify_model"), F.col("advanced_model")).alias("model"), "prompt_version")
    return answers.join(now, ["variant", "provider", "model", "prompt_version"], "left_semi")


def pending_events(events: DataFrame, articles: DataFrame, assessments: DataFrame, most: int = 200) -> DataFrame:
    """Events without an assessment whose primary article passed both gates, newest first."""
    fine = articles.where("prefilter_reason = '' and quality_flag = ''").select(F.col("id").alias("primary_article_id"))
    open_ = events.where("category <> 'other'").join(assessments.select(F.col("event_id").alias("id")), "id", "left_anti")
    return open_.join(fine, "primary_article_id", "left_semi").orderBy(F.desc("event_time"), F.desc("id")).limit(most)


def licensed(articles: DataFrame, staff: bool = False) -> DataFrame:
    """P10: of sources that may only be linked to, readers get neither lead nor content. ``articles`` hold license_mode."""
    closed = (F.col("license_mode") == "facts_link_out") & ~F.lit(staff)
    return articles.withColumns({c: F.when(closed, F.lit("")).otherwise(F.col(c)) for c in ("lead", "content")})


def recent_urls(articles: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """Live articles stored within a week, those first whose check is longest ago; never checked before all."""
    return articles.where((F.col("url_status") == "live") & (F.col("created_at") >= now - days(7))).orderBy(F.asc_nulls_first("last_checked_at"), "id").limit(most)


def stale_urls(articles: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """Live articles that no listing has shown for a week, oldest first."""
    return articles.where((F.col("url_status") == "live") & (F.col("fetched_at") < now - days(7))).orderBy("fetched_at", "id").limit(most)


def due_retries(retries: DataFrame, sources: DataFrame, now: Column, most: int = 50) -> DataFrame:
    """Fetches whose next try is due, of sources that are on, longest due first."""
    on = sources.where("enabled").select("source_id")
    return retries.where(~F.col("gave_up") & (F.col("next_at") <= now)).join(on, "source_id", "left_semi").orderBy("next_at", "id").limit(most)


def kept_retries(retries: DataFrame, now: Column, keep_days: int = 30) -> DataFrame:
    """The queue without what was given up a month ago."""
    return retries.where(~F.col("gave_up") | (F.col("updated_at") >= now - days(keep_days)))


def retried(retries: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The queue after a pass. ``outcomes``: id, error ('' where the page was stored). What was stored leaves; what
    failed waits longer each time, by its own count, or is given up and keeps its time. A pass is a batch of ``foreachBatch`` as well."""
    joined = retries.join(outcomes, "id", "left").where("error is null or error <> ''")
    failed = F.col("error").isNotNull()
    attempts = F.col("attempts") + failed.cast("int")
    cause = F.when(failed, X.error_class(F.col("error"))).otherwise(F.col("error_class"))
    lost = failed & X.gives_up(attempts, cause)
    again = now + F.make_dt_interval(secs=(60 * X.retry_minutes(attempts)).cast("decimal(18,6)"))
    out = joined.withColumns({"attempts": attempts, "error_class": cause, "gave_up": F.col("gave_up") | lost, "next_at": F.when(failed & ~lost, again).otherwise(F.col("next_at"))})
    return out.select(*retries.columns)


def gap_backfills(intervals: DataFrame, archived: DataFrame, most_days: int = 3) -> DataFrame:
    """A backfill for each gap or silence that a covered interval ends, from its start, three days back at most, of sources
    that have an archive. (source_id, closed_at, since)."""
    order = Window.partitionBy("source_id").orderBy("ended_at", "started_at")
    seen = intervals.withColumns({"_was": F.lag("state").over(order), "_from": F.lag("started_at").over(order)})
    closing = seen.where("state = 'covered' and _was <> 'covered'").join(archived.select("source_id").distinct(), "source_id", "left_semi")
    # the interval that closes a gap begins where the gap ended
    return closing.select("source_id", F.col("started_at").alias("closed_at"), F.to_date(F.greatest(F.col("_from"), F.col("started_at") - days(most_days))).alias("since"))


def backfilled(pages: DataFrame, since: Column, known: DataFrame, most: int = 200) -> DataFrame:
    """Of a source's archived pages those since a day that are not stored, newest first, so many for each source."""
    new = pages.where(F.to_date("published_at") >= since).join(known.select("url"), "url", "left_anti")
    return top_per(new, ["source_id"], most, F.desc("published_at"), F.asc("url"))


def page(articles: DataFrame, number: int, size: int = 30, stored: bool = False) -> DataFrame:
    """A page of the article list, newest first by publication, or by when they were stored."""
    order = [F.desc("created_at"), F.desc("id")] if stored else [F.desc_nulls_last("published_at"), F.desc("id")]
    return articles.orderBy(*order).offset(size * (number - 1)).limit(size)


def misses(slo: DataFrame, most: int = 10) -> DataFrame:
    """The sources that missed most, worst first."""
    return slo.where("failed > 0").orderBy(F.desc("failed"), F.asc("passed"), F.asc("source_id")).limit(most)


def inbox(alerts: DataFrame, visible: DataFrame, most: int = 100) -> DataFrame:
    """Each reader's newest alerts on events that can be seen."""
    seen = alerts.join(visible.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return top_per(seen, ["user_id"], most, F.desc("created_at"), F.desc("id"))


def sources_in_order(reports: DataFrame) -> DataFrame:
    """An event's reports as a list ordered by when each was made. An event has few; they are gathered by event."""
    return reports.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("reported_at", "report_id", "source_id"))).alias("sources"))


def history(revisions: DataFrame, most: int = 20) -> DataFrame:
    """The newest revisions of each event's articles."""
    return top_per(revisions, ["event_id"], most, F.desc("observed_at"), F.desc("revision_id"))


def members(links: DataFrame, events: DataFrame, most: int = 20) -> DataFrame:
    """A storyline's events that can be seen, in order of time, the first twenty."""
    return top_per(links.join(events.where("not hidden and status <> 'withdrawn'").select(F.col("id").alias("event_id"), "event_time"), "event_id"), ["storyline_id"], most, F.asc("event_time"), F.asc("event_id"))


def note_gone(articles: DataFrame, gone: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(articles, revisions): pages found gone (url, http_status) turn the status of articles that were not gone yet and
    leave a revision of each; doing it again changes nothing."""
    first = gone.groupBy("url").agg(F.min("http_status").alias("_status"))
    joined = articles.join(first, "url", "left")
    turns = F.col("_status").isNotNull() & (F.col("url_status") != "gone")
    revisions = joined.where(turns).select("id", "title", "lead", "content", F.col("url_status").alias("status"), now.alias("observed_at"))
    after = joined.withColumns({"gone_http_status": F.when(turns, F.col("_status")).otherwise(F.col("gone_http_status")), "gone_at": F.when(turns, now).otherwise(F.col("gone_at"))})
    return after.withColumn("url_status", F.when(turns, "gone").otherwise(F.col("url_status"))).select(*articles.columns), revisions


def takedowns(state: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hidden, audit) after requests to hide or show: ``state``: kind, id, hidden; ``log``: kind, id, seq, hide, reason.
    A request without a reason counts nowhere, one that changes nothing leaves no entry; the last one stands."""
    valid = log.where(F.trim(F.coalesce("reason", F.lit(""))) != "").join(state.withColumnRenamed("hidden", "_hidden"), ["kind", "id"])
    before = F.coalesce(F.lag("hide").over(Window.partitionBy("kind", "id").orderBy("seq")), F.col("_hidden"))
    audit = valid.withColumn("_before", before).where("hide <> _before").select("kind", "id", "seq", F.when(F.col("hide"), "hide").otherwise("unhide").alias("action"), F.substring(F.trim("reason"), 1, 255).alias("reason"))
    last = latest_per(valid, ["kind", "id"], F.desc("seq")).select("kind", "id", "hide")
    return state.join(last, ["kind", "id"], "left").select("kind", "id", F.coalesce("hide", "hidden").alias("hidden")), audit


def renamed(storylines: DataFrame, proposed: DataFrame, now: Column, frozen_after: int = 5) -> DataFrame:
    """Storylines (storyline_id, name, n_events, previous) after names are proposed: one with more events than
    ``frozen_after`` keeps the name it has, a name that changes goes to the end of the previous ones."""
    joined = storylines.join(proposed.withColumnRenamed("name", "_name"), "storyline_id", "left")
    has = F.coalesce("name", F.lit("")) != ""
    turns = F.coalesce(F.nullif("_name", F.lit("")), F.col("name")).isNotNull() & ~((F.col("n_events") > frozen_after) & has) & ~F.coalesce("_name", "name").eqNullSafe(F.col("name"))
    old = F.struct(F.col("name"), now.alias("replaced_at"), F.col("n_events").alias("events"))
    out = joined.withColumns({"previous": F.when(turns & has, F.array_append("previous", old)).otherwise(F.col("previous"))})
    return out.withColumn("name", F.when(turns, F.col("_name")).otherwise(F.col("name"))).select(*storylines.columns)


def review_statistics(reviews: DataFrame, assessments: DataFrame, events: DataFrame) -> DataFrame:
    """Agreement of finished reviews with what the model said when they were made, overall (category null) and by the
    model's category in today's vocabulary; an item agrees in category and both bands. Reviews that are not finished or lack a
    score don't count. The model said what the assessment of the largest id by then says, the event's own fields where there was
    none. ``reviews``: event_id, reviewed_at, status, category, iran_score, global_score; ``assessments``: event_id, id,
    created_at and the same three; ``events``: event_id and the same three."""
    fields = ("category", "iran_score", "global_score")
    done = reviews.where("status = 'reviewed' and reviewed_at is not null and iran_score is not null and global_score is not null")
    said = assessments.select(F.col("event_id").alias("_of"), "id", "created_at", *[F.col(c).alias(f"m_{c}") for c in fields])
    joined = done.join(said, (F.col("event_id") == F.col("_of")) & (F.col("created_at") <= F.col("reviewed_at")), "left")
    stood = latest_per(joined, ["event_id", "reviewed_at"], F.desc_nulls_last("id")).join(events.select("event_id", *[F.col(c).alias(f"e_{c}") for c in fields]), "event_id", "left")
    model = {c: F.when(F.col("id").isNull(), F.col(f"e_{c}")).otherwise(F.col(f"m_{c}")) for c in fields}
    category = X.event_topic(model["category"])
    bands = reduce_and(*[F.coalesce(X.band(F.col(c)) == X.band(model[c]), F.lit(False)) for c in fields[1:]])
    marked = stood.select(F.coalesce(F.nullif(category, F.lit("")), F.lit("unassessed")).alias("shown"), (category == X.event_topic(F.col("category"))).alias("c"), bands.alias("b"))
    n = lambda cond, name: F.round(F.count_if(cond) / F.count("*"), 3).alias(name)
    out = marked.groupingSets([[], [F.col("shown")]], F.col("shown")).agg(F.count("*").alias("reviewed"), n(F.col("c") & F.col("b"), "agreement_rate"), n(F.col("c"), "category_match_rate"), n(F.col("b"), "tier_match_rate"))
    return out.withColumnRenamed("shown", "category")


def reduce_and(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def per_category(articles: DataFrame, classifications: DataFrame, limit: int) -> DataFrame:
    """An even slice: of each category of the latest answers, the newest articles."""
    last = latest_per(classifications, ["article_id"], F.desc("created_at"), F.desc("id")).where(F.col("category").isin(*vocab.CATEGORIES)).select(F.col("article_id").alias("id"), "category")
    return top_per(articles.join(last, "id"), ["category"], max(1, limit // len(vocab.CATEGORIES)), F.desc("published_at"), F.desc("id"))


def period_start(period: Column, now: Column) -> Column:
    """Where a reader's period begins: 24 hours back, the local midnight, a week or 30 days back; null for no period."""
    midnight = F.date_trunc("day", D.local(now)).cast("timestamp_ntz") - D.minutes(D.OFFSET_MINUTES)
    return F.when(period == "now", now - days(1)).when(period == "today", midnight).when(period == "week", now - days(7)).when(period == "latest", now - days(30))


def source_health(sources: DataFrame) -> DataFrame:
    """What readers see of the sources that are on, by priority."""
    return sources.where("enabled").orderBy("priority", "source_id").select("source_id", "health", "last_success_at")


def asset_catalogue(own: DataFrame, shared: DataFrame | None) -> DataFrame:
    """The own assets, and the shared ones where that service is there; an own key wins."""
    first = own.withColumn("shared", F.lit(False))
    return first if shared is None else first.unionByName(shared.join(own.select("key"), "key", "left_anti").withColumn("shared", F.lit(True)))


def external_series(series: DataFrame | None, spark, schema: str, caveat: str = "prices are not available") -> tuple[DataFrame, str]:
    """An external price table and what to say of it: without the service an empty one and a caveat."""
    return (spark.createDataFrame([], schema), caveat) if series is None else (series, "")


#: The series of the market feed that are tracked, by our symbol.
FEED_KEYS = {"gold_18k": "geram18", "gold_ounce": "ons", "coin_emami": "sekee", "usd_irr": "price_dollar_rl", "eur_irr": "price_eur"}


def market_feed(payloads: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """(symbol, price, observed_at) of the tracked series in a feed's JSON (column ``payload``): texts to decimals,
    local times to UTC; entries that cannot be read are left out."""
    keys = keys or FEED_KEYS
    parsed = payloads.select(F.from_json("payload", "struct<current: map<string, struct<p: string, ts: string>>>").alias("j"))
    each = parsed.select(F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), F.col("j.current")[k].alias("e")) for s, k in keys.items()])).alias("x")).select("x.symbol", "x.e.p", "x.e.ts")
    moment = F.try_to_timestamp(F.trim("ts"), F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz") - D.minutes(D.OFFSET_MINUTES)
    return each.select("symbol", X.price(F.col("p")).alias("price"), moment.alias("observed_at")).where("price is not null and observed_at is not null")


def dimension(stored: DataFrame, wanted: DataFrame, key: str, values: list[str]) -> DataFrame:
    """A curated table after its file was read again: every wanted row as it is now and enabled, what the file no longer
    has disabled. A file that names a key twice, or none, is refused."""
    bad = wanted.groupBy(key).count().where(f"{key} is null or {key} = '' or count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"keys given twice or not at all: {[r[0] for r in bad]}")
    s, w = stored.alias("s"), wanted.alias("w")
    return s.join(w, F.col(f"s.{key}") == F.col(f"w.{key}"), "full").select(F.coalesce(f"w.{key}", f"s.{key}").alias(key), *[F.when(F.col(f"w.{key}").isNotNull(), F.col(f"w.{v}")).otherwise(F.col(f"s.{v}")).alias(v) for v in values], F.col(f"w.{key}").isNotNull().alias("enabled"))


def insert_or_ignore(stored: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The rows of ``new`` to append: of each key the first, where the store has none."""
    return latest_per(new, keys, *order).join(stored.select(*keys), keys, "left_anti")


def insert_or_update(stored: DataFrame, new: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The store after ``new``: of each key its last new row, else the stored one."""
    last = latest_per(new, keys, *order)
    return stored.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*stored.columns))


def answers(raw: DataFrame, questions: list[tuple[str, str, list[str]]], optional: tuple[str, ...] = (), most_tags: int = 5) -> DataFrame:
    """A fallback model's answers in the usual shape, each with whether it stands. ``raw``: id, name, choice, score,
    choices (null where not given), confidence; ``questions``: (name, kind, criteria), a list fixed in code. A choice must be among the criteria, a
    score a place in them; of tags the known ones stay, the first five; confidence is brought into 0..1."""
    typed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), F.array(*map(F.lit, criteria)).alias("criteria")) for name, kind, criteria in questions])
    asked = raw.select("id").distinct().select("id", F.explode(typed).alias("q")).select("id", "q.*").join(raw, ["id", "name"], "left")
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.0))))
    given = F.coalesce("choice", F.col("score").cast("string"), F.array_join("choices", ",")).isNotNull()
    choice = F.when(F.array_contains("criteria", F.col("choice")), F.col("choice"))
    place = F.when((F.col("score") >= 0) & (F.col("score") < F.size("criteria")), F.col("score"))
    tags = F.slice(F.filter("choices", lambda x: F.array_contains("criteria", x)), 1, most_tags)
    multi, kind = F.col("kind") == "multi", F.col("kind")
    fine = F.when(multi, ~given | F.col("choices").isNotNull()).when(kind == "choice", choice.isNotNull()).otherwise(place.isNotNull())
    left_out = F.col("name").isin(*optional) & choice.isNull() if optional else F.lit(False)
    out = asked.where(~left_out)
    return out.select("id", "name", "kind", F.when(kind == "choice", choice).alias("choice"), F.when(kind == "score", place).alias("score"), F.when(multi, F.coalesce(tags, F.array().cast("array<string>"))).alias("choices"), F.when(multi & ~given, F.lit(0.0)).otherwise(sure).alias("confidence"), F.coalesce(fine, F.lit(False)).alias("stands"))


def linked_assets(events: DataFrame, classes: list[tuple[str, str]]) -> DataFrame:
    """An event's assets by the score of their class, best first; all of them, by key, where the event is not assessed.
    ``events``: event_id, asset_scores map<string,int>; ``classes``: (key, class), the fixed catalogue."""
    catalogue = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(c).alias("class")) for k, c in classes])
    score = F.when(F.col("asset_scores").isNull(), F.lit(0)).otherwise(F.try_element_at("asset_scores", F.col("class")))
    pairs = events.select("event_id", "asset_scores", F.explode(catalogue).alias("a")).select("event_id", "asset_scores", "a.*").withColumn("score", score).where("score is not null")
    return pairs.select("event_id", "key", F.coalesce("score", F.lit(0)).alias("score"), F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("score"), F.asc("key"))).alias("place"))


def ingested(store: DataFrame, crawl: DataFrame, now: Column) -> DataFrame:
    """What a crawl does to the store, in one plan: both gates, the content's hash, the action of L06 and, for what is
    created, the smallest stored article of the same content. ``store``: id, url, content_hash, url_status; ``crawl``: url,
    title, lead, content, published_at, native_category, blocked (of the prefilter), gone; one row for each url."""
    flag = X.quality_flag(F.col("title"), F.col("lead"), F.col("content"), F.col("url"), F.col("published_at"), now)
    new = crawl.select("url", "gone", T.content_hash(F.col("title"), F.col("lead"), F.col("content")).alias("_hash"), flag.alias("quality_flag"), F.when(F.col("blocked"), F.concat(F.lit("slug:"), "native_category")).otherwise("").alias("prefilter_reason"))
    first = store.groupBy("content_hash").agg(F.min("id").alias("duplicate_of"))
    joined = new.join(store.select("url", "id", "content_hash", "url_status"), "url", "left").join(first.withColumnRenamed("content_hash", "_hash"), "_hash", "left")
    known = F.col("id").isNotNull()
    action = (
        F.when(~known & F.col("gone"), "ignored")
        .when(~known, "created")
        .when(F.col("gone"), F.when(F.col("url_status") == "live", "gone").otherwise("seen"))
        .when(F.col("content_hash") != F.col("_hash"), "revised")
        .when(F.col("url_status") == "gone", "revived")
        .otherwise("seen")
    )
    queued = (action.isin("created", "revised")) & (F.col("quality_flag") == "") & (F.col("prefilter_reason") == "") & (known | F.col("duplicate_of").isNull())
    return joined.select("url", action.alias("action"), F.col("_hash").alias("content_hash"), "quality_flag", "prefilter_reason", F.when(~known, F.col("duplicate_of")).alias("duplicate_of"), queued.alias("queued"))
