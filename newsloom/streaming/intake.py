"""Intake in micro-batches: attempts appended once, articles and what follows from them, cut-offs kept up to date.

Sinks of one batch are folders named by its number, written whole: a batch that
is done again, after a failure or on purpose, writes the same rows into the same
folders. What a batch reads of the store is what batches before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from newsloom import vocab
from newsloom.functions import score as X
from newsloom.operators import articles as A
from newsloom.operators import events as E
from newsloom.operators import lists as L
from newsloom.plans.durable import scratch, written
from newsloom.plans.joins import latest_per
from newsloom.plans.store import exists, replace_changed

# --- R01


def attempts(results: DataFrame) -> DataFrame:
    """An attempt for each crawl result: partial where an article failed, else success or, with nothing fetched, empty; failed
    where the crawl itself ended in an error. ``results``: source_id, started_at, fetched, new, failed, error."""
    status = F.when(F.col("error") != "", "failed").when(F.col("failed") > 0, "partial").when(F.col("fetched") > 0, "success").otherwise("empty")
    cause = F.when(F.col("error") != "", X.error_class(F.col("error"))).when(F.col("fetched") == 0, "parse").otherwise("")
    return results.select("source_id", "started_at", status.alias("status"), cause.alias("error_class"), "fetched", "new", (F.col("fetched") - F.col("new") - F.col("failed")).alias("repeated"), "failed")


def append_available(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what has come since the last run, each row once, and ends. The file sink's log makes a batch's files count only
    when it is whole, and the checkpoint knows which input is in it."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


# --- stores by batch


@dataclass(frozen=True)
class Sinks:
    """Tables under one folder, each in folders by batch."""

    root: str

    def put(self, rows: DataFrame, name: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def before(self, spark: SparkSession, name: str, schema: str, batch: int) -> DataFrame:
        """A table as the batches before left it, with the column batch."""
        kind = StructType.fromDDL(f"{schema}, batch int")
        if not exists(spark, f"{self.root}/{name}"):
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).parquet(f"{self.root}/{name}").where(F.col("batch") < batch)

    def all(self, spark: SparkSession, name: str, schema: str) -> DataFrame:
        return self.before(spark, name, schema, 1 << 30)


def each_batch(stream: DataFrame, do: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """``do(rows, batch)`` for what is available; a batch that did not end is done again under its number."""
    return stream.writeStream.foreachBatch(do).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- C01, C04

ARTICLE = "id long, url string, source_id string, title string, lead string, published_at timestamp_ntz, content_hash string, url_status string, quality_flag string, prefilter_reason string, duplicate_of long"
REVISION = "id long, url string, title string, lead string, content_hash string, url_status string"
DUPLICATE = "id long, duplicate_of long, score double"
LINK = "event_id long, article_id long"
ASSESSMENT = "event_id long, article_id long, category string, iran_score int, global_score int, confidence double"
TAG = "event_id long, slug string"
SAMPLE = "event_id long, stratum string"
#: One assessed event in so many is sampled for review, beside those of little confidence.
SAMPLED, UNSURE = 20, 0.5


def intake(sinks: Sinks, answers: DataFrame, items: list[tuple[str, list[str]]], rules: DataFrame, now: datetime) -> Callable[[DataFrame, int], None]:
    """What ``each_batch`` does with crawled rows (seq, source_id, url, title, lead, content, published_at,
    native_category, gone): upsert by URL with revisions, both gates, duplicates by content and by similar titles, events and
    their links, and for those that pass, the model's answer with its tags and review samples.

    seq is unique and names an article that its row creates. ``answers`` stand for the model: url, category, iran, global (0 to 4),
    confidence, tags. Sinks: articles (a version for each change), revisions, duplicates, links, assessments, tags, samples."""

    def take(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        with scratch(spark, "intake") as folder:
            crawl = written(A.prefilter_reason(latest_per(rows, ["url"], F.desc("seq")), rules), "crawl", folder)
            versions = sinks.before(spark, "articles", ARTICLE, batch)
            store = written(latest_per(versions, ["id"], F.desc("batch")).drop("batch"), "store", folder)
            moment = F.lit(now).cast("timestamp_ntz")
            done = L.ingested(store, crawl.withColumn("blocked", F.col("prefilter_reason") != ""), moment).select("url", "action", "content_hash", "quality_flag", F.col("duplicate_of").alias("same"))
            judged = written(crawl.join(done, "url"), "judged", folder)

            old = store.select("url", *[F.col(c).alias(f"old_{c}") for c in ("id", "title", "lead", "content_hash", "url_status", "duplicate_of", "prefilter_reason", "source_id", "published_at", "quality_flag")])
            changed = written(judged.where("action in ('created', 'revised', 'revived', 'gone')").join(old, "url", "left").withColumn("id", F.coalesce("old_id", "seq")), "changed", folder)
            sinks.put(changed.where("action in ('revised', 'gone')").select("id", "url", F.col("old_title").alias("title"), F.col("old_lead").alias("lead"), F.col("old_content_hash").alias("content_hash"), F.col("old_url_status").alias("url_status")), "revisions", batch)

            # duplicates of what is new, among the store around it and the batch itself
            created = changed.where("action = 'created'")
            titled = created.select("id", "title", "published_at", "content_hash")
            ends = titled.agg(F.min("published_at").alias("lo"), F.max("published_at").alias("hi")).first()
            reach = timedelta(seconds=A.WINDOW_SECONDS)
            around = F.col("published_at").isNull() if ends.lo is None else F.col("published_at").isNull() | F.col("published_at").between(F.lit(ends.lo - reach), F.lit(ends.hi + reach))
            if titled.where("published_at is null").limit(1).count():
                around = F.lit(True)  # an undated title is compared with all
            beside = store.where(around).select("id", "title", "published_at", "content_hash").unionByName(titled)
            similar = A.find_duplicates(beside).join(created.select("id"), "id", "left_semi")
            exact = created.where("same is not null").select("id", F.col("same").alias("duplicate_of"), F.lit(1.0).alias("score"), F.lit(1).alias("by"))
            copies = latest_per(exact.unionByName(similar.withColumn("by", F.lit(0))), ["id"], F.desc("by")).select("id", "duplicate_of", "score")
            copies = written(_rooted(copies, store), "copies", folder)
            sinks.put(copies, "duplicates", batch)

            kept = lambda c: F.coalesce(F.when(F.col("action") == "gone", F.col(f"old_{c}")), F.col(c)).alias(c)
            status = F.when(F.col("action") == "gone", "gone").otherwise("live").alias("url_status")
            versions_now = changed.join(copies.select("id", F.col("duplicate_of").alias("new_copy")), "id", "left").select(
                "id", "url", F.coalesce("old_source_id", "source_id").alias("source_id"), kept("title"), kept("lead"), F.coalesce("old_published_at", "published_at").alias("published_at"), kept("content_hash"), status, kept("quality_flag"),
                F.coalesce("old_prefilter_reason", "prefilter_reason").alias("prefilter_reason"), F.coalesce("old_duplicate_of", "new_copy").alias("duplicate_of"),
            )
            articles = written(versions_now, "articles", folder)
            sinks.put(articles, "articles", batch)

            # an event is named by its first article; a copy goes where its canonical article is
            known = sinks.before(spark, "links", LINK, batch).select("event_id", F.col("article_id").alias("canonical"))
            fresh = articles.join(created.select("id"), "id", "left_semi").withColumn("canonical", F.coalesce("duplicate_of", "id"))
            links = fresh.join(known, "canonical", "left").select(F.coalesce("event_id", "canonical").alias("event_id"), F.col("id").alias("article_id"))
            links = written(links, "links", folder)
            sinks.put(links, "links", batch)

            # what passes both gates and is no copy is assessed: new articles and corrections
            passed = articles.where("quality_flag = '' and prefilter_reason = '' and duplicate_of is null and url_status = 'live'").join(judged.where("action in ('created', 'revised')").select("url", "content"), "url")
            of = links.unionByName(known.withColumnRenamed("canonical", "article_id")).dropDuplicates(["article_id"])
            known_topics = F.col("category").isin(*vocab.EVENT_CATEGORIES)
            asked = passed.select("id", "url", "title", "lead", "content").join(answers, "url").join(of.withColumnRenamed("article_id", "id"), "id")
            said = asked.withColumns({"iran_score": X.stored_score(F.col("iran")), "global_score": X.stored_score(F.col("global"))}).where(known_topics & F.col("iran_score").isNotNull() & F.col("global_score").isNotNull() & F.col("confidence").between(0, 1))
            said = written(said, "said", folder)
            sinks.put(said.select("event_id", F.col("id").alias("article_id"), "category", "iran_score", "global_score", "confidence"), "assessments", batch)
            text = F.concat_ws("\n", "title", "lead", "content")
            short = A.shortlist(said.withColumn("evidence", text), items, F.col("evidence"))
            wanted = said.select("id", "event_id", F.explode(F.slice(F.array_distinct("tags"), 1, 5)).alias("slug"))
            sinks.put(wanted.join(short.select("id", "slug"), ["id", "slug"], "left_semi").select("event_id", "slug").distinct(), "tags", batch)
            stratum = F.when(F.col("confidence") < UNSURE, "unsure").when(F.crc32("url") % SAMPLED == 0, "sample")
            sinks.put(said.select("event_id", stratum.alias("stratum")).where("stratum is not null").distinct(), "samples", batch)

    return take


def _rooted(copies: DataFrame, store: DataFrame) -> DataFrame:
    """Copies of what is itself a copy, in the store or in the batch, as copies of its canonical article: the smallest id that
    is reached is canonical, and chains within a batch are as short as its rows of one story allow."""
    held = store.select(F.col("id").alias("duplicate_of"), F.col("duplicate_of").alias("of_stored"))
    now = copies.join(held, "duplicate_of", "left").select("id", F.coalesce("of_stored", "duplicate_of").alias("duplicate_of"), "score")
    while True:
        up = now.select(F.col("id").alias("duplicate_of"), F.col("duplicate_of").alias("further"))
        moved = written(now.join(up, "duplicate_of", "left").select("id", F.coalesce("further", "duplicate_of").alias("duplicate_of"), "score", F.col("further").isNotNull().alias("moved")), "rooted")
        now = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return now


# --- R13

HISTOGRAM = "day date, axis string, score double, n long"


def cutoffs_upkeep(sinks: Sinks, days: int = E.WINDOW_DAYS, min_sample: int = E.MIN_SAMPLE) -> Callable[[DataFrame, int], None]:
    """What ``each_batch`` does with scored events (event_time, iran_score, global_score, category): their daily histograms are
    kept, and of the days whose window they touch the cut-offs are made anew from all histograms, by day under cutoffs/."""

    def take(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        with scratch(spark, "cutoffs") as folder:
            new = written(E.daily_histograms(rows), "new", folder)
            sinks.put(new, "histograms", batch)
            touched = new.select("day").distinct().select(F.explode(F.sequence("day", F.date_add("day", days - 1))).alias("day")).distinct()
            around = touched.select(F.explode(F.sequence(F.date_sub("day", days - 1), F.col("day"))).alias("day")).distinct()
            held = sinks.before(spark, "histograms", HISTOGRAM, batch).drop("batch").unionByName(new)
            summed = held.join(around, "day", "left_semi").groupBy("day", "axis", "score").agg(F.sum("n").alias("n"))
            again = E.rolling_cutoffs(summed, days, min_sample=min_sample).join(touched, "day", "left_semi")
            replace_changed(written(again, "cutoffs", folder), f"{sinks.root}/cutoffs", "day")

    return take
