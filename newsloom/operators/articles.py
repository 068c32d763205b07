"""Articles: gates, dedup, revisions, search, watch items."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import text as T
from newsloom.plans.durable import written
from newsloom.plans.graph import components
from newsloom.plans.joins import latest_per, range_join, top_per

#: Titles are the same story from this similarity on, within so many seconds.
SIMILAR, WINDOW_SECONDS = 0.75, 36 * 3600


def prefilter_reason(articles: DataFrame, rules: DataFrame) -> DataFrame:
    """An enabled rule for the source and slug, or for the slug everywhere. Rules are a curated table; Spark sizes it."""
    own = rules.where("enabled and source_id is not null").select("source_id", "native_category").distinct().withColumn("_own", F.lit(True))
    general = rules.where("enabled and source_id is null").select("native_category").distinct().withColumn("_all", F.lit(True))
    joined = articles.join(own, ["source_id", "native_category"], "left").join(general, "native_category", "left")
    return joined.withColumn("prefilter_reason", F.when(F.coalesce("_own", "_all", F.lit(False)), F.concat(F.lit("slug:"), "native_category")).otherwise(F.lit(""))).drop("_own", "_all")


def canonical(articles: DataFrame, hidden_event_articles: DataFrame) -> DataFrame:
    """Not a duplicate, not hidden, in no hidden event."""
    return articles.where("duplicate_of is null and not hidden").join(hidden_event_articles.select("id").distinct(), "id", "left_anti")


def eligible(articles: DataFrame) -> DataFrame:
    """P02, over canonical rows."""
    return articles.where("quality_flag = '' and prefilter_reason = '' and url_status = 'live'")


def exact_duplicates(articles: DataFrame) -> DataFrame:
    """(id, duplicate_of) for every row whose content hash a smaller id has."""
    first = articles.where("content_hash is not null").groupBy("content_hash").agg(F.min("id").alias("duplicate_of"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return articles.select("id", "content_hash").join(first, "content_hash").where("id > duplicate_of").select("id", "duplicate_of")


def similar_pairs(articles: DataFrame, threshold: float = SIMILAR, radius_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(left_id, right_id, score) of titles within the radius of time, each pair once, the smaller id left. A title
    without a moment is compared with all titles.

    Trigrams are ordered rare first by their counts over all titles; rows meet where they share one of their prefix and a
    bucket of time, and length and position allow the threshold. Only ids, sizes, places and hashes travel so far; the sets
    come to each pair once. A story that many outlets carry within the window is so many pairs, as the result asks for each.
    """
    titled = written(articles.select("id", "published_at", T.trigrams(F.col("title")).alias("g")).where(F.size("g") > 0).withColumn("n", F.size("g")), "titles")
    each = titled.select("id", "published_at", "n", F.explode(F.transform("g", lambda x: F.xxhash64(x))).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("f"))
    placed = each.join(counts, "token").withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("f", "token")))
    posted = written(placed.where(F.col("pos") <= F.col("n") - F.ceil(threshold * F.col("n")) + 1).drop("f"), "posted")
    side = lambda s: posted.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "published_at", "n", "pos")], "token")
    left, right = side("left"), side("right")
    dated = range_join(left.where("left_published_at is not null"), right.where("right_published_at is not null"), "left_published_at", "right_published_at", radius_seconds, ["token"]).where("left_id < right_id")
    # two undated titles meet once; beside a dated one the undated may have the larger id
    undated = left.where("left_published_at is null").join(right, "token").where("left_id < right_id or (right_published_at is not null and left_id > right_id)")
    sized = (F.col("left_n") >= threshold * F.col("right_n")) & (F.col("right_n") >= threshold * F.col("left_n"))
    need = threshold / (1 + threshold) * (F.col("left_n") + F.col("right_n")) - 1e-9
    fits = sized & (F.least(F.col("left_n") - F.col("left_pos"), F.col("right_n") - F.col("right_pos")) + 1 >= need)
    ends = lambda pairs: pairs.where(fits).select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"))
    near = ends(dated).unionByName(ends(undated)).distinct()
    sets = lambda s: titled.select(F.col("id").alias(f"{s}_id"), F.col("g").alias(f"{s}_g"))
    scored = near.join(sets("left"), "left_id").join(sets("right"), "right_id").withColumn("score", T.jaccard(F.col("left_g"), F.col("right_g")))
    return scored.where(F.col("score") >= threshold).select("left_id", "right_id", "score")


def find_duplicates(articles: DataFrame) -> DataFrame:
    """(id, duplicate_of, score): an exact hash first, else the most similar earlier title; ties to the newest, then the largest id (Q1)."""
    exact = exact_duplicates(articles).withColumn("score", F.lit(1.0)).withColumn("_exact", F.lit(1))
    pairs = similar_pairs(articles).select(F.col("right_id").alias("id"), F.col("left_id").alias("duplicate_of"), "score").withColumn("_exact", F.lit(0))
    when = articles.select(F.col("id").alias("duplicate_of"), "published_at")
    every = exact.unionByName(pairs).join(when, "duplicate_of")
    return latest_per(every, ["id"], F.desc("_exact"), F.desc("score"), F.desc("published_at"), F.desc("duplicate_of")).select("id", "duplicate_of", "score")


def elect(articles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, canonical_id) over the components of duplicate pairs. Best is classified, then the lower priority of
    its source, then the longer content, then the smaller id; the forest has depth one."""
    parts = components(pairs, "left_id", "right_id").withColumnRenamed("node", "id")
    ranked = parts.join(articles.select("id", "classified", "priority", F.length("content").alias("n")), "id")
    best = latest_per(ranked, ["component"], F.desc("classified"), F.asc("priority"), F.desc("n"), F.asc("id")).select("component", F.col("id").alias("canonical_id"))
    return parts.join(best, "component").where("id <> canonical_id").select("id", "canonical_id")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """By URL, what a crawl does to the store: created, revised (the content hash turned), revived, gone, or seen.
    ``old``: url, content_hash, url_status; ``new``: url, content_hash, gone (one row for each url)."""
    o, n = old.alias("o"), new.alias("n")
    action = (
        F.when(F.col("o.url").isNull() & ~F.col("n.gone"), "created")
        .when(F.col("n.url").isNull(), "unseen")
        .when(F.col("o.url").isNull(), "ignored")
        .when(F.col("n.gone") & (F.col("o.url_status") == "live"), "gone")
        .when(F.col("n.gone"), "seen")
        .when(F.col("o.content_hash") != F.col("n.content_hash"), "revised")
        .when(F.col("o.url_status") == "gone", "revived")
        .otherwise("seen")
    )
    return o.join(n, F.col("o.url") == F.col("n.url"), "full").select(F.coalesce("o.url", "n.url").alias("url"), action.alias("action"), F.coalesce(F.when(~F.col("n.gone"), F.col("n.content_hash")), F.col("o.content_hash")).alias("content_hash"))


def search(articles: DataFrame, needle: str, summaries: DataFrame | None = None) -> DataFrame:
    """A case-insensitive substring of title, lead or a summary's title; each article once."""
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))
    own = has(F.col("title")) | has(F.col("lead"))
    if summaries is None:
        return articles.where(own)
    found = summaries.where(has(F.col("title"))).select(F.col("article_id").alias("id")).distinct().withColumn("_s", F.lit(True))
    return articles.join(found, "id", "left").where(own | F.col("_s")).drop("_s")


#: Fixed value: what a word may end with beyond an alias.
ENDINGS = "(?:s|es|ها|های|ی|ای)?"


def shortlist(texts: DataFrame, items: list[tuple[str, list[str]]], text: Column, most: int = 8) -> DataFrame:
    """(id, slug, hits): the watch items that a text names, by key (``text.title_key``) on both sides: an alias between
    non-word characters, an ending allowed, the longest alias first; the first item to claim a key has it; the ``most`` with most
    hits, ties to the one met first. Items are a curated list, bounded by its file."""
    spark = texts.sparkSession
    named = [(k, slug, alias) for k, (slug, alias) in enumerate((s, a) for s, aliases in items for a in aliases)]
    claimed: dict[str, str] = {}
    for r in spark.createDataFrame(named, "k int, slug string, alias string").select("k", "slug", T.title_key(F.col("alias")).alias("key")).orderBy("k").collect():
        if r.key:
            claimed.setdefault(r.key, r.slug)
    if not claimed:
        return texts.select("id", F.lit("").alias("slug"), F.lit(0).cast("long").alias("hits")).limit(0)
    pattern = "(?U)(?<!\\w)(" + "|".join(re.escape(a) for a in sorted(claimed, key=lambda a: (-len(a), a))) + f"){ENDINGS}(?!\\w)"
    names = F.create_map(*[F.lit(x) for pair in claimed.items() for x in pair])
    found = texts.select("id", F.posexplode(F.regexp_extract_all(T.title_key(text), F.lit(pattern), F.lit(1))).alias("place", "a"))
    hits = found.groupBy("id", names[F.col("a")].alias("slug")).agg(F.count("*").alias("hits"), F.min("place").alias("place"))
    return top_per(hits, ["id"], most, F.desc("hits"), F.asc("place")).select("id", "slug", "hits")
