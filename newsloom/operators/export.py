"""Exports: a numbered row for each event and local day, text feeds, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import score as X
from newsloom.functions import time as D
from newsloom.plans.joins import latest_per
from newsloom.plans.store import replace_changed


def safe_cell(text: Column) -> Column:
    """What a spreadsheet would take for a formula is marked as text."""
    return F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def hyperlink(url: Column) -> Column:
    return F.when(url.rlike("^https?://"), url)


def notify_formula(row: Column, columns: tuple[str, str, str] = ("E", "F", "G")) -> Column:
    """The vote as a spreadsheet's formula over the row's three scores: the same thresholds as ``decide``."""
    cells = f"{columns[0]}{{0}}:{columns[-1]}{{0}}"
    text = f'=IF(COUNT({cells})<2,"insufficient",IF(MIN({cells})<2,"no",IF(COUNTIF({cells},">=4")>=2,"notify","no")))'
    parts = text.split("{0}")
    out = [F.lit(parts[0])]
    for p in parts[1:]:
        out += [row.cast("string"), F.lit(p)]
    return F.concat(*out)


def workbook(events: DataFrame) -> DataFrame:
    """Events by local solar day, numbered by time and id."""
    day = D.jalali(D.local_day(F.col("event_time")))
    order = Window.partitionBy("jalali_day").orderBy("event_time", "id")
    return events.withColumn("jalali_day", day).withColumn("number", F.row_number().over(order))


def workbook_rows(events: DataFrame, assessments: DataFrame, articles: DataFrame, watched: DataFrame) -> DataFrame:
    """A workbook's record for each event that is not withdrawn: evidence as the level of occurrence, the gold score of
    the latest assessment, the Iran score for security topics, the vote of the three, outlets in order and each once, notes.
    ``events``: id, event_time, status, category, evidence_level, iran_score, title, brief, url, primary_article_id;
    ``assessments``: event_id, id, gold_score; ``articles``: event_id, article_id, outlet; ``watched``: event_id, link_id, name."""
    last = latest_per(assessments, ["event_id"], F.desc("id")).select(F.col("event_id").alias("id"), "gold_score")
    first = articles.join(events.select(F.col("id").alias("event_id"), "primary_article_id"), "event_id").where("outlet <> ''")
    place = F.struct((F.col("article_id") != F.col("primary_article_id")).alias("late"), "article_id")
    by_outlet = first.groupBy("event_id", "outlet").agg(F.min(place).alias("place"))
    listed = by_outlet.groupBy(F.col("event_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "outlet"))), lambda x: x["outlet"]), "، ").alias("outlets"))
    items = watched.groupBy(F.col("event_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("link_id", "name"))), lambda x: x["name"]), "، ").alias("items"))
    joined = events.where("status <> 'withdrawn'").join(last, "id", "left").join(listed, "id", "left").join(items, "id", "left")
    category = X.legacy_category(F.col("category"))
    axes = [X.occurrence_level(F.col("evidence_level")), X.level_label(F.col("gold_score")), F.when(F.contains(category, F.lit("security")), X.level_label(F.col("iran_score"))).otherwise("")]
    day = D.jalali(D.local_day(F.col("event_time")))
    notes = F.concat_ws("\n", F.nullif("brief", F.lit("")), F.concat(F.lit("پایش: "), F.nullif("items", F.lit(""))))
    return joined.select("id", "event_time", day.alias("jalali_day"), D.jalali_words(day).alias("date"), F.date_format(D.local(F.col("event_time")), "HH:mm").alias("clock"), F.coalesce("outlets", F.lit("")).alias("outlets"), "title", axes[0].alias("occurrence"), axes[1].alias("gold"), axes[2].alias("security"), X.decide(*[F.nullif(a, F.lit("")) for a in axes]).alias("decision"), notes.alias("notes"), hyperlink(F.col("url")).alias("link"), category.alias("feed"))


def write_workbook(rows: DataFrame, path: str) -> DataFrame:
    """One folder of CSV for each day of ``rows``; days whose records are as they were keep their files, and so do days
    that ``rows`` lack. Returns the days written (jalali_day)."""
    return replace_changed(rows, path, "jalali_day", ["number"], "csv", header="true")


def changed_days(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Only the days that have a changed row."""
    days = rows.join(changed, "id", "left_semi").select("jalali_day").distinct()
    return rows.join(days, "jalali_day", "left_semi")


def feeds(rows: DataFrame) -> DataFrame:
    """(feed, n, text): the lines of a feed in order, joined. A feed holds one day."""
    lines = F.array_sort(F.collect_list(F.struct("number", "line")))
    return rows.groupBy("jalali_day", "feed").agg(F.count("*").alias("n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


def outdated(files: DataFrame, keep: int) -> DataFrame:
    """All but the newest."""
    return files.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("modified_at"), F.desc("name")))).where(F.col("_r") > keep).drop("_r")


def digest(alerts: DataFrame, delivered: DataFrame, accounts: DataFrame, since: Column, most: int = 20) -> DataFrame:
    """Of accounts that opted in, the newest alerts since a moment that no mail has carried."""
    new = alerts.where(F.col("created_at") >= since).join(delivered.where("channel = 'email'"), "alert_id", "left_anti").join(accounts.where("email_digest").select("user_id"), "user_id", "left_semi")
    return new.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("alert_id")))).where(F.col("place") <= most)


def replace_watchlist(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(user_id, item, action) that turn one list into the other."""
    c, w = current.select("user_id", "item", F.lit(True).alias("_c")), wanted.select("user_id", "item", F.lit(True).alias("_w"))
    return c.join(w, ["user_id", "item"], "full").select("user_id", "item", F.when(F.col("_c").isNull(), "add").when(F.col("_w").isNull(), "remove").otherwise("keep").alias("action"))


def acceptable_watchlists(wanted: DataFrame, items: DataFrame, least: int = 3, most: int = 100) -> DataFrame:
    """The lists of readers who name so many items of the catalogue, each once; other lists are refused as a whole."""
    known = wanted.select("user_id", "item").distinct().join(items.select("item", F.lit(True).alias("_known")), "item", "left")
    fine = known.groupBy("user_id").agg(F.count("*").alias("n"), F.count("_known").alias("k")).where(f"n = k and n between {least} and {most}").select("user_id")
    return known.join(fine, "user_id", "left_semi").select("user_id", "item")
