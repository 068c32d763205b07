"""Rules that wait: fetches that are tried again, predictions that settle when the market has traded. Batch forms, and the
steps that their streaming forms share (``streaming/timers.py``)."""

from __future__ import annotations

from datetime import datetime, timedelta
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsloom.functions import score as X
from newsloom.plans.folds import ordered_fold

#: The first wait and the longest, tries before a page is given up, and how long the queue keeps what was given up.
BASE_DELAY, MOST_DELAY, MOST_TRIES, KEPT = timedelta(minutes=5), timedelta(hours=6), 6, timedelta(days=30)
#: Causes that pass.
PASSING = ("network", "rate_limit")


class Retry(NamedTuple):
    """A page in the queue: failed tries since it was queued, when it is due, whether that was told, whether it was given up."""

    attempts: int
    next_at: datetime
    fired: bool
    gave_up: bool
    updated_at: datetime
    cause: str


RETRY_EVENT = "at timestamp, kind string, attempts int, next_at timestamp, cause string"


def wakes_at(s: Retry | None) -> datetime | None:
    """When something happens to a queued page by itself."""
    if s is None or (s.fired and not s.gave_up):
        return None
    return s.updated_at + KEPT if s.gave_up else s.next_at


def woken(s: Retry | None, until: datetime) -> tuple[Retry | None, list[tuple]]:
    """What the clock does up to a moment: a page comes due; what was given up leaves after a month."""
    at = wakes_at(s)
    if at is None or at > until:
        return s, []
    if s.gave_up:
        return None, [(at, "dropped", s.attempts, None, s.cause)]
    return s._replace(fired=True), [(at, "due", s.attempts, s.next_at, s.cause)]


def tried(s: Retry | None, at: datetime, cause: str) -> tuple[Retry | None, list[tuple]]:
    """A fetch of the page ended at a moment; ``cause`` is the class of its error, '' where the page was stored.

    A passing failure queues a page. A failure while it waits is a crawl's and changes nothing; one after it came due is the
    try's: the next wait is twice as long, or the page is given up and keeps its time.
    """
    s, out = woken(s, at)
    if cause == "":
        return None, out + ([(at, "stored", s.attempts, None, "")] if s else [])
    passing = cause in PASSING
    if s is None:
        if not passing:
            return None, out
        s = Retry(0, at + BASE_DELAY, False, False, at, cause)
        return s, [*out, (at, "scheduled", 0, s.next_at, cause)]
    if s.gave_up or not s.fired:
        return s, out
    attempts = s.attempts + 1
    if passing and attempts < MOST_TRIES:
        s = Retry(attempts, at + min(BASE_DELAY * 2 ** (attempts - 1), MOST_DELAY), False, False, at, cause)
        return s, [*out, (at, "rescheduled", attempts, s.next_at, cause)]
    s = Retry(attempts, s.next_at, True, True, at, cause)
    return s, [*out, (at, "gave_up", attempts, s.next_at, cause)]


def retry_log(outcomes: DataFrame, now: datetime) -> DataFrame:
    """What happens to each page of the retry queue up to ``now``: scheduled, due, rescheduled, gave_up, stored, dropped.
    ``outcomes``: source_id, url, at, seq, error ('' where the page was stored), in order of (at, seq).

    A page's rows are folded in order; a page has few, as its waits double. The clock's last word for each page comes from a
    row at ``now`` behind all others.
    """
    rows = outcomes.where(F.col("at") <= F.lit(now).cast(outcomes.schema["at"].dataType)).select("source_id", "url", F.col("at").cast("timestamp").alias("at"), "seq", X.error_class(F.col("error")).alias("cause"))
    pages = rows.select("source_id", "url").distinct()
    last = pages.select("source_id", "url", F.lit(now).cast("timestamp").alias("at"), F.lit(None).cast(rows.schema["seq"].dataType).alias("seq"), F.lit(None).cast("string").alias("cause"))
    names = [f.split()[0] for f in RETRY_EVENT.split(", ")]
    kind = rows.schema

    def step(s, row):
        after, found = woken(s, row["at"]) if row["cause"] is None else tried(s, row["at"], row["cause"])
        return after, (row["source_id"], row["url"], [dict(zip(names, x, strict=True)) for x in found]) if found else None

    schema = StructType.fromDDL(f"source_id {kind['source_id'].dataType.simpleString()}, url string, found array<struct<{RETRY_EVENT.replace(' ', ': ').replace(',: ', ', ')}>>")
    both = rows.unionByName(last).withColumn("end", F.col("seq").isNull())
    folded = ordered_fold(both, ["source_id", "url"], ["at", "end", "seq"], step, schema)
    return folded.select("source_id", "url", F.inline("found")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("at", "next_at")})
