"""Prices: as-of lookups, trading days, back-tests and reactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.functions import score as X
from newsloom.functions import time as D
from newsloom.plans.joins import asof_join, range_join


def trading_days(prices: DataFrame) -> DataFrame:
    """(symbol, day, first_at, place): local days with an observation, counted from 1. One row for each symbol and day."""
    days = prices.groupBy("symbol", D.local_day(F.col("observed_at")).alias("day")).agg(F.min("observed_at").alias("first_at"), F.max("observed_at").alias("last_at"), F.max_by("price", "observed_at").alias("close"))
    return days.withColumn("place", F.row_number().over(Window.partitionBy("symbol").orderBy("day")))


def nth_trading_day(moments: DataFrame, prices: DataFrame, n: int, time: str = "at") -> DataFrame:
    """``moments`` with ``nth_at``, the first observation of the n-th trading day after their day; null until then.

    The last trading day no later than a moment's own day comes by an as-of join on days, the n-th after it by its place.
    """
    days = trading_days(prices).select("symbol", F.col("day").cast("timestamp_ntz").alias("_day"), "first_at", "place")
    placed = asof_join(moments.withColumn("_of", D.local_day(F.col(time)).cast("timestamp_ntz")), days, ["symbol"], "_of", "_day", ["place"], bucket_seconds=32 * 86_400)
    later = days.select("symbol", (F.col("place") - n).alias("_k"), F.col("first_at").alias("nth_at"))
    return placed.withColumn("_k", F.coalesce("place", F.lit(0))).join(later, ["symbol", "_k"], "left").drop("_of", "_day", "place", "_k")


def backtest(predictions: DataFrame, prices: DataFrame, n: int) -> DataFrame:
    """The price at or before a prediction against the first of the n-th trading day; unscored until it has come."""
    start = asof_join(predictions, prices, ["symbol"], "at", "observed_at", ["price"]).withColumnsRenamed({"price": "baseline", "observed_at": "baseline_at"}).where("baseline is not null")
    reached = nth_trading_day(start, prices, n).where("nth_at is not null")
    end = prices.select("symbol", F.col("observed_at").alias("nth_at"), F.col("price").alias("realized"))
    out = reached.join(end, ["symbol", "nth_at"])
    pct = X.pct_change(F.col("baseline"), F.col("realized"))
    return out.withColumn("realized_pct", pct).withColumn("direction_correct", X.direction_correct(F.col("gold_trend"), F.col("realized_pct")))


def _shift(hours: int) -> Column:
    return F.make_dt_interval(hours=F.lit(hours))


def window_prices(events: DataFrame, prices: DataFrame, window: str, now: Column) -> DataFrame:
    """``events`` (symbol, at, ...) with before_at, before, after_at, after for one window; rows that have not come to
    pass, or whose series has nothing near enough, fall out."""
    at = F.col("at")
    if window in ("1td", "3td"):
        timed = nth_trading_day(events, prices, int(window[0])).withColumnRenamed("nth_at", "_end").withColumn("_start", at)
        slack = 4 * 86_400
    else:
        back, ahead, slack = {"2h": (2, 2, 3600), "1d": (0, 24, 86_400)}[window]
        timed = events.withColumns({"_start": at - _shift(back), "_end": at + _shift(ahead)})
    timed = timed.where((F.col("_end") <= now) & F.col("_end").isNotNull())
    before = asof_join(timed, prices, ["symbol"], "_start", "observed_at", ["price"], tolerance_seconds=slack).withColumnsRenamed({"observed_at": "before_at", "price": "before"})
    after = asof_join(before, prices, ["symbol"], "_end", "observed_at", ["price"]).withColumnsRenamed({"observed_at": "after_at", "price": "after"})
    return after.where("before is not null and after is not null and after_at > at and after_at <> before_at").drop("_start", "_end")


def daily_moves(prices: DataFrame) -> DataFrame:
    """(symbol, from_at, to_at, move) between the last observations of consecutive trading days."""
    order = Window.partitionBy("symbol").orderBy("day")
    days = trading_days(prices)
    return days.select("symbol", F.lag("last_at").over(order).alias("from_at"), F.col("last_at").alias("to_at"), X.pct_change(F.lag("close").over(order), F.col("close")).alias("move")).where("from_at is not null")


def with_abs_z(changes: DataFrame, prices: DataFrame, days: int = 30, least: int = 10) -> DataFrame:
    """|change| over the deviation of the moves of the trailing days; null for too few or none."""
    near = range_join(changes.select("id", "symbol", "at"), daily_moves(prices), "at", "to_at", days * 86_400, ["symbol"])
    inside = near.where((F.col("to_at") <= F.col("at")) & (F.col("from_at") >= F.col("at") - F.make_dt_interval(days=F.lit(days))))
    spread = inside.groupBy("id", "symbol").agg(F.when((F.count("*") >= least) & (F.stddev_pop("move") > 0), F.stddev_pop("move")).alias("_spread"))
    return changes.join(spread, ["id", "symbol"], "left").withColumn("abs_z", F.abs("pct_change") / F.col("_spread")).drop("_spread")


def calibration(reactions: DataFrame, keys: list[str], hit: float = 1.0) -> DataFrame:
    """Per key of each kind: reactions, scored, hits, the mean |z| and the share of hits, in one pass."""
    sets = reactions.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys])
    return sets.agg(F.count("*").alias("reactions"), F.count("abs_z").alias("scored"), F.count_if(F.col("abs_z") >= hit).alias("hits"), F.avg("abs_z").alias("mean_abs_z"), (F.count_if(F.col("abs_z") >= hit) / F.nullif(F.count("abs_z"), F.lit(0))).alias("hit_rate"))


def valid_points(rows: DataFrame) -> DataFrame:
    """(symbol, observed_at, price) of what parses: a time, and a finite price above zero."""
    parsed = rows.select("symbol", D.parse_iso(F.col("observed_at")).alias("observed_at"), F.col("price").try_cast("double").alias("price"))
    return parsed.where(F.col("observed_at").isNotNull() & (F.col("price") > 0) & ~F.isnan("price") & (F.col("price") < float("inf")))


def observed_changes(markers: DataFrame, points: DataFrame, now: Column, slack_days: int = 3) -> DataFrame:
    """Per marker (id, symbol, at) the change in per cent a day and a week after it: from the last price before, three
    days old at most, to the first from then on within three days; null where either is missing or the time has not come."""
    slack = slack_days * 86_400
    out = asof_join(markers, points, ["symbol"], "at", "observed_at", ["price"], tolerance_seconds=slack).withColumnsRenamed({"price": "_before", "observed_at": "_from"})
    for name, days in (("change_1d", 1), ("change_1w", 7)):
        target = out.withColumn("_target", F.col("at") + F.make_dt_interval(days=F.lit(days)))
        later = asof_join(target, points, ["symbol"], "_target", "observed_at", ["price"], forward=True, tolerance_seconds=slack)
        change = F.round(100 * (F.col("price") - F.col("_before")) / F.nullif(F.col("_before"), F.lit(0)), 2)
        out = later.withColumn(name, F.when(F.col("_target") <= now, change)).drop("price", "observed_at", "_target")
    return out.select("id", "symbol", "at", "change_1d", "change_1w")
