"""Joins that Spark has no operator for: latest row of a key, as-of, and within a radius of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``. Spark drops others before the shuffle (WindowGroupLimit)."""
    return top_per(df, keys, 1, *order)


def top_per(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def _seconds(moment: Column) -> Column:
    return moment.cast("timestamp").cast("long")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str], forward: bool = False, bucket_seconds: int = 86_400, tolerance_seconds: int | None = None) -> DataFrame:
    """``left`` with the ``values`` (and ``right_time``) of the last row of ``right`` at or before its moment,
    or with ``forward`` the first at or after it; null where there is none within the tolerance.

    Rows are windowed by key and bucket of time, so a key with most of the rows is many groups; what a bucket lacks
    comes from a summary with one row for each key and bucket.
    """
    sign = -1 if forward else 1
    bucket = lambda c: (F.floor(_seconds(F.col(c)) / bucket_seconds) * sign).cast("long")
    held = F.struct(F.col(right_time).alias("_at"), *values)
    r = right.where(F.col(right_time).isNotNull()).select(*by, bucket(right_time).alias("_b"), F.col(right_time).alias("_t"), held.alias("_v"))
    l = left.withColumn("_b", bucket(left_time)).withColumn("_t", F.col(left_time))  # noqa: E741
    columns = left.columns
    pick = F.max_by if not forward else F.min_by
    summary = r.groupBy(*by, "_b").agg(pick("_v", "_t").alias("_v"))
    grid = l.select(*by, "_b").distinct().withColumn("_v", F.lit(None).cast(summary.schema["_v"].dataType)).unionByName(summary).groupBy(*by, "_b").agg(F.first("_v", ignorenulls=True).alias("_v"))
    past = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = grid.withColumn("_before", F.last("_v", ignorenulls=True).over(past)).select(*by, "_b", "_before")
    null_v = F.lit(None).cast(r.schema["_v"].dataType)
    packed = F.struct(*columns)
    rows = l.select(*by, "_b", "_t", F.lit(1).alias("_side"), packed.alias("_l"), null_v.alias("_v")).unionByName(r.select(*by, "_b", "_t", F.lit(0).alias("_side"), F.lit(None).cast(l.select(packed).schema[0].dataType).alias("_l"), "_v"))
    order = Window.partitionBy(*by, "_b").orderBy(F.col("_t").desc() if forward else F.col("_t"), "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_side = 1").select(*by, "_b", "_t", "_l", "_v")
    found = seen.join(carried, [*by, "_b"], "left").withColumn("_v", F.coalesce("_v", "_before"))
    if tolerance_seconds is not None:
        gap = F.abs(_seconds(F.col("_t")) - _seconds(F.col("_v._at")))
        found = found.withColumn("_v", F.when(gap <= tolerance_seconds, F.col("_v")))
    return found.select(*[F.col(f"_l.{c}").alias(c) for c in columns], F.col("_v._at").alias(right_time), *[F.col(f"_v.{v}").alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, radius_seconds: int, on: list[str] | None = None) -> DataFrame:
    """Pairs whose moments are no more than a radius apart: an equi-join on buckets as wide as the radius, the left side in
    three of them, then the exact condition. Columns of the two sides must differ, but for ``on``."""
    at = lambda c: F.floor(_seconds(F.col(c)) / radius_seconds).cast("long")
    l = left.withColumn("_b", F.explode(F.array(*[at(left_time) + k for k in (-1, 0, 1)])))  # noqa: E741
    r = right.withColumn("_b", at(right_time))
    near = F.abs(_seconds(F.col(left_time)) - _seconds(F.col(right_time))) <= radius_seconds
    return l.join(r, [*(on or []), "_b"]).where(near).drop("_b")


#: Parts into which the left rows of ``met_by_any`` are dealt, and members that stand together as one row.
MET_PARTS, MEMBERS = 64, 2048


def met_by_any(left: DataFrame, right: DataFrame, member: str, traits: list[str] = []) -> DataFrame:  # noqa: B006
    """For joins whose result is large by nature. ``left`` has a set ``has``; ``right`` a ``member`` with a set ``wants`` and
    ``traits`` (not null), one row for each member. Where the sets share anything, gives the row of ``left`` with ``members``, an
    array of those who do, and their traits; a left row and a member meet in one such row only, so exploding ``members`` gives
    each pair once, without a shuffle or a set operation for each pair.

    Members of equal wishes and traits are packed in blocks; a row and a block meet at the first thing that they share. Left rows
    are dealt over parts, and blocks stand in each, so what everybody has or wants is many groups."""
    alike = ["wants", *traits]
    sized = right.join(right.groupBy(*alike).agg(F.count("*").alias("_n")), alike)
    block = F.pmod(F.xxhash64(member), F.ceil(F.col("_n") / MEMBERS))
    packed = sized.groupBy(*alike, block.alias("_block")).agg(F.collect_list(member).alias("members")).drop("_block")
    key = lambda part, thing: F.concat_ws(":", part.cast("string"), thing)
    part = F.pmod(F.xxhash64(*[c for c in left.columns if c != "has"]), F.lit(MET_PARTS))
    dealt = left.withColumn("_thing", F.explode("has")).withColumn("_key", key(part, F.col("_thing"))).repartition(MET_PARTS, "_key")
    standing = packed.withColumn("_want", F.explode("wants")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(MET_PARTS - 1))))
    standing = standing.select(key(F.col("_part"), F.col("_want")).alias("_key"), *alike, "members").repartition(MET_PARTS, "_key")
    first = F.array_min(F.array_intersect("has", "wants")) == F.col("_thing")
    return dealt.join(standing.hint("shuffle_merge"), "_key").where(first).drop("_key", "_thing", "has", "wants")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
