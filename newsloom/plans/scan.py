"""Running sums over the rows of a key, as blocks of time with a summary that carries between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from newsloom.plans.joins import _seconds


def block_of(at: str, seconds: int) -> Column:
    """The number of the block of time that a moment falls into."""
    return F.floor(_seconds(F.col(at)) / seconds).cast("long")


def prefix_sums(rows: DataFrame, keys: list[str], at: str, order: list[str], values: dict[str, str], block_seconds: int = 3600) -> DataFrame:
    """``rows`` with, for each ``name: value`` of ``values``, the sum of that column over the rows of the same key that come
    before by ``order``, which begins with ``at``. Rows are windowed by key and block of time; a summary with one row for each
    key and block carries what came before, so a key with most of the rows is many groups."""
    blocked = rows.withColumn("_b", block_of(at, block_seconds))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    own = blocked.withColumns({f"_in_{n}": F.sum(v).over(inside) for n, v in values.items()})
    totals = blocked.groupBy(*keys, "_b").agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in values.items()])
    carried = totals.select(*keys, "_b", *[F.sum(f"_sum_{n}").over(before).alias(f"_was_{n}") for n in values])
    zero = F.lit(0)
    both = {n: F.coalesce(f"_in_{n}", zero) + F.coalesce(f"_was_{n}", zero) for n in values}
    return own.join(carried, [*keys, "_b"]).select(*rows.columns, *[c.alias(n) for n, c in both.items()])
