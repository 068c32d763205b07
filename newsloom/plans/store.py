"""Stored partitions that change only where their rows do.

Beside the data lies a table of fingerprints, one row for each partition. A
write compares, replaces the partitions that differ, and records them after
their files stand; a write that is repeated, or was cut off and is done again,
leaves what is right alone and puts right what is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.plans.durable import scratch, written
from newsloom.plans.joins import latest_per

#: Spark's readers pass over folders that begin so. Fingerprints lie in so many shards, not in a file for each partition.
_MARKS, SHARDS = "_fingerprints/shards", 64


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _path(spark, path)
    return fs.exists(where)


def fingerprints(rows: DataFrame, by: str) -> DataFrame:
    """(by, n, h) of each partition: its number of rows and a sum of their hashes, whatever their order."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).alias("h"))


def replace_changed(rows: DataFrame, path: str, by: str, order: list[str] | None = None, format: str = "parquet", **options) -> DataFrame:
    """Writes the partitions of ``rows`` (by column ``by``) that differ from what stands under ``path``; all others keep their
    files. Returns (by) of those written. ``rows`` hold their partitions whole."""
    spark = rows.sparkSession
    with scratch(spark, "store") as folder:
        new = written(fingerprints(rows, by), "new", folder)
        old = _marked(spark, path, by, rows.schema[by].dataType.simpleString())
        if old is not None:
            new = written(new.join(old.select(by, "n", "h"), [by, "n", "h"], "left_anti"), "changed", folder)
        changed = [r[0] for r in new.select(by).limit(1).collect()]
        if changed:
            part = rows.join(new.select(by), by, "left_semi").repartition(by).sortWithinPartitions(by, *(order or []))
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy(by).format(format).save(path)
            _mark(new, path, by, folder)
        return written(new.select(by), "changed-partitions")


def _marked(spark: SparkSession, path: str, by: str, kind: str) -> DataFrame | None:
    """(by, n, h, _shard) as they were recorded; None where nothing was."""
    marks = f"{path.rstrip('/')}/{_MARKS}"
    return spark.read.schema(f"{by} {kind}, n long, h decimal(38,0), _shard int").parquet(marks).where(F.col(by).isNotNull()) if exists(spark, marks) else None


def _mark(changed: DataFrame, path: str, by: str, folder: str) -> None:
    """Records (by, n, h) of partitions; those without ``n`` are forgotten. The shards that hold them are written again, each with a
    row for no partition, so that one whose partitions have all gone is written too."""
    spark = changed.sparkSession
    new = changed.select(by, F.col("n").cast("long").alias("n"), F.col("h").cast("decimal(38,0)").alias("h")).withColumn("_shard", F.pmod(F.xxhash64(by), F.lit(SHARDS)).cast("int"))
    shards = new.select("_shard").distinct()
    out = new.where("n is not null").unionByName(shards.select(F.lit(None).cast(new.schema[by].dataType).alias(by), F.lit(0).cast("long").alias("n"), F.lit(0).cast("decimal(38,0)").alias("h"), "_shard"))
    old = _marked(spark, path, by, new.schema[by].dataType.simpleString())
    if old is not None:
        out = out.unionByName(old.join(shards, "_shard", "left_semi").join(new.select(by), by, "left_anti").select(*out.columns))
    whole = written(out, "marks", folder)  # what is read stands where it is written
    whole.repartition("_shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_shard").parquet(f"{path.rstrip('/')}/{_MARKS}")


def upsert(new: DataFrame, path: str, keys: list[str], by: str, *order: Column) -> DataFrame:
    """The last new row of each key (by ``order``) in place of the stored one, in Parquet under ``path`` partitioned by ``by``.
    Only partitions that a new row enters or a stored one leaves are read whole and written. Returns (by) of those written."""
    spark = new.sparkSession
    with scratch(spark, "upsert") as folder:
        last = written(latest_per(new, keys, *order), "last", folder)
        if not exists(spark, path):
            return replace_changed(last, path, by)
        stored = spark.read.schema(last.schema).parquet(path).select(*last.columns)
        left = stored.select(*keys, by).join(last.select(*keys), keys, "left_semi").select(by)
        touched = written(left.unionByName(last.select(by)).distinct(), "touched", folder)
        kept = stored.join(touched, by, "left_semi").join(last.select(*keys), keys, "left_anti")
        merged = written(kept.select(*last.columns).unionByName(last), "merged", folder)  # fingerprints depend on the order of columns
        gone = written(touched.join(merged.select(by).distinct(), by, "left_anti"), "gone", folder)
        if not gone.isEmpty():
            _mark(gone.withColumns({"n": F.lit(None), "h": F.lit(None)}), path, by, folder)
            _drop(spark, path, by, gone)
        return replace_changed(merged, path, by)


def _drop(spark: SparkSession, path: str, by: str, gone: DataFrame) -> None:
    """Removes the folders of partitions that every row has left."""
    for r in gone.select(F.col(by).cast("string")).toLocalIterator():
        fs, where = _path(spark, f"{path.rstrip('/')}/{by}={r[0]}")
        fs.delete(where, True)
