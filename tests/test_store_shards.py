"""Fingerprints of many stored partitions take few files, and follow partitions that go and come again."""

import os
from datetime import date, timedelta

from pyspark.sql import functions as F

from newsloom.plans import store


def test_fingerprints_are_few_and_right(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SHARDS", 3)
    path, day = f"{tmp_path}/t", lambda k: date(2024, 1, 1) + timedelta(days=k)
    put = lambda rows: store.upsert(spark.createDataFrame(rows, "id long, v long, day date"), path, ["id"], "day", F.desc("v"))
    held = lambda: sorted((r.id, r.v, r.day) for r in spark.read.parquet(path).collect())
    rows = [(k, 0, day(k)) for k in range(12)]
    assert put(rows).count() == 12 and held() == rows
    assert sum(f.endswith(".parquet") for d, _, fs in os.walk(f"{path}/_fingerprints") for f in fs) <= 3
    assert put([(5, 1, day(6))]).count() == 1  # day 5 goes
    assert not os.path.exists(f"{path}/day=2024-01-06")
    assert put([(5, 0, day(5))]).count() == 2  # and comes again as it was
    assert held() == rows and put(rows[:3]).count() == 0
