"""Streams against their batch forms, over files that arrive one after another."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import events as E
from newsloom.operators import ops as O
from newsloom.streaming import folds, windows
from test_operators import CHANGES, changes, ledger_brute

T0 = datetime(2024, 1, 1)


@pytest.fixture
def stream(spark, tmp_path):
    def make(rows, schema, parts=3):
        step = -(-len(rows) // parts)
        for k in range(parts):
            spark.createDataFrame(rows[k * step : (k + 1) * step], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def collected(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        q.awaitTermination(120)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_ledger(spark, stream):
    rows = changes()
    got = collected(spark, folds.ledger(stream(rows, CHANGES)), "ledger")
    assert sorted((r.user_id, r.event_id, r.at, r.seq, r.kind) for r in got) == ledger_brute(rows)
    batch = E.alert_ledger(spark.createDataFrame(rows, CHANGES)).collect()
    assert sorted((r.user_id, r.event_id, r.seq) for r in got) == sorted((r.user_id, r.event_id, r.seq) for r in batch)


def test_coverage(spark, stream):
    schema = "source_id string, at timestamp, seq long, state string, error_class string"
    rows = [("s" if k % 3 else "t", T0 + timedelta(minutes=3 * k + (60 if k > 20 else 0)), k, "gap" if k % 7 < 2 else "covered", "") for k in range(40)]
    got = collected(spark, folds.coverage(stream(rows, schema), 600), "coverage")
    batch = O.coverage(spark.createDataFrame(rows, schema), 600).collect()
    closed = sorted((r.source_id, r.started_at, r.ended_at, r.state) for r in got)
    every = sorted((r.source_id, r.started_at, r.ended_at, r.state) for r in batch)
    last = {r[0]: r for r in sorted(every, key=lambda r: (r[0], r[2], r[1]))}
    assert closed == [r for r in every if r not in last.values()]


def test_circuit(spark, stream):
    schema = "id long, provider string, created_at timestamp, status string"
    rows = [(k, "ab"[k % 2], T0 + timedelta(minutes=k), ["failed", "failed", "failed", "success", "wallet", "failed", "success"][k % 7]) for k in range(42)]
    got = collected(spark, folds.circuit(stream(rows, schema), 3), "circuit")
    batch = O.circuit(spark.createDataFrame(rows, schema), 3).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in batch)


def test_prices(spark, stream):
    rows = [("g", T0 + timedelta(minutes=k // 2), 1.0) for k in range(20)]
    assert len(collected(spark, windows.distinct_prices(stream(rows, "symbol string, observed_at timestamp, price double")), "prices")) == 10


def test_sessions(spark, stream):
    rows = [(k % 2, T0 + timedelta(minutes=k + 30 * (k // 10))) for k in range(40)] + [(9, T0 + timedelta(days=1))]
    schema = "run_id long, created_at timestamp"
    got = collected(spark, windows.sessions(stream(rows, schema)), "sessions")
    batch = O.sessions(spark.createDataFrame(rows, schema)).where(F.col("run_id") != 9).collect()
    assert sorted(tuple(r) for r in got if r.run_id != 9) == sorted(tuple(r) for r in batch)
