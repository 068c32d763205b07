"""Rules that wait: streams with timers against their batch forms, stopped and started again in between."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from newsloom.operators import events as E
from newsloom.operators import market as M
from newsloom.operators import timed
from newsloom.streaming import timers

T0 = datetime(2024, 1, 1)
FAR = datetime(2030, 1, 1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def arriving(spark, tmp_path, batches, schema, make):
    """The stream's rows after all ``batches``, each read by a run of its own that goes on from the checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{tmp_path}/in")
        q = make(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        try:
            q.awaitTermination(300)
        finally:
            q.stop()
    return spark.read.parquet(f"{tmp_path}/out")


# --- R06

OUTCOMES = "source_id long, url string, at timestamp_ntz, seq long, error string"


def brute_log(rows, now):
    """The rules for a page once more, in plain words, as one loop over times."""
    held, out = {}, []

    def clock(key, t):
        s = held.get(key)
        if s and s["gave_up"] and s["changed"] + timedelta(days=30) <= t:
            out.append((*key, s["changed"] + timedelta(days=30), "dropped", s["n"]))
            del held[key]
        elif s and not s["gave_up"] and not s["told"] and s["due"] <= t:
            out.append((*key, s["due"], "due", s["n"]))
            s["told"] = True

    for source, url, t, _, error in sorted(rows, key=lambda r: (r[2], r[3])):
        key = (source, url)
        clock(key, t)
        s, passing = held.get(key), "503" in error or "429" in error
        if not error:
            if s:
                out.append((*key, t, "stored", s["n"]))
                del held[key]
        elif s is None:
            if passing:
                held[key] = {"n": 0, "due": t + timedelta(minutes=5), "told": False, "gave_up": False, "changed": t}
                out.append((*key, t, "scheduled", 0))
        elif s["told"] and not s["gave_up"]:
            s["n"] += 1
            s["changed"] = t
            if passing and s["n"] < 6:
                s["due"], s["told"] = t + min(timedelta(minutes=5 * 2 ** (s["n"] - 1)), timedelta(hours=6)), False
                out.append((*key, t, "rescheduled", s["n"]))
            else:
                s["gave_up"] = True
                out.append((*key, t, "gave_up", s["n"]))
    for key in list(held):
        clock(key, now)
    return sorted(out)


def outcomes(n=400):
    r = random.Random(8)
    rows = [(k % 3, f"u{r.randrange(4)}", at(r.choice([7, 30, 200]) * (k // 4) + r.randrange(5)), k, r.choice(["HTTP 503", "HTTP 503", "HTTP 429", "HTTP 503", "HTTP 404", ""] if k > 100 else ["HTTP 503"])) for k in range(n)]
    return sorted(rows, key=lambda r: (r[2], r[3]))


def test_retry_log_equals_a_loop(spark):
    rows, now = outcomes(), at(60 * 24 * 90)
    got = sorted((r.source_id, r.url, r.at, r.kind, r.attempts) for r in timed.retry_log(spark.createDataFrame(rows, OUTCOMES).repartition(5), now).collect())
    assert got == brute_log(rows, now)
    assert {k for *_, k, _ in got} == {"scheduled", "due", "rescheduled", "stored", "gave_up", "dropped"}


def test_retries_fire_when_due(rocksdb, tmp_path):
    """The stream tells the same as the batch at its last watermark, over three runs."""
    rows = outcomes()
    pulse = [(99, "pulse", rows[-1][2] + timedelta(days=60), 10**6, "")]
    log = arriving(rocksdb, tmp_path, [rows[:130], rows[130:260], rows[260:], pulse], OUTCOMES, lambda s: timers.retry_log(s, "0 seconds"))
    got = sorted((r.source_id, r.url, r.at, r.kind, r.attempts, r.next_at, r.cause) for r in log.collect() if r.url != "pulse")
    batch = timed.retry_log(rocksdb.createDataFrame(rows, OUTCOMES), pulse[0][2]).collect()
    assert sorted(got, key=repr) == sorted(((r.source_id, r.url, r.at, r.kind, r.attempts, r.next_at, r.cause) for r in batch), key=repr)


# --- R05

ROWS = "symbol string, at timestamp_ntz, seq long, kind int, price double, id long, trend string"


def market():
    """Three symbols, one with most of the rows; days without trade; predictions before the first price and on days off."""
    r = random.Random(6)
    rows = []
    for k in range(420):
        day = r.choice([0, 1, 2, 5, 6, 7, 8, 12])
        rows.append((r.choice("aaab"), at(1440 * day + r.randrange(1440)), k, 0, float(r.randrange(90, 110)), None, None))
    for k in range(120):
        rows.append((r.choice("aabc"), at(r.randrange(-600, 1440 * 13)), k, 1, None, k, r.choice(["↑", "↓", "→"])))
    return sorted({(x[0], x[1], x[3]): x for x in rows}.values(), key=lambda x: (x[1], x[3], x[2]))


@pytest.mark.parametrize("n,shards", [(1, 1), (3, 4)])
def test_predictions_settle_once(rocksdb, tmp_path, n, shards):
    rows = market()
    late = rows[:]
    for k in range(0, len(late) - 3, 3):  # rows come out of order, within the lateness
        late[k], late[k + 2] = late[k + 2], late[k]
    pulse = [("z", FAR, 10**6, 0, 1.0, None, None)]
    cuts = [late[:150], late[150:300], late[300:], pulse]
    settled = arriving(rocksdb, tmp_path, cuts, ROWS, lambda s: timers.settlements(s, n, "30 days", shards))
    got = sorted((r.id, r.at, r.baseline, r.nth_at, r.realized, r.realized_pct, r.direction_correct) for r in settled.collect())
    prices = rocksdb.createDataFrame([(s, t, p) for s, t, _, kind, p, *_ in rows if kind == 0], "symbol string, observed_at timestamp_ntz, price double")
    calls = rocksdb.createDataFrame([(k, s, t, w) for s, t, _, kind, _, k, w in rows if kind == 1], "id long, symbol string, at timestamp_ntz, gold_trend string")
    batch = M.backtest(calls, prices, n).select("id", "at", "baseline", "nth_at", "realized", "realized_pct", "direction_correct").collect()
    assert got == sorted(map(tuple, batch)) and len(got) > 40


def test_a_prediction_waits_for_its_day(rocksdb, tmp_path):
    """What the market has not answered stays in the state, over a restart, and settles when it does."""
    first = [("g", at(600), 0, 0, 100.0, None, None), ("g", at(700), 1, 1, None, 7, "↑"), ("g", at(1440 + 600), 2, 0, 101.0, None, None), ("z", at(1440 * 3), 3, 0, 1.0, None, None)]
    out = arriving(rocksdb, tmp_path, [first], ROWS, lambda s: timers.settlements(s, 2, "1 hour"))
    assert out.count() == 0
    more = [("g", at(1440 * 5), 4, 0, 104.0, None, None), ("z", at(1440 * 9), 5, 0, 1.0, None, None)]
    row = arriving(rocksdb, tmp_path, [more], ROWS, lambda s: timers.settlements(s, 2, "1 hour")).first()
    assert (row.id, row.baseline, row.realized, row.nth_at, row.direction_correct) == (7, 100.0, 104.0, at(1440 * 5), True)
    with pytest.raises(ValueError):
        timers.settlements(rocksdb.createDataFrame([], ROWS), 0)


def test_rolling_cutoffs_equal_those_of_each_day(spark):
    r = random.Random(3)
    days = [0, 1, 5, 40, 41, 80]
    rows = [(k, T0 + timedelta(days=r.choice(days)), float(r.randrange(5) * 20), float(r.randrange(100)), r.choice(["oil", "other"])) for k in range(1500)]
    e = spark.createDataFrame(rows, "id long, event_time timestamp_ntz, iran_score double, global_score double, category string")
    got = {(x.day, x.axis): (x.basis, x.sample, x.cuts) for x in E.rolling_cutoffs(E.daily_histograms(e)).collect()}
    assert {d for d, _ in got} == {(T0 + timedelta(days=d + k)).date() for d in days for k in range(30)}
    for k in (0, 5, 29, 30, 34, 35, 69, 71, 109):
        day = T0 + timedelta(days=k)
        inside = e.where((F.col("event_time") <= F.lit(day)) & (F.col("event_time") > F.lit(day - timedelta(days=30))))
        for x in E.cutoffs(E.axis_scores(inside)).collect():
            assert got[day.date(), x.axis] == (x.basis, x.sample, x.cuts)
