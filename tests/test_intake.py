"""Micro-batches against one batch, replayed and restarted."""

import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from newsloom.operators import events as E
from newsloom.operators import export as K
from newsloom.plans import store
from newsloom.streaming import intake as I

T0 = datetime(2024, 1, 1)


def arrive(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(path)


def finish(q):
    q.awaitTermination(300)
    q.stop()
    assert q.exception() is None


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith((".parquet", ".csv")) and "_fingerprints" not in d}


def test_attempts_are_appended_once(spark, tmp_path):
    """Two runs over growing input equal one batch over all of it; a third without news adds nothing."""
    schema = "source_id string, started_at timestamp_ntz, fetched long, new long, failed long, error string"
    rows = [(f"s{k % 3}", T0 + timedelta(minutes=k), [0, 5, 9][k % 3], k % 3, int(k % 4 == 0 and k % 3 > 0), "HTTP 503" if k % 7 == 0 else "") for k in range(40)]
    for part in (rows[:15], rows[15:], None):
        stream = arrive(spark, f"{tmp_path}/in", part, schema) if part else spark.readStream.schema(spark.createDataFrame([], schema).schema).parquet(f"{tmp_path}/in")
        finish(I.append_available(I.attempts(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint"))
    want = sorted(map(tuple, I.attempts(spark.createDataFrame(rows, schema)).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("source_id", "started_at", "status", "error_class", "fetched", "new", "repeated", "failed").collect())) == want
    assert {r[2] for r in want} == {"success", "partial", "empty", "failed"}


def test_cutoffs_follow_the_stream(spark, tmp_path):
    """After three runs, with late events among them, every day's cut-offs are those of one batch; days out of reach keep their files."""
    schema = "id long, event_time timestamp_ntz, iran_score double, global_score double, category string"
    r = random.Random(3)
    rows = [(k, T0 + timedelta(days=d), float(r.randrange(5) * 20), float(r.randrange(100)), "oil") for k, d in enumerate([r.randrange(12) for _ in range(300)] + [40 + r.randrange(3) for _ in range(200)] + [r.choice([2, 80]) for _ in range(100)])]
    sinks, kept = I.Sinks(f"{tmp_path}/store"), []
    for part in (rows[:300], rows[300:500], rows[500:]):
        finish(I.each_batch(arrive(spark, f"{tmp_path}/in", part, schema), I.cutoffs_upkeep(sinks, min_sample=100), f"{tmp_path}/checkpoint"))
        kept.append(files(f"{tmp_path}/store/cutoffs"))
    got = spark.read.parquet(f"{tmp_path}/store/cutoffs")
    want = E.rolling_cutoffs(E.daily_histograms(spark.createDataFrame(rows, schema)), min_sample=100)
    as_rows = lambda df: sorted(map(repr, df.select("day", "axis", "basis", "sample", "cuts").collect()))
    assert as_rows(got) == as_rows(want)
    assert {p for p in kept[0] if "2024-01-01" in p} <= kept[2].keys()
    assert sum(kept[1].get(p) == t for p, t in kept[0].items()) > 20


CRAWL = "seq long, source_id string, url string, title string, lead string, content string, published_at timestamp_ntz, native_category string, gone boolean"
BODY = " ".join(f"word{k}" for k in range(120))


def crawl(seq, url, title, content=BODY, hours=1.0, gone=False, slug="news"):
    return (seq, "s1", url, title, f"lead of {title}, long enough to pass the gate of quality", f"{content} {title}", T0 + timedelta(hours=hours), slug, gone)


def test_a_batch_done_again_changes_nothing(spark, tmp_path):
    u = "https://example.org/"
    story = "central bank raises gold price again in surprise move"
    batches = [
        [crawl(1, u + "a", story), crawl(2, u + "b", "storm closes the northern ports for days"), crawl(3, u + "c", "sports results of the weekend", slug="sport"), crawl(4, u + "gone", "never seen", gone=True)],
        [crawl(11, u + "d", story + "s", hours=3), crawl(12, u + "e", story + "s", hours=4), crawl(13, u + "b", "storm closes the northern ports for days", BODY + " corrected"), crawl(14, u + "far", story + "s", BODY + " of another day", hours=500)],
        [crawl(21, u + "b", "storm closes the northern ports for days", gone=True), crawl(22, u + "a", story), crawl(23, u + "f", story, hours=5), crawl(24, u + "a", story)],
    ]
    answers = spark.createDataFrame([(u + k, "macro_monetary" if k != "far" else "no such topic", i, 2.0, c, ["gold", "port", "nothing"]) for k, i, c in (("a", 4.0, 0.9), ("b", 1.0, 0.3), ("c", 1.0, 0.9), ("d", 1.0, 0.9), ("far", 1.0, 0.9))], "url string, category string, iran double, global double, confidence double, tags array<string>")
    rules = spark.createDataFrame([(True, None, "sport")], "enabled boolean, source_id string, native_category string")
    sinks = I.Sinks(f"{tmp_path}/store")
    take = I.intake(sinks, answers, [("gold", ["gold"]), ("port", ["port"])], rules, T0 + timedelta(days=40))
    schemas = {"articles": I.ARTICLE, "revisions": I.REVISION, "duplicates": I.DUPLICATE, "links": I.LINK, "assessments": I.ASSESSMENT, "tags": I.TAG, "samples": I.SAMPLE}
    seen = lambda: {n: sorted(map(repr, sinks.all(spark, n, s).collect())) for n, s in schemas.items()}
    for rows in batches:
        finish(I.each_batch(arrive(spark, f"{tmp_path}/in", rows, CRAWL), take, f"{tmp_path}/checkpoint"))
    first = seen()
    for k in (2, 1):
        take(spark.createDataFrame(batches[k], CRAWL), k)
        assert seen() == first
    get = lambda n: sinks.all(spark, n, schemas[n]).collect()
    assert {(r.id, r.batch, r.url_status) for r in get("articles")} == {(1, 0, "live"), (2, 0, "live"), (3, 0, "live"), (11, 1, "live"), (12, 1, "live"), (2, 1, "live"), (14, 1, "live"), (2, 2, "gone"), (23, 2, "live")}
    assert {(r.id, r.batch) for r in get("revisions")} == {(2, 1), (2, 2)}
    assert {(r.id, r.duplicate_of) for r in get("duplicates")} == {(11, 1), (12, 1), (23, 1)}
    assert {(r.event_id, r.article_id) for r in get("links")} == {(1, 1), (2, 2), (3, 3), (1, 11), (1, 12), (14, 14), (1, 23)}
    assert {(r.event_id, r.batch, r.iran_score) for r in get("assessments")} == {(1, 0, 100), (2, 0, 25), (2, 1, 25)}
    assert {(r.event_id, r.slug) for r in get("tags")} == {(1, "gold"), (2, "port")}
    assert (2, "unsure") in {(r.event_id, r.stratum) for r in get("samples")}


def test_stored_partitions_change_only_where_rows_do(spark, tmp_path):
    path = f"{tmp_path}/t"
    row = lambda ks, v: spark.createDataFrame([(k, v, T0.date() + timedelta(days=k % 5)) for k in ks], "id long, v string, day date")
    store.upsert(row(range(50), "a"), path, ["id"], "day", F.desc("v"))
    first = files(path)
    changed = store.upsert(row([5, 10], "b"), path, ["id"], "day", F.desc("v"))
    assert [r.day for r in changed.collect()] == [T0.date()]
    second = files(path)
    assert {p for p in first if "2024-01-01" not in p} == {p for p, t in second.items() if first.get(p) == t}
    assert store.upsert(row([5, 10], "b"), path, ["id"], "day", F.desc("v")).count() == 0 and files(path) == second
    moved = spark.createDataFrame([(k, "c", T0.date() + timedelta(days=9)) for k in range(4, 50, 5)], "id long, v string, day date")
    store.upsert(moved, path, ["id"], "day", F.desc("v"))
    got = {r.id: (r.v, r.day) for r in spark.read.parquet(path).collect()}
    assert len(got) == 50 and got[4] == ("c", T0.date() + timedelta(days=9)) and got[5][0] == "b" and not any("2024-01-05" in p for p in files(path))


def test_workbooks_of_unchanged_days_keep_their_files(spark, tmp_path):
    path = f"{tmp_path}/book"
    rows = lambda v: spark.createDataFrame([(k, v if k == 7 else "x", 1 + k // 3, f"1402-10-{11 + k % 3}") for k in range(9)], "id long, title string, number int, jalali_day string")
    assert K.write_workbook(rows("x"), path).count() == 3
    first = files(path)
    assert K.write_workbook(rows("x"), path).count() == 0 and files(path) == first
    assert [r.jalali_day for r in K.write_workbook(rows("new"), path).collect()] == ["1402-10-12"]
    assert sum(files(path).get(p) == t for p, t in first.items()) == 2
    assert [r.title for r in spark.read.csv(path, header=True).where("id = 7").collect()] == ["new"]
    assert K.write_workbook(rows("new").where("jalali_day = '1402-10-11'"), path).count() == 0 and spark.read.csv(path, header=True).count() == 9
