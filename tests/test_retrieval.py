"""Neighbours and similar titles against brute force."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import neighbours as N
from newsloom.operators import retrieval as R

VECTORS = "id long, vector array<double>, at timestamp_ntz"
T0 = datetime(2024, 1, 1)


def clustered(n, centres, seed=2, width=16, spread=0.03):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, width))
    x = c[r.integers(0, centres, n)] + r.normal(0, spread, (n, width))
    return [(k, x[k].tolist(), T0 + timedelta(minutes=int(r.integers(0, 5000)))) for k in range(n)]


def brute(queries, rows, k, past=False):
    out = set()
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    at = {i: t for i, _, t in rows}
    for q, v, t in queries:
        u = np.array(v) / np.linalg.norm(v)
        near = sorted((-round(float(u @ unit[i]), 12), i) for i in unit if i != q and len(unit[i]) == len(u) and (not past or at[i] < t))
        out |= {(q, i, place) for place, (_, i) in enumerate(near[:k], 1)}
    return out


@pytest.mark.parametrize("past", [False, True])
def test_pruned_neighbours_equal_brute_force(spark, monkeypatch, past):
    monkeypatch.setattr(N, "BLOCK_ROWS", 32)
    monkeypatch.setattr(N, "QUERY_ROWS", 8)
    rows = clustered(1500, 25) + [(5000 + k, [1.0, 2.0, float(k)], T0) for k in range(5)] + [(6000, None, T0), (6001, [], T0)]
    real = [r for r in rows if r[1]]
    df = spark.createDataFrame(rows, VECTORS)
    v = N.rows_of(df, N.undated_last(F.col("at")))
    q = N.rows_of(df, N.moment(F.col("at"), N.AFTER_ALL)).where("id % 10 = 0")
    want = brute([r for r in real if r[0] % 10 == 0], real, 5, past)
    report = {}
    got = N.pruned(q, v, 5, past, report=report)
    assert {(r.query_id, r.id, r.place) for r in got.collect()} == want
    assert {(r.query_id, r.id, r.place) for r in N.nearest(q, v, 5, past).collect()} == want
    assert past or report["met"] < 0.25 * report["all"], report


def test_pruning_loses_nothing_where_nothing_is_near(spark, monkeypatch):
    """Directions without clusters: bounds let most blocks in, results are the same. Equal vectors tie to the smaller id."""
    monkeypatch.setattr(N, "BLOCK_ROWS", 16)
    r = np.random.default_rng(1)
    rows = [(k, r.normal(size=8).tolist(), T0) for k in range(300)] + [(1000 + k, [1.0] * 8, T0) for k in range(40)]
    v = N.rows_of(spark.createDataFrame(rows, VECTORS))
    q = v.where("id % 4 = 0")
    got = {(x.query_id, x.id, x.place) for x in N.pruned(q, v, 3).collect()}
    assert got == {(x.query_id, x.id, x.place) for x in N.nearest(q, v, 3, prune=False).collect()}
    assert {(1000, 1001, 1), (1000, 1002, 2), (1004, 1000, 1)} <= got
    assert N.pruned(q.limit(0), v, 3).count() == 0 and N.pruned(q, v.limit(0), 3).count() == 0


def test_memory_examples_know_only_the_past(spark):
    """Reviewed rows of the query's category from before it, then the model's; titles where there is no vector."""
    day = lambda d: T0 + timedelta(days=d)
    queries = [(1, [1.0, 0.0], "gold price rises again", day(10), "economics"), (2, None, "gold price rises again", day(10), "security"), (3, [1.0, 0.0], "x", None, None)]
    reviewed = [(11, [1.0, 0.1], "gold price rises", day(5), "economics"), (12, [1.0, 0.0], "gold price", day(11), "economics"), (13, [1.0, 0.05], "gold rises", day(5), "security"), (14, [0.9, 0.1], "gold price again", None, "security/economics"), (15, [1.0, 0.02], "boats", day(1), "other")]
    others = [(k, v, t, True) for k, v, _, t, _ in reviewed] + [(21, [1.0, 0.01], day(9), True), (22, [1.0, 0.0], day(12), True), (23, [1.0, 0.0], day(8), False)]
    q = spark.createDataFrame(queries, "id long, vector array<double>, title string, at timestamp_ntz, category string")
    r = spark.createDataFrame(reviewed, "id long, vector array<double>, title string, at timestamp_ntz, category string")
    o = spark.createDataFrame(others, "id long, vector array<double>, at timestamp_ntz, usable boolean")
    got = {}
    for x in R.memory_examples(q, r, o, 4).orderBy("query_id", "place").collect():
        got.setdefault(x.query_id, []).append((x.id, x.reviewed))
    assert got[1] == [(11, True), (14, True), (21, False), (15, False)]
    assert got[2] == [(13, True), (14, True)] or got[2] == [(14, True), (13, True)]
    assert [k for k, _ in got[3]] == [12, 15, 13, 11] and all(h for _, h in got[3])


@pytest.mark.parametrize("k", [1, 3])
def test_similar_titles_equal_brute_force(spark, k):
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("gold", "oil", "rates", "market", "storm", "talks") for b in ("", "s", "ing", "er")]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 9)))) for i in range(150)] + [(900, ""), (901, None), (902, "zq"), (903, "ﷲ")]
    df = spark.createDataFrame(rows, "id long, title string")
    got = {}
    for x in R.similar_titles(df.where("id % 3 = 0"), df, k).collect():
        got.setdefault(x.query_id, []).append((-round(x.score, 9), x.id))
    grams = lambda t: (lambda s: {s[i : i + 3] for i in range(len(s) - 2)} if len(s) > 2 else {s} if s else set())((t or "").replace(" ", ""))
    for i, t in rows:
        if i % 3 == 0:
            near = sorted((-round(len(grams(t) & grams(o)) / len(grams(t) | grams(o)), 9), j) for j, o in rows if j != i and grams(t) & grams(o))[:k]
            assert sorted(got.get(i, [])) == near, (i, t)
