"""Storylines over stretches of time in parts equal the greedy choice by hand, whatever is near by text or items."""

import random
from datetime import datetime, timedelta

import pytest

from newsloom.operators import retrieval as R


def cosine(a, b):
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5, 9)


@pytest.mark.parametrize("part", [65_536, 9])
def test_every_event_finds_its_strongest(spark, monkeypatch, part):
    monkeypatch.setattr(R, "STRETCH_EVENTS", part)
    monkeypatch.setattr(R, "BLOCK_ROWS", 3)
    r = random.Random(part)
    base = [[r.gauss(0, 1) for _ in range(4)] for _ in range(6)]
    base += [[x + 0.3 * r.gauss(0, 1) for x in v] for v in base]
    cats, names = ["political", "social", None], [f"i{k}" for k in range(14)]
    rows = [(k, datetime(2024, 1, 1) + timedelta(hours=r.randrange(1500)), r.choice(cats), r.choice([*base, None])) for k in range(160)]
    tags = [(k, i) for k, *_ in rows for i in r.sample(names, r.choice([0, 1, 2, 3, 12]))] + [(0, None)]
    items = {k: {i for e, i in tags if e == k and i} for k, *_ in rows}
    df = spark.createDataFrame(rows, "id long, event_time timestamp_ntz, category string, vector array<float>")
    rows = [(x.id, x.event_time, x.t, x.vector) for x in df.withColumn("t", R.X.event_topic(R.F.col("category"))).collect()]
    up = {}
    for l_id, l_at, topic, vector in rows:
        best = []
        for e_id, e_at, other, v in rows:
            if (e_at, e_id) < (l_at, l_id) and l_at - e_at <= timedelta(days=14):
                s = cosine(vector, v) if vector and v else 0.0
                s, n = s if s >= 0.75 else 0.0, len(items[l_id] & items[e_id])
                if s >= 0.85 or (s and n) or (n >= 2 and topic == other and topic is not None):
                    best.append((-(s + 0.1 * n), e_at, e_id))
        if best:
            up[l_id] = min(best)[2]
    group = {k: k for k, *_ in rows}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in up.items():
        a, b = root(a), root(b)
        group[max(a, b)] = min(a, b)
    want = {k: root(k) for k in {*up, *up.values()}}
    assert {x.event_id: x.storyline_id for x in R.storylines(df, spark.createDataFrame(tags, "event_id long, item string")).collect()} == want and len(want) > 100
