"""Joins of news with their audience: each pair once, made without meeting pair by pair."""

import random

from pyspark.sql import functions as F

from newsloom.plans import joins as J


def test_met_by_any_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "MEMBERS", 3)
    r = random.Random(5)
    things = [f"t{k}" for k in range(6)]
    left = [(k, k % 3, sorted(r.sample(things, r.randrange(5)))) for k in range(50)]
    right = [(f"m{k}", sorted(r.sample(things, r.choice([1, 1, 2, 4]))), "ab"[k % 2]) for k in range(70)]
    rows = J.met_by_any(spark.createDataFrame(left, "id long, tier int, has array<string>"), spark.createDataFrame(right, "m string, wants array<string>, kind string"), "m", ["kind"])
    assert sorted(rows.columns) == ["id", "kind", "members", "tier"]
    got = sorted((x.id, x.tier, x.m, x.kind) for x in rows.withColumn("m", F.explode("members")).collect())
    assert got == sorted((i, t, m, kind) for i, t, has in left for m, wants, kind in right if set(has) & set(wants))


def test_what_everybody_wants_is_dealt_over_parts_and_blocks(spark):
    """No join hands on a row for each pair: before the last step there are rows for events times blocks of readers."""
    left = spark.range(100).select("id", F.array(F.lit("all")).alias("has"))
    right = spark.range(5000).select(F.col("id").alias("m"), F.array(F.lit("all"), F.lit("more")).alias("wants"))
    met = J.met_by_any(left, right, "m")
    n, members, most = met.agg(F.count("*"), F.sum(F.size("members")), F.max(F.size("members"))).first()
    assert members == 500_000 and n <= 100 * 3 and most <= 2 * J.MEMBERS
